"""WARC archives compressed record by record with a dictionary built from the archived records.

An archive file starts with a skippable frame that holds the dictionary; then comes one Zstandard
frame for each record, the first of them a warcinfo record. An archive is closed once it has
ARCHIVE_BYTES, so none grows with a partition. Spark's text writer lays each down as a file of one row,
so that any file system it knows and its commit protocol serve, and a task that is run again leaves
nothing behind; its names end in .txt. The separator that this writer puts after a row is an empty
skippable frame, which readers of the format pass over.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.llm.common import bounded_sample, shared_folder, spread_join, stored, table

DICT_MAGIC = bytes.fromhex("5d2a4d18")  # skippable frame 0x184D2A5D, little-endian
GAP_MAGIC = bytes.fromhex("502a4d18")  # skippable frame 0x184D2A50
GAP = (GAP_MAGIC + bytes(4)).decode("ascii")
FRAME_MAGIC = bytes.fromhex("28b52ffd")
DICT_BYTES = 1 << 16
SAMPLE_ROWS = 400  # records that the dictionary is built from, at most
ARCHIVE_BYTES = 1 << 24  # compressed bytes after which an archive is closed
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"  # of every record, so that equal pages give equal archives
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def _line(value: str | None) -> str:
    """A header value on one line."""
    return " ".join((value or "").split())


def warcinfo(number: int, part: int) -> bytes:
    """The record that describes an archive, named by its partition and place in it."""
    block = b"software: ledgerlake\r\nformat: WARC File Format 1.1\r\n"
    name = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'archive:{part}:{number}')}>"
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: {name}", f"WARC-Date: {DATE}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def warc_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response record, or with refers_to a revisit record that has the HTTP head only."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {_line(url)}", f"WARC-Payload-Digest: sha1:{digest}"]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if revisit:
        head += [f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page-Id: {refers_to}", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], int, bytes | None]:
    """(WARC headers, length of the full payload, payload or None for a revisit or a warcinfo). Payload digests are verified."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record does not end where its length says")
    if fields["WARC-Type"] == "warcinfo":
        return fields, 0, None
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(http.rsplit(b"Content-Length: ", 1)[1])
    if fields["WARC-Type"] == "revisit":
        return fields, size, None
    if len(payload) != size or fields["WARC-Payload-Digest"] != "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode():
        raise ValueError("a payload does not match its digest")
    return fields, size, payload


def frames(data: bytes) -> Iterator[bytes]:
    """The records of one archive: skippable frames are passed over, the leading one gives the dictionary."""
    at, tool = 0, zstandard.ZstdDecompressor()
    view = memoryview(data)
    while at < len(data):
        magic = data[at : at + 4]
        if magic != FRAME_MAGIC:
            if magic not in (DICT_MAGIC, GAP_MAGIC):
                raise ValueError(f"no frame at byte {at}")
            size = int.from_bytes(data[at + 4 : at + 8], "little")
            if magic == DICT_MAGIC:
                tool = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[at + 8 : at + 8 + size]))
            at += 8 + size
            continue
        one = tool.decompressobj()
        out = [one.decompress(view[at : at + 65536])]
        used = min(65536, len(data) - at)
        while not one.eof:
            if at + used >= len(data):
                raise ValueError("the archive ends within a frame")
            out.append(one.decompress(view[at + used : at + used + 65536]))
            used += min(65536, len(data) - at - used)
        at += used - len(one.unused_data)
        yield b"".join(out)


def build_dictionary(records: list[bytes]) -> bytes:
    """A trained dictionary, or, where there is too little to train on, the records themselves as a raw one."""
    if not records:
        return b""
    try:
        return zstandard.train_dictionary(DICT_BYTES, records).as_bytes()
    except zstandard.ZstdError:
        return b"".join(records)[-DICT_BYTES:]


def with_revisits(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, sha1, refers_to): of equal payloads the smallest page_id is the response.
    Payloads are equal if their SHA-1 digests and lengths are. Repeated rows of that page_id are responses too."""
    html = F.coalesce(pages["html"].cast("string"), F.lit("")).cast("binary")
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), html.alias("payload"), F.sha1(html).alias("sha1"), F.octet_length(html).alias("size"))
    first = stored(rows.groupBy("sha1", "size").agg(F.min("page_id").alias("first"), F.count("*").alias("n")), "payloads")
    joined = spread_join(rows, first.drop("n"), ["sha1", "size"], F.col("page_id"), sizes=first)
    return joined.select("page_id", "url", "payload", "sha1", F.when(F.col("page_id") > F.col("first"), F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, size: int = ARCHIVE_BYTES) -> None:
    """Writes the archives of each partition of pages (page_id, url, html) under folder; size is that in ARCHIVE_BYTES.

    A null html is an empty payload, a null url an empty target; a row without page_id is a response.
    The dictionary comes from at most SAMPLE_ROWS records, chosen by a hash, whole whatever their length.
    An empty table writes no record. Columns other than these three are ignored.
    """
    sample = bounded_sample(pages.select("page_id", "url", "html"), F.col("page_id"), SAMPLE_ROWS).collect()
    digest = lambda b: base64.b32encode(hashlib.sha1(b).digest()).decode()
    trained = build_dictionary([warc_record(r[0], r[1], b, digest(b), None) for r in sample for b in [(r[2] or "").encode("utf-8", "surrogatepass")]])
    lead = DICT_MAGIC + len(trained).to_bytes(4, "little") + trained

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(trained) if trained else None)
        archive, held, number = [], 0, 0
        for batch in batches:
            for page_id, url, payload, sha, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                if not archive:
                    archive, held, number = [lead, pack.compress(warcinfo(number, part))], 0, number + 1
                archive.append(pack.compress(warc_record(page_id, url, payload, base64.b32encode(bytes.fromhex(sha)).decode(), refers_to)))
                held += len(archive[-1])
                if held >= size:
                    yield pa.RecordBatch.from_pydict({"value": pa.array([b"".join(archive)], pa.binary())})
                    archive = []
        if archive:
            yield pa.RecordBatch.from_pydict({"value": pa.array([b"".join(archive)], pa.binary())})

    packed = with_revisits(pages).mapInArrow(run, "value binary")
    packed.select(F.col("value").cast("string").alias("value")).write.option("lineSep", GAP).option("compression", "none").option("maxRecordsPerFile", 1).text(folder)


def read_archives(spark: SparkSession, folder: str, with_payload: bool = True) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload), a row for each record
    of the archives under folder. A payload that does not match its digest or length is an error."""
    fields = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload
    names = [x.split()[0] for x in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows: list = []
                for raw in frames(content.as_py()):
                    head, size, payload = parse_record(raw)
                    if head["WARC-Type"] == "warcinfo":
                        continue
                    number = lambda k: int(head[k]) if k in head else None  # noqa: B023, E731
                    rows.append((number("X-Page-Id"), head["WARC-Target-URI"], size, head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"], number("X-Refers-To-Page-Id"), payload)[: len(names)])
                    if len(rows) == 256:
                        yield batch_of(rows)
                        rows = []
                if rows:
                    yield batch_of(rows)

    def batch_of(rows: list) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    files = spark.read.format("binaryFile").load(folder).where("length > 0").select("content")
    return files.mapInArrow(run, fields)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), folder)
    return read_archives(spark, folder, with_payload=False).drop("url")


#: The same rows from the table alone; base32 of a digest is spelled four characters for every five hex digits.
OP10_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
x AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS d, min(page_id) OVER (PARTITION BY h) AS f FROM p)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(8), lambda i: array_to_string(list_transform([15, 10, 5, 0], lambda s:
           substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(d, 5 * i::INT + 1, 5))::INT >> s) & 31) + 1), 1)), '')), '') AS payload_digest,
       CASE WHEN page_id > f THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > f THEN f END AS refers_to
FROM x
"""
