"""What the text operators share: tables, the shared folder, bounded samples and Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that are worked on together in Python. Spark bounds the bytes of an Arrow batch; this bounds what is made of it.
BATCH_ROWS = 256

_own_folder: dict[str, str] = {}
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder path under spark.checkpoint.dir, which driver and executors share.

    Where that setting is unset and the master is local, as in tests on one machine, a temporary folder
    stands in; on a cluster that is an error, since executors couldn't read each other's folders.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        app = spark.conf.get("spark.app.id")
        if app not in _own_folder:
            _own_folder[app] = tempfile.mkdtemp(prefix="ledgerlake-")
        base = _own_folder[app]
    path = f"{base.rstrip('/')}/ledgerlake/{name}-{uuid.uuid4().hex}"
    if (made := _made.get()) is not None:
        made.append(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared folder and read back: cuts the lineage, and outlives lost executors."""
    path = shared_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Deletes folders. Over Spark Connect, which gives no file system, they stay until the shared folder is cleared."""
    jvm = getattr(spark, "_jvm", None)
    for path in paths if jvm is not None else ():
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables stored inside the block are deleted at its end; what is made of them has to be written before, outside of it."""
    token = _made.set([])
    try:
        yield
    finally:
        made = _made.get()
        _made.reset(token)
        discard(spark, made or [])


def text_of(df: DataFrame, column: str = "text") -> Column:
    return F.coalesce(df[column].cast("string"), F.lit(""))


def crc_mod(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo n; a null key counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % n


def over_batches(df: DataFrame, make: Callable[[pa.RecordBatch], dict], schema: str) -> DataFrame:
    """mapInArrow of a function from a batch of at most BATCH_ROWS rows to named columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                yield pa.RecordBatch.from_pydict(make(batch.slice(at, BATCH_ROWS)))

    return df.mapInArrow(run, schema)


def bounded_sample(df: DataFrame, key: Column, rows: int) -> DataFrame:
    """At most `rows` rows, spread by a hash of the key, the same ones on every run.

    A larger table is thinned by the hash to about three times as many rows before they are ranked, so
    what tasks send on does not grow with their number."""
    n = df.count()
    place = F.pmod(F.xxhash64(key), F.lit(1 << 30))
    thin = df if n <= 3 * rows else df.where(place < -(-3 * rows * (1 << 30) // n))
    return thin.orderBy(place, key).limit(rows)


def spread_join(rows: DataFrame, known: DataFrame, keys: list[str], by: Column, how: str = "inner", sizes: DataFrame | None = None, share: int = 1000) -> DataFrame:
    """rows joined with known by keys, of which known has each at most once; keys are never null.

    A key that more than one in `share` rows has, of which there are fewer than `share`, is dealt over
    as many salts as it has such shares, by a hash of `by` (columns of rows), and its row of known is repeated for each. So no task gets
    all rows of a hot key, and what is broadcast, the hot keys, is bounded. sizes (keys, n) may be given
    if the rows of each key have been counted already.
    """
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("n")) if sizes is None else sizes.select(*keys, "n")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    hot = sizes.where(F.col("n") * share > total).where("n > 100").select(*(F.col(k).alias(f"__{k}") for k in keys), F.ceil(F.col("n") * share / max(total, 1)).cast("int").alias("__salts"))
    hot = F.broadcast(stored(hot, "hot-keys"))

    def salted(df: DataFrame, salt: Column) -> DataFrame:
        met = df.join(hot, [F.col(k) == F.col(f"__{k}") for k in keys], "left")
        return met.withColumn("__salt", salt).drop("__salts", *(f"__{k}" for k in keys))

    salts = F.coalesce("__salts", F.lit(1))
    left = salted(rows, F.pmod(F.xxhash64(by), salts).cast("int"))
    right = salted(known, F.explode(F.sequence(F.lit(0), salts - 1)))
    return left.join(right, [*keys, "__salt"], how).drop("__salt")


#: Bits of the map of digests, whatever the number of keys: 16 MB in 4,096 rows.
MAP_BITS = 27


def digest_map(keys: DataFrame, digest: str) -> DataFrame:
    """(bucket, bits) of the first MAP_BITS bits of binary digests: at most 4,096 rows of 4 KB, so it may be broadcast at any size of keys."""
    place = F.shiftright(F.conv(F.hex(F.substring(digest, 1, 4)), 16, 10).cast("long"), 32 - MAP_BITS)
    return keys.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))


def maybe_among(df: DataFrame, digest: Column, keys: DataFrame) -> DataFrame:
    """df with __maybe: false where a digest is in none of the rows of digest_map(). All others are true, and as many more as the map is full: one in a
    hundred with a million keys, most with a hundred million, so what depends on it has to be right for any of them."""
    place = F.shiftright(F.conv(F.hex(F.substring(digest, 1, 4)), 16, 10).cast("long"), 32 - MAP_BITS)
    placed = df.withColumn("__bucket", F.bitmap_bucket_number(place)).withColumn("__bit", F.bitmap_bit_position(place))
    met = placed.join(F.broadcast(keys.select(F.col("bucket").alias("__b"), F.col("bits").alias("__bits"))), F.col("__bucket") == F.col("__b"), "left")
    byte = F.conv(F.hex(F.substr("__bits", (F.col("__bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.getbit(byte, (F.col("__bit") % 8).cast("int")) == 1
    return met.withColumn("__maybe", F.coalesce(hit, F.lit(False))).drop("__bucket", "__bit", "__b", "__bits")
