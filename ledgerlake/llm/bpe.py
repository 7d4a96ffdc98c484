"""Byte-level BPE by the tiktoken library over a local rank file."""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame, SparkSession

from ledgerlake.llm.common import over_batches, table, text_of

RANKS = "byte_bpe_50k.tiktoken"
PIECE = 1 << 15  # characters after which a long text is cut at the next safe boundary
RUN = 1 << 10  # white space of this length is taken out of the pattern's hands
#: White space as the library's patterns have it; Python's own class has U+001C to U+001F too.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Cuts that no match of the pattern crosses: before a space after what isn't white space, and between a
#: kana or Han character and punctuation of its script. No match looks behind, and neither side leaves white space open.
SAFE = re.compile(rf"(?<=[^{SPACE}])(?= )|(?<=[\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fff])(?=[\u3001\u3002\uff01\uff0c\uff1f])")
BLANKS = re.compile(rf"[{SPACE}]{{{RUN},}}")


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str = public_tokenizers.PATTERN) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, size: int = PIECE) -> list[str]:
    """The text in parts that encode as the whole does. Text without a safe boundary stays in one part."""
    parts, at = [], 0
    while len(text) - at > size:
        cut = SAFE.search(text, at + size)
        if not cut:
            break
        parts.append(text[at : cut.start()])
        at = cut.start()
    parts.append(text[at:])
    return parts


def encode(enc: tiktoken.Encoding, text: str) -> np.ndarray:
    """Ids of the whole text as unsigned 32-bit numbers. A lone surrogate is read as the replacement character."""
    if len(text) <= PIECE:
        return enc.encode_to_numpy(text, disallowed_special=())
    out = []
    for part in pieces(text):
        at = 0
        for run in BLANKS.finditer(part) if len(part) > RUN else ():
            # as the pattern has it: all of a run at the end, else all but the last blank, are one match
            end = run.end() - (run.end() < len(part))
            out.append(enc.encode_to_numpy(part[at : run.start()], disallowed_special=()))
            out.append(np.array(enc._encode_single_piece(part[run.start() : end]), np.uint32))
            at = end
        out.append(enc.encode_to_numpy(part[at:], disallowed_special=()))
    return np.concatenate(out)


def decode(enc: tiktoken.Encoding, ids: np.ndarray) -> bytes:
    return enc.decode_bytes(ids.tolist())


def encoded(docs: DataFrame, path: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded), one row per row of docs: ids as little-endian unsigned 32-bit
    bytes, decoded as the raw bytes that the ids stand for. A null text counts as empty and has no
    tokens. Special strings are ordinary text. Columns other than doc_id and text are ignored. With
    with_ids false, ids and decoded are their SHA-256 in lower-case hex instead."""

    def make(batch: pa.RecordBatch) -> dict:
        enc = encoding(path)
        n, ids, back = [], [], []
        for text in batch.column(1).to_pylist():
            got = encode(enc, text)
            n.append(len(got))
            packed, raw = got.astype("<u4").tobytes(), decode(enc, got)
            ids.append(packed if with_ids else hashlib.sha256(packed).hexdigest())
            back.append(raw if with_ids else hashlib.sha256(raw).hexdigest())
        kind = pa.binary() if with_ids else pa.string()
        return {"doc_id": batch.column(0), "n_tokens": pa.array(n, pa.int64()), "ids": pa.array(ids, kind), "decoded": pa.array(back, kind)}

    kind, out = docs.schema["doc_id"].dataType.simpleString(), "binary" if with_ids else "string"
    return over_batches(docs.select("doc_id", text_of(docs).alias("text")), make, f"doc_id {kind}, n_tokens long, ids {out}, decoded {out}")


def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = encoded(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), with_ids=False)
    return found.withColumnsRenamed({"ids": "ids_sha256", "decoded": "decoded_sha256"})
