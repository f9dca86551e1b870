"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Long texts are cut before they reach the library, at boundaries that cannot lie within
a match of the pattern, so the pieces give the ids of the whole text.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import tiktoken
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

from .common import held

#: Texts beyond so many characters are cut.
PIECE = 1 << 16
#: A character that no engine takes for white space, before a blank or a line feed: every
#: alternative of the pattern ends there, and none looks back.
SAFE = re.compile(r"[^\s](?=[ \n])")
#: A run of white space beyond so many characters is resolved here: the library's regex
#: engine recurses over such a run.
LONG_RUN = 1 << 12
#: White space as the library's engine has it (the property White_Space), a fixed list.
BLANK = "\\t\\n\\x0b\\x0c\\r\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
RUN = re.compile(f"[{BLANK}]{{{LONG_RUN},}}")

def encoding(ranks: bytes, pattern: str) -> tiktoken.Encoding:
    """The encoding of a rank file's bytes, kept for the life of the worker."""

    def make() -> tiktoken.Encoding:
        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    return held("encoding " + hashlib.sha256(ranks + pattern.encode()).hexdigest(), make)


def _cut(text: str, size: int) -> Iterator[str]:
    at = 0
    while len(text) - at > size:
        found = SAFE.search(text, at + size - 1)
        if not found:
            break
        yield text[at : found.end()]
        at = found.end()
    yield text[at:]


def _merged(enc: tiktoken.Encoding, run: str) -> list[int]:
    """Ids of one match that is a long run, without the pattern."""
    return enc._core_bpe.encode_single_piece(run.encode())


def encode(enc: tiktoken.Encoding, text: str, size: int = PIECE) -> list[int]:
    """Ids of the whole text, as `enc.encode_ordinary` gives them."""
    ids: list[int] = []
    for piece in _cut(text, size) if len(text) > size else (text,):
        at = 0
        if len(piece) > LONG_RUN:
            for found in RUN.finditer(piece):
                # all but the last blank of the run are one match; the last one stays with what follows
                end = found.end() if found.end() == len(piece) else found.end() - 1
                ids += enc.encode_ordinary(piece[at : found.start()])
                ids += _merged(enc, piece[found.start() : end])
                at = end
        ids += enc.encode_ordinary(piece[at:] if at else piece)
    return ids


def encode_decode(docs: DataFrame, ranks: Broadcast, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per row: doc_id, n_tokens, ids_sha256, decoded_sha256 and (with_ids) ids.

    Null texts count as empty: no ids, the digests of nothing. Rows with null or
    repeated ids are encoded each for itself; other columns are not read. Nothing is
    shuffled. ids: array of int.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks.value, pattern)
        words = [str(i) for i in range(enc.max_token_value + 1)]
        for batch in batches:
            counts, shas, decoded, kept = [], [], [], []
            for text in batch.column(1):
                ids = encode(enc, text.as_py() or "")
                counts.append(len(ids))
                shas.append(hashlib.sha256(" ".join(map(words.__getitem__, ids)).encode()).hexdigest())
                decoded.append(hashlib.sha256(enc.decode_bytes(ids)).hexdigest())
                if with_ids:
                    kept.append(ids)
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(shas, pa.string()), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(kept, pa.list_(pa.int32()))] * with_ids, names=names)

    return docs.selectExpr(f"cast(`{id_col}` as bigint) doc_id", f"`{text_col}`").mapInArrow(run, schema)


def rank_file(spark: SparkSession, path: str) -> Broadcast:
    """The rank file's bytes, read on the driver: a vocabulary, whose size does not grow with the data."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())
