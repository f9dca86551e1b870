"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are short and documents long, so a Jaccard sketch of both would be hopeless.
The sketch is the item's alone: its bottom-L MinHash, tested against the document's whole
shingle set. Items are partitioned by set size into powers of two, and L follows from the
partition's upper bound: one more than the shingles that a document at the threshold may
lack, so that such a document holds one of the L at least and none is missed. A document
meets only the partitions that it is large enough for. Candidates are then verified by
exact shingle containment.

Items reach the executors in blocks of a fixed size; each block is one pass over the
documents, so neither a broadcast nor the driver grows with the number of items.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shingle_hashes, word_hashes

#: Words of the items in one block, on average.
BLOCK_WORDS = 1_000_000


class Partition:
    """Items of one shingle length and size class."""

    def __init__(self, k: int, upper: int, items: list[tuple[int, np.ndarray]], percent: int):
        self.k, self.items = k, items
        length = upper - math.ceil(upper * percent / 100) + 1
        self.least = min(math.ceil(len(s) * percent / 100) for _, s in items)
        sketches = []
        for i, (_, s) in enumerate(items):
            with np.errstate(over="ignore"):
                order = np.argsort((s ^ (s >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93), kind="stable")
            low = s[order[:length]]
            sketches.append(np.stack([low, np.full(len(low), i, np.uint64)]))
        keys, owner = np.concatenate(sketches, axis=1)
        order = np.argsort(keys, kind="stable")
        self.keys, self.owner = keys[order], owner[order].astype(np.int64)

    def search(self, shingles: np.ndarray, percent: int) -> list[tuple[int, int, int]]:
        """(item, size, shared) of the items that the sorted set contains."""
        if len(shingles) < self.least:
            return []
        at = np.searchsorted(self.keys, shingles)
        hit = self.keys[np.minimum(at, len(self.keys) - 1)] == shingles
        if not hit.any():
            return []
        low, high = at[hit], np.searchsorted(self.keys, shingles[hit], "right")
        wanted = np.unique(np.concatenate([self.owner[a:b] for a, b in zip(low, high, strict=True)]))
        out = []
        for i in wanted.tolist():
            item, s = self.items[i]
            at = np.searchsorted(shingles, s)
            shared = int((shingles[np.minimum(at, len(shingles) - 1)] == s).sum())
            if 100 * shared >= percent * len(s):
                out.append((item, len(s), shared))
        return out


class Index:
    """The size partitions of one block of items."""

    def __init__(self, items: list[tuple[int, str]], words: int, percent: int):
        classes: dict[tuple[int, int], list[tuple[int, np.ndarray]]] = {}
        for item, text in items:
            w = word_hashes(text)
            if len(w):
                k = min(words, len(w))
                s = np.unique(shingle_hashes(w, k))
                classes.setdefault((k, len(s).bit_length()), []).append((item, s))
        self.percent = percent
        self.partitions = [Partition(k, (1 << bits) - 1, found, percent) for (k, bits), found in sorted(classes.items())]

    def search(self, text: str | None) -> list[tuple[int, int, int]]:
        w = word_hashes(text)
        sets: dict[int, np.ndarray] = {}
        out = []
        for p in self.partitions:
            if len(w) < p.k:
                continue
            if p.k not in sets:
                sets[p.k] = np.unique(shingle_hashes(w, p.k))
            out += p.search(sets[p.k], self.percent)
        return out


def blocks_of(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks, dealt by a hash of the id; empty texts are left out."""
    rows = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("item_text")).filter("item_text is not null and item_id is not null")
    n = rows.agg(F.sum(F.octet_length("item_text"))).first()[0] or 0
    blocks = math.ceil(n / 6 / BLOCK_WORDS)
    for b in range(blocks):
        yield [(r.item_id, r.item_text) for r in rows.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).orderBy("item_id", "item_text").collect()]


def contained_items(docs: DataFrame, items: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, n_item, n_shared, containment), one row for each item within a document.

    An item is within a document that has `percent` per cent of its distinct shingles of
    `words` words (ASCII lower case, cut at ASCII white space). An item of fewer words is
    one shingle, sought among the document's runs of as many words. Items without words,
    null items and items with a null id are within nothing, and nothing is within a text that is null or
    empty. Rows that repeat a document or an item give rows of their own. Either table may
    be empty. Other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.selectExpr(f"cast(`{id_col}` as bigint) doc_id", f"`{text_col}`")
    schema = "doc_id long, item_id long, n_item long, n_shared long, containment double"
    out = None
    for block in blocks_of(items, item_id_col, item_text_col):
        index = spark.sparkContext.broadcast(Index(block, words, percent))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [(doc, item, n, shared, shared / n) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for item, n, shared in index.value.search(text.as_py())]
                columns = list(zip(*found, strict=True)) if found else [[]] * 5
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "item_id", "n_item", "n_shared", "containment"])

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.union(part)
    return spark.createDataFrame([], schema) if out is None else out


def without_items(docs: DataFrame, items: DataFrame, words: int = 5, percent: int = 80, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of `docs`, with all their columns, whose text contains none of the items."""
    at = docs.columns.index(text_col)
    spark = docs.sparkSession
    for block in blocks_of(items, item_id_col, item_text_col):
        index = spark.sparkContext.broadcast(Index(block, words, percent))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not index.value.search(text.as_py()) for text in batch.column(at)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
