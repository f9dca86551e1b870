"""Substring dedup: Rabin-Karp hashes of all windows of words, counted in Spark; repeated windows merge into removal intervals.

1. Equal texts are folded and written in chunks (a bucketed table, so that later passes
   read a chunk without a shuffle).
2. Every window of WINDOW words of a chunk gets two rolling hashes, 96 bits together, in
   constant time a window, however long it is. Its first 32 bits and a bin go, packed and
   once a chunk, to the bin, which counts in how many chunks each code is and answers
   with one bit a code. All windows take part in four bytes each.
3. Windows whose codes are in several chunks are counted again by their full hashes: the
   least document over all chunks. A chunk sends a hash once, so a window that very many
   documents share has a row a chunk at most, and windows of one hash are met in order,
   none held.
4. Within a chunk a window goes if a smaller document of the chunk, or by step 3 of
   another, has it; windows that go merge into maximal intervals, which are cut.

Windows are equal by 96-bit hashes: among 10^13 windows two that differ are taken for
equal with probability of about one in a thousand.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import held, materialize, remove, scratch, skew_join
from .periodic_runs import PIECE, pieces, split_words
from .suffix_dedup import NULL_ID, folded

WINDOW = 50
CHUNK_BYTES, WIDE_CHUNK_BYTES = 16 << 20, 64 << 20
#: Codes that one task counts, in bytes, about.
BIN_BYTES = 48 << 20
#: A chunk has so many bytes of text to a bin at least, so rows stay in proportion to codes.
CHUNK_SHARE = 1 << 10
BASES = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def layout(total: int) -> tuple[int, int]:
    """Chunks and bins for so many bytes of text, at a word in six bytes. From about a TB on chunks widen, and from five on bins."""
    bins = math.ceil(4 * total / 6 / BIN_BYTES)
    size = CHUNK_BYTES if bins <= CHUNK_BYTES // CHUNK_SHARE else WIDE_CHUNK_BYTES
    return max(12, math.ceil(total / size)), max(12, min(bins, size // CHUNK_SHARE))


def rolling(values: np.ndarray, base: int, k: int) -> np.ndarray:
    """Rabin-Karp, modulo 2^64: for each run of k values, the sum of value j times base^-j. The values are hashes themselves."""
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * _powers(pow(base, -1, 1 << 64), len(values))[:-1], dtype=np.uint64)])
        return (sums[k:] - sums[:-k]) * _powers(base, max(0, len(values) - k))


def mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ h >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ h >> np.uint64(32)


def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, np.uint64(base), np.uint64)]), dtype=np.uint64)


class WordHasher:
    """64-bit hashes of words, straight from the bytes: a sum of a random number a byte times a power of its place in the word."""

    BLANK = np.isin(np.arange(256), list(b" \t\n\v\f\r"))

    def __init__(self):
        self.number = np.random.Generator(np.random.PCG64(20_260_924)).integers(1, 1 << 63, 256, np.uint64)
        self.n = 0

    def block(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The words' hashes and the places of their first bytes."""
        a = np.frombuffer(data, np.uint8)
        if len(a) > self.n:
            self.n = max(len(a), PIECE)
            self.up, self.down = _powers(BASES[1], self.n), _powers(pow(BASES[1], -1, 1 << 64), self.n)
        inside = np.concatenate([[False], ~self.BLANK[a], [False]])
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        start, end = edge[::2], edge[1::2]
        with np.errstate(over="ignore"):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.number[a] * self.down[: len(a)], dtype=np.uint64)])
            return mixed((sums[end] - sums[start]) * self.up[start]), start

    def texts(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of all words of the texts in order, and how many each text has; a block of texts, or a piece of a long one, at a time."""
        hashes, counts = [np.empty(0, np.uint64)], np.zeros(len(texts), np.int64)
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) < PIECE):
                size += len(texts[end]) + 1
                end += 1
            if end == at + 1:
                for piece in pieces(texts[at]):
                    hashes.append(self.block(piece)[0])
                    counts[at] += len(hashes[-1])
            else:
                found, start = self.block(b"\n".join(texts[at:end]))
                hashes.append(found)
                first = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts[at:end]])])
                counts[at:end] = np.diff(np.searchsorted(start, first))
            at = end
        return np.concatenate(hashes), counts


class Windows:
    """The windows of a chunk's texts: h and g, their hashes; start, their first word, counted over the chunk; rank, that of their document's id."""

    def __init__(self, tab: pa.Table, k: int):
        w, self.lengths = held("hasher", WordHasher).texts(tab.column("data").to_pylist())
        self.ids, rank = np.unique(tab.column("doc_id").to_numpy(), return_inverse=True)
        n = np.maximum(self.lengths - k + 1, 0)
        first = np.concatenate([[0], np.cumsum(self.lengths)])
        self.first, self.words = first[:-1], int(first[-1])
        self.start = np.repeat(first[:-1] + n - np.cumsum(n), n) + np.arange(int(n.sum()))
        self.rank = np.repeat(rank, n)
        with np.errstate(over="ignore"):
            self.h = mixed(rolling(w, BASES[0], k)[self.start])
            self.g = (mixed(rolling(mixed(w * np.uint64(BASES[1])), BASES[1], k)[self.start]) >> np.uint64(32)).astype(np.int32)


def codes(h: np.ndarray, bins: int) -> np.ndarray:
    """A bin in the upper and a code in the lower half."""
    return (h >> np.uint64(32)) % np.uint64(bins) << np.uint64(32) | h & np.uint64(0xFFFFFFFF)


def least_rank(h: np.ndarray, g: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by (h, g, rank), where in it each (h, g) begins, and the least rank of each."""
    order = np.lexsort((rank, g, h))
    new = np.ones(len(order), bool)
    new[1:] = (h[order[1:]] != h[order[:-1]]) | (g[order[1:]] != g[order[:-1]])
    return order, new, rank[order[new]]


def in_other_chunks(texts: DataFrame, bins: int, k: int) -> DataFrame:
    """(chunk, bin, bits): which of a chunk's codes in that bin, in order, other chunks have too."""

    def send(key, tab):
        code = np.unique(codes(Windows(tab, k).h, bins))
        cut = np.searchsorted((code >> np.uint64(32)).astype(np.int64), np.arange(bins + 1))
        low = code.astype(np.uint32)
        return pa.table({"bin": pa.array(range(bins), pa.int64()), "chunk": pa.array([key[0].as_py()] * bins, pa.int64()), "low": pa.array([low[a:b].tobytes() for a, b in zip(cut, cut[1:], strict=False)], pa.binary())})

    def count(key, tab):
        arrays = [np.frombuffer(x.as_py(), np.uint32) for x in tab.column("low")]
        every = np.sort(np.concatenate(arrays))
        several = np.unique(every[1:][every[1:] == every[:-1]])
        bits = [np.packbits(several[np.minimum(np.searchsorted(several, a), len(several) - 1)] == a if len(several) else np.zeros(len(a), bool)).tobytes() for a in arrays]
        return pa.table({"chunk": tab.column("chunk"), "bin": tab.column("bin"), "bits": pa.array(bits, pa.binary())})

    return texts.groupBy("chunk").applyInArrow(send, "bin long, chunk long, low binary").groupBy("bin").applyInArrow(count, "chunk long, bin long, bits binary")


def candidates(texts: DataFrame, flags: DataFrame, bins: int, k: int) -> DataFrame:
    """(chunk, h, g, first): the windows whose codes are in several chunks, once a chunk with its smallest document."""

    def chosen(key, tab, flag):
        w = Windows(tab, k)
        code = codes(w.h, bins)
        every = np.unique(code)
        sizes = np.diff(np.searchsorted((every >> np.uint64(32)).astype(np.int64), np.arange(bins + 1)))
        bits = dict(zip(flag.column("bin").to_pylist(), flag.column("bits").to_pylist(), strict=True))
        hit = np.concatenate([np.unpackbits(np.frombuffer(bits[b], np.uint8), count=int(n)).astype(bool) if b in bits else np.zeros(n, bool) for b, n in enumerate(sizes)])
        several = every[hit]
        some = np.flatnonzero(several[np.minimum(np.searchsorted(several, code), len(several) - 1)] == code) if len(several) else np.empty(0, np.int64)
        order, new, least = least_rank(w.h[some], w.g[some], w.rank[some])
        at = some[order[new]]
        return pa.table({"chunk": pa.array([key[0].as_py()] * len(at), pa.int64()), "h": pa.array(w.h[at].view(np.int64)), "g": pa.array(w.g[at]), "first": pa.array(w.ids[least])})

    return texts.groupBy("chunk").cogroup(flags.groupBy("chunk")).applyInArrow(chosen, "chunk long, h long, g int, first long")


def cut_texts(texts: DataFrame, bins: int, k: int, used: list[str], with_text: bool) -> DataFrame:
    """One row a different text: digest_, rep (its smallest id), n_words, spans, kept, kept_sha256; `used` gets the scratch tables that it reads."""
    spark = texts.sparkSession

    def kept(df: DataFrame, tag: str) -> DataFrame:
        used.append(scratch(spark, tag))
        return materialize(df, used[-1])

    flags = kept(in_other_chunks(texts, bins, k), "flags")
    met = candidates(texts, flags, bins, k)
    least = F.min("first").over(Window.partitionBy("h", "g").orderBy("first").rowsBetween(Window.unboundedPreceding, 0))
    marks = kept(met.withColumn("least", least).filter("least < first").select("chunk", "h", "g"), "marks")

    def cut(key, tab, mark):
        w = Windows(tab, k)
        n_marks = mark.num_rows
        # a mark stands for a document that is smaller than all of the chunk
        h = np.concatenate([mark.column("h").to_numpy().view(np.uint64), w.h])
        ordered = np.sort(h)
        twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        some = np.flatnonzero(twice[np.minimum(np.searchsorted(twice, h), len(twice) - 1)] == h) if len(twice) else np.empty(0, np.int64)
        g = np.concatenate([mark.column("g").to_numpy(), w.g])[some]
        rank = np.concatenate([np.full(n_marks, -1, np.int64), w.rank])[some]
        order, new, least = least_rank(h[some], g, rank)
        gone = order[rank[order] > least[np.cumsum(new) - 1]]
        starts = w.start[some[gone] - n_marks]
        steps = np.bincount(starts, minlength=w.words + 1) - np.bincount(starts + k, minlength=w.words + 1)[: w.words + 1]
        removed = np.cumsum(steps)[: w.words] > 0
        total = np.concatenate([[0], np.cumsum(removed)])
        spans, texts_, shas = [], [], []
        for data, a, n in zip(tab.column("data"), w.first.tolist(), w.lengths.tolist(), strict=True):
            mine = removed[a : a + n]
            if total[a + n] > total[a]:
                edge = np.flatnonzero(np.diff(np.concatenate([[0], mine.view(np.int8), [0]])))
                spans.append([{"start": s, "end": e} for s, e in edge.reshape(-1, 2).tolist()])
            else:
                spans.append([])
            sha, at, out = hashlib.sha256(), 0, []
            for words in split_words(data.as_py()):
                left = list(compress(words, (~mine[at : at + len(words)]).tolist())) if spans[-1] else words
                at += len(words)
                if left:
                    out.append(b" ".join(left))
            joined = b" ".join(out)
            sha.update(joined)
            shas.append(sha.hexdigest())
            texts_.append(joined.decode("utf-8", "surrogatepass") if with_text else None)
        return pa.table({"digest_": tab.column("digest"), "rep": tab.column("doc_id"), "n_words": pa.array(w.lengths), "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), "kept": pa.array(texts_, pa.string()), "kept_sha256": pa.array(shas, pa.string())})

    schema = "digest_ binary, rep long, n_words long, spans array<struct<start:long,end:long>>, kept string, kept_sha256 string"
    return texts.groupBy("chunk").cogroup(marks.groupBy("chunk")).applyInArrow(cut, schema)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, with_text: bool = True) -> DataFrame:
    """One row per row: doc_id, n_words, spans (maximal intervals [start, end) of removed words), kept (the rest, words joined by
    one space; null unless `with_text`), kept_sha256.

    A word goes where a window of `window` words that covers it also starts in a document
    with a smaller id. Words are cut at ASCII white space and compared as they are; null
    and blank texts have none; windows do not cross documents and are judged on the input.
    A null id ranks below all others. Rows that repeat an id and a text are alike; other
    rows that repeat an id are judged each against smaller ids. An empty table gives an
    empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.col(f"`{text_col}`").alias("text_"))
    seen = rows.agg(F.sum(F.octet_length("text_")), F.count(F.lit(1))).first()
    chunks, bins = layout(seen[0] or 0)
    name, where = f"quillmesh_chunks_{uuid.uuid4().hex[:12]}", scratch(spark, "chunks")
    used = [where]
    try:
        folded(rows, chunks).write.format("parquet").option("compression", "zstd").option("path", where).bucketBy(chunks, "chunk").sortBy("chunk").saveAsTable(name)
        judged = materialize(cut_texts(spark.table(name), bins, window, used, with_text), scratch(spark, "judged"))
    finally:  # also where a step fails
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove(spark, *used)
    named = rows.select("doc_id", F.unhex(F.sha2(F.coalesce("text_", F.lit("")), 256)).alias("digest"))
    met = skew_join(named, judged.withColumnRenamed("digest_", "digest"), "digest", F.col("doc_id"), seen[1])
    copy = (F.col("doc_id") != F.col("rep")) & (F.col("n_words") >= window)
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_words").alias("end")))
    return met.select(
        F.nullif("doc_id", F.lit(NULL_ID)).alias("doc_id"),
        "n_words",
        F.when(copy, whole).otherwise(F.col("spans")).alias("spans"),
        F.when(copy, F.lit("") if with_text else F.lit(None)).otherwise(F.col("kept")).alias("kept"),
        F.when(copy, F.lit(EMPTY_SHA256)).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
    )
