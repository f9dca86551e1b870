"""Periodic runs of words: repeated k-gram masking, then Main-Lorentz on what survives.

A run of least length `shortest` with two periods at least overlaps itself, shifted by
its period, in k = least_overlap(shortest) words or more, so all its words lie in k-grams
that the document has twice. Words outside such k-grams cannot join a run. The stretches
that survive are laid end to end, a separator of its own behind each, and searched by
the divide and conquer of Main and Lorentz, all centres of a batch at once: a repetition
across a centre shows where a word and the one a period away extend, to both sides
together, over a period at least. Extensions compare names of stretches of 2^j words
(equal exactly where the words are), so masking by hashes never changes a result.

One pass over the documents, no shuffle; a task holds a batch and, for its surviving
words, some 4 bytes a word and level of names.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, held, shingle_hashes

SHORTEST = 12
#: Centre and period pairs that are extended at a time.
PAIRS = 1 << 19
#: Surviving words that are searched together, about.
TOGETHER = 1 << 16
#: Bytes of a text that are split into words at a time.
PIECE = 1 << 20
BLANK = re.compile(rb"[ \t-\r]")


def least_overlap(shortest: int) -> int:
    """Words that a run shares with itself a period on, at least: max(shortest, 2q) - q over all periods q."""
    return -(-shortest // 2)


def pieces(data: bytes) -> Iterator[bytes]:
    """A text cut at blanks into pieces of about PIECE bytes."""
    at = 0
    while at < len(data):
        end = at + PIECE
        stop = BLANK.search(data, end) if end < len(data) else None
        end = stop.start() if stop else len(data)
        yield data[at:end]
        at = end


def split_words(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text, cut at ASCII white space, a piece of the text at a time."""
    return (piece.split() for piece in pieces(data))


def repeated_stretches(hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of words that lie in k-grams that occur twice (or collide)."""
    none = np.empty(0, np.int64), np.empty(0, np.int64)
    if len(hashes) < k + 1:
        return none
    grams = shingle_hashes(hashes, k)
    order = np.argsort(grams)
    same = grams[order[1:]] == grams[order[:-1]]
    if not same.any():
        return none
    twice = np.zeros(len(hashes) + 1, np.int64)
    at = np.concatenate([order[1:][same], order[:-1][same]])
    at = np.unique(at)
    twice[at] += 1
    twice[at + k] -= 1
    covered = np.concatenate([[False], np.cumsum(twice)[:-1] > 0, [False]])
    edge = np.flatnonzero(covered[1:] != covered[:-1])
    return edge[::2], edge[1::2]


class Extensions:
    """How far two places of a sequence agree, forwards and backwards, by names of 2^j items."""

    def __init__(self, items: np.ndarray):
        self.n = len(items)
        self.names = [np.unique(items, return_inverse=True)[1].astype(np.int32)]
        width = 1
        while 2 * width < self.n:
            last = self.names[-1]
            pair = last[:-width].astype(np.int64) << 32 | last[width:]
            _, first, name = np.unique(pair, return_index=True, return_inverse=True)
            if len(first) == len(pair):
                break  # no stretch so long occurs twice
            self.names.append(name.astype(np.int32))
            width *= 2

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Items from a and b on that agree; a < b."""
        out = np.zeros(len(a), np.int64)
        for j in range(len(self.names) - 1, -1, -1):
            name, width = self.names[j], 1 << j
            for _ in range(2 if j == len(self.names) - 1 else 1):  # the longest may fit twice
                at = np.flatnonzero(b + out < len(name))
                at = at[name[a[at] + out[at]] == name[b[at] + out[at]]]
                out[at] += width
        return out

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Items before a and b that agree; a < b."""
        out = np.zeros(len(a), np.int64)
        for j in range(len(self.names) - 1, -1, -1):
            name, width = self.names[j], 1 << j
            for _ in range(2 if j == len(self.names) - 1 else 1):
                at = np.flatnonzero((a - out >= width) & (b - out - width < len(name)))
                at = at[name[a[at] - out[at] - width] == name[b[at] - out[at] - width]]
                out[at] += width
        return out


def least_periods(runs: np.ndarray) -> np.ndarray:
    """The different rows; of equal ends the least period, as the others are multiples of it."""
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    return runs[np.concatenate([[True], (runs[1:, :2] != runs[:-1, :2]).any(axis=1)])] if len(runs) else runs


def main_lorentz(items: np.ndarray, starts: np.ndarray, ends: np.ndarray, shortest: int) -> np.ndarray:
    """(start, end, period) rows of the runs within the stretches [starts, ends) of `items`.

    Behind each stretch stands an item that occurs nowhere else. Place i is the centre of
    a node that reaches as far to both sides as the lowest bit of i; every run crosses
    one centre that is the highest within it, and has a period to one side of it.
    """
    where = Extensions(items)
    names = where.names[0]
    centre = np.concatenate([np.arange(s + 1, e) for s, e in zip(starts, ends, strict=True)] or [np.empty(0, np.int64)])
    of = np.repeat(np.arange(len(starts)), np.maximum(ends - starts - 1, 0))
    reach = centre & -centre
    right = np.minimum(reach, ends[of] - centre)
    left = np.minimum(reach, centre - starts[of])
    found = [np.empty((0, 3), np.int64)]
    for side, count in ((1, right), (-1, left)):
        total = np.cumsum(count)
        at = 0
        while at < len(centre):
            before = total[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(total, before + PAIRS, "right")))
            c = np.repeat(centre[at:end], count[at:end])
            p = np.arange(len(c)) - np.repeat(total[at:end] - count[at:end] - before, count[at:end]) + 1
            a, b = (c, c + p) if side > 0 else (c - p, c)
            some = (names[a] == names[b]) | (names[a - 1] == names[b - 1])  # else they agree on nothing
            a, b, p = a[some], b[some], p[some]
            start, stop = a - where.backward(a, b), b + where.forward(a, b)
            some = stop - start >= np.maximum(2 * p, shortest)
            found.append(least_periods(np.column_stack([start[some], stop[some], p[some]])))
            at = end
    return least_periods(np.concatenate(found))


def found_runs(docs: list[tuple[list[bytes], np.ndarray]], shortest: int = SHORTEST) -> list[np.ndarray]:
    """For each document, given as words and their hashes, its (start, length, period) rows by start, then period."""
    k = least_overlap(shortest)
    out = [np.empty((0, 3), np.int64) for _ in docs]
    waiting: list[tuple[int, int, list[bytes]]] = []
    size = 0

    def search() -> None:
        number: dict[bytes, int] = {}
        lengths = np.array([len(w) for _, _, w in waiting])
        items = np.empty(int(lengths.sum()) + len(waiting), np.int64)
        starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
        for s, (_, _, w) in zip(starts, waiting, strict=True):
            items[s : s + len(w)] = [number.setdefault(x, len(number)) for x in w]
        items[starts + lengths] = -1 - np.arange(len(waiting))
        runs = main_lorentz(items, starts, starts + lengths, shortest)
        of = np.searchsorted(starts, runs[:, 0], "right") - 1
        for i in np.unique(of):
            doc, begin, _ = waiting[i]
            mine = runs[of == i]
            mine = np.column_stack([mine[:, 0] - starts[i] + begin, mine[:, 1] - mine[:, 0], mine[:, 2]])
            out[doc] = np.concatenate([out[doc], mine])
        waiting.clear()

    for doc, (words, hashes) in enumerate(docs):
        for s, e in zip(*repeated_stretches(hashes, k), strict=True):
            if e - s >= shortest:
                waiting.append((doc, int(s), words[s:e]))
                size += int(e - s)
        if size >= TOGETHER:
            search()
            size = 0
    if waiting:
        search()
    return [r[np.lexsort((r[:, 2], r[:, 0]))] for r in out]


def collapsed(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """The words that no run contains behind its first period."""
    if not len(runs):
        return words
    steps = np.zeros(len(words) + 1, np.int64)
    np.add.at(steps, runs[:, 0] + runs[:, 2], 1)
    np.add.at(steps, runs[:, 0] + runs[:, 1], -1)
    return list(compress(words, (np.cumsum(steps)[:-1] == 0).tolist()))


def with_planted_run(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """Every tenth document, by the crc32 of its id, repeats a stretch of itself to its end; a null id none."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    period = words[a : a + p]
    return words[:a] + (period * (-(-(n - a) // p)))[: n - a]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST, change: Callable[[list[bytes], int | None], list[bytes]] | None = None, with_text: bool = True) -> DataFrame:
    """One row a row: doc_id, n_words, runs (array of start, length, period, by start, then
    period), runs_sha256 (of their lines), collapsed (the text without words that a run
    repeats; null unless `with_text`) and collapsed_sha256.

    A run is a stretch of words with least period q and `shortest` and 2q words at least,
    which no neighbouring word extends. Words are cut at ASCII white space and compared
    as they are. Null, empty and blank texts have no words and no runs. Rows that repeat
    an id or a text are judged each for itself; a null id stays null. `change` alters the
    words before the search. An empty table gives an empty result. Other columns are not
    read. A text is one task's, with some 100 bytes a word where it repeats itself.
    """

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            table = held("words", WordHashes)
            read = []
            for doc_id, text in zip(ids, batch.column(1), strict=True):
                words = [w for piece in split_words((text.as_py() or "").encode("utf-8", "surrogatepass")) for w in piece]
                words = change(words, doc_id) if change else words
                read.append((words, np.fromiter(map(table.__getitem__, words), np.uint64, len(words))))
            runs = found_runs(read, shortest)
            lines, kept = [], []
            for (words, _), mine in zip(read, runs, strict=True):
                lines.append(hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in mine.tolist()).encode()).hexdigest())
                kept.append(b" ".join(collapsed(words, mine)))
            flat = np.concatenate([np.empty((0, 3), np.int64), *runs])
            of = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(r) for r in runs])]), pa.int32()), pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], names=["start", "length", "period"]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([len(w) for w, _ in read], pa.int64()), of, pa.array(lines, pa.string()), pa.array([x.decode("utf-8", "surrogatepass") for x in kept] if with_text else [None] * len(kept), pa.string()), pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())],
                names=["doc_id", "n_words", "runs", "runs_sha256", "collapsed", "collapsed_sha256"],
            )

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(judged, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, runs_sha256 string, collapsed string, collapsed_sha256 string")


def longest_run(found: DataFrame) -> DataFrame:
    """`found` with n_runs and the start, length, period and exponent_milli of its longest run (ties: smallest start, then period)."""
    best = F.aggregate(
        "runs",
        F.lit(None).cast("struct<start:long,length:long,period:long>"),
        lambda top, r: F.when(top.isNull() | (r["length"] > top["length"]), r).otherwise(top),  # runs stand by start, then period
    )
    out = found.withColumn("best_", best)
    return out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best_.start", "best_.length", "best_.period", F.expr("best_.length * 1000 div best_.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
