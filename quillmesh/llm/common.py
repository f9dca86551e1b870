"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession

from quillmesh.operators.scale import HOT_KEYS, free_name, materialize, remove, scratch, shared_dir, skew_join
from quillmesh.session import ship

__all__ = ["HOT_KEYS", "Query", "free_name", "held", "materialize", "remove", "scratch", "setup", "shared_dir", "shingle_hashes", "shingle_set", "skew_join", "table", "word_hashes"]

def setup(spark: SparkSession) -> None:
    """Ship the package, and bound the Arrow batches that reach Python, whatever the length of the texts."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_held: dict[str, object] = {}


def held(name: str, make: Callable[[], object]) -> object:
    """A worker's cache of that name; others go, so that stages do not add up their memory."""
    if name not in _held:
        _held.clear()
        _held[name] = make()
    return _held[name]


class WordHashes(dict):
    """64-bit hashes of words (bytes), remembered up to a bound."""

    BOUND = 500_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.BOUND:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def word_hashes(text: str | None) -> np.ndarray:
    """Hashes of the words of a text, A-Z in lower case, cut at ASCII white space."""
    if not text:
        return np.empty(0, np.uint64)
    words = text.encode("utf-8", "surrogatepass").lower().split()
    return np.fromiter(map(held("words", WordHashes).__getitem__, words), np.uint64, len(words))


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash for each run of `k` words in order; of all words where they are fewer; none for none."""
    n = len(words)
    if not n:
        return words
    k = min(k, n)
    out = np.full(n - k + 1, k, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            out ^= words[j : n - k + 1 + j]
            out *= np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
    return out


def shingle_set(text: str | None, k: int) -> np.ndarray:
    return np.unique(shingle_hashes(word_hashes(text), k))


Query = Callable[[SparkSession, str], DataFrame]
