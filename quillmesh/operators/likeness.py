"""How like each member of a group is to all others of it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pairs of a group whose shared words are counted at a time.
AT_ONCE = 1 << 19


def summed(words: pa.ListArray) -> np.ndarray:
    """For each set of words the sum of its Jaccard similarities, to nine digits, with all others."""
    n = words.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    term = np.unique(words.flatten().to_numpy(zero_copy_only=False), return_inverse=True)[1]
    of = np.repeat(np.arange(len(n)), n)
    order = np.argsort(term, kind="stable")
    posted, start = of[order], np.searchsorted(term[order], np.arange(term.max() + 2 if len(term) else 1))
    first = np.concatenate([[0], np.cumsum(n)])
    out = np.zeros(len(n))
    rows = max(1, AT_ONCE // max(1, len(n)))
    for low in range(0, len(n), rows):
        high = min(low + rows, len(n))
        t, row = term[first[low] : first[high]], of[first[low] : first[high]] - low
        count = start[t + 1] - start[t]
        # every posting of every word of these rows
        at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(start[t], count)
        both = np.bincount(np.repeat(row, count) * len(n) + posted[at], minlength=(high - low) * len(n))
        met = np.flatnonzero(both)
        a, b = met // len(n) + low, met % len(n)
        same = both[met]
        score = np.where(a == b, 0.0, np.round(same / (n[a] + n[b] - same), 9))
        out[low:high] = np.bincount(a - low, score, high - low)
    return out


def likeness(sets: DataFrame, group: str, id_col: str, words: str) -> DataFrame:
    """(group, id, s): the sum of each set's Jaccard similarities with the others of its group; a lone one has no row.

    A group goes to one task, as its ids and the hashes of its words; its pairs are
    counted by AT_ONCE, so memory grows with its members. A null set counts for none.
    """
    rows = sets.select(F.col(group).cast("long").alias(group), F.col(id_col).cast("long").alias(id_col), F.transform(words, lambda x: F.xxhash64(x)).alias("h"))

    def run(key, table):
        table = table.combine_chunks()
        if len(table) < 2:
            table = table.slice(0, 0)
        h = table.column("h").combine_chunks() if len(table) else pa.array([], pa.list_(pa.int64()))
        h = h.combine_chunks() if isinstance(h, pa.ChunkedArray) else h
        known = h.is_valid().to_numpy(zero_copy_only=False)
        s = np.zeros(len(h))
        s[known] = summed(h.filter(pa.array(known))) if known.any() else 0.0
        return pa.table({group: table.column(group), id_col: table.column(id_col), "s": pa.array(s, pa.float64(), mask=~known)})

    return rows.groupBy(group).applyInArrow(run, f"{group} long, {id_col} long, s double")
