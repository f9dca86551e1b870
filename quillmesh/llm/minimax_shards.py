"""Sharding by minimax contiguous partition.

Groups of equal texts are the atoms, in the order of their smallest id. The smallest
capacity at which the ordered sizes fit into the shards is found by binary search, each
step checked greedily; the cuts then lie within the bounds that this capacity leaves,
as near to equal sizes as it allows.

Sizes stay distributed: the driver holds the sums of at most BLOCKS blocks of groups
and reads the few blocks where a cut may fall.
"""

from __future__ import annotations

import bisect
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, scratch, skew_join

#: Blocks of groups whose sums the driver holds, beside one a partition.
BLOCKS = 50_000
LEAST_BLOCK = 4096
#: monotonically_increasing_id() has the row within its partition in so many low bits.
ROW_BITS = 33


class Sizes:
    """Prefix sums of ordered positive sizes, looked up block by block."""

    def __init__(self, sums: list[int], load):
        self.base = [0]
        for s in sums:
            self.base.append(self.base[-1] + s)
        self.total, self._load, self._held = self.base[-1], load, {}

    def _block(self, i: int) -> np.ndarray:
        if i not in self._held:
            self._held[i] = self.base[i] + np.cumsum(np.array(self._load(i), np.int64))
        return self._held[i]

    def down(self, x: int) -> int:
        """The largest prefix sum of at most x."""
        if x >= self.total:
            return self.total
        i = bisect.bisect_right(self.base, x) - 1
        if self.base[i] == x:
            return x
        ends = self._block(i)
        k = int(np.searchsorted(ends, x, "right"))
        return int(ends[k - 1]) if k else self.base[i]

    def up(self, x: int) -> int:
        """The smallest prefix sum of at least x."""
        if x <= 0:
            return 0
        i = bisect.bisect_left(self.base, x)
        if self.base[i] == x:
            return x
        ends = self._block(i - 1)
        return int(ends[np.searchsorted(ends, x, "left")])

    def coarse(self, x: int) -> int:
        return self.base[bisect.bisect_right(self.base, x) - 1]


def fits(sizes: Sizes, shards: int, capacity: int) -> bool:
    for look in (sizes.coarse, sizes.down):  # block ends alone may do
        at = 0
        for _ in range(shards):
            at = look(min(at + capacity, sizes.total))
        if at == sizes.total:
            return True
    return False


def minimax_cuts(sizes: Sizes, shards: int, largest: int) -> tuple[int, list[int]]:
    """The smallest feasible capacity, and the prefix sums at which shards 1.. begin."""
    low = max(largest, math.ceil(sizes.total / shards))
    high = low + largest
    while low < high:
        middle = (low + high) // 2
        if fits(sizes, shards, middle):
            high = middle
        else:
            low = middle + 1
    earliest = [sizes.total]
    for _ in range(shards - 1):  # what is left must fit into the shards that are left
        earliest.append(sizes.up(earliest[-1] - low))
    cuts, at = [], 0
    for j in range(1, shards):
        aim = at + (sizes.total - at) // (shards - j + 1)
        near = min(sizes.down(aim), sizes.up(aim), key=lambda p: abs(p - aim))
        at = max(min(near, sizes.down(at + low)), earliest[shards - j], at)
        cuts.append(at)
    return low, cuts


def minimax_shards(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, size, text_crc32, shard, slot.

    size: UTF-8 bytes of the text and one; a null text has none and counts as an empty
    one. Equal texts share a shard. slot: the row's place in its shard, from 0, in the
    order of groups and ids. Rows that repeat an id and text take a slot each. Null ids
    come first. Texts count as equal by their SHA-256. An empty table gives an empty
    result. Other columns are not read.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("digest_"))
    groups = materialize(rows.groupBy("digest_").agg(F.min("doc_id").alias("first_id"), F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")), scratch(spark, "groups"))
    known = groups.agg(F.count(F.lit(1)).alias("groups"), F.max("bytes").alias("largest"), F.sum("n").alias("rows")).first()
    per_block = max(LEAST_BLOCK, math.ceil(known.groups / BLOCKS))
    ordered = groups.repartitionByRange("first_id", "digest_").sortWithinPartitions("first_id", "digest_").withColumn("at_", F.monotonically_increasing_id())
    ordered = materialize(ordered.withColumn("part_", F.shiftright("at_", ROW_BITS)).withColumn("block_", F.floor(F.col("at_").bitwiseAND((1 << ROW_BITS) - 1) / per_block)).withColumn("block_", F.shiftleft(F.col("part_"), 32) + F.col("block_")).drop("part_"), scratch(spark, "ordered"))
    blocks = ordered.groupBy("block_").agg(F.sum("bytes").alias("bytes")).orderBy("block_").collect()  # BLOCKS and one a partition at most

    def load(i: int) -> list[int]:
        return [r.bytes for r in ordered.filter(F.col("block_") == blocks[i].block_).select("at_", "bytes").orderBy("at_").collect()]

    sizes = Sizes([b.bytes for b in blocks], load)
    _, cuts = minimax_cuts(sizes, shards, known.largest or 0)
    bases = spark.createDataFrame([(b.block_, at) for b, at in zip(blocks, sizes.base, strict=False)], "block_ long, base long")
    starts = (
        ordered.join(F.broadcast(bases), "block_")
        .withColumn("begins", F.expr("base + sum(bytes) over (partition by block_ order by at_) - bytes"))
        .select("digest_", "n", "begins")
        .withColumn("shard", sum((F.col("begins") >= F.lit(c)).cast("int") for c in cuts) if cuts else F.lit(0))
    )
    starts = materialize(starts, scratch(spark, "starts"))
    joined = skew_join(rows, starts, "digest_", F.col("doc_id"), known.rows or 0, counts="n").drop("digest_", "n")
    joined = materialize(joined, scratch(spark, "placed"))
    placed = materialize(joined.repartitionByRange("begins", "doc_id").sortWithinPartitions("begins", "doc_id").withColumn("at_", F.monotonically_increasing_id()), scratch(spark, "slots"))
    part = F.shiftright("at_", ROW_BITS)
    counts = {(r.part, r.shard): r.n for r in placed.groupBy(part.alias("part"), "shard").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a partition and cut
    in_part: dict[int, int] = {}
    in_shard: dict[int, int] = {}
    for (p, s), n in counts.items():
        in_part[p] = in_part.get(p, 0) + n
        in_shard[s] = in_shard.get(s, 0) + n
    before, at = {}, 0
    for p in sorted(in_part):
        before[p], at = at, at + in_part[p]
    firsts, at = {}, 0
    for s in sorted(in_shard):
        firsts[s], at = at, at + in_shard[s]
    offsets = spark.createDataFrame([(p, s, before[p] - firsts[s]) for p, s in counts], "part_ long, shard int, offset long")
    return (
        placed.withColumn("part_", part)
        .join(F.broadcast(offsets), ["part_", "shard"])
        .select("doc_id", "size", "text_crc32", "shard", (F.col("offset") + F.col("at_").bitwiseAND((1 << ROW_BITS) - 1)).alias("slot"))
    )
