"""A pool filled by score under floors, ceilings and a budget of bytes.

What can be ranked apart is ranked over the cluster: one row a URL, each outlet's picks,
the order of each floor. Then a run's rows stream through one task in the order of the
phases, and the state they meet is in proportion to what the budget holds: what is
chosen, and the later versions of stories already kept, which wait until their price is
due. No task holds a run, and the sort that feeds it spills.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PER_SOURCE, SOURCE_CEIL, GROUP_CEIL, CLUSTER_CEIL, EXTRA_PENALTY = 2, 12, 12, 6, 8
BUCKET_FLOOR, LEAN_SHARE, LEAN_LEAST, STORY_LEANS, STALE_H, FRESH_H = 8, 0.40, 20, 4, 36, 3
#: The lean that no share bounds.
FREE_LEAN = "non-us"
REASONS = ("floor_source", "floor_story", "floor_bucket", "floor_tag", "fill")


class Pool:
    """What a run has chosen so far."""

    def __init__(self, budget: int, tags: dict[str, int]):
        self.budget, self.tags = budget, tags
        self.used, self.out = 0, {}
        self.source, self.group, self.cluster, self.bucket, self.lean, self.tag = (Counter() for _ in range(6))
        self.sides: dict[str, set] = {}
        self.waiting: list[tuple] = []

    def open_to(self, r: dict, ceilings: int) -> bool:
        """Whether r fits: by bytes alone (0), under the ceilings of outlets (1), or under all (2)."""
        if r["id"] in self.out or self.used + r["bytes"] > self.budget:
            return False
        if ceilings and (self.source[r["source_id"]] >= SOURCE_CEIL or self.group[r["grp"]] >= GROUP_CEIL):
            return False
        if ceilings < 2:
            return True
        lean = r["lean"]
        free = lean is None or lean == FREE_LEAN or self.lean[lean] + 1 <= max(LEAN_LEAST, LEAN_SHARE * (len(self.out) + 1))
        return self.cluster[r["cluster"]] < CLUSTER_CEIL and free

    def take(self, r: dict, why: int) -> None:
        self.out[r["id"]] = why
        self.used += r["bytes"]
        for counter, key in ((self.source, "source_id"), (self.group, "grp"), (self.cluster, "cluster"), (self.bucket, "bucket")):
            counter[r[key]] += 1
        if r["lean"] is not None:
            self.lean[r["lean"]] += 1
            self.sides.setdefault(r["cluster"], set()).add(r["lean"])
        for t in r["topics"]:
            if t in self.tags:
                self.tag[t] += 1

    def worth(self, r: dict) -> int:
        return r["score"] - EXTRA_PENALTY * self.cluster[r["cluster"]]

    def settle(self, least: float) -> None:
        """Decide what waits and is worth `least` or more, the best first, the first in order of equals."""
        while self.waiting and -self.waiting[0][0] >= least:
            _, at, r = heapq.heappop(self.waiting)
            now = self.worth(r)
            if now < least or self.waiting and (-now, at) > self.waiting[0][:2]:
                if self.open_to(r, 1) and self.cluster[r["cluster"]] < CLUSTER_CEIL:
                    heapq.heappush(self.waiting, (-now, at, r))
            elif self.open_to(r, 2):
                self.take(r, 4)

    def meet(self, r: dict, at: int) -> None:
        """One row of the stream."""
        phase = r["phase"]
        if phase == 0:
            if self.open_to(r, 0):
                self.take(r, 0)
        elif phase == 1:
            have = self.sides.setdefault(r["cluster"], set())
            if len(have) < STORY_LEANS and r["lean"] is not None and r["lean"] not in have and self.open_to(r, 1):
                self.take(r, 1)
        elif phase == 2:
            if self.bucket[r["bucket"]] < BUCKET_FLOOR and self.open_to(r, 1):
                self.take(r, 2)
        elif phase == 3:
            if self.tag[r["key"]] < self.tags[r["key"]] and self.open_to(r, 1):
                self.take(r, 3)
        else:
            self.settle(r["score"])
            # what a ceiling that only fills keeps out is out for good
            if not self.open_to(r, 1) or self.cluster[r["cluster"]] >= CLUSTER_CEIL:
                return
            if self.cluster[r["cluster"]]:
                heapq.heappush(self.waiting, (-self.worth(r), at, r))
            elif self.open_to(r, 2):
                self.take(r, 4)


def fill_pool(candidates: DataFrame, budget: int, tag_floor: dict[str, int] | None = None) -> DataFrame:
    """(run_id, id, why, place), in the order of choice within each run.

    candidates: run_id, id, url, source_id, syndication_group, cluster_id, two_sided,
    bucket, lean, topics, score, published_s, age_h, bytes. Of one run's rows with one URL
    the smallest id counts. The order is by score, then the newest, then the id. Floors
    come first: PER_SOURCE of each outlet, its newest if just out, then the best that are
    not stale, or the newest where all are; each lean of a two-sided story; BUCKET_FLOOR
    of each bucket; `tag_floor` of each tag. The fill goes by score, a further version
    of a story losing EXTRA_PENALTY a version before it. What does not fit the budget is
    left out and smaller items still tried. A null story is one of its own; null
    outlets, groups, buckets and scores count as "" and 0.
    """
    tags = dict(tag_floor or {})
    c = candidates.select(
        "run_id", "id", F.coalesce("url", F.concat(F.lit("id:"), F.col("id").cast("string"))).alias("url"), F.coalesce("source_id", F.lit("")).alias("source_id"), F.coalesce("syndication_group", "source_id", F.lit("")).alias("grp"),
        F.coalesce(F.col("cluster_id").cast("string"), F.concat(F.lit("item "), F.col("id").cast("string"))).alias("cluster"), F.coalesce("two_sided", F.lit(False)).alias("two_sided"), F.coalesce("bucket", F.lit("")).alias("bucket"), "lean",
        F.coalesce("topics", F.array().cast("array<string>")).alias("topics"), F.coalesce(F.col("score").cast("long"), F.lit(0)).alias("score"), F.coalesce("published_s", F.lit(0)).cast("long").alias("published_s"), F.coalesce("age_h", F.lit(2.0 * STALE_H)).cast("double").alias("age_h"), F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes"),
    )
    first = F.row_number().over(Window.partitionBy("run_id", "url").orderBy("id"))
    c = c.withColumn("nth", first).filter("nth = 1").drop("nth", "url")
    order = [F.desc("score"), F.desc("published_s"), F.asc("id")]
    mine = Window.partitionBy("run_id", "source_id")
    ranked = c.withColumn("newest", F.row_number().over(mine.orderBy(F.desc("published_s"), "id"))).withColumn("any_fresh", F.max(F.col("age_h") <= STALE_H).over(mine))
    latest = (F.col("newest") == 1) & (F.col("age_h") <= FRESH_H)
    ranked = ranked.withColumn("group_", F.when(latest, 0).when(F.col("age_h") <= STALE_H, 1).when((F.col("newest") == 1) & ~F.col("any_fresh"), 2))
    picks = ranked.filter("group_ is not null").withColumn("pick", F.row_number().over(mine.orderBy("group_", *order))).filter(F.col("pick") <= PER_SOURCE)
    cols = ["run_id", "id", "source_id", "grp", "cluster", "bucket", "lean", "topics", "score", "published_s", "bytes"]
    no = F.lit(0)
    parts = [
        picks.select(*cols, no.alias("phase"), F.col("source_id").alias("key"), F.col("pick").alias("nth")),
        c.filter("two_sided").select(*cols, F.lit(1).alias("phase"), F.col("cluster").alias("key"), no.alias("nth")),
        c.select(*cols, F.lit(2).alias("phase"), F.col("bucket").alias("key"), no.alias("nth")),
        c.select(*cols, F.lit(4).alias("phase"), F.lit("").alias("key"), no.alias("nth")),
    ]
    if tags:
        wanted = F.array_intersect("topics", F.array(*map(F.lit, tags)))
        parts.append(c.withColumn("key", F.explode(F.array_distinct(wanted))).select(*cols, F.lit(3).alias("phase"), "key", no.alias("nth")))
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.union(more)
    rows = rows.repartition("run_id").sortWithinPartitions("run_id", "phase", "key", "nth", *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool, now, at = None, object(), 0

        def closed() -> pa.RecordBatch:
            pool.settle(float("-inf"))
            ids = list(pool.out)
            return pa.RecordBatch.from_arrays([pa.array([now] * len(ids), pa.int64()), pa.array(ids, pa.int64()), pa.array([REASONS[w] for w in pool.out.values()], pa.string()), pa.array(range(1, len(ids) + 1), pa.int32())], names=["run_id", "id", "why", "place"])

        for batch in batches:
            for r in batch.to_pylist():
                if pool is None or r["run_id"] != now:
                    if pool is not None:
                        yield closed()
                    pool, now = Pool(budget, tags), r["run_id"]
                pool.meet(r, at)
                at += 1
        if pool is not None:
            yield closed()

    return rows.mapInArrow(run, "run_id long, id long, why string, place int")
