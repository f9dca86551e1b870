"""Connected components by alternating star contraction, on DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .scale import materialize, remove, scratch, skew_join


#: So many edges, 16 bytes each, are joined in one task in less time than a round of contraction takes.
FEW_EDGES = 1 << 16


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) of few edges (hi, lo): each node by the smallest it reaches."""
    above: dict = {}

    def top(x):
        while (up := above.setdefault(x, x)) != x:
            above[x] = x = above[up]
        return x

    for batch in batches:
        for hi, lo in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = top(hi), top(lo)
            if a != b:
                above[max(a, b)] = min(a, b)
    nodes = list(above)
    if nodes:
        kind = batch.column(0).type
        yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array([top(x) for x in nodes], kind)], names=["node", "component"])


def _stars(edges: DataFrame) -> bool:
    """Whether every node points at one centre, which points at none."""
    up = edges.select(F.col("hi").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    down = edges.select(F.col("lo").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    nodes = up.union(down).groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return nodes.filter("up > 1 or (up > 0 and down > 0)").isEmpty()


def _written(edges: DataFrame, path: str) -> tuple[DataFrame, int]:
    """The edges, written and read again, and about how many they are."""
    seen = Observation()
    return materialize(edges.observe(seen, F.count(F.lit(1)).alias("n")), path), int(seen.get.get("n") or 0)


def components(links: DataFrame, few: int = 0) -> DataFrame:
    """(node, component) of every node in links (a, b); component is its smallest node.

    A round points every node's smaller neighbours at the smallest (small star), then
    its larger neighbours (large star). Hubs are joined with dealt salts, edges stay in
    the shared folder, and the driver sees two numbers a round. Up to `few` edges are
    joined in one task instead, with the same result. Null nodes have no links.
    """
    spark = links.sparkSession
    path = scratch(spark, "edges")
    edges, n = _written(links.filter("a != b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), path)
    if n <= few:
        kind = edges.schema["hi"].dataType.simpleString()
        return edges.coalesce(1).mapInArrow(_joined, f"node {kind}, component {kind}")
    while not _stars(edges):
        least = edges.groupBy("hi").agg(F.min("lo").alias("least"), F.count(F.lit(1)).alias("n"))
        small = skew_join(edges, least, "hi", F.col("lo"), n, counts="n")
        small = small.select(F.explode(F.array(F.struct(F.col("hi").alias("x"), F.col("least").alias("y")), F.struct(F.col("lo").alias("x"), F.col("least").alias("y")))).alias("e")).select(F.col("e.x").alias("hi"), F.col("e.y").alias("lo")).filter("hi != lo").distinct()
        small_path = scratch(spark, "edges")
        small = materialize(small, small_path)
        both = small.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(small.select("lo", "hi"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("least"), F.count(F.when(F.col("v") > F.col("u"), 1)).alias("n"))
        large = skew_join(both.filter("v > u"), least, "u", F.col("v"), n, counts="n")
        next_path = scratch(spark, "edges")
        edges, n = _written(large.select(F.col("v").alias("hi"), F.col("least").alias("lo")).distinct(), next_path)
        remove(spark, path, small_path)
        path = next_path
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(edges.select("lo", "lo").distinct())
