"""Places in a total order, and joins by the latest time, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scale import free_name, materialize, scratch


def placed(df: DataFrame, *order: str | Column, name: str = "place") -> DataFrame:
    """`df` with each row's place (int, from 1) in a total order.

    Rows are range-partitioned by the order and written, so that their partition stays
    theirs; places within a partition start from the rows of those before, one count each.
    """
    part = free_name("part_", df)
    rows = materialize(df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()), scratch(df.sparkSession, "ranges"))
    counts = rows.groupBy(part).agg(F.count(F.lit(1)).alias("n_"))
    before = counts.select(part, (F.sum("n_").over(Window.orderBy(part)) - F.col("n_")).alias("before_"))  # one row a partition
    own = F.row_number().over(Window.partitionBy(part).orderBy(*order))
    return rows.join(F.broadcast(before), part).withColumn(name, (F.col("before_") + own).cast("int")).drop(part, "before_")


def placed_in(df: DataFrame, keys: list[str], *order: str | Column, name: str = "place") -> DataFrame:
    """`df` with each row's place (long, from 1) within its group of `keys`, a group being dealt over many tasks.

    Rows are range-partitioned by keys and order, so a group that began in an earlier
    partition is the first of its own: one offset a partition at most, which is broadcast.
    """
    part = free_name("part_", df)
    rows = materialize(df.repartitionByRange(*keys, *order).withColumn(part, F.spark_partition_id()), scratch(df.sparkSession, "ranges"))
    n = rows.groupBy(part, *keys).agg(F.count(F.lit(1)).alias("n_"))
    earlier = (F.sum("n_").over(Window.partitionBy(*keys).orderBy(part)) - F.col("n_")).alias("before_")
    offsets = n.select(F.col(part).alias("of_"), *[F.col(k).alias(f"key{i}_") for i, k in enumerate(keys)], earlier).filter("before_ > 0")
    same = F.col(part) == F.col("of_")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"key{i}_"))
    own = F.row_number().over(Window.partitionBy(part, *keys).orderBy(*order))
    return rows.withColumn(name, own.cast("long")).join(F.broadcast(offsets), same, "left").withColumn(name, F.col(name) + F.coalesce("before_", F.lit(0))).select(*df.columns, name)


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, value: str, span_s: int = 3600) -> DataFrame:
    """`left` with the value of the latest row of `right` of its key at or before its time; null where there is none.

    Both have `key` and the timestamp `at`; `right` has `value`, which is not null; the
    latest time's largest value counts. A key is gone through in spans of time, each a
    group of its own, and what holds before a span is carried over the spans alone, so a
    key with many rows takes many tasks.
    """
    columns = left.columns
    span = F.floor(F.unix_timestamp(F.col(at).cast("timestamp")) / span_s)
    r = right.groupBy(key, at).agg(F.max(value).alias("held_")).withColumn("span_", span)
    rows = left.select(F.struct(*columns).alias("row_"), F.col(key), F.col(at), F.lit(None).cast(r.schema["held_"].dataType).alias("held_"), span.alias("span_"))
    both = rows.unionByName(r.select(F.lit(None).cast(rows.schema["row_"].dataType).alias("row_"), key, at, "held_", "span_"))
    in_span = Window.partitionBy(key, "span_").orderBy(F.col(at), F.col("row_").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    latest = r.groupBy(key, "span_").agg(F.max_by("held_", at).alias("last_"))
    spans = rows.select(key, "span_").union(latest.select(key, "span_")).distinct().join(latest, [key, "span_"], "left")
    carried = spans.withColumn("carried_", F.last("last_", True).over(Window.partitionBy(key).orderBy("span_").rowsBetween(Window.unboundedPreceding, -1))).select(F.col(key).alias("key_"), F.col("span_").alias("of_"), "carried_")
    found = both.withColumn("seen_", F.last("held_", True).over(in_span)).filter("row_ is not null")
    met = found.join(carried, (F.col(key).eqNullSafe(F.col("key_"))) & (F.col("span_") == F.col("of_")), "left")
    return met.select("row_.*", F.coalesce("seen_", "carried_").alias(value))


def matched(pairs: DataFrame) -> DataFrame:
    """(a, b) of the greedy 1:1 matching of (a, b, n): the largest n first, ties by a, then b.

    A pair that is first for both its ends is taken whatever the others do, so all such
    pairs go at once; ends that are taken leave with their pairs.
    """
    spark = pairs.sparkSession
    left = materialize(pairs.select("a", "b", F.struct((-F.col("n")).alias("n"), "a", "b").alias("rank")), scratch(spark, "pairs"))
    out = None
    while not left.isEmpty():
        by_a, by_b = left.groupBy("a").agg(F.min("rank").alias("rank")), left.groupBy("b").agg(F.min("rank").alias("rank"))
        now = materialize(by_a.select("rank").join(by_b.select("rank"), "rank").select("rank.a", "rank.b"), scratch(spark, "matched"))
        out = now if out is None else out.union(now)
        left = materialize(left.join(now.select("a"), "a", "left_anti").join(now.select("b"), "b", "left_anti").select("a", "b", "rank"), scratch(spark, "pairs"))
    return pairs.select("a", "b").limit(0) if out is None else out
