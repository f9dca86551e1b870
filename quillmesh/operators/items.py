"""Item operators: validation with one drop reason, dedup, caps, ledgers, health."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from quillmesh.session import ship


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row a key: the first in the order, which must end in a unique column."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rn_", F.row_number().over(w)).filter("rn_ = 1").drop("rn_")


def validate(items: DataFrame, now_s: int, drop_titles: Column | None = None, absurd: bool = False) -> DataFrame:
    """`items` with drop_reason, null for what stays.

    The first rule that holds names the reason: no_title, title_rule, bad_url,
    duplicate_url (a smaller id has the address), no_date, and with `absurd` also
    absurd_date (older than 30 days or more than one ahead).
    """
    first = F.min("id").over(Window.partitionBy("url"))
    reason = F.when(F.coalesce(F.trim("title"), F.lit("")) == "", "no_title")
    if drop_titles is not None:
        reason = reason.when(drop_titles, "title_rule")
    reason = reason.when(~F.coalesce(F.col("url").rlike("^https?://"), F.lit(False)), "bad_url").when(F.col("id") != first, "duplicate_url").when(F.col("published_s").isNull(), "no_date")
    if absurd:
        reason = reason.when((F.col("published_s") < now_s - 30 * 86400) | (F.col("published_s") > now_s + 86400), "absurd_date")
    return items.withColumn("drop_reason", reason)


def ledger(checked: DataFrame) -> DataFrame:
    """A1: metric, n: fetched, published and each drop; fetched is the sum of the others."""
    kept = F.coalesce("drop_reason", F.lit("published"))
    return checked.groupBy(kept.alias("metric")).agg(F.count(F.lit(1)).alias("n")).union(checked.agg(F.lit("fetched"), F.count(F.lit(1))))


def cap_pass(items: DataFrame, clustered: DataFrame, cap: int, extra: int) -> DataFrame:
    """First `cap` items a source, and `extra` more of those in stories of several outlets.

    items: id, source_id, position; clustered: id of items in such stories.
    """
    w = Window.partitionBy("source_id").orderBy("position", "id")
    ranked = items.join(clustered.select("id").distinct().withColumn("multi", F.lit(True)), "id", "left").withColumn("rn", F.row_number().over(w))
    rest = Window.partitionBy("source_id", F.col("rn") > cap, F.coalesce("multi", F.lit(False))).orderBy("position", "id")
    ranked = ranked.withColumn("rest", F.row_number().over(rest))
    return ranked.filter((F.col("rn") <= cap) | (F.coalesce("multi", F.lit(False)) & (F.col("rest") <= extra))).drop("multi", "rn", "rest")


def streaks(runs: DataFrame) -> DataFrame:
    """Each run with the consecutive errors and empties that end in it, and unhealthy.

    runs: source_id, run, state. Gaps and islands: a streak counts rows since the state
    last differed.
    """
    by = Window.partitionBy("source_id").orderBy("run")
    out = runs
    for state in ("error", "empty"):
        island = F.sum(F.when(F.col("state") != state, 1).otherwise(0)).over(by.rowsBetween(Window.unboundedPreceding, 0))
        out = out.withColumn(f"{state}_island", island)
        w = Window.partitionBy("source_id", f"{state}_island").orderBy("run").rowsBetween(Window.unboundedPreceding, 0)
        out = out.withColumn(f"consecutive_{state}", F.sum(F.when(F.col("state") == state, 1).otherwise(0)).over(w)).drop(f"{state}_island")
    return out.withColumn("unhealthy", (F.col("consecutive_error") >= 3) | (F.col("consecutive_empty") >= 5))


def skip_fill(items: DataFrame, group: str, order: list[str], size: str, budget: int) -> DataFrame:
    """In order, what still fits a group's budget; what does not fit is skipped, not a stop.

    Groups are dealt by their key and sorted; the state is one number, carried from row to
    row and from batch to batch, so no group is held. A null size takes nothing and is kept.
    """
    ship(items.sparkSession)
    at_group, at_size = items.columns.index(group), items.columns.index(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, used = (), 0
        for batch in batches:
            kept = []
            for g, n in zip(batch.column(at_group).to_pylist(), batch.column(at_size).to_pylist(), strict=True):
                if now != (g,):
                    now, used = (g,), 0
                fits = used + (n or 0) <= budget
                used += (n or 0) if fits else 0
                kept.append(fits)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(kept, pa.bool_())], names=[*batch.schema.names, "kept"])

    schema = StructType([*items.schema.fields, StructField("kept", BooleanType())])
    return items.repartition(group).sortWithinPartitions(group, *order).mapInArrow(run, schema)
