"""Exact dedup by skew-safe combining.

Rows are combined three times, each time on the digest and the full content: within
each map task, within a salted digest group, and over the winners of the salts. No
task ever holds more than one row a task (then a salt) of the same text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, scratch, skew_join

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Groups of equal digests are spread over so many salts at most.
SALTS = 16


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def combine(rows: DataFrame, salts: int = SALTS) -> DataFrame:
    """(digest_, norm_) -> keep_id, group_size, from rows (doc_id, digest_, norm_).

    The salt is the map task's number, so that the local combine leaves one row a
    text; the result does not depend on it.
    """
    salted = rows.withColumn("salt_", F.pmod(F.spark_partition_id(), F.lit(salts)))
    winners = salted.groupBy("digest_", "salt_", "norm_").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return winners.groupBy("digest_", "norm_").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise: Callable[[Column], Column] = ascii_lower, digest: Callable[[Column], Column] = sha256, salts: int = SALTS, with_row: bool = False) -> DataFrame:
    """One row per row of `docs`: doc_id, keep_id, group_size, kept, digest_.

    Texts are equal when their normalised forms are identical; null counts as empty.
    The largest id of a group stays. A null id ranks lowest; where all ids of a group
    are null, keep_id is null and its rows count as kept. Rows that repeat both the
    winning id and its text all count as kept. An empty table gives an empty result.
    Other columns of `docs` are not read, or with `with_row` stand together in the struct
    `row`, which has all columns of `docs` whatever their names. Different texts with one
    digest stay apart: the second path then joins on the content as well.
    """
    spark = docs.sparkSession
    row = [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")] if with_row else []
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), normalise(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("norm_"), *row).withColumn("digest_", digest(F.col("norm_")))
    merged = combine(rows.select("doc_id", "digest_", "norm_"), salts)
    groups = merged.groupBy("digest_").agg(F.count(F.lit(1)).alias("texts"), F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    groups = materialize(groups, scratch(spark, "groups"))
    seen = groups.agg(F.sum("group_size").alias("n"), F.max("texts").alias("texts")).first()
    if (seen.texts or 1) > 1:  # a digest collision: the content decides
        exact = materialize(merged.withColumn("key", F.struct("digest_", "norm_")).select("key", "keep_id", "group_size"), scratch(spark, "texts"))
        out = skew_join(rows.withColumn("key", F.struct("digest_", "norm_")), exact, "key", F.coalesce(F.col("doc_id"), F.lit(0)), seen.n or 0, counts="group_size").drop("key")
    else:
        out = skew_join(rows.drop("norm_"), groups.drop("texts"), "digest_", F.coalesce(F.col("doc_id"), F.lit(0)), seen.n or 0, counts="group_size")
    out = out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))
    return out.select("doc_id", "keep_id", "group_size", "kept", "digest_", *(["row"] if with_row else []))
