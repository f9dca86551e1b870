"""Reader analytics: weekly counts, evidence, breadth."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def weekly_counts(records: DataFrame) -> DataFrame:
    """Topic -> shown, opened, up, down, stories; repeats of a reader, story and kind count once.

    records: user_id, article_id, kind, topics.
    """
    once = records.groupBy("user_id", "article_id", "kind").agg(F.first("topics").alias("topics"))
    x = once.select("article_id", "kind", F.explode("topics").alias("topic"))
    return x.groupBy("topic").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("shown", "opened", "up", "down")], F.countDistinct("article_id").alias("stories"))


def evidence(counts: DataFrame) -> DataFrame:
    """(topic, lift): a topic's share of opens against that of all other topics."""
    total = F.broadcast(counts.agg(F.sum("shown").alias("ts"), F.sum("opened").alias("to_")))
    own = F.col("opened") / (F.col("opened") + F.col("shown"))
    rest = (F.col("to_") - F.col("opened")) / ((F.col("to_") - F.col("opened")) + (F.col("ts") - F.col("shown")))
    return counts.crossJoin(total).select("topic", F.round(own - rest, 9).alias("lift"))


def breadth(records: DataFrame) -> DataFrame:
    """(user_id, topic, weight): each record shared evenly among its topics."""
    x = records.select("user_id", F.size("topics").alias("k"), F.explode("topics").alias("topic"))
    return x.groupBy("user_id", "topic").agg(F.sum(1.0 / F.col("k")).alias("weight"))


def entropy(weights: DataFrame) -> DataFrame:
    """(user_id, breadth): Shannon entropy over the most that so many topics allow; 0 for one."""
    w = Window.partitionBy("user_id")
    p = weights.withColumn("p", F.col("weight") / F.sum("weight").over(w)).withColumn("n", F.count(F.lit(1)).over(w))
    h = p.groupBy("user_id").agg(F.sum(-F.col("p") * F.log2("p")).alias("h"), F.first("n").alias("n"))
    return h.select("user_id", F.when(F.col("n") <= 1, 0.0).otherwise(F.col("h") / F.log2(F.col("n").cast("double"))).alias("breadth"))
