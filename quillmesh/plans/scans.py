"""Feeds of the tables written as files, scanned and parsed."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmesh.operators.scale import materialize, scratch
from quillmesh.session import ship
from quillmesh.sources import feeds, feedscan
from quillmesh.sources.fixtures import articles, read, with_tables

from .base import query


@query("s02_fetch_all", with_tables("articles") + "SELECT 'source=' || source_id || '/part=' || (id // 1000) AS feed, 'ok' AS state, count(*) AS n_items FROM articles GROUP BY source_id, id // 1000 UNION ALL SELECT 'source=none' || s_suppkey || '/part=0', 'http_error', 0 FROM supplier")
def s02_fetch(spark, d):
    """A feed of each outlet and thousand ids, and suppliers' feeds that are not there: each gives its state."""
    ship(spark)
    a = articles(spark, d).select("id", "source_id", "title", "url").withColumn("part", F.floor(F.col("id") / 1000))
    item = F.concat(F.lit("<item><title><![CDATA["), F.regexp_replace("title", r"[\x00-\x1f]", " "), F.lit("]]></title><link>"), "url", F.lit("</link></item>"))
    body = a.groupBy(F.col("source_id").alias("source"), "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", item.alias("x")))), lambda s: s.x), "").alias("x"))
    root = scratch(spark, "feeds")
    body.select("source", "part", F.concat(F.lit("<rss>"), "x", F.lit("</rss>")).alias("value")).write.partitionBy("source", "part").text(root)
    there = a.select("source_id", "part").distinct().select(F.concat(F.lit("source="), "source_id", F.lit("/part="), F.col("part").cast("string")).alias("feed"))
    names = there.union(read(spark, d, "supplier").select(F.concat(F.lit("source=none"), F.col("s_suppkey").cast("string"), F.lit("/part=0")))).orderBy("feed")
    fetched = materialize(feedscan.fetch_all(spark, root, [r.feed for r in names.collect()]), scratch(spark, "fetched"))  # the catalog of feeds: names alone
    parsed = feeds.repaired(fetched.filter("body is not null").select("feed", "body")).withColumn("kind", feeds.kind(F.col("body")))
    return feedscan.feed_states(fetched.join(parsed.select("feed", "kind"), "feed", "left"), feeds.items(parsed.select("feed", "body")))
