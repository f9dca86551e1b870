"""A, W, R, K, X: reader analytics over what was shown, opened, liked and saved."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillmesh.operators.history import breadth, entropy, evidence, weekly_counts
from quillmesh.operators.order import placed
from quillmesh.sources.fixtures import articles, history, read, runs, sources, with_tables

from .base import query

WEEK = "wk AS (SELECT *, date_diff('day', CAST(ts AS DATE), (SELECT CAST(max(ts) AS DATE) FROM history)) AS ago FROM history)"


def tagged(spark, d):
    """History with topics and the days before the newest record."""
    h = history(spark, d)
    last = F.broadcast(h.agg(F.max("ts").alias("last")))
    a = articles(spark, d).select(F.col("id").alias("article_id"), "topics", "source_id")
    return h.join(a, "article_id").crossJoin(last).withColumn("ago", F.datediff(F.to_date("last"), F.to_date("ts")))


@query("a26_weekly_counts", with_tables("history", "articles", also="r AS (SELECT user_id, article_id, kind FROM history GROUP BY ALL), x AS (SELECT user_id, article_id, kind, unnest(topics) AS topic FROM r JOIN articles ON article_id = id)") + "SELECT topic, count(*) FILTER (WHERE kind = 'shown') AS shown, count(*) FILTER (WHERE kind = 'opened') AS opened, count(*) FILTER (WHERE kind = 'up') AS up, count(*) FILTER (WHERE kind = 'down') AS down, count(DISTINCT article_id) AS stories FROM x GROUP BY topic")
def a26(spark, d):
    return weekly_counts(tagged(spark, d))


@query("w13_evidence_lift", with_tables("history", "articles", also="r AS (SELECT user_id, article_id, kind FROM history GROUP BY ALL), x AS (SELECT kind, unnest(topics) AS topic FROM r JOIN articles ON article_id = id), c AS (SELECT topic, count(*) FILTER (WHERE kind = 'shown') AS s, count(*) FILTER (WHERE kind = 'opened') AS o FROM x GROUP BY topic), t AS (SELECT sum(s) AS ts, sum(o) AS t_o FROM c)") + "SELECT topic, round(o / (o + s) - (t_o - o) / ((t_o - o) + (ts - s)), 9) AS lift FROM c, t")
def w13(spark, d):
    return evidence(weekly_counts(tagged(spark, d)))


@query("a27_topic_weights", with_tables("history", "articles") + "SELECT user_id, topic, round(sum(1.0 / len(topics)), 6) AS weight FROM (SELECT user_id, topics, unnest(topics) AS topic FROM history JOIN articles ON article_id = id WHERE kind = 'opened') GROUP BY ALL")
def a27(spark, d):
    return breadth(tagged(spark, d).filter("kind = 'opened'")).select("user_id", "topic", F.round("weight", 6).alias("weight"))


ENTROPY = "w AS (SELECT user_id, topic, sum(1.0 / len(topics)) AS weight FROM (SELECT user_id, topics, unnest(topics) AS topic FROM history JOIN articles ON article_id = id WHERE kind = 'opened') GROUP BY ALL), s AS (SELECT *, weight / sum(weight) OVER (PARTITION BY user_id) AS p, count(*) OVER (PARTITION BY user_id) AS k FROM w)"


@query("a28_entropy", with_tables("history", "articles", also=ENTROPY) + "SELECT user_id, CASE WHEN any_value(k) <= 1 THEN 0.0 ELSE round(-sum(p * log2(p)) / log2(any_value(k)), 6) END AS breadth FROM s GROUP BY user_id")
def a28(spark, d):
    return entropy(breadth(tagged(spark, d).filter("kind = 'opened'"))).select("user_id", F.round("breadth", 6).alias("breadth"))


@query("a29_week_over_week", with_tables("history", also=WEEK) + "SELECT user_id, count(*) FILTER (WHERE ago < 7) AS this_week, count(*) FILTER (WHERE ago BETWEEN 7 AND 13) AS last_week, count(*) FILTER (WHERE ago < 7) * 100 < 85 * count(*) FILTER (WHERE ago BETWEEN 7 AND 13) AS narrowed FROM wk GROUP BY user_id")
def a29(spark, d):
    h = history(spark, d)
    last = F.broadcast(h.agg(F.max("ts").alias("last")))
    g = h.crossJoin(last).withColumn("ago", F.datediff(F.to_date("last"), F.to_date("ts"))).groupBy("user_id").agg(F.count_if(F.col("ago") < 7).alias("this_week"), F.count_if(F.col("ago").between(7, 13)).alias("last_week"))
    return g.withColumn("narrowed", F.col("this_week") * 100 < 85 * F.col("last_week"))


@query("r20_proposals", with_tables("history", "articles", also="r AS (SELECT user_id, article_id, kind FROM history GROUP BY ALL), x AS (SELECT kind, unnest(topics) AS topic FROM r JOIN articles ON article_id = id), c AS (SELECT topic, count(*) FILTER (WHERE kind = 'shown') AS s, count(*) FILTER (WHERE kind = 'opened') AS o FROM x GROUP BY topic), t AS (SELECT sum(s) AS ts, sum(o) AS t_o FROM c), l AS (SELECT topic, round(o / (o + s) - (t_o - o) / ((t_o - o) + (ts - s)), 9) AS lift FROM c, t WHERE o + s >= 8)") + "SELECT topic, CASE WHEN lift > 0 THEN 'raise' ELSE 'lower' END AS proposal FROM l WHERE abs(lift) >= 0.001 ORDER BY abs(lift) DESC, topic LIMIT 5")
def r20(spark, d):
    c = weekly_counts(tagged(spark, d))
    lift = evidence(c).join(c, "topic").filter("opened + shown >= 8 and abs(lift) >= 0.001")
    return lift.orderBy(F.desc(F.abs("lift")), "topic").limit(5).select("topic", F.when(F.col("lift") > 0, "raise").otherwise("lower").alias("proposal"))


@query("j16_history_stories", with_tables("articles", "history") + "SELECT id, bool_or(kind = 'opened') IS TRUE AS opened, bool_or(kind = 'shown') IS TRUE AS shown FROM articles LEFT JOIN history ON article_id = id GROUP BY id")
def j16(spark, d):
    h = history(spark, d).groupBy("article_id").agg(F.bool_or(F.col("kind") == "opened").alias("opened"), F.bool_or(F.col("kind") == "shown").alias("shown"))
    return articles(spark, d).join(h, F.col("id") == F.col("article_id"), "left").select("id", F.coalesce("opened", F.lit(False)).alias("opened"), F.coalesce("shown", F.lit(False)).alias("shown"))


@query("j17_attribute_expansion", with_tables("articles", "sources", "history") + "SELECT event_id, unnest(list_concat([source_id, coalesce(lean, 'none'), country], topics)) AS attribute FROM history JOIN articles ON article_id = id JOIN sources USING (source_id)")
def j17(spark, d):
    h = history(spark, d).join(articles(spark, d), F.col("article_id") == F.col("id")).join(F.broadcast(sources(spark, d)), "source_id")
    return h.select("event_id", F.explode(F.concat(F.array("source_id", F.coalesce("lean", F.lit("none")), "country"), "topics")).alias("attribute"))


@query("k07_retention", with_tables("history", also=WEEK) + "SELECT event_id FROM wk WHERE (kind = 'shown' AND ago < 14) OR (kind <> 'shown' AND ago < 365)")
def k07(spark, d):
    h = history(spark, d)
    last = F.broadcast(h.agg(F.max("ts").alias("last")))
    ago = F.datediff(F.to_date("last"), F.to_date("ts"))
    return h.crossJoin(last).filter(((F.col("kind") == "shown") & (ago < 14)) | ((F.col("kind") != "shown") & (ago < 365))).select("event_id")


@query("k08_idempotent", with_tables("history") + "SELECT user_id, article_id, kind, CAST(ts AS DATE) AS day, min(event_id) AS event_id FROM history GROUP BY ALL")
def k08(spark, d):
    return history(spark, d).groupBy("user_id", "article_id", "kind", F.to_date("ts").alias("day")).agg(F.min("event_id").alias("event_id"))


@query("k09_rolling_week", "SELECT a.day, count(*) AS n FROM (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events) a JOIN events e ON CAST(e.ts AS DATE) <= a.day AND CAST(e.ts AS DATE) > a.day - INTERVAL 7 DAY GROUP BY ALL")
def k09(spark, d):
    n = read(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("c"))
    spread = n.select(F.explode(F.sequence("day", F.date_add("day", 6))).alias("day"), "c").groupBy("day").agg(F.sum("c").alias("n"))
    return spread.join(n.select("day"), "day", "left_semi")


@query("k12_tumbling", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def k12(spark, d):
    return read(spark, d, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


@query("k12_sessions", "WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, session")
def k12s(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = read(spark, d, "events").withColumn("new", F.when(F.col("ts") - F.lag("ts").over(w) <= F.expr("INTERVAL 30 MINUTES"), 0).otherwise(1))
    return e.withColumn("session", F.sum("new").over(w)).groupBy("user_id", "session").agg(F.min("ts").alias("start"), F.count(F.lit(1)).alias("n")).drop("session")


@query("k11_cadence", "SELECT event_id FROM events WHERE hour(ts) % 3 = 0")
def k11(spark, d):
    return read(spark, d, "events").filter(F.hour("ts") % 3 == 0).select("event_id")


@query("x09_failing_sources", with_tables("runs", also="""i AS (SELECT *, sum(CASE WHEN state <> 'error' THEN 1 ELSE 0 END) OVER w AS ie, sum(CASE WHEN state <> 'empty' THEN 1 ELSE 0 END) OVER w AS im FROM runs WINDOW w AS (PARTITION BY source_id ORDER BY run)),
  c AS (SELECT source_id, run, sum(CASE WHEN state = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY source_id, ie ORDER BY run) AS e, sum(CASE WHEN state = 'empty' THEN 1 ELSE 0 END) OVER (PARTITION BY source_id, im ORDER BY run) AS m FROM i)""") + "SELECT source_id, max(greatest(e, m))::BIGINT AS longest FROM c GROUP BY source_id")
def x09(spark, d):
    from quillmesh.operators.items import streaks

    return streaks(runs(spark, d)).groupBy("source_id").agg(F.max(F.greatest("consecutive_error", "consecutive_empty")).alias("longest"))


@query("x26_latest_seen", with_tables("history") + "SELECT kind, article_id, max(ts) AS ts FROM history WHERE kind IN ('opened', 'shown') GROUP BY ALL")
def x26(spark, d):
    return history(spark, d).filter(F.col("kind").isin("opened", "shown")).groupBy("kind", "article_id").agg(F.max("ts").alias("ts"))


@query("x25_source_groups", with_tables("sources") + "SELECT bucket, count(*) AS n, count(*) FILTER (WHERE paywall) AS walled FROM sources GROUP BY bucket")
def x25(spark, d):
    return sources(spark, d).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.count_if("paywall").alias("walled"))


@query("x16_source_catalog", with_tables("sources") + "SELECT source_id, CASE WHEN lean IS NULL THEN 'unrated' ELSE 'rated' END AS basis, CAST(row_number() OVER (ORDER BY bucket, country, k) AS INT) AS place FROM sources")
def x16(spark, d):
    rows = placed(sources(spark, d), "bucket", "country", "k")
    return rows.select("source_id", F.when(F.col("lean").isNull(), "unrated").otherwise("rated").alias("basis"), "place")
