"""R, W, T, O: scores, picks, orders and list passes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillmesh.functions import text as T
from quillmesh.operators.items import first_by
from quillmesh.operators.likeness import likeness
from quillmesh.operators.poolfill import fill_pool
from quillmesh.operators.ranking import run_passes, score_terms, select_pool
from quillmesh.operators.order import placed
from quillmesh.session import ship
from quillmesh.sources.fixtures import BASE_S, HARD_NEWS, NOW_S, TOPICS, articles, history, members, read, sources, with_tables

from .base import query
from .items import STORY, facts

#: The profile: topic weights and source trust.
WEIGHTS = {"politics": 0.8, "economy": 0.6, "science": 0.4, "conflict": 0.3}
_w = " ".join(f"WHEN '{t}' THEN {w}" for t, w in WEIGHTS.items())
SCORED = f"""terms AS (SELECT cluster_id, latest_s, independent, CAST(floor(round(pow(2, -greatest(0, ({NOW_S} - latest_s) / 3600.0) / 12), 9) * 1e6 + 0.5) AS BIGINT) AS recency,
  CAST(floor(least(1.0, coalesce(list_max(ws), 0) + 0.25 * (coalesce(list_sum(ws), 0) - coalesce(list_max(ws), 0))) * 1e6 + 0.5) AS BIGINT) AS affinity,
  CAST(floor(round(0.5 * log2(greatest(1, independent)), 9) * 1e6 + 0.5) AS BIGINT) AS importance, CASE WHEN cluster_id % 10 = 0 THEN 1.2 WHEN cluster_id % 10 = 1 THEN 0.7 ELSE 1.0 END AS trust
  FROM (SELECT *, list_filter(list_transform(topics, lambda t: CAST(CASE t {_w} END AS DOUBLE)), lambda x: x IS NOT NULL) AS ws FROM facts)),
  scored AS (SELECT *, CAST(floor((trust::DOUBLE - 1) * (recency + affinity + importance) + 0.5) AS BIGINT) AS trust_term, recency + affinity + importance + CAST(floor((trust::DOUBLE - 1) * (recency + affinity + importance) + 0.5) AS BIGINT) AS score FROM terms)"""


def scored(spark, d):
    profile = F.create_map(*[F.lit(x) for t, w in WEIGHTS.items() for x in (t, w)])
    m = F.col("cluster_id") % 10
    f = facts(spark, d).withColumn("weights", F.array_compact(F.transform("topics", lambda t: profile[t]))).withColumn("trust", F.when(m == 0, 1.2).when(m == 1, 0.7).otherwise(1.0))
    return score_terms(f, NOW_S)


@query("r11_score_terms", with_tables("articles", "sources", "members", also=STORY + ", " + SCORED) + "SELECT cluster_id, recency, affinity, importance, trust_term, score FROM scored")
def r11(spark, d):
    return scored(spark, d).select("cluster_id", "recency", "affinity", "importance", "trust_term", "score")


@query("t01_total_order", with_tables("articles", "sources", "members", also=STORY + ", " + SCORED) + "SELECT cluster_id, CAST(row_number() OVER (ORDER BY score DESC, latest_s DESC, cluster_id) AS INT) AS place FROM scored QUALIFY place <= 100")
def t01(spark, d):
    top = scored(spark, d).select("cluster_id", "score", "latest_s").orderBy(F.desc("score"), F.desc("latest_s"), "cluster_id").limit(100)
    return top.select("cluster_id", F.row_number().over(Window.orderBy(F.desc("score"), F.desc("latest_s"), "cluster_id")).alias("place"))


@query("t02_today_orders", with_tables("articles", "sources", "members", also=STORY) + "SELECT cluster_id, CAST(row_number() OVER (ORDER BY latest_s DESC, cluster_id) AS INT) AS latest, CAST(row_number() OVER (ORDER BY independent >= 3 DESC, latest_s DESC, cluster_id) AS INT) AS urgent FROM facts QUALIFY latest <= 50")
def t02(spark, d):
    f = facts(spark, d).withColumn("few", F.col("independent") < 3)
    latest = placed(f, F.desc("latest_s"), "cluster_id", name="latest")
    return placed(latest, "few", F.desc("latest_s"), "cluster_id", name="urgent").filter("latest <= 50").select("cluster_id", "latest", "urgent")


@query("t03_top_topics", with_tables("articles") + "SELECT topic, count(*) AS n FROM (SELECT unnest(topics) AS topic FROM articles) GROUP BY topic ORDER BY n DESC, topic LIMIT 3")
def t03(spark, d):
    return articles(spark, d).select(F.explode("topics").alias("topic")).groupBy("topic").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "topic").limit(3)


@query("t05_triage", with_tables("articles", also="s AS (SELECT id, n_chars AS points, id % 3 = 0 AS kept FROM articles), u AS (SELECT * FROM (SELECT id, 1 AS pri FROM s WHERE kept ORDER BY points, id LIMIT 100) UNION ALL SELECT * FROM (SELECT id, 2 FROM s WHERE NOT kept ORDER BY points DESC, id LIMIT 100) UNION ALL SELECT * FROM (SELECT id, 3 FROM s ORDER BY md5(id::VARCHAR) LIMIT 20))") + "SELECT id, min(pri) AS pri FROM u GROUP BY id")
def t05(spark, d):
    s = articles(spark, d).select("id", F.col("n_chars").alias("points"), (F.col("id") % 3 == 0).alias("kept"))
    a = s.filter("kept").orderBy("points", "id").limit(100).select("id", F.lit(1).alias("pri"))
    b = s.filter("not kept").orderBy(F.desc("points"), "id").limit(100).select("id", F.lit(2).alias("pri"))
    c = s.orderBy(F.md5(F.col("id").cast("string"))).limit(20).select("id", F.lit(3).alias("pri"))
    return a.union(b).union(c).groupBy("id").agg(F.min("pri").alias("pri"))


@query("t06_evict", with_tables("history") + "SELECT user_id, article_id FROM (SELECT user_id, article_id, bool_or(kind = 'save') AS pinned, max(event_id) AS e FROM history GROUP BY ALL) QUALIFY pinned OR row_number() OVER (PARTITION BY user_id, pinned ORDER BY e DESC) <= 200")
def t06(spark, d):
    h = history(spark, d).groupBy("user_id", "article_id").agg(F.bool_or(F.col("kind") == "save").alias("pinned"), F.max("event_id").alias("e"))
    r = F.row_number().over(Window.partitionBy("user_id", "pinned").orderBy(F.desc("e")))
    return h.withColumn("r", r).filter("pinned or r <= 200").select("user_id", "article_id")


@query("t07_feed_order", with_tables("runs", "sources") + "SELECT source_id, CAST(row_number() OVER (ORDER BY e DESC, bucket, source_id) AS INT) AS place FROM (SELECT source_id, count(*) FILTER (WHERE state = 'error') AS e FROM runs GROUP BY ALL) JOIN sources USING (source_id)")
def t07(spark, d):
    from quillmesh.sources.fixtures import runs

    e = runs(spark, d).groupBy("source_id").agg(F.count_if(F.col("state") == "error").alias("e")).join(F.broadcast(sources(spark, d)), "source_id")
    return placed(e, F.desc("e"), "bucket", "source_id").select("source_id", "place")


@query("t10_seeded_sample", with_tables("articles") + "SELECT id FROM articles ORDER BY md5('seed7' || id), id LIMIT 25")
def t10(spark, d):
    return articles(spark, d).select("id").orderBy(F.md5(F.concat(F.lit("seed7"), F.col("id").cast("string"))), "id").limit(25)


@query("t11_largest_groups", with_tables("members") + "SELECT article_id FROM members JOIN (SELECT cluster_id FROM members GROUP BY cluster_id ORDER BY count(*) DESC, cluster_id LIMIT 5) USING (cluster_id)")
def t11(spark, d):
    m = members(spark, d)
    top = m.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "cluster_id").limit(5)
    return m.join(F.broadcast(top), "cluster_id").select("article_id")


@query("w02_newest_per_query", with_tables("articles") + "SELECT topic, id FROM (SELECT unnest(topics) AS topic, id, published_s FROM articles) QUALIFY row_number() OVER (PARTITION BY topic ORDER BY published_s DESC, id) <= 10")
def w02(spark, d):
    a = articles(spark, d).select(F.explode("topics").alias("topic"), "id", "published_s")
    return a.withColumn("r", F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("published_s"), "id"))).filter("r <= 10").select("topic", "id")


@query("w03_round_robin", with_tables("articles", also="r AS (SELECT topic, id, row_number() OVER (PARTITION BY topic ORDER BY published_s DESC, id) AS r FROM (SELECT unnest(topics) AS topic, id, published_s FROM articles))") + "SELECT topic, id, CAST(row_number() OVER (ORDER BY r, topic) AS INT) AS place FROM r WHERE r <= 10")
def w03(spark, d):
    a = articles(spark, d).select(F.explode("topics").alias("topic"), "id", "published_s")
    r = a.withColumn("r", F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("published_s"), "id"))).filter("r <= 10")
    return placed(r, "r", "topic").select("topic", "id", "place")


@query("w04_first_points", with_tables("articles", "members") + "SELECT id, CAST(greatest(0, floor(10 * (1 - ((published_s - min(published_s) OVER (PARTITION BY cluster_id)) / 3600.0) / 12) + 0.5)) AS BIGINT) AS points FROM members JOIN articles ON article_id = id")
def w04(spark, d):
    m = members(spark, d).join(articles(spark, d), F.col("article_id") == F.col("id"))
    h = (F.col("published_s") - F.min("published_s").over(Window.partitionBy("cluster_id"))) / 3600.0
    return m.select("id", F.greatest(F.lit(0), F.floor(10 * (1 - h / 12) + 0.5)).cast("long").alias("points"))


BV = """bv AS (SELECT cluster_id, unit_id, id, CASE WHEN syndication_group <> source_id THEN 0 ELSE 20 END AS original, CASE WHEN n_chars >= 600 THEN 15 WHEN length(dek) > 0 THEN 7 ELSE 0 END AS complete, least(10, n_chars // 600)::BIGINT AS depth, CASE WHEN paywall AND n_chars < 600 THEN -15 ELSE 0 END AS wall,
  CAST(greatest(0, floor(10 * (1 - ((published_s - min(published_s) OVER (PARTITION BY cluster_id)) / 3600.0) / 12) + 0.5)) AS BIGINT) AS first FROM members JOIN articles ON article_id = id JOIN sources USING (source_id))"""


def best_terms(spark, d):
    m = members(spark, d).join(articles(spark, d), F.col("article_id") == F.col("id")).join(F.broadcast(sources(spark, d)), "source_id")
    h = (F.col("published_s") - F.min("published_s").over(Window.partitionBy("cluster_id"))) / 3600.0
    return m.select(
        "cluster_id",
        "unit_id",
        "id",
        F.when(F.col("syndication_group") != F.col("source_id"), 0).otherwise(20).alias("original"),
        F.when(F.col("n_chars") >= 600, 15).when(F.length("dek") > 0, 7).otherwise(0).alias("complete"),
        F.least(F.lit(10), F.floor(F.col("n_chars") / 600)).cast("long").alias("depth"),
        F.when(F.col("paywall") & (F.col("n_chars") < 600), -15).otherwise(0).alias("wall"),
        F.greatest(F.lit(0), F.floor(10 * (1 - h / 12) + 0.5)).cast("long").alias("first"),
    )


@query("r07_version_terms", with_tables("articles", "sources", "members", also=BV) + "SELECT id, [original, complete, depth, wall, first]::BIGINT[] AS bv FROM bv")
def r07(spark, d):
    return best_terms(spark, d).select("id", F.array(*[F.col(c).cast("long") for c in ("original", "complete", "depth", "wall", "first")]).alias("bv"))


@query("w05_best_version", with_tables("articles", "sources", "members", also=BV) + "SELECT cluster_id, id, original + complete + depth + wall + first AS points FROM bv QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY original + complete + depth + wall + first DESC, id) = 1")
def w05(spark, d):
    b = best_terms(spark, d).withColumn("points", (F.col("original") + F.col("complete") + F.col("depth") + F.col("wall") + F.col("first")).cast("long"))
    return first_by(b, ["cluster_id"], F.desc("points"), F.col("id")).select("cluster_id", "id", "points")


@query("r08_units_best", with_tables("articles", "sources", "members", also=BV) + "SELECT unit_id, min(id) AS id FROM (SELECT *, rank() OVER (PARTITION BY unit_id ORDER BY original + complete + depth DESC) AS r FROM bv) WHERE r = 1 GROUP BY unit_id")
def r08(spark, d):
    b = best_terms(spark, d).withColumn("points", F.col("original") + F.col("complete") + F.col("depth"))
    return first_by(b, ["unit_id"], F.desc("points"), F.col("id")).select("unit_id", "id")


@query("w07_story_lead", with_tables("articles", "members") + "SELECT cluster_id, id FROM members JOIN articles ON article_id = id QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY dek = '', abs(length(dek) - 160), id) = 1")
def w07(spark, d):
    m = members(spark, d).join(articles(spark, d), F.col("article_id") == F.col("id"))
    return first_by(m, ["cluster_id"], F.col("dek") == "", F.abs(F.length("dek") - 160), F.col("id")).select("cluster_id", "id")


@query("w08_anchor", with_tables("articles", "members", also="s AS (SELECT cluster_id, id, list_distinct(string_split(lower(title), ' ')) AS w FROM members JOIN articles ON article_id = id)") + "SELECT cluster_id, id FROM (SELECT a.cluster_id, a.id, sum(round(len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))), 9)) AS s FROM s a JOIN s b ON a.cluster_id = b.cluster_id AND a.id <> b.id GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY round(s, 6) DESC, id) = 1")
def w08(spark, d):
    """The member whose title is most like the others'; all pairs of a cluster, counted by the words they share."""
    ship(spark)
    s = members(spark, d).join(articles(spark, d), F.col("article_id") == F.col("id")).select("cluster_id", "id", F.array_distinct(F.split(F.lower("title"), " ")).alias("w"))
    j = likeness(s, "cluster_id", "id", "w")
    return first_by(j, ["cluster_id"], F.desc(F.round("s", 6)), F.col("id")).select("cluster_id", "id")


@query("w09_sliding_lean", with_tables("articles", "sources") + "SELECT id, count(*) FILTER (WHERE lean = 'left') OVER w > 6 AS too_left FROM articles JOIN sources USING (source_id) WINDOW w AS (PARTITION BY lang ORDER BY published_s, id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)")
def w09(spark, d):
    a = articles(spark, d).join(F.broadcast(sources(spark, d)), "source_id")
    w = Window.partitionBy("lang").orderBy("published_s", "id").rowsBetween(-9, 0)
    return a.select("id", (F.count(F.when(F.col("lean") == "left", 1)).over(w) > 6).alias("too_left"))


@query("w10_tiers", with_tables("articles", "sources", "members", also=STORY + ", " + SCORED) + "SELECT cluster_id, CASE WHEN r = 1 THEN 'lead' WHEN r <= 3 THEN 'second' WHEN r <= 15 THEN 'third' ELSE 'rest' END AS tier FROM (SELECT cluster_id, row_number() OVER (ORDER BY score DESC, latest_s DESC, cluster_id) AS r FROM scored)")
def w10(spark, d):
    return placed(scored(spark, d), F.desc("score"), F.desc("latest_s"), "cluster_id", name="r").select("cluster_id", F.when(F.col("r") == 1, "lead").when(F.col("r") <= 3, "second").when(F.col("r") <= 15, "third").otherwise("rest").alias("tier"))


@query("w14_day_groups", "SELECT event_id, CAST(date_diff('day', CAST(ts AS DATE), (SELECT CAST(max(ts) AS DATE) FROM events)) AS INT) AS days_ago FROM events")
def w14(spark, d):
    e = read(spark, d, "events")
    last = F.broadcast(e.agg(F.max("ts").alias("last")))
    return e.crossJoin(last).select("event_id", F.datediff(F.to_date("last"), F.to_date("ts")).alias("days_ago"))


@query("w15_shard_caps", with_tables("articles") + "SELECT topic, id FROM (SELECT * FROM (SELECT unnest(topics) AS topic, id, source_id, n_chars FROM articles) QUALIFY row_number() OVER (PARTITION BY topic, source_id ORDER BY n_chars DESC, id) <= 25) QUALIFY row_number() OVER (PARTITION BY topic ORDER BY n_chars DESC, id) <= 300")
def w15(spark, d):
    a = articles(spark, d).select(F.explode("topics").alias("topic"), "id", "source_id", "n_chars")
    a = a.withColumn("s", F.row_number().over(Window.partitionBy("topic", "source_id").orderBy(F.desc("n_chars"), "id"))).filter("s <= 25")
    return a.withColumn("r", F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("n_chars"), "id"))).filter("r <= 300").select("topic", "id")


@query("w16_first_seen", with_tables("history") + "SELECT article_id, min(ts) AS first_seen FROM history GROUP BY article_id")
def w16(spark, d):
    return history(spark, d).groupBy("article_id").agg(F.min("ts").alias("first_seen"))


@query("r01_tags", with_tables("articles") + "SELECT id, list_sort(list_distinct(list_concat(topics, CASE WHEN list_contains(topics, 'conflict') THEN ['world'] ELSE [] END))) AS tags FROM articles")
def r01(spark, d):
    return articles(spark, d).select("id", F.array_sort(F.array_union("topics", F.when(F.array_contains("topics", "conflict"), F.array(F.lit("world"))).otherwise(F.array().cast("array<string>")))).alias("tags"))


@query("r02_strong_weak_rule", with_tables("articles") + "SELECT id, regexp_matches(dek, 'that|una') OR (regexp_matches(dek, 'with|sur') AND NOT regexp_matches(dek, 'from|pour')) AS hit FROM articles")
def r02(spark, d):
    x = F.col("dek")
    return articles(spark, d).select("id", (x.rlike("that|una") | (x.rlike("with|sur") & ~x.rlike("from|pour"))).alias("hit"))


@query("r06_countries", with_tables("articles") + r"SELECT id, list_sort(list_distinct(regexp_extract_all(lower(dek), 'the and|the|and|und|que'))) AS found FROM articles")
def r06(spark, d):
    return articles(spark, d).select("id", F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower("dek"), F.lit("the and|the|and|und|que"), 0))).alias("found"))


@query("r09_fact_terms", with_tables("articles", "sources", "members", also=STORY) + f"""SELECT id, CASE WHEN independent >= 2 THEN least(36, CAST(round_even(round(12 * log2(independent), 6), 0) AS INT)) ELSE 0 END AS corroboration, CASE WHEN len(coalesce(leans, [])) >= 2 THEN 8 ELSE 0 END AS lean_span, CASE WHEN list_has_any(a.topics, {HARD_NEWS}) THEN 10 ELSE 0 END AS hard, CAST(round_even(20 * pow(2, -(({NOW_S} - published_s) / 3600.0) / 12), 0) AS BIGINT) AS recency
  FROM members JOIN articles a ON article_id = id JOIN facts USING (cluster_id)""")
def r09(spark, d):
    from quillmesh.functions.numeric import recency_points

    f = facts(spark, d).select("cluster_id", "independent", "leans")
    a = members(spark, d).join(articles(spark, d), F.col("article_id") == F.col("id")).join(f, "cluster_id")
    hard = F.arrays_overlap("topics", F.array(*map(F.lit, HARD_NEWS)))
    return a.select(
        "id",
        F.when(F.col("independent") >= 2, F.least(F.lit(36), F.bround(F.round(12 * F.log2(F.col("independent").cast("double")), 6), 0).cast("int"))).otherwise(0).alias("corroboration"),
        F.when(F.size("leans") >= 2, 8).otherwise(0).alias("lean_span"),
        F.when(hard, 10).otherwise(0).alias("hard"),
        recency_points((F.lit(NOW_S) - F.col("published_s")) / 3600.0).alias("recency"),
    )


@query("r13_boosts", with_tables("articles") + "SELECT id, 1000000 * (CASE WHEN contains(lower(title), 'tion') THEN 1 ELSE 0 END) + 500000 * (CASE WHEN source_id = 'src2' THEN 1 ELSE 0 END) + 250000 * (CASE WHEN list_contains(topics, 'science') THEN 1 ELSE 0 END) AS boost FROM articles")
def r13(spark, d):
    boosts = spark.createDataFrame([("keyword", "tion", 1.0), ("source", "src2", 0.5), ("topic", "science", 0.25)], "kind string, value string, amount double")
    a = articles(spark, d)
    hit = F.when(F.col("kind") == "keyword", F.lower("title").contains(F.col("value"))).when(F.col("kind") == "source", F.col("source_id") == F.col("value")).otherwise(F.array_contains("topics", F.col("value")))
    got = a.join(F.broadcast(boosts), hit).groupBy("id").agg(F.sum(F.floor(F.col("amount") * 1_000_000 + 0.5)).cast("long").alias("b"))
    return a.select("id").join(got, "id", "left").select("id", F.coalesce("b", F.lit(0)).cast("int").alias("boost"))


@query("r15_seen_penalty", with_tables("history") + "SELECT user_id, article_id, CAST(floor(round(-0.5 * pow(2, -(epoch((SELECT max(ts) FROM history)) - epoch(max(ts))) / 86400.0), 6) * 1e6 + 0.5) AS BIGINT) AS penalty FROM history WHERE kind IN ('opened', 'shown') GROUP BY ALL")
def r15(spark, d):
    h = history(spark, d)
    last = F.broadcast(h.agg(F.max("ts").alias("last")))
    s = h.filter(F.col("kind").isin("opened", "shown")).groupBy("user_id", "article_id").agg(F.max("ts").alias("ts")).crossJoin(last)
    age = (F.unix_micros(F.col("last").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 1e6
    return s.select("user_id", "article_id", F.floor(F.round(-0.5 * F.pow(F.lit(2.0), -age / 86400.0), 6) * 1e6 + 0.5).cast("long").alias("penalty"))


@query("r19_silence", with_tables("articles") + f"SELECT topic, ({NOW_S} - max(published_s)) // 3600 AS quiet_hours FROM (SELECT unnest(['politics', 'economy', 'science', 'conflict', 'culture', 'sport']) AS topic) LEFT JOIN articles ON list_contains(topics, topic) GROUP BY topic")
def r19(spark, d):
    defs = spark.createDataFrame([(t,) for t in [*TOPICS, "sport"]], "topic string")
    a = articles(spark, d).select(F.explode("topics").alias("topic"), "published_s").groupBy("topic").agg(F.max("published_s").alias("m"))
    return defs.join(a, "topic", "left").select("topic", F.floor((F.lit(NOW_S) - F.col("m")) / 3600).cast("long").alias("quiet_hours"))


@query("o05_select_pool")
def o05(spark, d):
    """Greedy with a byte budget, so held against a brute-force version in the tests."""
    ship(spark)
    a = members(spark, d).join(articles(spark, d), F.col("article_id") == F.col("id"))
    c = a.select((F.col("id") % 4).alias("run_id"), "id", "source_id", F.col("cluster_id").cast("long"), (F.col("n_chars") % 97).alias("points"), (F.col("n_chars") % 1900 + 100).alias("bytes"))
    return select_pool(c, 60_000)


POOL_BUDGET = 60_000


def pool_candidates(spark, d):
    """Candidates of O5: runs of six hours, with the points of R9 that the tables give."""
    f = facts(spark, d).select("cluster_id", "independent", "leans")
    a = members(spark, d).join(articles(spark, d), F.col("article_id") == F.col("id")).join(f, "cluster_id").join(F.broadcast(sources(spark, d)), "source_id", "left")
    run = F.floor((F.col("published_s") - BASE_S) / 21_600)
    age = (F.lit(BASE_S) + (run + 1) * 21_600 - F.col("published_s")) / 3600.0
    score = F.least(F.lit(36), F.bround(12 * F.log2(F.col("independent").cast("double")), 0)) + F.when(F.size("leans") >= 2, 8).otherwise(0) + F.when(F.arrays_overlap("topics", F.array(*map(F.lit, HARD_NEWS))), 10).otherwise(0) + F.bround(20 * F.pow(F.lit(2.0), -age / 12), 0)
    return a.select(run.alias("run_id"), "id", "url", "source_id", "syndication_group", F.col("cluster_id").cast("long"), ((F.col("independent") >= 2) & (F.size("leans") >= 2)).alias("two_sided"), "bucket", "lean", "topics", score.cast("long").alias("score"), F.col("published_s").cast("long"), age.alias("age_h"), (F.octet_length("title") + F.octet_length("dek") + 200).cast("long").alias("bytes"))


@query("o05_fill_pool")
def o05_fill(spark, d):
    """Floors of outlets, stories, buckets and tags, then the fill under all ceilings; held against a greedy run in the tests."""
    ship(spark)
    return fill_pool(pool_candidates(spark, d), POOL_BUDGET, {"science": 12})


@query("o14_page_passes")
def o14(spark, d):
    """Ordered scans of pages of some 250 cards, held against brute force in the tests."""
    ship(spark)
    a = members(spark, d).join(articles(spark, d), F.col("article_id") == F.col("id")).join(F.broadcast(sources(spark, d)), "source_id")
    hard = F.arrays_overlap("topics", F.array(*map(F.lit, HARD_NEWS)))
    lists = max(8, read(spark, d, "documents").count() // 250)
    pages = a.select((F.col("id") % lists).alias("list_id"), "id", F.col("n_chars").alias("score"), F.col("published_s").alias("neutral"), (F.col("cluster_id") % 30).cast("long").alias("event"), "lean", F.array_distinct(T.content_words(F.col("title"))).alias("words"), hard.alias("must_know"), "topics")
    return run_passes(pages, [("science", 2, 10), ("culture", 1, 6)])
