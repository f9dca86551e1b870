"""Phrases, joins by time, matching, all score terms, rule tables, the live order."""

from __future__ import annotations

import json

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillmesh.functions import text as T
from quillmesh.functions.numeric import micro
from quillmesh.operators.order import as_of, matched, placed
from quillmesh.operators.ranking import affinity
from quillmesh.operators.scale import materialize, scratch
from quillmesh.sources.fixtures import NOW_S, TOPICS, articles, members, read, sources, with_tables
from quillmesh.sources.rules import load_rules

from .base import QUERIES, query
from .items import STORY, facts
from .ranking import WEIGHTS
from .stories import ENTS, PROPER, entities

WORD_GAPS = r"([\p{L}\p{N}]+)"

PHRASES = rf"""tx AS (SELECT id, 0 AS part, title AS t FROM articles UNION ALL SELECT id, 1, substr(dek, 1, 600) FROM articles),
  tk AS (SELECT id, part, unnest(regexp_extract_all(t, '[\p{{L}}\p{{N}}]+')) AS w, unnest(regexp_extract_all(' ' || t, '[^\p{{L}}\p{{N}}]+[\p{{L}}\p{{N}}]')) AS g, unnest(range(len(regexp_extract_all(t, '[\p{{L}}\p{{N}}]+')))) AS pos FROM tx),
  en AS (SELECT tk.*, (e.entity IS NOT NULL) AS ent, w = 'New' AS anew FROM tk LEFT JOIN ents e ON e.id = tk.id AND e.entity = lower(w)),
  st AS (SELECT *, (ent OR anew) AS k, coalesce(lag(ent OR anew) OVER (PARTITION BY id, part ORDER BY pos), false) AS before FROM en),
  rn AS (SELECT *, sum(CASE WHEN k AND (anew OR NOT before OR substr(g, 1, length(g) - 1) <> ' ') THEN 1 ELSE 0 END) OVER (PARTITION BY id, part ORDER BY pos) AS r FROM st),
  ph AS (SELECT DISTINCT id, string_agg(lower(w), ' ' ORDER BY pos) AS phrase FROM rn WHERE k GROUP BY id, part, r)"""


@query("f15_phrases", with_tables("articles", "sources", also=", ".join((PROPER, ENTS, PHRASES))) + "SELECT id, phrase FROM ph WHERE phrase <> 'new' AND phrase NOT IN (SELECT lower(source_id) FROM sources)")
def f15(spark, d):
    """entity words that stand next to each other with one blank between; "New" begins a phrase; outlets' names are none."""
    a = articles(spark, d)
    text = a.select("id", F.lit(0).alias("part"), F.col("title").alias("t")).union(a.select("id", F.lit(1), F.substring("dek", 1, 600)))
    gaps = F.regexp_extract_all(F.concat(F.lit(" "), "t"), F.lit(r"([^\p{L}\p{N}]+)[\p{L}\p{N}]"))
    w = text.select("id", "part", F.posexplode(F.arrays_zip(F.regexp_extract_all("t", F.lit(WORD_GAPS)).alias("w"), gaps.alias("g"))).alias("pos", "x")).select("id", "part", "pos", "x.w", "x.g", F.lower("x.w").alias("entity"))
    known = entities(spark, d).withColumn("ent", F.lit(True))
    w = w.join(known, ["id", "entity"], "left").withColumn("k", F.coalesce("ent", F.lit(False)) | (F.col("w") == "New"))
    text_order = Window.partitionBy("id", "part").orderBy("pos")
    starts = F.col("k") & ((F.col("w") == "New") | ~F.coalesce(F.lag("k").over(text_order), F.lit(False)) | (F.col("g") != " "))
    runs = w.withColumn("starts", starts.cast("int")).withColumn("run", F.sum("starts").over(text_order)).filter("k")
    words = F.array_sort(F.collect_list(F.struct("pos", "entity")))
    phrases = runs.groupBy("id", "part", "run").agg(F.array_join(words["entity"], " ").alias("phrase")).select("id", "phrase").distinct()
    own = F.broadcast(sources(spark, d).select(F.lower("source_id").alias("phrase")))  # one row an outlet
    return phrases.filter("phrase != 'new'").join(own, "phrase", "left_anti").select("id", "phrase")


HYPE = """ev AS (SELECT cluster_id % 20 AS event_id, count(DISTINCT cluster_id) * count(DISTINCT syndication_group) AS hype, min(published_s) AS since FROM members JOIN articles ON article_id = id JOIN sources USING (source_id) GROUP BY ALL)"""


@query("t08_live_order", with_tables("articles", "sources", "members", also=HYPE) + "SELECT event_id, CAST(row_number() OVER (ORDER BY event_id <> (SELECT event_id FROM ev ORDER BY since, event_id LIMIT 1), hype DESC, event_id) AS INT) AS place FROM ev")
def t08(spark, d):
    """The live event (here the one first reported), then by hype, then by id."""
    m = members(spark, d).join(articles(spark, d), F.col("article_id") == F.col("id")).join(F.broadcast(sources(spark, d)), "source_id")
    ev = m.groupBy((F.col("cluster_id") % 20).alias("event_id")).agg((F.countDistinct("cluster_id") * F.countDistinct("syndication_group")).alias("hype"), F.min("published_s").alias("since"))
    live = F.broadcast(ev.agg(F.min(F.struct("since", "event_id")).alias("live")))  # one row
    return placed(ev.crossJoin(live).withColumn("waits", F.col("event_id") != F.col("live.event_id")), "waits", F.desc("hype"), "event_id").select("event_id", "place")


@query("j21_as_of", """SELECT v.event_id, p.value AS last_purchase FROM (SELECT * FROM events WHERE event_type = 'view') v ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY ALL) p ON v.user_id = p.user_id AND v.ts >= p.ts""")
def j21(spark, d):
    """Each view with the reader's latest purchase at or before it."""
    e = read(spark, d, "events")
    bought = e.filter("event_type = 'purchase'").select("user_id", "ts", F.col("value").alias("last_purchase"))
    return as_of(e.filter("event_type = 'view'").select("event_id", "user_id", "ts"), bought, "user_id", "ts", "last_purchase").select("event_id", "last_purchase")


@query("j21_full_outer", """SELECT coalesce(a.user_id, b.user_id) AS user_id, a.n AS views, b.n AS errors FROM (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY ALL) a FULL JOIN (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY ALL) b USING (user_id)""")
def j21_outer(spark, d):
    e = read(spark, d, "events")
    n = lambda kind, name: e.filter(F.col("event_type") == kind).groupBy("user_id").agg(F.count(F.lit(1)).alias(name))
    return n("view", "views").join(n("error", "errors"), "user_id", "full")


@query("s21_rule_tables", "SELECT * FROM (VALUES " + ", ".join(f"('{t}', '{w}')" for t, ws in TOPICS.items() for w in ws) + ") v(topic, keyword)")
def s21(spark, d):
    """The topic table as a JSON file, read under its schema; an entry of another shape is an error."""
    where = scratch(spark, "rules")
    table = json.dumps({"topics": [{"id": t, "keywords": ws} for t, ws in TOPICS.items()]})
    spark.createDataFrame([(table,)], "value string").coalesce(1).write.text(where)
    return load_rules(spark, where).select(F.col("id").alias("topic"), F.explode("keywords").alias("keyword"))


@query("o09_event_matching")
def o09(spark, d):
    """Previous and current events matched 1:1 by shared articles, largest first; held against brute force in the tests."""
    m = members(spark, d).select("article_id", (F.col("cluster_id") % 20).alias("a"), (F.floor(F.col("cluster_id") / 13) % 17).cast("long").alias("b"))
    shared = materialize(m.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")), scratch(spark, "shared"))
    return matched(shared).select(F.col("a").alias("event_id"), F.col("b").alias("inherited_id"))


#: The rest of the profile: half-lives of topics, work rules by tier, boosts.
HALF_LIVES = {"politics": 12.0, "economy": 24.0, "science": 48.0, "conflict": 6.0}
WORK_POINTS = {1: 0.6, 2: 0.45, 3: 0.3, 4: 0.15}
WORK_RULES = [("desk", 1, "economy", "science"), ("world", 3, "conflict", "politics")]
BOOSTS = [("topic", "science", 0.25), ("topic", "culture", -2.0), ("source", "src2", 0.5), ("topic", "politics", 1.5)]
_half = " ".join(f"WHEN '{t}' THEN {h}" for t, h in HALF_LIVES.items())
_aff = " ".join(f"WHEN '{t}' THEN {w}" for t, w in WEIGHTS.items())
_work = " ".join(f"WHEN list_contains(topics, '{a}') AND list_contains(topics, '{b}') THEN {round(WORK_POINTS[t] * 1e6)}" for _, t, a, b in sorted(WORK_RULES, key=lambda r: r[1]))
_boost = " + ".join(f"CASE WHEN list_contains({'topics' if k == 'topic' else 'source_ids'}, '{v}') THEN {round(max(-1, min(1, x)) * 1e6)} ELSE 0 END" for k, v, x in BOOSTS)
ALL_TERMS = f"""pt AS (SELECT *, list_filter(list_transform(topics, lambda t: CAST(CASE t {_aff} END AS DOUBLE)), lambda x: x IS NOT NULL) AS ws, coalesce(list_max(list_transform(topics, lambda t: CAST(CASE t {_half} END AS DOUBLE))), 12.0) AS half FROM facts),
  q AS (SELECT cluster_id, half, CAST(floor(round(pow(2, -greatest(0, ({NOW_S} - latest_s) / 3600.0) / half), 9) * 1e6 + 0.5) AS BIGINT) AS recency,
  CAST(floor(least(1.0, coalesce(list_max(ws), 0) + 0.25 * (coalesce(list_sum(ws), 0) - coalesce(list_max(ws), 0))) * 1e6 + 0.5) AS BIGINT) AS affinity,
  CAST(floor(round(0.5 * log2(greatest(1, independent)), 9) * 1e6 + 0.5) AS BIGINT) AS importance,
  CASE WHEN list_contains(source_ids, 'src1') THEN 1.2 WHEN len(list_filter(source_ids, lambda s: s <> 'src4')) = 0 THEN 0.7 ELSE 1.0 END AS trust,
  CAST(CASE {_work} ELSE 0 END AS BIGINT) AS work, CAST({_boost} AS BIGINT) AS boosts FROM pt)"""


@query("r11_all_terms", with_tables("articles", "sources", "members", also=STORY + ", " + ALL_TERMS) + "SELECT *, recency + affinity + importance + trust_term + work + boosts AS score FROM (SELECT cluster_id, half, recency, affinity, importance, CAST(floor((trust::DOUBLE - 1) * (recency + affinity + importance) + 0.5) AS BIGINT) AS trust_term, work, boosts FROM q)")
def r11_all(spark, d):
    """Recency by the longest half-life of the matched topics, affinity, importance,
    the best trust of the outlets, the first work rule's tier and all boosts, each whole micro-points; the score is their sum."""
    table = lambda m: F.create_map(*[F.lit(x) for pair in m.items() for x in pair])
    of = lambda m: F.array_compact(F.transform("topics", lambda t: table(m)[t]))
    trust_of = table({"src1": 1.2, "src4": 0.7})
    f = facts(spark, d).withColumn("weights", of(WEIGHTS)).withColumn("half", F.coalesce(F.array_max(of(HALF_LIVES)), F.lit(12.0)))
    age = F.greatest(F.lit(0.0), (F.lit(NOW_S) - F.col("latest_s")) / 3600.0)
    f = f.withColumn("recency", micro(F.round(F.pow(F.lit(2.0), -age / F.col("half")), 9))).withColumn("affinity", micro(affinity(F.col("weights")))).withColumn("importance", micro(F.round(0.5 * F.log2(F.greatest(F.lit(1.0), F.col("independent").cast("double"))), 9)))
    trust = F.array_max(F.transform("source_ids", lambda s: F.coalesce(trust_of[s], F.lit(1.0))))
    trust_term = F.floor((trust - 1) * (F.col("recency") + F.col("affinity") + F.col("importance")) + 0.5).cast("long")
    work = F.coalesce(*[F.when(F.array_contains("topics", a) & F.array_contains("topics", b), F.lit(round(WORK_POINTS[tier] * 1e6))) for _, tier, a, b in sorted(WORK_RULES, key=lambda r: r[1])], F.lit(0)).cast("long")
    boost = sum((F.when(F.array_contains("topics" if kind == "topic" else "source_ids", value), F.lit(round(max(-1.0, min(1.0, x)) * 1e6))).otherwise(0) for kind, value, x in BOOSTS), F.lit(0)).cast("long")
    f = f.withColumn("trust_term", trust_term).withColumn("work", work).withColumn("boosts", boost)
    terms = ("recency", "affinity", "importance", "trust_term", "work", "boosts")
    return f.select("cluster_id", "half", *terms, sum((F.col(t) for t in terms), F.lit(0)).cast("long").alias("score"))
