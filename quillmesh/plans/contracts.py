"""C, P: documents held against a schema, and the tables of a pool against each other."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmesh.operators.contract import balance_faults, event_faults, reference_faults, schema_faults
from quillmesh.operators.items import ledger
from quillmesh.sources.fixtures import articles, members, read, runs, sources, with_tables

from .base import query
from .items import RAW, REASON, checked

#: The shape of an item's record. Bounds are such that the texts at hand break each.
ITEM = {
    "$defs": {"topic": {"type": "string", "enum": ["politics", "economy", "science", "culture"]}},
    "type": "object",
    "required": ["id", "title", "image"],
    "additionalProperties": False,
    "properties": {
        "id": {"type": "integer", "minimum": 10},
        "title": {"type": "string", "minLength": 40, "maxLength": 60, "pattern": "^[A-Z]"},
        "topics": {"type": "array", "minItems": 1, "maxItems": 2, "items": {"$ref": "#/$defs/topic"}},
        "weights": {"type": "array", "uniqueItems": True, "items": {"type": ["integer", "null"]}},
        "kind": {"const": "item"},
    },
}
_x = "CASE WHEN {} THEN ['{}'] ELSE [] END"
ITEM_SQL = ", ".join((
    _x.format("id % 7 = 0", "$: image is missing"),
    _x.format("id < 10", "$.id: too small"),
    _x.format("length(title) < 40", "$.title: too short"),
    _x.format("length(title) > 60", "$.title: too long"),
    _x.format("NOT regexp_matches(title, '^[A-Z]')", "$.title: not of the pattern"),
    _x.format("len(topics) < 1", "$.topics: too few"),
    _x.format("len(topics) > 2", "$.topics: too many"),
    "list_transform(list_filter(list_zip(topics, range(len(topics))), lambda t: t[1] = 'conflict'), lambda t: '$.topics[' || t[2] || ']: not of the list')",
    _x.format("id % 3 = n_chars % 3", "$.weights: repeats"),
    "CASE WHEN lang = 'en' THEN ['$.kind: not \"item\"'] ELSE [] END",
    "['$.lang: not known']",
    _x.format("id % 7 <> 0", "$.image: not known"),
))


@query("c01_schema_engine", with_tables("articles") + f"SELECT id, unnest(flatten([{ITEM_SQL}])) AS fault FROM articles")
def c01(spark, d):
    """Each item as JSON, parsed, against a closed schema with a reference, lists, patterns and bounds."""
    i = F.col("id")
    record = F.struct("id", "title", "topics", F.array(i % 3, F.col("n_chars") % 3).alias("weights"), F.when(F.col("lang") == "en", "page").otherwise("item").alias("kind"), "lang", F.when(i % 7 != 0, "x").alias("image"))
    a = articles(spark, d).select("id", F.try_parse_json(F.to_json(record)).alias("v"))
    return a.select("id", F.explode(schema_faults(F.col("v"), ITEM)).alias("fault"))


#: The shape of a state document.
STATE = {
    "type": "object",
    "required": ["schema_version", "generated_at", "source_health", "clusters", "events"],
    "additionalProperties": False,
    "properties": {
        "schema_version": {"const": 1},
        "generated_at": {"type": "string", "minLength": 1},
        "source_health": {"type": "object", "additionalProperties": {"type": "object", "required": ["errors", "empties"]}},
        "clusters": {"type": "array", "items": {"type": "object", "required": ["id", "article_ids"]}},
        "events": {"type": "array", "items": {"type": "object", "required": ["id", "cluster_ids", "live"], "additionalProperties": False, "properties": {"id": {}, "cluster_ids": {}, "live": {}, "label": {}}}},
        "embed_budget": {"type": "object", "required": ["day", "neurons"], "additionalProperties": False, "properties": {"day": {"type": "string"}, "neurons": {"type": "number", "minimum": 0}}},
        "first_seen": {"type": "object", "additionalProperties": {"type": "string"}},
    },
}
#: (name, document, its faults): one of each way to be wrong.
STATES = [
    ("whole", '{"schema_version":1,"generated_at":"t","source_health":{"a":{"errors":0,"empties":1}},"clusters":[{"id":"c","article_ids":[]}],"events":[{"id":1,"cluster_ids":[],"live":false}],"embed_budget":{"day":"d","neurons":1.5},"first_seen":{"x":"t"}}', []),
    ("no JSON", '{"schema_version":', ["$: not JSON"]),
    ("no text", None, ["$: not JSON"]),
    ("list", "[]", ["$: not object"]),
    ("version", '{"schema_version":2,"generated_at":"","source_health":{},"clusters":[],"events":[]}', ["$.schema_version: not 1", "$.generated_at: too short"]),
    ("parts", '{"schema_version":1,"generated_at":"t","source_health":{"a":{"errors":0},"b":3},"clusters":{},"events":[{"id":1,"live":true,"x":0},7]}', ["$.source_health.a: empties is missing", "$.source_health.b: not object", "$.clusters: not array", "$.events[0]: cluster_ids is missing", "$.events[0].x: not known", "$.events[1]: not object"]),
    ("extras", '{"schema_version":1,"generated_at":"t","source_health":{},"clusters":[],"events":[],"embed_budget":{"day":"d","neurons":-1},"first_seen":{"x":1},"more":null}', ["$.embed_budget.neurons: too small", "$.first_seen.x: not string", "$.more: not known"]),
    ("budget", '{"schema_version":1,"generated_at":"t","source_health":{},"clusters":[],"events":[],"embed_budget":{"day":"d","neurons":true}}', ["$.embed_budget.neurons: not number"]),
]


@query("c05_state_faults", "SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{f}')" for n, _, fs in STATES for f in fs) + ") v(name, fault)")
def c05(spark, d):
    """State documents, broken in each way; a document that is no JSON is a fault and raises nothing."""
    rows = spark.createDataFrame([(n, x) for n, x, _ in STATES], "name string, document string")
    return rows.select("name", F.explode(schema_faults(F.try_parse_json("document"), STATE)).alias("fault"))


POOL = """it AS (SELECT id, CASE WHEN id % 90 = 1 THEN 'src99' ELSE source_id END AS source_id FROM articles UNION ALL SELECT id, source_id FROM articles WHERE n_chars % 50 = 0),
  pl AS (SELECT cluster_id, article_id AS id FROM members UNION ALL SELECT user_id % 257, event_id FROM events WHERE event_type = 'error'),
  cp AS (SELECT cluster_id, unit_id AS group_id, article_id AS id FROM members UNION ALL SELECT user_id % 257, event_id % 7, event_id FROM events WHERE event_type = 'signup')"""


@query("c02_all_references", with_tables("articles", "sources", "members", also=POOL) + """SELECT 'item id repeats' AS fault, id::VARCHAR AS key FROM it GROUP BY id HAVING count(*) > 1
  UNION ALL SELECT 'unknown outlet', id::VARCHAR FROM it WHERE source_id NOT IN (SELECT source_id FROM sources)
  UNION ALL SELECT DISTINCT 'unknown item', id::VARCHAR FROM pl WHERE id NOT IN (SELECT id FROM it)
  UNION ALL SELECT DISTINCT 'item listed twice', id::VARCHAR FROM (SELECT id FROM pl GROUP BY cluster_id, id HAVING count(*) > 1)
  UNION ALL SELECT 'item in several clusters', id::VARCHAR FROM pl GROUP BY id HAVING count(DISTINCT cluster_id) > 1
  UNION ALL SELECT DISTINCT 'copy outside its cluster', id::VARCHAR FROM cp WHERE (cluster_id, id) NOT IN (SELECT (cluster_id, id) FROM pl)
  UNION ALL SELECT DISTINCT 'copy in several groups', id::VARCHAR FROM (SELECT id FROM cp GROUP BY cluster_id, id HAVING count(*) > 1)""")
def c02(spark, d):
    """Items, outlets, clusters and groups of copies, to which events add listings that do not fit."""
    a, m, e = articles(spark, d), members(spark, d), read(spark, d, "events")
    cluster = (F.col("user_id") % 257).alias("cluster_id")
    items = a.select("id", F.when(F.col("id") % 90 == 1, "src99").otherwise(F.col("source_id")).alias("source_id")).union(a.filter("n_chars % 50 = 0").select("id", "source_id"))
    listed = m.select("cluster_id", F.col("article_id").alias("id")).union(e.filter("event_type = 'error'").select(cluster, "event_id"))
    copies = m.select("cluster_id", F.col("unit_id").alias("group_id"), F.col("article_id").alias("id")).union(e.filter("event_type = 'signup'").select(cluster, F.col("event_id") % 7, "event_id"))
    return reference_faults(items, sources(spark, d), listed, copies)


@query("c03_all_balances", with_tables("articles", "sources", "runs", also=RAW + f""", ck AS (SELECT id, {REASON} AS reason FROM raw), rl AS (SELECT coalesce(reason, 'published') AS metric, count(*) AS n FROM ck GROUP BY ALL),
  tl AS (SELECT metric, CASE WHEN metric = 'bad_url' THEN n + 2 ELSE n END AS n FROM rl)""") + """SELECT 'count is not that of the rows' AS fault, metric AS key FROM tl JOIN rl USING (metric) WHERE tl.n <> rl.n
  UNION ALL SELECT 'fetched is not the sum', 'fetched' WHERE (SELECT sum(n) FROM tl) <> (SELECT count(*) FROM articles)
  UNION ALL SELECT 'outlet without health', source_id FROM sources WHERE source_id NOT IN (SELECT source_id FROM runs WHERE state = 'empty' AND items = 0 AND run % 3 = 0)
  UNION ALL SELECT DISTINCT 'health of no outlet', source_id FROM runs WHERE state = 'empty' AND run % 3 = 0 AND source_id NOT IN (SELECT source_id FROM sources)""")
def c03(spark, d):
    """A ledger that tells two bad addresses too many, and health from some runs only."""
    rows = checked(spark, d).select("id", "drop_reason")
    told = ledger(rows).withColumn("n", F.col("n") + F.when(F.col("metric") == "bad_url", 2).otherwise(0))
    health = runs(spark, d).filter("state = 'empty' and run % 3 = 0").select("source_id").distinct()
    return balance_faults(rows, told, sources(spark, d).select("source_id"), health)


EVENTS = """ev AS (SELECT user_id % 40 AS event_id, event_id % 300 AS cluster_id, user_id % 40 < 5 AS live, user_id % 3 = 0 AS eligible FROM events WHERE event_type = 'click')"""


@query("c04_all_events", with_tables("members", also=EVENTS) + """SELECT DISTINCT 'unknown cluster' AS fault, cluster_id::VARCHAR AS key FROM ev WHERE cluster_id NOT IN (SELECT cluster_id FROM members)
  UNION ALL SELECT 'cluster in several events', cluster_id::VARCHAR FROM ev GROUP BY cluster_id HAVING count(DISTINCT event_id) > 1
  UNION ALL SELECT DISTINCT 'cluster listed twice', cluster_id::VARCHAR FROM (SELECT cluster_id FROM ev GROUP BY event_id, cluster_id HAVING count(*) > 1)
  UNION ALL SELECT DISTINCT 'live but not eligible', event_id::VARCHAR FROM ev WHERE live AND NOT eligible""")
def c04(spark, d):
    """C4: known clusters, one event a cluster, no cluster twice, live only where eligible."""
    u = F.col("user_id")
    e = read(spark, d, "events").filter("event_type = 'click'").select((u % 40).alias("event_id"), (F.col("event_id") % 300).alias("cluster_id"), (u % 40 < 5).alias("live"), (u % 3 == 0).alias("eligible"))
    return event_faults(e, members(spark, d).select("cluster_id").distinct())
