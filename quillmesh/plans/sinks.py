"""S, J, K, O, T: tables written and read back, samples, joined stories, streams joined."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.operators.graph import FEW_EDGES, components
from quillmesh.operators.items import first_by
from quillmesh.operators.order import placed
from quillmesh.operators.scale import materialize, scratch
from quillmesh.sources.fixtures import NOW_S, articles, members, with_tables
from quillmesh.streaming import state as K

from . import ranking, relations  # noqa: F401  (their queries are used here)
from .base import ORACLE_SQL, QUERIES, query
from .streams import events_stream, finished


def reserve(items: DataFrame, score: str, outlet_cap: int = 25, shard_cap: int = 300) -> DataFrame:
    """(tag, rank, id): by falling score, then newest, then id, the first row of an
    address, `outlet_cap` rows an outlet, and `shard_cap` of those a tag."""
    order = [F.desc(score), F.desc("published_s"), F.col("id")]
    one = first_by(items, ["url"], *order)
    kept = one.withColumn("own_", F.row_number().over(Window.partitionBy("source_id").orderBy(*order))).filter(F.col("own_") <= outlet_cap)
    rank = F.row_number().over(Window.partitionBy("tag").orderBy(*order))
    return kept.withColumn("tag", F.explode(F.array_distinct("topics"))).filter(r"tag rlike '^[a-z][a-z0-9_]{0,40}$'").withColumn("rank", rank).filter(F.col("rank") <= shard_cap).select("tag", "rank", "id", "source_id", "url", "title")


SHARDS = """one AS (SELECT * FROM articles QUALIFY row_number() OVER (PARTITION BY url ORDER BY n_chars DESC, published_s DESC, id) = 1),
  own AS (SELECT * FROM one QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY n_chars DESC, published_s DESC, id) <= 25),
  shards AS (SELECT tag, id, title, row_number() OVER (PARTITION BY tag ORDER BY n_chars DESC, published_s DESC, id) AS rank FROM (SELECT *, unnest(topics) AS tag FROM own) QUALIFY rank <= 300)"""


@query("s16_reserve_files", with_tables("articles", also=SHARDS) + "SELECT tag, count(*) AS n, sum(id)::BIGINT AS ids, sum(length(title))::BIGINT AS chars FROM shards GROUP BY tag")
def s16(spark, d):
    """A folder of JSON a tag, read back as the index counts it."""
    where = scratch(spark, "reserve")
    reserve(articles(spark, d), "n_chars").repartition("tag").write.partitionBy("tag").json(where)
    rows = spark.read.schema("tag string, id long, title string").json(where)
    return rows.groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"), F.sum(F.length("title")).alias("chars"))


@query("s14_pool_file", with_tables("articles") + "SELECT id, source_id, url, title, dek, published_s, topics FROM articles")
def s14(spark, d):
    """Items as JSON lines in UTF-8, read back under their schema."""
    where, fields = scratch(spark, "pool"), ["id", "source_id", "url", "title", "dek", "published_s", "topics"]
    rows = articles(spark, d).select(*fields)
    rows.write.option("compression", "gzip").json(where)
    return spark.read.schema(rows.schema).json(where)


@query("s17_candidate_file", with_tables("articles", "members") + f"SELECT id, source_id, url, substr(dek, 1, 600) AS dek FROM articles WHERE id NOT IN (SELECT article_id FROM members JOIN articles ON article_id = id WHERE {NOW_S} - published_s < 21600 AND len(topics) >= 4)")
def s17(spark, d):
    """Candidates but for hidden ids (here recent items of four topics and more), written and read back."""
    a = articles(spark, d)
    hidden = members(spark, d).join(a, F.col("article_id") == F.col("id")).filter((F.lit(NOW_S) - F.col("published_s") < 21_600) & (F.size("topics") >= 4)).select("id")
    where, rows = scratch(spark, "candidates"), a.join(hidden, "id", "left_anti").select("id", "source_id", "url", F.substring("dek", 1, 600).alias("dek"))
    rows.write.option("compression", "gzip").json(where)
    return spark.read.schema(rows.schema).json(where)


@query("t04_near_misses_by_shared", ORACLE_SQL["j12_near_misses"] + " ORDER BY shared DESC, a, b LIMIT 40")
def t04(spark, d):
    """T4: the 40 near misses with the most words in common, ties by the pair."""
    return QUERIES["j12_near_misses"](spark, d).orderBy(F.desc("shared"), "a", "b").limit(40)


ANCHOR = ORACLE_SQL["w08_anchor"]


@query("j14_w8_pairs", with_tables("members") + f"SELECT m.cluster_id, w.id AS anchor, m.article_id AS member FROM members m JOIN ({ANCHOR}) w ON m.cluster_id = w.cluster_id WHERE w.id <> m.article_id")
def j14(spark, d):
    """Each cluster's anchor, the member most like the others (W8), with each other member."""
    anchors = QUERIES["w08_anchor"](spark, d).select("cluster_id", F.col("id").alias("anchor"))
    return members(spark, d).join(anchors, "cluster_id").filter("anchor <> article_id").select("cluster_id", "anchor", F.col("article_id").alias("member"))


PAIRED = """o AS (SELECT id, published_s, topics, cluster_id, row_number() OVER (ORDER BY md5('pairs' || id), id) AS place FROM articles JOIN members ON article_id = id)"""


@query("j13_unrelated_pairs", with_tables("articles", "members", also=PAIRED) + "SELECT least(x.id, y.id) AS a, greatest(x.id, y.id) AS b FROM o x JOIN o y ON y.place = x.place + 1 WHERE abs(x.published_s - y.published_s) >= 86400 AND x.cluster_id <> y.cluster_id AND NOT list_has_any(x.topics, y.topics) ORDER BY x.place LIMIT 200")
def j13(spark, d):
    """200 sampled pairs of other stories, without a common topic, a day and more apart.

    Items next to each other in an order by hash are the draws, so no pair is built that is not drawn.
    """
    a = articles(spark, d).join(members(spark, d), F.col("id") == F.col("article_id")).select("id", "published_s", "topics", "cluster_id")
    o = materialize(placed(a.withColumn("h", F.md5(F.concat(F.lit("pairs"), F.col("id").cast("string")))), "h", "id"), scratch(spark, "drawn"))
    y = o.select((F.col("place") - 1).alias("place"), F.col("id").alias("other"), F.col("published_s").alias("s"), F.col("topics").alias("ts"), F.col("cluster_id").alias("c"))
    far = (F.abs(F.col("published_s") - F.col("s")) >= 86_400) & (F.col("cluster_id") != F.col("c")) & ~F.arrays_overlap("topics", "ts")
    return o.join(y, "place").filter(far).orderBy("place").limit(200).select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"))


HALF = """s AS (SELECT article_id AS id, count(*) OVER (PARTITION BY unit_id) > 1 AS grouped, md5('seed7' || article_id) AS h FROM members), k AS (SELECT greatest(1, CAST(round_even(count(*) * 0.1, 0) AS BIGINT)) AS k, count(*) FILTER (WHERE grouped) AS g FROM s),
  r AS (SELECT *, row_number() OVER (PARTITION BY grouped ORDER BY h, id) AS r FROM s)"""


@query("t10_half_grouped", with_tables("members", also=HALF) + "SELECT id, grouped FROM r, k WHERE r <= CASE WHEN grouped THEN (k + 1) // 2 ELSE k - least(g, (k + 1) // 2) END")
def t10(spark, d):
    """A tenth as a seeded sample, half of items that share a unit and half of those alone."""
    m = members(spark, d)
    sizes = m.groupBy("unit_id").agg((F.count(F.lit(1)) > 1).alias("grouped"))
    s = m.join(sizes, "unit_id").select(F.col("article_id").alias("id"), "grouped", F.md5(F.concat(F.lit("seed7"), F.col("article_id").cast("string"))).alias("h"))
    n = s.agg(F.count(F.lit(1)).alias("n"), F.count_if("grouped").alias("g")).first()
    k = max(1, round(n["n"] * 0.1))
    grouped = min(n["g"], (k + 1) // 2)
    part = lambda only, size: s.filter(only).orderBy("h", "id").limit(size).select("id", "grouped")
    return part("grouped", grouped).union(part("not grouped", k - grouped))


JOINED = f"""miss AS (SELECT a, b, least(0.99, 0.6 + 0.1 * shared) AS p FROM ({ORACLE_SQL["j12_near_misses"]})),
  unitsize AS (SELECT unit_id, count(*) AS n FROM members GROUP BY unit_id),
  held AS (SELECT DISTINCT unit_id FROM members JOIN articles ON article_id = id WHERE len(topics) >= 5),
  link AS (SELECT DISTINCT x.unit_id AS x, y.unit_id AS y FROM miss JOIN members x ON x.article_id = a JOIN members y ON y.article_id = b WHERE p >= 0.9 AND x.unit_id <> y.unit_id AND x.unit_id NOT IN (FROM held) AND y.unit_id NOT IN (FROM held)),
  sym AS (SELECT x, y FROM link UNION SELECT y, x FROM link),
  walk AS (SELECT x, y FROM sym UNION SELECT w.x, s.y FROM walk w JOIN sym s ON w.y = s.x),
  comp AS (SELECT x AS unit_id, least(x, min(y)) AS c FROM walk GROUP BY x),
  fits AS (SELECT c FROM comp JOIN unitsize USING (unit_id) GROUP BY c HAVING sum(n) <= 12)"""


@query("o16_story_join", with_tables("articles", "members", also=JOINED) + "SELECT unit_id, (SELECT arg_min(id, (published_s, id)) FROM comp c2 JOIN members m USING (unit_id) JOIN articles ON m.article_id = id WHERE c2.c = comp.c) AS seed FROM comp WHERE c IN (FROM fits)")
def o16(spark, d):
    """Stories that sure near misses (0.9 and more) join, up to 12 members together, none of an event; named by the first item."""
    m = members(spark, d).select("unit_id", F.col("article_id").alias("id"))
    own = m.join(articles(spark, d).select("id", "published_s", F.size("topics").alias("topics")), "id")
    units = materialize(own.groupBy("unit_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("published_s", "id")).alias("first"), F.max("topics").alias("topics")), scratch(spark, "units"))
    sure = QUERIES["j12_near_misses"](spark, d).filter(F.least(F.lit(0.99), 0.6 + 0.1 * F.col("shared")) >= 0.9)
    free = m.join(units.filter("topics < 5").select("unit_id"), "unit_id")
    links = sure.join(free.select(F.col("id").alias("a"), F.col("unit_id").alias("x")), "a").join(free.select(F.col("id").alias("b"), F.col("unit_id").alias("y")), "b").filter("x <> y")
    met = materialize(components(links.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), FEW_EDGES).join(units, F.col("node") == F.col("unit_id")).select("unit_id", "component", "n", "first"), scratch(spark, "joined"))
    fits = met.groupBy("component").agg(F.sum("n").alias("members"), F.min("first").alias("first_")).filter("members <= 12")
    return met.join(fits, "component").select("unit_id", F.col("first_.id").alias("seed"))


@query("k12_stream_join", "SELECT v.event_id AS shown, c.event_id AS opened FROM events v JOIN events c ON v.user_id = c.user_id AND c.ts BETWEEN v.ts AND v.ts + INTERVAL 1 HOUR WHERE v.event_type = 'view' AND c.event_type = 'click'")
def k12(spark, d):
    """Two streams joined: what a reader opened within an hour of a view."""
    e = lambda kind: events_stream(spark, d).filter(F.col("event_type") == kind).select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    return finished(K.opened_within(e("view"), e("click")), spark, "append")
