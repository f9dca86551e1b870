"""Stories made ready for pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmesh.operators import storypages as P
from quillmesh.operators.items import first_by
from quillmesh.operators.ranking import run_passes
from quillmesh.operators.scale import materialize, scratch
from quillmesh.functions import text as T
from quillmesh.session import ship
from quillmesh.sources.fixtures import HARD_NEWS, articles, history, members, read, sources, with_tables

from .base import query
from .items import STORY, facts


def stories_with_titles(spark, d):
    """id, rank, titles: the units of each story as stories of their own, fuller ones ranking lower."""
    a = members(spark, d).join(articles(spark, d), F.col("article_id") == F.col("id")).join(F.broadcast(sources(spark, d).select("source_id", "syndication_group")), "source_id", "left")
    g = a.groupBy(F.col("unit_id").alias("id_"), F.floor(F.col("id") / 20).alias("part")).agg(F.countDistinct("syndication_group").alias("independent"), F.count(F.lit(1)).alias("n"), F.max("published_s").alias("latest"), F.min("id").alias("id"), F.array_sort(F.collect_set("title")).alias("titles"))
    return g.select("id", F.struct((-F.col("independent")).alias("i"), (-F.col("n")).alias("n"), (-F.col("latest")).alias("t"), "id").alias("rank"), "titles")


@query("u03_ordered_dedup")
def u03(spark, d):
    """The order-dependent dedup of stories by headline, in rounds; held against the sequential scan in the tests."""
    return P.without_twins(stories_with_titles(spark, d))


SPLIT = f"""art AS (SELECT a.*, m.cluster_id, m.unit_id FROM members m JOIN articles a ON a.id = m.article_id),
  anc AS (SELECT cluster_id, arg_min(id, (published_s, id)) AS anchor, arg_min(n_chars, (published_s, id)) AS size FROM art GROUP BY cluster_id),
  r AS (SELECT art.*, anchor, CASE WHEN (id + anchor) % 4 > 0 THEN round(least(n_chars, size) / greatest(n_chars, size, 1), 3) END AS same, CASE WHEN (id + anchor) % 4 > 0 THEN lang END AS framing, unit_id % 2 = 0 AND len(topics) > 2 AS embedded, art.cluster_id IN (SELECT n_nationkey FROM nation) AS live FROM art JOIN anc USING (cluster_id)),
  o AS (SELECT *, coalesce(id <> anchor AND same < {P.SPLIT_BELOW}, false) AS off FROM r),
  l AS (SELECT cluster_id, count(*) FILTER (WHERE NOT off) AS n_left, bool_or(off) AS any_off FROM o GROUP BY cluster_id),
  f AS (SELECT *, CASE WHEN off AND NOT (live AND any_off AND n_left < 2) THEN 'split' WHEN n_left < 2 AND NOT (live AND any_off) THEN 'dissolved' ELSE 'kept' END AS fate FROM o JOIN l USING (cluster_id))"""


def split(spark, d):
    a = members(spark, d).join(articles(spark, d), F.col("article_id") == F.col("id"))
    a = a.select("cluster_id", "id", "unit_id", "source_id", "published_s", "n_chars", "lang", ((F.col("unit_id") % 2 == 0) & (F.size("topics") > 2)).alias("embedded"))
    first = a.groupBy("cluster_id").agg(F.min_by(F.struct("id", "n_chars"), F.struct("published_s", "id")).alias("f")).select("cluster_id", F.col("f.id").alias("anchor"), F.col("f.n_chars").alias("size"))
    met = a.join(first, "cluster_id").filter((F.col("id") + F.col("anchor")) % 4 > 0)
    answers = met.select("anchor", "id", F.round(F.least("n_chars", "size") / F.greatest("n_chars", "size", F.lit(1)), 3).alias("same"), F.col("lang").alias("framing"))
    live = read(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("cluster_id"))
    return P.split_stories(a.select("cluster_id", "id", "unit_id", "source_id", "embedded"), first.select("cluster_id", "anchor"), answers, sources(spark, d), live)


@query("o15_split_members", with_tables("articles", "members", also=SPLIT) + "SELECT cluster_id, id, fate, CASE WHEN fate = 'kept' AND id <> anchor THEN same END AS same, CASE WHEN fate = 'kept' AND id <> anchor THEN framing END AS framing FROM f")
def o15_members(spark, d):
    return split(spark, d)[0]


@query("o15_split_stories", with_tables("articles", "members", "sources", also=SPLIT + """, k AS (SELECT * FROM f WHERE fate = 'kept'), u AS (SELECT cluster_id, unit_id, count(*) AS n, bool_or(embedded) AS e FROM k GROUP BY ALL),
  s AS (SELECT cluster_id, sum(n)::BIGINT AS n, count(*) AS units, count(*) FILTER (WHERE n > 1) AS copies, count(*) FILTER (WHERE e) AS e FROM u GROUP BY cluster_id),
  t AS (SELECT cluster_id, count(DISTINCT coalesce(syndication_group, k.source_id)) AS independent, coalesce(list_sort(list(DISTINCT lean) FILTER (WHERE lean IS NOT NULL)), []) AS leans FROM k LEFT JOIN sources USING (source_id) GROUP BY cluster_id)""") + "SELECT cluster_id, n, units, copies, independent, leans, CASE WHEN units > 1 AND copies > 0 THEN 'minhash+cosine_entity' WHEN units > 1 THEN 'cosine_entity' ELSE 'minhash' END || CASE WHEN e > 1 AND units > 1 THEN '+embedding' ELSE '' END AS method FROM s JOIN t USING (cluster_id)")
def o15_stories(spark, d):
    return split(spark, d)[1]


def readers_pages(spark, d):
    """(cards, versions): each reader's page after mute and dedup, the passes' places, and all versions of their stories."""
    f = facts(spark, d)
    a = members(spark, d).join(articles(spark, d), F.col("article_id") == F.col("id")).join(F.broadcast(sources(spark, d)), "source_id", "left")
    versions = a.select(F.col("cluster_id").alias("story_id"), F.col("id").alias("article_id"), "source_id", "lean", F.col("n_chars").alias("score"), (F.col("n_chars") % 100).alias("base"), "published_s", F.lit(None).cast("double").alias("same"), F.when(F.col("lang") == "de", "adds").when(F.col("lang") == "fr", "different").alias("framing"))
    titled = a.groupBy("cluster_id").agg(F.array_sort(F.collect_set("title")).alias("titles"))
    rank = F.struct((-F.col("independent")).alias("i"), (-F.col("n")).alias("n"), (-F.col("latest_s")).alias("t"), F.col("cluster_id").alias("id")).alias("rank")
    twins = P.without_twins(f.join(titled, "cluster_id").select(F.col("cluster_id").alias("id"), rank, "titles"))
    stays = twins.filter("twin is null").select(F.col("id").alias("story_id"))
    seen = history(spark, d).select(F.col("user_id").alias("list_id"), "article_id").distinct()
    muted = history(spark, d).filter("kind = 'down'").join(articles(spark, d).select(F.col("id").alias("article_id"), "source_id"), "article_id").select(F.col("user_id").alias("list_id"), "source_id").distinct()
    shown = seen.join(a.select(F.col("id").alias("article_id"), F.col("cluster_id").alias("story_id"), "source_id", "title", "lean", "n_chars", "published_s", "topics"), "article_id").join(stays, "story_id", "left_semi").join(muted, ["list_id", "source_id"], "left_anti")
    one = first_by(shown, ["list_id", "story_id"], F.desc("n_chars"), "article_id")
    return materialize(one.join(f.select(F.col("cluster_id").alias("story_id"), "independent", "leans"), "story_id"), scratch(spark, "cards")), versions, muted


@query("o14_page_runs")
def o14_runs(spark, d):
    """O14 in full: mute, dedup, repeat cap, lean quota, exploration, floors, and the other side, a page a reader."""
    ship(spark)
    cards, versions, muted = readers_pages(spark, d)
    hard = F.arrays_overlap("topics", F.array(*map(F.lit, HARD_NEWS)))
    pages = cards.select("list_id", F.col("story_id").alias("id"), F.col("n_chars").alias("score"), F.col("published_s").alias("neutral"), (F.col("story_id") % 30).cast("long").alias("event"), "lean", F.array_distinct(T.content_words(F.col("title"))).alias("words"), hard.alias("must_know"), "topics")
    placed = run_passes(pages, [("science", 2, 10), ("culture", 1, 6)]).withColumnRenamed("id", "story_id")
    placed = materialize(placed.join(cards.select("list_id", "story_id", "article_id", "lean", "independent", "leans"), ["list_id", "story_id"]), scratch(spark, "placed"))
    other = P.other_side(placed, versions, muted).select("list_id", "story_id", "other", F.col("lean").alias("other_lean"))
    return placed.join(other, ["list_id", "story_id"], "left").select("list_id", "story_id", "place", "article_id", "other", "other_lean")
