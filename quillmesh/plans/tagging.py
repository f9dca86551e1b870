"""Tables of terms and rules over whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmesh.operators import terms as T
from quillmesh.session import ship
from quillmesh.sources.fixtures import read, sources, with_tables
from quillmesh.sources.rules import passage_rules, passage_rules_sql

from .base import query

WORDS = {"fold": T.plain_words, "whole": False}
PAIRED = {"term": (1, 2), "pair": (4, 1), "exclude": (14, 1)}


def whole_texts(spark, d):
    """id, bucket, text: whole documents with their outlet's bucket."""
    return read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("source_id"), "text").join(F.broadcast(sources(spark, d).select("source_id", "bucket")), "source_id", "left").select("id", "bucket", "text")


@query("j20_rule_words", f"WITH {passage_rules_sql(PAIRED)} SELECT id, rule FROM parts WHERE list_contains(parts, 'term') AND NOT list_contains(parts, 'exclude') AND (list_contains(parts, 'pair') OR rule NOT IN (SELECT rule FROM rules WHERE part = 'pair'))")
def j20_words(spark, d):
    """Rules of terms, pairs and exclusions, from a table, over whole texts: one scan a text."""
    ship(spark)
    return T.matched_rules(whole_texts(spark, d), passage_rules(spark, d, PAIRED), **WORDS)


TOLD = " OR ".join(("list_contains(parts, 'keyword')", "list_contains(parts, 'strong')", "(list_contains(parts, 'named') AND list_contains(parts, 'context'))", "(list_contains(parts, 'weak') AND NOT list_contains(parts, 'negative'))", "(list_contains(parts, 'state') AND list_contains(parts, 'occasion'))"))


@query("r01_rule_tags", with_tables("sources", also=passage_rules_sql() + f""",
  texts AS (SELECT id, bucket FROM hays LEFT JOIN sources ON source = source_id),
  topics AS (SELECT r_name AS bucket, lower(r_name) AS tag FROM region WHERE r_regionkey < 3),
  implied AS (SELECT lower(r_name) AS tag, 'key' || r_regionkey AS also FROM region WHERE r_regionkey < 2 UNION ALL SELECT 't' || r_regionkey, 'key' || r_regionkey FROM region),
  direct AS (SELECT id, rule AS tag FROM parts WHERE {TOLD} UNION SELECT id, tag FROM texts JOIN topics USING (bucket)),
  tags AS (SELECT id, tag FROM direct UNION SELECT id, also FROM direct JOIN implied USING (tag))""").replace("WITH RECURSIVE", "WITH") + "SELECT id, tag FROM tags UNION ALL SELECT id, 'world' FROM texts WHERE bucket IS NOT NULL AND id NOT IN (SELECT id FROM tags)")
def r01_rules(spark, d):
    """Keywords, rules of several parts, tags of buckets, what they imply, and the default."""
    ship(spark)
    region = read(spark, d, "region")
    topics = region.filter("r_regionkey < 3").select(F.col("r_name").alias("bucket"), F.lower("r_name").alias("tag"))
    key = F.concat(F.lit("key"), F.col("r_regionkey").cast("string")).alias("also")
    implied = region.filter("r_regionkey < 2").select(F.lower("r_name").alias("tag"), key).union(region.select(F.concat(F.lit("t"), F.col("r_regionkey").cast("string")), key))
    return T.topic_tags(whole_texts(spark, d), passage_rules(spark, d), topics, implied, **WORDS)


def gazetteer(spark, d):
    """label, kind, term: names of regions and countries, from the nations and from the first words of benchmark passages."""
    nation, region = read(spark, d, "nation"), read(spark, d, "region")
    named = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    own = named.select(F.col("r_name").alias("label"), F.lit("strong").alias("kind"), F.initcap("n_name").alias("term"))
    parts = {"strong": (1, 2), "weak": (4, 1), "exclude": (1, 3), "strip": (12, 2)}
    passages = passage_rules(spark, d, parts).join(region.select("r_name", F.concat(F.lit("t"), F.col("r_regionkey").cast("string")).alias("rule")), "rule")
    return own.union(passages.select("r_name", "part", "term"))


@query("r05_region_terms")
def r05_signals(spark, d):
    """Regions by strong and weak terms, with phrases to strip and to exclude, over whole texts; the tests hold it against regular expressions."""
    ship(spark)
    weak = read(spark, d, "region").select(F.col("r_name").alias("label"), F.col("r_name").alias("bucket"))
    return T.geo_signals(whole_texts(spark, d), gazetteer(spark, d), weak)


@query("r06_country_names")
def r06_names(spark, d):
    """Countries by the longest names first; shorter ones within them do not count."""
    ship(spark)
    parts = {f"{i}": (1, i) for i in (1, 2, 3)}
    own = read(spark, d, "nation").select(F.col("n_name").alias("label"), F.lit("name").alias("kind"), F.initcap("n_name").alias("term"))
    nested = passage_rules(spark, d, parts).select(F.concat("rule", "part"), F.lit("name"), "term")
    strip = passage_rules(spark, d, {"strip": (12, 2)}).select(F.lit("any"), "part", "term")
    return T.countries(whole_texts(spark, d), own.union(nested).union(strip))
