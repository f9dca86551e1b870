"""readers' profiles held against their rules, and thumbs as toggles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.operators.contract import schema_faults
from quillmesh.sources.fixtures import history, with_tables

from .base import query

PROFILE = {
    "type": "object",
    "required": ["topics"],
    "properties": {
        "topics": {"type": "object", "additionalProperties": {"type": "object", "properties": {"phrase": {"type": "string"}, "affinity": {"type": "number", "minimum": 0}}}},
        "work_watch": {"type": "array", "items": {"type": "object", "required": ["id"], "properties": {"terms": {"type": "array", "items": {"type": "string"}}}}},
        "boosts": {"type": "array", "items": {"type": "object", "required": ["id"]}},
        "mutes": {"type": "object", "properties": {"topics": {"type": "array", "items": {"type": "string"}}}},
    },
}
FIELDS = "topics map<string,struct<phrase:string>>, work_watch array<struct<id:string,terms:array<string>,pair_any:array<string>,exclude:array<string>>>, boosts array<struct<id:string>>, mutes struct<topics:array<string>>"
TOPIC_ID = "^[a-z][a-z0-9_]*$"


def profile_faults(profiles: DataFrame) -> DataFrame:
    """(name, fault) of profiles (name, document): the schema's faults, and where it has none, those between fields.

    Between fields: the form of topic ids, phrases without a word or that read the same
    (case and punctuation aside), ids of work rules and boosts that repeat, terms without
    a word, muted topics that the profile does not have.
    """
    rows = profiles.withColumn("bad", schema_faults(F.try_parse_json("document"), PROFILE))
    p = rows.filter("size(bad) = 0").select("name", F.from_json("document", FIELDS).alias("p")).select("name", "p.*")
    topics = p.select("name", F.explode("topics").alias("id", "topic"))
    words = F.array_join(F.regexp_extract_all(F.lower("topic.phrase"), F.lit(r"([\p{L}\p{N}]+)")), " ")
    phrases = topics.filter("topic.phrase is not null").select("name", "id", words.alias("words"))
    rules = p.select("name", F.posexplode("work_watch").alias("i", "r"))
    terms = reduce(DataFrame.union, (rules.select("name", "i", F.lit(f).alias("f"), F.posexplode(f"r.{f}").alias("j", "term")) for f in ("terms", "pair_any", "exclude")))
    twice = lambda df, label: df.groupBy("name", "id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("name", F.concat(F.lit(label), "id").alias("fault"))
    muted = p.select("name", F.explode("mutes.topics").alias("id"), F.map_keys("topics").alias("own")).filter(~F.array_contains("own", F.col("id")))
    parts = [
        rows.select("name", F.explode("bad").alias("fault")),
        topics.filter(~F.col("id").rlike(TOPIC_ID)).select("name", F.concat(F.lit("form of topic id "), "id")),
        phrases.filter("words = ''").select("name", F.concat(F.lit("phrase without a word: "), "id")),
        phrases.filter("words <> ''").groupBy("name", "words").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("name", F.concat(F.lit("same phrase: "), "words")),
        twice(rules.select("name", F.col("r.id").alias("id")), "work rule repeats: "),
        twice(p.select("name", F.explode("boosts.id").alias("id")), "boost repeats: "),
        terms.filter(~F.col("term").rlike(r"[\p{L}\p{N}]")).select("name", F.concat("f", F.lit("["), F.col("i").cast("string"), F.lit("]["), F.col("j").cast("string"), F.lit("] has no word"))),
        muted.select("name", F.concat(F.lit("muted topic is not the profile's: "), "id")),
    ]
    return reduce(DataFrame.union, parts)


#: (name, document, its faults).
PROFILES = [
    ("sound", '{"topics":{"space":{"phrase":"Dark Matter","affinity":0.5}},"work_watch":[{"id":"w","terms":["x-ray"]}],"boosts":[{"id":"b"}],"mutes":{"topics":["space"]}}', []),
    ("bare", '{"topics":{}}', []),
    ("shape", '{"topics":{"Space":{"affinity":-1}},"mutes":{"topics":[3]}}', ["$.topics.Space.affinity: too small", "$.mutes.topics[0]: not string"]),
    ("none", "{}", ["$: topics is missing"]),
    ("phrases", '{"topics":{"a":{"phrase":"Dark matter"},"b":{"phrase":"dark, MATTER!"},"c":{"phrase":"?!"},"1d":{}}}', ["same phrase: dark matter", "phrase without a word: c", "form of topic id 1d"]),
    ("repeats", '{"topics":{"a":{}},"work_watch":[{"id":"w","terms":["ok","--"]},{"id":"w","exclude":[" "]}],"boosts":[{"id":"b"},{"id":"b"}],"mutes":{"topics":["a","gone"]}}', ["work rule repeats: w", "boost repeats: b", "terms[0][1] has no word", "exclude[1][0] has no word", "muted topic is not the profile's: gone"]),
]


@query("c09_profile_faults", "SELECT * FROM (VALUES " + ", ".join("('{}', '{}')".format(n, f.replace("'", "''")) for n, _, fs in PROFILES for f in fs) + ") v(name, fault)")
def c09(spark, d):
    """Profiles broken in each way."""
    return profile_faults(spark.createDataFrame([(n, x) for n, x, _ in PROFILES], "name string, document string"))


TAPS = """taps AS (SELECT user_id, article_id, kind, row_number() OVER w AS r, CASE WHEN kind IS DISTINCT FROM lag(kind) OVER w THEN 1 ELSE 0 END AS turn FROM history WHERE kind IN ('up', 'down') WINDOW w AS (PARTITION BY user_id, article_id ORDER BY ts, event_id)),
  fold AS (SELECT user_id, article_id, r, kind AS thumb FROM taps WHERE r = 1 UNION ALL SELECT t.user_id, t.article_id, t.r, CASE WHEN t.kind = f.thumb THEN NULL ELSE t.kind END FROM fold f JOIN taps t ON t.user_id = f.user_id AND t.article_id = f.article_id AND t.r = f.r + 1)"""


def thumbs(taps: DataFrame) -> DataFrame:
    """(user_id, article_id, thumb) after all taps (user_id, article_id, kind, ts, event_id).

    A tap of the same kind as the thumb clears it, another replaces it. After a change
    of kind the thumb is never of the new kind, so the last run of equal taps tells: an
    odd number leaves a thumb, an even one none.
    """
    by = Window.partitionBy("user_id", "article_id").orderBy("ts", "event_id")
    turn = (~F.col("kind").eqNullSafe(F.lag("kind").over(by))).cast("int")
    runs = taps.withColumn("turn", turn).withColumn("run", F.sum("turn").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    sizes = runs.groupBy("user_id", "article_id", "run").agg(F.count(F.lit(1)).alias("n"), F.first("kind").alias("kind"))
    last = sizes.groupBy("user_id", "article_id").agg(F.max_by(F.struct("n", "kind"), "run").alias("x"))
    return last.select("user_id", "article_id", F.when(F.col("x.n") % 2 == 1, F.col("x.kind")).alias("thumb"))


@query("x29_thumbs", with_tables("history", also=TAPS) + "SELECT user_id, article_id, nullif(arg_max(coalesce(thumb, ''), r), '') AS thumb FROM fold GROUP BY ALL")
def x29(spark, d):
    return thumbs(history(spark, d).filter("kind in ('up', 'down')").select("user_id", "article_id", "kind", "ts", "event_id"))
