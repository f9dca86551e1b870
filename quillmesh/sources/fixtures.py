"""Items, sources, stories and reader history, derived from the tables at hand.

Every function takes (spark, sf_dir). The same derivations stand in SQL in `CTES`, for the
checks: `with_tables("articles", "sources")` gives the WITH clause of those and all
they need. All offsets are deterministic functions of the keys.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The first item's time, and the clock of all runs: three days later.
BASE_S = 1_767_225_600
NOW_S = BASE_S + 259_200
#: Tag keywords, our own small table: words of the texts that stand for a topic.
TOPICS = {"politics": ["from", "pour"], "economy": ["with", "sur"], "science": ["nicht", "dans"], "conflict": ["avec", "los"], "culture": ["that", "una"]}
HARD_NEWS = ["conflict", "economy", "politics", "science", "world"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, source_id, url, title, dek, published_s, published_at, lang, n_chars, topics.

    Title and dek are the first words of the text, however much white space it starts with; topics are read from all of it.
    """
    flat = lambda x: F.trim(F.regexp_replace(x, r"[ \t\n\r\f]+", " "))
    d = read(spark, sf_dir, "documents")
    head = F.regexp_extract("text", r"^[ \t\n\r\f]*((?:[^ \t\n\r\f]+[ \t\n\r\f]+){0,62})([^ \t\n\r\f]*)", 0)  # 62 words and more, and no look at the rest
    d = d.withColumn("w", F.split(flat(head), " ", 63)).withColumn("tagged", F.concat(F.lit(" "), flat(F.col("text")), F.lit(" ")))
    title, dek = F.array_join(F.slice("w", 1, 12), " "), F.array_join(F.slice("w", 13, 50), " ")
    tags = [F.when(reduce(or_, (F.col("tagged").contains(f" {k} ") for k in ks)), F.lit(t)) for t, ks in TOPICS.items()]
    at = F.lit(BASE_S) + (F.col("doc_id") * 7919) % 259_200
    return d.select(
        F.col("doc_id").alias("id"),
        F.col("source").alias("source_id"),
        F.concat(F.lit("https://"), "source", F.lit(".example/"), F.col("doc_id").cast("string")).alias("url"),
        title.alias("title"),
        dek.alias("dek"),
        at.alias("published_s"),
        F.timestamp_seconds(at).alias("published_at"),
        "lang",
        "n_chars",
        F.array_sort(F.array_compact(F.array(*tags))).alias("topics"),
    )


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_id, k, country, bucket, lean, syndication_group, paywall: one row an outlet."""
    nation, region = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    s = read(spark, sf_dir, "documents").select(F.col("source").alias("source_id")).distinct().withColumn("k", F.substring("source_id", 4, 9).cast("int"))
    lean = F.when(F.col("k") % 7 < 2, "left").when(F.col("k") % 7 < 4, "center").when(F.col("k") % 7 < 6, "right")
    group = F.when(F.col("k") % 5 == 0, F.concat(F.lit("wire"), F.floor(F.col("k") / 10).cast("string"))).otherwise(F.col("source_id"))
    return (
        s.join(F.broadcast(nation), F.col("k") % 25 == F.col("n_nationkey"))
        .join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("source_id", "k", F.col("n_name").alias("country"), F.col("r_name").alias("bucket"), lean.alias("lean"), group.alias("syndication_group"), (F.col("k") % 4 == 0).alias("paywall"))
    )


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cluster_id, article_id, unit_id: stories of items, near-duplicate units within them."""
    i = F.col("doc_id")
    return read(spark, sf_dir, "documents").select(((i * 31) % 257).alias("cluster_id"), i.alias("article_id"), ((i * 31) % 257 * 4 + i % 2).alias("unit_id"))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, user_id, kind, article_id, ts: what readers saw, opened, liked and saved."""
    kind = F.create_map(*[F.lit(x) for pair in (("view", "shown"), ("click", "opened"), ("purchase", "up"), ("error", "down"), ("signup", "save")) for x in pair])
    return read(spark, sf_dir, "events").select("event_id", "user_id", kind[F.col("event_type")].alias("kind"), (F.col("event_id") * 13 % 1000).alias("article_id"), "ts", "value")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_id, run, state, items: the outcome of each hourly read of a source."""
    e = read(spark, sf_dir, "events")
    state = F.when(F.col("event_type") == "error", "error").when(F.col("value") < 20, "empty").otherwise("ok")
    return e.select(F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string")).alias("source_id"), F.col("event_id").alias("run"), state.alias("state"), F.when(state == "ok", F.floor("value").cast("long")).otherwise(F.lit(0)).alias("items"))


_words = lambda x: f"list_filter(string_split(regexp_replace({x}, '[ \\t\\n\\r\\f]+', ' ', 'g'), ' '), lambda w: w <> '')"
_tags = ", ".join(f"CASE WHEN list_has_any(w, [{', '.join(repr(k) for k in ks)}]) THEN '{t}' END" for t, ks in TOPICS.items())
CTES = {
    "articles": f"""articles AS (SELECT doc_id AS id, source AS source_id, 'https://' || source || '.example/' || doc_id AS url,
        array_to_string(w[1:12], ' ') AS title, array_to_string(w[13:62], ' ') AS dek, {BASE_S} + (doc_id * 7919) % 259200 AS published_s,
        make_timestamp(({BASE_S} + (doc_id * 7919) % 259200) * 1000000) AS published_at, lang, n_chars,
        list_sort(list_filter([{_tags}], lambda t: t IS NOT NULL)) AS topics
        FROM (SELECT *, {_words("text")} AS w FROM documents))""",
    "sources": """sources AS (SELECT source_id, k, n_name AS country, r_name AS bucket,
        CASE WHEN k % 7 < 2 THEN 'left' WHEN k % 7 < 4 THEN 'center' WHEN k % 7 < 6 THEN 'right' END AS lean,
        CASE WHEN k % 5 = 0 THEN 'wire' || (k // 10) ELSE source_id END AS syndication_group, k % 4 = 0 AS paywall
        FROM (SELECT DISTINCT source AS source_id, CAST(substr(source, 4) AS INT) AS k FROM documents)
        JOIN nation ON k % 25 = n_nationkey JOIN region ON n_regionkey = r_regionkey)""",
    "members": "members AS (SELECT (doc_id * 31) % 257 AS cluster_id, doc_id AS article_id, (doc_id * 31) % 257 * 4 + doc_id % 2 AS unit_id FROM documents)",
    "history": """history AS (SELECT event_id, user_id, CASE event_type WHEN 'view' THEN 'shown' WHEN 'click' THEN 'opened' WHEN 'purchase' THEN 'up' WHEN 'error' THEN 'down' WHEN 'signup' THEN 'save' END AS kind,
        event_id * 13 % 1000 AS article_id, ts, value FROM events)""",
    "runs": """runs AS (SELECT 'src' || (user_id % 20) AS source_id, event_id AS run, CASE WHEN event_type = 'error' THEN 'error' WHEN value < 20 THEN 'empty' ELSE 'ok' END AS state,
        CASE WHEN event_type <> 'error' AND value >= 20 THEN CAST(floor(value) AS BIGINT) ELSE 0 END AS items FROM events)""",
}


def with_tables(*names: str, also: str = "") -> str:
    """A WITH clause of the named derived tables, and of `also`."""
    parts = [CTES[n] for n in names] + ([also] if also else [])
    recursive = "RECURSIVE " if re.search(r"\bUNION\b", also) else ""
    return f"WITH {recursive}" + ",\n".join(parts) + "\n"
