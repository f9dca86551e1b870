"""Rule tables kept as JSON files, read under a schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOPIC_TABLE = "topics array<struct<id: string, keywords: array<string>>>"


def load_rules(spark: SparkSession, path: str, schema: str = TOPIC_TABLE) -> DataFrame:
    """One row an entry of the table: the fields of the schema's one array.

    A file that is not such a JSON document raises when it is read; so does an entry
    without an id.
    """
    found = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    column = found.columns[0]
    rows = found.select(F.explode(column).alias("r")).select("r.*")
    return rows.withColumn("id", F.when(F.col("id").isNull(), F.raise_error(F.lit("an entry has no id"))).otherwise(F.col("id")))


#: Parts of the rules that benchmark passages give: a part's term is so many words from that place on.
PARTS = {"keyword": (1, 3), "strong": (4, 2), "weak": (6, 1), "negative": (7, 1), "named": (8, 1), "context": (9, 1), "state": (10, 1), "occasion": (11, 1)}


def passage_rules(spark: SparkSession, sf_dir: str, parts: dict[str, tuple[int, int]] = PARTS) -> DataFrame:
    """rule, part, term: a table of rules that grows with the benchmark, five rules of many terms each."""
    w = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.concat(F.lit("t"), (F.col("item_id") % 5).cast("string")).alias("rule"), F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}]+)")).alias("w"))
    rows = F.array(*(F.struct(F.lit(part).alias("part"), F.array_join(F.slice("w", at, n), " ").alias("term")) for part, (at, n) in parts.items()))
    return w.select("rule", F.explode(rows).alias("r")).select("rule", "r.part", "r.term").filter("term != ''").distinct()


def passage_rules_sql(parts: dict[str, tuple[int, int]] = PARTS) -> str:
    some = ", ".join(f"{{'part': '{part}', 'term': array_to_string(w[{at}:{at + n - 1}], ' ')}}" for part, (at, n) in parts.items())
    return rf"""passages AS (SELECT 't' || (item_id % 5) AS rule, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM benchmark),
  rules AS (SELECT DISTINCT rule, r.part AS part, r.term AS term FROM (SELECT rule, unnest([{some}]) AS r FROM passages) WHERE r.term <> ''),
  hays AS (SELECT doc_id AS id, source, ' ' || array_to_string(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+'), ' ') || ' ' AS hay FROM documents),
  parts AS (SELECT id, rule, list(DISTINCT part) AS parts FROM hays JOIN rules ON contains(hay, ' ' || term || ' ') GROUP BY id, rule)"""
