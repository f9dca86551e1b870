"""Takeaways and points of whole documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmesh.operators import reading as R
from quillmesh.sources.fixtures import read

from .base import query

STATUS = ["sure", "lean", "split", "none given"]


def answered(spark, d):
    """(docs, named, points): documents' sentences, and answers that their lengths give."""
    docs = read(spark, d, "documents").filter("doc_id is not null").select(F.col("doc_id").alias("id"), R.placed_sentences(R.paragraphs(F.col("text"))).alias("place"), F.length("text").alias("n"))
    status = lambda x: F.element_at(F.array(*map(F.lit, STATUS)), (x % len(STATUS) + 1).cast("int"))
    size = F.size("place")
    named = docs.filter(size > 1).select("id", "n", size.alias("size"), F.explode(F.sequence(F.lit(0), F.lit(R.TAKEAWAYS - 1))).alias("key"))
    named = named.select("id", "key", ((F.col("n") * (F.col("key") + 3)) % F.col("size")).alias("pick"), status(F.col("n") + F.col("key")).alias("status"))
    sections = docs.filter(size > 1).withColumn("key", F.explode(F.sequence(F.lit(0), F.floor(F.array_max("place") / R.SECTION).cast("int"))))
    own = F.filter(F.sequence(F.lit(0), size - 1), lambda i: F.floor(F.get("place", i) / R.SECTION) == F.col("key"))
    points = sections.withColumn("own", own).select("id", "key", F.get("own", (F.col("n") + F.col("key")) % F.size("own")).alias("pick"), status(F.col("n") + 2 * F.col("key")).alias("status"))
    return docs.select("id", "place"), named, points


@query("x18_takeaways")
def x18(spark, d):
    """Ordered choices with spacing over whole documents, as folds in generated code; held against a loop in the tests."""
    return R.reading_view(*answered(spark, d))
