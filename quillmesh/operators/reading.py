"""A document's sentences by paragraph, and the ones that a reading marks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.functions import text as T

TAKEAWAYS, NAMED_OPTIONS, SECTION = 5, 60, 5
ACTIONABLE = ("sure", "lean", "none given")
POINT = "array<struct<key:int,pick:int,paragraph:int>>"


def paragraphs(text: Column) -> Column:
    """Paragraphs of a text (its lines that are not blank), each as an array of sentences."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.filter(F.transform(lines, T.sentences), lambda p: F.size(p) > 0)


def placed_sentences(parts: Column) -> Column:
    """For each sentence in order, the number of its paragraph, from 0."""
    return F.flatten(F.transform(parts, lambda p, i: F.array_repeat(i, F.size(p))))


def reading_view(docs: DataFrame, named: DataFrame, points: DataFrame) -> DataFrame:
    """(id, takeaways, points): what is marked of each document, in order of its sentences.

    docs: id, place (array: the paragraph of each sentence). named: id, key (0 to
    TAKEAWAYS - 1, their priority), pick (a sentence's number), status. points: id, key (a
    section's number, SECTION paragraphs each), pick, status. One answer a key counts.

    Takeaways are taken by priority, one for three paragraphs and one in any case, of the
    first NAMED_OPTIONS sentences, none twice; only answers that are sure, leaning or
    without a confidence count. A document of several sections has a point for each
    section without a takeaway, of the section's own sentences, but none in a paragraph
    next to a marked one unless it is sure. Each is (key, pick, paragraph).
    """

    def packed(answers: DataFrame, name: str) -> DataFrame:
        one = answers.filter(F.col("status").isin(*ACTIONABLE) & F.col("pick").isNotNull()).groupBy("id", "key").agg(F.min(F.struct(F.col("pick").cast("int").alias("pick"), "status")).alias("a"))
        return one.groupBy("id").agg(F.array_sort(F.collect_list(F.struct(F.col("key").cast("int").alias("key"), "a.pick", "a.status"))).alias(name))

    rows = docs.select("id", F.transform("place", lambda x: x.cast("int")).alias("place")).join(packed(named, "named_"), "id", "left").join(packed(points, "points_"), "id", "left")
    blank = F.array().cast("array<struct<key:int,pick:int,status:string>>")
    rows = rows.select("id", "place", F.coalesce("named_", blank).alias("named_"), F.coalesce("points_", blank).alias("points_"))
    size = F.coalesce(F.array_max("place") + 1, F.lit(0))
    most = F.greatest(F.lit(1), F.least(F.lit(TAKEAWAYS), F.floor(size / 3))).cast("int")
    mark = lambda x: F.array(F.struct(x["key"].alias("key"), x["pick"].alias("pick"), F.get("place", x["pick"]).alias("paragraph")))
    fits = F.filter("named_", lambda x: x["key"].between(0, TAKEAWAYS - 1) & x["pick"].between(0, F.least(F.size("place"), F.lit(NAMED_OPTIONS)) - 1))
    taken = F.aggregate(fits, F.array().cast(POINT), lambda out, x: F.when((F.size(out) < most) & ~F.exists(out, lambda o: o["pick"] == x["pick"]), F.concat(out, mark(x))).otherwise(out))
    rows = rows.withColumn("most", most).withColumn("takeaways", taken)
    marked = F.transform("takeaways", lambda t: t["paragraph"])
    start = F.struct(marked.alias("marked"), F.array().cast(POINT).alias("out"))
    section = lambda p: F.floor(p / SECTION).cast("int")
    own = F.filter("points_", lambda x: x["pick"].between(0, F.size("place") - 1) & (section(F.get("place", x["pick"])) == x["key"]) & ~F.exists("takeaways", lambda t: section(t["paragraph"]) == x["key"]))

    def step(s: Column, x: Column) -> Column:
        at = F.get("place", x["pick"])
        crowded = F.array_contains(s["marked"], at - 1) | F.array_contains(s["marked"], at + 1)
        return F.when(crowded & (x["status"] != "sure"), s).otherwise(F.struct(F.concat(s["marked"], F.array(at)).alias("marked"), F.concat(s["out"], mark(x)).alias("out")))

    chosen = F.when(size > SECTION, F.aggregate(own, start, step)["out"]).otherwise(F.array().cast(POINT))
    order = lambda c: F.array_sort(c, lambda a, b: a["pick"] - b["pick"])
    return rows.select("id", order(F.col("takeaways")).alias("takeaways"), order(chosen).alias("points"))
