"""Stories on their way to a page: twins removed, members split off, other sides attached."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scale import materialize, remove, scratch

DEDUP_MIN_CHARS = 20
SPLIT_BELOW = 0.3
OTHER_SIDE_OUTLETS, OTHER_SIDE_LEANS, OTHER_SIDE_SAME = 3, 2, 0.6
# The leans in the order of the spectrum.
SPECTRUM = ["left", "center-left", "center", "center-right", "right"]


def title_form(title: Column) -> Column:
    """A headline by its letters and digits alone."""
    return F.trim(F.regexp_replace(F.lower(title), r"[^\p{L}\p{N}]+", " "))


def without_twins(stories: DataFrame, min_chars: int = DEDUP_MIN_CHARS) -> DataFrame:
    """(id, twin): every story, with the story it is a twin of, or null where it stays.

    stories: id, rank (an orderable column, no two alike: fuller stories rank lower),
    titles. In the order of rank a story is a twin if one that stays before it has one of
    its headlines; what is removed owns no headlines. That order is kept without walking
    it: in a round every story that ranks first for all of its headlines stays, what
    shares one with it goes, and the rest meets again. A twin names the owner of the
    first of its headlines that has one. Headlines under `min_chars` and null ones do not count.
    """
    spark = stories.sparkSession
    paths: list[str] = []

    def kept(df: DataFrame, tag: str) -> DataFrame:
        paths.append(scratch(spark, tag))
        return materialize(df, paths[-1])

    forms = F.array_distinct(F.filter(F.transform(F.coalesce("titles", F.array().cast("array<string>")), title_form), lambda t: t.isNotNull() & (F.length(t) >= min_chars)))
    every = kept(stories.select("id", "rank", F.posexplode(forms).alias("at", "title")), "titles")
    open_, owners = every.select("id", "rank", "title"), []
    while True:
        least = open_.groupBy("title").agg(F.min("rank").alias("least"))
        met = kept(open_.join(least, "title").select("id", "rank", "title", (F.col("rank") == F.col("least")).alias("first")), "met")
        wins = met.groupBy("id").agg(F.min("first").alias("wins")).filter("wins").select("id")
        owned = kept(met.join(wins, "id", "left_semi").select("title", F.col("id").alias("owner"), F.col("rank").alias("owner_rank")), "owned")
        if owned.isEmpty():
            break
        owners.append(owned)
        gone = met.join(owned.select("title"), "title", "left_semi").select("id").distinct()  # those that stay, and their twins
        open_ = kept(met.join(gone, "id", "left_anti").select("id", "rank", "title"), "open")
        if open_.isEmpty():
            break
    if not owners:
        out = stories.select("id", F.lit(None).cast(stories.schema["id"].dataType).alias("twin"))
    else:
        all_ = owners[0]
        for more in owners[1:]:
            all_ = all_.union(more)
        twins = every.join(all_, "title").filter("owner_rank < rank").groupBy("id").agg(F.min_by("owner", "at").alias("twin"))
        out = stories.select("id").join(twins, "id", "left")
    path = scratch(spark, "twins")
    out = materialize(out, path)
    remove(spark, *paths)
    return out


def split_stories(members: DataFrame, anchors: DataFrame, answers: DataFrame, outlets: DataFrame, live: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, stories) after the members that a model reads as another event are split off.

    members: cluster_id, id, unit_id (near copies share one), source_id, embedded
    (boolean); anchors: cluster_id, anchor; answers: anchor, id, same (double), framing;
    outlets: source_id, syndication_group, lean; live: cluster_id of stories that a live
    event holds.

    A member whose `same` is under SPLIT_BELOW leaves. A story left with one member
    dissolves, but for a live one, which then stays whole. members out: cluster_id, id,
    fate ("kept", "split" or "dissolved"), same, framing, of kept members that have been
    answered. stories out, of two members and more: cluster_id, n, units, copies (units
    of several members), independent, leans, method. The anchor is never split off.
    """
    said = answers.groupBy("anchor", "id").agg(F.first("same").alias("same"), F.first("framing").alias("framing"))
    rows = members.join(anchors, "cluster_id", "left").join(said, ["anchor", "id"], "left").join(live.select("cluster_id", F.lit(True).alias("live")).distinct(), "cluster_id", "left")
    off = (F.col("id") != F.col("anchor")) & (F.col("same") < SPLIT_BELOW)
    rows = rows.withColumn("off", F.coalesce(off, F.lit(False)))
    left = rows.groupBy("cluster_id").agg(F.count_if(~F.col("off")).alias("left_"), F.max("off").alias("any_off"))
    rows = rows.join(left, "cluster_id").withColumn("whole", F.coalesce("live", F.lit(False)) & F.col("any_off") & (F.col("left_") < 2))
    fate = F.when(F.col("off") & ~F.col("whole"), "split").when((F.col("left_") < 2) & ~F.col("whole"), "dissolved").otherwise("kept")
    rows = rows.withColumn("fate", fate)
    noted = (F.col("fate") == "kept") & (F.col("id") != F.col("anchor"))
    placed = rows.select("cluster_id", "id", "fate", F.when(noted, F.col("same")).alias("same"), F.when(noted, F.col("framing")).alias("framing"))
    kept = rows.filter("fate = 'kept'")
    units = kept.groupBy("cluster_id", "unit_id").agg(F.count(F.lit(1)).alias("n"), F.max("embedded").alias("embedded"))
    shape = units.groupBy("cluster_id").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("units"), F.count_if(F.col("n") > 1).alias("copies"), F.count_if("embedded").alias("embedded"))
    told = kept.join(outlets.select("source_id", "syndication_group", "lean"), "source_id", "left").groupBy("cluster_id").agg(F.countDistinct(F.coalesce("syndication_group", "source_id")).alias("independent"), F.array_sort(F.collect_set("lean")).alias("leans"))
    base = F.when((F.col("units") > 1) & (F.col("copies") > 0), "minhash+cosine_entity").when(F.col("units") > 1, "cosine_entity").otherwise("minhash")
    method = F.when((F.col("embedded") > 1) & (F.col("units") > 1), F.concat(base, F.lit("+embedding"))).otherwise(base)
    return placed, shape.join(told, "cluster_id").select("cluster_id", "n", "units", "copies", "independent", "leans", method.alias("method"))


def other_side(cards: DataFrame, versions: DataFrame, muted: DataFrame | None = None, window: int = 10, per_page: int = 1) -> DataFrame:
    """(list_id, story_id, other, lean): the other side of the first `per_page` cards of a list that have one.

    cards: list_id, place (from 1), story_id, article_id (the card's own), lean,
    independent, leans. versions: story_id, article_id, source_id, lean, score, base,
    published_s, same, framing. muted: list_id, source_id. A card of three outlets and two
    leans and more gets the version from the lean that is rarest among the page's first
    `window` cards, other than its own; of equally rare ones the furthest across the
    spectrum, then by name. Versions read as another event are left out after the lean is
    chosen; those that frame the story differently come first, then the best score.
    """
    mix = cards.filter((F.col("place") <= window) & F.col("lean").isNotNull()).groupBy("list_id", F.col("lean").alias("side")).agg(F.count(F.lit(1)).alias("shown"))
    at = lambda c: F.array_position(F.array(*map(F.lit, SPECTRUM)), c)
    able = cards.filter((F.col("independent") >= OTHER_SIDE_OUTLETS) & (F.size("leans") >= OTHER_SIDE_LEANS)).select("list_id", "place", "story_id", F.col("article_id").alias("own"), F.col("lean").alias("own_lean"))
    met = able.join(versions.filter("lean is not null").withColumnRenamed("lean", "side"), "story_id").filter((F.col("article_id") != F.col("own")) & ~F.col("side").eqNullSafe(F.col("own_lean")))
    if muted is not None:
        met = met.join(muted, ["list_id", "source_id"], "left_anti")
    met = met.join(mix, ["list_id", "side"], "left").withColumn("shown", F.coalesce("shown", F.lit(0)))
    placed = (at(F.col("side")) > 0) & (at(F.col("own_lean")) > 0)
    met = met.withColumn("far", F.when(placed, F.abs(at(F.col("side")) - at(F.col("own_lean")))).otherwise(0))
    met = met.withColumn("chosen", F.min(F.struct("shown", (-F.col("far")).alias("far"), "side")).over(Window.partitionBy("list_id", "story_id")))
    met = met.filter((F.col("chosen.side") == F.col("side")) & ~F.coalesce(F.col("same") < OTHER_SIDE_SAME, F.lit(False)) & ~F.coalesce(F.col("framing") == "different", F.lit(False)))
    framed = F.when(F.col("framing").isin("emphasis", "adds"), 0).otherwise(1)
    best = met.groupBy("list_id", "place", "story_id").agg(F.min_by(F.struct("article_id", "side"), F.struct(framed.alias("f"), (-F.col("score")).alias("s"), (-F.col("base")).alias("b"), (-F.col("published_s")).alias("p"), "article_id")).alias("pick"))
    first = F.row_number().over(Window.partitionBy("list_id").orderBy("place", "story_id"))
    return best.withColumn("k", first).filter(F.col("k") <= per_page).select("list_id", "story_id", F.col("pick.article_id").alias("other"), F.col("pick.side").alias("lean"))
