"""Quotes and the one post that they come from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .items import first_by
from .terms import found_labels

#: Quotes of one automaton, some 10 KB each; beyond MOST of them texts and quotes meet by a join.
SLICE, MOST = 5_000, 50_000
WINDOW_S, LEAST_WORDS = 72 * 3600, 6


def split(x: Column) -> Column:
    return F.split(x, " ")


def contained(quotes: DataFrame, quote_id: str, texts: DataFrame, text_id: str) -> DataFrame:
    """(text_id, quote_id) wherever a text t contains a quote q, as a substring.

    A quote's first and last word may stand within longer words, so quotes of six words
    or more meet texts by their words 2 to 5, and shorter ones are held against all texts.
    """
    quotes, texts = quotes.select(quote_id, "q"), texts.select(text_id, "t")
    long = quotes.filter(F.size(split(F.col("q"))) >= 6).withColumn("k", F.array_join(F.slice(split(F.col("q")), 2, 4), " "))
    w = split(F.col("t"))
    runs = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w) - 3)), lambda i: F.array_join(F.slice(w, i, 4), " ")))
    met = texts.select(text_id, F.explode(runs).alias("k")).join(long, "k").select(text_id, quote_id, "q").distinct()
    by_key = met.join(texts, text_id).filter(F.col("t").contains(F.col("q"))).select(text_id, quote_id)
    short = quotes.filter(F.size(split(F.col("q"))) < 6)
    return by_key.unionByName(texts.join(F.broadcast(short), F.col("t").contains(F.col("q"))).select(text_id, quote_id))


def quoted(quotes: DataFrame, quote_id: str, texts: DataFrame, text_id: str, most: int = MOST) -> DataFrame:
    """As `contained`, for quotes that are few beside the texts: one scan of a text finds all that it holds."""
    quotes = quotes.filter("q is not null")
    if quotes.count() > most:
        return contained(quotes, quote_id, texts, text_id)
    kind = quotes.schema[quote_id].dataType.simpleString()
    terms = quotes.select(F.col(quote_id).cast("string").alias("label"), F.lit("").alias("kind"), F.col("q").alias("term"))
    met = found_labels(texts, terms, id_col=text_id, text_col="t", slice_=SLICE, whole=False, cased=True, fold=lambda text: text or "")
    met = met.select(F.col("id").alias(text_id), F.col("label").cast(kind).alias(quote_id))
    return met.unionByName(texts.filter("t is not null").select(text_id).join(F.broadcast(quotes.filter("q = ''").select(quote_id))))


def fold(x: Column) -> Column:
    """Case, curly apostrophes and punctuation folded away, blanks collapsed."""
    return F.trim(F.regexp_replace(F.lower(F.translate(x, "’‘", "''")), r"[^\p{L}\p{N}_']+", " "))


def word_count(x: Column) -> Column:
    return F.regexp_count(x, F.lit(r"[\p{L}\p{N}]+(?:'[\p{L}\p{N}]+)*"))


def sources_of(versions: DataFrame, posts: DataFrame) -> DataFrame:
    """(id, url) of versions (id, published_s, text) and the post (url, published_s, text) that each quotes.

    Of a version that names the network, the first quoted span of six words or more that
    exactly one post holds, of those up to 72 hours before it; reposts and short posts
    are left out. Without both times nothing is eligible.
    """
    v = versions.filter(F.col("text").rlike("(?i)truth social"))
    spans = F.transform(F.regexp_extract_all("text", F.lit('("[^"]+"|“[^”]+”)')), lambda s: fold(F.substring(s, F.lit(2), F.length(s) - 2)))
    s = v.select("id", F.col("published_s").alias("at_s"), F.posexplode(spans).alias("place", "q")).filter(word_count(F.col("q")) >= LEAST_WORDS)
    s = s.withColumn("span", F.struct("id", "place"))
    p = posts.filter(~F.col("text").rlike(r"(?i)^\s*RT\b")).select("url", "published_s", fold(F.col("text")).alias("t")).filter(word_count(F.col("t")) >= LEAST_WORDS)
    p = p.withColumn("post", F.struct("url", "published_s", "t"))
    met = contained(s, "span", p, "post").select("span", F.col("post.url").alias("url"), F.col("post.published_s").alias("post_s"))
    met = met.join(s.select("span", "at_s"), "span").filter((F.col("at_s") >= F.col("post_s")) & (F.col("at_s") - F.col("post_s") <= WINDOW_S))
    one = met.groupBy("span").agg(F.countDistinct("url").alias("n"), F.min("url").alias("url")).filter("n = 1")
    return first_by(one.select("span.id", "span.place", "url"), ["id"], F.col("place")).select("id", "url")
