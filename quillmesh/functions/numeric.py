"""Numeric functions on columns: vectors, decay, integer scores, answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCALE = 1_000_000


def micro(x: Column) -> Column:
    """integer micro-points, halves up."""
    return F.floor(x * SCALE + 0.5).cast("long")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """of dense vectors."""
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def embed_term(cos: Column, floor: float = 0.775, weight: float = 0.2) -> Column:
    """what a vector pair adds to a link."""
    return weight * F.greatest(F.lit(0.0), F.least(F.lit(1.0), (cos - floor) / (1 - floor)))


def decay(seconds: Column, hours: float = 24) -> Column:
    """exp(-t / hours)."""
    return F.exp(-F.abs(seconds) / (hours * 3600))


def recency_points(age_hours: Column) -> Column:
    """20 points halved every 12 hours, halves to even."""
    return F.bround(20 * F.pow(F.lit(2.0), -age_hours / 12), 0).cast("long")


def micro_recency(age_hours: Column, half_life: Column) -> Column:
    return micro(F.pow(F.lit(2.0), -age_hours / half_life))


def quantized(v: Column) -> Column:
    """signed bytes against the vector's peak, halves to even."""
    peak = F.array_max(F.transform(v, lambda x: F.abs(x.cast("double"))))
    return F.transform(v, lambda x: F.when(peak > 0, F.bround(x.cast("double") * 127 / peak, 0)).otherwise(0).cast("int"))


def token_estimate(x: Column) -> Column:
    """a token for each three bytes, and two."""
    return (F.ceil(F.octet_length(x) / 3) + 2).cast("long")


def choice_band(p: Column, second: Column) -> Column:
    """how sure an answer is, from its best and second probabilities."""
    return F.when(p.isNull(), "none").when((p >= 0.6) & (p - second >= 0.15), "sure").when((p >= 0.4) & (p - second >= 0.15), "leaning").otherwise("split")


def likely_band(p: Column) -> Column:
    return F.when(p >= 0.7, "likely").when(p >= 0.4, "possible").otherwise("low")


def iso_week(ts: Column) -> Column:
    """2026W39."""
    return F.concat(F.extract(F.lit("YEAROFWEEK"), ts).cast("string"), F.lit("W"), F.lpad(F.weekofyear(ts).cast("string"), 2, "0"))


def positive_int(x: Column) -> Column:
    """the number that a string of up to nine digits stands for, if it is above zero."""
    return F.when(x.rlike(r"^\s*\d{1,9}\s*$") & (F.trim(x).try_cast("int") > 0), F.trim(x).try_cast("int"))
