"""The corpus pipeline: toxic documents, copies, near copies and benchmark leaks go, the rest is encoded.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All
but the last return the columns of `documents`; each result is written as Parquet in the
shared folder and read again. Extra columns pass through, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.llm import toxicity
from quillmesh.llm.bpe_tokens import encode_decode, rank_file
from quillmesh.llm.common import free_name, materialize, scratch, setup, table
from quillmesh.llm.decontaminate import without_items
from quillmesh.llm.exact_dedup import exact_dedup
from quillmesh.llm.queries import held_out
from quillmesh.llm.tensor_minhash import minhash_dedup


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the toxicity network does not reject.

    It learns from the labelled ones among `docs`; where they do not have both labels,
    nothing is rejected. Null and empty texts are scored as empty.
    """
    setup(spark)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), held_out=held_out)
    return toxicity.without_toxic(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts (A-Z lower-cased, null as empty), that of the largest id.

    A null id ranks lowest. Of rows that repeat both id and text one stays.
    """
    setup(spark)
    repeated = not docs.groupBy("doc_id").count().filter("count > 1").isEmpty()
    kept = exact_dedup(docs, with_row=True).filter("kept")
    return (kept.dropDuplicates(["doc_id", "digest_"]) if repeated else kept).select("row.*")


def named(docs: DataFrame, name: str) -> DataFrame:
    """`docs` with a column `name` that tells its rows apart.

    It is the id, or, where the id is null or several rows have it, 2^62 and more by a
    hash of id and text, which ranks behind all ids below 2^62.
    """
    once = free_name("id_once", docs)
    own = F.lit(1 << 62).bitwiseOR(F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 2))
    repeats = materialize(docs.filter("doc_id is not null").groupBy(F.col("doc_id").alias(once)).count().filter("count > 1").select(once), scratch(docs.sparkSession, "repeats"))
    if repeats.isEmpty():
        return docs.withColumn(name, F.coalesce("doc_id", own))
    met = docs.join(repeats, F.col("doc_id") == F.col(once), "left")
    return met.withColumn(name, F.when(F.col("doc_id").isNull() | F.col(once).isNotNull(), own).otherwise(F.col("doc_id"))).drop(once)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity of 0.8 or more.

    The smallest id of a group stays; rows whose id is null or repeated rank behind the
    others. Texts without words are nobody's near copies.
    """
    setup(spark)
    name = free_name("row_name", docs)
    rows = named(docs, name)
    dropped = minhash_dedup(rows, words=5, percent=80, id_col=name).filter("not kept").select(F.col("doc_id").alias(name)).distinct()
    return rows.join(dropped, name, "left_anti").select(*(f"`{c}`" for c in docs.columns))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark item (0.8 of its five-word shingles); null and empty texts stay."""
    setup(spark)
    return without_items(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids), one row per row; null counts as empty."""
    setup(spark)
    return encode_decode(docs, rank_file(spark, public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("minhash_dedup", drop_near_copies),
    ("decontaminate", drop_leaks),
    ("bpe", encode),
]

#: SQL can express neither the network nor the merges; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), scratch(spark, f"stage-{name}"))
    return docs
