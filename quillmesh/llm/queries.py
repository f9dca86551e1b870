"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import quality, toxicity
from .bpe_tokens import encode_decode, rank_file
from .common import Query, setup, table
from .decontaminate import contained_items
from .exact_dedup import exact_dedup
from .html_text import page_texts
from .minimax_shards import minimax_shards
from .periodic_runs import longest_run, periodic_runs, with_planted_run
from .sstable import token_shards
from .substring_dedup import substring_dedup
from .suffix_dedup import suffix_dedup
from .tensor_minhash import minhash_dedup
from .vector_codes import codebooks_sha256, hex_codes, vector_codes, with_label_errors


def op1_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    setup(spark)
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        tokenizer = spark.sparkContext.broadcast(f.read())
    return token_shards(table(spark, sf_dir, "documents"), tokenizer, end_id=2, width=2, drops_blanks=True).drop("file")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    setup(spark)
    return page_texts(table(spark, sf_dir, "pages"))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    setup(spark)
    return minhash_dedup(table(spark, sf_dir, "documents"), words=3, percent=85)


def held_out(doc_id: Column) -> Column:
    """The rows whose labels no training sees."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    setup(spark)
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"), held_out=held_out)
    return quality.scored(docs, model).withColumn("held_out", held_out(F.col("doc_id")))


def op5_bpe_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    setup(spark)
    ranks = rank_file(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return encode_decode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, with_ids=False)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    setup(spark)
    found = exact_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest_")).alias("text_sha256"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    setup(spark)
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), held_out=held_out)
    found = toxicity.scored(docs, model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= toxicity.REJECT).cast("int").alias("predicted"))


def op8_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    setup(spark)
    placed = minimax_shards(table(spark, sf_dir, "documents"), shards=8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    setup(spark)
    return suffix_dedup(table(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    setup(spark)
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    setup(spark)
    return longest_run(periodic_runs(table(spark, sf_dir, "documents"), change=with_planted_run, with_text=False))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    setup(spark)
    coded, codebooks = vector_codes(table(spark, sf_dir, "embeddings"))
    found = with_label_errors(coded)
    return found.select("vec_id", hex_codes(F.col("code")).alias("code"), "error", "label_error", F.lit(codebooks_sha256(codebooks)).alias("codebooks_sha256"))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    setup(spark)
    found = substring_dedup(table(spark, sf_dir, "documents"), with_text=False)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_words", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_sstable, op2_html_text, op3_minhash, op4_quality, op5_bpe_tokens, op6_exact_dedup, op7_toxicity, op8_minimax_shards, op9_suffix_dedup, op10_decontaminate, op11_periodic_runs, op12_vector_codes, op13_substring_dedup)}

ORACLE_SQL = {
    "op6_exact_dedup": """
        WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY norm)""",
    "op10_decontaminate": r"""
        WITH words AS (
          SELECT 'd' AS side, doc_id AS id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
          UNION ALL
          SELECT 'i', item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') FROM benchmark),
        items AS (
          SELECT id AS item_id, k, unnest(list_distinct(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' ')))) AS s
          FROM (SELECT id, w, least(5, len(w)) AS k FROM words WHERE side = 'i' AND len(w) > 0)),
        docs AS (
          SELECT id AS doc_id, k, unnest(list_distinct(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' ')))) AS s
          FROM words, (SELECT DISTINCT k FROM items) WHERE side = 'd' AND len(w) >= k),
        sizes AS (SELECT item_id, count(*) AS n_item FROM items GROUP BY item_id)
        SELECT doc_id, item_id, n_item, count(*) AS n_shared, count(*) / n_item AS containment
        FROM docs JOIN items USING (k, s) JOIN sizes USING (item_id)
        GROUP BY doc_id, item_id, n_item HAVING 100 * count(*) >= 80 * n_item""",
    "op3_minhash": r"""
        WITH RECURSIVE words AS (
          SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        sets AS (
          SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(2, len(w) - 1)), lambda i: array_to_string(w[i:i + 2], ' '))) END AS s FROM words),
        shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
        links AS (
          SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id <> b.doc_id
          GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))),
        reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
        SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id, least(doc_id, coalesce(m, doc_id)) = doc_id AS kept
        FROM sets LEFT JOIN (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a) USING (doc_id)""",
}
