"""Quotes against plain versions."""

from quillmesh.operators.quotes import sources_of
from quillmesh.plans import registry

HOUR = 3600


def test_short_items_are_found(spark, tmp_path):
    docs = [(1, "we saw a red fox jump over it"), (2, "no Red foxes here at all"), (3, "so the quick brown fox jumps overhead today"), (4, "fox")]
    items = [(1, "red fox"), (2, "the quick brown fox jumps"), (3, "e quick brown fox jumps over"), (4, "fox"), (5, "quick brown fox jumps over")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted(tuple(r) for r in registry.QUERIES["j06_quote_archive"](spark, str(tmp_path)).select("doc_id", "item_id").collect())
    assert got == sorted((i, j) for i, t in docs for j, q in items if q.lower() in t.lower())


def test_one_post_within_the_interval(spark):
    said = "We will never ever give up, it’s done"
    at = 1_000 * HOUR
    posts = [("a", at, f"Today: {said}!"), ("old", at - 80 * HOUR, f"Then {said}"), ("rt", at, f" RT {said}"), ("none", None, said), ("b", at, "one two three four five six seven"), ("c", at, "zero one two three four five six")]
    quote = "Truth Social: “we will NEVER, ever give up - it's done”"
    versions = [
        (1, at + HOUR, quote),
        (2, at - HOUR, quote),
        (3, at + 72 * HOUR, quote),
        (4, at + 72 * HOUR + 1, quote),
        (5, at + HOUR, quote.replace("Truth Social", "Elsewhere")),
        (6, at + HOUR, 'truth social "one two three four five six" "three four five six seven"'),
        (7, at + HOUR, 'truth social "one two three four five six" "two three four five six seven"'),
        (8, None, quote),
    ]
    got = sources_of(spark.createDataFrame(versions, "id long, published_s long, text string"), spark.createDataFrame(posts, "url string, published_s long, text string"))
    # 2: `old` is 79 hours before it. 6: the first span stands in two posts, the second is too short.
    assert sorted(tuple(r) for r in got.collect()) == [(1, "a"), (3, "a"), (7, "b")]


def test_texts_are_scanned_for_quotes_and_not_cut_into_runs(spark, tmp_path):
    """No row is made for each run of a text's words; nulls, empty quotes, case and two quotes of the same words count as in the SQL."""
    docs = [(1, "A Red FOX jumps. " + "word " * 2000), (2, None), (3, ""), (4, "éa red foxes")]
    items = [(1, "red fox"), (2, "RED FOX"), (3, None), (4, "ÉA"), (5, ""), (6, "word " * 1999)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    df = registry.QUERIES["j06_quote_archive"](spark, str(tmp_path))
    want = sorted((i, j) for i, t in docs for j, q in items if t is not None and q is not None and q.lower() in t.lower())
    assert sorted((r.doc_id, r.item_id) for r in df.collect()) == want and (3, 5) in want
    assert "Generate" not in df._jdf.queryExecution().executedPlan().toString()
