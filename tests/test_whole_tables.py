"""Feeds hold all items and combined states all runs."""

from quillmesh.plans import registry


def test_all_items_reach_the_feeds(spark, tmp_path):
    rows = [(i, f"title {i} and more", "en", f"src{i % 2}", 20) for i in range(0, 3000, 7)] + [(9001, "", "en", "src3", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.QUERIES["s09_all_feed_items"](spark, str(tmp_path)).collect()
    assert sorted((r.link, r.title) for r in got) == sorted((f"https://{s}.example/{i}", t or None) for i, t, _, s, _ in rows)
    assert {(r.source_id, r.feed) for r in got} == {(s, i // 1000) for i, _, _, s, _ in rows}


def test_the_only_ok_run_counts(spark, tmp_path):
    rows = [(k, "error", 0.0) if k != 5 else (5, "view", 60.0) for k in range(1, 15)]
    spark.createDataFrame([(k, 3, t, v) for k, t, v in rows], "event_id long, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    assert [tuple(r) for r in registry.QUERIES["x05_all_runs"](spark, str(tmp_path)).collect()] == [("src3", "ok")]
