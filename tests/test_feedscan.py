"""Feeds as a data source: missing, broken, large and unreadable ones give states, in order."""

import os

from quillmesh.session import ship
from quillmesh.sources import feeds, feedscan


def test_every_feed_gives_a_row(spark, tmp_path):
    ship(spark)
    (tmp_path / "parts").mkdir()
    for name, text in (("parts/part-1", "<rss><item><title>a</title>"), ("parts/part-2", "<link>x</link></item></rss>"), ("parts/_SUCCESS", "no"), ("one", "<feed><entry><title>é</title></entry></feed>"), ("empty", "<rss></rss>"), ("text", "no feed"), ("large", "<rss>" + "x" * 4000 + "</rss>")):
        (tmp_path / name).write_text(text, encoding="utf-8")
    (tmp_path / "bytes").write_bytes(b"<rss>\xff<item><title>b</title></item></rss>")
    (tmp_path / "hollow").mkdir()
    os.symlink(tmp_path / "nowhere", tmp_path / "broken")
    names = ["large", "parts", "missing", "one", "empty", "text", "broken", "hollow", "bytes", "one"]
    got = feedscan.fetch_all(spark, f"file://{tmp_path}", names, max_bytes=1000, retries=1)
    rows = got.collect()
    assert [r.feed for r in rows] == names and [r.place for r in rows] == list(range(10))
    assert {r.feed: (r.state, r.attempts) for r in rows} == {"large": ("http_error", 2), "parts": (None, 1), "missing": ("http_error", 2), "one": (None, 1), "empty": (None, 1), "text": (None, 1), "broken": ("http_error", 2), "hollow": ("http_error", 2), "bytes": (None, 1)}
    assert got.rdd.getNumPartitions() >= 1 and rows[1].body == "<rss><item><title>a</title><link>x</link></item></rss>"
    one = got.dropDuplicates(["feed"])
    parsed = feeds.repaired(one.filter("body is not null").select("feed", "body")).withColumn("kind", feeds.kind(feeds.F.col("body")))
    states = feedscan.feed_states(one.join(parsed.select("feed", "kind"), "feed", "left"), feeds.items(parsed.select("feed", "body")))
    assert {r.feed: (r.state, r.n_items) for r in states.collect()} == {"large": ("http_error", 0), "parts": ("ok", 1), "missing": ("http_error", 0), "one": ("ok", 1), "empty": ("empty", 0), "text": ("parse_error", 0), "broken": ("http_error", 0), "hollow": ("http_error", 0), "bytes": ("ok", 1)}
    assert feedscan.fetch_all(spark, f"file://{tmp_path}", ["one"], timeout=-1).first().state == "timeout"
    assert feedscan.fetch_all(spark, str(tmp_path), []).count() == 0


def test_many_feeds_share_tasks_and_are_read_once(spark, tmp_path):
    """5,000 feeds take some 200 tasks and no sort, in their order; a few have one each."""
    ship(spark)
    for i in range(0, 5000, 50):
        (tmp_path / f"f{i}").write_text(f"<rss>{i}</rss>")
    names = [f"f{i}" for i in range(5000)]
    got = feedscan.fetch_all(spark, str(tmp_path), names, retries=0)
    assert got.rdd.getNumPartitions() == feedscan.TASKS and "Sort" not in got._jdf.queryExecution().executedPlan().toString()
    rows = got.collect()
    assert [(r.place, r.feed) for r in rows] == list(enumerate(names))
    assert all(r.body == f"<rss>{r.place}</rss>" if r.place % 50 == 0 else r.state == "http_error" for r in rows)
    assert feedscan.fetch_all(spark, str(tmp_path), names[:30]).rdd.getNumPartitions() == 30
