"""Readings against a loop; streams whose state ends; the live slot over runs."""

import datetime
import json
import random

from pyspark.sql import functions as F

from quillmesh.operators import reading as R
from quillmesh.plans import registry, streams
from quillmesh.plans.readings import answered
from quillmesh.streaming import state as K

DATA = "/root/testdata/sf0.001"


def plain_view(place, named, points):
    """Takeaways by priority, then points by section, one after the other."""
    size = max(place) + 1 if place else 0
    cap, taken, takeaways = max(1, min(5, size // 3)), set(), []
    for key, (pick, status) in sorted(named.items()):
        if len(takeaways) < cap and status in R.ACTIONABLE and pick is not None and 0 <= pick < min(len(place), R.NAMED_OPTIONS) and pick not in taken:
            taken.add(pick)
            takeaways.append((key, pick, place[pick]))
    marked, out = {p for *_, p in takeaways}, []
    for key, (pick, status) in sorted(points.items()) if size > R.SECTION else ():
        if any(p // R.SECTION == key for *_, p in takeaways) or status not in R.ACTIONABLE or pick is None or not 0 <= pick < len(place) or place[pick] // R.SECTION != key:
            continue
        if {place[pick] - 1, place[pick] + 1} & marked and status != "sure":
            continue
        marked.add(place[pick])
        out.append((key, pick, place[pick]))
    return sorted(takeaways, key=lambda x: x[1]), sorted(out, key=lambda x: x[1])


def view_rows(found):
    return {x.id: ([tuple(t) for t in x.takeaways], [tuple(t) for t in x.points]) for x in found.collect()}


def test_readings_equal_the_loop(spark):
    r = random.Random(40)
    docs, named, points = {}, {}, {}
    for i in range(200):
        place = [p for p in range(r.randrange(0, 25)) for _ in range(r.randrange(1, 4))]
        docs[i] = place
        named[i] = {k: (r.choice([None, r.randrange(-1, len(place) + 2)]), r.choice(["sure", "lean", "split", "none given", None])) for k in range(5) if r.random() < 0.7}
        points[i] = {k: (r.choice([None, r.randrange(0, len(place) + 2)]), r.choice(["sure", "lean", "split"])) for k in range(7) if r.random() < 0.9}
    flat = lambda x: spark.createDataFrame([(i, k, *v) for i, a in x.items() for k, v in a.items()], "id long, key int, pick long, status string")
    got = R.reading_view(spark.createDataFrame(list(docs.items()), "id long, place array<int>"), flat(named), flat(points))
    assert view_rows(got) == {i: plain_view(docs[i], named[i], points[i]) for i in docs}


def test_readings_over_whole_documents(spark):
    docs, named, points = answered(spark, DATA)
    asked = lambda df: {(x.id, x.key): (x.pick, x.status) for x in df.collect()}
    a, b = asked(named), asked(points)
    want = {x.id: plain_view(x.place or [], {k: v for (i, k), v in a.items() if i == x.id}, {k: v for (i, k), v in b.items() if i == x.id}) for x in docs.collect()}
    assert view_rows(registry.QUERIES["x18_takeaways"](spark, DATA)) == want
    assert any(p for _, p in want.values()) and any(t for t, _ in want.values())


def hours(n):
    return datetime.datetime(2026, 1, 1) + datetime.timedelta(hours=n)


def test_state_ends_with_the_watermark(spark, tmp_path):
    """Records of ten days in ten files: repeats within a day go, the state holds two days at most, late rows are dropped."""
    schema = "user_id long, article_id long, kind string, ts timestamp"
    for day in range(10):
        rows = [(day * 50 + u, 1, "shown", hours(day * 24 + u % 24 + more)) for u in range(50) for more in (0, 0.01)]
        rows += [(777, 9, "late", hours(0))] if day == 8 else []
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = K.recorded_once(stream, "1 hour").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/log").trigger(availableNow=True).start()
    q.awaitTermination()
    state = [x["numRowsTotal"] for p in q.recentProgress for x in json.loads(p.json)["stateOperators"]]
    got = spark.read.parquet(f"{tmp_path}/out")
    assert got.filter("kind = 'late'").count() == 0
    assert got.count() == 500 and max(state) <= 110, state


def test_live_slot_over_runs(spark):
    events = spark.read.parquet(f"{DATA}/events.parquet").select("event_id", "user_id", "event_type", F.least(F.floor((F.dayofmonth("ts") - 1) / 3), F.lit(9)).alias("run"), F.floor((F.dayofmonth("ts") - 1) / 3).alias("real")).collect()
    held, want = None, {}
    for run in range(streams.LIVE_RUNS):
        mine = [e for e in events if e.run == run]
        now = max(e.real for e in mine) * streams.LIVE_EVERY_S
        table = {}
        for e in mine:
            table.setdefault(f"e{e.event_id % 12}", []).append(e)
        hype = {i: len({e.user_id for e in es}) for i, es in table.items()}
        able = {i: 5 * sum(e.event_type == "purchase" for e in es) > len(es) for i, es in table.items()}
        merit = [i for i in table if able[i] and hype[i] >= K.LIVE_LEAST]
        best = min(merit, key=lambda i: (-hype[i], i), default=None)
        if held and able.get(held[0]) and (held[0] == best or now - held[1] < K.HOLD_S):
            pass
        else:
            held = (best, now) if best else None
        if held:
            want[run] = held
    got = {x.epoch: (x.id, x.since_s) for x in registry.QUERIES["k02_live_slot"](spark, DATA).collect()}
    assert got == want and len(set(want.values())) > 1
