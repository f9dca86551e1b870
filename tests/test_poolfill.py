"""The pool fill against a plain greedy run."""

import random
from collections import Counter

from quillmesh.operators import poolfill as P
from quillmesh.plans import registry

SCHEMA = "run_id long, id long, url string, source_id string, syndication_group string, cluster_id long, two_sided boolean, bucket string, lean string, topics array<string>, score long, published_s long, age_h double, bytes long"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def greedy(rows, budget, tag_floor):
    """One item at a time, every remaining one looked at for each choice of the fill."""
    urls, some = set(), []
    for r in sorted(rows, key=lambda r: r["id"]):
        if r["url"] not in urls:
            urls.add(r["url"])
            some.append(r)
    key = lambda r: (-r["score"], -r["published_s"], r["id"])
    order = sorted(some, key=key)
    for r in order:
        r["c"] = r["cluster_id"] if r["cluster_id"] is not None else f"own {r['id']}"
        r["g"] = r["syndication_group"] or r["source_id"]
    why, used = {}, 0
    n = {k: Counter() for k in ("source_id", "g", "c", "bucket", "lean")}

    def fits(r, level):
        if r["id"] in why or used + r["bytes"] > budget:
            return False
        if level and (n["source_id"][r["source_id"]] >= P.SOURCE_CEIL or n["g"][r["g"]] >= P.GROUP_CEIL):
            return False
        if level < 2:
            return True
        return n["c"][r["c"]] < P.CLUSTER_CEIL and (r["lean"] in (None, "non-us") or n["lean"][r["lean"]] + 1 <= max(P.LEAN_LEAST, P.LEAN_SHARE * (len(why) + 1)))

    def take(r, reason):
        nonlocal used
        why[r["id"]] = reason
        used += r["bytes"]
        for k in n:
            if r[k] is not None:
                n[k][r[k]] += 1

    for source in sorted({r["source_id"] for r in order}):
        mine = [r for r in order if r["source_id"] == source]
        newest = min(mine, key=lambda r: (-r["published_s"], r["id"]))
        latest = [newest] if newest["age_h"] <= P.FRESH_H else []
        picks = (latest + [r for r in mine if r["age_h"] <= P.STALE_H and r not in latest])[: P.PER_SOURCE] or [newest]
        for r in picks:
            if fits(r, 0):
                take(r, "floor_source")
    for c in sorted({r["c"] for r in order if r["two_sided"]}, key=str):
        mine = [r for r in order if r["c"] == c and r["two_sided"]]
        have = {r["lean"] for r in order if r["c"] == c and r["id"] in why and r["lean"]}
        for r in mine:
            if len(have) < P.STORY_LEANS and r["lean"] and r["lean"] not in have and fits(r, 1):
                take(r, "floor_story")
                have.add(r["lean"])
    for b in sorted({r["bucket"] for r in order}):
        for r in order:
            if r["bucket"] == b and n["bucket"][b] < P.BUCKET_FLOOR and fits(r, 1):
                take(r, "floor_bucket")
    for tag in sorted(tag_floor):
        for r in order:
            if sum(tag in x["topics"] for x in order if x["id"] in why) < tag_floor[tag] and tag in r["topics"] and fits(r, 1):
                take(r, "floor_tag")
    left = [r for r in order if r["id"] not in why]
    while left:
        best = max(left, key=lambda r: (r["score"] - P.EXTRA_PENALTY * n["c"][r["c"]], -left.index(r)))
        left.remove(best)
        if fits(best, 2):
            take(best, "fill")
    return list(why.items())


def candidates(r, run, n):
    story = {c: r.random() < 0.4 for c in range(40)}
    out = []
    for i in range(n):
        c = r.choice([None, r.randrange(40), 7])
        out.append(dict(zip(NAMES, (run, run * 10_000 + i, f"u{r.randrange(n)}" if r.random() < 0.2 else f"own{i}", f"s{r.randrange(30)}", r.choice([None, "wire", f"g{r.randrange(12)}"]), c, c is not None and story[c], f"b{r.randrange(4)}", r.choice(["left", "right", "center", "non-us", None, "left"]), r.sample(["sg", "us", "ai"], r.randrange(3)), r.randrange(60), r.randrange(1000), r.choice([1.0, 10.0, 50.0]), r.randrange(50, 1500)), strict=True)))
    return out


def test_fill_equals_the_greedy_run(spark):
    r = random.Random(50)
    runs = {k: candidates(r, k, n) for k, n in enumerate((300, 60, 1, 420))}
    rows = [tuple(x[c] for c in NAMES) for rs in runs.values() for x in rs]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    seen = set()
    for budget, tags in ((60_000, {"sg": 70, "ai": 3}), (150_000, {}), (400, {"us": 2})):
        got = {}
        for x in sorted(P.fill_pool(df, budget, tags).collect(), key=lambda x: x.place):
            got.setdefault(x.run_id, []).append((x.id, x.why))
        want = {k: w for k, rs in runs.items() if (w := greedy(rs, budget, tags))}
        assert got == want
        seen |= {w for ws in want.values() for _, w in ws}
    assert seen == set(P.REASONS)
    assert P.fill_pool(df.limit(0), 100).count() == 0


def test_fill_over_the_table(spark):
    from quillmesh.plans.ranking import POOL_BUDGET, pool_candidates

    rows = [x.asDict() for x in pool_candidates(spark, "/root/testdata/sf0.001").collect()]
    want = []
    for run in {x["run_id"] for x in rows}:
        want += [(run, i, w, k) for k, (i, w) in enumerate(greedy([x for x in rows if x["run_id"] == run], POOL_BUDGET, {"science": 12}), 1)]
    got = registry.QUERIES["o05_fill_pool"](spark, "/root/testdata/sf0.001").collect()
    assert sorted(tuple(x) for x in got) == sorted(want)
