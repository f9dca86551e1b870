"""Twins, splits and other sides against sequential loops."""

import random
import re

from pyspark.sql import functions as F

from quillmesh.operators import storypages as P
from quillmesh.plans import registry

DATA = "/root/testdata/sf0.001"


def in_order(stories, least):
    """The sequential scan: a story is a twin if a headline of its own has an owner; else it owns them."""
    owner, out = {}, {}
    for i, _, titles in sorted(stories, key=lambda s: s[1]):
        forms = [re.sub(r"[\W_]+", " ", (t or "").lower()).strip() for t in titles or []]
        forms = [t for t in forms if len(t) >= least]
        out[i] = next((owner[t] for t in forms if t in owner), None)
        if out[i] is None:
            for t in forms:
                owner.setdefault(t, i)
    return out


def test_twins_are_those_of_the_scan(spark):
    r = random.Random(30)
    for n, names in ((300, 200), (400, 90), (60, 4)):
        title = lambda: r.choice([None, "", "Short!", *(f"Headline, number {k}" for k in r.sample(range(names), min(names, 3)))])  # noqa: E731,B023
        ranks = r.sample(range(10_000), n)
        stories = [(i, ranks[i], r.choice([None, []]) if r.random() < 0.05 else [title() for _ in range(r.randrange(1, 5))]) for i in range(n)]
        # a chain: each story shares a headline with the next, so every other one goes
        stories += [(1000 + k, 20_000 + k, [f"Chain of stories {k}", f"Chain of stories {k + 1}"]) for k in range(12)]
        got = P.without_twins(spark.createDataFrame(stories, "id long, rank long, titles array<string>").repartition(5), 14)
        want = in_order(stories, 14)
        assert {x.id: x.twin for x in got.collect()} == want
        assert [want[1000 + k] is None for k in range(12)] == [k % 2 == 0 for k in range(12)]
    none = spark.createDataFrame([], "id long, rank long, titles array<string>")
    assert P.without_twins(none).count() == 0
    assert [tuple(x) for x in P.without_twins(spark.createDataFrame([(1, 1, None)], none.schema)).collect()] == [(1, None)]


def test_ordered_dedup_over_the_tables(spark):
    from quillmesh.plans.pages import stories_with_titles

    rows = [(x.id, tuple(x["rank"]), x.titles) for x in stories_with_titles(spark, DATA).collect()]
    want = in_order(rows, P.DEDUP_MIN_CHARS)
    assert {x.id: x.twin for x in registry.QUERIES["u03_ordered_dedup"](spark, DATA).collect()} == want
    assert any(want.values())


def test_members_split_off(spark):
    r = random.Random(31)
    members = [(c, c * 10 + k, c * 10 + r.randrange(3), f"s{r.randrange(5)}", r.random() < 0.5) for c in range(60) for k in range(r.randrange(1, 5))]
    anchors = {c: c * 10 for c in range(60)}
    answers = {(anchors[c], i): (r.choice([0.1, 0.29, 0.3, 0.9, None]), r.choice(["adds", None])) for c, i, *_ in members if r.random() < 0.7}
    live = {c for c in range(60) if c % 3 == 0}
    outlets = [("s0", "g", "left"), ("s1", "g", "right"), ("s2", "s2", None), ("s3", "s3", "left")]
    info = {s: (g, lean) for s, g, lean in outlets}
    want, shapes = {}, {}
    for c in range(60):
        mine = [m for m in members if m[0] == c]
        same = lambda i, c=c: answers.get((anchors[c], i), (None, None))
        drop = [m[1] for m in mine if m[1] != anchors[c] and same(m[1])[0] is not None and same(m[1])[0] < P.SPLIT_BELOW]
        keep = [m for m in mine if m[1] not in drop]
        if drop and len(keep) < 2 and c in live:
            keep, drop = mine, []
        whole = len(keep) >= 2 or (c in live and keep == mine and len([1 for m in mine if m[1] != anchors[c] and same(m[1])[0] is not None and same(m[1])[0] < P.SPLIT_BELOW]) > 0)
        for m in mine:
            fate = "split" if m[1] in drop else "kept" if whole else "dissolved"
            want[m[1]] = (fate, *(same(m[1]) if fate == "kept" and m[1] != anchors[c] else (None, None)))
        if whole:
            by_unit = {}
            for m in keep:
                by_unit.setdefault(m[2], []).append(m)
            copies, units = sum(len(v) > 1 for v in by_unit.values()), len(by_unit)
            emb = sum(any(m[4] for m in v) for v in by_unit.values()) > 1 and units > 1
            method = ("minhash+cosine_entity" if copies else "cosine_entity") if units > 1 else "minhash"
            srcs = {m[3] for m in keep}
            shapes[c] = (len(keep), units, copies, len({info.get(s, (s,))[0] for s in srcs}), sorted({info[s][1] for s in srcs if s in info and info[s][1]}), method + ("+embedding" if emb else ""))
    placed, stories = P.split_stories(
        spark.createDataFrame(members, "cluster_id long, id long, unit_id long, source_id string, embedded boolean"),
        spark.createDataFrame(list(anchors.items()), "cluster_id long, anchor long"),
        spark.createDataFrame([(*k, *v) for k, v in answers.items()], "anchor long, id long, same double, framing string"),
        spark.createDataFrame(outlets, "source_id string, syndication_group string, lean string"),
        spark.createDataFrame([(c,) for c in sorted(live) * 2], "cluster_id long"),
    )
    assert {x.id: (x.fate, x.same, x.framing) for x in placed.collect()} == want
    assert {x.cluster_id: (x.n, x.units, x.copies, x.independent, x.leans, x.method) for x in stories.collect()} == shapes


def test_other_sides(spark):
    r = random.Random(32)
    leans = [*P.SPECTRUM, "non-us", None]
    versions = [(s, s * 100 + k, f"s{r.randrange(9)}", r.choice(leans), r.randrange(4), r.randrange(3), r.randrange(5), r.choice([None, 0.2, 0.6, 0.9]), r.choice([None, "adds", "different", "same", "emphasis"])) for s in range(25) for k in range(r.randrange(1, 7))]
    cards, muted = [], {(u, f"s{r.randrange(9)}") for u in range(6)}
    for u in range(6):
        for place, s in enumerate(r.sample(range(25), 14), 1):
            own = r.choice([v for v in versions if v[0] == s])
            cards.append((u, place, s, own[1], own[3], r.randrange(1, 6), r.sample(["a", "b", "c"], r.randrange(0, 4))))
    for per_page in (1, 3):
        want = {}
        for u in range(6):
            page = sorted(c for c in cards if c[0] == u)
            shown = [c[4] for c in page[:10]]
            given = 0
            for _, _, s, own, lean, independent, sides in page:
                if given >= per_page or independent < 3 or len(sides) < 2:
                    continue
                some = [v for v in versions if v[0] == s and v[1] != own and v[3] and v[3] != lean and (u, v[2]) not in muted]
                if not some:
                    continue
                far = lambda x, lean=lean: abs(P.SPECTRUM.index(x) - P.SPECTRUM.index(lean)) if x in P.SPECTRUM and lean in P.SPECTRUM else 0
                side = min({v[3] for v in some}, key=lambda x: (shown.count(x), -far(x), x))
                fit = [v for v in some if v[3] == side and not (v[7] is not None and v[7] < 0.6) and v[8] != "different"]
                if not fit:
                    continue
                best = min(fit, key=lambda v: (v[8] not in ("adds", "emphasis"), -v[4], -v[5], -v[6], v[1]))
                want[u, s] = (best[1], side)
                given += 1
        got = P.other_side(
            spark.createDataFrame(cards, "list_id long, place int, story_id long, article_id long, lean string, independent long, leans array<string>"),
            spark.createDataFrame(versions, "story_id long, article_id long, source_id string, lean string, score long, base long, published_s long, same double, framing string"),
            spark.createDataFrame(sorted(muted), "list_id long, source_id string"),
            per_page=per_page,
        )
        assert {(x.list_id, x.story_id): (x.other, x.lean) for x in got.collect()} == want and want


def test_page_runs(spark):
    got = registry.QUERIES["o14_page_runs"](spark, DATA)
    rows = got.collect()
    assert rows and got.groupBy("list_id").agg(F.max("place").alias("m"), F.count("*").alias("n"), F.countDistinct("place").alias("d")).filter("m <> n or d <> n").count() == 0
    sides = [x.list_id for x in rows if x.other is not None]
    assert len(sides) == len(set(sides))
