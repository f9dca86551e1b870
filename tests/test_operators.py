"""Operators that SQL cannot say: against plain versions and invariants."""

import datetime
import math
import random

from pyspark.sql import functions as F

from quillmesh.operators import ranking as R
from quillmesh.operators import stories as S
from quillmesh.operators.graph import components
from quillmesh.operators.order import as_of, matched, placed
from quillmesh.operators.scale import skew_join
from quillmesh.streaming.state import hold_live


def test_components_match_union_find(spark):
    r = random.Random(3)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)]
    parent = list(range(300))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    for few in (0, 1 << 16):
        got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), few).collect()}
        assert got == {x: find(x) for x in nodes}
        assert components(spark.createDataFrame([], "a long, b long"), few).count() == 0
        assert components(spark.createDataFrame([(None, 1), (3, 3)], "a long, b long"), few).count() == 0


def test_skew_join_keeps_all_rows(spark):
    left = spark.createDataFrame([(1, i) for i in range(500)] + [(k, -k) for k in range(2, 40)] + [(None, 7)], "k long, v long")
    right = spark.createDataFrame([(k, k * 10) for k in range(1, 30)], "k long, w long")
    got = skew_join(left, right, "k", F.col("v"), 500)
    assert got.count() == 500 + 28
    assert got.filter("w <> k * 10").count() == 0
    assert skew_join(left, right, "k", F.col("v"), 500, how="left").count() == left.count()


def naive_agglomerate(units, times, sources, scores, threshold):
    clusters = {u: sorted(m) for u, m in units.items()}

    def linked(a, b):
        return any((min(x, y), max(x, y)) in scores for x in clusters[a] for y in clusters[b])

    while True:
        best = None
        for a in sorted(clusters):
            for b in sorted(clusters):
                if a < b and linked(a, b):
                    both = clusters[a] + clusters[b]
                    if max(times[i] for i in both) - min(times[i] for i in both) > S.SPAN_S:
                        continue
                    links = [scores.get((min(x, y), max(x, y)), 0.0) for x in clusters[a] for y in clusters[b] if sources[x] != sources[y]]
                    if links and (mean := round(math.fsum(links) / len(links), 9)) >= threshold:
                        best = min(best, (-mean, a, b)) if best else (-mean, a, b)
        if not best:
            return clusters
        _, a, b = best
        clusters[a] = sorted(clusters[a] + clusters.pop(b))


def test_average_link_matches_one_join_at_a_time(spark):
    r = random.Random(5)
    items, pairs, want = [], [], {}
    for case in range(40):
        ids = [case * 100 + i for i in range(12)]
        times, sources = {i: r.randrange(3 * 86400) for i in ids}, {i: f"s{r.randrange(4)}" for i in ids}
        scores = {(a, b): r.randrange(270, 1000) / 1000 for a in ids for b in ids if a < b and sources[a] != sources[b] and r.random() < 0.5}
        items += [(i, sources[i], times[i]) for i in ids]
        pairs += [(a, b, s) for (a, b), s in scores.items()]
        found = naive_agglomerate({i: [i] for i in ids}, times, sources, scores, 0.41)
        want |= {i: c for c, m in found.items() for i in m}
    frame = spark.createDataFrame(items, "id long, source_id string, published_s long")
    for bound in (S.BOUND, 0):
        got = S.average_link(frame, frame.select("id", F.col("id").alias("unit")), spark.createDataFrame(pairs, "a long, b long, score double"), bound=bound)
        assert {x.id: x.story for x in got.collect()} == want
    assert len(set(want.values())) < len(want) - 50


def test_events_match_a_plain_greedy_run(spark):
    r = random.Random(6)
    keys = sorted({(c, f"e{r.randrange(25)}") for c in range(120) for _ in range(2) if c % 3})
    clusters = {c: (r.randrange(5 * 86400), r.randrange(1, 9)) for c in range(120)}
    left, want = set(clusters), []
    while True:
        ranked = []
        for e in {e for _, e in keys}:
            some = [c for c, k in keys if k == e and c in left]
            kept = [c for c in some if max(clusters[x][0] for x in some) - clusters[c][0] <= 48 * 3600]
            if len(kept) >= 2:
                ranked.append((-len(kept), -sum(clusters[c][1] for c in kept), e, kept))
        if not ranked:
            break
        _, _, e, kept = min(ranked)
        want += [(e, c) for c in kept]
        left -= set(kept)
    rows = spark.createDataFrame([(c, *x) for c, x in clusters.items()], "cluster_id long, newest_s long, n long")
    got = S.greedy_events(spark.createDataFrame(keys, "cluster_id long, entity string"), rows)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_near_classes_and_units_match_all_pairs(spark):
    r = random.Random(11)
    words = [f"word{i}" for i in range(60)]
    base = [[r.choice(words) for _ in range(20)] for _ in range(12)]
    rows = []
    for i in range(150):
        w = list(r.choice(base))
        if i % 3:
            w[r.randrange(20)] = "changed"
        at = r.randrange(10 * 86400)
        rows.append((i, "s", " ".join(w[:8]) if i % 7 else "", " ".join(w[8:]) if i % 7 else "", at))
    frame = spark.createDataFrame(rows, "id long, source_id string, title string, dek string, published_s long")
    sets = {x.id: (set(x.full), set(x["head"])) for x in S.shingled(frame).collect()}
    at = {x[0]: x[4] for x in rows}
    jaccard = lambda x, y: len(x & y) / len(x | y) if x and y else 0.0
    want = {}
    for a in sets:
        for b in sets:
            if a < b and abs(at[a] - at[b]) <= S.WINDOW_S:
                both = [jaccard(x, y) for x, y in zip(sets[a], sets[b], strict=True)]
                if both[0] >= S.NEAR or both[1] >= S.TITLE_NEAR:
                    want[a, b] = both
    got = S.near_pairs(frame).collect()
    assert len(got) == len(want) and all([x.similarity, x.titles] == want[x.a, x.b] for x in got)
    label = {i: i for i in sets}
    for a, b in want:
        x, y = label[a], label[b]
        label = {i: min(x, y) if v in (x, y) else v for i, v in label.items()}
    for most in (S.PAIRS_A_NODE, 0):  # all pairs at once, and hub after hub
        assert {x.id: x.unit for x in S.units(frame, most).collect()} == label


def test_near_copies_give_links_not_pairs(spark):
    """1,500 texts that are all near each other, as 1.1 million pairs: a few links a text, and one unit a time span."""
    words = [f"word{i}" for i in range(30)]
    rows = [(i, "s", " ".join(words[:8]), " ".join([*words[8 : 8 + i % 20], f"own{i}", *words[9 + i % 20 :]]), i * 50) for i in range(1500)]
    frame = spark.createDataFrame(rows, "id long, source_id string, title string, dek string, published_s long")
    s, classes, keyed = S.class_tables(frame)
    nodes = S.class_members(s, classes).select("rep", F.floor(F.col("published_s") / S.WINDOW_S).alias("span"), F.col("id").alias("node"), F.col("published_s").alias("lo"), F.col("published_s").alias("hi"))
    links = S.node_links(nodes, keyed, classes)
    assert 1499 <= links.count() <= 12_000
    assert {x.unit for x in S.units(frame).collect()} == {0}


def test_copies_give_rows_and_no_pairs(spark):
    frame = spark.createDataFrame([(i, "s", "one title of six words here", "and a dek", i) for i in range(3000)], "id long, source_id string, title string, dek string, published_s long")
    pairs, members = S.near_classes(frame)
    assert pairs.count() == 0 and members.filter("rep = 0").count() == 3000 and S.units(frame).filter("unit = 0").count() == 3000


def test_lean_quota_holds_where_it_can():
    leans = ["l"] * 8 + ["r"] * 8 + [None] * 4
    order = R.lean_quota(leans)
    assert sorted(order) == list(range(20))
    assert R.breaks([leans[i] for i in order]) == 0
    assert R.lean_quota(["l"] * 12) == list(range(12))


def test_repeat_cap_moves_and_drops_nothing():
    events = [1, 1, 1, 2] + [None] * 12
    words = [{f"w{i}"} for i in range(16)]
    order = R.repeat_cap(events, words)
    assert sorted(order) == list(range(16)) and 2 not in order[:12]
    assert R.repeat_cap(events[:5], words[:5]) == list(range(5))


def test_passes_keep_each_page(spark):
    rows = [(p, i, i * 7 % 50, i * 3 % 40, i % 5 if i % 3 else None, "lrc"[i % 3], [f"w{i}", f"x{i % 7}"], i % 4 == 0, ["t"] * (i % 9 == 0)) for p in range(3) for i in range(40)]
    pages = spark.createDataFrame(rows, "list_id long, id long, score long, neutral long, event long, lean string, words array<string>, must_know boolean, topics array<string>")
    got = R.run_passes(pages, [("t", 2, 10)]).collect()
    for p in range(3):
        mine = sorted((r.place, r.id) for r in got if r.list_id == p)
        assert [x for x, _ in mine] == list(range(1, 41)) and sorted(i for _, i in mine) == list(range(40))
    again = R.run_passes(pages.repartition(7), [("t", 2, 10)]).collect()
    assert {(r.list_id, r.id, r.place) for r in got} == {(r.list_id, r.id, r.place) for r in again}


def test_select_pool_keeps_budget_and_floors(spark):
    rows = [(0, i, f"s{i % 5}", i % 11, i * 13 % 37, 100 + i % 50) for i in range(120)]
    got = R.select_pool(spark.createDataFrame(rows, "run_id long, id long, source_id string, cluster_id long, points long, bytes long"), 6000).collect()
    size = {r[1]: r[5] for r in rows}
    assert sum(size[r.id] for r in got) <= 6000 and len({r.id for r in got}) == len(got)
    for s in range(5):
        assert sum(r.why == "floor_source" and r.id % 5 == s for r in got) == 2


def slot(spark, events, previous, now_s):
    rows = spark.createDataFrame([(*e, now_s) for e in events], "id string, hype long, eligible boolean, now_s long")
    got = hold_live(rows, spark.createDataFrame([previous] if previous else [], "id string, since_s long")).collect()
    return tuple(got[0]) if got else None


def test_live_slot_holds_and_releases(spark):
    a, b = ("a", 9, True), ("b", 12, True)
    assert slot(spark, [a], None, 0) == ("a", 0)
    assert slot(spark, [a, b], ("a", 0), 3600) == ("a", 0)
    assert slot(spark, [a, b], ("a", 0), 13 * 3600) == ("b", 13 * 3600)
    assert slot(spark, [("a", 9, False)], ("a", 0), 3600) is None
    assert slot(spark, [("a", 3, True)], ("a", 0), 3600) == ("a", 0)
    assert slot(spark, [("a", 3, True), b], ("a", 0), 12 * 3600) == ("b", 12 * 3600)
    assert slot(spark, [], ("a", 0), 3600) is None
    assert slot(spark, [("c", 12, True), b], None, 5) == ("b", 5)


def scan_quota(leans, window=10, cap=6):
    """The earliest waiting card that fits, one place after the other."""
    left, out = list(range(len(leans))), []
    for _ in leans:
        tail = [leans[i] for i in out[max(0, len(out) - window + 1) :]]
        fits = [i for i in left if leans[i] is None or sum(x == leans[i] for x in tail) < cap]
        out.append((fits or left)[0])
        left.remove(out[-1])
    return out


def test_lean_quota_matches_a_scan():
    r = random.Random(7)
    for _ in range(200):
        leans = [r.choice(["l", "l", "l", "r", None]) for _ in range(r.randrange(45))]
        assert R.lean_quota(leans) == scan_quota(leans)
        windows = [leans[i : i + 10] for i in range(max(1, len(leans) - 9))]
        assert R.breaks(leans) == sum(any(w.count(x) > 6 for x in "lr") for w in windows)


def test_repeat_cap_matches_pairwise_checks():
    r = random.Random(8)
    for _ in range(100):
        n = r.randrange(5, 40)
        events, words = [r.choice([None, 1, 2, 3]) for _ in range(n)], [{f"w{r.randrange(30)}" for _ in range(4)} for _ in range(n)]
        rare, top = R.rare_words(words), []
        for i in range(n):
            twin = any(rare[i] and rare[k] and len(rare[i] & rare[k]) > 0.5 * min(len(rare[i]), len(rare[k])) for k in top)
            if len(top) < 12 and not twin and (events[i] is None or [events[k] for k in top].count(events[i]) < 2):
                top.append(i)
        order = R.repeat_cap(events, words)
        assert order == (top + [i for i in range(n) if i not in top] if n > 12 else list(range(n)))
        assert n <= 12 or R.cap_holds(order[: len(top)], events, rare)


def test_exploration_keeps_the_cap_and_the_quota():
    r = random.Random(9)
    for _ in range(60):
        n = 30
        events, words = [r.choice([None, 1, 2]) for _ in range(n)], [{f"w{i}"} for i in range(n)]
        leans, neutral, rare = [r.choice("lrc") for _ in range(n)], [r.randrange(99) for _ in range(n)], R.rare_words(words)
        order = R.repeat_cap(events, words)
        out = R.explore(order, neutral, leans, events, rare)
        assert sorted(out) == list(range(n)) and (R.cap_holds(out, events, rare) or not R.cap_holds(order, events, rare))
        one = R.explore(order, neutral, leans, events, rare, slots=(4,))
        able = [i for i in order[3:] if R.cap_holds(m := R.at_place(order, i, 3), events, rare) and R.breaks([leans[x] for x in m]) <= R.breaks([leans[x] for x in order])]
        assert not able or not R.cap_holds(order, events, rare) or one[3] == min(able, key=lambda i: (-neutral[i], i))


def test_floors_are_met():
    r = random.Random(10)
    for _ in range(60):
        n = 30
        leans, neutral, must = [r.choice("lrc") for _ in range(n)], [r.randrange(99) for _ in range(n)], [r.random() < 0.2 for _ in range(n)]
        order = R.floor_pass(list(range(n)), must, neutral, leans, 3)
        assert sorted(order) == list(range(n)) and sum(must[i] for i in order[:3]) == min(3, sum(must))
        fits = {i for i in range(n) if r.random() < 0.2}
        held = set(order[:3])
        out = R.standing_floor(order, [(fits, 2, 8)], neutral, leans, held)
        assert sorted(out) == list(range(n)) and out[:3] == order[:3] and sum(i in fits for i in out[:8]) >= min(2, len(fits))
        if sum(i in fits for i in order[:8]) >= 2:
            assert out == order


def test_places_of_a_total_order(spark):
    r = random.Random(12)
    rows = [(i, r.randrange(40)) for i in range(3000)]
    got = placed(spark.createDataFrame(rows, "id long, n long").repartition(8), F.desc("n"), "id").collect()
    assert [(x.id, x.n) for x in sorted(got, key=lambda x: x.place)] == sorted(rows, key=lambda x: (-x[1], x[0])) and {x.place for x in got} == set(range(1, 3001))
    assert placed(spark.createDataFrame([], "id long"), "id").count() == 0


def test_as_of_join(spark):
    r = random.Random(13)
    at = lambda s: datetime.datetime(2026, 1, 1) + datetime.timedelta(seconds=s)
    left = [(i, r.choice([1, 2, 3, None]), at(r.randrange(100_000)), "kept") for i in range(300)]
    right = [(r.choice([1, 1, 2, 4, None]), at(r.randrange(100_000)), float(r.randrange(50))) for _ in range(80)]
    got = as_of(spark.createDataFrame(left, "id long, k long, at timestamp, held_ string"), spark.createDataFrame(right, "k long, at timestamp, v double"), "k", "at", "v").collect()
    for x in got:
        before = [(t, v) for k, t, v in right if k == x.k and t <= x.at] if x.k is not None else None
        assert before is None or x.v == max(before, default=(None, None))[1], x
    assert len(got) == 300 and {x.held_ for x in got} == {"kept"}


def test_matching_is_the_greedy_one(spark):
    r = random.Random(14)
    pairs = [(a, b, r.randrange(6)) for a in range(15) for b in range(12) if r.random() < 0.6]
    want, ends = [], set()
    for a, b, _ in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
        if ("a", a) not in ends and ("b", b) not in ends:
            want.append((a, b))
            ends |= {("a", a), ("b", b)}
    assert sorted(map(tuple, matched(spark.createDataFrame(pairs, "a long, b long, n long")).collect())) == sorted(want)


def test_places_within_groups(spark):
    """One group holds most rows, so it spans partitions; null keys and ties count."""
    from pyspark.sql import functions as F

    from quillmesh.operators.order import placed_in

    df = spark.range(0, 4000, 1, 8).select("id", F.when(F.col("id") % 10 < 7, "big").when(F.col("id") % 10 < 9, F.concat(F.lit("g"), F.col("id") % 50)).alias("k"), (F.col("id") % 13).alias("x"))
    got = placed_in(df, ["k"], "x", "id").collect()
    want, groups = {}, {}
    for r in sorted(df.collect(), key=lambda r: (r.x, r.id)):
        groups[r.k] = groups.get(r.k, 0) + 1
        want[r.id] = groups[r.k]
    assert {r.id: r.place for r in got} == want
    assert placed_in(df.limit(0), ["k"], "x").count() == 0


def test_skip_fill_carries_its_state(spark):
    """Against a plain loop: null sizes, null groups, ties, groups longer than a batch."""
    from pyspark.sql import functions as F

    from quillmesh.operators.items import skip_fill

    df = spark.range(30_000).select("id", F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("g"), F.when(F.col("id") % 11 > 0, F.col("id") * 7919 % 97).alias("size"))
    got = {r.id: r.kept for r in skip_fill(df, "g", ["id"], "size", 9000).collect()}
    used, want = {}, {}
    for r in sorted(df.collect(), key=lambda r: r.id):
        n = r.size or 0
        want[r.id] = used.get(r.g, 0) + n <= 9000
        used[r.g] = used.get(r.g, 0) + (n if want[r.id] else 0)
    assert got == want
    assert skip_fill(df.limit(0), "g", ["id"], "size", 1).count() == 0
