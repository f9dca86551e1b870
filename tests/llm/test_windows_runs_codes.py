"""Word windows, periodic runs and vector codes against brute force and edge cases."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmesh.llm import periodic_runs as runs
from quillmesh.llm import queries
from quillmesh.llm import vector_codes as codes
from quillmesh.llm.common import WordHashes, setup, table
from quillmesh.llm.substring_dedup import substring_dedup

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, extra string, h long, digest int, spans string"


def sha(x):
    return hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest()


def frame(spark, rows):
    setup(spark)
    return spark.createDataFrame([(i, t, "x", None, 1, "s") for i, t in rows], SCHEMA).repartition(5)


# 11: periodic runs


def plain_runs(w, shortest=12):
    """Every period's maximal stretches; of equal stretches the least period."""
    n, best = len(w), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            if i + q - s >= max(shortest, 2 * q):
                best.setdefault((s, i + q - s), q)
    return sorted((s, n, q) for (s, n), q in best.items())


def periodic_text(r):
    kind = r.random()
    if kind < 0.3:
        return [r.choice("ab") for _ in range(r.randrange(0, 70))]
    if kind < 0.5:
        a, b = "a", "ab"
        for _ in range(r.randrange(2, 9)):
            a, b = b, b + a
        return list(b)[:150]
    w = []
    for _ in range(r.randrange(1, 6)):
        w += [r.choice("abcdefgh") for _ in range(r.randrange(1, 12))] * r.randrange(1, 6)
        w = w[: -r.randrange(0, 3) or None]
    return w


def test_runs_equal_every_period_tried():
    r, table_ = random.Random(4), WordHashes()
    docs = [[x.encode() for x in periodic_text(r)] for _ in range(1500)]
    for shortest in (12, 4, 7):
        got = runs.found_runs([(w, np.fromiter(map(table_.__getitem__, w), np.uint64, len(w))) for w in docs], shortest)
        for w, mine in zip(docs, got, strict=True):
            assert [tuple(x) for x in mine.tolist()] == plain_runs(w, shortest), b"".join(w)


def test_colliding_hashes_change_no_run():
    w = [x.encode() for x in ("a b c d e f g h " * 3 + "i j k l m n o p q").split()]
    got = runs.found_runs([(w, np.zeros(len(w), np.uint64))])
    assert [tuple(x) for x in got[0].tolist()] == [(0, 24, 8)]


def test_batches_of_texts_are_searched_apart(monkeypatch):
    monkeypatch.setattr(runs, "TOGETHER", 40)
    monkeypatch.setattr(runs, "PAIRS", 50)
    monkeypatch.setattr(runs, "PIECE", 7)
    r = random.Random(8)
    texts = [" ".join(periodic_text(r)) for _ in range(60)]
    docs = [[w for piece in runs.split_words(t.encode()) for w in piece] for t in texts]
    assert docs == [t.encode().split() for t in texts]
    table_ = WordHashes()
    got = runs.found_runs([(w, np.fromiter(map(table_.__getitem__, w), np.uint64, len(w))) for w in docs])
    assert [[tuple(x) for x in g.tolist()] for g in got] == [plain_runs(w) for w in docs]


def test_long_periodic_text_takes_near_linear_time():
    w = [str(i % 997).encode() for i in range(200_000)]
    got = runs.found_runs([(w, np.arange(200_000, dtype=np.uint64) % np.uint64(997))])
    assert got[0].tolist() == [[0, 200_000, 997]]


def expected_run_row(doc_id, text):
    w = (text or "").encode("utf-8", "surrogatepass").split()
    n = len(w)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = plain_runs(w)
    drop = {i for s, m, q in found for i in range(s + q, s + m)}
    top = max(found, key=lambda x: (x[1], -x[0], -x[2]), default=None)
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in sorted(found, key=lambda x: (x[0], x[2])))
    kept = b" ".join(x for i, x in enumerate(w) if i not in drop)
    return (doc_id, len(found), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None, sha(lines), hashlib.sha256(kept).hexdigest())


def test_op11_over_texts_of_all_kinds(spark):
    r = random.Random(6)
    planted = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 10 == 0][:40]
    rows = [(i, " ".join(periodic_text(r))) for i in range(120)] + [(i, " ".join(r.choice("abcdefghij") + str(r.randrange(30)) for _ in range(r.randrange(1, 300)))) for i in planted]
    rows += [(-1, None), (-2, ""), (-3, " \t\n "), (None, "a b " * 9), (-4, "é é " * 12), (-5, "x y"), (-5, "x y"), (-6, "w " * 3000)]
    df = frame(spark, rows)
    got = runs.longest_run(runs.periodic_runs(df, change=runs.with_planted_run, with_text=False)).collect()
    assert sorted((tuple(x) for x in got), key=repr) == sorted((expected_run_row(i, t) for i, t in rows), key=repr)
    assert runs.periodic_runs(df.limit(0)).count() == 0
    texts = {x.doc_id: x for x in runs.periodic_runs(df.filter("doc_id = -6")).collect()}
    assert texts[-6].collapsed == "w" and [tuple(x) for x in texts[-6].runs] == [(0, 3000, 1)]


def test_op11_over_the_table(spark):
    want = [expected_run_row(x.doc_id, x.text) for x in table(spark, DATA, "documents").select("doc_id", "text").collect()]
    got = [tuple(x) for x in queries.op11_periodic_runs(spark, DATA).collect()]
    assert sorted(got) == sorted(want)


# 12: vector codes


def plain_codes(rows, parts=8, entries=16, rounds=6):
    """Lloyd rounds with every distance computed, in Python's whole numbers."""
    kept = sorted(((i, [math.floor(4096 * c) for c in v], label) for i, v, label in rows if v and all(c is not None and math.isfinite(c) for c in v)), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    width = len(kept[0][1]) // parts
    cut = [[tuple(v[p * width : (p + 1) * width]) for p in range(parts)] for _, v, _ in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def nearest(book, x):
        d = [sum((a - b) ** 2 for a, b in zip(x, e, strict=True)) for e in book]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for c in cut:
                groups.setdefault(nearest(books[p], c[p])[0], []).append(c[p])
            for k, members in groups.items():
                books[p][k] = tuple(sum(x) // len(members) for x in zip(*members, strict=True))
    out = []
    for (i, _, label), c in zip(kept, cut, strict=True):
        found = [nearest(books[p], c[p]) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for k, _ in found), sum(d for _, d in found), label))
    total = {}
    for _, _, e, label in out:
        total[label] = total.get(label, 0) + e
    digest = sha(",".join(str(x) for book in books for e in book for x in e))
    return [(i, k, e, total[label], digest) for i, k, e, label in out]


def coded(spark, rows, **sizes):
    setup(spark)
    df = spark.createDataFrame([(i, v, label, 1, "c") for i, v, label in rows], "vec_id long, embedding array<float>, label int, error int, code string").repartition(4)
    found, books = codes.vector_codes(df, **sizes)
    digest = codes.codebooks_sha256(books)
    return [(x.vec_id, x.code.hex(), x.error, x.label_error, digest) for x in codes.with_label_errors(found).collect()]


def test_codes_equal_plain_lloyd_rounds(spark):
    r = random.Random(12)
    near = [[r.gauss(0, 0.01) for _ in range(16)] for _ in range(12)]
    rows = [(i, [float(np.float32(c + r.gauss(0, 0.0005))) for c in r.choice(near)], r.choice([0, 1, None])) for i in range(200)]
    rows += [(300 + i, [r.choice([0.0, 0.25, -0.25]) for _ in range(16)], 2) for i in range(150)]  # many ties
    rows += [(5, None, 1), (6, [], 1), (7, [1.0, None] * 8, 1), (8, [float("nan")] * 16, 1), (9, [float("inf")] + [0.0] * 15, 1), (300, rows[0][1], 1), (300, rows[0][1], 1), (None, rows[3][1], 1)]
    assert sorted(coded(spark, rows), key=repr) == sorted(plain_codes(rows), key=repr)
    hot = [(i, [0.5] * 8, 1) for i in range(100)] + [(1000 + i, [r.random() for _ in range(8)], None) for i in range(60)]
    assert sorted(coded(spark, hot)) == sorted(plain_codes(hot))  # equal entries, hot label
    few = rows[:5]
    assert sorted(coded(spark, few)) == sorted(plain_codes(few))
    assert coded(spark, [(1, None, 1)]) == [] and coded(spark, []) == []
    other = coded(spark, [*few, (900, [1.0] * 8, 1), (901, [1.0] * 3, 1)])
    assert sorted(other) == sorted(plain_codes(few))
    with pytest.raises(Exception, match="do not fit a long"):
        coded(spark, [(1, [1e30] * 8, 1)])


def test_op12_over_the_table(spark):
    rows = [(x.vec_id, x.embedding, x.label) for x in table(spark, DATA, "embeddings").collect()]
    got = [tuple(x) for x in queries.op12_vector_codes(spark, DATA).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()]
    assert sorted(got) == sorted(plain_codes(rows))


def test_bounds_spare_scans_and_hold():
    """Bounds always enclose the true distances, and later rounds compare few parts with all entries."""
    g = np.random.default_rng(1)
    x = (g.integers(0, 16, (4000, 8, 1)) * 2000 + g.integers(-150, 150, (4000, 8, 8))).astype(np.int64)
    books, state, scans = codes.Codebooks(x[:16].swapaxes(0, 1).copy()), None, []
    for _ in range(6):
        code, upper, lower, scanned = codes.assigned(x, books, state)
        d = np.sqrt(((x[:, :, None] - books.entries[None]) ** 2).sum(axis=3).astype(np.longdouble))
        own = np.take_along_axis(d, code[:, :, None].astype(int), 2)[:, :, 0]
        assert (code == d.argmin(axis=2)).all() and (upper >= own).all()
        np.put_along_axis(d, code[:, :, None].astype(int), np.inf, 2)
        assert (lower <= d.min(axis=2)).all()
        sums = codes.part_sums(x, code, 16)
        books = codes.Codebooks(np.where(sums[:, :, 8:] > 0, sums[:, :, :8] // np.maximum(sums[:, :, 8:], 1), books.entries), books.entries)
        state = code, upper, lower
        scans.append(scanned)
    assert scans[0] == 32_000 and scans[-1] < 16_000, scans


# 13: substring dedup


def plain_windows(rows, k):
    """(doc_id, n_words, n_removed, kept_sha256): every window looked up among all."""
    words = [(i, (t or "").encode("utf-8", "surrogatepass").split()) for i, t in rows]
    rank = lambda i: -(2**63) if i is None else i
    least = {}
    for i, w in words:
        for s in range(len(w) - k + 1):
            key = tuple(w[s : s + k])
            least[key] = min(least.get(key, 2**63), rank(i))
    out = []
    for i, w in words:
        gone = {x for s in range(len(w) - k + 1) if least[tuple(w[s : s + k])] < rank(i) for x in range(s, s + k)}
        kept = b" ".join(x for n, x in enumerate(w) if n not in gone)
        spans = sum(n - 1 not in gone for n in gone)
        out.append((i, len(w), len(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def digests(found):
    return sorted(((x.doc_id, x.n_words, sum(e - s for s, e in x.spans), len(x.spans), x.kept_sha256) for x in found.collect()), key=repr)


def passages(seed, n, longest=60):
    r = random.Random(seed)
    shared = [[r.choice("abcdefgh") + str(r.randrange(9)) for _ in range(r.randrange(4, 30))] for _ in range(12)]
    out = []
    for i in range(n):
        w = []
        for _ in range(r.randrange(0, 5)):
            w += r.choice(shared) if r.random() < 0.5 else [r.choice("ab") for _ in range(r.randrange(longest))]
        out.append((r.randrange(n), r.choice([" ", "\n", " \t"]).join(w)))
    return out


@pytest.mark.parametrize("k", [1, 3, 8])
def test_windows_equal_brute_force(spark, k):
    rows = passages(k, 150)
    rows += [(500, None), (501, ""), (502, " \n"), (None, rows[0][1]), (None, rows[5][1]), (503, "Ab ab AB"), (504, "é x " * 20), (505, "é x " * 20), (600, rows[7][1]), (600, rows[7][1]), *((700 + i, "one two three four five six seven eight nine") for i in range(60))]
    df = frame(spark, rows)
    assert digests(substring_dedup(df, window=k)) == plain_windows(rows, k)


def test_windows_texts_and_empty_table(spark):
    rows = [(1, "a b c d e f"), (2, "x b c  d y"), (3, "a b c d e f"), (4, "b c"), (5, None)]
    got = {x.doc_id: x for x in substring_dedup(frame(spark, rows), window=3).collect()}
    assert {i: x.kept for i, x in got.items()} == {1: "a b c d e f", 2: "x y", 3: "", 4: "b c", 5: ""}
    assert [tuple(x) for x in got[2].spans] == [(1, 4)] and [tuple(x) for x in got[3].spans] == [(0, 6)]
    assert substring_dedup(frame(spark, rows).limit(0)).count() == 0


def test_many_chunks_and_bins(spark, monkeypatch):
    """Shared windows across small chunks, and colliding first hashes."""
    from quillmesh.llm import substring_dedup as module

    monkeypatch.setattr(module, "layout", lambda total: (40, 17))
    rows = passages(77, 300, 90)
    assert digests(substring_dedup(frame(spark, rows), window=5)) == plain_windows(rows, 5)


def test_first_hashes_that_collide_remove_nothing():
    import pyarrow as pa

    from quillmesh.llm.substring_dedup import Windows, least_rank

    tab = pa.table({"doc_id": pa.array([3, 1]), "data": pa.array([b"a b c d", b"p q r"], pa.binary())})
    w = Windows(tab, 3)
    assert (w.start.tolist(), w.rank.tolist(), w.first.tolist(), w.words) == ([0, 1, 4], [1, 1, 0], [0, 4], 7)
    order, new, least = least_rank(np.zeros(3, np.uint64), w.g, w.rank)
    assert new.all() and sorted(least.tolist()) == [0, 1, 1]


def test_op13_over_the_table(spark):
    rows = [(x.doc_id, x.text) for x in table(spark, DATA, "documents").select("doc_id", "text").collect()]
    got = queries.op13_substring_dedup(spark, DATA).select("doc_id", "n_words", "n_removed", "n_spans", "kept_sha256")
    assert sorted((tuple(x) for x in got.collect()), key=repr) == plain_windows(rows, 50)
    assert got.agg(F.sum("n_removed")).first()[0] > 0
