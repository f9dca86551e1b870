import numpy as np

from quillmesh.llm import quality


def test_all_rounds_give_new_texts(monkeypatch):
    r = np.random.default_rng(1)
    y = np.arange(400) % 2
    rows = lambda y, n: (r.normal(size=(len(y), n)) * 0.3 + (2 * y[:, None] - 1)).astype(np.float32)
    each = np.arange(2000) % 2
    pool = [rows(each, 6), rows(each, 6)]
    pool[0][:700:2], pool[1][:700:2] = -4, -4  # copies of one text, the most confident
    seen = []

    class Spy(quality.Logistic):
        def __init__(self, x, y, penalty, steps=300):
            seen.append(x)
            super().__init__(x, y, penalty, steps)

    monkeypatch.setattr(quality, "Logistic", Spy)
    used = set()

    def pick(views, _):
        """The surest texts of the pool in memory, each text once."""
        out = {}
        text = [row.tobytes() for row in pool[0]]
        for k in (0, 1):
            p = 1 / (1 + np.exp(-views[k].logit(pool[k])))
            for label, sure in ((0, 1 - p), (1, p)):
                first = {}
                for i in np.argsort(-sure, kind="stable").tolist():
                    if sure[i] >= quality.CONFIDENT and text[i] not in used and len(first) < quality.GIVEN:
                        first.setdefault(text[i], i)
                out[k, label] = [part[list(first.values())] for part in pool], set(first)
        for _, names in out.values():
            used.update(names)
        return {key: part for key, (part, _) in out.items()}

    quality.co_train([rows(y, 6), rows(y, 6)], y, pick)
    sizes = [len(x) for x in seen[: 2 * (quality.ROUNDS + 1) : 2]]
    assert np.diff(sizes).tolist() == [2 * quality.GIVEN] * quality.ROUNDS
    assert (seen[2 * quality.ROUNDS] == -4).all(axis=1).sum() <= 1


def test_surest_texts_are_those_of_the_whole_pool(spark, monkeypatch):
    """Against all rows in Python: copies count once, with their smallest id, used texts not at all, GIVEN a view and label."""
    from pyspark.sql import functions as F

    from quillmesh.llm.common import setup

    setup(spark)
    monkeypatch.setattr(quality, "CONFIDENT", 0.5)
    monkeypatch.setattr(quality, "GIVEN", 25)
    g = np.random.default_rng(3)
    texts = [" ".join(g.choice(["good", "prose", "%%%", "###", "word"], int(g.integers(1, 40)))) for _ in range(300)]
    rows = [(int(i), texts[int(g.integers(300))] if i % 3 else texts[0], "en", f"s{i % 4}", None) for i in range(900)] + [(None, texts[5], None, None, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text_ string, lang string, source string, n_chars long").withColumn("same", F.xxhash64("text_")).repartition(7)
    table = df.collect()
    x = quality._views(table)
    y = np.array([float("%%%" in r.text_) for r in table])
    views = [quality.Logistic(x[k], y, 1e-3, 60) for k in (0, 1)]
    used = {r.same for r in table[:100]}
    got = {(k, label): [] for k in (0, 1) for label in (0, 1)}
    for r in quality.surest(df, views, used).collect():
        got[r.view, r.label].append((r.same, r.doc_id, round(r.p, 5)))
    for k in (0, 1):
        p = 1 / (1 + np.exp(-np.clip(views[k].logit(x[k]), -30, 30)))
        for label, sure in ((0, 1 - p), (1, p)):
            best = {}
            for r, s in zip(table, sure.tolist(), strict=True):
                if s >= 0.5 and r.same not in used:
                    found = (-s, r.doc_id is not None, r.doc_id or 0)
                    best[r.same] = min(best.get(r.same, found), found)
            want = sorted((v[0], t, v[2] if v[1] else None) for t, v in best.items())[:25]
            assert sorted(t for t, _, _ in got[k, label]) == sorted(t for _, t, _ in want), (k, label)
            assert np.allclose(sorted(p for _, _, p in got[k, label]), sorted(-v for v, _, _ in want), atol=1e-4)


def test_quality_edges(spark):
    """Repeated and null ids, an empty table, labels on one side, clashing columns; scores by the plain formula."""
    from quillmesh.llm.common import setup

    setup(spark)
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string"
    good, bad = [f"a fine line of prose number {i} and more words here" for i in range(60)], [f"%% {i} ## @@ {i} !!" for i in range(60)]
    rows = [(i, t, "en", "s", len(t), 0.0, "x") for i, t in enumerate(good + bad)]
    rows += [(3, "another text of id three", None, None, None, 0.0, "x"), (3, good[3], "en", "s", 1, 0.0, "x"), (None, "no id", "en", None, None, 0.0, "x"), (500, None, None, None, None, 0.0, "x")]
    df = spark.createDataFrame(rows, schema)
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(0, 120, 2)] + [(3, 0), (3, 1), (None, 1), (77, None)], "doc_id long, quality int")
    model = quality.train(df, labels, pool_share=1)
    again = quality.train(df.repartition(5), labels, pool_share=1)
    got = quality.scored(df, model).collect()
    assert len(got) == len(rows)
    plain = quality._views([type("R", (), {"text_": r[1], "lang": r[2], "source": r[3], "n_chars": r[4]}) for r in rows])
    z = [a * v.logit(x) + b for v, x, (a, b) in zip(model.views, plain, model.scales, strict=True)]
    want = 1 / (1 + np.exp(-np.clip(model.weights[0] * z[0] + model.weights[1] * z[1] + model.weights[2], -60, 60)))
    assert np.allclose(sorted(r.score for r in got), np.sort(want), atol=1e-5)
    assert np.allclose(sorted(r.score for r in quality.scored(df, again).collect()), np.sort(want), atol=1e-4)
    none = spark.createDataFrame([], schema)
    assert quality.train(none, labels) is None and quality.train(df, labels.limit(0)) is None
    assert quality.scored(none, model).count() == 0 and quality.scored(none, None).count() == 0


def test_pseudo_labels_are_sought_in_all_other_texts(spark, monkeypatch):
    """Every text that is neither trained on nor held out, and no other, is looked at in each round."""
    from pyspark.sql import functions as F

    from quillmesh.llm.common import setup

    setup(spark)
    rows = [(i, f"a fine line of prose number {i}" if i % 2 else f"%% {i} ## @@") for i in range(240)] + [(None, "no id"), (900, None)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in range(0, 60)], "doc_id long, quality int")
    seen, surest = [], quality.surest
    monkeypatch.setattr(quality, "surest", lambda pool, *rest: seen.append(sorted(r.text_ for r in pool.collect())) or surest(pool, *rest))
    assert quality.train(docs, labels, held_out=lambda i: i >= 200)
    assert len(seen) > 1 and all(x == sorted([t for i, t in rows[60:200]] + ["no id"]) for x in seen)
