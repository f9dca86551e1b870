"""The pipeline's stages against brute force, on odd rows too."""

import base64
import hashlib
import os
import random
import shutil
import subprocess
import sys

import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import tiktoken

import corpus_pipeline
from quillmesh.llm import toxicity
from quillmesh.llm.common import setup, shingle_set
from quillmesh.llm.queries import held_out

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, row long, key_ int"


def prose(seed, n, words=120):
    r = random.Random(seed)
    vocabulary = [f"{r.choice('bcdfg')}{r.choice('aeiou')}{r.choice('lmnrst')}{i % 37}" for i in range(400)]
    return [" ".join(r.choice(vocabulary) for _ in range(r.randrange(40, words))) for _ in range(n)]


@pytest.fixture(scope="module")
def case(spark, tmp_path_factory):
    setup(spark)
    base, items = prose(1, 60), prose(2, 4, 60)
    texts = [*base, *[t.upper() for t in base[:5]], *[f"{t} onemore" for t in base[5:15]], base[20] + " " + items[0], items[1] + " " + base[21], "", None, "LONG " * 50_000]
    rows = [(i, t, "en", "s", 1, "k", 7, 3) for i, t in enumerate(texts)]
    rows += [(None, base[30] + " again", "en", "s", 1, None, 8, 3), (None, base[31], "en", None, None, "k", 9, None), (40, base[32] + " again", None, "s", 2, "k", 1, 1), (40, "a text of its own under a repeated id, long enough", "x", "s", 2, "k", 1, 1), (41, base[41], "en", "s", 1, "k", 7, 3)]
    where = tmp_path_factory.mktemp("data")
    pq.write_table(pa.table({"item_id": pa.array(range(4), pa.int64()), "text": items}), where / "benchmark.parquet")
    return spark.createDataFrame(rows, SCHEMA).repartition(4), str(where)


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def test_exact_stage(spark, case):
    docs, where = case
    got = corpus_pipeline.drop_copies(spark, docs, where)
    assert got.columns == docs.columns
    groups = {}
    for r in docs.collect():
        groups.setdefault(lower(r.text), []).append(r)
    best = {t: max((r.doc_id for r in g if r.doc_id is not None), default=None) for t, g in groups.items()}
    assert sorted(((r.doc_id, lower(r.text)) for r in got.collect()), key=repr) == sorted(((i, t) for t, i in best.items()), key=repr)


def test_near_stage(spark, case):
    docs, where = case
    docs = corpus_pipeline.drop_copies(spark, docs, where).cache()
    rows = docs.collect()
    sets = [set(shingle_set(r.text, 5).tolist()) for r in rows]
    ids = [r.doc_id for r in rows]
    rank = [(ids.count(r.doc_id) > 1 or r.doc_id is None, r.doc_id or 0) for r in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                group = [group[a] if g == group[b] else g for g in group]
    members = {g: [i for i in range(len(rows)) if group[i] == g] for g in group}
    got = corpus_pipeline.drop_near_copies(spark, docs, where)
    assert got.columns == docs.columns
    found = [(r.doc_id, r.text) for r in got.collect()]
    assert len(found) == len(members) == len(set(found))
    for m in members.values():  # one row of each group, the best ranked
        least = min(rank[i] for i in m)
        assert [(rows[i].doc_id, rows[i].text) in found for i in m].count(True) == 1
        assert any((rows[i].doc_id, rows[i].text) in found and rank[i][:1 if least[0] else 2] == least[:1 if least[0] else 2] for i in m)


def test_leak_stage(spark, case):
    docs, where = case
    items = [shingle_set(t, 5) for t in pq.read_table(f"{where}/benchmark.parquet")["text"].to_pylist()]
    got = corpus_pipeline.drop_leaks(spark, docs, where)
    clean = [(r.doc_id, r.text) for r in docs.collect() if not any(100 * len(set(s.tolist()) & set(shingle_set(r.text, 5).tolist())) >= 80 * len(s) for s in items)]
    assert got.columns == docs.columns and len(clean) < docs.count()
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted(clean, key=repr)


def test_encode_stage(spark, case):
    docs, where = case
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f.read().splitlines())}
    enc = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = sorted(((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in docs.select("doc_id", "text").collect() for ids in [enc.encode_ordinary(t or "")]), key=repr)
    got = corpus_pipeline.encode(spark, docs, where)
    assert sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got.collect()), key=repr) == want


def plain_score(model, text):
    """A document's score, one window and one step at a time."""
    p, side, hidden = {k: v.astype(float) for k, v in model.p.items()}, toxicity.SIDE, toxicity.HIDDEN
    import numpy as np

    sig = lambda x: 1 / (1 + np.exp(-x))
    words = toxicity.words_of(text)
    best = -np.inf
    for start in toxicity.window_starts(len(words)):
        window = words[start : start + toxicity.WINDOW]
        x = []
        for w in window:
            rows, _ = toxicity.grams([w])
            x.append(np.concatenate([p["word"][model.rows.get(w, 0)], p["char"][rows].sum(axis=0) / np.sqrt(len(rows))]))
        states = np.zeros((len(window), 2 * hidden))
        for k, d in enumerate("fb"):
            h = np.zeros(hidden)
            for t in range(len(window)) if d == "f" else reversed(range(len(window))):
                g, u = x[t] @ p[f"W{d}"] + p[f"b{d}"], p[f"U{d}"]
                z, q = sig(g[:hidden] + h @ u[:, :hidden]), sig(g[hidden : 2 * hidden] + h @ u[:, hidden : 2 * hidden])
                n = np.tanh(g[2 * hidden :] + q * (h @ u[:, 2 * hidden :]))
                h = h + (1 - z) * (n - h)
                states[t, k * hidden : (k + 1) * hidden] = h
        if len(window):
            e = np.tanh(states @ p["A"]) @ p["a"]
            e = np.exp(e - e.max())
            best = max(best, float((e / e.sum()) @ states @ p["v"] + p["c"][0]))
        else:
            best = max(best, float(p["c"][0]))
    return float(sig(np.clip(model.scale * best + model.shift, -60, 60)))


def test_toxic_stage(spark, tmp_path):
    setup(spark)
    texts = prose(9, 160)
    texts = [t.replace(" ", " vilemoron ", 2) if i % 2 else t for i, t in enumerate(texts)] + ["", None]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "k", 7, 3) for i, t in enumerate(texts)], SCHEMA)
    labels = [(i, 1, i % 2) for i in range(160)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.drop_toxic(spark, docs, str(tmp_path))
    model = toxicity.train(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"), held_out=held_out)
    scores = [plain_score(model, t) for t in texts]
    assert got.columns == docs.columns and {r.doc_id for r in got.collect()} == {i for i, s in enumerate(scores) if s < toxicity.REJECT}
    assert sum(a > b for a in scores[1:160:2] for b in scores[:160:2]) >= 0.93 * 80 * 80 and max(scores[:160:2]) < toxicity.REJECT
    for some in ("toxic = 0", "toxic = 1", "toxic > 5"):  # labels that tell nothing apart reject nothing
        model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int").filter(some))
        assert toxicity.without_toxic(docs, model).count() == len(texts)


def test_stages_of_an_empty_table(spark, case, tmp_path):
    docs, where = case
    none = docs.limit(0)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    os.symlink(f"{where}/benchmark.parquet", tmp_path / "benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0, name
    assert corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).count() == docs.count()


def test_the_rest_imports_without_this_subpackage(tmp_path):
    shutil.copytree(f"{ROOT}/quillmesh", tmp_path / "quillmesh", ignore=lambda *_: {"llm", "__pycache__"})
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 200 and not any(n.startswith('op') or n == 'pipeline' for n in q), len(q); assert set(e.oracle_sql()) <= set(q)"
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
