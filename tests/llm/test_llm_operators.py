"""The training-data operators against brute force, round trips and edge cases."""

import collections
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillmesh.llm import bpe_tokens, difference_cover, quality, sstable, toxicity
from quillmesh.llm.common import scratch, setup, shingle_set
from quillmesh.llm.decontaminate import contained_items, without_items
from quillmesh.llm.exact_dedup import exact_dedup
from quillmesh.llm.html_text import extract
from quillmesh.llm.minimax_shards import Sizes, minimax_cuts, minimax_shards
from quillmesh.llm.suffix_dedup import suffix_dedup
from quillmesh.llm.tensor_minhash import half_keys, minhash_dedup, side_for

LONG = "word " * 60_000
DOCS = [(1, "A b c"), (2, "a B c"), (3, None), (4, ""), (5, "x"), (None, "A b c"), (None, "lone one"), (6, "same same"), (6, "same same"), (7, LONG)]


@pytest.fixture(scope="module")
def docs(spark):
    setup(spark)
    df = spark.createDataFrame(DOCS, "doc_id long, text string")
    return df.withColumn("digest", F.lit(1)).withColumn("key", F.lit("k")).withColumn("n", F.lit(None).cast("long"))


@pytest.fixture(scope="module")
def empty(spark):
    setup(spark)
    return spark.createDataFrame([], "doc_id long, text string")


def prose(seed, n, words=300):
    r = random.Random(seed)
    vocabulary = [f"{r.choice('bcdfg')}{r.choice('aeiou')}{r.choice('lmnrst')}{i % 37}" for i in range(400)]
    return [" ".join(r.choice(vocabulary) for _ in range(r.randrange(5, words))) for _ in range(n)]


# 1: token shards


def test_shards_round_trip(spark, docs):
    js = open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()
    t = Tokenizer.from_str(js)
    texts = [(i, x) for i, x in enumerate(prose(1, 60))] + [(100, "Ünïcode—tests, it's <|endoftext|> x<|endoftext|>%%% ÉTÉ 'S !!'s a1b2\n\n\tİ ﬁ²"), (101, None), (None, "null id")]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(7)
    where = scratch(spark, "sst")
    manifest = sstable.write_shards(df, where, spark.sparkContext.broadcast(js), 2, width=2, drops_blanks=True)
    got = {r.doc_id: r for r in sstable.read_shards(manifest, where).collect()}
    at = 0
    for i, x in sorted(texts, key=lambda p: sstable.key_of(p[0])):
        ids = t.encode(x or "", add_special_tokens=False).ids + [2]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), i
        assert sstable.lookup(manifest, where, i) == [ids]
        at += len(ids)
    assert sstable.lookup(manifest, where, 55_555) == []


def test_remembered_chunks_give_the_library_ids():
    """Composed, decomposing, case-expanding and combining characters before and after punctuation."""
    js = open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()
    t, r = Tokenizer.from_str(js), random.Random(17)
    ids = sstable.encoder(js, 4, drops_blanks=True)
    want = lambda text: np.array(t.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    for text in ("\u0130*", "\u09af\u09bc,", "\u09df,", "\u095c?", "\u0958.", "\u00e9.", "e\u0301.", "\ufb01!", "\u1e9e;", "\u212b:", "\u03a3.", "x\u0345.", "a \u0301b"):
        assert ids(text) == want(text), text
    odd = [chr(c) for c in (0x130, 0x149, 0x1F0, 0x300, 0x301, 0x327, 0x345, 0x3A3, 0x958, 0x95C, 0x9DC, 0x9DF, 0x9BC, 0xA59, 0xB5C, 0xF43, 0x1E9E, 0x212B, 0x2126, 0xAC00, 0x1100, 0x1161, 0xFB01, 0xFB1D, 0x1D15E, 0x200D, 0xA0)]
    pieces = [*odd, *"aZz09'", *sstable.ChunkIds.TAIL, "-", "_", " ", "\n", "\t", "word", "ÉT"]
    for _ in range(20_000):
        text = "".join(r.choice(pieces) for _ in range(r.randrange(1, 9)))
        assert ids(text) == want(text), ascii(text)


def test_shards_spread_rows_of_one_id(spark):
    js = spark.sparkContext.broadcast(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read())
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, f"text {i}") for i in range(600)]
    where = scratch(spark, "sst")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    manifest = sstable.write_shards(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), where, js, 2, drops_blanks=True)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = sorted(sstable.read_shards(manifest, where).collect(), key=lambda x: x.start)
    assert len({x.file for x in got if x.doc_id is None}) > 1 and len({x.file for x in got if x.doc_id == 7}) > 1
    assert [sstable.key_of(x.doc_id) for x in got] == sorted(sstable.key_of(i) for i, _ in rows)
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:], strict=False)) and got[0].start == 0
    assert len(sstable.lookup(manifest, where, 7)) == 200 and len(sstable.lookup(manifest, where, None)) == 200


def test_shards_of_odd_rows(spark, docs, empty):
    js = spark.sparkContext.broadcast(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read())
    assert sstable.token_shards(docs, js, 2, drops_blanks=True).count() == len(DOCS)
    assert sstable.token_shards(empty, js, 2, drops_blanks=True).count() == 0


# 2: HTML


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("plain  text", "plain text"),
        ("<p>a<p>b", "a\n\nb"),
        ("<div>a</div><div>b</div>", "a\nb"),
        ("<ul><li>x<li>y<ol start=3><li>q</ol></ul>", "- x\n- y\n  3. q"),
        ("<table><tr><th>Name<th>N<tr><td>Longer<td>1<br>2</table>", "Name   | N\nLonger | 1\n       | 2"),
        ("<table><tr><td colspan=2>wide cell<tr><td>a<td>b</table>", "wide cell\na | b"),
        ("<p>a<span hidden>no</span><b style='DISPLAY: none'>no</b>b<script>if (a<b) x()</script>", "ab"),
        ("<pre>a\n  b</pre>x", "a\n  b\n\nx"),
        ("a &amp; b&nbsp;&lt;c&gt; &copy;", "a & b <c> ©"),
        ("<a href='x>y'>link</a><!-- c --><br><br>next", "link\n\nnext"),
        ("<title>t</title><body>x<textarea>no</textarea>", "xno"),
        ("<" * 5, "<<<<<"),
    ],
)
def test_html(page, text):
    assert extract(page) == text


def test_html_depth_and_junk():
    assert extract("<div>" * 50_000 + "x") == "x"
    r = random.Random(2)
    for _ in range(200):
        extract("".join(r.choice(["<p>", "</p>", "<td>", "<tr>", "</table>", "<table>", "<li>", "</ul>", "x ", "<b", "'", ">", "&#x41;", "<!--"]) for _ in range(60)))


# 3: near-dedup


def test_minhash_matches_brute_force(spark):
    r = random.Random(4)
    base = prose(5, 40, 120)
    texts = list(base)
    for t in base[:15]:
        for _ in range(4):
            w = t.split()
            for _ in range(max(1, len(w) // r.choice((12, 25, 60)))):
                w[r.randrange(len(w))] = f"edit{r.randrange(10**6)}"
            texts.append(" ".join(w))
    texts += texts[:5] + ["", None, "one", "one two", "ONE TWO"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [set(shingle_set(t, 3).tolist()) for t in texts]
    label = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = label[a], label[b]
                label = [min(x, y) if v in (x, y) else v for v in label]
    got = {r.doc_id: r for r in minhash_dedup(df, words=3, percent=85).collect()}
    assert [got[i].component_id for i in range(len(texts))] == label
    assert [got[i].n_shingles for i in range(len(texts))] == [len(s) for s in sets]
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_minhash_edges(docs, empty):
    got = minhash_dedup(docs).collect()
    assert len(got) == len(DOCS)
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[1].kept and by[2].component_id == 1 and by[3].kept and by[4].kept and by[3].n_shingles == 0
    assert minhash_dedup(empty).count() == 0


def test_minhash_joins_a_large_group_in_few_rows(spark, monkeypatch):
    """5000 near copies of one text: links stay in proportion to the documents, not to their pairs."""
    from quillmesh.llm import tensor_minhash as module

    r, words = random.Random(30), [f"w{i}" for i in range(150)]
    texts = []
    for i in range(5000):
        w = list(words)
        for _ in range(1 + (i % 20 == 7) * 2):  # a few are too far from the others
            w[r.randrange(150)] = f"x{i} {r.random()}"
        texts.append(" ".join(w))
    handed = []
    real = module.components
    monkeypatch.setattr(module, "components", lambda links: handed.append(links.count()) or real(links))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    sizes = sorted(x["count"] for x in minhash_dedup(df).groupBy("component_id").count().collect())
    assert sizes[-1] >= 4750 and sum(sizes) == 5000 and sum(handed) <= 2 * len(texts)


@pytest.mark.parametrize("block", [7, 1024])
def test_minhash_later_rounds_lose_no_link(spark, monkeypatch, block):
    from quillmesh.llm import tensor_minhash as module

    monkeypatch.setattr(module, "BLOCK", block)
    monkeypatch.setattr(module, "HUBS", 5)
    r = random.Random(31)
    core = [f"core{i}" for i in range(60)]
    texts = []
    for i in range(60):  # all share much, few enough for a link
        w = core + [f"own{i} own{i}x{j}" for j in range(14)]
        texts.append(" ".join(w))
        if i % 3 == 0:
            texts.append(" ".join(w[: len(w) - r.randrange(4)]))
    sets = [set(shingle_set(t, 5).tolist()) for t in texts]
    label = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = label[a], label[b]
                label = [min(x, y) if v in (x, y) else v for v in label]
    got = {x.doc_id: x.component_id for x in minhash_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(texts))] == label


def test_minhash_deals_texts_only_where_a_comparison_is_due(spark, monkeypatch):
    """Members of an open bucket that share a table's key with none there are not dealt with their texts."""
    from quillmesh.llm import tensor_minhash as module

    r = random.Random(33)
    core = [f"core{i}" for i in range(60)]
    texts = []
    for i in range(120):  # far from each other, but many share a half key
        w = core + [f"own{i}x{j}" for j in range(60)]
        texts.append(" ".join(w))
        if i % 4 == 0:
            texts.append(" ".join(w[: len(w) - r.randrange(1, 4)]))
    side = side_for(80)
    sets = [shingle_set(t, 5) for t in texts]
    halves = np.array([half_keys(x, side) for x in sets])
    meet = (halves[:, None, side:] == halves[None, :, side:]).any(axis=2)
    want = set()
    for a, b in zip(*np.nonzero(np.triu(meet, 1)), strict=True):
        want |= {(int(k), int(x)) for k in halves[a, :side][halves[a, :side] == halves[b, :side]] for x in (a, b)}
    dealt = set()
    real = module.block_joins
    monkeypatch.setattr(module, "block_joins", lambda rows, *rest: dealt.update((x.key, x.rep) for x in rows.select("key", "rep").collect()) or real(rows, *rest))
    got = {x.doc_id: x.component_id for x in minhash_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert dealt and dealt <= want
    full = [set(x.tolist()) for x in sets]
    label = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if 100 * len(full[a] & full[b]) >= 80 * len(full[a] | full[b]):
                x, y = label[a], label[b]
                label = [min(x, y) if v in (x, y) else v for v in label]
    assert [got[i] for i in range(len(texts))] == label


@pytest.mark.parametrize("among", [True, False])
def test_compared_rows_are_those_of_all_pairs(among):
    from quillmesh.llm.tensor_minhash import compared

    for seed in range(40):
        r = np.random.default_rng(seed)
        n, side, slot = 40, 4, 1
        halves = r.integers(0, 12, (n, 2 * side))
        halves[:, slot] = 99
        component, hubs, size = r.integers(0, 9, n), r.random(n) < 0.3, r.integers(0, 12, n)
        want = np.zeros(n, bool)
        for a in range(n):
            for b in range(n):
                shares = halves[a] == halves[b]
                if hubs[a] and a != b and (among or not hubs[b]) and component[a] != component[b] and min(size[a], size[b]) > 0 and 100 * min(size[a], size[b]) >= 80 * max(size[a], size[b]) and shares[side:].any() and not shares[:slot].any():
                    want[[a, b]] = True
        assert (compared(component, hubs, halves, slot, size, 80, among) == want).all() and want.any() and not want.all()


def test_half_keys_miss_rate():
    r = np.random.default_rng(3)
    side, missed = side_for(85), 0
    for _ in range(300):
        both, a, b = (r.integers(0, 2**63, n).astype(np.uint64) for n in (170, 15, 15))
        x, y = half_keys(np.concatenate([both, a]), side), half_keys(np.concatenate([both, b]), side)
        missed += not ((x[:side] == y[:side]).any() and (x[side:] == y[side:]).any())
    assert missed <= 2


# 4, 7: classifiers


def test_quality_learns_and_scores_all(spark, docs):
    setup(spark)
    good, bad = prose(7, 120), [" ".join(f"{w}%%% ###" for w in t.split()) for t in prose(8, 120)]
    rows = [(i, t, "en", f"src{i % 3}", len(t)) for i, t in enumerate(good + bad)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, int(i < 120)) for i in range(240) if i % 2], "doc_id long, quality int")
    model = quality.train(df, labels)
    got = {r.doc_id: r for r in quality.scored(df, model).collect()}
    assert sum(got[i].kept == (i < 120) for i in range(240)) >= 236
    assert quality.scored(docs, model).count() == len(DOCS)
    assert quality.train(df, labels.filter("quality = 1")) is None
    assert quality.scored(docs, None).filter("kept").count() == len(DOCS)


def test_toxicity_gradients():
    m = toxicity.Model(["a"], 1)
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    r = np.random.default_rng(0)
    x, index, mask = r.standard_normal((30, 2 * toxicity.SIDE)), r.integers(0, 30, (4, toxicity.WINDOW)), np.ones((4, toxicity.WINDOW))
    mask[1, 20:] = 0
    delta = r.standard_normal(4)
    _, kept = m.run(m.project(x), index, mask, True)
    g, _ = m.gradients(x, index, mask, delta, kept)
    for name, value in g.items():
        at = tuple(r.integers(0, s) for s in value.shape)
        old = m.p[name][at]
        sides = []
        for e in (1e-3, -1e-3):
            m.p[name][at] = old + e
            sides.append(float((m.run(m.project(x), index, mask)[0] * delta).sum()))
        m.p[name][at] = old
        assert abs((sides[0] - sides[1]) / 2e-3 - value[at]) < 1e-3, name


def test_toxicity_learns_and_scores_whole_texts(spark, docs, empty, monkeypatch):
    texts = prose(9, 160, 120)
    toxic = [t.replace(" ", " vilemoron ", 1 + i % 3) for i, t in enumerate(texts[:80])]
    model = toxicity.fit(toxic + texts[80:], [1] * 80 + [0] * 80)
    scorer = toxicity.Scorer(model)
    late = " ".join(prose(10, 40)) * 3 + " vilemoron"
    scores = scorer.score([late, " ".join(prose(10, 40)), "", None, toxic[0]])
    assert scores[0] > 0.5 > scores[1] and scores[2] == scores[3] and ((0 <= scores) & (scores <= 1)).all()
    monkeypatch.setattr(toxicity.Scorer, "BOUND", 1000)
    monkeypatch.setattr(toxicity.Scorer, "STEP", 8)
    assert np.allclose(toxicity.Scorer(model).score([late, texts[3], "", None, toxic[0]] + texts), scorer.score([late, texts[3], "", None, toxic[0]] + texts), atol=1e-5)
    assert toxicity.scored(docs, model).count() == len(DOCS) and toxicity.scored(empty, model).count() == 0
    kept = toxicity.without_toxic(docs, model)
    assert kept.columns == docs.columns


def test_windows_cover_all_words():
    for n in (0, 1, 31, 32, 33, 56, 57, 500):
        index, mask = toxicity.windows_of(np.arange(n))
        assert set(index[mask > 0].tolist()) == set(range(n))


# 5: BPE


@pytest.fixture(scope="module")
def enc():
    return bpe_tokens.encoding(open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read(), public_tokenizers.PATTERN)


def test_bpe_pieces_give_whole_ids(enc):
    r = random.Random(6)
    pieces = ["abc", " ", "\n", "  ", "'s", "’", "é", "12", "!?", "　", "\x1c", "日本", " \n ", "'"]
    for _ in range(300):
        text = "".join(r.choice(pieces) for _ in range(r.randrange(120)))
        for size in (5, 20):
            assert bpe_tokens.encode(enc, text, size) == enc.encode_ordinary(text)
        assert enc.decode_bytes(bpe_tokens.encode(enc, text, 5)) == text.encode()


def test_bpe_long_runs(enc, monkeypatch):
    monkeypatch.setattr(bpe_tokens, "LONG_RUN", 8)
    monkeypatch.setattr(bpe_tokens, "RUN", __import__("re").compile(f"[{bpe_tokens.BLANK}]{{8,}}"))
    for text in ("a" + " " * 20 + "b", " " * 30, "x" + "\n \t" * 9 + "1", "q" + " " * 12 + "\nend", "a" + " " * 15 + "!"):
        assert bpe_tokens.encode(enc, text) == enc.encode_ordinary(text)


def test_bpe_very_long_texts(enc):
    for text in (" " * 2_000_000 + "x", "\n \n" * 400_000, "a" * 300_000, LONG):
        assert enc.decode_bytes(bpe_tokens.encode(enc, text)) == text.encode()
    assert regex.findall(public_tokenizers.PATTERN, "a  b") == ["a", " ", " b"]


def test_bpe_rows(spark, docs, empty):
    ranks = bpe_tokens.rank_file(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    got = bpe_tokens.encode_decode(docs, ranks, public_tokenizers.PATTERN).collect()
    assert collections.Counter(r.decoded_sha256 for r in got) == collections.Counter(hashlib.sha256((t or "").encode()).hexdigest() for _, t in DOCS)
    assert all(r.ids_sha256 == hashlib.sha256(" ".join(map(str, r.ids)).encode()).hexdigest() for r in got)
    assert bpe_tokens.encode_decode(empty, ranks, public_tokenizers.PATTERN).count() == 0
    assert isinstance(tiktoken.__version__, str)


# 6: exact dedup


def brute_groups(rows):
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups["".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")].append(i)
    out = []
    for ids in groups.values():
        keep = max((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), i == keep) for i in ids]
    return sorted(out, key=repr)


def test_exact_dedup(spark, docs, empty):
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup(docs.select("doc_id", "text")).collect()), key=repr)
    assert got == brute_groups(DOCS)
    assert exact_dedup(empty).count() == 0


@pytest.mark.parametrize("column", ["keep_id", "norm_", "hot_key", "salts", "key_", "group_size", "text_", "salt_", "kept", "digest_", "row"])
def test_exact_dedup_keeps_columns_of_clashing_names(spark, column):
    df = spark.createDataFrame([(1, "A", 5), (2, "a", 6), (3, "b", None)], f"doc_id long, text string, `{column}` long")
    got = exact_dedup(df, with_row=True).filter("kept").select("row.*")
    assert got.columns == df.columns and sorted(map(tuple, got.collect())) == [(2, "a", 6), (3, "b", None)]


def test_exact_dedup_survives_colliding_digests(spark):
    rows = [(i, f"t{i % 23}") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    weak = lambda x: F.unhex(F.substring(F.sha2(x, 256), 1, 1))
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup(df, digest=weak).collect()), key=repr)
    assert got == brute_groups(rows)


def test_exact_dedup_hot_group(spark):
    rows = [(i, "Hot" if i % 3 else f"cold {i}") for i in range(3000)]
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert got == brute_groups(rows)


# 8: sharding


def best_capacity(sizes, k):
    low, high = max(sizes), sum(sizes)
    while low < high:
        mid, parts, at = (low + high) // 2, 1, 0
        for s in sizes:
            if at + s > mid:
                parts, at = parts + 1, 0
            at += s
        low, high = (low, mid) if parts <= k else (mid + 1, high)
    return low


def test_minimax_is_the_best_capacity():
    r = random.Random(8)
    for _ in range(200):
        sizes, k, block = [r.choice((1, 3, 10, 90)) * r.randrange(1, 9) for _ in range(r.randrange(1, 60))], r.randrange(1, 9), r.randrange(1, 7)
        blocks = [sizes[i : i + block] for i in range(0, len(sizes), block)]
        found = Sizes([sum(b) for b in blocks], lambda i, blocks=blocks: blocks[i])
        capacity, cuts = minimax_cuts(found, k, max(sizes))
        ends = [0, *cuts, sum(sizes)]
        assert capacity == best_capacity(sizes, k) and len(cuts) == k - 1
        assert all(0 <= b - a <= capacity for a, b in zip(ends, ends[1:], strict=False))
        assert set(cuts) <= {0, *np.cumsum(sizes).tolist()}


def test_shards_of_rows(spark, docs, empty):
    rows = [(i, "hot" * 50 if i % 3 == 0 else f"text {i % 70} " * (i % 9)) for i in range(900)]
    got = minimax_shards(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), 8).collect()
    text, shard_of, slots = dict(rows), {}, collections.defaultdict(list)
    for r in got:
        assert r.size == len(text[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode())
        assert shard_of.setdefault(text[r.doc_id], r.shard) == r.shard
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and sum(map(len, slots.values())) == 900
    assert minimax_shards(docs, 8).count() == len(DOCS) and minimax_shards(empty, 8).count() == 0


# 9: suffix dedup


def brute_removed(rows):
    seen = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - 49):
            s = b[p : p + 50]
            seen[s] = min(seen.get(s, i), i)
    out = {}
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - 49):
            if seen[b[p : p + 50]] < i:
                gone[p : p + 50] = True
        gone = gone[:-1]
        spans = int((gone[1:] & ~gone[:-1]).sum()) + int(bool(len(gone)) and bool(gone[0]))
        out[i] = (len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    return out


def test_difference_cover_order():
    r = np.random.default_rng(1)
    for n in list(range(40)) * 2:
        s = r.integers(1, 4, n).astype(np.int64)
        assert difference_cover.suffix_order(s).tolist() == sorted(range(n), key=lambda i: s[i:].tolist())


@pytest.mark.parametrize("hot", [65_536, 2])
def test_suffix_dedup_matches_brute_force(spark, monkeypatch, hot):
    from quillmesh.llm import suffix_dedup as module

    monkeypatch.setattr(module, "ANCHOR_ROWS", hot)
    base = prose(11, 30, 90)
    r = random.Random(12)
    common = "a passage that a good many documents share, word for word, é and all the rest of it. "
    texts = base + [t[: len(t) // 2] + common + t[len(t) // 2 :] for t in base[:12]] + base[:3] + [common, common * 3, "z" * 300, "z" * 120, "", None, "short"]
    r.shuffle(texts)
    rows = list(enumerate(texts))
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert got == brute_removed(rows)


def test_suffix_dedup_edges(docs, empty):
    got = suffix_dedup(docs).collect()
    assert len(got) == len(DOCS) and sum(r.doc_id is None for r in got) == 2
    assert suffix_dedup(empty).count() == 0


# 10: decontamination


def brute_contained(docs, items, k=5, percent=80):
    def shingles(t, n):
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}, len(w)

    out = []
    for item, t in items:
        n = min(k, shingles(t, 1)[1])
        if not n:
            continue
        s = shingles(t, n)[0]
        for doc, text in docs:
            both = len(s & shingles(text, n)[0])
            if 100 * both >= percent * len(s):
                out.append((doc, item, len(s), both))
    return sorted(out)


def test_contained_items_match_brute_force(spark, monkeypatch):
    from quillmesh.llm import decontaminate as module

    r = random.Random(13)
    items = [(i, t) for i, t in enumerate(prose(14, 25, 60))] + [(90, "two words"), (91, ""), (92, None), (93, "Three Odd words"), (94, "solo")]
    docs = [(i, t) for i, t in enumerate(prose(15, 60, 200))]
    for i in range(0, 50, 2):
        w = (items[i % 25][1]).split()
        for _ in range(r.randrange(3)):
            w[r.randrange(len(w))] = "changed"
        docs[i] = (i, docs[i][1] + " " + " ".join(w).upper() + " tail two words three odd words")
    docs += [(70, None), (71, ""), (72, "solo")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = brute_contained(docs, items)
    for words in (1_000_000, 200):  # one block, then several
        monkeypatch.setattr(module, "BLOCK_WORDS", words)
        assert sorted((x.doc_id, x.item_id, x.n_item, x.n_shared) for x in contained_items(d, b).collect()) == want
        assert {x.doc_id for x in without_items(d, b).collect()} == {i for i, _ in docs} - {i for i, *_ in want}
    assert contained_items(d, b.limit(0)).count() == 0 and without_items(d.limit(0), b).count() == 0


@pytest.mark.parametrize("step", [192 << 10, 70])
def test_suffix_dedup_of_long_texts_in_pieces(spark, monkeypatch, step):
    from quillmesh.llm import suffix_dedup as module

    monkeypatch.setattr(module, "STEP", step)
    base = prose(41, 8, 400)
    rows = list(enumerate([*base, base[1][30:700] + " new " + base[2], "q" * 500, base[0] + base[3], "q" * 130, *base[:2]]))
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == brute_removed(rows)


def test_suffix_dedup_rows_between_chunks_and_bins():
    from quillmesh.llm.suffix_dedup import layout

    for total in (0, 10**9, 10**11, 10**12, 10**13, 10**14):
        chunks, bins = layout(total)
        assert chunks * bins * 1024 <= max(total, 12 * 12 * 1024) * 1.01 and 4 * total / 13 / bins < 500e6


def test_suffix_arrays_stay_short_however_many_contexts_an_anchor_has(monkeypatch):
    """Against all strings in Python: masks are the same, and no array is much longer than ARRAY_BYTES."""
    from quillmesh.llm import suffix_dedup as module

    r = np.random.default_rng(51)
    some = [bytes(r.integers(97, 123, module.GRAM, np.uint8)) for _ in range(3000)]
    cores = sorted(some, key=lambda g: int(module.gram_hashes(np.frombuffer(g, np.uint8))[0]) >> 32)[:2]  # of low hashes, so anchors
    found = {}
    for i in range(1200):
        core = cores[i % 5 == 0]
        left, right = (bytes(r.choice([98, 99], 4, p=[0.8, 0.2]).astype(np.uint8)) * 7 for _ in range(2))
        text = left[: r.integers(29)] + core + right[: r.integers(29)]
        for _, a, b, _, h in module.anchors([text]):
            for x, y, z in zip(a.tolist(), b.tolist(), h.tolist(), strict=True):
                found.setdefault((z, text[x : y + 50]), i)
    found = dict(sorted(found.items(), key=lambda e: e[0]))
    contexts, first, group = [c for _, c in found], np.array(list(found.values())), np.array([h % 2**62 for h, _ in found])
    assert max(np.unique(group, return_counts=True)[1]) > 200
    least = {}
    for c, i in zip(contexts, first.tolist(), strict=True):
        for p in range(len(c) - 49):
            least[c[p : p + 50]] = min(least.get(c[p : p + 50], i), i)
    want = [sum((least[c[p : p + 50]] < i) << p for p in range(len(c) - 49)) for c, i in zip(contexts, first.tolist(), strict=True)]
    assert sum(w > 0 for w in want) > 50
    order, longest = module.suffix_order, []
    monkeypatch.setattr(module, "suffix_order", lambda s, levels: longest.append(len(s)) or order(s, levels))
    for size in (1 << 20, 4000, 600):
        monkeypatch.setattr(module, "ARRAY_BYTES", size)
        longest.clear()
        assert module.bounded_masks(contexts, first, group).tolist() == want
        assert max(longest) <= 1.1 * size
