"""Terms and rules over texts against regular expressions and plain loops."""

import random
import re

import duckdb
import pytest

from quillmesh.operators import terms as T
from quillmesh.plans import registry
from quillmesh.session import ship

DATA = "/root/testdata/sf0.001"
PIECES = ["new", "york", "papua", "guinea", "north", "korea", "s", "es", "un", "u", "a", "b", "ab", "é", "S$", "5", ".", "-", "koreas", "The"]


def random_terms(r, n, labels, kinds):
    return sorted({(r.choice(labels), r.choice(kinds), " ".join(r.choice(PIECES) for _ in range(r.randrange(1, 4)))) for _ in range(n)})


def texts(r, n):
    return [r.choice([" ", "  ", ""]).join(r.choice(PIECES) + r.choice([" ", "", ",", "s ", "es ", "—"]) for _ in range(r.randrange(0, 30))) for _ in range(n)] + [""]


def alternation(terms, cased=False, plural=True):
    """The terms as one pattern, longest first; an edge that is a letter or digit touches no other."""
    word = "A-Za-z0-9" if cased else "a-z0-9"
    keys = {T.plain_text(t) if cased else T.plain_text(t).lower() for t in terms} - {""}
    alts = []
    for k in sorted(keys, key=lambda k: (-len(k), k)):
        head = f"(?<![{word}])" if k[0].isalnum() else ""
        tail = ("(?:s|es)?" if plural else "") + f"(?![{word}])" if k[-1].isalnum() else ""
        alts.append(f"{head}(?:{re.escape(k)}){tail}")
    return re.compile("|".join(alts)) if alts else None


@pytest.fixture(scope="module")
def case(spark):
    ship(spark)
    r = random.Random(20)
    rows = [(i, r.choice(["x", "y", None]), t) for i, t in enumerate(texts(r, 250))] + [(900, "x", None)]
    return r, rows, spark.createDataFrame(rows, "id long, bucket string, text string").repartition(3)


@pytest.mark.parametrize("slices", [T.SLICE, 7])
def test_countries_are_consumed_longest_first(spark, case, slices):
    r, rows, df = case
    terms = random_terms(r, 25, ["PG", "KP", "US", "SG"], ["name"]) + random_terms(r, 4, ["any"], ["strip"])
    names = {}
    for label, kind, term in terms:
        names.setdefault(T.plain_text(term).lower(), set()).add(label) if kind == "name" else None
    cut, find = alternation([t for _, k, t in terms if k == "strip"]), alternation([t for _, k, t in terms if k == "name"])
    want = set()
    for i, _, text in rows:
        base = T.plain_text(text).lower()
        gone = [m.span() for m in cut.finditer(base)]
        at = 0
        while m := find.search(base, at):
            if any(a < m.end() and m.start() < b for a, b in gone):
                at = m.start() + 1  # what is left of such a place is tried in the next test
                continue
            key = next(k for k in (m[0], m[0].removesuffix("s"), m[0].removesuffix("es")) if k in names)
            want |= {(i, c) for c in names[key]} if len(names[key]) == 1 else {(i, min(names[key]))}
            at = m.end()
    some = spark.createDataFrame(terms, "label string, kind string, term string")
    got = {(x.id, x.country) for x in T.countries(df, some, slice_=slices).collect()}
    clear = {i for i, _, text in rows if not cut.search(T.plain_text(text).lower())}
    assert {x for x in got if x[0] in clear} == {x for x in want if x[0] in clear} and len(clear) > 100
    assert not any(i == 900 for i, _ in got)


def test_finds_are_those_of_each_term_alone():
    r = random.Random(21)
    for cased in (False, True):
        for _ in range(60):
            terms = random_terms(r, 12, ["L"], ["k"])
            text = texts(r, 1)[0]
            m = T.Terms(terms, plural=True, cased=cased)
            base = m.read(text)
            want = set()
            for _, _, term in terms:
                key = m.read(term)
                if key:
                    p = alternation([term], cased)
                    want |= {(a.start(), a.end(), key) for k in range(len(base)) if (a := p.match(base, k))}
            assert {(s, e, t) for s, e, _, _, _, t in m.find(text)} == want, (terms, text)


def test_regions_with_strip_exclude_and_weak(spark, case):
    """Phrases are cut out, then each region's exclusions; terms are looked for in what is left."""
    r, rows, df = case
    terms = random_terms(r, 30, ["asia", "us", "world"], ["strong", "weak", "exclude"]) + random_terms(r, 3, ["any"], ["strip"])
    of = lambda label, kind: [t for x, k, t in terms if k == kind and x in (label, "any")]

    def cut_spans(pattern, base, before):
        out, at = [], 0
        while pattern and (m := pattern.search(base, at)):
            if any(a < m.end() and m.start() < b for a, b in before):
                at = m.start() + 1
                continue
            out.append(m.span())
            at = m.end()
        return out

    want = set()
    for i, bucket, text in rows:
        base = T.plain_text(text).lower()
        strip = cut_spans(alternation(of("any", "strip")), base, [])
        for label in ("asia", "us", "world"):
            gone = strip + cut_spans(alternation(of(label, "exclude")), base, strip)

            def first(kind, label=label, gone=gone, base=base):
                hits = [(m.start(), -len(k), k) for t in of(label, kind) if (k := T.plain_text(t).lower()) for s in range(len(base)) if (m := alternation([t]).match(base, s)) and not any(a < m.end() and m.start() < b for a, b in gone)]
                return min(hits)[2] if hits else None

            if (hit := first("strong")) is not None:
                want.add((i, label, hit))
            elif bucket == "x" and label != "us" and (hit := first("weak")) is not None:
                want.add((i, label, f"weak:{hit}"))
    table = spark.createDataFrame(terms, "label string, kind string, term string")
    weak = spark.createDataFrame([("asia", "x"), ("world", "x"), ("world", "x")], "label string, bucket string")
    got = [tuple(x) for x in T.geo_signals(df, table, weak).collect()]
    assert sorted(got) == sorted(want)


def test_rules_of_terms_pairs_and_exclusions(spark, case):
    r, rows, df = case
    rules = sorted({(f"r{r.randrange(8)}", r.choice(["term", "pair", "exclude"]), " ".join(r.choice(PIECES[:13]) for _ in range(r.randrange(1, 3)))) for _ in range(40)})
    want = set()
    for i, _, text in rows:
        hay = T.folded_words(text).split()
        has = lambda term, hay=hay: (n := T.folded_words(term).split()) and any(hay[k : k + len(n)] == n for k in range(len(hay)))
        for rule in {x[0] for x in rules}:
            part = lambda p, rule=rule: [t for x, k, t in rules if x == rule and k == p]
            if any(map(has, part("term"))) and (not part("pair") or any(map(has, part("pair")))) and not any(map(has, part("exclude"))):
                want.add((i, rule))
    table = spark.createDataFrame(rules, "rule string, part string, term string")
    for slices in (T.SLICE, 5):
        got = [tuple(x) for x in T.matched_rules(df, table, fold=T.folded_words, whole=False, slice_=slices).collect()]
        assert sorted(got) == sorted(want)
    assert want and T.matched_rules(df, table.limit(0)).count() == 0 and T.matched_rules(df.limit(0), table).count() == 0


def test_folded_words():
    assert T.folded_words("Korea's movies’ CLASSES, Éclairs tie") == " korea movy classe eclair tie "
    assert T.folded_words(None) == T.folded_words(" -- ") == ""


@pytest.mark.parametrize("name", ["r05_region_terms", "r06_country_names"])
def test_queries_over_the_tables(spark, name):
    got = registry.QUERIES[name](spark, DATA).collect()
    docs = {i: T.plain_text(t).lower() for i, t in duckdb.sql(f"select doc_id, text from '{DATA}/documents.parquet'").fetchall()}
    assert got and all(x.term.removeprefix("weak:") in docs[x.id] for x in got if "term" in x)
