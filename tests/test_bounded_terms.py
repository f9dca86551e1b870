"""Scans for terms: what a task holds is bounded, and a text is read once."""

import random

import pyarrow as pa

from quillmesh.operators import terms as T
from quillmesh.plans import registry
from quillmesh.session import ship

DATA = "/root/testdata/sf0.001"


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tags_come_from_one_scan_of_the_texts(spark):
    assert physical(registry.QUERIES["r01_rule_tags"](spark, DATA)).count("MapInArrow") == 1


def test_rules_leave_a_task_as_rules_and_not_as_finds(spark):
    """A text with 50,000 finds of two rules gives two rows, before any shuffle."""
    ship(spark)
    df = spark.createDataFrame([(1, "a b " * 25_000)], "id long, text string")
    rules = spark.createDataFrame([("r", "term", "a"), ("r", "pair", "b"), ("q", "term", "b")], "rule string, part string, term string")
    plan = physical(T.rule_parts(df, rules))
    assert "found" not in plan and sorted((x.rule, sorted(x.parts)) for x in T.rule_parts(df, rules).collect()) == [("q", ["term"]), ("r", ["pair", "term"])]


def test_finds_are_handed_on_in_bounded_batches():
    texts = pa.RecordBatch.from_arrays([pa.array(range(500), pa.int64()), pa.array(["a " * 300] * 500)], names=["id", "text"])
    m = T.Terms([("L", "k", "a")])
    kind = {"found": pa.list_(pa.int32())}
    got = list(T._handed_on([texts], lambda t: [([x[0] for x in m.find(t)],)], kind))
    assert max(len(b.column(1).flatten()) for b in got) <= T.AT_ONCE + 300 and sum(len(b) for b in got) == 500
    assert [x for b in got for x in b.column(0).to_pylist()] == list(range(500))


def test_folds_are_the_same_for_one_slice_and_for_several(spark):
    """Regions and countries where each term has an automaton of its own."""
    ship(spark)
    r = random.Random(22)
    words = ["new", "york", "north", "korea", "un"]
    df = spark.createDataFrame([(i, "x", " ".join(r.choice(words) for _ in range(9))) for i in range(200)], "id long, bucket string, text string")
    terms = [(label, kind, " ".join(r.choice(words) for _ in range(r.randrange(1, 3)))) for label in ("a", "b") for kind in ("strong", "weak", "exclude") for _ in range(3)] + [("any", "strip", "un new")]
    table = spark.createDataFrame(terms, "label string, kind string, term string")
    weak = spark.createDataFrame([("a", "x")], "label string, bucket string")
    one, several = (sorted(tuple(x) for x in T.geo_signals(df, table, weak, slice_=n).collect()) for n in (T.SLICE, 2))
    assert one == several and one
    names = table.filter("kind <> 'exclude'").replace({"strong": "name", "weak": "name"}, subset="kind")
    one, several = (sorted(tuple(x) for x in T.countries(df, names, slice_=n).collect()) for n in (T.SLICE, 2))
    assert one == several and one


def test_a_scan_meets_whole_terms_alone():
    """Within words a term is not met at all, and finds stand where a scan of the text as it is has them: beside marks, letters that no edge knows, and plurals that are terms too."""
    r = random.Random(23)
    pieces = ["a", "e", "es", "s", "as", "ß", "æ", "é", "S$", "5", ".", " ", " ", "\x00", "x"]
    met = 0
    for k in range(300):
        terms = [("L", "k", "".join(r.choice(pieces) for _ in range(r.randrange(1, 4)))) for _ in range(8)]
        text = "".join(r.choice(pieces[: 13 if k % 4 else 15]) for _ in range(60))
        for cased in (False, True):
            m = T.Terms(terms, plural=True, cased=cased)
            base = m.read(text)
            want = []
            for key in m.by_term:
                for at in range(len(base)):
                    if base.startswith(key, at) and (span := m._span(base, at + len(key) - 1, key)):
                        want.append((*span, len(key), "L", "k", key))
            got = m.find(text)
            assert sorted(got) == sorted(want), (terms, text)
            met += len(got)
    assert met > 2000
    m = T.Terms([("L", "k", "a")], plural=True)
    assert sum(1 for _ in m.marked.iter(m.run.sub(T.RUN, "banana as alaska a"))) == 2
