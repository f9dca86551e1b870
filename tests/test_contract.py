"""The schema engine, thumbs and shards against plain loops."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quillmesh.operators.contract import event_faults, reference_faults, schema_faults
from quillmesh.plans.profile import profile_faults, thumbs
from quillmesh.plans.sinks import reserve

SCHEMA = {
    "$defs": {"part": {"type": "object", "required": ["n"], "additionalProperties": False, "properties": {"n": {"type": "integer", "minimum": 0}, "s": {"type": "string", "maxLength": 2}}}},
    "type": "object",
    "required": ["a"],
    "properties": {"a": {"type": ["array", "null"], "items": {"$ref": "#/$defs/part"}, "maxItems": 2, "uniqueItems": True}, "b": {"enum": [1, "é", None, True]}, "c": {"type": "number"}},
    "additionalProperties": {"type": "boolean"},
}
TYPES = {"object": dict, "array": list, "string": str, "null": type(None), "boolean": bool}


def of_type(v, name):
    if name in ("integer", "number"):
        return not isinstance(v, bool) and isinstance(v, int if name == "integer" else (int, float))
    return isinstance(v, TYPES[name])


def plain(v, s, path="$"):
    """The faults by recursion over Python values."""
    s = SCHEMA["$defs"]["part"] if "$ref" in s else s
    names = [s["type"]] if isinstance(s.get("type"), str) else s.get("type")
    if names and not any(of_type(v, n) for n in names):
        return [f"{path}: not {' or '.join(names)}"]
    out = []
    if "enum" in s and json.dumps(v) not in map(json.dumps, s["enum"]):
        out.append(f"{path}: not of the list")
    if isinstance(v, str) and len(v) > s.get("maxLength", 99):
        out.append(f"{path}: too long")
    if of_type(v, "number") and v < s.get("minimum", -99):
        out.append(f"{path}: too small")
    if isinstance(v, dict):
        out += [f"{path}: {k} is missing" for k in s.get("required", ()) if k not in v]
        for k, x in v.items():
            part = s.get("properties", {}).get(k, s.get("additionalProperties", True))
            out += [f"{path}.{k}: not known"] if part is False else [] if part is True else plain(x, part, f"{path}.{k}")
    if isinstance(v, list):
        if len(v) > s.get("maxItems", 99):
            out.append(f"{path}: too many")
        if s.get("uniqueItems") and len({json.dumps(x, sort_keys=True) for x in v}) < len(v):
            out.append(f"{path}: repeats")
        for i, x in enumerate(v):
            out += plain(x, s["items"], f"{path}[{i}]") if "items" in s else []
    return out


def test_schema_engine(spark):
    r = random.Random(5)

    def value(depth):
        kind = r.randrange(9 if depth else 6)
        if kind > 6:
            return [value(depth - 1) for _ in range(r.randrange(4))]
        if kind == 6:
            return {k: value(depth - 1) for k in r.sample("abcns", r.randrange(4))}
        return (None, True, r.randrange(-2, 3), r.choice([0.5, -1.5]), r.choice(["", "é", "abc"]), {"n": r.randrange(-1, 2)})[kind]

    docs = [{"a": [{"n": r.randrange(-1, 2), "s": r.choice(["x", "abc"])} for _ in range(r.randrange(4))], "b": value(1), "c": value(1), "d": value(1)} if r.random() < 0.6 else value(3) for _ in range(400)]
    rows = spark.createDataFrame([(i, json.dumps(x, ensure_ascii=False)) for i, x in enumerate(docs)], "i int, t string")
    got = {x.i: sorted(x.f) for x in rows.select("i", schema_faults(F.try_parse_json("t"), SCHEMA).alias("f")).collect()}
    assert got == {i: sorted(plain(x, SCHEMA)) for i, x in enumerate(docs)}


def test_schema_engine_refuses_what_it_cannot_check():
    for bad in ({"oneOf": []}, {"$ref": "#/$defs/x", "$defs": {"x": {"$ref": "#/$defs/x"}}}):
        with pytest.raises(ValueError):
            schema_faults(F.lit(None), bad)


def test_thumbs(spark):
    r = random.Random(8)
    taps = [(i % 7, i % 5, r.choice(["up", "down"]), r.randrange(50), i) for i in range(600)]
    want = {}
    for user, article, kind, _, _ in sorted(taps, key=lambda t: (t[3], t[4])):
        want[user, article] = None if want.get((user, article)) == kind else kind
    found = thumbs(spark.createDataFrame(taps, "user_id int, article_id int, kind string, ts int, event_id int"))
    assert {(x.user_id, x.article_id): x.thumb for x in found.collect()} == want


def test_reserve(spark):
    r = random.Random(3)
    items = [(i, f"s{r.randrange(3)}", f"u{r.randrange(150)}", r.randrange(9), r.randrange(5), r.sample(["a", "b", "C!"], r.randrange(4)), f"t{i}") for i in range(200)]
    seen, own, want = set(), {}, {}
    for i, source, url, score, at, tags, _ in sorted(items, key=lambda x: (-x[3], -x[4], x[0])):
        if url in seen:
            continue
        seen.add(url)
        own[source] = own.get(source, 0) + 1
        if own[source] <= 20:
            for t in {"a", "b"} & set(tags):
                want.setdefault(t, []).append(i)
    df = spark.createDataFrame(items, "id int, source_id string, url string, score int, published_s int, topics array<string>, title string")
    got = {}
    for x in sorted(reserve(df, "score", 20, 15).collect(), key=lambda x: x.rank):
        got.setdefault(x.tag, []).append(x.id)
    assert got == {t: ids[:15] for t, ids in want.items()}


def test_checks_of_empty_tables(spark):
    none = lambda s: spark.createDataFrame([], s)
    assert reference_faults(none("id int, source_id string"), none("source_id string"), none("cluster_id int, id int"), none("cluster_id int, group_id int, id int")).count() == 0
    assert event_faults(none("event_id int, cluster_id int, live boolean, eligible boolean"), none("cluster_id int")).count() == 0
    assert profile_faults(none("name string, document string")).count() == 0


def test_keywords_beside_a_reference_and_boolean_schemas(spark):
    schema = {"$defs": {"s": {"type": "string", "minLength": 2}}, "type": "object", "properties": {"a": {"$ref": "#/$defs/s", "maxLength": 3}, "b": True, "c": False, "d": {"type": "array", "items": False}, "e": {"items": True}}}
    docs = ['{"a": "ab"}', '{"a": "abcdef"}', '{"a": "x"}', '{"a": 5}', '{"b": {"any": [1]}, "e": [1, null]}', '{"c": null}', '{"d": []}', '{"d": [1]}']
    df = spark.createDataFrame([(i, x) for i, x in enumerate(docs)], "i int, doc string")
    got = {r.i: sorted(r.f) for r in df.select("i", schema_faults(F.try_parse_json("doc"), schema).alias("f")).collect()}
    assert got == {0: [], 1: ["$.a: too long"], 2: ["$.a: too short"], 3: ["$.a: not string"], 4: [], 5: ["$.c: not allowed"], 6: [], 7: ["$.d[0]: not allowed"]}
    whole = df.select(schema_faults(F.try_parse_json("doc"), True).alias("y"), schema_faults(F.try_parse_json("doc"), False).alias("n")).first()
    assert whole.y == [] and whole.n == ["$: not allowed"]
