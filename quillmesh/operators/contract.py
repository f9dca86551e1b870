"""Contract checks: a JSON Schema subset as column expressions, and the references between tables of a pool."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ANNOTATIONS = {"$schema", "$id", "$defs", "$comment", "title", "description"}
ASSERTIONS = {"$ref", "type", "const", "enum", "required", "properties", "additionalProperties", "items", "minItems", "maxItems", "uniqueItems", "pattern", "minLength", "maxLength", "minimum"}
KINDS = {"object": "OBJECT", "array": "ARRAY", "string": "STRING", "boolean": "BOOLEAN", "null": "VOID", "integer": r"BIGINT|DECIMAL\(\d+,0\)", "number": "BIGINT|DECIMAL|DOUBLE|FLOAT"}
NONE = "array<string>"


def _is(value: Column, name: str) -> Column:
    return F.schema_of_variant(value).rlike(f"^({KINDS[name]})")


def _json(value: object) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def _when(bad: Column, faults: Column) -> Column:
    return F.when(bad, faults).otherwise(F.array().cast(NONE))


def schema_faults(value: Column, schema: dict | bool, root: dict | None = None, path: Column | str = "$", within: tuple[str, ...] = ()) -> Column:
    """An array of "path: fault" for a VARIANT under a schema; empty where it fits.

    A value of the wrong type gives that fault alone, but for those of its `$ref`, whose
    schema holds together with the keywords beside it. A schema may be true or false:
    everything fits, or nothing. A keyword holds for the types it
    is about. A keyword that is not of the subset raises, as does a schema that refers to
    itself, so no schema is checked in part. A null column (no JSON) gives "not JSON".
    """
    at = F.lit(path) if isinstance(path, str) else path
    if isinstance(schema, bool):
        fits = F.array().cast(NONE)
        return F.when(value.isNull(), F.array(F.concat(at, F.lit(": not JSON")))).otherwise(fits if schema else F.array(F.concat(at, F.lit(": not allowed"))))
    root = schema if root is None else root
    if unknown := set(schema) - ANNOTATIONS - ASSERTIONS:
        raise ValueError(f"keywords outside the subset: {sorted(unknown)}")
    if "$ref" in schema:
        ref = schema["$ref"]
        if ref in within:
            raise ValueError(f"{ref} refers to itself")
        meant = schema_faults(value, reduce(lambda s, k: s[k], ref.removeprefix("#/").split("/"), root), root, at, (*within, ref))
        beside = {k: v for k, v in schema.items() if k in ASSERTIONS and k != "$ref"}
        return F.array_distinct(F.concat(meant, schema_faults(value, beside, root, at, within))) if beside else meant
    say = lambda text: F.array(F.concat(at, F.lit(f": {text}")))
    found = []
    if "const" in schema:
        found.append(_when(F.to_json(value) != _json(schema["const"]), say(f"not {_json(schema['const'])}")))
    if "enum" in schema:
        found.append(_when(~F.to_json(value).isin([_json(x) for x in schema["enum"]]), say("not of the list")))
    text = F.try_variant_get(value, "$", "string")
    for key, bad, fault in (("minLength", lambda n: F.length(text) < n, "too short"), ("maxLength", lambda n: F.length(text) > n, "too long"), ("pattern", lambda p: ~text.rlike(p), "not of the pattern")):
        if key in schema:
            found.append(_when(_is(value, "string") & bad(schema[key]), say(fault)))
    if "minimum" in schema:
        found.append(_when(_is(value, "number") & (F.try_variant_get(value, "$", "double") < schema["minimum"]), say("too small")))
    fields = F.try_variant_get(value, "$", "map<string,variant>")
    inside = []
    for name in schema.get("required", ()):
        inside.append(_when(~F.map_contains_key(fields, name), say(f"{name} is missing")))
    known, rest = schema.get("properties", {}), schema.get("additionalProperties", True)
    for name, part in known.items():
        inside.append(_when(F.map_contains_key(fields, name), schema_faults(fields[name], part, root, F.concat(at, F.lit(f".{name}")), within)))
    if rest is not True:
        others = F.filter(F.map_entries(fields), lambda e: ~e.key.isin(list(known))) if known else F.map_entries(fields)
        if rest is False:
            inside.append(F.transform(others, lambda e: F.concat(at, F.lit("."), e.key, F.lit(": not known"))))
        else:
            inside.append(F.flatten(F.transform(others, lambda e: schema_faults(e.value, rest, root, F.concat(at, F.lit("."), e.key), within))))
    if inside:
        found.append(_when(_is(value, "object"), F.flatten(F.array(*inside))))
    entries = F.try_variant_get(value, "$", "array<variant>")
    for key, bad, fault in (("minItems", lambda n: F.size(entries) < n, "too few"), ("maxItems", lambda n: F.size(entries) > n, "too many")):
        if key in schema:
            found.append(_when(_is(value, "array") & bad(schema[key]), say(fault)))
    if schema.get("uniqueItems"):
        found.append(_when(_is(value, "array") & (F.size(F.array_distinct(F.transform(entries, lambda x: F.to_json(x)))) < F.size(entries)), say("repeats")))
    if "items" in schema:
        each = F.transform(entries, lambda x, i: schema_faults(x, schema["items"], root, F.concat(at, F.lit("["), i.cast("string"), F.lit("]")), within))
        found.append(_when(_is(value, "array"), F.flatten(each)))
    all_ = F.flatten(F.array(*found)) if found else F.array().cast(NONE)
    if "type" in schema:
        names = [schema["type"]] if isinstance(schema["type"], str) else schema["type"]
        fits = reduce(lambda x, y: x | y, (_is(value, n) for n in names))
        all_ = F.when(fits, all_).otherwise(say(f"not {' or '.join(names)}"))
    return F.when(value.isNull(), say("not JSON")).otherwise(all_)


def _named(fault: str, rows: DataFrame, key: str) -> DataFrame:
    return rows.select(F.lit(fault).alias("fault"), F.col(key).cast("string").alias("key"))


def _several(rows: DataFrame, by: list[str], of: str | None = None) -> DataFrame:
    """The groups that have several rows, or several values of a column."""
    n = F.count(F.lit(1)) if of is None else F.countDistinct(of)
    return rows.groupBy(*by).agg(n.alias("n_")).filter("n_ > 1")


def reference_faults(items: DataFrame, outlets: DataFrame, placed: DataFrame, copies: DataFrame) -> DataFrame:
    """(fault, key), one row a fault.

    items: id, source_id; outlets: source_id; placed: cluster_id, id, one row a listing;
    copies: cluster_id, group_id, id, one row a listing in a group of near duplicates.
    """
    own = placed.select("cluster_id", "id").distinct()
    parts = [
        _named("item id repeats", _several(items, ["id"]), "id"),
        _named("unknown outlet", items.join(outlets, "source_id", "left_anti"), "id"),
        _named("unknown item", own.join(items.select("id"), "id", "left_anti").select("id").distinct(), "id"),
        _named("item listed twice", _several(placed, ["cluster_id", "id"]).select("id").distinct(), "id"),
        _named("item in several clusters", _several(placed, ["id"], "cluster_id"), "id"),
        _named("copy outside its cluster", copies.join(own, ["cluster_id", "id"], "left_anti").select("id").distinct(), "id"),
        _named("copy in several groups", _several(copies, ["cluster_id", "id"]).select("id").distinct(), "id"),
    ]
    return reduce(DataFrame.union, parts)


def event_faults(events: DataFrame, clusters: DataFrame) -> DataFrame:
    """C4: (fault, key). events: event_id, cluster_id, live, eligible, one row a listing; clusters: cluster_id."""
    parts = [
        _named("unknown cluster", events.select("cluster_id").distinct().join(clusters, "cluster_id", "left_anti"), "cluster_id"),
        _named("cluster in several events", _several(events, ["cluster_id"], "event_id"), "cluster_id"),
        _named("cluster listed twice", _several(events, ["event_id", "cluster_id"]).select("cluster_id").distinct(), "cluster_id"),
        _named("live but not eligible", events.filter("live and not eligible").select("event_id").distinct(), "event_id"),
    ]
    return reduce(DataFrame.union, parts)


def balance_faults(checked: DataFrame, counts: DataFrame, outlets: DataFrame, health: DataFrame) -> DataFrame:
    """(fault, key): counts that do not add up, and outlets without health or health without an outlet.

    checked: id, drop_reason; counts: metric, n (fetched, published and each drop);
    outlets: source_id; health: source_id.
    """
    real = checked.groupBy(F.coalesce("drop_reason", F.lit("published")).alias("metric")).agg(F.count(F.lit(1)).alias("real"))
    told = counts.filter("metric != 'fetched'")
    wrong = told.join(real, "metric", "full").filter(~F.col("n").eqNullSafe(F.col("real")))
    sums = counts.agg(F.sum(F.when(F.col("metric") == "fetched", F.col("n")).otherwise(-F.col("n"))).alias("over")).filter("over <> 0").select(F.lit("fetched").alias("metric"))
    parts = [
        _named("count is not that of the rows", wrong, "metric"),
        _named("fetched is not the sum", sums, "metric"),
        _named("outlet without health", outlets.join(health, "source_id", "left_anti"), "source_id"),
        _named("health of no outlet", health.join(outlets, "source_id", "left_anti"), "source_id"),
    ]
    return reduce(DataFrame.union, parts)
