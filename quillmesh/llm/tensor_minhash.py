"""MinHash near-dedup with tensored banding.

Two collections of `side` half keys, each over `rows` minhashes, stand for side x side
tables: the key of table (i, j) is formed of half i of one and half j of the other. A
document thus takes 2 * side * rows minhashes in place of side * side * 2 * rows. The
tables are not written out, which would take side * side rows a document: documents are
dealt by half i, and half j completes the key when two of them meet.

Candidates are checked on the full shingle sets. In the first round the smallest document
of a bucket is compared with its other members. Where that leaves a bucket in several
components, later rounds compare those outside its largest one with the rest, HUBS of
them at a time, until no bucket is open: no link between components is lost. These
comparisons stay within blocks of bounded size, which first meet by half keys and set
sizes alone: only rows that are then due a comparison are dealt once more, with their
texts. A block joins its components as it finds links, skips pairs that are joined
already, and gives one row a join, so less rows than it has members.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.operators.graph import components

from .common import materialize, scratch, shingle_set, skew_join

ROWS = 3
#: A pair at the threshold is missed with this probability at most.
MISS = 2e-4
#: Hubs that a bucket takes in a later round, on average.
HUBS = 2048
#: Other members that meet the hubs in one task, about.
BLOCK = 1024


def side_for(percent: int, rows: int = ROWS, miss: float = MISS) -> int:
    """Half keys a collection so that a pair at `percent` per cent is missed with `miss` at most."""
    return math.ceil(math.log(miss / 2) / math.log(1 - (percent / 100) ** rows))


def half_keys(shingles: np.ndarray, side: int, rows: int = ROWS) -> np.ndarray:
    """2 * side keys of a non-empty set of 64-bit hashes, by 2 * side * rows minhashes."""
    r = np.random.default_rng(20240229)
    n = 2 * side * rows
    factor = r.integers(1, 2**63, n, np.uint64) * np.uint64(2) + np.uint64(1)
    mask = r.integers(0, 2**63, n, np.uint64)
    least = np.full(n, 2**64 - 1, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(shingles), 4096):
            np.minimum(least, ((shingles[at : at + 4096, None] ^ mask) * factor).min(axis=0), out=least)
        least = least.reshape(2 * side, rows)
        keys = np.arange(2 * side, dtype=np.uint64) + np.uint64(1)
        for k in range(rows):
            keys = (keys ^ least[:, k]) * np.uint64(0x9E3779B97F4A7C15)
            keys ^= keys >> np.uint64(31)
    return keys.view(np.int64)


def signatures(docs: DataFrame, words: int, side: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_shingles, set_key (a digest of the set, of the id where it is empty), halves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, keys, halves = [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = shingle_set(text.as_py(), words)
                counts.append(len(found))
                keys.append(xxhash.xxh3_128_digest(found.tobytes() if len(found) else f"empty {doc_id}"))
                halves.append(half_keys(found, side) if len(found) else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(keys, pa.binary()), pa.array(halves, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "set_key", "halves"])

    return docs.selectExpr(f"cast(`{id_col}` as bigint) doc_id", f"`{text_col}`").mapInArrow(run, "doc_id long, n_shingles long, set_key binary, halves array<long>")


def shared_size(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two sorted sets, none empty."""
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    return int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())


def verified(pairs: DataFrame, texts: DataFrame, words: int, percent: int, rows: int) -> DataFrame:
    """The pairs (a, b) whose full sets share enough: 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, np.ndarray] = {}  # sets of the last hubs, by their texts

        def of(text: str) -> np.ndarray:
            if text not in known:
                if len(known) >= 16:
                    known.clear()
                known[text] = shingle_set(text, words)
            return known[text]

        for batch in batches:
            linked = []
            for ta, tb in zip(batch.column(2), batch.column(3), strict=True):
                x, y = of(ta.as_py()), shingle_set(tb.as_py(), words)
                both = shared_size(x, y) if len(x) and len(y) else 0
                linked.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(linked, pa.bool_()))

    with_b = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text_").alias("text_b")), "b")
    both = skew_join(with_b, texts.select(F.col("doc_id").alias("a"), F.col("text_").alias("text_a")), "a", F.col("b"), rows)
    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def met_by(h: int, left: np.ndarray, component: np.ndarray, halves: np.ndarray, slot: int, size: np.ndarray, percent: int) -> np.ndarray:
    """The rows among `left` that hub `h` is to be compared with.

    A pair counts where it has a table's key in common, and in the first slot of the
    first collection that it shares, so once; where its sizes can reach the threshold;
    and where its components differ.
    """
    side = halves.shape[1] // 2
    which = np.flatnonzero(left & (component != component[h]) & (size > 0) & (100 * np.minimum(size, size[h]) >= percent * np.maximum(size, size[h])))
    same = halves[which] == halves[h]
    return which[~same[:, :slot].any(axis=1) & same[:, side:].any(axis=1)]


def compared(component: np.ndarray, hubs: np.ndarray, halves: np.ndarray, slot: int, size: np.ndarray, percent: int, among: bool) -> np.ndarray:
    """Whether each row is in a pair that `joined` can compare."""
    done, out = np.zeros(len(size), bool) if among else hubs.copy(), np.zeros(len(size), bool)
    for h in np.flatnonzero(hubs):
        done[h] = True
        which = met_by(h, ~done & ~out if out[h] else ~done, component, halves, slot, size, percent)
        if len(which):
            out[h] = out[which] = True
    return out


def joined(component: np.ndarray, hubs: np.ndarray, halves: np.ndarray, slot: int, sets: list[np.ndarray], percent: int, among: bool) -> list[tuple[int, int]]:
    """The joins (component, component) that links between hubs and other members make.

    Members of one component are never compared, and a found link makes two components
    one from then on, so there are fewer joins than components. `among`: whether hubs are
    compared with each other too.
    """
    component, size = component.copy(), np.array([len(x) for x in sets])
    every, starts = np.concatenate(sets), np.concatenate([[0], np.cumsum(size)[:-1]])
    done, out = np.zeros(len(sets), bool) if among else hubs.copy(), []
    for h in np.flatnonzero(hubs):
        done[h] = True
        which = met_by(h, ~done, component, halves, slot, size, percent)
        if not len(which):
            continue
        if len(which) < len(sets) // 4:
            part, at, n = np.concatenate([sets[i] for i in which]), np.concatenate([[0], np.cumsum(size[which])[:-1]]), size[which]
        else:
            part, at, n = every, starts[which], size[which]
        hit = sets[h][np.minimum(np.searchsorted(sets[h], part), size[h] - 1)] == part
        total = np.concatenate([[0], np.cumsum(hit)])
        both = total[at + n] - total[at]
        met = np.unique(component[which[100 * both >= percent * (n + size[h] - both)]])
        out += [(int(component[h]), int(c)) for c in met]
        component[np.isin(component, met)] = component[h]
    return out


def block_of(key, tab: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Components, hubs, halves and the key's slot of a block's rows."""
    halves = tab.column("halves").combine_chunks().flatten().to_numpy().reshape(tab.num_rows, -1)
    slot = int(np.flatnonzero((halves == key[0].as_py()).any(axis=0))[0])
    return tab.column("component").to_numpy(), tab.column("is_hub").to_numpy(), halves, slot


def due(rows: DataFrame, percent: int) -> DataFrame:
    """The rows that `block_joins` has to compare, by half keys and sizes alone.

    rows: key (a half of the first collection), block, rep, component, is_hub, halves,
    n_shingles; a block has the hubs of its bucket and BLOCK other members about. Hubs
    meet each other in block 0.
    """

    def run(key, tab):
        among, size = key[1].as_py() == 0, tab.column("n_shingles").to_numpy()
        return tab.select(["key", "block", "rep", "component", "is_hub", "halves"]).filter(pa.array(compared(*block_of(key, tab), size, percent, among)))

    return rows.groupBy("key", "block").applyInArrow(run, "key long, block int, rep long, component long, is_hub boolean, halves array<long>")


def block_joins(rows: DataFrame, words: int, percent: int) -> DataFrame:
    """The joins (a, b) of components by links between the rows of each block: those that
    are `due`, with text_."""

    def run(key, tab):
        sets = [shingle_set(x.as_py(), words) for x in tab.column("text_")]
        found = joined(*block_of(key, tab), sets, percent, key[1].as_py() == 0)
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return rows.groupBy("key", "block").applyInArrow(run, "a long, b long")


def thinned(links: DataFrame) -> DataFrame:
    """Links (a, b) of the same components: a document's first hub stands for its others.

    A document has a hub a half at most, so its list is bounded.
    """
    hubs = links.groupBy("b").agg(F.sort_array(F.collect_set("a")).alias("hubs"))
    other = F.expr("transform(slice(hubs, 2, size(hubs)), h -> struct(hubs[0] AS a, h AS b))")
    return hubs.select(F.explode(F.concat(F.array(F.struct(F.col("hubs")[0].alias("a"), "b")), other)).alias("l")).select("l.a", "l.b").distinct()


def in_table(side: int) -> str:
    """Whether rep and hub, which agree in half `slot` of the first collection, share a table's key.

    Table (i, j) has the key of halves i and j, so they do where a half of the second
    collection agrees as well; and each pair counts once, in the first slot that it shares.
    """
    same = "zip_with(halves, hub_halves, (x, y) -> x = y)"
    return f"array_position(slice({same}, 1, {side}), true) = slot + 1 and array_contains(slice({same}, {side + 1}, {side}), true)"


def table_members(classes: DataFrame, side: int) -> tuple[DataFrame, DataFrame]:
    """(members, wanted). members: (key, rep, hub, in_table), one row a document and half of
    the first collection that several documents have, hub being the smallest of them;
    wanted: the ids (doc_id) that have a shared half in either collection."""
    spark = classes.sparkSession
    n = classes.count()
    half = classes.filter("rep is not null").select("rep", F.posexplode("halves").alias("slot", "half"))
    shared = materialize(half.groupBy("half").agg(F.count(F.lit(1)).alias("n_half")).filter("n_half > 1"), scratch(spark, "shared"))
    # a table's key can be shared only where both its halves are
    met = skew_join(half, shared, "half", F.col("rep"), 2 * side * n, counts="n_half").groupBy("rep").agg(F.min("slot").alias("low"), F.max("slot").alias("high"))
    wanted = materialize(met.filter((F.col("low") < side) & (F.col("high") >= side)).select(F.col("rep").alias("doc_id")), scratch(spark, "wanted"))
    rows = classes.join(wanted.withColumnRenamed("doc_id", "rep"), "rep", "left_semi").select("rep", "halves", F.posexplode(F.slice("halves", 1, side)).alias("slot", "key"))
    buckets = rows.groupBy("key").agg(F.min_by(F.struct("rep", "halves"), "rep").alias("least"), F.count(F.lit(1)).alias("n_key")).filter("n_key > 1")
    buckets = buckets.select("key", F.col("least.rep").alias("hub"), F.col("least.halves").alias("hub_halves"), "n_key")
    members = skew_join(rows, buckets, "key", F.col("rep"), side * n, counts="n_key").select("key", "rep", "hub", F.expr(in_table(side)).alias("in_table"))
    return materialize(members, scratch(spark, "members")), wanted


def links_of(classes: DataFrame, docs: DataFrame, words: int, percent: int, side: int, id_col: str, text_col: str) -> DataFrame:
    """(node, component) of the representatives that can have a link."""
    spark = docs.sparkSession
    members, wanted = table_members(classes, side)
    texts = materialize(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text_")).join(wanted, "doc_id", "left_semi"), scratch(spark, "texts"))
    pairs = materialize(members.filter("rep != hub and in_table").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct(), scratch(spark, "pairs"))
    links = materialize(thinned(verified(pairs, texts, words, percent, pairs.count())), scratch(spark, "links"))
    linked = components(links)
    found = materialize(wanted.distinct().join(linked, F.col("doc_id") == F.col("node"), "left").select(F.col("doc_id").alias("node"), F.coalesce("component", "doc_id").alias("component")), scratch(spark, "components"))
    # half keys and sizes of a rep; where an id repeats, it has several
    shapes = classes.select("rep", "halves", "n_shingles").join(wanted.withColumnRenamed("doc_id", "rep"), "rep", "left_semi")
    turn, n_nodes, members = 0, found.count(), members.select("key", "rep")
    while True:  # buckets whose members are in several components
        turn += 1
        labelled = materialize(members.join(found.withColumnRenamed("node", "rep"), "rep"), scratch(spark, "labelled"))
        parts = labelled.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
        several = parts.groupBy("key").agg(F.max(F.struct("n", "component")).alias("most"), F.sum("n").alias("n_key"), F.count(F.lit(1)).alias("n_parts")).filter("n_parts > 1")
        several = materialize(several.select("key", "n_key", F.col("most.component").alias("main"), (F.col("n_key") - F.col("most.n")).alias("others")), scratch(spark, "open"))
        left = several.agg(F.sum("n_key")).first()[0] or 0
        if not left:
            return found
        # a pair of two components has a member outside the bucket's largest one: those are the hubs
        chosen = (F.col("component") != F.col("main")) & (F.pmod(F.xxhash64("rep", F.lit(turn)), F.col("others")) < HUBS)
        open_ = skew_join(labelled, several, "key", F.col("rep"), left, counts="n_key").withColumn("is_hub", chosen).withColumn("blocks", F.ceil(F.col("n_key") / BLOCK).cast("int"))
        open_ = materialize(open_.select("key", "rep", "component", "is_hub", "blocks"), scratch(spark, "round"))
        own = F.array(F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        dealt = open_.withColumn("block", F.explode(F.when(F.col("is_hub"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(own)))
        met = dealt.select("key", "block", "rep", "component", "is_hub").join(shapes, "rep").filter("array_contains(halves, key)")
        met = materialize(due(met, percent), scratch(spark, "due"))
        new = materialize(block_joins(met.join(texts.withColumnRenamed("doc_id", "rep"), "rep"), words, percent), scratch(spark, "joins"))
        members = open_.filter("not is_hub").select("key", "rep")
        if not new.isEmpty():
            merged = materialize(components(new).select(F.col("component").alias("into"), F.col("node").alias("component")), scratch(spark, "merged"))
            found = materialize(skew_join(found.withColumnRenamed("node", "rep"), merged, "component", F.col("rep"), n_nodes, how="left").select(F.col("rep").alias("node"), F.coalesce("into", "component").alias("component")), scratch(spark, "components"))


def minhash_dedup(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, n_shingles, component_id, kept.

    A document's set: distinct shingles of `words` words (ASCII lower case, cut at ASCII
    white space); all its words as one shingle where there are fewer; nothing without
    words or text, which is linked with nothing. Documents are linked where
    100 * intersection >= percent * union. component_id: the smallest id that links
    reach. Documents of equal sets are one class, linked through its smallest id. Rows
    that repeat an id count as linked. A row with a null id takes the component of its
    class; a class of null ids alone has component null and counts as kept. An empty
    table gives an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    side = side_for(percent)
    marks = materialize(signatures(docs, words, side, id_col, text_col), scratch(spark, "signatures"))
    classes = marks.filter("n_shingles > 0").groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.min_by("halves", "doc_id").alias("halves"), F.min("n_shingles").alias("n_shingles"), F.count(F.lit(1)).alias("n_class"))
    classes = materialize(classes, scratch(spark, "classes"))
    found = links_of(classes, docs, words, percent, side, id_col, text_col)
    named = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("set_key", "n_class", F.coalesce("component", "rep").alias("component"))
    named = materialize(named, scratch(spark, "named"))
    n = marks.count()
    out = skew_join(marks.select("doc_id", "n_shingles", "set_key"), named, "set_key", F.coalesce(F.col("doc_id"), F.lit(0)), n, how="left", counts="n_class")
    component = F.when(F.col("n_class").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
