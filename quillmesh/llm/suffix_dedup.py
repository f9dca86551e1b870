"""Suffix-array dedup: bytes of repeated 50-byte strings go where a smaller document has them.

The suffix order is formed by the difference-cover algorithm (`difference_cover`),
distributed by content:

1. Equal texts are folded, so that each different text takes part once, and are written
   in chunks (a bucketed table, so that later passes read a chunk without a shuffle).
2. Every 50-byte string has an anchor, the least of its 26-byte hashes. Anchors in one
   text only cannot lie in a repeated string; 32 bits an anchor and chunk are compared
   to find the others. Nothing repeated is lost, and few suffixes are left.
3. The strings of a shared anchor occurrence form one context. Equal strings have equal
   anchors, so suffixes are dealt over the cluster by anchor: each task sorts the
   suffixes of its different contexts and compares adjacent prefixes of 50 bytes; the
   strings of a class belong to its smallest document. All strings of an occurrence go
   if a smaller document has its context, else those that the classes name. Contexts of
   one anchor beyond ARRAY_BYTES are parted by what stands beside the anchor, so that no
   array is much longer.
4. An anchor with very many occurrences is folded and dealt string by string instead.
5. Runs are cut from the chunks.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, remove, scratch, skew_join
from .difference_cover import suffix_order

LENGTH, GRAM = 50, 26
#: Anchors' 32-bit codes that one task compares, in bytes, about.
BIN_BYTES = 48 << 20
#: Bytes of a chunk to each bin at least, so that a chunk has a good many codes (one in 13 bytes) in each.
CHUNK_SHARE = 1 << 10
#: Anchor starts that a string of LENGTH bytes holds, and so strings that one anchor has at most.
SPAN = LENGTH - GRAM + 1
CHUNK_BYTES, WIDE_CHUNK_BYTES = 16 << 20, 64 << 20
#: Bytes of contexts that one suffix array covers, about.
ARRAY_BYTES = 1 << 20
#: Bytes of text whose anchors are found at a time.
STEP = 192 << 10
#: An anchor is hot with more than so many occurrences, and more than one part in HOT_ANCHORS of all.
ANCHOR_ROWS, HOT_ANCHORS = 65_536, 100_000
#: Stands for a null id, which ranks below all others.
NULL_ID = -(2**63)
#: Names stand for 81 bytes after so many rounds, more than LENGTH.
LEVELS = 3


def gram_hashes(a: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of GRAM bytes."""
    with np.errstate(over="ignore"):
        p = np.uint64(0x9E3779B97F4A7C15)
        h = (a.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        made, size, kept = h, 1, {}
        while size < 16:
            n = len(made) - size
            made = made[:n] * p + made[size : size + n]
            made ^= made >> np.uint64(29)
            size *= 2
            kept[size] = made
        n = len(a) - GRAM + 1
        out = (kept[16][:n] * p + kept[8][16 : 16 + n]) * p + kept[2][24 : 24 + n]
        out ^= out >> np.uint64(31)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
    return out


def anchors(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(text number, first string, last string, anchor start, anchor hash) arrays, a step of texts at a time.

    Strings are named by their start within the text; each string of LENGTH bytes is in
    exactly one row, that of its leftmost least anchor. Texts longer than STEP are gone
    through in pieces.
    """
    number = np.array([i for i, t in enumerate(texts) for _ in range(0, max(1, len(t) - LENGTH + 1), STEP)], np.int64)
    before = np.array([a for t in texts for a in range(0, max(1, len(t) - LENGTH + 1), STEP)], np.int64)
    # a long text in pieces, one byte less than a string in common
    texts = [texts[i][a : a + STEP + LENGTH - 1] if len(texts[i]) > STEP else texts[i] for i, a in zip(number, before, strict=True)]
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (size == 0 or size + len(texts[end]) <= STEP):
            size += len(texts[end])
            end += 1
        lengths = np.array([len(t) for t in texts[at:end]])
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        if size >= LENGTH:
            h = gram_hashes(np.frombuffer(b"".join(texts[at:end]), np.uint8))
            key = h >> np.uint64(32) << np.uint64(32) | np.arange(len(h), dtype=np.uint64)
            least, width = key, 1
            while width < 16:
                least = np.minimum(least[: len(least) - width], least[width:])
                width *= 2
            n = size - LENGTH + 1
            least = (np.minimum(least[:n], least[SPAN - 16 : SPAN - 16 + n]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
            owner = np.repeat(np.arange(len(lengths)), np.maximum(lengths - LENGTH + 1, 0))
            inside = np.concatenate([np.arange(s, s + k - LENGTH + 1) for s, k in zip(starts, lengths, strict=True) if k >= LENGTH] or [np.empty(0, np.int64)])
            least = least[inside]
            if len(least):
                new = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])]))
                last = np.append(new[1:], len(least)) - 1
                text = owner[new]
                shift = before[text + at] - starts[text]
                yield number[text + at], inside[new] + shift, inside[last] + shift, least[new] + shift, h[least[new]]
        at = end


def layout(total: int) -> tuple[int, int]:
    """Chunks and bins for so many bytes of text.

    Each chunk sends a row to each bin. Bins are as many as it takes to compare BIN_BYTES
    at a time, but no more than leave a row a good many codes, so rows are in proportion
    to codes at any size. Where that bound holds (from 10^12 bytes on), chunks widen.
    """
    code_bytes = 4 * total / 13
    bins = max(12, math.ceil(code_bytes / BIN_BYTES))
    size = CHUNK_BYTES if bins <= CHUNK_BYTES // CHUNK_SHARE else WIDE_CHUNK_BYTES
    return max(12, math.ceil(total / size)), min(bins, size // CHUNK_SHARE)


def codes(h: np.ndarray, bins: int) -> np.ndarray:
    return (h >> np.uint64(32)) % np.uint64(bins) << np.uint64(32) | h & np.uint64(0xFFFFFFFF)


def chunk_codes(texts: list[bytes], bins: int) -> tuple[np.ndarray, np.ndarray]:
    """The different codes of a chunk's anchors in order, and which are in several of its texts."""
    found = [(codes(h, bins), text) for text, _, _, _, h in anchors(texts)]
    if not found:
        return np.empty(0, np.uint64), np.empty(0, bool)
    code, text = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(code, kind="stable")
    code, text = code[order], text[order]
    new = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    return code[new], np.minimum.reduceat(text, new) != np.maximum.reduceat(text, new)


def folded(rows: DataFrame, chunks: int) -> DataFrame:
    """(chunk, digest, doc_id, data), one row a different text with its smallest id.

    A map task sends a text once, and its smallest id; so no text, however frequent,
    gathers in one place.
    """

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[bytes, int] = {}
        sent: dict[bytes, int] = {}
        names = ["chunk", "digest", "doc_id", "data"]

        def chunk(digest: bytes) -> int:
            return int.from_bytes(digest[:7], "little") % chunks

        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                digest = hashlib.sha256(data).digest()
                if digest not in least:
                    least[digest] = sent[digest] = doc_id
                    out.append((chunk(digest), digest, doc_id, data))
                elif doc_id < least[digest]:
                    least[digest] = doc_id
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.binary(), pa.int64(), pa.binary()), strict=True)], names=names)
        late = [(chunk(d), d, i, None) for d, i in least.items() if i != sent[d]]
        for at in range(0, len(late), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*late[at : at + 10_000], strict=True), (pa.int64(), pa.binary(), pa.int64(), pa.binary()), strict=True)], names=names)

    schema = "chunk long, digest binary, doc_id long, data binary"
    sent = rows.mapInArrow(local, schema).repartition(chunks, "chunk")
    return sent.groupBy("chunk", "digest").agg(F.min("doc_id").alias("doc_id"), F.max("data").alias("data"))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, judged): rows (doc_id, n_bytes, digest), one a row of `docs`; judged, one a
    different text: digest_, rep (its smallest id), n_removed, n_spans, kept_sha256."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.col(text_col).alias("text_"))
    total = rows.agg(F.sum(F.octet_length("text_"))).first()[0] or 0
    chunks, bins = layout(total)
    name, where = f"quillmesh_chunks_{uuid.uuid4().hex[:12]}", scratch(spark, "chunks")
    used = [where]
    try:
        folded(rows, chunks).write.format("parquet").option("compression", "zstd").option("path", where).bucketBy(chunks, "chunk").sortBy("chunk").saveAsTable(name)
        judged = materialize(cut_texts(spark.table(name), bins, used), scratch(spark, "judged"))
    finally:  # also where a step fails
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove(spark, *used)
    text = F.coalesce(F.col("text_"), F.lit(""))
    return rows.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.unhex(F.sha2(text, 256)).alias("digest")), judged


def cut_texts(texts: DataFrame, bins: int, used: list[str]) -> DataFrame:
    """One row a different text: digest_, rep, n_removed, n_spans, kept_sha256; `used` gets the scratch tables that it reads."""
    spark = texts.sparkSession

    def kept(df: DataFrame, tag: str) -> DataFrame:
        used.append(scratch(spark, tag))
        return materialize(df, used[-1])

    def send(key, tab):
        code, several = chunk_codes(tab.column("data").to_pylist(), bins)
        which = (code >> np.uint64(32)).astype(np.int64)
        cut = np.searchsorted(which, np.arange(bins + 1))
        low = code.astype(np.uint32)
        out = [np.concatenate([low[a:b], low[a:b][several[a:b]]]).tobytes() for a, b in zip(cut, cut[1:], strict=False)]
        return pa.table({"bin": pa.array(range(bins), pa.int64()), "chunk": pa.array([key[0].as_py()] * bins, pa.int64()), "n": pa.array(np.diff(cut), pa.int64()), "low": pa.array(out, pa.binary())})

    def compare(key, tab):
        arrays = [np.frombuffer(x, np.uint32) for x in tab.column("low").to_pylist()]
        every = np.sort(np.concatenate(arrays))
        shared = np.unique(every[1:][every[1:] == every[:-1]])
        bits = []
        for n, a in zip(tab.column("n").to_pylist(), arrays, strict=True):
            at = np.searchsorted(shared, a[:n])
            hit = shared[np.minimum(at, len(shared) - 1)] == a[:n] if len(shared) else np.zeros(n, bool)
            bits.append(np.packbits(hit).tobytes())
        return pa.table({"chunk": tab.column("chunk"), "bin": tab.column("bin"), "bits": pa.array(bits, pa.binary())})

    flags = texts.groupBy("chunk").applyInArrow(send, "bin long, chunk long, n long, low binary").groupBy("bin").applyInArrow(compare, "chunk long, bin long, bits binary")
    flags = kept(flags, "flags")

    def contexts(key, tab, flag):
        data, digests, ids = tab.column("data").to_pylist(), tab.column("digest").to_pylist(), tab.column("doc_id").to_pylist()
        code, _ = chunk_codes(data, bins)
        cut = np.searchsorted((code >> np.uint64(32)).astype(np.int64), np.arange(bins + 1))
        bits = {b: x for b, x in zip(flag.column("bin").to_pylist(), flag.column("bits").to_pylist(), strict=True)}
        hit = np.concatenate([np.unpackbits(np.frombuffer(bits[b], np.uint8), count=int(n)).astype(bool) if b in bits else np.zeros(n, bool) for b, n in enumerate(np.diff(cut))])
        shared = code[hit]
        who, where_, made, hashes = [], [], [], []
        if len(shared):
            for text, first, last, _, h in anchors(data):
                c = codes(h, bins)
                some = np.flatnonzero(shared[np.minimum(np.searchsorted(shared, c), len(shared) - 1)] == c)
                who += text[some].tolist()
                where_ += first[some].tolist()
                made += [data[t][a : b + LENGTH] for t, a, b in zip(text[some].tolist(), first[some].tolist(), last[some].tolist(), strict=True)]
                hashes.append(h[some].view(np.int64))
        key_of, id_of = np.array([int.from_bytes(d[:8], "little", signed=True) for d in digests], np.int64), np.array(ids, np.int64)
        return pa.table({"chunk": pa.array([key[0].as_py()] * len(who), pa.int64()), "of": pa.array(key_of[who] if who else [], pa.int64()), "doc_id": pa.array(id_of[who] if who else [], pa.int64()), "pos": pa.array(where_, pa.int32()), "anchor": pa.array(np.concatenate(hashes) if hashes else [], pa.int64()), "context": pa.array(made, pa.binary())})

    found = texts.groupBy("chunk").cogroup(flags.groupBy("chunk")).applyInArrow(contexts, "chunk long, of long, doc_id long, pos int, anchor long, context binary")
    found = kept(found, "contexts")
    gone = kept(removed_strings(found), "gone")

    def cut(key, tab, marks):
        place: dict[int, list[int]] = {}
        for i, d in enumerate(marks.column("of").to_pylist()):
            place.setdefault(d, []).append(i)
        pos, masks_ = marks.column("pos").to_numpy(), marks.column("mask").to_numpy().astype(np.int64)
        removed, spans, shas = [], [], []
        for digest, data in zip(tab.column("digest").to_pylist(), tab.column("data").to_pylist(), strict=True):
            which = place.get(int.from_bytes(digest[:8], "little", signed=True))
            if not which:
                removed.append(0)
                spans.append(0)
                shas.append(digest.hex())
                continue
            p, m = pos[which], masks_[which]
            starts = (p[:, None] + np.arange(SPAN))[(m[:, None] >> np.arange(SPAN)) & 1 == 1]
            steps = np.bincount(starts, minlength=len(data) + 1) - np.bincount(starts + LENGTH, minlength=len(data) + 1)[: len(data) + 1]
            gone_ = np.cumsum(steps)[: len(data)] > 0
            removed.append(int(gone_.sum()))
            spans.append(int(gone_[0]) + int((gone_[1:] & ~gone_[:-1]).sum()))
            shas.append(hashlib.sha256(np.frombuffer(data, np.uint8)[~gone_].tobytes()).hexdigest())
        return pa.table({"digest_": tab.column("digest"), "rep": tab.column("doc_id"), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(shas, pa.string())})

    return texts.groupBy("chunk").cogroup(gone.groupBy("chunk")).applyInArrow(cut, "digest_ binary, rep long, n_removed long, n_spans long, kept_sha256 string")


def removed_strings(found: DataFrame) -> DataFrame:
    """(chunk, of, pos, mask): bit i of mask is set where string i of the occurrence at pos goes."""
    spark = found.sparkSession
    size = found.count()
    share = max(ANCHOR_ROWS, math.ceil(size / HOT_ANCHORS))
    hot = found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > share).select(F.col("anchor").alias("hot_anchor"))
    hot = materialize(hot, scratch(spark, "hot"))
    some = F.broadcast(hot)  # HOT_ANCHORS rows at most
    kinds = (("chunk", pa.int64()), ("of", pa.int64()), ("pos", pa.int32()), ("mask", pa.int32()))

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        volume = 0

        def flush(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            tab = pa.Table.from_batches(parts).combine_chunks()
            coded = tab.column("context").chunk(0).dictionary_encode()
            index, doc = coded.indices.to_numpy(), tab.column("doc_id").to_numpy()
            first = np.full(len(coded.dictionary), np.iinfo(np.int64).max)
            np.minimum.at(first, index, doc)
            anchor, strings = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
            anchor[index] = tab.column("anchor").to_numpy()
            texts = coded.dictionary.to_pylist()
            strings[:] = [len(t) - LENGTH + 1 for t in texts]
            masks = bounded_masks(texts, first, anchor)
            mask = np.where(doc > first[index], (np.int64(1) << strings[index]) - 1, masks[index])
            tab = tab.append_column("mask", pa.array(mask, pa.int32())).filter(pa.array(mask != 0)).combine_chunks()
            return pa.RecordBatch.from_arrays([tab.column(n).combine_chunks() if tab.num_rows else pa.array([], t) for n, t in kinds], names=[n for n, _ in kinds])

        for batch in batches:
            if not batch.num_rows:
                continue
            anchor = batch.column("anchor").to_numpy()
            if held and volume >= ARRAY_BYTES:
                begins = np.flatnonzero(anchor != held[-1].column("anchor")[-1].as_py())
                cut = int(begins[0]) if len(begins) else batch.num_rows
                if cut:
                    held.append(batch.slice(0, cut))
                if cut < batch.num_rows:
                    yield flush(held)
                    held, volume = [batch.slice(cut)], batch.slice(cut).nbytes
                continue
            held.append(batch)
            volume += batch.nbytes
        if held:
            yield flush(held)

    marked = found.join(some, F.col("anchor") == F.col("hot_anchor"), "left")
    cold = marked.filter("hot_anchor is null").drop("hot_anchor").repartition("anchor").sortWithinPartitions("anchor")
    out = cold.select("anchor", "context", "doc_id", "chunk", "of", "pos").mapInArrow(sort, "chunk long, of long, pos int, mask int")
    if hot.isEmpty():
        return out
    many = marked.filter("hot_anchor is not null").withColumn("key", F.unhex(F.md5("context")))
    folds = many.groupBy("key", "context").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n_context"))
    folds = materialize(folds, scratch(spark, "folds"))
    strings = folds.withColumn("i", F.explode(F.sequence(F.lit(0), F.octet_length("context") - LENGTH))).withColumn("string", F.expr(f"substring(context, i + 1, {LENGTH})"))
    strings = materialize(strings.select("key", "first", "n_context", "i", "string"), scratch(spark, "strings"))
    least = strings.groupBy("string").agg(F.min("first").alias("least"), F.count(F.lit(1)).alias("n_string"))
    judged = skew_join(strings, least, "string", F.xxhash64("key"), strings.count(), counts="n_string")
    mask = F.sum(F.when(F.col("least") < F.col("first"), F.expr("shiftleft(1, i)")).otherwise(0)).cast("int")
    masks = materialize(judged.groupBy("key").agg(F.first("first").alias("first"), F.first("n_context").alias("n_context"), mask.alias("mask")), scratch(spark, "masks"))
    met = skew_join(many.select("chunk", "of", "doc_id", "pos", (F.octet_length("context") - LENGTH + 1).alias("strings"), "key"), masks, "key", F.col("doc_id") + F.col("pos"), size, counts="n_context")
    mask = F.when(F.col("doc_id") > F.col("first"), F.expr("shiftleft(1, strings) - 1")).otherwise(F.col("mask"))
    return out.union(met.select("chunk", "of", "pos", mask.cast("int").alias("mask")).filter("mask != 0"))


def bounded_masks(contexts: list[bytes], first: np.ndarray, group: np.ndarray) -> np.ndarray:
    """`string_masks` of different contexts, by arrays of ARRAY_BYTES about, however many contexts an anchor has."""
    out = np.zeros(len(contexts), np.int64)
    size = np.array([len(c) for c in contexts], np.int64)
    begins = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.empty(0, np.int64)
    at = 0
    for begin, end in zip(begins.tolist(), [*begins[1:].tolist(), len(contexts)], strict=True):
        large = size[begin:end].sum() > ARRAY_BYTES
        if at < begin and (large or size[at:end].sum() > ARRAY_BYTES):
            out[at:begin] = string_masks(contexts[at:begin], first[at:begin], group[at:begin])
            at = begin
        if large:
            some = contexts[begin:end]
            place = np.zeros(len(some), np.int64)
            for text, _, _, start, _ in anchors(some):
                place[text] = start
            out[begin:end] = parted_masks(some, first[begin:end], place, 0, SPAN - 1)
            at = end
    if at < len(contexts):
        out[at:] = string_masks(contexts[at:], first[at:], group[at:])
    return out


def parted_masks(contexts: list[bytes], first: np.ndarray, place: np.ndarray, low: int, high: int) -> np.ndarray:
    """`string_masks` of different contexts of one anchor, which starts at `place`.

    `low` to `high`: where in its strings the anchor starts. Equal strings have it at the
    same place, so the strings are parted by it in halves; those of a half have some bytes
    beside the anchor in common with all equal ones, and are parted by these. What is
    left at the end is one string, with its copies folded.
    """
    out = np.zeros(len(contexts), np.int64)
    if low == high or len(contexts) < 2:  # each is one string, and they differ
        return out
    middle = (low + high) // 2
    for a, b in ((low, middle), (middle + 1, high)):
        parts: dict[bytes, dict[bytes, list[int]]] = {}
        begin = np.maximum(0, place - b)
        for i, (s, p, c) in enumerate(zip(begin.tolist(), place.tolist(), contexts, strict=True)):
            e = min(len(c) - LENGTH, p - a)
            if s <= e:
                parts.setdefault(c[p - a : p - b + LENGTH], {}).setdefault(c[s : e + LENGTH], []).append(i)
        held: list[dict[bytes, list[int]]] = []
        volume = 0
        for x in (*parts.values(), None):  # None: the last array
            size = sum(map(len, x)) if x else 0
            if held and (x is None or volume + size > ARRAY_BYTES):
                texts = [c for y in held for c in y]
                who = [y[c] for y in held for c in y]
                least = np.array([first[w].min() for w in who])
                of = np.repeat(np.arange(len(held)), [len(y) for y in held])
                if len(held) == 1 and volume > ARRAY_BYTES:
                    masks = parted_masks(texts, least, np.array([place[w[0]] - begin[w[0]] for w in who]), a, b)
                else:
                    masks = string_masks(texts, least, of)
                for c, w, m, mask in zip(texts, who, least.tolist(), masks.tolist(), strict=True):
                    whole = (1 << (len(c) - LENGTH + 1)) - 1
                    for i in w:
                        out[i] |= (whole if first[i] > m else mask) << int(begin[i])
                held, volume = [], 0
            if x:
                held.append(x)
                volume += size
    return out


def string_masks(contexts: list[bytes], first: np.ndarray, group: np.ndarray) -> np.ndarray:
    """For each context, the bits of its strings that a smaller document has, by a suffix array of all.

    `group`: each context's anchor; contexts of one anchor follow each other.
    """
    out = np.zeros(len(contexts), np.int64)
    alone = np.ones(len(group), bool)
    same = group[1:] == group[:-1]
    alone[1:][same] = alone[:-1][same] = False
    which = np.flatnonzero(~alone)  # a context alone with its anchor shares no string with another
    if not len(which):
        return out
    joined = np.frombuffer(b"\0".join(contexts[i] for i in which) + bytes(LENGTH), np.uint8)
    lengths = np.array([len(contexts[i]) for i in which])
    starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    ends = starts + lengths
    text = joined[: ends[-1]].astype(np.int64) + 2
    text[ends[:-1]] = 1
    order = suffix_order(text, LEVELS)
    owner = np.repeat(np.arange(len(which)), lengths + 1)[: len(text)]
    order = order[order + LENGTH <= ends[owner[order]]]  # suffixes that begin with a whole string
    wide = np.lib.stride_tricks.sliding_window_view(joined, 8)
    eight = np.ascontiguousarray(wide).view(np.uint64).ravel()
    a, b = order[:-1], order[1:]
    equal = np.ones(len(a), bool)
    for at in (*range(0, LENGTH - 8, 8), LENGTH - 8):
        equal &= eight[a + at] == eight[b + at]
    new = np.flatnonzero(np.concatenate([[True], ~equal]))
    own = first[which][owner[order]]
    least = np.repeat(np.minimum.reduceat(own, new), np.diff(np.append(new, len(order))))
    hit = least < own
    np.bitwise_or.at(out, which[owner[order[hit]]], np.int64(1) << (order[hit] - starts[owner[order[hit]]]))
    return out


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A byte goes where a 50-byte string that covers it also starts in a document with a
    smaller id. Texts are taken as UTF-8, null as empty; strings do not cross documents
    and are judged on the input. A null id ranks below all others. Rows that repeat an
    id and a text are alike; other rows that repeat an id are judged each against
    smaller ids. An empty table gives an empty result. Other columns are not read.
    """
    rows, judged = repeated_spans(docs, id_col, text_col)
    n = rows.count()
    met = skew_join(rows, judged.withColumnRenamed("digest_", "digest"), "digest", F.col("doc_id"), n)
    copy = (F.col("doc_id") != F.col("rep")) & (F.col("n_bytes") >= LENGTH)
    return met.select(
        F.nullif("doc_id", F.lit(NULL_ID)).alias("doc_id"),
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(copy, F.lit(1)).otherwise(F.col("n_spans")).cast("long").alias("n_spans"),
        F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
    )
