"""Quality by co-training of two views.

One classifier reads the text's content, another the metadata beside it (language,
source, lengths and layout counts). Each is trained on the labelled documents; over
rounds each gives its most confident pseudo-labels, of either label, to the other's
training set; they are found among all unlabelled documents, by a pass over them a round. The views are then calibrated on labelled documents that neither has
trained on, and combined by the calibrated log odds, weighted on the same documents.

The fit runs on the driver, on a bounded sample of labelled documents and the pseudo-labels
of all rounds (GIVEN bounds them); scoring is one pass over the documents without a shuffle.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, scratch
from .toxicity import calibrate

#: Labelled documents of each label that the fit takes at most.
TRAIN_DOCS = 1500
ROUNDS = 4
#: Pseudo-labels of each label that a view gives to the other in a round, and the
#: probability that they need at least.
GIVEN, CONFIDENT = 100, 0.95
BUCKETS, META_BUCKETS = 2048, 256
KEEP = 0.5


def content(text: str | None) -> np.ndarray:
    """The content view: character pairs by hash and shares of kinds of bytes, words and repeats."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    out = np.zeros(BUCKETS + 12, np.float32)
    if not len(data):
        return out
    n = len(data)
    if n > 1:
        code = data[:-1].astype(np.uint32) << 8 | data[1:]
        pairs = np.bincount((code * np.uint32(2654435761)) >> np.uint32(21), minlength=BUCKETS)
        out[:BUCKETS] = np.sqrt(pairs / (n - 1))
    count = np.bincount(data, minlength=256)
    letters = count[65:91].sum() + count[97:123].sum() + count[128:].sum()
    words = data.tobytes().lower().split()
    lines = data.tobytes().split(b"\n")
    k = max(1, len(words))
    out[BUCKETS:] = [
        letters / n,
        count[48:58].sum() / n,
        (count[33:48].sum() + count[58:65].sum() + count[91:97].sum() + count[123:127].sum()) / n,
        count[65:91].sum() / max(1, letters),
        count[32] / n,
        len(set(words)) / k,
        min(1.0, sum(map(len, words)) / k / 20),
        len(set(lines)) / len(lines),
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / k,
        count[46] / k,
        count[124] / k,
        1.0,
    ]
    return out


def metadata(lang: str | None, source: str | None, n_chars: int | None, text: str | None) -> np.ndarray:
    """The metadata view: language, source and lengths; no content of the text."""
    out = np.zeros(META_BUCKETS + 4, np.float32)
    size = len(text or "") if n_chars is None else max(0, n_chars)
    lines = (text or "").count("\n") + 1
    for name in (f"lang {lang}", f"source {source}", f"size {size.bit_length()}", f"lines {lines.bit_length()}", f"mean {(size // lines).bit_length()}", f"{lang} {size.bit_length()}"):
        out[zlib.crc32(name.encode("utf-8", "surrogatepass")) % META_BUCKETS] = 1
    out[META_BUCKETS:] = [np.log1p(size) / 12, np.log1p(lines) / 8, np.log1p(size / lines) / 10, 1]
    return out


class Logistic:
    """Logistic regression by Adam on standardised inputs, labels counting alike."""

    def __init__(self, x: np.ndarray, y: np.ndarray, penalty: float, steps: int = 300):
        self.mean, self.sd = x.mean(axis=0), x.std(axis=0) + 1e-3
        x = np.clip((x - self.mean) / self.sd, -5, 5)
        share = min(max(y.mean(), 1e-3), 1 - 1e-3)
        weight = np.where(y > 0.5, 0.5 / share, 0.5 / (1 - share))
        self.w, self.b = np.zeros(x.shape[1]), 0.0
        m, v = np.zeros(len(self.w) + 1), np.zeros(len(self.w) + 1)
        for t in range(1, steps + 1):
            error = weight * (1 / (1 + np.exp(-np.clip(x @ self.w + self.b, -30, 30))) - y) / len(y)
            g = np.append(error @ x + penalty * self.w, error.sum())
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            move = 0.02 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
            self.w, self.b = self.w - move[:-1], self.b - move[-1]

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.sd, -5, 5) @ self.w + self.b


class Model:
    """Both views and how they combine."""

    def __init__(self, views: list[Logistic], scales: list[tuple[float, float]], weights: np.ndarray):
        self.views, self.scales, self.weights = views, scales, weights

    def scores(self, x: list[np.ndarray]) -> tuple[np.ndarray, ...]:
        """Probabilities by content, by metadata and combined."""
        z = [a * view.logit(part) + b for view, part, (a, b) in zip(self.views, x, self.scales, strict=True)]
        both = self.weights[0] * z[0] + self.weights[1] * z[1] + self.weights[2]
        return tuple(1 / (1 + np.exp(-np.clip(s, -60, 60))) for s in (*z, both))


#: (view, 0 or 1) -> the rows that the view gives that label, as the two views' inputs.
Pick = Callable[[list[Logistic], int], dict[tuple[int, int], list[np.ndarray]]]


def co_train(x: list[np.ndarray], y: np.ndarray, pick: Pick, seed: int = 11) -> Model:
    """x: rows of the two views; y: their labels; pick(views, round): the pseudo-labels that each view is surest of."""
    r = np.random.default_rng(seed)
    held = r.random(len(y)) < 0.25  # for calibration and weights alone
    if min(y[held].sum(), (1 - y[held]).sum(), y[~held].sum(), (1 - y[~held]).sum()) < 1:
        held[:] = False
    sets = [(part[~held], y[~held].astype(float)) for part in x]
    penalty = (3e-3, 1e-3)
    views = [Logistic(*sets[k], penalty[k]) for k in (0, 1)]
    for at in range(ROUNDS):
        given = pick(views, at)
        if not any(len(rows[0]) for rows in given.values()):
            break
        for k in (0, 1):  # each view labels for the other
            for label in (0, 1):
                rows = given.get((1 - k, label))
                if rows is not None and len(rows[k]):
                    sets[k] = (np.concatenate([sets[k][0], rows[k]]), np.concatenate([sets[k][1], np.full(len(rows[k]), float(label))]))
        views = [Logistic(*sets[k], penalty[k]) for k in (0, 1)]
    test = held if held.any() else np.ones(len(y), bool)
    z = [views[k].logit(x[k][test]) for k in (0, 1)]
    scales = [calibrate(z[k], y[test]) for k in (0, 1)]
    both = np.stack([a * part + b for part, (a, b) in zip(z, scales, strict=True)], axis=1)
    top = Logistic(both, y[test], 1e-3, 200)
    weights = np.maximum(top.w / top.sd, 0)
    if not weights.any():
        weights = np.ones(2) / 2
    a, b = calibrate(both @ weights, y[test])
    return Model(views, scales, np.append(a * weights, b))


COLUMNS = ("lang", "source", "n_chars")


def _views(rows) -> list[np.ndarray]:
    return [np.stack([content(r.text_) for r in rows]), np.stack([metadata(r.lang, r.source, r.n_chars, r.text_) for r in rows])]


def _read(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    meta = [F.col(c).cast("long" if c == "n_chars" else "string").alias(c) if c in docs.columns else F.lit(None).cast("long" if c == "n_chars" else "string").alias(c) for c in COLUMNS]
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text_"), *meta)


def surest(pool: DataFrame, views: list[Logistic], used: set[int]) -> DataFrame:
    """(view, label, same, p, doc_id): of the pool's texts that are not `used`, those that a view is surest of, GIVEN a view and label at most.

    pool: doc_id, text_, lang, source, n_chars, same (a hash of the text). A text is given
    once, however many rows have it. A task sends its own surest texts alone.
    """
    shipped = pool.sparkSession.sparkContext.broadcast((views, used))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        views, used = shipped.value
        best: dict[tuple[int, int], dict[int, tuple[float, int | None]]] = {(k, label): {} for k in (0, 1) for label in (0, 1)}
        for batch in batches:
            rows = [r for r in batch.to_pylist() if r["same"] not in used]
            for at in range(0, len(rows), 256):
                some = rows[at : at + 256]
                x = [np.stack([content(r["text_"]) for r in some]), np.stack([metadata(r["lang"], r["source"], r["n_chars"], r["text_"]) for r in some])]
                for k in (0, 1):
                    p = 1 / (1 + np.exp(-np.clip(views[k].logit(x[k]), -30, 30)))
                    for label, sure in ((0, 1 - p), (1, p)):
                        mine = best[k, label]
                        for i in np.flatnonzero(sure >= CONFIDENT).tolist():
                            found = (-float(sure[i]), some[i]["doc_id"])
                            mine[some[i]["same"]] = min(mine.get(some[i]["same"], found), found, key=_surer)
                        if len(mine) > 4 * GIVEN:
                            best[k, label] = dict(sorted(mine.items(), key=lambda e: (_surer(e[1]), e[0]))[:GIVEN])
        out = [(k, label, same, -p, doc_id) for (k, label), mine in best.items() for same, (p, doc_id) in sorted(mine.items(), key=lambda e: (_surer(e[1]), e[0]))[:GIVEN]]
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(kinds)], names=["view", "label", "same", "p", "doc_id"])

    found = pool.select("doc_id", "text_", *COLUMNS, "same").mapInArrow(run, "view int, label int, same long, p double, doc_id long")
    once = found.groupBy("view", "label", "same").agg(F.min(F.struct((-F.col("p")).alias("q"), "doc_id")).alias("best"))
    once = materialize(once, scratch(pool.sparkSession, "surest"))  # else each of the parts below takes a pass over the pool
    parts = [once.filter((F.col("view") == k) & (F.col("label") == label)).orderBy("best.q", "same").limit(GIVEN) for k in (0, 1) for label in (0, 1)]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3]).select("view", "label", "same", (-F.col("best.q")).alias("p"), F.col("best.doc_id").alias("doc_id"))


def _surer(found: tuple[float, int | None]) -> tuple[float, bool, int]:
    return found[0], found[1] is not None, found[1] or 0


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", held_out=None, pool_share: int = 1) -> Model | None:
    """Fit on a bounded sample of the labelled documents, taken by a hash, and all others; None where a label has no documents.

    Labelled documents beyond the sample are among the others, their labels unseen. With a
    `pool_share` only one in so many of the other texts is looked at. `held_out(id)` is a condition on rows whose labels training must not see; they take
    no part as unlabelled rows either, nor do rows without a text. Rows that repeat a
    labelled id all have its label (the largest, where it repeats in `labels`); an empty
    table gives None.
    """
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label_")).filter("label_ in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("label_").alias("label_"))
    rows = _read(docs, id_col, text_col).filter("text_ is not null")
    seen: Column = F.lit(True) if held_out is None else ~F.coalesce(held_out(F.col("doc_id")), F.lit(False))
    some = [known.filter(seen & (F.col("label_") == v)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_DOCS) for v in (0, 1)]
    one = F.min(F.struct("text_", *COLUMNS, "label_")).alias("r")  # of rows that repeat an id the first by text
    chosen_ids = materialize(some[0].union(some[1]), scratch(docs.sparkSession, "labelled"))  # 2 * TRAIN_DOCS at most
    labelled = rows.join(F.broadcast(chosen_ids), "doc_id").groupBy("doc_id").agg(one).select("doc_id", "r.*").orderBy("doc_id").collect()  # 2 * TRAIN_DOCS at most
    y = np.array([r.label_ for r in labelled])
    if len(set(y.tolist())) < 2:
        return None
    pool = rows.withColumn("same", F.xxhash64("text_")).filter(seen & (F.pmod("same", F.lit(pool_share)) == 0)).join(F.broadcast(chosen_ids.select("doc_id")), "doc_id", "left_anti")
    used: set[int] = set()

    def pick(views: list[Logistic], _: int) -> dict[tuple[int, int], list[np.ndarray]]:
        chosen = surest(pool, views, used).collect()  # 4 * GIVEN at most
        used.update(c.same for c in chosen)
        keys = F.broadcast(pool.sparkSession.createDataFrame([(c.same, c.doc_id) for c in chosen], "same_ long, id_ long").distinct())
        met = pool.join(keys, (F.col("same") == F.col("same_")) & F.col("doc_id").eqNullSafe(F.col("id_")))
        one = met.groupBy("same").agg(F.min(F.struct(*COLUMNS, "text_")).alias("r")).select("same", "r.*")
        texts = {r.same: r for r in one.collect()} if chosen else {}
        out = {}
        for k in (0, 1):
            for label in (0, 1):
                mine = sorted((c for c in chosen if (c.view, c.label) == (k, label)), key=lambda c: (-c.p, c.same))
                out[k, label] = _views([texts[c.same] for c in mine]) if mine else [np.empty((0, BUCKETS + 12), np.float32), np.empty((0, META_BUCKETS + 4), np.float32)]
        return out

    return co_train(_views(labelled), y, pick)


def scored(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, content_score, metadata_score, score (all 0 to 1), kept.

    kept: score of KEEP or more. Null texts count as empty, missing or null metadata as
    a value of its own. Without a model (no labels) all scores are null and all rows
    kept. Rows with null or repeated ids are scored each for itself. An empty table gives
    an empty result.
    """
    rows = _read(docs, id_col, text_col)
    if model is None:
        none = F.lit(None).cast("double")
        return rows.select("doc_id", none.alias("content_score"), none.alias("metadata_score"), none.alias("score"), F.lit(True).alias("kept"))
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, meta = batch.column(1).to_pylist(), [batch.column(i).to_pylist() for i in (2, 3, 4)]
            parts: list[list[np.ndarray]] = []
            for at in range(0, len(texts), 256):
                x = [np.stack([content(t) for t in texts[at : at + 256]]), np.stack([metadata(*m, t) for *m, t in zip(*(c[at : at + 256] for c in meta), texts[at : at + 256], strict=True)])]
                parts.append(list(shipped.value.scores(x)))
            columns = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.empty(0)] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.float64()) for c in columns), pa.array(columns[2] >= KEEP, pa.bool_())], names=["doc_id", "content_score", "metadata_score", "score", "kept"])

    return rows.mapInArrow(run, "doc_id long, content_score double, metadata_score double, score double, kept boolean")
