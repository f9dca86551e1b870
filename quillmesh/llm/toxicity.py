"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A word enters as two parts: its own embedding, where enough training documents have the
word, and the mean of embeddings of its character n-grams. Two GRUs read a window of words in either
direction, attention pools their states, a logistic unit scores the window. Windows
overlap and cover the whole text; a document's score is that of its highest window,
calibrated. Training sees documents' labels only (multiple-instance learning): the
windows of a document share its error by a softmax of their logits, ever sharper.

The model is fitted on the driver, on a bounded sample of labelled documents; scoring
is one pass over the documents without a shuffle.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held

#: Words a window, and from one window's start to the next.
WINDOW, STRIDE = 32, 24
OVERLAP = WINDOW - STRIDE
CHAR_ROWS, SIDE, HIDDEN = 1 << 14, 8, 8
#: Words in fewer training documents are read by their characters alone.
LEAST_DF = 6
#: Labelled documents of each label that training takes at most, and windows of each of
#: them at most. Both bound the fit alone; scoring covers everything.
TRAIN_DOCS, TRAIN_WINDOWS = 1200, 16
EPOCHS, LEAST_STEPS, BATCH, RATE = 6, 240, 32, 0.005
#: Sharpness of the softmax over a document's windows, in the first and the last epoch.
SHARP = (1.0, 4.0)
TOKEN = re.compile(r"\w+")
#: Documents at or above this score are rejected.
REJECT = 0.7


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the words' character n-grams, 3 to 5 characters with both ends marked: concatenated, and how many a word has."""
    text = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), [len(w) + 2 for w in words])
    rows, owners = [], []
    with np.errstate(over="ignore"):
        for n in (3, 4, 5):
            m = len(text) - n + 1
            h = np.full(max(0, m), n, np.uint64)
            for j in range(n):
                h = (h ^ text[j : j + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            inside = owner[: len(h)] == owner[n - 1 : n - 1 + len(h)]
            rows.append(h[inside] % np.uint64(CHAR_ROWS))
            owners.append(owner[: len(h)][inside])
    owner = np.concatenate(owners)
    return np.concatenate(rows).astype(np.int64)[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(words))


def words_of(text: str | None) -> list[str]:
    """Words in lower case, long ones in pieces of 32 characters."""
    found = TOKEN.findall((text or "").lower())
    if found and len(max(found, key=len)) > 32:
        found = [w[i : i + 32] for w in found for i in range(0, len(w), 32)]
    return found


def window_starts(n: int) -> list[int]:
    """Starts of all windows of n words."""
    return list(range(0, max(1, n - OVERLAP), STRIDE))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Model:
    """Parameters by name; windows are (batch, WINDOW) arrays of word inputs."""

    def __init__(self, words: list[str] = (), seed: int = 7):
        r = np.random.default_rng(seed)
        self.rows = {w: i + 1 for i, w in enumerate(words)}  # row 0 stands for all others
        f = lambda *shape: (r.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {"word": 0.1 * r.standard_normal((len(words) + 1, SIDE)).astype(np.float32), "char": 0.1 * r.standard_normal((CHAR_ROWS, SIDE)).astype(np.float32)}
        for d in "fb":
            self.p |= {f"W{d}": f(2 * SIDE, 3 * HIDDEN), f"U{d}": f(HIDDEN, 3 * HIDDEN), f"b{d}": np.zeros(3 * HIDDEN, np.float32)}
        self.p |= {"A": f(2 * HIDDEN, HIDDEN), "a": f(HIDDEN), "v": f(2 * HIDDEN), "c": np.full(1, -1, np.float32)}
        self.scale, self.shift, self.name = 1.0, 0.0, uuid.uuid4().hex

    def inputs(self, word_rows: np.ndarray, gram_rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """(words, 2 SIDE) from each word's row and its concatenated gram rows."""
        ends = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        chars = np.add.reduceat(self.p["char"][gram_rows], ends, axis=0) / np.sqrt(lengths)[:, None]
        return np.concatenate([self.p["word"][word_rows], chars.astype(np.float32)], axis=1)

    def run(self, projected: dict[str, np.ndarray], index: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits of windows. projected[d]: each word's input to the gates; index, mask: (batch, WINDOW)."""
        batch = len(index)
        states, trace = np.zeros((2, WINDOW, batch, HIDDEN), np.float32), {}
        for k, d in enumerate("fb"):
            u, h = self.p[f"U{d}"], np.zeros((batch, HIDDEN), np.float32)
            for t in range(WINDOW) if d == "f" else range(WINDOW - 1, -1, -1):
                x, m = projected[d][index[:, t]], mask[:, t, None]
                s = h @ u
                zr = sigmoid(x[:, : 2 * HIDDEN] + s[:, : 2 * HIDDEN])
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                q = s[:, 2 * HIDDEN :]
                n = np.tanh(x[:, 2 * HIDDEN :] + r * q)
                new = h + m * (1 - z) * (n - h)
                if keep:
                    trace[d, t] = (h, z, r, q, n)
                h = states[k, t] = new
        both = np.concatenate([states[0], states[1]], axis=2)
        hidden = np.tanh(both @ self.p["A"])
        e = hidden @ self.p["a"] + (mask.T - 1) * 1e4
        w = np.exp(e - e.max(axis=0))
        w /= w.sum(axis=0)
        pooled = np.einsum("tb,tbh->bh", w, both)
        return pooled @ self.p["v"] + self.p["c"][0], (trace, both, hidden, w, pooled)

    def project(self, x: np.ndarray) -> dict[str, np.ndarray]:
        return {d: x @ self.p[f"W{d}"] + self.p[f"b{d}"] for d in "fb"}

    def gradients(self, x: np.ndarray, index: np.ndarray, mask: np.ndarray, delta: np.ndarray, kept) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of sum(delta * logit) by parameter, and by the words' inputs x."""
        trace, both, hidden, w, pooled = kept
        g = {"v": pooled.T @ delta, "c": np.array([delta.sum()], np.float32)}
        dp = delta[:, None] * self.p["v"]
        dboth = w[:, :, None] * dp
        dw = np.einsum("tbh,bh->tb", both, dp)
        de = w * (dw - (w * dw).sum(axis=0))
        g["a"] = np.einsum("tb,tbh->h", de, hidden)
        dh = de[:, :, None] * self.p["a"] * (1 - hidden**2)
        g["A"] = np.einsum("tbi,tbj->ij", both, dh)
        dboth = dboth + dh @ self.p["A"].T
        dx = np.zeros_like(x)
        for k, d in enumerate("fb"):
            u = self.p[f"U{d}"]
            gates = np.zeros((len(x), 3 * HIDDEN), np.float32)
            du, carry = np.zeros_like(u), np.zeros((len(index), HIDDEN), np.float32)
            for t in range(WINDOW - 1, -1, -1) if d == "f" else range(WINDOW):
                h, z, r, q, n = trace[d, t]
                m = mask[:, t, None]
                total = carry + dboth[t, :, k * HIDDEN : (k + 1) * HIDDEN]
                dn = total * m * (1 - z)
                dz = total * m * (h - n)
                da = dn * (1 - n**2)
                dzr = np.concatenate([dz * z * (1 - z), da * q * r * (1 - r)], axis=1)
                ds = np.concatenate([dzr, da * r], axis=1)
                du += h.T @ ds
                carry = total - dn + ds @ u.T
                np.add.at(gates, index[:, t], np.concatenate([dzr, da], axis=1))
            g[f"U{d}"], g[f"W{d}"], g[f"b{d}"] = du, x.T @ gates, gates.sum(axis=0)
            dx += gates @ self.p[f"W{d}"].T
        return g, dx


def windows_of(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(windows, WINDOW) word numbers, and which of them are words."""
    at = np.array(window_starts(len(ids)))[:, None] + np.arange(WINDOW)
    mask = at < len(ids)
    return np.where(mask, ids[np.minimum(at, max(0, len(ids) - 1))] if len(ids) else 0, 0), mask.astype(np.float32)


def fit(texts: list[str], labels: list[int], seed: int = 7) -> Model:
    """Train on whole documents' labels; texts are few (TRAIN_DOCS of each label)."""
    r = np.random.default_rng(seed)
    number: dict[str, int] = {}
    df: Counter[str] = Counter()
    docs = []
    for text in texts:
        df.update(set(words_of(text)))
        ids = np.array([number.setdefault(w, len(number)) for w in words_of(text)], np.int64)
        docs.append(windows_of(ids))
    if not number:
        number[""] = 0
    vocabulary = list(number)
    model = Model(sorted(w for w, n in df.items() if n >= LEAST_DF), seed)
    word_rows = np.array([model.rows.get(w, 0) for w in vocabulary])
    flat, lengths = grams(vocabulary)
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    y = np.array(labels, np.float32)
    share = float(y.sum()) / max(1, len(y))
    weight = np.where(y > 0.5, 0.5 / max(share, 1e-3), 0.5 / max(1 - share, 1e-3))  # labels count alike
    held = r.random(len(docs)) < 0.2  # for the calibration alone
    train = np.flatnonzero(~held)
    # the first coordinates start from the log odds of the label, of documents that have the word or n-gram
    distinct = [np.unique(np.fromiter((number[w] for w in set(words_of(t))), np.int64)) for t in texts]
    in_word, in_gram, have = np.zeros((2, len(vocabulary))), np.zeros((2, CHAR_ROWS)), np.zeros(2)
    for i in train:
        k = int(y[i] > 0.5)
        have[k] += 1
        in_word[k, distinct[i]] += 1
        if len(distinct[i]):
            in_gram[k, np.unique(np.concatenate([flat[offsets[j] : offsets[j + 1]] for j in distinct[i]]))] += 1
    odds = lambda n: np.clip(np.log((n[1] + 1) / (have[1] + 2)) - np.log((n[0] + 1) / (have[0] + 2)), -1, 3)
    known = word_rows > 0
    model.p["word"][word_rows[known], 0] = odds(in_word)[known]
    model.p["word"][0] = 0
    model.p["char"][:, 0] = np.where(in_gram.sum(axis=0) >= LEAST_DF, odds(in_gram), 0)
    told = np.maximum(odds(in_word), 0)
    for i in train:  # of a long document, the windows whose words tell most of the label
        index, mask = docs[i]
        if len(index) > TRAIN_WINDOWS:
            some = np.sort(np.argsort(-(told[index] * mask).sum(axis=1), kind="stable")[:TRAIN_WINDOWS])
            docs[i] = index[some], mask[some]
    first = {k: np.zeros_like(v) for k, v in model.p.items()}
    second = {k: np.zeros_like(v) for k, v in model.p.items()}
    step = 0

    def logits(which: np.ndarray, keep: bool):
        index = np.concatenate([docs[i][0] for i in which])
        mask = np.concatenate([docs[i][1] for i in which])
        owner = np.repeat(np.arange(len(which)), [len(docs[i][0]) for i in which])
        used, local = np.unique(index, return_inverse=True)
        parts = np.concatenate([flat[offsets[i] : offsets[i + 1]] for i in used])
        x = model.inputs(word_rows[used], parts, lengths[used])
        out, kept = model.run(model.project(x), local.reshape(index.shape), mask, keep)
        best = np.full(len(which), -np.inf, np.float32)
        np.maximum.at(best, owner, out)
        return best.astype(np.float64), out, owner, x, local.reshape(index.shape), mask, used, parts, kept

    epochs = max(EPOCHS, -(-LEAST_STEPS * BATCH // max(1, len(train))))
    for epoch in range(epochs):
        rate = RATE * (0.4 if epoch > epochs * 0.6 else 1)
        sharp = SHARP[0] + (SHARP[1] - SHARP[0]) * epoch / max(1, epochs - 1)
        r.shuffle(train)
        for at in range(0, len(train), BATCH):
            which = train[at : at + BATCH]
            best, out, owner, x, index, mask, used, parts, kept = logits(which, True)
            share = np.exp(sharp * (out - best[owner]))
            total = np.bincount(owner, share, len(which))
            windows = np.bincount(owner, minlength=len(which))
            pooled = best + np.log(total / windows) / sharp
            error = (sigmoid(pooled) - (0.03 + 0.94 * y[which])) * weight[which]
            delta = (share / total[owner] * error[owner] / len(which)).astype(np.float32)
            g, dx = model.gradients(x, index, mask, delta, kept)
            g["word"] = np.zeros_like(model.p["word"])
            np.add.at(g["word"], word_rows[used], dx[:, :SIDE])
            g["char"] = np.zeros_like(model.p["char"])
            np.add.at(g["char"], parts, np.repeat(dx[:, SIDE:] / np.sqrt(lengths[used])[:, None], lengths[used], axis=0))
            step += 1
            for k, v in g.items():
                v = v + 1e-5 * model.p[k]
                first[k] = 0.9 * first[k] + 0.1 * v
                second[k] = 0.99 * second[k] + 0.01 * v * v
                model.p[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    if len(set(labels)) < 2:  # nothing tells the labels apart: every text gets the score of an unknown one
        model.scale, model.shift = 0.0, float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))) if min(labels, default=0) == 0 else 0.0
    elif held.any():
        model.scale, model.shift = calibrate(Scorer(model).best([texts[i] for i in np.flatnonzero(held)]), y[held])  # on all windows
    return model


def calibrate(logit: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scale and shift that make sigmoid(scale * logit + shift) a probability (Platt, damped Newton steps)."""
    mean, sd = float(logit.mean()), float(logit.std()) + 1e-6
    x = (logit - mean) / sd
    target = np.where(y > 0.5, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        d, w = p - target, p * (1 - p) + 1e-3
        h = np.array([[(w * x * x).sum() + 0.1, (w * x).sum()], [(w * x).sum(), w.sum() + 0.1]])
        move = np.linalg.solve(h, [(d * x).sum() + 0.1 * a, d.sum()])
        a, b = a - float(np.clip(move[0], -1, 1)), b - float(np.clip(move[1], -1, 1))
    a = max(a, 0.05)
    return a / sd, b - a * mean / sd


class Scorer:
    """Scores batches of texts; remembers words' gate inputs up to a bound."""

    BOUND = 500_000
    STEP = 2048  # windows at a time

    def __init__(self, model: Model):
        self.model, self.known = model, {}
        self.table = {d: np.zeros((self.BOUND + 1, 3 * HIDDEN), np.float32) for d in "fb"}

    def _learn(self, words: list[str]) -> None:
        rows = np.array([self.model.rows.get(w, 0) for w in words])
        x = self.model.inputs(rows, *grams(words))
        at = len(self.known)
        for d, v in self.model.project(x).items():
            self.table[d][at : at + len(words)] = v
        self.known.update(zip(words, range(at, at + len(words)), strict=True))

    def _numbers(self, words: list[str]) -> np.ndarray:
        get = self.known.get
        out = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        if (missing := np.flatnonzero(out < 0)).size:
            new = list(dict.fromkeys(words[i] for i in missing))
            if len(self.known) + len(new) > self.BOUND:
                self.known = {}
                new = list(dict.fromkeys(words))
            self._learn(new)
            out = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        return out

    def logits(self, text: str | None) -> Iterator[np.ndarray]:
        """The logits of all windows of a text, some at a time; an empty text has one empty window."""
        words = words_of(text)
        span = self.STEP * STRIDE
        for at in range(0, max(1, len(words) - OVERLAP), span):
            index, mask = windows_of(self._numbers(words[at : at + span + OVERLAP]))
            yield self.model.run({d: self.table[d] for d in "fb"}, index, mask)[0]

    def best(self, texts: list[str | None]) -> np.ndarray:
        """The largest logit of all windows of each text."""
        best = np.full(len(texts), -np.inf)
        held, owners, size = [], [], 0

        def flush() -> None:
            nonlocal held, owners, size
            if held:
                index, mask = (np.concatenate(x) for x in zip(*held, strict=True))
                np.maximum.at(best, np.concatenate(owners), self.model.run(self.table, index, mask)[0])
            held, owners, size = [], [], 0

        for i, text in enumerate(texts):
            words = words_of(text)
            if len(words) > self.STEP * STRIDE // 4:
                flush()
                for part in self.logits(text):
                    best[i] = max(best[i], part.max())
                continue
            before = self.known
            numbers = self._numbers(words) if words else np.empty(0, np.int64)
            if self.known is not before and held:  # the numbers of held windows are void
                todo = sorted({int(o[0]) for o in owners})
                held, owners, size = [], [], 0
                for j in todo:
                    for part in self.logits(texts[j]):
                        best[j] = max(best[j], part.max())
                numbers = self._numbers(words) if words else numbers
            index, mask = windows_of(numbers)
            held.append((index, mask))
            owners.append(np.full(len(index), i))
            size += len(index)
            if size >= self.STEP:
                flush()
        flush()
        return best

    def score(self, texts: list[str | None]) -> np.ndarray:
        z = self.model.scale * self.best(texts) + self.model.shift
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def scorer_of(model: Model) -> Scorer:
    """The worker's scorer of a model, with the words that it has met."""
    return held(f"scorer {model.name}", lambda: Scorer(model))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", held_out=None, per_label: int = TRAIN_DOCS) -> Model:
    """Fit on at most `per_label` labelled documents of each label, taken by a hash of the id.

    `held_out(id)` is a condition on rows that training must not see. Rows without a
    label, id or text are not used. Where there are no rows of one label, nothing tells
    the labels apart and all texts get one score, below REJECT.
    """
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label_")).filter("label_ in (0, 1) and doc_id is not null")
    if held_out is not None:
        known = known.filter(~held_out(F.col("doc_id")))
    some = [known.filter(F.col("label_") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label) for y in (0, 1)]
    wanted = F.broadcast(some[0].union(some[1]))  # 2 * per_label rows at most
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text_")).filter("text_ is not null").join(wanted, "doc_id").collect()
    rows = sorted(rows, key=lambda r: (r.doc_id, r.text_))
    return fit([r.text_ for r in rows], [r.label_ for r in rows])


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, score (0 to 1). Null and empty texts get the score of no words.

    Rows with null or repeated ids are scored each for itself; equal texts get equal
    scores up to rounding. Other columns are not read.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = scorer_of(shipped.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scorer.score(batch.column(1).to_pylist()), pa.float64())], names=["doc_id", "score"])

    return docs.selectExpr(f"cast(`{id_col}` as bigint) doc_id", f"`{text_col}`").mapInArrow(run, "doc_id long, score double")


def without_toxic(docs: DataFrame, model: Model, text_col: str = "text", reject: float = REJECT) -> DataFrame:
    """The rows of `docs`, with all their columns, that score below `reject`."""
    at, shipped = docs.columns.index(text_col), docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = scorer_of(shipped.value)
        for batch in batches:
            yield batch.filter(pa.array(scorer.score(batch.column(at).to_pylist()) < reject, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
