"""Vector code compression: product codes by Lloyd rounds with Hamerly's bounds, in whole numbers.

A vector is cut into parts, each with a codebook of its own. Each round assigns every
part to its nearest entry and replaces each entry by the floored mean of its parts.
Between rounds a row keeps, part by part, its entry, one upper bound of the distance to
it and one lower bound of that to the second nearest. When entries move, the bounds
move by as much; where the upper one stays strictly below the lower one, or below half
the distance from its entry to the next, no distance is computed. Elsewhere the upper
bound is made exact, and where that fails too all entries are compared in whole numbers,
ties to the lower index. Bounds are rounded outwards, so rounding never hides a tie.

A round is one pass, written with its state into the shared folder, as lost tasks then
repeat alone. A task's last row holds the sums of its parts; they are added up in Spark,
and the driver gets the sums of PARTS * ENTRIES entries, whatever the input.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, remove, scratch, skew_join

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Components beyond it are refused: their squared distances would not fit a long.
LIMIT = 1 << 29
STATE = "vec_id long, label_ string, x binary, code binary, upper binary, lower binary, sums array<long>, error long"


def up(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x, np.inf, dtype=x.dtype)


def down(x: np.ndarray) -> np.ndarray:
    return np.maximum(np.nextafter(x, -np.inf, dtype=x.dtype), 0)


def packed(a: np.ndarray) -> pa.Array:
    """A row of `a` as the bytes of one binary value."""
    a = np.ascontiguousarray(a)
    width = a.shape[1] * a.itemsize
    return pa.Array.from_buffers(pa.binary(), len(a), [None, pa.py_buffer(np.arange(0, width * len(a) + 1, width or 1, dtype=np.int32)[: len(a) + 1].tobytes()), pa.py_buffer(a.tobytes())])


def unpacked(column: pa.Array, kind, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width)


class Codebooks:
    """Entries [parts, entries, width], how far each entry moved to get there, and half the distance from each to its next."""

    def __init__(self, entries: np.ndarray, before: np.ndarray | None = None):
        self.entries = entries
        parts, count, _ = entries.shape
        self.moved, self.most_other = np.zeros((parts, count)), np.zeros((parts, count))
        if before is not None:
            self.moved = np.where((entries != before).any(axis=2), up(np.sqrt(((entries - before) ** 2).sum(axis=2).astype(np.float64))), 0.0)
            if count > 1:
                order = np.sort(self.moved, axis=1)
                self.most_other = np.where(self.moved == order[:, -1:], order[:, -2:-1], order[:, -1:])
                self.most_other = np.where((self.moved == order[:, -1:]).sum(axis=1, keepdims=True) > 1, order[:, -1:], self.most_other)
        gaps = ((entries[:, :, None] - entries[:, None]) ** 2).sum(axis=3).astype(np.float64)
        gaps[:, np.arange(count), np.arange(count)] = np.inf
        self.half = down(np.sqrt(gaps.min(axis=2)) / 2) if count > 1 else np.full((parts, count), np.inf)


def assigned(x: np.ndarray, books: Codebooks, state: tuple[np.ndarray, np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Code, upper and lower bound of each part of each row of x [rows, parts, width], and how many parts were compared with all entries.

    `state` has those of the round before, under the entries from which the books moved.
    """
    rows, parts, _ = x.shape
    place = np.arange(parts)
    if state is None:
        code, upper, lower = np.zeros((rows, parts), np.uint8), np.zeros((rows, parts), np.float32), np.zeros((rows, parts), np.float32)
        fails = np.ones((rows, parts), bool)
    else:
        code, upper, lower = (a.copy() for a in state)
        upper = up(up((upper + books.moved[place, code]).astype(np.float32)))
        lower = down(down(np.maximum(lower - books.most_other[place, code], 0).astype(np.float32)))
        bound = np.maximum(lower, books.half[place, code])
        fails = ~(upper < bound)
        r, p = np.nonzero(fails)
        exact = ((x[r, p] - books.entries[p, code[r, p]]) ** 2).sum(axis=1)
        upper[r, p] = up(up(np.sqrt(exact.astype(np.float64))).astype(np.float32))
        fails[r, p] = ~(upper[r, p] < bound[r, p])
    scanned = 0
    for p in range(parts):
        r = np.flatnonzero(fails[:, p])
        scanned += len(r)
        for at in range(0, len(r), 4096):
            some = r[at : at + 4096]
            d = ((x[some, p, None] - books.entries[p][None]) ** 2).sum(axis=2)
            best = d.argmin(axis=1)  # the first of equals
            code[some, p] = best
            upper[some, p] = up(up(np.sqrt(d[np.arange(len(some)), best].astype(np.float64))).astype(np.float32))
            d[np.arange(len(some)), best] = np.iinfo(np.int64).max
            lower[some, p] = down(down(np.sqrt(d.min(axis=1).astype(np.float64))).astype(np.float32))
    return code, upper, lower, scanned


def part_sums(x: np.ndarray, code: np.ndarray, count: int) -> np.ndarray:
    """[parts, entries, width + 1]: the sums of each entry's parts and, last, their number."""
    rows, parts, width = x.shape
    out = np.zeros((parts, count, width + 1), np.int64)
    for p in range(parts):
        order = np.argsort(code[:, p], kind="stable")
        n = np.bincount(code[:, p], minlength=count)
        some = np.flatnonzero(n)
        if rows:
            out[p, some, :width] = np.add.reduceat(x[order, p], np.concatenate([[0], np.cumsum(n[some])[:-1]]), axis=0)
        out[p, :, width] = n
    return out


def finite(v: Column) -> Column:
    return F.coalesce(v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))), F.lit(False))


def sizes(table: DataFrame, id_col: str, vector_col: str, parts: int) -> DataFrame:
    """(vec_id, dim) of the finite vectors that cut into equal parts."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    return table.filter(finite(v) & (F.size(v) > 0) & (F.size(v) % parts == 0)).select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.size(v).alias("dim"))


def kept_vectors(table: DataFrame, id_col: str, vector_col: str, label_col: str, dim: int) -> DataFrame:
    """(vec_id, label_, v) of the finite vectors with `dim` components; label_ names a label, null too, by a string that is never null."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    label = F.coalesce(F.concat(F.lit("="), F.col(f"`{label_col}`").cast("string")), F.lit("null"))
    return table.filter(finite(v) & (F.size(v) == dim)).select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), label.alias("label_"), v.alias("v"))


def whole(v: np.ndarray) -> np.ndarray:
    x = np.floor(SCALE * v)
    if (np.abs(x) > LIMIT).any():
        raise ArithmeticError(f"vector components beyond {LIMIT // SCALE} have squared distances that do not fit a long")
    return x.astype(np.int64)


def codebooks_sha256(entries: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, entries.ravel().tolist())).encode()).hexdigest()


def vector_codes(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """One row a kept vector (vec_id, label_, code (binary, an index a part), error), and the codebooks [parts, entries, width].

    Component x counts as floor(4096 x). A codebook starts as the parts of the vectors with
    the smallest ids (a null id ranks last, equal ids by their components; with fewer
    vectors than entries it has as many entries as vectors); unused entries stay. Vectors
    that are null or hold null, NaN or infinite components are dropped, as are those with
    another number of components than the first; that number must divide by `parts`. Rows
    that repeat an id are coded each for itself. An empty table gives an empty result.
    Other columns are not read. Components beyond 2^17 are an error.
    """
    spark = table.sparkSession
    found = sizes(table, id_col, vector_col, parts).orderBy(F.col("vec_id").asc_nulls_last(), "dim").limit(1).collect()
    dim = found[0]["dim"] if found else 0
    width = dim // parts
    rows = kept_vectors(table, id_col, vector_col, label_col, dim)
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect() if dim else []
    if not first:
        return spark.createDataFrame([], "vec_id long, label_ string, code binary, error long"), np.zeros((parts, 0, width), np.int64)
    books = Codebooks(whole(np.array([r["v"] for r in first])).reshape(len(first), parts, width).swapaxes(0, 1).copy())

    def one_round(state: DataFrame, books: Codebooks, begin: bool, last: bool) -> DataFrame:
        count = books.entries.shape[1]

        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((parts, count, width + 1), np.int64)
            for batch in batches:
                n = batch.num_rows
                if not n:
                    continue
                held = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
                if begin:
                    x, before = whole(held["v"].flatten().to_numpy(zero_copy_only=False).reshape(n, dim)), None
                else:
                    x = unpacked(held["x"], np.int32, dim).astype(np.int64)
                    before = unpacked(held["code"], np.uint8, parts), unpacked(held["upper"], np.float32, parts), unpacked(held["lower"], np.float32, parts)
                x = x.reshape(n, parts, width)
                code, upper, lower, _ = assigned(x, books, before)
                none = pa.nulls(n, pa.binary())
                error = pa.nulls(n, pa.int64())
                if last:
                    error = pa.array(((x - books.entries[np.arange(parts), code]) ** 2).sum(axis=(1, 2)))
                else:
                    sums += part_sums(x, code, count)
                kept = [none] * 3 if last else [packed(x.reshape(n, dim).astype(np.int32)), packed(upper), packed(lower)]
                yield pa.RecordBatch.from_arrays([held["vec_id"], held["label_"].cast(pa.string()), kept[0], packed(code), kept[1], kept[2], pa.nulls(n, pa.list_(pa.int64())), error], names=[c.split()[0] for c in STATE.split(", ")])
            if not last:
                one = [pa.nulls(1, t) for t in (pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.binary(), pa.binary())]
                yield pa.RecordBatch.from_arrays([*one, pa.array([sums.ravel().tolist()], pa.list_(pa.int64())), pa.nulls(1, pa.int64())], names=[c.split()[0] for c in STATE.split(", ")])

        return state.mapInArrow(step, STATE)

    path = None
    for r in range(rounds + 1):
        state = rows if path is None else spark.read.schema(STATE).parquet(path).filter("sums is null")
        out = one_round(state, books, path is None, r == rounds)
        next_path = scratch(spark, "codes")
        out = materialize(out, next_path)
        if path:
            remove(spark, path)
        path = next_path
        if r < rounds:
            added = out.filter("sums is not null").select(F.posexplode("sums")).groupBy("pos").agg(F.sum("col").alias("n")).collect()
            sums = np.zeros(books.entries.shape[:2] + (width + 1,), np.int64)
            for row in added:
                sums.ravel()[row["pos"]] = row["n"]
            used = sums[:, :, width:] > 0
            books = Codebooks(np.where(used, sums[:, :, :width] // np.maximum(sums[:, :, width:], 1), books.entries), books.entries)
    return out.select("vec_id", "label_", "code", "error"), books.entries


def with_label_errors(coded: DataFrame) -> DataFrame:
    """`coded` with label_error, the sum of the errors of its label; a label that most rows have is joined in shares."""
    sums = coded.groupBy("label_").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n_label"))
    return skew_join(coded, sums, "label_", F.xxhash64("vec_id"), coded.count(), counts="n_label").drop("n_label")


def hex_codes(code: Column) -> Column:
    return F.lower(F.hex(code))
