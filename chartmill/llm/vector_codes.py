"""Vector code compression: a codebook for each part of the vectors, learned with adaptive distance bounds.

For every part of every vector the b nearest entries of its codebook are kept, with ordered lower bounds of their
distances, and one outer bound for all other entries.  When a codebook has moved, bounds shrink by what the entries
moved; the distance to the assigned entry is computed exactly, and only entries whose lower bound doesn't exceed it are
compared, in integers.  If even the outer bound doesn't, the whole codebook is searched.  b is fitted to each codebook,
from how deep its parts had to look the last time.

The bounds lie beside the vectors' integers in a table in the shared folder, which each round writes anew.  Bounds are
16-bit floats rounded down, so they are never too large.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.lineage import forget, joined_by, stored
from .columnar import as_strings, emit, long, quoted, string, with_columns
from .vectors import exact, finite, scaled

#: Up to so many bits of a component the square sums, times the entries, are exact in doubles.
BITS = 20
#: No entry, in a place of the list that isn't known.
NONE = 255
HEX = np.array([b"%02x" % i for i in range(256)], "S2")
#: The part of a codebook's parts that may look beyond its list.
BEYOND = 1 / 16


def lower(x: np.ndarray) -> np.ndarray:
    """As 16-bit floats, rounded down."""
    with np.errstate(over="ignore"):
        out = x.astype(np.float16)
    return np.where(out > x, np.nextafter(out, np.float16(-np.inf)), out)


class Bounds:
    """Of each row: the known nearest entries, the lower bounds of their distances, and that of all others."""

    def __init__(self, ids: np.ndarray, near: np.ndarray, outer: np.ndarray) -> None:
        self.ids, self.near, self.outer = ids, near, outer

    def cut(self, b: int) -> Bounds:
        """With b entries: more than that join the others, fewer leave places without an entry."""
        have = self.ids.shape[1]
        if b < have:
            return Bounds(self.ids[:, :b], self.near[:, :b], np.minimum(self.outer, self.near[:, b:].min(axis=1)))
        more = ((0, 0), (0, b - have))
        return Bounds(np.pad(self.ids, more, constant_values=NONE), np.concatenate([self.near, np.repeat(self.outer[:, None], b - have, axis=1)], axis=1), self.outer)


def whole_search(x: np.ndarray, entries: np.ndarray, b: int) -> tuple[Bounds, np.ndarray]:
    """The bounds of each row, all exact, and the squared distance of its nearest entry."""
    k = len(entries)
    dtype = object if x.dtype == object else float
    p, e = x.astype(dtype), entries.astype(dtype)
    square = (p * p).sum(axis=1)[:, None] + (e * e).sum(axis=1) - 2 * (p @ e.T)
    rank = square * k + np.arange(k)  # all different: equal distances are ordered by entry
    order = np.argsort(rank, axis=1)[:, : b + 1]
    far = np.take_along_axis(square, order, axis=1)
    roots = np.sqrt(far.astype(float))
    outer = roots[:, b] if b < k else np.full(len(x), np.inf)
    return Bounds(order[:, :b].astype(np.uint8), roots[:, :b], outer).cut(b), far[:, 0].astype(x.dtype)


def bounded_search(x: np.ndarray, entries: np.ndarray, had: Bounds, moved: np.ndarray) -> tuple[Bounds, np.ndarray, np.ndarray]:
    """Bounds after the entries moved so far at most, squared distances, and how many places of the list were compared;
    one more than the list has for a whole search."""
    b = had.ids.shape[1]
    most = moved.max(initial=0.0)
    near = had.near - np.append(moved, np.full(NONE + 1 - len(moved), most))[had.ids]
    outer = had.outer - most
    away = x - entries[had.ids[:, 0]]
    square = (away * away).sum(axis=1)
    root = np.sqrt(square.astype(float)) * (1 + 1e-12)
    least = np.minimum.accumulate(np.concatenate([near[:, 1:], outer[:, None]], axis=1)[:, ::-1], axis=1)[:, ::-1]
    depth = 1 + (root[:, None] >= least).sum(axis=1)  # places from here on are further away than the assigned entry
    known = (had.ids != NONE).sum(axis=1)
    depth[depth > known] = b + 1
    ids, near = had.ids.copy(), near.copy()
    near[:, 0] = np.sqrt(square.astype(float))
    some = np.flatnonzero((depth > 1) & (depth <= b))
    if len(some):
        listed = ids[some]
        away = x[some, None, :] - entries[np.where(listed == NONE, 0, listed)]
        looked = np.arange(b) < depth[some, None]
        far = (away * away).sum(axis=2)
        bound = np.where(looked, np.sqrt(far.astype(float)), near[some])
        order = np.lexsort((listed, bound), axis=1)
        ids[some], near[some] = np.take_along_axis(listed, order, axis=1), np.take_along_axis(bound, order, axis=1)
        square[some] = np.take_along_axis(far, order[:, :1], axis=1)[:, 0]
    full = np.flatnonzero(depth > b)
    if len(full):
        again, square[full] = whole_search(x[full], entries, b)
        ids[full], near[full], outer[full] = again.ids, again.near, again.outer
    return Bounds(ids, near, outer), square, depth


class Codebooks:
    """Entries of each part, how far each moved last, and the length of the lists in the table (before and after)."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries
        parts, k, _ = entries.shape
        self.moved = np.zeros((parts, k))
        self.had = [0] * parts
        self.b = [max(1, k // 8)] * parts

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def step(self, sums: dict[tuple[int, int, int], int], depths: dict[tuple[int, int], int]) -> None:
        """Entries to the floor of their parts' mean, and the lists to the length that nearly all parts looked at."""
        parts, k, w = self.entries.shape
        new = self.entries.tolist()
        for p in range(parts):
            for e in range(k):
                if n := sums.get((p, e, w), 0):
                    new[p][e] = [sums.get((p, e, i), 0) // n for i in range(w)]
        new = np.array(new, np.int64).reshape(self.entries.shape)
        away = new.astype(float) - self.entries.astype(float)
        self.entries, self.moved = new, np.sqrt((away * away).sum(axis=2)) * (1 + 1e-9)
        self.had = list(self.b)
        for p in range(parts):
            seen = [depths.get((p, i), 0) for i in range(NONE + 2)]
            if sum(seen[1:]):  # the first round looks at everything and tells nothing
                beyond = sum(seen[1:]) - np.cumsum(seen)
                need = int(np.flatnonzero(beyond <= BEYOND * sum(seen[1:]))[0])
                self.b[p] = min(max(need, k // 16, 1), max(1, k // 4))


def packed(x: np.ndarray) -> np.ndarray:
    """Rows of integers as bytes, 2, 4 or 8 for each."""
    most = np.abs(x).max(initial=0)
    kind = np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64
    return np.ascontiguousarray(x.astype(kind)).view(np.uint8).reshape(len(x), -1)


def binary(rows: np.ndarray) -> pa.Array:
    """A binary value for each row of bytes."""
    return as_strings(np.arange(len(rows) + 1, dtype=np.int64) * rows.shape[1], np.ascontiguousarray(rows).tobytes(), pa.binary())


def unpacked(column: pa.Array, width: int) -> np.ndarray:
    """Rows of width integers of each value, which may have different sizes."""
    values = column.to_pylist()
    out = np.zeros((len(values), width), np.int64)
    sizes = np.array([len(v) for v in values])
    for size in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == size)
        out[rows] = np.frombuffer(b"".join(values[i] for i in rows.tolist()), np.dtype(f"i{size // width}")).reshape(-1, width)
    return out


def write_state(each: list[tuple[Bounds, np.ndarray]]) -> pa.Array:
    """For each part: how deep it looked, its list, the bounds."""
    cells = []
    for found, depth in each:
        cells += [np.minimum(depth, NONE).astype(np.uint8)[:, None], found.ids, lower(np.column_stack([found.near, found.outer])).view(np.uint8)]
    return binary(np.concatenate(cells, axis=1))


def read_state(column: pa.Array, lists: list[int]) -> list[tuple[Bounds, np.ndarray]]:
    cells = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)
    out, at = [], 0
    for b in lists:
        ids, bounds = cells[:, at + 1 : at + 1 + b], np.ascontiguousarray(cells[:, at + 1 + b : at + 3 + 3 * b]).view(np.float16).astype(float)
        out.append((Bounds(ids, bounds[:, :b], bounds[:, b]), cells[:, at].astype(np.int64)))
        at += 3 + 3 * b
    return out


def assigner(books: Codebooks, last: bool) -> Callable:
    """A kernel from integers (and state, after the first round) to integers and new state, or at the end code and error."""
    parts, k, w = books.entries.shape

    def kernel():
        def work(part: pa.RecordBatch) -> list[pa.Array]:
            n = part.num_rows
            whole = unpacked(part.column(part.schema.get_field_index("ints")), parts * w)
            had = read_state(part.column(part.schema.get_field_index("state")), books.had) if books.had[0] else None
            each, codes, error = [], np.zeros((n, parts), np.uint8), np.zeros(n, object)
            for p in range(parts):
                x, entries = exact(whole[:, p * w : (p + 1) * w], BITS if w <= 16 else 0, books.entries[p])
                if had:
                    found, square, depth = bounded_search(x, entries, had[p][0], books.moved[p])
                    found = found.cut(books.b[p])
                else:
                    found, square = whole_search(x, entries, books.b[p])
                    depth = np.zeros(n, np.int64)
                codes[:, p] = found.ids[:, 0]
                error += square
                each.append((found, depth))
            if last:
                text = HEX[codes].view(f"S{2 * parts}").ravel()
                return [as_strings(np.arange(n + 1, dtype=np.int64) * 2 * parts, text.tobytes()), pa.array(error.tolist(), pa.int64())]
            return [write_state(each)]

        return work

    return kernel


def summed(points: DataFrame, books: Codebooks) -> None:
    """Move the codebooks to what their parts' sums say."""
    parts, k, w = books.entries.shape
    lists = list(books.b)

    def kernel():
        def work(part: pa.RecordBatch):
            whole, rows = unpacked(part.column(0), parts * w), []
            for p, (found, depth) in enumerate(read_state(part.column(1), lists)):
                (x,) = exact(whole[:, p * w : (p + 1) * w], 48)
                at = found.ids[:, 0].astype(np.int64)
                order = np.argsort(at, kind="stable")
                used, first = np.unique(at[order], return_index=True)
                total = np.add.reduceat(x[order], first, axis=0)
                for e, n, values in zip(used.tolist(), np.diff(np.append(first, len(at))).tolist(), total.tolist(), strict=True):
                    rows += [(p, e, i, int(v)) for i, v in enumerate(values)] + [(p, e, w, n)]
                rows += [(p, d, -1, n) for d, n in enumerate(np.bincount(depth).tolist()) if n]
            cells = list(zip(*rows, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cells], names=["part", "entry", "slot", "total"])

        return work

    cells = emit(points, ["ints", "state"], None, "part long, entry long, slot long, total long", kernel).groupBy("part", "entry", "slot").agg(F.sum("total").alias("total")).collect()
    books.step({(r.part, r.entry, r.slot): r.total for r in cells if r.slot >= 0}, {(r.part, r.entry): r.total for r in cells if r.slot < 0})


def first_entries(points: DataFrame, key: str, vector: str, parts: int, entries: int, scale: int) -> np.ndarray | None:
    """Codebooks of the vectors with the smallest keys; None without any."""
    order = [F.col(quoted(key)), F.col("vector")]
    rows = points.select(F.col(quoted(key)), F.col(quoted(vector)).cast("array<double>").alias("vector")).where(F.col(quoted(key)).isNotNull() & (F.size("vector") > 0) & (F.size("vector") % parts == 0))
    got = rows.orderBy(*order).limit(entries).collect()
    if not got:
        return None
    size = len(got[0].vector)
    if any(len(r.vector) != size for r in got):
        got = rows.where(F.size("vector") == size).orderBy(*order).limit(entries).collect()
    whole = np.array([[int(np.floor(x * scale)) for x in r.vector] for r in got], np.int64)
    return whole.reshape(len(got), parts, size // parts).transpose(1, 0, 2).copy()


def compress(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> DataFrame:
    """The kept rows of df, without the vector, with code, error, label_error and codebooks_sha256.

    Rows whose vector is null or holds null or non-finite components are dropped; a component x counts as
    floor(scale * x).  Codebooks start as the parts of the vectors with the smallest keys (of equal keys the lesser
    vector first; null keys start none); fewer vectors make fewer entries.  Equally near entries: the lower index.
    label_error sums the error over equal labels, nulls together.  Vectors that don't have the length of the one
    with the smallest key among those that can be cut (by length, not empty) take no part: code and error are null.
    An empty table stays empty; repeated rows are coded each.  An error beyond a long is an error.  Columns
    with a result's name, in any case, are replaced; a label or key so named is still read.  Every round writes the
    other columns of df again, so give those that are needed.  At most 255 entries.
    """
    names = ["code", "error", "label_error", "codebooks_sha256"]
    kept = df.where(finite(vector))
    start = first_entries(kept, key, vector, parts, entries, scale)
    others = [c for c in df.columns if c != vector and c.lower() not in names]
    # Columns by position: any name may come.
    plain = kept.select(F.col(quoted(label)).alias("label"), F.col(quoted(vector)).alias("vector"), *[F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(others)])
    columns = ["label", *[f"c{i}" for i in range(len(others))]]
    back = [F.col(f"c{i}").alias(c) for i, c in enumerate(others)]
    nothing = [F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error")]
    if start is None:
        return plain.select(*back, *nothing, F.lit(None).cast("long").alias("label_error"), F.lit(hashlib.sha256(b"").hexdigest()).alias("codebooks_sha256"))
    books, size = Codebooks(start), start.shape[0] * start.shape[2]

    def to_ints():
        return lambda part: [binary(packed(scaled(part.column(part.schema.get_field_index("vector")), scale)))]

    fits = F.size("vector") == size
    points = with_columns(plain.where(fits), None, [T.StructField("ints", T.BinaryType())], to_ints).select(*columns, "ints")
    path = None
    for _ in range(rounds):
        state = with_columns(points, None, [T.StructField("state", T.BinaryType())], assigner(books, False))
        had, (points, new) = path, stored(state)
        if had:
            forget(points, had)
        path = new
        summed(points, books)
    coded, _ = stored(with_columns(points, None, [string("code"), long("error")], assigner(books, True)).select(*columns, "code", "error"))
    if path:
        forget(coded, path)
    coded = coded.unionByName(plain.where(~fits).select(*columns, *nothing))
    total = coded.groupBy(F.struct("label").alias("same")).agg(F.sum("error").alias("label_error"))
    return joined_by(coded, F.struct("label"), total, "same").select(*back, "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
