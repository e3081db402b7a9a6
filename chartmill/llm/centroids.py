"""Centroid clustering with equal-average equal-variance search, in exact integers.

A vector's nearest centroid is searched among the centroids sorted by their mean, outward from the vector's own mean.
With d components, means m and standard deviations s, the squared distance is at least d * (difference of m)^2, so the
scan stops where that exceeds the best distance, and at least d * ((difference of m)^2 + (difference of s)^2), so a
centroid beyond that is passed over.  Both tests have slack for rounding; what they leave is compared in integers.

A round is one pass over the vectors where they lie: each task adds up its vectors by centroid, and what is shuffled are
these sums, a row for each task, centroid and component.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columnar import integer, long, quoted, ship, string, with_columns
from .vectors import ROWS, exact, finite, scaled

#: With this many bits in a component all sums below fit in 64 bits, up to 64 components.
BITS = 24


def spread(x: np.ndarray) -> np.ndarray:
    """d times the standard deviation of each row's d components."""
    total = x.sum(axis=1)
    return np.sqrt((x.shape[1] * (x * x).sum(axis=1) - total * total).astype(float))


def nearest(x: np.ndarray, centres: np.ndarray, looked: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Number of each vector's nearest centroid, the smaller of equally near ones, and the squared distance.

    looked, if given, gets the number of distances that were computed.
    """
    d, k = x.shape[1], len(centres)
    x, centres = exact(x, BITS if d <= 64 else 0, centres)
    order = np.lexsort((np.arange(k), centres.sum(axis=1)))
    centres = centres[order]
    place, own = centres.sum(axis=1).astype(float), x.sum(axis=1).astype(float)
    wide, own_wide = spread(centres), spread(x)
    right = np.searchsorted(place, own)
    left = right - 1
    edge = np.concatenate([[-np.inf], place, [np.inf]])
    best, who, bound = np.zeros(len(x), x.dtype), np.full(len(x), k), np.full(len(x), np.inf)
    rows = np.arange(len(x))
    while len(rows):
        low, high = own[rows] - edge[left[rows] + 1], edge[right[rows] + 1] - own[rows]
        gap = np.minimum(low, high)
        go = np.isfinite(gap) & (gap * gap <= bound[rows])  # beyond it, every further centroid is too far
        rows, gap, down = rows[go], gap[go], (low <= high)[go]
        at = np.where(down, left[rows], right[rows])
        left[rows] -= down
        right[rows] += ~down
        apart = np.abs(own_wide[rows] - wide[at])
        apart = np.maximum(0, apart - 1e-9 * (own_wide[rows] + wide[at]) - 1e-9)
        near = gap * gap + apart * apart <= bound[rows]
        some, at = rows[near], at[near]
        away = x[some] - centres[at]
        found = (away * away).sum(axis=1)
        if looked is not None:
            looked.append(len(some))
        better = (who[some] == k) | (found < best[some]) | (found == best[some]) & (order[at] < who[some])
        some, at, found = some[better], at[better], found[better]
        best[some], who[some] = found, order[at]
        bound[some] = d * found.astype(float) * (1 + 1e-9) + 1e-6
    return who, best


def totals(points: DataFrame, vector: str, centres: np.ndarray, scale: int) -> tuple[np.ndarray, list[int], list[int]]:
    """Sums of components, vectors and squared distances of each centroid."""
    k, d = centres.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((k, d + 2), object)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                (x,) = exact(scaled(batch.column(0).slice(at, ROWS), scale), BITS)
                who, far = nearest(x, centres)
                order = np.argsort(who, kind="stable")
                used, first = np.unique(who[order], return_index=True)
                sums[used, :d] += np.add.reduceat(x[order], first, axis=0)
                sums[used, d] += np.diff(np.append(first, len(who)))
                sums[used, d + 1] += np.add.reduceat(far[order], first)
        rows, slots = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(slots), pa.array([int(v) for v in sums[rows, slots]], pa.int64())], names=["centroid", "slot", "total"])

    ship(points.sparkSession)
    got = points.select(F.col(quoted(vector)).alias("vector")).mapInArrow(run, "centroid long, slot long, total long").groupBy("centroid", "slot").agg(F.sum("total").alias("total")).collect()
    out = np.zeros((k, d + 2), object)
    for r in got:
        out[r.centroid, r.slot] = r.total
    return out[:, :d], out[:, d].tolist(), out[:, d + 1].tolist()


def cluster(df: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3) -> DataFrame:
    """The rows of df whose vector is kept, with cluster, distance, cluster_inertia, inertia and centroid_sha256.

    Kept are vectors of dims components, none null or non-finite; a component x counts as floor(scale * x).  Centroids
    start as the k kept vectors with the smallest sha256 of "seed:key"; of vectors with equal keys the lesser comes
    first, and null keys start none.  Each of the rounds assigns all vectors and moves every centroid that has some to
    the floor of their mean.  Fewer vectors make fewer centroids; without any key there are none, and the new columns
    are null.  An empty table stays empty, repeated rows are assigned each.  A distance or sum that a long can't hold is
    an error.  Columns with a result's name, in any case, are replaced.  df is read rounds + 3 times.
    """
    points = df.where(finite(vector) & (F.size(F.col(quoted(vector))) == dims))
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(quoted(key)).cast("string")), 256)
    first = points.select(mark.alias("mark"), F.col(quoted(vector)).cast("array<double>").alias("vector")).where("mark is not null").orderBy("mark", "vector").limit(k)
    centres = np.array([[int(np.floor(x * scale)) for x in r.vector] for r in first.collect()], np.int64).reshape(-1, dims)
    inertia: list[int] = []
    for step in range(rounds + 1 if len(centres) else 0):
        sums, counts, inertia = totals(points, vector, centres, scale)
        if step < rounds:
            centres = np.array([[s // n for s in row] if n else old for row, n, old in zip(sums.tolist(), counts, centres.tolist(), strict=True)], np.int64)
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres.tolist()]

    def kernel():
        def work(part: pa.RecordBatch) -> list[pa.Array]:
            if not len(centres):
                return [pa.nulls(part.num_rows, t) for t in (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string())]
            who, far = nearest(scaled(part.column(part.schema.get_field_index(vector)), scale), centres)
            who = who.tolist()
            return [pa.array(who, pa.int32()), pa.array(far.tolist(), pa.int64()), pa.array([inertia[c] for c in who], pa.int64()), pa.array([sum(inertia)] * len(who), pa.int64()), pa.array([digests[c] for c in who], pa.string())]

        return work

    fields = [integer("cluster"), long("distance"), long("cluster_inertia"), long("inertia"), string("centroid_sha256")]
    return with_columns(points, None, fields, kernel)
