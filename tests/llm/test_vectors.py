"""Centroid clustering and vector codes against plain integer loops."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import types as T

from chartmill.llm import centroids, vector_codes

NAN, INF = float("nan"), float("inf")


def square(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))


def closest(x, centres):
    return min(range(len(centres)), key=lambda c: (square(x, centres[c]), c))


def moved(points, who, centres):
    out = []
    for c, old in enumerate(centres):
        own = [p for p, w in zip(points, who, strict=True) if w == c]
        out.append([sum(v) // len(own) for v in zip(*own, strict=True)] if own else old)
    return out


def plain_clusters(rows, dims, k, rounds, scale=1024, seed=3):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    points = [v for _, v in kept]
    marks = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centres = [v for _, v in marks[:k]]
    for _ in range(rounds):
        centres = moved(points, [closest(p, centres) for p in points], centres)
    who = [closest(p, centres) for p in points]
    far = [square(p, centres[w]) for p, w in zip(points, who, strict=True)]
    own = [sum(f for f, w in zip(far, who, strict=True) if w == c) for c in range(len(centres))]
    return sorted(((i, w, f, own[w], sum(far), hashlib.sha256(",".join(map(str, centres[w])).encode()).hexdigest()) for (i, _), w, f in zip(kept, who, far, strict=True)), key=repr)


def plain_codes(rows, parts, entries, rounds, scale=256):
    kept = [(i, [math.floor(scale * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    w = len(kept[0][1]) // parts
    first = sorted((i, v) for i, v, _ in kept if i is not None)[:entries]
    books, codes, error = [], [], [0] * len(kept)
    for p in range(parts):
        points = [v[p * w : p * w + w] for _, v, _ in kept]
        book = [v[p * w : p * w + w] for _, v in first]
        for _ in range(rounds):
            book = moved(points, [closest(x, book) for x in points], book)
        who = [closest(x, book) for x in points]
        error = [e + square(x, book[c]) for e, x, c in zip(error, points, who, strict=True)]
        books.append(book)
        codes.append(who)
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    total = {label: sum(e for e, (_, _, other) in zip(error, kept, strict=True) if other == label) for label in {k[2] for k in kept}}
    return sorted(((i, "".join(f"{codes[p][n]:02x}" for p in range(parts)), error[n], total[label], digest) for n, (i, _, label) in enumerate(kept)), key=repr)


def vectors(n, dims, seed, step=None):
    r = np.random.default_rng(seed)
    middle = r.normal(size=(6, dims))
    x = middle[r.integers(0, 6, n)] + 0.3 * r.normal(size=(n, dims))
    return (np.round(x / step) * step if step else x).astype(np.float32).astype(float).tolist()


@pytest.mark.parametrize("k", [1, 2, 8, 30])
@pytest.mark.parametrize("size", [2, 1000, 1 << 23, 1 << 40])
def test_search_finds_the_nearest(k, size):
    r = np.random.default_rng(k)
    x, centres = r.integers(-size, size, (300, 5)), r.integers(-size, size, (k, 5))
    centres[k // 2] = centres[0]  # a tie
    looked = []
    who, far = centroids.nearest(x, centres, looked)
    want = [closest(p, centres.tolist()) for p in x.tolist()]
    assert who.tolist() == want
    assert [int(f) for f in far] == [square(p, centres.tolist()[c]) for p, c in zip(x.tolist(), want, strict=True)]
    assert k < 8 or sum(looked) < 0.9 * k * len(x)


@pytest.mark.parametrize("step", [None, 0.5])
def test_clusters_equal_a_plain_loop(spark, step):
    rows = list(enumerate(vectors(300, 6, 1, step)))
    rows += [(300, None), (301, [1.0]), (302, [0.0] * 5 + [NAN]), (303, [INF] + [0.0] * 5), (304, [0.0] * 5 + [None]), (None, [0.5] * 6), (7, rows[7][1]), (8, rows[9][1]), (305, [0.0] * 7)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got = centroids.cluster(df, k=8, rounds=4, dims=6).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()
    assert sorted(map(tuple, got), key=repr) == plain_clusters(rows, 6, 8, 4)


def test_clusters_of_odd_tables(spark):
    kind = "vec_id string, embedding array<float>, `a.b` int, Cluster string, centroid int, n0 int"
    one = [("x", [1.0, -2.0], 4, "old", 5, 6)]
    (r,) = centroids.cluster(spark.createDataFrame(one, kind), dims=2).collect()
    assert (r["a.b"], r.cluster, r.distance, r.inertia, r.centroid, r.n0) == (4, 0, 0, 0, 5, 6) and "Cluster" not in r.asDict()
    assert centroids.cluster(spark.createDataFrame([], kind), dims=2).collect() == []
    (r,) = centroids.cluster(spark.createDataFrame([(None, [1.0, 2.0], 1, "", 1, 1)], kind), dims=2).collect()
    assert r.cluster is None and r.inertia is None
    far = spark.createDataFrame([(1, [1e5, 0.0]), (2, [-1e5, 0.5]), (3, [1e5, 1.0])], "vec_id long, embedding array<double>")
    got = centroids.cluster(far, k=2, rounds=3, dims=2).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()
    assert sorted(map(tuple, got), key=repr) == plain_clusters([(r.vec_id, r.embedding) for r in far.collect()], 2, 2, 3)


@pytest.mark.parametrize("step", [None, 0.25])
def test_codes_equal_a_plain_loop(spark, step):
    rows = [(i, v, (None, "a", "b")[i % 3]) for i, v in enumerate(vectors(400, 8, 2, step))]
    rows += [(400, None, "a"), (401, [0.0] * 7 + [NAN], "a"), (402, [None] + [0.0] * 7, "b"), (None, [0.25] * 8, "b"), (3, rows[3][1], None), (4, rows[5][1], "a")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string").repartition(5)
    for rounds in (0, 2, 5):
        got = vector_codes.compress(df, parts=4, entries=40, rounds=rounds).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()
        assert sorted(map(tuple, got), key=repr) == plain_codes(rows, 4, 40, rounds)


def test_bounds_hold_and_save_work():
    r = np.random.default_rng(3)
    middle = r.integers(-500, 500, (64, 4))
    x = middle[r.integers(0, 64, 3000)] + r.integers(-30, 30, (3000, 4))
    book = vector_codes.Codebooks(middle[None] + r.integers(-40, 40, (1, 64, 4)))
    found, square_, depth = *vector_codes.whole_search(x, book.entries[0], book.b[0]), np.zeros(3000, int)
    lists = []
    for _ in range(6):
        ids = found.ids[:, 0].astype(int)
        sums = {(0, e, 4): int((ids == e).sum()) for e in range(64)} | {(0, e, i): int(x[ids == e, i].sum()) for e in range(64) for i in range(4)}
        book.step(sums, {(0, d): n for d, n in enumerate(np.bincount(depth).tolist())})
        stored = vector_codes.read_state(vector_codes.write_state([(found, depth)]), book.had)[0][0]
        new, square_, depth = vector_codes.bounded_search(x, book.entries[0], stored, book.moved[0])
        every = ((x[:, None] - book.entries[0]) ** 2).sum(axis=2)
        assert (new.ids[:, 0] == every.argmin(axis=1)).all() and (square_ == every.min(axis=1)).all()
        for z in range(new.ids.shape[1]):
            known = new.ids[:, z] != vector_codes.NONE
            true = np.sqrt(every[np.arange(3000), np.minimum(new.ids[:, z], 63)])
            assert (new.near[known, z] <= true[known] * (1 + 1e-9)).all()
        rest = every.astype(float)
        for z in range(new.ids.shape[1]):
            known = new.ids[:, z] != vector_codes.NONE
            rest[np.flatnonzero(known), new.ids[known, z]] = np.inf
        assert (new.outer <= np.sqrt(rest.min(axis=1)) * (1 + 1e-9)).all()
        found = new.cut(book.b[0])
        lists.append((book.b[0], float((depth == 1).mean())))
    assert lists[-1][1] > 0.5 and {b for b, _ in lists} != {8}  # most entries aren't searched at last, and the lists were fitted


def test_codes_of_odd_tables(spark):
    kind = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("label", T.DoubleType()), T.StructField("Code", T.StringType()), T.StructField("a.b", T.StringType()), T.StructField("state", T.StringType()), T.StructField("c0", T.StringType())])
    assert vector_codes.compress(spark.createDataFrame([], kind)).collect() == []
    rows = [(5, [float(i) for i in range(16)], 1.0, "x", "y", "z", "w"), (6, [1e6] * 16, NAN, "x", "y", "z", "w"), (7, [1.0] * 15, NAN, "x", "y", "z", "w"), (8, [2.0] * 32, None, "x", "y", "z", "w"), (9, [], None, "x", "y", "z", "w")]
    got = {r.vec_id: r for r in vector_codes.compress(spark.createDataFrame(rows, kind)).collect()}
    assert len(got) == 5 and got[5].asDict() | {"codebooks_sha256": 0} == {"vec_id": 5, "label": 1.0, "a.b": "y", "state": "z", "c0": "w", "code": "00" * 16, "error": 0, "label_error": 0, "codebooks_sha256": 0}
    assert got[6].code == "01" * 16 and got[6].error == got[6].label_error == 0
    assert got[7].code is got[8].code is got[9].error is got[9].label_error is None
