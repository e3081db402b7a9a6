"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints link when they differ in at most RADIUS bits.  Each of the 64 bits has a vector m(bit) of RADIUS + 1
bits; for every nonzero vector v the table v keeps the bits with <m(bit), v> = 1.  The vectors of up to RADIUS
differing bits span a proper subspace, so some v is orthogonal to all of them and its table keeps none of these
bits: every pair within the radius collides in some table.

Only distinct fingerprints are hashed, so copies cost nothing.  A bucket of up to BUCKET fingerprints is compared
within itself; it returns a star for each group that it holds, not all pairs.  A larger bucket is resolved through
hubs: a fingerprint reaches every value within two of the bits that the table doesn't keep, and is near those
within one; if a hub has a near fingerprint, all that reach it link to that one.  Two fingerprints at a distance
of three or less share such a hub, so this is exact, and linear in the bucket.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from ..plans.lineage import cut
from .columnar import LOWER, long, ship, split_words, starts_of, with_columns

RADIUS = 3
SEED = 42
BUCKET = 4096
#: m(bit): the 15 nonzero vectors in turn.
VECTORS = [bit % 15 + 1 for bit in range(64)]
MASKS = [sum(1 << bit for bit in range(64) if bin(VECTORS[bit] & v).count("1") % 2) for v in range(1, 2 ** (RADIUS + 1))]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(texts: pa.Array) -> np.ndarray:
    """Unsigned fingerprint of each text's word 3-shingles."""
    words, counts = split_words(texts, LOWER)
    spaced = pc.binary_join_element_wise(words, "", " ")
    if isinstance(spaced, pa.ChunkedArray):
        spaced = spaced.combine_chunks()
    out = np.zeros(len(counts), np.uint64)
    if not len(words):
        return out
    _, offsets, data = spaced.buffers()
    at = np.frombuffer(offsets, np.int32)[spaced.offset : spaced.offset + len(spaced) + 1].tolist()
    raw, digest, first = data.to_pybytes(), xxhash.xxh64_intdigest, starts_of(counts).tolist()
    weights = np.left_shift(np.uint64(1), np.arange(64, dtype=np.uint64))
    for i, n in enumerate(counts.tolist()):
        if n:
            s, w = first[i], min(n, 3)
            edges = at[s : s + n + 1]
            h = np.array([digest(raw[a : b - 1], SEED) for a, b in zip(edges, edges[w:], strict=False)], np.uint64)
            bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            out[i] = weights[2 * bits > len(h)].sum(dtype=np.uint64)
    return out


def with_fingerprint(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the signed 64-bit fingerprint of its text (0 for null and for texts without words)."""

    def kernel():
        return lambda part: [pa.array(fingerprints(part.column(part.schema.get_field_index(text))).view(np.int64))]

    return with_columns(df, text, [long("fingerprint")], kernel)


def stars(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Edges (fingerprint, least fingerprint of its group) within each list of distinct fingerprints."""
    values, counts = lists.flatten().to_numpy(zero_copy_only=False), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    first = starts_of(counts)
    a, b = [], []
    for n in np.unique(counts[counts > 1]).tolist():
        which = np.flatnonzero(counts == n)
        step = max(1, (1 << 22) // (n * n))
        for k in range(0, len(which), step):
            x = np.sort(values[first[which[k : k + step]][:, None] + np.arange(n)], axis=1)
            near = np.bitwise_count(x[:, :, None] ^ x[:, None, :]) <= RADIUS
            label = np.broadcast_to(np.arange(n), x.shape)
            while True:
                lower = np.where(near, label[:, None, :], n).min(axis=2)
                lower = np.take_along_axis(lower, lower, axis=1)
                if (lower == label).all():
                    break
                label = lower
            i, j = np.nonzero(label != np.arange(n))
            a.append(x[i, j])
            b.append(x[i, label[i, j]])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def links(prints: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) that connect distinct fingerprints exactly as all pairs within the radius do."""
    tables = F.explode(F.array(*[F.struct(F.lit(v).alias("v"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key"), F.col("fp")) for v, m in enumerate(MASKS)]))
    cells = prints.select(tables.alias("c")).select("c.*")
    shared = cells.groupBy("v", "key").count().where("count > 1")
    cells = cells.join(shared, ["v", "key"])
    small = cells.where(F.col("count") <= bucket).groupBy("v", "key").agg(F.collect_list("fp").alias("fps")).select("fps")

    def pairs(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 20_000):
                a, b = stars(batch.column(0).slice(k, 20_000))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    ship(prints.sparkSession)
    found = small.mapInArrow(pairs, "a long, b long")
    flips = [[f for r in range(near_r + 1) for f in combinations([bit for bit in range(64) if not m >> bit & 1], r)] for m in MASKS for near_r in [2]]
    large = cells.where(F.col("count") > bucket)
    if large.isEmpty():
        return found.distinct()
    options = F.create_map(*[x for v, fs in enumerate(flips) for x in (F.lit(v), F.array(*[F.lit(signed(sum(1 << bit for bit in f))) for f in fs]))])
    reach = large.select("fp", F.explode(options[F.col("v")]).alias("flip")).distinct().select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("hub"), (F.bit_count("flip") <= 1).alias("near"))
    centre = reach.where("near").groupBy("hub").agg(F.min("fp").alias("b"))
    return found.union(reach.join(centre, "hub").where("fp <> b").select(F.col("fp").alias("a"), "b")).distinct()


def classes(df: DataFrame, key: str = "doc_id", text: str = "text", bucket: int = BUCKET, prints: DataFrame | None = None) -> DataFrame:
    """(fingerprint, root, component_id) for each distinct fingerprint: root is the class's least fingerprint,
    component_id the least key of its rows, null if they have none."""
    rows = with_fingerprint(df.select(F.col(key).alias("key"), F.col(text).alias("body")), "body") if prints is None else prints
    distinct = cut(rows.groupBy(F.col("fingerprint").alias("fp")).agg(F.min("key").alias("least")))
    joined = components(links(distinct.select("fp"), bucket))
    roots = distinct.join(joined, distinct.fp == joined.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    groups = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    return roots.join(groups, "root").select(F.col("fp").alias("fingerprint"), "root", "component_id")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", bucket: int = BUCKET) -> DataFrame:
    """(key, fingerprint, component_id) for each row of df.

    fingerprint is 16 lowercase hex digits; component_id is the least key among the rows that are linked to this
    one, directly or through others, itself included (null keys don't count; if there are no others it is null).
    Repeated rows and keys stay as they are.  Null and empty texts have fingerprint zero and link like any other; very
    long ones are fingerprinted whole.  An empty table gives no rows.  Only the key and the text are read, so df's other
    columns can't clash.
    """
    rows = cut(with_fingerprint(df.select(F.col(key).alias("key"), F.col(text).alias("body")), "body").select("key", "fingerprint"))
    hexed = F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint")
    return rows.join(classes(df, key, text, bucket, rows), "fingerprint", "left").select(F.col("key").alias(key), hexed, "component_id")
