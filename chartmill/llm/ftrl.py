"""Quality scores: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates.

A text's tokens are its runs of letters and digits, lower-cased, and its runs of other characters; an upper-case word
and a token that repeats the one before give marks of their own too.  Single tokens and pairs are hashed into buckets; a bucket's value is the square root of its
count, and the values of a text have length one.  A score is a sparse dot product with the weights.

All hashing is arithmetic on whole buffers: with prefix sums of byte * P^i modulo 2^64, the hash of any token is a
difference, times a power of the inverse of P.  Texts are read whole, in stretches of STRETCH bytes.

The weights are learned in the driver from a bounded sample: the at most TRAIN labelled documents whose ids have the
least hashes.  Their features lie in the shared folder and are streamed, a document at a time, as the updates want it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import forget, stored
from .columnar import SPACE, double, emit, integer, quoted, text_buffer, with_columns

BUCKETS = 1 << 18
#: Labelled documents to learn from, and how often each is seen.
TRAIN, EPOCHS = 8000, 4
STRETCH = 4 << 20
#: Learning rate and its offset, and the penalties on absolute and squared weights.
ALPHA, BETA, L1, L2 = 2.0, 1.0, 0.02, 0.005
#: A score from here on predicts label 1.
THRESHOLD = 0.3
P = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(P, -1, 1 << 64)
#: 0 for white space, 1 for letters, digits and all beyond ASCII, 2 for the rest.
KIND = np.full(256, 2, np.uint8)
KIND[SPACE] = 0
KIND[[b for b in range(256) if b >= 128 or chr(b).isalnum()]] = 1
LOW = np.array([b + 32 if 65 <= b < 91 else b for b in range(256)], np.uint64)
UPPER, LOWER = np.zeros(256, np.int32), np.zeros(256, np.int32)
UPPER[65:91] = LOWER[97:123] = LOWER[128:] = 1
POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P^i and P^-i modulo 2^64 for i up to n."""
    if not POWERS or len(POWERS[0]) <= n:
        both = [np.full(max(n, 1 << 16) + 1, v, np.uint64) for v in (P, INVERSE)]
        for a in both:
            a[0] = 1
        POWERS[:] = [np.multiply.accumulate(a) for a in both]
    return POWERS[0], POWERS[1]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(29)


def grams(data: np.ndarray, ends: np.ndarray, before: np.uint64) -> tuple[np.ndarray, np.ndarray, np.uint64]:
    """Text number and bucket of every n-gram in the bytes of texts that end at ends, and the last token's hash.

    before is the last token of the same text's stretch before, 0 at a text's start.
    """
    kind = KIND[data]
    at = np.flatnonzero(kind)
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) > 1) | (kind[at[1:]] != kind[at[:-1]])
    first = np.zeros(len(data) + 1, bool)
    first[ends[:-1]] = True  # a text's first byte begins a token
    new |= first[at]
    starts = at[new]
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), before
    stops = np.append(at[np.flatnonzero(new)[1:] - 1], at[-1]) + 1
    up, down = powers(len(data))
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum((LOW[data] + np.uint64(1)) * up[: len(data)], dtype=np.uint64)])
    word = mixed((prefix[stops] - prefix[starts]) * down[starts])
    owner = np.searchsorted(ends, starts, side="right")
    cases = [np.concatenate([np.zeros(1, np.int32), np.cumsum(c[data], dtype=np.int32)]) for c in (UPPER, LOWER)]
    loud = (cases[0][stops] - cases[0][starts] > 1) & (cases[1][stops] == cases[1][starts])
    ahead = np.concatenate([[before], word[:-1]])
    tied = np.concatenate([[before != 0], owner[1:] == owner[:-1]])
    pair = mixed(ahead * np.uint64(31) + word)
    again = tied & (ahead == word)
    everything = np.concatenate([word, pair[tied], np.full(int(loud.sum()), 7, np.uint64), np.full(int(again.sum()), 8, np.uint64)])
    return np.concatenate([owner, owner[tied], owner[loud], owner[again]]), (everything % np.uint64(BUCKETS)).astype(np.int64), word[-1]


def cuts(data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of a text, cut at white space or, in a run of more than a stretch, anywhere."""
    lo = 0
    while lo < len(data):
        hi = min(lo + STRETCH, len(data))
        if hi < len(data):
            blank = np.flatnonzero(SPACE[data[max(lo, hi - 65536) : hi]])
            hi = max(lo, hi - 65536) + int(blank[-1]) + 1 if len(blank) else hi
        yield lo, hi
        lo = hi


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, bucket and value of all texts' features, in order."""
    offsets, raw = text_buffer(column)
    data, n = np.frombuffer(raw, np.uint8), len(offsets) - 1
    if len(data) <= STRETCH:
        owner, bucket, _ = grams(data, offsets[1:], np.uint64(0))
        keys, counts = np.unique(owner * BUCKETS + bucket, return_counts=True)
    else:
        found = []
        for i in range(n):
            text, seen, last = data[offsets[i] : offsets[i + 1]], np.zeros(BUCKETS, np.int64), np.uint64(0)
            for lo, hi in cuts(text):
                _, bucket, last = grams(text[lo:hi], np.array([hi - lo]), last)
                seen += np.bincount(bucket, minlength=BUCKETS)
            used = np.flatnonzero(seen)
            found.append((used + i * BUCKETS, seen[used]))
        keys, counts = (np.concatenate(x) for x in zip(*found, strict=True))
    owner = keys // BUCKETS
    norm = np.sqrt(np.bincount(owner, weights=counts, minlength=n))
    return owner, keys % BUCKETS, np.sqrt(counts) / norm[owner]


class Leader:
    """Follow-the-regularised-leader updates of each coordinate, the last of which is the bias."""

    def __init__(self) -> None:
        self.z, self.n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z = self.z[at]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2))

    def learn(self, bucket: np.ndarray, value: np.ndarray, label: int) -> None:
        at, x = np.append(bucket, BUCKETS), np.append(value, 1.0)
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
        more = np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])
        self.z[at] += g - more / ALPHA * w
        self.n[at] += g * g


def held_out(key: str) -> Column:
    return F.coalesce(F.crc32(F.col(quoted(key)).cast("string")) % 5 == 0, F.lit(False))


def examples(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str) -> DataFrame:
    """h, y, buckets and values of the documents to learn from, one for each id.

    An id's label is 1 if at least half of its rows in labels that have one are not 0; of several texts of an id the
    one with the least features, as bytes, stands for it.
    """
    known = labels.select(F.col(quoted(key)).alias("key"), F.col(quoted(label)).alias("y")).where(~held_out("key") & F.col("key").isNotNull() & F.col("y").isNotNull())
    each = known.groupBy("key").agg((F.avg((F.col("y") != 0).cast("int")) >= 0.5).cast("int").alias("y"))
    there = docs.select(F.col(quoted(key)).alias("key")).distinct()
    picked = each.join(there, "key", "left_semi").orderBy(F.xxhash64("key"), "key").limit(TRAIN)
    chosen = docs.select(F.col(quoted(key)).alias("key"), F.col(quoted(text)).alias("text")).join(F.broadcast(picked), "key").select(F.xxhash64("key").alias("h"), F.col("key").cast("string").alias("key"), "y", "text")

    def kernel():
        def work(part: pa.RecordBatch):
            owner, bucket, value = features(part.column(3))
            first = np.searchsorted(owner, np.arange(part.num_rows + 1)).tolist()
            pairs = [bucket[a:b].astype(np.int32).tobytes() + value[a:b].astype(np.float32).tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(pairs, pa.binary())], names=["h", "key", "y", "x"])

        return work

    made = emit(chosen, ["h", "key", "y", "text"], "text", "h long, key string, y int, x binary", kernel)
    return made.groupBy("h", "key", "y").agg(F.min("x").alias("x"))


def trained(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> np.ndarray:
    """Weights of all buckets and the bias."""
    rows, path = stored(examples(docs, labels, key, text, label))
    leader = Leader()
    ordered = rows.orderBy("h", "key").select("y", "x")
    for _ in range(EPOCHS):
        for r in ordered.toLocalIterator():
            half = len(r.x) // 2
            leader.learn(np.frombuffer(r.x[:half], np.int32), np.frombuffer(r.x[half:], np.float32).astype(float), r.y)
    forget(rows, path)
    return leader.weights(slice(None)).astype(np.float32)


def score(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """docs with held_out, score (0 to 1, higher: label 1 likelier) and predicted (1 if score is at least THRESHOLD).

    Rows whose crc32(key as text) mod 5 is 0 are held out (a null key isn't): their labels are never read.  Null and
    empty texts, and those of white space alone, get the score of the bias; very long ones are read whole.  Repeated rows
    are scored each.  Without labels every score is 0.5; an empty table stays empty.  Ties can't arise.  Columns with a
    result's name, in any case, are replaced.
    """
    weights = trained(docs, labels, key, text, label)
    names = {"held_out", "score", "predicted"}
    plain = docs.drop(*[F.col(quoted(c)) for c in docs.columns if c.lower() in names and c not in (key, text)]).withColumn("held_out", held_out(key))

    def kernel():
        w = weights.astype(float)

        def work(part: pa.RecordBatch) -> list[pa.Array]:
            owner, bucket, value = features(part.column(part.schema.get_field_index(text)))
            total = np.bincount(owner, weights=w[bucket] * value, minlength=part.num_rows) + w[-1]
            chance = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
            return [pa.array(chance), pa.array((chance >= THRESHOLD).astype(np.int32))]

        return work

    return with_columns(plain, text, [double("score"), integer("predicted")], kernel)
