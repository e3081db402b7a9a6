"""Language identification by hierarchical discrimination.

Features are hashed counts of the letters' 1-, 2- and 3-grams over the whole text.  Languages whose centroids are
close form a family, of at most MEMBERS languages.  A linear support vector machine for each family picks the family;
within it one-versus-one machines vote.  So the number of machines grows in proportion to that of languages.  The
machines are fitted on a sample of the training documents, by hash: about PER_LANGUAGE of each language, fewer if there
are so many languages that all would exceed TRAIN, but at least LEAST of each.  Every language is learned, however
rare; everything is predicted.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .columnar import double, emit, string, text_buffer, with_columns

BUCKETS = 4096
PER_LANGUAGE = 300
TRAIN = 8000
LEAST = 8
#: Centroids at least this similar (cosine, less their common mean) are of one family, up to so many of them.
FAMILY, MEMBERS = 0.0, 12
#: More distinct values than this are no languages: an error, so that what goes to the tasks is bounded.
LANGUAGES = 1_000
ROWS = 256


def letter_table() -> np.ndarray:
    """The lower-case letter of each code point, 0 for what isn't a letter."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        if chr(c).isalpha():
            low = chr(c).lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


LETTERS: list[np.ndarray] = []


def features(texts: pa.Array) -> np.ndarray:
    """Unit-length feature vectors; zero for a text without letters."""
    if not LETTERS:
        LETTERS.append(letter_table())
    offsets, data = text_buffer(texts)
    n = len(offsets) - 1
    # Two spaces between texts keep the n-grams apart.
    pieces = [data[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    code = np.frombuffer(b"  ".join([*pieces, b""]).decode().encode("utf-32-le"), np.uint32)
    lengths = np.array([len(p.decode()) + 2 for p in pieces], np.int64)
    letter = LETTERS[0][code]
    owner = np.repeat(np.arange(n, dtype=np.int64) * BUCKETS, lengths)[: len(letter)]
    out = np.zeros(n * BUCKETS)
    one = letter * np.uint32(2654435761)
    two = one[:-1] * np.uint32(40503) ^ letter[1:] * np.uint32(2246822519)
    three = two[:-1] * np.uint32(69069) ^ letter[2:] * np.uint32(3266489917)
    for gram, real in ((one, letter > 0), (two, (letter[:-1] > 0) | (letter[1:] > 0)), (three, letter[1:-1] > 0)):
        mixed = gram ^ gram >> np.uint32(15)
        bucket = (mixed * np.uint32(2246822519) >> np.uint32(20)).astype(np.int64)
        out += np.bincount((owner[: len(bucket)] + bucket)[real], minlength=n * BUCKETS)
    out = np.sqrt(out.reshape(n, BUCKETS)).astype(np.float32)
    has = np.bincount((owner // BUCKETS)[letter > 0], minlength=n) > 0
    out[~has] = 0
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def machines(x: np.ndarray, sides: np.ndarray, penalty: float = 1e-4, steps: int = 60) -> np.ndarray:
    """Weights (a column each, the bias last) of linear SVMs with squared hinge loss that share the rows of x.

    sides has 1 or -1 for each row and machine, 0 where a row doesn't belong; both sides weigh the same.
    """
    y = sides.astype(np.float32)
    weight = sum(np.where(y == side, 0.5 / np.maximum(1, (y == side).sum(axis=0)), 0) for side in (1, -1)).astype(np.float32)
    w = np.zeros((x.shape[1] + 1, y.shape[1]), np.float32)
    ahead, momentum = w.copy(), 1.0
    for _ in range(steps):  # accelerated gradient; rows have unit length, so the loss is smooth with constant 4
        pull = -2 * weight * y * np.maximum(0, 1 - y * (x @ ahead[:-1] + ahead[-1]))
        new = ahead - 0.25 * np.vstack([x.T @ pull + np.float32(penalty) * ahead[:-1], pull.sum(axis=0)])
        following = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead = new + np.float32((momentum - 1) / following) * (new - w)
        w, momentum = new, following
    return w


class Hierarchy:
    """Families, their machines, and the machines of each pair of languages within a family."""

    def __init__(self, x: np.ndarray, langs: list[str]) -> None:
        self.languages = sorted(set(langs))
        code = np.array([self.languages.index(v) for v in langs], np.int64)
        centres = np.stack([x[code == k].mean(axis=0) for k in range(len(self.languages))])
        self.family = self.families(centres)
        groups, n = self.family[code], int(self.family.max()) + 1
        self.above = machines(x, np.where(groups[:, None] == np.arange(n), 1, -1)) if n > 1 else None
        self.within = []  # for each family its languages, and their machines by pair
        for g in range(n):
            members, rows = np.flatnonzero(self.family == g), np.flatnonzero(groups == g)
            own = code[rows][:, None]
            first, second = np.array(list(combinations(members.tolist(), 2)), np.int64).reshape(-1, 2).T
            self.within.append((members, machines(x[rows], (own == first).astype(int) - (own == second))))

    @staticmethod
    def families(centres: np.ndarray) -> np.ndarray:
        """Family of each language: groups of centroids are merged, the most similar on average first, while they are
        similar enough and small enough."""
        x = centres - centres.mean(axis=0)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
        total, size, alive = (x @ x.T).astype(float), np.ones(len(x)), np.ones(len(x), bool)
        out = np.arange(len(x))
        while alive.sum() > 2:
            near = total / np.outer(size, size)
            barred = ~np.outer(alive, alive) | (size[:, None] + size > MEMBERS) | np.tri(len(x), dtype=bool)
            near[barred] = -np.inf
            i, j = np.unravel_index(near.argmax(), near.shape)
            if not np.isfinite(near[i, j]) or near[i, j] < FAMILY and alive.sum() <= int(np.sqrt(len(x))):
                break
            total[i] += total[j]
            total[:, i] += total[:, j]
            size[i], alive[j] = size[i] + size[j], False
            out[out == j] = i
        return np.unique(out, return_inverse=True)[1]

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Language and score of each row that has letters; und and 0 for the others."""
        n = len(x)
        if self.above is not None:
            values = x @ self.above[:-1] + self.above[-1]
            group, ranked = values.argmax(axis=1), np.sort(values, axis=1)
            margin = ranked[:, -1] - ranked[:, -2]
        else:
            group, margin = np.zeros(n, np.int64), np.full(n, 4.0)
        best, least = np.zeros(n, np.int64), np.full(n, 4.0)
        for g in np.unique(group).tolist():
            (members, w), rows = self.within[g], np.flatnonzero(group == g)
            values = x[rows] @ w[:-1] + w[-1]
            votes, worst = np.zeros((len(members), len(rows))), np.full((len(members), len(rows)), 4.0)
            for (i, j), v in zip(combinations(range(len(members)), 2), values.T, strict=True):
                votes[i] += (v > 0) + 1e-3 * np.tanh(v)
                votes[j] += (v <= 0) - 1e-3 * np.tanh(v)
                worst[i], worst[j] = np.minimum(worst[i], 2 * v), np.minimum(worst[j], -2 * v)
            won = votes.argmax(axis=0)
            best[rows], least[rows] = members[won], worst[won, np.arange(len(rows))]
        sure = 1 / (1 + np.exp(-2 * np.minimum(margin, least)))
        blank = ~x.any(axis=1)
        return ["und" if u else self.languages[k] for k, u in zip(best.tolist(), blank.tolist(), strict=True)], np.where(blank, 0.0, sure.astype(float))


def held_out(key: str) -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 3 == 1, F.lit(False))


def fitted(df: DataFrame, key: str, text: str, lang: str) -> Hierarchy | None:
    """Machines from a bounded hash sample of the labelled training rows; None if there are none."""
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).where(~held_out("key") & F.col("lang").isNotNull() & F.col("text").isNotNull()).withColumn("h", F.xxhash64("key", "text"))
    counts = rows.groupBy("lang").agg(F.count("*").alias("rows"), F.min("h").alias("first")).limit(LANGUAGES + 1)
    languages = counts.count()
    if not languages:
        return None
    if languages > LANGUAGES:
        raise ValueError(f"{lang} has more than {LANGUAGES} values; it isn't a column of languages")
    each = max(LEAST, min(PER_LANGUAGE, TRAIN // languages))
    # The hash picks about twice of what the rank keeps, all rows of a language with few, and at least the first hash.
    share = F.broadcast(counts.select("lang", "first", F.when(F.col("rows") <= 4 * each, 1.0).otherwise(2 * each / F.col("rows")).alias("share")))
    picked = rows.join(share, "lang").where((F.pmod("h", F.lit(1 << 30)) < F.col("share") * (1 << 30)) | (F.col("h") == F.col("first")))
    order = Window.partitionBy("lang").orderBy("h", "text")
    sample = picked.withColumn("r", F.row_number().over(order)).where(F.col("r") <= each).select("lang", "text")

    def kernel():
        def work(part: pa.RecordBatch):
            for k in range(0, part.num_rows, ROWS):
                rows_ = part.slice(k, ROWS)
                x = features(rows_.column(rows_.schema.get_field_index("text")))
                yield pa.RecordBatch.from_arrays([rows_.column(rows_.schema.get_field_index("lang")), pa.array([v.astype(np.float16).tobytes() for v in x], pa.binary())], names=["lang", "x"])

        return work

    got = emit(sample, ["lang", "text"], "text", "lang string, x binary", kernel).orderBy("lang", F.xxhash64("x"), "x").collect()
    x = np.stack([np.frombuffer(r.x, np.float16).astype(np.float32) for r in got]) if got else np.zeros((0, BUCKETS), np.float32)
    keep = x.any(axis=1)
    langs = [r.lang for r, k in zip(got, keep.tolist(), strict=True) if k]
    return Hierarchy(x[keep], langs) if langs else None


def identify(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """df with held_out, lang_pred and score.

    Rows whose crc32(key as text) mod 3 is 1 are held out (a null key trains); the machines learn from the text and
    the non-null lang of others, and predict from the text alone.  lang_pred is und, with score 0, for a text that is
    null or empty or has no letter, and where there is nothing to learn from (an empty table too); the score is between
    0 and 1.  Very long texts are read whole.  Repeated rows are predicted each.  Of languages with equal votes the
    first by name wins.  Columns with a result's name, in any case, are replaced.
    """
    model = fitted(df, key, text, lang)
    marked = df.drop(*[c for c in df.columns if c.lower() == "held_out"]).withColumn("held_out", held_out(key))
    return with_columns(marked, text, [string("lang_pred"), double("score")], predictor(model, text))


def predictor(model: Hierarchy | None, text: str) -> Callable:
    def kernel():
        def work(part: pa.RecordBatch) -> list[pa.Array]:
            column = part.column(part.schema.get_field_index(text))
            langs, scores = [], []
            for k in range(0, part.num_rows, ROWS):
                some = column.slice(k, ROWS)
                got = model.predict(features(some)) if model else (["und"] * len(some), np.zeros(len(some)))
                langs += got[0]
                scores.append(got[1])
            return [pa.array(langs, pa.string()), pa.array(np.concatenate([np.zeros(0), *scores]))]

        return work

    return kernel
