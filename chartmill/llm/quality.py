"""Quality rules: a base rule on length and repetition, then divergence from language references.

A language's reference is the histogram of its character classes and of its common words over all documents of
that language.  A document is compared with every reference by the Jensen-Shannon distance (base 2, from 0 to 1)
of both histograms; it is kept if some language is near enough in both.  Documents with fewer words or characters
than the guards are left to the base rule, as their histograms say little.

The references come from one pass: tasks count the words and classes of each language chunk by chunk, Spark adds the
counts up, and the COMMON most frequent words of each language are exact, whatever the layout.  Only counts are
shuffled, never documents.  The references (COMMON words and nine classes a language) go to the tasks of the second
pass, in which a document's words are matched once with those of all languages.  Every language has a reference;
more than LANGUAGES distinct values, which no column of languages has, are an error.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .columnar import SPACE, as_strings, boolean, double, emit, long, ragged, split_words, starts_of, sums, text_buffer, with_columns

COMMON = 100
LANGUAGES = 10_000
MIN_WORDS = 50
MIN_CHARS = 200
MAX_CLASS_DISTANCE = 0.32
MAX_WORD_DISTANCE = 0.50
#: Added to that limit over the root of the number of words: short texts stray further by chance.
WORD_SLACK = 0.6
#: Distances (documents x languages) that are held at once.
CELLS = 1 << 21
#: Stands for all words of a language; no word begins with a space.
TOTAL = " all"
SYMBOLS = b"#*$%&|<>"
IDENTITY = bytes(range(256))


def byte_classes() -> np.ndarray:
    """Class of each byte; bytes 0x80-0xBF continue a character and have none (-1)."""
    return np.array([0 if 97 <= b < 123 else 1 if 65 <= b < 91 else 2 if 48 <= b < 58 else 3 if SPACE[b] else 4 if b in SYMBOLS else 5 if b in b".,;:!?'\"()-" else 6 if b < 128 else -1 if b < 192 else 7 if b < 224 else 8 for b in range(256)])


CLASS_OF_BYTE = byte_classes()
CLASSES = 9


def class_counts(offsets: np.ndarray, data: bytes) -> np.ndarray:
    """Characters of each class in each text."""
    kind = CLASS_OF_BYTE[np.frombuffer(data, np.uint8)]
    owner = np.repeat(np.arange(len(offsets) - 1) * CLASSES, np.diff(offsets))
    real = kind >= 0
    return np.bincount(owner[real] + kind[real], minlength=(len(offsets) - 1) * CLASSES).reshape(-1, CLASSES)


def repeated_words(code: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Words of each text that stand in a 3-word window found at least twice in it."""
    first = starts_of(counts)
    begin = np.ones(len(code), bool)
    for back in (1, 2):
        begin[np.maximum(first[1:] - back, 0)[counts >= back]] = False
    at = np.flatnonzero(begin[: max(0, len(code))])
    at = at[at + 2 < len(code)]
    doc = np.repeat(np.arange(len(counts)), counts)
    out = np.zeros(len(code), bool)
    if len(at):
        parts = [doc[at], code[at], code[at + 1], code[at + 2]]
        mixed = np.zeros(len(at), np.uint64)
        for p in parts:
            mixed = (mixed ^ p.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
        order = np.argsort(mixed)
        same = mixed[order[1:]] == mixed[order[:-1]]
        if not all((p[order[1:]][same] == p[order[:-1]][same]).all() for p in parts):  # two windows with one hash
            order = np.lexsort(parts)
            same = np.logical_and.reduce([p[order[1:]] == p[order[:-1]] for p in parts])
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        for ahead in range(3):
            out[at[twice] + ahead] = True
    return sums(out, first)


def repeated_lines(column: pa.Array) -> np.ndarray:
    """Lines with a word that equal an earlier line of their text."""
    ended = pc.binary_join_element_wise(pc.fill_null(column.cast(pa.string()), ""), "", "\n")
    offsets, data = text_buffer(ended)
    code = np.frombuffer(data, np.uint8)
    edges = np.concatenate([[0], np.flatnonzero(code == 10) + 1])
    line = np.asarray(as_strings(edges, data, pa.binary()).dictionary_encode().indices).astype(np.int64)
    full = sums(~SPACE[code], edges) > 0
    owner = np.searchsorted(offsets, edges[:-1], side="right") - 1
    key = (owner << 32 | line)[full]
    n = len(offsets) - 1
    return np.bincount(owner[full], minlength=n) - np.bincount(np.unique(key) >> 32, minlength=n)


def measure(column: pa.Array) -> tuple[dict[str, np.ndarray], pa.Array]:
    """The base counts of each text, and its words."""
    offsets, data = text_buffer(column)
    words, counts = split_words(column, IDENTITY)
    code = np.asarray(words.dictionary_encode().indices).astype(np.int64)
    classes = class_counts(offsets, data)
    out = {"n_words": counts, "word_chars": classes.sum(axis=1) - classes[:, 3], "n_symbols": classes[:, 4], "n_dup_lines": repeated_lines(column), "n_repeat_words": repeated_words(code, counts)}
    out["base_failed"] = (counts < MIN_WORDS) | (100 * out["n_repeat_words"] > 50 * counts)
    out["classes"] = classes
    return out, words


def count_rows(langs: pa.Array, column: pa.Array) -> tuple[list, list, list]:
    """(lang, word, n) of a chunk: each language's words, its number of words (TOTAL) and its classes (" 0" ...)."""
    words, counts = split_words(column)
    coded, numbered = langs.dictionary_encode(), words.dictionary_encode()
    names, which = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    width = max(1, len(numbered.dictionary))
    pair, n = np.unique(np.repeat(which * width, counts) + np.asarray(numbered.indices), return_counts=True)
    classes = np.zeros((len(names), CLASSES + 1), np.int64)
    np.add.at(classes, which, np.column_stack([class_counts(*text_buffer(column)), counts]))
    fixed = [*(f" {c}" for c in range(CLASSES)), TOTAL]
    owner = pa.array(np.concatenate([pair // width, np.repeat(np.arange(len(names)), len(fixed))]))
    return names.take(owner), pa.concat_arrays([numbered.dictionary.take(pa.array(pair % width)), pa.array(fixed * len(names), pa.string())]), pa.array(np.concatenate([n, classes.ravel()]))


def references(df: DataFrame, text: str = "text", lang: str = "lang", common: int = COMMON) -> dict:
    """Common words and both histograms of each language, counted over all rows with a language; of words that are
    equally frequent the least comes first."""
    known = df.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).where("lang is not null")

    def kernel():
        def work(part: pa.RecordBatch):
            yield pa.RecordBatch.from_arrays(list(count_rows(*(part.column(part.schema.get_field_index(c)) for c in ("lang", "text")))), names=["lang", "word", "n"])

        return work

    counts = emit(known, ["lang", "text"], "text", "lang string, word string, n long", kernel).groupBy("lang", "word").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc(F.startswith("word", F.lit(" "))), F.desc("n"), "word")
    top = counts.withColumn("r", F.row_number().over(order)).where(F.col("r") <= common + CLASSES + 1).select("lang", "word", "n")
    found: dict[str, dict[str, int]] = {}
    for r in top.toLocalIterator():
        found.setdefault(r.lang, {})[r.word] = r.n
        if len(found) > LANGUAGES:
            raise ValueError(f"{lang} has more than {LANGUAGES} values; it isn't a column of languages")
    out = {}
    for name in sorted(found):
        n = found[name]
        classes = np.array([n[f" {c}"] for c in range(CLASSES)], float)
        out[name] = {"classes": classes / max(1, classes.sum()), "words": {w: n[w] / max(1, n[TOTAL]) for w in sorted(n) if not w.startswith(" ")}}
    return out


def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """What a pair of probabilities adds to the square of the Jensen-Shannon distance of their distributions."""
    mean = np.where(p + q > 0, (p + q) / 2, 1)
    part = lambda x: x * np.log2(np.where(x > 0, x, 1) / np.where(x > 0, mean, 1))
    return (part(p) + part(q)) / 2


class References:
    """The references of all languages: class histograms, and for each word the languages in which it is common."""

    def __init__(self, found: dict) -> None:
        self.n = len(found)
        self.classes = np.array([ref["classes"] for ref in found.values()]).reshape(-1, CLASSES)
        words = sorted({w for ref in found.values() for w in ref["words"]})
        code = {w: i for i, w in enumerate(words)}
        entries = sorted((code[w], k, q) for k, ref in enumerate(found.values()) for w, q in ref["words"].items())
        self.words = pa.array(words, pa.string())
        self.first = np.searchsorted(np.array([e[0] for e in entries], np.int64), np.arange(len(words) + 1))
        self.language, self.share = np.array([e[1] for e in entries], np.int64), np.array([e[2] for e in entries])
        self.mass = np.bincount(self.language, weights=self.share, minlength=self.n)

    def distances(self, classes: np.ndarray, words: pa.Array, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distances of class and word histogram from the nearest language: that with the least sum of both, the
        first by name on ties; 1 and 1 without any."""
        out = np.ones((2, len(counts)))
        code = pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        edges, step = starts_of(counts), max(1, CELLS // max(1, self.n))
        for k in range(0, len(counts) if self.n else 0, step):
            rows = slice(k, min(k + step, len(counts)))
            out[:, rows] = self._nearest(classes[rows], code[edges[rows.start] : edges[rows.stop]], counts[rows])
        return out[0], out[1]

    def _nearest(self, classes: np.ndarray, code: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, size = len(counts), np.maximum(1, counts)
        share = classes / np.maximum(1, classes.sum(axis=1, keepdims=True))
        class_far = np.zeros((n, self.n))
        for c in range(CLASSES):
            class_far += gap(share[:, c, None], self.classes[:, c])
        owner = np.repeat(np.arange(n), counts)[code >= 0]
        width = max(1, len(self.words))
        pair, times = np.unique(owner * width + code[code >= 0], return_counts=True)
        doc, word = pair // width, pair % width
        hits = self.first[word + 1] - self.first[word]
        at = ragged(self.first[word], hits)
        cell = np.repeat(doc, hits) * self.n + self.language[at]
        p, q = np.repeat(times / size[doc], hits), self.share[at]
        table = lambda v: np.bincount(cell, weights=v, minlength=n * self.n).reshape(n, self.n)
        rest = (counts / size)[:, None] - table(p)
        # a common word that the text lacks adds half its share
        word_far = self.mass / 2 + table(gap(p, q) - q / 2) + gap(np.maximum(0, rest), np.maximum(0, 1 - self.mass))
        far = np.sqrt(np.maximum(0, np.stack([class_far, word_far])))
        best = far.sum(axis=0).argmin(axis=1)
        return far[0, np.arange(n), best], far[1, np.arange(n), best]


def judge(reference: References, text: str) -> Callable:
    def kernel():
        def work(part: pa.RecordBatch) -> list[pa.Array]:
            column = part.column(part.schema.get_field_index(text))
            base, _ = measure(column)
            lowered, counts = split_words(column)
            class_far, word_far = reference.distances(base["classes"], lowered, counts)
            guarded = (base["n_words"] < MIN_WORDS) | (base["word_chars"] < MIN_CHARS)
            limit = MAX_WORD_DISTANCE + WORD_SLACK / np.sqrt(np.maximum(1, counts))
            far = ~guarded & ((class_far > MAX_CLASS_DISTANCE) | (word_far > limit)) if reference.n else np.zeros(len(counts), bool)
            longs = [pa.array(base[k].astype(np.int64)) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
            return [*longs, pa.array(base["base_failed"]), pa.array(class_far), pa.array(word_far), pa.array(~base["base_failed"] & ~far)]

        return work

    return kernel


def quality(df: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """df with the base counts, base_failed, class_distance, word_distance and kept.

    Words are runs of characters other than ASCII white space.  base_failed: fewer than 50 words, or more than half
    of the words in repeated 3-word windows.  kept: not base_failed and, for texts over the guards, near a
    language's reference.  Null and empty texts have no words and fail; very long texts are measured whole.  Rows with
    a null language are judged, but don't shape a reference; without any reference (an empty table too) the base rule
    decides alone.  Of equally frequent words the lesser is the commoner, of equally near languages the first by name
    counts.  Repeated rows are counted and judged each.  Columns with a result's name, in any case, are replaced.
    """
    fields = [long(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] + [boolean("base_failed"), double("class_distance"), double("word_distance"), boolean("kept")]
    return with_columns(df, text, fields, judge(References(references(df, text, lang)), text))
