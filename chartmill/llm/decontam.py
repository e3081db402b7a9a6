"""Benchmark decontamination with an FM-index per training shard.

A shard is a chunk of documents.  Its words are coded by the benchmark's vocabulary; every other word ends a
stretch, and a stretch shorter than the shortest window can't hold one.  The remaining stretches are indexed: the
suffixes are sorted by doubling; the Burrows-Wheeler transform is kept as a wavelet matrix, whose ranks drive the backward search of all windows at once; the rows of a window's interval
are walked to the next sampled suffix position, which gives the place.  Places become spans of words, and the
spans of a document are merged.

Up to BLOCK_CHARS characters of benchmark items, documents are searched where they lie, never shuffled.  More items
come in blocks of about that size: each block is a job of its own, which leaves the spans and items of the distinct
texts that it hits in the shared folder, so that the driver and the tasks hold one block at a time; the results of all
blocks are merged by text and joined to the documents.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.lineage import forget, joined_by, stored, unused_name
from .columnar import ALNUM, emit, long, ragged, split_words, starts_of, with_columns

WINDOW = 13
BLOCK_CHARS = 2_000_000
#: Every so many-th position of a shard keeps its place in the text.
SAMPLE = 8
#: Rows that are walked to their places at once.
LOCATE = 1 << 20


class WaveletMatrix:
    """Ranks and accesses over a sequence of symbols from 0 to size - 1."""

    def __init__(self, symbols: np.ndarray, size: int) -> None:
        self.bits = max(1, int(size - 1).bit_length())
        self.ones: list[np.ndarray] = []  # ones before each place, by level
        self.zeros: list[int] = []
        for level in range(self.bits - 1, -1, -1):
            bit = (symbols >> level & 1).astype(bool)
            self.ones.append(np.concatenate([[0], np.cumsum(bit, dtype=np.int32)]).astype(np.int32))
            self.zeros.append(int(len(bit) - bit.sum()))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Number of each symbol among the first end symbols."""
        begin = np.zeros_like(end)
        for level, ones, zeros in zip(range(self.bits - 1, -1, -1), self.ones, self.zeros, strict=True):
            bit = (symbol >> level & 1).astype(bool)
            b, e = ones[begin], ones[end]
            begin, end = np.where(bit, zeros + b, begin - b), np.where(bit, zeros + e, end - e)
        return end - begin

    def access(self, at: np.ndarray) -> np.ndarray:
        """The symbols at these places."""
        out = np.zeros_like(at)
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            bit = ones[at + 1] - ones[at]
            out = out << 1 | bit
            at = np.where(bit == 1, zeros + ones[at], at - ones[at])
        return out


class FMIndex:
    """Full-text index over stretches of symbols from 1 to size - 1, each followed by a separator, 0.

    Separators are ordered by their places, so that suffixes differ within their stretch: after doublings in the
    logarithm of the longest stretch the order is complete.  The first place of a stretch is always sampled, so
    that no walk crosses a separator.
    """

    def __init__(self, text: np.ndarray, size: int) -> None:
        n = len(text)
        ends = text == 0
        rank = np.where(ends, np.cumsum(ends) - 1, text + ends.sum())
        top, width = int(rank.max()) + 2, 1
        order = np.argsort(rank, kind="stable")
        while True:
            key = rank * top
            key[: n - width] += rank[width:] + 1
            order = np.argsort(key, kind="stable")
            ordered = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
            top, width = n + 2, width * 2
            if rank[order[-1]] == n - 1:
                break
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=size))]).astype(np.int64)
        self.tree = WaveletMatrix(text[order - 1], size)
        self.sampled = (order % SAMPLE == 0) | ends[order - 1]
        self.slot = np.cumsum(self.sampled) - 1
        self.places = order[self.sampled]
        self.n = n

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the rows whose suffixes begin with each pattern (a row of patterns, left-aligned)."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for back in range(1, patterns.shape[1] + 1):
            live = np.flatnonzero((lengths >= back) & (low < high))
            symbol = patterns[live, lengths[live] - back]
            base = self.before[symbol]
            low[live], high[live] = base + self.tree.rank(symbol, low[live]), base + self.tree.rank(symbol, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The text position of each row's suffix."""
        out = np.zeros(len(rows), np.int64)
        for k in range(0, len(rows), LOCATE):
            row, walked = rows[k : k + LOCATE].copy(), np.zeros(min(LOCATE, len(rows) - k), np.int64)
            while len(open_ := np.flatnonzero(~self.sampled[row])):
                symbol = self.tree.access(row[open_])
                row[open_] = self.before[symbol] + self.tree.rank(symbol, row[open_])
                walked[open_] += 1
            out[k : k + LOCATE] = self.places[self.slot[row]] + walked
        return out


class Windows:
    """The distinct windows of a block of benchmark items."""

    def __init__(self, ids: list, texts: list, window: int) -> None:
        words, counts = split_words(pa.array(texts, pa.string()), ALNUM)
        coded = words.dictionary_encode()
        self.vocabulary = coded.dictionary
        code, first = np.asarray(coded.indices).astype(np.int64) + 1, starts_of(counts)
        self.ids = ids
        found: dict[bytes, list[int]] = {}
        for i, n in enumerate(counts.tolist()):
            w = min(n, window)
            for k in range(n - w + 1 if n else 0):
                items = found.setdefault(code[first[i] + k : first[i] + k + w].tobytes(), [])
                if not items or items[-1] != i:
                    items.append(i)
        self.lengths = np.array([len(k) // 8 for k in found], np.int64)
        self.patterns = np.zeros((len(found), window), np.int64)
        for k, key in enumerate(found):
            self.patterns[k, : len(key) // 8] = np.frombuffer(key, np.int64)
        self.item_counts = np.array([len(v) for v in found.values()], np.int64)
        self.items = np.array([x for v in found.values() for x in v], np.int64)
        self.shortest = int(self.lengths.min()) if len(found) else 0

    def occurrences(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, first word, window) of every occurrence in the rows' texts, and the number of words of each row."""
        words, counts = split_words(texts, ALNUM)
        none = np.zeros(0, np.int64)
        if not len(self.lengths) or not len(words):
            return none, none, none, counts
        code = pc.fill_null(pc.index_in(words, value_set=self.vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        first = starts_of(counts)
        edge = np.zeros(len(code) + 1, bool)
        edge[first] = True  # a stretch ends with its text
        known = code > 0
        begins = np.flatnonzero(known & (edge[:-1] | ~np.concatenate([[False], known[:-1]])))
        ends = np.flatnonzero(known & (edge[1:] | ~np.concatenate([known[1:], [False]]))) + 1
        long_enough = ends - begins >= self.shortest
        begins, sizes = begins[long_enough], (ends - begins)[long_enough]
        if not len(begins):
            return none, none, none, counts
        # Each stretch is followed by one separator, 0.
        places = ragged(begins, sizes + 1)
        text = np.where(places < np.repeat(begins + sizes, sizes + 1), code[np.minimum(places, len(code) - 1)], 0)
        index = FMIndex(text, len(self.vocabulary) + 1)
        # Windows with a word that the shard lacks needn't be searched; padding is 0, the separator.
        there = np.bincount(text, minlength=len(self.vocabulary) + 1) > 0
        live = np.flatnonzero(there[self.patterns].all(axis=1))
        low, high = index.search(self.patterns[live], self.lengths[live])
        hits = np.maximum(high - low, 0)
        window = np.repeat(live, hits)
        at = places[index.locate(ragged(low, hits))]
        row = np.searchsorted(first, at, side="right") - 1
        return row, at - first[row], window, counts


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of spans (start, end), as sorted spans that don't touch."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


KIND = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def search(block: Windows, column: pa.Array) -> tuple[np.ndarray, list[list], list[list]]:
    """Number of words of each text, the merged spans that a block's windows hit, and the sorted ids of its items."""
    row, start, window, counts = block.occurrences(column)
    spans, items = [[] for _ in range(len(counts))], [set() for _ in range(len(counts))]
    for r, s, w in zip(row.tolist(), start.tolist(), block.lengths[window].tolist(), strict=True):
        spans[r].append((s, s + w))
    owners = np.repeat(row, block.item_counts[window])
    which = block.items[ragged(starts_of(block.item_counts)[window], block.item_counts[window])]
    for r, i in np.unique(np.stack([owners, which]), axis=1).T.tolist():
        items[r].add(block.ids[i])
    return counts, [merge(x) for x in spans], [sorted(x) for x in items]


def arrays(spans: list[list], items: list[list]) -> list[pa.Array]:
    return [pa.array([[{"start": a, "end": b} for a, b in x] for x in spans], KIND), pa.array(items, pa.list_(pa.string()))]


def scanner(block: Windows, text: str) -> Callable:
    """A kernel that returns the words, spans and items of each row."""

    def kernel():
        def work(part: pa.RecordBatch) -> list[pa.Array]:
            counts, spans, items = search(block, part.column(part.schema.get_field_index(text)))
            return [pa.array(counts), *arrays(spans, items)]

        return work

    return kernel


def hits(docs: DataFrame, block: Windows) -> DataFrame:
    """(digest, spans, items) of the distinct texts that a block hits."""

    def kernel():
        def work(part: pa.RecordBatch):
            _, spans, items = search(block, part.column(1))
            hit = [i for i, x in enumerate(spans) if x]
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(hit, pa.int64())), *arrays([spans[i] for i in hit], [items[i] for i in hit])], names=["digest", "spans", "items"])

        return work

    return emit(docs, ["digest", "text"], "text", "digest string, spans array<struct<start:bigint,end:bigint>>, items array<string>", kernel).dropDuplicates(["digest"])


def merger(text: str, spans: str, items: str) -> Callable:
    """A kernel that returns the words of each row and unites what the blocks found."""

    def kernel():
        def work(part: pa.RecordBatch) -> list[pa.Array]:
            column = lambda c: part.column(part.schema.get_field_index(c))
            _, counts = split_words(column(text), ALNUM)
            united = [merge([(s["start"], s["end"]) for s in x or []]) for x in column(spans).to_pylist()]
            return [pa.array(counts), *arrays(united, [sorted(set(x or [])) for x in column(items).to_pylist()])]

        return work

    return kernel


def contamination(df: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """df with n_words, spans, items, n_hit, n_items, items_sha256 and contaminated.

    Words are runs of lower-cased ASCII letters, digits and non-ASCII characters.  spans are the merged spans of
    words (from 0, end exclusive) that stand inside an occurrence of a benchmark window; items are the ids, as
    strings, sorted, of the items with an occurring window; an item of fewer words than a window is one window.  A
    document is contaminated if at least a twentieth of its words are hit.  Null texts have no words; items with a
    null id or text or without words are left out; rows with one id count as one item.  Very long texts are searched
    whole; repeated rows get the same result each; without items or documents nothing is hit.  df's columns with a
    result's name, in any case, are replaced (the text is read before).
    """
    names = ["n_words", "spans", "items", "n_hit", "n_items", "items_sha256", "contaminated"]
    fields = [long("n_words"), T.StructField("spans", SPANS), T.StructField("items", T.ArrayType(T.StringType()))]
    out = df.drop(*[c for c in df.columns if c.lower() in names and c != text])
    tests = benchmark.select(F.col(item).cast("string").alias("id"), F.col(item_text).alias("body")).dropna()
    size = tests.agg(F.sum(F.length("body"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_CHARS))
    windows = lambda rows: Windows(*([list(x) for x in zip(*((r.id, r.body) for r in rows.collect()), strict=True)] or [[], []]), window)
    if blocks == 1:
        out = with_columns(out, text, fields, scanner(windows(tests), text))
    else:
        parts, folder = stored(tests.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks))), ["block"])
        digest = F.sha2(F.col(text), 256)
        texts = df.select(digest.alias("digest"), F.col(text).alias("text")).where("digest is not null")
        found = [stored(hits(texts, windows(parts.where(F.col("block") == b))))[0] for b in range(blocks)]
        forget(parts, folder)
        names_ = [unused_name(out, f"_{c}") for c in ("spans", "items")]
        united = reduce(DataFrame.unionByName, found).groupBy("digest").agg(*[F.flatten(F.collect_list(c)).alias(n) for c, n in zip(("spans", "items"), names_, strict=True)])
        out = with_columns(joined_by(out, digest, united, "digest"), text, fields, merger(text, *names_)).drop(*names_)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    out = out.withColumns({"n_hit": hit, "n_items": F.size("items").cast("long"), "items_sha256": F.sha2(F.concat_ws(",", "items"), 256)})
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))

