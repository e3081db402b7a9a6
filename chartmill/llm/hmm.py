"""Language model scoring with a hidden Markov model.

Tokens are the lower-cased words of a text and one end.  Pass one codes the words of each chunk of documents by the
chunk's own dictionary and writes both.  Counts of all words are summed by word, with partial sums before the shuffle.
The CLASSES most frequent words and the words that most chunks have, at most HOT of them, are named: their counts and
emissions go to all chunks by broadcast.

Each Baum-Welch round is one job over all training documents: a task runs the scaled forward and backward
recursions over its documents side by side, adds up expected counts, and Spark sums them by table cell.  In all rounds
but the last the words without a name share one emission.  In the last one every word of the training texts gets its
own: a chunk hands on each of its words' count and the states' shares of it (16 bits each), Spark sums them by word and
hands the sums back to the chunks that have it.  So no table holds the vocabulary, whatever its size, and no word gathers a row for
every chunk in one task unless it is rarer than those with a name.  The score of a text is the scaled forward recursion's
likelihood, which is exact.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.lineage import forget, stored
from .columnar import chunks, ship, split_words, starts_of

STATES = 4
ROUNDS = 3
CLASSES = 2048
CHUNK = 8 << 20
#: Words whose counts all tasks get, those that most chunks share.
HOT = 50_000
#: Steps in a word's share of a state, 16 bits.
SHARE = 65535
#: Weight of the unigram in a state's emissions.
MIX = 0.05
SEED = 7
END = ""


@dataclass
class Model:
    start: np.ndarray  # of each state
    move: np.ndarray  # from state, to state
    emit: np.ndarray  # class, state
    gain: np.ndarray | None = None  # of each state: what an expected count adds to the emission of a word outside emit
    floor: np.ndarray | None = None  # and the part of its unigram that it has at least

    @classmethod
    def initial(cls, unigram: np.ndarray, states: int = STATES, seed: int = SEED) -> Model:
        noise = np.random.default_rng(seed).uniform(0.5, 1.5, (len(unigram), states))
        emit = unigram[:, None] * noise
        return cls(np.full(states, 1 / states), np.full((states, states), 0.1 / states) + 0.9 * np.eye(states), emit / emit.sum(axis=0))

    def size(self) -> int:
        return 1 + self.start.size + self.move.size + self.emit.size


def forward_backward(model: Model, codes: np.ndarray, lengths: np.ndarray, learn: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """Natural log likelihood of each sequence of classes and, to learn, the expected counts.

    The sequences (codes, one after the other; no length is zero) advance side by side, the longest first, so each
    step works on all sequences that are that long.
    """
    order = np.argsort(-lengths, kind="stable")
    first, long_ = starts_of(lengths)[order], lengths[order]
    steps = int(long_[0]) if len(long_) else 0
    alive = np.searchsorted(-long_, -np.arange(steps), side="left")  # sequences longer than t
    offset = starts_of(alive)
    log, states = np.zeros(len(lengths)), len(model.start)
    kept = np.empty((int(offset[-1]), states)) if learn else None
    scales = np.empty(int(offset[-1])) if learn else None
    alpha = None
    for t in range(steps):
        n = alive[t]
        emitted = model.emit[codes[first[:n] + t]]
        alpha = (model.start if t == 0 else alpha[:n] @ model.move) * emitted
        scale = alpha.sum(axis=1)
        alpha /= scale[:, None]
        log[:n] += np.log(scale)
        if learn:
            kept[offset[t] : offset[t + 1]], scales[offset[t] : offset[t + 1]] = alpha, scale
    out = np.empty(len(lengths))
    out[order] = log
    if not learn:
        return out, None
    moved, ahead = np.zeros((states, states)), None
    step_codes = np.empty(int(offset[-1]), np.int64)
    for t in range(steps - 1, -1, -1):
        n, m = alive[t], alive[t + 1] if t + 1 < steps else 0
        at = slice(offset[t], offset[t + 1])
        alpha, beta = kept[at], np.ones((n, states))
        if m:
            moved += alpha[:m].T @ ahead
            beta[:m] = ahead @ model.move.T
        code = codes[first[:n] + t]
        ahead = model.emit[code] * beta / scales[at][:, None]
        kept[at] = alpha * beta
        step_codes[at] = code
    emitted = np.stack([np.bincount(step_codes, weights=kept[:, k], minlength=len(model.emit)) for k in range(states)], axis=1)
    start = kept[: offset[1]].sum(axis=0) if steps else np.zeros(states)
    return out, np.concatenate([[out.sum()], start, (moved * model.move).ravel(), emitted.ravel()])


def improved(model: Model, counts: np.ndarray, unigram: np.ndarray, unseen: np.ndarray) -> Model:
    """The next round's model: a state mixes its expected counts with the unigram, and has its share of the unseen."""
    s = len(model.start)
    start, move, emit = np.split(counts[1:], [s, s + s * s])
    move = move.reshape(s, s) + 1 / s
    emit = emit.reshape(-1, s) + 1e-9
    gain, floor = (1 - MIX) / emit.sum(axis=0), np.full(s, MIX)
    mixed = gain * emit + floor * unigram[:, None]
    scale = (1 - unigram[unseen].sum()) / mixed[~unseen].sum(axis=0)
    mixed *= scale
    mixed[unseen] = unigram[unseen, None]
    return Model((start + 1) / (start + 1).sum(), move / move.sum(axis=1, keepdims=True), mixed, gain * scale, floor * scale)


def coded(df: DataFrame, key: str, text: str, held: str) -> DataFrame:
    """One row for each chunk of documents: their keys, and their words as codes of the chunk's dictionary."""
    kind = df.schema[key].dataType
    schema = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("keys", T.ArrayType(kind)), T.StructField("held", T.ArrayType(T.BooleanType())), T.StructField("lengths", T.ArrayType(T.LongType())), T.StructField("codes", T.BinaryType()), T.StructField("words", T.ArrayType(T.StringType())), T.StructField("counts", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, text, CHUNK):
                column = lambda c: part.column(part.schema.get_field_index(c))  # noqa: B023, E731
                words, lengths = split_words(column(text))
                numbered = words.dictionary_encode()
                train = ~column(held).to_numpy(zero_copy_only=False)
                codes = np.asarray(numbered.indices).astype(np.int32)
                n = np.append(np.bincount(codes[np.repeat(train, lengths)], minlength=len(numbered.dictionary)), train.sum())
                one = lambda x, kind: pa.array([x], kind)
                yield pa.RecordBatch.from_arrays(
                    [one(uuid.uuid4().int >> 65, pa.int64()), whole(column(key)), whole(column(held)), whole(pa.array(lengths)), one(packed(codes.astype("<i4")), pa.binary()), whole(pa.concat_arrays([numbered.dictionary, pa.array([END])])), whole(pa.array(n))],
                    names=[f.name for f in schema],
                )

    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def whole(column: pa.Array) -> pa.Array:
    """A column as the only list of a list column."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column)


def packed(codes: np.ndarray) -> bytes:
    """Whole numbers, compressed byte plane by byte plane."""
    return pa.compress(np.ascontiguousarray(codes).view(np.uint8).reshape(-1, codes.itemsize).T.tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes, n: int, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    if not n:
        return np.zeros(0, kind)
    return np.frombuffer(pa.decompress(data, size * n, codec="zstd", asbytes=True), np.uint8).reshape(size, n).T.copy().view(kind).ravel()


def per_chunk(df: DataFrame, schema: T.StructType | str, work: Callable) -> DataFrame:
    """Rows that work(row as a batch of one) makes of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield work({n: batch.column(k).slice(i, 1) for k, n in enumerate(batch.schema.names)})

    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def classes_of(words: pa.Array, counts: np.ndarray, frequent: pa.Array, mass: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class of each word, and the natural log of its share of the class."""
    code = pc.fill_null(pc.index_in(words, value_set=frequent), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    magnitude = np.frexp(np.asarray(counts, np.int64).astype(float))[1].astype(np.int64)  # the length of a count in bits
    rest = code < 0
    share = np.zeros(len(counts))
    known = rest & (counts > 0)
    share[known] = np.log((counts[known] + 0.5) / mass[magnitude[known]])
    return np.where(rest, len(frequent) + magnitude, code), share


def score(df: DataFrame, key: str = "doc_id", text: str = "text", states: int = STATES, rounds: int = ROUNDS, classes: int = CLASSES) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of df.

    Documents whose crc32(key as text) mod 5 is 1 are held out; the others train (a null key trains).  Tokens are
    lower-cased words (runs without ASCII white space) and one end; a null text has the end alone.  base_score is the
    smoothed unigram's log10 probability, score the hidden Markov model's; n_known counts tokens seen in training.
    Without training documents the model knows only its smoothing; an empty table gives none.  Empty texts are scored
    like null ones, very long texts whole, repeated rows each.  Every word of the training texts has an emission of its
    own; all unknown words are one.  Of equally frequent words the lesser gets a name first.  Only the key and the text are read, so df's other columns can't clash.  The result is written to
    the session's spark.checkpoint.dir and read from there; the larger tables of the way are deleted.
    """
    docs = df.select(F.col(key).alias("key"), F.col(text).alias("text"), F.coalesce(F.crc32(F.col(key).cast("string")) % 5 == 1, F.lit(False)).alias("held"))
    table, table_path = stored(coded(docs, "key", "text", "held"))
    entries = table.select("chunk", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "e")).select("chunk", "at", "e.words", "e.counts")
    sums, sums_path = stored(entries.groupBy("words").agg(F.sum("counts").alias("c"), F.count("*").alias("chunks")).withColumn("shared", F.floor(8 * F.log2("chunks"))))
    trained = sums.where("c > 0")
    total, distinct = trained.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    top = trained.orderBy(F.desc("c"), "words").limit(classes).select("words", "c").toArrow()

    # Words that most chunks have get a name too, whether or not they train.
    least, room = None, HOT
    for r in sums.where("shared > 0").groupBy("shared").count().orderBy(F.desc("shared")).collect():
        if (room := room - r["count"]) < 0:
            break
        least = r.shared
    hot = sums.where(F.lit(False) if least is None else F.col("shared") >= least).select("words", "c").toArrow()
    hot = hot.filter(pc.invert(pc.is_in(hot["words"], value_set=top["words"].combine_chunks())))
    both = pa.concat_tables([top, hot.cast(top.schema)]).combine_chunks()
    forget(sums, sums_path)
    names = Names.of(both["words"].combine_chunks(), both["c"].to_numpy(), total, distinct)
    unseen = np.arange(len(names.unigram)) == len(names.unigram) - 1

    model = Model.initial(names.unigram, states)
    for _ in range(rounds - 1):
        model = improved(model, summed(expected(table, model, names), model), names.unigram, unseen)
    found, found_path = stored(expected(table, model, names, by_word=True))
    if rounds:
        model = improved(model, summed(found, model), names.unigram, unseen)
    else:
        model.gain, model.floor = np.zeros(states), model.emit[-2] / names.unigram[-2]
    known = shared_counts(found.where("chunk is not null"), states).groupBy("chunk").agg(F.collect_list(F.struct("at", "c", *packs(states))).alias("known"))
    kind = df.schema[key].dataType
    result = T.StructType([T.StructField(n, k) for n, k in ((key, kind), ("held_out", T.BooleanType()), ("n_tokens", T.LongType()), ("n_known", T.LongType()), ("train_tokens", T.LongType()), ("base_score", T.DoubleType()), ("score", T.DoubleType()))])

    def likelihood(row: dict[str, pa.Array]) -> pa.RecordBatch:
        rows = unpacked(row["rows"][0].as_py(), row["size"][0].as_py(), "<i4")
        emit, counts = model.emit[rows], names.count[rows]
        if row["known"][0].is_valid:
            at, c, *parts = (row["known"].flatten().field(i).to_numpy(zero_copy_only=False) for i in range(2 + len(packs(states))))
            counts[at] = c
            emit[at] = model.gain * c[:, None] * shares(parts, states, len(c)) + model.floor * names.share(c)[:, None]
        emit[counts == 0] = model.emit[-1]
        tokens, lengths = with_ends(row, len(rows))
        log, _ = forward_backward(Model(model.start, model.move, emit), tokens, lengths, False)
        logs = np.log10((counts + 0.5) / (total + 0.5 * (distinct + 1)))
        edges = starts_of(lengths)[:-1]
        n_known, base = (np.add.reduceat(x[tokens], edges) if len(edges) else np.zeros(0, x.dtype) for x in ((counts > 0).astype(np.int64), logs))
        return pa.RecordBatch.from_arrays([row["keys"].flatten(), row["held"].flatten(), pa.array(lengths), pa.array(n_known), pa.array(np.full(len(lengths), total)), pa.array(base), pa.array(log / np.log(10))], names=[f.name for f in result])

    bare = per_chunk(table.select("chunk", "keys", "held", "lengths", "codes", "words"), T.StructType([*table.select("chunk", "keys", "held", "lengths", "codes").schema, T.StructField("size", T.LongType()), T.StructField("rows", T.BinaryType())]), names.number)
    scored, _ = stored(per_chunk(bare.join(known, "chunk", "left"), result, likelihood))
    forget(found, found_path)
    forget(table, table_path)
    return scored


def packs(states: int) -> list[str]:
    """The columns that hold a word's shares of the states but the last, three in each."""
    return [f"p{i}" for i in range((states + 1) // 3)]


def packed_shares(emitted: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """The parts of n that expected counts have in each state but the last, in steps of 1 / SHARE, as packs names them."""
    part = np.rint(np.clip(emitted / np.maximum(n, 1)[:, None], 0, 1) * SHARE).astype(np.int64)
    return [sum((part[:, k] << 16 * (k - i) for k in range(i, min(i + 3, part.shape[1] - 1))), np.zeros(len(n), np.int64)) for i in range(0, part.shape[1] - 1, 3)]


def shares(parts: list[np.ndarray], states: int, size: int) -> np.ndarray:
    """The parts that packed_shares packed for so many words, and the last state's, which is the rest."""
    own = np.zeros((size, states))
    for k in range(states - 1):
        own[:, k] = (parts[k // 3] >> 16 * (k % 3) & SHARE) / SHARE
    own[:, -1] = np.maximum(1 - own.sum(axis=1), 0)
    return own


def shared_counts(found: DataFrame, states: int) -> DataFrame:
    """(chunk, at, c, p0, ...): how often each word of a chunk trains in all chunks, and its shares of the states there."""
    same = Window.partitionBy("word")
    part = lambda k: F.shiftright(f"p{k // 3}", 16 * (k % 3)).bitwiseAND(SHARE)
    sums = found.select("chunk", "at", F.sum("n").over(same).alias("c"), *[F.sum(F.col("n") * part(k)).over(same).alias(f"s{k}") for k in range(states - 1)])
    mean = lambda k: F.expr(f"shiftleft(case when c > 0 then (s{k} + c div 2) div c else 0L end, {16 * (k % 3)})")
    return sums.select("chunk", "at", "c", *[sum((mean(k) for k in range(3 * i, min(3 * i + 3, states - 1))), F.lit(0)).cast("long").alias(p) for i, p in enumerate(packs(states))])


@dataclass
class Names:
    """The words that all chunks know.

    The emission table has a row for each of them that trains, one for all other words that do, and one for words that
    don't.
    """

    words: pa.Array
    rows: np.ndarray  # of each word
    count: np.ndarray  # of each row, 0 for the last two
    unigram: np.ndarray  # of each row
    unit: float  # a word's unigram for each count

    @classmethod
    def of(cls, words: pa.Array, counts: np.ndarray, total: int, distinct: int) -> Names:
        trains = counts > 0
        n = int(trains.sum())
        mass = np.append(counts[trains] + 0.5, [max(total - counts.sum() + 0.5 * (distinct - n), 1e-9), 0.5])
        return cls(words, np.where(trains, np.cumsum(trains) - 1, n + 1), np.append(counts[trains], [0, 0]), mass / mass.sum(), 1 / mass.sum())

    def rows_of(self, words: pa.Array) -> np.ndarray:
        """The row of each word; words without a name have the last but one."""
        at = pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        rows = np.full(len(at), len(self.unigram) - 2)
        rows[at >= 0] = self.rows[at[at >= 0]]
        return rows

    def number(self, row: dict[str, pa.Array]) -> pa.RecordBatch:
        """A chunk with rows in place of its words."""
        rows = self.rows_of(row.pop("words").flatten())
        return pa.RecordBatch.from_arrays([*row.values(), pa.array([len(rows)], pa.int64()), pa.array([packed(rows.astype("<i4"))], pa.binary())], names=[*row, "size", "rows"])

    def share(self, counts: np.ndarray) -> np.ndarray:
        return (counts + 0.5) * self.unit


def with_ends(row: dict[str, pa.Array], size: int) -> tuple[np.ndarray, np.ndarray]:
    """A chunk's words as codes of its dictionary, whose last entry closes each document, and the documents' lengths."""
    lengths = row["lengths"].flatten().to_numpy(zero_copy_only=False)
    tokens = unpacked(row["codes"][0].as_py(), int(lengths.sum()), "<i4")
    return np.insert(tokens, np.cumsum(lengths), size - 1), lengths + 1


def expected(table: DataFrame, model: Model, names: Names, by_word: bool = False) -> DataFrame:
    """Expected counts of all training documents under the model: (cell, value) once a task, to be summed by cell.

    With by_word there are rows (chunk, at, word, n, p0, ...) too, for each word of a chunk's dictionary that has no
    name: its place there, how often it trains, and the states' shares of that.
    """
    states = len(model.start)
    schema = T.StructType([T.StructField("cell", T.LongType()), T.StructField("value", T.DoubleType()), T.StructField("chunk", T.LongType()), T.StructField("at", T.IntegerType()), T.StructField("word", T.StringType()), T.StructField("n", T.LongType()), *[T.StructField(p, T.LongType()) for p in packs(states)]])
    kinds = [pa.int64(), pa.float64(), pa.int64(), pa.int32(), pa.string(), pa.int64(), *[pa.int64()] * len(packs(states))]

    def told(size: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], k) if f.name in columns else pa.nulls(size, k) for f, k in zip(schema, kinds, strict=True)], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, skip = np.zeros(model.size()), 1 + states + states * states
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(k).slice(i, 1) for k, n in enumerate(batch.schema.names)}
                words = row["words"].flatten()
                rows, got = names.rows_of(words), np.zeros(skip + len(words) * states)
                train = ~row["held"].flatten().to_numpy(zero_copy_only=False)
                if train.any():
                    tokens, n = with_ends(row, len(words))
                    tokens, n = tokens[np.repeat(train, n)], n[train]
                    if not by_word:
                        total += forward_backward(model, rows[tokens], n, True)[1]
                        continue
                    got = forward_backward(Model(model.start, model.move, model.emit[rows]), tokens, n, True)[1]
                if by_word:
                    emitted = got[skip:].reshape(-1, states)
                    total[:skip] += got[:skip]
                    for k in range(states):
                        total[skip + k :: states] += np.bincount(rows, weights=emitted[:, k], minlength=len(model.emit))
                    at = np.flatnonzero(rows == len(model.emit) - 2)
                    n = row["counts"].flatten().to_numpy(zero_copy_only=False)[at]
                    yield told(len(at), chunk=np.full(len(at), row["chunk"][0].as_py()), at=at.astype(np.int32), word=words.take(pa.array(at)), n=n, **dict(zip(packs(states), packed_shares(emitted[at], n), strict=True)))
        yield told(len(total), cell=np.arange(len(total)), value=total)

    ship(table.sparkSession)
    return table.select("chunk", "held", "lengths", "codes", "words", *["counts"] * by_word).mapInArrow(run, schema)


def summed(found: DataFrame, model: Model) -> np.ndarray:
    """The expected counts of all tasks, summed by Spark cell by cell."""
    cells = found.where("cell is not null").groupBy("cell").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros(model.size())
    out[cells["cell"].to_numpy()] = cells["value"].to_numpy()
    return out
