"""Folds over sorted rows that spread one group over many tasks.

Rows are dealt by ranges of their whole order, so a chart or song with very many rows lies in several pieces that follow
one another.  A fold says where it begins anew, that is where no earlier row matters: at another group, after a gap, at
a row that keeps its place.  Each piece is folded from its first such row on, and leaves the state at its end.  The rows
before it, its head, are folded in a second step, from the state that the pieces before have left; heads of pieces that
begin nowhere follow one another.  So only heads and one state a piece move twice, and what can't be cut stays in order.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..plans.lineage import stored
from ..plans.ship import ship


class Fold:
    """State that goes from row to row; before is the row before, None if there is none or it isn't known."""

    def __init__(self) -> None:
        self.before: tuple | None = None

    def begins(self, row: tuple) -> bool:
        """Whether nothing before this row matters to it and what follows; if before is None, for any row before."""
        raise NotImplementedError

    def reset(self) -> list[tuple]:
        """What is still to be told of the rows so far, at a beginning or an end of rows; the state that later rows need
        stays."""
        return []

    def feed(self, row: tuple, fresh: bool) -> list[tuple]:
        """What a row adds to the result; fresh: the state before it doesn't count."""
        raise NotImplementedError

    def take(self, row: tuple, fresh: bool) -> list[tuple]:
        out = self.feed(row, fresh)
        self.before = row
        return out


def rows_of(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(c.to_pylist() for c in batch.columns), strict=True)


def folded(rows: DataFrame, order: list[Column | str], fold: Callable[[], Fold], schema: T.StructType) -> DataFrame:
    """The rows that a fold makes of rows in their order, wherever Spark cuts it.

    rows' columns are handed to the fold in their own order.  The result has been written to the shared folder.
    """
    ship(rows.sparkSession)
    n = len(rows.columns)
    plain = rows.toDF(*[f"i{k}" for k in range(n)])
    ins = [T.StructField(f"i{k}", f.dataType) for k, f in enumerate(rows.schema)]
    outs = [T.StructField(f"o{k}", f.dataType) for k, f in enumerate(schema)]
    full = T.StructType([T.StructField("piece", T.IntegerType()), T.StructField("seq", T.LongType()), T.StructField("state", T.BinaryType()), *ins, *outs])
    kinds = [to_arrow_type(f.dataType) for f in full]
    out_kinds = kinds[3 + n :]

    def batch_of(size: int, at: dict[int, pa.Array]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([at[k] if k in at else pa.nulls(size, kinds[k]) for k in range(len(kinds))], names=full.names)

    def results(found: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*found, strict=True)) if found else [()] * len(outs)
        return batch_of(len(found), {3 + n + k: pa.array(c, t) for k, (c, t) in enumerate(zip(columns, out_kinds, strict=True))})

    def by_piece(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, seq, work, begun = TaskContext.get().partitionId(), 0, fold(), False
        mark = lambda size: pa.array([piece] * size, pa.int32())
        for batch in batches:
            found, head = [], 0
            for row in rows_of(batch):
                fresh = work.begins(row)
                if fresh and begun:
                    found += work.reset()
                begun = begun or fresh
                if begun:
                    found += work.take(row, fresh)
                else:
                    work.before = row
                    head += 1
            if head:
                raw = batch.slice(0, head)
                yield batch_of(head, {0: mark(head), 1: pa.array(range(seq, seq + head), pa.int64()), **{3 + k: raw.column(k).cast(kinds[3 + k]) for k in range(n)}})
                seq += head
            if found:
                yield results(found)
        if begun:
            yield results(work.reset())
            yield batch_of(1, {0: mark(1), 1: pa.array([seq], pa.int64()), 2: pa.array([pickle.dumps(work)], pa.binary())})

    def by_group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, group = None, None
        for batch in batches:
            found = []
            for now, state, *row in rows_of(batch):
                row = tuple(row)
                if work is None or now != group:
                    found += work.reset() if work else []
                    group, work = now, pickle.loads(state) if state else fold()
                    fresh = not state
                    if state:
                        continue
                else:
                    fresh = work.begins(row)
                    found += work.reset() if fresh else []
                found += work.take(row, fresh)
            yield pa.RecordBatch.from_arrays(results(found).columns[3 + n :], names=[f.name for f in outs])
        if work:
            yield pa.RecordBatch.from_arrays(results(work.reset()).columns[3 + n :], names=[f.name for f in outs])

    keys = [c if isinstance(c, Column) else F.col(c) for c in order]
    placed = rows.select(*[F.col(c).alias(f"i{k}") for k, c in enumerate(rows.columns)], *[c.alias(f"k{j}") for j, c in enumerate(keys)])
    ranked = [F.asc_nulls_last(f"k{j}") for j in range(len(keys))]
    laid = placed.repartitionByRange(*ranked).sortWithinPartitions(*ranked).select(*plain.columns)
    done, _ = stored(laid.mapInArrow(by_piece, full))
    told = done.where("piece is not null")
    marks = sorted((r.piece, r.left) for r in told.groupBy("piece").agg(F.max(F.col("state").isNotNull()).alias("left")).collect())
    group, last = [], -1
    for piece, left in marks:
        group.append((piece, last))
        last = piece if left else last
    # A row for each task of the first step.
    groups = F.broadcast(rows.sparkSession.createDataFrame(group, "piece int, from_piece int"))
    heads = told.join(groups, "piece").withColumn("group", F.when(F.col("state").isNotNull(), F.col("piece")).otherwise(F.col("from_piece")))
    again = heads.repartition("group").sortWithinPartitions("group", "piece", "seq").select("group", "state", *plain.columns).mapInArrow(by_group, T.StructType(outs))
    inner = done.where("piece is null").select(*[f.name for f in outs])
    return inner.union(again).toDF(*schema.names)
