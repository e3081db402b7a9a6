"""Arrow helpers shared by the text operators.

Every text operator is a ``mapInArrow`` over the rows as Spark partitions them.  A record batch is cut into
chunks of bounded bytes (a single longer text makes a chunk of its own, so that texts are always whole), and
the chunk's one UTF-8 buffer is tokenized at once; ``kernel(chunk)`` returns the new columns of these rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.ship import ship

CHUNK_BYTES = 4 << 20
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Lower-cases A-Z and turns every ASCII byte that isn't a letter or digit into a space.
ALNUM = bytes(b if b >= 128 or 48 <= b < 58 or 97 <= b < 123 else b + 32 if 65 <= b < 91 else 32 for b in range(256))
#: Whether a byte is one of [\x20\x09-\x0D].
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def text_buffer(column: pa.Array) -> tuple[np.ndarray, bytes]:
    """Byte offsets (int64, from 0) and bytes of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.string()), "")
    if len(column) == 0:
        return np.zeros(1, np.int64), b""
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return off - off[0], b"" if data is None else data.slice(off[0], off[-1] - off[0]).to_pybytes()


def as_strings(offsets: np.ndarray, data: bytes, kind: pa.DataType | None = None) -> pa.Array:
    """The array of the pieces of data between neighbouring offsets."""
    return pa.Array.from_buffers(kind or pa.string(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])


def split_words(column: pa.Array, table: bytes = LOWER) -> tuple[pa.Array, np.ndarray]:
    """All words of a string column after translating its bytes, and the number of words of each row."""
    offsets, data = text_buffer(column)
    lists = pc.ascii_split_whitespace(as_strings(offsets, data.translate(table)))
    words, parents = lists.flatten(), pc.list_parent_indices(lists)
    real = pc.not_equal(pc.binary_length(words), 0)
    parents = np.asarray(parents.filter(real), dtype=np.int64)
    return words.filter(real), np.bincount(parents, minlength=len(column)).astype(np.int64)


def starts_of(counts: np.ndarray) -> np.ndarray:
    """Offsets of rows with so many elements each, one more than rows."""
    return np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of each piece, one piece after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of values[offsets[i]:offsets[i+1]] for each i."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[offsets[1:]] - total[offsets[:-1]]


def chunks(batch: pa.RecordBatch, text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about limit bytes of text each, and no more than 4096 rows."""
    if batch.num_rows == 0:
        return
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False))
    lo = 0
    while lo < batch.num_rows:
        base = size[lo - 1] if lo else 0
        hi = min(max(lo + 1, int(np.searchsorted(size, base + limit, side="right"))), lo + 4096)
        yield batch.slice(lo, hi - lo)
        lo = hi


def slices(batch: pa.RecordBatch, text: str | None, limit: int) -> Iterator[pa.RecordBatch]:
    """Chunks by bytes of text, or without a text column by rows."""
    if text is not None:
        yield from chunks(batch, text, limit)
    else:
        yield from (batch.slice(at, 4096) for at in range(0, batch.num_rows, 4096))


def by_position(df: DataFrame) -> DataFrame:
    """df with names that any schema string and reader can hold."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def with_columns(df: DataFrame, text: str | None, fields: list[T.StructField], kernel: Callable[[], Callable], limit: int = CHUNK_BYTES) -> DataFrame:
    """df with columns that a kernel computes from chunks of its rows; without a text column chunks are cut by rows.

    kernel() is called once a task and returns chunk -> list of arrays, one for each field.  A column of df with
    the name of a new field (in any case) is replaced (the kernel still sees it), the others stay, whatever their names;
    rows are neither lost nor reordered.
    """
    new_names = {f.name.lower() for f in fields}
    columns = df.columns
    kept = [i for i, c in enumerate(columns) if c.lower() not in new_names]
    plain = by_position(df)
    schema = T.StructType([plain.schema[i] for i in kept] + [T.StructField(f"n{i}", f.dataType) for i, f in enumerate(fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = kernel()
        for batch in batches:
            for part in slices(pa.RecordBatch.from_arrays(batch.columns, names=columns), text, limit):
                yield pa.RecordBatch.from_arrays([part.column(i) for i in kept] + list(work(part)), names=schema.names)
            pa.default_memory_pool().release_unused()

    ship(df.sparkSession)
    return plain.mapInArrow(run, schema).toDF(*[columns[i] for i in kept], *[f.name for f in fields])


def emit(df: DataFrame, columns: list[str], text: str | None, schema: str, kernel: Callable[[], Callable], limit: int = CHUNK_BYTES) -> DataFrame:
    """Rows that a kernel makes of chunks of df's rows; kernel() returns chunk -> iterable of record batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = kernel()
        for batch in batches:
            for part in slices(pa.RecordBatch.from_arrays(batch.columns, names=columns), text, limit):
                yield from work(part)

    ship(df.sparkSession)
    return by_position(df.select(*[F.col(quoted(c)) for c in columns])).mapInArrow(run, schema)


def quoted(name: str) -> str:
    """A column's name as an expression reads it, dots and backticks included."""
    return "`" + name.replace("`", "``") + "`"


def long(name: str) -> T.StructField:
    return T.StructField(name, T.LongType())


def integer(name: str) -> T.StructField:
    return T.StructField(name, T.IntegerType())


def string(name: str) -> T.StructField:
    return T.StructField(name, T.StringType())


def double(name: str) -> T.StructField:
    return T.StructField(name, T.DoubleType())


def boolean(name: str) -> T.StructField:
    return T.StructField(name, T.BooleanType())
