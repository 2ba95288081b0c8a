"""Running Python functions over rows, Arrow batch by Arrow batch, in bounded memory."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: What may be held as Python objects at once, besides one row.
MOST_ROWS, MOST_BYTES = 4096, 1 << 23


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in parts of bounded rows and bytes (by the batch's mean)."""
    step = max(1, min(MOST_ROWS, MOST_BYTES * max(1, batch.num_rows) // max(1, batch.nbytes)))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of Arrow batches as tuples, converted in slices of bounded size."""
    for batch in batches:
        for part in slices(batch):
            yield from zip(*(c.to_pylist() for c in part.columns))


def weight(row: tuple) -> int:
    return sum(len(x) for x in row if isinstance(x, (str, bytes, list)))


def map_stream(df: DataFrame, schema: T.StructType | str, work: Callable[[Iterator[tuple]], Iterable[tuple]]) -> DataFrame:
    """Apply a function from the rows of a task to output rows in ``mapInArrow``.

    Output goes out in batches bounded by rows and by the length of their texts, so long texts never make a task hold all its
    results at once.
    """
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        for row in work(rows_of(batches)):
            out.append(row)
            held += weight(row)
            if len(out) >= MOST_ROWS or held >= MOST_BYTES:
                yield pack(out)
                out, held = [], 0
        if out:
            yield pack(out)

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    return df.mapInArrow(run, schema)


def map_rows(df: DataFrame, schema: T.StructType | str, start: Callable[[], Callable[..., Iterable[tuple]]]) -> DataFrame:
    """Apply a row-to-rows function. ``start`` runs once per task and returns the function, which gets the columns of one row as
    arguments and yields output tuples."""

    def work(rows: Iterator[tuple]) -> Iterator[tuple]:
        each = start()
        for row in rows:
            yield from each(*row)

    return map_stream(df, schema, work)
