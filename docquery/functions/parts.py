"""Python functions over columns in small parts: a worker's memory follows a part's bytes, not the rows of an Arrow batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of arguments that are looked at at a time; a larger row is a part of its own.
PART_BYTES = 1 << 20
#: Rows that are looked at at a time.
PART_ROWS = 512


def parts(arrays: tuple[pa.Array, ...]) -> Iterator[tuple[pa.Array, ...]]:
    """Slices of columns of equal length, halved until each is small or a single row."""
    n = len(arrays[0])
    if n <= 1 or n <= PART_ROWS and sum(a.nbytes for a in arrays) <= PART_BYTES:
        yield arrays
        return
    yield from parts(tuple(a.slice(0, n // 2) for a in arrays))
    yield from parts(tuple(a.slice(n // 2) for a in arrays))


def mapped(make: Callable[..., list], returns: str, kind: pa.DataType, *columns: Column) -> Column:
    """A column of what `make` gives for lists of the columns' values (returns and kind: its type for Spark and for Arrow)."""

    @F.arrow_udf(returns)
    def one(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for (part,) in parts((batch,)):
                yield pa.array(make(part.to_pylist()), kind)

    @F.arrow_udf(returns)
    def many(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for batch in batches:
            for part in parts(tuple(batch)):
                yield pa.array(make(*(x.to_pylist() for x in part)), kind)

    return (one if len(columns) == 1 else many)(*columns)
