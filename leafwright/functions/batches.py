"""Python functions over a column, as Arrow functions that hold a small piece of a batch at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

#: Bytes of text in a piece; what a function makes of it may be some twenty times as large.
PIECE_BYTES = 1 << 18


def cut(sizes: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """(start, length) of runs of about most in all; a larger one is a run of its own."""
    start, total, i = 0, 0, -1
    for i, n in enumerate(pc.fill_null(sizes, 0).to_pylist()):
        if i > start and total + n > most:
            yield start, i - start
            start, total = i, 0
        total += n
    if i >= start:
        yield start, i + 1 - start


def over_texts(f: Callable[[str], object], kind: str, empty: object = None):
    """An Arrow function of f, text by text, that gives type kind, and empty for a null. A worker holds a batch as it came and
    what f makes of one piece of it, whatever the number of rows."""
    made = to_arrow_type(DataType.fromDDL(kind))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for at, n in cut(pc.binary_length(batch), PIECE_BYTES):
                yield pa.array([empty if x is None else f(x) for x in batch.slice(at, n).to_pylist()], made)
            if not len(batch):
                yield pa.array([], made)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, kind)
