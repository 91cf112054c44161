"""Row-expanding functions over Arrow batches: kept columns pass through as they are."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: characters of text handled at once, so that long texts take no more memory than short ones
CHARS = 2_000_000


def slices(b: pa.RecordBatch, column: int, chars: int = CHARS) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about so many characters of one column (a longer text is a part of its own)."""
    size, first = 0, 0
    for i, v in enumerate(b.column(column).to_pylist()):
        n = len(v) if v is not None else 0
        if size and size + n > chars:
            yield b.slice(first, i - first)
            size, first = 0, i
        size += n
    if first < b.num_rows:
        yield b.slice(first)


def expand(
    df: DataFrame, keep: dict[str, str], text: str, fields: list[T.StructField],
    make: Callable[[], Callable[[list], tuple[list[int], list[list]]]],
) -> DataFrame:
    """Rows of ``df`` -> any number of rows each.

    ``keep`` maps output names to columns that pass through, nulls and types
    untouched; ``make()`` runs once a task and gives the function, which takes the
    texts of a part (null as "") and returns how many rows each gives and the
    values of the new ``fields``, column by column."""
    src = df.select(*[df[c].alias(f"k{i}") for i, c in enumerate(keep.values())], df[text].alias("t"))
    schema = T.StructType([
        *(T.StructField(o, df.schema[c].dataType) for o, c in keep.items()), *fields])
    kinds = [to_arrow_type(f.dataType) for f in fields]
    names = [f.name for f in schema.fields]
    width = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            for b in slices(batch, width):
                n, cols = fn(["" if t is None else t for t in b.column(width).to_pylist()])
                rows = pa.array(np.repeat(np.arange(b.num_rows), n))
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(i).take(rows) for i in range(width)),
                     *(pa.array(c, type=k) for c, k in zip(cols, kinds))], names=names)

    return src.mapInArrow(run, schema)
