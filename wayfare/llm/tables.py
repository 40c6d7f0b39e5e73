"""Helpers that the operators of this package share: safe column names, hashes, tables in the shared folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from wayfare.session import materialize, shared_dir

__all__ = ["hold", "low_hex", "map_column", "prefixed", "shared_dir", "text_of", "unused"]


def text_of(column: str = "text") -> Column:
    """A text column in which null counts as empty."""
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


def unused(df: DataFrame, wanted: str) -> str:
    """``wanted``, or a longer name where the table has a column of that name (compared without case)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def prefixed(df: DataFrame, added: list[str]) -> DataFrame:
    """``df`` without columns that an operator is about to add under the same names (compared without case)."""
    names = {c.lower() for c in added}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in names])


def hold(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, lineage cut, safe against lost executors."""
    return materialize(df, label)


def low_hex(number: Column) -> Column:
    """A long as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(number), 16, "0"))


#: Rows that ``map_column`` handles at once: what Python holds besides the incoming batch stays small.
ROWS = 512


def map_column(df: DataFrame, work: str, added: dict[str, str], function: Callable[[pa.Array], list[pa.Array]]) -> DataFrame:
    """``df`` without column ``work`` and with the columns ``added`` (name to type) that ``function`` makes from it, an Arrow batch at a time."""
    keep = [c for c in df.columns if c != work]
    schema = StructType([f for f in df.schema.fields if f.name != work] + [StructField(name, DataType.fromDDL(kind)) for name, kind in added.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(work)
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                columns = [part.column(i) for i in range(part.num_columns) if i != at]
                yield pa.RecordBatch.from_arrays([*columns, *function(part.column(at))], names=[*keep, *added])

    return df.mapInArrow(run, schema)
