"""Writers. Output stays in as many files as there are partitions unless one file is asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _files(df: DataFrame, single_file: bool) -> DataFrame:
    return df.repartition(1) if single_file else df


def write_csv(df: DataFrame, path: str, *, delimiter: str = ",", header: bool = True, mode: str = "overwrite", single_file: bool = False) -> None:
    """Delimited files. ``single_file`` sends everything through one task; it suits small results only."""
    _files(df, single_file).write.mode(mode).option("sep", delimiter).option("header", header).csv(path)


def append_csv(df: DataFrame, path: str, *, single_file: bool = False) -> None:
    _files(df, single_file).write.mode("append").csv(path)


def write_parquet(df: DataFrame, path: str, *, mode: str = "error", single_file: bool = False) -> None:
    _files(df, single_file).write.mode(mode).parquet(path)


def write_text(df: DataFrame, column: str | Column, path: str, *, mode: str = "error") -> None:
    value = F.col(column) if isinstance(column, str) else column
    df.select(value.alias("value")).write.mode(mode).text(path)


def append_metric(df: DataFrame, path: str) -> None:
    """Append one run's metric row, without a header, to the metric's folder."""
    df.coalesce(1).write.mode("append").csv(path)


def write_days(df: DataFrame, path: str, *, day: str = "date", fmt: str = "parquet", **options) -> None:
    """One folder for each day that ``df`` has rows of (``path/date=2024-01-01``); a rerun replaces those days and no other.

    Days are replaced when the job commits, so a failed or repeated run leaves what was there. Formats are Spark's (parquet, csv, ...), with
    their options; for text the other column is the line. Rows of a day stay in as many files as there are tasks that have some.
    """
    df.write.mode("overwrite").format(fmt).options(**options).option("partitionOverwriteMode", "dynamic").partitionBy(day).save(path)


def write_bucketed(df: DataFrame, table: str, *, by: str = "agent_id", buckets: int = 200, path: str | None = None, mode: str = "error") -> None:
    """A table whose files are divided by a key, one file for each bucket and sorted by the key.

    Joins and groupings by the key over tables with as many buckets need no exchange, day after day. ``path`` puts the files there;
    otherwise they go to the warehouse. A key with very many rows makes one large bucket: store such tables as distinct rows or sums.
    """
    writer = df.repartition(buckets, by).write.mode(mode).format("parquet").bucketBy(buckets, by).sortBy(by)
    (writer.option("path", path) if path else writer).saveAsTable(table)
