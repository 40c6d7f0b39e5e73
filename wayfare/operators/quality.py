"""Which rows a conversion cannot handle."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def flag_valid(df: DataFrame, attempt: Column, out: str = "is_valid") -> DataFrame:
    """True where an attempt that yields null on failure (``try_*``) gave a value."""
    return df.withColumn(out, attempt.isNotNull())


def quarantine(df: DataFrame, attempt: Column) -> tuple[DataFrame, DataFrame]:
    """The rows the attempt handles, and those it does not."""
    good = attempt.isNotNull()
    return df.where(good), df.where(~good)


def valid_share(df: DataFrame, attempt: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows and failures per group."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(attempt.isNull()).alias("failures")
    )


@dataclass
class Counts:
    """What a write saw: rows that came in, rows an attempt could not handle, rows of each further condition."""

    rows: int
    failures: int
    others: dict[str, int]


def write_counted(df: DataFrame, attempt: Column, path: str, *, flag: str = "is_valid", mode: str = "error", conditions: dict[str, Column] | None = None) -> Counts:
    """Write handled and unhandled rows to ``path/is_valid=true`` and ``=false``, and count them in the same pass.

    The counts come from the pass that writes, so nothing is read twice. ``conditions`` are counted among handled rows.
    """
    seen = Observation()
    good = F.col(flag)
    counted = flag_valid(df, attempt, flag).observe(
        seen, F.count(F.lit(1)).alias("rows"), F.count_if(~good).alias("failures"), *[F.count_if(good & c).alias(f"_{n}") for n, c in (conditions or {}).items()]
    )
    counted.write.mode(mode).partitionBy(flag).parquet(path)
    found = seen.get
    return Counts(found["rows"], found["failures"], {n: found[f"_{n}"] for n in conditions or {}})
