"""Exact nearest-rank percentiles, weighted or not, of groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.operators.joins import join_null_safe
from wayfare.operators.ordered import running


def weighted_summary(
    df: DataFrame, keys: Sequence[str], value: str, weight: str | None = None, p: float = 0.5
) -> DataFrame:
    """Per group: ``total`` weight, ``mean``, and ``percentile`` = the first value whose running weight reaches
    ``ceil(p * total)``.

    Equal to repeating each row by its weight, without repeating anything. Rows are summed per distinct value; the sums are
    range-partitioned by group and value, so that a large group, however close its values lie, is dealt over many tasks, and their running
    weights carry over from one partition to the next. The value that holds the rank is then the one row whose running weight passes it.
    Three passes at every size: sum, sort, pick.
    Null values and weights below one are left out; NaN follows all numbers.
    """
    if not 0 <= p <= 1:
        raise ValueError("p must lie between 0 and 1")
    keys = list(keys)
    w = F.lit(1).cast("long") if weight is None else F.col(weight).cast("long")
    by_value = (
        df.select(*keys, F.col(value).alias("_value"), w.alias("_w"))
        .where(F.col("_value").isNotNull() & (F.col("_w") > 0))
        .groupBy(*keys, "_value")
        .agg(F.sum("_w").alias("_w"))
    )
    group = keys or ["_all"]
    placed = running(by_value if keys else by_value.withColumn("_all", F.lit(0)), group, ["_value"], {"_run": F.col("_w")})
    totals = placed.groupBy(*group).agg(
        F.max("_run").alias("total"), (F.sum(F.col("_value").cast("double") * F.col("_w")) / F.sum("_w")).alias("mean")
    )
    need = F.greatest(F.ceil(F.col("total") * F.lit(p)), F.lit(1))
    found = join_null_safe(placed, totals, group).where((F.col("_run") >= need) & (F.col("_run") - F.col("_w") < need))
    return found.select(*keys, "total", "mean", F.col("_value").alias("percentile"))


def nearest_rank_percentile(df: DataFrame, value: str, p: float, keys: Sequence[str] = ()) -> DataFrame:
    """Per group, sorted[ceil(p * n) - 1]; p = 0 gives the smallest value."""
    return weighted_summary(df, keys, value, None, p).select(*keys, "percentile")
