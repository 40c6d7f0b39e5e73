"""Numbers to bins."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame


def equal_splits(lower: float, upper: float, interval: float, extend_last: bool = False) -> list[float]:
    """Bounds lower, lower + interval, ... up to upper; a rest shorter than the interval has no bin of its own.

    ``extend_last`` adds upper as a last bound, so that the rest gets one.
    """
    if interval <= 0 or upper <= lower:
        raise ValueError("interval must be positive and upper above lower")
    steps = math.floor((upper - lower) / interval + 1e-9)
    splits = [lower + i * interval for i in range(steps + 1)]
    if extend_last and splits[-1] < upper:
        splits.append(upper)
    return splits


def equal_bin(
    df: DataFrame, lower: float, upper: float, interval: float, column: str, out: str, extend_last: bool = False
) -> DataFrame:
    """Bin number as a double; bins are [a, b), the last one [a, b]. A value outside fails the query."""
    return custom_bin(df, equal_splits(lower, upper, interval, extend_last), column, out)


def custom_bin(df: DataFrame, splits: Sequence[float], column: str, out: str) -> DataFrame:
    bucketizer = Bucketizer(inputCol=column, outputCol=out, splits=[float(s) for s in splits])
    return bucketizer.transform(df)
