"""Importing this module registers every query."""

from wayfare.checks import codec_checks, geo_checks, io_checks, stream_checks, table_checks, time_checks  # noqa: F401
from wayfare.checks.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
