"""Mobility analytics on Spark: location events, trajectories, stays, cells, areas and routes."""

from wayfare.session import build_session, ensure_utc, shared_dir

__all__ = ["build_session", "ensure_utc", "shared_dir"]
