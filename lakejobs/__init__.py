"""Partitioned tables and the jobs over them, as Spark jobs. See the README for a tour."""

from lakejobs.session import build_session

__all__ = ["build_session"]
