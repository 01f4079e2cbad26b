"""Auditable tabular data quality and deduplication on Spark DataFrames."""

from tidyledger.session import build_session, tune
from tidyledger.sources.tables import CellTable, from_frame

__all__ = ["CellTable", "build_session", "from_frame", "tune"]
