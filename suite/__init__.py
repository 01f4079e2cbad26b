"""Registered queries over the driver tables, each with the SQL that must give the same rows."""

from suite import cleaning, files, governance, matching, operations, profiling, standardizing
from suite.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "cleaning", "files", "governance", "matching", "operations", "profiling", "standardizing"]
