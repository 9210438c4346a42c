"""Registered queries over the test tables, each with the SQL it must agree with."""

from . import checks, catalogs, evidence, payloads, privacy, relational, runs, streams  # noqa: F401
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
