"""Queries over the given tables: each operator applied to whole tables, with the SQL that checks it."""

from . import chat, conversion, extra, files, fixtures, lifecycle, markdown, reconcile, retrieval, validation  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
