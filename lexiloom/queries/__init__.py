"""Queries over the driver's tables, one for each operator or family, with their SQL."""

from . import corpus, dictionary, evaluation, intervals, language, lexicon, relational, selection, vectors  # noqa: F401
from .base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
