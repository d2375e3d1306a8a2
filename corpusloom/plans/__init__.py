"""Registered queries over the standard tables."""

from corpusloom.plans import corpus_queries, sample_queries, text_queries  # noqa: F401  they register themselves
from corpusloom.plans.catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
