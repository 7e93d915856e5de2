"""Queries over the star-schema tables, one for each operator, with SQL that says the same."""

from .base import ORACLES, QUERIES
from . import curation, evaluation, fidelity, graph, logs, narration, questions, ranking, streams, texts, truth, understanding  # noqa: F401  (they register their queries)

__all__ = ["ORACLES", "QUERIES"]
