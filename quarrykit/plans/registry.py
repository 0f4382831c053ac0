"""Every query of the reference's operators, with its SQL where SQL can express it."""

from .base import ORACLES, QUERIES
from . import chunks, evaluation, evidence, evolution, focus, graphs, knowledge, relational, retrieval, salvage, stores, texts  # noqa: F401  they register themselves

__all__ = ["ORACLES", "QUERIES"]
