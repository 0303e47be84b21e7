"""All queries of the decision model."""

from . import builders, curation, evaluation, reading, rules, selection, serving  # noqa: F401
from .registry import PLANS, SQL

__all__ = ["PLANS", "SQL"]
