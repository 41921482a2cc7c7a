"""Severity levels, rule categories and their display order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Severity names, category labels and their orders.
LEVELS = ("low", "medium", "high", "critical")
REVIEW_LEVELS = ("critical", "high", "medium", "low", "informational")
CATEGORY_OF_FOLDER = {
    "webshell": "Webshell", "rce": "RCE", "traversal": "Traversal", "scanning": "Scanning",
    "auth": "Auth", "upload": "Upload", "aggregation": "Aggregation",
}
CATEGORY_ORDER = ("Webshell", "RCE", "Traversal", "Scanning", "Auth", "Upload", "Aggregation", "Other")


def rank_of(value: Column, names: tuple[str, ...], default: int) -> Column:
    """Position of a value in a short fixed list."""
    ranked = F.when(F.lit(False), F.lit(0))
    for position, name in enumerate(names):
        ranked = ranked.when(value == name, F.lit(position))
    return ranked.otherwise(F.lit(default))


def level_rank(level: Column) -> Column:
    """0 for low up to 3 for critical; unknown names count as low."""
    return rank_of(level, LEVELS, 0)


def review_rank(level: Column) -> Column:
    """0 for the most severe; unknown names come last."""
    return rank_of(level, REVIEW_LEVELS, len(REVIEW_LEVELS))


def at_least(level: str, minimum: str) -> bool:
    """Whether a rule of this level passes the minimum level (unknown names count as low)."""
    ranks = {name: i for i, name in enumerate(LEVELS)}
    return ranks.get(level, 0) >= ranks.get(minimum, 0)
