"""Ordered rule ladders as one CASE expression."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_column(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def first_match(rules: Iterable[tuple[Column, object]], otherwise=None) -> Column:
    """Value of the first rule whose condition is true."""
    expr = None
    for condition, value in rules:
        expr = F.when(condition, as_column(value)) if expr is None else expr.when(condition, as_column(value))
    if expr is None:
        return as_column(otherwise)
    return expr.otherwise(as_column(otherwise)) if otherwise is not None else expr


def score_ladder(value: Column, bounds: Iterable, smaller_is_better: bool) -> Column:
    """5, 4, 3, ... for each bound that is met, best bound first; 1 otherwise."""
    rules = [
        (value <= b if smaller_is_better else value >= b, 5 - i) for i, b in enumerate(bounds)
    ]
    return first_match(rules, 1)


def contains_any(text: Column, words: Iterable[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def ilike_rule(text: Column, include: Iterable, exclude: Iterable[str]) -> Column:
    """All of ``include`` occur (a tuple means any of its members) and none of ``exclude``."""

    def hit(pattern) -> Column:
        if isinstance(pattern, tuple):
            return reduce(lambda a, b: a | b, [hit(p) for p in pattern])
        return text.ilike(f"%{pattern}%")

    wanted = [hit(p) for p in include]
    unwanted = [~hit(p) for p in exclude]
    return reduce(lambda a, b: a & b, wanted + unwanted)
