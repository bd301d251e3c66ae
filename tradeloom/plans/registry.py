"""Registry of runnable queries and of the SQL that states the same result.

Common table expressions are shared: ``compose`` puts every expression a statement
mentions, directly or through others, in front of it.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradeloom.sources.star import StarTables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
CTES: dict[str, str] = {}

#: Lifts a decimal tie such as 0.125 off the border, where the engines round differently.
NUDGE = 1.00000000000001


def cte(name: str, body: str) -> None:
    CTES[name] = body.strip()


def compose(sql: str) -> str:
    ordered: list[str] = []

    def visit(text: str) -> None:
        for name, body in CTES.items():
            if name not in ordered and re.search(rf"\b{name}\b", text):
                visit(body)
                if name not in ordered:
                    ordered.append(name)

    visit(sql)
    if not ordered:
        return sql.strip()
    parts = ",\n".join(f"{name} AS (\n{CTES[name]}\n)" for name in ordered)
    body = sql.strip()
    glue = ",\n" + body[5:] if body.upper().startswith("WITH ") else "\n" + body
    return f"WITH {parts}{glue}"


def query(name: str, sql: str | None = None, rounded: str = "", digits: int = 6):
    """Register ``f(tables) -> DataFrame`` under ``name``.

    ``rounded`` names the computed doubles that are rounded on both sides for the comparison
    (``name`` or ``name:digits``); the operators themselves do not round.
    """
    columns = {}
    for item in rounded.split():
        column, _, places = item.partition(":")
        columns[column] = int(places or digits)

    def register(build: Callable[[StarTables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = build(StarTables(spark, sf_dir))
            return df.withColumns({c: F.round(F.col(c) * NUDGE, d) for c, d in columns.items()}) if columns else df

        QUERIES[name] = run
        if sql is not None:
            text = compose(sql)
            if columns:
                changes = ", ".join(f"round({c} * CAST({NUDGE} AS DOUBLE), {d}) AS {c}" for c, d in columns.items())
                text = f"SELECT * REPLACE ({changes}) FROM (\n{text}\n) AS result"
            ORACLES[name] = text
        return build

    return register
