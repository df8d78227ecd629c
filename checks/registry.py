"""Query registry: ``@query(name, sql)`` pairs a Spark query with the SQL that must agree."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def rounded(df: DataFrame, digits: int = 6, nudge: float = 0.0) -> DataFrame:
    """Round doubles so that the two engines' summation orders cannot show.  ``nudge``
    moves values that fall exactly half-way between two roundings, in both engines."""
    return df.select(
        *[
            (F.round(F.col(f.name) + nudge, digits) + 0.0).alias(f.name)
            if f.dataType.typeName() == "double"
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def select_rounded(
    ctes: str, source: str, keys: Sequence[str], values: Sequence[str] = (), digits: int = 6, nudge: float = 0.0
) -> str:
    """SQL text: ``ctes`` then the keys as they are and the doubles rounded."""
    cols = list(keys) + [f"round({v} + {nudge!r}::double, {digits}) + 0.0 as {v}" for v in values]
    return f"with recursive {ctes}\nselect {', '.join(cols)} from {source}"
