"""Registration of (query, oracle SQL) pairs and the shared output shape.

``spec`` names the output columns once for both engines: ``name`` for text, ``name:i`` bigint,
``name:f`` double rounded to 6 digits, ``name:m`` to 3, ``name:d`` date, ``name:t`` timestamp,
``name:b`` boolean, ``name:a`` an average of values that are themselves rounded: it can be an
exact half of the last digit, which the engines round differently, so both sides are moved by the
same amount far below that digit first. Dates, timestamps and booleans are compared in a neutral form.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _parse(spec: str) -> list[tuple[str, str]]:
    return [tuple(item.split(":")) if ":" in item else (item, "s") for item in spec.split()]


def _spark_column(name: str, kind: str) -> Column:
    c = F.col(name)
    return {
        "s": lambda: c.cast("string"), "i": lambda: c.cast("bigint"),
        "f": lambda: F.round(c.cast("double"), 6) + 0.0, "m": lambda: F.round(c.cast("double"), 3) + 0.0,
        "a": lambda: F.round(c.cast("double") + 3.337e-8, 6) + 0.0,
        "d": lambda: F.date_format(c, "yyyy-MM-dd"),
        "t": lambda: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS"), "b": lambda: c.cast("bigint"),
    }[kind]().alias(name)


def _sql_column(name: str, kind: str) -> str:
    form = {
        "s": "CAST({0} AS VARCHAR)", "i": "CAST({0} AS BIGINT)",
        "f": "round(CAST({0} AS DOUBLE), 6) + 0.0", "m": "round(CAST({0} AS DOUBLE), 3) + 0.0",
        "a": "round(CAST({0} AS DOUBLE) + 3.337e-8, 6) + 0.0",
        "d": "strftime({0}, '%Y-%m-%d')", "t": "strftime({0}, '%Y-%m-%d %H:%M:%S.%f')",
        "b": "CAST({0} AS BIGINT)",
    }[kind]
    return form.format(f'"{name}"') + f' AS "{name}"'


def register(name: str, spec: str, oracle: str | None, ctes: tuple[str, ...] = ()):
    """Decorator. ``oracle`` is a SELECT over the given CTEs; None leaves a rows-only check."""

    def wrap(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        columns = _parse(spec)

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(spark, sf_dir).select(*[_spark_column(c, k) for c, k in columns])

        QUERIES[name] = run
        if oracle is not None:
            head = "WITH RECURSIVE " + ",\n".join(dict.fromkeys(ctes)) + "\n" if ctes else ""
            outer = ", ".join(_sql_column(c, k) for c, k in columns)
            ORACLES[name] = f"{head}SELECT {outer} FROM (\n{oracle.strip()}\n) AS q"
        return fn

    return wrap
