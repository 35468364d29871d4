"""The registered queries of the library's own operators, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its name, with its SQL if SQL can express it."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _load() -> None:
    from . import bytes as _bytes, clips, formats, geometry, images, nested, objects, pixels, records, state, text  # noqa: F401


def queries() -> dict[str, Query]:
    _load()
    return QUERIES


def oracles() -> dict[str, str]:
    _load()
    return ORACLES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["walk_wmf_summary"](spark, sf_dir)
