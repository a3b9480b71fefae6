"""Name → (Spark query, oracle SQL) registry."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; without ``sql`` it is checked by rows and by tests only."""

    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def tidy(df: DataFrame, digits: int = 6, averages: Sequence[str] = (), **per_column: int) -> DataFrame:
    """Comparable output: BIGINT, rounded DOUBLE and STRING columns only.

    Averages of money often end exactly on a rounding tie (cents divided by
    8), where the last bit depends on summation order. ``averages`` get 1e-8
    added before rounding, here and in the SQL.
    """
    cols = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.FractionalType,)):
            c = c.cast("double") + F.lit(1e-8 if f.name in averages else 0.0)
            c = F.round(c, per_column.get(f.name, digits)) + F.lit(0.0)
        elif isinstance(f.dataType, (T.IntegralType, T.BooleanType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            c = F.to_date(c).cast("string")
        cols.append(c.alias(f.name))
    return df.select(*cols)
