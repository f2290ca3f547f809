"""Query registry: a Spark callable and, where SQL can say it, the same query in ANSI SQL.

Doubles are rounded to six digits on both sides because the order of floating-point sums is not
defined in either engine; integers are widened to 64 bits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.views import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: SQL without rounding, for queries built from others.
RAW: dict[str, str] = {}
DIGITS = 6


def tidy(df: DataFrame) -> DataFrame:
    out = []
    for f in df.schema.fields:
        col = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            col = F.round(col.cast("double"), DIGITS) + F.lit(0.0)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            col = col.cast("long")
        out.append(col.alias(f.name))
    return df.select(*out)


def query(name: str, sql: str | None = None, views: str = "", d: str = "", i: str = "", extra: str = ""):
    """Register a query. ``d`` and ``i`` name its double and integer result columns."""

    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, path: tidy(fn(spark, path))
        if sql is not None:
            fixes = [f'round("{x}"::double, {DIGITS}) + 0e0 as "{x}"' for x in d.split()]
            fixes += [f'"{x}"::bigint as "{x}"' for x in i.split()]
            repl = f" replace ({', '.join(fixes)})" if fixes else ""
            RAW[name] = with_views(views, sql.strip(), extra)
            ORACLES[name] = with_views(views, f"select *{repl} from (\n{sql.strip()}\n) result_rows", extra)
        return fn

    return wrap
