"""Windows along sessions of any length.

A session is cut into pieces by its rows' first order column: an hour of time, or 10,000 numbers.
Each piece is a task's window by itself; what a piece takes over from those before it (or after it)
is found from one small row a piece, and enters its window as a row of its own.  So a session that
holds most of the log is many tasks, and its rows are shuffled once.  Rows without a value there are
one piece, the first, as nulls sort first; columns of other types can't be cut and are one piece.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

NUMBERS = 10_000
_PIECE, _OWN, _EDGE = "_piece", "_own", "_edge"


def piece(rows: DataFrame, column: str) -> Column:
    kind = rows.schema[column].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.date_trunc("hour", column)
    return F.floor(F.col(column) / NUMBERS) if isinstance(kind, T.IntegralType) else F.lit(0)


def _cut(rows: DataFrame, order: list[str], value: Column) -> DataFrame:
    return rows.withColumns({_PIECE: piece(rows, order[0]), _OWN: value, _EDGE: F.lit(0)})


def running_sum(rows: DataFrame, key: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """``rows`` with the sum of ``value`` from the first row of ``key`` to each, in ``order``."""
    cut = _cut(rows, order, value.cast("long"))
    before = Window.partitionBy(*key).orderBy(_PIECE).rowsBetween(Window.unboundedPreceding, -1)
    sums = cut.groupBy(*key, _PIECE).agg(F.sum(_OWN).alias("sum"))
    edges = sums.select(*key, _PIECE, F.coalesce(F.sum("sum").over(before), F.lit(0)).alias(_OWN), F.lit(-1).alias(_EDGE))
    w = Window.partitionBy(*key, _PIECE).orderBy(_EDGE, *order).rowsBetween(Window.unboundedPreceding, 0)
    every = cut.unionByName(edges, allowMissingColumns=True)
    return every.withColumn(name, F.sum(_OWN).over(w)).where(F.col(_EDGE) == 0).drop(_PIECE, _OWN, _EDGE)


def next_value(rows: DataFrame, key: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """``rows`` with the first ``value`` that isn't null at each or behind it, in ``order``."""
    cut = _cut(rows, order, value)
    after = Window.partitionBy(*key).orderBy(_PIECE).rowsBetween(1, Window.unboundedFollowing)
    firsts = cut.groupBy(*key, _PIECE).agg(F.min_by(_OWN, F.when(F.col(_OWN).isNotNull(), F.struct(*order))).alias("first"))
    edges = firsts.select(*key, _PIECE, F.first("first", ignorenulls=True).over(after).alias(_OWN), F.lit(1).alias(_EDGE))
    w = Window.partitionBy(*key, _PIECE).orderBy(_EDGE, *order).rowsBetween(0, Window.unboundedFollowing)
    every = cut.unionByName(edges, allowMissingColumns=True)
    return every.withColumn(name, F.first(_OWN, ignorenulls=True).over(w)).where(F.col(_EDGE) == 0).drop(_PIECE, _OWN, _EDGE)
