"""Positions in a global order without a single-partition window."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Rows that one task numbers, about.
ROWS_A_RANGE = 250_000


def range_bounds(df: DataFrame, key: Column, parts: int) -> list:
    """At most parts - 1 increasing cut points of a numeric key: approximate quantiles, found in one aggregation."""
    if parts < 2:
        return []
    at = [i / parts for i in range(1, parts)]
    got = df.select(F.percentile_approx(key, at, 10000)).head()[0]
    return sorted(set(got or []))


def range_bucket(key: Column, bounds: list) -> Column:
    """How many bounds are at or below the key; a null key is in bucket 0."""
    if not bounds:
        return F.lit(0)
    return reduce(add, [F.coalesce(key >= F.lit(b), F.lit(False)).cast("int") for b in bounds])


def with_position(df: DataFrame, order: list[Column], key: Column, name: str = "idx", parts: int | None = None) -> DataFrame:
    """Adds the 0-based position in the order given by ``order``.

    ``key`` is a number that never falls along that order; it deals rows into ranges, each
    range is numbered on its own, and the counts of the ranges before it are added (one row
    a range, so that join's small side is bounded by ``parts``). Rows that tie in the whole
    order get distinct positions in no fixed order.
    """
    spark = df.sparkSession
    parts = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // ROWS_A_RANGE))
    dealt = df.withColumn("__range", range_bucket(key, range_bounds(df, key, parts)))
    sizes = dealt.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("__range", (F.sum("__n").over(Window.orderBy("__range")) - F.col("__n")).alias("__before"))
    own = F.row_number().over(Window.partitionBy("__range").orderBy(*order)) - 1
    return (
        dealt.withColumn("__own", own)
        .join(F.broadcast(before), "__range")
        .withColumn(name, (F.col("__own") + F.col("__before")).cast("long"))
        .drop("__range", "__own", "__before")
    )
