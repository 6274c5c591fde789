"""Samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.operators.ranking import ROWS_A_RANGE, range_bounds, range_bucket, with_position


def systematic(df: DataFrame, k: int, key: str = "doc_id") -> DataFrame:
    """Rows 0, k, 2k, ... in the order of a numeric key."""
    return with_position(df, [F.col(key)], F.col(key), "__at").where(F.col("__at") % k == 0).drop("__at")


def systematic_by_class(df: DataFrame, k: int, by: str, key: str = "doc_id") -> DataFrame:
    """Every k-th row of each class, before any fan-out.

    A class may hold most rows: ranges of the key are numbered on their own within each class
    and the counts of a class's earlier ranges are added, a row a class and range.
    """
    parts = max(1, -(-df.count() // ROWS_A_RANGE))
    dealt = df.withColumn("__r", range_bucket(F.col(key), range_bounds(df, F.col(key), parts)))
    sizes = dealt.groupBy(by, "__r").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select(F.col(by).alias("__by"), F.col("__r").alias("__q"), (F.sum("__n").over(Window.partitionBy(by).orderBy("__r")) - F.col("__n")).alias("__b"))
    own = dealt.withColumn("__at", F.row_number().over(Window.partitionBy(by, "__r").orderBy(key)) - 1)
    met = own.join(before, F.col(by).eqNullSafe(F.col("__by")) & (F.col("__r") == F.col("__q")))
    return met.where((F.col("__at") + F.col("__b")) % k == 0).select(*df.columns)


def random_rows(df: DataFrame, n: int, key: str = "doc_id", seed: str = "") -> DataFrame:
    """n rows in the order of a digest of seed and key (top-n, no full sort): any rerun and partitioning select alike."""
    return df.orderBy(F.md5(F.concat(F.lit(seed), F.col(key).cast("string"))), key).limit(n)
