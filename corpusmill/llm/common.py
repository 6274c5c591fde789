"""What the operators share: reading documents and folding their edge cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def text_of(column: str = "text") -> Column:
    """The text, a null as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def text_hash(column: str = "text") -> Column:
    """Rows of one text have one."""
    return F.xxhash64(text_of(column))


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def with_text(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of the struct ``row``, with the text of the column beside it; n_chars, where there is one, follows the text."""
    n = F.when(F.col("text").isNull(), F.col("row").getField("n_chars")).otherwise(F.length("text").cast("long")) if "n_chars" in columns else None
    own = {"text": F.col("text"), "n_chars": n}
    return rows.select(*[(own[c] if c in own else F.col("row").getField(c)).alias(c) for c in columns])
