"""Writers. The mode is explicit: a rerun replaces or fails as the caller says."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_parquet(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).parquet(path)


def write_delimited(df: DataFrame, path: str, sep: str = "\t", mode: str = "error") -> None:
    """Columns in order, joined; a null becomes an empty field."""
    fields = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]
    df.select(F.concat_ws(sep, *fields).alias("value")).write.mode(mode).text(path)


def score_lines(scores: DataFrame) -> DataFrame:
    """value: ``doc|cls|score`` lines with a space after the score, from doc_id, cls, score."""
    return scores.select(F.concat_ws("|", F.col("doc_id").cast("string"), F.col("cls").cast("string"), F.concat(F.col("score").cast("string"), F.lit(" "))).alias("value"))


def write_timing(path: str, seconds: float) -> None:
    with open(path, "w", encoding="utf-8") as f:
        f.write(f"Time elapsed: {int(seconds)}s\n")


def write_report(path: str, accuracy: float, seconds: float) -> None:
    with open(path, "w", encoding="utf-8") as f:
        f.write(f"Accuracy: {accuracy}\nTime elapsed: {int(seconds)}s\n")
