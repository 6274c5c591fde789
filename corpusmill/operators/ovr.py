"""One-vs-rest: fan-out, score pivot, arg-min, accuracy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fan_out(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """Each document once a class: the columns of docs, cls and y (1 for its own class).

    ``classes`` (label_name, label) is a dimension of a few rows; docs has label_name.
    """
    dim = F.broadcast(classes.select(F.col("label").cast("int").alias("cls"), F.col("label_name").alias("__name")))
    return docs.crossJoin(dim).withColumn("y", F.coalesce(F.col("label_name") == F.col("__name"), F.lit(False)).cast("int")).drop("__name")


def argmin_class(docs: DataFrame, scores: DataFrame, n_classes: int) -> DataFrame:
    """doc_id, prediction: the class with the least score.

    A missing score is 0.0 and competes; of equal scores the lowest class wins. scores has
    doc_id, cls, score.
    """
    slots = scores.groupBy("doc_id").pivot("cls", list(range(n_classes))).agg(F.min("score"))
    full = docs.select("doc_id").join(slots, "doc_id", "left")
    least = F.least(*[F.struct(F.coalesce(F.col(str(c)), F.lit(0.0)).alias("s"), F.lit(c).alias("c")) for c in range(n_classes)])
    return full.select("doc_id", least["c"].alias("prediction"))


def accuracy(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """accuracy (0 to 1) and accuracy_pct (0 to 100), in one row; null without rows."""
    right = F.avg(F.coalesce(F.col(label) == F.col(prediction), F.lit(False)).cast("double"))
    return df.agg(right.alias("accuracy"), (right * 100).alias("accuracy_pct"))
