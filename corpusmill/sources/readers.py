"""Readers: labelled corpora, Parquet tables, stopword lists and inverted-index lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def raw_corpus(spark: SparkSession, glob: str, keep_empty: bool = True) -> DataFrame:
    """``root/<class>/<file>``, a document per file: path, text, label_name.

    An empty file is a document. Spark's text source has no row for one, so ``keep_empty``
    reads through ``wholeTextFiles``, the one RDD entry point of the library.
    """
    if keep_empty:
        files = spark.createDataFrame(spark.sparkContext.wholeTextFiles(glob), "path string, text string")
    else:
        files = spark.read.text(glob, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return files.withColumn("label_name", F.regexp_extract("path", "([^/]+)/[^/]+$", 1))


def corpus(docs: DataFrame, label: str = "lang") -> DataFrame:
    """doc_id, text, label_name of a documents table."""
    return docs.select("doc_id", "text", F.col(label).alias("label_name"))


def lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def stopwords(spark: SparkSession, path: str) -> DataFrame:
    """A word a line, trimmed, blank lines dropped: value."""
    return spark.read.text(path).select(F.trim("value").alias("value")).where("value <> ''").distinct()


def index_lines(df: DataFrame, column: str = "value") -> DataFrame:
    """Lines ``(w) N,...<tab>file: n;file: n`` as term, total, postings; w loses its wrapper characters.

    A posting that isn't ``file: n`` and a line without a tab have no postings.
    """
    line = F.col(column)
    head, tail = F.split(line, "\t", 2)[0], F.get(F.split(line, "\t", 2), F.lit(1))
    word = F.substring_index(head, " ", 1)
    total = F.substring_index(F.regexp_replace(head, "^[^ ]* ", ""), ",", 1)
    items = F.filter(F.split(F.coalesce(tail, F.lit("")), ";"), lambda x: x.contains(": "))
    return df.select(
        F.substring(word, F.lit(2), F.greatest(F.length(word) - 2, F.lit(0))).alias("term"),
        total.try_cast("bigint").alias("total"),
        F.transform(items, lambda x: F.struct(F.split(x, ": ", 2)[0].alias("doc"), F.split(x, ": ", 2)[1].try_cast("bigint").alias("n"))).alias("postings"),
    )


def parse_score_lines(df: DataFrame, column: str = "value") -> DataFrame:
    """doc, cls, score of lines ``doc|cls|...|score``: re-keyed on the first bar, the score is the last field; fields between are passed over."""
    key = F.split(F.col(column), r"\|", 2)
    rest = F.split(F.get(key, F.lit(1)), r"\|")
    return df.select(key[0].alias("doc"), rest[0].try_cast("int").alias("cls"), F.trim(F.element_at(rest, -1)).try_cast("double").alias("score"))


def idf_lines(df: DataFrame, column: str = "value") -> DataFrame:
    """term, idf of side-file lines ``(w)<tab>idf``; w loses its wrapper characters."""
    p = F.split(F.col(column), "\t", 2)
    return df.select(F.substring(p[0], F.lit(2), F.greatest(F.length(p[0]) - 2, F.lit(0))).alias("term"), F.get(p, F.lit(1)).try_cast("double").alias("idf"))


def vector_lines(df: DataFrame, column: str = "value") -> DataFrame:
    """doc, vec of lines ``file<tab>idx:val idx:val``; an empty vector stays."""
    p = F.split(F.col(column), "\t", 2)
    return df.select(p[0].alias("doc"), F.coalesce(F.get(p, F.lit(1)), F.lit("")).alias("vec"))


def count_documents(docs: DataFrame) -> DataFrame:
    """One row, n_docs; empty documents count."""
    return docs.agg(F.count(F.lit(1)).alias("n_docs"))
