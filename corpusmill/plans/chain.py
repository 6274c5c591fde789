"""The jobs from files to files: index lines to idf, idf and index to vectors, vectors to scores, scores to classes, classes to accuracy."""

from __future__ import annotations

import argparse

from pyspark.ml.classification import LinearSVC, OneVsRest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators import ovr, text, weighting
from corpusmill.session import materialise
from corpusmill.sources import idf_lines, index_lines, lines, parse_score_lines, score_lines, vector_lines, write_delimited


def idf_job(spark: SparkSession, index: str, n_docs: int, out: str, mode: str = "error") -> None:
    """Lines ``<term><tab>idf``, single precision, from index lines."""
    tf = text.postings_to_terms(index_lines(lines(spark, index)))
    weights = weighting.idf(text.doc_freq(tf), spark.createDataFrame([(n_docs,)], "n_docs long"), "single")
    write_delimited(weights.select(F.concat(F.lit("<"), "term", F.lit(">")), "idf"), out, mode=mode)


def bow_job(spark: SparkSession, index: str, idf: str, out: str, mode: str = "error") -> None:
    """Lines ``file<tab>idx:val idx:val``; a term's index is its place in the byte order of the idf table."""
    tf = materialise(text.postings_to_terms(index_lines(lines(spark, index))), "terms")
    weights = materialise(idf_lines(lines(spark, idf)), "idf")
    vectors = weighting.bow_string(tf.select("doc_id").distinct(), weighting.weigh(tf, weights, "n"), text.vocab_index(weights))
    write_delimited(vectors, out, mode=mode)


def _vectors(spark: SparkSession, path: str, size: int) -> DataFrame:
    def sparse(entries):
        return SparseVector(size, sorted((int(i), float(v)) for i, v in (e.split(":") for e in entries if e)))

    parsed = vector_lines(lines(spark, path)).select("doc", text.prefix_label(F.col("doc")).alias("label_name"), F.split("vec", " ").alias("e"))
    return parsed.select("doc", "label_name", F.udf(sparse, VectorUDT())("e").alias("features"))


def _size(spark: SparkSession, *paths: str) -> int:
    places = [weighting.bow_parse(vector_lines(lines(spark, p)).withColumnRenamed("doc", "doc_id")).agg(F.max("idx")).head()[0] for p in paths]
    return 1 + max([p for p in places if p is not None], default=0)


def train_job(spark: SparkSession, train: str, test: str, out: str, mode: str = "error") -> None:
    """One linear machine a class on the train vectors; lines ``file|class|score`` of every test vector, the least score the best class.

    The class is the first two characters of a file's name; a class's number is its place by name.
    """
    size = _size(spark, train, test)
    rows = _vectors(spark, train, size)
    classes = text.label_index(rows)
    fitted = OneVsRest(classifier=LinearSVC()).fit(rows.join(F.broadcast(classes), "label_name").withColumn("label", F.col("label").cast("double")))
    scored = fitted.transform(_vectors(spark, test, size))
    each = scored.select(F.col("doc").alias("doc_id"), F.posexplode(vector_to_array("rawPrediction")).alias("cls", "margin"))
    score_lines(each.select("doc_id", "cls", (-F.col("margin")).alias("score"))).write.mode(mode).text(out)


def predict_job(spark: SparkSession, scores: str, n_classes: int, out: str, mode: str = "error") -> None:
    """Lines ``file<tab>class``."""
    rows = parse_score_lines(lines(spark, scores)).withColumnRenamed("doc", "doc_id")
    write_delimited(ovr.argmin_class(rows.select("doc_id").distinct(), rows, n_classes), out, mode=mode)


def accuracy_job(spark: SparkSession, predictions: str, classes: list[str]) -> float:
    """Percent of files whose class is that of their name."""
    p = F.split("value", "\t")
    rows = lines(spark, predictions).select((F.array_position(F.lit(classes), text.prefix_label(p[0])) - 1).alias("label"), p[1].cast("long").alias("prediction"))
    return ovr.accuracy(rows).head()["accuracy_pct"]


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser()
    sub = p.add_subparsers(dest="job", required=True)
    for job, names in (("idf", ["index", "n_docs", "out"]), ("bow", ["index", "idf", "out"]), ("train", ["train", "test", "out"]), ("predict", ["scores", "n_classes", "out"]), ("accuracy", ["predictions", "classes"])):
        own = sub.add_parser(job)
        for n in names:
            own.add_argument(n, type=int if n.startswith("n_") else str)
    a = vars(p.parse_args(args))
    spark, job = SparkSession.builder.getOrCreate(), a.pop("job")
    if job == "accuracy":
        print(accuracy_job(spark, a["predictions"], a["classes"].split(",")))
    else:
        {"idf": idf_job, "bow": bow_job, "train": train_job, "predict": predict_job}[job](spark, **a)


if __name__ == "__main__":
    main()
