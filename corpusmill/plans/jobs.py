"""The two jobs on raw corpora: ``features`` (text to weighted vectors) and ``models`` (train, score, report)."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import longest_match
from corpusmill.operators import classify, text
from corpusmill.session import local_session
from corpusmill.sources import parquet, raw_corpus, stopwords, write_parquet, write_report, write_timing


def build_features(spark: SparkSession, root: str, stop_path: str | None, out: str, filtered: bool, script: str | None, mode: str = "error", words: list[str] | None = None, timing: str | None = None) -> None:
    """Writes train, test, train_normed, test_normed under out. Fitted parts come from train alone.

    ``words`` cuts scripts without spaces by a word list; ``timing`` names a report of the seconds taken.
    """
    start = time.monotonic()
    cut = longest_match(words) if words else None
    train, test = (raw_corpus(spark, f"{root}/{part}/*/*").withColumn("doc_id", F.col("path")) for part in ("train", "test"))
    classes = text.label_index(train)
    stop = [r.value for r in stopwords(spark, stop_path).collect()] if stop_path else []

    def clean(df: DataFrame) -> DataFrame:
        return text.without_stopwords(text.token_arrays(df, cut).join(F.broadcast(classes), "label_name"), stop).select("doc_id", "tokens", "label")

    a, b = clean(train), clean(test)
    if filtered:
        rows = a.select("doc_id", F.explode("tokens").alias("term")).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("n"))
        vocab = text.vocabulary(rows, script=script)
        a, b = text.keep_vocabulary(a, vocab), text.keep_vocabulary(b, vocab)
    for l1, tail, column in ((False, "", "tf_idf_vector"), (True, "_normed", "normed_tf_idf_vector")):
        for name, df in zip(("train", "test"), classify.hashed_features(a, b, l1=l1), strict=True):
            write_parquet(df.select(F.col("features").alias(column), "label"), f"{out}/{name}{tail}", mode)
    if timing:
        write_timing(timing, time.monotonic() - start)


def train_model(spark: SparkSession, name: str, train: str, test: str, report: str, sample: tuple[int, int] | None = None) -> float:
    start = time.monotonic()
    column = "normed_tf_idf_vector" if train.rstrip("/").endswith("_normed") else "tf_idf_vector"
    a, b = parquet(spark, train), parquet(spark, test)
    if sample:
        a, b = a.orderBy(F.rand(1)).limit(sample[0]), b.orderBy(F.rand(1)).limit(sample[1])
    accuracy = classify.evaluate(classify.fit_predict(name, a.withColumn("label", F.col("label").cast("double")), b.withColumn("label", F.col("label").cast("double")), features=column))
    write_report(report, accuracy, time.monotonic() - start)
    return accuracy


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser()
    p.add_argument("--local", action="store_true")
    sub = p.add_subparsers(dest="job", required=True)
    f = sub.add_parser("features")
    f.add_argument("root")
    f.add_argument("out")
    f.add_argument("--stopwords")
    f.add_argument("--filtered", action="store_true")
    f.add_argument("--script", default="cjk")
    f.add_argument("--words", help="a word list, one a line, for scripts without spaces")
    f.add_argument("--timing")
    m = sub.add_parser("models")
    m.add_argument("model", choices=["LR", "SVM", "NB"])
    m.add_argument("train")
    m.add_argument("test")
    m.add_argument("report")
    a = p.parse_args(args)
    spark = local_session() if a.local else SparkSession.builder.getOrCreate()
    if a.job == "features":
        words = [r.value for r in stopwords(spark, a.words).collect()] if a.words else None  # a word list, bounded by its file
        build_features(spark, a.root, a.stopwords, a.out, a.filtered, a.script, words=words, timing=a.timing)
    else:
        train_model(spark, a.model, a.train, a.test, a.report)


if __name__ == "__main__":
    main()
