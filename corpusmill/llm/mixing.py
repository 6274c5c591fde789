"""Mixing sources to target weights, in words.

Every document gets a hash-random key; within a source, documents are range-sorted by it,
prefix sums of their sizes are computed range by range, and the source is cut at its exact
budget. A budget above the source's size takes whole epochs first. Only DataFrame functions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import WORD, text_of, with_text
from corpusmill.session import materialise

#: Rows that one task sorts, about.
ROWS_A_RANGE = 50_000


def words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def random_key(seed: str = "mix") -> Column:
    """60 bits of the digest of seed and doc_id: any rerun, engine and partitioning gives the same."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """source, source_size, target, from source and source_size (a row a source).

    Sources in code-point order, a null last, weigh ``weights`` in turn and share ``share``
    times all sizes. A target stops at ``cap`` times its source; with sources by
    cap * size / weight, the common level is the greatest that any cut of that order gives.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("__w", w).withColumn("__cap", F.lit(cap) * F.col("source_size"))
    by = Window.orderBy(F.col("__cap") / F.col("__w"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    below = F.sum("__cap").over(by) - F.col("__cap")
    weight = F.sum("__w").over(everything) - F.sum("__w").over(by) + F.col("__w")
    total = F.lit(share) * F.sum("source_size").over(everything)
    rows = rows.withColumn("__below", below).withColumn("__weight", weight).withColumn("__total", total)
    level = F.max((F.col("__total") - F.col("__below")) / F.col("__weight")).over(everything)
    return rows.withColumn("__level", level).select("source", "source_size", F.least(F.col("__cap"), F.col("__level") * F.col("__w")).alias("target"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: str = "mix") -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of docs (doc_id, text, source).

    A null text has size 0, a null source is a source. taken sums to the rounded target of
    each source; the document at the cut gives only the words up to it. Repeated rows count
    each; an empty table gives no rows.
    """
    return _mixed(materialise(docs.select("doc_id", "source", words(text_of()).alias("size"), random_key(seed).alias("__key"), F.xxhash64("text").alias("__tie")), "sizes"), weights, share, cap).select(
        "doc_id", "size", "source_size", "target", "taken"
    )


def _mixed(sized: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    bits = max(0, math.ceil(math.log2(max(1, sized.count() / ROWS_A_RANGE))))
    dealt = sized.withColumn("__r", F.shiftright("__key", 60 - bits)).withColumn("__s", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    sums = dealt.groupBy("__s", "__r").agg(F.first("source").alias("source"), F.sum("size").alias("__n"))
    per_source = sums.groupBy("__s").agg(F.first("source").alias("source"), F.sum("__n").alias("source_size"))
    goal = targets(per_source.select("source", "source_size"), weights, share, cap)
    goal = goal.select(F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("__s"), "source_size", "target")
    before = sums.select("__s", "__r", (F.sum("__n").over(Window.partitionBy("__s").orderBy("__r")) - F.col("__n")).alias("__b")).join(goal, "__s")
    order = Window.partitionBy("__s", "__r").orderBy("__key", "doc_id", "__tie").rowsBetween(Window.unboundedPreceding, 0)
    own = F.sum("size").over(order) - F.col("size")
    rows = dealt.withColumn("__o", own).join(before, ["__s", "__r"])
    budget = F.floor(F.col("target") + 0.5)
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    rest = budget - epochs * F.col("source_size") - F.col("__o") - F.col("__b")
    return rows.withColumn("taken", (epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest))).cast("long"))


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    ends = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    return F.array_join(F.slice(ends, F.lit(1), n.cast("int")), "")


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: str = "mix") -> DataFrame:
    """The mix itself, with the columns of docs: a row an epoch for each document taken.

    The document at a source's cut comes with its first words alone; n_chars, where there is
    such a column, follows. Documents that the mix leaves out or that have no words go.
    Columns of any name pass through.
    """
    key = [random_key(seed).alias("__key"), F.xxhash64("text").alias("__tie")]
    sized = materialise(docs.select("doc_id", "source", words(text_of()).alias("size"), *key), "sizes")
    taken = _mixed(sized, weights, share, cap).select("doc_id", "__key", "__tie", "__s", F.col("size").alias("__size"), F.col("taken").alias("__taken"))
    # Rows alike in key, text and source differ in taken at a cut only: numbered, each meets its own.
    same = Window.partitionBy("__key", "__tie", "__s").orderBy("doc_id")
    left = docs.select(F.struct("*").alias("row"), "doc_id", "text", *key, F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("__s")).withColumn("__i", F.row_number().over(same))
    right = taken.withColumn("__i", F.row_number().over(Window.partitionBy("__key", "__tie", "__s").orderBy("doc_id", F.desc("__taken")))).drop("doc_id")
    rows = left.join(right, ["__key", "__tie", "__s", "__i"]).where("__taken > 0")
    parts = F.transform(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__taken") - 1) / F.col("__size"))), lambda e: F.least(F.col("__size"), F.col("__taken") - e * F.col("__size")))
    out = rows.withColumn("__part", F.explode(parts)).withColumn("text", F.when(F.col("__part") < F.col("__size"), first_words(F.col("text"), F.col("__part"))).otherwise(F.col("text")))
    return with_text(out.select("row", "text"), docs.columns)
