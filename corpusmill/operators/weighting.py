"""Term weights in long form (doc_id, term, value) and as sparse text vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import idf_plain, idf_single, idf_smooth, java_hash
from corpusmill.operators.text import with_terms


def idf(vocab: DataFrame, n_docs: DataFrame, kind: str = "smooth") -> DataFrame:
    """term, idf. ``smooth``: ln((N+1)/(df+1)); ``plain``: ln(N/(df+1)); ``single``: the same in single precision. n_docs is one row."""
    weight = {"smooth": idf_smooth, "plain": idf_plain, "single": idf_single}[kind]
    return vocab.crossJoin(F.broadcast(n_docs)).select("term", weight(F.col("n_docs"), F.col("df")).alias("idf"))


def tf_counts(tf: DataFrame, vocab: DataFrame) -> DataFrame:
    return with_terms(tf, vocab.select("term")).select("doc_id", "term", "n")


def tf_l1(counts: DataFrame) -> DataFrame:
    """doc_id, term, ntf: shares of a document's kept tokens."""
    total = F.sum("n").over(Window.partitionBy("doc_id"))
    return counts.select("doc_id", "term", (F.col("n").cast("double") / total).alias("ntf"))


def weigh(values: DataFrame, weights: DataFrame, column: str) -> DataFrame:
    """doc_id, term, val = value * idf."""
    return with_terms(values, weights).select("doc_id", "term", (F.col(column) * F.col("idf")).alias("val"))


def bow_string(docs: DataFrame, weighted: DataFrame, index: DataFrame) -> DataFrame:
    """doc_id, vec: ``idx:val`` with four decimals, by idx, space-joined; '' for an empty document."""
    entries = with_terms(weighted, index).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("idx", "val"))).alias("e"))
    text = F.array_join(F.transform("e", lambda x: F.format_string("%d:%.4f", x["idx"], x["val"])), " ")
    return docs.select("doc_id").join(entries, "doc_id", "left").select("doc_id", F.coalesce(text, F.lit("")).alias("vec"))


def bow_parse(vectors: DataFrame) -> DataFrame:
    """Back from vec to doc_id, idx, val; an empty vector has no row."""
    items = F.filter(F.split(F.trim("vec"), " "), lambda x: x != "")
    pair = vectors.select("doc_id", F.explode(items).alias("x")).select("doc_id", F.split("x", ":").alias("p"))
    return pair.select("doc_id", F.col("p")[0].cast("long").alias("idx"), F.col("p")[1].cast("double").alias("val"))


def hash_slots(weighted: DataFrame, index: DataFrame, slots: int = 87423) -> DataFrame:
    """doc_id, slot, val: values summed where the decimal index strings of terms hash to the same slot; a term is hashed once."""
    own = index.select("term", java_hash(F.col("idx").cast("string"), slots).cast("long").alias("slot"))
    return with_terms(weighted, own).groupBy("doc_id", "slot").agg(F.sum("val").alias("val"))


def slot_load(index: DataFrame, slots: int = 87423) -> DataFrame:
    """slot, n: how many indexes meet in a slot."""
    return index.groupBy(java_hash(F.col("idx").cast("string"), slots).cast("long").alias("slot")).agg(F.count(F.lit(1)).alias("n"))


def whole_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows again, those of one ``at`` (which never falls) always together."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        table = pa.Table.from_batches([*held, b])
        at = table.column("at").to_numpy()
        if (np.diff(at) < 0).any():
            raise ValueError("rows are not in the order of their documents")
        last = int(np.searchsorted(at, at[-1]))
        if last:
            yield table.slice(0, last)
        held = table.slice(last).to_batches()
    if held:
        yield pa.Table.from_batches(held)


def _starts(at: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))


def by_document(lists: DataFrame, table: DataFrame, columns: list[str], work: Callable[[pa.Table], pa.Table], out: str, keep: str = "inner") -> DataFrame:
    """work() over whole documents, without a shuffle: doc_id, rows and the columns of their terms joined with a table of terms.

    with_terms() leaves rows in their order, so the terms of a row of term_lists() follow one
    another; ``at`` numbers that row. out: columns after doc_id.
    """
    every = lists.withColumn("at", F.monotonically_increasing_id())
    rows = every.select("at", "doc_id", "rows", (F.inline_outer if keep == "left" else F.inline)("terms"))
    joined = with_terms(rows, table, keep).select("at", "doc_id", "rows", *columns)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_runs(batches):
            yield from work(t).combine_chunks().to_batches()

    return joined.mapInArrow(each, f"doc_id {lists.schema['doc_id'].dataType.simpleString()}, {out}")


def l1_in_rows(lists: DataFrame, weights: DataFrame) -> DataFrame:
    """doc_id, term, ntf, idf of the terms with a weight: shares of a document's kept tokens."""

    def work(t: pa.Table) -> pa.Table:
        n, at = t.column("n").to_numpy(), t.column("at").to_numpy()
        first = _starts(at)
        total = np.repeat(np.add.reduceat(n, first), np.diff(np.append(first, len(at))))
        return pa.table({"doc_id": t.column("doc_id"), "term": t.column("term"), "ntf": pa.array(n / total), "idf": t.column("idf")})

    return by_document(lists, weights.select("term", "idf"), ["term", "n", "idf"], work, "term string, ntf double, idf double")


def bow_string_in_rows(lists: DataFrame, places: DataFrame) -> DataFrame:
    """bow_string() of term_lists() and a table (term, idx, idf); a document for each row of an id, a null id has ''."""

    def work(t: pa.Table) -> pa.Table:
        at, known = t.column("at").to_numpy(), t.column("idx").is_valid().to_numpy()
        first = _starts(at)
        kept = t.filter(pa.array(known)).combine_chunks()
        own, idx = kept.column("at").to_numpy(), kept.column("idx").to_numpy()
        order = np.lexsort((idx, own))
        ends = np.append(np.searchsorted(own, at[first]), len(own)).astype(np.int32)
        pairs = pa.StructArray.from_arrays([pa.array(idx[order]), pa.array(kept.column("val").to_numpy()[order])], names=["idx", "val"])
        head = t.select(["doc_id", "rows"]).take(pa.array(first))
        return pa.table({"doc_id": head.column("doc_id"), "rows": head.column("rows"), "e": pa.ListArray.from_arrays(pa.array(ends), pairs)})

    columns = ["idx", (F.col("n") * F.col("idf")).alias("val")]
    entries = by_document(lists, places, columns, work, "rows long, e array<struct<idx:bigint,val:double>>", "left")
    text = F.array_join(F.transform("e", lambda x: F.format_string("%d:%.4f", x["idx"], x["val"])), " ")
    vec = entries.select("doc_id", "rows", F.when(F.col("doc_id").isNull(), "").otherwise(text).alias("vec"))
    return vec.select("doc_id", "vec", F.explode(F.array_repeat(F.lit(0), F.col("rows").cast("int")))).select("doc_id", "vec")


def hash_slots_in_rows(lists: DataFrame, places: DataFrame, slots: int = 87423) -> DataFrame:
    """hash_slots() of term_lists() and a table (term, idx, idf); a term is hashed once."""

    def work(t: pa.Table) -> pa.Table:
        at, slot = t.column("at").to_numpy(), t.column("slot").to_numpy()
        order = np.lexsort((slot, at))
        at, slot = at[order], slot[order]
        first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (slot[1:] != slot[:-1])]))
        val = np.add.reduceat(t.column("val").to_numpy()[order], first)
        return pa.table({"doc_id": t.column("doc_id").take(pa.array(order[first])), "slot": pa.array(slot[first]), "val": pa.array(val)})

    own = places.select("term", java_hash(F.col("idx").cast("string"), slots).cast("long").alias("slot"), "idf")
    return by_document(lists, own, ["slot", (F.col("n") * F.col("idf")).alias("val")], work, "slot long, val double")
