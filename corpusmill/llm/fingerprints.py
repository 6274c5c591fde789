"""Document fingerprints by one-permutation MinHash. Only DataFrame functions.

Every shingle is hashed once; its top bits name a bin and each bin keeps its least hash. An
empty bin borrows from the first full bin of its own random sequence of bins (optimal
densification). The low bits of each bin are packed into 64-bit words; the likeness of two
fingerprints is the share of equal bins, corrected for bins that agree by chance.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import GAP, shuffle_parts, text_of
from corpusmill.operators.ranking import range_bounds, range_bucket

#: Bins, bits kept of each, words a shingle.
BINS, BITS, WORDS = 256, 8, 5
#: Probes of an empty bin's sequence before it goes on by priorities over all full bins.
PROBES = 12


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def with_fingerprint(df: DataFrame, text: str, name: str, bins: int = BINS, bits: int = BITS, words: int = WORDS) -> DataFrame:
    """Adds ``name``: array<long> of bins * bits / 64 packed words.

    A shingle is ``words`` lower-cased words; fewer words are one shingle; a null text or one
    without words has the fingerprint of zeros.
    """
    low = 64 - (bins.bit_length() - 1)
    rest = (1 << low) - 1
    w, h, dense, vals, full, filled = (f"__{x}_{name}" for x in ("w", "h", "dense", "vals", "full", "filled"))
    rng = random.Random(7)
    probes = [F.lit([rng.randrange(bins) for _ in range(bins)]) for _ in range(PROBES)]
    ends = F.lit([_signed((((b - bins // 2) << low) | rest) & ((1 << 64) - 1)) for b in range(bins)]).cast("array<bigint>")
    trimmed = F.btrim(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(" \t\n\v\f\r"))
    out = df.withColumn(w, F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, GAP)))
    arr = F.col(w)
    many = F.transform(F.sequence(F.lit(0), F.size(arr) - words), lambda i: F.xxhash64(*[F.get(arr, i + k) for k in range(words)]))
    one = F.when(F.size(arr) > 0, F.array(F.xxhash64(F.array_join(arr, " ")))).otherwise(F.array().cast("array<bigint>"))
    out = out.withColumn(h, F.sort_array(F.concat(F.when(F.size(arr) >= words, many).otherwise(one), ends)))
    hs = F.col(h)
    out = out.withColumn(dense, F.filter(hs, lambda x, i: (i == 0) | (F.shiftright(x, low) != F.shiftright(F.get(hs, i - 1), low))))
    out = out.withColumn(vals, F.transform(dense, lambda x: F.when(x.bitwiseAND(F.lit(rest)) != rest, x)))
    out = out.withColumn(full, F.array_compact(F.col(vals)))
    v, f = F.col(vals), F.col(full)

    def borrowed(x: Column, i: Column) -> Column:
        by_priority = F.array_min(F.transform(f, lambda y: F.struct(F.xxhash64(i, F.shiftright(y, low)).alias("p"), y.alias("y"))))["y"]
        return F.coalesce(x, *[F.get(v, F.get(p, i)) for p in probes], by_priority, F.lit(0).cast("bigint"))

    out = out.withColumn(filled, F.transform(v, borrowed))
    each = 64 // bits
    lane = (1 << bits) - 1
    a = F.col(filled)

    def packed(j: Column) -> Column:
        word = F.get(a, j * each).bitwiseAND(F.lit(lane))
        for k in range(1, each):
            word = word.bitwiseOR(F.shiftleft(F.get(a, j * each + k).bitwiseAND(F.lit(lane)), k * bits))
        return word

    out = out.withColumn(name, F.transform(F.sequence(F.lit(0), F.lit(bins // each - 1)), packed))
    return out.drop(w, h, dense, vals, full, filled)


def as_hex(fingerprint: Column) -> Column:
    return F.array_join(F.transform(fingerprint, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def likeness(a: Column, b: Column, bins: int = BINS, bits: int = BITS) -> Column:
    """Estimated share of common shingles, 0 to 1; equal fingerprints give 1."""
    each = 64 // bits
    lowest = sum(1 << (k * bits) for k in range(each))

    def equal(x: Column, y: Column) -> Column:
        z, step = x.bitwiseXOR(y), bits // 2
        while step:  # the lowest bit of a lane gathers all bits of the lane
            z, step = z.bitwiseOR(F.shiftrightunsigned(z, step)), step // 2
        return F.lit(each) - F.bit_count(z.bitwiseAND(F.lit(lowest)))

    same = F.aggregate(F.zip_with(a, b, equal), F.lit(0), lambda s, x: s + x)
    chance = 2.0**-bits
    return F.greatest(F.lit(0.0), (same.cast("double") / bins - chance) / (1 - chance))


def with_next(docs: DataFrame, columns: list[str]) -> DataFrame:
    """Adds ``next_<c>``: the columns of the row after it by ascending doc_id, of the first for the last.

    Documents are dealt into ranges of doc_id; each range also gets a copy of the first row
    of the range after it, so each is worked on its own. Null ids come first; of equal ids
    the order is that of the columns.
    """
    spark = docs.sparkSession
    least = F.lit(-(1 << 63))
    rows = docs.withColumn("__k", F.coalesce(F.col("doc_id"), least))
    bounds = range_bounds(docs, F.col("doc_id"), min(256, 4 * shuffle_parts(spark)))
    rows = rows.withColumn("__r", range_bucket(F.col("__k"), bounds)).withColumn("__copy", F.lit(0))
    heads = sorted(tuple(x) for x in rows.groupBy("__r").agg(F.min("__k")).collect())  # a row a range
    if not heads:
        return docs.select("*", *[F.col(c).alias(f"next_{c}") for c in columns])
    before = {k: heads[i - 1][0] for i, (_, k) in enumerate(heads)}
    first = rows.where(F.col("__k").isin(list(before))).withColumn("__n", F.row_number().over(Window.partitionBy("__k").orderBy(*columns))).where("__n = 1").drop("__n")
    moved = F.create_map(*[F.lit(x) for kv in before.items() for x in kv])
    copies = first.withColumn("__r", F.element_at(moved, F.col("__k"))).withColumn("__copy", F.lit(1))
    order = Window.partitionBy("__r").orderBy("__copy", "__k", *columns)
    both = rows.unionByName(copies)
    for c in columns:
        both = both.withColumn(f"next_{c}", F.lead(c).over(order))
    return both.where("__copy = 0").drop("__k", "__r", "__copy")


def fingerprint_edits(docs: DataFrame, bins: int = BINS, bits: int = BITS) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last half replaced by the first half as long of the next
    document. An only document is its own next; repeated rows are documents of their own.
    """
    rows = docs.select("doc_id", text_of().alias("text"))
    rows = with_next(with_fingerprint(rows, "text", "fp", bins, bits), ["text", "fp"])
    n, half = F.length("text"), F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "fp", "next_fp", edited.alias("edited"))
    rows = with_fingerprint(rows, "edited", "ep", bins, bits)
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), as_hex(F.col("fp")).alias("fingerprint"),
        as_hex(F.col("ep")).alias("edited_fingerprint"), likeness(F.col("fp"), F.col("ep"), bins, bits).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp"), bins, bits).alias("near_next"),
    )
