"""Best-fit packing of documents into sequences of a fixed capacity, in bulk-synchronous steps.

Documents of over half the capacity open a sequence each. Then one step a band of lengths,
each half of the one before: documents of the band and open gaps are range-sorted by size
together, and a sweep through each range, sizes falling, gives every document its successor,
the least gap that holds it. Documents that find none in their range meet the gaps left in
the ranges before it by rank, each gap one document; the gaps shrink, and sweeps repeat until
none places anything. What is left opens new sequences. A gap is (sequence, size) alone: the
place in a sequence is the capacity less the gap. Only three counts a range reach the driver.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import text_of
from corpusmill.llm.tokenizing import ids_of
from corpusmill.session import materialise

#: Characters of text that a worker encodes together, and texts that it gets at a time.
HELD, TEXTS = 1 << 20, 500
#: Rows that one task matches, about; the length from which all shorter ones are one step.
ROWS_A_RANGE, LOW = 50_000, 32


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, as bytes): documents cut to the capacity.

    Only a document of more tokens is cut; its first piece takes the remainder. A null or
    empty text is the end id alone. Repeated rows are documents of their own.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = ids_of(tokenizer, small=True)
        for b in batches:
            row, held, size = 0, [], 0
            for text in b.column(1):
                held.append(text.as_py())
                size += len(held[-1])
                if size >= HELD or row + len(held) == b.num_rows:
                    yield _cut(b.column(0).slice(row, len(held)), encode.many(held), capacity, end, with_ids)
                    row, held, size = row + len(held), [], 0

    return docs.select("doc_id", text_of()).mapInArrow(cut, schema)


def _cut(doc: pa.Array, encoded: list[bytes], capacity: int, end: bytes, with_ids: bool) -> pa.RecordBatch:
    """The pieces of some documents, given their ids without the end id."""
    flat = memoryview(end.join([*encoded, b""]))
    n = np.fromiter(map(len, encoded), np.int64, len(encoded)) // 4 + 1
    some = -(-n // capacity)
    own = np.repeat(np.arange(len(n)), some)
    piece = np.arange(len(own)) - np.repeat(np.cumsum(some) - some, some)
    first = n - (some - 1) * capacity
    start = np.where(piece > 0, first[own] + (piece - 1) * capacity, 0)
    length = np.where(piece > 0, capacity, first[own])
    lo = (np.cumsum(n) - n)[own] + start
    cuts = [flat[a:b] for a, b in zip((4 * lo).tolist(), (4 * (lo + length)).tolist(), strict=True)]
    columns = [doc.take(pa.array(own)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(map(zlib.crc32, cuts), pa.int64())]
    return pa.record_batch([*columns, *([pa.array(map(bytes, cuts), pa.binary())] if with_ids else [])], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids])


def _match(capacity: int, low: int):
    """Rows of one range, by size downwards, gaps before documents: each document takes the least gap that holds it.

    A gap that still holds a document of the step stays open. Documents without a gap and
    whole gaps are numbered in their order: ranges settle them among each other by rank.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        open_: list[list[int]] = [[] for _ in range(capacity + 1)]
        mask, placed, left, least = 0, [], [], 0
        for b in batches:
            for key, size, doc in zip(*[b.column(i).to_pylist() for i in range(3)], strict=True):
                least = size
                if doc:
                    above = mask >> size
                    if not above:
                        left.append((1, key, size, None, None, len(left)))
                        continue
                    gap = size + (above & -above).bit_length() - 1
                    held = open_[gap]
                    seq = held.pop()
                    if not held:
                        mask ^= 1 << gap
                    placed.append((2, key, size, seq, capacity - gap, None))
                    key, size = seq, gap - size
                if size:
                    open_[size].append(key)
                    mask |= 1 << size if size > low else 0  # others wait for a later step
        gaps = [(0, seq, size, None, None, None) for size in range(capacity, 0, -1) for seq in open_[size]]
        whole = sum(1 for g in gaps if g[2] >= least)  # these hold any document of a later range
        rows = [*placed, *left, *[(*g[:5], i if i < whole else None) for i, g in enumerate(gaps)]]
        r = TaskContext.get().partitionId()
        for i in range(0, len(rows), 1 << 16):
            part = list(zip(*rows[i : i + (1 << 16)], strict=True))
            kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
            yield pa.record_batch([pa.array([r] * len(part[0]), pa.int32()), *map(pa.array, part, kinds)], names=["r", "kind", "key", "size", "seq", "at", "rank"])

    return work


def settle(left: dict[int, int], whole: dict[int, int]) -> list[tuple[int, int, int, int, int]]:
    """(range, first rank, last rank + 1, range of gaps, rank of the first one's gap): documents left in a range take the least gaps left in the ranges before it."""
    stack: list[list[int]] = []
    out = []
    for r in sorted({*left, *whole}):
        rank, n = 0, left.get(r, 0)
        while rank < n and stack:
            take = min(n - rank, stack[-1][1])
            out.append((r, rank, rank + take, stack[-1][0], stack[-1][1] - 1))
            rank += take
            stack[-1][1] -= take
            if not stack[-1][1]:
                stack.pop()
        if whole.get(r):
            stack.append([r, whole[r]])
    return out


def sweep(docs: DataFrame, gaps: DataFrame, rows: int, capacity: int, low: int) -> tuple[DataFrame, DataFrame, DataFrame, int, bool]:
    """One superstep: (placed, documents left, gaps left, how many documents are left, whether another sweep may place some).

    docs has id and length, gaps has seq and size. Both are range-sorted by size together;
    every range is matched on its own, then the ranks of what is left meet across ranges.
    """
    spark = docs.sparkSession
    ranges = max(1, -(-rows // ROWS_A_RANGE))
    both = gaps.select(F.col("seq").alias("key"), "size", F.lit(False).alias("doc")).unionByName(docs.select(F.col("id").alias("key"), F.col("length").alias("size"), F.lit(True).alias("doc")))
    dealt = both.repartitionByRange(ranges, F.desc("size"), F.asc("doc"), F.xxhash64("key")).sortWithinPartitions(F.desc("size"), "doc", "key")
    out = materialise(dealt.mapInArrow(_match(capacity, low), "r int, kind int, key long, size int, seq long, at int, rank long"), "sweep")
    n: dict[int, dict[int, int]] = {0: {}, 1: {}, 2: {}}
    for x in out.where("kind > 0 OR rank IS NOT NULL").groupBy("r", "kind").count().collect():  # three rows a range
        n[x["kind"]][x["r"]] = x["count"]
    segments = settle(n[1], n[0])
    docs_left, gaps_left = out.where("kind = 1"), out.where("kind = 0")
    placed = out.where("kind = 2").select(F.col("key").alias("id"), "seq", "at")
    left = sum(n[1].values())
    if segments:
        to = F.broadcast(spark.createDataFrame(segments, "sr int, lo long, hi long, gr int, top long"))  # two rows a range at most
        meets = (F.col("r") == F.col("sr")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))
        asked = docs_left.join(to, meets).select(F.col("key").alias("id"), F.col("size").alias("length"), "gr", (F.col("top") - F.col("rank") + F.col("lo")).alias("gk"))
        open_ = gaps_left.where("rank IS NOT NULL").select(F.col("r").alias("gr"), F.col("rank").alias("gk"), F.col("key").alias("seq"), "size")
        met = materialise(asked.join(open_, ["gr", "gk"]).select("id", "length", "seq", "size"), "met")
        placed = placed.unionByName(met.select("id", "seq", (F.lit(capacity) - F.col("size")).cast("int").alias("at")))
        docs_left = docs_left.join(met.select(F.col("id").alias("key")), "key", "left_anti")
        gaps_left = gaps_left.join(met.select(F.col("seq").alias("key")), "key", "left_anti").select(F.col("key").alias("seq"), "size")
        gaps_left = gaps_left.unionByName(met.select("seq", (F.col("size") - F.col("length")).alias("size")).where("size > 0"))
        left -= sum(s[2] - s[1] for s in segments)
    else:
        gaps_left = gaps_left.select(F.col("key").alias("seq"), "size")
    return placed, docs_left.select(F.col("key").alias("id"), F.col("size").alias("length")), gaps_left, left, ranges > 1 and bool(segments or n[2])


def opened(docs: DataFrame, capacity: int) -> DataFrame:
    """id, length, seq, at: documents without a gap open sequences, as many to one as their length goes into the capacity.

    A sequence is called by its first document. Documents are ranked in hash ranges; the last
    sequence of a range and number may hold fewer: ``whole`` is false for its documents.
    """
    each = F.floor(F.lit(capacity) / F.col("length")).cast("int")
    ranges = max(1, -(-docs.count() // ROWS_A_RANGE))
    rows = docs.withColumn("each", each).withColumn("r", F.pmod(F.xxhash64("id"), F.lit(ranges)))
    rank = F.row_number().over(Window.partitionBy("r", "each").orderBy(F.desc("length"), "id")) - 1
    own = Window.partitionBy("r", "each", "group").orderBy(F.desc("length"), "id")
    rows = rows.withColumn("group", F.floor(rank / F.col("each")))
    at = (F.sum("length").over(own.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length")).cast("int")
    many = F.count(F.lit(1)).over(Window.partitionBy("r", "each", "group"))
    return rows.select("id", "length", F.first("id").over(own).alias("seq"), at.alias("at"), (many == F.col("each")).alias("whole"))


def pack(sized: DataFrame, capacity: int = 1024, low: int = LOW) -> DataFrame:
    """Adds sequence_id and offset to rows with a length from 1 to the capacity.

    Repeated rows are packed each; without rows there are no sequences.
    """
    rows = materialise(sized.withColumn("__id", F.monotonically_increasing_id()), "sized")
    ids = rows.select(F.col("__id").alias("id"), F.col("length").cast("int").alias("length"))
    high = capacity // 2
    # Documents of over half the capacity never share: each opens its own sequence.
    large = ids.where(F.col("length") > high)
    placed = large.select("id", F.col("id").alias("seq"), F.lit(0).alias("at"))
    gaps = large.where(F.col("length") < capacity).select(F.col("id").alias("seq"), (F.lit(capacity) - F.col("length")).alias("size"))
    upto, empty = high, 0
    while upto:
        under = upto // 2 if upto > low else 0
        docs = ids.where((F.col("length") > under) & (F.col("length") <= upto))
        left, upto, again, first = docs.count(), under, True, True
        while left:
            if not again and first:
                new = materialise(opened(docs, capacity), "opened")
                some = new if under else new.where("whole")  # in the last step what is left over shares
                placed = placed.unionByName(some.select("id", "seq", "at"))
                gaps = gaps.unionByName(some.groupBy("seq").agg((F.lit(capacity) - F.sum("length")).cast("int").alias("size")).where("size > 0"))
                docs = new.where("not whole").select("id", "length")
                left, first = 0 if under else docs.count(), False
            elif not again:
                need = -(-docs.agg(F.sum("length")).head()[0] // capacity)
                gaps = gaps.unionByName(sized.sparkSession.range(empty, empty + need).select((-F.col("id") - 1).alias("seq"), F.lit(capacity).alias("size")))
                empty += need
            if left and (again or not first):
                wide = gaps.where(F.col("size") > under)
                more, docs, wide_left, left, again = sweep(docs, wide, left + wide.count(), capacity, under)
                placed = placed.unionByName(more)
                gaps = materialise(gaps.where(F.col("size") <= under).unionByName(wide_left), "gaps")
    place = placed.select(F.col("id").alias("__id"), F.col("seq").cast("long").alias("sequence_id"), F.col("at").cast("long").alias("offset"))
    return rows.join(place, "__id").drop("__id")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every document's pieces."""
    return pack(materialise(pieces(docs, tokenizer, capacity, end_id), "pieces", TEXTS), capacity)


def sequences(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """sequence_id, ids array<int>, doc_ids array<long>: the packed sequences themselves.

    A sequence has at most ``capacity`` pieces, so a group is bounded.
    """
    own = materialise(pieces(docs, tokenizer, capacity, end_id, with_ids=True), "pieces", TEXTS)
    placed = pack(own, capacity).groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("p"))
    words = F.flatten(F.transform("p", lambda x: F.split(F.regexp_replace(F.hex(x["ids"]), "(.{8})(?=.)", "$1 "), " ")))
    little = lambda h: F.conv(F.concat(h.substr(7, 2), h.substr(5, 2), h.substr(3, 2), h.substr(1, 2)), 16, 10).cast("int")
    return placed.select("sequence_id", F.transform(words, little).alias("ids"), F.col("p")["doc_id"].alias("doc_ids"))
