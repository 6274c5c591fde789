"""Exact removal of byte strings that also occur elsewhere, by merged suffix orders.

A repeated string of ``length`` bytes has the same bytes around the same anchor (the least
hash of its 32-byte strings) wherever it occurs. Each run of windows with one anchor is a
piece of text. Pieces are counted by anchor and digest: a piece that occurs twice repeats as
a whole; a piece alone under its anchor has nothing that repeats; the others are sharded by
anchor, one of each, and there the shard's suffixes are put in order: all texts' suffixes
are interleaved by their first eight bytes, and the interleave is refined, block by block,
by the rank of the suffix that begins at the end of the common prefix, which doubles that
prefix each round. Blocks of one suffix are settled and not sorted again. What is left in
common blocks at ``length`` bytes are the repeated intervals. No link is lost, no pair is
emitted, and a group of copies costs one piece.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import text_of
from corpusmill.session import forget, materialise

LENGTH, GRAM = 200, 32
#: Bytes that are searched for anchors at once; bytes of pieces a shard; pieces of one anchor beyond which its windows are dealt by digest.
BUFFER, SHARD, HOT = 1 << 18, 1 << 20, 10_000
_POS = (1 << 24) - 1
_TABLE = np.random.default_rng(1).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def anchors(buf: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first start, last start) of each run of windows of the texts that end at ``ends`` in buf.

    A window's anchor is the rightmost of its least gram hashes; it depends on the window's
    bytes alone. buf has less than 2**24 bytes, gram is a power of two.
    """
    none = np.empty(0, np.int64)
    if len(buf) < length:
        return none.astype(np.uint64), none, none
    h, b, step = _TABLE[buf], 0x9E3779B97F4A7C15, 1
    while step < gram:
        h = h[: len(h) - step] * np.uint64(b) + h[step:]
        b, step = b * b % (1 << 64), step * 2
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    least = (h & np.uint64(~_POS & (1 << 64) - 1)) | (np.uint64(_POS) - np.arange(len(h), dtype=np.uint64))
    width, step = length - gram + 1, 1
    while step * 2 <= width:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    least = np.minimum(least[: len(least) - (width - step)], least[width - step :])
    inside = np.zeros(len(least), bool)
    begin = 0
    for e in ends.tolist():
        if e - begin >= length:
            inside[begin : e - length + 1] = True
        begin = e
    start = np.flatnonzero(inside)
    if not len(start):
        return none.astype(np.uint64), none, none
    at = (np.uint64(_POS) - (least[start] & np.uint64(_POS))).astype(np.int64)
    cut = np.flatnonzero((np.diff(at) != 0) | (np.diff(start) != 1)) + 1
    lo = np.concatenate([[0], cut])
    return h[at[lo]], start[lo], start[np.concatenate([cut - 1, [len(start) - 1]])]


def _buffers(texts: list[bytes], length: int) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, ends, row, place of each part in its text); long texts come in parts that overlap by length - 1."""
    held, rows, places, size = [], [], [], 0
    part = 8 * BUFFER
    for i, t in enumerate(texts):
        if len(t) < length:
            continue
        for at in range(0, len(t) - length + 1, part):
            held.append(t[at : at + part + length - 1])
            rows.append(i)
            places.append(at)
            size += len(held[-1])
            if size >= BUFFER:
                yield b"".join(held), np.cumsum([len(x) for x in held]), np.array(rows), np.array(places)
                held, rows, places, size = [], [], [], 0
    if held:
        yield b"".join(held), np.cumsum([len(x) for x in held]), np.array(rows), np.array(places)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64(text_of()).alias("th"), text_of().alias("text"))


def pieces(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, th (text hash), h (anchor), d (digest), lo, hi (first and last start) of every piece."""
    schema = "doc_id long, th long, h long, d long, lo long, hi long"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t.as_py().encode() for t in b.column(2)]
            for data, ends, row, place in _buffers(texts, length):
                h, lo, hi = anchors(np.frombuffer(data, np.uint8), ends, length)
                d = np.array([xxhash.xxh64_intdigest(data[x : y + length]) for x, y in zip(lo.tolist(), hi.tolist(), strict=True)], np.uint64)
                own = np.searchsorted(ends, lo, "right")
                shift = place[own] - np.concatenate([[0], ends[:-1]])[own]
                take = pa.array(row[own])
                yield pa.record_batch([b.column(0).take(take), b.column(1).take(take), pa.array(h.view(np.int64)), pa.array(d.view(np.int64)), pa.array(lo + shift), pa.array(hi + shift)], names=["doc_id", "th", "h", "d", "lo", "hi"])

    return _keyed(docs).mapInArrow(work, schema)


def refine(rank: np.ndarray, depth: int, at: np.ndarray | None = None) -> np.ndarray:
    """Ranks to twice the depth (or, with ``at``, by the ranks at those places): only suffixes that share a rank are sorted.

    A rank is the first place of its block in the interleave.
    """
    n = len(rank)
    alone = np.bincount(rank, minlength=n)[rank] == 1
    todo = np.flatnonzero(~alone)
    if not len(todo):
        return rank
    then = rank[np.minimum(todo + depth, n - 1)] if at is None else at[todo]
    key = (rank[todo].astype(np.uint64) << np.uint64(32)) | then.astype(np.uint64)
    order = np.argsort(key)
    todo, key = todo[order], key[order]
    old = (key >> np.uint64(32)).astype(np.int64)
    i = np.arange(len(todo))
    new_old = np.concatenate([[True], old[1:] != old[:-1]])
    new = np.concatenate([[True], key[1:] != key[:-1]])
    first_old = np.maximum.accumulate(np.where(new_old, i, 0))
    first_new = np.maximum.accumulate(np.where(new, i, 0))
    out = rank.copy()
    out[todo] = old + first_new - first_old
    return out


def repeated_starts(texts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each text, which of its windows (by start) also begin at another place of any of the texts."""
    data = b"".join(texts)
    buf = np.frombuffer(data + b"\0" * 8, np.uint8)
    n = len(data)
    if not n:
        return [np.empty(0, bool) for _ in texts]
    word = np.zeros(n, np.uint64)
    for k in range(8):
        word = (word << np.uint64(8)) | buf[k : n + k].astype(np.uint64)
    order = np.argsort(word)
    new = np.concatenate([[True], word[order][1:] != word[order][:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    depth = 8
    while depth * 2 <= length:
        rank, depth = refine(rank, depth), depth * 2
    size = np.array([max(0, len(t) - length + 1) for t in texts])
    begin = np.concatenate([[0], np.cumsum([len(t) for t in texts])[:-1]])
    start = np.repeat(begin - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
    pair = (rank[start].astype(np.uint64) << np.uint64(32)) | rank[start + (length - depth)].astype(np.uint64)
    _, inverse, count = np.unique(pair, return_inverse=True, return_counts=True)
    return np.split(count[inverse] > 1, np.cumsum(size)[:-1])


def _runs(flags: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Byte ranges that the flagged starts cover, relative to the piece."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [(int(a), int(b) - 1 + length) for a, b in zip(edge[::2], edge[1::2], strict=True)]


def _shard(length: int):
    run = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))

    def work(table: pa.Table) -> pa.Table:
        need = table.column("need").to_pylist()
        flags = repeated_starts(table.column("bytes").to_pylist(), length)
        rows = [(h, d, _runs(f, length)) for h, d, f, k in zip(table.column("h").to_pylist(), table.column("d").to_pylist(), flags, need, strict=True) if k and f.any()]
        return pa.table({"h": pa.array([r[0] for r in rows], pa.int64()), "d": pa.array([r[1] for r in rows], pa.int64()), "runs": pa.array([[{"a": a, "b": b} for a, b in r[2]] for r in rows], run)})

    return work


def _hot(rows: DataFrame, length: int) -> DataFrame:
    """The same for anchors with very many pieces: windows are dealt by a 128-bit digest of their bytes."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for h, d, need, data in zip(*[c.to_pylist() for c in b.columns], strict=True):
                w = [xxhash.xxh128_intdigest(data[i : i + length]) for i in range(len(data) - length + 1)]
                x, y = (np.array([v >> s & (1 << 64) - 1 for v in w], np.uint64).view(np.int64) for s in (0, 64))
                k = len(w)
                yield pa.record_batch([pa.array([h] * k, pa.int64()), pa.array([d] * k, pa.int64()), pa.array([need] * k, pa.bool_()), pa.array(range(k), pa.int64()), pa.array(x), pa.array(y)], names=["h", "d", "need", "at", "x", "y"])

    each = rows.select("h", "d", "need", "bytes").mapInArrow(windows, "h long, d long, need boolean, at long, x long, y long")
    many = each.groupBy("x", "y").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    found = each.where("need").join(many, ["x", "y"]).groupBy("h", "d").agg(F.collect_set("at").alias("s"))
    return found.select("h", "d", F.transform("s", lambda a: F.struct(a.alias("a"), (a + length).alias("b"))).alias("runs"))


def repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, th, runs array<struct<a, b>>: byte ranges to remove from each document that has any (they may overlap)."""
    all_ = materialise(pieces(docs, length), "pieces")
    kinds = all_.groupBy("h", "d").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("doc_id", "th", "lo", "hi")).alias("one"))
    kinds = materialise(kinds, "kinds")
    several = materialise(kinds.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "several")
    asked = kinds.join(several, "h").select("h", "d", "n", (F.col("c") == 1).alias("need"), "one.*")
    asked = materialise(asked, "asked")
    some = kinds.where("c > 1").select("h", "d", F.lit(True).alias("full")).unionByName(asked.where("need").select("h", "d", F.lit(False).alias("full")))
    found = materialise(all_.join(some, ["h", "d"]), "found")
    for t in (all_, kinds, several):
        forget(t)

    # One text of each piece that must be compared.
    schema = "h long, d long, n long, need boolean, bytes binary"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, want in zip(b.column(0), b.column(1), strict=True):
                data = text.as_py().encode()
                out += [(w["h"], w["d"], w["n"], w["need"], data[w["lo"] : w["hi"] + length]) for w in want.as_py()]
            kinds_ = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
            yield pa.record_batch([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds_)], names=["h", "d", "n", "need", "bytes"])

    wanted = asked.groupBy("doc_id", "th").agg(F.collect_list(F.struct("h", "d", "n", "need", "lo", "hi")).alias("want"))
    keyed = _keyed(docs).alias("t")
    same = F.col("t.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("t.th") == F.col("w.th"))
    texts = materialise(keyed.join(wanted.alias("w"), same).select("t.text", "w.want").mapInArrow(cut, schema), "texts")
    total = texts.agg(F.coalesce(F.sum(F.length("bytes")), F.lit(0))).head()[0]
    shards = max(1, -(-total // SHARD))
    usual, hot = texts.where(F.col("n") <= HOT), texts.where(F.col("n") > HOT)
    runs = usual.groupBy(F.pmod("h", F.lit(shards)).alias("shard")).applyInArrow(_shard(length), "h long, d long, runs array<struct<a:long,b:long>>")
    if hot.head(1):
        runs = runs.unionByName(_hot(hot, length))
    runs = materialise(runs, "runs")
    forget(texts)

    whole = found.where("full").select("doc_id", "th", F.array(F.struct(F.col("lo").alias("a"), (F.col("hi") + length).alias("b"))).alias("runs"))
    part = found.where("not full").join(runs, ["h", "d"]).select("doc_id", "th", F.transform("runs", lambda r: F.struct((r["a"] + F.col("lo")).alias("a"), (r["b"] + F.col("lo")).alias("b"))).alias("runs"))
    out = materialise(whole.unionByName(part).groupBy("doc_id", "th").agg(F.array_sort(F.flatten(F.collect_set("runs"))).alias("runs")), "ranges")
    forget(found)
    forget(asked)
    return out


def merged(runs: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal ranges, from ranges sorted by their first byte."""
    out: list[list[int]] = []
    for r in runs or ():
        if out and r["a"] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], r["b"])
        else:
            out.append([r["a"], r["b"]])
    return [tuple(x) for x in out]


def _with_runs(docs: DataFrame, length: int) -> DataFrame:
    found = repeats(docs.select("doc_id", "text"), length).alias("r")
    same = F.col("t.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("t.th") == F.col("r.th"))
    return _keyed(docs).alias("t").join(found, same, "left").select("t.doc_id", "t.text", "r.runs")


def report(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document.

    A null or short text loses nothing; a repeated row of a long enough text loses all.
    """
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, text, runs in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                data, cuts = text.as_py().encode(), merged(runs.as_py())
                edges = [0, *[x for c in cuts for x in c], len(data)]
                kept = b"".join([data[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True)])
                out.append((doc, len(data), len(data) - len(kept), len(cuts), hashlib.sha256(kept).hexdigest()))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.record_batch([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return _with_runs(docs, length).mapInArrow(work, schema)


def kept_bytes(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, kept binary: what is left of each text; a cut may fall inside a character, so it stays bytes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, runs in zip(b.column(1), b.column(2), strict=True):
                data = text.as_py().encode()
                edges = [0, *[x for c in merged(runs.as_py()) for x in c], len(data)]
                out.append(b"".join([data[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True)]))
            yield pa.record_batch([b.column(0), pa.array(out, pa.binary())], names=["doc_id", "kept"])

    return _with_runs(docs, length).mapInArrow(work, "doc_id long, kept binary")
