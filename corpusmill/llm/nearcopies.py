"""Operator 6 on similarity: texts whose sets of five-word shingles are 0.8 alike or more, exact.

Fingerprints of the same shingles go through the vantage-point tree of ``simhash``; what it
links at its radius is checked by the whole sets and joined first, so that large groups of
copies are one component before anything else meets. At 0.8 alike two fingerprints differ in
10 of 64 bits on average and in up to 18 or so, a radius at which the tree's bounds prune
nothing; so the links beyond the tree's radius are found by shingles: similar sets share one
among the first fifth of each in any common order (prefix filter), and the order takes
common shingles last, so that a line which many texts have brings few of them together. Star
rounds, each text of a bucket against one of it, come first; then all pairs that are still
in different components are compared. No pair is compared twice, and whole sets decide every
link. Components are contracted after each round, so what is labelled is a pair of
components, not of texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import text_hash, text_of
from corpusmill.llm.simhash import bits, label_components, links, shingle_hashes
from corpusmill.session import forget, materialise

#: Words a shingle; the least similarity is NUM / DEN.
SHINGLE, NUM, DEN = 5, 4, 5
#: Star rounds at most (one that links nothing is the last); shingles that the order takes last at most, and the count in a table that makes one such. These bound the work, not the links.
STARS, HOT, OFTEN = 2, 200_000, 20
#: Texts of a bucket from which its pairs are compared in blocks and not as rows; texts and shingles a block, about.
LARGE, BLOCK, BLOCK_SHINGLES = 48, 400, 500_000
#: Rows with texts or sets that a Python worker gets at once; shingles that it counts at once, about.
ROWS, HELD = 500, 2_000_000
#: Texts to compare, up to which their names are broadcast.
BROADCAST_ROWS = 500_000


def shingle_set(text: str) -> np.ndarray:
    """Distinct hashes, ascending; texts without words share one."""
    h = shingle_hashes(text, SHINGLE)
    return np.unique(h) if len(h) else np.zeros(1, "<u8")


def common(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Common shingles, ascending, and their counts: those that rows with about HELD shingles have twice are counted."""

    def twice(sets: list[np.ndarray]) -> pa.RecordBatch:
        h, n = np.unique(np.concatenate(sets), return_counts=True)
        return pa.record_batch([pa.array(h[n > 1].view(np.int64)), pa.array(n[n > 1])], names=["h", "n"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, size = [], 0
        for b in batches:
            for t in b.column(0):
                sets.append(shingle_set(t.as_py()))
                size += len(sets[-1])
                if size >= HELD:
                    yield twice(sets)
                    sets, size = [], 0
        if sets:
            yield twice(sets)

    counted = docs.select(text_of()).mapInArrow(work, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= OFTEN)
    kept = materialise(counted, "common", ROWS)
    got = kept.orderBy(F.desc("n"), "h").limit(HOT).toPandas()
    forget(kept)
    h, n = got.h.to_numpy(np.int64).view(np.uint64), got.n.to_numpy(np.int64)
    at = np.argsort(h)
    return h[at], n[at]


def signatures(docs: DataFrame) -> DataFrame:
    """node, n (size of the set), fp, tokens (the shingles by which a text meets others, in order) of each different text."""
    hot, often = common(docs)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, fps, tokens = [], [], []
            for t in b.column(1):
                all_ = shingle_hashes(t.as_py(), SHINGLE)
                h = np.unique(all_) if len(all_) else np.zeros(1, "<u8")
                rank = np.zeros(len(h), np.int64)
                if len(hot):
                    at = np.minimum(np.searchsorted(hot, h), len(hot) - 1)
                    rank = np.where(hot[at] == h, often[at], 0)
                sizes.append(len(h))
                fps.append(bits(all_))
                tokens.append(h[np.lexsort((h, rank))][: len(h) - -(-NUM * len(h) // DEN) + 1].view(np.int64))
            fp = pa.array(np.array(fps, np.uint64).view(np.int64))
            yield pa.record_batch([b.column(0), pa.array(sizes, pa.int32()), fp, pa.array(tokens, pa.list_(pa.int64()))], names=["node", "n", "fp", "tokens"])

    return docs.select(text_hash().alias("node"), text_of()).mapInArrow(work, "node long, n int, fp long, tokens array<long>").dropDuplicates(["node"])


def sets_of(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """node, hashes (the set, as bytes) of the nodes given, as a table."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([shingle_set(t.as_py()).tobytes() for t in b.column(1)], pa.binary())], names=["node", "hashes"])

    met = materialise(nodes.distinct(), "met")
    few = F.broadcast(met) if met.count() <= BROADCAST_ROWS else met
    texts = docs.select(text_hash().alias("node"), text_of().alias("text")).join(few, "node", "left_semi").dropDuplicates(["node"])
    own = materialise(texts.mapInArrow(sets, "node long, hashes binary"), "sets", ROWS)
    forget(met)
    return own


def _overlaps(sets: list[np.ndarray]) -> Callable[[int], np.ndarray]:
    """A function that counts, for the set at a place, what each of the sets shares with it; an element is a number and not an object."""
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    owner = np.repeat(np.arange(len(sets), dtype=np.int32), np.diff(at))
    different, ids = np.unique(np.concatenate(sets), return_inverse=True)
    ids, mark = ids.astype(np.int32), np.zeros(len(different), bool)

    def shared(x: int) -> np.ndarray:
        own = ids[at[x] : at[x + 1]]
        mark[own] = True
        n = np.bincount(owner[mark[ids]], minlength=len(sets))
        mark[own] = False
        return n

    return shared


def _compare(key: tuple, rows: pa.Table) -> pa.Table:
    """Links between the texts of two blocks of a bucket (or within one), as a spanning forest over their components."""
    token, i, j = (k.as_py() for k in key)
    nodes, comp, block = (rows.column(c).to_numpy() for c in ("node", "comp", "block"))
    whole = [np.frombuffer(x.as_buffer(), "<u8") for x in rows.column("hashes")]
    n, both = np.array([len(x) for x in whole]), _overlaps(whole)
    # A pair is compared in the bucket of the least token that both have.
    tokens = [x.values.to_numpy() for x in rows.column("tokens")]
    lower = _overlaps([x[x < token] for x in tokens])
    root = np.unique(comp, return_inverse=True)[1]
    left, right = block == i, block == j
    a, b = [], []
    for x in np.flatnonzero(left):
        to = right & (root != root[x]) & (DEN * np.minimum(n, n[x]) >= NUM * np.maximum(n, n[x]))
        if i == j:
            to[: x + 1] = False
        if not to.any():
            continue
        to &= lower(x) == 0
        if not to.any():
            continue
        m = both(x)
        for y in np.flatnonzero(to & (DEN * m >= NUM * (n + n[x] - m))):
            if root[x] != root[y]:
                a.append(nodes[x])
                b.append(nodes[y])
                root[root == root[y]] = root[x]
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def in_blocks(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """a, b: links among the texts of large buckets (token, node, comp; k texts of so many shingles). Two blocks of a bucket meet in one task; only links are rows.

    What decides where a pair is compared are the large buckets alone: the others ask more of it.
    """
    own = sets_of(rows.select("node"), docs).join(rows.groupBy("node").agg(F.collect_list("token").alias("tokens")), "node")
    blocks = F.greatest(F.ceil(F.col("k") / BLOCK), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    dealt = rows.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    cells = dealt.select("token", "node", "comp", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    cells = cells.select("token", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "comp", "block")
    return materialise(cells.join(own, "node").groupBy("token", "i", "j").applyInArrow(_compare, "a long, b long"), "links", ROWS)


def verified(pairs: DataFrame, docs: DataFrame, tested: list[DataFrame]) -> DataFrame:
    """The pairs a, b (hashes of texts) whose whole sets are similar, as a table; pairs tested before go, and these join them."""
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    for t in tested:
        pairs = pairs.join(t, ["a", "b"], "left_anti")
    pairs = materialise(pairs, "pairs")
    tested.append(pairs)
    own = sets_of(pairs.select(F.explode(F.array("a", "b")).alias("node")), docs)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                p, q = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(DEN * both >= NUM * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left, right = (own.select(F.col("node").alias(c), F.col("hashes").alias(f"h{c}")) for c in ("a", "b"))
    found = materialise(pairs.join(left, "a").join(right, "b").select("a", "b", "ha", "hb").mapInArrow(work, "a long, b long"), "links", ROWS)
    forget(own)
    return found


def tree_pairs(every: DataFrame) -> DataFrame:
    """Pairs of texts that the tree links: those of one fingerprint with its least text, and the least texts of near fingerprints."""
    least = materialise(every.groupBy("fp").agg(F.min("node").alias("least")), "least")
    near = links(least)
    a, b = (least.select(F.col("fp").alias(x), F.col("least").alias(f"l{x}")) for x in ("a", "b"))
    far = near.join(a, "a").join(b, "b").select(F.col("la").alias("a"), F.col("lb").alias("b"))
    return far.unionByName(every.join(least, "fp").where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b")))


def possible(x: str, y: str) -> Column:
    """Sizes and places of a shared shingle leave room for the similarity; the first shared one of a similar pair always does."""
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    rest = F.least(n - F.col(f"{x}.pos"), m - F.col(f"{y}.pos"))
    return (DEN * F.least(n, m) >= NUM * F.greatest(n, m)) & (rest * (NUM + DEN) >= NUM * (n + m)) & (F.col(f"{x}.comp") != F.col(f"{y}.comp"))


def joined(label: DataFrame, links_: DataFrame) -> DataFrame:
    """node, label once the links join components."""
    to = [label.select(F.col("node").alias(c), F.col("label").alias(f"l{c}")) for c in ("a", "b")]
    ends = links_.join(to[0], "a", "left").join(to[1], "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    up = label_components(ends.where("a <> b").distinct())
    moved = label.join(up.select(F.col("node").alias("label"), F.col("label").alias("up")), "label", "left").select("node", F.coalesce("up", "label").alias("label"))
    return materialise(moved.unionByName(up.join(label, "node", "left_anti")), "joined")


def labels(docs: DataFrame) -> DataFrame:
    """node, label of every text that has a near copy (its own component's texts have the same label)."""
    every = materialise(signatures(docs), "signatures", ROWS)
    tested: list[DataFrame] = []
    label = label_components(verified(tree_pairs(every), docs, tested))
    rows = every.select("node", "n", F.posexplode("tokens").alias("pos", "token"))
    shared = materialise(rows.groupBy("token").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("token"), "shared")
    postings = materialise(rows.join(shared, "token"), "postings")
    forget(every)
    forget(shared)
    stars = STARS
    while True:
        now = postings.join(label, "node", "left").withColumn("comp", F.coalesce("label", "node")).drop("label")
        seat = F.struct(F.xxhash64("node", F.lit(stars)), "node", "n", "pos", "comp")
        mixed = now.groupBy("token").agg(F.min(seat).alias("s"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
        if stars:
            other = mixed.select("token", "s.node", "s.n", "s.pos", "s.comp")
            pairs = now.alias("x").join(other.alias("y"), "token").where(possible("x", "y"))
        else:
            some = materialise(now.join(mixed.select("token"), "token", "left_semi"), "mixed")
            large = some.groupBy("token").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("shingles")).where(F.col("k") > LARGE)
            found = in_blocks(some.join(large, "token").select("token", "node", "comp", "k", "shingles"), docs)
            if found.head(1):
                label = joined(label, found)
            some = some.join(large, "token", "left_anti")
            pairs = some.alias("x").join(some.alias("y"), "token").where((F.col("x.node") < F.col("y.node")) & possible("x", "y"))
        found = verified(pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")), docs, tested)
        any_ = bool(found.head(1))
        if any_:
            before, label = label, joined(label, found)
            forget(before)
        forget(found)
        if not stars:
            break
        stars = stars - 1 if any_ else 0
    for t in (postings, *tested):
        forget(t)
    return label


def keep_representatives(docs: DataFrame) -> DataFrame:
    """One row of each component, with its columns: the smallest doc_id (nulls last), then the smallest hash of the text and of the row."""
    row = docs.select(F.struct("*").alias("row"), "doc_id", text_hash().alias("node"), F.xxhash64(*[docs[c] for c in docs.columns]).alias("hash"))
    own = row.drop("row").join(labels(docs), "node", "left")
    first = own.groupBy(F.coalesce("label", "node").alias("label")).agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "node", "hash")).alias("k"))
    k = first.select("k.doc_id", "k.node", "k.hash").alias("k")
    same = (F.col("r.node") == F.col("k.node")) & (F.col("r.hash") == F.col("k.hash")) & F.col("r.doc_id").eqNullSafe(F.col("k.doc_id"))
    return row.alias("r").join(k, same, "left_semi").dropDuplicates(["node", "hash", "doc_id"]).select("row.*")
