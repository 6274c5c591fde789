"""SimHash near-duplicates, exact within a Hamming radius, by vantage-point trees.

Fingerprints (distinct ones; copies are one) are dealt to the leaves of a vantage-point tree
by their Hamming distances to vantage points. A fingerprint near a boundary is also sent, as
a guest, down the far side, and there wherever the triangle bounds allow a partner; so any
pair within the radius meets in exactly one leaf. A leaf compares its own with its own and
its guests in blocks and returns a spanning forest of what it links, never all pairs. The
forests' components are found by distributed min-label rounds with pointer jumping.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import text_of
from corpusmill.session import forget, materialise

SEED, RADIUS, SHINGLE = 42, 3, 3
#: Distinct fingerprints a leaf, about; fingerprints that the tree is built from at most.
LEAF, SAMPLE = 8_000, 16_000
BLOCK = 1 << 22  # distances at a time
EDGES = 1 << 20  # links that a task contracts at a time


def shingle_hashes(text: str, size: int) -> np.ndarray:
    """XXH64 of each run of so many words (of all, if there are fewer), in order; none without words."""
    words = text.encode().lower().split()
    if not words:
        return np.empty(0, "<u8")
    hash_ = xxhash.xxh64_intdigest
    if len(words) < size:
        h = [hash_(b" ".join(words), SEED)]
    else:
        line = b" ".join(words)
        ends = (np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1).tolist()
        starts = [0, *[e + 1 for e in ends[: len(ends) - size]]]
        h = [hash_(line[a:b], SEED) for a, b in zip(starts, ends[size - 1 :], strict=True)]
    return np.array(h, "<u8")


def fingerprint(text: str, size: int = SHINGLE) -> int:
    """64 bits, each 1 if over half the shingles' XXH64 have it; 0 without words."""
    return bits(shingle_hashes(text, size))


def bits(a: np.ndarray) -> int:
    """Of 64 bits those that over half the hashes have."""
    total = np.zeros(64, np.int64)
    for i in range(0, len(a), 1 << 16):
        total += np.unpackbits(a[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(a), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, fp (a signed 64-bit number) of every row; a null text is empty."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), size) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.record_batch([b.column(0), pa.array(fp)], names=["doc_id", "fp"])

    return docs.select("doc_id", text_of()).mapInArrow(work, "doc_id long, fp long")


def build_tree(sample: np.ndarray, depth: int, seed: int = 3):
    """(vantage, median, left, right), or None for a leaf: of a few candidates the one that halves the sample best."""
    if depth <= 0 or len(sample) < 4:
        return None
    rng = np.random.default_rng(seed)
    best = None
    for v in rng.choice(sample, min(8, len(sample)), replace=False):
        d = np.bitwise_count(sample ^ v)
        mu = int(np.median(d))
        inside = int((d <= mu).sum())
        # Few fingerprints close to the boundary mean few guests.
        cost = abs(2 * inside - len(d)) + int((np.abs(d.astype(int) - mu) <= RADIUS).sum())
        if 0 < inside < len(d) and (best is None or cost < best[0]):
            best = (cost, v, mu, d <= mu)
    if best is None:
        return None
    _, v, mu, inside = best
    return (v, mu, build_tree(sample[inside], depth - 1, seed + 1), build_tree(sample[~inside], depth - 1, seed + 2))


def deal(tree, fps: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[int, np.ndarray, bool]]:
    """(leaf, fingerprints, guests?): every fingerprint once at home, and as a guest wherever a partner may be."""
    work = [(tree, 1, fps, False)]
    while work:
        node, leaf, own, guest = work.pop()
        if not len(own):
            continue
        if node is None:
            yield leaf, own, guest
            continue
        v, mu, left, right = node
        d = np.bitwise_count(own ^ v).astype(np.int16)
        if guest:
            work.append((left, 2 * leaf, own[d - radius <= mu], True))
            work.append((right, 2 * leaf + 1, own[d + radius > mu], True))
        else:
            inside = d <= mu
            work.append((left, 2 * leaf, own[inside], False))
            work.append((right, 2 * leaf + 1, own[~inside], False))
            work.append((right, 2 * leaf + 1, own[inside & (d + radius > mu)], True))


def forest(own: np.ndarray, guests: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) for every fingerprint that the pairs own-own and guest-own link to another."""
    both = np.concatenate([own, guests])
    label = np.arange(len(both))
    step = max(1, BLOCK // max(1, len(own)))

    for i in range(0, len(both), step):
        near = np.bitwise_count(both[i : i + step, None] ^ own[None, :]) <= radius
        r, c = np.nonzero(near)
        r += i
        off = label[r] != label[c]
        if not off.any():
            continue
        pairs = np.unique(np.stack([label[r[off]], label[c[off]]]), axis=1).T.tolist()
        parent: dict[int, int] = {}

        def find(x: int, parent=parent) -> int:
            while x in parent:
                if parent[x] in parent:
                    parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for a, b in pairs:
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        to = np.arange(len(both))
        for x in parent:
            to[x] = find(x)
        label = to[label]
    moved = label != np.arange(len(both))
    return both[moved], both[label[moved]]


def links(distinct: DataFrame, radius: int = RADIUS, leaf: int = LEAF) -> DataFrame:
    """a, b: forest edges among the distinct fingerprints of column fp; every component of links is kept."""
    n = distinct.count()
    depth = max(0, int(np.ceil(np.log2(max(1, n / leaf)))))
    drawn = distinct.orderBy(F.xxhash64("fp")).limit(SAMPLE).toPandas().fp.to_numpy(np.int64).view(np.uint64) if depth else np.empty(0, np.uint64)
    tree = build_tree(drawn, depth)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, fps, guest in deal(tree, b.column(0).to_numpy().view(np.uint64), radius):
                yield pa.record_batch([pa.array(np.full(len(fps), at)), pa.array(fps.view(np.int64)), pa.array(np.full(len(fps), guest))], names=["leaf", "fp", "guest"])

    def join(table: pa.Table) -> pa.Table:
        fp, guest = table.column("fp").to_numpy().view(np.uint64), table.column("guest").to_numpy()
        a, b = forest(np.sort(fp[~guest]), fp[guest], radius)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    sent = distinct.select("fp").mapInArrow(send, "leaf long, fp long, guest boolean")
    return sent.groupBy("leaf").applyInArrow(join, "a long, b long")


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root): the links of the same components in which each node has the least one as its root."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        off = low < high
        if not off.any():
            break
        x, y = x[off], y[off]
        np.minimum.at(root, high[off], low[off])
        while (root[root] != root).any():
            root = root[root]
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def contracted(edges: DataFrame) -> DataFrame:
    """a, b: links of the same components, each partition's own (EDGES at a time) as stars; no shuffle, and fewer rounds after it."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> pa.RecordBatch:
            a, b = stars(*(np.concatenate([h.column(c).to_numpy() for h in held]) for c in (0, 1)))
            held.clear()
            return pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            held.append(batch)
            if sum(h.num_rows for h in held) >= EDGES:
                yield flush()
        if held:
            yield flush()

    return edges.where("a <> b").select("a", "b").mapInArrow(work, "a long, b long")


def label_components(edges: DataFrame) -> DataFrame:
    """node, label: one label a component: links become stars in each partition, then min-label rounds with pointer jumping until nothing changes."""
    few = materialise(contracted(edges), "stars")
    both = materialise(few.unionByName(few.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    forget(few)
    now = materialise(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).select(F.col("a").alias("node"), "label"), "labels")
    while True:
        near = both.join(now.select(F.col("node").alias("b"), F.col("label").alias("l")), "b").groupBy("a").agg(F.min("l").alias("m"))
        low = now.join(near, now["node"] == near["a"]).select("node", "label", F.least("label", "m").alias("new"))
        up = now.select(F.col("node").alias("new"), F.col("label").alias("up"))
        after = materialise(low.join(up, "new", "left").select("node", F.coalesce("up", "new").alias("label"), (F.coalesce("up", "new") != F.col("label")).alias("changed")), "labels")
        forget(now)
        now = after
        if not after.where("changed").head(1):
            forget(both)
            return now.select("node", "label")


def components(docs: DataFrame, radius: int = RADIUS, size: int = SHINGLE, leaf: int = LEAF) -> DataFrame:
    """doc_id, fingerprint, component_id (the smallest doc_id reachable) of every row of docs.

    Rows without words link like any other; repeated rows have a row each; null ids never are
    a component's id unless it has no other.
    """
    own = materialise(fingerprints(docs, size), "fingerprints")
    distinct = materialise(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    label = label_components(links(distinct, radius, leaf))
    named = distinct.join(label, distinct["fp"] == label["node"], "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    grouped = named.groupBy("label").agg(F.min("least").alias("component_id"))
    by_fp = named.join(grouped, "label").select("fp", "component_id")
    return own.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
