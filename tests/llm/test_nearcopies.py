"""The near-copy stage against a brute-force join."""

import collections
import itertools
import random
import tracemalloc

import duckdb
import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from corpusmill.llm import nearcopies, quality
from corpusmill.session import materialise

DIR = "/root/testdata/sf0.01"


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def plain_groups(texts):
    """Label by place: the first place that similar pairs lead to."""
    sets, root, holds = [shingles(t) for t in texts], list(range(len(texts))), collections.defaultdict(list)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in enumerate(sets):
        for x in s:
            holds[x].append(i)
    both = collections.Counter(p for at in holds.values() for p in itertools.combinations(at, 2))
    for (i, j), n in both.items():
        if 5 * n >= 4 * (len(sets[i]) + len(sets[j]) - n):
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def edited(rng, words, n):
    w = list(words)
    for _ in range(n):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**9)}"
    return " ".join(w)


def made():
    """Copies at and about the limit, a line and a passage that many have, a chain, blank and short texts."""
    rng = random.Random(7)
    word = lambda: f"w{rng.randrange(3000)}"
    line, out = " ".join(f"l{i}" for i in range(14)), ["", " \n", None, "one", "One", "one two", "a b c d e"]
    for _ in range(60):
        base = [word() for _ in range(rng.randrange(12, 140))]
        out += [" ".join(base), *(edited(rng, base, rng.randrange(4)) for _ in range(rng.randrange(4)))]
        out += [f"{line} {' '.join(word() for _ in range(rng.randrange(1, 30)))}"]
    base = [word() for _ in range(100)]
    out += [edited(rng, base, rng.randrange(6)) for _ in range(60)]
    for k in range(0, 40, 2):
        out.append(" ".join([*(f"c{i}" for i in range(k, k + 60))]))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize(("often", "stars", "large", "block"), [(20, 2, 48, 400), (2, 0, 3, 7)])
def test_components_equal_brute_force(spark, monkeypatch, often, stars, large, block):
    """Also without star rounds and with buckets of over three texts compared in blocks."""
    monkeypatch.setattr(nearcopies, "LARGE", large)
    monkeypatch.setattr(nearcopies, "BLOCK", block)
    monkeypatch.setattr(nearcopies, "OFTEN", often)
    monkeypatch.setattr(nearcopies, "STARS", stars)
    texts = made()
    want = {i for i, r in enumerate(plain_groups(texts)) if i == r}
    got = [r.doc_id for r in nearcopies.keep_representatives(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()]
    assert sorted(got) == sorted(want)


def test_stage_equals_brute_force(spark):
    """The reviewer's 12 pairs of 0.8 or more whose fingerprints differ in over 3 bits are among these."""
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{DIR}/documents.parquet' ORDER BY 1").fetchall()
    want = [docs[i][0] for i, r in enumerate(plain_groups([t for _, t in docs])) if i == r]
    got = corpus_pipeline.near_dedup(spark, spark.read.parquet(f"{DIR}/documents.parquet"), DIR).collect()
    assert sorted(r.doc_id for r in got) == want


def sentence(k):
    return " ".join(f"w{k}x{i}" for i in range(30))


def test_rows_with_null_or_shared_ids(spark):
    """Null ids and ids on two texts lose no group; of a group the smallest id stays, a null only alone."""
    a, b, c, d, e, f = map(sentence, range(6))
    rows = [(None, a), (None, b), (None, c), (5, d), (5, e), (7, c), (3, d), (8, f), (8, f), (None, f)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = collections.Counter(tuple(r) for r in nearcopies.keep_representatives(docs).collect())
    assert got == collections.Counter([(None, a), (None, b), (7, c), (3, d), (5, e), (8, f)])


def test_good_rows_do_not_keep_bad_ones(spark):
    """A row stays by its own text, whatever other rows have its id."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    ids = {r.doc_id: r.predicted for r in quality.score_documents(docs, labels).collect()}
    good, bad = min(i for i in ids if ids[i]), min(i for i in ids if not ids[i])
    text = {r.doc_id: r.text for r in docs.where(docs.doc_id.isin(good, bad)).collect()}
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(10**6, text[good]), (10**6, text[bad]), (None, text[good]), (None, text[bad])], "doc_id long, text string"))
    got = quality.keep_good(more, labels).where("doc_id = 1000000 OR doc_id IS NULL").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(10**6, text[good]), (None, text[good])], key=str)


def test_long_texts_of_a_bucket_are_held_as_numbers():
    """Sets of a block are arrays; as objects they took over ten times their bytes. The links are those of plain sets."""
    rng = np.random.default_rng(1)
    base = [np.unique(rng.integers(0, 1 << 63, 10_000, np.uint64)) for _ in range(20)]
    sets = [np.unique(np.concatenate([b[k:], rng.integers(0, 1 << 63, k, np.uint64)])) for b in base for k in (0, 900, 2_000)]
    n = len(sets)
    rows = pa.table(
        {"token": [5] * n, "i": [0] * n, "j": [0] * n, "node": list(range(n)), "comp": list(range(n)), "block": [0] * n, "hashes": [s.tobytes() for s in sets], "tokens": pa.array([[5, 7]] * n, pa.list_(pa.int64()))},
    )
    tracemalloc.start()
    got = nearcopies._compare((pa.scalar(5), pa.scalar(0), pa.scalar(0)), rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 * sum(s.nbytes for s in sets)
    plain = [set(s.tolist()) for s in sets]
    want = {(i, j) for i, j in itertools.combinations(range(n), 2) if 5 * len(plain[i] & plain[j]) >= 4 * len(plain[i] | plain[j])}
    joined = collections.defaultdict(set)
    for a, b in zip(got.column("a").to_pylist(), got.column("b").to_pylist(), strict=True):
        assert (min(a, b), max(a, b)) in want
        joined[a // 3] |= {a, b}
    assert all(any(i in s and j in s for s in joined.values()) for i, j in want)


def test_python_gets_few_long_rows_at_once(spark):
    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")

    def sizes(batches):
        for b in batches:
            yield pa.record_batch([pa.array([b.num_rows])], names=["n"])

    got = materialise(spark.range(0, 100, 1, 1).mapInArrow(sizes, "n long"), "sizes", 30).collect()
    assert sorted(r.n for r in got) == [10, 30, 30, 30]
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == held
