"""Toxicity scores: averaged subword-bag embeddings under a linear softmax.

A word's vector is the mean of the vectors of its character n-grams and of the word itself,
a text's the mean over its words; misspellings share most n-grams with what they misspell.
Embeddings and softmax are trained together in numpy on a bounded sample of labelled texts.
With two classes the softmax needs the difference of its two rows alone, so gradients pass
through one number an n-gram and scores through one number a word.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import text_of
from corpusmill.llm.quality import key_hash

#: Labelled texts of each class that the fit reads at most (by hash of doc_id), and words of those texts.
SAMPLE, WORDS = 1500, 600_000
#: n-gram lengths, buckets, embedding width, standard errors of a telling n-gram, epochs, step, decay, weight of a text's mean.
NGRAMS, BUCKETS, WIDTH, CUT, EPOCHS, STEP, DECAY, SCALE = (3, 4, 5), 1 << 20, 8, 6.0, 100, 0.05, 1e-6, 200.0
#: Words whose score a worker keeps.
TABLE = 300_000
_EDGE = ".,;:!?*$%&#|\"'()[]{}<>-_"


def words_of(text: str) -> list[str]:
    return text.lower().split()


def grams(word: str, buckets: int = BUCKETS) -> list[int]:
    """Buckets of the word (edge punctuation aside) and of its character n-grams."""
    w = f"<{word.strip(_EDGE)}>"
    out = {zlib.crc32(w.encode()) % buckets}
    for n in NGRAMS:
        out.update(zlib.crc32(w[i : i + n].encode()) % buckets for i in range(len(w) - n + 1))
    return sorted(out)


class Model:
    """Buckets that have a vector, their vectors, softmax rows and biases."""

    def __init__(self, used: np.ndarray, vectors: np.ndarray, softmax: np.ndarray, bias: np.ndarray):
        self.used, self.vectors, self.softmax, self.bias = used, vectors, softmax, bias
        self.u = dict(zip(used.tolist(), (vectors @ (softmax[1] - softmax[0])).tolist(), strict=True))
        self.b = float(bias[1] - bias[0])

    def scorer(self):
        """text -> probability of label 1."""
        u, table = self.u.get, {}

        class Words(dict):
            def __missing__(self, word):
                g = grams(word)
                s = sum([u(i, 0.0) for i in g]) / len(g)
                if len(self) < TABLE:
                    self[word] = s
                return s

        get = Words(table).__getitem__

        def score(text: str) -> float:
            ws = words_of(text)
            z = self.b + (SCALE * sum(map(get, ws)) / len(ws) if ws else 0.0)
            return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

        return score


def telling(docs: list[list[np.ndarray]], y: np.ndarray) -> np.ndarray:
    """Buckets whose share of texts differs between the classes by over CUT standard errors."""
    has = [np.zeros(BUCKETS, np.int32), np.zeros(BUCKETS, np.int32)]
    for bags, k in zip(docs, y, strict=True):
        if bags:
            has[int(k)][np.unique(np.concatenate(bags))] += 1
    n = np.array([(y == 0).sum(), (y == 1).sum()], float)
    share = (has[0] + has[1]) / n.sum()
    error = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n).sum())
    return np.flatnonzero(np.abs(has[1] / n[1] - has[0] / n[0]) > CUT * error)


def train(texts: list[str], y: np.ndarray, seed: int = 5) -> Model:
    """Full-batch Adam on embeddings, softmax and bias together; classes weigh the same.

    Only n-grams that tell the classes apart in the sample keep a vector: the others would
    learn single texts by heart. They still count in a word's mean.
    """
    rng = np.random.default_rng(seed)
    W = rng.normal(0, 0.3, (2, WIDTH))
    bias = np.zeros(2)
    if not len(y) or y.min() == y.max():
        bias[:] = [0, 0 if not len(y) else (3 if y[0] else -3)]
        return Model(np.empty(0, int), np.zeros((0, WIDTH)), W, bias)
    vocab: dict[str, int] = {}
    bags: list[np.ndarray] = []
    doc, word, share = [], [], []
    for i, t in enumerate(texts):
        c = Counter(words_of(t))
        n = max(1, sum(c.values()))
        for w, k in c.items():
            if w not in vocab:
                vocab[w] = len(vocab)
                bags.append(np.array(grams(w), np.int32))
            doc.append(i)
            word.append(vocab[w])
            share.append(k / n)
    doc, word, share = np.array(doc, np.int32), np.array(word, np.int32), np.array(share)
    used = telling([[bags[j] for j in x] for x in np.split(word, np.searchsorted(doc, np.arange(1, len(y))))], y)
    size = np.array([len(g) for g in bags])
    gram, owner = np.concatenate(bags), np.repeat(np.arange(len(bags), dtype=np.int32), size)
    del bags, vocab
    some = np.isin(gram, used)
    gram, owner = np.searchsorted(used, gram[some]), owner[some]
    e = rng.normal(0, 0.01, (len(used), WIDTH))
    cls = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())
    state = [np.zeros_like(x) for x in (e, e, W, W, bias, bias)]
    for t in range(1, EPOCHS + 1):
        diff = W[1] - W[0]
        s = np.bincount(owner, (e @ diff)[gram], len(size)) / size
        z = SCALE * np.bincount(doc, share * s[word], len(y)) + bias[1] - bias[0]
        g = cls * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        back = SCALE * np.bincount(word, share * g[doc], len(size)) / size
        c = np.bincount(gram, back[owner], len(used))
        pull = e.T @ c
        grads = (c[:, None] * diff + DECAY * e, np.stack([-pull, pull]) + DECAY * W, np.array([-g.sum(), g.sum()]))
        for k, (x, d) in enumerate(zip((e, W, bias), grads, strict=True)):
            m, v = state[2 * k], state[2 * k + 1]
            m += 0.1 * (d - m)
            v += 0.001 * (d * d - v)
            x -= STEP * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return Model(used, e, W, bias)


def score_documents(docs: DataFrame, labels: DataFrame, column: str = "toxic", folds: int = 3, fold: int = 1, threshold: float = 0.7, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs.

    held_out is crc32(doc_id as text) mod folds = fold; only other rows are learnt from, at
    most ``sample`` of each class, chosen by a hash of doc_id, up to WORDS words a class.
    Scores depend on the text alone; a null text is empty and scores as one. Without labels
    of both classes every score is the same.
    """
    known = labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull() & (key_hash() % folds != fold))
    known = known.select("doc_id", F.col(column).cast("int").alias("y"), F.xxhash64("doc_id").alias("h"))
    drawn = [known.where(F.col("y") == k).orderBy("h", "doc_id").limit(2 * sample) for k in (0, 1)]
    picked = drawn[0].unionByName(drawn[1])
    rows = docs.join(F.broadcast(picked), "doc_id").select("y", "h", text_of().alias("text"))
    each = [rows.where(F.col("y") == k).orderBy("h").limit(sample) for k in (0, 1)]
    texts, y = [], []
    for r in each:
        left = WORDS
        for x in r.toLocalIterator():
            left -= len(x["text"].split())
            if left < 0:
                break
            texts.append(x["text"])
            y.append(x["y"])
    model = train(texts, np.array(y, float))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for b in batches:
            s = [score(t.as_py()) for t in b.column(2)]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(s, pa.float64())], names=["doc_id", "held_out", "score"])

    scored = docs.select("doc_id", (key_hash() % folds == fold).alias("held_out"), text_of()).mapInArrow(work, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


