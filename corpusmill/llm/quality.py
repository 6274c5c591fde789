"""Quality scores: Gaussian-kernel ridge regression by random Fourier features, calibrated.

Statistics of each whole text are standardised and mapped to random Fourier features. Every
partition sums its share of the normal equations, the sums are added a row of the matrix at
a time, and the driver solves a system whose size is a parameter. Raw scores are calibrated
by isotonic regression on labelled rows that the fit has not seen, from counts by score bin.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import islice
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import text_hash, text_of
from corpusmill.session import materialise

#: Random features, ridge penalty a row, seed, score bins of the calibration.
FEATURES, RIDGE, SEED, BINS = 384, 1e-4, 11, 400
#: Texts that a worker gets at a time.
TEXTS = 500
#: Byte classes whose shares are statistics.
_CLASSES = {
    "upper": bytes(range(65, 91)), "lower": bytes(range(97, 123)), "digit": bytes(range(48, 58)), "space": b" \t\n\v\f\r",
    "stop": b".,;:", "loud": b"!?", "symbol": b"*$%&#@^~=+<>_\\/", "bar": b"|", "quote": b"\"'`()[]{}-", "high": bytes(range(128, 256)),
}
N_STATS = 8 + len(_CLASSES) + 6


def statistics(text: str) -> list[float]:
    """Length, shape and repetition of a whole text; all zero for an empty one."""
    data = text.encode()
    n = len(data)
    if not n:
        return [0.0] * N_STATS
    words = text.split()
    k = max(1, len(words))
    lines = text.split("\n")
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    p = counts[counts > 0] / n
    seen = Counter(words)
    top = seen.most_common(1)[0][1] if seen else 0
    shares = [sum(int(counts[c]) for c in cls) / n for cls in _CLASSES.values()]
    pairs = len(set(zip(words, islice(words, 1, None), strict=False)))
    ends = (text.count(". ") + text.count("! ") + text.count("? ")) / k
    lens = np.fromiter(map(len, words), np.int32, len(words)) if words else np.zeros(1, np.int32)
    return [
        math.log1p(n), math.log1p(len(words)), math.log1p(len(lines)), float(lens.mean()), float(lens.std()), len(seen) / k, pairs / max(1, k - 1), top / k,
        *shares,
        sum(map(eq, words, islice(words, 1, None))) / k, len(set(lines)) / len(lines), float(-(p * np.log2(p)).sum()), ends, float((lens <= 3).mean()), float((lens >= 12).mean()),
    ]


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, hash of the text, stats array<double> of every row; a null text is empty."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            stats = pa.array([statistics(t.as_py()) for t in b.column(1)], pa.list_(pa.float64()))
            yield pa.record_batch([b.column(0), b.column(2), stats], names=["doc_id", "hash", "stats"])

    return docs.select("doc_id", text_of(), text_hash()).mapInArrow(work, "doc_id long, hash long, stats array<double>")


class Model:
    """Standardisation, random features, weights, calibration."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, features: int, seed: int):
        rng = np.random.default_rng(seed)
        d = len(mean)
        self.mean, self.scale = mean, scale
        self.w = rng.normal(0, 1 / math.sqrt(d), (d, features))
        self.b = rng.uniform(0, 2 * math.pi, features)
        self.beta = np.zeros(features + d + 1)
        self.x, self.y = np.array([0.0]), np.array([0.5])

    def map(self, stats: np.ndarray) -> np.ndarray:
        """Fourier features, the statistics themselves and a constant."""
        z = np.clip((stats - self.mean) / self.scale, -6, 6)
        return np.hstack([math.sqrt(2 / self.w.shape[1]) * np.cos(z @ self.w + self.b), 0.1 * z, np.ones((len(z), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.map(stats) @ self.beta

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), self.x, self.y), 0, 1)


def _matrix(col: pd.Series) -> np.ndarray:
    return np.array(col.to_list(), float).reshape(len(col), -1)


def isotonic(y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The non-decreasing fit to means y with weights n (pool adjacent violators)."""
    blocks: list[list[float]] = []
    for v, w in zip(y, n, strict=True):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, c2 = blocks.pop()
            v1, w1, c1 = blocks.pop()
            blocks.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, c1 + c2])
    return np.concatenate([[v] * int(c) for v, _, c in blocks])


def fit(rows: DataFrame, features: int = FEATURES, ridge: float = RIDGE, seed: int = SEED) -> Model:
    """A model of rows (stats, y 0 or 1, calibrate boolean). Without rows every score is 0.5."""
    d = N_STATS
    rows = materialise(rows, "labelled")
    got = rows.agg(F.count(F.lit(1)), *[F.avg(F.get("stats", F.lit(i))) for i in range(d)], *[F.stddev_pop(F.get("stats", F.lit(i))) for i in range(d)]).head()
    n = got[0]
    if not n:
        return Model(np.zeros(d), np.ones(d), features, seed)
    model = Model(np.array(got[1 : d + 1]), np.maximum(np.array(got[d + 1 :]), 1e-3), features, seed)
    size = len(model.beta)

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((size, size + 1))
        for f in frames:
            for i in range(0, len(f), 4096):
                z, y = model.map(_matrix(f.stats[i : i + 4096])), f.y[i : i + 4096].to_numpy(float)
                total[:, :size] += z.T @ z
                total[:, size] += z.T @ y
        yield pd.DataFrame({"i": range(size), "row": [r.tobytes() for r in total]})

    def added(key, f: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": [key[0]], "row": [np.sum([np.frombuffer(r) for r in f.row], axis=0).tobytes()]})

    fitted = rows.where("not calibrate") if rows.where("calibrate").head() and rows.where("not calibrate").head() else rows
    held = rows.where("calibrate") if fitted is not rows else rows
    sums = fitted.select("stats", "y").mapInPandas(partial, "i int, row binary").groupBy("i").applyInPandas(added, "i int, row binary").collect()  # a row a feature
    total = np.zeros((size, size + 1))
    for r in sums:
        total[r["i"]] = np.frombuffer(r["row"])
    penalty = np.full(size, ridge * max(n, 100))
    penalty[-1] = 0
    model.beta = np.linalg.solve(total[:, :size] + np.diag(penalty) + 1e-9 * np.eye(size), total[:, size])

    def bins(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            at = np.round(np.clip(model.raw(_matrix(f.stats)), -1, 2) * (BINS / 3)).astype(int)
            yield pd.DataFrame({"at": at, "y": f.y.astype(float), "n": 1.0}).groupby("at", as_index=False).sum()

    counted = held.select("stats", "y").mapInPandas(bins, "at int, y double, n double").groupBy("at").agg(F.sum("y").alias("y"), F.sum("n").alias("n")).orderBy("at").collect()  # a row a bin
    if counted:
        at, y, w = (np.array(v, float) for v in zip(*counted, strict=True))
        prior = y.sum() / w.sum()
        model.x, model.y = at / (BINS / 3), isotonic((y + 0.2 * prior) / (w + 0.2), w)
    return model


def key_hash() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))


def score_rows(docs: DataFrame, labels: DataFrame, column: str, folds: int, fold: int, threshold: float) -> DataFrame:
    """What score_documents returns and the hash of the text."""
    stats = materialise(document_statistics(docs), "statistics", TEXTS)
    known = labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(column).cast("int").alias("y"))
    rows = stats.where(key_hash() % folds != fold).join(known, "doc_id").select("stats", "y", ((key_hash() / folds).cast("long") % 4 == 0).alias("calibrate"))
    model = fit(rows)

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"doc_id": f.doc_id, "hash": f.hash, "held_out": f.held_out, "score": model.score(_matrix(f.stats)) if len(f) else []})

    scored = stats.select("doc_id", "hash", (key_hash() % folds == fold).alias("held_out"), "stats").mapInPandas(work, "doc_id long, hash long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def score_documents(docs: DataFrame, labels: DataFrame, column: str = "quality", folds: int = 5, fold: int = 0, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs.

    held_out is crc32(doc_id as text) mod folds = fold; only other rows are learnt from, a
    quarter of them for the calibration. Scores depend on the text alone. A label that is
    null, or of a document that isn't there, is not used.
    """
    return score_rows(docs, labels, column, folds, fold, threshold).drop("hash")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows whose own text is predicted good, with their columns."""
    good = score_rows(docs, labels, "quality", 5, 0, threshold).where("predicted = 1").select("doc_id", "hash").distinct()
    same = F.col("d.doc_id").eqNullSafe(F.col("v.doc_id")) & (text_hash("d.text") == F.col("v.hash"))
    return docs.alias("d").join(good.alias("v"), same, "left_semi")


def crc(text: str) -> int:
    """What key_hash computes, for tests."""
    return zlib.crc32(text.encode())
