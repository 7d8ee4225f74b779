"""Quality classifier: ridge regression on random Fourier features, calibrated by isotonic regression.

Each text gives a vector of statistics (shares of character classes, word and line shape,
repetition, length). Random Fourier features approximate a Gaussian kernel on the standardised vector.
Partitions sum their part of the normal equations; the driver solves a system of ``width`` unknowns.
A fourth of the labelled rows is kept apart for the isotonic map from raw scores to probabilities.

At most about ``max_rows`` labelled rows are used (chosen by a hash of doc_id): a documented bound on
fitting only; every document is scored on its whole text.

Defined results: null texts count as empty; null labels are ignored; without two classes of labels every
score is the share of label 1 (0.5 without labels). Extra columns pass through; a clashing ``score`` or
``predicted`` is replaced.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from pulsegrid.llm.common import small, stored

WIDTH, MAX_ROWS, RIDGE, PARTS = 256, 200_000, 1e-3, 16
SYMBOLS = b"#$%&*+=<>@^_{}~|\\/[]"
NAMES = (
    "log_bytes", "upper", "lower", "digit", "space", "newline", "high", "symbol", "bang", "stop", "other",
    "log_words", "word_length", "distinct_words", "distinct_lines", "line_length", "symbol_words", "upper_words", "top_word", "long_words",
)
_SYM = np.frombuffer(SYMBOLS, np.uint8)


def statistics(text: str | None) -> list[float]:
    b = (text or "").encode()
    n = len(b)
    words = b.split()
    lines = [x for x in b.split(b"\n") if x.strip()]
    k = len(words)
    if not k:
        return [math.log1p(n)] + [0.0] * (len(NAMES) - 1)
    h = np.bincount(np.frombuffer(b, np.uint8), minlength=256)
    up, lo, dig = int(h[65:91].sum()), int(h[97:123].sum()), int(h[48:58].sum())
    sp, nl, high, sym = int(h[32]), int(h[10]), int(h[128:].sum()), int(h[_SYM].sum())
    bang, stop = int(h[33] + h[63]), int(h[46] + h[44])
    other = n - (up + lo + dig + sp + nl + high + sym + bang + stop)
    count = Counter(words)
    distinct, top = len(count), max(count.values())
    marked = sum(c for w, c in count.items() if w[-1] in SYMBOLS or w[-1] == 33)
    shouted = sum(c for w, c in count.items() if len(w) > 1 and w.isupper())
    long = sum(c for w, c in count.items() if len(w) > 14)
    return [
        math.log1p(n), up / n, lo / n, dig / n, sp / n, nl / n, high / n, sym / n, bang / n, stop / n, other / n,
        math.log1p(k), math.log1p(sum(map(len, words)) / k), distinct / k, len(set(lines)) / max(1, len(lines)), math.log1p(n / max(1, len(lines))),
        marked / k, shouted / k, top / k, long / k,
    ]


def matrix(texts: list[str | None]) -> np.ndarray:
    return np.array([statistics(t) for t in texts], float).reshape(-1, len(NAMES))


def with_statistics(docs: DataFrame) -> DataFrame:
    """``docs`` with the statistics as array<double> in place of ``text``."""
    keep = [c for c in docs.columns if c not in ("text", "stats")]
    src = docs.select(*keep, "text")
    schema = StructType(src.schema.fields[:-1]).add("stats", ArrayType(DoubleType()))

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                rows = pa.array(matrix(part.column(len(keep)).to_pylist()).tolist(), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], rows], names=schema.names)

    return src.mapInArrow(run, schema)


class Features:
    """Standardised statistics to random Fourier features, with a constant."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, width: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.freq = rng.normal(size=(len(mean), width)) / math.sqrt(len(mean))
        self.phase = rng.uniform(0, 2 * math.pi, width)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        out = np.cos(z @ self.freq + self.phase) * math.sqrt(2 / len(self.phase))
        return np.hstack([out, np.ones((len(out), 1))])


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots of a nondecreasing map, each block at its mean x."""
    order = np.lexsort((y, x))
    blocks: list[list[float]] = []  # sum of y, weight, sum of x
    for a, b in zip(x[order], y[order], strict=True):
        blocks.append([float(b), 1.0, float(a)])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, w, t = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += w
            blocks[-1][2] += t
    # a pseudo-observation of either class keeps calibrated values off 0 and 1
    return np.array([t / w for s, w, t in blocks]), np.array([(s + 0.5) / (w + 1) for s, w, t in blocks])


class Model:
    def __init__(self, features: Features | None, weights: np.ndarray | None, knots, prior: float):
        self.features, self.weights, self.knots, self.prior = features, weights, knots, prior

    def score(self, stats: np.ndarray) -> np.ndarray:
        if self.features is None:
            return np.full(len(stats), self.prior)
        raw = self.features(stats) @ self.weights
        kx, ky = self.knots
        return np.clip(np.round(np.interp(raw, kx, np.maximum.accumulate(ky)), 9), 0, 1)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", width: int = WIDTH, max_rows: int = MAX_ROWS, ridge: float = RIDGE) -> Model:
    """``labels``: doc_id and the label (0 or 1); rows to learn from only."""
    y = F.col(label).cast("double")
    known = labels.select("doc_id", y.alias("y")).filter("doc_id IS NOT NULL AND y IS NOT NULL")
    n = known.count()
    if n > max_rows:  # by doc_id, before any text is looked at
        known = known.filter(F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1 << 20)) < int((1 << 20) * max_rows / n))
    labelled = docs.select("doc_id", "text").join(small(known, 2 * max_rows), "doc_id")
    rows = stored(with_statistics(labelled), "quality-train")
    rows = rows.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(4)))
    size = len(NAMES)
    cols = [F.col("stats")[i] for i in range(size)]
    head = rows.agg(F.avg("y").alias("prior"), F.min("y").alias("lo"), F.max("y").alias("hi"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(cols)]).head()
    if head["prior"] is None or head["lo"] == head["hi"]:
        return Model(None, None, None, 0.5 if head["prior"] is None else float(head["prior"]))
    mean = np.array([head[f"m{i}"] for i in range(size)])
    scale = np.array([head[f"s{i}"] or 0.0 for i in range(size)])
    features = Features(mean, np.where(scale > 1e-9, scale, 1.0), width)
    d = width + 1

    def sums(batches):
        zz, zy = np.zeros((d, d)), np.zeros(d)
        for batch in batches:
            x = np.array(batch.column(0).to_pylist(), float).reshape(-1, size)
            z = features(x)
            zz += z.T @ z
            zy += z.T @ np.asarray(batch.column(1))
        yield pa.RecordBatch.from_arrays([pa.array([zz.tobytes()], pa.binary()), pa.array([zy.tobytes()], pa.binary())], names=["zz", "zy"])

    learn = rows.filter("fold < 3").coalesce(PARTS).select("stats", "y")
    zz, zy = np.zeros((d, d)), np.zeros(d)
    for r in learn.mapInArrow(sums, "zz binary, zy binary").collect():  # PARTS rows
        zz += np.frombuffer(r["zz"]).reshape(d, d)
        zy += np.frombuffer(r["zy"])
    count = zz[-1, -1]
    weights = np.linalg.solve(zz + ridge * max(count, 1.0) / d * np.eye(d), zy)
    model = Model(features, weights, None, float(head["prior"]))

    def raw(batches):
        for batch in batches:
            x = np.array(batch.column(0).to_pylist(), float).reshape(-1, size)
            yield pa.RecordBatch.from_arrays([pa.array(features(x) @ weights), batch.column(1)], names=["raw", "y"])

    held = rows.filter("fold = 3").select("stats", "y").mapInArrow(raw, "raw double, y double").toPandas()
    if len(held) < 2:
        held = rows.select("stats", "y").mapInArrow(raw, "raw double, y double").toPandas()
    model.knots = isotonic(held["raw"].to_numpy(), held["y"].to_numpy())
    return model


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """Adds ``score`` and ``predicted``; every other column passes through."""
    keep = [c for c in docs.columns if c not in ("score", "predicted")]
    src = docs.select(*keep)
    schema = StructType([*src.schema.fields]).add("score", "double").add("predicted", "integer")
    at = keep.index("text")

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                s = model.score(matrix(part.column(at).to_pylist()))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=schema.names)

    return src.mapInArrow(run, schema)


def fold_of(col: str = "doc_id", folds: int = 5):
    return F.crc32(F.col(col).cast("string").cast("binary")) % folds
