"""Quality classifier: random Fourier features, ridge by partition-summed normal equations, isotonic calibration."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import small_batches, text_key, texts
from cairn.session import materialize

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#$%&*@^~<>{}[]\\=+_")] = True
FEATURES = (
    "log_chars", "word_length", "word_length_sd", "letters", "digits", "upper", "symbols", "bars", "bangs", "stops", "non_ascii",
    "distinct_words", "top_word", "repeated_next", "distinct_pairs", "distinct_lines", "log_line_words", "title_words", "bare_words", "short_words",
)


def statistics(text: str) -> list[float]:
    """Statistics of one whole text; the empty text has zeros."""
    raw = text.encode()
    n = len(raw)
    words = text.split()
    m = len(words)
    if not m:
        return [0.0] * len(FEATURES)
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper, lower = seen[65:91].sum(), seen[97:123].sum()
    wide = seen[0x80:].sum()
    length = np.fromiter(map(len, words), np.int64, m)
    top = max(Counter(words).values())
    lines = [x for x in text.split("\n") if x]
    return [
        np.log1p(n), length.mean(), length.std(), (upper + lower + wide) / n, seen[48:58].sum() / n, upper / max(1, upper + lower), seen[SYMBOLS].sum() / n,
        seen[124] / m, seen[33] / m, seen[46] / m, wide / n,
        len(set(words)) / m, top / m, sum(map(str.__eq__, words, words[1:])) / m, len(set(zip(words, words[1:], strict=False))) / m, len(set(lines)) / len(lines), np.log1p(m / len(lines)),
        sum(map(str.istitle, words)) / m, sum(map(str.isalpha, words)) / m, (length <= 3).mean(),
    ]


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key and x, the statistics of every whole text."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("array<double>")
    def measure(text: pd.Series) -> pd.Series:
        return text.map(statistics)

    return texts(docs, id_col, text_col).select("doc_id", text_key().alias("text_key"), measure("text").alias("x"))


def is_held_out(id_col: str = "doc_id"):
    """Rows whose labels are never learned from: crc32 of the id as text, modulo 3, is 1; a null id isn't held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def partition_sums(rows: DataFrame, sums, width: int) -> np.ndarray:
    """Sum over all rows of what sums(X, y) gives for a batch: a partition adds up its batches and sends one vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for b in batches:
            if b.num_rows:
                x = np.array(b.column(0).to_pylist(), dtype=float)
                total += sums(x, b.column(1).to_numpy(zero_copy_only=False).astype(float))
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["total"])

    parts = rows.select("x", "y").mapInArrow(run, "total array<double>").collect()
    return np.sum([np.array(r["total"]) for r in parts], axis=0) if parts else np.zeros(width)


class Model:
    """Standardised statistics, a random Fourier map, ridge weights, and the calibration's knots."""

    def __init__(self, mean, scale, omega, phase, beta, knots, values, prior):
        self.mean, self.scale, self.omega, self.phase, self.beta, self.knots, self.values, self.prior = mean, scale, omega, phase, beta, knots, values, prior

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        f = np.cos(z @ self.omega + self.phase) * np.sqrt(2 / self.omega.shape[1])
        return np.concatenate([f, z / 10, np.ones((len(x), 1))], 1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.beta

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.beta is None:
            return np.full(len(x), self.prior)
        r = self.raw(x)
        # A thousandth of the raw order is kept, so that ties of the calibration's steps stay sorted.
        return np.clip(0.999 * np.interp(r, self.knots, self.values) + 0.001 / (1 + np.exp(-4 * (r - 0.5))), 0, 1)


def isotonic(n: np.ndarray, positive: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the non-decreasing means nearest to positive / n."""
    blocks: list[list[float]] = []  # weight, positives, bins
    for w, p in zip(n, positive, strict=True):
        blocks.append([w, p, 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            w2, p2, k2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + w2, blocks[-1][1] + p2, blocks[-1][2] + k2]
    return np.concatenate([np.full(k, p / w) for w, p, k in blocks]) if blocks else np.zeros(0)


def fit(train: DataFrame, n_features: int = 256, ridge: float = 1.0, bins: int = 512, seed: int = 11) -> Model:
    """Fit on rows (doc_id, x, y), bounded by the caller.

    Three of four rows give the normal equations Z'Z and Z'y, summed by partitions; the fourth gives the calibration, from
    counts in `bins` bins of the raw score; where that fourth has one label only, all rows do. With no rows, or of one label only, every score is the prior.
    """
    n, ones = train.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0.0))).first()
    d = len(FEATURES)
    rng = np.random.default_rng(seed)
    omega, phase = rng.normal(size=(d, n_features)) / np.sqrt(d) * 1.2, rng.uniform(0, 2 * np.pi, n_features)
    if not 0 < ones < n:
        return Model(None, None, None, None, None, None, None, 0.5 if not n else float(ones > 0))
    moments = partition_sums(train, lambda x, y: np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)]), 1 + 2 * d)
    mean = moments[1 : d + 1] / moments[0]
    scale = np.sqrt(np.maximum(moments[d + 1 :] / moments[0] - mean**2, 1e-8))
    model = Model(mean, scale, omega, phase, None, None, None, ones / n)
    fold = F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(4))
    width = n_features + d + 1

    def normal(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = model.features(x)
        return np.concatenate([(z.T @ z).ravel(), z.T @ y])

    sums = partition_sums(train.filter(fold > 0), normal, width * width + width)
    model.beta = np.linalg.solve(sums[: width * width].reshape(width, width) + ridge * np.eye(width), sums[width * width :])
    edges = np.linspace(-0.5, 1.5, bins - 1)

    def histogram(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        b = np.searchsorted(edges, model.raw(x))
        return np.concatenate([np.bincount(b, minlength=bins), np.bincount(b, y, bins)])

    counts = partition_sums(train.filter(fold == 0), histogram, 2 * bins)
    if not 0 < counts[bins:].sum() < counts[:bins].sum():
        counts = partition_sums(train, histogram, 2 * bins)
    full = np.flatnonzero(counts[:bins])
    if len(full):
        middle = np.concatenate([[edges[0]], (edges[1:] + edges[:-1]) / 2, [edges[-1]]])
        model.knots, model.values = middle[full], isotonic(counts[:bins][full], counts[bins:][full])
    else:
        model.knots, model.values = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    return model


def score_quality(docs: DataFrame, labels: DataFrame, all_labels: bool = False, max_rows: int = 200_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key, held_out, score and predicted for every document.

    Statistics of every whole text are computed once and written down (20 numbers a text); labels meet them by doc_id. The
    model is fitted on about max_rows labelled ids at most, chosen by a hash before they meet the texts: a documented bound. An id
    labelled more than once counts by its mean label; null labels and ids are left out. Null or empty text: zeros, scored
    like any other. Repeated rows get equal scores. An empty table: no rows; no labels: score 0.5.
    """
    spark = docs.sparkSession
    stats = materialize(document_statistics(docs, id_col, text_col), "quality-statistics")
    known = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("double").alias("y"))
    if not all_labels:
        known = known.filter(~is_held_out())
    n = known.count()
    if n > max_rows:
        known = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 20)) < int(max_rows / n * (1 << 20)))
    train = stats.join(known, "doc_id").select("doc_id", "x", "y").groupBy("doc_id", "y").agg(F.min("x").alias("x"))  # one text an id
    model = fit(materialize(train.repartition(16), "quality-train"))  # bounded: 200,000 rows of 20 numbers

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array(x.tolist(), dtype=float).reshape(len(x), -1)) if len(x) else np.zeros(0))

    return stats.select("doc_id", "text_key", is_held_out().alias("held_out"), score("x").alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
