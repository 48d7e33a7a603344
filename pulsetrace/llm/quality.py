"""Quality classifier: regularised quadratic discriminant over transformed text statistics.

Each class has a mean and a covariance shrunk towards the pooled one and towards its diagonal; its
Cholesky factor is computed once and shipped with the scorer. A score is the logistic of the
difference of the two log densities (Mahalanobis distance, determinant, prior).

Statistics are computed once per document, written, and read by the fit and by the scorer.
The fit uses every labelled row outside the held-out part; it shuffles sums, not rows.

Defined cases: null text counts as empty and is scored; null labels are left out of the fit; a
document labelled twice counts twice; with one class or no labels the score is the prior (0.5
without labels); repeated rows score alike; an empty table gives no rows; other columns are ignored.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, batch_rows, written

LETTERS = bytes(range(65, 91)) + bytes(range(97, 123))
UPPER = bytes(range(65, 91))
DIGITS = bytes(range(48, 58))
SPACES = b" \t\n\r\x0b\x0c"
STOPS = b".,;:"
MARKS = b"!?"
SIGNS = bytes(c for c in range(33, 127) if c not in LETTERS + DIGITS + STOPS + MARKS + b"'-\"()")
WIDE = bytes(range(128, 256))
NAMES = (
    "words", "word_length", "longest", "distinct", "lines", "line_length", "repeated_lines",
    "upper", "digit", "stop", "mark", "sign", "wide", "space", "capitals", "ended",
)


def _logit(part: float, whole: float) -> float:
    return float(np.log((part + 0.5) / (whole - part + 0.5)))


def statistics(text: str) -> list[float]:
    """The values of ``NAMES``: logarithms of counts and lengths, log-odds of shares."""
    raw = text.encode("utf-8", "surrogatepass")
    size = len(raw)
    words = raw.split()
    n = len(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    among = lambda kind: _logit(size - len(raw.translate(None, kind)), size)
    lengths = list(map(len, words))
    return [
        np.log1p(n),
        np.log1p(sum(lengths) / n) if n else 0.0,
        np.log1p(max(lengths)) if n else 0.0,
        _logit(len(set(words)), n),
        np.log1p(len(lines)),
        np.log1p(size / len(lines)) if lines else 0.0,
        _logit(len(lines) - len(set(lines)), len(lines)),
        *map(among, (UPPER, DIGITS, STOPS, MARKS, SIGNS, WIDE, SPACES)),
        _logit(sum(w[:1].isupper() for w in words), n),
        _logit(sum(x.rstrip()[-1:] in (b".", b"!", b"?") for x in lines), len(lines)),
    ]


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batch_rows(batches):
        values = [statistics(t or "") for t in batch.column("text").to_pylist()]
        flat = pa.array(np.array(values, dtype=float).ravel())
        lists = pa.FixedSizeListArray.from_arrays(flat, len(NAMES)).cast(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("held_out"), lists], ["doc_id", "held_out", "x"]
        )


def document_statistics(docs: DataFrame, held_out) -> DataFrame:
    """(doc_id, held_out, x) of every document, written once."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), "text")
    return written(
        rows.mapInArrow(_features, "doc_id long, held_out boolean, x array<double>"), "statistics"
    )


@dataclass
class Discriminant:
    """Two classes: log prior, mean and inverse Cholesky factor of each."""

    log_prior: np.ndarray
    mean: np.ndarray
    whiten: np.ndarray
    log_det: np.ndarray

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        """Log density ratio of class 1 to class 0 for rows of ``x``."""
        dense = [
            self.log_prior[c] - 0.5 * self.log_det[c]
            - 0.5 * np.square((x - self.mean[c]) @ self.whiten[c].T).sum(axis=1)
            for c in (0, 1)
        ]
        return dense[1] - dense[0]


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Count, sums and products of one task's rows per class, as long rows."""
    d = len(NAMES)
    total = np.zeros((2, d + 1, d + 1))
    for batch in batches:
        x = np.array(batch.column("x").to_pylist(), dtype=float).reshape(-1, d)
        y = batch.column("label").to_numpy()
        ones = np.hstack([np.ones((len(x), 1)), x])
        for c in (0, 1):
            total[c] += ones[y == c].T @ ones[y == c]
    place = np.arange(total.size, dtype=np.int32)
    yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(total.ravel())], ["place", "value"])


def fit(stats: DataFrame, labels: DataFrame, to_pooled: float = 0.2, to_sphere: float = 0.02) -> Discriminant:
    """``labels``: (doc_id, label 0 or 1). Shrinkage weights are shares of the class covariance."""
    d = len(NAMES) + 1
    known = labels.where(F.col("label").isin(0, 1))
    rows = stats.where(~F.col("held_out")).join(known, "doc_id").select("x", F.col("label").cast("int"))
    sums = np.zeros(2 * d * d)
    parts = rows.mapInArrow(_moments, "place int, value double").groupBy("place").agg(F.sum("value"))
    for place, value in parts.collect():  # 2 x (statistics + 1)^2 numbers, whatever the rows
        sums[place] = value
    m = sums.reshape(2, d, d)
    n = m[:, 0, 0]
    if not n.all():
        prior = np.log((n + 1) / (n.sum() + 2)) if n.sum() else np.zeros(2)
        eye = np.stack([np.eye(d - 1)] * 2)
        return Discriminant(prior, np.zeros((2, d - 1)), eye, np.zeros(2))
    mean = m[:, 0, 1:] / n[:, None]
    own = m[:, 1:, 1:] / n[:, None, None] - mean[:, :, None] * mean[:, None, :]
    pooled = (own * n[:, None, None]).sum(axis=0) / n.sum()
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-9))
    sphere = np.diag(scale**2)
    cov = (1 - to_pooled - to_sphere) * own + to_pooled * pooled + to_sphere * sphere
    lower = np.linalg.cholesky(cov)
    return Discriminant(
        np.log(n / n.sum()), mean, np.linalg.inv(lower),
        2 * np.log(np.diagonal(lower, axis1=1, axis2=2)).sum(axis=1),
    )


def score(stats: DataFrame, model: Discriminant, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted)."""
    schema = arrow_schema(doc_id=pa.int64(), held_out=pa.bool_(), score=pa.float64(), predicted=pa.int32())

    def rows(batches):
        for batch in batches:
            x = np.array(batch.column("x").to_pylist(), dtype=float).reshape(-1, len(NAMES))
            p = 1 / (1 + np.exp(-np.clip(model.log_odds(x), -700, 700)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(p),
                 pa.array((p >= threshold).astype(np.int32))],
                schema=schema,
            )

    return stats.mapInArrow(rows, "doc_id long, held_out boolean, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, held_out, threshold: float = 0.3) -> DataFrame:
    """Fit on the labelled documents outside ``held_out`` and score all of ``docs``."""
    stats = document_statistics(docs, held_out)
    return score(stats, fit(stats, labels), threshold)
