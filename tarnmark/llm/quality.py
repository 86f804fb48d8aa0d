"""Quality classifier: regularised quadratic discriminant analysis.

A text becomes a vector of transformed statistics (sizes, shares of character
classes, word and line repetition). Each label has a Gaussian; its
covariance is shrunk towards the pooled one and towards a multiple of the
identity. The score is the logistic of the difference of log densities plus the
log prior odds; Mahalanobis distances come from Cholesky factors that are
computed once, on the driver, from moments.

Moments are sums over all labelled training rows: each task adds up its own,
and sums of sums follow, so the driver sees a few hundred numbers. Nothing but
the text enters a score.

Defined results: null and empty texts get the vector of an empty text; if only
one label was seen the score is that label, and 1.0 if none was (nothing is
rejected without evidence); rows that repeat an id are scored each, and each
label row of an id counts; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnmark.llm.common import is_held_out, materialize, per_batch, text_or_empty, utf8

#: Byte classes whose shares are taken: lower case, upper case, digits, white space, stops, marks, bars, beyond ASCII.
_CLASSES = [
    b"abcdefghijklmnopqrstuvwxyz",
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    b"0123456789",
    b" \t\n\r\f\v",
    b".,;:?'\"()-",
    b"#$%&*@^~+=_`\\/<>{}[]",
    b"|!",
    bytes(range(128, 256)),
]
_MEMBERS = np.zeros((256, len(_CLASSES)))
for _k, _members in enumerate(_CLASSES):
    _MEMBERS[list(_members), _k] = 1
#: Shares of the classes that a short text is drawn towards, with the weight of so many bytes (fixed values).
_USUAL, _WEIGHT = np.array([0.77, 0.02, 0.005, 0.16, 0.02, 0.005, 0.005, 0.015]), 40
N_FEATURES = len(_CLASSES) + 5


def _logit(share: float | np.ndarray) -> float | np.ndarray:
    return np.log((share + 0.002) / (1.002 - share))


def statistics(text: bytes) -> np.ndarray:
    """The transformed statistics of one text; all but the size hardly depend on the length."""
    counts = np.bincount(np.frombuffer(text, dtype="u1"), minlength=256)
    words, lines = text.split(), text.split(b"\n")
    k, out = len(_CLASSES), np.zeros(N_FEATURES)
    out[:k] = _logit((counts @ _MEMBERS + _WEIGHT * _USUAL) / (len(text) + _WEIGHT))
    out[k] = np.log1p(len(words))
    out[k + 1] = np.log((len(text) - len(words) + 5 * _WEIGHT) / (len(words) + _WEIGHT))
    out[k + 2] = _logit((len(set(words)) + _WEIGHT) / (len(words) + _WEIGHT))
    out[k + 3] = _logit((len(set(lines)) + 5) / (len(lines) + 5))
    out[k + 4] = np.log((len(words) + _WEIGHT) / (len(lines) + 2))
    return out


def features(docs: DataFrame) -> DataFrame:
    """doc_id, x array<double>."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = pa.array([statistics(t) for t in utf8(batch.column(1))], pa.list_(pa.float64()))
            return pa.RecordBatch.from_arrays([batch.column(0), x], names=["doc_id", "x"])

        return step

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(
        per_batch(make), "doc_id long, x array<double>"
    )


def moments(labelled: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """label -> (count, mean, covariance) of rows (label, x); one aggregate of sums of products for each label."""
    d = N_FEATURES
    x = [F.lit(1.0), *(F.col("x")[k] for k in range(d))]
    cells = [(i, j) for i in range(d + 1) for j in range(i, d + 1)]
    out = {}
    for r in labelled.groupBy("label").agg(F.array(*[F.sum(x[i] * x[j]) for i, j in cells]).alias("sums")).collect():  # a row a label
        s = np.zeros((d + 1, d + 1))
        for (i, j), v in zip(cells, r.sums):
            s[i, j] = s[j, i] = v
        mean = s[0, 1:] / s[0, 0]
        out[r.label] = (s[0, 0], mean, s[1:, 1:] / s[0, 0] - np.outer(mean, mean))
    return out


class QuadraticDiscriminant:
    """Two shrunk Gaussians with cached Cholesky factors."""

    def __init__(self, seen: dict[int, tuple[float, np.ndarray, np.ndarray]], *, to_pooled: float = 0.1, to_identity: float = 0.05):
        self.only = None if 0 in seen and 1 in seen else float(next(iter(sorted(x for x in seen if x in (0, 1))), 1))
        if self.only is not None:
            return
        total = seen[0][0] + seen[1][0]
        pooled = sum(seen[c][0] * seen[c][2] for c in (0, 1)) / total
        self.scale = np.sqrt(np.diag(pooled)) + 1e-6
        pooled = pooled / np.outer(self.scale, self.scale)
        self.parts = {}
        for c in (0, 1):
            n, mean, cov = seen[c]
            cov = (1 - to_pooled) * cov / np.outer(self.scale, self.scale) + to_pooled * pooled
            cov = (1 - to_identity) * cov + to_identity * np.trace(cov) / len(cov) * np.eye(len(cov))
            factor = np.linalg.cholesky(cov)
            self.parts[c] = (mean / self.scale, np.linalg.inv(factor), 2 * np.log(np.diag(factor)).sum(), np.log(n / total))

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.only is not None:
            return np.full(len(x), self.only)
        log = {}
        for c, (mean, whiten, log_det, log_prior) in self.parts.items():
            z = (x / self.scale - mean) @ whiten.T
            log[c] = log_prior - 0.5 * (log_det + (z * z).sum(axis=1))
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))


def fit(x: DataFrame, labels: DataFrame) -> QuadraticDiscriminant:
    """Learn from features (doc_id, x) and labels (doc_id, quality) of rows that are not held out."""
    train = labels.where("quality in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
    return QuadraticDiscriminant(moments(train.where(~is_held_out()).join(x, "doc_id").select("label", "x")))


def quality_scores(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per row of docs; learns from rows not held out."""
    x = materialize(features(docs), "features")
    model = fit(x, labels)

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            s = model.score(np.array(batch.column(1).to_pylist()))
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64())], names=["doc_id", "score"])

        return step

    scored = x.mapInArrow(per_batch(make), "doc_id long, score double")
    return scored.select("doc_id", is_held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def good_documents(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.7) -> DataFrame:
    """docs without the rows scored below the threshold; scored where they lie, so no text is shuffled."""
    model, at = fit(features(docs), labels), docs.columns.index("text")

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            s = model.score(np.array([statistics(t) for t in utf8(batch.column(at))]))
            return batch.filter(pa.array(s >= threshold))

        return step

    return docs.mapInArrow(per_batch(make), docs.schema)


def quality_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op9: all documents, labels of rows that are not held out."""
    return quality_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
