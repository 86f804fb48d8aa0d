"""Language identification by nearest centroid.

Texts become counts of hashed character n-grams (one to three letters, word
boundaries included), weighted by TF-IDF and normalised. Each language has
several centroids: its sample vectors are clustered by spherical k-means. A
text gets the language of its nearest centroid by cosine; the score is that
cosine. Distance-based rejection: a text farther from its centroid than nearly
all sample texts of that language is marked ``rejected`` (its nearest language
stays in ``lang_pred``).

Learning uses a bounded sample, ``sample_rows`` labelled rows (or LEAST_ROWS a
language, if that is more), split evenly over languages. A language is counted
first; rows whose hash of id and text lies below the share that its count leaves
are taken where they lie, the share being five deviations short of the bound.
Document frequencies come from that sample. Prediction reads the whole text and
nothing else.

Defined results: null texts and texts without a letter are ``und`` with score
0.0; so is everything if no labelled row can be learned from; equal cosines go
to the first language by name; rows that repeat an id are predicted each; other
columns are ignored.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnmark.llm.common import is_held_out, per_batch, text_or_empty

BUCKETS = 4096
SAMPLE_ROWS = 2400
CLUSTERS = 4
#: Rows that a language may have in the sample however many languages there are; languages up to which their shares are broadcast.
LEAST_ROWS, BROADCAST_LANGUAGES = 36, 100_000
#: Vectors made at once; bounds a worker's memory.
ROWS_AT_ONCE = 256


@functools.cache
def _letters() -> np.ndarray:
    """For each code point itself if a letter, else a space."""
    points = np.arange(0x110000, dtype=np.uint32)
    alpha = np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)
    return np.where(alpha, points, 32).astype(np.uint32)


def ngram_counts(text: str) -> np.ndarray | None:
    """Counts per bucket; None without a letter."""
    points = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), dtype="<u4")
    x = _letters()[points]
    keep = np.ones(len(x), dtype=bool)
    keep[1:] = (x[1:] != 32) | (x[:-1] != 32)
    x = x[keep]
    if len(x) < 3:
        return None
    one = x * np.uint32(2654435761)
    two = (one[:-1] ^ np.uint32(0x9E3779B9)) * np.uint32(2246822519) + x[1:]
    two *= np.uint32(3266489917)
    three = (two[:-1] ^ (two[:-1] >> np.uint32(15))) * np.uint32(2246822519) + x[2:]
    three *= np.uint32(668265263)
    out = np.bincount(two >> np.uint32(20), minlength=BUCKETS)
    out += np.bincount(three >> np.uint32(20), minlength=BUCKETS)
    out += np.bincount(one[x != 32] >> np.uint32(20), minlength=BUCKETS)
    return out


def _counts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Matrix of counts and which rows have letters."""
    found = [ngram_counts(t) if t else None for t in texts]
    out = np.zeros((len(texts), BUCKETS), dtype=np.float32)
    for i, c in enumerate(found):
        if c is not None:
            out[i] = c
    return out, np.array([c is not None for c in found], dtype=bool)


def _weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def cluster(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; starts from the row nearest the mean, then the farthest ones."""
    picked = [int((x @ x.mean(axis=0)).argmax())]
    while len(picked) < min(k, len(x)):
        picked.append(int((x @ x[picked].T).max(axis=1).argmin()))
    c = x[picked]
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        sums = np.stack([x[own == j].sum(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
        c = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return c


class NearestCentroid:
    """Centroids, their languages, and the farthest accepted distance of each language."""

    def __init__(self, counts: np.ndarray, langs: list[str], *, clusters: int, quantile: float = 0.999, slack: float = 1.25):
        self.idf = (np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))) + 0.1).astype(np.float32)
        x = _weighted(counts, self.idf)
        names, groups = np.array(langs), []
        self.langs: list[str] = []
        self.reach: list[float] = []
        for lang in sorted(set(langs)):
            own = x[names == lang]
            c = cluster(own, clusters)
            groups.append(c)
            self.langs += [lang] * len(c)
            self.reach += [min(1.0, slack * float(np.quantile(1 - (own @ c.T).max(axis=1), quantile)))] * len(c)
        self.centroids = np.vstack(groups).astype(np.float32)

    def predict(self, counts: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        cosine = _weighted(counts, self.idf) @ self.centroids.T
        best = cosine.argmax(axis=1)
        top = np.clip(cosine[np.arange(len(best)), best].astype(float), 0.0, 1.0)
        return [self.langs[j] for j in best], top, 1 - top > np.array(self.reach)[best]


def learn(docs: DataFrame, *, sample_rows: int = SAMPLE_ROWS, clusters: int = CLUSTERS) -> NearestCentroid | None:
    """Fit on a bounded sample of labelled rows that are not held out."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out())
    counts = usable.groupBy("lang").agg(F.count("*").alias("rows"))
    n_langs = counts.count()
    if not n_langs:
        return None
    quota = max(LEAST_ROWS, sample_rows // n_langs)
    share = F.when(F.col("rows") <= quota, 1.0).otherwise((quota - 5 * quota**0.5) / F.col("rows"))
    shares = counts.select("lang", (share * float(1 << 40)).alias("below"))
    drawn = F.pmod(F.xxhash64(F.lit("sample"), "doc_id", "text"), F.lit(1 << 40))
    sample = usable.select("lang", "doc_id", "text").join(F.broadcast(shares) if n_langs <= BROADCAST_LANGUAGES else shares, "lang")
    sample = sample.where(drawn < F.col("below")).select("lang", "doc_id", "text").distinct()  # repeated rows count once

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts, has = _counts(batch.column(1).to_pylist())
            packed = pa.array([x.astype("<f4").tobytes() for x in counts[has]], pa.binary())
            return pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(has)), packed], names=["lang", "counts"])

        return step

    rows = sample.select("lang", "text").mapInArrow(per_batch(make), "lang string, counts binary").collect()  # the sample
    if not rows:
        return None
    rows.sort(key=lambda r: (r.lang, bytes(r.counts)))
    return NearestCentroid(np.stack([np.frombuffer(r.counts, "<f4") for r in rows]), [r.lang for r in rows], clusters=clusters)


def identify(docs: DataFrame, model: NearestCentroid | None) -> DataFrame:
    """doc_id, lang_pred, score, rejected: one row per row of docs."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            langs, scores, rejected = [], [], []
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                counts, has = _counts(batch.column(1).slice(at, ROWS_AT_ONCE).to_pylist())
                if model is None:
                    has[:] = False
                    found = (["und"] * len(has), np.zeros(len(has)), np.ones(len(has), dtype=bool))
                else:
                    found = model.predict(counts)
                langs += [x if h else "und" for x, h in zip(found[0], has)]
                scores += np.where(has, found[1], 0.0).tolist()
                rejected += (found[2] | ~has).tolist()
            return pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())],
                names=["doc_id", "lang_pred", "score", "rejected"],
            )

        return step

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(per_batch(make), "doc_id long, lang_pred string, score double, rejected boolean")


def language_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op7: all documents; learns from labelled rows that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs, learn(docs))
    return found.select("doc_id", is_held_out().alias("held_out"), "lang_pred", "score", "rejected")
