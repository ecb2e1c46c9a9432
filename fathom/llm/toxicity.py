"""Toxicity by a factorization machine over hashed terms.

score = sigmoid(b + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j), x_i = 1 if the
text holds a term of bucket i. The second sum is taken in linear time as
(|sum v_i x_i|^2 - sum |v_i x_i|^2) / 2 and learns pairs (insult with group
mention) that additive weights miss.

Terms are runs of letters and digits, lower-cased, hashed into 2**bits buckets.
Training takes a bounded sample of the labelled rows (`bound`, chosen by a hash
of the doc_id), keeps the `features` buckets that tell most by chi-squared, and fits by full-batch
Adam on the driver. Scoring covers every row and every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, ship, span_hashes

BITS = 20
#: ASCII bytes that part terms; bytes of other characters belong to them.
_PARTS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms(text: str | None, bits: int = BITS) -> np.ndarray:
    """Sorted distinct buckets of the terms of a whole text."""
    if not text:
        return np.empty(0, np.int64)
    if not text.isascii():
        text = text.lower()
    found = text.encode("utf-8", "surrogatepass").translate(_PARTS).split()
    if not found:
        return np.empty(0, np.int64)
    return np.unique((span_hashes(b" ".join(found) + b" ", 1) >> np.uint64(64 - bits)).astype(np.int64))


@dataclass
class Machine:
    buckets: np.ndarray  # sorted, the features
    bias: float
    weights: np.ndarray  # one a feature
    factors: np.ndarray  # features x rank
    bits: int = BITS

    def score(self, text: str | None) -> float:
        """In [0, 1]; a text without known terms gets the base rate."""
        t = terms(text, self.bits)
        z = self.bias
        if len(t) and len(self.buckets):
            at = np.minimum(np.searchsorted(self.buckets, t), len(self.buckets) - 1)
            at = at[self.buckets[at] == t]
            if len(at):
                v = self.factors[at]
                z += float(self.weights[at].sum() + 0.5 * ((v.sum(0) ** 2).sum() - (v**2).sum()))
        return 1 / (1 + float(np.exp(-np.clip(z, -30, 30))))


def choose(rows: list[np.ndarray], y: np.ndarray, features: int) -> np.ndarray:
    """The buckets with the highest chi-squared against the label; ties go to the smaller bucket."""
    buckets, where = np.unique(np.concatenate(rows), return_inverse=True)
    label = np.repeat(y, [len(r) for r in rows])
    n, pos = len(y), float(y.sum())
    both = np.bincount(where, label, len(buckets))
    df = np.bincount(where, minlength=len(buckets)).astype(float)
    expected = df * pos / n
    spread = expected * (1 - pos / n) * (1 - df / n) + 1e-9
    chi = np.where((df >= 3) & (df < n), (both - expected) ** 2 / spread, 0)
    order = np.lexsort((buckets, -chi))[:features]
    return np.sort(buckets[order[chi[order] > 4]])


def fit(rows: list[np.ndarray], labels: list[int], features: int = 512, rank: int = 4, steps: int = 250, rate: float = 0.1, l2: float = 2e-4, l2_pairs: float = 2e-3, bits: int = BITS) -> Machine:
    """Deterministic. Without rows of both labels the machine answers their base rate (0 without rows)."""
    y = np.asarray(labels, float)
    if not len(y) or y.min() == y.max():
        rate_ = float(y.mean()) if len(y) else 0.0
        return Machine(np.empty(0, np.int64), 30.0 if rate_ == 1 else -30.0, np.empty(0), np.empty((0, rank)), bits)
    kept = choose(rows, y, features)
    x = np.zeros((len(y), len(kept)), np.float64)
    for i, r in enumerate(rows):
        x[i, np.isin(kept, r, assume_unique=True)] = 1
    base = float(y.mean())
    params = [np.array([np.log(base / (1 - base))]), np.zeros(len(kept)), np.random.default_rng(7).normal(0, 0.01, (len(kept), rank))]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        b, w, v = params
        xv = x @ v
        z = b[0] + x @ w + 0.5 * ((xv**2).sum(1) - (x @ v**2).sum(1))
        e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
        grads = [np.array([e.sum()]), x.T @ e + l2 * w, x.T @ (e[:, None] * xv) - (x.T @ e)[:, None] * v + l2_pairs * v]
        for p, g, m, s in zip(params, grads, first, second):
            m += 0.1 * (g - m)
            s += 0.001 * (g * g - s)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return Machine(kept, float(params[0][0]), params[1], params[2], bits)


def held_out(doc_id) -> F.Column:
    """crc32 of the doc_id as text, modulo 4, is 2; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _packed(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("_label"), pa.array([terms(t.as_py(), bits).astype(np.int32).tobytes() for t in batch.column("text")], pa.binary())], names=["doc_id", "label", "packed"])

    return run


def train(docs: DataFrame, labels: DataFrame, column: str = "toxic", bound: int = 8000, bits: int = BITS, row_bound: int | None = None, **options) -> Machine:
    """Learn from docs(doc_id, text) and labels(doc_id, <column> 0/1), without the held-out rows.

    bound: the most labelled documents that are looked at, chosen by a hash of doc_id. Null labels
    and ids are ignored; of repeated label rows the greatest counts; repeated documents all count.
    row_bound: the most rows of those documents, 2 * bound if not given; it matters only if ids repeat. Rows are taken by the
    hash of doc_id, doc_id and the text's terms, so that the same rows are taken in every run.
    """
    ship(docs.sparkSession)
    known = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(F.col(column).cast("int")).alias("_label"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").mapInArrow(_packed(bits), "doc_id long, label int, packed binary")
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "packed").limit(row_bound or 2 * bound).toArrow()
    ids, packed, label = (rows.column(c).to_pylist() for c in ("doc_id", "packed", "label"))
    order = sorted(range(len(ids)), key=lambda i: (ids[i], packed[i]))
    return fit([np.frombuffer(packed[i], np.int32).astype(np.int64) for i in order], [label[i] for i in order], bits=bits, **options)


def scored(docs: DataFrame, machine: Machine, into: str = "_score") -> DataFrame:
    """docs with a double column `into`, which takes the place of one of that name; a null or empty text gets the base rate's score. Row-wise: ties and repeats are no matter."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        m = shared.value
        return pd.Series([m.score(t if isinstance(t, str) else None) for t in texts], dtype="float64")

    return docs.withColumn(into, score(F.col("text")))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """docs whose score is below the threshold, with all their columns."""
    into = free_name(docs, "_score")
    return scored(docs, train(docs, labels), into).where(F.col(into) < threshold).select(*docs.columns)
