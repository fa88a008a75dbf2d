"""Quality classifier: a factorisation machine over hashed words and structure statistics.

A text is a sparse vector: its hashed words, with the square roots of their counts scaled to unit length, and dense statistics of its
structure (lengths, shares of characters, repetition). Low-rank factors give each pair of features a weight, and the
score takes linear time by the sum-of-squares identity: the pairs' sum is half of (square of the sum minus sum of the squares).

Training reads a bounded sample, at most SAMPLE labelled rows of the learning folds by least hash of the id, on the driver (features only). Every
document is scored on its whole text; neither labels, language, source nor id are inputs. Metadata is left out: the only column that may be one, n_chars,
is the text's own length, of which the statistics have the words and their mean size.

Defined results: a null text counts as empty and is scored like any other. Without learning labels every score is the
prior one half. If an id has several labels the least one counts. Repeated rows give repeated results; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetloom.llm.common import crc_fold

BITS, RANK, SAMPLE, EPOCHS = 16, 8, 10_000, 6
RATE, DECAY, CUT = 0.05, 2e-5, 0.3
WORDS = 1 << BITS
_UPPER, _LOWER, _DIGIT = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789"
_STOPS, _SYMBOLS, _PIPES, _SHOUTS = b".,;:", b"#*$%&<>", b"|", b"!?"
STATS = 16


def structure(text: bytes, words: list[bytes], counts: Counter) -> list[float]:
    """STATS statistics of about unit size, the first one constant."""
    size, n = max(1, len(text)), max(1, len(words))
    share = lambda chars: (len(text) - len(text.translate(None, chars))) / size
    lines = [x for x in text.split(b"\n") if x.strip()]
    most = max(counts.values(), default=0) / n
    runs = sum(a == b for a, b in zip(words, words[1:], strict=False)) / n
    upper, lower = share(_UPPER), share(_LOWER)
    return [
        1.0,
        np.log1p(len(words)) / 5 - 1,
        min(3.0, len(text) / n / 6) - 1,
        4 * upper,
        upper / (upper + lower + 1e-9),
        8 * share(_DIGIT),
        10 * share(_STOPS),
        10 * share(_SYMBOLS),
        10 * share(_PIPES),
        10 * share(_SHOUTS),
        len(counts) / n,
        4 * most,
        4 * runs,
        2 * (1 - len(set(lines)) / max(1, len(lines))),
        np.log1p(size / max(1, len(lines))) / 5 - 1,
        float(len(words) < 12),
    ]


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(places, values): the statistics at WORDS and after, the words before."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    counts = Counter(words)
    at = np.fromiter((xxhash.xxh32_intdigest(w) & (WORDS - 1) for w in counts), np.int64, len(counts))
    x = np.sqrt(np.fromiter(counts.values(), np.float64, len(counts)))
    if len(x):
        x /= np.sqrt((x * x).sum())
    return np.concatenate([at, np.arange(WORDS, WORDS + STATS)]), np.concatenate([x, structure(data, words, counts)])


@dataclass
class Model:
    bias: float
    w: np.ndarray
    v: np.ndarray

    def raw(self, at: np.ndarray, x: np.ndarray) -> float:
        xv = x[:, None] * self.v[at]
        s = xv.sum(axis=0)
        return float(self.bias + x @ self.w[at] + 0.5 * (s @ s - (xv * xv).sum()))

    def score(self, text: str | None) -> float:
        return float(1.0 / (1.0 + np.exp(-np.clip(self.raw(*features(text)), -30, 30))))


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS) -> Model:
    """Logistic loss by AdaGrad, a row at a time."""
    rng = np.random.default_rng(11)
    model = Model(0.0, np.zeros(WORDS + STATS), rng.normal(0, 0.02, (WORDS + STATS, RANK)))
    gw, gv, gb = np.full(WORDS + STATS, 1e-2), np.full((WORDS + STATS, RANK), 1e-2), 1e-2
    for _ in range(epochs):
        for r in rng.permutation(len(rows)):
            at, x, y = rows[r]
            v = model.v[at]
            xv = x[:, None] * v
            s = xv.sum(axis=0)
            raw = model.bias + x @ model.w[at] + 0.5 * (s @ s - (xv * xv).sum())
            d = 1.0 / (1.0 + np.exp(-np.clip(raw, -30, 30))) - y
            dw, dv = d * x + DECAY * model.w[at], d * x[:, None] * (s[None, :] - xv) + DECAY * v
            gb += d * d
            model.bias -= RATE * d / np.sqrt(gb)
            gw[at] += dw * dw
            model.w[at] -= RATE * dw / np.sqrt(gw[at])
            gv[at] += dv * dv
            model.v[at] -= RATE * dv / np.sqrt(gv[at])
    return model


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [features(t.as_py()) for t in batch.column(1)]
        yield pa.record_batch(
            [batch.column(0), batch.column(2), pa.array([a.astype("<i4").tobytes() for a, _ in found], pa.binary()), pa.array([x.astype("<f4").tobytes() for _, x in found], pa.binary())],
            names=["doc_id", "y", "at", "x"],
        )


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """docs: doc_id, text; labels: doc_id, quality. Only ids outside fold 0 of 5 are read."""
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (crc_fold(F.col("doc_id"), 5) != 0))
    known = known.groupBy("doc_id").agg(F.min("quality").cast("int").alias("y"))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    own = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("doc_id", "text", "y").dropDuplicates(["doc_id"])  # ``sample`` rows
    found = own.mapInArrow(_features, "doc_id long, y int, at binary, x binary").collect()
    rows = [(np.frombuffer(r["at"], "<i4"), np.frombuffer(r["x"], "<f4"), int(r["y"])) for r in sorted(found, key=lambda r: r["doc_id"])]
    return fit(rows)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([own.score(t.as_py()) for t in batch.column(1)], pa.float64())], names=["doc_id", "score"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, "doc_id long, score double")
