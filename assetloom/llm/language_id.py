"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Characters n-grams (1 to 3 code points of the lower-cased text) are hashed to BUCKETS. The term frequency of a bucket is its share of a text's
n-grams; the inverse document frequency comes from all learning rows. The weights are trained by follow-the-regularised-leader
with elastic-net penalties on a bounded sample: at most SAMPLE rows, the same number for each language as far as there are that many, by
least hash. A fifth of the sample is kept back to fit the temperature that the scores are divided by.

A prediction reads nothing but the text, whole: it is the mean over its n-grams of one table row each, in slices of bounded size.

Defined results: a text that is null or has no letter is ``und`` with score 0. Without learning rows all others are ``und`` too.
Of equal scores the first language in alphabetical order wins. Repeated rows give repeated results, empty tables empty ones; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assetloom.llm.common import crc_fold, slices

BITS, SAMPLE, EPOCHS = 16, 4000, 3
BUCKETS = 1 << BITS
ALPHA, BETA, L1, L2, SCALE = 0.5, 1.0, 0.02, 0.02, 40.0
UNKNOWN = "und"
_SLICE = 1 << 16
_LETTER = regex.compile(r"\p{L}")
#: Odd multipliers of the hash, one for each place in an n-gram.
_MIX = tuple(np.uint32(m) for m in (2654435761, 2246822519, 3266489917))


def buckets(text: str) -> Iterator[np.ndarray]:
    """Buckets of the n-grams of a text, by slices of bounded size that lose no n-gram."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    shift = np.uint32(32 - BITS)
    for at in range(0, len(code), _SLICE):
        part = code[at : at + _SLICE + 2]
        own = min(_SLICE, len(code) - at)
        one = (part + np.uint32(1)) * _MIX[0]
        yield ((one ^ (one >> np.uint32(15))) * _MIX[1] >> shift)[:own]
        for n in (2, 3):
            if len(part) >= n:
                mixed = one[: len(part) - n + 1].copy()
                for k in range(1, n):
                    mixed = (mixed ^ (mixed >> np.uint32(13))) * _MIX[k] + part[k : len(part) - n + 1 + k] * _MIX[0]
                yield ((mixed ^ (mixed >> np.uint32(15))) * _MIX[2] >> shift)[:own]


def _known(text: str | None) -> bool:
    return bool(text) and bool(_LETTER.search(text))


@dataclass(frozen=True)
class Model:
    """table: BUCKETS x languages, weights times inverse document frequency."""

    languages: tuple[str, ...]
    table: np.ndarray
    bias: np.ndarray
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not _known(text):
            return UNKNOWN, 0.0
        total, n = np.zeros(len(self.languages)), 0
        for part in buckets(text):
            total += self.table[part].sum(axis=0, dtype=np.float64)
            n += len(part)
        logits = (SCALE * total / n + self.bias) / self.temperature
        share = np.exp(logits - logits.max())
        best = int(share.argmax())
        return self.languages[best], float(share[best] / share.sum())


def learning_rows(docs: DataFrame) -> Column:
    return (crc_fold(F.col("doc_id"), 4) != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull()


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, rows = np.zeros(BUCKETS + 1, np.int64), 0
    for batch in batches:
        for text in batch.column(0):
            seen = np.zeros(BUCKETS, bool)
            for part in buckets(text.as_py()):
                seen[part] = True
            df[:-1] += seen
            rows += 1
    df[-1] = rows
    yield pa.record_batch([pa.array(np.arange(BUCKETS + 1)), pa.array(df)], names=["bucket", "n"])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, n = [], []
        for text in batch.column(1):
            found = np.concatenate([*buckets(text.as_py()), np.zeros(0, np.uint32)])
            ids, count = np.unique(found, return_counts=True)
            at.append(ids.astype("<i4").tobytes())
            n.append((count / max(1, len(found))).astype("<f4").tobytes())
        yield pa.record_batch([batch.column(0), pa.array(at, pa.binary()), pa.array(n, pa.binary())], names=["lang", "at", "tf"])


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """(weights, bias) by follow-the-regularised-leader with per-coordinate steps; rows: buckets, values, class."""
    z, g2 = np.zeros((BUCKETS + 1, classes)), np.zeros((BUCKETS + 1, classes))

    def weights(at: np.ndarray | slice) -> np.ndarray:
        w = -(z[at] - np.sign(z[at]) * L1) / ((BETA + np.sqrt(g2[at])) / ALPHA + L2)
        return np.where(np.abs(z[at]) <= L1, 0.0, w)

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for r in order.permutation(len(rows)):
            at, x, y = rows[r]
            at, x = np.append(at, BUCKETS), np.append(x, 1.0)
            w = weights(at)
            logits = x @ w
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[y] -= 1.0
            g = x[:, None] * p[None, :]
            was = g2[at]
            sigma = (np.sqrt(was + g * g) - np.sqrt(was)) / ALPHA
            z[at] += g - sigma * w
            g2[at] = was + g * g
    w = weights(slice(None))
    return w[:-1], w[-1]


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits that gives the least negative log-likelihood, by golden-section search on its logarithm; half at least."""
    if not len(y):
        return 1.0

    def loss(log_t: float) -> float:
        s = logits / np.exp(log_t)
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y]).mean())

    low, high, ratio = -0.7, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """docs: doc_id, text, lang. Only learning rows are read."""
    rows = docs.filter(learning_rows(docs)).select("doc_id", "lang", "text")
    frequencies = rows.select("text").mapInArrow(_document_frequencies, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect()  # BUCKETS + 1 rows
    sizes = dict(rows.groupBy("lang").count().collect())  # a row for each language
    languages = tuple(sorted(sizes))
    if not languages:
        return Model((), np.zeros((BUCKETS, 0)), np.zeros(0), 1.0)
    df = np.zeros(BUCKETS + 1)
    for bucket, n in frequencies:
        df[bucket] = n
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1.0

    each = max(8, sample // len(languages))
    # A cut of the hashes leaves about a quarter more rows of each language than are wanted, so that ranking them is a small task.
    share = docs.sparkSession.createDataFrame([(k, min(1.0, 1.25 * (each + 50) / n)) for k, n in sizes.items()], "lang string, share double")
    hashed = rows.select("doc_id", "lang", F.xxhash64("doc_id").alias("h")).join(F.broadcast(share), "lang")
    few = hashed.filter(F.pmod("h", F.lit(1 << 30)) <= F.col("share") * (1 << 30))
    ranked = few.withColumn("_at", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id")))
    picked = ranked.filter(F.col("_at") <= each).select("doc_id").distinct()
    own = rows.join(F.broadcast(picked), "doc_id", "left_semi").dropDuplicates(["doc_id"])  # ``sample`` ids, or 8 for each language
    found = sorted(own.select("lang", "text", "doc_id").select("lang", "text").mapInArrow(_counts, "lang string, at binary, tf binary").collect(), key=lambda r: (r[0], len(r[1]), bytes(r[1])))
    pairs = [(np.frombuffer(at, "<i4"), np.frombuffer(tf, "<f4"), languages.index(lang)) for lang, at, tf in found if at]
    data = [(at, (SCALE * tf * idf[at]).astype(np.float32), y) for at, tf, y in pairs]
    held = [r for i, r in enumerate(data) if i % 5 == 0]
    weights, bias = ftrl([r for i, r in enumerate(data) if i % 5], len(languages))
    logits = np.array([x @ weights[at] + bias for at, x, _ in held]).reshape(len(held), len(languages))
    table = (weights * idf[:, None]).astype(np.float32)
    return Model(languages, table, bias, temperature(logits, np.array([y for _, _, y in held], int)))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS rows for each language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            found = [own.predict(t.as_py()) for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, "doc_id long, lang_pred string, score double")


def keep_known(docs: DataFrame, model: Model, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The documents, all columns, whose language is known with at least that score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in slices(batches):
            found = [own.predict(t.as_py()) for t in batch.column(at)]
            yield batch.filter(pa.array([lang != UNKNOWN and score >= least for lang, score in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
