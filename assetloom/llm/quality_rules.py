"""Quality rules in DataFrame operations only: base counts, and a hashed n-gram log-likelihood ratio.

Words and word pairs are hashed to BUCKETS buckets each. Two multinomials are counted over them: the raw corpus (every document) and a trusted
target (every document labelled good). A document's score is the mean of
log(target / raw) over its n-grams, so it doesn't depend on length, and every document is held against one
fixed threshold. A bucket's ratio is shrunk by SMOOTHING times the occurrences that the target has of a bucket on average, so that it doesn't depend on the size
of the corpus: words too rare to tell are neutral, and text that the target avoids is dropped.

Texts are marked by bitmaps of the target's ids where these are few enough to send to every executor, else over one exchange. Counting explodes words to rows that are aggregated before the shuffle (at most 2 * BUCKETS rows a task). Scoring
has no shuffle: the ratios are a literal of fixed size, looked up within the row.

Defined results: a null text has no words and fails the base rule. Repeated rows give repeated results. Without labels, or without
documents, the ratio is zero everywhere. Only id and text are read, so clashing names of other columns don't matter.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetloom.llm.common import materialise

BUCKETS, SMOOTHING, THRESHOLD = 1 << 15, 0.5, -0.2
#: Bitmaps of target ids, of 4 KB each, that may be sent to every executor: 16 MB.
BITMAPS = 1 << 12
MIN_WORDS, REPEAT_PERCENT, WINDOW = 10, 20, 5
SYMBOLS, SPACES = "#*$%&|<>", " \t\n\x0b\f\r"


def once(value: Column) -> Column:
    """The value, in a projection that filters aren't pushed below: copied into a filter, the nested arrays would be computed for each element."""
    return F.when(F.spark_partition_id() >= 0, value)


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def _without(text: Column, chars: str) -> Column:
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _word_bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def _pair_bucket(a: Column, b: Column) -> Column:
    return F.pmod(F.xxhash64(a, b), F.lit(BUCKETS)).cast("int") + BUCKETS


def _windows(width: int) -> Column:
    """Each word with those after it, as a struct; the last ones have nulls for words past the end."""
    return F.arrays_zip("ws", *(F.slice("ws", k + 1, F.size("ws")).alias(f"w{k}") for k in range(1, width)))


def target_ids(labels: DataFrame) -> DataFrame:
    """Ids of the trusted target, each once."""
    return labels.filter((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()


def _marked(docs: DataFrame, target: DataFrame) -> DataFrame:
    """docs (doc_id, text) with _good, 1 in the target and else 0; the same rows whichever way they are joined.

    Whole ids become bitmaps of 32,768 ids in 4 KB each, written as a table and counted: up to BITMAPS of them are broadcast, and texts stay where they are.
    Beyond that, or with other ids, ids and texts meet by an exchange, hashed, so that texts aren't sorted.
    """
    whole = {"tinyint", "smallint", "int", "bigint"}
    if dict(docs.dtypes)["doc_id"] in whole and dict(target.dtypes)["doc_id"] in whole:
        bits = target.groupBy(F.bitmap_bucket_number(F.col("doc_id").cast("long")).alias("_range")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("doc_id").cast("long"))).alias("_bits"))
        bits = materialise(bits, "rules-target")
        if bits.count() <= BITMAPS:
            own = F.col("doc_id").cast("long")
            met = docs.join(F.broadcast(bits), F.bitmap_bucket_number(own) == F.col("_range"), "left")
            at = F.bitmap_bit_position(own)
            byte = F.conv(F.hex(F.substring("_bits", F.shiftright(at, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
            good = byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), (at % 8).cast("int"))) != 0
            return met.select("doc_id", "text", F.when(good, 1).otherwise(0).alias("_good"))
    mark = target.select("doc_id", F.lit(1).alias("_good"))
    return docs.join(mark.hint("shuffle_hash"), "doc_id", "left").select("doc_id", "text", F.coalesce("_good", F.lit(0)).alias("_good"))


def ratios(docs: DataFrame, target: DataFrame) -> list[float]:
    """log(target / raw) of each bucket, words first and then pairs; docs: (doc_id, text)."""
    marked = _marked(docs, target).select("_good", words(F.col("text")).alias("ws"))
    # One explode gives a word's own bucket and that of its pair, so texts are read and exchanged once.
    pairs = marked.select("_good", F.explode(_windows(2)).alias("p"))
    both = F.array(_word_bucket(F.col("p.ws")), F.when(F.col("p.w1").isNotNull(), _pair_bucket(F.col("p.ws"), F.col("p.w1"))))
    hashed = pairs.select("_good", F.explode(both).alias("b")).filter("b IS NOT NULL")
    found = hashed.groupBy("b").agg(F.count(F.lit(1)), F.sum("_good")).collect()  # 2 * BUCKETS rows at most
    raw, good = [0] * (2 * BUCKETS), [0] * (2 * BUCKETS)
    for b, n, g in found:
        raw[b], good[b] = n, g
    out = []
    for half in (slice(0, BUCKETS), slice(BUCKETS, 2 * BUCKETS)):
        r, g = raw[half], good[half]
        part = sum(g) / max(1, sum(r))  # what the target would have of a bucket if it were like the corpus
        shrink = SMOOTHING * sum(g) / BUCKETS or 1.0  # without a target, any
        out += [round(math.log((y + shrink) / (x * part + shrink)), 4) for x, y in zip(r, g, strict=True)]
    return out


def base_counts(docs: DataFrame) -> DataFrame:
    """From (doc_id, text) to doc_id, ws, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = F.col("text")
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    df = docs.select("doc_id", "text", words(text).alias("ws"), lines.alias("_lines"))
    df = df.select("*", _windows(WINDOW).alias("_windows"))
    df = df.select(
        "doc_id",
        "ws",
        F.size("ws").cast("long").alias("n_words"),
        F.length(_without(text, SPACES)).cast("long").alias("word_chars"),
        (F.octet_length(text) - F.octet_length(_without(text, SYMBOLS))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.transform(F.slice("_windows", 1, F.greatest(F.size("ws") - (WINDOW - 1), F.lit(0))), lambda w: F.xxhash64(w)).alias("_hashes"),
    )
    # Only texts with a repeated window pay for the sort that finds which.
    repeated = F.size("_hashes") > F.size(F.array_distinct("_hashes"))
    placed = F.when(repeated, F.sort_array(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("p")))))
    df = df.withColumn("_sorted", placed).drop("_hashes")
    of = lambda k: F.get("_sorted", k)["h"]
    starts = F.filter("_sorted", lambda x, k: x["h"].eqNullSafe(of(k + 1)) | (F.when(k > 0, x["h"].eqNullSafe(of(k - 1))).otherwise(F.lit(False))))
    df = df.withColumn("_starts", F.sort_array(F.transform(starts, lambda x: x["p"]))).drop("_sorted")
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    step = lambda acc, p: F.struct((p + WINDOW).alias("end"), (acc["n"] + (p + WINDOW - F.greatest(acc["end"], p))).alias("n"))
    covered = F.aggregate("_starts", zero, step, lambda acc: acc["n"])
    return df.withColumn("n_repeat_words", once(F.coalesce(covered, F.lit(0)).cast("long"))).drop("_starts")


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, the five counts, base_failed, kept, llr."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    table = ratios(own, target_ids(labels))
    ratio = F.split(F.lit(",".join(map(str, table))), ",").cast("array<double>")  # folded to a literal
    df = base_counts(own)
    look = lambda at: F.get(ratio, at)
    both = lambda acc, w: acc + look(_word_bucket(w["ws"])) + F.when(w["w1"].isNull(), F.lit(0.0)).otherwise(look(_pair_bucket(w["ws"], w["w1"])))
    total = F.aggregate(_windows(2), F.lit(0.0), both)
    n = F.size("ws")
    llr = F.when(n > 0, total / (F.lit(2.0) * n - 1)).otherwise(F.lit(0.0))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    df = df.withColumn("base_failed", failed).withColumn("llr", once(llr))
    kept = ~F.col("base_failed") & (F.col("llr") >= THRESHOLD)
    return df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "llr")
