"""Exact dedup by content sort, in DataFrame operations only.

Sampled splitters range-partition the normalised bytes (by their first LEAD characters, then a hash, so that the
sample which the driver draws the splitters from stays small), the external sort inside each range places equal
texts side by side, and the window operator walks the sorted rows comparing each text in full with its
neighbour; the smallest identifier of a run stays.

A text with very many copies would fill one range. Copies are therefore counted first by a 64-bit hash (a
partial aggregate, sixteen bytes a text). A hash with over ``rows / (SPLIT * partitions)`` copies is hot; by the
pigeonhole principle at most ``SPLIT * partitions`` are. A hot text gets a salt in its sort key, so that its run
spreads over several ranges, and one representative of each salted run takes part in a second, small
comparison of full texts.

Defined results: a null text counts as the empty text. A null id sorts after all others; a group of null ids
has a null ``keep_id``. Of repeated rows with equal id and text exactly one has ``kept`` true. An empty table gives an
empty result. Columns other than the id and the text are ignored unless ``carry`` asks for whole rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assetloom.llm.common import materialise

#: A text is hot when its copies exceed this fraction of an average range.
SPLIT = 4
#: Characters of a text in the key of the ranges.
LEAD = 32


def normalised(text: Column) -> Column:
    """Each run of ``[\\x20\\x09-\\x0D]`` becomes one space; a lone space already is one and is not matched."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def hot_texts(base: DataFrame) -> DataFrame:
    """(hash, salts) of the texts whose copies would overfill a range; at most SPLIT * partitions rows."""
    partitions = int(base.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = base.groupBy("_hash").agg(F.count(F.lit(1)).alias("_copies"))
    counts = counts.filter("_copies > 1")
    limit = F.greatest(F.lit(8.0), F.lit(base.count()) / (SPLIT * partitions))
    return counts.filter(F.col("_copies") > limit).select("_hash", F.ceil(F.col("_copies") / limit).cast("int").alias("_salts"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256 (and ``row``, the whole input row, with ``carry``)."""
    picked = [F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("_norm")]
    picked += [F.struct(*[docs[c] for c in docs.columns]).alias("row")] if carry else []
    base = docs.select(*picked).withColumn("_hash", F.xxhash64("_norm"))
    hot = materialise(hot_texts(base), "exact-hot")

    # The bound of hot_texts makes this broadcast safe at any input size.
    salted = base.join(F.broadcast(hot), "_hash", "left").withColumn(
        "_salt", F.when(F.col("_salts").isNotNull(), F.pmod(F.xxhash64("doc_id", F.spark_partition_id()), F.col("_salts"))).otherwise(F.lit(0)).cast("int")
    )
    ranged = salted.withColumn("_lead", F.substring("_norm", 1, LEAD)).repartitionByRange(F.col("_lead"), F.col("_hash"), F.col("_salt"))
    run = Window.partitionBy("_norm", "_salt", "_lead", "_hash")
    ordered = run.orderBy(F.col("doc_id").asc_nulls_last())
    extra = ["row"] if carry else []
    runs = ranged.select(
        "doc_id",
        "_salt",
        F.col("_salts").isNotNull().alias("_hot"),
        F.first("doc_id").over(ordered).alias("keep_id"),
        F.count(F.lit(1)).over(run).alias("group_size"),
        F.row_number().over(ordered).alias("_at"),
        "_norm",
        F.sha2("_norm", 256).alias("text_sha256"),
        *extra,
    )
    out = ["doc_id", "keep_id", "group_size", "kept", "text_sha256", *extra]
    if hot.isEmpty():
        return runs.withColumn("kept", F.col("_at") == 1).select(*out)

    runs = runs.withColumn("_norm", F.when(F.col("_hot") & (F.col("_at") == 1), F.col("_norm")))
    runs = materialise(runs, "exact-runs")
    text = Window.partitionBy("_norm")
    first = F.struct(F.col("keep_id").isNull(), F.col("keep_id"), F.col("_salt"))
    heads = runs.filter(F.col("_norm").isNotNull()).select(
        "text_sha256",
        "_salt",
        F.min(first).over(text).getField("keep_id").alias("_keep"),
        F.min(first).over(text).getField("_salt").alias("_first"),
        F.sum("group_size").over(text).alias("_size"),
    )
    # One row for each salted run: at most twice SPLIT * partitions.
    joined = runs.join(F.broadcast(heads), ["text_sha256", "_salt"], "left")
    in_hot = F.col("_first").isNotNull()
    return joined.select(
        "doc_id",
        F.when(in_hot, F.col("_keep")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.when(in_hot, F.col("_size")).otherwise(F.col("group_size")).alias("group_size"),
        ((F.col("_at") == 1) & (~in_hot | (F.col("_salt") == F.col("_first")))).alias("kept"),
        "text_sha256",
        *extra,
    )


ORACLE_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM n
"""
