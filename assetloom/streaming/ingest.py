"""Continuous ingestion: captures to an asset index that is merged batch by batch.

The index is a set of mergeable states (first and last captures, counts), so merging two states is the same aggregation as building one, and batches give
what one run over everything gives. A batch writes the states of its own captures and then a marker, so its cost doesn't grow with the index; a batch that is
repeated after a failure overwrites its own files. Readers merge what was written since the last compaction, which every COMPACT-th batch does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from assetloom.config import EngineConfig
from assetloom.operators import captures as C

FIRST = ("url", "method", "asset_type", "sha256", "base_name", "original_filename", "script_srcs", "inline_script_count", "sourcemap_ref", "minified", "chunk_candidates")
COMPACT = 64
KEPT = ("referer", "host", "path")
LAST = ("status_code", "content_type")


def states(rows: DataFrame) -> DataFrame:
    """Derived captures to one state for each asset."""
    at = F.struct("ts", "capture_id")
    return rows.groupBy("asset_id").agg(
        F.min_by(F.struct(*FIRST), at).alias("head"),
        F.min(at).alias("first_at"),
        F.max(at).alias("last_at"),
        F.max_by(F.struct(*LAST), at).alias("tail"),
        *(F.max_by(c, F.when(F.coalesce(c, F.lit("")) != "", at)).alias(c) for c in KEPT),
        *(F.max(F.when(F.coalesce(c, F.lit("")) != "", at)).alias(f"{c}_at") for c in KEPT),
        F.count(F.lit(1)).alias("seen_count"),
    )


def merged(found: DataFrame) -> DataFrame:
    """States of several batches as one for each asset."""
    return found.groupBy("asset_id").agg(
        F.min_by("head", "first_at").alias("head"),
        F.min("first_at").alias("first_at"),
        F.max("last_at").alias("last_at"),
        F.max_by("tail", "last_at").alias("tail"),
        *(F.max_by(c, f"{c}_at").alias(c) for c in KEPT),
        *(F.max(f"{c}_at").alias(f"{c}_at") for c in KEPT),
        F.sum("seen_count").alias("seen_count"),
    )


def index_of(found: DataFrame) -> DataFrame:
    """States as the index's columns, as ``captures.upsert`` gives them."""
    return found.select(
        "asset_id", *(F.col("head")[c].alias(c) for c in FIRST), *(F.coalesce(c, F.lit("")).alias(c) for c in KEPT), *(F.col("tail")[c].alias(c) for c in LAST),
        F.col("first_at.ts").alias("first_seen"), F.col("last_at.ts").alias("last_seen"), "seen_count",
    )


def merged_observations(found: DataFrame) -> DataFrame:
    """Observations of several batches as one for each asset and key."""
    return found.groupBy("asset_id", "key", "url", "method", "referer").agg(
        F.min("first_seen").alias("first_seen"), F.max_by("status_code", "last_seen").alias("status_code"), F.max_by("content_type", "last_seen").alias("content_type"), F.max("last_seen").alias("last_seen"), F.sum("count").alias("count")
    ).select("asset_id", "key", "url", "method", "referer", "first_seen", "last_seen", "count", "status_code", "content_type")


class IndexSink:
    """The tables under a folder: ``<name>/base=<n>`` after a compaction, ``<name>/v=<n>`` for each batch since, and markers of what is complete."""

    def __init__(self, spark: SparkSession, folder: str, config: EngineConfig = EngineConfig(), compact: int = COMPACT) -> None:
        self.spark, self.folder, self.config, self.every = spark, folder.rstrip("/"), config, compact

    def _at(self, name: str):
        """A file system and a path under the folder."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _marks(self, kind: str) -> list[int]:
        fs, path = self._at(kind)
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(path)) if fs.exists(path) else []

    def _mark(self, kind: str, n: int) -> None:
        fs, path = self._at(f"{kind}/{n}")
        fs.create(path, True).close()

    def _remove(self, name: str) -> None:
        fs, path = self._at(name)
        fs.delete(path, True)

    def version(self) -> int | None:
        """The latest complete batch."""
        return max(self._marks("done"), default=None)

    def table(self, name: str) -> DataFrame:
        base = max(self._marks("compacted"), default=None)
        paths = [] if base is None else [f"{self.folder}/{name}/base={base}"]
        paths += [f"{self.folder}/{name}/v={n}" for n in self._marks("done") if base is None or n > base]
        return self.spark.read.parquet(*paths)

    def write(self, batch: DataFrame, batch_id: int) -> None:
        fs, mark = self._at(f"done/{batch_id}")
        if fs.exists(mark):
            return  # complete before a restart
        rows = C.derive(C.classify(batch, self.config), self.config)
        states(rows).write.mode("overwrite").parquet(f"{self.folder}/states/v={batch_id}")
        C.observations(rows).write.mode("overwrite").parquet(f"{self.folder}/observations/v={batch_id}")
        self._mark("done", batch_id)
        if (batch_id + 1) % self.every == 0:
            self.compact(batch_id)

    def compact(self, batch_id: int) -> None:
        """Merges everything up to a batch into new base files.

        What the last compaction left behind stays for readers that have begun; what it had merged itself goes, so neither folders nor markers pile up.
        """
        before = [n for n in self._marks("compacted") if n < batch_id]
        merged(self.table("states")).write.mode("overwrite").parquet(f"{self.folder}/states/base={batch_id}")
        merged_observations(self.table("observations")).write.mode("overwrite").parquet(f"{self.folder}/observations/base={batch_id}")
        self._mark("compacted", batch_id)
        if before:
            # Markers go after what they stand for: a run that stops in between deletes again at the next compaction.
            for n in before[:-1]:
                for kind in (f"states/base={n}", f"observations/base={n}", f"compacted/{n}"):
                    self._remove(kind)
            for n in self._marks("done"):
                if n <= before[-1]:
                    for kind in (f"states/v={n}", f"observations/v={n}", f"done/{n}"):
                        self._remove(kind)

    def index(self) -> DataFrame:
        return index_of(merged(self.table("states")))

    def observations(self) -> DataFrame:
        return merged_observations(self.table("observations"))


def ingest(captures: DataFrame, folder: str, checkpoint: str, config: EngineConfig = EngineConfig(), once: bool = False) -> StreamingQuery:
    """Starts merging a stream of captures; ``once`` stops when what is there is done."""
    sink = IndexSink(captures.sparkSession, folder, config)
    writer = captures.writeStream.foreachBatch(lambda batch, n: sink.write(batch, n)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=config.debounce)).start()


def watch_index(spark: SparkSession, folder: str, changed, checkpoint: str, config: EngineConfig = EngineConfig(), once: bool = False) -> StreamingQuery:
    """Calls ``changed`` with the assets of each index file that appears in a folder; files of one debounce interval come together.

    Files are known by name, so each version of an index is a file of its own.
    """
    from assetloom.sources.index import parse_index

    texts = spark.readStream.format("text").option("wholetext", "true").load(folder)
    writer = texts.writeStream.foreachBatch(lambda batch, n: changed(parse_index(batch))).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=config.debounce)).start()
