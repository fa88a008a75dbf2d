"""Reading what was captured: the index, bodies, sourcemaps, files, and streams of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assetloom.operators.captures import INLINE_MAP, source_map_ref
from assetloom.schemas import CAPTURES, ENTRY, INDEX_FIELDS


def _entries() -> Column:
    """The array in an index file, or null; a lone object would be read as an array of one."""
    return F.when(F.ltrim("value").startswith("["), F.from_json("value", f"array<{ENTRY}>"))


def parse_index(texts: DataFrame) -> DataFrame:
    """From (value), whole index files, to assets with their place in the array. What is no array has no rows."""
    rows = texts.select(F.posexplode(_entries()).alias("pos", "e")).filter("e IS NOT NULL")
    out = rows.select(F.col("pos").cast("long").alias("pos"), "e.*").withColumn("asset_type", F.coalesce("asset_type", F.lit("js")))
    return out.select(F.concat_ws(":", "asset_type", "sha256").alias("asset_id"), "pos", *INDEX_FIELDS)


def read_index(spark: SparkSession, path: str, last_good: DataFrame | None = None) -> DataFrame:
    """Assets of an index file; the last good table if it can't be read or holds no array."""
    try:
        texts = spark.read.text(path, wholetext=True)
        if last_good is not None and texts.filter(_entries().isNotNull()).isEmpty():
            return last_good
        return parse_index(texts)
    except Exception:  # the path isn't there
        if last_good is None:
            raise
        return last_good


def read_captures(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    return spark.read.schema(CAPTURES).format(format).load(path)


def stream_captures(spark: SparkSession, path: str, format: str = "parquet", files: int = 200) -> DataFrame:
    """A stream of capture files; ``files`` a batch is the bounded queue, and nothing is dropped."""
    return spark.readStream.schema(CAPTURES).format(format).option("maxFilesPerTrigger", files).load(path)


def read_bodies(spark: SparkSession, path: str) -> DataFrame:
    """(path, source) of text files under a path or glob; names as Spark gives them, without the scheme."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return rows.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), F.decode("content", "UTF-8").alias("source"))


def with_bodies(assets: DataFrame, bodies: DataFrame, deobfuscated: DataFrame | None = None) -> DataFrame:
    """Adds file_path and source: the deobfuscated text, else the beautified file, else the raw one. Pages aren't read. Assets with no readable body go.

    The path is chosen by name alone, so that each body is exchanged once.
    """
    code = assets.filter("asset_type <> 'html'")
    wanted = code.select("asset_id", "pos", F.posexplode(F.array("beautified_path", "raw_path")).alias("_order", "path")).filter("coalesce(path, '') <> ''")
    there = bodies.filter("source <> ''")
    chosen = wanted.join(there.select("path"), "path", "left_semi").groupBy("asset_id", "pos").agg(F.min_by("path", "_order").alias("_at"))
    texts = there.select(F.col("path").alias("_at"), F.col("source").alias("_text"))
    out = code.join(chosen, ["asset_id", "pos"]).join(texts, "_at").select(*code.columns, F.col("_at").alias("file_path"), F.col("_text").alias("source"))
    if deobfuscated is None:
        return out
    better = deobfuscated.select("asset_id", F.col("source").alias("_better"), F.col("file_path").alias("_path")).filter("coalesce(_better, '') <> ''")
    out = out.join(better, "asset_id", "left")
    return out.withColumns({"source": F.coalesce("_better", "source"), "file_path": F.coalesce("_path", "file_path")}).drop("_better", "_path")


def safe_name(name: Column) -> Column:
    return F.regexp_replace(name, "[^a-zA-Z0-9._-]+", "_")


def inline_map(ref: Column) -> Column:
    """The JSON text of an inline sourcemap, or null."""
    return F.when(ref.startswith(INLINE_MAP), F.decode(F.try_to_binary(F.substring(ref, len(INLINE_MAP) + 1, 1 << 30), F.lit("base64")), "UTF-8"))


def sourcemaps(sources: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """(asset_id, pos, map_id, raw) of assets that name a sourcemap: inline, else the captured file. The network isn't asked.

    sources: asset_id, pos, sha256, source, sourcemap_ref, sourcemap_path. files: path, source.
    """
    ref = F.coalesce(F.nullif(source_map_ref(F.col("source"), every=False), F.lit("")), F.nullif("sourcemap_ref", F.lit("")))
    rows = sources.withColumn("_ref", ref).filter("_ref IS NOT NULL").withColumn("raw", inline_map(F.col("_ref")))
    if files is not None:
        rows = rows.join(files.select(F.col("path").alias("sourcemap_path"), F.col("source").alias("_file")), "sourcemap_path", "left").withColumn("raw", F.coalesce("raw", "_file"))
    return rows.filter("raw IS NOT NULL").select("asset_id", "pos", F.substring("sha256", 1, 16).alias("map_id"), "raw")


def resolved_sources(maps: DataFrame) -> DataFrame:
    """(asset_id, pos, file_path, source): the original files that sourcemaps carry, under safe names."""
    parsed = F.from_json("raw", "sources array<string>, sourcesContent array<string>")
    pair = F.arrays_zip(F.col("m.sources").alias("name"), F.slice("m.sourcesContent", 1, F.size("m.sources")).alias("source"))
    rows = maps.withColumn("m", parsed).filter("m.sources IS NOT NULL AND m.sourcesContent IS NOT NULL").select("asset_id", "pos", "map_id", F.posexplode(pair).alias("n", "s"))
    name = F.coalesce(F.nullif("s.name", F.lit("")), F.concat(F.lit("source-"), F.col("n").cast("string"), F.lit(".js")))
    return rows.filter("coalesce(s.source, '') <> ''").select("asset_id", "pos", F.concat_ws("/", F.lit("resolved"), "map_id", safe_name(name)).alias("file_path"), F.col("s.source").alias("source"))
