"""Captured responses: classification, derived columns, and content-keyed upserts with their observations. Native expressions throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assetloom.config import EngineConfig
from assetloom.functions import text as T
from assetloom.functions import urls

# Fixed values.
JS_WORDS = ("function", "=>", "var ", "let ", "const ", "import ", "export ", "require(", "define(")
PAGE_SUFFIXES = ("html", "htm", "jsp", "jspx", "jspf", "php", "asp", "aspx")
CHUNK_MARKS = ("chunk", "static/js", "webpack", "lazy")
CHUNK_NAMES = ("{}.js", "{}.chunk.js", "static/js/{}.js", "static/js/{}.chunk.js")
SAMPLE_CHARS, SLUG_CHARS = 10_000, 80
SOURCE_MAP, INLINE_MAP = "sourceMappingURL=", "data:application/json;base64,"


def header(headers: Column, name: str) -> Column:
    """The value of the first header of that name, or the empty string."""
    hit = F.get(F.filter(headers, lambda h: F.lower(h).startswith(f"{name.lower()}:")), 0)
    return F.coalesce(F.trim(F.regexp_replace(hit, r"(?s)^[^:]*:", "")), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))


def looks_like_page(sample: Column) -> Column:
    low = F.lower(F.substring(sample, 1, SAMPLE_CHARS))
    both = lambda a, b: low.contains(a) & low.contains(b)
    return low.contains("<!doctype html") | low.contains("<html") | both("<head", "<body") | both("<script", "</script")


def looks_like_js(sample: Column) -> Column:
    part = F.substring(sample, 1, SAMPLE_CHARS)
    low = F.lower(part)
    page = low.contains("<!doctype html") | low.contains("<html") | (low.contains("<head") & low.contains("<body"))
    return ~page & (sum((part.contains(w).cast("int") for w in JS_WORDS), F.lit(0)) >= 2)


def is_page_path(path: Column) -> Column:
    return F.lower(path).rlike(rf"\.(?:{'|'.join(PAGE_SUFFIXES)})\z")


def is_javascript(content_type: Column, path: Column, sample: Column) -> Column:
    """The stricter order for a fetched chunk: a style sheet or a page by name is never code."""
    low, name = F.lower(F.coalesce(content_type, F.lit(""))), F.lower(F.coalesce(path, F.lit("")))
    return F.when(low.contains("css"), False).when(low.contains("javascript") | name.rlike(r"\.m?js\z"), True).when(name.endswith(".css") | is_page_path(name), False).otherwise(looks_like_js(sample))


def is_minified(body: Column) -> Column:
    """A line of over 200 characters, and under a fifth of white space."""
    lines = F.split(body, r"\r\n|[\n\r\x0B\f\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]")
    white = F.length(body) - F.length(F.translate(body, " \t\n\r", ""))
    return F.exists(lines, lambda line: F.length(line) > 200) & (white / F.greatest(F.length(body), F.lit(1)) < 0.2)


def latin(body: Column) -> Column:
    """Bytes as characters, one for one."""
    return F.decode(body, "ISO-8859-1")


def classify(captures: DataFrame, config: EngineConfig = EngineConfig(), scope: DataFrame | None = None) -> DataFrame:
    """Captures that are code or pages, with asset_type; the first matching rule holds. scope: (host) of what to keep, with ``only_in_scope``."""
    kind, path = F.lower(F.coalesce(F.col("content_type"), F.lit(""))), F.lower(url_path(F.col("url")))
    sample = latin(F.substring(F.col("body"), 1, config.heuristic_bytes))
    rows = captures.filter(~(kind.contains("css") | path.endswith(".css")))
    if config.only_in_scope and scope is not None:
        rows = rows.withColumn("_host", F.lower(F.try_parse_url("url", F.lit("HOST")))).join(scope.select(F.lower("host").alias("_host")).distinct(), "_host", "left_semi").drop("_host")
    code = kind.contains("javascript") | path.rlike(r"\.m?js\z") | (~is_page_path(path) & looks_like_js(sample))
    page = F.lit(config.capture_html) & (kind.contains("text/html") | kind.contains("application/xhtml") | is_page_path(path) | looks_like_page(sample))
    return rows.withColumn("asset_type", F.when(F.coalesce(code, F.lit(False)), "js").when(F.coalesce(page, F.lit(False)), "html")).filter("asset_type IS NOT NULL")


def slug(method: Column, url: Column) -> Column:
    host, path = F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")), F.regexp_replace(url_path(url), r"^/+|/+\z", "")
    raw = F.replace(F.concat_ws("_", method, host, path), F.lit(".."), F.lit("_"))
    return F.substring(F.regexp_replace(F.regexp_replace(raw, "[^A-Za-z0-9._-]+", "_"), r"^_+|_+\z", ""), 1, SLUG_CHARS)


def script_sources(html: Column) -> Column:
    found = F.regexp_extract_all(html, F.lit("(?i)<script[^>]+src=[\"']([^\"']+)[\"']"), F.lit(1))
    return F.transform(found, lambda src: F.trim(src))  # trim alone would take the place as its characters


def inline_scripts(html: Column) -> Column:
    return F.regexp_count(html, F.lit("(?i)<script(?![^>]+src=)[^>]*>"))


def source_map_ref(body: Column, every: bool = True) -> Column:
    """The last marker's value up to the end of its line; comment ends are taken out (all, or the first only)."""
    tail = F.regexp_extract(body, rf"(?s)^.*{SOURCE_MAP}([^\r\n]*)", 1)
    return F.trim(F.replace(tail, F.lit("*/"), F.lit("")) if every else F.regexp_replace(tail, r"(?s)^(.*?)\*/", "$1"))


def chunk_names(body: Column, quirks: str = T.INTENDED) -> Column:
    """Names of code chunks that a bundle mentions, sorted. As observed, the patterns only match bodies with stray backslashes, so there are none."""
    if quirks == T.OBSERVED:
        return F.array().cast("array<string>")
    all_of = lambda pattern: F.regexp_extract_all(body, F.lit(pattern), F.lit(1))
    named = F.concat(all_of("webpackChunkName\\s*:\\s*[\"']([^\"']+)[\"']"), F.transform(all_of("__webpack_require__\\.e\\(\\s*([0-9]+|[\"'][^\"']+[\"'])\\s*\\)"), lambda x: F.regexp_replace(x, "^[\"']+|[\"']+\\z", "")))
    spelled = F.flatten(F.transform(named, lambda n: F.array(*(F.concat(F.lit(t.split("{}")[0]), n, F.lit(t.split("{}")[1])) for t in CHUNK_NAMES))))
    listed = F.filter(all_of("[\"']([^\"']+\\.js(?:\\?[^\"']*)?)[\"']"), lambda x: T.has(x, CHUNK_MARKS))
    return F.array_sort(F.array_distinct(F.concat(spelled, listed)))


def derive(captures: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """Adds hash, key, names and what is read off the body."""
    body, js = latin(F.col("body")), F.col("asset_type") == "js"
    none = F.array().cast("array<string>")
    out = captures.withColumn("sha256", F.sha2("body", 256)).withColumn("asset_id", F.concat_ws(":", F.coalesce("asset_type", F.lit("js")), "sha256"))
    tail = slug(F.col("method"), F.col("url"))
    return out.withColumns(
        {
            "base_name": F.when(tail == "", F.col("sha256")).otherwise(F.concat_ws("__", "sha256", tail)),
            "original_filename": F.element_at(F.split(url_path(F.col("url")), "/"), -1),
            "script_srcs": F.when(~js, script_sources(body)),
            "inline_script_count": F.when(~js, inline_scripts(body)),
            "sourcemap_ref": F.when(js & F.lit(config.sourcemaps), source_map_ref(body)),
            "minified": F.when(js, is_minified(body)),
            "chunk_candidates": F.when(js & F.lit(config.chunk_discovery), chunk_names(body, config.quirks)).when(js, none),
        }
    )


def unique_names(rows: DataFrame, folder: str, name: str, order: str) -> DataFrame:
    """Adds unique_name: the name, with -1, -2, ... for later rows of the same folder and name."""
    nth = F.row_number().over(Window.partitionBy(folder, name).orderBy(order)) - 1
    return rows.withColumn("unique_name", F.when(nth == 0, F.col(name)).otherwise(F.concat_ws("-", F.col(name), nth.cast("string"))))


def upsert(captures: DataFrame) -> DataFrame:
    """One row for each asset_id: the first capture's columns, the last one's status and content type, and the last referer, host and path that aren't empty.

    Minima and maxima by (ts, capture_id), so they are aggregated before the shuffle and a body seen by most captures is no hot spot.
    """
    at = F.struct("ts", "capture_id")
    first = lambda c: F.min_by(c, at)
    kept = lambda c: F.coalesce(F.max_by(c, F.when(F.coalesce(F.col(c), F.lit("")) != "", at)), F.lit(""))
    fixed = [c for c in ("url", "method", "asset_type", "sha256", "base_name", "original_filename", "script_srcs", "inline_script_count", "sourcemap_ref", "minified", "chunk_candidates") if c in captures.columns]
    return captures.groupBy("asset_id").agg(
        *(first(c).alias(c) for c in fixed),
        *(kept(c).alias(c) for c in ("referer", "host", "path")),
        F.max_by("status_code", at).alias("status_code"),
        F.max_by("content_type", at).alias("content_type"),
        F.min("ts").alias("first_seen"),
        F.max("ts").alias("last_seen"),
        F.count(F.lit(1)).alias("seen_count"),
    )


def observations(captures: DataFrame, quirks: str = T.INTENDED) -> DataFrame:
    """One row for each asset_id, method, url and referer. As observed, an asset's first capture has no key and a row of its own."""
    at = F.struct("ts", "capture_id")
    rows = captures.withColumn("referer", F.coalesce("referer", F.lit("")))
    key = F.concat_ws("|", "method", "url", "referer")
    group = ["asset_id", "method", "url", "referer"]
    if quirks == T.OBSERVED:
        first = rows.groupBy("asset_id").agg(F.min(at).alias("_first"))
        rows = rows.join(first, "asset_id").withColumn("_alone", at == F.col("_first"))
        key, group = F.when(~F.col("_alone"), key), [*group, "_alone"]
    return rows.withColumn("key", key).groupBy(*group, "key").agg(
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count(F.lit(1)).alias("count"), F.max_by("status_code", at).alias("status_code"), F.max_by("content_type", at).alias("content_type")
    ).select("asset_id", "key", "url", "method", "referer", "first_seen", "last_seen", "count", "status_code", "content_type")


def index(captures: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """Classified captures to the asset index, observations nested by first sight."""
    rows = derive(classify(captures, config), config)
    seen = observations(rows, config.quirks).groupBy("asset_id").agg(F.array_sort(F.collect_list(F.struct("first_seen", "key", "url", "method", "referer", "last_seen", "count", "status_code", "content_type"))).alias("observations"))
    return upsert(rows).join(seen, "asset_id", "left")


def chunk_plan(assets: DataFrame, seen: DataFrame, config: EngineConfig = EngineConfig(), same_origin: bool = True) -> DataFrame:
    """(asset_id, candidate): chunks worth fetching, by name, at most ``chunk_limit`` an asset. Nothing is fetched."""
    rows = assets.select("asset_id", "url", F.explode("chunk_candidates").alias("_name"))
    rows = rows.withColumn("candidate", urls.resolve_url(F.col("url"), F.col("_name"))).filter("candidate <> ''")
    rows = rows.join(seen.select(F.col("url").alias("candidate")).distinct(), "candidate", "left_anti")
    if same_origin:
        rows = rows.filter(urls.same_origin(F.col("url"), F.col("candidate")))
    nth = F.row_number().over(Window.partitionBy("asset_id").orderBy("candidate"))
    return rows.dropDuplicates(["asset_id", "candidate"]).withColumn("_nth", nth).filter(F.col("_nth") <= config.chunk_limit).select("asset_id", "candidate")


def admitted(captures: DataFrame, limit: int, window: str = "1 minute") -> DataFrame:
    """The first ``limit`` captures of each window of time: the bounded queue, as an operator."""
    nth = F.row_number().over(Window.partitionBy(F.window(F.to_timestamp("ts"), window)).orderBy("ts", "capture_id"))
    return captures.withColumn("_nth", nth).filter(F.col("_nth") <= limit).drop("_nth")
