"""Roll-ups over assets and findings: plain Catalyst plans, lazy, each a table.

assets: asset_id, pos, url, timestamp, asset_type, sha256, referer, observations, file_path as each needs. findings: see ``schemas``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assetloom.functions import text as T
from assetloom.functions import urls

COUNTED = ("endpoints", "sinks", "user_sinks", "secrets", "signatures")
DRIFTING = ("endpoints", "sinks", "user_sinks", "secrets", "paths", "urls")


def _counts(findings: DataFrame, key: str, buckets: tuple[str, ...] = COUNTED) -> DataFrame:
    few = findings.filter(F.col("bucket").isin(*buckets))
    return few.groupBy(key).agg(*(F.count_if(F.col("bucket") == b).alias(b) for b in buckets))


def coverage(assets: DataFrame, findings: DataFrame) -> DataFrame:
    """Counts of each asset; those without findings have zeros."""
    rows = assets.select("asset_id", "pos", F.col("url").alias("label")).join(_counts(findings, "asset_id"), "asset_id", "left").fillna(0, list(COUNTED))
    return rows.withColumn("total", reduce(lambda a, b: a + b, (F.col(b) for b in COUNTED)))


def coverage_totals(covered: DataFrame) -> DataFrame:
    return covered.agg(F.count(F.lit(1)).alias("assets"), *(F.coalesce(F.sum(b), F.lit(0)).alias(b) for b in (*COUNTED, "total")))


def severity(score: Column) -> Column:
    return F.when(score >= 25, "critical").when(score >= 15, "high").when(score >= 8, "medium").otherwise("low")


def asset_paths(assets: DataFrame) -> DataFrame:
    """(url, file_path): the path of the first asset of each URL."""
    return assets.groupBy("url").agg(F.min_by("file_path", "pos").alias("file_path"))


def triage(covered: DataFrame, assets: DataFrame | None = None) -> DataFrame:
    e, s, u, k, g = (F.col(c) for c in COUNTED)
    e, s, u, k = (F.col(c) for c in ("endpoints", "sinks", "user_sinks", "secrets"))
    both, reached = (k > 0) & (u > 0), (u > 0) & (e > 0)
    score = e + 2 * s + 5 * u + 6 * k + g + F.when(both, 10).otherwise(0) + F.when(reached, 5).otherwise(0)
    why = [(k > 0, "secrets"), (u > 0, "user-controlled sinks"), (s > 0, "sinks"), (e > 0, "endpoints"), (g > 0, "signature matches"), (both, "secret + user sink"), (reached, "user sink + endpoint")]
    rows = covered.filter("total > 0").select("asset_id", "pos", F.col("label").alias("url"), score.alias("score"), F.array_compact(F.array(*(F.when(c, F.lit(w)) for c, w in why))).alias("reasons"))
    rows = rows.withColumn("severity", severity(F.col("score")))
    if assets is None:
        return rows
    return rows.join(asset_paths(assets), "url", "left").withColumn("file_path", F.coalesce("file_path", "url"))


def versions(assets: DataFrame) -> DataFrame:
    """(url, old_id, new_id, from_timestamp, to_timestamp): the last two assets of each URL that has two."""
    latest = Window.partitionBy("url").orderBy(F.coalesce("timestamp", F.lit("")).desc(), F.col("pos").desc())
    last = assets.select("url", "asset_id", "timestamp", "pos", F.row_number().over(latest).alias("_nth")).filter("_nth <= 2")
    pick = lambda c, n: F.max(F.when(F.col("_nth") == n, F.col(c)))
    both = last.groupBy("url").agg(pick("asset_id", 2).alias("old_id"), pick("asset_id", 1).alias("new_id"), pick("timestamp", 2).alias("from_timestamp"), pick("timestamp", 1).alias("to_timestamp"), F.count(F.lit(1)).alias("_n"))
    return both.filter("_n = 2").drop("_n")


def drift_findings(assets: DataFrame, findings: DataFrame) -> DataFrame:
    """Findings of each URL's last version whose label the one before doesn't have in that bucket; repeats within the last stay."""
    pairs = versions(assets)
    few = findings.filter(F.col("bucket").isin(*DRIFTING)).drop("url", "timestamp")
    new = few.join(pairs.select("url", "from_timestamp", "to_timestamp", F.col("new_id").alias("asset_id")), "asset_id")
    old = few.select("asset_id", "bucket", "label").join(pairs.select("url", F.col("old_id").alias("asset_id")), "asset_id").select("url", "bucket", "label").distinct()
    return new.join(old, ["url", "bucket", "label"], "left_anti")


def drift(assets: DataFrame, findings: DataFrame) -> DataFrame:
    """Counts of new findings of each URL that has any."""
    added = drift_findings(assets, findings)
    return added.groupBy("url", "from_timestamp", "to_timestamp").agg(*(F.count_if(F.col("bucket") == b).alias(f"added_{b}") for b in DRIFTING))


def alerts(drifted: DataFrame) -> DataFrame:
    e, s, u, k = (F.col(f"added_{c}") for c in ("endpoints", "sinks", "user_sinks", "secrets"))
    level = F.when((k > 0) & (u > 0), "critical").when((k > 0) | (u > 0), "high").when((s > 0) & (e > 0), "medium").otherwise("low")
    told = [(k, "secrets"), (u, "user sinks"), (s, "sinks"), (e, "endpoints")]
    details = F.array_compact(F.array(*(F.when(n > 0, F.concat(F.lit(f"New {w}: "), n.cast("string"))) for n, w in told)))
    return drifted.filter((e + s + u + k) > 0).select("url", level.alias("severity"), F.concat(F.lit("New findings for "), "url").alias("summary"), details.alias("details"))


def routes(assets: DataFrame) -> DataFrame:
    """(route, asset_id, pos, first_pos): pages and the assets seen from them; of assets with one hash the last, at the place of the first."""
    referers = F.array_union(F.array(F.coalesce("referer", F.lit(""))), F.transform(F.coalesce("observations", F.array().cast(dict(assets.dtypes)["observations"])), lambda o: F.coalesce(o["referer"], F.lit(""))))
    rows = assets.select("asset_id", "pos", "sha256", "url", F.explode(F.filter(F.array_distinct(referers), lambda r: r != "")).alias("route"))
    return rows.groupBy("route", "sha256").agg(F.max_by("asset_id", "pos").alias("asset_id"), F.max_by("url", "pos").alias("url"), F.max("pos").alias("pos"), F.min("pos").alias("first_pos"))


def clusters(findings: DataFrame) -> DataFrame:
    rows = findings.filter("bucket = 'endpoints'").select(T.base_path(F.col("label")).alias("base_path"), F.coalesce(F.col("meta")["auth"], F.lit("none")).alias("auth"))
    return rows.groupBy("base_path", "auth").agg(F.count(F.lit(1)).alias("endpoints"))


def cluster_members(findings: DataFrame) -> DataFrame:
    """Endpoints with the cluster that each is in."""
    auth = F.coalesce(F.col("meta")["auth"], F.lit("none"))
    return findings.filter("bucket = 'endpoints'").withColumns({"base_path": T.base_path(F.col("label")), "auth": auth})


def page_assets(assets: DataFrame) -> DataFrame:
    return assets.filter("asset_type = 'html' AND coalesce(html_path, '') <> ''").select(
        "asset_id", "pos", "url", "html_path", F.coalesce("script_srcs", F.array().cast("array<string>")).alias("script_srcs"), F.coalesce("inline_script_count", F.lit(0)).alias("inline_script_count")
    )


def page_references(pages: DataFrame, *own: str) -> DataFrame:
    """(script_url, page_url), each once: which pages load a script. Columns of ``own`` tell pages with one URL apart. Plain references need no Python."""
    rows = pages.select("url", *(F.col(c).alias(f"_{c}") for c in own), F.explode("script_srcs").alias("src"))
    kept = (F.col(f"_{c}").alias(c) for c in own)
    return rows.select(urls.resolve_url(F.col("url"), F.col("src")).alias("script_url"), F.coalesce("url", F.lit("")).alias("page_url"), *kept).distinct()


def referrers(assets: DataFrame, pages: DataFrame) -> DataFrame:
    """(asset_id, page_url) of the assets that pages load."""
    return assets.select("asset_id", F.col("url").alias("script_url")).join(page_references(pages), "script_url").drop("script_url")


def script_targets(assets: DataFrame, pages: DataFrame, *own: str) -> DataFrame:
    """(page_url, script_url, asset_id): the first asset, not a page, of each script's URL; null if not captured. Columns of ``own`` as in ``page_references``."""
    first = assets.filter("coalesce(asset_type, 'js') <> 'html'").groupBy(F.col("url").alias("script_url")).agg(F.min_by("asset_id", "pos").alias("asset_id"))
    return page_references(pages, *own).join(first, "script_url", "left")


def wordlist(words: DataFrame) -> DataFrame:
    return words.select("word").distinct()


def view_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


def calls_by_caller(call_graph: DataFrame) -> DataFrame:
    return call_graph.groupBy("caller").agg(F.count(F.lit(1)).alias("edges"), F.count_distinct("callee").alias("callees"))


def resolved_stats(findings: DataFrame) -> DataFrame:
    """Four counts for each resolved source file."""
    return _counts(findings, "file_path", COUNTED[:4])


def summary(findings: DataFrame, covered: DataFrame, routed: DataFrame, drifted: DataFrame, clustered: DataFrame, traced: DataFrame, called: DataFrame) -> DataFrame:
    """One row; labels of endpoints, secrets, sinks and signatures count once, the others by rows."""
    once = lambda bucket, value="label": F.count_distinct(F.when(F.col("bucket") == bucket, F.col(value)))
    value = findings.withColumn("_secret", T.secret_value(F.col("label"), F.col("detail")))
    described = ~F.col("bucket").isin(*COUNTED, "frameworks")
    out = value.agg(*(once(b).alias(b) for b in COUNTED if b != "secrets"), once("secrets", "_secret").alias("secrets"), F.count_if(described).alias("descriptors"))
    one = {
        "coverage": covered.agg(F.count(F.lit(1))), "triage": covered.filter("total > 0").agg(F.count(F.lit(1))), "routes": routed.agg(F.count_distinct("route")), "drift": drifted.agg(F.count(F.lit(1))),
        "alerts": alerts(drifted).agg(F.count(F.lit(1))), "clusters": clustered.agg(F.count(F.lit(1))), "traces": traced.agg(F.count(F.lit(1))), "call_graph": called.agg(F.count(F.lit(1))),
    }
    return out.withColumns({name: df.scalar() for name, df in one.items()})
