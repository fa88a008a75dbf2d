"""Outputs: lists, JSON, CSV, SARIF and a report with exact names and formats, from small ordered tables; Parquet for every table.

Lines and rows of JSON are formatted by expressions and streamed to the driver in order, a partition at a time, and from there to the file, so a list may be
larger than the driver's memory. A path without a scheme is a file of the driver; one with a scheme goes to the file system that it names.
"""

from __future__ import annotations

import io
import json
import os
from collections.abc import Iterable, Iterator
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assetloom.functions import text as T

TOOL = "script-asset-analytics"
# Buckets with the category and the key that exports give them, in the order of exports.
EXPORTS = (
    ("endpoints", "endpoint", "endpoints"), ("data", "data", "data"), ("paths", "path", "paths"), ("urls", "url", "urls"), ("hostnames", "hostname", "hostnames"), ("extensions", "extension", "extensions"),
    ("mime_types", "mime", "mimeTypes"), ("regexes", "regex", "regexes"), ("graphql", "graphql", "graphql"), ("events", "event", "events"), ("location", "location", "location"), ("storage", "storage", "storage"),
    ("cookies", "cookie", "cookies"), ("document_domain", "document_domain", "documentDomain"), ("window_name", "window_name", "windowName"), ("window_open", "window_open", "windowOpen"),
    ("urlsearchparams", "urlsearchparams", "urlSearchParams"), ("rest_client", "rest_client", "restClient"), ("fetch_options", "fetch_options", "fetchOptions"), ("schemas", "schema", "schemas"),
    ("dependencies", "dependency", "dependencies"), ("feature_flags", "feature_flag", "featureFlags"), ("sinks", "sink", "sinks"), ("user_sinks", "user_sink", "userSinks"), ("secrets", "secret", "secrets"),
    ("frameworks", "framework", "frameworks"), ("signatures", "signature", "signatures"),
)
#: Descriptor lists by file name.
DESCRIPTORS = {
    "data": "data", "paths": "paths", "urls": "urls", "hostnames": "hostnames", "extensions": "extensions", "mime-types": "mime_types", "regex": "regexes", "graphql": "graphql", "events": "events",
    "location": "location", "storage": "storage", "cookies": "cookies", "document-domain": "document_domain", "window-name": "window_name", "window-open": "window_open", "urlsearchparams": "urlsearchparams",
    "rest-client": "rest_client", "fetch-options": "fetch_options", "schemas": "schemas", "dependencies": "dependencies", "feature-flags": "feature_flags",
}
TOP = 10


def now() -> str:
    return datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%S.%f")[:-3] + "Z"


def redacted(findings: DataFrame) -> DataFrame:
    """Secrets as their first four characters, length and hash."""
    secret = F.col("bucket") == "secrets"
    value = T.secret_value(F.col("label"), F.col("detail"))
    shown = F.concat(F.substring(value, 1, 4), F.lit("...["), F.length(value).cast("string"), F.lit(":"), F.substring(F.sha2(value, 256), 1, 12), F.lit("]"))
    return findings.withColumns({"label": F.when(secret, shown).otherwise(F.col("label")), "detail": F.when(secret, shown).otherwise(F.col("detail"))})


def _lines(df: DataFrame) -> Iterator[str]:
    for row in df.toLocalIterator():  # nothing runs before the first line is asked for
        yield row[0]


class _Remote(io.RawIOBase):
    """A new file of any file system that Spark knows."""

    def __init__(self, path: str) -> None:
        spark = SparkSession.active()
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        self._out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self._out.write(bytearray(data))
        return len(data)

    def close(self) -> None:
        if not self.closed:
            self._out.close()
        super().close()


def _opened(path: str) -> io.TextIOBase:
    if "://" in path:
        return io.TextIOWrapper(io.BufferedWriter(_Remote(path), 1 << 20), encoding="utf-8", newline="\n")
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    return open(path, "w", encoding="utf-8", newline="\n")


def write_text(path: str, lines: Iterable[str]) -> str:
    with _opened(path) as file:
        first = True
        for line in lines:
            file.write(line if first else "\n" + line)
            first = False
        file.write("\n")
    return path


def _write_value(file: io.TextIOBase, value: object, pad: str = "") -> None:
    """Writes JSON with an indent of two. An iterator is an array of rows that are JSON already, of which one is held at a time."""
    deeper = pad + "  "
    if isinstance(value, dict):
        marks, items = "{}", ((json.dumps(k, ensure_ascii=False) + ": ", v) for k, v in value.items())
    elif isinstance(value, list):
        marks, items = "[]", (("", v) for v in value)
    elif isinstance(value, Iterator):
        marks, items = "[]", (("", json.loads(row)) for row in value)
    else:
        file.write(json.dumps(value, ensure_ascii=False))
        return
    some = False
    for name, item in items:
        file.write(f"{',' if some else marks[0]}\n{deeper}{name}")
        _write_value(file, item, deeper)
        some = True
    file.write(f"\n{pad}{marks[1]}" if some else marks)


def write_json(path: str, data: object) -> str:
    with _opened(path) as file:
        _write_value(file, data)
    return path


def ordered(df: DataFrame) -> DataFrame:
    return df.orderBy("pos", "ord")


def finding_json() -> Column:
    place = F.when(F.col("line").isNotNull(), F.struct("line", F.col("col").alias("column")))
    return F.to_json(F.struct("kind", "label", "detail", F.col("file_path").alias("filePath"), place.alias("location"), "meta"))


def finding_rows(findings: DataFrame, bucket: str) -> Iterator[str]:
    few = ordered(findings.filter(F.col("bucket") == bucket))
    return _lines(few.select(finding_json()))


def unique_labels(findings: DataFrame, bucket: str, value: Column | None = None) -> DataFrame:
    column = (F.col("label") if value is None else value).alias("v")
    return findings.filter(F.col("bucket") == bucket).select(column).distinct().orderBy("v")


def coverage_line() -> Column:
    return F.format_string("%d\tE:%d\tS:%d\tU:%d\tK:%d\tG:%d\t%s", "total", "endpoints", "sinks", "user_sinks", "secrets", "signatures", "label")


def trace_line() -> Column:
    place = F.concat(F.col("file_path"), F.lit(":"), F.coalesce(F.col("sink_line").cast("string"), F.lit("?")))
    return F.concat_ws("\t", "source_label", "sink_label", place, F.array_join("path", " -> "))


def call_line() -> Column:
    return F.concat_ws("\t", "caller", "callee", F.concat(F.col("file_path"), F.lit(":"), F.coalesce(F.col("line").cast("string"), F.lit("?"))))


def cluster_line() -> Column:
    return F.concat_ws("\t", "base_path", "auth", F.col("endpoints").cast("string"))


def triage_line() -> Column:
    return F.format_string("%s (%d) %s", "severity", "score", "url")


def fetch_line() -> Column:
    return F.concat_ws("\t", "label", F.coalesce("detail", F.lit("")), "file_path")


def by_locale(name: str) -> Column:
    return F.collate(F.col(name), "UNICODE")


def in_order(snapshot: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The snapshot's tables as their outputs list them."""
    s = snapshot
    return {
        "routes": s["routes"].select("route").distinct().orderBy(by_locale("route")),
        "drift": s["drift"].orderBy(by_locale("url")),
        "alerts": s["alerts"].orderBy("severity", by_locale("url")),
        "triage": s["triage"].orderBy(F.col("score").desc(), F.col("total_rank").desc(), "pos") if "total_rank" in s["triage"].columns else s["triage"].orderBy(F.col("score").desc(), "pos"),
        "coverage": s["coverage"].orderBy(F.col("total").desc(), "pos"),
        "clusters": s["clusters"].orderBy(by_locale("base_path"), by_locale("auth")),
        "traces": ordered(s["traces"]) if "pos" in s["traces"].columns else s["traces"].orderBy("asset_id", "ord"),
        "call_graph": ordered(s["call_graph"]) if "pos" in s["call_graph"].columns else s["call_graph"].orderBy("asset_id", "ord"),
        "pages": s["pages"].orderBy(by_locale("url")),
    }


def _records(df: DataFrame) -> Iterator[str]:
    return _lines(df.select(F.to_json(F.struct(*df.columns))))


def write_outputs(folder: str, snapshot: dict[str, DataFrame]) -> list[str]:
    """Every list and JSON file under ``folder``, with the layout of the views; returns the paths."""
    f, o = snapshot["findings"], in_order(snapshot)
    at = lambda *parts: os.path.join(folder, "interesting", *parts)
    lists = {
        ("apis", "endpoints"): unique_labels(f, "endpoints"),
        ("secrets", "secrets"): unique_labels(f, "secrets", T.secret_value(F.col("label"), F.col("detail"))),
        ("sinks", "sinks"): unique_labels(f, "sinks"),
        ("sinks", "user-sinks"): unique_labels(f, "user_sinks"),
        ("signatures", "signatures"): unique_labels(f, "signatures"),
        ("routes", "routes"): o["routes"],
        ("drift", "drift"): o["drift"].select("url"),
        ("triage", "triage"): o["triage"].select(triage_line()),
        ("alerts", "alerts"): o["alerts"].select(F.concat_ws(": ", "severity", "summary")),
        ("coverage", "coverage"): o["coverage"].select(coverage_line()),
        ("clusters", "clusters"): o["clusters"].select(cluster_line()),
        ("flows", "call-graph"): o["call_graph"].select(call_line()),
        ("flows", "traces"): o["traces"].select(trace_line()),
        ("assets", "html"): o["pages"].select(F.concat_ws("\t", "url", F.col("inline_script_count").cast("string"), F.size("script_srcs").cast("string"))),
    }
    for name, bucket in DESCRIPTORS.items():
        lists["descriptors", name] = ordered(f.filter(F.col("bucket") == bucket)).select(fetch_line()) if bucket == "fetch_options" else unique_labels(f, bucket)
    out = [write_text(at(a, f"{b}.txt"), _lines(df)) for (a, b), df in lists.items()]
    found = {("apis", "endpoints"): "endpoints", ("secrets", "secrets"): "secrets", ("sinks", "user-sinks"): "user_sinks", ("signatures", "signatures"): "signatures"}
    found |= {("descriptors", name): bucket for name, bucket in DESCRIPTORS.items()}
    out += [write_json(at(a, f"{b}.json"), finding_rows(f, bucket)) for (a, b), bucket in found.items()]
    tables = {("triage", "triage"): "triage", ("alerts", "alerts"): "alerts", ("coverage", "coverage"): "coverage", ("clusters", "clusters"): "clusters", ("flows", "call-graph"): "call_graph", ("flows", "traces"): "traces", ("drift", "drift"): "drift", ("assets", "html"): "pages"}
    out += [write_json(at(a, f"{b}.json"), _records(o[t])) for (a, b), t in tables.items()]
    out.append(write_json(at("routes", "routes.json"), _records(snapshot["routes"].groupBy("route").agg(F.array_sort(F.collect_list(F.struct("first_pos", "url"))).alias("assets")).orderBy(by_locale("route")))))
    if "sourcemap_graph" in snapshot:
        out.append(write_json(at("sourcemaps", "sourcemap-graph.json"), _records(snapshot["sourcemap_graph"])))
    summary = snapshot["summary"].first()
    out.append(write_json(at("summary.json"), {**(summary.asDict() if summary else {}), "updatedAt": now()}))
    return out


def flat_findings(findings: DataFrame) -> DataFrame:
    """category, label, detail, filePath, line, column, in the order of the exports."""
    rank = F.create_map(*(F.lit(x) for n, (bucket, _, _) in enumerate(EXPORTS) for x in (bucket, n)))
    name = F.create_map(*(F.lit(x) for bucket, category, _ in EXPORTS for x in (bucket, category)))
    rows = findings.withColumn("_rank", rank[F.col("bucket")]).filter("_rank IS NOT NULL").orderBy("_rank", "pos", "ord")
    return rows.select(name[F.col("bucket")].alias("category"), "label", "detail", F.col("file_path").alias("filePath"), "line", F.col("col").alias("column"))


def export_csv(folder: str, findings: DataFrame) -> str:
    rows = flat_findings(findings)
    line = F.concat_ws(",", *(T.csv_field(F.col(c).cast("string")) for c in rows.columns))
    return write_text(os.path.join(folder, "findings.csv"), (x for part in ([",".join(rows.columns)], _lines(rows.select(line))) for x in part))


def export_sarif(folder: str, findings: DataFrame, tool: str = TOOL) -> str:
    rows = flat_findings(findings)
    place = F.struct(
        F.struct(F.struct(F.col("filePath").alias("uri")).alias("artifactLocation"), F.struct(F.coalesce("line", F.lit(1)).alias("startLine"), F.coalesce("column", F.lit(1)).alias("startColumn")).alias("region")).alias("physicalLocation")
    )
    results = _lines(rows.select(F.to_json(F.struct(F.col("category").alias("ruleId"), F.struct(F.col("label").alias("text")).alias("message"), F.array(place).alias("locations")))))
    found = {r[0] for r in rows.select("category").distinct().collect()}  # no more than there are exports
    rules = [category for _, category, _ in EXPORTS if category in found]
    run = {"tool": {"driver": {"name": tool, "rules": [{"id": r, "name": r, "shortDescription": {"text": r}} for r in rules]}}, "results": results}
    return write_json(os.path.join(folder, "findings.sarif"), {"version": "2.1.0", "$schema": "https://json.schemastore.org/sarif-2.1.0.json", "runs": [run]})


def export_json(folder: str, snapshot: dict[str, DataFrame]) -> str:
    o = in_order(snapshot)
    data = {"generatedAt": now(), "findings": {key: finding_rows(snapshot["findings"], bucket) for bucket, _, key in EXPORTS}}
    routes = snapshot["routes"].groupBy("route").agg(F.transform(F.array_sort(F.collect_list(F.struct("first_pos", "url"))), lambda x: x["url"]).alias("assets")).orderBy(by_locale("route"))
    data |= {"routes": _records(routes), "drift": _records(o["drift"]), "alerts": _records(o["alerts"]), "triage": _records(o["triage"]), "coverage": _records(o["coverage"]), "clusters": _records(o["clusters"])}
    data |= {"callGraph": _records(o["call_graph"]), "traces": _records(o["traces"]), "htmlAssets": _records(o["pages"])}
    return write_json(os.path.join(folder, "findings.json"), data)


def export(folder: str, snapshot: dict[str, DataFrame], format: str) -> str:
    if format == "json":
        return export_json(folder, snapshot)
    return {"csv": export_csv, "sarif": export_sarif}[format](folder, snapshot["findings"])


def write_report(path: str, snapshot: dict[str, DataFrame], title: str = "Script Asset Report") -> str:
    """Totals and the first ten of each list, as Markdown."""
    o, f = in_order(snapshot), snapshot["findings"]
    totals = snapshot["coverage"].agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("endpoints", "sinks", "user_sinks", "secrets", "signatures")), F.count(F.lit(1))).first()
    count = lambda name: snapshot[name].count()
    lines = [f"# {title}", "", f"Generated: {now()}", "", "## Summary", ""]
    named = ["Assets analyzed", "HTML assets", "Routes mapped", "Endpoints", "Sinks", "User-controlled sinks", "Secrets", "Signature matches", "Drift entries", "Alerts", "Endpoint clusters", "Flow traces", "Call graph edges"]
    values = [totals[5], count("pages"), o["routes"].count(), *totals[:5], count("drift"), count("alerts"), count("clusters"), count("traces"), count("call_graph")]
    lines += [f"- {n}: {v}" for n, v in zip(named, values, strict=True)]
    top = lambda bucket: _lines(ordered(f.filter(F.col("bucket") == bucket)).limit(TOP).select("label"))
    sections = {
        "Top Triage": _lines(o["triage"].limit(TOP).select(F.format_string("%s (%d) %s (%s)", "severity", "score", "url", "file_path"))),
        "Top Secrets": top("secrets"),
        "Top Endpoints": top("endpoints"),
        "User-Controlled Sinks": top("user_sinks"),
        "Alerts": _lines(o["alerts"].limit(TOP).select(F.concat_ws(": ", "severity", "summary"))),
    }
    for name, items in sections.items():
        lines += ["", f"## {name}", "", *([f"- {x}" for x in items] or ["- (none)"])]
    return write_text(path, lines)


def write_wordlist(path: str, words: DataFrame) -> str:
    return write_text(path, _lines(words.select("word").distinct().orderBy("word")))


def write_tables(folder: str, snapshot: dict[str, DataFrame]) -> None:
    """Every table as Parquet; findings in folders by bucket, so that a view reads its own."""
    for name, df in snapshot.items():
        writer = df.write.mode("overwrite")
        (writer.partitionBy("bucket") if name == "findings" else writer).parquet(f"{folder}/{name}")
