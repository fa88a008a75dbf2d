"""Facts to findings, words, call graph and traces: projections only, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetloom.functions import text as T
from assetloom.sources.rules import Rule

META = "map<string,string>"
#: Above the number of findings that a fact can give: a few, and one for each rule.
ORDER = 1 << 32


def _finding(bucket: str, kind: str, label: Column, detail: Column | None = None, meta: Column | None = None) -> Column:
    null = lambda kind: F.lit(None).cast(kind)
    return F.struct(
        F.lit(kind).alias("kind"), F.lit(bucket).alias("bucket"), label.alias("label"), (null("string") if detail is None else detail).alias("detail"), (null(META) if meta is None else meta).alias("meta")
    )


def of_literal(value: Column, quirks: str = T.INTENDED, rules: list[Rule] | None = None, quasi: bool = False) -> Column:
    """All findings of a string literal, or of a template's piece (which is never a URL or a path), in order, as an array."""
    url, path = T.is_url(value), T.is_path(value) & ~T.is_url(value)
    host, mime, ext, query = T.is_hostname(value), T.is_mime(value), T.extension(value, quirks), T.graphql(value, quirks)
    why, short = T.secret_reason(value, quirks), T.truncated(value)
    named = url | path if quasi else url | path | host | mime
    found = []
    if not quasi:
        pathname, kind = T.url_pathname(value), T.path_type(value)
        found += [
            F.when(url, _finding("urls", "url", value)),
            F.when(url & pathname.isNotNull(), _finding("paths", "path", pathname, F.lit("url-path"), F.create_map(F.lit("path_type"), F.lit("url")))),
            F.when(path, _finding("paths", "path", value, kind, F.create_map(F.lit("path_type"), kind))),
        ]
    found += [
        F.when(host, _finding("hostnames", "hostname", value)),
        F.when(ext.isNotNull(), _finding("extensions", "extension", ext, value)),
        F.when(mime, _finding("mime_types", "mime", value)),
        F.when(query.isNotNull(), _finding("graphql", "graphql", query, short)),
        F.when(why.isNotNull(), _finding("secrets", "secret", F.concat(short, F.lit(" ("), why, F.lit(")")), value)),
        F.when(why.isNull() & ~named & T.is_data(value), _finding("data", "data", short)),
    ]
    found += [F.when(value.rlike(r.java), _finding("signatures", r.kind or "signature", F.lit(r.label or r.id), short)) for r in rules or []]
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def literal_words(value: Column) -> Column:
    """Words of a literal: itself, its path's segments, and the names of its parameters."""
    pathlike = F.when(T.is_url(value) | T.is_path(value), T.path_words(value)).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.filter(F.array(value), T.is_word), pathlike, F.filter(T.query_params(value), T.is_word)))


def findings(facts: DataFrame, quirks: str = T.INTENDED, rules: list[Rule] | None = None) -> DataFrame:
    label, detail, name, what = (F.col(c) for c in ("label", "detail", "to_name", "what"))
    kinds = {"endpoints": "endpoint", "sinks": "sink", "user_sinks": "user_sink", "events": "event", "regexes": "regex", "frameworks": "framework", "dependencies": "dependency", "schemas": "schema", "cookies": "cookie"}
    kind = F.coalesce(F.create_map(*(F.lit(x) for kv in kinds.items() for x in kv))[F.col("bucket")], F.col("bucket"))
    meta = F.when(F.col("auth").isNotNull(), F.create_map(F.lit("auth"), F.col("auth")))
    plain = F.array(F.struct(kind.alias("kind"), F.col("bucket"), label, detail, meta.alias("meta")))
    flag = F.array(_finding("feature_flags", "feature_flag", label, detail))
    tagged = F.array(_finding("graphql", "graphql", F.coalesce(T.graphql(label, quirks), F.lit("graphql:tagged")), T.truncated(label)))
    secret = F.array(_finding("secrets", "secret", F.concat(T.truncated(label), F.lit(" ("), detail, F.lit(")")), label))
    rows = (
        F.when(what == "finding", plain)
        .when(what == "literal", of_literal(label, quirks, rules))
        .when(what == "quasi", of_literal(label, quirks, rules, quasi=True))
        .when(what == "tagged", tagged)
        .when((what == "named") & T.is_secret_name(name) & T.is_sensitive_literal(label, quirks), secret)
        .when((what == "flag_name") & T.is_flag_name(label), flag)
        .when((what == "flag_path") & T.is_flag_path(label, quirks), flag)
        .when((what == "flag_call") & T.is_flag_call(name), flag)
        .when((what == "flag_toggled") & T.is_flag_container(name), flag)
        .when((what == "flag_inside") & T.is_flag_container(name) & T.is_flag_name(label), flag)
    )
    out = facts.select("asset_id", "pos", "file_path", F.col("ord").alias("_at"), "line", "col", F.posexplode(rows).alias("_n", "f"))
    return out.select("asset_id", "pos", "file_path", "f.kind", "f.bucket", "f.label", "f.detail", "line", "col", "f.meta", (F.col("_at").cast("long") * ORDER + F.col("_n")).alias("ord"))


def words(facts: DataFrame) -> DataFrame:
    """(asset_id, word), each once."""
    label, what = F.col("label"), F.col("what")
    found = F.when((what == "word") & T.is_word(label), F.array(label)).when(what == "literal", literal_words(label)).when(what == "quasi", T.path_words(label))
    return facts.select("asset_id", F.explode(found).alias("word")).distinct()


def call_graph(facts: DataFrame) -> DataFrame:
    return facts.filter("what = 'edge'").select("asset_id", F.col("label").alias("caller"), F.col("to_name").alias("callee"), "file_path", "line", "col", "ord")


def traces(facts: DataFrame) -> DataFrame:
    names = {"label": "source_label", "detail": "source_kind", "line": "source_line", "col": "source_col", "to_name": "sink_label", "to_line": "sink_line", "to_col": "sink_col"}
    return facts.filter("what = 'trace'").select("asset_id", "file_path", *(F.col(k).alias(v) for k, v in names.items()), "path", "ord")
