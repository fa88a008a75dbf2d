"""Named views over a snapshot, and table functions for SQL.

Views with a limit are top-k reports: an order and a limit, which Spark runs without a full sort.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from assetloom.sources.writers import by_locale, in_order

OVERVIEW, WORDS = 10, 200


def views(snapshot: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Overview lists of ten, the first 200 words, findings by label, calls by caller, and counts."""
    o, f = in_order(snapshot), snapshot["findings"]
    top = lambda bucket: f.filter(F.col("bucket") == bucket).orderBy("pos", "ord").limit(OVERVIEW)
    out = {f"top_{b}": top(b) for b in ("endpoints", "secrets", "sinks", "user_sinks")}
    out |= {f"top_{t}": o[t].limit(OVERVIEW) for t in ("triage", "alerts", "coverage")}
    out["words"] = snapshot["wordlist"].orderBy("word").limit(WORDS)
    out["findings_by_label"] = f.orderBy("bucket", by_locale("label"), "pos", "ord")
    out["calls_by_caller"] = snapshot["calls_by_caller"].orderBy("caller")
    out["counts"] = snapshot["view_counts"]
    return out


def assets_of_route(snapshot: dict[str, DataFrame], route: str) -> DataFrame:
    return snapshot["routes"].filter(F.col("route") == route).orderBy("first_pos")


def create_views(snapshot: dict[str, DataFrame], prefix: str = "") -> None:
    """Temporary views of every table, for SQL."""
    for name, df in snapshot.items():
        df.createOrReplaceTempView(f"{prefix}{name}")


def register_table_functions(spark: SparkSession) -> None:
    """js_tokens(source) and js_facts(source), for use with LATERAL."""

    @udtf(returnType="ord int, kind string, text string, lines int")
    class Tokens:
        def eval(self, source: str):
            from assetloom.functions.js.beautify import tokenize

            for n, t in enumerate(tokenize(source or "")):
                yield n, t.kind, t.text, t.lines

    @udtf(returnType="ord int, what string, bucket string, label string, detail string, line int, col int")
    class Facts:
        def eval(self, source: str):
            from assetloom.functions.js.facts import extract

            for n, f in enumerate(extract(source or "")):
                yield n, f.what, f.bucket, f.label, f.detail, f.line, f.col

    spark.udtf.register("js_tokens", Tokens)
    spark.udtf.register("js_facts", Facts)
