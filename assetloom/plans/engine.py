"""The engine: assets and bodies to facts, findings and a snapshot of lazy tables.

Facts are written once to the shared folder, since every table is a projection of them; an asset whose hash, rules and analyser are as
before isn't parsed again.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetloom.config import EngineConfig
from assetloom.functions import text as T
from assetloom.functions.rewrite import beautified
from assetloom.operators import captures as C
from assetloom.operators import facts as FA
from assetloom.operators import findings as FI
from assetloom.operators import rollups as R
from assetloom.sources import index as SI
from assetloom.sources.rules import Rule, load_rules

#: Changes when facts change.
ANALYSER = "1"


class Engine:
    def __init__(self, spark: SparkSession, config: EngineConfig = EngineConfig(), rules: list[Rule] | None = None, folder: str | None = None) -> None:
        self.spark, self.config = spark, config
        self.rules = load_rules(spark) if rules is None else rules
        shared = folder or spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            raise ValueError("set spark.checkpoint.dir, or give a folder that all executors share")
        self.folder = f"{shared.rstrip('/')}/engine"

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def facts(self, sources: DataFrame, known: DataFrame | None = None) -> DataFrame:
        """Facts of sources (asset_id, pos, file_path, source), with the version that they are of.

        Known facts of this version are taken over for the assets that sources still have (an id names a text), at the place and path that these have now.
        """
        version = self.version()
        if known is None or "version" not in known.columns:
            return self.stored(FA.facts(sources).withColumn("version", F.lit(version)), "facts")
        known = known.filter(F.col("version") == version)
        # An asset without facts is told apart from an unknown one by its status, which every parsed asset has.
        new = FA.facts(sources.join(known.select("asset_id").distinct(), "asset_id", "left_anti")).withColumn("version", F.lit(version))
        now = sources.groupBy("asset_id").agg(F.min(F.struct("pos", "file_path")).alias("now"))
        moved = known.drop("pos", "file_path").join(now, "asset_id").select("*", F.col("now.pos").cast("long").alias("pos"), "now.file_path").drop("now")
        return self.stored(new.unionByName(moved.select(*new.columns)), "facts")

    def ingest(self, captures: DataFrame, scope: DataFrame | None = None) -> DataFrame:
        """Captures to (asset_id, source, beautified): the code among them, laid out where it is minified or always is."""
        rows = C.derive(C.classify(captures, self.config, scope), self.config).filter("asset_type = 'js'")
        rows = rows.groupBy("asset_id").agg(F.first("body").alias("body"), F.first("minified").alias("minified"))
        text = C.latin(F.col("body")) if self.config.quirks == T.OBSERVED else F.decode("body", "UTF-8")
        wanted = F.lit(self.config.beautify) & (F.lit(self.config.always_beautify) | F.col("minified"))
        rows = rows.select("asset_id", text.alias("source"), wanted.alias("_wanted"))
        plain = rows.filter("NOT _wanted").select("asset_id", "source", F.lit(None).cast("string").alias("beautified"))
        return plain.union(rows.filter("_wanted").select("asset_id", "source", beautified()(F.col("source"))))

    def version(self) -> str:
        """Names what facts depend on besides the text."""
        return hashlib.sha256(f"{ANALYSER}|{self.config.quirks}".encode()).hexdigest()[:12]

    def snapshot(self, assets: DataFrame, sources: DataFrame, known: DataFrame | None = None, maps: DataFrame | None = None) -> dict[str, DataFrame]:
        """All tables. assets: the index (pages too); sources: asset_id, pos, file_path, source of the code among them."""
        facts = self.facts(sources, known)
        findings = FI.findings(facts, self.config.quirks, self.rules)
        place = sources.select("asset_id", "file_path")
        named = assets.join(place, "asset_id", "left").withColumn("file_path", F.coalesce("file_path", "url"))
        covered, routed, drifted = R.coverage(assets, findings), R.routes(assets), R.drift(named, findings)
        pages = R.page_assets(assets)
        called, traced, clustered = FI.call_graph(facts), FI.traces(facts), R.clusters(findings)
        out = {
            "facts": facts, "findings": findings, "words": FI.words(facts), "call_graph": called, "traces": traced, "coverage": covered, "triage": R.triage(covered, named), "routes": routed, "drift": drifted,
            "alerts": R.alerts(drifted), "clusters": clustered, "pages": pages, "referrers": R.referrers(assets, pages), "script_targets": R.script_targets(assets, pages),
            "summary": R.summary(findings, covered, routed, drifted, clustered, traced, called), "wordlist": R.wordlist(FI.words(facts)), "view_counts": R.view_counts(findings), "calls_by_caller": R.calls_by_caller(called),
        }
        if maps is not None:
            resolved = FI.findings(FA.facts(SI.resolved_sources(maps)), self.config.quirks)
            stats = self.stored(R.resolved_stats(resolved), "resolved")
            files = SI.resolved_sources(maps).select("asset_id", "file_path").distinct()
            out["sourcemap_graph"] = files.join(stats, "file_path", "left").fillna(0).join(assets.select("asset_id", "url"), "asset_id")
        return out
