import json

from pyspark.sql import functions as F

from assetloom import registry
from assetloom.operators import rollups as R
from assetloom.plans.engine import Engine
from assetloom.schemas import FINDINGS, INDEX_FIELDS
from assetloom.sources import writers as W

FIELDS = "asset_id string, pos long, " + ", ".join(f"{k} {v}" for k, v in INDEX_FIELDS.items())


def assets(spark, rows):
    names = ["asset_id", "pos", *INDEX_FIELDS]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], FIELDS)


def finding(asset, bucket, label, n=0, **more):
    return (asset, 0, "/f.js", bucket, bucket, label, more.get("detail"), 1, 1, more.get("meta"), n)


def test_triage_levels(spark):
    rows = [("a", 0, "u", 1, 2, 1, 1, 0)] + [(f"s{n}", n, f"u{n}", n, 0, 0, 0, 0) for n in (7, 8, 14, 15, 24, 25)]
    covered = spark.createDataFrame(rows, "asset_id string, pos long, label string, endpoints long, sinks long, user_sinks long, secrets long, signatures long").withColumn("total", F.lit(1))
    got = {r.asset_id: r for r in R.triage(covered).collect()}
    assert (got["a"].score, got["a"].severity) == (31, "critical")
    assert got["a"].reasons == ["secrets", "user-controlled sinks", "sinks", "endpoints", "secret + user sink", "user sink + endpoint"]
    assert [got[f"s{n}"].severity for n in (7, 8, 14, 15, 24, 25)] == ["low", "medium", "medium", "high", "high", "critical"]


def test_drift_and_alerts(spark):
    a = assets(spark, [{"asset_id": x, "pos": n, "url": "u", "timestamp": t, "sha256": x} for n, (x, t) in enumerate([("one", "1"), ("two", "2"), ("three", "2")])])
    f = spark.createDataFrame([finding("one", "secrets", "s"), finding("two", "endpoints", "old"), finding("three", "endpoints", "old"), finding("three", "endpoints", "new", 1), finding("three", "endpoints", "new", 2), finding("three", "paths", "p")], FINDINGS)
    got = R.drift(a, f).collect()
    assert len(got) == 1 and (got[0].added_endpoints, got[0].added_paths, got[0].added_secrets) == (2, 1, 0)
    levels = {"ku": (0, 0, 1, 1), "k": (0, 0, 0, 1), "u": (0, 0, 1, 0), "se": (1, 1, 0, 0), "s": (0, 1, 0, 0), "e": (1, 0, 0, 0), "none": (0, 0, 0, 0)}
    rows = spark.createDataFrame([(u, *v) for u, v in levels.items()], "url string, added_endpoints long, added_sinks long, added_user_sinks long, added_secrets long")
    assert {r.url: r.severity for r in R.alerts(rows).collect()} == {"ku": "critical", "k": "high", "u": "high", "se": "medium", "s": "low", "e": "low"}


def test_routes_clusters_and_pages(spark):
    seen = [("k", "u", "GET", "r2", "1", "1", 1, 200, "t")]
    a = assets(spark, [
        {"asset_id": "js:1", "pos": 0, "url": "https://h/a.js", "sha256": "x", "referer": "r1", "observations": seen}, {"asset_id": "js:2", "pos": 1, "url": "https://h/b.js", "sha256": "x", "referer": "r1"},
        {"asset_id": "html:1", "pos": 2, "url": "https://h/p", "asset_type": "html", "html_path": "/p", "script_srcs": ["a.js", "//o/c.js"], "sha256": "y"},
    ])
    got = sorted((r.route, r.asset_id, r.first_pos) for r in R.routes(a).collect())
    assert got == [("r1", "js:2", 0), ("r2", "js:1", 0)]
    pages = R.page_assets(a)
    assert sorted((r.page_url, r.script_url, r.asset_id) for r in R.script_targets(a, pages).collect()) == [("https://h/p", "https://h/a.js", "js:1"), ("https://h/p", "https://o/c.js", None)]
    assert [(r.asset_id, r.page_url) for r in R.referrers(a, pages).collect()] == [("js:1", "https://h/p")]
    f = spark.createDataFrame([finding("x", "endpoints", "/a/b/c", meta={"auth": "Authorization"}), finding("x", "endpoints", "/a/b/d")], FINDINGS)
    assert sorted((r.base_path, r.auth, r.endpoints) for r in R.clusters(f).collect()) == [("/a/b", "Authorization", 1), ("/a/b", "none", 1)]


def test_pages_with_one_url_keep_their_own_scripts(spark, tmp_path):
    rows = [(1, "https://h/p", "<p>"), (2, "https://h/p", "<p>"), (3, "https://h/q", None), (4, None, "<p>")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted((r.page_id, r.script_url, r.asset_id or "", r.page_url) for r in registry.QUERIES["page_script_targets"](spark, str(tmp_path)).collect())
    assert got == sorted(x for n, u, _ in rows for x in ((n, f"https://cdn.example/{n}.js", f"js:{n}", u), (n, "https://cdn.example/shared.js", "", u)))


def test_snapshot_to_outputs(spark, tmp_path):
    code = 'fetch("/api/users/1", {headers: {Authorization: t}});\nel.innerHTML = location.hash;\nvar apiToken = "abcdefghij-1234";\nfunction go(p) { document.write(p) } go(location.search);'
    a = assets(spark, [
        {"asset_id": "js:1", "pos": 0, "url": "https://h/a.js", "sha256": "x", "timestamp": "1", "asset_type": "js", "referer": "https://h/p"}, {"asset_id": "js:2", "pos": 1, "url": "https://h/a.js", "sha256": "y", "timestamp": "2", "asset_type": "js", "referer": "https://h/p"},
        {"asset_id": "html:1", "pos": 2, "url": "https://h/p", "asset_type": "html", "html_path": "/p", "script_srcs": ["a.js"], "sha256": "z"},
    ])
    sources = spark.createDataFrame([("js:1", 0, "/c/1.js", "fetch('/api/old')"), ("js:2", 1, "/c/2.js", code)], "asset_id string, pos long, file_path string, source string")
    engine = Engine(spark)
    snap = engine.snapshot(a, sources)
    again = engine.facts(sources, snap["facts"])
    assert again.count() == snap["facts"].count()
    row = snap["summary"].first()
    assert (row.coverage, row.triage, row.routes, row.drift, row.alerts, row.secrets) == (3, 2, 1, 1, 1, 1)
    assert snap["alerts"].first().severity == "critical" and snap["triage"].filter("asset_id = 'js:2'").first().file_path == "/c/1.js"
    paths = W.write_outputs(str(tmp_path), snap)
    assert len(paths) == len(set(paths)) and (tmp_path / "interesting/apis/endpoints.txt").read_text() == "/api/old\n/api/users/1\n"
    assert (tmp_path / "interesting/flows/traces.txt").read_text().splitlines()[0].startswith("location.hash\tinnerHTML\t/c/2.js:2\t")
    assert (tmp_path / "interesting/coverage/coverage.txt").read_text().splitlines()[-1] == "0\tE:0\tS:0\tU:0\tK:0\tG:0\thttps://h/p"
    text = open(W.export(str(tmp_path), snap, "csv")).read().splitlines()
    assert text[0] == "category,label,detail,filePath,line,column" and text[1].startswith("endpoint,/api/old,fetch,/c/1.js,1,")
    sarif = json.load(open(W.export(str(tmp_path), snap, "sarif")))
    assert sarif["version"] == "2.1.0" and sarif["runs"][0]["results"][0]["ruleId"] == "endpoint"
    data = json.load(open(W.export(str(tmp_path), snap, "json")))
    assert data["findings"]["endpoints"][0]["label"] == "/api/old" and data["routes"] == [{"route": "https://h/p", "assets": ["https://h/a.js", "https://h/a.js"]}]
    report = open(W.write_report(str(tmp_path / "r.md"), snap)).read()
    assert "- Assets analyzed: 3" in report and "## Alerts" in report
    assert "apiToken" not in open(W.write_wordlist(str(tmp_path / "w.txt"), snap["words"])).read().split()
    assert "abcdefghij-1234" not in str(W.redacted(snap["findings"]).filter("bucket = 'secrets'").collect())
    far = W.export(f"file://{tmp_path}/far", snap, "sarif")
    assert json.load(open(far[len("file://") :])) == sarif and [r["id"] for r in sarif["runs"][0]["tool"]["driver"]["rules"]] == list(dict.fromkeys(r["ruleId"] for r in sarif["runs"][0]["results"]))
    for path in paths:
        if path.endswith(".json"):
            assert (text := open(path, encoding="utf-8").read()) == json.dumps(json.loads(text), indent=2, ensure_ascii=False)
    W.write_tables(f"file://{tmp_path}/tables", {k: snap[k] for k in ("findings", "coverage")})
    assert spark.read.parquet(f"file://{tmp_path}/tables/findings").count() == snap["findings"].count()


def test_ingestion_lays_out_minified_code(spark):
    from assetloom.config import EngineConfig
    from tests.test_captures import capture, frame

    rows = frame(spark, [capture(1, "https://h/a.js", "a=1;" * 60), capture(2, "https://h/b.js", "b = 1;\nc = 2;")])
    got = {r.source[0]: r.beautified for r in Engine(spark).ingest(rows).collect()}
    assert got["a"].startswith("a = 1;\na = 1;") and got["b"] is None
    got = {r.source[0]: r.beautified for r in Engine(spark, EngineConfig(always_beautify=True)).ingest(rows).collect()}
    assert got["b"] == "b = 1;\nc = 2;"


def test_views_and_table_functions(spark):
    from assetloom.plans.views import assets_of_route, create_views, register_table_functions, views

    a = assets(spark, [{"asset_id": "js:1", "pos": 0, "url": "u", "sha256": "x", "timestamp": "1", "asset_type": "js", "referer": "r"}])
    code = ";".join(f"fetch('/api/{n:02d}')" for n in range(15))
    snap = Engine(spark).snapshot(a, spark.createDataFrame([("js:1", 0, "/f.js", code)], "asset_id string, pos long, file_path string, source string"))
    shown = views(snap)
    assert [r.label for r in shown["top_endpoints"].collect()] == [f"/api/{n:02d}" for n in range(10)]
    assert shown["words"].count() > 0 and shown["calls_by_caller"].first().edges == 15 and assets_of_route(snap, "r").count() == 1
    create_views({"coverage": snap["coverage"]}, "t_")
    assert spark.sql("SELECT endpoints FROM t_coverage").first()[0] == 15
    register_table_functions(spark)
    assert spark.sql("SELECT text FROM js_tokens('a = 1') ORDER BY ord").collect()[1].text == "="
    rows = spark.sql("SELECT s.id, f.label FROM (SELECT 1 AS id, \"fetch('/x/y')\" AS src) s, LATERAL js_facts(s.src) f WHERE f.what = 'finding'").collect()
    assert [(r.id, r.label) for r in rows] == [(1, "/x/y")]


def test_known_facts_move_with_their_assets_and_age_with_the_analyser(spark, tmp_path, monkeypatch):
    from assetloom.plans import engine as E

    schema = "asset_id string, pos long, file_path string, source string"
    run = E.Engine(spark, rules=[], folder=f"file://{tmp_path}")
    old = run.facts(spark.createDataFrame([("js:a", 0, "/old.js", "go('one/two')"), ("js:gone", 1, "/gone.js", "x()"), ("js:bad", 2, "/bad.js", "((")], schema))
    sources = spark.createDataFrame([("js:a", 7, "/new.js", "go('another text')"), ("js:bad", 2, "/bad.js", "(("), ("js:b", 9, "/b.js", "go('b/c')")], schema)
    got = run.facts(sources, old)
    assert {(r.asset_id, r.pos, r.file_path) for r in got.collect()} == {("js:a", 7, "/new.js"), ("js:bad", 2, "/bad.js"), ("js:b", 9, "/b.js")}
    labels = lambda df: {r.label for r in df.filter("what = 'literal'").collect()}
    assert labels(got) == {"one/two", "b/c"}  # an id names a text, so js:a wasn't parsed again
    monkeypatch.setattr(E, "ANALYSER", "next")
    assert labels(run.facts(sources, got)) == {"another text", "b/c"}
    assert run.facts(sources.limit(0), got).count() == 0
