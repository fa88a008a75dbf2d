import random

import pytest
from pyspark.sql import functions as F

from assetloom.config import EngineConfig
from assetloom.operators import captures as C
from assetloom.schemas import CAPTURES
from assetloom.sources import index as SI
from assetloom.streaming.ingest import IndexSink, ingest, index_of, merged, states


def capture(n, url, body, kind=None, ts=None, method="GET", referer=None):
    return (n, url, method, 200, kind, [], referer, "h", "/p", body.encode(), ts or f"2024-01-01T00:00:{n % 60:02d}Z")


def frame(spark, rows):
    return spark.createDataFrame(rows, CAPTURES)


JS = "var a = 1; let b"


def test_classification(spark):
    cases = [("https://h/a.css", JS, None, None), ("https://h/a", JS, "text/css", None), ("https://h/a", "x", "application/javascript", "js"), ("https://h/a.MJS", "x", None, "js"), ("https://h/a", JS, None, "js"), ("https://h/a.php", JS, None, "html"), ("https://h/a", "<html>var let", None, "html"), ("https://h/a", "var a", None, None), ("https://h/a", "x", "text/html", "html"), ("https://h/a", "<script>a</script>", None, "html")]
    rows = frame(spark, [capture(n, u, b, k) for n, (u, b, k, _) in enumerate(cases)])
    got = {r.capture_id: r.asset_type for r in C.classify(rows).collect()}
    assert [got.get(n) for n in range(len(cases))] == [c[3] for c in cases]
    assert "html" not in {r.asset_type for r in C.classify(rows, EngineConfig(capture_html=False)).collect()}
    scope = spark.createDataFrame([("other",)], "host string")
    assert C.classify(rows, EngineConfig(only_in_scope=True), scope).count() == 0


def test_derived_columns(spark):
    page = '<script src="a.js"></script><script>x</script><SCRIPT>y</SCRIPT>'
    code = "x;\n//# sourceMappingURL=one.map\n/*# sourceMappingURL=two.map */\nimport(/* webpackChunkName: \"home\" */ './h'); a('static/js/z.js')"
    rows = C.derive(frame(spark, [capture(1, "https://h/a/b..c.js?q", code, "application/javascript"), capture(2, "https://h/", page, "text/html")]).withColumn("asset_type", F.expr("if(capture_id = 1, 'js', 'html')"))).orderBy("capture_id").collect()
    assert rows[0].sourcemap_ref == "two.map" and rows[0].original_filename == "b..c.js" and rows[0].base_name.endswith("__GET_h_a_b_c.js")
    assert rows[0].chunk_candidates == sorted(["home.js", "home.chunk.js", "static/js/home.js", "static/js/home.chunk.js", "static/js/z.js"])
    assert rows[1].script_srcs == ["a.js"] and rows[1].inline_script_count == 2
    minified = [("x" * 201, True), (("x" * 3 + " ") * 60, False), ("short\n" * 99, False), ("", False)]
    got = spark.createDataFrame(minified, "b string, w boolean").select(C.is_minified(F.col("b")).alias("g"), "w").collect()
    assert all(r.g == r.w for r in got)
    observed = C.derive(frame(spark, [capture(1, "https://h/a", code)]).withColumn("asset_type", F.lit("js")), EngineConfig(quirks="observed")).first()
    assert observed.chunk_candidates == []


def test_headers_names_and_limits(spark):
    assert spark.createDataFrame([(["HTTP/1.1 200", "content-TYPE:  a/b "],)], "h array<string>").select(C.header(F.col("h"), "Content-Type")).first()[0] == "a/b"
    names = C.unique_names(spark.createDataFrame([("d", "a", 1), ("d", "a", 2), ("d", "b", 3)], "d string, n string, k int"), "d", "n", "k")
    assert sorted(r.unique_name for r in names.collect()) == ["a", "a-1", "b"]
    assert C.admitted(frame(spark, [capture(n, "u", "b") for n in range(20)]), 5).count() == 5


def test_observations_in_both_modes(spark):
    rows = C.derive(frame(spark, [capture(n, "https://h/a.js", JS, referer="r") for n in range(3)]).withColumn("asset_type", F.lit("js")))
    assert [r["count"] for r in C.observations(rows).collect()] == [3]
    assert sorted((r["count"], r["key"] is None) for r in C.observations(rows, "observed").collect()) == [(1, True), (2, False)]
    up = C.upsert(rows).first()
    assert up.seen_count == 3 and up.first_seen < up.last_seen


def test_chunk_plan_fetches_nothing(spark):
    assets = spark.createDataFrame([("a", "https://h/x/y.js", ["z.js", "https://other/q.js", "seen.js", "w.js"])], "asset_id string, url string, chunk_candidates array<string>")
    seen = spark.createDataFrame([("https://h/x/seen.js",)], "url string")
    assert [r.candidate for r in C.chunk_plan(assets, seen, EngineConfig(chunk_limit=1)).collect()] == ["https://h/x/w.js"]
    assert C.chunk_plan(assets, seen).count() == 2


def random_captures(spark, n=120):
    rng = random.Random(5)
    return [capture(i, f"https://h/{rng.randrange(4)}.js", f"var a = {rng.randrange(6)}; let b", "application/javascript", f"2024-01-01T00:{rng.randrange(60):02d}:00Z", rng.choice(["GET", "POST"]), rng.choice(["", None, "p", "q"])) for i in range(n)]


@pytest.mark.parametrize("compacted", [False, True])
def test_stream_equals_batch(spark, tmp_path, compacted):
    rows = random_captures(spark)
    source, out = tmp_path / "in", tmp_path / "out"
    for k in range(3):
        frame(spark, rows[k * 40 : k * 40 + 40]).coalesce(1).write.mode("append").parquet(f"file://{source}")
    stream = SI.stream_captures(spark, f"file://{source}", files=1)
    query = ingest(stream, f"file://{out}", f"file://{tmp_path}/check", once=True)
    assert query.awaitTermination(120)
    batch = C.derive(C.classify(frame(spark, rows)))
    sink, want = IndexSink(spark, f"file://{out}"), C.upsert(batch)
    if compacted:
        sink.compact(2)
        assert {p.name for p in (out / "compacted").glob("[0-9]*")} == {"2"}
    assert sink.version() == 2
    assert sorted(map(str, sink.index().select(*sorted(want.columns)).collect())) == sorted(map(str, want.select(*sorted(want.columns)).collect()))
    columns = ["asset_id", "key", "first_seen", "last_seen", "count"]
    assert sorted(map(str, sink.observations().select(columns).collect())) == sorted(map(str, C.observations(batch).select(columns).collect()))


def test_merging_is_order_free(spark):
    rows = C.derive(C.classify(frame(spark, random_captures(spark))))
    a, b = states(rows.filter("capture_id % 2 = 0")), states(rows.filter("capture_id % 2 = 1"))
    one, two = (sorted(map(str, index_of(merged(x.unionByName(y))).collect())) for x, y in ((a, b), (b, a)))
    assert one == two == sorted(map(str, index_of(states(rows)).collect()))


def test_index_files_and_bodies(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw/a.js").write_text("raw text")
    (tmp_path / "raw/b.js").write_text("pretty")
    index = tmp_path / "index.json"
    index.write_text('[{"url": "u", "sha256": "x", "raw_path": "%s", "beautified_path": "%s"}, {"url": "p", "sha256": "y", "asset_type": "html", "html_path": "z"}]' % (tmp_path / "raw/a.js", tmp_path / "raw/b.js"))
    assets = SI.read_index(spark, str(index))
    assert [(r.asset_id, r.pos) for r in assets.orderBy("pos").collect()] == [("js:x", 0), ("html:y", 1)]
    bodies = SI.with_bodies(assets, SI.read_bodies(spark, f"file://{tmp_path}/raw"))
    assert [r.source for r in bodies.collect()] == ["pretty"]
    (tmp_path / "raw/b.js").write_text("")  # an empty file is no body
    (tmp_path / "raw/sub").mkdir()
    (tmp_path / "raw/sub/c.js").write_text("other")
    found = SI.read_bodies(spark, f"file://{tmp_path}/{{raw,raw/sub}}")  # folders that overlap give each file once
    assert sorted(r.path for r in found.collect()) == [str(tmp_path / "raw" / x) for x in ("a.js", "sub/c.js")]
    bodies = SI.with_bodies(assets, found)
    assert [(r.url, r.file_path, r.source) for r in bodies.collect()] == [("u", str(tmp_path / "raw/a.js"), "raw text")]
    index.write_text('{"not": "an array"}')
    assert SI.read_index(spark, str(index), assets) is assets
    with pytest.raises(Exception):
        SI.read_index(spark, str(tmp_path / "none.json"))


def test_sourcemaps(spark):
    import base64
    import json

    data = {"sources": ["src/a b.ts", "", "c.ts"], "sourcesContent": ["eval(location.hash)", "two", None]}
    ref = "data:application/json;base64," + base64.b64encode(json.dumps(data).encode()).decode()
    rows = spark.createDataFrame([("js:1", 0, "f" * 64, f"x\n//# sourceMappingURL={ref}", None, None), ("js:2", 1, "e" * 64, "y", "m.map", "/m.map"), ("js:3", 2, "d" * 64, "z", "https://h/x.map", None)], "asset_id string, pos long, sha256 string, source string, sourcemap_ref string, sourcemap_path string")
    files = spark.createDataFrame([("/m.map", json.dumps({"sources": ["q"], "sourcesContent": ["w"]}))], "path string, source string")
    got = SI.resolved_sources(SI.sourcemaps(rows, files)).orderBy("pos", "file_path").collect()
    assert [(r.file_path, r.source) for r in got] == [("resolved/" + "f" * 16 + "/source-1.js", "two"), ("resolved/" + "f" * 16 + "/src_a_b.ts", "eval(location.hash)"), ("resolved/" + "e" * 16 + "/q", "w")]


def test_config(tmp_path):
    path = tmp_path / "c.json"
    path.write_text('{"heuristic_bytes": 10, "capture_html": false, "unknown": 1}')
    got = EngineConfig.load(str(path), {"ASSETLOOM_HEURISTIC_BYTES": "20", "ASSETLOOM_REDACT_SECRETS": "true"})
    assert (got.heuristic_bytes, got.capture_html, got.redact_secrets) == (20, False, True)
    with pytest.raises(ValueError):
        EngineConfig(quirks="other")


def test_watching_an_index(spark, tmp_path):
    from assetloom.streaming.ingest import watch_index

    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.json").write_text('[{"url": "u", "sha256": "x"}]')
    seen = []
    query = watch_index(spark, f"file://{tmp_path}/in", lambda assets: seen.extend(r.asset_id for r in assets.collect()), f"file://{tmp_path}/check", once=True)
    assert query.awaitTermination(60) and seen == ["js:x"]


def test_compaction_removes_what_it_no_longer_needs(spark, tmp_path):
    rows = frame(spark, random_captures(spark))
    sink = IndexSink(spark, f"file://{tmp_path}", compact=2)
    for n in range(7):
        sink.write(rows.filter(f"capture_id % 7 = {n}"), n)
        sink.write(rows.filter(f"capture_id % 7 = {n}"), n)  # a batch that is repeated changes nothing
    assert sink._marks("compacted") == [3, 5] and sink._marks("done") == [4, 5, 6] and sink.version() == 6
    assert sorted(p.name for p in (tmp_path / "states").iterdir()) == ["base=3", "base=5", "v=4", "v=5", "v=6"]
    want = C.upsert(C.derive(C.classify(rows)))
    assert sorted(map(str, sink.index().select(*want.columns).collect())) == sorted(map(str, want.collect()))
