import pytest
from pyspark.sql import functions as F

from assetloom.functions import text as T
from assetloom.functions import urls


def value(spark, make, v):
    return spark.createDataFrame([(v,)], "v string").select(make(F.col("v")).alias("r")).first().r


CASES = [
    (T.is_url, "WSS://x", True), (T.is_url, "ftp://x", False), (T.is_path, "/", True), (T.is_path, "/a", True), (T.is_path, "text/html", True), (T.is_path, "https://h/a", False),
    (T.query_params, "/a?x=1&y&=z#f", ["x", "y"]), (T.query_params, "/a", []), (T.is_word, "ab", False), (T.is_word, "abc", True), (T.is_word, "a.c", False), (T.is_word, "a" * 65, False), (T.is_word, "abc\n", False),
    (T.path_segments, "/a/b?x=1&y=2", ["a", "b", "x", "1", "y=2"]), (T.truncated, "a" * 121, "a" * 120 + "..."), (T.truncated, "a" * 120, "a" * 120), (T.entropy, "aabbccdd", 2.0), (T.entropy, "a" * 24, 0.0),
    (T.is_hostname, "api.example.com", True), (T.is_hostname, "1.5", True), (T.is_hostname, ".a.b", False), (T.is_hostname, "host:8080", False), (T.is_hostname, "a.b:80", True),
    (T.extension, "/a/app.min.js?x#y", ".js"), (T.is_mime, "application/json", True), (T.is_mime, "./a", False), (T.is_mime, "a/b", True),
    (T.graphql, "queryString", "graphql:query"), (T.graphql, "{ a { __typename } }", "graphql:fragment"), (T.graphql, "\n mutation M {x}", "graphql:mutation"), (T.graphql, "fragment F on T {a}\nquery\n{b}", "graphql:query"), (T.graphql, "plain", None),
    (T.is_data, "hello world", True), (T.is_data, "hello.world", False), (T.is_data, "12345", False), (T.is_data, "key:value", False), (T.is_jwt, "abcdefgh.abcdefgh.abcdefgh", True), (T.is_jwt, "abcdefghijk.abcdefghijk", False),
    (T.secret_reason, "AKIA" + "A" * 16, "known-prefix"), (T.secret_reason, "0123456789abcdef01234567", "high-entropy"), (T.secret_reason, "0123456789abcdefghij", None), (T.secret_reason, "a" * 24, None),
    (T.secret_reason, "12345678-1234-1234-1234-123456789abc", None), (T.is_sensitive_literal, "abcdefghij1234", True), (T.is_sensitive_literal, "my-secret-value-1", True), (T.is_sensitive_literal, "with a few spaces", False),
    (T.is_sensitive_literal, "abcd/efghijkl", False), (T.path_type, "/x", "simple"), (T.path_type, "/api", "api"), (T.path_type, "/api/v?y#z", "query,fragment,api"), (T.url_pathname, "https://h.example", "/"),
    (T.is_flag_name, "flags", False), (T.is_flag_name, "ff_x", True), (T.is_flag_name, "enableSwitch", True), (T.is_flag_path, "cfg.ff_beta", True), (T.is_flag_path, "cfg_ff_beta", True),
    (T.base_path, "https://h/a/b/c?x", "/a/b"), (T.base_path, "/a", "/a"), (T.base_path, "?x", "/"), (T.base_path, "api/v1/x", "/api/v1"), (T.csv_field, 'a"b', '"a""b"'), (T.csv_field, "a\rb", "a\rb"),
]


def test_intended(spark):
    rows = [(n, c[1]) for n, c in enumerate(CASES)]
    df = spark.createDataFrame(rows, "n int, v string")
    for make in {c[0] for c in CASES}:
        got = {r.n: r.r for r in df.filter(F.col("n").isin([n for n, c in enumerate(CASES) if c[0] is make])).select("n", make(F.col("v")).alias("r")).collect()}
        for n, found in got.items():
            want = CASES[n][2]
            assert found == pytest.approx(want) if isinstance(want, float) else found == want, (make.__name__, CASES[n][1], found)


def test_observed(spark):
    seen = lambda f: lambda v: f(v, T.OBSERVED)
    assert value(spark, seen(T.extension), "/a/app.min.js?x#y") is None
    assert value(spark, seen(T.extension), "a\\xjs") == ".js"
    assert value(spark, seen(T.graphql), "fragment F on T {a}\nquery\n{b}") is None
    assert value(spark, seen(T.is_sensitive_literal), "my-secret-value-1") is False
    assert value(spark, seen(T.is_flag_path), "cfg.ff_beta") is False and value(spark, seen(T.is_flag_path), "cfg_ff_beta") is True


def test_urls(spark):
    cases = {("https://H.example/a/b", "../c"): "https://h.example/c", ("https://h/a", "//o.example:443/x"): "https://o.example/x", ("https://h/a", "https://h"): "https://h/", ("", "x"): "x", ("https://h/a/", "b?c#d"): "https://h/a/b?c#d"}
    for (base, ref), want in cases.items():
        assert urls.resolve_one(base, ref) == want


def test_plain_references_need_no_python_and_none_differ(spark):
    bases = ["https://h.io/a/b?c#d", "http://h", "wss://h.io/", "https://H.io/x", "https://h.io:443/", "https://u@h.io/", "ftp://h/", "nonsense", "", None, "https://h.io/\u00e9", "https://h.io/a b", "http://[h/", "https://h.io?x"]
    refs = ["/a/b.js", "/a/../b", "/a/./b", "//o.io/x", "/", "", None, "/a//b", "/a?b=c", "/a?", "/a#f", "/.hidden", "/a/..", "b.js", "https://o.io/x.js", "https://o.io", "https://O.io/x", "https://o.io:443/x", "https://o.io:80/x", "ws://o.io/x?y", "/a b", " /a", "/a\n", "/\u00e9", "/a%20b", "?q", "#f", "mailto:x", "https://o.io/a/../b", "/a;b", "/~x"]
    rows = [(b, r) for b in bases for r in refs]
    got = spark.createDataFrame(rows, "b string, r string").select("b", "r", urls.resolve_url(F.col("b"), F.col("r")).alias("got")).collect()
    assert len(got) == len(rows) and [(x.b, x.r, x.got) for x in got if x.got != urls.resolve_one(x.b, x.r)] == []
    df = spark.createDataFrame([("https://h/a", "http://h/a"), ("https://H:443/a", "https://h/b")], "a string, b string")
    assert [r[0] for r in df.select(urls.same_origin(F.col("a"), F.col("b"))).collect()] == [False, True]
