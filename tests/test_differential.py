"""Native expressions against an independent scalar version, over random strings, in both modes."""

import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from assetloom.functions import text as T

JS_SPACE = "\t\n\x0b\f\r \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
PARTS = ["a", "Z", "9", "-", "_", ".", "/", "?", "&", "=", "#", ":", "@", " ", "\n", "\u3000", "\\", "\\s", "[", "]", "{", "}", "<", "é", "🎉", "api", "https://", "ws://", "http://h.io", "query ", " mutation ", "__typename", "token", "ff_x", ".ff_y", "flags", "feature", "AKIA", "sk_", "0f", "deadbeef", "Qz7+", "application/json", ".js", "x" * 30, "12345678-1234-1234-1234-123456789abc"]


def url(v):
    return v.lower().startswith(("http://", "https://", "ws://", "wss://"))


def path(v):
    return v.startswith("/") and len(v) > 1 or "/" in v and not url(v)


def host(v):
    if not 3 <= len(v) <= 255 or "/" in v or "@" in v:
        return False
    labels = v.split(":")[0].split(".")
    return len(labels) >= 2 and all(1 <= len(x) <= 63 and all(c.isascii() and (c.isalnum() or c == "-") for c in x) for x in labels)


def ext(v, observed):
    if len(v) < 3:
        return None
    last = v.split("?")[0].split("#")[0].split("/")[-1]
    m = re.search((r"\\[^\n\r\u2028\u2029]" if observed else r"\.") + r"([A-Za-z0-9]{1,8})\Z", last)
    return f".{m[1]}" if m else None


def mime(v):
    token = "[A-Za-z0-9][A-Za-z0-9!#$&^_.+-]*"
    return len(v) <= 80 and bool(re.fullmatch(f"{token}/{token}", v))


def broken(v, observed):
    return bool(re.search(r"\\s|[<>{}\\\[]\]", v)) if observed else any(c in JS_SPACE + "<>{}[]" for c in v)


def bits(v):
    n = len(v.encode("utf-16-le")) // 2
    return -sum(c / n * math.log2(c / n) for c in Counter(v).values())


def reason(v, observed):
    if len(v) < 20:
        return None
    if v.startswith(T.SECRET_PREFIXES):
        return "known-prefix"
    if re.fullmatch(r"([A-Za-z0-9_-]{6,}\.){2}[A-Za-z0-9_-]{6,}", v):
        return "jwt"
    dense = bool(re.fullmatch(r"[A-Za-z0-9+/=_-]{20,}", v))
    if re.fullmatch(r"[a-fA-F0-9]{8}(-[a-fA-F0-9]{4}){3}-[a-fA-F0-9]{12}", v) or broken(v, observed):
        return None
    if not dense and (url(v) or path(v) or host(v) or ext(v, observed)):
        return None
    if dense:
        return "high-entropy" if len(v) >= 24 and bits(v) >= 3.6 else None
    return "high-entropy" if len(v) > 40 and re.fullmatch("[A-Za-z0-9._$-]+", v) and bits(v) >= 4 else None


def sensitive(v, observed):
    chars = r"[A-Za-z0-9._+$\\/=?]+" if observed else r"[A-Za-z0-9._+$\-/=?]+"
    return len(v) >= 12 and not broken(v, observed) and not (url(v) or path(v) or host(v) or mime(v) or ext(v, observed)) and bool(re.fullmatch(chars, v))


def graphql(v, observed):
    text = re.sub(r"\\s+" if observed else f"[{JS_SPACE}]+", " ", v).strip(JS_SPACE).lower()
    for word in ("query", "mutation", "subscription"):
        if text.startswith(word) or f" {word} " in text:
            return f"graphql:{word}"
    return "graphql:fragment" if "{" in text and "}" in text and "__typename" in text else None


def segments(v):
    for mark in "?&=":
        v = v.replace(mark, "/", 1)
    return [x for x in v.split("/") if x]


def params(v):
    return [n for p in v.partition("?")[2].split("&") if (n := p.split("=")[0])] if "?" in v else []


def test_random_strings(spark):
    rng = random.Random(11)
    values = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(1, 9))) for _ in range(4000)]
    v, df = F.col("v"), spark.createDataFrame([(n, x) for n, x in enumerate(values)], "n int, v string")
    plain = {"url": (T.is_url, url), "path": (T.is_path, path), "host": (T.is_hostname, host), "mime": (T.is_mime, mime), "segments": (T.path_segments, segments), "params": (T.query_params, params)}
    both = {"ext": (T.extension, ext), "reason": (T.secret_reason, reason), "sensitive": (T.is_sensitive_literal, sensitive), "graphql": (T.graphql, graphql)}
    columns = {k: native(v) for k, (native, _) in plain.items()}
    columns |= {f"{k}_{m}": native(v, m) for k, (native, _) in both.items() for m in (T.INTENDED, T.OBSERVED)}
    columns["bits"] = T.entropy(v)
    for r in df.withColumns(columns).collect():
        for k, (_, scalar) in plain.items():
            assert r[k] == scalar(r.v), (k, r.v)
        for k, (_, scalar) in both.items():
            for m in (T.INTENDED, T.OBSERVED):
                assert r[f"{k}_{m}"] == scalar(r.v, m == T.OBSERVED), (k, m, r.v)
        assert abs(r.bits - bits(r.v)) < 1e-9
