"""URL resolution: an expression for absolute references, a vectorised function for the others."""

from __future__ import annotations

from urllib.parse import quote, urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

PORTS = {"http": 80, "https": 443, "ws": 80, "wss": 443, "ftp": 21}
#: A lower-case host without a port, and plain path segments with or without a query: nothing in these changes when they are resolved.
_ORIGIN = r"(?:https?|wss?)://[a-z0-9-]+(?:\.[a-z0-9-]+)*"
_PATH = r"(?=/)(?:/[A-Za-z0-9_-][A-Za-z0-9._-]*)*/?(?:\?[A-Za-z0-9_=&.-]+)?"
_KEEP = "!#$%&'()*+,/:;=?@[]~|^\\`{}-._"


def normalised(url: str) -> str:
    """Host in lower case, default port gone, dot segments resolved, an empty path as a slash."""
    parts = urlsplit(url)
    if parts.scheme not in PORTS or not parts.netloc:
        return url
    user, _, host = parts.netloc.rpartition("@")
    host = host.lower()
    name, colon, port = host.rpartition(":")
    if colon and port.isdigit() and int(port) == PORTS[parts.scheme]:
        host = name
    out: list[str] = []
    steps = parts.path.split("/")[1:]
    for n, step in enumerate(steps):
        if step in (".", ".."):
            out = out[:-1] if step == ".." else out
            out += [""] if n == len(steps) - 1 else []
        else:
            out.append(step)
    path = quote("/" + "/".join(out), safe=_KEEP)
    return urlunsplit((parts.scheme, f"{user}@{host}" if user else host, path, quote(parts.query, safe=_KEEP), quote(parts.fragment, safe=_KEEP)))


def resolve_one(base: str | None, reference: str | None) -> str | None:
    """The reference as seen from the base; itself where that can't be said."""
    if reference is None or not base:
        return reference
    try:
        joined = urljoin(base, reference.strip())
        return normalised(joined) if urlsplit(joined).scheme else reference
    except ValueError:
        return reference


@F.pandas_udf(StringType())
def _resolve(base: pd.Series, reference: pd.Series) -> pd.Series:
    return pd.Series([resolve_one(b, r) for b, r in zip(base, reference, strict=True)], dtype=object)


def resolve_url(base: Column, reference: Column) -> Column:
    """``resolve_one`` of each row. Plain absolute and rooted references are resolved by expressions; Python sees nulls in their place."""
    known = F.regexp_extract(base, rf"\A({_ORIGIN})(?:/[\x21-\x7E]*)?\z", 1)
    absolute = reference.rlike(rf"\A{_ORIGIN}{_PATH}\z")
    rooted = reference.rlike(rf"\A{_PATH}\z") & F.coalesce(known != "", F.lit(False))
    rest = ~F.coalesce(absolute | rooted, F.lit(False))
    return F.when(absolute, reference).when(rooted, F.concat(known, reference)).otherwise(_resolve(F.when(rest, base), F.when(rest, reference)))


def origin(url: Column) -> Column:
    """scheme://host:port with defaults filled in, or null."""
    part = lambda p: F.try_parse_url(url, F.lit(p))
    scheme = F.lower(part("PROTOCOL"))
    port = F.regexp_extract(part("AUTHORITY"), r":([0-9]+)\z", 1)
    known = F.when(port != "", port).otherwise(F.when(scheme == "https", F.lit("443")).otherwise(F.lit("80")))
    return F.when(part("HOST").isNotNull(), F.concat(scheme, F.lit("://"), F.lower(part("HOST")), F.lit(":"), known))


def same_origin(a: Column, b: Column) -> Column:
    return F.coalesce(origin(a) == origin(b), F.lit(False))
