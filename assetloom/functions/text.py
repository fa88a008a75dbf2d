"""String classifiers as Catalyst expressions: Column in, Column out, no Python at run time.

``quirks`` chooses between the documented intent of a rule ("intended", the default) and what over-escaped patterns in the field do
("observed"). A null value gives null (or false in a chain of conditions). Lengths count code points, except in entropy.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
SECRET_PREFIXES = ("AKIA", "AIza", "ghp_", "sk_", "pk_", "xoxb-", "xoxp-")
SECRET_NAME_PARTS = ("secret", "token", "apikey", "api_key", "api-key", "password", "passwd", "auth", "bearer")
FLAG_PARTS = ("feature", "flag", "toggle", "experiment", "variant", "rollout", "abtest", "ab_test", "switch")
FLAG_CONTAINERS = ("featureflags", "feature_flags", "feature-toggles", "flags", "toggles", "experiments", "variants", "rollouts")
FLAG_CALLS = ("isenabled", "isfeatureenabled", "getflag", "getfeature")
MAX_VALUE = 120

#: The white space of ECMAScript, for use inside a character class of either Java's or RE2's dialect.
SPACE = r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
INTENDED, OBSERVED = "intended", "observed"


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def has(value: Column, parts) -> Column:
    """Whether a string has one of the parts."""
    return any_of(value.contains(p) for p in parts)


def whole(pattern: str) -> str:
    return rf"^(?:{pattern})\z"


def before(value: Column, mark: str) -> Column:
    """What precedes the first mark, or all."""
    return F.substring_index(value, mark, 1)


def is_url(v: Column) -> Column:
    return F.lower(v).rlike("^(?:https?|wss?)://")


def is_path(v: Column) -> Column:
    return (v.startswith("/") & (F.length(v) > 1)) | (v.contains("/") & ~is_url(v))


def query_params(v: Column) -> Column:
    """Names of the parameters after the first question mark; a fragment stays part of the last."""
    query = F.when(v.contains("?"), F.regexp_replace(v, r"(?s)^[^?]*\?", "")).otherwise(F.lit(""))
    return F.filter(F.transform(F.split(query, "&"), lambda p: F.substring_index(p, "=", 1)), lambda p: p != "")


def is_word(v: Column) -> Column:
    return v.rlike(whole("[A-Za-z0-9_-]{3,64}"))


def path_segments(v: Column) -> Column:
    """Splits at slashes, once the first ``?``, the first ``&`` and the first ``=`` are slashes too."""
    for mark in "?&=":
        v = F.regexp_replace(v, rf"(?s)^([^{mark}]*)\{mark}" if mark == "?" else f"(?s)^([^{mark}]*){mark}", "$1/")
    return F.filter(F.split(v, "/"), lambda s: s != "")


def path_words(v: Column) -> Column:
    return F.filter(path_segments(v), is_word)


def truncated(v: Column, most: int = MAX_VALUE) -> Column:
    return F.when(F.length(v) > most, F.concat(F.substring(v, 1, most), F.lit("..."))).otherwise(v)


def utf16_length(v: Column) -> Column:
    return (F.octet_length(F.encode(v, "UTF-16BE")) / 2).cast("int")


def entropy(v: Column) -> Column:
    """Bits a character: code points are counted, UTF-16 units divide."""
    units = utf16_length(v).cast("double")
    share = lambda c: (F.length(v) - F.length(F.replace(v, c, F.lit("")))) / units
    chars = F.array_distinct(F.filter(F.split(v, ""), lambda c: c != ""))
    return F.aggregate(F.transform(chars, share), F.lit(0.0), lambda acc, p: acc - p * F.log2(p))


def is_base64ish(v: Column) -> Column:
    return v.rlike(whole("[A-Za-z0-9+/=_-]{20,}"))


def is_hexish(v: Column) -> Column:
    return v.rlike(whole("[0-9a-fA-F]{20,}"))


def is_hostname(v: Column) -> Column:
    """At least two labels of 1 to 63 characters before a colon; top-level domains aren't looked up."""
    host = before(v, ":")
    shaped = F.length(v).between(3, 255) & ~v.rlike("[/@]")
    return shaped & host.rlike(whole(r"[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})+"))


def extension(v: Column, quirks: str = INTENDED) -> Column:
    """``.ext`` of the last path segment, or null."""
    last = F.element_at(F.split(before(before(v, "?"), "#"), "/"), -1)
    dot = r"\." if quirks == INTENDED else r"\\[^\n\r\x{2028}\x{2029}]"
    found = F.regexp_extract(last, rf"{dot}([A-Za-z0-9]{{1,8}})\z", 1)
    return F.when((F.length(v) >= 3) & (found != ""), F.concat(F.lit("."), found))


def is_mime(v: Column) -> Column:
    token = "[a-z0-9][a-z0-9!#$&^_.+-]*"
    return (F.length(v) <= 80) & v.rlike("(?i)" + whole(f"{token}/{token}"))


def graphql(v: Column, quirks: str = INTENDED) -> Column:
    """The finding's label, or null."""
    run = f"[{SPACE}]+" if quirks == INTENDED else r"\\s+"
    text = F.lower(F.regexp_replace(F.regexp_replace(v, run, " "), rf"^[{SPACE}]+|[{SPACE}]+\z", ""))
    out = None
    for word in ("query", "mutation", "subscription"):
        hit = text.startswith(word) | text.contains(f" {word} ")
        out = (F.when if out is None else out.when)(hit, F.lit(f"graphql:{word}"))
    return out.when(text.contains("{") & text.contains("}") & text.contains("__typename"), F.lit("graphql:fragment"))


def is_css_selector(v: Column) -> Column:
    text = F.regexp_replace(v, rf"^[{SPACE}]+|[{SPACE}]+\z", "")
    return text.rlike(r"^[.#\[:]") | text.rlike(r"\[[^\]]+\]") | text.rlike("[:.#][A-Za-z]")


def is_data(v: Column) -> Column:
    return F.length(v).between(4, 80) & ~is_css_selector(v) & v.rlike(whole(r"[A-Za-z0-9 _:.\\-]+")) & v.rlike("[A-Za-z]")


def is_jwt(v: Column) -> Column:
    return v.rlike(whole(r"[A-Za-z0-9_-]{6,}\.[A-Za-z0-9_-]{6,}\.[A-Za-z0-9_-]{6,}"))


def is_uuid(v: Column) -> Column:
    return v.rlike(whole("[a-fA-F0-9]{8}(?:-[a-fA-F0-9]{4}){3}-[a-fA-F0-9]{12}"))


def _broken(v: Column, quirks: str) -> Column:
    """White space or brackets."""
    return v.rlike(rf"[{SPACE}<>{{}}\[\]]") if quirks == INTENDED else v.rlike(r"\\s|[<>{}\\\[]\]")


def secret_reason(v: Column, quirks: str = INTENDED) -> Column:
    """Why a literal is a secret (known-prefix, jwt, high-entropy), or null."""
    dense = is_base64ish(v) | is_hexish(v)
    plain = is_url(v) | is_path(v) | is_hostname(v) | extension(v, quirks).isNotNull()
    no, high, bits = F.lit(None).cast("string"), F.lit("high-entropy"), entropy(v)
    return (
        F.when(v.isNull() | (F.length(v) < 20), no)
        .when(any_of(v.startswith(p) for p in SECRET_PREFIXES), F.lit("known-prefix"))
        .when(is_jwt(v), F.lit("jwt"))
        .when(is_uuid(v) | _broken(v, quirks) | (plain & ~dense), no)
        .when(dense, F.when((F.length(v) >= 24) & (bits >= 3.6), high))
        .when((F.length(v) > 40) & v.rlike(whole("[A-Za-z0-9._$-]+")) & (bits >= 4.0), high)
    )


def is_secret_name(name: Column) -> Column:
    return has(F.lower(name), SECRET_NAME_PARTS)


def is_sensitive_literal(v: Column, quirks: str = INTENDED) -> Column:
    """A literal that counts as a secret under a secret's name."""
    chars = r"[A-Za-z0-9._+$\-/=?]+" if quirks == INTENDED else r"[A-Za-z0-9._+$\\/=?]+"
    named = is_url(v) | is_path(v) | is_hostname(v) | is_mime(v) | extension(v, quirks).isNotNull()
    return (F.length(v) >= 12) & ~_broken(v, quirks) & ~named & v.rlike(whole(chars))


def path_type(v: Column) -> Column:
    tags = [(v.contains("?"), "query"), (v.contains("#"), "fragment"), (F.lower(v).contains("api"), "api")]
    joined = F.concat_ws(",", *(F.when(c, F.lit(t)) for c, t in tags))
    return F.when(joined == "", F.lit("simple")).otherwise(joined)


def url_pathname(v: Column) -> Column:
    """The path of an absolute URL; ``/`` if it has none; null if it is no URL."""
    path = F.try_parse_url(v, F.lit("PATH"))
    return F.when(F.try_parse_url(v, F.lit("HOST")).isNotNull(), F.coalesce(F.nullif(path, F.lit("")), F.lit("/")))


def is_flag_name(name: Column) -> Column:
    low = F.lower(name)
    return ~low.isin(*FLAG_CONTAINERS) & F.length(low).between(3, 80) & (has(low, FLAG_PARTS) | low.startswith("ff_"))


def is_flag_container(name: Column) -> Column:
    return F.lower(name).isin(*FLAG_CONTAINERS)


def is_flag_path(path: Column, quirks: str = INTENDED) -> Column:
    low, dot = F.lower(path), r"\." if quirks == INTENDED else r"\\[^\n\r]"
    return has(low, FLAG_PARTS) | low.rlike(rf"(?:{dot}|_)ff_[a-z0-9_]+")


def is_flag_call(callee: Column) -> Column:
    low = F.lower(callee)
    return has(low, FLAG_PARTS) | low.isin(*FLAG_CALLS)


def base_path(label: Column) -> Column:
    """The first two segments of a path or of an http URL's path."""
    absolute = label.startswith("http://") | label.startswith("https://")
    path = F.when(absolute, F.coalesce(url_pathname(label), label)).otherwise(label)
    segments = F.filter(F.split(before(before(path, "?"), "#"), "/"), lambda s: s != "")
    return F.concat(F.lit("/"), F.array_join(F.slice(segments, 1, 2), "/"))


def secret_value(label: Column, detail: Column) -> Column:
    return F.coalesce(F.nullif(detail, F.lit("")), label)


def csv_field(v: Column) -> Column:
    """Quoted if it has a comma, a quote or a newline."""
    text = F.coalesce(v, F.lit(""))
    return F.when(text.rlike('[,"\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)
