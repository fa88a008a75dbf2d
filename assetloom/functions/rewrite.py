"""Unpacking of common script packers, by reading them; nothing is evaluated.

Unpackers are (priority, detect, unpack). All are asked about the original text first, and those that know it are applied in order of
priority. A fault in one leaves the text as it was.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable
from dataclasses import dataclass
from urllib.parse import unquote, unquote_plus

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from assetloom.functions.js import read
from assetloom.functions.js.beautify import Options, beautify
from assetloom.functions.js.syntax import Node, Parser, SyntaxFault


@dataclass(frozen=True)
class Unpacker:
    name: str
    priority: int
    detect: Callable[[str], bool]
    unpack: Callable[[str], str]


def _url_detect(text: str) -> bool:
    return " " not in text and ("%20" in text or text.count("%") > 3)


def _url_unpack(text: str) -> str:
    return unquote_plus(text) if _url_detect(text) else text


# How packed code starts, the digits of its numbers, the masking packer's table of names, and the warning that goes before what it hid.
PACKED = re.compile(r"eval *\( *function *\( *p *, *a *, *c *, *k *, *e *, *")
DIGITS = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
PRINTABLE = "".join(map(chr, range(32, 127)))
MASK = r'["\x41\x42\x43\x44\x45\x46\x47\x48\x49\x4A\x4B\x4C\x4D\x4E\x4F\x50\x51\x52\x53\x54\x55\x56\x57\x58\x59\x5A\x61\x62\x63\x64\x65\x66\x67\x68\x69\x6A\x6B\x6C\x6D\x6E\x6F\x70\x71\x72\x73\x74\x75\x76\x77\x78\x79\x7A\x30\x31\x32\x33\x34\x35\x36\x37\x38\x39\x2B\x2F\x3D","","\x63\x68\x61\x72\x41\x74","\x69\x6E\x64\x65\x78\x4F\x66","\x66\x72\x6F\x6D\x43\x68\x61\x72\x43\x6F\x64\x65","\x6C\x65\x6E\x67\x74\x68"]'
WARNING = """//
// Unpacker warning: be careful when using myobfuscate.com for your projects:
// scripts obfuscated by the free online version call back home.
//

"""

# Packed code: a call eval(function(p, a, c, k, e, ...) {...}(payload, base, count, names)) in which the names of the payload are numbers. The call is read by the
# parser, so its end is where the parser stops, and every number that can occur is spelled beforehand.


def spelled(n: int, base: int) -> str:
    """A number in a base up to 62, or in one of 95 printable characters."""
    if base != len(PRINTABLE) and not 2 <= base <= len(DIGITS):
        raise ValueError(f"no digits for base {base}")
    digits, out = PRINTABLE if base == len(PRINTABLE) else DIGITS, ""
    while not out or n:
        n, digit = divmod(n, base)
        out = digits[digit] + out
    return out


def _quoted(reader: Parser, node: Node | None) -> str:
    """A string literal as it is written, but for escaped quotes and backslashes."""
    if read.text_of(node) is None:
        raise ValueError("no string here")
    start = reader.starts[node.line - 1] + node.col - 1
    inside = string_at(reader.text, start)[1:-1]
    return re.sub(r"\\([\\'])", r"\1", inside)


def _packed_unpack(text: str) -> str:
    """Puts names back for numbers, and strings for places in a table of strings."""
    if not (head := PACKED.search(text)):
        raise ValueError("no packed code")
    reader = Parser(text[head.start() :], False)
    outer = reader.expression()
    inner = outer.arguments[0]
    payload, base, count, names = inner.arguments[:4]
    table = _quoted(reader, names.callee.object).split("|")
    base = 62 if base.type == "ArrayExpression" else int(base.value)
    if int(count.value) != len(table):
        raise ValueError("the table of names is incomplete")
    known = {(word := spelled(n, base)): name or word for n, name in enumerate(table)}
    source = re.sub(r"[A-Za-z0-9_]+", lambda m: known[m[0]], _quoted(reader, payload))
    if strings := re.search(r"var *(_\w+)=\[(?=\")", source):
        return _inlined(source, strings)
    return text[: head.start()] + source + reader.text[reader.prev_end :]


# Tables of strings: var name = ["...", ...]; with name[0], name[1] ... after it.
_TABLE = re.compile(r"var _0x[a-f0-9]+ ?= ?\[")


def string_at(text: str, start: int) -> str | None:
    """The string literal that starts there, with its quotes."""
    found = re.compile(r"""(["'])(?:\\.|(?!\1).)*\1""", re.DOTALL).match(text, start)
    return found and found[0]


def _inlined(text: str, head: re.Match) -> str:
    """What follows a table of strings, with its places replaced by what they hold; head ends behind the opening bracket."""
    items, at = [], head.end()
    while item := string_at(text, at):
        items.append(item)
        at = re.compile(r"\s*,?\s*").match(text, at + len(item)).end()
    close = re.compile(r"\s*\]\s*;").match(text, at)
    if not close:
        raise ValueError("not a table of strings")
    name = re.search(r"(\w+) ?= ?\[$", head[0])[1]
    return re.sub(rf"\b{name}\[(\d+)\]", lambda m: items[int(m[1])] if int(m[1]) < len(items) else m[0], text[: head.start()] + text[close.end() :])


def _array_unpack(text: str) -> str:
    return _inlined(text, head) if (head := _TABLE.match(text)) else text


# Masked code: a string that is reversed base64 of percent-escaped HTML, named in a chain of calls inside of eval.


def _masked_unpack(text: str) -> str:
    values = {m[1]: string_at(text, m.end())[1:-1] for m in re.finditer(r"\bvar (\w+)\s*=\s*(?=')", text) if string_at(text, m.end())}
    asked = [m[1] for m in re.finditer(r"\beval\((?:\w+\()+(\w+)\)+;", text) if m[1] in values]
    if not asked:
        raise ValueError("no masked string")
    html = unquote(base64.b64decode(values[asked[0]][::-1]).decode())
    before, after = "var _escape='<script>", "</script>'"
    hidden = html.startswith(before) and after in html
    return WARNING + (html[len(before) : html.rindex(after)] if hidden else text)


REGISTRY: tuple[Unpacker, ...] = tuple(
    sorted(
        (
            Unpacker("urlencode", 0, _url_detect, _url_unpack),
            Unpacker("packer", 1, lambda t: bool(PACKED.search(t)), _packed_unpack),
            Unpacker("array", 1, lambda t: bool(_TABLE.match(t)), _array_unpack),
            Unpacker("masked", 1, lambda t: MASK in t, _masked_unpack),
        ),
        key=lambda u: u.priority,
    )
)


def unpack(text: str | None, registry: tuple[Unpacker, ...] = REGISTRY) -> str | None:
    """The text with every known packer undone; as it was where one fails."""
    out = text
    try:
        for unpacker in [u for u in registry if text and u.detect(text)]:
            out = unpacker.unpack(out)
    except (ValueError, IndexError, KeyError, TypeError, AttributeError, SyntaxFault, RecursionError):  # not what the packer writes
        return text
    return out


@F.pandas_udf(StringType())
def unpacked(source: pd.Series) -> pd.Series:
    return source.map(unpack)


def beautified(options: Options = Options(indent_size=2)):
    """Unpacking and pretty-printing as a vectorised function; the text itself where that fails."""

    def one(text: str | None) -> str | None:
        try:
            return beautify(text, options, REGISTRY) if text else text
        except Exception:  # a fault in one text is no reason to lose the others
            return text

    return F.pandas_udf(lambda s: s.map(one), StringType())


def deobfuscator(function: Callable[[str], str | None]):
    """A user's function of one text as a vectorised one; empty results and faults are null."""

    def one(text: str | None) -> str | None:
        try:
            return (function(text) or None) if text else None
        except Exception:  # the plug-in's
            return None

    return F.pandas_udf(lambda s: s.map(one), StringType())
