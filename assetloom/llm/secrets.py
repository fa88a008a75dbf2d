"""Secret scans: plain patterns, and an assignment-aware lexer.

The patterns give the base spans (``assign``, ``access``, ``hex``). The lexer adds ``literal`` spans: at each
assignment operator of source or configuration syntax it reads the name to the left and the value to the right. A value is a
sum of quoted strings, bare words and names bound earlier in the text, so constants are propagated: a
literal counts for every name that it reaches. A literal is a secret if the product of the sensitivity of the
best name that it reaches and its own likeness to a credential is high enough.

Defined results: a null text has no spans; spans are in code points, end exclusive. Repeated rows give repeated results. Other
columns are ignored. A text is read whole, and literals and sums of any length with it; each operator looks at a bounded stretch on its left and a value on its right. The work
is linear in the text, but for operators inside of one long bare word or sum, which each read the rest of it.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetloom.llm.common import slices

KINDS = ("assign", "access", "hex", "literal")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile("AKIA[A-Z0-9]{16,}")  # the runs that have 20 characters
_HEX = re.compile("[0-9a-f]{24,}")

_OPERATOR = re.compile(r":=|=>|[:=]")
_NAME_LEFT = re.compile(r"([A-Za-z_$][\w$.-]*)[\"'\]]{0,2}[ \t]*\Z", re.ASCII)
_LEFT = 96  # characters to the left of an operator in which its name starts
_TERM = re.compile(r"""\s*(?:(?P<q>["'`])(?P<s>(?:\\.|(?!(?P=q))[^\\\n])*)(?P=q)|(?P<w>[^\s"'`,;(){}\[\]<>+]+))""")
_PLUS = re.compile(r"\s*\+")
#: A term on a later line that is the name of an assignment of its own, or ends in a colon, isn't a value.
_NAMES = re.compile(r"[\w$.-]+(?::|=(?!=*\Z))", re.ASCII)
_ASSIGNED = re.compile(r"[ \t]*(?::=|=>|:|=(?!=))")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
#: How much a part of a name says that its value is secret.
_SENSITIVE = {"password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "auth": 0.7, "bearer": 0.8, "private": 0.6, "signing": 0.7, "encryption": 0.7, "key": 0.6, "salt": 0.5, "dsn": 0.6}
#: Parts of a name that say it isn't.
_HARMLESS = {"public", "id", "name", "type", "length", "count", "size", "path", "file", "url", "expiry", "ttl", "hint", "field", "label", "limit", "max", "min"}
_PLACEHOLDER = re.compile(r"(?i)^(?:change_?me|example|placeholder|your[_-].*|x+|\*+|none|null|true|false|todo|test|dummy|redacted)$|[$%]\{|^\$|<|\{\{")
THRESHOLD = 0.45


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, index of the kind, end) of the base patterns."""
    low = text.lower()
    found = []
    if any(w in low for w in ("passw", "secret", "token", "apikey", "api_key")):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def name_weight(name: str) -> float:
    """0 to 1: how sensitive a target name is."""
    parts = [p.lower() for p in _PARTS.findall(name.rpartition(".")[2])]
    joined = [a + b for a, b in zip(parts, parts[1:], strict=False)]
    weight = max((_SENSITIVE.get(p, 0.0) for p in parts + joined), default=0.0)
    return weight * (0.4 if any(p in _HARMLESS for p in parts) else 1.0)


def literal_weight(value: str, quoted: bool) -> float:
    """0 to 1: how much a literal looks like a credential."""
    if len(value) < 6 or any(c.isspace() for c in value) or _PLACEHOLDER.search(value):
        return 0.0
    counts = Counter(value)
    entropy = -sum(n / len(value) * math.log2(n / len(value)) for n in counts.values())
    kinds = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", r"\d", r"[^\w]"))
    if not quoted and (kinds < 2 or not re.search(r"\d", value)):
        return 0.0  # a bare word of prose
    return min(1.0, entropy / 3.0) * (1.0 if kinds >= 2 else 0.7)


def terms(text: str, at: int) -> Iterator[re.Match]:
    """The terms of the sum that starts at ``at``; it goes on over line breaks after an operator and around a plus."""
    while term := _TERM.match(text, at):
        start = term.start("s") - 1 if term["q"] else term.start("w")
        if "\n" in text[at:start] or "\r" in text[at:start]:
            if _ASSIGNED.match(text, term.end()) or not term["q"] and _NAMES.match(term["w"]):
                return
        yield term
        if not (plus := _PLUS.match(text, term.end())):
            return
        at = plus.end()


def literal_spans(text: str) -> list[tuple[int, int, int]]:
    """Spans that the lexer adds.

    Each assignment is a node with the literals of its sum and the nodes of the names in it, which are all earlier; so one
    pass from the last node to the first takes the weight of the most sensitive name to all that reaches it.
    """
    bound: dict[str, int] = {}
    weights: list[float] = []
    own: list[list[tuple[int, int, bool]]] = []
    earlier: list[set[int]] = []
    for op in _OPERATOR.finditer(text):
        after = text[op.end() : op.end() + 1]
        if after in ("=", "/") or text[op.start() - 1 : op.start()] in ("=", "!", "<", ">"):
            continue  # comparisons and URLs
        left = _NAME_LEFT.search(text[max(0, op.start() - _LEFT) : op.start()])
        if not left:
            continue
        literals, names = [], set()
        for term in terms(text, op.end()):
            if term["q"]:
                literals.append((term.start("s"), term.end("s"), True))
            elif (known := bound.get(term["w"])) is not None:
                names.add(known)
            else:
                literals.append((term.start("w"), term.end("w"), False))
        if literals or names:
            bound[left[1]] = len(weights)
            weights.append(name_weight(left[1]))
            own.append(literals)
            earlier.append(names)
    best: dict[tuple[int, int, bool], float] = {}
    for n in range(len(weights) - 1, -1, -1):
        if weights[n]:
            for k in earlier[n]:
                weights[k] = max(weights[k], weights[n])
            for literal in own[n]:
                best[literal] = max(weights[n], best.get(literal, 0.0))
    return sorted({(s, 3, e) for (s, e, quoted), weight in best.items() if weight >= THRESHOLD and weight * literal_weight(text[s:e], quoted) >= THRESHOLD})


def spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans: a literal that lies within one base span adds nothing."""
    base = base_spans(text)
    added = []
    if ":" in text or "=" in text:
        reach, at = -1, 0  # the furthest end of the base spans that start no later
        for start, end, kind in sorted((s, e, k) for s, k, e in literal_spans(text)):
            while at < len(base) and base[at][0] <= start:
                reach = max(reach, base[at][2])
                at += 1
            if reach < end:
                added.append((start, kind, end))
    return base, sorted(base + added)


def joined(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in found)


def redacted(text: str, found: list[tuple[int, int, int]]) -> str:
    """The text with each stretch of touching spans replaced by a mark."""
    out, at = [], 0
    for start, _, end in found:
        if start >= at:
            out += [text[at:start], "<secret>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, sha, every = ([], [], []), [], []
            for text in batch.column(1):
                base, found = spans(text.as_py() or "")
                kinds = Counter(k for _, k, _ in base)
                for k in range(3):
                    counts[k].append(kinds[k])
                sha.append(hashlib.sha256(joined(base).encode()).hexdigest())
                every.append(joined(found))
            yield pa.record_batch(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(sha, pa.string()), pa.array(every, pa.string())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """The documents, all columns, with secrets in the text replaced; a null text stays null. length_col: a count of characters that follows the text."""
    at = docs.columns.index(text_col)
    counted = docs.columns.index(length_col) if length_col else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            was = batch.column(at).to_pylist()
            texts = [t if t is None else redacted(t, spans(t)[1]) for t in was]
            columns = [pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(batch.columns)]
            if length_col:
                less = [0 if t is None else len(t) - len(old) for t, old in zip(texts, was, strict=True)]
                columns[counted] = pc.add(columns[counted], pa.array(less, columns[counted].type))
            yield pa.record_batch(columns, names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
