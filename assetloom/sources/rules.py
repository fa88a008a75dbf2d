"""Signature rules: reading, checking, and their patterns in Java's dialect."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import SparkSession

from assetloom.functions.text import SPACE


@dataclass(frozen=True)
class Rule:
    id: str
    pattern: str
    kind: str | None = None
    label: str | None = None
    flags: str = "i"

    @property
    def java(self) -> str:
        return to_java(self.pattern, self.flags or "i")


# Fixed values.
DEFAULTS = (
    Rule("aws-access-key", "AKIA[0-9A-Z]{16}", "secret", "AWS Access Key"),
    Rule("stripe-secret", "sk_live_[0-9a-zA-Z]{16,}", "secret", "Stripe Secret Key"),
    Rule("github-token", "ghp_[0-9A-Za-z]{20,}", "secret", "GitHub Token"),
    Rule("firebase-api-key", "AIza[0-9A-Za-z\\-_]{20,}", "secret", "Firebase API Key"),
    Rule("graphql-endpoint", "/graphql", "endpoint", "GraphQL Endpoint"),
    Rule("webhook-url", "webhook", "endpoint", "Webhook URL"),
)


def to_java(pattern: str, flags: str) -> str:
    """An ECMAScript pattern as Java reads it: an end without ``m`` is the very end, white space is the Unicode set, ``[`` in a class is a character."""
    out, in_class, at = [], False, 0
    while at < len(pattern):
        c = pattern[at]
        if c == "\\":
            two = pattern[at : at + 2]
            out.append({r"\s": SPACE if in_class else f"[{SPACE}]", r"\S": two if in_class else f"[^{SPACE}]"}.get(two, two))
            at += 2
            continue
        if c == "[" and in_class:
            out.append(r"\[")
        elif c == "&" and in_class:
            out.append(r"\&")
        elif c == "$" and not in_class and "m" not in flags:
            out.append(r"\z")
        else:
            in_class = (in_class or c == "[") and c != "]"
            out.append(c)
        at += 1
    given = "".join(f for f in "ims" if f in flags)
    return (f"(?{given})" if given else "") + "".join(out)


def valid(spark: SparkSession, rules: list[Rule]) -> list[Rule]:
    """Rules with an id whose patterns Java accepts; one that it doesn't would fail a job."""
    compile_ = spark._jvm.java.util.regex.Pattern.compile

    def good(rule: Rule) -> bool:
        if not (rule.id and rule.pattern) or re.search(r"[^dgimsuvy]", rule.flags or ""):
            return False
        try:
            compile_(rule.java)
            return True
        except Exception:  # the JVM's complaint about the pattern
            return False

    return [r for r in rules if good(r)]


def load_rules(spark: SparkSession, path: str | None = None) -> list[Rule]:
    """Rules of a JSON file (an array, or an object with ``rules``); the defaults if there is nothing usable."""
    found: list[Rule] = []
    if path:
        try:
            data = json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))
            rows = data if isinstance(data, list) else data.get("rules", [])
            found = [Rule(r["id"], r["pattern"], r.get("kind"), r.get("label"), r.get("flags") or "i") for r in rows if isinstance(r, dict) and r.get("id") and r.get("pattern")]
        except Exception:  # unreadable or not JSON
            found = []
    return valid(spark, found or list(DEFAULTS))
