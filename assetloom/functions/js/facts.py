"""One parse of a program to flat facts.

Decisions about the shape of the tree are made here. Decisions about strings (is this literal a secret, is this name a flag's) are left to
Catalyst: such facts carry the string and are classified later.
"""

from __future__ import annotations

from dataclasses import dataclass

from assetloom.functions.js import flow, read
from assetloom.functions.js.syntax import Node, parse
from assetloom.functions.js.walk import bottom_up

# Fixed values.
FRAMEWORKS = ("react", "vue", "angular", "svelte", "solid", "preact")
NAMED_FRAMEWORKS = ("react", "vue", "angular", "svelte")
VERBS = frozenset(("get", "post", "put", "patch", "delete", "options", "head"))
INSERTS = frozenset(("append", "prepend", "replaceWith", "after", "before", "insertAdjacentHTML"))
METHOD_SINKS = frozenset(("append", "prepend", "replaceWith", "after", "before", "insertAdjacentHTML", "postMessage", "write", "writeln", "open", "setAttribute"))
WATCHED = {"document.cookie": "cookies", "document.domain": "document_domain", "window.name": "window_name"}
KIND = {"cookies": "cookie", "endpoints": "endpoint", "sinks": "sink", "user_sinks": "user_sink", "events": "event", "regexes": "regex", "frameworks": "framework", "dependencies": "dependency", "schemas": "schema", "secrets": "secret", "feature_flags": "feature_flag"}


@dataclass
class Fact:
    """What: finding (bucket known), literal or quasi (to classify), named (value under a name), flag (a name to test), word, edge, trace, status."""

    what: str
    bucket: str = ""
    label: str | None = None
    detail: str | None = None
    auth: str | None = None
    line: int | None = None
    col: int | None = None
    path: list[str] | None = None
    to: str | None = None
    to_line: int | None = None
    to_col: int | None = None


class Extractor:
    """Visitors of one program, in the order in which nodes are left."""

    def __init__(self) -> None:
        self.facts: list[Fact] = []
        self.seen: set[str] = set()
        self.words: set[str] = set()

    def find(self, bucket: str, label: str, node: Node | None, detail: str | None = None, auth: str | None = None, what: str = "finding") -> None:
        self.facts.append(Fact(what, bucket, label, detail, auth, node and node.line, node and node.col))

    def sink(self, label: str, node: Node, controlled: bool) -> None:
        self.find("sinks", label, node)
        if controlled:
            self.find("user_sinks", label, node)

    def named(self, name: str | None, value: Node | None, node: Node, context: str) -> None:
        literal = read.static(value)
        if name and literal:
            self.facts.append(Fact("named", "secrets", literal, context, None, node.line, node.col, to=name))

    def regex(self, literal: Node | None, node: Node, detail: str) -> None:
        if literal is not None and literal.regex:
            self.find("regexes", f"/{literal.regex[0]}/{literal.regex[1]}", node, detail)

    def on_ImportDeclaration(self, node: Node) -> None:
        lib = node.source.value.lower()
        for name in FRAMEWORKS:
            if name in lib:
                self.seen.add(name)
                self.find("frameworks", name, node)
        if not lib.startswith((".", "/")):
            self.find("dependencies", lib, node)

    def on_Identifier(self, node: Node) -> None:
        if node.name not in self.words:
            self.words.add(node.name)
            self.facts.append(Fact("word", label=node.name))
        low = node.name.lower()
        if low in NAMED_FRAMEWORKS and low not in self.seen:
            self.seen.add(low)
            self.find("frameworks", low, node)

    def on_Literal(self, node: Node) -> None:
        if isinstance(node.value, str):
            self.find("", node.value, node, what="literal")
        else:
            self.regex(node, node, "pattern")

    def on_TemplateLiteral(self, node: Node) -> None:
        for quasi in node.quasis:
            if quasi.raw:
                self.find("", quasi.raw, quasi, what="quasi")

    def on_TaggedTemplateExpression(self, node: Node) -> None:
        raw = "".join(q.raw for q in node.quasi.quasis)
        if (read.callee_of(node.tag) or "").lower() in ("gql", "graphql") and raw:
            self.find("graphql", raw, node, what="tagged")

    def on_VariableDeclarator(self, node: Node) -> None:
        name = node.id.name if node.id.type == "Identifier" else None
        self.named(name, node.init, node, "var-context")
        if name and read.toggle(node.init):
            self.find("feature_flags", name, node, "var", what="flag_name")
        if read.schema(node.init):
            self.find("schemas", "object schema", node)

    def on_ObjectExpression(self, node: Node) -> None:
        if read.schema(node):
            self.find("schemas", "object schema", node)

    def on_CallExpression(self, node: Node) -> None:
        callee, args = node.callee, node.arguments
        first, second = (args + [None, None])[:2]
        controlled, name = any(map(read.user_controlled, args)), read.callee_of(callee) or ""
        target = read.endpoint(first)
        if name and target:
            self.facts.append(Fact("flag_call", "feature_flags", target, f"call:{name}", None, first.line, first.col, to=name))
        if callee.type == "Identifier":
            self.plain_call(node, name, first, second, target)
        elif callee.type == "MemberExpression":
            if not self.method_call(node, controlled, first, second, target):
                return
        if callee.type == "Identifier" and name in read.CALL_SINKS:
            self.sink(name, node, controlled)

    def plain_call(self, node: Node, name: str, first: Node | None, second: Node | None, target: str | None) -> None:
        if name == "require" and target and not target.startswith((".", "/")):
            self.find("dependencies", target, node)
        elif name == "fetch":
            if target:
                self.find("endpoints", target, first, "fetch", read.auth_hint(second))
            if keys := [k for k, _ in read.members(second)]:
                self.find("fetch_options", "fetch options", second, ", ".join(keys))
        elif name == "URLSearchParams":
            self.find("urlsearchparams", "URLSearchParams", node)
        elif name == "open":
            self.find("window_open", "window.open", node)
        elif name == "axios" and (url := read.url_option(first)):
            self.find("endpoints", url, first, "axios", read.auth_hint(first))

    def method_call(self, node: Node, controlled: bool, first: Node | None, second: Node | None, target: str | None) -> bool:
        """Whether the visitor goes on after the guards of the sinks."""
        prop, obj = read.member_name(node.callee), node.callee.object
        prop = prop if isinstance(prop, str) else ""
        path, owner = read.path_of(obj), obj.name if obj.type == "Identifier" else None
        if prop == "open" and (url := read.endpoint(second)):
            self.find("endpoints", url, second, "XMLHttpRequest")
        if prop == "addEventListener" and read.text_of(first) is not None:
            self.find("events", first.value, first)
        if prop == "test":
            self.regex(obj, node, "match")
        if prop in ("match", "search", "replace"):
            self.regex(first, node, "match")
        if prop in ("assign", "replace", "reload") and path and "location" in path:
            self.find("location", f"location.{prop}", node, "assignment")
        if prop == "open" and path and (path == "window" or path.endswith(".window")):
            self.find("window_open", "window.open", node)
        if prop in METHOD_SINKS:
            if prop == "setAttribute":
                name = (read.name_of(first) or "").lower()
                if name in read.ATTRIBUTE_SINKS:
                    self.sink(f"setAttribute:{name}", node, read.user_controlled(second))
                return False
            shut = {
                "open": not (path or "").startswith(("window", "document")),
                "write": "document" not in (path or ""),
                "writeln": "document" not in (path or ""),
            }.get(prop, prop in INSERTS and not controlled and not read.html_like(node.arguments))
            if shut:
                return False
            self.sink(prop, node, controlled)
        if owner == "axios":
            if prop in ("get", "post", "put", "delete", "patch", "request") and target:
                self.find("endpoints", target, first, "axios", read.auth_hint(second))
            if prop == "request" and (url := read.url_option(first)):
                self.find("endpoints", url, first, "axios", read.auth_hint(first))
        elif owner and prop in VERBS and target:
            self.find("rest_client", target, first, f".{prop}")
        if owner in ("$", "jQuery") and prop in ("ajax", "get", "post", "getJSON", "getScript"):
            if url := (prop == "ajax" and read.url_option(first)) or target:
                self.find("endpoints", url, first, f"jquery.{prop}")
        if owner == "navigator" and prop == "sendBeacon" and target:
            self.find("endpoints", target, first, "sendBeacon")
        if prop in ("setTimeout", "setInterval"):
            self.sink(prop, node, controlled)
        return True

    def on_NewExpression(self, node: Node) -> None:
        name = node.callee.name if node.callee.type == "Identifier" else None
        first = node.arguments[0] if node.arguments else None
        if name in ("WebSocket", "EventSource") and (url := read.endpoint(first)):
            self.find("endpoints", url, first, name)
        elif name == "Function":
            self.sink(name, node, any(map(read.user_controlled, node.arguments)))
        elif name == "URLSearchParams":
            self.find("urlsearchparams", name, node)
        elif name == "RegExp" and (pattern := read.static(first)):
            self.find("regexes", f"/{pattern}/", node, "pattern")

    def watch(self, path: str, node: Node, how: str) -> None:
        if path in WATCHED:
            self.find(WATCHED[path], path, node, how)
        elif path in ("window.location", "document.location") or path.startswith("location."):
            self.find("location", path, node, how)

    def on_MemberExpression(self, node: Node) -> None:
        if path := read.path_of(node):
            self.find("feature_flags", path, node, "member", what="flag_path")
            self.watch(path, node, "read")
        owner = node.object
        name = owner.name if owner.type == "Identifier" else None
        if name in ("localStorage", "sessionStorage"):
            self.find("sinks", name, node)
            self.find("storage", name, node)
        within = owner.type == "MemberExpression" and owner.object.type == "Identifier" and owner.object.name == "window" and owner.property.name == "crypto"
        if name == "crypto" or within:
            self.find("sinks", "crypto", node)

    def on_AssignmentExpression(self, node: Node) -> None:
        left = node.left
        if left.type == "MemberExpression":
            prop = read.member_name(left)
            if left.object.type == "Identifier" and left.object.name == "window" and left.property.name in ("onmessage", "onhashchange"):
                self.find("events", f"window.{left.property.name}", node)
            if isinstance(prop, str) and prop in read.ASSIGNED_SINKS:
                self.sink(prop, node, read.user_controlled(node.right))
            if path := read.path_of(left):
                self.watch(path, node, "assignment")
        self.named(read.callee_of(left), node.right, node, "assign-context")

    def on_Property(self, node: Node) -> None:
        name = read.name_of(node.key)
        if name == "dangerouslySetInnerHTML":
            self.sink(name, node, read.user_html(node.value))
        if not name:
            return
        if node.value.type == "ObjectExpression":
            for flag, p in read.members(node.value):
                self.facts.append(Fact("flag_toggled" if read.toggle(p.value) else "flag_inside", "feature_flags", flag, f"container:{name}", None, p.line, p.col, to=name))
        elif read.toggle(node.value):
            self.find("feature_flags", name, node, "property", what="flag_name")
        self.named(name, node.value, node, "key-context")


_VISITORS = tuple(n for n in dir(Extractor) if n.startswith("on_"))
#: Steps of the analysis, by what their facts are read for.
STEPS = ("findings", "calls", "traces")


def extract(source: str, steps: tuple[str, ...] = STEPS) -> list[Fact]:
    """The facts of a source text by the steps named, in the order of all; one of status ``failed`` if it is no program."""
    program = parse(source)
    if program is None:
        return [Fact("status", label="failed")]
    out: list[Fact] = []
    if "findings" in steps:
        own = Extractor()
        bottom_up(program, {n[3:]: getattr(own, n) for n in _VISITORS})
        out += own.facts
    if "calls" in steps or "traces" in steps:
        edges, functions = flow.call_graph(program)
        if "calls" in steps:
            out += [Fact("edge", label=caller, to=callee, line=line, col=col) for caller, callee, line, col in edges]
        for t in flow.traces(program, functions) if "traces" in steps else ():
            out.append(Fact("trace", label=t.source.label, detail=t.source.kind, line=t.source.line, col=t.source.col, path=list(t.path), to=t.sink.label, to_line=t.sink.line, to_col=t.sink.col))
    return [*out, Fact("status", label="parsed")]
