"""Call graph and source-to-sink traces of one program.

Taint is a set of (source, chain of names) for each name. Statements are taken in source order without regard to branches, a name's taint is set and
never cleared, and each function is summarised twice with its parameters as sources, so that chains pass through two calls.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from assetloom.functions.js import read
from assetloom.functions.js.syntax import Node
from assetloom.functions.js.walk import FUNCTIONS, parts, with_ancestors

PASSES, TOP, PARAM = 2, "<top>", "param"


@dataclass(frozen=True)
class Point:
    label: str
    line: int
    col: int
    kind: str = "source"


@dataclass(frozen=True)
class Taint:
    source: Point
    chain: tuple[str, ...]

    def into(self, name: str) -> Taint:
        return Taint(self.source, (*self.chain, name))


@dataclass(frozen=True)
class Trace:
    source: Point
    sink: Point
    path: tuple[str, ...]


@dataclass
class Summary:
    params: list[str]
    reaches: dict[int, list[Trace]] = field(default_factory=dict)


def function_name(above: list[Node]) -> str:
    """Name of the function at the end of the ancestors: its own, or that of what it is assigned to at any depth."""
    node = above[-1]
    if node.id is not None:
        return node.id.name
    for outer in reversed(above):
        name = None
        if outer.type == "VariableDeclarator" and outer.id.type == "Identifier":
            name = outer.id.name
        elif outer.type == "AssignmentExpression":
            name = read.callee_of(outer.left)
        elif outer.type == "Property":
            name = read.name_of(outer.key)
        if name:
            return name
    return f"anonymous@{node.line}:{node.col}"


def call_graph(program: Node) -> tuple[list[tuple[str, str, int, int]], dict[str, Node]]:
    """((caller, callee, line, col) of each call, the first function found of each name)."""
    edges: list[tuple[str, str, int, int]] = []
    functions: dict[str, Node] = {}

    def visit(node: Node, above: list[Node]) -> None:
        if node.type in FUNCTIONS:
            functions.setdefault(function_name(above), node)
        elif node.type == "CallExpression" and (callee := read.callee_of(node.callee)):
            depth = next((i for i in range(len(above) - 1, -1, -1) if above[i].type in FUNCTIONS), None)
            edges.append((TOP if depth is None else function_name(above[: depth + 1]), callee, node.line, node.col))

    with_ancestors(program, visit)
    return edges, functions


def parameters(node: Node) -> list[str]:
    inner = [p.left if p.type == "AssignmentPattern" else p for p in node.params or []]
    return [p.name for p in inner if p is not None and p.type == "Identifier"]


def source_of(node: Node) -> Point | None:
    label = None
    if node.type == "MemberExpression":
        path = read.path_of(node)
        label = path if path in read.USER_PATHS else None
    elif node.type in ("CallExpression", "NewExpression"):
        path = read.callee_of(node.callee) or ""
        known = path == "URLSearchParams" or node.type == "CallExpression" and (path in read.STORED or path.endswith(".get") and "searchParams" in path)
        label = path if known else None
    return Point(label, node.line, node.col) if label else None


class Walk:
    """One pass over a body; functions inside it are left to passes of their own."""

    def __init__(self, summaries: dict[str, Summary], taints: dict[str, list[Taint]] | None = None) -> None:
        self.summaries, self.taints, self.traces = summaries, dict(taints or {}), []

    def value(self, node: Node | None) -> list[Taint]:
        if node is None:
            return []
        if source := source_of(node):
            return [Taint(source, (source.label,))]
        if node.type == "Identifier":
            return self.taints.get(node.name, [])
        if node.type == "MemberExpression":
            return self.taints.get(read.path_of(node) or "") or self.value(node.object)
        return [t for part in read.carried(node) for t in self.value(part)]

    def bind(self, target: Node, found: list[Taint]) -> None:
        name = read.callee_of(target)
        if name and found:
            self.taints[name] = [t.into(name) for t in found]

    def sink(self, label: str, node: Node, found: list[Taint]) -> None:
        point = Point(label, node.line, node.col, "sink")
        self.traces += [Trace(t.source, point, (*t.chain, label)) for t in found]

    def go(self, node: Node) -> list[Trace]:
        handler = getattr(self, f"on_{node.type}", None)
        if handler:
            handler(node)
        else:
            for part, _ in parts(node):
                self.go(part)
        return self.traces

    def on_FunctionDeclaration(self, node: Node) -> None:
        pass

    on_FunctionExpression = on_ArrowFunctionExpression = on_FunctionDeclaration

    def on_VariableDeclarator(self, node: Node) -> None:
        if node.init is not None:
            self.bind(node.id, self.value(node.init))
            self.go(node.init)

    def on_AssignmentExpression(self, node: Node) -> None:
        found = self.value(node.right)
        self.bind(node.left, found)
        if node.left.type == "MemberExpression" and (name := read.member_name(node.left)) in read.ASSIGNED_SINKS:
            self.sink(str(name), node, found)
        self.go(node.right)

    def on_CallExpression(self, node: Node) -> None:
        callee, args = read.callee_of(node.callee) or "", [self.value(a) for a in node.arguments]
        every, last = [t for a in args for t in a], callee.rpartition(".")[2] if "." in callee else ""
        timer = ("setTimeout", "setInterval")
        labels = [callee] * ((callee in read.CALL_SINKS) + (callee in timer) + (last in (*timer, "write", "writeln")))
        labels += [last] * (last in ("postMessage", "insertAdjacentHTML"))
        for label in labels:
            self.sink(label, node, every)
        if last == "setAttribute" and node.arguments and (name := read.name_of(node.arguments[0])) and name.lower() in read.ATTRIBUTE_SINKS:
            self.sink(f"setAttribute:{name.lower()}", node, args[1] if len(args) > 1 else [])
        if summary := self.summaries.get(callee):
            for n, found in enumerate(args[: len(summary.params)]):
                self.traces += [Trace(t.source, s.sink, (*t.chain, *s.path[1:])) for t in found for s in summary.reaches.get(n, ())]
        for a in node.arguments:
            self.go(a)

    def on_NewExpression(self, node: Node) -> None:
        if read.callee_of(node.callee) == "Function":
            self.sink("Function", node, [t for a in node.arguments for t in self.value(a)])
        for a in node.arguments:
            self.go(a)

    def on_Property(self, node: Node) -> None:
        if read.name_of(node.key) == "dangerouslySetInnerHTML":
            inner = [p.value for k, p in read.members(node.value) if k == "__html"] if node.value.type == "ObjectExpression" else [node.value]
            for value in inner:
                self.sink("dangerouslySetInnerHTML", node, self.value(value))
        self.go(node.value)


def summaries(functions: dict[str, Node]) -> dict[str, Summary]:
    found = {name: Summary(parameters(node)) for name, node in functions.items()}
    for _ in range(PASSES):
        for name, node in functions.items():
            params = parameters(node)
            seeds = {p: [Taint(Point(f"{PARAM}:{p}", node.line, node.col, PARAM), (f"{PARAM}:{p}",))] for p in params}
            done = Summary(params)
            for trace in Walk(found, seeds).go(node.body):
                if trace.source.kind == PARAM and (p := trace.source.label.partition(":")[2]) in params:
                    done.reaches.setdefault(params.index(p), []).append(trace)
            found[name] = done
    return found


def traces(program: Node, functions: dict[str, Node]) -> list[Trace]:
    """Traces of the top level, then of each function."""
    known = summaries(functions)
    return [t for root in (program, *(f.body for f in functions.values())) for t in Walk(known).go(root)]
