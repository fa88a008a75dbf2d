"""Orders of traversal over ESTree nodes.

A node's parts are given in source order by FIELDS. A part in a pattern's place is only followed where it holds code: names that are
declared or assigned are not visited, nor are the keys of members and properties unless they are computed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from assetloom.functions.js.syntax import Node

#: Fields in order; a star marks a pattern's place.
FIELDS = {
    "Program": ("body",), "BlockStatement": ("body",), "StaticBlock": ("body",), "ExpressionStatement": ("expression",), "ChainExpression": ("expression",), "LabeledStatement": ("body",),
    "IfStatement": ("test", "consequent", "alternate"), "ConditionalExpression": ("test", "consequent", "alternate"), "WithStatement": ("object", "body"), "SwitchStatement": ("discriminant", "cases"),
    "SwitchCase": ("test", "consequent"), "ReturnStatement": ("argument",), "YieldExpression": ("argument",), "AwaitExpression": ("argument",), "ThrowStatement": ("argument",), "SpreadElement": ("argument",),
    "UnaryExpression": ("argument",), "UpdateExpression": ("argument",), "TryStatement": ("block", "handler", "finalizer"), "CatchClause": ("*param", "body"), "WhileStatement": ("test", "body"),
    "DoWhileStatement": ("body", "test"), "ForStatement": ("init", "test", "update", "body"), "ForInStatement": ("*left", "right", "body"), "ForOfStatement": ("*left", "right", "body"),
    "VariableDeclaration": ("declarations",), "VariableDeclarator": ("*id", "init"), "FunctionDeclaration": ("*id", "*params", "body"), "FunctionExpression": ("*id", "*params", "body"),
    "ArrowFunctionExpression": ("*params", "body"), "RestElement": ("*argument",), "ArrayPattern": ("*elements",), "AssignmentPattern": ("*left", "right"), "ArrayExpression": ("elements",),
    "ObjectExpression": ("properties",), "SequenceExpression": ("expressions",), "TemplateLiteral": ("quasis", "expressions"), "BinaryExpression": ("left", "right"), "LogicalExpression": ("left", "right"),
    "AssignmentExpression": ("*left", "right"), "NewExpression": ("callee", "arguments"), "CallExpression": ("callee", "arguments"), "ExportNamedDeclaration": ("declaration", "source"),
    "ExportDefaultDeclaration": ("declaration",), "ExportAllDeclaration": ("source",), "ImportDeclaration": ("source",), "ImportExpression": ("source",), "TaggedTemplateExpression": ("tag", "quasi"),
    "ClassDeclaration": ("*id", "superClass", "body"), "ClassExpression": ("*id", "superClass", "body"), "ClassBody": ("body",),
}
#: (name, whether in a pattern's place) of the fields of each type.
_SPLIT = {kind: tuple((f.lstrip("*"), f[0] == "*") for f in fields) for kind, fields in FIELDS.items()}
_KEYED = ("Property", "MethodDefinition", "PropertyDefinition")
FUNCTIONS = ("FunctionDeclaration", "FunctionExpression", "ArrowFunctionExpression")


def parts(node: Node) -> Iterator[tuple[Node, bool]]:
    """(part, whether it is in a pattern's place), in order."""
    kind = node.type
    if kind == "MemberExpression":
        yield node.object, False
        if node.computed:
            yield node.property, False
    elif kind in _KEYED:
        if node.computed:
            yield node.key, False
        if node.value is not None:
            yield node.value, False
    elif kind == "ObjectPattern":
        for p in node.properties:
            if p.type == "Property":
                if p.computed:
                    yield p.key, False
                yield p.value, True
            else:
                yield p.argument, True
    else:
        own = node.__dict__
        for field, pattern in _SPLIT.get(kind, ()):
            value = own.get(field)
            if value.__class__ is list:
                for part in value:
                    if part is not None:
                        yield part, pattern
            elif value is not None:
                yield value, pattern


def bottom_up(node: Node, visit: dict[str, Callable[[Node], None]]) -> None:
    """Calls the visitor of each node after those of its parts."""
    for part, pattern in parts(node):
        if not (pattern and part.type == "Identifier"):
            bottom_up(part, visit)
    if node.type in visit:
        visit[node.type](node)


def with_ancestors(node: Node, call: Callable[[Node, list[Node]], None], above: list[Node] | None = None) -> None:
    """Calls for each node, after its parts, with all nodes from the root down to it."""
    above = [] if above is None else above
    above.append(node)
    for part, _ in parts(node):
        with_ancestors(part, call, above)
    call(node, above)
    above.pop()
