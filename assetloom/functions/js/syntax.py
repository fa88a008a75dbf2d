"""A parser of ECMAScript to ESTree-shaped nodes, by precedence climbing over an on-demand scanner.

Arrow parameters and destructuring targets are read as expressions and turned into patterns when ``=>`` or ``=`` follows.
"""

from __future__ import annotations

import re


class SyntaxFault(Exception):
    """The text is not a program."""


class Node:
    """A node; fields it doesn't have read as None."""

    def __init__(self, type: str, line: int, col: int, **given: object) -> None:
        self.type, self.line, self.col = type, line, col
        self.__dict__.update(given)

    def __getattr__(self, name: str) -> None:
        if name.startswith("__"):
            raise AttributeError(name)
        return None


_START, _PART = r"(?:[$_\w]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})", r"(?:[$\w\u200c\u200d]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})"
_NAME = re.compile(rf"(?!\d){_START}{_PART}*")
_NUMBER = re.compile(r"0[xX][0-9a-fA-F_]+n?|0[oO][0-7_]+n?|0[bB][01_]+n?|(?:(?:\d[\d_]*)?\.\d[\d_]*|\d[\d_]*\.?)(?:[eE][+-]?\d[\d_]*)?n?")
_SKIP = re.compile(r"(?:[\t\x0b\x0c \xa0\ufeff\u1680\u2000-\u200a\u202f\u205f\u3000]|//[^\n\r\u2028\u2029]*|/\*[^*]*\*+(?:[^/*][^*]*\*+)*/|[\n\r\u2028\u2029])*")
_BREAK = re.compile("[\n\r\u2028\u2029]")
_LINE = re.compile("\r\n|[\n\r\u2028\u2029]")
_PUNCT = re.compile(r">>>=|\.\.\.|\*\*=|<<=|>>=|>>>|===|!==|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\*\*|[{}()\[\];,<>+\-*/%&|^!~?:=.@#]")
_STRING = {q: re.compile(rf"{q}(?:[^{q}\\\n\r]|\\(?:\r\n|[\s\S]))*{q}") for q in "'\""}
_REGEX = re.compile(r"/(?!\*)((?:[^/\\\[\n\r\u2028\u2029]|\\[^\n\r\u2028\u2029]|\[(?:[^\]\\\n\r\u2028\u2029]|\\[^\n\r\u2028\u2029])*\])+)/([A-Za-z]*)")
_TOKEN = re.compile("|".join((f"(?P<name>{_NAME.pattern})", rf"(?P<number>(?=\.?\d)(?:{_NUMBER.pattern}))", f"(?P<string>{'|'.join(p.pattern for p in _STRING.values())})", f"(?P<punct>{_PUNCT.pattern})")))
_ESCAPE = re.compile(r"\\(?:u\{([0-9a-fA-F]+)\}|u([0-9a-fA-F]{4})|x([0-9a-fA-F]{2})|([0-3]?[0-7]{1,2})|(\r\n|[\s\S]))")
_SIMPLE = {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f", "v": "\v", "\r\n": "", "\n": "", "\r": "", "\u2028": "", "\u2029": ""}
_BINARY = {"??": 1, "||": 2, "&&": 3, "|": 4, "^": 5, "&": 6, **dict.fromkeys(("==", "!=", "===", "!=="), 7), **dict.fromkeys(("<", ">", "<=", ">=", "instanceof", "in"), 8), **dict.fromkeys(("<<", ">>", ">>>"), 9), "+": 10, "-": 10, "*": 11, "/": 11, "%": 11, "**": 12}
_ASSIGN = {"=", "+=", "-=", "*=", "/=", "%=", "**=", "<<=", ">>=", ">>>=", "&=", "|=", "^=", "&&=", "||=", "??="}
_UNARY = {"!", "~", "+", "-", "typeof", "void", "delete"}
RESERVED = frozenset(
    "break case catch class const continue debugger default delete do else export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with enum".split()
)


def unescaped(text: str) -> str:
    """The value of the inside of a string literal."""
    if "\\" not in text:
        return text

    def one(m: re.Match) -> str:
        wide, four, two, octal, char = m.groups()
        code = wide or four or two
        if code:
            return chr(int(code, 16)) if int(code, 16) <= 0x10FFFF else ""
        return chr(int(octal, 8)) if octal else _SIMPLE.get(char, char)

    joined = _ESCAPE.sub(one, text)
    return re.sub("[\ud800-\udbff][\udc00-\udfff]", lambda m: m[0].encode("utf-16", "surrogatepass").decode("utf-16"), joined)


class Parser:
    def __init__(self, text: str, module: bool) -> None:
        self.text, self.module = text, module
        self.starts = [0, *(m.end() for m in _LINE.finditer(text))]
        self.at_line = self.start = 0
        #: The token that was looked ahead at, by the position it was asked for; and the place of the current one.
        self.ahead: tuple[int, tuple] = (-1, ())
        self.here: tuple[int, int] | None = None
        self.pos = _LINE.search(text).end() if text.startswith("#!") and _LINE.search(text) else len(text) if text.startswith("#!") else 0
        self.prev_end = 0
        self.returns = self.loops = 0
        self.switches = 0
        self.no_in = False
        self.awaits, self.yields = module, False
        self.scan()

    # Scanning: kind, value and extent of the current token, and whether a line break precedes it.

    def token(self, pos: int) -> tuple[str, str, int, int, bool, bool]:
        """Kind, value, start and end of the token at or after a position, whether a line break precedes it, and whether it is a name with escapes."""
        text = self.text
        start = _SKIP.match(text, pos).end()
        newline = start > pos and _BREAK.search(text, pos, start) is not None
        m = _TOKEN.match(text, start)
        if m is None:
            if start >= len(text):
                return "eof", "", start, start, newline, False
            if text[start] == "`":
                return "template", "`", start, start + 1, newline, False
            self.fail()
        kind, value, end, escaped = m.lastgroup, m[0], m.end(), False
        if kind == "name":
            if "\\" in value:
                value, escaped = unescaped(value), True
        elif kind == "string":
            value = unescaped(value[1:-1])
        elif kind == "number" and (_NAME.match(text, end) or text[end : end + 1].isdigit()):
            self.fail()
        return kind, value, start, end, newline, escaped

    def scan(self) -> None:
        at, ahead = self.ahead
        self.kind, self.value, self.start, self.end, self.newline, self.escaped = ahead if at == self.pos else self.token(self.pos)
        self.pos, self.here = self.end, None

    def fail(self) -> None:
        raise SyntaxFault(f"unexpected text at {self.start}")

    def place(self, start: int | None = None) -> tuple[int, int]:
        """(line from 1, column from 1) of a position; positions asked for are mostly close to each other."""
        if start is None:
            if self.here is None:
                self.here = self.place(self.start)
            return self.here
        n = self.at_line
        while self.starts[n] > start:
            n -= 1
        while n + 1 < len(self.starts) and self.starts[n + 1] <= start:
            n += 1
        self.at_line = n
        return n + 1, start - self.starts[n] + 1

    def advance(self) -> str:
        value = self.value
        self.prev_end = self.end
        self.scan()
        return value

    def is_(self, value: str) -> bool:
        return self.value == value and self.kind in ("punct", "name") and not (self.kind == "name" and self.escaped)

    def eat(self, value: str) -> bool:
        if self.is_(value):
            self.advance()
            return True
        return False

    def expect(self, value: str) -> None:
        if not self.eat(value):
            self.fail()

    def semicolon(self) -> None:
        if not self.eat(";") and not (self.is_("}") or self.kind == "eof" or self.newline):
            self.fail()

    def peek(self) -> tuple[str, str, bool]:
        """Kind, value and preceding line break of the next token."""
        if self.ahead[0] != self.pos:
            try:
                self.ahead = self.pos, self.token(self.pos)
            except SyntaxFault:
                return "punct", "", False
        kind, value, _, _, newline, _ = self.ahead[1]
        return kind, value, newline

    # Statements.

    def program(self) -> Node:
        body = []
        while self.kind != "eof":
            body.append(self.statement(top=True))
        return Node("Program", 1, 1, body=body)

    def block(self) -> Node:
        line, col = self.place()
        self.expect("{")
        body = []
        while not self.eat("}"):
            if self.kind == "eof":
                self.fail()
            body.append(self.statement())
        return Node("BlockStatement", line, col, body=body)

    def parenthesised(self) -> Node:
        self.expect("(")
        found = self.expression()
        self.expect(")")
        return found

    def statement(self, top: bool = False) -> Node:
        line, col = self.place()
        node = lambda type, **given: Node(type, line, col, **given)
        if self.kind == "punct":
            if self.value == "{":
                return self.block()
            if self.value == ";":
                self.advance()
                return node("EmptyStatement")
            if self.value == "@":
                self.decorators()
        if self.kind == "name" and not self.escaped:
            handler = getattr(self, f"_{self.value}_statement", None) if self.value in _STATEMENTS else None
            if handler:
                return handler(node, top)
            after = self.peek() if self.value in ("let", "async") or self.value not in RESERVED else None
            if self.value == "let" and after and (after[0] == "name" and after[1] not in ("in", "instanceof", "of") or after[1] in ("[", "{") and after[0] == "punct"):
                return self._var_statement(node, top)
            if self.value == "async" and after[1] == "function" and not after[2]:
                self.advance()
                return self.function(line, col, declaration=True, is_async=True)
            if after and after[:2] == ("punct", ":"):
                label = self.advance()
                self.advance()
                return node("LabeledStatement", label=label, body=self.statement())
        found = self.expression()
        self.semicolon()
        return node("ExpressionStatement", expression=found)

    def _var_statement(self, node, top) -> Node:
        found = self.declarations()
        self.semicolon()
        return found

    _const_statement = _var_statement

    def declarations(self, no_in: bool = False) -> Node:
        line, col = self.place()
        kind, found, was = self.advance(), [], self.no_in
        self.no_in = no_in
        while True:
            at = self.place()
            target = self.binding()
            init = self.assignment() if self.eat("=") else None
            if init is None and not no_in and (kind == "const" or target.type != "Identifier"):
                self.fail()
            found.append(Node("VariableDeclarator", *at, id=target, init=init))
            if not self.eat(","):
                break
        self.no_in = was
        return Node("VariableDeclaration", line, col, kind=kind, declarations=found)

    def _function_statement(self, node, top) -> Node:
        return self.function(*self.place(), declaration=True)

    def _class_statement(self, node, top) -> Node:
        return self.class_("ClassDeclaration")

    def _if_statement(self, node, top) -> Node:
        self.advance()
        test, consequent = self.parenthesised(), self.statement()
        return node("IfStatement", test=test, consequent=consequent, alternate=self.statement() if self.eat("else") else None)

    def loop_body(self) -> Node:
        self.loops += 1
        body = self.statement()
        self.loops -= 1
        return body

    def _while_statement(self, node, top) -> Node:
        self.advance()
        return node("WhileStatement", test=self.parenthesised(), body=self.loop_body())

    def _do_statement(self, node, top) -> Node:
        self.advance()
        body = self.loop_body()
        self.expect("while")
        test = self.parenthesised()
        self.eat(";")
        return node("DoWhileStatement", body=body, test=test)

    def _with_statement(self, node, top) -> Node:
        if self.module:
            self.fail()
        self.advance()
        return node("WithStatement", object=self.parenthesised(), body=self.statement())

    def _for_statement(self, node, top) -> Node:
        self.advance()
        awaited = self.eat("await")
        self.expect("(")
        init = None
        if not self.is_(";"):
            after = self.peek()
            if self.is_("var") or self.is_("const") or self.is_("let") and (after[0] == "name" and after[1] not in ("in", "of") or after[1] in ("[", "{")):
                init = self.declarations(no_in=True)
            else:
                was, self.no_in = self.no_in, True
                init = self.expression()
                self.no_in = was
            for word, type in (("of", "ForOfStatement"), ("in", "ForInStatement")):
                if self.is_(word):
                    self.advance()
                    if init.type != "VariableDeclaration":
                        init = self.target(init)
                    right = self.assignment() if word == "of" else self.expression()
                    self.expect(")")
                    return node(type, left=init, right=right, body=self.loop_body(), awaited=awaited)
        self.expect(";")
        test = None if self.is_(";") else self.expression()
        self.expect(";")
        update = None if self.is_(")") else self.expression()
        self.expect(")")
        return node("ForStatement", init=init, test=test, update=update, body=self.loop_body())

    def _return_statement(self, node, top) -> Node:
        if not self.returns:
            self.fail()
        self.advance()
        found = None if self.is_(";") or self.is_("}") or self.kind == "eof" or self.newline else self.expression()
        self.semicolon()
        return node("ReturnStatement", argument=found)

    def _throw_statement(self, node, top) -> Node:
        self.advance()
        if self.newline:
            self.fail()
        found = self.expression()
        self.semicolon()
        return node("ThrowStatement", argument=found)

    def _break_statement(self, node, top) -> Node:
        word = self.advance()
        label = self.advance() if self.kind == "name" and not self.newline and self.value not in RESERVED else None
        if not label and not (self.loops or word == "break" and self.switches):
            self.fail()
        self.semicolon()
        return node("BreakStatement" if word == "break" else "ContinueStatement", label=label)

    _continue_statement = _break_statement

    def _switch_statement(self, node, top) -> Node:
        self.advance()
        value, cases = self.parenthesised(), []
        self.expect("{")
        self.switches += 1
        while not self.eat("}"):
            at = self.place()
            if self.eat("default"):
                test = None
            else:
                self.expect("case")
                test = self.expression()
            self.expect(":")
            body = []
            while not (self.is_("case") or self.is_("default") or self.is_("}")):
                if self.kind == "eof":
                    self.fail()
                body.append(self.statement())
            cases.append(Node("SwitchCase", *at, test=test, consequent=body))
        self.switches -= 1
        return node("SwitchStatement", discriminant=value, cases=cases)

    def _try_statement(self, node, top) -> Node:
        self.advance()
        block, handler, last = self.block(), None, None
        at = self.place()
        if self.eat("catch"):
            param = None
            if self.eat("("):
                param = self.binding()
                self.expect(")")
            handler = Node("CatchClause", *at, param=param, body=self.block())
        if self.eat("finally"):
            last = self.block()
        if not handler and not last:
            self.fail()
        return node("TryStatement", block=block, handler=handler, finalizer=last)

    def _debugger_statement(self, node, top) -> Node:
        self.advance()
        self.semicolon()
        return node("DebuggerStatement")

    def source(self) -> Node:
        if self.kind != "string":
            self.fail()
        found = self.literal()
        if self.eat("with") or self.is_("assert") and not self.newline and self.eat("assert"):
            self.object()
        return found

    def _import_statement(self, node, top) -> Node:
        after = self.peek()
        if after[:2] in (("punct", "("), ("punct", ".")):
            found = self.expression()
            self.semicolon()
            return node("ExpressionStatement", expression=found)
        if not (self.module and top):
            self.fail()
        self.advance()
        named = []
        if self.kind != "string":
            while True:
                at = self.place()
                if self.eat("*"):
                    self.expect("as")
                    named.append(Node("ImportNamespaceSpecifier", *at, local=self.identifier()))
                elif self.eat("{"):
                    while not self.eat("}"):
                        at = self.place()
                        name = self.module_name()
                        local = self.identifier() if self.eat("as") else name
                        named.append(Node("ImportSpecifier", *at, imported=name, local=local))
                        if not self.is_("}"):
                            self.expect(",")
                else:
                    named.append(Node("ImportDefaultSpecifier", *at, local=self.identifier()))
                if not self.eat(","):
                    break
            self.expect("from")
        found = self.source()
        self.semicolon()
        return node("ImportDeclaration", specifiers=named, source=found)

    def module_name(self) -> Node:
        if self.kind == "string":
            return self.literal()
        at = self.place()
        if self.kind != "name":
            self.fail()
        return Node("Identifier", *at, name=self.advance())

    def _export_statement(self, node, top) -> Node:
        if not (self.module and top):
            self.fail()
        self.advance()
        if self.eat("*"):
            name = self.module_name() if self.eat("as") else None
            self.expect("from")
            found = self.source()
            self.semicolon()
            return node("ExportAllDeclaration", exported=name, source=found)
        if self.eat("default"):
            at = self.place()
            after = self.peek()
            if self.is_("function"):
                found = self.function(*at, declaration=True, nameless=True)
            elif self.is_("async") and after[1] == "function" and not after[2]:
                self.advance()
                found = self.function(*at, declaration=True, is_async=True, nameless=True)
            elif self.is_("class"):
                found = self.class_("ClassDeclaration", nameless=True)
            else:
                found = self.assignment()
                self.semicolon()
            return node("ExportDefaultDeclaration", declaration=found)
        if self.eat("{"):
            named, found = [], None
            while not self.eat("}"):
                at = self.place()
                name = self.module_name()
                named.append(Node("ExportSpecifier", *at, local=name, exported=self.module_name() if self.eat("as") else name))
                if not self.is_("}"):
                    self.expect(",")
            if self.eat("from"):
                found = self.source()
            self.semicolon()
            return node("ExportNamedDeclaration", specifiers=named, source=found)
        found = self.statement()
        if found.type not in ("VariableDeclaration", "FunctionDeclaration", "ClassDeclaration"):
            self.fail()
        return node("ExportNamedDeclaration", specifiers=[], declaration=found)

    # Patterns, functions and classes.

    def identifier(self) -> Node:
        if self.kind != "name" or self.value in RESERVED:
            self.fail()
        at = self.place()
        return Node("Identifier", *at, name=self.advance())

    def binding(self) -> Node:
        if self.kind == "punct" and self.value in ("[", "{"):
            return self.target(self.array() if self.value == "[" else self.object())
        return self.identifier()

    def binding_default(self) -> Node:
        at = self.place()
        if self.eat("..."):
            return Node("RestElement", *at, argument=self.binding())
        found = self.binding()
        return Node("AssignmentPattern", *at, left=found, right=self.assignment()) if self.eat("=") else found

    def target(self, node: Node) -> Node:
        """An expression as a pattern."""
        kind = node.type
        if kind in ("Identifier", "MemberExpression", "ObjectPattern", "ArrayPattern", "RestElement", "AssignmentPattern"):
            return node
        if kind == "AssignmentExpression" and node.operator == "=" and not node.wrapped:
            node.type, node.left = "AssignmentPattern", self.target(node.left)
        elif kind == "ArrayExpression" and not node.wrapped:
            node.type, node.elements = "ArrayPattern", [e and self.target(e) for e in node.elements]
        elif kind == "ObjectExpression" and not node.wrapped:
            node.type = "ObjectPattern"
            for p in node.properties:
                if p.type == "SpreadElement":
                    p.type, p.argument = "RestElement", self.target(p.argument)
                elif p.method or p.kind != "init":
                    self.fail()
                else:
                    p.value = self.target(p.value)
        elif kind == "SpreadElement":
            node.type, node.argument = "RestElement", self.target(node.argument)
        else:
            self.fail()
        return node

    def params(self) -> list[Node]:
        self.expect("(")
        found = []
        while not self.eat(")"):
            found.append(self.binding_default())
            if not self.is_(")"):
                self.expect(",")
        return found

    def body(self, is_async: bool, generator: bool) -> Node:
        kept = self.returns, self.loops, self.switches, self.no_in, self.awaits, self.yields
        self.returns, self.loops, self.switches, self.no_in, self.awaits, self.yields = 1, 0, 0, False, is_async, generator
        found = self.block()
        self.returns, self.loops, self.switches, self.no_in, self.awaits, self.yields = kept
        return found

    def function(self, line: int, col: int, declaration: bool, is_async: bool = False, nameless: bool = False) -> Node:
        self.expect("function")
        generator = self.eat("*")
        name = None if self.is_("(") and (nameless or not declaration) else self.identifier()
        params = self.params()
        return Node("FunctionDeclaration" if declaration else "FunctionExpression", line, col, id=name, params=params, body=self.body(is_async, generator))

    def method(self, is_async: bool = False, generator: bool = False) -> Node:
        at = self.place()
        params = self.params()
        return Node("FunctionExpression", *at, params=params, body=self.body(is_async, generator))

    def arrow(self, line: int, col: int, params: list[Node], is_async: bool) -> Node:
        if self.newline:
            self.fail()
        self.expect("=>")
        if self.is_("{"):
            return Node("ArrowFunctionExpression", line, col, params=params, body=self.body(is_async, False))
        was, self.awaits = self.awaits, is_async or self.awaits and self.module and not self.returns
        found = self.assignment()
        self.awaits = was
        return Node("ArrowFunctionExpression", line, col, params=params, body=found, expression=True)

    def decorators(self) -> None:
        while self.eat("@"):
            if not self.is_("("):
                self.identifier()
                while self.eat("."):
                    self.advance()
                if self.is_("("):
                    self.arguments()
            else:
                self.parenthesised()

    def key(self) -> tuple[Node, bool]:
        at = self.place()
        if self.eat("["):
            was, self.no_in = self.no_in, False
            found = self.assignment()
            self.no_in = was
            self.expect("]")
            return found, True
        if self.eat("#"):
            return Node("PrivateIdentifier", *at, name=self.advance()), False
        if self.kind in ("string", "number"):
            return self.literal(), False
        if self.kind != "name":
            self.fail()
        return Node("Identifier", *at, name=self.advance()), False

    def modifiers(self) -> tuple[str, bool, bool]:
        """(kind, async, generator) that precede a member's key."""
        ends = ("(", ",", "}", ":", "=", ";")
        kind, is_async = "init", False
        if self.kind == "name" and self.value in ("get", "set", "async"):
            after = self.peek()
            if not (after[0] == "punct" and after[1] in ends or after[0] == "eof") and not (self.value == "async" and after[2]):
                word = self.advance()
                kind, is_async = ("init", True) if word == "async" else (word, False)
        return kind, is_async, self.eat("*")

    def class_(self, type: str, nameless: bool = False) -> Node:
        at = self.place()
        self.expect("class")
        name = self.identifier() if self.kind == "name" and self.value != "extends" else None
        if name is None and type == "ClassDeclaration" and not nameless:
            self.fail()
        parent = self.call_chain(self.place(), self.primary()) if self.eat("extends") else None
        inside = self.place()
        self.expect("{")
        members = []
        while not self.eat("}"):
            if self.eat(";"):
                continue
            if self.is_("@"):
                self.decorators()
            here = self.place()
            if self.is_("static"):
                after = self.peek()
                if after[1] == "{":
                    self.advance()
                    members.append(Node("StaticBlock", *here, body=self.body(False, False).body))
                    continue
                if after[1] not in ("(", "=", ";", "}"):
                    self.advance()
            kind, is_async, generator = self.modifiers()
            key, computed = self.key()
            if self.is_("("):
                members.append(Node("MethodDefinition", *here, key=key, computed=computed, value=self.method(is_async, generator)))
            else:
                if kind != "init" or is_async or generator:
                    self.fail()
                value = self.assignment() if self.eat("=") else None
                self.semicolon()
                members.append(Node("PropertyDefinition", *here, key=key, computed=computed, value=value))
        return Node(type, *at, id=name, superClass=parent, body=Node("ClassBody", *inside, body=members))

    # Expressions.

    def expression(self) -> Node:
        at = self.place()
        found = self.assignment()
        if not self.is_(","):
            return found
        all_ = [found]
        while self.eat(","):
            all_.append(self.assignment())
        return Node("SequenceExpression", *at, expressions=all_)

    def assignment(self) -> Node:
        at = self.place()
        if self.kind == "name" and not self.escaped:
            after = self.peek() if self.value in ("async", "yield") or self.value not in RESERVED else None
            if self.value == "yield" and self.yields:
                self.advance()
                star = not self.newline and self.eat("*")
                empty = not star and (self.newline or self.kind == "eof" or self.kind == "punct" and self.value in (")", "]", "}", ",", ";", ":") or self.is_("in") or self.is_("of"))
                return Node("YieldExpression", *at, argument=None if empty else self.assignment())
            if self.value == "async" and after[0] == "name" and not after[2] and after[1] not in RESERVED and after[1] != "of":
                self.advance()
                return self.arrow(*at, [self.identifier()], True)
            if after and after[:2] == ("punct", "=>"):
                return self.arrow(*at, [self.identifier()], False)
        left = self.conditional()
        if self.kind == "punct" and self.value in _ASSIGN and left.type != "ArrowFunctionExpression":
            if self.value == "=":
                left = self.target(left)
            elif left.type not in ("Identifier", "MemberExpression"):
                self.fail()
            operator = self.advance()
            return Node("AssignmentExpression", *at, operator=operator, left=left, right=self.assignment())
        return left

    def conditional(self) -> Node:
        at = self.place()
        test = self.binary(0)
        if not self.eat("?"):
            return test
        was, self.no_in = self.no_in, False
        yes = self.assignment()
        self.no_in = was
        self.expect(":")
        return Node("ConditionalExpression", *at, test=test, consequent=yes, alternate=self.assignment())

    def binary(self, least: int) -> Node:
        at = self.place()
        if self.is_("#"):
            key, _ = self.key()
            left = key
        else:
            left = self.unary()
        if left.type == "ArrowFunctionExpression" and not left.wrapped:
            return left
        while self.kind in ("punct", "name") and (level := _BINARY.get(self.value, 0)) > least and not (self.value == "in" and self.no_in) and not (self.kind == "name" and self.escaped):
            operator = self.advance()
            right = self.binary(level - 1 if operator == "**" else level)
            left = Node("LogicalExpression" if operator in ("&&", "||", "??") else "BinaryExpression", *at, operator=operator, left=left, right=right)
        return left

    def unary(self) -> Node:
        at = self.place()
        if self.kind in ("punct", "name") and self.value in _UNARY:
            operator = self.advance()
            return Node("UnaryExpression", *at, operator=operator, argument=self.unary())
        if self.is_("++") or self.is_("--"):
            operator = self.advance()
            found = self.unary()
            if found.type not in ("Identifier", "MemberExpression"):
                self.fail()
            return Node("UpdateExpression", *at, operator=operator, argument=found)
        if self.awaits and self.is_("await"):
            self.advance()
            return Node("AwaitExpression", *at, argument=self.unary())
        found = self.call_chain(at, self.primary())
        if self.kind == "punct" and self.value in ("++", "--") and not self.newline:
            if found.type not in ("Identifier", "MemberExpression"):
                self.fail()
            return Node("UpdateExpression", *at, operator=self.advance(), argument=found)
        return found

    def arguments(self) -> list[Node]:
        self.expect("(")
        was, self.no_in = self.no_in, False
        found = []
        while not self.eat(")"):
            at = self.place()
            found.append(Node("SpreadElement", *at, argument=self.assignment()) if self.eat("...") else self.assignment())
            if not self.is_(")"):
                self.expect(",")
        self.no_in = was
        return found

    def call_chain(self, at: tuple[int, int], node: Node, calls: bool = True) -> Node:
        if node.type == "ArrowFunctionExpression" and not node.wrapped:
            return node
        optional = False
        while True:
            if self.kind == "template":
                node = Node("TaggedTemplateExpression", *at, tag=node, quasi=self.template())
            elif self.is_("."):
                self.advance()
                node = Node("MemberExpression", *at, object=node, property=self.property_name(), computed=False)
            elif self.is_("?.") and calls:
                self.advance()
                optional = True
                if self.is_("("):
                    node = Node("CallExpression", *at, callee=node, arguments=self.arguments())
                elif self.eat("["):
                    node = self.index(at, node)
                else:
                    node = Node("MemberExpression", *at, object=node, property=self.property_name(), computed=False)
            elif self.is_("["):
                self.advance()
                node = self.index(at, node)
            elif self.is_("(") and calls:
                if node.type == "Identifier" and node.name == "async" and not self.newline:
                    args = self.arguments()
                    if self.is_("=>"):
                        return self.arrow(*at, [self.target(a) for a in args], True)
                    node = Node("CallExpression", *at, callee=node, arguments=args)
                else:
                    node = Node("CallExpression", *at, callee=node, arguments=self.arguments())
            else:
                return Node("ChainExpression", *at, expression=node) if optional else node

    def property_name(self) -> Node:
        at = self.place()
        if self.eat("#"):
            return Node("PrivateIdentifier", *at, name=self.advance())
        if self.kind != "name":
            self.fail()
        return Node("Identifier", *at, name=self.advance())

    def index(self, at: tuple[int, int], node: Node) -> Node:
        was, self.no_in = self.no_in, False
        found = self.expression()
        self.no_in = was
        self.expect("]")
        return Node("MemberExpression", *at, object=node, property=found, computed=True)

    def literal(self) -> Node:
        at = self.place()
        if self.kind == "string":
            return Node("Literal", *at, value=self.advance())
        raw = self.advance().replace("_", "")
        try:
            value = int(raw, 0) if raw[:2].lower() in ("0x", "0o", "0b") and raw[-1] != "n" else float(raw.rstrip("n")) if raw[:2].lower() not in ("0x", "0o", "0b") else 0.0
        except ValueError:
            value = 0.0
        return Node("Literal", *at, value=float(value))

    def template(self) -> Node:
        at = self.place()
        pos, quasis, inside = self.start + 1, [], []
        while True:
            begin = pos
            while True:
                if pos >= len(self.text):
                    self.fail()
                c = self.text[pos]
                if c == "\\":
                    pos += 2
                elif c == "`" or self.text.startswith("${", pos):
                    break
                else:
                    pos += 1
            quasis.append(Node("TemplateElement", *self.place(begin), raw=self.text[begin:pos].replace("\r\n", "\n").replace("\r", "\n")))
            if self.text[pos] == "`":
                self.end = self.pos = pos + 1
                self.advance()
                return Node("TemplateLiteral", *at, quasis=quasis, expressions=inside)
            self.pos = pos + 2
            self.scan()
            was, self.no_in = self.no_in, False
            inside.append(self.expression())
            self.no_in = was
            if not self.is_("}"):
                self.fail()
            pos = self.end

    def array(self) -> Node:
        at = self.place()
        self.expect("[")
        was, self.no_in = self.no_in, False
        found: list[Node | None] = []
        while not self.eat("]"):
            if self.eat(","):
                found.append(None)
                continue
            here = self.place()
            found.append(Node("SpreadElement", *here, argument=self.assignment()) if self.eat("...") else self.assignment())
            if not self.is_("]"):
                self.expect(",")
        self.no_in = was
        return Node("ArrayExpression", *at, elements=found)

    def object(self) -> Node:
        at = self.place()
        self.expect("{")
        was, self.no_in = self.no_in, False
        found = []
        while not self.eat("}"):
            here = self.place()
            if self.eat("..."):
                found.append(Node("SpreadElement", *here, argument=self.assignment()))
            else:
                kind, is_async, generator = self.modifiers()
                named = self.kind == "name" and self.value not in RESERVED
                key, computed = self.key()
                if self.is_("("):
                    found.append(Node("Property", *here, key=key, computed=computed, kind=kind, method=kind == "init", value=self.method(is_async, generator)))
                elif kind != "init" or is_async or generator:
                    self.fail()
                elif self.eat(":"):
                    found.append(Node("Property", *here, key=key, computed=computed, kind=kind, value=self.assignment()))
                elif named and not computed:
                    value = key
                    if self.eat("="):
                        value = Node("AssignmentPattern", *here, left=key, right=self.assignment())
                    found.append(Node("Property", *here, key=key, computed=False, kind=kind, shorthand=True, value=value))
                else:
                    self.fail()
            if not self.is_("}"):
                self.expect(",")
        self.no_in = was
        return Node("ObjectExpression", *at, properties=found)

    def primary(self) -> Node:
        at, kind, value = self.place(), self.kind, self.value
        if kind in ("string", "number"):
            return self.literal()
        if kind == "template":
            return self.template()
        if kind == "punct":
            if value == "(":
                return self.group(at)
            if value == "[":
                return self.array()
            if value == "{":
                return self.object()
            if value in ("/", "/="):
                m = _REGEX.match(self.text, self.start)
                if not m:
                    self.fail()
                self.end = self.pos = m.end()
                self.advance()
                return Node("Literal", *at, regex=(m[1], m[2]))
            if value == "@":
                self.decorators()
                return self.class_("ClassExpression")
            self.fail()
        if kind == "eof":
            self.fail()
        if self.escaped:
            return self.identifier()
        if value == "function":
            return self.function(*at, declaration=False)
        if value == "async":
            after = self.peek()
            if after[1] == "function" and not after[2]:
                self.advance()
                return self.function(*at, declaration=False, is_async=True)
        if value == "class":
            return self.class_("ClassExpression")
        if value == "new":
            return self.new(at)
        if value in ("true", "false", "null"):
            self.advance()
            return Node("Literal", *at, value={"true": True, "false": False, "null": None}[value])
        if value in ("this", "super"):
            self.advance()
            return Node("ThisExpression" if value == "this" else "Super", *at)
        if value == "import":
            self.advance()
            if self.eat("."):
                self.advance()
                return Node("MetaProperty", *at)
            args = self.arguments()
            return Node("ImportExpression", *at, source=args[0] if args else self.fail())
        return self.identifier()

    def new(self, at: tuple[int, int]) -> Node:
        self.advance()
        if self.eat("."):
            self.advance()
            return Node("MetaProperty", *at)
        here = self.place()
        callee = self.new(here) if self.is_("new") else self.primary()
        callee = self.call_chain(here, callee, calls=False)
        return Node("NewExpression", *at, callee=callee, arguments=self.arguments() if self.is_("(") else [])

    def group(self, at: tuple[int, int]) -> Node:
        """A parenthesised expression, or the parameters of an arrow function."""
        self.advance()
        was, self.no_in = self.no_in, False
        found, only_params = [], False
        while not self.eat(")"):
            here = self.place()
            if self.eat("..."):
                found.append(Node("RestElement", *here, argument=self.binding()))
                only_params = True
            else:
                found.append(self.assignment())
            if not self.is_(")"):
                self.expect(",")
                only_params |= self.is_(")")
        self.no_in = was
        if self.is_("=>") and not self.newline:
            return self.arrow(*at, [self.target(p) for p in found], False)
        if only_params or not found:
            self.fail()
        if len(found) == 1:
            found[0].wrapped = True
            return found[0]
        return Node("SequenceExpression", found[0].line, found[0].col, expressions=found, wrapped=True)


_STATEMENTS = {n[1 : -len("_statement")] for n in vars(Parser) if n.startswith("_") and n.endswith("_statement")}


def parse(text: str) -> Node | None:
    """The program as a module, else as a script, else None."""
    for module in (True, False):
        try:
            return Parser(text, module).program()
        except (SyntaxFault, RecursionError, IndexError):
            continue
    return None
