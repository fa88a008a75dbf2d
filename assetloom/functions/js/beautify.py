"""Pretty-printing of JavaScript from its tokens.

Two passes: the first pairs brackets and decides what each brace opens (a block, a literal, a class, a switch); the second writes the tokens, asking one
rule for the gap between two of them (nothing, a space, or a line). Tokens are never changed but for comment indentation and, if asked, escapes of printable
characters, so a program means what it meant. Sections between ``beautify preserve:start``/``ignore:start`` comments and their ends are kept as they are.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, fields, replace

from assetloom.functions.js.syntax import _NAME, _NUMBER, _REGEX, RESERVED


#: Options of the format that aren't supported, with the only value that may be asked for.
FIXED = {
    "wrap_line_length": 0, "comma_first": False, "operator_position": "before-newline", "keep_array_indentation": False, "break_chained_methods": False, "keep_function_indentation": False, "jslint_happy": False, "e4x": False,
}


@dataclass(frozen=True)
class Options:
    indent_size: int = 4
    indent_char: str = " "
    indent_level: int = 0
    indent_with_tabs: bool = False
    preserve_newlines: bool = True
    max_preserve_newlines: int = 32786
    brace_style: str = "collapse"
    space_in_paren: bool = False
    space_in_empty_paren: bool = False
    space_after_named_function: bool = False
    space_after_anon_function: bool = False
    space_before_conditional: bool = True
    unescape_strings: bool = False
    end_with_newline: bool = False
    eol: str = "\n"
    disabled: bool = False

    def __post_init__(self) -> None:
        if self.brace_style not in ("collapse", "expand", "end-expand", "none"):
            raise ValueError(f"no such brace_style: {self.brace_style}")

    @classmethod
    def of(cls, given: dict[str, object]) -> Options:
        """Options by name, with ``-`` or ``_``; those of ``js`` go before the others; unknown ones are left out, and known ones that aren't supported are an error."""
        merged = {k: v for k, v in given.items() if k not in ("js", "css", "html")} | dict(given.get("js") or {})
        named = {k.replace("-", "_"): v for k, v in merged.items()}
        if lacking := sorted(k for k, v in FIXED.items() if named.get(k, v) != v):
            raise ValueError(f"not supported: {', '.join(lacking)}")
        known = {f.name for f in fields(cls)}
        return replace(cls(), **{k: v for k, v in named.items() if k in known})


@dataclass
class Token:
    kind: str  # word number string template regex op line block directive
    text: str
    lines: int = 0  # line breaks before it
    opens: str = ""  # what a brace opens
    mate: int = -1
    role: str = ""  # of an operator: unary, postfix, generator; of a colon: ternary, key, case, label; of a word: member
    level: int = 0  # of the line that it opens a bracket on


_LEX = re.compile(r">>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|[-+*/%&|^]=|<<|>>|\*\*|.", re.DOTALL)
_STRINGS = re.compile(r"'(?:[^'\\\n]|\\[\s\S])*'?|\"(?:[^\"\\\n]|\\[\s\S])*\"?")
_KEPT = re.compile(r"/\*\s*beautify\s+(preserve|ignore):start\s*\*/[\s\S]*?(?:/\*\s*beautify\s+\1:end\s*\*/|\Z)")
_VALUE_WORDS = frozenset(("this", "super", "null", "true", "false"))
_AHEAD = frozenset(("return", "throw", "typeof", "new", "in", "of", "instanceof", "void", "delete", "case", "yield", "await", "do", "else", "default", "extends"))
_BINARY = frozenset("= + - * / % ** == === != !== < > <= >= && || ?? & | ^ << >> >>> += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??= => ?".split())


def _template_end(text: str, at: int) -> int:
    """Where the template that starts at ``at`` ends."""
    at += 1
    while at < len(text):
        if text[at] == "\\":
            at += 2
        elif text[at] == "`":
            return at + 1
        elif text.startswith("${", at):
            depth, at = 1, at + 2
            while at < len(text) and depth:
                c = text[at]
                if c == "`":
                    at = _template_end(text, at)
                    continue
                if c in "'\"":
                    at = max(_STRINGS.match(text, at).end(), at + 1)
                    continue
                depth += (c == "{") - (c == "}")
                at += 1
        else:
            at += 1
    return len(text)


def tokenize(text: str) -> list[Token]:
    """Every token with the number of line breaks before it; text that is no token is an operator of one character."""
    out: list[Token] = []
    at, lines = 0, 0
    while at < len(text):
        c = text[at]
        if c in "\n\r\u2028\u2029":
            at += 2 if text.startswith("\r\n", at) else 1
            lines += 1
            continue
        if c.isspace() or c == "\ufeff":
            at += 1
            continue
        last = next((t for t in reversed(out) if t.kind not in ("line", "block")), None)
        value = last is not None and (last.kind in ("number", "string", "template", "regex") or last.kind == "word" and last.text not in RESERVED - _VALUE_WORDS or last.text in (")", "]", "}"))
        if kept := _KEPT.match(text, at):
            kind, end = "directive", kept.end()
        elif text.startswith("#!", at) and not out or text.startswith("//", at):
            kind, end = "line", re.compile("[\n\r\u2028\u2029]|\\Z").search(text, at).start()
        elif text.startswith("/*", at):
            end = text.find("*/", at + 2)
            kind, end = "block", end + 2 if end >= 0 else len(text)
        elif m := _NAME.match(text, at):
            kind, end = "word", m.end()
        elif c.isdigit() or c == "." and text[at + 1 : at + 2].isdigit():
            kind, end = "number", _NUMBER.match(text, at).end()
        elif c in "'\"":
            kind, end = "string", _STRINGS.match(text, at).end()
        elif c == "`":
            kind, end = "template", _template_end(text, at)
        elif c == "/" and not value and (m := _REGEX.match(text, at)):
            kind, end = "regex", m.end()
        else:
            kind, end = "op", _LEX.match(text, at).end()
        out.append(Token(kind, text[at:end], lines))
        at, lines = end, 0
    return out


def _solid(tokens: list[Token], at: int) -> int:
    """The nearest token before ``at`` that is no comment, or -1."""
    at -= 1
    while at >= 0 and tokens[at].kind in ("line", "block"):
        at -= 1
    return at


def _annotate(tokens: list[Token]) -> None:
    """Pairs brackets, says what braces open, and tells unary from binary operators."""
    stack: list[int] = []
    blank = Token("op", "")
    for n, t in enumerate(tokens):
        p = _solid(tokens, n)
        last = tokens[p] if p >= 0 else blank
        if t.kind == "word" and last.text in (".", "?."):
            t.role = "member"
        if t.kind != "op":
            continue
        ends_value = last.kind in ("number", "string", "template", "regex") or last.kind == "word" and (last.role == "member" or last.text not in RESERVED - _VALUE_WORDS) or last.text in (")", "]") or last.text == "}" and last.opens in ("literal", "function")
        inside = tokens[stack[-1]] if stack else blank
        if t.text in ("(", "[", "{"):
            if t.text == "{":
                head = tokens[last.mate] if last.text == ")" and last.mate >= 0 else None
                before = tokens[q] if head and (q := _solid(tokens, last.mate)) >= 0 else blank
                if last.text == ")":
                    t.opens = "switch" if before.text == "switch" and before.role != "member" else "block" if before.text in ("if", "for", "while", "with", "catch") and before.role != "member" else "function"
                elif last.text == "=>":
                    t.opens = "function"
                elif last.kind == "word" and last.role != "member" and last.text in ("else", "do", "try", "finally", "static", "catch"):
                    t.opens = "block"
                elif any(tokens[k].text == "class" for k in range(max(0, n - 8), n)) and (last.kind == "word" or last.text == ")") and last.text not in ("return",):
                    t.opens = "class"
                elif last.text == ":" and (inside.opens == "switch" or last.role == "label"):
                    t.opens = "block"
                elif p < 0 or last.text in (";", "}") or last.text == "{" and last.opens not in ("literal",):
                    t.opens = "block"
                else:
                    t.opens = "literal"
            elif t.text == "[":
                t.opens = "index" if ends_value else "array"
            else:
                t.opens = "call" if ends_value else "group"
            stack.append(n)
        elif t.text in (")", "]", "}"):
            if stack:
                t.mate = stack.pop()
                tokens[t.mate].mate = n
                t.opens = tokens[t.mate].opens
        elif t.text in ("+", "-", "!", "~"):
            t.role = "" if ends_value and t.text in "+-" else "unary"
        elif t.text in ("++", "--"):
            t.role = "postfix" if ends_value and not t.lines else "unary"
        elif t.text == "*" and (last.text in ("function", "yield") or not ends_value):
            t.role = "generator"
        elif t.text == "...":
            t.role = "unary"
        elif t.text == ":":
            q = _solid(tokens, p)
            ternary = 0
            for k in range(p, stack[-1] if stack else -1, -1):
                if tokens[k].text in (")", "]", "}") and tokens[k].mate >= 0 and tokens[k].mate < k:
                    continue
                if tokens[k].text == "?":
                    ternary += 1
                elif tokens[k].text == ":" and tokens[k].role == "ternary":
                    ternary -= 1
                elif tokens[k].text == ";":
                    break
            if ternary > 0:
                t.role = "ternary"
            elif inside.opens == "literal":
                t.role = "key"
            elif inside.opens == "switch":
                t.role = "case"
            else:
                t.role = "label" if last.kind == "word" and (q < 0 or tokens[q].text in (";", "{", "}", ":")) else "key"


_ESCAPES = re.compile(r"\\(?:x([0-9a-fA-F]{2})|u([0-9a-fA-F]{4})|u\{([0-9a-fA-F]{1,6})\}|[\s\S])")


def unescaped(text: str) -> str:
    """A string with escapes of printable ASCII spelled out, quotes and backslashes aside."""

    def one(m: re.Match) -> str:
        code = int(m[1] or m[2] or m[3] or "0", 16)
        return chr(code) if 0x20 <= code < 0x7F and chr(code) not in "\\'\"" else m[0]

    return _ESCAPES.sub(one, text)


class _Writer:
    def __init__(self, tokens: list[Token], options: Options) -> None:
        self.tokens, self.o = tokens, options
        self.out: list[str] = []
        self.unit = "\t" if options.indent_with_tabs else options.indent_char * options.indent_size
        #: Of each open bracket: the level of its closing line, the depth around it, and itself.
        self.frames: list[tuple[int, int, Token]] = []
        self.depth = self.level = options.indent_level
        self.fresh = True

    def line(self, blank: int, level: int) -> None:
        while self.out and self.out[-1] == " ":
            self.out.pop()
        if not self.fresh:
            self.out.append("\n")
        self.out.append("\n" * blank)
        self.level, self.fresh = level, True

    def write(self, text: str) -> None:
        if self.fresh:
            self.out.append(self.unit * self.level)
            self.fresh = False
        self.out.append(text)

    def run(self) -> str:
        tokens, o = self.tokens, self.o
        for n, t in enumerate(tokens):
            p = tokens[n - 1] if n else None
            solid = tokens[_solid(tokens, n)] if _solid(tokens, n) >= 0 else None
            gap, blank, extra = self.gap(n, t, p, solid)
            if t.text in (")", "]", "}") and t.kind == "op" and t.mate >= 0 and self.frames:
                level, self.depth, _ = self.frames.pop()
            else:
                level = self.depth + extra
            if gap == "line":
                self.line(blank, level)
            elif gap == "space" and not self.fresh:
                self.out.append(" ")
            text = t.text
            if t.kind == "block" and "\n" in text.replace("\r", "\n"):
                self.comment(text)
            else:
                self.write(unescaped(text) if t.kind == "string" and o.unescape_strings else text.rstrip() if t.kind == "line" else text)
            if t.kind == "op" and t.text in ("(", "[", "{") and t.mate > n:
                t.level = self.level
                base = self.level
                if t.opens in ("block", "switch", "class"):
                    base = self.depth
                elif t.opens == "function":
                    q = _solid(tokens, n)
                    q = _solid(tokens, q) if tokens[q].text == "=>" else q
                    base = tokens[tokens[q].mate].level if tokens[q].text == ")" and tokens[q].mate >= 0 else base
                self.frames.append((base, self.depth, t))
                self.depth = base + 1
        text = "".join(self.out)
        text = re.sub(r"[ \t]+\n", "\n", text).rstrip() if text.strip() else ""
        return text

    def comment(self, text: str) -> None:
        rows = re.split("\r\n|[\n\r\u2028\u2029]", text)
        starred = all(r.strip().startswith("*") for r in rows[1:])
        self.write(rows[0])
        for r in rows[1:]:
            self.out.append("\n" + self.unit * self.level + (" " + r.strip() if starred else r.strip() if not r[:1].isspace() else r))

    def gap(self, n: int, t: Token, p: Token | None, solid: Token | None) -> tuple[str, int, int]:
        """(line, space or nothing; blank lines that go with it; extra indentation) before a token."""
        if p is None:
            return "", 0, 0
        o = self.o
        kept = o.preserve_newlines and t.lines > 0
        blank = max(0, min(t.lines, o.max_preserve_newlines) - 1) if o.preserve_newlines else 0
        inside = self.frames[-1][2] if self.frames else None
        where = inside.opens if inside else "block"
        if p.kind in ("line", "directive") or t.kind == "directive":
            return "line", blank, 0
        if t.kind in ("line", "block"):
            if t.lines:
                return "line", blank, 0
            return "space", 0, 0
        if p.kind == "block":
            return ("line", blank, 0) if t.lines or (where in ("block", "function", "class", "switch") and "\n" in p.text) else ("space", 0, 0)
        if t.kind == "op" and t.text == "}" and t.mate >= 0:
            return ("", 0, 0) if t.mate == n - 1 else ("line", 0, 0)
        if p.kind == "op" and p.text == "{":
            return "line", 0, self.case_depth(t, where)
        if p.kind == "op" and p.text == "}" and p.mate >= 0:
            return self.after_brace(t, p, kept, blank, where)
        if p.kind == "op" and p.text == ";":
            if where in ("group", "call"):
                return "space", 0, 0
            return "line", max(blank, int(self.declares(n, t))), self.case_depth(t, where)
        if p.kind == "op" and p.text == ":" and p.role == "case":
            return ("space", 0, 0) if t.text == "{" else ("line", 0, self.case_depth(t, "switch"))
        if p.kind == "op" and p.text == ",":
            if where == "literal":
                return "line", blank, 0
            if where in ("call", "array", "group", "index"):
                return ("line", blank, 0) if kept else ("space", 0, 0)
            return ("line", 0, 1) if self.breaks_declaration(n) or kept else ("space", 0, 0)
        if kept and self.statement_ends(p, t, where):
            return "line", max(blank, int(self.declares(n, t))), self.case_depth(t, where)
        spaced = self.space(n, t, p, where)
        if kept and t.kind == "op" and t.text in (".", "?.") and p.text != ".":
            return "line", 0, 1
        if kept and where in ("array", "call", "group") and p.text in ("(", "["):
            return "line", 0, 0
        if kept and (p.kind == "op" and p.text in _BINARY and p.role != "unary" or t.kind == "op" and t.text in _BINARY - {"=>", "="} and not t.role):
            return ("line", 0, 1) if p.text != "=>" else ("space", 0, 0)
        if t.kind == "op" and t.text == "{" and o.brace_style.startswith("expand") and t.opens != "literal" and not (p.kind == "word" and p.text == "return"):
            return "line", 0, 0
        return ("space" if spaced else ""), 0, 0

    def case_depth(self, t: Token, where: str) -> int:
        return int(where == "switch" and not (t.kind == "word" and t.text in ("case", "default")))

    def declares(self, n: int, t: Token) -> bool:
        """A function declaration has a blank line before it."""
        words = [t.text, self.tokens[n + 1].text if n + 1 < len(self.tokens) else ""]
        return t.kind == "word" and t.role != "member" and (words[0] == "function" or words == ["async", "function"])

    def breaks_declaration(self, n: int) -> bool:
        """Whether the declaration that a comma is in has an initial value before that comma."""
        depth, seen = 0, False
        for k in range(n - 2, -1, -1):
            t = self.tokens[k]
            if t.kind == "op" and t.text in (")", "]", "}") and t.mate >= 0:
                depth += 1
            elif t.kind == "op" and t.text in ("(", "[", "{"):
                depth -= 1
                if depth < 0:
                    return False
            elif depth == 0:
                if t.text == "=" and t.kind == "op":
                    seen = True
                if t.kind == "word" and t.text in ("var", "let", "const") and t.role != "member":
                    return seen
                if t.text == ";" and t.kind == "op":
                    return False
        return False

    def statement_ends(self, p: Token, t: Token, where: str) -> bool:
        """Whether a kept line break ends a statement."""
        if where not in ("block", "function", "class", "switch"):
            return False
        ended = p.kind in ("number", "string", "template", "regex") or p.kind == "word" and (p.role == "member" or p.text not in RESERVED - _VALUE_WORDS - {"break", "continue", "debugger", "return"}) or p.text in (")", "]") or p.role == "postfix"
        begins = t.kind in ("word", "string", "number", "template") and t.text not in ("in", "of", "instanceof") or t.kind == "op" and (t.role == "unary" or t.text in ("@", "#", "{"))
        return ended and begins and not (t.text == "{" and (t.opens != "block" or p.text == ")"))

    def after_brace(self, t: Token, p: Token, kept: bool, blank: int, where: str) -> tuple[str, int, int]:
        if t.kind == "op" and t.text in (";", ",", ")", "]", ".", "?.", "(", "[", ":"):
            if t.text in (".", "?.") and kept:
                return "line", 0, 1
            return "", 0, 0
        if t.kind == "template":
            return "", 0, 0
        if p.opens in ("literal",) and t.kind in ("op",) or t.kind == "op" and t.text in _BINARY and t.text != "{" and t.role != "unary" and not (t.role == "generator"):
            return "space", 0, 0
        if p.opens == "literal" and t.kind == "word" and t.text in ("from", "as", "of", "in", "instanceof"):
            return "space", 0, 0
        if t.kind == "word" and t.role != "member" and (t.text in ("else", "catch", "finally") or t.text == "while" and self.closes_do(p)):
            joined = self.o.brace_style in ("collapse", "none") and not (self.o.brace_style.startswith("none") and kept)
            return ("space" if joined or t.text == "while" else "line"), 0, 0
        named = p.opens in ("function", "class") and t.kind == "word" and t.text == "function"
        return "line", max(blank, int(named)), self.case_depth(t, where)

    def closes_do(self, p: Token) -> bool:
        head = _solid(self.tokens, p.mate)
        return head >= 0 and self.tokens[head].text == "do"

    def space(self, n: int, t: Token, p: Token, where: str) -> bool:
        """Whether a space stands between two tokens of one line."""
        o, a, b = self.o, p.text if p.kind == "op" else "", t.text if t.kind == "op" else ""
        keyword = p.kind == "word" and p.role != "member" and p.text in RESERVED - _VALUE_WORDS
        if b in (";", ",") or a in (".", "?.", "#", "@") or b in (".", "?."):
            return p.kind == "number" and b == "." and p.text.isdigit()
        if a in ("(", "[") or b in (")", "]"):
            return o.space_in_paren and not (a in ("(", "[") and b in (")", "]")) or o.space_in_empty_paren and a == "(" and b == ")"
        if p.role in ("unary",):
            return a in ("+", "-") and b == a or a + b in ("+++", "---", "+++", "---")
        if t.role == "postfix":
            return False
        if p.role == "generator":
            return p.kind == "op" and t.kind == "word" and _solid(self.tokens, n - 1) >= 0 and self.tokens[_solid(self.tokens, n - 1)].text in ("function", "yield")
        if t.role == "generator":
            return a in ("=", ":", ",")
        if b == ":":
            return t.role == "ternary"
        if a == ":":
            return True
        if b == "(":
            if p.kind == "word" and p.role != "member":
                if p.text == "function":
                    return o.space_after_anon_function
                if p.text in ("if", "for", "while", "switch", "catch", "with"):
                    return o.space_before_conditional
                if keyword and p.text not in ("super", "import"):
                    return True
                return o.space_after_named_function and n > 1 and self.tokens[n - 2].text == "function"
            return a in _BINARY
        if b == "[":
            return t.opens == "array" and (keyword or a in _BINARY)
        if t.kind == "template":
            return keyword or a in _BINARY
        if b == "{" or a == "{":
            return True
        if b in _BINARY or a in _BINARY:
            return True
        if a == ")" and t.kind != "op":
            return True
        if p.kind != "op" and t.kind != "op":
            return True
        if t.role == "unary" or b in ("@", "#"):
            return keyword or p.kind == "word"
        return keyword and t.kind != "op"


def beautify(source: str, options: Options = Options(), unpackers=None) -> str:
    """The text, unpacked if unpackers are given, then laid out; itself if disabled."""
    if options.disabled:
        return source
    if unpackers is not None:
        from assetloom.functions.rewrite import unpack

        source = unpack(source, unpackers) or ""
    tokens = tokenize(source)
    _annotate(tokens)
    out = _Writer(tokens, options).run()
    if options.end_with_newline and not out.endswith("\n"):
        out += "\n"
    return out.replace("\n", options.eol) if options.eol != "\n" else out
