"""Lexer and precedence parser of the query language.

The tree is made of tuples whose first member names the node. Operators from loosest to tightest: pipe,
comma, assignment, ``//``, ``or``, ``and``, comparison, additive, multiplicative, unary minus, postfix.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from larkspur.functions.numbers import number


class QuerySyntaxError(ValueError):
    pass


@dataclass
class Token:
    kind: str
    text: object
    at: int


_TOKEN = re.compile(
    r"""(?P<skip>\s+|\#[^\n]*)
  |(?P<num>(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)
  |(?P<field>\.[A-Za-z_]\w*)
  |(?P<var>\$__loc__|\$(?:[A-Za-z_]\w*::)*[A-Za-z_]\w*)
  |(?P<fmt>@[A-Za-z0-9_]+)
  |(?P<name>(?:[A-Za-z_]\w*::)*[A-Za-z_]\w*)
  |(?P<op>\?//=?|//=|\|=|\+=|-=|\*=|/=|==|!=|<=|>=|\.\.|//|[.\[\]{}()|,:;=<>+\-*/%?$])""",
    re.X,
)
_ESCAPES = {'"': '"', "\\": "\\", "/": "/", "b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t"}
_CONSTANTS = {"null": None, "true": True, "false": False}
KEYWORDS = {"def", "if", "then", "elif", "else", "end", "as", "reduce", "foreach", "try", "catch", "label", "import", "include", "and", "or", "__loc__"}


def lex(src: str, at: int = 0, closing: bool = False) -> tuple[list[Token], int]:
    """Tokens from ``at`` on; with ``closing`` up to the parenthesis that closes an interpolation."""
    out, depth = [], 0
    while at < len(src):
        if src[at] == '"':
            parts, end = _string(src, at + 1)
            out.append(Token("str", parts, at))
            at = end
            continue
        m = _TOKEN.match(src, at)
        if not m:
            raise QuerySyntaxError(f"unexpected {src[at]!r} at {at}")
        kind, text = m.lastgroup, m.group()
        if kind == "op" and text == "(":
            depth += 1
        elif kind == "op" and text == ")":
            if closing and not depth:
                return out, m.end()
            depth -= 1
        if kind != "skip":
            if kind == "op" and text in ("?//=",):
                raise QuerySyntaxError(f"unexpected {text!r} at {at}")
            out.append(Token(kind, text, at))
        at = m.end()
    if closing:
        raise QuerySyntaxError("unclosed interpolation")
    return out, at


def _string(src: str, at: int) -> tuple[list, int]:
    parts: list = []
    text = ""
    while at < len(src):
        c = src[at]
        if c == '"':
            return [*parts, text], at + 1
        if c != "\\":
            text, at = text + c, at + 1
            continue
        e = src[at + 1 : at + 2]
        if e == "(":
            tokens, at = lex(src, at + 2, closing=True)
            parts += [text, Parser(src, tokens).whole()]
            text = ""
        elif e == "u":
            code = int(src[at + 2 : at + 6], 16)
            at += 6
            if 0xD800 <= code < 0xDC00 and src[at : at + 2] == "\\u":
                low = int(src[at + 2 : at + 6], 16)
                if 0xDC00 <= low < 0xE000:
                    code, at = 0x10000 + ((code - 0xD800) << 10) + low - 0xDC00, at + 6
            text += chr(code) if not 0xD800 <= code < 0xE000 else "�"
        elif e in _ESCAPES:
            text, at = text + _ESCAPES[e], at + 2
        else:
            raise QuerySyntaxError(f"bad escape at {at}")
    raise QuerySyntaxError("unclosed string")


_BINARY = [({"//"}, "right"), ({"or"}, "left"), ({"and"}, "left"), ({"==", "!=", "<", "<=", ">", ">="}, "none"), ({"+", "-"}, "left"), ({"*", "/", "%"}, "left")]
_ASSIGN = {"=", "|=", "+=", "-=", "*=", "/=", "//="}


class Parser:
    def __init__(self, src: str, tokens: list[Token]):
        self.src, self.tokens, self.i = src, tokens, 0

    def peek(self, k: int = 0) -> Token:
        return self.tokens[self.i + k] if self.i + k < len(self.tokens) else Token("end", "end of query", len(self.src))

    def next(self) -> Token:
        t = self.peek()
        self.i += 1
        return t

    def is_(self, *texts: str) -> bool:
        t = self.peek()
        return t.kind in ("op", "name") and t.text in texts

    def take(self, *texts: str) -> bool:
        if self.is_(*texts):
            self.i += 1
            return True
        return False

    def need(self, text: str) -> None:
        if not self.take(text):
            self.fail(f"expected {text!r}")

    def fail(self, why: str):
        t = self.peek()
        raise QuerySyntaxError(f"{why}, found {t.text!r} at {t.at}")

    def whole(self):
        e = self.pipe()
        if self.peek().kind != "end":
            self.fail("unexpected token")
        return e

    def program(self):
        """(imports, definitions, body or None)"""
        imports, defs = [], []
        meta = None
        if self.is_("module"):
            self.next()
            meta = self.postfix()
            self.need(";")
        while self.is_("import", "include"):
            kind = self.next().text
            path = self.plain_string()
            name = None
            if kind == "import":
                self.need("as")
                t = self.next()
                name = t.text
            about = None if self.is_(";") else self.postfix()
            self.need(";")
            imports.append((kind, path, name, about))
        while self.is_("def"):
            defs.append(self.definition())
        body = None if self.peek().kind == "end" else self.whole()
        return meta, imports, defs, body

    def plain_string(self) -> str:
        t = self.next()
        if t.kind != "str" or len(t.text) != 1:
            self.i -= 1
            self.fail("expected a plain string")
        return t.text[0]

    def definition(self):
        self.need("def")
        name = self.next().text
        params = []
        if self.take("("):
            while True:
                params.append(self.next().text)
                if not self.take(";"):
                    break
            self.need(")")
        self.need(":")
        body = self.pipe()
        self.need(";")
        return name, params, body

    def pipe(self):
        if self.is_("def"):
            name, params, body = self.definition()
            return ("def", name, params, body, self.pipe())
        left = self.comma()
        if self.take("as"):
            pats = [self.pattern()]
            while self.take("?//"):
                pats.append(self.pattern())
            self.need("|")
            return ("as", left, pats, self.pipe())
        if self.take("|"):
            return ("pipe", left, self.pipe())
        return left

    def comma(self):
        left = self.assign()
        while self.take(","):
            left = ("comma", left, self.assign())
        return left

    def assign(self):
        left = self.binary(0)
        t = self.peek()
        if t.kind == "op" and t.text in _ASSIGN:
            self.next()
            return ("assign", t.text, left, self.binary(0))
        return left

    def binary(self, level: int):
        if level == len(_BINARY):
            return self.unary()
        ops, assoc = _BINARY[level]
        left = self.binary(level + 1)
        while self.is_(*ops):
            op = self.next().text
            right = self.binary(level if assoc == "right" else level + 1)
            left = ("and" if op == "and" else "or" if op == "or" else "alt" if op == "//" else "bin", op, left, right)
            if assoc == "none" and self.is_(*ops):
                self.fail("comparisons don't chain")
        return left

    def unary(self):
        if self.take("-"):
            return ("neg", self.unary())
        if self.is_("reduce", "foreach", "if", "try", "label"):
            return self.postfix()
        left = self.postfix()
        if self.is_("as"):
            self.next()
            pats = [self.pattern()]
            while self.take("?//"):
                pats.append(self.pattern())
            self.need("|")
            return ("as", left, pats, self.pipe())
        return left

    def pattern(self):
        t = self.next()
        if t.kind == "var":
            return ("pvar", t.text[1:])
        if t.kind == "op" and t.text == "[":
            items = [self.pattern()]
            while self.take(","):
                items.append(self.pattern())
            self.need("]")
            return ("parr", items)
        if t.kind == "op" and t.text == "{":
            items = []
            while True:
                k = self.next()
                if k.kind == "var":
                    items.append((("lit", k.text[1:]), k.text[1:], self.pattern() if self.take(":") else None))
                else:
                    if k.kind == "name":
                        key = ("lit", k.text)
                    elif k.kind == "str":
                        key = ("str", None, k.text)
                    elif k.text == "(":
                        key = self.pipe()
                        self.need(")")
                    else:
                        self.i -= 1
                        self.fail("expected a key")
                    self.need(":")
                    items.append((key, None, self.pattern()))
                if not self.take(","):
                    break
            self.need("}")
            return ("pobj", items)
        self.i -= 1
        self.fail("expected a pattern")

    def postfix(self):
        e = self.term()
        while True:
            t = self.peek()
            if t.kind == "field":
                self.next()
                e = ("index", e, ("lit", t.text[1:]))
            elif t.kind == "op" and t.text == "." and self.peek(1).kind == "str":
                self.next()
                e = ("index", e, ("str", None, self.next().text))
            elif t.kind == "op" and t.text == "." and self.peek(1).text == "[" and self.peek(1).kind == "op":
                self.next()
            elif t.kind == "op" and t.text == "[":
                self.next()
                e = self.bracket(e)
            elif t.kind == "op" and t.text == "?":
                self.next()
                e = ("try", e, None)
            else:
                return e

    def bracket(self, e):
        if self.take("]"):
            return ("iter", e)
        if self.take(":"):
            hi = self.pipe()
            self.need("]")
            return ("slice", e, None, hi)
        lo = self.pipe()
        if self.take(":"):
            hi = None if self.is_("]") else self.pipe()
            self.need("]")
            return ("slice", e, lo, hi)
        self.need("]")
        return ("index", e, lo)

    def term(self):
        t = self.next()
        k, x = t.kind, t.text
        if k == "num":
            return ("lit", number(x))
        if k == "str":
            return ("str", None, x)
        if k == "fmt":
            if self.peek().kind == "str":
                return ("str", x, self.next().text)
            return ("call", x, [])
        if k == "field":
            return ("index", ("id",), ("lit", x[1:]))
        if k == "var":
            if x == "$__loc__":
                return ("lit", {"file": "<top-level>", "line": self.src.count("\n", 0, t.at) + 1})
            return ("var", x[1:])
        if k == "op":
            if x == ".":
                if self.peek().kind == "str":
                    return ("index", ("id",), ("str", None, self.next().text))
                return ("id",)
            if x == "..":
                return ("call", "recurse", [])
            if x == "(":
                e = self.pipe()
                self.need(")")
                return e
            if x == "[":
                if self.take("]"):
                    return ("array", None)
                e = self.pipe()
                self.need("]")
                return ("array", e)
            if x == "{":
                return self.object()
            if x == "-":
                return ("neg", self.postfix())
        if k == "name":
            if x == "if":
                return self.conditional()
            if x == "try":
                body = self.post_try()
                return ("try", body, self.post_try() if self.take("catch") else ("call", "empty", []))
            if x in ("reduce", "foreach"):
                src = self.postfix()
                self.need("as")
                pats = [self.pattern()]
                while self.take("?//"):
                    pats.append(self.pattern())
                self.need("(")
                args = [self.pipe()]
                while self.take(";"):
                    args.append(self.pipe())
                self.need(")")
                if len(args) not in ((2,) if x == "reduce" else (2, 3)):
                    self.fail(f"wrong number of parts of {x}")
                return (x, src, pats, *args, *([None] * (3 - len(args)) if x == "foreach" else []))
            if x == "label":
                v = self.next()
                self.need("|")
                return ("label", v.text[1:], self.pipe())
            if x == "def":
                self.i -= 1
                name, params, body = self.definition()
                return ("def", name, params, body, self.pipe())
            if x == "break":
                return ("break", self.next().text[1:])
            if x in KEYWORDS:
                self.i -= 1
                self.fail("unexpected keyword")
            if x in _CONSTANTS and not self.is_("("):
                return ("lit", _CONSTANTS[x])
            args = []
            if self.take("("):
                args.append(self.pipe())
                while self.take(";"):
                    args.append(self.pipe())
                self.need(")")
            return ("call", x, args)
        self.i -= 1
        self.fail("expected a term")

    def post_try(self):
        if self.is_("-"):
            return self.unary()
        return self.postfix()

    def conditional(self):
        c = self.pipe()
        self.need("then")
        a = self.pipe()
        if self.take("elif"):
            return ("if", c, a, self.conditional())
        b = self.pipe() if self.take("else") else ("id",)
        self.need("end")
        return ("if", c, a, b)

    def object(self):
        items = []
        while not self.take("}"):
            t = self.next()
            if t.kind == "var":
                name = t.text[1:]
                value = ("lit", {"file": "<top-level>", "line": self.src.count("\n", 0, t.at) + 1}) if name == "__loc__" else ("var", name)
                items.append((("lit", name), value))
            else:
                if t.kind == "name":
                    key = ("lit", t.text)
                elif t.kind == "num":
                    key = ("lit", number(t.text))
                elif t.kind == "str":
                    key = ("str", None, t.text)
                elif t.kind == "fmt":
                    key = ("str", t.text, self.next().text) if self.peek().kind == "str" else ("call", t.text, [])
                elif t.text == "(":
                    key = self.pipe()
                    self.need(")")
                else:
                    self.i -= 1
                    self.fail("expected a key")
                if self.take(":"):
                    value = self.object_value()
                else:
                    value = ("index", ("id",), key)
                items.append((key, value))
            if not self.take(","):
                self.need("}")
                break
        return ("object", items)

    def object_value(self):
        left = self.binary(0)
        while self.take("|"):
            left = ("pipe", left, self.binary(0))
        return left


def parse(src: str):
    """The syntax tree of a query; an empty one is the identity."""
    meta, imports, defs, body = parse_program(src)
    if imports:
        raise QuerySyntaxError("imports need a module loader")
    e = body or ("id",)
    for name, params, b in reversed(defs):
        e = ("def", name, params, b, e)
    return e


def parse_program(src: str):
    """(metadata, imports, definitions, body) of a query or module."""
    return Parser(src, lex(src)[0]).program()
