"""Decoders and encoders of one text: between a document's text and values."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from larkspur.functions.numbers import number, show
from larkspur.functions.values import QueryError, dumps, kind, loads

# ---------------------------------------------------------------- JSON and its kin

_DECODER = json.JSONDecoder(parse_float=number, parse_int=number, strict=False)


def json_roots(text: str) -> Iterator:
    """Every root of a text of JSON values parted by white space."""
    at, n = 0, len(text)
    while True:
        while at < n and text[at] in " \t\r\n\ufeff":
            at += 1
        if at == n:
            return
        try:
            v, at = _DECODER.raw_decode(text, at)
        except json.JSONDecodeError as e:
            raise QueryError(f"{e.msg} at {e.pos}") from None
        yield v


def json_sequence(text: str) -> Iterator:
    """The records of an RS-framed sequence; a broken record is an error value of its own."""
    for part in text.split("\x1e")[1:]:
        if part.strip():
            yield loads(part)


_JSON5 = re.compile(
    r"""\s+|//[^\n]*|/\*.*?\*/
  |(?P<triple>'{3}(?:.*?)'{3}|"{3}(?:.*?)"{3})
  |(?P<str>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')
  |(?P<num>[+-]?(?:0[xX][0-9a-fA-F]+|Infinity|NaN|\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?))
  |(?P<name>[A-Za-z_$][\w$]*)
  |(?P<op>[{}\[\]:,])""",
    re.X | re.S,
)
_ESC5 = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "0": "\0"}


def _unescape5(s: str) -> str:
    def one(m):
        c = m[1]
        if c[0] in "ux" and len(c) > 1:
            return chr(int(c[1:], 16))
        return "" if c in ("\n", "\r\n") else _ESC5.get(c, c)

    return re.sub(r"\\(u[0-9a-fA-F]{4}|x[0-9a-fA-F]{2}|\r\n|.)", one, s, flags=re.S)


def json5(text: str):
    """One JSON5 value."""
    tokens, at = [], 0
    while at < len(text):
        m = _JSON5.match(text, at)
        if not m or m.end() == at:
            raise QueryError(f"unexpected {text[at]!r} at {at}")
        at = m.end()
        if m.lastgroup:
            tokens.append((m.lastgroup, m.group()))
    tokens.append(("end", ""))
    v, i = _value5(tokens, 0)
    if tokens[i][0] != "end":
        raise QueryError(f"unexpected {tokens[i][1]!r} after the value")
    return v


def _number5(t: str):
    sign, body = (-1, t[1:]) if t.startswith("-") else (1, t.lstrip("+"))
    if body.lower().startswith("0x"):
        return sign * int(body, 16)
    if body in ("Infinity", "NaN"):
        return sign * float(body.replace("Infinity", "inf"))
    if body.startswith(".") or re.match(r"\d+\.(?:$|[eE])", body):
        return sign * float(body)
    return number(("-" if sign < 0 else "") + body)


def _value5(tokens, i):
    k, t = tokens[i]
    if k == "triple":
        return t[3:-3], i + 1
    if k == "str":
        return _unescape5(t[1:-1]), i + 1
    if k == "num":
        return _number5(t), i + 1
    if k == "name" and t in ("true", "false", "null", "Infinity", "NaN"):
        return {"true": True, "false": False, "null": None, "Infinity": float("inf"), "NaN": float("nan")}[t], i + 1
    if t == "[":
        out, i = [], i + 1
        while tokens[i][1] != "]":
            v, i = _value5(tokens, i)
            out.append(v)
            if tokens[i][1] == ",":
                i += 1
            elif tokens[i][1] != "]":
                raise QueryError("expected , or ]")
        return out, i + 1
    if t == "{":
        out, i = {}, i + 1
        while tokens[i][1] != "}":
            kk, kt = tokens[i]
            if kk not in ("str", "name", "num"):
                raise QueryError("expected a key")
            if tokens[i + 1][1] != ":":
                raise QueryError("expected :")
            v, i = _value5(tokens, i + 2)
            out[_unescape5(kt[1:-1]) if kk == "str" else kt] = v
            if tokens[i][1] == ",":
                i += 1
            elif tokens[i][1] != "}":
                raise QueryError("expected , or }")
        return out, i + 1
    raise QueryError(f"unexpected {t or 'end'!r}")


# ---------------------------------------------------------------- delimited text


def split_rows(text: str, sep: str) -> list[list[tuple[str, bool]]]:
    """Rows of (text, quoted) fields."""
    rows, row, at, n = [], [], 0, len(text)
    while at < n:
        if text[at] == '"':
            end, out = at + 1, []
            while True:
                stop = text.find('"', end)
                if stop < 0:
                    raise QueryError("unclosed quote")
                out.append(text[end:stop])
                if text[stop + 1 : stop + 2] == '"':
                    out.append('"')
                    end = stop + 2
                else:
                    end = stop + 1
                    break
            field, quoted, at = "".join(out), True, end
            if at < n and text[at] not in (sep, "\n", "\r"):
                raise QueryError("text after a closing quote")
        else:
            m = re.compile(f"[^{re.escape(sep)}\r\n]*").match(text, at)
            field, quoted, at = m.group(), False, m.end()
        row.append((field, quoted))
        if at < n and text[at] == sep:
            at += 1
            if at == n:
                row.append(("", False))
                rows.append(row)
                row = []
            continue
        rows.append(row)
        row = []
        at += 2 if text[at : at + 2] == "\r\n" else 1
    return rows


_JSON_NUMBER = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?")


def scalar(field: str, quoted: bool):
    """An unquoted field's value: empty is null; true, false and numbers are typed; other text is a string."""
    if quoted:
        return field
    if field == "":
        return None
    if field in ("true", "false"):
        return field == "true"
    return number(field) if _JSON_NUMBER.fullmatch(field) else field


def delimited(text: str, sep: str) -> Iterator[dict]:
    """An object for each row after the header."""
    rows = split_rows(text.removeprefix("\ufeff"), sep)
    if not rows:
        return
    header = [f for f, _ in rows[0]]
    if len(set(header)) < len(header):
        raise QueryError("duplicate header")
    for r in rows[1:]:
        if len(r) > len(header):
            raise QueryError("a row has more fields than the header")
        values = [scalar(*f) for f in r]
        yield dict(zip(header, values + [None] * (len(header) - len(values)), strict=True))


def _cell(v, sep: str) -> str:
    if isinstance(v, (list, dict)):
        raise QueryError("arrays and objects have no place in a row")
    if v is None:
        return ""
    if not isinstance(v, str):
        return dumps(v)
    if v == "" or scalar(v, False) != v or any(c in v for c in (sep, '"', "\n", "\r")) or v != v.strip():
        return '"' + v.replace('"', '""') + '"'
    return v


def to_delimited(values, sep: str) -> str:
    """Header and rows; the first object's keys are the header, later rows may leave keys out but add none."""
    out, header = [], None
    for v in values:
        if not isinstance(v, dict):
            raise QueryError(f"a row must be an object, not {kind(v)}")
        if header is None:
            header = list(v)
            out.append(sep.join(_cell(k, sep) if k else '""' for k in header))
        if set(v) - set(header):
            raise QueryError("a row has a key that the header lacks")
        out.append(sep.join(_cell(v.get(k), sep) for k in header))
    return "\n".join(out) + ("\n" if out else "")


# ---------------------------------------------------------------- YAML (the JSON-shaped part)


def yaml_documents(text: str) -> Iterator:
    import yaml

    class Loader(yaml.SafeLoader):
        pass

    Loader.yaml_implicit_resolvers = {k: [(t, r) for t, r in v if t not in ("tag:yaml.org,2002:timestamp",)] for k, v in yaml.SafeLoader.yaml_implicit_resolvers.items()}
    for d in yaml.load_all(text, Loader):
        yield _plain(d)


def _plain(v):
    if isinstance(v, dict):
        return {k if isinstance(k, str) else dumps(k): _plain(x) for k, x in v.items()}
    return list(map(_plain, v)) if isinstance(v, (list, tuple)) else v


_BARE = re.compile(r"[A-Za-z_][A-Za-z0-9_ ./-]*")
_RESERVED = {"true", "false", "null", "yes", "no", "on", "off", "y", "n", "~"}


def _yaml_string(s: str) -> str:
    return s if _BARE.fullmatch(s) and s.lower() not in _RESERVED and s == s.strip() else dumps(s)


def to_yaml(v, level: int = 0) -> str:
    pad = "  " * level
    if isinstance(v, dict) and v:
        out = []
        for k, x in v.items():
            nested = isinstance(x, (dict, list)) and x
            out.append(f"{pad}{_yaml_string(k)}:" + ("\n" + to_yaml(x, level + 1) if nested else " " + to_yaml(x)))
        return "\n".join(out)
    if isinstance(v, list) and v:
        out = []
        for x in v:
            if isinstance(x, (dict, list)) and x:
                body = to_yaml(x, level + 1)
                out.append(f"{pad}- {body[len(pad) + 2 :]}")
            else:
                out.append(f"{pad}- {to_yaml(x)}")
        return "\n".join(out)
    return _yaml_string(v) if isinstance(v, str) else "{}" if v == {} and isinstance(v, dict) else "[]" if isinstance(v, list) else dumps(v)


# ---------------------------------------------------------------- TOON

_KEY = re.compile(r"[A-Za-z_][A-Za-z0-9_.]*")
_LIKE_NUMBER = re.compile(r"-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|0\d+")


def _toon_quoted(s: str) -> str:
    return '"' + s.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t") + '"'


def _toon_scalar(v, sep: str = ",") -> str:
    if not isinstance(v, str):
        return show(v) if kind(v) == "number" else dumps(v)
    bare = v and v == v.strip() and v not in ("true", "false", "null") and not _LIKE_NUMBER.fullmatch(v) and not v.startswith("-") and not any(c in v for c in ':"\\[]{}\n\r\t' + sep)
    return v if bare else _toon_quoted(v)


def _toon_key(k: str) -> str:
    return k if _KEY.fullmatch(k) else _toon_quoted(k)


def _scalars(v) -> bool:
    return all(not isinstance(x, (list, dict)) for x in v)


def to_toon(v) -> str:
    """Canonical TOON: indentation of two, comma rows, tables where all rows are objects of equal scalar keys."""
    if isinstance(v, dict):
        return "\n".join(_toon_members(v, 0))
    if isinstance(v, list):
        return "\n".join(_toon_array("", v, 0))
    return _toon_scalar(v)


def _toon_members(o: dict, level: int) -> list[str]:
    pad, out = "  " * level, []
    for k, v in o.items():
        key = _toon_key(k)
        if isinstance(v, dict):
            out.append(f"{pad}{key}:")
            out += _toon_members(v, level + 1)
        elif isinstance(v, list):
            out += _toon_array(key, v, level)
        else:
            out.append(f"{pad}{key}: {_toon_scalar(v)}")
    return out


def _toon_array(key: str, v: list, level: int) -> list[str]:
    pad = "  " * level
    if _scalars(v):
        return [f"{pad}{key}[{len(v)}]:" + (" " + ",".join(map(_toon_scalar, v)) if v else "")]
    if all(isinstance(x, dict) and x for x in v) and all(set(x) == set(v[0]) and _scalars(x.values()) for x in v):
        head = list(v[0])
        return [f"{pad}{key}[{len(v)}]{{{','.join(map(_toon_key, head))}}}:", *(f"{pad}  " + ",".join(_toon_scalar(x[k]) for k in head) for x in v)]
    out = [f"{pad}{key}[{len(v)}]:"]
    for x in v:
        if isinstance(x, dict):
            lines = _toon_members(x, level + 2)
            out.append(f"{pad}  - {lines[0].lstrip()}" if lines else f"{pad}  -")
            out += lines[1:]
        elif isinstance(x, list):
            lines = _toon_array("", x, level + 1)
            out.append(f"{pad}  - {lines[0].lstrip()}")
            out += ["  " + line for line in lines[1:]]
        else:
            out.append(f"{pad}  - {_toon_scalar(x)}")
    return out


_HEAD = re.compile(r'(?P<key>"(?:[^"\\]|\\.)*"|[^:\[\]{}"]*)\[(?P<n>\d+)(?P<sep>[\t|]?)\](?:\{(?P<fields>.*)\})?:(?P<rest>.*)', re.S)


def from_toon(text: str, strict: bool = True):
    """The value of a TOON document. Strict: counts and indentation have to agree."""
    lines = []
    for raw in text.split("\n"):
        if raw.strip():
            indent = len(raw) - len(raw.lstrip(" "))
            if strict and (indent % 2 or raw.lstrip(" ").startswith("\t")):
                raise QueryError("indentation isn't a multiple of two blanks")
            lines.append((indent // 2, raw.strip(" \r")))
    if not lines:
        return {}
    d = _Toon(lines, strict)
    first = lines[0][1]
    m = _HEAD.fullmatch(first)
    if m and not m["key"]:
        v = d.array(m, 0)
    elif len(lines) == 1 and not m and _colon(first) < 0:
        d.i, v = 1, _toon_value(first)
    else:
        v = d.members(0)
    if d.i < len(lines):
        raise QueryError(f"unexpected line {lines[d.i][1]!r}")
    return v


def _toon_value(s: str):
    s = s.strip()
    if s.startswith('"'):
        try:
            return json.loads(s, strict=False)
        except ValueError:
            raise QueryError(f"bad string {s[:40]}") from None
    if s in ("true", "false", "null"):
        return {"true": True, "false": False, "null": None}[s]
    return number(s) if _JSON_NUMBER.fullmatch(s) else s


def _outside(s: str, char: str) -> list[int]:
    out, quoted, i = [], False, 0
    while i < len(s):
        if quoted and s[i] == "\\":
            i += 1
        elif s[i] == '"':
            quoted = not quoted
        elif s[i] == char and not quoted:
            out.append(i)
        i += 1
    return out


def _colon(s: str) -> int:
    return next(iter(_outside(s, ":")), -1)


def _cells(s: str, sep: str) -> list[str]:
    cuts = [-1, *_outside(s, sep), len(s)]
    return [s[a + 1 : b].strip() for a, b in zip(cuts, cuts[1:])]


class _Toon:
    def __init__(self, lines, strict):
        self.lines, self.strict, self.i = lines, strict, 0

    def members(self, level: int, first: str | None = None) -> dict:
        out: dict = {}
        while True:
            if first is not None:
                s, first = first, None
            else:
                if self.i >= len(self.lines) or self.lines[self.i][0] < level:
                    return out
                if self.lines[self.i][0] > level:
                    raise QueryError("unexpected indentation")
                s = self.lines[self.i][1]
                if s.startswith("- ") or s == "-":
                    return out
                self.i += 1
            self.member(s, level, out)

    def member(self, s: str, level: int, out: dict) -> None:
        m = _HEAD.fullmatch(s)
        if m and m["key"]:
            self.i -= 1
            out[_toon_name(m["key"])] = self.array(m, level)
            return
        at = _colon(s)
        if at < 0:
            raise QueryError(f"a member needs a colon: {s[:40]!r}")
        key, rest = _toon_name(s[:at].strip()), s[at + 1 :].strip()
        if self.strict and key in out:
            raise QueryError(f"duplicate key {key!r}")
        if rest:
            out[key] = _toon_value(rest)
        elif self.i < len(self.lines) and self.lines[self.i][0] > level:
            out[key] = self.members(level + 1)
        else:
            out[key] = {}

    def array(self, m, level: int) -> list:
        self.i += 1
        n, sep, rest = int(m["n"]), m["sep"] or ",", m["rest"].strip()
        out: list = []
        if m["fields"] is not None:
            names = [_toon_name(x) for x in _cells(m["fields"], sep)]
            while self.i < len(self.lines) and self.lines[self.i][0] > level:
                cells = _cells(self.lines[self.i][1], sep)
                if len(cells) != len(names):
                    if self.strict:
                        raise QueryError("a row's width differs from its header's")
                    cells = (cells + [""] * len(names))[: len(names)]
                out.append(dict(zip(names, map(_toon_value, cells), strict=True)))
                self.i += 1
        elif rest:
            out = [_toon_value(x) for x in _cells(rest, sep)]
        else:
            while self.i < len(self.lines) and self.lines[self.i][0] == level + 1 and self.lines[self.i][1].startswith("-"):
                s = self.lines[self.i][1][1:].strip()
                self.i += 1
                h = _HEAD.fullmatch(s)
                if not s:
                    out.append({})
                elif h and not h["key"]:
                    self.i -= 1
                    out.append(self.array(h, level + 1))
                elif h or _colon(s) >= 0:
                    item: dict = {}
                    if h:
                        self.lines[self.i - 1] = (level + 2, s)
                        self.i -= 1
                        item = self.members(level + 2)
                    else:
                        self.member(s, level + 2, item)
                        item.update(self.members(level + 2))
                    out.append(item)
                else:
                    out.append(_toon_value(s))
        if self.strict and len(out) != n:
            raise QueryError(f"an array has {len(out)} items, its header says {n}")
        return out


def _toon_name(s: str) -> str:
    return _toon_value(s) if s.startswith('"') else s.strip()


# ---------------------------------------------------------------- by name

DECODERS = {
    "json": lambda t: json_roots(t),
    "jsonl": lambda t: (loads(x) for x in t.split("\n") if x.strip()),
    "json-seq": json_sequence,
    "json5": lambda t: iter((json5(t),)),
    "yaml": yaml_documents,
    "csv": lambda t: delimited(t, ","),
    "tsv": lambda t: delimited(t, "\t"),
    "toon": lambda t: iter((from_toon(t),)),
    "toon-seq": lambda t: (from_toon(x) for x in t.split("\x1e")[1:] if x.strip()),
    "raw": lambda t: iter(t.removesuffix("\n").split("\n") if t else ()),
    "raw-slurp": lambda t: iter((t,)),
}
DECODERS |= {"ndjson": DECODERS["jsonl"], "yml": DECODERS["yaml"]}

ENCODERS = {
    "json": lambda vs, **o: "".join(dumps(v, o.get("indent"), o.get("sort_keys", False), o.get("ascii", False)) + "\n" for v in vs),
    "jsonl": lambda vs, **o: "".join(dumps(v) + "\n" for v in vs),
    "json-seq": lambda vs, **o: "".join("\x1e" + dumps(v) + "\n" for v in vs),
    "yaml": lambda vs, **o: "---\n".join(to_yaml(v) + "\n" for v in vs),
    "csv": lambda vs, **o: to_delimited(vs, ","),
    "tsv": lambda vs, **o: to_delimited(vs, "\t"),
    "toon": lambda vs, **o: "\n".join(map(to_toon, vs)) + "\n",
    "toon-seq": lambda vs, **o: "".join("\x1e" + to_toon(v) + "\n" for v in vs),
    "raw": lambda vs, **o: "".join((v if isinstance(v, str) else dumps(v)) + o.get("end", "\n") for v in vs),
}


def probe(text: str) -> str:
    """The format that the beginning of a document looks like."""
    if text.startswith("\x1e"):
        return "json-seq"
    s = text.lstrip("\ufeff \t\r\n")
    if s[:1] in ("{", "[", '"') and not re.match(r"\[\d+[\t|]?\](\{[^\n]*\})?:", s) and not re.match(r'"(?:[^"\\]|\\.)*"\s*:', s):
        return "json"
    if s.startswith("---") or re.search(r"^\s*- ", s, re.M) and not re.search(r"\[\d+\]", s):
        return "yaml"
    first = s.split("\n", 1)[0].strip()
    return "json" if _JSON_NUMBER.fullmatch(first) or first in ("true", "false", "null") else "toon"
