"""Built-in functions of plain values: operators, strings, formats, regular expressions, dates, mathematics."""

from __future__ import annotations

import base64
import calendar
import html
import math
import time
import urllib.parse

from larkspur.functions.numbers import Literal, show
from larkspur.functions.values import QueryError, compare, dumps, kind, loads, order_key, shown, sorted_keys, truthy


def is_number(v) -> bool:
    return isinstance(v, (int, float)) and v is not True and v is not False


def cut(text: str) -> str:
    return text if len(text.encode()) <= 30 else text[:27] + "..."


def tidy(x):
    """A whole double as int, so that it prints and indexes as one."""
    return int(x) if isinstance(x, float) and not isinstance(x, Literal) and x.is_integer() and abs(x) < 1e17 and (x or math.copysign(1, x) > 0) else x


def _two(a, b, doing):
    raise QueryError(f"{shown(a)} and {shown(b)} cannot be {doing}")


def add(a, b):
    if a is None:
        return b
    if b is None:
        return a
    if is_number(a) and is_number(b):
        return tidy(float(a) + float(b))
    if isinstance(a, str) and isinstance(b, str) or isinstance(a, list) and isinstance(b, list):
        return a + b
    if isinstance(a, dict) and isinstance(b, dict):
        return {**a, **b}
    _two(a, b, "added")


def subtract(a, b):
    if is_number(a) and is_number(b):
        return tidy(float(a) - float(b))
    if isinstance(a, list) and isinstance(b, list):
        return [x for x in a if not any(compare(x, y) == 0 for y in b)]
    _two(a, b, "subtracted")


def _merge(a, b):
    out = dict(a)
    for k, v in b.items():
        out[k] = _merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def multiply(a, b):
    if is_number(a) and is_number(b):
        return tidy(float(a) * float(b))
    if isinstance(a, str) and is_number(b) or is_number(a) and isinstance(b, str):
        s, n = (a, b) if isinstance(a, str) else (b, a)
        if n != n or n < 0:
            return None
        if len(s) * n > 1 << 29:
            raise QueryError("Repeat string result too long")
        return s * (int(n) if n >= 1 or n == 0 else 1)
    if isinstance(a, dict) and isinstance(b, dict):
        return _merge(a, b)
    _two(a, b, "multiplied")


def divide(a, b):
    if is_number(a) and is_number(b):
        if b == 0:
            _two(a, b, "divided because the divisor is zero")
        return tidy(float(a) / float(b))
    if isinstance(a, str) and isinstance(b, str):
        return split(a, b)
    _two(a, b, "divided")


def _whole(x) -> int:
    x = float(x)
    return int(max(min(x, 9.2e18), -9.2e18))


def modulo(a, b):
    if is_number(a) and is_number(b):
        if math.isnan(a) or math.isnan(b):
            return math.nan
        x, y = _whole(a), _whole(b)
        if y == 0:
            _two(a, b, "divided because the divisor is zero")
        r = abs(x) % abs(y)
        return -r if x < 0 else r
    _two(a, b, "divided")


def negate(v):
    if not is_number(v):
        raise QueryError(f"{shown(v)} cannot be negated")
    if isinstance(v, Literal):
        return Literal(v.text[1:] if v.text.startswith("-") else "-" + v.text)
    return -v if v else -0.0


OPERATORS = {
    "+": add, "-": subtract, "*": multiply, "/": divide, "%": modulo,
    "==": lambda a, b: compare(a, b) == 0, "!=": lambda a, b: compare(a, b) != 0, "<": lambda a, b: compare(a, b) < 0,
    "<=": lambda a, b: compare(a, b) <= 0, ">": lambda a, b: compare(a, b) > 0, ">=": lambda a, b: compare(a, b) >= 0,
}


# ---------------------------------------------------------------- containers


def length(v):
    if v is None:
        return 0
    if isinstance(v, bool):
        raise QueryError(f"{shown(v)} has no length")
    return abs(v) if is_number(v) and not isinstance(v, Literal) else tidy(abs(float(v))) if is_number(v) else len(v)


def keys(v, ordered: bool = True):
    if isinstance(v, dict):
        return sorted_keys(v) if ordered else list(v)
    if isinstance(v, list):
        return list(range(len(v)))
    raise QueryError(f"{shown(v)} has no keys")


def has(v, k):
    if isinstance(v, dict) and isinstance(k, str):
        return k in v
    if isinstance(v, list) and is_number(k):
        return k == k and 0 <= k < len(v)
    raise QueryError(f"Cannot check whether {kind(v)} has a {'string' if isinstance(k, str) else kind(k)} key")


def contains(a, b):
    if isinstance(a, dict) and isinstance(b, dict):
        return all(k in a and contains(a[k], v) for k, v in b.items())
    if isinstance(a, list) and isinstance(b, list):
        return all(any(kind(x) == kind(y) and contains(x, y) for x in a) for y in b)
    if isinstance(a, str) and isinstance(b, str):
        return b in a
    if kind(a) == kind(b):
        return compare(a, b) == 0
    _two(a, b, "have their containment checked")


def add_all(v):
    out = None
    for x in _members(v):
        out = add(out, x)
    return out


def _members(v):
    if isinstance(v, list):
        return v
    if isinstance(v, dict):
        return list(v.values())
    raise QueryError(f"Cannot iterate over {shown(v) if v is not None else 'null'}")


def from_entries(v):
    out = {}
    for e in _members(v):
        if not isinstance(e, dict):
            raise QueryError(f'Cannot index {kind(e)} with "key"')
        k = next((e[n] for n in ("key", "k", "name", "Name", "Key", "K") if n in e and truthy(e[n])), next((e[n] for n in ("key", "k", "name", "Name", "Key", "K") if e.get(n) is False), None))
        value = next((e[n] for n in ("value", "v", "Value", "V") if n in e), None)
        if is_number(k) or isinstance(k, bool) or k is None:
            k = "null" if k is None else dumps(k)
        if not isinstance(k, str):
            raise QueryError(f"Cannot use {shown(k)} as object key")
        out[k] = value
    return out


def flatten(v, depth=1e9):
    if not is_number(depth) or depth < 0:
        raise QueryError("flatten depth must not be negative")
    out = []
    for x in _members(v):
        if isinstance(x, list) and depth > 0:
            out += flatten(x, depth - 1)
        else:
            out.append(x)
    return out


def _array(v, doing):
    if not isinstance(v, list):
        raise QueryError(f"{shown(v)} cannot be {doing}, as it is not an array")
    return v


def sort(v):
    return sorted(_array(v, "sorted"), key=order_key)


def _pairs(v, ks):
    return sorted(zip(ks, v, strict=True), key=lambda p: order_key(p[0]))


def _groups(v, ks):
    out: list[tuple] = []
    for k, x in _pairs(v, ks):
        if out and compare(out[-1][0], k) == 0:
            out[-1][1].append(x)
        else:
            out.append((k, [x]))
    return [g for _, g in out]


def _least(v, ks):
    best = None
    for k, x in zip(ks, v, strict=True):
        if best is None or compare(k, best[0]) < 0:
            best = (k, x)
    return None if best is None else best[1]


def _most(v, ks):
    best = None
    for k, x in zip(ks, v, strict=True):
        if best is None or compare(k, best[0]) >= 0:
            best = (k, x)
    return None if best is None else best[1]


BY = {
    "sort_by": lambda v, ks: [x for _, x in _pairs(v, ks)],
    "group_by": _groups,
    "unique_by": lambda v, ks: [g[0] for g in _groups(v, ks)],
    "min_by": _least,
    "max_by": _most,
}


def reverse(v):
    if v is None:
        return []
    if isinstance(v, (list, str)):
        return v[::-1]
    raise QueryError(f"Cannot reverse {shown(v)}")


def transpose(v):
    n = max((len(r) for r in v), default=0)
    return [[r[i] if i < len(r) else None for r in v] for i in range(n)]


def combinations(v):
    if not v:
        yield []
        return
    for x in _members(v[0]):
        for rest in combinations(v[1:]):
            yield [x, *rest]


def bsearch(v, x):
    _array(v, "searched from")
    lo, hi = 0, len(v)
    while lo < hi:
        mid = (lo + hi) // 2
        c = compare(v[mid], x)
        if c == 0:
            return mid
        lo, hi = (mid + 1, hi) if c < 0 else (lo, mid)
    return -1 - lo


def indices(v, x):
    if v is None:
        return None
    if isinstance(v, str) and isinstance(x, str):
        return [i for i in range(len(v) - len(x) + 1) if v.startswith(x, i)] if x else None
    if isinstance(v, list) and isinstance(x, list):
        return [i for i in range(len(v) - len(x) + 1) if all(compare(a, b) == 0 for a, b in zip(v[i:], x))] if x else None
    if isinstance(v, list):
        return [i for i, y in enumerate(v) if compare(x, y) == 0]
    raise QueryError(f"Cannot determine indices of {shown(x)} in {shown(v)}" if isinstance(v, str) else f"Cannot index {kind(v)} with {kind(x)}")


def tostream(v, path=(), top=True):
    if isinstance(v, (list, dict)) and v:
        items = list(enumerate(v)) if isinstance(v, list) else list(v.items())
        for k, x in items:
            yield from tostream(x, (*path, k), False)
        yield [[*path, items[-1][0]]]
    else:
        yield [list(path), v]


# ---------------------------------------------------------------- strings


def _str(v, doing):
    if not isinstance(v, str):
        raise QueryError(f"{shown(v)} {doing}")
    return v


def tostring(v):
    return v if isinstance(v, str) else dumps(v)


def tonumber(v):
    if is_number(v):
        return v
    if isinstance(v, str):
        from larkspur.functions.numbers import number
        import re

        if re.fullmatch(r"-?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", v):
            return number(v) if not v.startswith((".", "-.")) and not v.rstrip("0123456789").endswith(".") or "e" in v.lower() else tidy(float(v))
        if v in ("nan", "-nan", "NaN"):
            return math.nan
    raise QueryError(f"{shown(v)} cannot be parsed as a number")


def toboolean(v):
    if isinstance(v, bool):
        return v
    if v in ("true", "false"):
        return v == "true"
    raise QueryError(f"{shown(v)} cannot be parsed as a boolean")


def _ascii(lower: bool):
    table = {a: a + 32 for a in range(65, 91)} if lower else {a: a - 32 for a in range(97, 123)}

    def change(v):
        if not isinstance(v, str):
            raise QueryError(f"ascii_{'downcase' if lower else 'upcase'} input must be a string")
        return v.translate(table)

    return change


_BLANK = " \t\n\r\f\v"


def _trim(left, right):
    def change(v):
        if not isinstance(v, str):
            raise QueryError(f"{shown(v)} cannot be trimmed")
        v = v.lstrip(None) if left else v
        return v.rstrip(None) if right else v

    return change


def ltrimstr(v, x):
    return v[len(x) :] if isinstance(v, str) and isinstance(x, str) and x and v.startswith(x) else v


def rtrimstr(v, x):
    return v[: -len(x)] if isinstance(v, str) and isinstance(x, str) and x and v.endswith(x) else v


def startswith(v, x):
    if not (isinstance(v, str) and isinstance(x, str)):
        raise QueryError("startswith() requires string inputs")
    return v.startswith(x)


def endswith(v, x):
    if not (isinstance(v, str) and isinstance(x, str)):
        raise QueryError("endswith() requires string inputs")
    return v.endswith(x)


def join(v, sep):
    parts = []
    for x in _members(v):
        if isinstance(x, (list, dict)):
            _two(sep, x, "added")
        parts.append("" if x is None else tostring(x))
    if len(parts) and not isinstance(sep, str):
        if sep is None:
            return "".join(parts)
        _two(parts[0], sep, "added")
    return sep.join(parts) if parts else ""


def split(v, sep):
    if not (isinstance(v, str) and isinstance(sep, str)):
        raise QueryError("split input and separator must be strings")
    if not v:
        return []
    return v.split(sep) if sep else list(v)


def implode(v):
    if not isinstance(v, list):
        raise QueryError("implode input must be an array")
    out = []
    for c in v:
        if not is_number(c):
            raise QueryError("Unicode codepoint must be numeric")
        c = int(c)
        out.append(chr(c) if 0 <= c < 0xD800 or 0xE000 <= c < 0x110000 else "�")
    return "".join(out)


# ---------------------------------------------------------------- formats


def _csv(v):
    if isinstance(v, (list, dict)):
        raise QueryError(f"{shown(v)} is not valid in a csv row")
    if isinstance(v, str):
        return '"' + v.replace('"', '""') + '"'
    return "" if v is None else dumps(v)


def _tsv(v):
    if isinstance(v, (list, dict)):
        raise QueryError(f"{shown(v)} is not valid in a csv row")
    if isinstance(v, str):
        return v.replace("\\", "\\\\").replace("\t", "\\t").replace("\n", "\\n").replace("\r", "\\r")
    return "" if v is None else dumps(v)


def _row(cell, sep, name):
    def render(v):
        if not isinstance(v, list):
            raise QueryError(f"{shown(v)} cannot be {name}-formatted, only an array can be")
        return sep.join(map(cell, v))

    return render


def _sh(v):
    def one(x):
        if isinstance(x, (list, dict)):
            raise QueryError(f"{shown(x)} can not be escaped for shell")
        return "'" + x.replace("'", "'\\''") + "'" if isinstance(x, str) else dumps(x)

    return " ".join(map(one, v)) if isinstance(v, list) else one(v)


def _base64d(v):
    s = tostring(v)
    try:
        body = "".join(s.split()).rstrip("=")
        if len(body) % 4 == 1:
            raise ValueError
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True).decode("utf-8", "replace")
    except ValueError:
        raise QueryError(f"{shown(s)} is not valid base64 data") from None


def _urid(v):
    import re

    s = tostring(v)
    if re.search("%(?![0-9A-Fa-f]{2})", s):
        raise QueryError(f"{shown(s)} is not a valid uri encoding")
    return urllib.parse.unquote(s, errors="replace")


FORMATS = {
    "@text": tostring,
    "@json": dumps,
    "@html": lambda v: html.escape(tostring(v), quote=True).replace("&#x27;", "&#39;"),
    "@uri": lambda v: urllib.parse.quote(tostring(v), safe="-_.~"),
    "@urid": _urid,
    "@csv": _row(_csv, ",", "csv"),
    "@tsv": _row(_tsv, "\t", "tsv"),
    "@sh": _sh,
    "@base64": lambda v: base64.b64encode(tostring(v).encode()).decode(),
    "@base64d": _base64d,
}


def formatter(name: str):
    if name not in FORMATS:
        raise LookupError(f"{name} is not a valid format")
    return FORMATS[name]


# ---------------------------------------------------------------- regular expressions

_compiled: dict[tuple, object] = {}


def _pattern(p, flags):
    import regex

    key = (p, flags)
    if key not in _compiled:
        if not isinstance(p, str):
            raise QueryError(f"{shown(p)} cannot be matched, as it is not a string")
        bits = regex.VERSION0 | regex.UNICODE | regex.MULTILINE
        for c in flags or "":
            if c == "x":
                bits |= regex.VERBOSE
            elif c == "i":
                bits |= regex.IGNORECASE
            elif c in "sp":
                bits |= regex.DOTALL
            elif c == "l":
                bits |= regex.POSIX
            elif c not in "gn":
                raise QueryError(f"{flags} is not a valid modifier string")
        # in this dialect the dot stops at line ends unless s or p is given, and names are (?<name>...)
        try:
            _compiled[key] = regex.compile(p, bits)
        except regex.error as e:
            raise QueryError(f"{p} (at offset 0) is not a valid regex: {e}") from None
    return _compiled[key]


def matches(v, p, flags) -> list[dict]:
    if not isinstance(v, str):
        raise QueryError(f"{shown(v)} cannot be matched, as it is not a string")
    if flags is not None and not isinstance(flags, str):
        raise QueryError(f"{shown(flags)} is not a string")
    r = _pattern(p, flags)
    names = {i: n for n, i in r.groupindex.items()}
    out = []
    for m in r.finditer(v):
        if "n" in (flags or "") and not m.group():
            continue
        caps = [
            {"offset": m.start(i), "length": m.end(i) - m.start(i), "string": m.group(i), "name": names.get(i)} if m.start(i) >= 0 else {"offset": -1, "length": 0, "string": None, "name": names.get(i)}
            for i in range(1, r.groups + 1)
        ]
        out.append({"offset": m.start(), "length": m.end() - m.start(), "string": m.group(), "captures": caps})
        if "g" not in (flags or ""):
            break
    return out


def _names(m):
    return {c["name"]: c["string"] for c in m["captures"] if c["name"] is not None}


def _split(v, p, flags):
    at, parts = 0, []
    for m in matches(v, p, (flags or "") + "g"):
        parts.append(v[at : m["offset"]])
        at = m["offset"] + m["length"]
    return [*parts, v[at:]]


REGEX = {
    "test": lambda v, p, f: [bool(matches(v, p, f))],
    "match": matches,
    "capture": lambda v, p, f: [_names(m) for m in matches(v, p, f)],
    "scan": lambda v, p, f: [[c["string"] for c in m["captures"]] if m["captures"] else m["string"] for m in matches(v, p, (f or "") + "g")],
    "splits": _split,
    "split": lambda v, p, f: [_split(v, p, f)],
}


# ---------------------------------------------------------------- dates


def gmtime(v):
    if not is_number(v):
        raise QueryError("gmtime() requires a number")
    whole = math.floor(v)
    try:
        t = time.gmtime(whole)
    except (ValueError, OverflowError, OSError):
        raise QueryError("error converting number of seconds since epoch to datetime") from None
    return _broken(t, v - whole)


def localtime(v):
    if not is_number(v):
        raise QueryError("localtime() requires a number")
    whole = math.floor(v)
    return _broken(time.localtime(whole), v - whole)


def _broken(t, fraction=0.0):
    return [t.tm_year, t.tm_mon - 1, t.tm_mday, t.tm_hour, t.tm_min, tidy(t.tm_sec + fraction), (t.tm_wday + 1) % 7, t.tm_yday - 1]


def _parts(v, name):
    if is_number(v):
        v = gmtime(v)
    if not isinstance(v, list) or len(v) < 6 or not all(map(is_number, v)):
        raise QueryError(f"{name} requires array of 6 numbers" if name == "mktime" else f"{name}/1 requires parsed datetime inputs")
    return v


def mktime(v):
    if not isinstance(v, list):
        raise QueryError("mktime requires array of 6 numbers")
    p = _parts(v, "mktime")
    return calendar.timegm((int(p[0]), int(p[1]) + 1, int(p[2]), int(p[3]), int(p[4]), int(p[5])))


def strftime(v, fmt, local: bool = False):
    if is_number(v) and local:
        v = localtime(v)
    p = _parts(v, "strflocaltime" if local else "strftime")
    if not isinstance(fmt, str):
        raise QueryError(f"{'strflocaltime' if local else 'strftime'}/1 requires a string format")
    days = calendar.timegm((int(p[0]), int(p[1]) + 1, int(p[2]), 0, 0, 0))
    g = time.gmtime(days)
    t = time.struct_time((int(p[0]), int(p[1]) + 1, int(p[2]), int(p[3]), int(p[4]), int(p[5]), g.tm_wday, g.tm_yday, -1 if local else 0))
    if not local:
        fmt = fmt.replace("%Z", "UTC").replace("%z", "+0000").replace("%s", str(calendar.timegm(t)))
    return time.strftime(fmt, t)


def strptime(v, fmt):
    if not isinstance(v, str):
        raise QueryError(f"strptime/1 requires string inputs and arguments")
    try:
        t = time.strptime(v, fmt.replace("%Z", "UTC").replace("%T", "%H:%M:%S").replace("%F", "%Y-%m-%d").replace("%e", "%d").replace("%D", "%m/%d/%y").replace("%R", "%H:%M")) if "%Z" not in fmt or "UTC" in v else time.strptime(v.replace("Z", "UTC") if v.endswith("Z") else v, fmt)
    except ValueError:
        raise QueryError(f'date "{v}" does not match format "{fmt}"') from None
    return _broken(t)


# ---------------------------------------------------------------- mathematics


def _num(v):
    if not is_number(v):
        raise QueryError(f"{shown(v)} number required")
    return float(v)


def _real(f):
    def run(v, *more):
        xs = [_num(x) for x in (more if more else (v,))]
        try:
            return tidy(f(*xs))
        except OverflowError:
            return math.inf
        except ValueError:
            return math.nan

    return run


def _whole_of(f):
    def run(x):
        return x if math.isinf(x) or math.isnan(x) else math.copysign(float(f(x)), x)

    return run


def _pow(x, y):
    try:
        return math.pow(x, y)
    except OverflowError:
        return -math.inf if x < 0 and y % 2 == 1 else math.inf
    except ValueError:
        return math.inf if x == 0 else math.nan


def _log(f):
    def run(x):
        return -math.inf if x == 0 else f(x)

    return run


def _expo(x):
    return -math.inf if x == 0 else x if x != x else math.inf if math.isinf(x) else float(math.frexp(x)[1] - 1)


def _bessel(n, x, second=False):
    """Bessel functions of whole order, by their integral forms (composite Simpson)."""
    if second and x <= 0:
        return -math.inf if x == 0 else math.nan
    steps = 2000

    def simpson(f, lo, hi):
        h = (hi - lo) / steps
        return (f(lo) + f(hi) + sum((4 if i % 2 else 2) * f(lo + i * h) for i in range(1, steps))) * h / 3

    if not second:
        return simpson(lambda t: math.cos(n * t - x * math.sin(t)), 0, math.pi) / math.pi
    top = 40.0 / (1 + x) + 10
    first = simpson(lambda t: math.sin(x * math.sin(t) - n * t), 0, math.pi) / math.pi
    rest = simpson(lambda t: (math.exp(n * t) + (-1) ** n * math.exp(-n * t)) * math.exp(-min(700.0, x * math.sinh(min(t, 30.0)))), 0, top) / math.pi
    return first - rest


def frexp(v):
    m, e = math.frexp(_num(v))
    return [tidy(m), e]


def modf(v):
    x = _num(v)
    f, i = (math.copysign(0.0, x), x) if math.isinf(x) else math.modf(x)
    return [tidy(f), tidy(i)]


def _round_half_away(x):
    return math.floor(abs(x) + 0.5)


def is_normal(x) -> bool:
    return x == x and not math.isinf(x) and abs(x) >= 2.2250738585072014e-308


def _abs(v):
    if not is_number(v):
        raise QueryError(f"{shown(v)} has no absolute value")
    return v if v > 0 or v == 0 and not str(v).startswith("-") else negate(v) if v < 0 else 0


def _ldexp(x, e):
    try:
        return math.ldexp(x, int(max(min(e, 5000), -5000)))
    except OverflowError:
        return math.copysign(math.inf, x)


def _gamma(x):
    if x == 0 or x < 0 and x == math.floor(x):
        return math.inf
    return math.lgamma(x)


ONE = {
    "acos": math.acos, "acosh": math.acosh, "asin": math.asin, "asinh": math.asinh, "atan": math.atan, "atanh": lambda x: math.copysign(math.inf, x) if abs(x) == 1 else math.atanh(x),
    "cbrt": math.cbrt, "ceil": _whole_of(math.ceil), "cos": math.cos, "cosh": math.cosh, "erf": math.erf, "erfc": math.erfc, "exp": math.exp, "exp10": lambda x: _pow(10.0, x),
    "exp2": lambda x: _pow(2.0, x), "expm1": math.expm1, "fabs": math.fabs, "floor": _whole_of(math.floor), "gamma": _gamma, "lgamma": _gamma, "j0": lambda x: _bessel(0, x), "j1": lambda x: _bessel(1, x),
    "log": _log(math.log), "log10": _log(math.log10), "log1p": lambda x: -math.inf if x == -1 else math.log1p(x), "log2": _log(math.log2), "logb": _expo,
    "nearbyint": _whole_of(round), "rint": _whole_of(round), "round": lambda x: x if math.isinf(x) or x != x else math.copysign(_round_half_away(x), x), "sin": math.sin, "sinh": math.sinh, "sqrt": math.sqrt,
    "significand": lambda x: x if x == 0 or math.isinf(x) or x != x else math.frexp(x)[0] * 2, "tan": math.tan, "tanh": math.tanh, "tgamma": lambda x: math.copysign(math.inf, x) if x == 0 else math.gamma(x),
    "trunc": _whole_of(math.trunc), "y0": lambda x: _bessel(0, x, True), "y1": lambda x: _bessel(1, x, True),
}
TWO = {
    "atan2": math.atan2, "copysign": math.copysign, "drem": lambda x, y: math.nan if y == 0 else math.remainder(x, y), "remainder": lambda x, y: math.nan if y == 0 else math.remainder(x, y),
    "fdim": lambda x, y: x - y if x > y else 0.0 if x == x and y == y else math.nan, "fmax": lambda x, y: y if x != x else x if y != y else max(x, y), "fmin": lambda x, y: y if x != x else x if y != y else min(x, y),
    "fmod": lambda x, y: math.nan if y == 0 else math.fmod(x, y), "hypot": math.hypot, "jn": lambda n, x: _bessel(int(n), x), "yn": lambda n, x: _bessel(int(n), x, True), "ldexp": _ldexp, "scalb": _ldexp,
    "scalbln": _ldexp, "nextafter": math.nextafter, "nexttoward": math.nextafter, "pow": _pow,
}

PLAIN = {
    "type/0": kind, "length/0": length, "utf8bytelength/0": lambda v: len(_str(v, "only strings have UTF-8 byte length").encode()), "not/0": lambda v: not truthy(v),
    "have_decnum/0": lambda v: True, "have_literal_numbers/0": lambda v: True, "has/1": has, "keys/0": keys, "keys_unsorted/0": lambda v: keys(v, False), "from_entries/0": from_entries,
    "add/0": add_all, "flatten/0": flatten, "flatten/1": flatten, "min/0": lambda v: _least(_array(v, "iterated over"), v), "max/0": lambda v: _most(_array(v, "iterated over"), v), "sort/0": sort,
    "unique/0": lambda v: [g[0] for g in _groups(_array(v, "sorted"), v)], "reverse/0": reverse, "transpose/0": transpose, "bsearch/1": bsearch, "contains/1": contains,
    "indices/1": indices, "index/1": lambda v, x: (indices(v, x) or [None])[0], "rindex/1": lambda v, x: (indices(v, x) or [None])[-1],
    "tostring/0": tostring, "tonumber/0": tonumber, "toboolean/0": toboolean, "tojson/0": dumps, "fromjson/0": lambda v: loads(_str(v, "only strings can be parsed")),
    "ascii_downcase/0": _ascii(True), "ascii_upcase/0": _ascii(False), "trim/0": _trim(True, True), "ltrim/0": _trim(True, False), "rtrim/0": _trim(False, True),
    "ltrimstr/1": ltrimstr, "rtrimstr/1": rtrimstr, "trimstr/1": lambda v, x: rtrimstr(ltrimstr(v, x), x), "startswith/1": startswith, "endswith/1": endswith, "join/1": join, "split/1": split,
    "explode/0": lambda v: list(map(ord, _str(v, "cannot be exploded"))), "implode/0": implode, "now/0": lambda v: time.time(), "gmtime/0": gmtime, "localtime/0": localtime, "mktime/0": mktime,
    "strptime/1": strptime, "strftime/1": strftime, "strflocaltime/1": lambda v, f: strftime(v, f, True), "abs/0": _abs, "infinite/0": lambda v: math.inf, "nan/0": lambda v: math.nan,
    "isinfinite/0": lambda v: math.isinf(_num(v)), "isfinite/0": lambda v: math.isfinite(_num(v)), "isnan/0": lambda v: math.isnan(_num(v)), "isnormal/0": lambda v: is_normal(_num(v)), "frexp/0": frexp, "modf/0": modf,
    "fma/3": lambda v, x, y, z: tidy(_num(x) * _num(y) + _num(z)),
    **{f"{k}/0": f for k, f in FORMATS.items()}, **{f"{k}/0": _real(f) for k, f in ONE.items()}, **{f"{k}/2": _real(f) for k, f in TWO.items()},
}

__all__ = ["BY", "FORMATS", "OPERATORS", "PLAIN", "REGEX", "order_key", "show"]
