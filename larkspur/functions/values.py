"""JSON values: kinds, order, equality, text."""

from __future__ import annotations

import json
import math
from functools import cmp_to_key

from larkspur.functions.numbers import Literal, number, show

ORDER = {"null": 0, "boolean": 1, "number": 3, "string": 4, "array": 5, "object": 6}


class QueryError(Exception):
    """A catchable error; ``value`` is what ``catch`` sees."""

    def __init__(self, value):
        super().__init__(value if isinstance(value, str) else dumps(value))
        self.value = value


def kind(v) -> str:
    if v is None:
        return "null"
    if v is True or v is False:
        return "boolean"
    if isinstance(v, (int, float)):
        return "number"
    if isinstance(v, str):
        return "string"
    return "array" if isinstance(v, list) else "object"


def truthy(v) -> bool:
    return v is not None and v is not False


def _exact(x):
    from decimal import Decimal

    return Decimal(x.text) if isinstance(x, Literal) else x


def compare(a, b) -> int:
    """-1, 0 or 1 in the total order null < false < true < number < string < array < object."""
    ka, kb = kind(a), kind(b)
    if ka != kb:
        return -1 if ORDER[ka] < ORDER[kb] else 1
    if ka == "boolean":
        return int(a) - int(b)
    if ka == "number":
        if isinstance(a, (int, Literal)) and isinstance(b, (int, Literal)):
            a, b = _exact(a), _exact(b)
            return (a > b) - (a < b)
        a, b = float(a), float(b)
        if math.isnan(a):  # nan is less than any number, itself included
            return -1
        return 1 if math.isnan(b) else (a > b) - (a < b)
    if ka == "string":
        x, y = a.encode("utf-8", "surrogatepass"), b.encode("utf-8", "surrogatepass")
        return (x > y) - (x < y)
    if ka == "array":
        for x, y in zip(a, b):
            if c := compare(x, y):
                return c
        return (len(a) > len(b)) - (len(a) < len(b))
    if ka == "object":
        keys, others = sorted_keys(a), sorted_keys(b)
        if c := compare(keys, others):
            return c
        for k in keys:
            if c := compare(a[k], b[k]):
                return c
    return 0


def sorted_keys(o: dict) -> list[str]:
    return sorted(o, key=lambda k: k.encode("utf-8", "surrogatepass"))


def equal(a, b) -> bool:
    return compare(a, b) == 0


order_key = cmp_to_key(compare)


def copied(v):
    """A shallow copy of a container."""
    return list(v) if isinstance(v, list) else dict(v)


# ---------------------------------------------------------------- text


def loads(text: str):
    """A JSON value; numbers keep their decimals, NaN is allowed."""
    try:
        return json.loads(text, parse_float=number, parse_int=number, parse_constant=_constant, strict=False)
    except (ValueError, RecursionError) as e:
        raise QueryError(f"{e} (while parsing '{text[:200]}')") from None


def _constant(x: str):
    if x == "NaN":
        return math.nan
    return math.inf if x == "Infinity" else -math.inf


_QUOTED = json.encoder.encode_basestring
_ASCII = json.encoder.encode_basestring_ascii


def quoted(s: str, ascii: bool = False) -> str:
    return (_ASCII if ascii else _QUOTED)(s).replace("\x7f", "\\u007f")


def dumps(v, indent: int | str | None = None, sort_keys: bool = False, ascii: bool = False, level: int = 0) -> str:
    """JSON text, compact without ``indent`` (a number of blanks, or the string of one level)."""
    if v is None:
        return "null"
    if v is True:
        return "true"
    if v is False:
        return "false"
    if isinstance(v, str):
        return quoted(v, ascii)
    if isinstance(v, (int, float)):
        return show(v)
    unit = " " * indent if isinstance(indent, int) else indent
    if unit:
        new, old, colon, comma = "\n" + unit * (level + 1), "\n" + unit * level, ": ", ","
    else:
        new, old, colon, comma = "", "", ":", ","
    if isinstance(v, list):
        if not v:
            return "[]"
        return "[" + new + (comma + new).join(dumps(x, indent, sort_keys, ascii, level + 1) for x in v) + old + "]"
    if not v:
        return "{}"
    keys = sorted_keys(v) if sort_keys else list(v)
    return "{" + new + (comma + new).join(quoted(k, ascii) + colon + dumps(v[k], indent, sort_keys, ascii, level + 1) for k in keys) + old + "}"


def shown(v) -> str:
    """How an error message shows a value."""
    text = dumps(v)
    return f"{kind(v)} ({text if len(text.encode()) <= 30 else text[:24] + '...'})"
