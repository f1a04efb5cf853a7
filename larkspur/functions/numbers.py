"""Numbers: binary64, with the exact decimal of a literal kept until arithmetic."""

from __future__ import annotations

import math
from decimal import Decimal

LARGEST = 1.7976931348623157e308


class Literal(float):
    """A number as it was written, where binary64 can't show that."""

    __slots__ = ("text",)

    def __new__(cls, text: str):
        x = super().__new__(cls, text)
        x.text = text
        return x

    def __reduce__(self):
        return Literal, (self.text,)


def number(text: str):
    """int, float or Literal from a JSON number."""
    x = float(text)
    if text.lstrip("-").isdigit():
        return int(text) if text.lstrip("-").lstrip("0") or not text.startswith("-") else -0.0
    if math.isinf(x) or show(x) != text:
        return Literal(_canonical(text))
    return x


def _canonical(text: str) -> str:
    sign, digits, exp = Decimal(text).as_tuple()
    body = "".join(map(str, digits)).lstrip("0") or "0"
    if exp > 0 or -exp > len(body) + 5:
        point = len(body) - 1 + exp
        head = body[0] + ("." + body[1:] if len(body) > 1 else "")
        return ("-" if sign else "") + (f"{head}E{point:+d}" if abs(point) > 17 else str(Decimal(text).quantize(Decimal(1))) if exp > 0 else f"{head}E{point:+d}")
    if exp < 0:
        body = body.rjust(-exp + 1, "0")
        body = body[:exp] + "." + body[exp:]
    return ("-" if sign and body.strip("0.") else "-" if sign else "") + body


def show(x) -> str:
    """JSON text of a number; NaN is null, infinities the largest number."""
    if isinstance(x, Literal):
        return show(float(x)) if math.isinf(x) else x.text
    if isinstance(x, int):
        return str(x)
    if math.isnan(x):
        return "null"
    if math.isinf(x):
        x = math.copysign(LARGEST, x)
    sign, digits, exp = Decimal(repr(x)).as_tuple()
    body = "".join(map(str, digits)).rstrip("0")
    if not body:
        return "-0" if sign else "0"
    point = len(digits) + exp
    minus = "-" if sign else ""
    if point <= -5 or point > 17:
        head = body[0] + ("." + body[1:] if len(body) > 1 else "")
        e = point - 1
        return f"{minus}{head}e{'-' if e < 0 else '+'}{abs(e):02d}"
    if point <= 0:
        return f"{minus}0.{'0' * -point}{body}"
    if len(body) <= point:
        return minus + body + "0" * (point - len(body))
    return f"{minus}{body[:point]}.{body[point:]}"

