"""The DataFrame compiler: queries over typed tables become plans of built-in Spark operators.

The input is either a stream (each row is one value) or, slurped, one array of all rows. A query is a chain of
stages; each turns one relation into another: filters, projections, explodes, groups, sorts, joins,
aggregates. Inside a stage, expressions become Columns. What has no such form raises ``Unsupported``, and
``larkspur.query`` then runs the kernel in Arrow batches instead.

Arithmetic is binary64, as the language has it. Null is less than anything, and adding null changes nothing.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.plans.syntax import parse


class Unsupported(Exception):
    """The query, or this part of it, has no column form."""


@dataclass(frozen=True)
class Val:
    """An expression: a Column with its type, or an object of named ones."""

    col: Column | None = None
    type: T.DataType | None = None
    fields: dict | None = None

    def column(self) -> Column:
        if self.fields is not None:
            return F.struct(*[v.column().alias(k) for k, v in self.fields.items()])
        return self.col

    @property
    def kind(self) -> str:
        if self.fields is not None:
            return "object"
        t = self.type
        if isinstance(t, T.NumericType):
            return "number"
        if isinstance(t, T.StringType):
            return "string"
        if isinstance(t, T.BooleanType):
            return "boolean"
        if isinstance(t, T.ArrayType):
            return "array"
        if isinstance(t, T.StructType):
            return "object"
        if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            return "time"
        return "json" if isinstance(t, T.VariantType) else "null"


DOUBLE, STRING, BOOL, LONG = T.DoubleType(), T.StringType(), T.BooleanType(), T.LongType()


def number(v: Val) -> Column:
    if v.kind != "number":
        raise Unsupported(f"a number is needed, not {v.kind}")
    return v.col.cast("double")


def required(c: Column, what: str) -> Column:
    """The column; a null among it is an error, as it is in the language."""
    return F.when(c.isNull(), F.raise_error(F.lit(f"null (null) {what}"))).otherwise(c)


def strict(v: Val) -> Column:
    return required(number(v), "number required")


def truth(v: Val) -> Column:
    if v.kind == "boolean":
        return F.coalesce(v.col, F.lit(False))
    return v.column().isNotNull() if v.fields is None else F.lit(True)


def text(v: Val) -> Column:
    """What tostring gives."""
    if v.kind == "string":
        return v.col
    if v.kind == "boolean":
        return F.coalesce(v.col.cast("string"), F.lit("null"))
    if v.kind == "number":
        if isinstance(v.type, (T.DoubleType, T.FloatType)):
            whole = (v.col == F.floor(v.col)) & (F.abs(v.col) < 1e17)
            return F.coalesce(F.when(whole, v.col.cast("long").cast("string")).otherwise(_shown(v.col.cast("double"))), F.lit("null"))
        return F.coalesce(v.col.cast("string"), F.lit("null"))
    if v.kind == "null":
        return F.lit("null")
    raise Unsupported(f"text of {v.kind}")


def _shown(c: Column) -> Column:
    """A number that isn't whole and small, as the kernel prints it: plain from 1e-5 to 1e17, else d.ddde-NN."""
    s = c.cast("string")
    sign, digits = F.when(c < 0, "-").otherwise(""), F.regexp_replace(F.substring_index(s, "E", 1), r"^-|\.0$|\.", "")
    n = F.substring_index(s, "E", -1).try_cast("int")
    head = F.when(F.length(digits) > 1, F.concat(F.left(digits, F.lit(1)), F.lit("."), F.substr(digits, F.lit(2)))).otherwise(digits)
    far = F.concat(sign, head, F.when(n < 0, "e-").otherwise("e+"), F.format_string("%02d", F.abs(n)))
    small = F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), -n - 1), digits)
    large = F.concat(sign, F.left(digits, n + 1), F.lit("."), F.substr(digits, n + 2))
    most = F.concat(sign, F.lit("1.7976931348623157e+308"))
    return (
        F.when(F.isnan(c), "null").when(F.abs(c) == float("inf"), most).when(~F.contains(s, F.lit("E")), s).when((n < -5) | (n > 16), far).when(n < 0, small).otherwise(large)
    )


# ---------------------------------------------------------------- relations


@dataclass(frozen=True)
class Key:
    """A column to sort by, null first when ascending."""

    col: Column
    down: bool = False

    def column(self) -> Column:
        return self.col.desc_nulls_last() if self.down else self.col.asc_nulls_first()


def _sort(keys) -> list[Column]:
    return [k.column() for k in keys]


@dataclass(frozen=True)
class Rel:
    df: DataFrame
    row: Val
    slurped: bool
    order: tuple = ()
    keys: tuple = ()  # of a grouped relation: (Val, ...)
    grouped: bool = False
    env: dict = field(default_factory=dict)

    def values(self) -> DataFrame:
        fields = self.row.fields if self.row.fields is not None else {"value": self.row}
        # values of no one type are given out as JSON texts
        out = self.df.select(*[(F.to_json(v.column()) if v.kind == "json" else v.column()).alias(k) for k, v in fields.items()], *[k.col.alias(f"__o{i}") for i, k in enumerate(self.order)])
        return out.orderBy(*_sort([Key(F.col(f"__o{i}"), k.down) for i, k in enumerate(self.order)])).drop(*[f"__o{i}" for i in range(len(self.order))]) if self.order else out


def of(df: DataFrame) -> Val:
    return Val(fields={f.name: Val(F.col(f"`{f.name}`"), f.dataType) for f in df.schema})


def rebase(rel: Rel, row: Val, **change) -> Rel:
    """The relation with its row (and order) computed into columns."""
    fields = row.fields if row.fields is not None else {"value": row}
    names = [f"{k}" for k in fields]
    df = rel.df.select(*[fields[k].column().alias(k) for k in names], *[k.col.alias(f"__o{i}") for i, k in enumerate(rel.order)])
    new = {n: Val(F.col(f"`{n}`"), df.schema[n].dataType, None) for n in names}
    order = tuple(Key(F.col(f"__o{i}"), k.down) for i, k in enumerate(rel.order))
    return replace(rel, df=df, row=Val(fields=new) if row.fields is not None else new["value"], order=order, **change)


def numbered(rel: Rel) -> Rel:
    """With an order: that of the input where no sort has given one."""
    if rel.order:
        return rel
    df = rel.df.withColumn("__in", F.monotonically_increasing_id())
    return replace(rel, df=df, order=(Key(F.col("__in")),))


def sort_columns(v: Val) -> list[Column]:
    if v.fields is not None:
        return [c for k in sorted(v.fields) for c in sort_columns(v.fields[k])]
    return [v.col]


# ---------------------------------------------------------------- expressions


def _string_arg(e) -> str:
    if e[0] == "lit" and isinstance(e[1], str):
        return e[1]
    if e[0] == "str" and e[1] is None and len(e[2]) == 1:
        return e[2][0]
    raise Unsupported("a constant string is needed")


def literal(v) -> Val:
    if v is None:
        return Val(F.lit(None), T.NullType())
    if isinstance(v, bool):
        return Val(F.lit(v), BOOL)
    if isinstance(v, int) and abs(v) < 2**53:
        return Val(F.lit(v).cast("long"), LONG)
    if isinstance(v, (int, float)):
        return Val(F.lit(float(v)), DOUBLE)
    if isinstance(v, str):
        return Val(F.lit(v), STRING)
    raise Unsupported("constant containers")


def lookup(v: Val, name: str) -> Val:
    if v.fields is not None:
        return v.fields.get(name, literal(None))
    if isinstance(v.type, T.StructType):
        if name in v.type.names:
            return Val(v.col.getField(name), v.type[name].dataType)
        return literal(None)
    if isinstance(v.type, T.NullType):
        return v
    if v.kind == "json" and "'" not in name:
        shape = F.schema_of_variant(v.col)
        found = F.try_variant_get(v.col, f"$['{name}']", "variant")
        return Val(F.when(shape.startswith("OBJECT") | shape.isNull() | (shape == "VOID"), found).otherwise(F.raise_error(F.lit(f'Cannot index with "{name}"'))), v.type)
    raise Unsupported(f"field of {v.kind}")


def compare(op: str, a: Val, b: Val) -> Val:
    if a.kind == "null" or b.kind == "null":
        x, y = a.column().isNull() if a.fields is None else F.lit(False), b.column().isNull() if b.fields is None else F.lit(False)
        both, first = x & y, x & ~y
        second = y & ~x
        return Val({"==": both, "!=": ~both, "<": first, "<=": first | both, ">": second, ">=": second | both}[op], BOOL)
    if a.kind != b.kind:
        raise Unsupported("comparison of different kinds")
    x, y = a.column(), b.column()
    if op in ("==", "!="):
        same = x.eqNullSafe(y)
        return Val(same if op == "==" else ~same, BOOL)
    if op in (">", ">="):
        return compare({">": "<", ">=": "<="}[op], b, a)
    # null comes first; a filter is better off with the bare comparison, which is null where either is
    less = x < y if op == "<" else x <= y
    return Val(F.coalesce(less, (x.isNull() & (y.isNotNull() if op == "<" else F.lit(True)))), BOOL)


def predicate(e, v: Val, env) -> Column:
    """A condition for a filter: comparisons with constants stay bare, so that they reach the scan."""
    if e[0] == "and" and e[1] == "and":
        return predicate(e[2], v, env) & predicate(e[3], v, env)
    if e[0] == "or" and e[1] == "or":
        return predicate(e[2], v, env) | predicate(e[3], v, env)
    if e[0] == "bin" and e[1] in ("==", ">", ">="):
        a, b = expr(e[2], v, env), expr(e[3], v, env)
        if e[3][0] in ("lit", "str") and a.kind == b.kind and a.kind != "null":
            return {"==": a.col == b.col, ">": a.col > b.col, ">=": a.col >= b.col}[e[1]]
    return truth(expr(e, v, env))


def arithmetic(op: str, a: Val, b: Val) -> Val:
    if op == "+":
        if a.kind == "null":
            return b
        if b.kind == "null":
            return a
        if a.kind == b.kind == "number":
            x, y = number(a), number(b)
            return Val(F.coalesce(x + y, x, y), DOUBLE)
        if a.kind == b.kind == "string":
            return Val(F.coalesce(F.concat(a.col, b.col), a.col, b.col), STRING)
        if a.kind == b.kind == "array":
            return Val(F.coalesce(F.concat(a.col, b.col), a.col, b.col), a.type)
        if a.fields is not None and b.fields is not None:
            return Val(fields={**a.fields, **b.fields})
    elif op == "-" and a.kind == b.kind == "array":
        return Val(F.filter(a.col, lambda x: ~F.array_contains(b.col, x)), a.type)
    elif op == "/" and a.kind == b.kind == "string":
        return Val(_split(a.col, b.col), T.ArrayType(STRING))
    elif a.kind == b.kind == "number":
        x, y = strict(a), strict(b)
        if op == "%":
            return Val((x.cast("long") % y.cast("long")).cast("double"), DOUBLE)
        return Val({"-": x - y, "*": x * y, "/": x / y}[op], DOUBLE)
    raise Unsupported(f"{a.kind} {op} {b.kind}")


def _split(s: Column, sep: Column) -> Column:
    quoted = F.concat(F.lit("\\Q"), sep, F.lit("\\E"))
    letters = F.filter(F.split(s, F.lit("")), lambda c: c != "")
    return F.when(s == "", F.array().cast("array<string>")).when(sep == "", letters).otherwise(F.split(s, quoted, -1))


def _members(v: Val) -> list[Val]:
    if v.fields is not None:
        return list(v.fields.values())
    raise Unsupported("members of that")


def _collapse(e, v, env) -> Val:
    """[a, b, c]"""
    items: list = []

    def walk(x):
        if x[0] == "comma":
            walk(x[1])
            walk(x[2])
        else:
            items.append(x)

    walk(e)
    vals = [expr(x, v, env) for x in items]
    kinds = {x.kind for x in vals} - {"null"}
    if len(kinds) > 1:
        raise Unsupported("arrays of several kinds")
    cols = [number(x) if x.kind == "number" else x.column() for x in vals]
    t = DOUBLE if kinds == {"number"} else next((x.type for x in vals if x.kind != "null" and x.type is not None), None)
    if t is None:
        raise Unsupported("arrays of objects")
    return Val(F.array(*cols), T.ArrayType(t))


def _one(f, out):
    return lambda v: Val(f(v), out(v) if callable(out) else out)


def _seconds(v: Val) -> Column:
    if v.kind == "time":
        return F.unix_micros(v.col.cast("timestamp")) / 1e6
    return number(v)


_FORMAT = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%Z": "'UTC'", "%F": "yyyy-MM-dd", "%T": "HH:mm:ss", "%j": "DDD", "%y": "yy", "%b": "MMM", "%B": "MMMM", "%a": "EEE", "%A": "EEEE", "%p": "a", "%I": "hh", "%e": "d"}


def _java_format(fmt: str) -> str:
    out, i = "", 0
    while i < len(fmt):
        two = fmt[i : i + 2]
        if two in _FORMAT:
            out, i = out + _FORMAT[two], i + 2
        elif fmt[i] == "%":
            raise Unsupported(f"date format {two}")
        else:
            out, i = out + ("'" + fmt[i] + "'" if fmt[i].isalpha() else "''" if fmt[i] == "'" else fmt[i]), i + 1
    return out


def _length(v: Val) -> Val:
    if v.kind == "string":
        return Val(F.coalesce(F.char_length(v.col), F.lit(0)).cast("long"), LONG)
    if v.kind == "number":
        return Val(F.coalesce(F.abs(v.col), F.lit(0)), v.type)
    if v.kind == "array":
        return Val(F.greatest(F.size(v.col), F.lit(0)).cast("long"), LONG)
    if v.kind == "object" and v.fields is not None:
        return literal(len(v.fields))
    if v.kind == "null":
        return literal(0)
    raise Unsupported(f"length of {v.kind}")


def _element(v: Val) -> T.DataType:
    if not isinstance(v.type, T.ArrayType):
        raise Unsupported("an array is needed")
    return v.type.elementType


_LOWER, _UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _strings(v: Val) -> Column:
    if v.kind != "string":
        raise Unsupported("a string is needed")
    return required(v.col, "string required")


def _array_add(v: Val) -> Val:
    t = _element(v)
    if isinstance(t, T.NumericType):
        return Val(F.when(F.size(v.col) > 0, F.aggregate(v.col, F.lit(0.0), lambda a, x: a + F.coalesce(x.cast("double"), F.lit(0.0)))), DOUBLE)
    if isinstance(t, T.StringType):
        return Val(F.when(F.size(v.col) > 0, F.array_join(v.col, "")), STRING)
    if isinstance(t, T.ArrayType):
        return Val(F.when(F.size(v.col) > 0, F.flatten(v.col)), t)
    raise Unsupported("add of that")


_MATH1 = {"floor": F.floor, "ceil": F.ceil, "sqrt": F.sqrt, "exp": F.exp, "log": F.ln, "log10": F.log10, "log2": F.log2, "sin": F.sin, "cos": F.cos, "tan": F.tan, "asin": F.asin, "acos": F.acos, "atan": F.atan, "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh, "cbrt": F.cbrt, "expm1": F.expm1, "log1p": F.log1p, "rint": F.rint, "nearbyint": F.rint, "fabs": F.abs, "exp2": lambda c: F.pow(F.lit(2.0), c), "exp10": lambda c: F.pow(F.lit(10.0), c), "round": lambda c: F.signum(c) * F.floor(F.abs(c) + 0.5), "trunc": lambda c: F.signum(c) * F.floor(F.abs(c)), "asinh": F.asinh, "acosh": F.acosh, "atanh": F.atanh}
_MATH2 = {"pow": F.pow, "atan2": F.atan2, "hypot": F.hypot, "fmin": F.least, "fmax": F.greatest, "fmod": lambda a, b: a % b, "ldexp": lambda a, b: a * F.pow(F.lit(2.0), b), "copysign": lambda a, b: F.abs(a) * F.when(b < 0, -1.0).otherwise(1.0), "fdim": lambda a, b: F.greatest(a - b, F.lit(0.0))}

ONE = {
    "length": _length,
    "not": lambda v: Val(~truth(v), BOOL),
    "tostring": lambda v: Val(text(v), STRING),
    "tonumber": lambda v: v if v.kind == "number" else Val(_strings(v).cast("double"), DOUBLE),
    "toboolean": lambda v: v if v.kind == "boolean" else Val(_strings(v).cast("boolean"), BOOL),
    "type": lambda v: Val(F.when(v.column().isNull(), "null").otherwise("string" if v.kind == "time" else v.kind) if v.fields is None else F.lit("object"), STRING),
    "utf8bytelength": lambda v: Val(F.octet_length(_strings(v)).cast("long"), LONG),
    "ascii_downcase": lambda v: Val(F.translate(_strings(v), _UPPER, _LOWER), STRING),
    "ascii_upcase": lambda v: Val(F.translate(_strings(v), _LOWER, _UPPER), STRING),
    "explode": lambda v: Val(F.transform(F.split(_strings(v), ""), lambda c: F.ascii(c).cast("long")), T.ArrayType(LONG)),
    "trim": lambda v: Val(F.btrim(_strings(v), F.lit(" \t\n\r\f\x0b")), STRING),
    "ltrim": lambda v: Val(F.regexp_replace(_strings(v), r"^[ \t\n\r\f\x0B]+", ""), STRING),
    "rtrim": lambda v: Val(F.regexp_replace(_strings(v), r"[ \t\n\r\f\x0B]+$", ""), STRING),
    "reverse": lambda v: Val(F.reverse(v.col), v.type),
    "sort": lambda v: Val(F.sort_array(v.col), v.type) if _element(v) else v,
    "unique": lambda v: Val(F.sort_array(F.array_distinct(v.col)), v.type) if _element(v) else v,
    "min": lambda v: Val(F.when(~F.exists(v.col, lambda x: x.isNull()), F.array_min(v.col)), _element(v)),
    "max": lambda v: Val(F.array_max(v.col), _element(v)),
    "first": lambda v: Val(F.get(v.col, F.lit(0)), _element(v)),
    "last": lambda v: Val(F.try_element_at(v.col, F.lit(-1)), _element(v)),
    "add": _array_add,
    "flatten": lambda v: Val(F.flatten(v.col), _element(v)) if isinstance(_element(v), T.ArrayType) else v,
    "abs": lambda v: Val(F.abs(v.col), v.type) if v.kind == "number" else literal(None),
    "todate": lambda v: Val(F.date_format(F.timestamp_seconds(F.floor(_seconds(v))), "yyyy-MM-dd'T'HH:mm:ss'Z'"), STRING),
    "fromdate": lambda v: Val(F.unix_timestamp(F.to_timestamp(_strings(v), "yyyy-MM-dd'T'HH:mm:ss'Z'")), LONG),
    "fromjson": lambda v: Val(F.parse_json(_strings(v)), T.VariantType()),
    "tojson": lambda v: Val(F.to_json(v.column()), STRING) if v.kind in ("object", "array") else Val(text(v) if v.kind != "string" else F.to_json(F.array(v.col)).substr(F.lit(2), F.length(F.to_json(F.array(v.col))) - 2), STRING),
    "keys": lambda v: Val(F.array(*map(F.lit, sorted(v.fields))), T.ArrayType(STRING)) if v.fields is not None else Val(F.sequence(F.lit(0), F.size(v.col) - 1), T.ArrayType(T.IntegerType())),
    "@text": lambda v: Val(text(v), STRING),
    "@base64": lambda v: Val(F.regexp_replace(F.base64(text(v).cast("binary")), "[\r\n]", ""), STRING),
    "@base64d": lambda v: Val(F.unbase64(_strings(v)).cast("string"), STRING),
    "@html": lambda v: Val(_escaped(text(v)), STRING),
    "values": None,
    "isnan": lambda v: Val(F.isnan(number(v)), BOOL),
    "nan": lambda v: Val(F.lit(float("nan")), DOUBLE),
    "infinite": lambda v: Val(F.lit(float("inf")), DOUBLE),
    "isinfinite": lambda v: Val(F.abs(number(v)) == float("inf"), BOOL),
    "gamma": None,
    **{k: (lambda f: lambda v: Val(f(strict(v)).cast("double"), DOUBLE))(f) for k, f in _MATH1.items()},
}
ONE = {k: f for k, f in ONE.items() if f}
ONE |= {"todateiso8601": ONE["todate"], "fromdateiso8601": ONE["fromdate"]}


def _escaped(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("'", "&#39;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def java_regex(p: str, flags: str = "") -> str:
    """A pattern that means the same in Java, or Unsupported."""
    if set(flags) - set("gisx"):
        raise Unsupported("regex flags")
    for bad in ("(?<", "(?P", "\\p", "\\h", "\\H", "\\K", "\\G", "[[:", "&&", "(?>"):
        if bad in p:
            raise Unsupported(f"regex with {bad}")
    on = "m" + ("i" if "i" in flags else "") + ("s" if "s" in flags else "") + ("x" if "x" in flags else "") + "u"
    return f"(?{on}){p}"


def _call(name, args, v: Val, env) -> Val:
    n = len(args)
    if n == 0:
        if name in ONE:
            return ONE[name](v)
        if name == "now":
            return Val(F.unix_micros(F.current_timestamp()) / 1e6, DOUBLE)
    if n == 1:
        a = args[0]
        if name in ("startswith", "endswith"):
            x = expr(a, v, env)
            return Val(F.startswith(_strings(v), _strings(x)) if name == "startswith" else F.endswith(_strings(v), _strings(x)), BOOL)
        if name in ("ltrimstr", "rtrimstr"):
            s, x = v.col, expr(a, v, env).col
            if v.kind != "string":
                raise Unsupported("what isn't a string stays as it is")
            keep = F.length(s) - F.length(x)
            return Val(F.when(F.startswith(s, x), F.right(s, keep)).otherwise(s) if name == "ltrimstr" else F.when(F.endswith(s, x), F.left(s, keep)).otherwise(s), STRING)
        if name == "split":
            return Val(_split(_strings(v), _strings(expr(a, v, env))), T.ArrayType(STRING))
        if name == "join":
            t = _element(v)
            items = v.col if isinstance(t, T.StringType) else F.transform(v.col, lambda x: text(Val(x, t)))
            return Val(F.array_join(items, _string_arg(a), ""), STRING)
        if name == "test":
            return Val(F.regexp_like(_strings(v), F.lit(java_regex(_string_arg(a)))), BOOL)
        if name == "contains":
            x = expr(a, v, env)
            if v.kind == x.kind == "string":
                return Val(F.contains(v.col, x.col), BOOL)
        if name == "inside":
            x = expr(a, v, env)
            if v.kind == x.kind == "string":
                return Val(F.contains(x.col, v.col), BOOL)
        if name == "has":
            if v.fields is not None:
                return literal(_string_arg(a) in v.fields)
            if v.kind == "array":
                i = number(expr(a, v, env))
                return Val((i >= 0) & (i < F.size(v.col)), BOOL)
        if name in ("index", "rindex", "indices"):
            x = expr(a, v, env)
            if v.kind == x.kind == "string" and name == "index":
                return Val(F.when(F.contains(v.col, x.col), (F.instr(v.col, _string_arg(a)) - 1).cast("long")), LONG)
            if v.kind == "array" and name == "indices":
                hit = F.transform(v.col, lambda y, i: F.when(y.eqNullSafe(x.col), i.cast("long")))
                return Val(F.filter(hit, lambda i: i.isNotNull()), T.ArrayType(LONG))
        if name == "map" and v.kind == "array":
            t = _element(v)
            body = expr(a, Val(F.lit(None).cast(t), t), env) if a[0] != "call" or a[1] != "select" else None
            if body is None:
                return Val(F.filter(v.col, lambda x: truth(expr(a[2][0], Val(x, t), env))), v.type)
            return Val(F.transform(v.col, lambda x: expr(a, Val(x, t), env).column()), T.ArrayType(body.type if body.type is not None else T.StructType([])))
        if name in ("any", "all") and v.kind == "array":
            t = _element(v)
            return Val((F.exists if name == "any" else F.forall)(v.col, lambda x: truth(expr(a, Val(x, t), env))), BOOL)
        if name == "strftime":
            return Val(F.date_format(F.timestamp_seconds(F.floor(_seconds(v))), _java_format(_string_arg(a))), STRING)
        if name == "strptime":
            raise Unsupported("broken-down time")
        if name == "IN":
            items = []
            _flat(a, items)
            vals = [expr(x, v, env) for x in items]
            out = F.lit(False)
            for x in vals:
                out = out | compare("==", v, x).col
            return Val(out, BOOL)
        if name == "limit":
            raise Unsupported("limit inside a row")
    if n == 2:
        if name in _MATH2:
            return Val(_MATH2[name](strict(expr(args[0], v, env)), strict(expr(args[1], v, env))).cast("double"), DOUBLE)
        if name == "test":
            return Val(F.regexp_like(_strings(v), F.lit(java_regex(_string_arg(args[0]), _string_arg(args[1])))), BOOL)
        if name in ("gsub", "sub"):
            p, to = java_regex(_string_arg(args[0])), _string_arg(args[1]).replace("\\", "\\\\").replace("$", "\\$")
            if name == "gsub":
                return Val(F.regexp_replace(_strings(v), p, to), STRING)
            raise Unsupported("sub of the first match")
    raise Unsupported(f"{name}/{n}")


def _flat(e, out):
    if e[0] == "comma":
        _flat(e[1], out)
        _flat(e[2], out)
    else:
        out.append(e)


def expr(e, v: Val, env: dict) -> Val:
    """The one result of an expression for each row."""
    op = e[0]
    if op == "id":
        return v
    if op == "lit":
        return literal(e[1])
    if op == "index":
        joined = env.get("__joined", {}).get(repr(e))
        if joined is not None:
            return joined
        base = expr(e[1], v, env)
        if e[2][0] in ("str", "lit") and isinstance(e[2][1] if e[2][0] == "lit" else e[2][2][0], str):
            return lookup(base, _string_arg(e[2]))
        if base.kind == "array":
            i = expr(e[2], v, env)
            k = F.floor(number(i)).cast("int")
            return Val(F.get(base.col, F.when(k < 0, k + F.size(base.col)).otherwise(k)), _element(base))
        raise Unsupported("index")
    if op == "slice":
        base = expr(e[1], v, env)
        size = F.length(base.col) if base.kind == "string" else F.size(base.col) if base.kind == "array" else None
        if size is None:
            raise Unsupported("slice of that")

        def at(x, default, up):
            if x is None:
                return default
            k = (F.ceil if up else F.floor)(number(expr(x, v, env))).cast("int")
            k = F.when(k < 0, k + size).otherwise(k)
            return F.least(F.greatest(k, F.lit(0)), size)

        lo, hi = at(e[2], F.lit(0), False), at(e[3], size, True)
        n = F.greatest(hi - lo, F.lit(0))
        return Val(F.substring(base.col, lo + 1, n) if base.kind == "string" else F.slice(base.col, lo + 1, n), base.type)
    if op == "pipe":
        return expr(e[2], expr(e[1], v, env), env)
    if op == "bin":
        a, b = expr(e[2], v, env), expr(e[3], v, env)
        return compare(e[1], a, b) if e[1] in ("==", "!=", "<", "<=", ">", ">=") else arithmetic(e[1], a, b)
    if op in ("and", "or"):
        a, b = truth(expr(e[2], v, env)), truth(expr(e[3], v, env))
        return Val(a & b if op == "and" else a | b, BOOL)
    if op == "alt":
        a, b = expr(e[2], v, env), expr(e[3], v, env)
        if a.kind == "null":
            return b
        a, b = _alike(a, b)
        return Val(F.when(truth(a), a.column()).otherwise(b.column()), a.type)
    if op == "if":
        c, (a, b) = truth(expr(e[1], v, env)), _alike(expr(e[2], v, env), expr(e[3], v, env))
        return Val(F.when(c, a.column()).otherwise(b.column()), a.type if a.kind != "null" else b.type)
    if op == "neg":
        return Val(-strict(expr(e[1], v, env)), DOUBLE)
    if op == "str":
        if e[1] not in (None, "@text"):
            raise Unsupported("formatted strings")
        parts = [F.lit(p) if isinstance(p, str) else text(expr(p, v, env)) for p in e[2] if p != ""]
        return Val(F.concat(*[F.coalesce(p, F.lit("null")) for p in parts]) if parts else F.lit(""), STRING)
    if op == "object":
        return Val(fields={_string_arg(k): expr(x, v, env) for k, x in e[1]})
    if op == "array":
        if e[1] is None:
            raise Unsupported("empty array")
        if e[1][0] == "call" and e[1][1] == "scan" and len(e[1][2]) == 1 and "(" not in _string_arg(e[1][2][0]):
            return Val(F.regexp_extract_all(_strings(v), F.lit(java_regex(_string_arg(e[1][2][0]))), F.lit(0)), T.ArrayType(STRING))
        return _collapse(e[1], v, env)
    if op == "var":
        if "$" + e[1] in env and isinstance(env["$" + e[1]], Val):
            return env["$" + e[1]]
        raise Unsupported(f"${e[1]}")
    if op == "as" and len(e[2]) == 1 and e[2][0][0] == "pvar":
        return expr(e[3], v, {**env, "$" + e[2][0][1]: expr(e[1], v, env)})
    if op == "call":
        f = env.get(f"{e[1]}/{len(e[2])}")
        if f is not None:
            params, body = f
            if params:
                raise Unsupported("filters with parameters")
            return expr(body, v, env)
        return _call(e[1], e[2], v, env)
    if op == "def":
        return expr(e[4], v, {**env, f"{e[1]}/{len(e[2])}": (e[2], e[3])})
    if op == "try" and e[2] is None and _never_fails(e[1]):
        return expr(e[1], v, env)
    raise Unsupported(op)


def _never_fails(e) -> bool:
    """Members of typed rows: what isn't there is null. Of all else ? has errors to suppress, which a plan can't."""
    return e[0] in ("id", "lit") or e[0] == "index" and e[2][0] in ("lit", "str") and _never_fails(e[1])


def _alike(a: Val, b: Val) -> tuple[Val, Val]:
    if a.kind == b.kind == "number":
        return Val(number(a), DOUBLE), Val(number(b), DOUBLE)
    if a.kind == "null" or b.kind == "null" or a.kind == b.kind:
        return a, b
    raise Unsupported("branches of different kinds")


# ---------------------------------------------------------------- aggregates


def aggregate(e, rel: Rel, key_of=None) -> tuple[Column, T.DataType] | None:
    """An aggregate over the array that a relation (or a group of it) is."""
    v, env = rel.row, rel.env
    op = e[0]
    if op == "lit":
        x = literal(e[1])
        return x.col, x.type
    if op == "call" and not e[2]:
        if e[1] == "length":
            return F.count(F.lit(1)), LONG
        if e[1] in ("add", "min", "max", "any", "all"):
            return _reduced(e[1], v, None)
    if op == "pipe":
        first, rest = e[1], e[2]
        if rest[0] == "pipe":  # keep to (source | reducer), then plain expressions after it
            return aggregate(("pipe", ("pipe", first, rest[1]), rest[2]), rel, key_of)
        if rest[0] == "call" and not rest[2] and rest[1] in ("length", "add", "min", "max", "any", "all", "unique"):
            src = _elements(first, rel)
            if src is not None:
                x, cond = src
                return _reduced(rest[1], x, cond)
            if first[0] == "pipe" and first[2] == ("call", "unique", []) and rest[1] == "length":
                x, cond = _elements(first[1], rel)
                null = x.column().isNull() if cond is None else x.column().isNull() & cond
                different = F.count_distinct(F.when(cond, x.column()) if cond is not None else x.column())
                return different + F.coalesce(F.max(F.when(null, 1)), F.lit(0)), LONG  # null is a value too
        inner = aggregate(first, rel, key_of)
        if inner is not None:
            out = expr(rest, Val(*inner), env)
            return out.column(), out.type
    if op == "call" and e[1] in ("min_by", "max_by") and len(e[2]) == 1:
        k = expr(e[2][0], v, env)
        f = F.min_by if e[1] == "min_by" else F.max_by
        return f(v.column(), F.struct(k.column(), *[o.col for o in rel.order])), None
    if op == "index" and e[1] == ("index", ("id",), ("lit", 0)):
        x = lookup(v, _string_arg(e[2]))
        return _first(x, rel), x.type
    if op == "bin":
        a, b = aggregate(e[2], rel, key_of), aggregate(e[3], rel, key_of)
        if a and b:
            out = expr(("bin", e[1], ("var", "__a"), ("var", "__b")), v, {**env, "$__a": Val(*a), "$__b": Val(*b)})
            return out.column(), out.type
    if op == "alt":
        a, b = aggregate(e[2], rel, key_of), aggregate(e[3], rel, key_of)
        if a and b:
            return F.coalesce(a[0], b[0]), a[1]
    if op == "reduce":
        return _fold(e, rel)
    return None


def _first(x: Val, rel: Rel) -> Column:
    """The value in the relation's first row."""
    down = {k.down for k in rel.order}
    if len(down) != 1:
        raise Unsupported("the first of rows in mixed order")
    return (F.max_by if True in down else F.min_by)(x.column(), F.struct(*[k.col for k in rel.order]))


def _takes_first(e) -> bool:
    """Whether the order of rows matters to an aggregate: .[0], min_by, max_by."""
    if isinstance(e, tuple) and e[:1] == ("index",) and e[1:] == (("id",), ("lit", 0)) or isinstance(e, tuple) and e[:1] == ("call",) and e[1] in ("min_by", "max_by"):
        return True
    return isinstance(e, (tuple, list)) and any(map(_takes_first, e))


def _elements(e, rel: Rel):
    """(value, condition) of what map(f) or [.[] | f] takes of each row."""
    if e[0] == "call" and e[1] == "map":
        return _filtered(e[2][0], rel.row, rel.env)
    if e[0] == "array" and e[1] is not None:
        body = e[1]
        if body == ("iter", ("id",)):
            return rel.row, None
        if body[0] == "pipe" and body[1] == ("iter", ("id",)):
            return _filtered(body[2], rel.row, rel.env)
        path = _path_of_iter(body)
        if path is not None:
            v = rel.row
            for name in path:
                v = lookup(v, name)
            return v, None
    return None


def _path_of_iter(e):
    names = []
    while e[0] == "index" and e[2][0] in ("lit", "str"):
        names.append(_string_arg(e[2]))
        e = e[1]
    return names[::-1] if e == ("iter", ("id",)) and names else None


def _filtered(e, v: Val, env):
    if e[0] == "call" and e[1] == "select":
        return v, predicate(e[2][0], v, env)
    if e[0] == "pipe":
        x, cond = _filtered(e[1], v, env)
        y, more = _filtered(e[2], x, env)
        return y, more if cond is None else cond if more is None else cond & more
    return expr(e, v, env), None


def _reduced(name, v: Val, cond):
    c = v.column()
    kept = F.when(cond, c) if cond is not None else c
    if name == "length":
        return (F.count(F.when(cond, 1)) if cond is not None else F.count(F.lit(1))), LONG
    if name == "add" and v.kind == "number":
        return F.sum(kept.cast("double")), DOUBLE
    null = c.isNull() if cond is None else c.isNull() & cond
    if name in ("min", "max") and v.kind in ("number", "string", "boolean", "time"):
        # null is less than anything
        return (F.when(F.coalesce(F.bool_or(null), F.lit(False)), F.lit(None)).otherwise(F.min(kept)) if name == "min" else F.max(kept)), v.type
    if name in ("any", "all"):
        t = truth(v)
        return F.coalesce((F.bool_or if name == "any" else F.bool_and)(F.when(cond, t) if cond is not None else t), F.lit(name == "all")), BOOL
    if name == "unique":
        first = F.when(F.coalesce(F.bool_or(null), F.lit(False)), F.array(F.lit(None).cast(v.type))).otherwise(F.array().cast(T.ArrayType(v.type)))
        return F.concat(first, F.sort_array(F.collect_set(kept))), T.ArrayType(v.type)
    raise Unsupported(f"{name} of {v.kind}")


def _fold(e, rel: Rel):
    """reduce .[] as $x (init; . + f($x)), and the like with min and max."""
    _, src, pats, init, step = e
    if len(pats) != 1 or pats[0][0] != "pvar":
        raise Unsupported("reduce")
    if src == ("iter", ("id",)):
        v, cond = rel.row, None
    elif src[0] == "pipe" and src[1] == ("iter", ("id",)):
        v, cond = _filtered(src[2], rel.row, rel.env)
    elif (path := _path_of_iter(src)) is not None:
        v, cond = rel.row, None
        for name in path:
            v = lookup(v, name)
    else:
        raise Unsupported("reduce over that")
    if step[0] == "bin" and step[1] == "+" and step[2] == ("id",):
        x = expr(step[3], literal(None), {**rel.env, "$" + pats[0][1]: v})
        start = expr(init, literal(None), rel.env)
        total = F.sum(F.when(cond, number(x)) if cond is not None else number(x))
        return F.coalesce(total, F.lit(0.0)) + (number(start) if start.kind == "number" else F.lit(0.0)), DOUBLE
    raise Unsupported("reduce of that form")


def _running(e, rel: Rel) -> Rel:
    """foreach .[] as $x (init; . + f($x); extract): a running sum in the relation's order."""
    _, src, pats, init, step, extract = e
    if src[0] == "pipe":
        rel, src = stage(src[1], rel), src[2]
    if src != ("iter", ("id",)) or len(pats) != 1 or pats[0][0] != "pvar" or step[0] != "bin" or step[1] != "+" or step[2] != ("id",):
        raise Unsupported("foreach of that form")
    rel = numbered(rel)
    name = "$" + pats[0][1]
    x = number(expr(step[3], literal(None), {**rel.env, name: rel.row}))
    start = number(expr(init, literal(None), rel.env))
    df = _running_sum(rel.df.withColumn("__x", F.coalesce(x, F.lit(0.0))), rel.order, start)
    state = Val(F.col("__run"), DOUBLE)
    out = expr(extract, state, {**rel.env, name: rel.row}) if extract else state
    return rebase(replace(rel, df=df), out, slurped=False)


#: Rows from which a running sum is cut into ranges of the first key, and how many ranges.
RUNNING_ROWS, RANGES = 1_000_000, 256


def _running_sum(df: DataFrame, order, start: Column) -> DataFrame:
    """df with __run, the sum of __x up to each row in order.

    Beyond RUNNING_ROWS rows by ranges of the first key: sums of the ranges come first, then each range is summed by
    itself on top of what is ahead of it. Quantiles only say where to cut: any cut gives the same sums.
    """
    first = order[0]
    kind = df.select(first.col.alias("k")).schema["k"].dataType
    cuts: list = []
    if isinstance(kind, T.NumericType):
        steps = [(i + 1) / RANGES for i in range(RANGES - 1)]
        n, cuts = df.select(first.col.cast("double").alias("k")).agg(F.count(F.lit(1)), F.percentile_approx("k", steps, 10_000)).first()
        cuts = sorted(set(cuts or [])) if n > RUNNING_ROWS else []
    upto = lambda *by: W.partitionBy(*by).orderBy(*_sort(order)).rowsBetween(W.unboundedPreceding, W.currentRow)
    if not cuts:
        return df.withColumn("__run", F.sum("__x").over(upto()) + start)
    k = first.col.cast("double")
    at = F.when(k.isNull(), -1).otherwise(F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < k)))
    df = df.withColumn("__range", -at if first.down else at)
    sums, ahead, total = dict(df.groupBy("__range").agg(F.sum("__x")).collect()), {}, 0.0
    for r in sorted(sums):
        ahead[r], total = total, total + sums[r]
    offset = F.element_at(F.create_map(*[F.lit(v) for r in sums for v in (r, ahead[r])]), F.col("__range"))
    return df.withColumn("__run", F.sum("__x").over(upto("__range")) + offset + start)


# ---------------------------------------------------------------- stages


def stage(e, rel: Rel) -> Rel:
    op = e[0]
    if op == "pipe":
        return stage(e[2], stage(e[1], rel))
    if op == "id":
        return rel
    if op == "def":
        return stage(e[4], replace(rel, env={**rel.env, f"{e[1]}/{len(e[2])}": (e[2], e[3])}))
    if op == "call" and f"{e[1]}/{len(e[2])}" in rel.env and not e[2]:
        return stage(rel.env[f"{e[1]}/0"][1], rel)
    if op == "as" and e[1][0] == "call" and e[1][1] == "INDEX" and e[2][0][0] == "pvar":
        return stage(e[3], replace(rel, env={**rel.env, "$" + e[2][0][1]: _index_table(e[1][2], rel)}))
    rel = _with_joins(e, rel)
    return _grouped(e, rel) if rel.grouped else _whole(e, rel) if rel.slurped else _each(e, rel)


def _index_table(args, rel: Rel):
    """INDEX($table[]; f): the last row of each key, by text."""
    if len(args) != 2:
        raise Unsupported("INDEX")
    src, key = args
    if src[0] != "iter" or src[1][0] != "var" or not isinstance(rel.env.get("$" + src[1][1]), DataFrame):
        raise Unsupported("INDEX of that")
    df = rel.env["$" + src[1][1]].withColumn("__in", F.monotonically_increasing_id())
    k = text(expr(key, of(df), rel.env))
    last = df.groupBy(k.alias("__key")).agg(F.max_by(F.struct(*[c for c in df.columns if c != "__in"]), F.col("__in")).alias("__hit"))
    return ("index", last)


def _with_joins(e, rel: Rel) -> Rel:
    """Join the index tables that the stage looks rows up in."""
    found: list = []

    def walk(x):
        if isinstance(x, tuple):
            if len(x) == 3 and x[0] == "index" and isinstance(x[1], tuple) and x[1][0] == "var" and isinstance(rel.env.get("$" + x[1][1]), tuple) and rel.env["$" + x[1][1]][0] == "index":
                found.append(x)
            for y in x:
                walk(y)
        elif isinstance(x, list):
            for y in x:
                walk(y)

    walk(e)
    joined = dict(rel.env.get("__joined", {}))
    for x in found:
        if repr(x) in joined or rel.slurped:
            continue
        last = rel.env["$" + x[1][1]][1]
        i = len(joined)
        last = last.withColumnsRenamed({"__key": f"__key{i}", "__hit": f"__hit{i}"})
        k = text(expr(x[2], rel.row, rel.env))
        df = rel.df.join(last, k == F.col(f"__key{i}"), "left")
        joined[repr(x)] = Val(F.col(f"__hit{i}"), last.schema[f"__hit{i}"].dataType)
        rel = replace(rel, df=df, env={**rel.env, "__joined": joined})
    return rel


def _semi(e, rel: Rel) -> Rel | None:
    """select(f | IN($table[] | g)) and its negation."""
    steps: list = []
    while e[0] == "pipe":
        steps.append(e[1])
        e = e[2]
    steps.append(e)
    negated = steps[-1] == ("call", "not", [])
    steps = steps[:-1] if negated else steps
    x = steps[-1]
    for step in reversed(steps[:-1]):
        x = ("pipe", step, x)
    if x[0] == "pipe" and x[2][0] == "call" and x[2][1] == "IN" and len(x[2][2]) == 1:
        probe, pool = x[1], x[2][2][0]
    elif x[0] == "call" and x[1] == "IN" and len(x[2]) == 2:
        probe, pool = x[2]
    else:
        return None
    chain = []
    while pool[0] == "pipe" or pool[0] == "index":
        chain.append(pool)
        pool = pool[1]
    if pool[0] != "iter" or pool[1][0] != "var" or not isinstance(rel.env.get("$" + pool[1][1]), DataFrame):
        return None
    t = Rel(rel.env["$" + pool[1][1]], of(rel.env["$" + pool[1][1]]), False, env=rel.env)
    for c in reversed(chain):
        t = stage(c[2], t) if c[0] == "pipe" else rebase(t, lookup(t.row, _string_arg(c[2])))
    other = t.df.select(t.row.column().alias("__in_pool"))
    k = expr(probe, rel.row, rel.env)
    return replace(rel, df=rel.df.join(other, k.column().eqNullSafe(F.col("__in_pool")), "left_anti" if negated else "left_semi"))


def _each(e, rel: Rel) -> Rel:
    """A stage applied to each value of a stream."""
    op = e[0]
    if op == "call" and e[1] == "select":
        out = _semi(e[2][0], rel)
        return out or replace(rel, df=rel.df.where(predicate(e[2][0], rel.row, rel.env)))
    if op == "call" and e[1] == "empty":
        return replace(rel, df=rel.df.limit(0))
    if op == "call" and e[1] == "values" and not e[2]:
        return replace(rel, df=rel.df.where(rel.row.column().isNotNull()))
    if op == "iter":
        inner = expr(e[1], rel.row, rel.env)
        rel = numbered(rel) if rel.order else rel
        if inner.fields is not None:
            raise Unsupported("members of an object")
        t = _element(inner)
        df = rel.df.select("*", F.posexplode(inner.col).alias("__pos", "__item"))
        return replace(rel, df=df, row=Val(F.col("__item"), t), order=(*rel.order, Key(F.col("__pos"))) if rel.order else ())
    if op == "comma":
        items: list = []
        _flat(e, items)
        try:
            vals = [expr(x, rel.row, rel.env) for x in items]
        except Unsupported:
            vals = []
        if vals:  # each branch has one result: all come from one scan, row by row
            vals = _same_shape(vals)
            df = rel.df.select("*", F.posexplode(F.array(*[x.column() for x in vals])).alias("__branch", "__out"))
            t = df.schema["__out"].dataType
            names = list(vals[0].fields or {})
            row = Val(fields={k: Val(F.col("__out").getField(k), t[k].dataType) for k in names}) if names else Val(F.col("__out"), t)
            return replace(rel, df=df, row=row, order=(*rel.order, Key(F.col("__branch"))) if rel.order else ())
        rel = numbered(rel)
        outs = [stage(x, rel) for x in items]
        rows = _same_shape([o.row for o in outs])
        outs = [rebase(replace(o, order=(*rel.order, Key(F.lit(i)), *o.order[len(rel.order) :])), r) for i, (o, r) in enumerate(zip(outs, rows, strict=True))]
        keys = len(rel.order) + 1
        df = None
        for o in outs:  # what orders the results of one branch further has no counterpart in another
            if len(o.order) > keys:
                raise Unsupported("branches in orders of their own")
            df = o.df if df is None else df.unionByName(o.df)
        return replace(outs[0], df=df, order=outs[0].order)
    if op == "as" and len(e[2]) == 1 and e[2][0][0] == "pvar":
        if e[1][0] == "iter":
            x = _each(e[1], rel)
            return stage(e[3], replace(x, row=rel.row, env={**rel.env, "$" + e[2][0][1]: x.row}))
        return stage(e[3], replace(rel, env={**rel.env, "$" + e[2][0][1]: expr(e[1], rel.row, rel.env)}))
    out = expr(e, rel.row, rel.env)
    return rebase(rel, out) if not rel.env.get("__joined") else replace(rebase(rel, out), env={k: x for k, x in rel.env.items() if k != "__joined"})


def _same_shape(vals: list[Val]) -> list[Val]:
    """Values of one type for one column, or Unsupported."""
    if all(v.fields is not None for v in vals):
        if len({tuple(v.fields) for v in vals}) > 1:
            raise Unsupported("branches of different members")
        columns = [_same_shape(list(c)) for c in zip(*[v.fields.values() for v in vals], strict=True)]
        return [Val(fields=dict(zip(v.fields, c, strict=True))) for v, c in zip(vals, zip(*columns, strict=True), strict=True)]
    kinds = {v.kind for v in vals} - {"null"}
    if len(kinds) > 1 or any(v.fields is not None for v in vals) or kinds & {"object", "time", "json"}:
        raise Unsupported("branches of different kinds")
    if kinds == {"number"} and len({v.type for v in vals}) > 1:
        return [Val(number(v) if v.kind == "number" else F.lit(None).cast("double"), DOUBLE) for v in vals]
    t = next((v.type for v in vals if v.kind != "null"), None)
    if t is None:
        raise Unsupported("branches of null")
    return [v if v.kind != "null" else Val(F.lit(None).cast(t), t) for v in vals]


def _whole(e, rel: Rel) -> Rel:
    """A stage applied to the array of all rows."""
    op = e[0]
    v, env = rel.row, rel.env
    if op == "iter" and e[1] == ("id",):
        return replace(rel, slurped=False)
    if op == "iter" and e[1][0] != "id":
        return stage(("iter", ("id",)), stage(e[1], rel))
    if op in ("index", "iter") and _path_of_iter(e) is not None:
        out = replace(rel, slurped=False)
        for name in _path_of_iter(e):
            out = rebase(out, lookup(out.row, name))
        return out
    if op == "array" and e[1] is not None:
        inner = stage(e[1], rel)
        return replace(inner, slurped=True)
    if op == "call":
        name, args = e[1], e[2]
        if name == "map":
            return replace(stage(args[0], replace(rel, slurped=False)), slurped=True)
        if name in ("sort_by", "sort"):
            items: list = []
            if args:
                _flat(args[0], items)
            keys = [expr(x, v, env) for x in items] if args else [v]
            cols = [c for k in keys for c in sort_columns(k)]
            rel = numbered(rel)
            return replace(rel, order=(*map(Key, cols), *rel.order))
        if name == "reverse":
            rel = numbered(rel)
            return replace(rel, order=tuple(Key(k.col, not k.down) for k in rel.order))
        if name == "group_by":
            items = []
            _flat(args[0], items)
            return replace(rel, keys=tuple(expr(x, v, env) for x in items), grouped=True)
        if name in ("unique_by", "unique"):
            keys = [expr(args[0], v, env)] if args else [v]
            if not args:
                out = rebase(replace(rel, order=()), v)
                cols = sort_columns(out.row)
                return replace(out, df=out.df.dropDuplicates(), order=tuple(map(Key, cols)))
            rel = numbered(rel)
            cols = [c for k in keys for c in sort_columns(k)]
            df = rel.df.withColumn("__first", F.row_number().over(W.partitionBy(*cols).orderBy(*_sort(rel.order)))).where("__first = 1")
            return replace(rel, df=df, order=tuple(map(Key, cols)))
        if name in ("first", "last") and not args:
            return _taken(rel, 1, name == "last")
        if name in ("limit", "first", "skip", "nth") and args:
            inner = stage(args[-1], rel)
            n = _count(args[0]) if len(args) == 2 else 1
            if name == "skip":
                inner = numbered(inner)
                return replace(inner, df=inner.df.orderBy(*_sort(inner.order)).offset(n))
            if name == "nth":
                inner = numbered(inner)
                return replace(inner, df=inner.df.orderBy(*_sort(inner.order)).offset(n).limit(1))
            return replace(_limited(inner, n), slurped=False)
    if op == "slice":
        base = stage(e[1], rel)
        lo, hi = (_count(x) if x else None for x in e[2:4])
        base = numbered(base)
        df = base.df.orderBy(*_sort(base.order))
        if lo:
            df = df.offset(lo)
        if hi is not None:
            df = df.limit(max(hi - (lo or 0), 0))
        return replace(base, df=df)
    if op == "foreach":
        return _running(e, rel)
    if op == "bin" and e[1] in ("+", "-"):
        a, b = _as_array(e[2], rel), _as_array(e[3], rel)
        if a is not None and b is not None:
            x, y = rebase(replace(a, order=()), a.row), rebase(replace(b, order=()), b.row)
            if e[1] == "+":
                return replace(x, df=x.df.unionByName(y.df), order=())
            other = y.df.withColumnsRenamed({c: f"__r_{c}" for c in y.df.columns})
            cond = [F.col(f"`{c}`").eqNullSafe(F.col(f"`__r_{c}`")) for c in x.df.columns]
            whole = cond[0]
            for c in cond[1:]:
                whole = whole & c
            return replace(x, df=x.df.join(other, whole, "left_anti"))
    rel = numbered(rel) if _takes_first(e) else rel
    v = rel.row
    if op == "object":
        aggs = {}
        for k, x in e[1]:
            got = aggregate(x, rel)
            if got is None:
                raise Unsupported("object over the whole input")
            aggs[_string_arg(k)] = got[0]
        df = rel.df.agg(*[c.alias(k) for k, c in aggs.items()])
        return Rel(df, of(df), False, env=env)
    got = aggregate(e, rel)
    if got is not None:
        df = rel.df.agg(got[0].alias("value"))
        row = Val(F.col("value"), df.schema["value"].dataType)
        return Rel(df, row, False, env=env)
    raise Unsupported(f"{op} over the whole input")


def _as_array(e, rel):
    """A table variable, or a stage of the input, as an array."""
    if e[0] == "var" and isinstance(rel.env.get("$" + e[1]), DataFrame):
        df = rel.env["$" + e[1]]
        return Rel(df, of(df), True, env=rel.env)
    if e[0] == "pipe" and (src := _as_array(e[1], rel)) is not None:
        return stage(e[2], src)
    out = stage(e, rel)
    return out if out.slurped else None


def _count(e) -> int:
    if e[0] == "lit" and isinstance(e[1], (int, float)) and e[1] >= 0:
        return int(e[1])
    raise Unsupported("counts that aren't constant")


def _limited(rel: Rel, n: int) -> Rel:
    rel = numbered(rel)
    return replace(rel, df=rel.df.orderBy(*_sort(rel.order)).limit(n))


def _taken(rel: Rel, n: int, last: bool) -> Rel:
    rel = numbered(rel)
    return replace(rel, df=rel.df.orderBy(*_sort([Key(k.col, k.down != last) for k in rel.order])).limit(n), slurped=False)


def _grouped(e, rel: Rel) -> Rel:
    """A stage applied to the array of groups: map(f), or length."""
    if e[0] == "call" and e[1] == "length":
        df = rel.df.select(*[k.column().alias(f"__k{i}") for i, k in enumerate(rel.keys)]).distinct().agg(F.count(F.lit(1)).alias("value"))
        return Rel(df, Val(F.col("value"), LONG), False, env=rel.env)
    streamed = e == ("iter", ("id",))
    if streamed:
        return replace(rel, slurped=False)
    body = e[2][0] if e[0] == "call" and e[1] == "map" else e if not rel.slurped else None
    if body is None:
        raise Unsupported("that of groups")
    rel = numbered(rel) if _takes_first(body) else rel
    names = [f"__k{i}" for i in range(len(rel.keys))]
    fields = None
    if body[0] == "object":
        fields = {_string_arg(k): x for k, x in body[1]}
    base = replace(rel, grouped=False, slurped=True)
    aggs, where = {}, None
    if body[0] == "call" and body[1] == "select" or body[0] == "pipe" and body[1][0] == "call" and body[1][1] == "select":
        where = (body if body[0] == "call" else body[1])[2][0]
        if body[0] == "call":
            raise Unsupported("groups as values")
        body = body[2]
        fields = {_string_arg(k): x for k, x in body[1]} if body[0] == "object" else None
    for k, x in (fields or {"value": body}).items():
        key = _key_index(x, rel)
        if key is not None:
            aggs[k] = F.first(rel.keys[key].column())
            continue
        got = aggregate(x, base)
        if got is None:
            raise Unsupported("group results of that form")
        aggs[k] = got[0]
    cols = [c.alias(k) for k, c in aggs.items()]
    if where is not None:
        got = aggregate(where, base)
        if got is None:
            raise Unsupported("group conditions of that form")
        cols.append(truth(Val(*got)).alias("__keep"))
    keyed = [c.alias(n) for n, k in zip(names, rel.keys, strict=True) for c in [k.column()]]
    df = rel.df.groupBy(*keyed).agg(*cols)
    if where is not None:
        df = df.where("__keep")
    row = Val(fields={k: Val(F.col(f"`{k}`"), df.schema[k].dataType) for k in aggs}) if fields else Val(F.col("value"), df.schema["value"].dataType)
    return Rel(df, row, rel.slurped or e[0] == "call" and e[1] == "map", order=tuple(Key(F.col(n)) for n in names), env=rel.env)


def _key_index(e, rel: Rel) -> int | None:
    """.[0].k where k is a key of the group."""
    if e[0] == "index" and e[1] == ("index", ("id",), ("lit", 0)):
        x = lookup(rel.row, _string_arg(e[2]))
        for i, k in enumerate(rel.keys):
            if k.col is not None and x.col is not None and str(k.col) == str(x.col):
                return i
    if e[0] == "pipe" and e[1] == ("index", ("id",), ("lit", 0)):
        try:
            x = expr(e[2], rel.row, rel.env)
        except Unsupported:
            return None
        for i, k in enumerate(rel.keys):
            if k.col is not None and x.col is not None and str(k.col) == str(x.col):
                return i
    return None


def plan(df: DataFrame, query: str, slurp: bool = False, tables: dict[str, DataFrame] | None = None, variables: dict | None = None) -> DataFrame:
    """The query's results as a DataFrame: an object's members as columns, other results in ``value``.

    slurp: the input is one array of all rows. tables: DataFrames that the query names as $name (arrays of
    objects). variables: constants, as $name. Raises Unsupported where there is no such plan.
    """
    env: dict = {f"${k}": t for k, t in (tables or {}).items()} | {f"${k}": literal(v) for k, v in (variables or {}).items()}
    out = stage(parse(query), Rel(df, of(df), slurp, env=env))
    if out.grouped:
        raise Unsupported("groups as values")
    return out.values()
