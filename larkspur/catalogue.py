"""Registered queries of the built-in functions, a family a query, and of sources and sinks, each with SQL.

A family's results are one JSON array a row. Doubles are compared as whole numbers of millionths (or of what is said).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators import batches
from larkspur.registry import ORACLE, QUERIES, _table, kernel, planned
from larkspur.sources import read, write


def family(name: str, table: str, setup: tuple[str, str], pairs: dict[str, str], unit: int = 0) -> None:
    """pairs: an expression of the language and the SQL that says the same. setup: what binds variables in either.

    unit: results are floored multiples of 1 / unit; 0: results are JSON values, and the SQL gives their texts.
    """
    each = (lambda e: f"(({e}) * {unit} | floor)") if unit else (lambda e: f"({e})")
    sql = (lambda q: f"floor(({q}) * {unit})::BIGINT::VARCHAR") if unit else (lambda q: f"({q})::VARCHAR")
    query = f"{setup[0]} [{', '.join(map(each, pairs))}]"
    kernel(name, table, query, f"SELECT '[' || concat_ws(',', {', '.join(map(sql, pairs.values()))}) || ']' AS value FROM ({setup[1]})")


# x lies within 0 and 1
_X = ("((.n_nationkey + 1) / 27) as $x |", "SELECT (n_nationkey + 1) / 27.0::DOUBLE AS x FROM nation")
family("math_inverse", "nation", _X, {f"$x | {f}": f"{f}(x)" for f in ("acos", "asin", "atan", "asinh", "atanh", "cbrt", "sqrt")} | {"$x + 1 | acosh": "acosh(x + 1)"}, 10**6)
family("math_circular", "nation", _X, {f"$x | {f}": f"{f}(x)" for f in ("cos", "sin", "tan", "cosh", "sinh", "tanh")}, 10**6)
family("math_exponential", "nation", _X, {"$x | exp": "exp(x)", "$x | exp2": "pow(2, x)", "$x | exp10": "pow(10, x)", "$x | expm1": "exp(x) - 1", "$x | log": "ln(x)", "$x | log2": "log2(x)", "$x | log10": "log10(x)", "$x | log1p": "ln(1 + x)"}, 10**6)
family("math_gamma", "nation", _X, {"$x | gamma": "lgamma(x)", "$x | lgamma": "lgamma(x)", "$x | tgamma": "gamma(x)"}, 10**6)
_ERF = "2 / sqrt(pi()) * list_sum([pow(-1, k) * pow(x, 2 * k + 1) / (factorial(k::INT) * (2 * k + 1)) for k in range(20)])"
family("math_error_function", "nation", _X, {"$x | erf": _ERF, "$x | erfc": f"1 - ({_ERF})"}, 10**6)


def _j(n: int) -> str:
    return f"list_sum([pow(-1, k) * pow(x / 2, 2 * k + {n}) / (factorial(k::INT) * factorial((k + {n})::INT)) for k in range(12)])"


_EULER = "0.57721566490153286061::DOUBLE"
_H = "coalesce(list_sum([1.0::DOUBLE / i for i in range(1, k + 1)]), 0)"
_Y0 = f"2 / pi() * (ln(x / 2) + {_EULER}) * {_j(0)} - 2 / pi() * list_sum([pow(-1, k) * {_H} * pow(x / 2, 2 * k) / (factorial(k::INT) * factorial(k::INT)) for k in range(1, 12)])"
_Y1 = f"-2 / (pi() * x) + 2 / pi() * ln(x / 2) * {_j(1)} - 1 / pi() * list_sum([pow(-1, k) * (2 * {_H} + 1.0::DOUBLE / (k + 1) - 2 * {_EULER}) * pow(x / 2, 2 * k + 1) / (factorial(k::INT) * factorial((k + 1)::INT)) for k in range(12)])"
family("math_bessel", "nation", _X, {"$x | j0": _j(0), "$x | j1": _j(1), "jn(2; $x)": _j(2), "$x | y0": _Y0, "$x | y1": _Y1, "yn(2; $x)": f"2 / x * ({_Y1}) - ({_Y0})"}, 10**4)
_AB = (".n_nationkey as $a | (.n_regionkey + 2) as $b |", "SELECT n_nationkey AS a, n_regionkey + 2 AS b FROM nation")
_REM = "a - b * round_even(a / b::DOUBLE, 0)"
family("math_two", "nation", _AB, {"atan2($a; $b)": "atan2(a, b)", "hypot($a; $b)": "sqrt(a * a + b * b)", "pow($a; $b)": "pow(a, b)", "fmod($a; $b)": "a % b", "fmin($a; $b)": "least(a, b)", "fmax($a; $b)": "greatest(a, b)", "fdim($a; $b)": "greatest(a - b, 0)", "fma($a; $b; 3)": "a * b + 3", "copysign($a + 1; 3 - $b)": "CASE WHEN 3 - b < 0 THEN -(a + 1) ELSE a + 1 END", "ldexp($a; $b)": "a * pow(2, b)", "scalb($a; $b)": "a * pow(2, b)", "scalbln($a; $b)": "a * pow(2, b)", "drem($a; $b)": _REM, "remainder($a; $b)": _REM}, 1000)
family("math_next", "nation", _AB, {"nextafter($a + 1; 99) - ($a + 1)": "nextafter((a + 1)::DOUBLE, 99::DOUBLE) - (a + 1)", "nexttoward($a + 1; 0) - ($a + 1)": "nextafter((a + 1)::DOUBLE, 0::DOUBLE) - (a + 1)"}, 10**19)
_EXP = "floor(log2(a + 1))"
family("math_parts", "nation", _AB, {"$a + 1 | logb": _EXP, "$a + 1 | significand": f"(a + 1) / pow(2, {_EXP})", "$a + 1 | frexp | .[0]": f"(a + 1) / pow(2, {_EXP} + 1)", "$a + 1 | frexp | .[1]": f"{_EXP} + 1", "$a / 4 | modf | .[0]": "a / 4.0::DOUBLE - floor(a / 4.0::DOUBLE)", "$a / 4 | modf | .[1]": "floor(a / 4.0::DOUBLE)"}, 10**6)
family("math_rounding", "nation", (".n_nationkey as $a | ($a / 4 + 3) as $x |", "SELECT n_nationkey AS a, n_nationkey / 4.0::DOUBLE + 3 AS x FROM nation"), {"$x | ceil": "ceil(x)", "$x | floor": "floor(x)", "$x | round": "floor(x + 0.5)", "$x | trunc": "floor(x)", "$x | rint": "round_even(x, 0)", "$x | nearbyint": "round_even(x, 0)", "12 - $a | abs": "abs(12 - a)", "12.5 - $a | fabs": "abs(12.5 - a)"}, 100)
family("math_classes", "nation", (".n_nationkey as $a | [$a, nan, infinite, 1 / ($a + 1)] |", "SELECT n_nationkey AS a FROM nation"), {"map(isnan) | tojson": "'\"[false,true,false,false]\"'", "map(isinfinite) | tojson": "'\"[false,false,true,false]\"'", "map(isfinite) | tojson": "'\"[true,false,false,true]\"'", "map(isnormal) | tojson": "'\"[' || (a <> 0) || ',false,false,true]\"'", "map(finites) | length": "3", "map(normals) | length": "CASE WHEN a = 0 THEN 1 ELSE 2 END"})

_KINDS = ("[.r_regionkey, .r_name, null, .r_regionkey > 2, [.r_regionkey], {a: .r_name}] |", "SELECT r_regionkey AS k, r_name AS s, r_regionkey > 2 AS b FROM region")
family("selectors", "region", _KINDS, {"map(nulls) | length": "1", "map(booleans)": "'[' || b || ']'", "map(numbers)": "'[' || k || ']'", "map(strings)": "'[\"' || s || '\"]'", "map(arrays)": "'[[' || k || ']]'", "map(objects)": "'[{\"a\":\"' || s || '\"}]'", "map(iterables) | length": "2", "map(scalars) | length": "4", "map(values) | length": "5", "[.[] | empty] | length": "0", "map(type) | tojson": "'\"[\\\"number\\\",\\\"string\\\",\\\"null\\\",\\\"boolean\\\",\\\"array\\\",\\\"object\\\"]\"'", "map(length?) | length": "5", "have_decnum": "true", "have_literal_numbers": "true", "builtins | length > 200": "true", "map(not)": "'[false,false,true,' || (NOT b) || ',false,false]'", "try error(.[1]) catch .": "'\"' || s || '\"'"})
_ROW = ("", "SELECT n_nationkey AS k, n_name AS s, n_regionkey AS r FROM nation")
family("object_access", "nation", _ROW, {'has("n_name")': "true", '"x" | in({x: 1})': "true", "keys": "'[\"n_name\",\"n_nationkey\",\"n_regionkey\"]'", "keys_unsorted": "'[\"n_nationkey\",\"n_name\",\"n_regionkey\"]'", "[path(.n_name)]": "'[[\"n_name\"]]'", "[paths]": "'[[\"n_nationkey\"],[\"n_name\"],[\"n_regionkey\"]]'", 'getpath(["n_name"])': "'\"' || s || '\"'", 'setpath(["n_name"]; .n_regionkey) | .n_name': "r", 'delpaths([["n_name"], ["n_regionkey"]])': "'{\"n_nationkey\":' || k || '}'", "pick(.n_regionkey)": "'{\"n_regionkey\":' || r || '}'", "del(.n_name, .n_nationkey)": "'{\"n_regionkey\":' || r || '}'", "[{name: .n_name, value: .n_nationkey}] | from_entries": "'{\"' || s || '\":' || k || '}'", "to_entries | map(.value) | last": "r", "[.n_regionkey | recurse(if . > 0 then . - 1 else empty end)] | length": "r + 1", "[recurse] | length": "4", "[recurse(.[]?; type == \"number\")] | length": "3", "[[.n_nationkey, .n_regionkey]] | [1 | truncate_stream([[0], 1], [[1, 0], 2], [[1, 0]], [[1]])] | length": "2", "[tostream] | length": "4", "fromstream(tostream) | .n_regionkey": "r", "with_entries(select(.value == .value)) | length": "3", "map_values(numbers)": "'{\"n_nationkey\":' || k || ',\"n_regionkey\":' || r || '}'", "walk(if type == \"string\" then length else . end) | .n_name": "length(s)"})
_LIST = ("[.n_nationkey, .n_regionkey, 7, null, .n_nationkey] |", "SELECT n_nationkey AS k, n_regionkey AS r FROM nation")
_S3 = "list_sort([k, r, 7])"
family("array_functions", "nation", _LIST, {"sort | .[0] | type": "'\"null\"'", "map(values) | sort | .[1:3]": "'[' || list_sort([k, k, r, 7])[2] || ',' || list_sort([k, k, r, 7])[3] || ']'", "[., [.]] | flatten | length": "10", "[., [.]] | flatten(1) | length": "6", "nth(2)": "7", "[nth(1; .[])]": "'[' || r || ']'", "isempty(.[] | select(. == 24))": "k <> 24", "map({v: .}) | min_by(.v) | .v | type": "'\"null\"'", "map({v: .}) | max_by(.v) | .v": "greatest(k, r, 7)", "map(values) | unique | length": "len(list_distinct([k, r, 7]))", "map(numbers) | unique | bsearch(7)": "list_position(list_sort(list_distinct([k, r, 7])), 7) - 1", "contains([7])": "true", "[7] | inside([7, 8])": "true", "indices(null)": "'[3]'", "index(7)": "CASE WHEN k = 7 THEN 0 WHEN r = 7 THEN 1 ELSE 2 END", "rindex(7)": "CASE WHEN k = 7 THEN 4 ELSE 2 END", "map(numbers) | map(. % 2) | unique_by(.) | length": "len(list_distinct([k % 2, r % 2, 1]))", "reverse | .[2]": "7", "first, last": "k || ',' || k", "[limit(2; .[])] | length": "2", "[skip(4; .[])]": "'[' || k || ']'", "map(numbers) | add": "2 * k + r + 7", "any, all": "'true,false'", "any(. == 24), all(. != 24)": "(k = 24) || ',' || (k <> 24)", "map(numbers) | group_by(. > 3) | length": "CASE WHEN k > 3 AND r > 3 THEN 1 ELSE CASE WHEN k <= 3 OR r <= 3 THEN 2 ELSE 1 END END", "[[.[0], 1], [2]] | transpose": "'[[' || k || ',2],[1,null]]'", "IN([7], [null])": "false", "INDEX(.[] | numbers; . % 2) | length": "len(list_distinct([k % 2, r % 2, 1]))", "[JOIN({\"7\": \"x\"}; .[] | numbers; tostring)] | length": "4", "[JOIN({\"7\": \"x\"}; .[2]; tostring; join(\"-\"))]": "'[\"7-x\"]'", "[range(3)], [range(0; 10; 4)]": "'[0,1,2],[0,4,8]'", "min, max": "'null,' || greatest(k, r, 7)", "map(numbers) | sort_by(-.) | first": "greatest(k, r, 7)", "[[1, 2] | combinations(2)] | length": "4"})
family("control", "nation", (".n_regionkey as $r |", "SELECT n_regionkey AS r FROM nation"), {"[$r + 1 | while(. < 50; . * 2)] | length": "ceil(log2(50.0 / (r + 1)))::INT", "$r + 1 | until(. > 50; . * 2)": "(r + 1) * pow(2, ceil(log2(50.5 / (r + 1))))::INT", "[limit($r; 1 | repeat(. * 2))] | add // 0": "(pow(2, r) - 1)::INT", "input_filename": "'null'", "[$r | debug, stderr] | add": "2 * r", "env | type": "'\"object\"'", "$ENV | type": "'\"object\"'", "now | type": "'\"number\"'", "$__loc__ | .line": "1", "[.[] as [$a] ?// $a | $a] | length": "3", "reduce range($r) as $i (0; . + $i)": "(r * (r - 1)) // 2", "[foreach range($r) as $i (0; . + $i; [$i, .])] | length": "r", "[.n_name as $n | $n, $r] | length": "2", "{a: [$r, 2]} as {a: [$x, $y]} | $x + $y": "r + 2", "try error({c: $r}) catch .c": "r", "[.[]? | numbers] | length": "2", "label $f | ($r, break $f, 9)": "r", "[$r, 1] | . as [$p, $q] | {$p, $q} | .p + .q": "r + 1", "$r | . as $v | def f(g; $n): g + $n + $v; f(. * 2; 5)": "3 * r + 5", "if $r > 2 then \"a\" elif $r > 0 then \"b\" else \"c\" end": "CASE WHEN r > 2 THEN '\"a\"' WHEN r > 0 THEN '\"b\"' ELSE '\"c\"' END", "[$r] | .[0] += 1 | .[0] -= 3 | .[0] *= 2 | .[0]": "(r - 2) * 2", "{} | .a //= $r | .a |= . + 1 | .a": "r + 1", "{a: {b: 1}} * {a: {c: $r}} | .a | length": "2", "[1, 2, $r + 5] - [2] | length": "2"})
_STR = (".n_name as $s | .n_regionkey as $r |", "SELECT n_name AS s, n_regionkey AS r FROM nation")
_Q = "'\"' || {} || '\"'"
family("string_functions", "nation", _STR, {'"true" | toboolean': "true", '"  \\($s) " | trim': _Q.format("s"), '"  \\($s) " | ltrim': _Q.format("s || ' '"), '"  \\($s) " | rtrim': _Q.format("'  ' || s"), '$s | ltrimstr("A")': _Q.format("CASE WHEN s LIKE 'A%' THEN substr(s, 2) ELSE s END"), '$s | rtrimstr("A")': _Q.format("CASE WHEN s LIKE '%A' THEN substr(s, 1, length(s) - 1) ELSE s END"), '"A\\($s | ascii_downcase)A" | trimstr("A")': _Q.format("lower(s)"), '$s | startswith("A")': "s LIKE 'A%'", '$s | endswith("A")': "s LIKE '%A'", '$s | explode | length': "length(s)", '$s | explode | map(. + 1) | implode | explode | .[0]': "ascii(s) + 1", '[$s | splits("A")] | length': "len(string_split(s, 'A'))", '$s | split("A") | join("-")': _Q.format("replace(s, 'A', '-')"), '$s | split("a"; "gi") | length': "len(string_split(s, 'A'))", '$s | ascii_downcase | ascii_upcase': _Q.format("upper(s)"), "$s | utf8bytelength": "strlen(s)", '$r | tostring | tonumber': "r", '[$r, $s] | tojson | fromjson | .[0]': "r", '$s | contains("A")': "contains(s, 'A')", '$s | inside("x" + $s)': "true", '$s | indices("A") | length': "len(s) - len(replace(s, 'A', ''))", '$s | index("A")': "CASE WHEN contains(s, 'A') THEN (strpos(s, 'A') - 1)::VARCHAR ELSE 'null' END", '$s | rindex("A")': "CASE WHEN contains(s, 'A') THEN (length(s) - strpos(reverse(s), 'A'))::VARCHAR ELSE 'null' END", '$s * 2': _Q.format("s || s"), '$s / "A" | length': "len(string_split(s, 'A'))", "$s[1:3]": _Q.format("substr(s, 2, 2)")})
family("formats", "nation", _STR, {"[$r, $s] | @text": "'\"[' || r || ',\\\"' || s || '\\\"]\"'", "[$r, $s] | @json": "'\"[' || r || ',\\\"' || s || '\\\"]\"'", '"<\\($s)&>" | @html': _Q.format("'&lt;' || s || '&amp;&gt;'"), '"\\($s) é/" | @uri': _Q.format("replace(s, ' ', '%20') || '%20%C3%A9%2F'"), '"\\($s) é" | @uri | @urid': _Q.format("s || ' é'"), "[$r, $s] | @csv": "'\"' || r || ',\\\"' || s || '\\\"\"'", "[$r, $s] | @tsv": "'\"' || r || '\\t' || s || '\"'", "[$r, $s] | @sh": _Q.format("r || ' ''' || s || ''''"), "$s | @base64": _Q.format("base64(s::BLOB)"), "$s | @base64 | @base64d": _Q.format("s"), '@uri "q=\\($s + " ")"': _Q.format("'q=' || replace(s, ' ', '%20') || '%20'")})
family("regex_functions", "nation", _STR, {'$s | [match("[AEIOU]"; "g").offset] | length': "len(regexp_extract_all(s, '[AEIOU]'))", '$s | match("[AEIOU]") | .string': _Q.format("regexp_extract(s, '[AEIOU]')"), '$s | sub("[AEIOU]"; "*")': _Q.format("regexp_replace(s, '[AEIOU]', '*')"), '$s | gsub("[aeiou]"; "*"; "i")': _Q.format("regexp_replace(s, '[AEIOU]', '*', 'g')"), '$s | test("^a"; "i")': "s LIKE 'A%'", '$s | [scan("[AEIOU]+")] | length': "len(regexp_extract_all(s, '[AEIOU]+'))", '$s | capture("(?<first>.)(?<rest>.*)") | .rest': _Q.format("substr(s, 2)"), '$s | [match("(?<v>[AEIOU])"; "g").captures[0].name] | unique': "'[\"v\"]'", '$s | sub("(?<a>.)(?<b>.)"; "\\(.b)\\(.a)")': _Q.format("substr(s, 2, 1) || substr(s, 1, 1) || substr(s, 3)")})
_T = ("(951782400 + .n_nationkey * 2678461) as $t |", "SELECT to_timestamp(951782400 + n_nationkey * 2678461) AT TIME ZONE 'UTC' AS ts, 951782400 + n_nationkey * 2678461 AS t FROM nation")
_PARTS = "'[' || year(ts) || ',' || (month(ts) - 1) || ',' || day(ts) || ',' || hour(ts) || ',' || minute(ts) || ',' || second(ts)::INT || ',' || dayofweek(ts) || ',' || (dayofyear(ts) - 1) || ']'"
family("date_functions", "nation", _T, {"$t | gmtime": _PARTS, "$t | gmtime | mktime": "t", "$t | todate": _Q.format("strftime(ts, '%Y-%m-%dT%H:%M:%SZ')"), "$t | todateiso8601": _Q.format("strftime(ts, '%Y-%m-%dT%H:%M:%SZ')"), "$t | todate | fromdate": "t", "$t | todate | fromdateiso8601": "t", '$t | todate | strptime("%Y-%m-%dT%H:%M:%SZ")': _PARTS, '$t | strftime("%A, %d %B %Y %j")': _Q.format("strftime(ts, '%A, %d %B %Y %j')"), '$t | localtime | mktime == $t': "true", '$t | strflocaltime("%Y") | length': "4", "$t | gmtime | todate": _Q.format("strftime(ts, '%Y-%m-%dT%H:%M:%SZ')")})
planned("null_min_max", "lineitem", "{lo: (map(if .l_linenumber == 2 then null else .l_quantity end) | min), hi: (map(if .l_linenumber == 2 then null else .l_quantity end) | max), kinds: ([.[] | if .l_linenumber == 2 then null else .l_suppkey end] | unique | length)}", "SELECT NULL::DOUBLE AS lo, max(l_quantity) FILTER (l_linenumber <> 2) AS hi, count(DISTINCT l_suppkey) FILTER (l_linenumber <> 2) + 1 AS kinds FROM lineitem", slurp=True)
planned("null_groups", "orders", 'map({s: (if .o_orderpriority == "1-URGENT" then null else .o_orderpriority end), p: (if .o_orderstatus == "O" then null else .o_totalprice end)}) | group_by(.s) | map({s: .[0].s, n: length, lo: (map(.p) | min), hi: (map(.p) | max), total: (map(.p) | add)})', "SELECT CASE WHEN o_orderpriority = '1-URGENT' THEN NULL ELSE o_orderpriority END AS s, count(*) AS n, CASE WHEN bool_or(o_orderstatus = 'O') THEN NULL ELSE min(o_totalprice) END AS lo, max(o_totalprice) FILTER (o_orderstatus <> 'O') AS hi, round(sum(o_totalprice) FILTER (o_orderstatus <> 'O'), 2) AS total FROM orders GROUP BY 1", slurp=True)
planned("null_compare", "lineitem", "(if .l_linenumber == 2 then null else .l_quantity end) as $q | {k: .l_orderkey, n: .l_linenumber, less: ($q < 20), same: ($q == null), more: ($q + 1), or_else: ($q // -1)}", "SELECT l_orderkey AS k, l_linenumber AS n, l_linenumber = 2 OR l_quantity < 20 AS less, l_linenumber = 2 AS same, CASE WHEN l_linenumber = 2 THEN 1 ELSE l_quantity + 1 END AS more, CASE WHEN l_linenumber = 2 THEN -1 ELSE l_quantity END AS or_else FROM lineitem")
planned("intersect_rows", "customer", "map({k: .c_custkey}) - (map({k: .c_custkey}) - ($orders | map({k: .o_custkey}))) | .[]", "SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders", slurp=True, others=("orders",))
planned("group_first", "orders", "sort_by(.o_totalprice, .o_orderkey) | group_by(.o_orderstatus) | map({s: .[0].o_orderstatus, cheapest: .[0].o_orderkey})", "SELECT o_orderstatus AS s, arg_min(o_orderkey, (o_totalprice, o_orderkey)) AS cheapest FROM orders GROUP BY 1", slurp=True)


# ---------------------------------------------------------------- sources and sinks


def _scratch(spark: SparkSession, fmt: str) -> str:
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that all machines share")
    return f"{named or 'file:///tmp/checkpoints/larkspur'}/formats/{fmt}-{uuid.uuid4().hex}"


def round_trip(name: str, fmt: str, shape: str, back: str, table: str = "nation", columns: str = "n_nationkey long, n_name string, n_regionkey long") -> None:
    """Write the table in a format and read the files again. shape: the query that makes the values to write; back: that turns what is read into rows."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = _scratch(spark, fmt)
        write(batches.run(batches.as_json(_table(spark, sf_dir, table)), shape), path, fmt)
        values = batches.run(read(spark, f"{path}/part-*" if fmt not in ("jsonl", "ndjson") else path, fmt).select("in_ord", "value"), back)
        return values.select(F.from_json("value", columns).alias("v")).select("v.*")

    run.__name__ = name
    QUERIES[name], ORACLE[name] = run, f"SELECT {', '.join(c.split()[0] for c in columns.split(', '))} FROM {table}"


for _fmt in ("json", "jsonl", "json-seq", "toon-seq"):
    round_trip(f"format_{_fmt.replace('-', '_')}", _fmt, ".", ".")
for _fmt in ("csv", "tsv"):
    round_trip(f"format_{_fmt}", _fmt, ".", "(if type == \"array\" then .[] else . end) | {n_nationkey: (.n_nationkey | tonumber), n_name, n_regionkey: (.n_regionkey | tonumber)}")
