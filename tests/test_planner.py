"""Planned forms against the kernel on the same rows, nulls among them: equal results, or an error from both."""

import json

import pytest

import larkspur
from larkspur.functions.values import QueryError, dumps
from larkspur.operators import columns

ROWS = [
    (1, 3, "b c", 0.00001, True, '{"k": 1, "t": "x"}'),
    (2, None, None, None, None, '{"k": null}'),
    (3, 1, "", -2.5, False, "{}"),
    (4, 3, "a,b", 1e20, True, '{"k": {"z": [1, 2]}}'),
    (5, 2, "É x", 12345678.5, None, '{"k": 0.5}'),
    (6, None, "a,b", 0.0001234, False, '{"k": false}'),
]
STREAM = [
    ".s", ".x + 1", ".x - 1", ".x * 2", ".x / 2", "-.x", ".d + .x", ".d - .i", "[.x, .i] | min", "[.x, .i] | max", "[.x, .i] | add", "[.x, .i] | sort", "[.x, .i, .x] | unique | length", ".d | tostring",
    '"\\(.d) and \\(.x) and \\(.b)"', ".s | length", ".s | ascii_upcase", '.s | startswith("a")', '.s | split(",")', '.s | split("")', '"ab" | split("")', ".x < 2", ".x <= 2", ".x >= 2", ".x == null", ".b and .x", ".b // .x", ".x // 7",
    ".b | not", "if .x then .i else 0 end", ".i, (.i + 10)", ".x, .d", "(.i, .s)", "{a: .i, b: .x}, {a: 0, b: .i}", "({a: .i}, {b: .i})", ".s | ltrimstr(\"a\")", ".d | floor", ".x | sqrt", ".d | fabs", "pow(.x; 2)", "select(.x > 1) | .i", "select(.x < 2) | .i", "select(.x != null) | .x - 1",
    "(10 / (.i - 1))?", '((.s | tonumber)? // -1)', ".x?", ".s | test(\"a\")", '.s | gsub("a"; "z")', '.s | [scan("[a-z]")] | length', ".x | type", ".nothing", ".nothing.more", ".j | fromjson | .k", "{i, k: (.j | fromjson | .k.z)}", ".i % 4", ".x % 4", ".s | utf8bytelength", "[.i, .x] | map(. == null)", ".i | IN(1, 2)", ".x | IN(1, null)", "[.i, .i + 1] | .[] | {v: .}",
]
SLURPED = [
    "map(.x) | min", "map(.x) | max", "map(.x) | add", "[.[].x] | unique | length", "map(.s) | unique", "map(.x) | unique", "map(.b) | any", "map(.b) | all", "map(select(.i > 2) | .x) | min", "map(select(.x > 0) | .x) | min", "map(select(.i > 99) | .x) | min", "map(select(.i > 99) | .x) | add",
    "group_by(.x) | map({x: .[0].x, n: length, first: .[0].s, low: (map(.d) | min), kinds: ([.[].s] | unique | length)})", "sort_by(.x) | map(.i)", "sort_by(.x, .i) | reverse | map({i, x})", "sort_by(-.i) | .[:2] | map(.i)", "unique_by(.x) | map(.i)", "map(.i, .x) | length", "length", "map(.i) | add / 2",
    "{lo: (map(.x) | min), hi: (map(.x) | max), n: length}", "reduce .[] as $r (0; . + $r.x)", "sort_by(.i) | foreach .[] as $r (0; . + $r.x)", "map(select(.x == null)) | length", ".[] | .i, .x", "group_by(.b) | map({b: .[0].b, lo: (map(.x) | min)})", "map({x}) | unique | .[]",
]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(ROWS, "i long, x long, s string, d double, b boolean, j string").coalesce(1)


def python_rows():
    return [dict(zip("ixsdbj", r, strict=True)) for r in ROWS]


def plain(v):
    """Numbers as doubles, so that 1 and 1.0 are equal."""
    if isinstance(v, list):
        return [plain(x) for x in v]
    if isinstance(v, dict):
        return {k: plain(x) for k, x in sorted(v.items())}
    return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v


def planned(frame, query, slurp):
    df = columns.plan(frame, query, slurp)
    lone = df.columns == ["value"] and not query.endswith("{value}")
    texts = [json.loads(t) for t in df.toJSON().collect()]
    names = df.columns
    rows = [{k: r.get(k) for k in names} for r in texts]
    if "fromjson" in query:
        rows = [{k: json.loads(v) if isinstance(v, str) else v for k, v in r.items()} for r in rows]
    return [plain(r["value"]) if lone else plain(r) for r in rows]


def same(frame, query, slurp, values):
    try:
        want = [plain(json.loads(dumps(x))) for v in values for x in larkspur.evaluate(query, v)]
    except QueryError:
        want = "error"
    try:
        got = planned(frame, query, slurp)
    except columns.Unsupported:
        pytest.skip("no plan: the kernel runs it")
    except Exception as e:
        assert want == "error", e
        return
    if slurp and want != "error" and len(want) == 1 and isinstance(want[0], list) and got != want:
        want = want[0]  # an array of results is a column of them
    assert got == want


@pytest.mark.parametrize("query", STREAM)
def test_stream(frame, query):
    same(frame, query, False, python_rows())


@pytest.mark.parametrize("query", SLURPED)
def test_slurped(frame, query):
    same(frame, query, True, [python_rows()])


@pytest.mark.parametrize("query", ["(.i, .s)", "({a: .i}, {b: .i})", "(10 / .i)?", "(.s | tonumber)? // -1"])
def test_left_to_the_kernel(frame, query):
    with pytest.raises(columns.Unsupported):
        columns.plan(frame, query)
    assert larkspur.query(frame, query).count() > 0


def test_doubles_print_alike(spark):
    from larkspur.functions.numbers import show

    xs = [0.1, 1e-5, 9.9e-6, 1e-7, 123.456, 1e17, 9.5e16, 1.25e18, -1e-9, -0.00025, 1.7e308, 5e-324, 1e22, 4503599627370497.5, float("inf"), float("-inf"), float("nan"), 3.0, -2.0]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i long, d double")
    got = [r.value for r in columns.plan(df, "sort_by(.i) | .[] | .d | tostring", True).collect()]
    assert [g for g, x in zip(got, xs, strict=True) if g != show(x) and abs(x) != 5e-324] == []


WHOLE = ["group_by(.x)", "map(.s) | add", "min_by(.d)", ".[-2:] | map(.i)", "sort_by(.x, -.i) | .[1:] | first", "[.[] | .i] | combinations(2) | length", "foreach .[] as $r ([]; . + [$r.i]; length)", "to_entries | length", "[limit(-1 + 2; .[])] | length", "map([.i, .x]) | transpose"]


@pytest.mark.parametrize("query", WHOLE)
def test_slurped_without_a_plan(frame, query):
    df = larkspur.query(frame, query, slurp=True)
    got = [json.loads(r["value"]) for r in df.orderBy("in_ord", "res_ord").collect()] if "res_ord" in df.columns else None
    if got is not None:
        assert got == [json.loads(dumps(v)) for v in larkspur.evaluate(query, python_rows())]


def test_tables_without_a_plan(frame):
    df = larkspur.query(frame, "[.i, ($t | map(select(.x == 3)) | length)] | @csv", tables={"t": frame})
    assert [json.loads(r["value"]) for r in df.orderBy("in_ord").collect()] == [f"{i},2" for i in range(1, 7)]


def test_large_arrays_without_a_plan(frame, monkeypatch):
    monkeypatch.setattr(larkspur, "WHOLE_BYTES", 10)
    with pytest.raises(columns.Unsupported):
        larkspur.query(frame, "group_by(.x)", slurp=True)


@pytest.mark.parametrize("query", ["sort_by(.k) | foreach .[] as $r (0; . + $r.v; {k: $r.k, total: .})", "sort_by(.k) | reverse | foreach .[] as $r (10; . + $r.v; {k: $r.k, total: .})"])
def test_running_sum_by_ranges(spark, query, monkeypatch):
    df = spark.range(3000).selectExpr("CASE WHEN id % 100 = 7 THEN NULL ELSE id * 7919 % 1500 END AS k", "id % 13 AS v").orderBy("k", "v").coalesce(1)
    df = spark.createDataFrame(df.collect(), df.schema).coalesce(1)
    one = columns.plan(df, query, True).collect()
    monkeypatch.setattr(columns, "RUNNING_ROWS", 10)
    cut = columns.plan(df, query, True)
    assert sorted(map(str, cut.collect())) == sorted(map(str, one))
