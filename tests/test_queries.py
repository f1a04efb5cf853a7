"""Registered queries against DuckDB, and plans."""

import os

import pytest

from larkspur import catalogue, registry  # noqa: F401
from larkspur.operators import columns

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(frame, names):
    def one(v):
        if v is None or v != v:
            return None
        return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v

    return sorted((tuple(repr(one(v.item() if hasattr(v, "item") else v)) for v in r) for r in frame[names].itertuples(index=False)))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_against_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    want = duck.execute(registry.ORACLE[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got, sorted(got.columns)) == rows(want, sorted(got.columns))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    lineitem = spark.read.parquet(f"{SF}/lineitem.parquet")
    p = plan_of(columns.plan(lineitem, 'select(.l_returnflag == "R" and .l_quantity > 40) | {k: .l_orderkey}'))
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double,l_returnflag:string>" in p
    assert "turnflag,R), GreaterThan(l_quantity," in p
    assert "l_extendedprice" not in p and "Exchange" not in p


def test_top_k_is_no_full_sort(spark):
    p = plan_of(columns.plan(spark.read.parquet(f"{SF}/orders.parquet"), "sort_by(-.o_totalprice, .o_orderkey) | .[:5]", slurp=True))
    assert "TakeOrderedAndProject" in p


def test_both_tiers_agree(spark):
    import larkspur
    from larkspur.functions.values import loads
    from larkspur.operators import batches

    part = spark.read.parquet(f"{SF}/part.parquet").limit(100)
    for q in ('{a: (.p_size * 2 + 1), b: (.p_name | ascii_upcase), c: (.p_name | split(" ") | length), d: (.p_size > 20 and .p_brand != "Brand#1")}', '{e: (.nope // "none"), f: (.p_name[1:4]), g: ([.p_size, 3] | max), h: (.p_retailprice | floor)}'):
        typed = [{k: float(v) if isinstance(v, int) and not isinstance(v, bool) else v for k, v in r.asDict().items()} for r in larkspur.query(part, q).collect()]
        kernel = [{k: float(v) if isinstance(v, int) and not isinstance(v, bool) else v for k, v in loads(r.value).items()} for r in batches.run(batches.as_json(part), q).collect()]
        assert sorted(map(str, typed)) == sorted(map(str, kernel))


def test_falls_back_to_the_kernel(spark):
    import larkspur

    out = larkspur.query(spark.read.parquet(f"{SF}/region.parquet"), '[.. | strings] | join("+")')
    assert sorted(r.value for r in out.collect())[0] == '"AFRICA"'


def test_empty_tables_and_nulls(spark):
    df = spark.createDataFrame([(None, None), (1, "a"), (3, None)], "a int, s string")
    got = columns.plan(df, "{x: (.a + 1), y: (.a < 2), z: (.s // \"none\"), n: (.s | length)}").collect()
    assert sorted(map(tuple, got), key=str) == [(1.0, True, "none", 0), (2.0, True, "a", 1), (4.0, False, "none", 0)]
    empty = df.where("false")
    assert columns.plan(empty, "{n: length, t: (map(.a) | add), any: (map(.a > 1) | any), all: (map(.a > 1) | all)}", slurp=True).collect()[0].asDict() == {"n": 0, "t": None, "any": False, "all": True}
    assert columns.plan(empty, "group_by(.s) | map({s: .[0].s, n: length})", slurp=True).count() == 0
