"""Registered queries over the driver's tables, each with SQL that says the same.

Doubles are rounded to two places on both sides, in the same arithmetic: sums depend on the order of addition.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators import batches, columns

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[(F.floor(F.col(c) * 100 + 0.5) / 100).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _rounding(sql: str) -> str:
    """The SQL with round(x, 2) written out as the arithmetic of ``_rounded``."""
    while (at := sql.find("round(")) >= 0:
        depth, end = 1, at + 6
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        sql = f"{sql[:at]}(floor(({sql[at + 6 : end - 4]}) * 100 + 0.5) / 100){sql[end:]}"
    return sql


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def planned(name: str, table: str, query: str, sql: str, slurp: bool = False, others: tuple[str, ...] = ()) -> None:
    """A query that the DataFrame compiler takes whole."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        tables = {t: _table(spark, sf_dir, t) for t in others}
        return _rounded(columns.plan(_table(spark, sf_dir, table), query, slurp, tables))

    run.__name__ = name
    QUERIES[name], ORACLE[name] = run, _rounding(sql)


def kernel(name: str, table: str, query: str, sql: str) -> None:
    """A query that runs in the kernel, one row at a time; its results are JSON texts."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return batches.run(batches.as_json(_table(spark, sf_dir, table)), query).select("value")

    run.__name__ = name
    QUERIES[name], ORACLE[name] = run, sql


planned("projection", "customer", "{name: .c_name, bal: .c_acctbal}", "SELECT c_name AS name, round(c_acctbal, 2) AS bal FROM customer")
planned("filter_construct", "lineitem", 'select(.l_returnflag == "R" and .l_quantity > 40) | {k: .l_orderkey, v: (.l_extendedprice * (1 - .l_discount))}', "SELECT l_orderkey AS k, round(l_extendedprice * (1 - l_discount), 2) AS v FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 40")
planned("select_or_not", "orders", 'select(.o_orderstatus == "F" or (.o_totalprice < 10000 | not | not)) | {o_orderkey}', "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' OR o_totalprice < 10000")
planned("conditional", "part", 'if .p_size < 10 then "small" elif .p_size < 30 then "middle" else "large" end | {size: .}', "SELECT CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'middle' ELSE 'large' END AS size FROM part")
planned("alternative", "supplier", '{s_suppkey, note: (.s_comment // "none"), rich: (if .s_acctbal > 5000 then .s_acctbal else null end // 0)}', "SELECT s_suppkey, 'none' AS note, CASE WHEN s_acctbal > 5000 THEN round(s_acctbal, 2) ELSE 0.0 END AS rich FROM supplier")
planned("arithmetic", "lineitem", "{k: .l_orderkey, a: (.l_quantity + 1), b: (.l_extendedprice / .l_quantity), c: (.l_orderkey % 7), d: (-.l_tax)}", "SELECT l_orderkey AS k, round(l_quantity + 1, 2) AS a, round(l_extendedprice / l_quantity, 2) AS b, (l_orderkey % 7)::DOUBLE AS c, round(-l_tax, 2) AS d FROM lineitem")
planned("strings", "part", '{p_partkey, up: (.p_name | ascii_upcase), low: (.p_type | ascii_downcase), n: (.p_name | length), s: (.p_name[0:3]), t: (.p_brand | ltrimstr("Brand#")), b: (.p_name | utf8bytelength), starts: (.p_type | startswith("ECO"))}', "SELECT p_partkey, upper(p_name) AS up, lower(p_type) AS low, length(p_name) AS n, substr(p_name, 1, 3) AS s, CASE WHEN starts_with(p_brand, 'Brand#') THEN substr(p_brand, 7) ELSE p_brand END AS t, strlen(p_name)::BIGINT AS b, starts_with(p_type, 'ECO') AS starts FROM part")
planned("interpolation", "nation", r'{line: "\(.n_nationkey): \(.n_name)@\(.n_regionkey + 1)"}', "SELECT n_nationkey || ': ' || n_name || '@' || (n_regionkey + 1) AS line FROM nation")
planned("split_join", "part", '{p_partkey, words: (.p_name | split(" ") | length), last: (.p_name | split(" ") | last), dashed: (.p_name | split(" ") | join("-"))}', "SELECT p_partkey, len(string_split(p_name, ' '))::BIGINT AS words, string_split(p_name, ' ')[-1] AS last, replace(p_name, ' ', '-') AS dashed FROM part")
planned("explode_array", "part", '.p_name | split(" ") | .[] | {word: .}', "SELECT unnest(string_split(p_name, ' ')) AS word FROM part")
planned("array_construct", "part", "[.p_size, .p_retailprice, 1] | {total: add, most: max, least: min, n: length}", "SELECT round(p_size + p_retailprice + 1, 2) AS total, round(greatest(p_size, p_retailprice, 1), 2) AS most, round(least(p_size, p_retailprice, 1), 2) AS least, 3::BIGINT AS n FROM part")
planned("array_map", "part", '.p_name | split(" ") | {n: (map(length) | add), long: (map(select(length > 4)) | length), any_red: any(. == "red")}', "SELECT length(replace(p_name, ' ', ''))::DOUBLE AS n, len(list_filter(string_split(p_name, ' '), lambda x: length(x) > 4))::BIGINT AS long, list_contains(string_split(p_name, ' '), 'red') AS any_red FROM part")
planned("dates", "orders", '{o_orderkey, day: (.o_orderdate | strftime("%Y-%m-%d")), month: (.o_orderdate | strftime("%Y/%m")), iso: (.o_orderdate | todate), back: (.o_orderdate | todate | fromdate)}', "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(o_orderdate, '%Y/%m') AS month, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS iso, epoch(o_orderdate)::BIGINT AS back FROM orders")
planned("math", "lineitem", "{k: .l_orderkey, n: .l_linenumber, f: (.l_extendedprice | floor), c: (.l_discount | ceil), s: (.l_quantity | sqrt), r: (.l_extendedprice | round), p: pow(.l_quantity; 2), g: (.l_quantity | log10), m: fmax(.l_tax; .l_discount)}", "SELECT l_orderkey AS k, l_linenumber AS n, floor(l_extendedprice) AS f, ceil(l_discount) AS c, round(sqrt(l_quantity), 2) AS s, floor(l_extendedprice + 0.5) AS r, round(pow(l_quantity, 2), 2) AS p, round(log10(l_quantity), 2) AS g, greatest(l_tax, l_discount) AS m FROM lineitem")
planned("regex_test", "part", 'select(.p_name | test("^(small|large)"; "i")) | {p_partkey}', "SELECT p_partkey FROM part WHERE regexp_matches(p_name, '^(small|large)', 'i')")
planned("regex_gsub", "part", '{p_partkey, masked: (.p_name | gsub("[aeiou]+"; "*"))}', "SELECT p_partkey, regexp_replace(p_name, '[aeiou]+', '*', 'g') AS masked FROM part")
planned("type_tests", "orders", '{o_orderkey, a: (.o_totalprice | type), b: (.o_orderstatus | type), c: (.nothing | type), d: (.o_totalprice | tostring | type)}', "SELECT o_orderkey, 'number' AS a, 'string' AS b, 'null' AS c, 'string' AS d FROM orders")
planned("in_list", "customer", '{c_custkey, home: (.c_mktsegment | IN("HOUSEHOLD", "FURNITURE"))}', "SELECT c_custkey, c_mktsegment IN ('HOUSEHOLD', 'FURNITURE') AS home FROM customer")
planned("bind_destructure", "lineitem", ".l_quantity as $q | .l_extendedprice as $p | {k: .l_orderkey, unit: ($p / $q)}", "SELECT l_orderkey AS k, round(l_extendedprice / l_quantity, 2) AS unit FROM lineitem")
planned("user_function", "lineitem", "def net: .l_extendedprice * (1 - .l_discount); def gross: net * (1 + .l_tax); {k: .l_orderkey, net: net, gross: gross}", "SELECT l_orderkey AS k, round(l_extendedprice * (1 - l_discount), 2) AS net, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 2) AS gross FROM lineitem")
planned("comma_union", "nation", "({id: .n_nationkey, what: \"nation\"}, {id: .n_regionkey, what: \"region\"})", "SELECT n_nationkey AS id, 'nation' AS what FROM nation UNION ALL SELECT n_regionkey, 'region' FROM nation")
planned("group_aggregate", "lineitem", "group_by(.l_returnflag, .l_linestatus) | map({flag: .[0].l_returnflag, status: .[0].l_linestatus, n: length, qty: (map(.l_quantity) | add), price: (map(.l_extendedprice * (1 - .l_discount)) | add), avg_qty: ((map(.l_quantity) | add) / length), hi: (map(.l_discount) | max), lo: (map(.l_tax) | min)})", "SELECT l_returnflag AS flag, l_linestatus AS status, count(*) AS n, sum(l_quantity) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS price, round(avg(l_quantity), 2) AS avg_qty, max(l_discount) AS hi, min(l_tax) AS lo FROM lineitem GROUP BY ALL", slurp=True)
planned("group_having", "lineitem", "group_by(.l_orderkey) | map(select((map(.l_quantity) | add) > 150) | {k: .[0].l_orderkey, qty: (map(.l_quantity) | add)})", "SELECT l_orderkey AS k, sum(l_quantity) AS qty FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 150", slurp=True)
planned("group_conditional", "events", 'group_by(.event_type) | map({event: .[0].event_type, n: length, large: (map(select(.value > 50)) | length), spent: (map(select(.value > 50) | .value) | add)})', "SELECT event_type AS event, count(*) AS n, count(*) FILTER (value > 50) AS large, round(sum(value) FILTER (value > 50), 2) AS spent FROM events GROUP BY event_type", slurp=True)
planned("group_hour", "events", 'map({hour: (.ts | strftime("%Y-%m-%dT%H")), value}) | group_by(.hour) | map({hour: .[0].hour, n: length, total: (map(.value) | add)})', "SELECT strftime(ts, '%Y-%m-%dT%H') AS hour, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1", slurp=True)
planned("distinct", "orders", "map({o_orderstatus, o_orderpriority}) | unique | .[]", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders", slurp=True)
planned("unique_by", "customer", "sort_by(.c_custkey) | unique_by(.c_mktsegment) | map({c_mktsegment, c_custkey})", "SELECT c_mktsegment, min(c_custkey) AS c_custkey FROM customer GROUP BY c_mktsegment", slurp=True)
planned("count_distinct", "lineitem", "[.[].l_suppkey] | unique | length", "SELECT count(DISTINCT l_suppkey) AS value FROM lineitem", slurp=True)
planned("sort_limit", "orders", "sort_by(-.o_totalprice, .o_orderkey) | .[:20] | map({o_orderkey, o_totalprice})", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20", slurp=True)
planned("sort_skip", "orders", "skip(100; limit(150; sort_by(.o_orderkey) | .[])) | {o_orderkey}", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 100", slurp=True)
planned("reverse_first", "supplier", "sort_by(.s_acctbal, .s_suppkey) | reverse | first | {s_suppkey, s_acctbal}", "SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal DESC, s_suppkey DESC LIMIT 1", slurp=True)
planned("whole_aggregate", "lineitem", "{n: length, qty: (map(.l_quantity) | add), hi: (map(.l_extendedprice) | max), any_free: (map(.l_tax == 0) | any), all_paid: (map(.l_tax > 0) | all)}", "SELECT count(*) AS n, sum(l_quantity) AS qty, max(l_extendedprice) AS hi, bool_or(l_tax = 0) AS any_free, bool_and(l_tax > 0) AS all_paid FROM lineitem", slurp=True)
planned("reduce_sum", "orders", "reduce .[] as $o (0; . + $o.o_totalprice)", "SELECT round(sum(o_totalprice), 2) AS value FROM orders", slurp=True)
planned("reduce_filtered", "orders", 'reduce (.[] | select(.o_orderstatus == "F")) as $o (0; . + $o.o_totalprice)', "SELECT round(sum(o_totalprice), 2) AS value FROM orders WHERE o_orderstatus = 'F'", slurp=True)
planned("foreach_running", "supplier", "sort_by(.s_suppkey) | foreach .[] as $s (0; . + $s.s_acctbal; {key: $s.s_suppkey, total: .})", "SELECT s_suppkey AS key, round(sum(s_acctbal) OVER (ORDER BY s_suppkey), 2) AS total FROM supplier", slurp=True)
planned("join_lookup", "customer", "INDEX($nation[]; .n_nationkey) as $n | .[] | {name: .c_name, nation: $n[.c_nationkey | tostring].n_name}", "SELECT c_name AS name, n_name AS nation FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey", slurp=True, others=("nation",))
planned("join_group", "orders", "INDEX($customer[]; .c_custkey) as $c | map({segment: $c[.o_custkey | tostring].c_mktsegment, price: .o_totalprice}) | group_by(.segment) | map({segment: .[0].segment, n: length, price: (map(.price) | add)})", "SELECT c_mktsegment AS segment, count(*) AS n, round(sum(o_totalprice), 2) AS price FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1", slurp=True, others=("customer",))
planned("join_inner", "orders", "INDEX($customer[]; .c_custkey) as $c | .[] | {k: .o_orderkey, name: $c[.o_custkey | tostring].c_name} | select(.name != null)", "SELECT o_orderkey AS k, c_name AS name FROM orders JOIN customer ON o_custkey = c_custkey", slurp=True, others=("customer",))
planned("semi_join", "customer", "map(select(.c_custkey | IN($orders[] | select(.o_totalprice > 400000) | .o_custkey)) | {c_custkey}) | .[]", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)", slurp=True, others=("orders",))
planned("anti_join", "customer", "map(select(.c_custkey | IN($orders[] | select(.o_totalprice > 300000) | .o_custkey) | not) | {c_custkey}) | .[]", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)", slurp=True, others=("orders",))
planned("union_all", "nation", "map({id: .n_regionkey, name: .n_name}) + ($region | map({id: .r_regionkey, name: .r_name})) | .[]", "SELECT n_regionkey AS id, n_name AS name FROM nation UNION ALL SELECT r_regionkey, r_name FROM region", slurp=True, others=("region",))
planned("union_distinct", "nation", "map({id: .n_regionkey}) + ($region | map({id: .r_regionkey})) | unique | .[]", "SELECT n_regionkey AS id FROM nation UNION SELECT r_regionkey FROM region", slurp=True, others=("region",))
planned("except_rows", "customer", "map({k: .c_custkey}) - ($orders | map(select(.o_totalprice > 300000)) | map({k: .o_custkey})) | .[]", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 300000", slurp=True, others=("orders",))
planned("json_navigation", "events", "{id: .event_id, k: (.props | fromjson | .k)}", "SELECT event_id AS id, json_extract(props, '$.k')::VARCHAR AS k FROM events")
kernel("entries", "nation", "to_entries | map(\"\\(.key)=\\(.value)\") | join(\",\")", "SELECT '\"n_nationkey=' || n_nationkey || ',n_name=' || n_name || ',n_regionkey=' || n_regionkey || '\"' AS value FROM nation")
kernel("entries_update", "region", "with_entries(.key |= ltrimstr(\"r_\")) | .name |= ascii_downcase | del(.regionkey)", "SELECT '{\"name\":\"' || lower(r_name) || '\"}' AS value FROM region")
kernel("paths_recurse", "region", "{a: [.r_regionkey, .r_name]} | ([paths | join(\"/\") ] | join(\" \")), ([.. | scalars | tostring] | join(\",\"))", "SELECT '\"a a/0 a/1\"' AS value FROM region UNION ALL SELECT '\"' || r_regionkey || ',' || r_name || '\"' FROM region")
kernel("combinations", "region", "[[.r_regionkey, 10], [1, 2]] | [combinations | add] | tojson", "SELECT '\"[' || (r_regionkey + 1) || ',' || (r_regionkey + 2) || ',11,12]\"' AS value FROM region")
kernel("transpose", "nation", "[[.n_nationkey, .n_regionkey], [1]] | transpose | tojson", "SELECT '\"[[' || n_nationkey || ',1],[' || n_regionkey || ',null]]\"' AS value FROM nation")
planned("regex_scan", "part", '{p_partkey, n: (.p_name | [scan("[a-z]+")] | length)}', "SELECT p_partkey, len(regexp_extract_all(p_name, '[a-z]+'))::BIGINT AS n FROM part")
kernel("regex_capture", "customer", '.c_name | capture("(?<w>[A-Za-z]+)#0*(?<n>[0-9]+)") | .n | tonumber', "SELECT c_custkey::VARCHAR AS value FROM customer")
kernel("range_until", "region", "[range(0; .r_regionkey + 3)] | add, (1 | until(. > 100; . * 2))", "SELECT ((r_regionkey + 3) * (r_regionkey + 2) // 2)::VARCHAR AS value FROM region UNION ALL SELECT '128' FROM region")
kernel("try_catch", "nation", "try (if .n_nationkey % 2 == 0 then error(\"even\") else .n_name end) catch .", "SELECT CASE WHEN n_nationkey % 2 = 0 THEN '\"even\"' ELSE '\"' || n_name || '\"' END AS value FROM nation")
kernel("label_break", "nation", "[label $f | range(10) as $i | $i, (select($i == .n_regionkey) | break $f)] | length", "SELECT (n_regionkey + 1)::VARCHAR AS value FROM nation")
kernel("stream_events", "region", "([tostream] | length), (fromstream(tostream) | .r_name)", "SELECT '3' AS value FROM region UNION ALL SELECT '\"' || r_name || '\"' FROM region")
kernel("formats_csv", "nation", "[.n_nationkey, .n_name] | @csv, @base64", "SELECT '\"' || n_nationkey || ',\\\"' || n_name || '\\\"\"' AS value FROM nation UNION ALL SELECT '\"' || base64(('[' || n_nationkey || ',\"' || n_name || '\"]')::BLOB) || '\"' FROM nation")
kernel("walk_update", "supplier", "walk(if type == \"number\" then . + 1 else . end) | .s_suppkey + .s_nationkey", "SELECT (s_suppkey + s_nationkey + 2)::VARCHAR AS value FROM supplier")
