import pytest

from larkspur.functions.values import QueryError, compare, dumps
from larkspur.sources import text as X


def test_json_family():
    assert list(X.json_roots('1 {"a":2}\n[3]')) == [1, {"a": 2}, [3]]
    assert list(X.json_sequence('\x1e1\n\x1e{"a":2}\n')) == [1, {"a": 2}]
    assert X.json5("{a: 'x', /* c */ \"b\": [1, .5, +2, 0xF,], // end\n c: '''t\n''' }") == {"a": "x", "b": [1, 0.5, 2, 15], "c": "t\n"}
    with pytest.raises(QueryError):
        list(X.json_roots("[1, bad]"))


def test_delimited():
    assert list(X.delimited('a,b,c\n1,"2",\ntrue,x y\n', ",")) == [{"a": 1, "b": "2", "c": None}, {"a": True, "b": "x y", "c": None}]
    rows = [{"a": "1", "b": None, "c": 'q"x'}, {"a": 2, "c": "l\nm"}]
    text = X.to_delimited(rows, ",")
    assert list(X.delimited(text, ",")) == [{"a": "1", "b": None, "c": 'q"x'}, {"a": 2, "b": None, "c": "l\nm"}]
    for bad in ("a,a\n1,2\n", "a\n1,2\n", 'a\n"x\n'):
        with pytest.raises(QueryError):
            list(X.delimited(bad, ","))
    with pytest.raises(QueryError):
        X.to_delimited([{"a": []}], ",")
    with pytest.raises(QueryError):
        X.to_delimited([{"a": 1}, {"b": 1}], ",")


VALUES = [
    {"a": 1, "b": "x", "c": None},
    {"items": [{"id": 1, "n": "a,b"}, {"id": 2, "n": "c: d"}], "tags": ["x", "y", "1", "true"]},
    {"deep": {"deeper": {"v": [1, 2]}}, "e": {}, "l": []},
    [1, "a", None],
    [{"a": 1}, {"b": [1, {"c": 2}]}],
    {"m": [[1, 2], [], ["x"]], "s": " lead", "q": 'say "hi"\n', "-": "-"},
    "plain",
    {"x": [{"k": {"z": 1}, "y": 2}, 5]},
]


@pytest.mark.parametrize("v", VALUES)
def test_toon_round_trip(v):
    assert compare(X.from_toon(X.to_toon(v)), v) == 0, X.to_toon(v)


@pytest.mark.parametrize("v", VALUES)
def test_yaml_round_trip(v):
    pytest.importorskip("yaml")
    assert list(X.yaml_documents(X.to_yaml(v))) == [v]


def test_toon_text():
    assert X.to_toon({"users": [{"id": 1, "name": "Ada"}, {"id": 2, "name": "Bob"}], "tags": ["a", "b"]}) == "users[2]{id,name}:\n  1,Ada\n  2,Bob\ntags[2]: a,b"
    with pytest.raises(QueryError):
        X.from_toon("a[3]: 1,2")
    assert X.from_toon("a[3]: 1,2", strict=False) == {"a": [1, 2]}


@pytest.mark.parametrize(("text", "fmt"), [('{"a":1}', "json"), ("[1]", "json"), ("\x1e1", "json-seq"), ("a: 1", "toon"), ("[2]: 1,2", "toon"), ("- a\n- b", "yaml"), ("12", "json")])
def test_probe(text, fmt):
    assert X.probe(text) == fmt


def test_files(spark, tmp_path):
    from larkspur.operators import batches
    from larkspur.sources import read, write
    from larkspur.sources.readers import events, null_input, slurped
    from larkspur.sources.writers import exit_status, single

    (tmp_path / "a.jsonl").write_text('{"a":1.50}\n\n{"a":2}\nbad\n')
    got = read(spark, str(tmp_path / "a.jsonl"), "jsonl")
    assert [(r.value, r.error is None) for r in got.orderBy("in_ord").collect()] == [('{"a":1.50}', True), ('{"a":2}', True), (None, False)]
    good = got.where("error IS NULL")
    assert slurped(good).first()["value"] == '[{"a":1.50},{"a":2}]'
    assert events(good).count() == 4
    out = batches.run(good, ".a, .a + 1")
    assert [r.value for r in out.orderBy("in_ord", "res_ord").collect()] == ["1.50", "2.5", "2", "3"]
    for fmt in ("jsonl", "json-seq", "json", "toon-seq", "raw"):
        write(out, str(tmp_path / f"out-{fmt}"), fmt, order=("in_ord", "res_ord"))
    assert [r.value for r in read(spark, str(tmp_path / "out-jsonl"), "jsonl").orderBy("in_ord").collect()] == ["1.50", "2.5", "2", "3"]
    write(batches.run(good, "{a, b: \"x\"}"), str(tmp_path / "out-csv"), "csv", order=("in_ord",))
    rows = read(spark, str(tmp_path / "out-csv"), "csv").collect()
    assert [r.value for r in rows] == ['{"a":1.50,"b":"x"}', '{"a":2,"b":"x"}']
    assert single(batches.run(null_input(spark), "1 + 1")) == 2
    assert exit_status(batches.run(null_input(spark), "empty")) == 4 and exit_status(batches.run(null_input(spark), "null")) == 1
    kept = batches.run(good, '1, error("x")', errors="keep").orderBy("in_ord", "res_ord").collect()
    assert [(r.value, r.error) for r in kept] == [("1", None), (None, '"x"')] * 2


def test_sort_key_column(spark):
    from larkspur.operators.batches import sort_key

    values = ['{"a":1,"b":2}', "null", "[1]", '{"b":2,"a":1}', "1e0", '"x"', "true", "1"]
    df = spark.createDataFrame([(v,) for v in values], "value string").withColumn("k", sort_key(__import__("pyspark").sql.functions.col("value")))
    assert [r.value for r in df.orderBy("k", "value").collect()] == ["null", "true", "1", "1e0", '"x"', "[1]", '{"a":1,"b":2}', '{"b":2,"a":1}']
    assert df.groupBy("k").count().count() == 6


def test_streams(spark, tmp_path):
    from larkspur import streaming

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"k":"a","v":1}\n{"k":"b","v":5}\n{"k":"a","v":2}\n')
    source = spark.readStream.format("text").load(str(tmp_path / "in"))
    q = streaming.run(source, ".v * 2").writeStream.format("memory").queryName("doubled").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    q.awaitTermination(60)
    assert sorted(r[0] for r in spark.sql("select * from doubled").collect()) == ["10", "2", "4"]
    keyed = source.selectExpr("get_json_object(value, '$.k') AS k", "value")
    q = streaming.fold(keyed, "k", "0", ". + $x.v").writeStream.format("memory").queryName("folded").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start()
    q.awaitTermination(60)
    assert sorted((r.key, r.value) for r in spark.sql("select * from folded").collect()) == [("a", "1"), ("a", "3"), ("b", "5")]


def test_dumps_layout():
    assert dumps({"b": [1, {}], "a": "é"}, indent=2) == '{\n  "b": [\n    1,\n    {}\n  ],\n  "a": "é"\n}'
    assert dumps({"b": 1, "a": "é"}, sort_keys=True, ascii=True) == '{"a":"\\u00e9","b":1}'
    assert dumps([1], indent="\t") == "[\n\t1\n]"
