"""The command line: options, statuses, layouts."""

import io
import json

import pytest

from larkspur.cli import main


def run(*argv, text="", environ=None):
    out, err = io.StringIO(), io.StringIO()
    code = main(list(argv), io.BytesIO(text.encode()), out, err, environ or {})
    return code, out.getvalue(), err.getvalue()


def test_layouts():
    v = '{"b": [1, {"c": "é"}], "a": null}'
    assert run("-c", ".", text=v)[:2] == (0, '{"b":[1,{"c":"é"}],"a":null}\n')
    assert run("-cS", ".", text=v)[1] == '{"a":null,"b":[1,{"c":"é"}]}\n'
    assert run("-ca", ".b[1]", text=v)[1] == '{"c":"\\u00e9"}\n'
    assert run("--tab", ".b[1]", text=v)[1] == '{\n\t"c": "é"\n}\n'
    assert run("--indent", "3", ".b[1]", text=v)[1] == '{\n   "c": "é"\n}\n'
    assert run(".b[1]", text=v)[1] == "c: é\n"
    assert run("-o", "yaml", ".b[1]", text=v)[1].strip() == 'c: "é"'
    assert run("-o", "csv", ".[]", text='[{"x":1,"y":"a"},{"x":2,"y":"b"}]')[1].split() == ["x,y", "1,a", "2,b"]
    assert run("--unframed", "-c", ".a", text=v)[1] == "null"
    assert run("--unframed", ".a, .a", text=v)[0] == 5


def test_raw_outputs():
    assert run("-r", ".[]", text='["a b", 1]')[1] == "a b\n1\n"
    assert run("-j", ".[]", text='["a", 1, "b"]')[1] == "a1b"
    assert run("--raw-output0", ".[]", text='["a", "b"]')[1] == "a\0b\0"
    assert run("--raw-output0", ".", text='"a\\u0000"')[0] == 5


def test_inputs():
    assert run("-n", "-c", "-i", "json", "[inputs]", text="1 2 3")[1] == "[1,2,3]\n"
    assert run("-sci", "json", ".", text="1 2")[1] == "[1,2]\n"
    assert run("-Rc", ".", text="a\nb\n")[1] == '"a"\n"b"\n'
    assert run("-Rsc", ".", text="a\nb\n")[1] == '"a\\nb\\n"\n'
    assert run("-c", "--stream", ".", text='{"a":[1]}')[1] == '[["a",0],1]\n[["a",0]]\n[["a"]]\n'
    assert run("-c", "-ijson", "--stream-errors", ".", text='1 {"a"')[1].startswith("[[],1]\n[")
    assert run("--seq", "-c", ".a", text='\x1e{"a":1}\n')[1] == "\x1e1\n"
    assert run("-i", "toon", "-c", ".", text="a: 1\nb[2]: x,y\n")[1] == '{"a":1,"b":["x","y"]}\n'
    assert run("-c", "-i", "json", "[., input]", text="1 2 3 4")[1] == "[1,2]\n[3,4]\n"
    assert run("-c", ".", text="")[:2] == (0, "")


def test_arguments(tmp_path):
    (tmp_path / "v.json").write_text("1 [2]")
    (tmp_path / "q.jq").write_text("# a comment\n.x + $n")
    assert run("-nc", "[$a, $b, $c]", "--arg", "a", "1", "--argjson", "b", "[1]", "--argtoon", "c", "k: v")[1] == '["1",[1],{"k":"v"}]\n'
    assert run("-nc", "--slurpfile", "s", str(tmp_path / "v.json"), "--rawfile", "r", str(tmp_path / "v.json"), "[$s, $r]")[1] == '[[1,[2]],"1 [2]"]\n'
    assert run("-nc", "$ARGS", "--arg", "k", "v", "--args", "x", "y")[1] == '{"positional":["x","y"],"named":{"k":"v"}}\n'
    assert run("-nc", "$ARGS.positional", "--jsonargs", "1", "null")[1] == "[1,null]\n"
    assert run("-c", "-f", str(tmp_path / "q.jq"), "--argjson", "n", "2", text='{"x": 5}')[1] == "7\n"
    assert run("-nc", "--deny-files", "--rawfile", "r", str(tmp_path / "v.json"), "$r")[0] == 2
    (tmp_path / "m.jq").write_text("def twice: . * 2;")
    assert run("-c", "-L", str(tmp_path), 'import "m" as m; m::twice', text="4")[1] == "8\n"
    (tmp_path / "in.json").write_text('{"a": 3}')
    assert run("-c", ".a", str(tmp_path / "in.json"))[1] == "3\n" and run(".", str(tmp_path / "no.json"))[0] == 2


def test_statuses():
    assert run("-e", ".", text="null")[0] == 1 and run("-e", ".", text="1")[0] == 0 and run("-e", "empty", text="1")[0] == 4
    assert run(".a", text="1")[0] == 5 and run("nothing_of_that", text="1")[0] == 3 and run("--no-such", ".")[0] == 2
    assert run("-c", "-i", "json", ".a", text='1 {"a": 2}')[:2] == (5, "2\n")
    assert run('"bye" | halt_error(7)', text="1")[::2] == (7, "bye") and run("halt", text="1")[0] == 0


def test_proxy():
    assert run("-x", "-c", ".", "-i", "json", text="[invalid")[:2] == (0, "[invalid")
    assert run("-x", "-c", ".a", text='{"a":1}')[:2] == (0, "1\n")
    assert run("-x", "--stream-errors", ".")[0] == 2


def test_colors():
    plain = lambda s: __import__("re").sub("\x1b\\[[0-9;]*m", "", s)
    out = run("-C", "-c", ".", text='{"a":[1,"x",null,true,false,{}]}')[1]
    assert "\x1b[0;36m" in out and plain(out) == '{"a":[1,"x",null,true,false,{}]}\n'
    assert "\x1b[1;31m" in run("-Cc", ".", text="null", environ={"LARKSPUR_COLORS": "1;31"})[1]
    assert run("-CMc", ".", text="1")[1] == "1\n"


def test_reports(tmp_path):
    assert "pipe" in run("--explain", ".a | .b")[1]
    assert json.loads(run("--explain-json", ".a")[1])["query"] == ".a"
    run("-c", "--report-file", str(tmp_path / "r.json"), ".", "-i", "json", text="1 2")
    assert json.loads((tmp_path / "r.json").read_text())["results"] == 2
    assert "input 1" in run("--trace", ".", text="1")[2]
    assert run("--max-results", "2", "range(5)", text="1")[0] == 5 and run("--max-depth", "1", ".", text="[[[]]]")[0] == 5
    assert run("--max-input-bytes", "3", ".", text="12345")[0] == 5
    assert run("--help")[0] == 0 and run("-V")[1].startswith("larkspur")
    assert "csv" in run("--build-configuration")[1]


def test_run_tests(tmp_path):
    (tmp_path / "t").write_text('# ok\n.[0]\n[1, 2]\n1\n\n.[]\n[1,2]\n1\n2\n\n%%FAIL\nno_such\n\n{b: 1, a: 2}\nnull\n{"a":2,"b":1}\n')
    assert run("--run-tests", str(tmp_path / "t"))[:2] == (0, "4 of 4 tests passed\n")
    assert run("--run-tests", text=". + 1\n1\n3\n")[0] == 1


@pytest.mark.parametrize("query", ["env.HOME", "$ENV.HOME"])
def test_environment(query):
    assert run("-nc", query, environ={"HOME": "/h"})[1] == '"/h"\n'
    assert run("-nc", query, "--deny-environment", environ={"HOME": "/h"})[1] in ("null\n", "")
