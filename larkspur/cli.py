"""The command line: ``python -m larkspur [options] QUERY [FILE...]``.

Queries run on one machine, in the kernel, over files or standard input. Results are written as TOON unless an
option says otherwise. Statuses: 0; 1 with -e for a last result of false or null; 2 for wrong usage or an unreadable
file; 3 for a query that doesn't compile; 4 with -e without results; 5 for an error of the input or the query.
"""

from __future__ import annotations

import io
import json
import os
import sys
import time
from dataclasses import dataclass, field
from pathlib import Path

from larkspur.functions.values import QueryError, dumps, loads, sorted_keys
from larkspur.operators.kernel import Halt, Program
from larkspur.sources.text import DECODERS, ENCODERS, from_toon, probe

VERSION = "0.2"


class Usage(Exception):
    """A command line that can't be followed."""


@dataclass
class Options:
    query: str | None = None
    files: list[str] = field(default_factory=list)
    input: str = "auto"
    output: str = "toon"
    named: dict = field(default_factory=dict)
    positional: list = field(default_factory=list)
    roots: list[str] = field(default_factory=list)
    limits: dict[str, int] = field(default_factory=dict)
    on: set[str] = field(default_factory=set)
    indent: int | str | None = 2
    explain: str | None = None
    report: str | None = None
    tests: str | None = None
    color: bool | None = None


# Options without an argument, by what they turn on.
SWITCHES = {
    "-n": "null_input", "--null-input": "null_input", "-R": "raw_input", "--raw-input": "raw_input", "-s": "slurp", "--slurp": "slurp", "--stream": "stream", "--stream-errors": "stream_errors", "--seq": "seq",
    "-r": "raw", "--raw-output": "raw", "-j": "join", "--join-output": "join", "--raw-output0": "nul", "-a": "ascii", "--ascii-output": "ascii", "-S": "sort", "--sort-keys": "sort", "-e": "status", "--exit-status": "status",
    "-x": "proxy", "--proxy-on-error": "proxy", "--non-strict": "lax", "--strict-conversion": "strict", "--unframed": "single", "--unbuffered": "flush", "-b": "binary", "--binary": "binary", "--trace": "trace", "-h": "help", "--help": "help",
    "-V": "version", "--version": "version", "--build-configuration": "build", "--allow-environment": "environment", "--deny-environment": "no_environment", "--deny-files": "no_files", "--toon-sequence-input": "toon_seq",
}
#: Limits: what stops a query that yields, nests or reads too much.
LIMITS = {"--max-results", "--max-depth", "--max-input-bytes", "--max-output-bytes"}


def options(argv: list[str]) -> Options:
    o, plain, rest, kind = Options(), [], list(argv), None
    from_file = None

    def take(name: str) -> str:
        if not rest:
            raise Usage(f"{name} needs an argument")
        return rest.pop(0)

    def read_file(name: str) -> str:
        if "no_files" in o.on:
            raise Usage(f"reading {name} is denied")
        return Path(name).read_text("utf-8")

    while rest:
        arg = rest.pop(0)
        if arg == "--":
            plain += rest
            break
        if not arg.startswith("-") or arg == "-":
            if kind and (o.query is not None or from_file or plain):
                o.positional.append(loads(arg) if kind == "json" else arg)
            else:
                plain.append(arg)
            continue
        if len(arg) > 2 and arg[1] != "-" and not arg.startswith(("-L", "-f", "-i", "-o")):
            rest[:0] = [f"-{c}" for c in arg[1:]]
            continue
        if len(arg) > 2 and arg[:2] in ("-L", "-f", "-i", "-o"):
            rest.insert(0, arg[2:])
            arg = arg[:2]
        name, eq, value = arg.partition("=")
        if eq and name.startswith("--"):
            rest.insert(0, value)
            arg = name
        if arg in SWITCHES:
            o.on.add(SWITCHES[arg])
        elif arg in ("-f", "--from-file"):
            from_file = take(arg)
        elif arg in ("-L", "--library-path"):
            o.roots.append(take(arg))
        elif arg in ("-i", "--input-format"):
            o.input = take(arg)
        elif arg in ("-o", "--output-format"):
            o.output = take(arg)
        elif arg in ("-c", "--compact-output"):
            o.output, o.indent = ("json" if o.output == "toon" else o.output), None
            o.on.add("compact")
        elif arg == "--pretty-output":
            o.output = "json" if o.output == "toon" else o.output
            o.indent = 2
        elif arg == "--indent":
            n = int(take(arg))
            if not 0 <= n <= 7:
                raise Usage("--indent takes 0 to 7")
            o.output, o.indent = ("json" if o.output == "toon" else o.output), n or None
        elif arg == "--tab":
            o.output, o.indent = ("json" if o.output == "toon" else o.output), "\t"
        elif arg in ("-C", "--color-output", "-M", "--monochrome-output"):
            o.color = arg in ("-C", "--color-output")
        elif arg == "--arg":
            key = take(arg)
            o.named[key] = take(arg)
        elif arg in ("--argjson", "--argtoon"):
            key = take(arg)
            o.named[key] = (loads if arg == "--argjson" else from_toon)(take(arg))
        elif arg in ("--slurpfile", "--rawfile"):
            key = take(arg)
            text = read_file(take(arg))
            o.named[key] = text if arg == "--rawfile" else list(DECODERS["json"](text))
        elif arg in ("--args", "--jsonargs"):
            kind = "json" if arg == "--jsonargs" else "text"
        elif arg in ("--explain", "--explain-json"):
            o.explain = arg[2:]
        elif arg == "--report-file":
            o.report = take(arg)
        elif arg == "--run-tests":
            o.tests = take(arg) if rest and not (rest[0].startswith("-") and rest[0] != "-") else "-"
        elif arg in LIMITS:
            o.limits[arg[2:]] = int(take(arg))
        else:
            raise Usage(f"unknown option {arg}")
    if from_file:
        o.query, o.files = read_file(from_file), plain
    else:
        o.query, o.files = (plain[0], plain[1:]) if plain else (".", [])
    if "proxy" in o.on and "stream_errors" in o.on:
        raise Usage("--proxy-on-error cannot be used with --stream-errors")
    if "ascii" in o.on:
        o.output = "json" if o.output == "toon" else o.output
    if "seq" in o.on:
        o.input, o.output = "json-seq", "json-seq" if o.output.startswith("json") else "toon-seq"
    if "toon_seq" in o.on:
        o.input = "toon-seq"
    for fmt, known in ((o.input, {*DECODERS, "auto"}), (o.output, set(ENCODERS))):
        if fmt not in known:
            raise Usage(f"unknown format {fmt}")
    return o


# ---------------------------------------------------------------- inputs


def _path_events(v, o: Options):
    from larkspur.operators.kernel import Program

    return Program("tostream").run(v)


class Inputs:
    """The values of all sources in order; decoding errors rise where they are met."""

    def __init__(self, o: Options, stdin):
        self.o, self.stdin = o, stdin
        self.file: str | None = None

    def sources(self):
        for name in self.o.files or ["-"]:
            self.file = None if name == "-" else name
            data = self.stdin.read() if name == "-" else Path(name).read_bytes()
            data = data.encode("utf-8", "surrogateescape") if isinstance(data, str) else data
            most = self.o.limits.get("max-input-bytes")
            if most is not None and len(data) > most:
                raise QueryError(f"the input is over {most} bytes")
            yield data

    def decoded(self, data: bytes):
        o = self.o
        text = data.decode("utf-8").removeprefix("﻿")
        if "raw_input" in o.on:
            yield from DECODERS["raw"](text)
            return
        fmt = probe(text) if o.input == "auto" else o.input
        if not text.strip():
            return
        if fmt == "toon":
            values = iter((from_toon(text, "lax" not in o.on),))
        else:
            values = DECODERS[fmt](text)
        if "stream" in o.on or "stream_errors" in o.on:
            try:
                for v in values:
                    yield from _path_events(v, o)
            except QueryError as e:
                if "stream_errors" not in o.on:
                    raise
                yield [str(e), []]
        else:
            yield from values

    def __iter__(self):
        if {"raw_input", "slurp"} <= self.o.on:
            yield "".join(d.decode("utf-8") for d in self.sources())
        elif "slurp" in self.o.on:
            yield [v for d in self.sources() for v in self.decoded(d)]
        else:
            for d in self.sources():
                yield from self.decoded(d)


# ---------------------------------------------------------------- output

# Styles of null, false, true, numbers, strings, arrays, objects, keys.
STYLES = "0;39:0;94:0;94:0;35:0;32:0;90:0;90:0;36"


def styles(environ) -> list[str]:
    """The palette of the environment, or the default where it isn't one."""
    for name in ("LARKSPUR_COLORS", "JQ_COLORS"):
        given = environ.get(name)
        if given and all(part.replace(";", "").isdigit() or not part for part in given.split(":")):
            parts = given.split(":")[:8]
            default = STYLES.split(":")
            merged = parts + default[len(parts) :]
            return merged if len(parts) > 7 else [*merged[:7], merged[3] if len(parts) == 7 else default[7]]
    return STYLES.split(":")


def colored(v, palette: list[str], indent, ascii: bool, level: int = 0) -> str:
    """JSON text with ANSI styles."""
    paint = lambda i, s: f"\x1b[{palette[i]}m{s}\x1b[0m"
    if isinstance(v, list | dict) and v:
        i = 5 if isinstance(v, list) else 6
        unit = " " * indent if isinstance(indent, int) else indent
        new, old = ("\n" + unit * (level + 1), "\n" + unit * level) if unit else ("", "")
        items = [colored(x, palette, indent, ascii, level + 1) for x in (v if i == 5 else v.values())]
        if i == 6:
            items = [paint(7, dumps(k, ascii=ascii)) + paint(6, ": " if unit else ":") + x for k, x in zip(v, items, strict=True)]
        return paint(i, "[{"[i - 5]) + paint(i, ",").join(new + x for x in items) + old + paint(i, "]}"[i - 5])
    at = 0 if v is None else 1 if v is False else 2 if v is True else 4 if isinstance(v, str) else 5 if isinstance(v, list) else 6 if isinstance(v, dict) else 3
    return paint(at, dumps(v, ascii=ascii))


def sorted_deep(v):
    if isinstance(v, list):
        return [sorted_deep(x) for x in v]
    return {k: sorted_deep(v[k]) for k in sorted_keys(v)} if isinstance(v, dict) else v


def depth(v) -> int:
    return 1 + max(map(depth, v if isinstance(v, list) else v.values()), default=0) if isinstance(v, list | dict) else 0


class Output:
    def __init__(self, o: Options, out, environ):
        self.o, self.out = o, out
        self.count, self.size, self.last, self.held = 0, 0, None, []
        auto = getattr(out, "isatty", lambda: False)() and "NO_COLOR" not in environ
        self.palette = styles(environ) if (o.color if o.color is not None else auto) else None

    def text(self, v) -> str:
        o = self.o
        if {"raw", "join", "nul"} & o.on:
            end = "" if "join" in o.on else "\0" if "nul" in o.on else "\n"
            if isinstance(v, str):
                if "nul" in o.on and "\0" in v:
                    raise QueryError("a string with NUL can't be written between NULs")
                return v + end
            return (colored(v, self.palette, None, "ascii" in o.on) if self.palette else dumps(v, ascii="ascii" in o.on)) + end
        if o.output == "json" and self.palette:
            return colored(v, self.palette, o.indent, "ascii" in o.on) + "\n"
        if o.output == "json":
            return dumps(v, o.indent, False, "ascii" in o.on) + "\n"
        return ENCODERS[o.output]([v])

    def add(self, v) -> None:
        v = sorted_deep(v) if "sort" in self.o.on else v
        self.count, self.last = self.count + 1, v
        if self.count > self.o.limits.get("max-results", self.count):
            raise QueryError(f"more than {self.o.limits['max-results']} results")
        if "max-depth" in self.o.limits and depth(v) > self.o.limits["max-depth"]:
            raise QueryError(f"a result nests deeper than {self.o.limits['max-depth']}")
        # documents of one root, and tables, are written at the end
        if "single" in self.o.on or self.o.output in ("csv", "tsv"):
            self.held.append(v)
        else:
            self.write(("---\n" if self.o.output in ("yaml", "yml") and self.count > 1 else "") + self.text(v))

    def write(self, text: str) -> None:
        self.size += len(text.encode("utf-8", "surrogatepass"))
        if self.size > self.o.limits.get("max-output-bytes", self.size):
            raise QueryError(f"the output is over {self.o.limits['max-output-bytes']} bytes")
        self.out.write(text)
        if "flush" in self.o.on:
            self.out.flush()

    def close(self) -> None:
        if "single" in self.o.on:
            if len(self.held) != 1:
                raise QueryError(f"exactly one result is needed, not {len(self.held)}")
            self.write(self.text(self.held[0]).removesuffix("\n"))
        elif self.held:
            self.write(ENCODERS[self.o.output](self.held))


# ---------------------------------------------------------------- commands


def compiled(o: Options, environ) -> Program:
    from larkspur.plans.modules import folder_loader

    variables = {**o.named, "ARGS": {"positional": o.positional, "named": o.named}}
    if "no_environment" not in o.on:
        variables["ENV"] = dict(environ)
    return Program(o.query, variables, folder_loader(*o.roots) if o.roots else None)


def explain(o: Options, program: Program) -> str:
    """The syntax tree, and whether a table query of it would be planned without Python."""

    def lines(e, level=0):
        if isinstance(e, tuple) and e and isinstance(e[0], str):
            simple = [repr(x) for x in e[1:] if not isinstance(x, tuple | list)]
            yield "  " * level + " ".join([e[0], *simple])
            for x in e[1:]:
                yield from lines(x, level + 1)
        elif isinstance(e, tuple | list):
            for x in e:
                yield from lines(x, level)

    if o.explain == "explain-json":
        return json.dumps({"query": o.query, "input": o.input, "output": o.output, "tree": program.tree}, default=str) + "\n"
    return f"input {o.input}, output {o.output}\n" + "\n".join(lines(program.tree)) + "\n"


def run_tests(text: str, out) -> int:
    """Tests in blocks: a query, an input, and the results a line each. %%FAIL expects a query that doesn't compile."""
    passed = failed = 0
    for block in text.replace("\r", "").split("\n\n"):
        rows = [r for r in block.split("\n") if r and not r.startswith("#")]
        if not rows:
            continue
        try:
            if rows[0].startswith("%%FAIL"):
                try:
                    Program(rows[1])
                    ok = False
                except (LookupError, ValueError, SyntaxError, QueryError):
                    ok = True
            else:
                got = [dumps(sorted_deep(v)) for v in Program(rows[0]).run(loads(rows[1]))]
                ok = got == [dumps(sorted_deep(loads(r))) for r in rows[2:]]
        except Exception as e:  # a test that fails in any way has failed
            ok = False
            out.write(f"{rows[0]}: {e}\n")
        passed, failed = passed + ok, failed + (not ok)
        if not ok:
            out.write(f"failed: {rows[0]}\n")
    out.write(f"{passed} of {passed + failed} tests passed\n")
    return int(failed > 0)


def main(argv: list[str] | None = None, stdin=None, stdout=None, stderr=None, environ=None) -> int:
    stdin = sys.stdin.buffer if stdin is None else stdin
    stdout = stdout or io.TextIOWrapper(sys.stdout.buffer, "utf-8", errors="surrogatepass", newline="", write_through=True)
    stderr, environ = stderr or sys.stderr, os.environ if environ is None else environ
    began = time.perf_counter()
    try:
        o = options(sys.argv[1:] if argv is None else argv)
    except (Usage, QueryError, OSError, ValueError) as e:
        stderr.write(f"larkspur: {e}\n")
        return 2
    if "help" in o.on:
        stdout.write(__doc__ + "\nOptions: " + " ".join(sorted({*SWITCHES, *LIMITS})) + "\n")
        return 0
    if "version" in o.on or "build" in o.on:
        stdout.write(f"larkspur {VERSION}\n" + ("formats: " + " ".join(sorted(DECODERS)) + "\n" if "build" in o.on else ""))
        return 0
    if o.tests is not None:
        text = stdin.read() if o.tests == "-" else Path(o.tests).read_bytes()
        return run_tests(text.decode() if isinstance(text, bytes) else text, stdout)
    try:
        program = compiled(o, environ)
    except (LookupError, ValueError, SyntaxError, QueryError, OSError) as e:
        stderr.write(f"larkspur: {e}\n")
        return 3
    if o.explain:
        stdout.write(explain(o, program))
        return 0
    inputs, output, status = Inputs(o, stdin), Output(o, stdout, environ), 0
    special = {"debug": lambda v: stderr.write(dumps(["DEBUG:", v]) + "\n"), "env": {} if "no_environment" in o.on else dict(environ)}

    def feed(values) -> int:
        """Results of each value; an error of one value doesn't stop the next."""
        failed = 0
        it = iter(values)
        for v in it:
            if "trace" in o.on:
                stderr.write(f"input {dumps(v)[:200]}\n")
            try:
                for r in program.run(v, inputs=it, file=inputs.file, **special):
                    output.add(r)
            except QueryError as e:
                stderr.write(f"larkspur: error: {e}\n")
                failed = 5
        return failed

    try:
        if "null_input" in o.on:
            for r in program.run(None, inputs=iter(inputs), file=None, **special):
                output.add(r)
        elif "proxy" in o.on:
            sources = list(inputs.sources())
            sources = [sources] if "slurp" in o.on else [[s] for s in sources]
            for group in sources:
                try:
                    values = [v for d in group for v in inputs.decoded(d)]
                except (QueryError, UnicodeDecodeError):
                    for d in group:
                        output.write(d.decode("utf-8", "surrogateescape"))
                    continue
                status = max(status, feed([values] if "slurp" in o.on else values))
        else:
            status = feed(inputs)
        output.close()
    except Halt as h:
        value, code, silent = h.args
        if not silent:
            stderr.write(value if isinstance(value, str) else dumps(value) + "\n")
        return code
    except (QueryError, UnicodeDecodeError) as e:
        stderr.write(f"larkspur: error: {e}\n")
        status = 5
    except OSError as e:
        stderr.write(f"larkspur: {e}\n")
        status = 2
    if o.report:
        Path(o.report).write_text(json.dumps({"results": output.count, "bytes": output.size, "seconds": round(time.perf_counter() - began, 6), "status": status}) + "\n")
    if status == 0 and "status" in o.on:
        return 4 if not output.count else int(output.last is None or output.last is False)
    return status
