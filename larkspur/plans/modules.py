"""Modules: import, include, data imports, and modulemeta.

A loader is a callable from (path, suffix) to text, or None where there is none. Imported filters are
renamed ``name::filter`` and put before the query as definitions; data become variables.
"""

from __future__ import annotations

from pathlib import Path

from larkspur.functions.values import loads
from larkspur.plans.syntax import QuerySyntaxError, parse_program


def folder_loader(*folders: str):
    """A loader that looks for path.jq, path/name.jq and path.json in folders, in their order."""

    def load(path: str, suffix: str) -> str | None:
        for folder in folders:
            for p in (Path(folder, path + suffix), Path(folder, path, Path(path).name + suffix)):
                if p.is_file():
                    return p.read_text()
        return None

    return load


def _value(e):
    """A constant tree as a value."""
    if e[0] == "lit":
        return e[1]
    if e[0] == "str" and len(e[2]) == 1:
        return e[2][0]
    if e[0] == "array":
        return [] if e[1] is None else [_value(x) for x in _commas(e[1])]
    if e[0] == "object":
        return {_value(k): _value(v) for k, v in e[1]}
    raise QuerySyntaxError("module metadata must be constant")


def _commas(e):
    return [*_commas(e[1]), *_commas(e[2])] if e[0] == "comma" else [e]


def _renamed(e, names: dict[str, str]):
    """The tree with calls renamed."""
    if not isinstance(e, tuple) or not e or not isinstance(e[0], str):
        return e
    if e[0] == "call":
        return ("call", names.get(f"{e[1]}/{len(e[2])}", e[1]), [_renamed(a, names) for a in e[2]])
    if e[0] == "def":
        inner = {k: v for k, v in names.items() if k != f"{e[1]}/{len(e[2])}"}
        body = {k: v for k, v in inner.items() if k not in {f"{p}/0" for p in e[2]}}
        return ("def", e[1], e[2], _renamed(e[3], body), _renamed(e[4], inner))

    def deep(x):
        if isinstance(x, tuple):
            return _renamed(x, names) if x and isinstance(x[0], str) else tuple(map(deep, x))
        return [deep(y) for y in x] if isinstance(x, list) else x

    return tuple([e[0], *map(deep, e[1:])]) if e[0] != "lit" else e


def _load(path, loader, seen):
    if path in seen:
        raise QuerySyntaxError(f"module {path} imports itself")
    text = loader(path, ".jq")
    if text is None:
        raise QuerySyntaxError(f"module {path} not found")
    meta, imports, defs, body = parse_program(text)
    if body is not None:
        raise QuerySyntaxError(f"module {path} has a body")
    return _resolve(imports, defs, loader, (*seen, path))


def _resolve(imports, defs, loader, seen):
    """(definitions with those of the imports before them, data variables)."""
    out, data = [], []
    for kind, path, name, _ in imports:
        if kind == "import" and name.startswith("$"):
            text = loader(path, ".json")
            if text is None:
                raise QuerySyntaxError(f"data {path} not found")
            from larkspur.sources.text import json_roots

            values = list(json_roots(text))
            data += [(name[1:], values), (f"{name[1:]}::{name[1:]}", values)]
            continue
        inner, more = _load(path, loader, seen)
        data += more
        if kind == "include":
            out += inner
        else:
            names = {f"{n}/{len(p)}": f"{name}::{n}" for n, p, _ in inner}
            out += [(f"{name}::{n}", p, _renamed(b, {k: v for k, v in names.items() if k not in {f"{q}/0" for q in p}})) for n, p, b in inner]
    return [*out, *defs], data


def link(text: str, loader):
    """The tree of a query with what it imports."""
    _, imports, defs, body = parse_program(text)
    defs, data = _resolve(imports, defs, loader, ())
    e = body or ("id",)
    for n, p, b in reversed(defs):
        e = ("def", n, p, b, e)
    for name, values in reversed(data):
        e = ("as", ("lit", values), [("pvar", name)], e)
    return e


def metadata(text: str) -> dict:
    """What ``modulemeta`` says of a module's text."""
    meta, imports, defs, _ = parse_program(text)
    out = dict(_value(meta)) if meta else {}
    out["deps"] = [{**(_value(about) if about else {}), **({"as": name.lstrip("$")} if name else {}), "is_data": bool(name and name.startswith("$")), "relpath": path} for _, path, name, about in imports]
    out["defs"] = [f"{n}/{len(p)}" for n, p, _ in defs]
    return out


__all__ = ["folder_loader", "link", "loads", "metadata"]
