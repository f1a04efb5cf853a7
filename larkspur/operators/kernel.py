"""The kernel: evaluates any query on one value, as an ordered stream of results.

A syntax tree is compiled into closures. Each takes an environment and a (path, value) pair and yields such
pairs; the path is None where nobody asks for it. The environment is a dict that is copied when something is
bound: ``$name`` for variables, ``name/arity`` for functions and closure parameters.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

from larkspur.functions import builtins as B
from larkspur.functions.values import QueryError, compare, copied, dumps, kind, shown, truthy
from larkspur.plans.syntax import parse, parse_program

sys.setrecursionlimit(max(sys.getrecursionlimit(), 20_000))


class Break(Exception):
    def __init__(self, mark):
        self.mark = mark


class Function:
    """A defined filter, or a closure passed as an argument (no parameters, own environment)."""

    __slots__ = ("body", "env", "name", "params")

    def __init__(self, params, body, env, name=None):
        self.params, self.body, self.env, self.name = params, body, env, name


# ---------------------------------------------------------------- access


def lookup(v, k):
    """v[k]: null where absent."""
    if isinstance(k, str) and not isinstance(v, list) and (v is None or isinstance(v, dict)):
        return None if v is None else v.get(k)
    if B.is_number(k) and (v is None or isinstance(v, list)):
        if v is None or k != k:
            return None
        i = int(k // 1)
        i = i + len(v) if i < 0 else i
        return v[i] if 0 <= i < len(v) else None
    if isinstance(k, dict) and (v is None or isinstance(v, (list, str))):
        if v is None:
            return None
        lo, hi = bounds(len(v), k.get("start"), k.get("end"))
        return v[lo:hi]
    if isinstance(k, list) and isinstance(v, list):
        return B.indices(v, k)
    if v is None and k is None:
        return None
    if isinstance(v, dict) or (isinstance(k, str) and not isinstance(v, list)):
        raise QueryError(f"Cannot index {kind(v)} with " + (f'"{k}"' if isinstance(k, str) else kind(k)))
    raise QueryError(f"Cannot index {kind(v)} with " + (f'"{k}"' if isinstance(k, str) else kind(k)))


def bounds(n: int, start, end) -> tuple[int, int]:
    import math

    for x in (start, end):
        if x is not None and not B.is_number(x):
            raise QueryError("Start and end indices of an array slice must be numbers")
    lo = 0 if start is None or start != start else math.floor(start)
    hi = n if end is None or end != end else math.ceil(end)
    lo, hi = (lo + n if lo < 0 else lo), (hi + n if hi < 0 else hi)
    lo = min(max(lo, 0), n)
    return lo, min(max(hi, lo), n)


def get_path(v, path):
    for k in path:
        if v is None:
            return None
        v = lookup(v, k)
    return v


def set_path(v, path, x):
    return update(v, path, lambda _: x)


def update(v, path, f):
    if not path:
        return f(v)
    k, rest = path[0], path[1:]
    if isinstance(k, str):
        if v is not None and not isinstance(v, dict):
            lookup(v, k)
        out = {} if v is None else dict(v)
        out[k] = update(out.get(k), rest, f)
        return out
    if B.is_number(k):
        if v is not None and not isinstance(v, list):
            lookup(v, k)
        out = [] if v is None else list(v)
        i = int(k // 1) if k == k else 0
        if i < 0:
            i += len(out)
            if i < 0:
                raise QueryError("Out of bounds negative array index")
        if i > 1 << 29:
            raise QueryError("Array index too large")
        new = update(out[i] if i < len(out) else None, rest, f)
        out += [None] * (i + 1 - len(out))
        out[i] = new
        return out
    if isinstance(k, dict):
        if v is not None and not isinstance(v, list):
            raise QueryError(f"Cannot update field at object index of {kind(v)}")
        out = [] if v is None else list(v)
        lo, hi = bounds(len(out), k.get("start"), k.get("end"))
        new = update(out[lo:hi], rest, f)
        if not isinstance(new, list):
            raise QueryError("A slice of an array can only be assigned another array")
        out[lo:hi] = new
        return out
    if isinstance(v, list) and isinstance(k, list):
        raise QueryError("Cannot update field at array index of array")
    raise QueryError(f"Invalid path component {shown(k)}" if v is None else f"Cannot index {kind(v)} with {kind(k)}")


def delete_paths(v, paths):
    for p in sorted(paths, key=B.order_key, reverse=True):
        v = _delete(v, p)
    return v


def _delete(v, path):
    if v is None:
        return None
    if not path:
        return None
    k, rest = path[0], path[1:]
    if rest:
        child = lookup(v, k)
        return v if child is None else set_path(v, [k], _delete(child, rest))
    if isinstance(v, dict) and isinstance(k, str):
        return {a: b for a, b in v.items() if a != k}
    if isinstance(v, list) and B.is_number(k):
        i = int(k // 1)
        i = i + len(v) if i < 0 else i
        return v[:i] + v[i + 1 :] if 0 <= i < len(v) else v
    if isinstance(v, list) and isinstance(k, dict):
        lo, hi = bounds(len(v), k.get("start"), k.get("end"))
        return v[:lo] + v[hi:]
    raise QueryError(f"Cannot delete field at {'object' if isinstance(k, str) else 'array'} index of {kind(v)}")


def _add_key(path, k):
    return None if path is None else (*path, k)


# ---------------------------------------------------------------- compilation


def compile_tree(e):
    return _COMPILE[e[0]](e)


def _id(e):
    def run(env, pv):
        yield pv

    return run


def _lit(e):
    v = e[1]

    def run(env, pv):
        yield (_off(pv), v)

    return run


class _Off:
    """In a path expression: a value that is no part of the input."""

    __slots__ = ("value",)

    def __init__(self, value=None):
        self.value = value


_NONE = _Off()


def _off(pv):
    return None if pv[0] is None else _NONE


def _need_path(pv, doing: str = "access element"):
    if isinstance(pv[0], _Off):
        raise QueryError(f"Invalid path expression with result {B.cut(dumps(pv[1]))}" if doing is None else f"Invalid path expression near attempt to {doing} of {B.cut(dumps(pv[1]))}")


def _index(e):
    term, key = compile_tree(e[1]), compile_tree(e[2])

    def run(env, pv):
        for t in term(env, pv):
            for _, k in key(env, (None, pv[1])):
                if t[0] is not None:
                    _need_path(t, f"access element {B.cut(dumps(k))}")
                yield _add_key(t[0], k), lookup(t[1], k)

    return run


def _slice(e):
    term = compile_tree(e[1])
    lo = compile_tree(e[2]) if e[2] else _lit(("lit", None))
    hi = compile_tree(e[3]) if e[3] else _lit(("lit", None))

    def run(env, pv):
        for t in term(env, pv):
            for _, b in hi(env, (None, pv[1])):
                for _, a in lo(env, (None, pv[1])):
                    if t[0] is not None:
                        _need_path(t)
                    if t[1] is not None and not isinstance(t[1], (list, str)):
                        raise QueryError(f"Cannot index {kind(t[1])} with object")
                    k = {"start": a, "end": b}
                    if t[1] is None:
                        bounds(0, a, b)
                    yield _add_key(t[0], k), lookup(t[1], k)

    return run


def children(pv):
    p, v = pv
    if p is not None:
        _need_path(pv, "iterate through")
    if isinstance(v, list):
        for i, x in enumerate(v):
            yield _add_key(p, i), x
    elif isinstance(v, dict):
        for k, x in list(v.items()):
            yield _add_key(p, k), x
    else:
        raise QueryError(f"Cannot iterate over {shown(v) if v is not None else 'null'}")


def _iter(e):
    term = compile_tree(e[1])

    def run(env, pv):
        for t in term(env, pv):
            yield from children(t)

    return run


def _try(e):
    body, handler = compile_tree(e[1]), compile_tree(e[2]) if e[2] else None

    def run(env, pv):
        results = body(env, pv)
        while True:
            try:
                r = next(results)
            except StopIteration:
                return
            except QueryError as x:
                if isinstance(x.value, dict) and x.value.get("__jq") == 0 and handler is None:
                    return
                if handler is not None:
                    yield from handler(env, (_off(pv), x.value))
                return
            yield r

    return run


def _pipe(e):
    a, b = compile_tree(e[1]), compile_tree(e[2])

    def run(env, pv):
        for x in a(env, pv):
            yield from b(env, x)

    return run


def _comma(e):
    a, b = compile_tree(e[1]), compile_tree(e[2])

    def run(env, pv):
        yield from a(env, pv)
        yield from b(env, pv)

    return run


def _values(f, env, pv) -> Iterator:
    return (v for _, v in f(env, (None, pv[1])))


def _array(e):
    body = compile_tree(e[1]) if e[1] else None

    def run(env, pv):
        yield _off(pv), ([] if body is None else list(_values(body, env, pv)))

    return run


def _object(e):
    items = [(compile_tree(k), compile_tree(v)) for k, v in e[1]]

    def build(env, pv, i, made):
        if i == len(items):
            yield dict(made)
            return
        kf, vf = items[i]
        for k in _values(kf, env, pv):
            if not isinstance(k, str):
                raise QueryError(f"Object keys must be strings" if not B.is_number(k) else f"Object keys must be strings")
            for v in _values(vf, env, pv):
                yield from build(env, pv, i + 1, {**made, k: v})

    def run(env, pv):
        for o in build(env, pv, 0, {}):
            yield _off(pv), o

    return run


def _str(e):
    fmt, parts = e[1], e[2]
    if len(parts) == 1:
        return _lit(("lit", parts[0]))
    compiled = [p if isinstance(p, str) else compile_tree(p) for p in parts]
    render = B.formatter(fmt or "@text")

    def build(env, pv, i, text):
        if i == len(compiled):
            yield text
        elif isinstance(compiled[i], str):
            yield from build(env, pv, i + 1, text + compiled[i])
        else:
            for v in _values(compiled[i], env, pv):
                yield from build(env, pv, i + 1, text + render(v))

    def run(env, pv):
        for s in build(env, pv, 0, ""):
            yield _off(pv), s

    return run


def _neg(e):
    body = compile_tree(e[1])

    def run(env, pv):
        for v in _values(body, env, pv):
            yield _off(pv), B.negate(v)

    return run


def _bin(e):
    op, a, b = B.OPERATORS[e[1]], compile_tree(e[2]), compile_tree(e[3])

    def run(env, pv):
        for y in _values(b, env, pv):
            for x in _values(a, env, pv):
                yield _off(pv), op(x, y)

    return run


def _and(e):
    a, b = compile_tree(e[2]), compile_tree(e[3])
    stop = e[0] == "or"

    def run(env, pv):
        for x in _values(a, env, pv):
            if truthy(x) == stop:
                yield _off(pv), stop
            else:
                for y in _values(b, env, pv):
                    yield _off(pv), truthy(y)

    return run


def _alt(e):
    a, b = compile_tree(e[2]), compile_tree(e[3])

    def run(env, pv):
        found = False
        results = a(env, pv)
        while True:
            try:
                r = next(results)
            except (StopIteration, QueryError):
                break
            if truthy(r[1]):
                found = True
                yield r
        if not found:
            yield from b(env, pv)

    return run


def _if(e):
    c, a, b = (compile_tree(x) for x in e[1:])

    def run(env, pv):
        for x in _values(c, env, pv):
            yield from (a if truthy(x) else b)(env, pv)

    return run


def paths_of(f, env, v):
    for p, x in f(env, ((), v)):
        if isinstance(p, _Off):
            raise QueryError(f"Invalid path expression with result {B.cut(dumps(x))}")
        yield p, x


def _assign(e):
    op, left, right = e[1], compile_tree(e[2]), compile_tree(e[3])

    def run(env, pv):
        v = pv[1]
        if op == "|=":
            out, gone = v, []
            for p, _ in paths_of(left, env, v):
                for new in _values(right, env, (None, get_path(out, p))):
                    out = set_path(out, p, new)
                    break
                else:
                    gone.append(list(p))
            yield _off(pv), delete_paths(out, gone)
            return
        for x in _values(right, env, pv):
            out = v
            for p, _ in paths_of(left, env, v):
                if op == "=":
                    out = set_path(out, p, x)
                elif op == "//=":
                    out = update(out, p, lambda old: old if truthy(old) else x)
                else:
                    out = update(out, p, lambda old: B.OPERATORS[op[0]](old, x))
            yield _off(pv), out

    return run


def _names(pattern) -> set[str]:
    if pattern[0] == "pvar":
        return {pattern[1]}
    if pattern[0] == "parr":
        return set().union(*map(_names, pattern[1]))
    out: set[str] = set()
    for _, name, inner in pattern[1]:
        out |= ({name} if name else set()) | (_names(inner) if inner else set())
    return out


def _binder(pattern):
    """f(env, value) yields environments."""
    if pattern[0] == "pvar":
        name = "$" + pattern[1]

        def one(env, v):
            yield {**env, name: v}

        return one
    if pattern[0] == "parr":
        inner = [_binder(p) for p in pattern[1]]

        def array(env, v, i=0):
            if v is not None and not isinstance(v, list):
                raise QueryError(f"Cannot index {kind(v)} with number")
            if i == len(inner):
                yield env
                return
            for env2 in inner[i](env, lookup(v, i)):
                yield from array(env2, v, i + 1)

        return array
    items = [(compile_tree(k), name, _binder(p) if p else None) for k, name, p in pattern[1]]

    def obj(env, v, i=0):
        if i == len(items):
            yield env
            return
        key, name, inner = items[i]
        for _, k in key(env, (None, v)):
            if not isinstance(k, str):
                raise QueryError(f"Cannot index {kind(v)} with {kind(k)}")
            x = lookup(v, k)
            env2 = {**env, "$" + name: x} if name else env
            for env3 in inner(env2, x) if inner else (env2,):
                yield from obj(env3, v, i + 1)

    return obj


def _bind_all(pats):
    binders = [_binder(p) for p in pats]
    every = {"$" + n: None for p in pats for n in _names(p)} if len(pats) > 1 else {}
    return binders, every


def _as(e):
    src, body = compile_tree(e[1]), compile_tree(e[3])
    binders, every = _bind_all(e[2])

    def run(env, pv):
        for v in _values(src, env, pv):
            for i, bind in enumerate(binders):
                try:
                    for env2 in bind({**env, **every}, v):
                        yield from body(env2, pv)
                    break
                except QueryError:
                    if i + 1 == len(binders):
                        raise

    return run


def _fold(e):
    foreach = e[0] == "foreach"
    src, init, step = compile_tree(e[1]), compile_tree(e[3]), compile_tree(e[4])
    extract = compile_tree(e[5]) if foreach and e[5] else None
    binders, every = _bind_all(e[2])

    def bound(env, v):
        for i, bind in enumerate(binders):
            try:
                yield from bind({**env, **every}, v)
                return
            except QueryError:
                if i + 1 == len(binders):
                    raise

    def run(env, pv):
        for start in init(env, pv):
            state = start
            for v in _values(src, env, pv):
                for env2 in bound(env, v):
                    new = None
                    for new in step(env2, state):
                        if foreach:
                            if extract:
                                yield from extract(env2, new)
                            else:
                                yield new
                    if new is not None:
                        state = new
                    elif not foreach:
                        state = (_off(pv), None)
            if not foreach:
                yield state

    return run


def _def(e):
    _, name, params, body, rest = e
    body, rest = compile_tree(body), compile_tree(rest)
    key = f"{name}/{len(params)}"

    def run(env, pv):
        yield from rest({**env, key: Function(params, body, env, key)}, pv)

    return run


def call(f: Function, env, args, pv):
    """Apply a defined filter to argument closures."""
    own = {**f.env, f.name: f} if f.name else f.env
    if not args:
        return f.body(own, pv)
    return _apply(f, own, env, args, pv, 0)


def _apply(f, own, env, args, pv, i):
    if i == len(args):
        yield from f.body(own, pv)
        return
    p = f.params[i]
    if p.startswith("$"):
        for v in _values(args[i], env, pv):
            yield from _apply(f, {**own, p: v, f"{p[1:]}/0": Function((), _lit(("lit", v)), {})}, env, args, pv, i + 1)
    else:
        yield from _apply(f, {**own, f"{p}/0": Function((), args[i], env)}, env, args, pv, i + 1)


def _call(e):
    name, args = e[1], [compile_tree(a) for a in e[2]]
    key = f"{name}/{len(args)}"
    native, plain = NATIVE.get(key), B.PLAIN.get(key)

    def run(env, pv):
        f = env.get(key)
        if f is not None:
            yield from call(f, env, args, pv)
        elif native is not None:
            yield from native(env, pv, *args)
        elif plain is not None:
            if not args:
                yield _off(pv), plain(pv[1])
            else:
                yield from _product(plain, args, env, pv)
        elif (f := prelude().get(key)) is not None:
            yield from call(f, env, args, pv)
        else:
            raise LookupError(f"{key} is not defined")

    return run


def _product(plain, args, env, pv):
    def build(i, got):
        if i < 0:
            yield _off(pv), plain(pv[1], *got)
            return
        for v in _values(args[i], env, pv):
            yield from build(i - 1, (v, *got))

    yield from build(len(args) - 1, ())


def _var(e):
    name = "$" + e[1]

    def run(env, pv):
        if name in env:
            yield _off(pv), env[name]
        elif name == "$ENV":
            yield _off(pv), env.get("__env", {})
        else:
            raise LookupError(f"{name} is not defined")

    return run


def _label(e):
    name, body = "*" + e[1], compile_tree(e[2])

    def run(env, pv):
        mark = object()
        try:
            yield from body({**env, name: mark}, pv)
        except Break as b:
            if b.mark is not mark:
                raise

    return run


def _break(e):
    name = "*" + e[1]

    def run(env, pv):
        if name not in env:
            raise LookupError(f"$*label-{e[1]} is not defined")
        raise Break(env[name])
        yield

    return run


_COMPILE = {
    "id": _id, "lit": _lit, "index": _index, "slice": _slice, "iter": _iter, "try": _try, "pipe": _pipe, "comma": _comma, "array": _array,
    "object": _object, "str": _str, "neg": _neg, "bin": _bin, "and": _and, "or": _and, "alt": _alt, "if": _if, "assign": _assign, "as": _as,
    "reduce": _fold, "foreach": _fold, "def": _def, "call": _call, "var": _var, "label": _label, "break": _break,
}


# ---------------------------------------------------------------- built-ins that see streams, paths or the environment


def _empty(env, pv):
    return iter(())


def _error(env, pv, message=None):
    if message is None:
        raise QueryError(pv[1])
    for v in _values(message, env, pv):
        raise QueryError(v)
    yield from ()


def _select(env, pv, cond):
    for v in _values(cond, env, pv):
        if truthy(v):
            yield pv


def _recurse(env, pv, step=None, cond=None):
    stack = [iter((pv,))]
    while stack:
        try:
            x = next(stack[-1])
        except StopIteration:
            stack.pop()
            continue
        yield x
        if step is None:
            if isinstance(x[1], (list, dict)):
                stack.append(children(x))
        elif cond is None:
            stack.append(step(env, x))
        else:
            stack.append(y for y in step(env, x) for ok in _values(cond, env, y) if truthy(ok))


def _path(env, pv, f):
    for p, _ in paths_of(f, env, pv[1]):
        yield _off(pv), list(p)


def _getpath(env, pv, f):
    for p in _values(f, env, pv):
        if not isinstance(p, list):
            raise QueryError("Path must be specified as an array")
        if pv[0] is not None:
            _need_path(pv)
            yield (*pv[0], *p), get_path(pv[1], p)
        else:
            yield None, get_path(pv[1], p)


def _setpath(env, pv, where, what):
    for x in _values(what, env, pv):
        for p in _values(where, env, pv):
            if not isinstance(p, list):
                raise QueryError("Path must be specified as an array")
            yield _off(pv), set_path(pv[1], p, x)


def _delpaths(env, pv, f):
    for ps in _values(f, env, pv):
        if not isinstance(ps, list):
            raise QueryError("Paths must be specified as an array")
        yield _off(pv), delete_paths(pv[1], ps)


def _del(env, pv, f):
    yield _off(pv), delete_paths(pv[1], [list(p) for p, _ in paths_of(f, env, pv[1])])


def _limit(env, pv, n, f):
    for k in _values(n, env, pv):
        if not B.is_number(k):
            raise QueryError("Invalid arguments to limit")
        if k < 0:
            raise QueryError("Limit doesn't support negative count")
        if k > 0:
            for i, x in enumerate(f(env, pv), 1):
                yield x
                if i >= k:
                    break


def _skip(env, pv, n, f):
    for k in _values(n, env, pv):
        if k < 0:
            raise QueryError("Skip doesn't support negative count")
        for i, x in enumerate(f(env, pv)):
            if i >= k:
                yield x


def _first(env, pv, f):
    for x in f(env, pv):
        yield x
        return


def _last(env, pv, f):
    x = None
    for x in f(env, pv):
        pass
    if x is not None:
        yield x


def _nth(env, pv, n, f):
    for k in _values(n, env, pv):
        if k < 0:
            raise QueryError("nth doesn't support negative indices")
        for i, x in enumerate(f(env, pv)):
            if i >= k:
                yield x
                break


def _isempty(env, pv, f):
    for _ in f(env, (None, pv[1])):
        yield _off(pv), False
        return
    yield _off(pv), True


def _range(env, pv, *fs):
    if len(fs) == 1:
        for hi in _values(fs[0], env, pv):
            yield from _span(pv, 0, hi, 1)
    else:
        for lo in _values(fs[0], env, pv):
            for hi in _values(fs[1], env, pv):
                for by in _values(fs[2], env, pv) if len(fs) == 3 else (1,):
                    yield from _span(pv, lo, hi, by)


def _span(pv, lo, hi, by):
    if not (B.is_number(lo) and B.is_number(hi) and B.is_number(by)):
        raise QueryError("Range bounds must be numeric")
    x = lo
    while by > 0 and x < hi or by < 0 and x > hi or by == 0 and lo < hi:
        yield _off(pv), x
        x = B.tidy(x + by)


def _any(env, pv, *fs, want=True):
    if not fs:
        src = (v for _, v in children((None, pv[1])))
        yield _off(pv), want if any(truthy(v) == want for v in src) else not want
        return
    gen, cond = fs if len(fs) == 2 else (None, fs[0])
    for x in gen(env, (None, pv[1])) if gen else children((None, pv[1])):
        for v in _values(cond, env, x):
            if truthy(v) == want:
                yield _off(pv), want
                return
    yield _off(pv), not want


def _all(env, pv, *fs):
    return _any(env, pv, *fs, want=False)


def _while(env, pv, cond, step):
    stack = [iter((pv,))]
    while stack:
        try:
            x = next(stack[-1])
        except StopIteration:
            stack.pop()
            continue
        if any(True for v in _values(cond, env, x) if truthy(v)):
            yield x
            stack.append(step(env, x))


def _until(env, pv, cond, step):
    stack = [iter((pv,))]
    while stack:
        try:
            x = next(stack[-1])
        except StopIteration:
            stack.pop()
            continue
        for v in _values(cond, env, x):
            if truthy(v):
                yield x
            else:
                stack.append(step(env, x))


def _repeat(env, pv, step):
    return _recurse(env, pv, step)


def _keyed(name):
    def run(env, pv, f):
        v = pv[1]
        if not isinstance(v, list):
            raise QueryError(f"Cannot index {kind(v)} with number" if isinstance(v, dict) else f"{shown(v)} cannot be {'grouped' if name == 'group_by' else 'sorted'}, as it is not an array")
        yield _off(pv), B.BY[name](v, [list(_values(f, env, (None, x))) for x in v])

    return run


def _add(env, pv, f):
    out = None
    for v in _values(f, env, pv):
        out = B.add(out, v)
    yield _off(pv), out


def _in_stream(env, pv, *fs):
    if len(fs) == 1:
        yield _off(pv), any(compare(pv[1], v) == 0 for v in _values(fs[0], env, pv))
    else:
        pool = list(_values(fs[1], env, pv))
        yield _off(pv), any(compare(x, y) == 0 for x in _values(fs[0], env, pv) for y in pool)


def _index_of(env, pv, *fs):
    gen, key = fs if len(fs) == 2 else (None, fs[0])
    out = {}
    for x in gen(env, (None, pv[1])) if gen else children((None, pv[1])):
        for k in _values(key, env, x):
            out[B.tostring(k)] = x[1]
    yield _off(pv), out


def _join_index(env, pv, idx, *fs):
    if len(fs) == 1:
        for table in _values(idx, env, pv):
            rows = []
            for x in children((None, pv[1])):
                rows += [[x[1], lookup(table, k)] for k in _values(fs[0], env, x)]
            yield _off(pv), rows
        return
    gen, key, *merge = fs
    for table in _values(idx, env, pv):
        for x in gen(env, (None, pv[1])):
            for k in _values(key, env, x):
                pair = [x[1], lookup(table, k)]
                for y in _values(merge[0], env, (None, pair)) if merge else (pair,):
                    yield _off(pv), y


def _input(env, pv):
    feed = env.get("__inputs")
    try:
        yield _off(pv), next(feed)
    except (StopIteration, TypeError):
        raise QueryError("No more inputs") from None


def _inputs(env, pv):
    for v in env.get("__inputs") or ():
        yield _off(pv), v


def _to_env(env, pv):
    yield _off(pv), env.get("__env", {})


def _meta(key, default=None):
    def run(env, pv):
        yield _off(pv), env.get(key, default)

    return run


def _debug(env, pv, f=None):
    for v in _values(f, env, pv) if f else (pv[1],):
        env.get("__debug", lambda _: None)(["DEBUG:", v])
    yield pv


class Halt(Exception):
    def __init__(self, value, status: int, silent: bool):
        self.value, self.status, self.silent = value, status, silent


def _halt(env, pv):
    raise Halt(None, 0, True)
    yield


def _halt_error(env, pv, status=None):
    for s in _values(status, env, pv) if status else (5,):
        if not B.is_number(s):
            raise QueryError("halt_error/1: number required")
        raise Halt(pv[1], int(s), False)
    yield from ()


def _fromstream(env, pv, f):
    out, started = None, False
    for ev in _values(f, env, pv):
        path = ev[0]
        if len(ev) == 2:
            if not path:
                yield _off(pv), ev[1]
                out, started = None, False
                continue
            out, started = set_path(out if started else None, path, ev[1]), True
        elif len(path) <= 1:
            if started:
                yield _off(pv), out
            out, started = None, False


def _truncate_stream(env, pv, f):
    depth = pv[1]
    for ev in f(env, (None, pv[1])):
        e = ev[1]
        if isinstance(e, list) and e and len(e[0]) > depth:
            yield _off(pv), [e[0][depth:], *e[1:]]


def _walk(env, pv, f):
    def go(v):
        if isinstance(v, list):
            v = [y for x in v for y in go(x)]
        elif isinstance(v, dict):
            new = {}
            for k, x in v.items():
                for y in go(x):
                    new[k] = y
                    break
            v = new
        return _values(f, env, (None, v))

    for v in go(pv[1]):
        yield _off(pv), v


def _pick(env, pv, f):
    out = None
    for p, _ in paths_of(f, env, pv[1]):
        if any(B.is_number(k) and k < 0 for k in p):
            raise QueryError("Out of bounds negative array index")
        out = set_path(out, p, get_path(pv[1], p))
    yield _off(pv), out


def _ltrimlike(env, pv):
    yield pv


def _sub(env, pv, *fs, all_=False):
    pattern, to = fs[0], fs[1]
    for flags in _values(fs[2], env, pv) if len(fs) == 3 else ("",):
        for p in _values(pattern, env, pv):
            found = B.matches(pv[1], p, (flags or "") + ("g" if all_ else ""))
            yield from ((_off(pv), s) for s in _substitute(env, pv[1], found, to))


def _substitute(env, text, found, to):
    def build(i, at, out):
        if i == len(found):
            yield out + text[at:]
            return
        m = found[i]
        names = {c["name"]: c["string"] for c in m["captures"] if c["name"] is not None}
        for r in _values(to, env, (None, names)):
            if not isinstance(r, str):
                raise QueryError(f"{shown(names)} cannot be added to a string")
            yield from build(i + 1, m["offset"] + m["length"], out + text[at : m["offset"]] + r)

    yield from build(0, 0, "")


def _gsub(env, pv, *fs):
    return _sub(env, pv, *fs, all_=True)


def _regex(name):
    def run(env, pv, *fs):
        for flags in _values(fs[1], env, pv) if len(fs) == 2 else (None,):
            for p in _values(fs[0], env, pv):
                if isinstance(p, list) and len(fs) == 1:
                    p, flags = p[0], (p[1] if len(p) > 1 else None)
                for v in B.REGEX[name](pv[1], p, flags):
                    yield _off(pv), v

    return run


def _tostream(env, pv):
    for ev in B.tostream(pv[1]):
        yield _off(pv), ev


def _combinations(env, pv, n=None):
    if n is None:
        for row in B.combinations(pv[1]):
            yield _off(pv), row
    else:
        for k in _values(n, env, pv):
            for row in B.combinations([pv[1]] * int(k)):
                yield _off(pv), row


def _kinds(*names):
    def run(env, pv):
        if kind(pv[1]) in names:
            yield pv

    return run


def _filter(test):
    def run(env, pv):
        if B.is_number(pv[1]) and test(pv[1]):
            yield pv

    return run


def _builtins(env, pv):
    yield _off(pv), sorted({k for k in (*NATIVE, *B.PLAIN, *prelude()) if not k.startswith(("_", "@"))})


NATIVE = {
    "empty/0": _empty, "error/0": _error, "error/1": _error, "select/1": _select, "recurse/0": _recurse, "recurse/1": _recurse, "recurse/2": _recurse,
    "path/1": _path, "getpath/1": _getpath, "setpath/2": _setpath, "delpaths/1": _delpaths, "del/1": _del, "limit/2": _limit, "skip/2": _skip,
    "first/1": _first, "last/1": _last, "nth/2": _nth, "isempty/1": _isempty, "range/1": _range, "range/2": _range, "range/3": _range,
    "any/0": _any, "any/1": _any, "any/2": _any, "all/0": _all, "all/1": _all, "all/2": _all, "while/2": _while, "until/2": _until, "repeat/1": _repeat,
    **{f"{n}/1": _keyed(n) for n in ("sort_by", "group_by", "unique_by", "min_by", "max_by")}, "add/1": _add, "IN/1": _in_stream, "IN/2": _in_stream,
    "INDEX/1": _index_of, "INDEX/2": _index_of, "JOIN/2": _join_index, "JOIN/3": _join_index, "JOIN/4": _join_index, "input/0": _input, "inputs/0": _inputs,
    "env/0": _to_env, "input_filename/0": _meta("__file"), "input_line_number/0": _meta("__line", 0), "debug/0": _debug, "debug/1": _debug, "stderr/0": _debug,
    "halt/0": _halt, "halt_error/0": _halt_error, "halt_error/1": _halt_error, "fromstream/1": _fromstream, "truncate_stream/1": _truncate_stream,
    "walk/1": _walk, "pick/1": _pick, "sub/2": _sub, "sub/3": _sub, "gsub/2": _gsub, "gsub/3": _gsub,
    **{f"{n}/{k}": _regex(n) for n in ("test", "match", "capture", "scan", "splits") for k in (1, 2)}, "split/2": _regex("split"), "tostream/0": _tostream,
    "combinations/0": _combinations, "combinations/1": _combinations, "nulls/0": _kinds("null"), "booleans/0": _kinds("boolean"), "numbers/0": _kinds("number"),
    "strings/0": _kinds("string"), "arrays/0": _kinds("array"), "objects/0": _kinds("object"), "iterables/0": _kinds("array", "object"),
    "scalars/0": _kinds("null", "boolean", "number", "string"), "values/0": _kinds("boolean", "number", "string", "array", "object"),
    "finites/0": _filter(lambda x: x not in (float("inf"), float("-inf"))), "normals/0": _filter(B.is_normal), "builtins/0": _builtins,
}

PRELUDE = """
def map(f): [.[] | f];
def map_values(f): .[] |= f;
def paths: path(..) | select(length > 0);
def paths(f): path(.. | select(f)) | select(length > 0);
def to_entries: [keys_unsorted[] as $k | {key: $k, value: .[$k]}];
def with_entries(f): to_entries | map(f) | from_entries;
def in(xs): . as $x | xs | has($x);
def inside(xs): . as $x | xs | contains($x);
def first: .[0];
def last: .[-1];
def nth($n): .[$n];
def todate: strftime("%Y-%m-%dT%H:%M:%SZ");
def todateiso8601: strftime("%Y-%m-%dT%H:%M:%SZ");
def fromdateiso8601: strptime("%Y-%m-%dT%H:%M:%SZ") | mktime;
def fromdate: fromdateiso8601;
def ascii: [.] | implode;
"""
_prelude: dict[str, Function] = {}


def prelude() -> dict[str, Function]:
    if not _prelude:
        for name, params, body in parse_program(PRELUDE)[2]:
            key = f"{name}/{len(params)}"
            _prelude[key] = Function(params, compile_tree(body), {}, key)
    return _prelude


class Program:
    """A compiled query. Pickles as its text."""

    def __init__(self, text: str, variables: dict | None = None, modules=None):
        self.text, self.variables = text, dict(variables or {})
        if modules is not None:
            from larkspur.plans.modules import link

            self.tree = link(text, modules)
        else:
            self.tree = parse(text)
        check_names(self.tree, {f"${k}" for k in self.variables} | {"$ENV"})
        self._run = compile_tree(self.tree)

    def __reduce__(self):
        return _revive, (self.text, self.variables, self.tree)

    def run(self, value, **special) -> Iterator:
        """Results for one input. special: inputs (iterator), env, debug, file."""
        env = {f"${k}": v for k, v in self.variables.items()} | {f"__{k}": v for k, v in special.items()}
        try:
            for _, v in self._run(env, (None, value)):
                yield v
        except Break:
            raise QueryError("break") from None
        except RecursionError:
            raise QueryError("the query recurses too deeply") from None


def _revive(text, variables, tree):
    p = Program.__new__(Program)
    p.text, p.variables, p.tree, p._run = text, variables, tree, compile_tree(tree)
    return p


def check_names(e, known: set[str]) -> None:
    """Raise LookupError for a variable, label or filter that nothing defines."""
    op = e[0]
    if op == "var" and "$" + e[1] not in known and e[1] != "__prog_args":
        raise LookupError(f"${e[1]} is not defined")
    if op == "break" and "*" + e[1] not in known:
        raise LookupError(f"$*label-{e[1]} is not defined")
    if op == "call":
        key = f"{e[1]}/{len(e[2])}"
        if key not in known and key not in NATIVE and key not in B.PLAIN and key not in prelude():
            raise LookupError(f"{key} is not defined")
        for a in e[2]:
            check_names(a, known)
    elif op == "def":
        _, name, params, body, rest = e
        own = known | {f"{name}/{len(params)}"}
        inner = own | {f"{p.lstrip('$')}/0" for p in params} | {p for p in params if p.startswith("$")}
        check_names(body, inner)
        check_names(rest, own)
    elif op == "label":
        check_names(e[2], known | {"*" + e[1]})
    elif op in ("as", "reduce", "foreach"):
        check_names(e[1], known)
        inner = known | {"$" + n for p in e[2] for n in _names(p)}
        for p in e[2]:
            _check_pattern(p, inner)
        for k, x in enumerate(e[3:]):
            if x is not None:
                check_names(x, known if op != "as" and k == 0 else inner)
    elif op == "str":
        for p in e[2]:
            if not isinstance(p, str):
                check_names(p, known)
    elif op == "object":
        for k, v in e[1]:
            check_names(k, known)
            check_names(v, known)
    elif op not in ("lit",):
        for x in e[1:]:
            if isinstance(x, tuple):
                check_names(x, known)


def _check_pattern(p, known):
    if p[0] == "parr":
        for x in p[1]:
            _check_pattern(x, known)
    elif p[0] == "pobj":
        for k, _, inner in p[1]:
            check_names(k, known)
            if inner:
                _check_pattern(inner, known)


__all__ = ["Break", "Halt", "Program", "copied"]
