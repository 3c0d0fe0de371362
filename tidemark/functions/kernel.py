"""Bodies in a subset of OpenCL C, turned into columns by running them on symbols.

Declarations, (compound) assignment, ``if``/``else``, ``for`` with constant bounds, ``return``, the operators of C, calls
of the functions below, casts, vector literals and lanes ``.sN``. Anything else raises ``ValueError``; such a body can
be a Python callable on columns instead.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.types import SCALARS

TOKEN = re.compile(r"\s*(?://[^\n]*|/\*.*?\*/)?\s*(?:(\d+\.\d*(?:[eE][-+]?\d+)?[fF]?|\.\d+[fF]?|\d+[eE][-+]?\d+|\d+[uUlLfF]*)|([A-Za-z_]\w*)|(<<=|>>=|\+\+|--|&&|\|\||<<|>>|[-+*/%&|^<>=!]=|[-+*/%&|^<>=!~?:;,(){}.\[\]]))", re.S)
TYPES = {**{k: v for k, v in SCALARS.items()}, "uint": T.LongType(), "size_t": T.LongType(), "bool": T.IntegerType()}
UNROLL = 4096
_half_up = lambda x: F.signum(x) * F.floor(F.abs(x) + 0.5)
_number = lambda x, y: (F.nanvl(x, y), F.nanvl(y, x))  # noqa: E731  these prefer what is a number
#: name: (function, whether the result is a float whatever the arguments are)
CALLS: dict[str, tuple[Callable[..., Column], bool]] = {
    **{n: (getattr(F, n), True) for n in "sqrt cbrt exp log2 log10 log1p expm1 sin cos tan asin acos atan sinh cosh tanh asinh acosh atanh atan2 hypot pow degrees radians".split()},
    "fabs": (F.abs, True), "abs": (F.abs, False), "log": (F.ln, True), "exp2": (lambda x: F.pow(F.lit(2.0), x), True), "pown": (F.pow, True),
    "floor": (lambda x: F.floor(x).cast("double"), True), "ceil": (lambda x: F.ceil(x).cast("double"), True), "trunc": (lambda x: F.signum(x) * F.floor(F.abs(x)), True),
    "rint": (F.rint, True), "round": (_half_up, True), "fmod": (lambda x, y: x % y, True), "sign": (F.signum, True),
    "max": (F.greatest, False), "min": (F.least, False), "fmax": (lambda x, y: F.greatest(*_number(x, y)), True), "fmin": (lambda x, y: F.least(*_number(x, y)), True),
    "clamp": (lambda x, low, high: F.least(F.greatest(x, low), high), False), "mad": (lambda a, b, c: a * b + c, True), "fma": (lambda a, b, c: a * b + c, True),
    "isnan": (lambda x: F.isnan(x).cast("int"), False), "isinf": (lambda x: (F.abs(x) == float("inf")).cast("int"), False), "popcount": (F.bit_count, False),
    "select": (lambda a, b, c: F.when(c != 0, b).otherwise(a), False),
}


@dataclass(frozen=True)
class Value:
    """Lanes of columns, whether they are floats, whether they are truth values, and the number if it is known."""

    cols: tuple[Column, ...]
    real: bool
    truth: bool = False
    known: int | None = None

    @property
    def one(self) -> Column:
        return self.cols[0].cast("int") if self.truth else self.cols[0]

    @property
    def test(self) -> Column:
        return self.cols[0] if self.truth else self.cols[0] != 0


def symbol(col: Column, kind: T.DataType) -> Value:
    """An element as a body sees it; chars and shorts are ints there, as C makes them in every operation."""
    fields = kind.fields if isinstance(kind, T.StructType) else None
    lane = fields[0].dataType if fields else kind
    cols = tuple(col[f.name] for f in fields) if fields else (col,)
    if isinstance(lane, T.ByteType | T.ShortType):
        cols = tuple(c.cast("int") for c in cols)
    return Value(cols, isinstance(lane, T.DoubleType | T.FloatType))


def _cast(c: Column, kind: T.DataType, real: bool) -> Column:
    """A cast as C makes it: an integer that is too long for a char or short loses its upper bits."""
    half = {"tinyint": 1 << 7, "smallint": 1 << 15}.get(kind.simpleString())
    if half is None or real:
        return c.cast(kind)
    return (F.pmod(c.cast("bigint") + half, F.lit(2 * half)) - half).cast(kind)


class Body:
    """One run of a body. ``env`` has the symbols by name, ``get`` the meaning of GET(i)."""

    def __init__(self, text: str, env: dict[str, Value], get: Callable[[int], Value] | None = None):
        self.tokens, at = [], 0
        text = text.strip()
        while at < len(text):
            m = TOKEN.match(text, at)
            if not m or m.end() == at:
                raise ValueError(f"body not understood at {text[at : at + 20]!r}")
            if m[1] or m[2] or m[3]:
                self.tokens.append(m[1] or m[2] or m[3])
            at = m.end()
        self.at, self.env, self.get = 0, dict(env), get

    def run(self) -> Value:
        out = self.block(len(self.tokens))
        if out is None:
            raise ValueError("the body doesn't return on every path")
        return out

    # -- tokens
    def peek(self, k: int = 0) -> str:
        return self.tokens[self.at + k] if self.at + k < len(self.tokens) else ""

    def take(self, want: str | None = None) -> str:
        found = self.peek()
        if not found or want is not None and found != want:
            raise ValueError(f"expected {want or 'more'}, found {found or 'the end'}")
        self.at += 1
        return found

    def skip(self, start: int) -> int:
        """Index behind the statement that begins at ``start``."""
        t, depth, i = self.tokens, 0, start
        if t[i] in ("if", "for", "while"):
            i += 1
            while True:
                depth += (t[i] == "(") - (t[i] == ")")
                i += 1
                if not depth:
                    break
            i = self.skip(i)
            return self.skip(i + 1) if i < len(t) and t[i] == "else" else i
        while True:
            depth += (t[i] in "({") - (t[i] in ")}")
            i += 1
            if not depth and t[i - 1] in (";", "}"):
                return i

    # -- statements; each gives the value returned, or None
    def follow(self, rest: tuple[tuple[int, int], ...]) -> Value | None:
        """What the ranges of tokens that come next return."""
        for i, (start, end) in enumerate(rest):
            self.at = start
            out = self.block(end, rest[i + 1 :])
            if out is not None:
                return out
        return None

    def block(self, end: int, rest: tuple[tuple[int, int], ...] | None = ()) -> Value | None:
        """Runs up to ``end``. ``rest``: the ranges that come after, for paths that go on there; None in a loop."""
        while self.at < end:
            word = self.peek()
            if word == ";":
                self.take()
            elif word == "{":
                stop = self.skip(self.at)
                self.take()
                out = self.block(stop - 1, None if rest is None else ((stop, end), *rest))
                if out is not None:
                    return out
                self.at = stop
            elif word == "return":
                self.take()
                return self.expression()
            elif word == "if":
                out = self.branch(end, rest)
                if out is not None:
                    return out
            elif word == "for":
                out = self.loop()
                if out is not None:
                    return out
            else:
                self.simple()
                self.take(";")
        return None

    def branch(self, end: int, more: tuple[tuple[int, int], ...] | None) -> Value | None:
        self.take("if")
        self.take("(")
        test = self.expression()
        self.take(")")
        then, rest = self.at, self.skip(self.at)
        other = rest + 1 if rest < len(self.tokens) and self.tokens[rest] == "else" else None
        after = self.skip(other) if other is not None else rest
        choose = lambda a, b: Value(tuple(F.when(test.test, x).otherwise(y) for x, y in zip(a.cols, b.cols, strict=True)), a.real or b.real, a.truth and b.truth)
        returns = "return" in self.tokens[then:after]
        if returns and more is None:
            raise ValueError("a path can't return from inside a loop")
        ways = ((after, end), *more) if returns else ()
        start, envs, outs = dict(self.env), [], []
        for begin, stop in ((then, rest), (other, after)):
            self.env, out = dict(start), None
            if begin is not None:
                self.at = begin
                out = self.block(stop, ways if returns else None)
            if returns and out is None:
                out = self.follow(ways)
                if out is None:
                    raise ValueError("the body doesn't return on every path")
            envs.append(self.env)
            outs.append(out)
        self.at = after
        if returns:
            return choose(*outs)
        self.env = {k: v if envs[1][k] is v else choose(v, envs[1][k]) for k, v in envs[0].items() if k in envs[1]}
        return None

    def loop(self) -> Value | None:
        self.take("for")
        self.take("(")
        if self.peek() != ";":
            self.simple()
        self.take(";")
        test_at = self.at
        depth, i = 0, self.at
        while self.tokens[i] != ";":
            i += 1
        step_at = i + 1
        i = step_at
        while depth or self.tokens[i] != ")":
            depth += (self.tokens[i] == "(") - (self.tokens[i] == ")")
            i += 1
        body, after = i + 1, self.skip(i + 1)
        for _ in range(UNROLL):
            self.at = test_at
            known = self.expression().known
            if known is None:
                raise ValueError("a loop must have constant bounds")
            if not known:
                self.at = after
                return None
            self.at = body
            out = self.block(after, None)
            if out is not None:
                return out
            self.at = step_at
            self.simple()
        raise ValueError(f"a loop of over {UNROLL} rounds")

    def simple(self) -> None:
        """A declaration, assignment, increment or expression."""
        if self.peek() == "const":
            self.take()
        kind = self.vector_type(self.peek())
        if kind and re.match(r"[A-Za-z_]", self.peek(1) or ";"):
            self.take()
            while True:
                name = self.take()
                if self.peek() == "=":
                    self.take()
                    self.env[name] = self.convert(self.assignment(), *kind)
                else:
                    self.env[name] = self.convert(self.constant(0, False), *kind)
                if self.peek() != ",":
                    return
                self.take()
        self.assignment()

    def assignment(self) -> Value:
        name, op = self.peek(), self.peek(1)
        if name in ("++", "--"):
            self.take()
            name = self.take()
            self.env[name] = self.binary(self.tokens[self.at - 2][0], self.env[name], self.constant(1, False))
            return self.env[name]
        if name in self.env and op in ("++", "--"):
            self.take(), self.take()
            old = self.env[name]
            self.env[name] = self.binary(op[0], old, self.constant(1, False))
            return old
        if name in self.env and op == "." and self.peek(3) == "=":
            self.take(), self.take()
            lane = self.lane(self.take())
            self.take("=")
            v, cols = self.assignment(), list(self.env[name].cols)
            cols[lane] = v.one
            self.env[name] = Value(tuple(cols), self.env[name].real)
            return v
        if name in self.env and re.fullmatch(r"(?:<<|>>|[-+*/%&|^])?=", op):
            self.take(), self.take()
            v, old = self.assignment(), self.env[name]
            new = v if op == "=" else self.binary(op[:-1], old, v)
            if old.real and not new.real:
                new = Value(tuple(c.cast("double") for c in new.cols), True)
            elif new.real and not old.real:
                new = Value(tuple(c.cast("bigint") for c in new.cols), False)
            self.env[name] = new
            return new
        return self.expression()

    # -- expressions
    LEVELS = (("||",), ("&&",), ("|",), ("^",), ("&",), ("==", "!="), ("<", ">", "<=", ">="), ("<<", ">>"), ("+", "-"), ("*", "/", "%"))

    def expression(self) -> Value:
        test = self.level(0)
        if self.peek() != "?":
            return test
        self.take()
        a = self.expression()
        self.take(":")
        b = self.expression()
        if test.known is not None:
            return a if test.known else b
        return Value(tuple(F.when(test.test, x).otherwise(y) for x, y in zip(a.cols, b.cols, strict=True)), a.real or b.real)

    def level(self, k: int) -> Value:
        if k == len(self.LEVELS):
            return self.unary()
        out = self.level(k + 1)
        while self.peek() in self.LEVELS[k]:
            op = self.take()
            out = self.binary(op, out, self.level(k + 1))
        return out

    @staticmethod
    def constant(v: float, real: bool) -> Value:
        return Value((F.lit(v),), real, known=None if real else int(v))

    def binary(self, op: str, a: Value, b: Value) -> Value:
        if a.known is not None and b.known is not None:
            x, y = a.known, b.known
            if op in ("/", "%"):
                q = abs(x) // abs(y) * (1 if (x < 0) == (y < 0) else -1)
                return self.constant(q if op == "/" else x - q * y, False)
            table = {"+": x + y, "-": x - y, "*": x * y, "<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y, "==": x == y, "!=": x != y, "&": x & y, "|": x | y, "^": x ^ y, "&&": bool(x and y), "||": bool(x or y)}
            return self.constant(int(table[op] if op in table else x << y if op == "<<" else x >> y), False)
        if op in ("&&", "||"):
            return Value((a.test & b.test if op == "&&" else a.test | b.test,), False, True)
        n = max(len(a.cols), len(b.cols))
        xs, ys = ((v.cols if len(v.cols) == n else (v.one,) * n) if not v.truth else (v.one,) * n for v in (a, b))
        real = a.real or b.real
        if op in ("<", ">", "<=", ">=", "==", "!="):
            compare = {"<": lambda x, y: x < y, ">": lambda x, y: x > y, "<=": lambda x, y: x <= y, ">=": lambda x, y: x >= y, "==": lambda x, y: x == y, "!=": lambda x, y: x != y}[op]
            return Value((compare(xs[0], ys[0]),), False, True)
        if op in ("<<", ">>"):
            if b.known is None:
                raise ValueError("a shift must be by a constant")
            return Value(tuple((F.shiftleft if op == "<<" else F.shiftright)(x, b.known) for x in xs), False)
        if op == "/" and not real:
            return Value(tuple(F.call_function("div", x, y) for x, y in zip(xs, ys, strict=True)), False)
        f = {"+": lambda x, y: x + y, "-": lambda x, y: x - y, "*": lambda x, y: x * y, "/": lambda x, y: x / y, "%": lambda x, y: x % y, "&": lambda x, y: x.bitwiseAND(y), "|": lambda x, y: x.bitwiseOR(y), "^": lambda x, y: x.bitwiseXOR(y)}[op]
        return Value(tuple(f(x, y) for x, y in zip(xs, ys, strict=True)), real)

    def unary(self) -> Value:
        word = self.peek()
        if word in ("-", "+", "!", "~"):
            self.take()
            v = self.unary()
            if v.known is not None:
                return self.constant({"-": -v.known, "+": v.known, "!": int(not v.known), "~": ~v.known}[word], False)
            if word == "!":
                return Value((~v.test,), False, True)
            return v if word == "+" else Value(tuple(-c if word == "-" else F.bitwise_not(c) for c in v.cols), v.real)
        if word == "(" and (kind := self.vector_type(self.peek(1))) and self.peek(2) == ")":
            self.take(), self.take(), self.take()
            if self.peek() == "(":  # a cast of one value, or a vector literal
                self.take()
                parts = [self.expression()]
                while self.peek() == ",":
                    self.take()
                    parts.append(self.expression())
                self.take(")")
                flat = [c for p in parts for c in (p.cols if not p.truth else (p.one,))]
                return self.convert(Value(tuple(flat), any(p.real for p in parts), known=parts[0].known if len(parts) == 1 else None), *kind)
            return self.convert(self.unary(), *kind)
        return self.postfix(self.primary())

    def postfix(self, v: Value) -> Value:
        while self.peek() == ".":
            self.take()
            v = Value((v.cols[self.lane(self.take())],), v.real)
        return v

    @staticmethod
    def lane(word: str) -> int:
        if re.fullmatch(r"[sS][0-9a-fA-F]", word):
            return int(word[1], 16)
        if word in ("x", "y", "z", "w"):
            return "xyzw".index(word)
        raise ValueError(f"no lane {word!r}")

    @staticmethod
    def vector_type(word: str) -> tuple[T.DataType, int] | None:
        m = re.fullmatch(r"([a-z_]+?)(2|4|8|16)?", word or "")
        return (TYPES[m[1]], int(m[2] or 1)) if m and m[1] in TYPES else None

    @staticmethod
    def convert(v: Value, kind: T.DataType, n: int) -> Value:
        cols = v.cols if len(v.cols) == n and not v.truth else (v.one,) * n
        if len(v.cols) not in (1, n):
            raise ValueError("a vector doesn't become one of another length")
        real = isinstance(kind, T.DoubleType | T.FloatType)
        return Value(tuple(_cast(c, kind, v.real) for c in cols), real, known=None if real else v.known)

    def primary(self) -> Value:
        word = self.take()
        if word == "(":
            v = self.expression()
            self.take(")")
            return v
        if re.match(r"[\d.]", word):
            text = word.rstrip("uUlLfF")
            real = "." in text or "e" in text.lower() or word[-1] in "fF"
            return self.constant(float(text) if real else int(text), real)
        if word == "INFINITY":
            return self.constant(float("inf"), True)
        if word == "NAN":
            return self.constant(float("nan"), True)
        if word == "M_PI":
            return self.constant(3.141592653589793, True)
        if self.peek() != "(":
            if word not in self.env:
                raise ValueError(f"unknown name {word!r}")
            return self.env[word]
        self.take()
        args = []
        while self.peek() != ")":
            args.append(self.expression())
            if self.peek() == ",":
                self.take()
        self.take(")")
        if word == "GET":
            if self.get is None or args[0].known is None:
                raise ValueError("GET takes a constant, in the body of a window")
            return self.get(args[0].known)
        if m := re.fullmatch(r"convert_([a-z]+?(?:2|4|8|16)?)(?:_sat|_rt[ezpn])*", word):
            if kind := self.vector_type(m[1]):
                return self.convert(args[0], *kind)
        if word not in CALLS:
            raise ValueError(f"unknown function {word!r}; a Python callable or an Arrow UDF can take its place")
        f, real = CALLS[word]
        n = max(len(a.cols) for a in args)
        rows = zip(*((a.cols if len(a.cols) == n and not a.truth else (a.one,) * n) for a in args), strict=True)
        return Value(tuple(f(*r) for r in rows), real or any(a.real for a in args))


def compile_body(body: str, env: dict[str, Value], kind: T.DataType | None = None, get: Callable[[int], Value] | None = None) -> Column:
    """The column that a body returns, cast to ``kind`` if given."""
    v = Body(body, env, get).run()
    if isinstance(kind, T.StructType):
        v = Body.convert(v, kind.fields[0].dataType, len(kind.fields))
    if len(v.cols) > 1:
        return F.struct(*[c.alias(f"_{i + 1}") for i, c in enumerate(v.cols)])
    return _cast(v.one, kind, v.real) if kind is not None else v.one
