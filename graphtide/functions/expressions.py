"""The models' expression language: one grammar, compiled to Columns or to numpy functions.

Loosest first: or, and, not, comparison, + -, * /, unary minus, ** (to the right), call and atom. Comparisons
give 1.0 or 0.0. A name that nothing defines reads 0.0.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\s*(?:(?P<num>(?:\d+\.\d*|\.\d+|\d+)(?:[eE][+-]?\d+)?)|(?P<name>[A-Za-z_][\w.]*)|(?P<quote>'[^']*'|\"[^\"]*\")|(?P<op>\*\*|<=|>=|==|!=|[-+*/(),<>]))")


class ExpressionError(SyntaxError):
    """What the grammar does not know."""


@dataclass(frozen=True)
class Num:
    value: float


@dataclass(frozen=True)
class Ref:
    name: str


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple


@dataclass(frozen=True)
class Op:
    op: str
    args: tuple


class _Reader:
    def __init__(self, text: str):
        self.items, at = [], 0
        text = text.strip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m or m.end() == at:
                raise ExpressionError(f"unexpected {text[at:]!r} in {text!r}")
            self.items.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self) -> str:
        return self.items[self.at][1] if self.at < len(self.items) else ""

    def take(self, *values: str) -> str | None:
        if self.at < len(self.items) and self.items[self.at][0] != "quote" and self.peek() in values:
            self.at += 1
            return self.items[self.at - 1][1]
        return None

    def expression(self):
        left = self.conjunction()
        while self.take("or"):
            left = Op("or", (left, self.conjunction()))
        return left

    def conjunction(self):
        left = self.negation()
        while self.take("and"):
            left = Op("and", (left, self.negation()))
        return left

    def negation(self):
        return Op("not", (self.negation(),)) if self.take("not") else self.comparison()

    def comparison(self):
        left = self.sum()
        while op := self.take("<", ">", "<=", ">=", "==", "!="):
            left = Op(op, (left, self.sum()))
        return left

    def sum(self):
        left = self.product()
        while op := self.take("+", "-"):
            left = Op(op, (left, self.product()))
        return left

    def product(self):
        left = self.unary()
        while op := self.take("*", "/"):
            left = Op(op, (left, self.unary()))
        return left

    def unary(self):
        return Op("neg", (self.unary(),)) if self.take("-") else self.power()

    def power(self):
        left = self.atom()
        return Op("**", (left, self.unary())) if self.take("**") else left

    def atom(self):
        if self.at >= len(self.items):
            raise ExpressionError("the expression ends too early")
        kind, value = self.items[self.at]
        self.at += 1
        if kind == "num":
            return Num(float(value))
        if kind == "quote":
            return Ref(value[1:-1].strip().replace(" ", "_"))
        if kind == "name":
            if self.take("("):
                args = []
                while not self.take(")"):
                    args.append(self.expression())
                    if not self.take(",") and self.peek() != ")":
                        raise ExpressionError(f"expected , or ) in the arguments of {value}")
                return Call(value, tuple(args))
            return Ref(value)
        if value == "(":
            inner = self.expression()
            if not self.take(")"):
                raise ExpressionError("a bracket is not closed")
            return inner
        raise ExpressionError(f"unexpected {value!r}")


def parse(text: str):
    r = _Reader(text)
    out = r.expression()
    if r.at < len(r.items):
        raise ExpressionError(f"unexpected {r.peek()!r} in {text!r}")
    return out


def names(e) -> list[str]:
    """Names that an expression reads, in order, each once."""
    if isinstance(e, Ref):
        return [e.name]
    if isinstance(e, (Call, Op)):
        return list(dict.fromkeys(n for a in e.args for n in names(a)))
    return []


def calls(e) -> set[str]:
    return ({e.name} if isinstance(e, Call) else set()).union(*[calls(a) for a in e.args]) if isinstance(e, (Call, Op)) else set()


def substitute(e, values: dict):
    """With names replaced by expressions."""
    if isinstance(e, Ref):
        return values.get(e.name, e)
    if isinstance(e, (Call, Op)):
        return type(e)(e.name if isinstance(e, Call) else e.op, tuple(substitute(a, values) for a in e.args))
    return e


def inline(e, macros: dict[str, tuple[list[str], object]], depth: int = 0):
    """With macro calls replaced by their bodies."""
    if depth > 50:
        raise ExpressionError("macros call each other in a circle")
    if isinstance(e, Call) and e.name in macros:
        params, body = macros[e.name]
        if len(params) != len(e.args):
            raise ExpressionError(f"{e.name} takes {len(params)} arguments")
        return inline(substitute(body, dict(zip(params, e.args, strict=True))), macros, depth + 1)
    if isinstance(e, (Call, Op)):
        return type(e)(e.name if isinstance(e, Call) else e.op, tuple(inline(a, macros, depth) for a in e.args))
    return e


# ---------------------------------------------------------------- Columns


def lookup_column(x: Column, xs: list[float], ys: list[float]) -> Column:
    """Linear interpolation between points, held at the ends; no points: 0.0."""
    if not xs:
        return F.lit(0.0)
    out = F.when(x <= xs[0], F.lit(float(ys[0])))
    for (a, b), (c, d) in zip(zip(xs, ys, strict=True), list(zip(xs, ys, strict=True))[1:], strict=False):
        out = out.when(x <= c, F.lit(float(b)) + (x - a) * ((d - b) / (c - a)) if c > a else F.lit(float(d)))
    return out.otherwise(F.lit(float(ys[-1])))


def to_column(e, env: Callable[[str], Column], tables: dict | None = None, functions: dict | None = None) -> Column:
    """An expression as a Column; env gives the Column of a name. Time is the name t, the step dt."""
    tables, functions = tables or {}, functions or {}

    def go(x):
        return to_column(x, env, tables, functions)

    if isinstance(e, Num):
        return F.lit(e.value)
    if isinstance(e, Ref):
        return F.lit(math.pi) if e.name == "PI" else env(e.name)
    if isinstance(e, Op):
        a = go(e.args[0])
        if e.op == "neg":
            return -a
        if e.op == "not":
            return (a == 0).cast("double")
        b = go(e.args[1])
        if e.op in ("and", "or"):
            return ((a != 0) & (b != 0) if e.op == "and" else (a != 0) | (b != 0)).cast("double")
        arithmetic = {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: a / b, "**": lambda: F.pow(a, b)}
        compared = {"<": lambda: a < b, ">": lambda: a > b, "<=": lambda: a <= b, ">=": lambda: a >= b, "==": lambda: a == b, "!=": lambda: a != b}
        return arithmetic[e.op]() if e.op in arithmetic else compared[e.op]().cast("double")
    args = [go(a) for a in e.args]
    if e.name in tables:
        return lookup_column(args[0], *tables[e.name])
    if e.name in functions:
        return functions[e.name](*args)
    t = env("t")
    known = {
        "IF": lambda c, a, b: F.when(c != 0, a).otherwise(b),
        "MIN": lambda *x: F.least(*x) if len(x) > 1 else x[0],
        "MAX": lambda *x: F.greatest(*x) if len(x) > 1 else x[0],
        "ABS": F.abs,
        "EXP": F.exp,
        "LN": lambda x: F.when(x > 0, F.ln(x)).otherwise(F.raise_error(F.lit("LN of what is not positive")).cast("double")),
        "SQRT": F.sqrt,
        "SIN": F.sin,
        "COS": F.cos,
        "ALLOCATE_FRACTION": lambda have, want, all_: want * F.least(F.lit(1.0), have / F.greatest(F.lit(1.0), all_)),
        "PULSE": lambda v, start, width: F.when((t >= start) & (t < start + width), v).otherwise(0.0),
        "STEP": lambda h, start: F.when(t >= start, h).otherwise(0.0),
        "RAMP": lambda slope, start, end: F.when(t < start, 0.0).when(t < end, slope * (t - start)).otherwise(slope * (end - start)),
    }
    if e.name not in known:
        raise ExpressionError(f"unknown function {e.name}")
    return known[e.name](*args)


# ---------------------------------------------------------------- numpy


def _lookup(xs, ys):
    xs, ys = np.asarray(xs, float), np.asarray(ys, float)
    return (lambda x: np.interp(x, xs, ys)) if len(xs) else (lambda x: np.zeros_like(np.asarray(x, float)))


def _hash01(*parts) -> np.ndarray:
    """Uniform numbers in (0, 1) that depend on their arguments alone."""
    x = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for p in parts:
            x = x ^ np.asarray(p).astype(np.int64).astype(np.uint64)
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            x = x ^ (x >> np.uint64(31))
    return ((x >> np.uint64(11)).astype(float) + 0.5) / 2.0**53


class Draws:
    """Random numbers for a batch of runs: the same for a run however runs are batched."""

    def __init__(self, runs: np.ndarray, seed: int = 42):
        self.runs, self.seed, self.n = runs, seed, 0

    def uniform(self, a=0.0, b=1.0):
        self.n += 1
        return a + (np.asarray(b) - a) * _hash01(self.seed, self.runs, self.n)

    def lognormal(self, mu, sigma):
        z = np.sqrt(-2 * np.log(self.uniform())) * np.cos(2 * np.pi * self.uniform())
        return np.where(np.asarray(sigma) > 0, np.exp(mu + np.asarray(sigma) * z), mu)


def to_numpy(e, tables: dict | None = None, functions: dict | None = None) -> Callable[[dict], np.ndarray]:
    """An expression as a function of an environment: name -> number or array over runs."""
    made = {n: _lookup(*p) for n, p in (tables or {}).items()}
    extra = functions or {}

    def build(x):
        if isinstance(x, Num):
            return lambda env: x.value
        if isinstance(x, Ref):
            return (lambda env: math.pi) if x.name == "PI" else (lambda env: env.get(x.name, 0.0))
        args = [build(a) for a in x.args]
        if isinstance(x, Op):
            one = {"neg": np.negative, "not": lambda a: np.equal(a, 0) * 1.0}
            if x.op in one:
                f, a = one[x.op], args[0]
                return lambda env: f(a(env))
            two = {
                "+": np.add, "-": np.subtract, "*": np.multiply, "/": np.divide, "**": np.power,
                "<": lambda a, b: np.less(a, b) * 1.0, ">": lambda a, b: np.greater(a, b) * 1.0, "<=": lambda a, b: np.less_equal(a, b) * 1.0, ">=": lambda a, b: np.greater_equal(a, b) * 1.0,
                "==": lambda a, b: np.equal(a, b) * 1.0, "!=": lambda a, b: np.not_equal(a, b) * 1.0, "and": lambda a, b: np.logical_and(a, b) * 1.0, "or": lambda a, b: np.logical_or(a, b) * 1.0,
            }
            f, a, b = two[x.op], *args
            return lambda env: f(a(env), b(env))
        if x.name in made:
            f = made[x.name]
            return lambda env: f(args[0](env))
        known = {
            "IF": lambda env, c, a, b: np.where(np.not_equal(c, 0), a, b),
            "MIN": lambda env, *v: _fold(np.minimum, v),
            "MAX": lambda env, *v: _fold(np.maximum, v),
            "ABS": lambda env, v: np.abs(v),
            "EXP": lambda env, v: np.exp(v),
            "LN": lambda env, v: np.log(v),
            "SQRT": lambda env, v: np.sqrt(v),
            "SIN": lambda env, v: np.sin(v),
            "COS": lambda env, v: np.cos(v),
            "ALLOCATE_FRACTION": lambda env, have, want, all_: want * np.minimum(1.0, have / np.maximum(1.0, all_)),
            "PULSE": lambda env, v, start, width: np.where((env["t"] >= start) & (env["t"] < start + width), v, 0.0),
            "STEP": lambda env, h, start: np.where(env["t"] >= start, h, 0.0),
            "RAMP": lambda env, slope, start, end: np.where(env["t"] < start, 0.0, slope * (np.minimum(env["t"], end) - start)),
            "NOISE": lambda env, a: env["_draws"].uniform(-np.asarray(a, float), a),
            "UNIFORM": lambda env, a, b: env["_draws"].uniform(a, b),
            "LOGNORMAL": lambda env, mu, sigma: env["_draws"].lognormal(mu, sigma),
        }
        f = known.get(x.name) or (extra.get(x.name) and (lambda env, *v: extra[x.name](*v)))
        if f is None:
            raise ExpressionError(f"unknown function {x.name}")
        return lambda env: f(env, *[a(env) for a in args])

    return build(e)


def _fold(f, values):
    out = values[0]
    for v in values[1:]:
        out = f(out, v)
    return out
