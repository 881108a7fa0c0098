"""Compiles parsed queries into one DataFrame plan; no row passes through Python.

A solution is a row with a term struct for each variable, null where unbound. Patterns become scans of the
graph with their constants as predicates, a basic graph pattern becomes a chain of joins that starts from
the most selective patterns and never joins without a shared variable while one is left.
"""

from __future__ import annotations

import warnings
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphtide.functions import terms as T
from graphtide.operators.closure import reach

from .sparql_parser import Const, Expr, Node, Path, Pattern, Query, Var, parse


@lru_cache(maxsize=512)
def parsed(text: str) -> Query:
    return parse(text)


def _const(c: Const) -> Column:
    return T.constant(c.kind, c.lex, c.dt, c.lang)


#: Parts that go with each other whole meet in so many tasks.
SALTS = 16


class Compiler:
    """Compiles for one graph. strict: a filter that errs drops the row (default: keeps it, numbers lenient)."""

    def __init__(self, graph, strict: bool = False):
        self.graph, self.strict = graph, strict

    # ------------------------------------------------------------ patterns

    def pattern(self, t: Pattern) -> DataFrame:
        if isinstance(t.p, Path):
            return self.path(t)
        value = lambda x: x.lex if isinstance(x, Const) else None
        graph = value(t.graph) if t.graph is not None else None
        rows = self.graph.scan(s=value(t.s), p=value(t.p), o=t.o if isinstance(t.o, Const) else None, g=graph, graphs=isinstance(t.graph, Var))
        named: dict[str, list[Column]] = {}
        for x, c in ((t.s, T.term(F.col("s_kind"), F.col("s"))), (t.p, T.term(T.IRI, F.col("p"))), (t.o, F.col("o")), (t.graph, T.term(T.IRI, F.col("g")))):
            if isinstance(x, Var):
                named.setdefault(x.name, []).append(c)
        for same in named.values():
            for other in same[1:]:  # a variable that comes twice in a pattern
                rows = rows.where(T.key(same[0]) == T.key(other))
        return rows.select(*[c[0].alias(n) for n, c in named.items()]) if named else rows.select(F.lit(1).alias("_one"))

    def path(self, t: Pattern) -> DataFrame:
        pairs = self.pairs(t.p, t.graph)
        out = []
        for x, side in ((t.s, "a"), (t.o, "b")):
            if isinstance(x, Const):
                pairs = pairs.where(T.key(F.col(side)) == T.key(_const(x)))
            else:
                out.append(F.col(side).alias(x.name))
        if isinstance(t.s, Var) and t.s == t.o:
            return pairs.where(T.key(F.col("a")) == T.key(F.col("b"))).select(out[0])
        return pairs.select(*out) if out else pairs.select(F.lit(1).alias("_one"))

    def pairs(self, p, graph) -> DataFrame:
        """(a, b): what a property path connects."""
        if isinstance(p, Const):
            return self.pattern(Pattern(Var("a"), p, Var("b"), graph if isinstance(graph, Const) else None))
        parts = [self.pairs(x, graph) for x in p.parts]
        if p.op == "^":
            return parts[0].select(F.col("b").alias("a"), F.col("a").alias("b"))
        if p.op == "|":
            return parts[0].unionByName(parts[1])
        if p.op == "/":
            left, right = parts[0].withColumnRenamed("b", "m"), parts[1].withColumnRenamed("a", "m2")
            return left.join(right, T.key(left["m"]) == T.key(right["m2"])).select("a", "b")
        step = parts[0].distinct()
        nodes = step.select("a").union(step.select("b")).distinct().select("a", F.col("a").alias("b"))
        if p.op == "?":
            return step.union(nodes).distinct()
        names = nodes.select(T.key(F.col("a")).alias("k"), F.col("a").alias("t"))
        closed = reach(step.select(T.key(F.col("a")).alias("a"), T.key(F.col("b")).alias("b")))
        ends = closed.join(names.select(F.col("k").alias("a"), F.col("t").alias("ta")), "a").join(names.select(F.col("k").alias("b"), F.col("t").alias("tb")), "b").select(F.col("ta").alias("a"), F.col("tb").alias("b"))
        return ends if p.op == "+" else ends.union(nodes).distinct()

    def bgp(self, patterns: list[Pattern]) -> tuple[DataFrame, set[str]]:
        def cost(t: Pattern) -> tuple:
            bound = [isinstance(x, Const) for x in (t.s, t.o, t.p)]
            return (-bound[0], -bound[1], isinstance(t.p, Path), -bound[2])

        def names(t: Pattern) -> set[str]:
            return {x.name for x in (t.s, t.p, t.o, t.graph) if isinstance(x, Var)}

        units = [(min(map(cost, used)), own, rows, used) for rows, own, used in self.stars(patterns)]
        starred = {id(t) for *_, used in units for t in used}
        units += [(cost(t), names(t), self.pattern(t), [t]) for t in patterns if id(t) not in starred]
        left = sorted(units, key=lambda u: u[0])
        out, have = None, set()
        while left:
            u = next((x for x in left if x[1] & have), left[0])
            left = [x for x in left if x is not u]
            out = u[2] if out is None else self.join(out, u[2], have, u[1], set(), set())
            have |= u[1]
        return out, have

    def stars(self, patterns: list[Pattern]):
        """Patterns on one subject variable with constant predicates, where the graph can read them in one scan:
        (rows, variables, patterns)."""
        if not hasattr(self.graph, "star"):
            return
        by_subject: dict[str, list[Pattern]] = {}
        for t in patterns:
            if isinstance(t.s, Var) and isinstance(t.p, Const) and (t.graph is None or isinstance(t.graph, Const)):
                by_subject.setdefault((t.s.name, t.graph), []).append(t)
        for (subject, graph), ts in by_subject.items():
            if len(ts) < 2 or len({t.p.lex for t in ts}) < len(ts):
                continue
            rows = self.graph.star([t.p.lex for t in ts], graph.lex if graph is not None else None)
            if rows is None:
                return
            named: dict[str, list[Column]] = {subject: [T.term(F.col("s_kind"), F.col("s"))]}
            for i, t in enumerate(ts):
                if isinstance(t.o, Const):
                    rows = rows.where(T.key(F.col(f"o{i}")) == T.key(_const(t.o)))
                else:
                    named.setdefault(t.o.name, []).append(F.col(f"o{i}"))
            for same in named.values():
                for other in same[1:]:
                    rows = rows.where(T.key(same[0]) == T.key(other))
            yield rows.select(*[c[0].alias(n) for n, c in named.items()]), set(named), ts

    def join(self, a: DataFrame, b: DataFrame, va: set[str], vb: set[str], loose_a: set[str], loose_b: set[str], how: str = "inner", extra=None) -> DataFrame:
        """Joins solutions on shared variables. loose: variables that may be unbound, which go with any value."""
        shared = sorted(va & vb)
        if (loose_a | loose_b) & set(shared):
            return self._masked(a, b, shared, loose_a & set(shared), loose_b & set(shared), how, extra)
        b = b.select(*[F.col(c).alias(f"_r_{c}") if c in shared or c == "_one" else F.col(c) for c in b.columns])
        conditions = []
        for v in shared:
            conditions.append(T.key(F.col(v)) == T.key(F.col(f"_r_{v}")))
        if extra is not None:
            conditions.append(extra(b))
        if how in ("left_semi", "left_anti"):
            return a.join(b, reduce(Column.__and__, conditions), how)
        out = a.join(b, reduce(Column.__and__, conditions), how) if conditions else (a.crossJoin(b) if how == "inner" else a.join(b, F.lit(True), how))
        return out.drop(*[f"_r_{v}" for v in [*shared, "_one"]])

    def _masked(self, a: DataFrame, b: DataFrame, shared: list[str], loose_a: set[str], loose_b: set[str], how: str, extra) -> DataFrame:
        """A join on variables that may be unbound: each side is split by which of them it binds, and each pair of
        parts joins on those that both bind, by equality.

        Parts without a common variable go with each other whole; there one side is dealt over salts and the
        other repeated for each, so this too is an equality.
        """
        b = b.select(*[F.col(c).alias(f"_r_{c}") if c in shared or c == "_one" else F.col(c) for c in b.columns])

        def parts(rows: DataFrame, loose: set[str], prefix: str) -> list[tuple[set[str], DataFrame]]:
            split = [(set(shared) - loose, rows)]
            for v in sorted(loose):
                there = F.col(prefix + v).isNotNull()
                split = [x for bound, part in split for x in ((bound | {v}, part.where(there)), (bound, part.where(~there)))]
            return split

        def having(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
            """A join on there being any row on the right."""
            some = right.limit(1).select(F.lit(0).alias("_r_some"))  # one row at most, so small enough to send
            return left.withColumn("_some", (F.rand(0) < 0).cast("int")).join(F.broadcast(some), F.col("_some") == F.col("_r_some"), how).drop("_some", "_r_some")

        def met(left: DataFrame, right: DataFrame, both: set[str], how: str) -> DataFrame:
            conditions = [T.key(F.col(v)) == T.key(F.col(f"_r_{v}")) for v in sorted(both)] + ([] if extra is None else [extra(right)])
            if both:
                return left.join(right, reduce(Column.__and__, conditions), how)
            if how == "inner":
                left = having(left, right, "inner").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
                right = right.withColumn("_r_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
                # What is repeated is larger than Spark knows from its files, so neither side may be sent whole.
                return left.join(right.hint("merge"), reduce(Column.__and__, conditions, F.col("_salt") == F.col("_r_salt"))).drop("_salt", "_r_salt")
            if extra is not None:  # any row of the right may satisfy the condition
                return left.join(right, conditions[0], how)
            return having(left, right, how)

        left, right = parts(a, loose_a, ""), parts(b, loose_b, "_r_")
        new = [c for c in b.columns if not c.startswith("_r_")]
        out: list[DataFrame] = []
        for bound, rows in left:
            if how in ("inner", "left"):
                for bound_r, rows_r in right:
                    joined = met(rows, rows_r, bound & bound_r, "inner")
                    out.append(joined.select(*[F.col(f"_r_{c}").alias(c) if c in shared and c not in bound else F.col(c) for c in a.columns], *new))
            rest = rows
            for bound_r, rows_r in right if how != "inner" else []:
                if how == "left_semi":
                    out.append(met(rest, rows_r, bound & bound_r, "left_semi"))
                rest = met(rest, rows_r, bound & bound_r, "left_anti")
            if how == "left_anti":
                out.append(rest)
            elif how == "left":
                kinds = dict(b.dtypes)
                out.append(rest.select(*a.columns, *[F.lit(None).cast(kinds[c]).alias(c) for c in new]))
        return reduce(DataFrame.union, out)

    # ------------------------------------------------------------ algebra: (rows, variables, those that may be unbound)

    def node(self, n: Node) -> tuple[DataFrame, set[str], set[str]]:
        if n.kind == "bgp":
            if not n.parts:
                return self.graph.spark.range(1).select(F.lit(1).alias("_one")), set(), set()
            rows, names = self.bgp(n.parts)
            return rows, names, set()
        if n.kind == "values":
            return self.values(*n.value)
        if n.kind == "select":
            rows = self.select(n.value)
            return rows, set(rows.columns), set(rows.columns)
        rows, names, loose = self.node(n.parts[0])
        if n.kind == "filter":
            return self.filter(rows, names, loose, n.value)
        if n.kind == "bind":
            name, e = n.value
            return rows.withColumn(name, self.expr(e)(rows)), names | {name}, loose | {name}
        if n.kind == "optional":
            return self.optional(rows, names, loose, n.parts[1])
        right, names_r, loose_r = self.node(n.parts[1])
        if n.kind == "join":
            return self.join(rows, right, names, names_r, loose, loose_r), names | names_r, (loose & loose_r) | (loose - names_r) | (loose_r - names)
        if n.kind == "union":
            drop = lambda d: d.drop("_one")
            return drop(rows).unionByName(drop(right), allowMissingColumns=True), names | names_r, loose | loose_r | (names ^ names_r)
        if n.kind == "minus":
            if not names & names_r:
                return rows, names, loose
            return self.join(rows, right, names, names_r, loose, loose_r, "left_anti"), names, loose
        raise ValueError(n.kind)

    def optional(self, rows, names, loose, part: Node):
        conditions = []
        while part.kind == "filter":  # filters of the optional part belong to the join condition
            conditions.append(part.value)
            part = part.parts[0]
        right, names_r, loose_r = self.node(part)
        shared = names & names_r

        def extra(b: DataFrame) -> Column:
            env = {c: F.col(f"_r_{c}") if c in shared else F.col(c) for c in names | names_r}
            return reduce(Column.__and__, [self.keep(self.value(e, env)) for e in conditions])

        out = self.join(rows, right, names, names_r, loose, loose_r, "left", extra if conditions else None)
        return out, names | names_r, loose | (names_r - names)

    def filter(self, rows, names, loose, e: Expr):
        negated = e.op == "!" and e.args[0].op == "EXISTS"
        if e.op == "EXISTS" or negated:
            right, names_r, loose_r = self.node((e.args[0].args if negated else e.args)[0])
            if not names & names_r:
                found = right.limit(1).count() > 0
                return (rows if found != negated else rows.limit(0)), names, loose
            return self.join(rows, right, names, names_r, loose, loose_r, "left_anti" if negated else "left_semi"), names, loose
        return rows.where(self.keep(self.expr(e)(rows))), names, loose

    def keep(self, value: Column) -> Column:
        return F.coalesce(T.truth(value), F.lit(not self.strict))

    def values(self, names: list[str], rows: list[list]):
        spark = self.graph.spark
        empty = spark.createDataFrame([], ", ".join(f"`{n}` {T.TERM}" for n in names))
        parts = [spark.range(1).select(*[(F.lit(None).cast(T.TERM) if c is None else _const(c)).alias(n) for n, c in zip(names, row, strict=True)]) for row in rows]
        loose = {n for i, n in enumerate(names) if any(r[i] is None for r in rows)}
        return reduce(DataFrame.union, parts, empty), set(names), loose

    # ------------------------------------------------------------ expressions

    def expr(self, e: Expr):
        return lambda rows: self.value(e, {c: F.col(c) for c in rows.columns})

    def value(self, e: Expr, env: dict[str, Column]) -> Column:
        unbound = F.lit(None).cast(T.TERM)
        if e.op == "VAR":
            return env.get(e.args[0], unbound)
        if e.op == "CONST":
            return _const(e.args[0])
        if e.op == "BOUND":
            return T.boolean(env[e.args[0].args[0]].isNotNull() if e.args[0].args[0] in env else F.lit(False))
        if e.op in ("REGEX", "REPLACE"):
            texts = [a.args[0].lex for a in e.args[1:]]
            return (T.regex if e.op == "REGEX" else T.replace)(self.value(e.args[0], env), *texts)
        args = [self.value(a, env) for a in e.args]
        if e.op == "IN":
            return T.boolean(T.key(args[0]).isin(*[T.key(a) for a in args[1:]])) if len(args) > 1 else T.boolean(F.lit(False))
        f = T.OPERATORS.get(e.op) or T.FUNCTIONS.get(e.op) or self.graph.functions.get(e.op)
        if f is None:
            raise ValueError(f"unknown function {e.op}")
        return f(*args)

    def aggregate(self, e: Expr, env: dict[str, Column]) -> Column:
        distinct, *args = e.args
        if e.op == "COUNT":
            if not args:
                return T.number(F.count(F.lit(1)))
            k = T.key(self.value(args[0], env))
            return T.number(F.countDistinct(k) if distinct else F.count(k))
        t = self.value(args[0], env)
        if e.op == "SAMPLE":
            return F.min(t)
        if e.op == "GROUP_CONCAT":
            collected = F.collect_set(t["lex"]) if distinct else F.collect_list(t["lex"])
            return T.string(F.array_join(F.array_sort(collected), args[1] if len(args) > 1 else " "))
        f = {"SUM": F.sum_distinct if distinct else F.sum, "AVG": F.avg, "MIN": F.min, "MAX": F.max}[e.op]
        return T.number(f(t["num"]))

    def _over(self, e: Expr, env: dict[str, Column], found: list) -> Expr:
        """Replaces the aggregates in an expression by variables for their results."""
        from .sparql_parser import AGGREGATES

        if e.op in AGGREGATES:
            found.append(self.aggregate(e, env).alias(f"_agg{len(found)}"))
            return Expr("VAR", [f"_agg{len(found) - 1}"])
        return Expr(e.op, [self._over(a, env, found) if isinstance(a, Expr) else a for a in e.args])

    # ------------------------------------------------------------ query forms

    def select(self, q: Query) -> DataFrame:
        rows, names, _ = self.node(q.where)
        columns = q.columns if q.columns is not None else [(n, None) for n in sorted(names) if not n.startswith("_")]
        found: list[Column] = []
        env = {c: F.col(c) for c in rows.columns}
        columns = [(n, e if e is None else self._over(e, env, found)) for n, e in columns]
        having = [self._over(e, env, found) for e in q.having]
        order = [(self._over(e, env, found), up) for e, up in q.order]
        if found or q.group:
            keyed = rows.groupBy(*[T.key(F.col(g)).alias(f"_key_{g}") for g in q.group])
            rows = keyed.agg(*[F.min(F.col(g)).alias(g) for g in q.group], *found, F.lit(1).alias("_one"))
            for e in having:
                rows = rows.where(self.keep(self.expr(e)(rows)))
        for n, e in columns:
            if e is not None:
                rows = rows.withColumn(n, self.expr(e)(rows))
            elif n not in rows.columns:
                rows = rows.withColumn(n, F.lit(None).cast(T.TERM))
        out = [n for n, _ in columns]
        keys = self.order(rows, order)
        if q.distinct:
            # The order of distinct solutions can only depend on what is selected.
            rows = rows.select(*out).withColumn("_k", F.array(*[F.coalesce(T.key(F.col(n)), F.lit("")) for n in out])).dropDuplicates(["_k"])
            keys = self.order(rows, order)
        if keys:
            rows = rows.orderBy(*keys)
        if q.offset:
            rows = rows.offset(q.offset)
        if q.limit is not None:
            rows = rows.limit(q.limit)
        return rows.select(*out)

    def order(self, rows: DataFrame, order: list) -> list[Column]:
        """Unbound first, then blank nodes, IRIs and literals; numbers by value."""
        keys = []
        for e, up in order:
            t = self.expr(e)(rows)
            rank = F.when(t.isNull(), 0).when(t["kind"] == T.BLANK, 1).when(t["kind"] == T.IRI, 2).when(t["num"].isNotNull(), 3).otherwise(4)
            for c in (rank, t["num"], t["lex"]):
                keys.append(c.asc_nulls_first() if up else c.desc_nulls_last())
        return keys

    def construct(self, q: Query) -> DataFrame:
        rows, _, _ = self.node(q.where)
        env = {c: F.col(c) for c in rows.columns}
        made = []
        for t in q.template:
            s, p, o = (_const(x) if isinstance(x, Const) else env.get(x.name, F.lit(None).cast(T.TERM)) for x in (t.s, t.p, t.o))
            made.append(F.struct(s.alias("s"), p.alias("p"), o.alias("o")))
        x = rows.select(F.explode(F.array(*made)).alias("t")).select("t.*")
        x = x.where("s is not null and p is not null and o is not null and s.kind < 2 and p.kind = 0")
        return x.select(F.col("s.lex").alias("s"), F.col("s.kind").alias("s_kind"), F.col("p.lex").alias("p"), "o").withColumn("_k", T.key(F.col("o"))).dropDuplicates(["s", "s_kind", "p", "_k"]).drop("_k")

    def describe(self, q: Query) -> DataFrame:
        rows, names, _ = self.node(q.where)
        parts = []
        for x in q.about:
            if isinstance(x, Const):
                parts.append(self.graph.scan(s=x.lex).select("s", "s_kind", "p", "o"))
            elif x.name in names:
                wanted = rows.select(F.col(x.name)["lex"].alias("s"), F.col(x.name)["kind"].alias("s_kind")).distinct()
                parts.append(self.graph.scan().join(wanted, ["s", "s_kind"], "left_semi").select("s", "s_kind", "p", "o"))
        return reduce(DataFrame.union, parts).distinct()

    def run(self, q: Query) -> DataFrame:
        if q.form == "select":
            return self.select(q)
        if q.form == "ask":
            return self.node(q.where)[0].limit(1).agg((F.count(F.lit(1)) > 0).alias("answer"))
        return self.construct(q) if q.form == "construct" else self.describe(q)


def query(graph, text: str, strict: bool = False) -> DataFrame:
    """The result of a query over a graph: a column of terms for each variable; ``answer`` for ASK; triples else."""
    return Compiler(graph, strict).run(parsed(text))


def ask(graph, text: str) -> bool:
    return bool(query(graph, text).first()[0])


def bindings(rows: DataFrame, most: int | None = 1000) -> list[dict[str, str]]:
    """Solutions as dictionaries of lexical forms on the driver; unbound variables are missing.

    The first ``most`` come, with a warning if there are more; None brings all.
    """
    found = rows.collect() if most is None else rows.limit(most + 1).collect()
    if most is not None and len(found) > most:
        warnings.warn(f"there are more than {most} solutions; the others were left out", stacklevel=2)
        found = found[:most]
    return [{n: r[n]["lex"] for n in rows.columns if r[n] is not None} for r in found]


def flat(rows: DataFrame, **columns: str) -> DataFrame:
    """Plain columns from terms: name="lex", "num", "long", "lang", "dt" or "bool" for each variable."""
    out = []
    for n, what in columns.items():
        t = F.col(n)
        out.append({"long": lambda t=t: t["num"].cast("long"), "bool": lambda t=t: t["num"] != 0}.get(what, lambda t=t, what=what: t[what])().alias(n))
    return rows.select(*out)
