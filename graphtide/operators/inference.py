"""Forward chaining over graphs: rules as joins, the RDFS and OWL rules, and query-time types.

Rules are evaluated semi-naively: in each round at least one atom of a body is matched against the facts that
the last round found, and facts already known are taken out by an anti-join. Rules that only chain one
predicate are closed by doubling paths over nodes instead.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphtide.functions import terms as T
from graphtide.plans.sparql import Compiler
from graphtide.plans.sparql_parser import Const, Pattern, Var

from .closure import reach, settle
from .graph import DEFAULT, QUAD, Graph, dealt, distinct, identified


@dataclass(frozen=True)
class Rule:
    """name: body patterns imply head patterns."""

    name: str
    body: tuple[Pattern, ...]
    head: tuple[Pattern, ...]


def _v(x: str):
    return Var(x[1:]) if x.startswith("?") else Const(T.IRI, x)


def rule(name: str, body: list[tuple[str, str, str]], head: list[tuple[str, str, str]]) -> Rule:
    """A rule from triples of strings; those with a question mark in front are variables."""
    made = lambda ts: tuple(Pattern(*map(_v, t)) for t in ts)
    return Rule(name, made(body), made(head))


def rdfs_rules() -> list[Rule]:
    sub, prop = T.RDFS + "subClassOf", T.RDFS + "subPropertyOf"
    return [
        rule("domain", [("?x", "?p", "?o"), ("?p", T.RDFS + "domain", "?c")], [("?x", T.TYPE, "?c")]),
        rule("range", [("?x", "?p", "?o"), ("?p", T.RDFS + "range", "?c")], [("?o", T.TYPE, "?c")]),
        rule("subclass-chain", [("?a", sub, "?b"), ("?b", sub, "?c")], [("?a", sub, "?c")]),
        rule("subclass-type", [("?x", T.TYPE, "?a"), ("?a", sub, "?b")], [("?x", T.TYPE, "?b")]),
        rule("subproperty-chain", [("?a", prop, "?b"), ("?b", prop, "?c")], [("?a", prop, "?c")]),
        rule("subproperty-use", [("?x", "?p", "?o"), ("?p", prop, "?q")], [("?x", "?q", "?o")]),
        rule("class-as-type", [("?a", sub, "?b")], [("?a", T.TYPE, "?b")]),
    ]


def owl_rules() -> list[Rule]:
    return [
        rule("inverse", [("?p", T.OWL + "inverseOf", "?q"), ("?x", "?p", "?y")], [("?y", "?q", "?x")]),
        rule("symmetric", [("?p", T.TYPE, T.OWL + "SymmetricProperty"), ("?x", "?p", "?y")], [("?y", "?p", "?x")]),
        rule("transitive", [("?p", T.TYPE, T.OWL + "TransitiveProperty"), ("?x", "?p", "?y"), ("?y", "?p", "?z")], [("?x", "?p", "?z")]),
        rule("functional", [("?p", T.TYPE, T.OWL + "FunctionalProperty"), ("?x", "?p", "?y"), ("?x", "?p", "?z")], [("?y", T.OWL + "sameAs", "?z")]),
    ]


#: Nodes that one of a pair may meet others at, and parts that those of a node are dealt over.
MANY, SALTS = 64, 16


class _Split:
    """Scans the known facts, or the last round's for one pattern of a body."""

    def __init__(self, known: Graph, fresh: Graph, which: Pattern):
        self.known, self.fresh, self.which, self.spark, self.functions = known, fresh, which, known.spark, {}

    def scan(self, **constants) -> DataFrame:
        return self.known.scan(**constants)


class _DeltaCompiler(Compiler):
    def pattern(self, t: Pattern) -> DataFrame:
        if t is self.graph.which:
            return Compiler(self.graph.fresh).pattern(t)
        return super().pattern(t)


def _heads(rows: DataFrame, r: Rule) -> DataFrame:
    """The triples that solutions of a body imply; literal subjects and predicates that are no IRI give none."""
    out = []
    for t in r.head:
        s, p, o = (T.constant(x.kind, x.lex) if isinstance(x, Const) else F.col(x.name) for x in (t.s, t.p, t.o))
        out.append(rows.select(s.alias("s"), p.alias("p"), o.alias("o")).where("s.kind < 2 and p.kind = 0").select(F.col("s.lex").alias("s"), F.col("s.kind").alias("s_kind"), F.col("p.lex").alias("p"), "o"))
    return reduce(DataFrame.union, out)


def _chains(r: Rule):
    """Of a rule (?x p ?y), (?y p ?z) -> (?x p ?z), where p is constant or a variable told by one more pattern: p and that pattern."""
    if len(r.body) not in (2, 3) or len(r.head) != 1:
        return None
    for i, j in ((0, 1), (1, 0)):
        links = r.body[-2:]
        x, y = links[i], links[j]
        told = r.body[0] if len(r.body) == 3 else None
        ends = (x.s, x.o, y.o)
        same = x.p == y.p and x.o == y.s and r.head[0] == Pattern(x.s, x.p, y.o)
        free = all(isinstance(v, Var) for v in ends) and len(set(ends)) == 3 and x.p not in ends
        schema = isinstance(x.p, Const) if told is None else told.s == x.p and isinstance(x.p, Var) and isinstance(told.p, Const) and isinstance(told.o, Const)
        if same and free and schema:
            return x.p, told
    return None


def _predicates(known: DataFrame, chain) -> DataFrame:
    """(p): the predicates that a chain rule closes."""
    p, told = chain
    if told is None:
        return known.sparkSession.createDataFrame([(p.lex,)], "p string")
    return Graph(known.withColumn("g", F.lit(DEFAULT)), once=True).scan(p=told.p.lex, o=told.o).where("s_kind = 0").select(F.col("s").alias("p")).distinct()


def _closed(known: DataFrame, chain) -> tuple[DataFrame, DataFrame]:
    """The facts (s, s_kind, p, o) that a chain rule adds to the known ones, and their predicates; a literal can only end a path.

    Nodes are walked as numbers and are named where the facts are read; what is stored are the numbers.
    """
    facts = known.join(_predicates(known, chain), "p", "left_semi")  # known is stored
    links = facts.where("o.kind < 2").select("p", "s_kind", "s", F.col("o.kind").alias("o_kind"), F.col("o.lex").alias("o_lex"))
    both = links.select("p", F.col("s_kind").alias("kind"), F.col("s").alias("lex")).union(links.select("p", "o_kind", "o_lex"))
    nodes = settle(both.distinct().withColumn("id", F.monotonically_increasing_id()))
    named = lambda kind, lex, x: nodes.select("p", F.col("kind").alias(kind), F.col("lex").alias(lex), F.col("id").alias(x))
    direct = settle(links.join(named("s_kind", "s", "a"), ["p", "s_kind", "s"]).join(named("o_kind", "o_lex", "b"), ["p", "o_kind", "o_lex"]).select("a", "b"))
    far = reach(direct, far=True, listed=True)  # its parts are stored
    # Pairs of numbers are unique and known ones are told by number, so the long rows are neither compared nor dealt again.
    # Each number has one name, which a reader of subjects alone needn't look up.
    starts = named("s_kind", "s", "a")
    names = named("o_kind", "o_lex", "b").drop("p").dropDuplicates(["b"])
    rows = far.join(starts, "a").select("s", "s_kind", "p", F.explode("ends").alias("b")).join(names, "b", "left").select("s", "s_kind", "p", T.term(F.col("o_kind"), F.col("o_lex")).alias("o"))
    told = far.select("a").join(starts, "a").select("p").distinct()
    literals = facts.where("o.kind = 2")
    if not literals.limit(1).count():
        return rows, told
    ends = literals.join(named("s_kind", "s", "b"), ["p", "s_kind", "s"]).select("b", "o")
    keys = ["s", "s_kind", "p", "_k"]
    pairs = far.select("a", F.explode("ends").alias("b")).union(direct)
    last = dealt(identified(pairs.join(ends, "b").join(starts, "a").select("s", "s_kind", "p", "o")), *keys).dropDuplicates(keys)
    last = settle(last.join(identified(literals).select(*keys), keys, "left_anti").select("s", "s_kind", "p", "o"))
    return rows.union(last), told.union(last.select("p"))


def _pair(r: Rule, rules: list[Rule]):
    """Of a rule whose head joins the two nodes that meet at a third, and that feeds no rule: the pattern of the head's
    subject, that of its object, and the name of what they share."""
    if len(r.body) != 2 or len(r.head) != 1:
        return None
    a, b, h = *r.body, r.head[0]
    if not all(isinstance(t.p, Const) and isinstance(t.s, Var) and isinstance(t.o, Var) and t.graph is None for t in (a, b, h)):
        return None
    at, ends = {a.s, a.o} & {b.s, b.o}, {a.s, a.o} ^ {b.s, b.o}
    if len(at) != 1 or len(ends) != 2 or {h.s, h.o} != ends or a.s == a.o or b.s == b.o:
        return None
    others = [t for x in rules for t in (*x.body, *(x.head if x is not r else ()))]
    if any(not isinstance(t.p, Const) or t.p == h.p for t in others):
        return None
    return (a, b, at.pop().name) if h.s in (a.s, a.o) else (b, a, at.pop().name)


def _paired(known: DataFrame, r: Rule, pair, told: bool) -> DataFrame | None:
    """The facts that a rule of pairs adds to the known ones, each once; told: some with its predicate are known.

    A pair that meets at several nodes comes at the smallest, so pairs are neither dealt nor compared and only the
    nodes are shuffled. None where a node has more than MANY, which each of its rows would carry.
    """
    c, h = Compiler(Graph(known.withColumn("g", F.lit(DEFAULT)), once=True)), r.head[0]

    def side(t: Pattern, end: str, at: str, name: str) -> DataFrame:
        rows = c.pattern(t).select(F.col(end).alias(name), T.key(F.col(end)).alias("_k"), T.key(F.col(at)).alias("_at"))
        return dealt(rows, "_k").groupBy("_k").agg(F.first(name).alias(name), F.collect_set("_at").alias(f"_{name}s"))

    left, right = settle(side(pair[0], h.s.name, pair[2], "x").where("x.kind < 2")), settle(side(pair[1], h.o.name, pair[2], "y"))
    if max(rows.agg(F.max(F.size(f"_{n}s"))).first()[0] or 0 for rows, n in ((left, "x"), (right, "y"))) > MANY:
        return None
    salts = F.sequence(F.lit(0), F.lit(SALTS - 1))
    a = left.select("x", "_xs", F.explode("_xs").alias("_at"), F.pmod(F.xxhash64("_k"), F.lit(SALTS)).cast("int").alias("_salt"))
    b = right.select("y", "_ys", F.explode("_ys").alias("_at")).withColumn("_salt", F.explode(salts))
    # What is repeated is larger than Spark knows from its files, so it may not be sent whole.
    rows = a.join(b.hint("merge"), ["_at", "_salt"]).where((F.size("_xs") == 1) | (F.size("_ys") == 1) | (F.array_min(F.array_intersect("_xs", "_ys")) == F.col("_at")))
    rows = rows.select(F.col("x.lex").alias("s"), F.col("x.kind").alias("s_kind"), F.lit(h.p.lex).alias("p"), F.col("y").alias("o"))
    if not told:
        return rows
    keys = ["s", "s_kind", "_k"]
    return identified(rows).join(identified(known.where(F.col("p") == h.p.lex)).select(*keys), keys, "left_anti").drop("_k")


def _met(rows: DataFrame, names: set[str]) -> tuple[bool, set[str]]:
    """Whether there are rows, and which of the named predicates they have; names are those that rules state."""
    stated = F.when(F.col("p").isin(*sorted(names)), F.col("p"))
    n, found = rows.agg(F.count(F.lit(1)), F.collect_set(stated)).first()
    return n > 0, set(found)


def infer(graph: Graph, rules: list[Rule], most_rounds: int = 200) -> tuple[Graph, DataFrame]:
    """The graph with all that the rules imply, and the new triples, which go to the default graph.

    Which of the predicates that rules state by name have facts, and new ones, is known in each round, so rules and
    patterns that can match nothing aren't evaluated. Rules of pairs that feed no rule come last and aren't stored. Rules that go on after so many rounds are an error, not a part of the result.
    """
    known = settle(graph.scan().select("s", "s_kind", "p", "o"))
    fresh, found = known, graph.spark.createDataFrame([], QUAD).select("s", "s_kind", "p", "o")
    bag = lambda d: Graph(d.withColumn("g", F.lit(DEFAULT)), once=True)
    chains = [c for c in map(_chains, rules) if c]
    last = [(r, pair) for r in rules if (pair := _pair(r, rules))]
    steps = [r for r in rules if not _chains(r) and not _pair(r, rules)]
    alone = len(chains) == 1 and not steps  # no rule reads what the chain adds, so that isn't stored with its terms
    names = {t.p.lex for r in rules for t in (*r.body, *r.head) if isinstance(t.p, Const)}
    _, present = _met(known, names)  # those with facts
    new = set(present)  # those with facts in fresh
    first, stirred = True, chains  # stirred: the chains whose facts or predicates may be new
    for _ in range(most_rounds):
        told = set()
        for c in stirred:
            if _needs(c) not in present:
                continue
            more, heads = _closed(known, c)
            some, mine = _met(heads, names)
            if some:
                more = more if alone else settle(more)
                known, found = known.union(more), found.union(more)
                fresh = known if first else fresh.union(more)
                present, new = present | mine, new | mine
                told |= {x for x in chains if x is not c and _stirs(more, mine, known, present, x)}
                told |= {c} if _tells(mine, c) else set()
        parts = []
        for r in steps:
            if any(isinstance(t.p, Const) and t.p.lex not in present for t in r.body):
                continue
            for i, t in enumerate(r.body):
                if first and i:
                    break  # in the first round everything is new
                if not first and isinstance(t.p, Const) and t.p.lex not in new:
                    continue
                split = _Split(bag(known), bag(fresh), t)
                rows, _ = _DeltaCompiler(split).bgp(list(r.body))
                parts.append(_heads(rows, r))
        first, fresh, new = False, fresh.limit(0), set()
        if parts:
            made = distinct(reduce(DataFrame.union, parts), often=True)
            keys = ["s", "s_kind", "p", "_k"]
            fresh = settle(identified(made).join(identified(known).select(*keys), keys, "left_anti").drop("_k"))
            some, new = _met(fresh, names)
            if some:
                known, found, present = known.union(fresh), found.union(fresh), present | new
                told |= {x for x in chains if _stirs(fresh, new, known, present, x)}
            elif not told:
                break
        elif not told:
            break
        stirred = [c for c in chains if c in told]
    else:
        raise RuntimeError(f"rules without a fixpoint after {most_rounds} rounds")
    for r, pair in last:
        if all(t.p.lex in present for t in r.body):
            more = _paired(known, r, pair, r.head[0].p.lex in present)
            if more is None:
                made = identified(distinct(_heads(Compiler(bag(known)).bgp(list(r.body))[0], r), often=True))
                keys = ["s", "s_kind", "p", "_k"]
                more = settle(made.join(identified(known).select(*keys), keys, "left_anti").drop("_k"))
            found = found.union(more)
    # What was found is in no graph yet and each once, so nothing needs to be compared.
    return Graph(graph.quads.select("g", "s", "s_kind", "p", "o").unionByName(found.select(F.lit(DEFAULT).alias("g"), "s", "s_kind", "p", "o")), graph.functions), found


def _needs(chain) -> str:
    """The predicate without facts of which a chain rule has nothing to close."""
    p, told = chain
    return p.lex if told is None else told.p.lex


def _tells(met: set[str], chain) -> bool:
    """Whether facts with these predicates may make a predicate one that the chain rule closes."""
    return chain[1] is not None and chain[1].p.lex in met


def _stirs(rows: DataFrame, met: set[str], known: DataFrame, present: set[str], chain) -> bool:
    """Whether facts may give a chain rule more to close."""
    if chain[1] is None or _needs(chain) in met:
        return _needs(chain) in met
    return _needs(chain) in present and rows.join(_predicates(known, chain), "p", "left_semi").limit(1).count() > 0


def subclasses(graph: Graph, predicate: str = T.RDFS + "subClassOf") -> DataFrame:
    """(a, b): a is below b, by one step or more."""
    return reach(graph.scan(p=predicate).select(F.col("s").alias("a"), F.col("o.lex").alias("b")))


class InferredGraph:
    """A graph whose scans see inferred types and sub-properties, without storing them."""

    def __init__(self, graph: Graph):
        self.graph, self.spark, self.functions = graph, graph.spark, graph.functions
        self._types = None
        self._properties = subclasses(graph, T.RDFS + "subPropertyOf")

    def types(self) -> DataFrame:
        """(s, s_kind, c): asserted types, those from domains and ranges, and all above them."""
        if self._types is None:
            g = self.graph
            said = g.scan(p=T.TYPE).select("s", "s_kind", F.col("o.lex").alias("c"))
            for predicate, by_object in ((T.RDFS + "domain", False), (T.RDFS + "range", True)):
                schema = g.scan(p=predicate).select(F.col("s").alias("p"), F.col("o.lex").alias("c"))
                uses = g.scan().join(schema, "p")
                said = said.union(uses.where("o.kind < 2").select("o.lex", "o.kind", "c") if by_object else uses.select("s", "s_kind", "c"))
            above = subclasses(g).select(F.col("a").alias("c"), F.col("b"))
            self._types = said.union(said.join(above, "c").select("s", "s_kind", "b")).distinct()
        return self._types

    def scan(self, s=None, p=None, o=None, g=None, graphs=False) -> DataFrame:
        if p == T.TYPE and not graphs:
            rows = self.types().select("s", "s_kind", F.lit(T.TYPE).alias("p"), T.term(T.IRI, F.col("c")).alias("o"), F.lit(None).cast("string").alias("g"))
        elif p is not None and not graphs:
            below = self._properties.where(F.col("b") == p).select(F.col("a").alias("p"))
            direct = self.graph.scan(p=p, g=g)
            rows = direct.unionByName(self.graph.scan(g=g).join(below, "p", "left_semi").withColumn("p", F.lit(p)))
            rows = distinct(rows.select("s", "s_kind", "p", "o")).withColumn("g", F.lit(None).cast("string"))
        else:
            return self.graph.scan(s, p, o, g, graphs)
        if s is not None:
            rows = rows.where(F.col("s") == s)
        if o is not None:
            rows = rows.where(T.key(F.col("o")) == T.key(T.constant(o.kind, o.lex, o.dt, o.lang)))
        return rows.select("g", "s", "s_kind", "p", "o")

    def query(self, text: str, **options) -> DataFrame:
        from graphtide.plans.sparql import query

        return query(self, text, **options)


class Lattice:
    """A single-parent hierarchy of types with boolean properties: a table (name, parent, properties: map)."""

    def __init__(self, types: DataFrame):
        self.types = types

    @property
    def above(self) -> DataFrame:
        """(a, b): b is an ancestor of a."""
        return reach(self.types.select(F.col("name").alias("a"), F.col("parent").alias("b")))

    def ancestors(self, name: str) -> DataFrame:
        return self.above.where(F.col("a") == name).select(F.col("b").alias("name"))

    def descendants(self, name: str) -> DataFrame:
        return self.above.where(F.col("b") == name).select(F.col("a").alias("name"))

    def children(self, name: str) -> DataFrame:
        return self.types.where(F.col("parent") == name).select("name")

    def siblings(self, name: str) -> DataFrame:
        own = self.types.where(F.col("name") == name).select(F.col("parent").alias("of"))
        return self.types.join(own, F.col("parent") == F.col("of")).where(F.col("name") != name).select("name")

    def is_subtype(self, name: str, other: str) -> bool:
        return name == other or self.ancestors(name).where(F.col("name") == other).limit(1).count() > 0

    def valid_edges(self, edges: DataFrame) -> DataFrame:
        """Edges (source_type, target_type, needs_source, needs_target) with ``valid``: both ends' types have the
        property asked for, or nothing is asked for."""
        props = self.types.select("name", "properties")
        e = edges.join(props.select(F.col("name").alias("source_type"), F.col("properties").alias("ps")), "source_type", "left").join(props.select(F.col("name").alias("target_type"), F.col("properties").alias("pt")), "target_type", "left")
        has = lambda p, need: F.col(need).isNull() | F.coalesce(F.element_at(F.col(p), F.col(need)), F.lit(False))
        return e.withColumn("valid", has("ps", "needs_source") & has("pt", "needs_target")).drop("ps", "pt")


def validate_types(rows: DataFrame, nodes: list[str], edges: list[str]) -> DataFrame:
    """Rows (node_type, edge_type) with ``valid``: both are in the allow-lists, whatever their case."""
    within = lambda c, names: F.upper(F.col(c)).isin(*[n.upper() for n in names])
    return rows.withColumn("valid", within("node_type", nodes) & within("edge_type", edges))
