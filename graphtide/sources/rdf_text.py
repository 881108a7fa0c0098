"""N-Triples and Turtle: readers and writers."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphtide.functions import terms as T
from graphtide.operators.graph import typed

_IRI, _BLANK, _STR = r"<[^<>\"\s]*>", r"_:\w+", r'\"(?:[^\"\\]|\\.)*\"'
_NT = rf"^\s*({_IRI}|{_BLANK})\s+({_IRI})\s+({_IRI}|{_BLANK}|{_STR}(?:\^\^{_IRI}|@[\w-]+)?)\s*\.\s*(?:#.*)?$"


def _plain(s):
    """A string literal's value from its escaped form."""
    out = F.replace(s, F.lit("\\\\"), F.lit("\x00"))
    for mark, c in (('\\"', '"'), ("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t")):
        out = F.replace(out, F.lit(mark), F.lit(c))
    return F.replace(out, F.lit("\x00"), F.lit("\\"))


def _escaped(s):
    out = F.replace(s, F.lit("\\"), F.lit("\\\\"))
    for c, mark in (('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(c), F.lit(mark))
    return out


def read_ntriples(lines: DataFrame, graph: str = "default") -> DataFrame:
    """Quads of lines (column ``value``, as spark.read.text gives); what is no triple is skipped."""
    part = lambda i: F.regexp_extract("value", _NT, i)
    rows = lines.where(F.col("value").rlike(_NT)).select(part(1).alias("a"), part(2).alias("b"), part(3).alias("c"))
    tail = F.regexp_extract("c", rf"^{_STR}(.*)$", 1)
    quoted = F.startswith("c", F.lit('"'))
    inside = lambda c: F.expr(f"substring({c}, 2, length({c}) - 2)")
    rows = rows.withColumn("tail", tail).select(
        "*",
        F.when(quoted, T.LITERAL).when(F.startswith("c", F.lit("<")), T.IRI).otherwise(T.BLANK).alias("kind"),
        F.when(quoted, _plain(F.regexp_extract("c", r'^"((?:[^"\\]|\\.)*)"', 1))).when(F.startswith("c", F.lit("<")), inside("c")).otherwise(F.col("c")).alias("lex"),
        F.when(F.startswith(tail, F.lit("^^")), F.expr("substring(tail, 4, length(tail) - 4)")).alias("dt"),
        F.when(F.startswith(tail, F.lit("@")), F.expr("substring(tail, 2)")).alias("lang"),
    )
    blank = F.startswith("a", F.lit("_:"))
    return rows.select(F.lit(graph).alias("g"), F.when(blank, F.col("a")).otherwise(inside("a")).alias("s"), F.when(blank, T.BLANK).otherwise(T.IRI).cast("tinyint").alias("s_kind"), inside("b").alias("p"), typed("kind", "lex", "dt", "lang").alias("o"))


def _written(o):
    suffix = F.when(o["lang"].isNotNull(), F.concat(F.lit("@"), o["lang"])).when(o["dt"].isNotNull(), F.concat(F.lit("^^<"), o["dt"], F.lit(">"))).otherwise("")
    quoted = F.concat(F.lit('"'), _escaped(o["lex"]), F.lit('"'), suffix)
    return F.when(o["kind"] == T.LITERAL, quoted).when(o["kind"] == T.IRI, F.concat(F.lit("<"), o["lex"], F.lit(">"))).otherwise(o["lex"])


def _subject():
    return F.when(F.col("s_kind") == T.BLANK, F.col("s")).otherwise(F.concat(F.lit("<"), F.col("s"), F.lit(">")))


def write_ntriples(triples: DataFrame) -> DataFrame:
    """A column ``value`` with a line for each triple, for write.text."""
    return triples.select(F.concat(_subject(), F.lit(" <"), F.col("p"), F.lit("> "), _written(F.col("o")), F.lit(" .")).alias("value"))


def write_turtle(triples: DataFrame, prefixes: dict[str, str]) -> DataFrame:
    """A column ``value`` with a block for each subject; IRIs that fit a prefix are shortened."""

    def short(text):
        for name, space in sorted(prefixes.items(), key=lambda x: len(x[1])):
            text = F.regexp_replace(text, F.lit(rf"^<{re.escape(space)}([A-Za-z0-9_][A-Za-z0-9_-]*)>$"), F.lit(f"{name}:$1"))
        return text

    line = F.concat(short(F.concat(F.lit("<"), F.col("p"), F.lit(">"))), F.lit(" "), short(_written(F.col("o"))))
    rows = triples.select(short(_subject()).alias("s"), line.alias("line"))
    return rows.groupBy("s").agg(F.array_sort(F.collect_list("line")).alias("lines")).select(F.concat(F.col("s"), F.lit(" "), F.array_join("lines", " ;\n    "), F.lit(" .\n")).alias("value"))


# ---------------------------------------------------------------- Turtle, a document at a time

_TURTLE = re.compile(
    r"""(?P<skip>\s+|\#[^\n]*)|(?P<directive>@prefix|@base|PREFIX\b|BASE\b)|(?P<iri><[^<>"{}|^`\\\s]*>)|(?P<long>\"\"\"(?:[^\\]|\\.)*?\"\"\"|'''(?:[^\\]|\\.)*?''')
      |(?P<str>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')|(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)|(?P<type>\^\^)|(?P<num>[+-]?(?:\d+\.\d+|\.\d+|\d+)(?:[eE][+-]?\d+)?)
      |(?P<blank>_:\w+)|(?P<name>(?:[A-Za-z][\w-]*)?:[\w-]*)|(?P<word>true\b|false\b|a\b)|(?P<mark>[.;,()\[\]])""",
    re.VERBOSE,
)


class TurtleError(ValueError):
    """What the reader can't make sense of."""


class _Turtle:
    """One document's statements as (s, s_kind, p, kind, lex, dt, lang)."""

    def __init__(self, text: str, prefixes: dict[str, str], base: str, label: str):
        self.rows, self.prefixes, self.base, self.label, self.made = [], dict(prefixes), base, label, 0
        self.tokens, at = [], 0
        while at < len(text):
            m = _TURTLE.match(text, at)
            if not m:
                raise TurtleError(f"unexpected {text[at : at + 10]!r} at {at}")
            if m.lastgroup != "skip":
                self.tokens.append((m.lastgroup, m[0]))
            at = m.end()
        self.at = 0

    def peek(self, value=None):
        kind, text = self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")
        return text == value if value is not None else kind

    def next(self):
        if self.at == len(self.tokens):
            raise TurtleError("the document ends within a statement")
        self.at += 1
        return self.tokens[self.at - 1]

    def mark(self, value):
        if self.next()[1] != value:
            raise TurtleError(f"expected {value!r}, found {self.tokens[self.at - 1][1]!r}")

    def fresh(self):
        self.made += 1
        return T.BLANK, f"_:{self.label}b{self.made}", None, None

    def run(self):
        while self.at < len(self.tokens):
            if self.peek() == "directive":
                self.directive()
            else:
                s = self.node()
                if not (self.peek(".") and self.tokens[self.at - 1][1] == "]"):
                    self.predicates(s)
                self.mark(".")
        return self.rows

    def directive(self):
        word = self.next()[1]
        if word.lower().endswith("prefix"):
            name = self.next()[1]
            self.prefixes[name[:-1]] = self.resolve(self.next()[1][1:-1])
        else:
            self.base = self.next()[1][1:-1]
        if word[0] == "@":
            self.mark(".")

    def resolve(self, iri):
        return iri if not self.base or re.match(r"\w+:", iri) else self.base + iri

    def node(self):
        kind, text = self.next()
        if kind == "iri":
            return T.IRI, self.resolve(text[1:-1]), None, None
        if kind == "name":
            prefix, local = text.split(":", 1)
            if prefix not in self.prefixes:
                raise TurtleError(f"unknown prefix {prefix!r}")
            return T.IRI, self.prefixes[prefix] + local, None, None
        if kind == "blank":
            return T.BLANK, f"_:{self.label}{text[2:]}", None, None
        if kind == "num":
            dt = "double" if re.search("[eE]", text) else "decimal" if "." in text else "integer"
            return T.LITERAL, text, T.XSD + dt, None
        if kind == "word" and text != "a":
            return T.LITERAL, text, T.XSD + "boolean", None
        if kind in ("str", "long"):
            width = 3 if kind == "long" else 1
            lex = re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t", "r": "\r"}.get(m[1], m[1]), text[width:-width])
            if self.peek() == "lang":
                return T.LITERAL, lex, None, self.next()[1][1:]
            if self.peek() == "type":
                self.next()
                return T.LITERAL, lex, self.node()[1], None
            return T.LITERAL, lex, None, None
        if text == "[":
            s = self.fresh()
            if not self.peek("]"):
                self.predicates(s)
            self.mark("]")
            return s
        if text == "(":
            items = []
            while not self.peek(")"):
                items.append(self.node())
            self.next()
            rest = (T.IRI, T.RDF + "nil", None, None)
            for item in reversed(items):
                cell = self.fresh()
                self.rows += [(cell[1], cell[0], T.RDF + "first", *item), (cell[1], cell[0], T.RDF + "rest", *rest)]
                rest = cell
            return rest
        raise TurtleError(f"expected a node, found {text!r}")

    def predicates(self, s):
        while True:
            if self.peek("a"):
                self.next()
                p = T.TYPE
            else:
                p = self.node()[1]
            while True:
                self.rows.append((s[1], s[0], p, *self.node()))
                if not self.peek(","):
                    break
                self.next()
            while self.peek(";"):
                self.next()
            if self.peek(".") or self.peek("]"):
                return


def read_turtle(documents: DataFrame, graph: str = "default", prefixes: dict[str, str] | None = None, base: str = "") -> DataFrame:
    """Quads of documents (column ``value``, one document a row, as spark.read.text(wholetext=True) gives).

    prefixes are known in every document. Blank nodes of different documents stay apart.
    """
    known = dict(prefixes or {})

    def run(batches):
        for batch in batches:
            rows = []
            for text in batch["value"]:
                label = format(_digest(text), "x")
                rows += _Turtle(text, known, base, label).run()
            yield pd.DataFrame(rows, columns=["s", "s_kind", "p", "kind", "lex", "dt", "lang"])

    rows = documents.select("value").mapInPandas(run, "s string, s_kind int, p string, kind int, lex string, dt string, lang string")
    return rows.select(F.lit(graph).alias("g"), "s", F.col("s_kind").cast("tinyint").alias("s_kind"), "p", typed("kind", "lex", "dt", "lang").alias("o"))


def _digest(text: str) -> int:
    import zlib

    return zlib.crc32(text.encode("utf-8", "surrogatepass"))
