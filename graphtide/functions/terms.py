"""RDF terms as Spark structs, and the scalar functions of the query language as Columns.

A term is struct<kind, lex, dt, lang, num, vtype>: kind 0 IRI, 1 blank node, 2 literal. ``num`` is the numeric
value of a number or boolean, computed once at load so that comparisons stay inside code generation.
Unbound is a null struct.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IRI, BLANK, LITERAL = 0, 1, 2
TERM = "struct<kind:tinyint,lex:string,dt:string,lang:string,num:double,vtype:string>"
# Names of the standard vocabularies.
XSD = "http://www.w3.org/2001/XMLSchema#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
TYPE = RDF + "type"
#: Local names of the numeric datatypes and the value type of each.
NUMERIC = {"integer": "int", "int": "int", "long": "int", "short": "int", "decimal": "float", "double": "float", "float": "float"}


def term(kind, lex: Column, dt: Column | None = None, lang: Column | None = None, num: Column | None = None, vtype: Column | None = None) -> Column:
    null = F.lit(None)
    return F.struct(
        F.lit(kind).cast("tinyint").alias("kind") if isinstance(kind, int) else kind.cast("tinyint").alias("kind"),
        lex.cast("string").alias("lex"),
        (null if dt is None else dt).cast("string").alias("dt"),
        (null if lang is None else lang).cast("string").alias("lang"),
        (null if num is None else num).cast("double").alias("num"),
        (null if vtype is None else vtype).cast("string").alias("vtype"),
    )


def iri(lex: Column) -> Column:
    return F.when(lex.isNotNull(), term(IRI, lex))


def literal(lex: Column, dt: str | None = None, lang: Column | None = None) -> Column:
    """A literal of a datatype; its number is parsed leniently (not a number: null)."""
    local = (dt or "").removeprefix(XSD)
    if local in NUMERIC:
        num, vtype = lex.try_cast("double"), NUMERIC[local]
    elif local == "boolean":
        num, vtype = F.when(F.lower(lex).isin("true", "1"), 1.0).when(F.lower(lex).isin("false", "0"), 0.0), "bool"
    else:
        num, vtype = None, "str"
    return F.when(lex.isNotNull(), term(LITERAL, lex, F.lit(dt), lang, num, F.lit(vtype)))


def number(value: Column) -> Column:
    """A computed number as a term; null stays unbound."""
    v = value.cast("double")
    whole = v == F.floor(v)
    lex = F.when(whole & (F.abs(v) < 1e15), v.cast("long").cast("string")).otherwise(v.cast("string"))
    return F.when(v.isNotNull(), term(LITERAL, lex, F.lit(XSD + "double"), None, v, F.lit("float")))


def string(value: Column) -> Column:
    return F.when(value.isNotNull(), term(LITERAL, value, None, None, None, F.lit("str")))


def boolean(value: Column) -> Column:
    return F.when(value.isNotNull(), term(LITERAL, F.when(value, "true").otherwise("false"), F.lit(XSD + "boolean"), None, value.cast("double"), F.lit("bool")))


def key(t: Column) -> Column:
    """A string that is equal for equal terms: numbers by value, other literals by form, datatype and tag."""
    plain = F.concat(t["kind"].cast("string"), F.lit("\x1f"), t["lex"])
    numeric = F.concat(F.lit("n\x1f"), t["num"].cast("string"))
    tagged = F.concat(plain, F.lit("\x1f"), F.coalesce(F.when(t["dt"] != XSD + "string", t["dt"]), F.lit("")), F.lit("\x1f"), F.coalesce(t["lang"], F.lit("")))
    return F.when(t["kind"] < LITERAL, plain).when(t["vtype"].isin("int", "float") & t["num"].isNotNull(), numeric).otherwise(tagged)


def constant(kind: int, lex: str, dt: str | None = None, lang: str | None = None) -> Column:
    if kind == LITERAL:
        return literal(F.lit(lex), dt, None if lang is None else F.lit(lang))
    return term(kind, F.lit(lex))


# ---------------------------------------------------------------- functions of the query language
# Each takes and gives term Columns. Lenient numbers: what is no number counts as 0 in comparisons.


def _num(t: Column) -> Column:
    return F.coalesce(t["num"], t["lex"].try_cast("double"), F.lit(0.0))


def truth(t: Column) -> Column:
    """Effective boolean value; unbound is null."""
    return F.when(t.isNull(), F.lit(None).cast("boolean")).when(t["kind"] < LITERAL, F.lit(True)).when(t["num"].isNotNull(), t["num"] != 0).otherwise(F.length(t["lex"]) > 0)


def _when(*terms: Column):
    ok = terms[0].isNotNull()
    for t in terms[1:]:
        ok = ok & t.isNotNull()
    return lambda value: F.when(ok, value)


def _regex(pattern: str, flags: str = "") -> str:
    kept = "".join(c for c in flags if c in "ims")
    return f"(?{kept}){pattern}" if kept else pattern


def _date(part):
    return lambda t: number(part(F.timestamp_seconds(_num(t))))


def _compare(op):
    return lambda a, b: boolean(op(F.when(a.isNotNull(), _num(a)).otherwise(0.0), F.when(b.isNotNull(), _num(b)).otherwise(0.0)))


def _arith(op):
    return lambda a, b: number(_when(a, b)(op(_num(a), _num(b))))


def _equal(a: Column, b: Column) -> Column:
    return boolean(F.coalesce(key(a) == key(b), F.lit(False)))


def _substr(s: Column, start: Column, *length: Column) -> Column:
    at = _num(start).cast("int")
    size = _num(length[0]).cast("int") if length else F.length(s["lex"])
    return string(F.when(at >= 1, F.substring(s["lex"], at, size)).otherwise(F.lit("")))


def _before(s: Column, x: Column) -> Column:
    at = F.instr(s["lex"], x["lex"])
    return string(F.when(at > 0, F.substring(s["lex"], F.lit(1), at - 1)).otherwise(F.lit("")))


def _after(s: Column, x: Column) -> Column:
    at = F.instr(s["lex"], x["lex"])
    return string(F.when(at > 0, F.substring(s["lex"], at + F.length(x["lex"]), F.length(s["lex"]))).otherwise(F.lit("")))


_ZONE = r"(Z|[+-]\d\d:\d\d)$"


def _zone(t: Column) -> Column:
    """The zone that a time is written with, or nothing."""
    return F.regexp_extract(t["lex"], _ZONE, 1)


def _zone_duration(t: Column) -> Column:
    zone = _zone(t)
    hours, minutes = F.substring(zone, 2, 2).try_cast("int"), F.substring(zone, 5, 2).try_cast("int")
    parts = F.concat(F.when(F.startswith(zone, F.lit("-")), "-").otherwise(""), F.lit("PT"), F.when(hours > 0, F.concat(hours.cast("string"), F.lit("H"))).otherwise(""), F.when(minutes > 0, F.concat(minutes.cast("string"), F.lit("M"))).otherwise(""))
    return F.when(zone == "", "").when((zone == "Z") | ((hours == 0) & (minutes == 0)), "PT0S").otherwise(parts)


OPERATORS = {
    "=": _equal,
    "!=": lambda a, b: boolean(~F.coalesce(key(a) == key(b), F.lit(False))),
    "<": _compare(lambda a, b: a < b),
    ">": _compare(lambda a, b: a > b),
    "<=": _compare(lambda a, b: a <= b),
    ">=": _compare(lambda a, b: a >= b),
    "+": _arith(lambda a, b: a + b),
    "-": _arith(lambda a, b: a - b),
    "*": _arith(lambda a, b: a * b),
    "/": _arith(F.try_divide),
    "&&": lambda a, b: boolean(truth(a) & truth(b)),
    "||": lambda a, b: boolean(truth(a) | truth(b)),
    "!": lambda a: boolean(~truth(a)),
    "NEG": lambda a: number(-_num(a)),
    "POS": lambda a: number(_num(a)),
}

FUNCTIONS = {
    "STR": lambda t: string(F.when(t.isNotNull(), t["lex"]).otherwise("")),
    "LANG": lambda t: string(F.coalesce(t["lang"], F.lit(""))),
    "DATATYPE": lambda t: string(F.coalesce(t["dt"], F.lit(""))),
    "ISNUMERIC": lambda t: boolean(t["vtype"].isin("int", "float") & t["num"].isNotNull()),
    "ISIRI": lambda t: boolean(t["kind"] == IRI),
    "ISURI": lambda t: boolean(t["kind"] == IRI),
    "ISBLANK": lambda t: boolean(t["kind"] == BLANK),
    "ISLITERAL": lambda t: boolean(t["kind"] == LITERAL),
    "SAMETERM": _equal,
    "LANGMATCHES": lambda a, b: boolean(F.when(b["lex"] == "*", F.length(a["lex"]) > 0).otherwise((F.lower(a["lex"]) == F.lower(b["lex"])) | F.startswith(F.lower(a["lex"]), F.concat(F.lower(b["lex"]), F.lit("-"))))),
    "STRLEN": lambda t: number(F.char_length(t["lex"])),
    "UCASE": lambda t: string(F.upper(t["lex"])),
    "LCASE": lambda t: string(F.lower(t["lex"])),
    "CONCAT": lambda *ts: string(F.concat_ws("", *[t["lex"] for t in ts])),
    "SUBSTR": _substr,
    "CONTAINS": lambda a, b: boolean(F.contains(a["lex"], b["lex"])),
    "STRSTARTS": lambda a, b: boolean(F.startswith(a["lex"], b["lex"])),
    "STRENDS": lambda a, b: boolean(F.endswith(a["lex"], b["lex"])),
    "STRBEFORE": _before,
    "STRAFTER": _after,
    "ABS": lambda t: number(F.abs(_num(t))),
    "CEIL": lambda t: number(F.ceil(_num(t))),
    "FLOOR": lambda t: number(F.floor(_num(t))),
    "ROUND": lambda t: number(F.bround(_num(t), 0)),
    "RAND": lambda: number(F.rand()),
    "NOW": lambda: number(F.unix_timestamp(F.current_timestamp())),
    "YEAR": _date(F.year),
    "MONTH": _date(F.month),
    "DAY": _date(F.dayofmonth),
    "HOURS": _date(F.hour),
    "MINUTES": _date(F.minute),
    "SECONDS": _date(F.second),
    "TZ": lambda t: string(_zone(t)),
    "TIMEZONE": lambda t: string(_zone_duration(t)),
    "XSD:DATETIME": lambda t: number(F.unix_micros(t["lex"].try_cast("timestamp")) / 1e6),
    "COALESCE": lambda *ts: F.coalesce(*ts),
    "IF": lambda c, a, b: F.when(truth(c), a).otherwise(b),
    "MD5": lambda t: string(F.md5(t["lex"])),
    "SHA1": lambda t: string(F.sha1(t["lex"])),
    "SHA256": lambda t: string(F.sha2(t["lex"], 256)),
    "SHA384": lambda t: string(F.sha2(t["lex"], 384)),
    "SHA512": lambda t: string(F.sha2(t["lex"], 512)),
    "STRLANG": lambda a, b: F.when(a.isNotNull(), term(LITERAL, a["lex"], None, b["lex"], None, F.lit("str"))),
    "STRDT": lambda a, b: F.when(a.isNotNull(), term(LITERAL, a["lex"], b["lex"], None, F.when(F.startswith(b["lex"], F.lit(XSD)), a["lex"].try_cast("double")), F.when(F.substring_index(b["lex"], "#", -1).isin(*NUMERIC), "float").otherwise("str"))),
    "IRI": lambda t: iri(t["lex"]),
    "URI": lambda t: iri(t["lex"]),
    "UUID": lambda: iri(F.concat(F.lit("urn:uuid:"), F.uuid())),
    "STRUUID": lambda: string(F.uuid()),
    "ENCODE_FOR_URI": lambda t: string(F.regexp_replace(F.url_encode(t["lex"]), r"\+", "%20")),
}


def regex(t: Column, pattern: str, flags: str = "") -> Column:
    """A bad pattern matches nothing."""
    import re

    try:
        re.compile(pattern)
    except re.error:
        return boolean(F.lit(False))
    return boolean(t["lex"].rlike(_regex(pattern, flags)))


def replace(t: Column, pattern: str, by: str, flags: str = "") -> Column:
    return string(F.regexp_replace(t["lex"], F.lit(_regex(pattern, flags)), F.lit(by)))
