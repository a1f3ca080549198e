"""RDF terms: one canonical string each, and columns that hold a term's value natively.

Canonical strings: <iri>, _:label, "lexical", "lexical"@lang, "lexical"^^<datatype>. The lexical
form is raw (the last quote ends it), language tags are in lower case, and xsd:string isn't
written, so that two terms are the same if and only if their strings are.

A column of a solution holds either such strings (kind TERM) or, where all its values are known to
be of one kind, what the source stored: a number, a timestamp, an IRI's varying part. Native
columns join, compare and push down as they are; strings are built only when they are needed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

XSD = "http://www.w3.org/2001/XMLSchema#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
TYPE = f"<{RDF}type>"

INTEGERS = tuple(XSD + t for t in ("integer", "int", "long", "short", "byte", "nonNegativeInteger", "positiveInteger", "negativeInteger", "nonPositiveInteger", "unsignedInt", "unsignedLong", "unsignedShort", "unsignedByte"))
NUMERIC = (*INTEGERS, XSD + "decimal", XSD + "float", XSD + "double")


@dataclass(frozen=True)
class Kind:
    """What a column holds: name is term, iri, integer, decimal, double, float, string, dateTime
    or boolean; prefix is an iri's constant beginning."""

    name: str
    prefix: str = ""


TERM = Kind("term")
STRING, INTEGER, DECIMAL, DOUBLE, FLOAT, DATETIME, BOOLEAN = (Kind(k) for k in ("string", "integer", "decimal", "double", "float", "dateTime", "boolean"))


def iri(value: str) -> str:
    return f"<{value}>"


def literal(lexical: str, datatype: str | None = None, lang: str | None = None) -> str:
    if lang:
        return f'"{lexical}"@{lang.lower()}'
    return f'"{lexical}"' if not datatype or datatype == XSD + "string" else f'"{lexical}"^^<{datatype}>'


def parts(term: str) -> tuple[str, str, str | None, str | None]:
    """(uri, bnode or literal; its value; language; datatype) of a canonical string."""
    if term.startswith("<"):
        return "uri", term[1:-1], None, None
    if term.startswith("_:"):
        return "bnode", term[2:], None, None
    end = term.rindex('"')
    tail = term[end + 1 :]
    return "literal", term[1:end], tail[1:] if tail.startswith("@") else None, tail[3:-1] if tail.startswith("^^") else None


_ESCAPES = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t"}


def nt(term: str) -> str:
    """The term as N-Triples has it."""
    if not term.startswith('"'):
        return term
    end = term.rindex('"')
    return '"' + "".join(_ESCAPES.get(c, c) for c in term[1:end]) + term[end:]


# --- columns ----------------------------------------------------------------------------------


def nt_column(term: Column) -> Column:
    """nt() for a column of canonical strings."""
    lex = lexical(term)
    for raw, shown in _ESCAPES.items():
        lex = F.replace(lex, F.lit(raw), F.lit(shown))
    return F.when(term.startswith('"'), F.concat(F.lit('"'), lex, F.lit('"'), suffix(term))).otherwise(term)


def typed_text(value: Column, kind: Kind) -> Column:
    """The lexical form of a native value."""
    if kind.name == "dateTime":
        whole = F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss")
        part = F.date_format(value, "SSSSSS")
        return F.when(part == "000000", whole).otherwise(F.concat(whole, F.lit("."), F.regexp_replace(part, "0+$", "")))
    if kind.name == "decimal":
        text = value.cast("decimal(38,10)").cast("string")
        return F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    if kind.name in ("double", "float"):
        return F.when(F.isnan(value), "NaN").when(value == float("inf"), "INF").when(value == float("-inf"), "-INF").otherwise(value.cast("string"))
    return value.cast("string")


def as_term(value: Column, kind: Kind) -> Column:
    """A column of canonical strings; null stays null."""
    if kind == TERM:
        return value
    if kind.name == "iri":
        return F.concat(F.lit("<" + kind.prefix), value.cast("string"), F.lit(">"))
    tail = '"' if kind == STRING else f'"^^<{XSD}{kind.name}>'
    return F.concat(F.lit('"'), typed_text(value, kind), F.lit(tail))


def _last_quote(term: Column) -> Column:
    return F.length(term) - F.instr(F.reverse(term), '"') + 1


def lexical(term: Column) -> Column:
    """The lexical form of a literal, else null."""
    return F.when(term.startswith('"'), F.substring(term, F.lit(2), _last_quote(term) - 2))


def suffix(term: Column) -> Column:
    """What follows a literal's last quote: nothing, @lang or ^^<datatype>."""
    return F.when(term.startswith('"'), F.substring(term, _last_quote(term) + 1, F.length(term)))


def text(term: Column) -> Column:
    """STR(): an IRI's or a literal's characters; null for blank nodes."""
    return F.when(term.startswith("<"), F.substring(term, F.lit(2), F.length(term) - 2)).otherwise(lexical(term))


def datatype(term: Column) -> Column:
    """The datatype's IRI, without brackets; null for anything but a literal."""
    s = suffix(term)
    return F.when(s == "", XSD + "string").when(s.startswith("@"), RDF + "langString").otherwise(F.substring(s, F.lit(4), F.length(s) - 4))


def number(term: Column) -> Column:
    """The value of a numeric literal as a double, else null."""
    numeric = F.regexp_extract(suffix(term), r"^\^\^<http://www\.w3\.org/2001/XMLSchema#(.*)>$", 1)
    lex = F.trim(lexical(term))
    lex = F.when(lex == "INF", "Infinity").when(lex == "-INF", "-Infinity").otherwise(lex)
    return F.when(numeric.isin([t[len(XSD) :] for t in NUMERIC]), lex.try_cast("double"))


def instant(term: Column) -> Column:
    """The value of an xsd:dateTime or xsd:date literal (UTC where it names no zone), else null."""
    kind = suffix(term).isin(f"^^<{XSD}dateTime>", f"^^<{XSD}date>")
    return F.when(kind, lexical(term).try_cast("timestamp"))
