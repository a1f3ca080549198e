"""Expressions over solutions: values of known or unknown kind, errors as nulls.

A value is a column with a Kind. Where kinds are known, comparisons and arithmetic work on native
columns, which Catalyst can push down; where they aren't, terms are decoded by built-in functions
as the row has them. NUMBER values are computed numbers of unknown type: a struct of the value and
its rank (integer, decimal, float, double).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera import terms as T
from tessera.plans.algebra import Expr
from tessera.terms import BOOLEAN, DATETIME, DECIMAL, DOUBLE, FLOAT, INTEGER, STRING, TERM, XSD, Kind

NUMBER = Kind("number")
RANKS = ("integer", "decimal", "float", "double")
_NUMERIC = ("integer", "decimal", "float", "double", "number")
_CUSTOM: dict[str, Callable[..., Column]] = {}


def register_function(iri: str, function: Callable[..., Column]) -> None:
    """Make function the extension function `iri`: it gets and returns columns of canonical terms."""
    _CUSTOM[iri] = function


class Unsupported(ValueError):
    """An expression that this engine doesn't evaluate."""


@dataclass
class Value:
    col: Column
    kind: Kind

    @property
    def numeric(self) -> bool:
        return self.kind.name in _NUMERIC


def constant(term: str) -> Value:
    kind, value, lang, datatype = T.parts(term)
    if kind == "literal" and not lang:
        try:
            if datatype is None:
                return Value(F.lit(value), STRING)
            name = datatype.removeprefix(XSD)
            if datatype in T.INTEGERS and name == "integer" and str(int(value)) == value and abs(int(value)) < 1 << 62:
                return Value(F.lit(int(value)), INTEGER)
            if name == "decimal":
                return Value(F.lit(Decimal(value)), DECIMAL)
            if name == "double" and value not in ("NaN", "INF", "-INF"):
                return Value(F.lit(float(value)), DOUBLE)
            if name == "boolean" and value in ("true", "false"):
                return Value(F.lit(value == "true"), BOOLEAN)
        except (ValueError, ArithmeticError):
            pass
    return Value(F.lit(term), TERM)


def error(kind: str = "string") -> Column:
    return F.lit(None).cast(kind)


# --- decoding ---------------------------------------------------------------------------------


def as_term(v: Value) -> Column:
    if v.kind != NUMBER:
        return T.as_term(v.col, v.kind)
    x, rank = v.col["x"], v.col["rank"]
    return (
        F.when(rank == 0, T.as_term(x.try_cast("long"), INTEGER))
        .when(rank == 1, T.as_term(x.try_cast("decimal(38,10)"), DECIMAL))
        .when(rank == 2, T.as_term(x, FLOAT))
        .when(x.isNotNull(), T.as_term(x, DOUBLE))
    )


def as_number(v: Value) -> Column:
    """A double (a long for integers, a decimal for decimals of known kind); null if not numeric."""
    if v.kind == NUMBER:
        return v.col["x"]
    if v.numeric:
        return v.col
    return T.number(v.col) if v.kind == TERM else error("double")


def rank(v: Value) -> Column:
    if v.kind == NUMBER:
        return v.col["rank"]
    if v.numeric:
        return F.lit(RANKS.index(v.kind.name))
    name = F.substring_index(T.datatype(v.col), "#", -1)
    return F.when(name == "double", 3).when(name == "float", 2).when(name == "decimal", 1).otherwise(0)


def as_text(v: Value) -> Column:
    """STR(): the characters of an IRI or a literal."""
    if v.kind == TERM:
        return T.text(v.col)
    if v.kind == NUMBER:
        return T.text(as_term(v))
    if v.kind.name == "iri":
        return F.concat(F.lit(v.kind.prefix), v.col.cast("string"))
    return T.typed_text(v.col, v.kind)


def as_string(v: Value) -> Column:
    """The characters of a plain or language-tagged string; null for other terms."""
    if v.kind == STRING:
        return v.col
    if v.kind != TERM:
        return error()
    s = T.suffix(v.col)
    return F.when((s == "") | s.startswith("@"), T.lexical(v.col))


def as_instant(v: Value) -> Column:
    return v.col if v.kind == DATETIME else T.instant(v.col) if v.kind == TERM else error("timestamp")


def truth(v: Value) -> Column:
    """The effective boolean value; null is an error."""
    if v.kind == BOOLEAN:
        return v.col
    if v.kind == STRING:
        return v.col != ""
    if v.numeric:
        x = as_number(v)
        return (x != 0) & ~F.isnan(x.cast("double"))
    if v.kind != TERM:
        return error("boolean")
    x = T.number(v.col)
    return (
        F.when(v.col == f'"true"^^<{XSD}boolean>', True)
        .when(v.col == f'"1"^^<{XSD}boolean>', True)
        .when(T.suffix(v.col) == f"^^<{XSD}boolean>", False)
        .when((T.suffix(v.col) == "") | T.suffix(v.col).startswith("@"), T.lexical(v.col) != "")
        .when(x.isNotNull(), (x != 0) & ~F.isnan(x))
    )


def boolean(c: Column) -> Value:
    return Value(c, BOOLEAN)


def like(v: Value, s: Column) -> Value:
    """s with v's language tag, if it has one."""
    if v.kind == STRING:
        return Value(s, STRING)
    tail = F.coalesce(T.suffix(v.col), F.lit("")) if v.kind == TERM else F.lit("")
    return Value(F.concat(F.lit('"'), s, F.lit('"'), F.when(tail.startswith("@"), tail).otherwise("")), TERM)


# --- comparison -------------------------------------------------------------------------------


def equal(a: Value, b: Value) -> Column:
    """SPARQL's =: by value for numbers, strings, booleans and instants, else by term."""
    if a.numeric and b.numeric:
        return _numbers(a, b, lambda x, y: x == y)
    if a.kind == b.kind and a.kind != TERM:
        return a.col == b.col if a.kind.name != "iri" or a.kind.prefix == b.kind.prefix else as_term(a) == as_term(b)
    if a.kind != TERM and b.kind != TERM and "iri" in (a.kind.name, b.kind.name) and a.kind.name != b.kind.name:
        return F.when(a.col.isNotNull() & b.col.isNotNull(), False)
    x, y = as_term(a), as_term(b)
    known: list[tuple[Column, Column]] = []
    if _may_be(a, "number") and _may_be(b, "number"):
        known.append((as_number(a).cast("double"), as_number(b).cast("double")))
    if _may_be(a, "instant") and _may_be(b, "instant"):
        known.append((as_instant(a), as_instant(b)))
    out = F.when(x == y, True)
    for m, n in known:
        out = out.when(m.isNotNull() & n.isNotNull(), m == n)
    # two literals of types that can't be compared by value are an error, not different
    plain = lambda t: T.suffix(t).isin("", f"^^<{XSD}boolean>") | T.suffix(t).startswith("@")
    strange = x.startswith('"') & y.startswith('"') & ~plain(x) & ~plain(y)
    return out.when(strange, error("boolean")).when(x.isNotNull() & y.isNotNull(), False)


def _may_be(v: Value, what: str) -> bool:
    return v.kind == TERM or (v.numeric if what == "number" else v.kind == DATETIME if what == "instant" else v.kind == STRING)


def _numbers(a: Value, b: Value, how: Callable[[Column, Column], Column]) -> Column:
    x, y = as_number(a), as_number(b)
    return how(x, y) if a.kind == b.kind or {a.kind.name, b.kind.name} <= {"integer", "decimal"} else how(x.cast("double"), y.cast("double"))


def compare(op: str, a: Value, b: Value) -> Column:
    how = {"<": lambda x, y: x < y, ">": lambda x, y: x > y, "<=": lambda x, y: x <= y, ">=": lambda x, y: x >= y}[op]
    if a.numeric and b.numeric:
        found = _numbers(a, b, how)
        for v in (a, b):  # to Spark, NaN is above all numbers; it is comparable with none
            found = found & ~F.isnan(as_number(v).cast("double")) if v.kind.name in ("double", "float") else found
        return found
    if a.kind == b.kind and a.kind in (STRING, DATETIME, BOOLEAN):
        return how(a.col, b.col)
    out: Column | None = None
    for what, get in (("number", lambda v: as_number(v).cast("double")), ("instant", as_instant), ("string", as_string)):
        if _may_be(a, what) and _may_be(b, what):
            x, y = get(a), get(b)
            found = how(x, y)
            out = F.when(x.isNotNull() & y.isNotNull(), found) if out is None else out.when(x.isNotNull() & y.isNotNull(), found)
    return error("boolean") if out is None else out


def order_keys(v: Value) -> list[Column]:
    """Columns that sort as ORDER BY does: unbound, blank nodes, IRIs, literals by value."""
    if v.kind == NUMBER:
        return [v.col["x"]]
    if v.kind.name == "iri":
        return [v.col.cast("string")]
    if v.kind != TERM:
        return [v.col]
    place = F.when(v.col.isNull(), 0).when(v.col.startswith("_:"), 1).when(v.col.startswith("<"), 2).otherwise(3)
    return [place, T.number(v.col), T.instant(v.col), F.coalesce(T.lexical(v.col), v.col), v.col]


# --- arithmetic -------------------------------------------------------------------------------


def arithmetic(op: str, a: Value, b: Value) -> Value:
    x, y = as_number(a), as_number(b)
    both = {a.kind, b.kind}
    if both == {INTEGER} and op != "/":
        return Value({"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op](x.cast("long"), y.cast("long")), INTEGER)
    if both <= {INTEGER, DECIMAL}:
        x, y = x.cast("decimal(28,10)"), y.cast("decimal(28,10)")
        out = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply, "/": F.try_divide}[op](x, y)
        return Value(out.cast("decimal(38,10)"), DECIMAL)
    x, y = x.cast("double"), y.cast("double")
    if op == "/":
        # dividing by zero is an error for exact numbers and infinite for others
        zero = F.when(y == 0, F.when(x > 0, float("inf")).when(x < 0, float("-inf")).otherwise(float("nan")))
        out = F.when(y != 0, F.try_divide(x, y)).otherwise(zero)
    else:
        out = {"+": x + y, "-": x - y, "*": x * y}[op]
    if a.kind in (DOUBLE,) or b.kind in (DOUBLE,):
        return Value(out, DOUBLE)
    high = F.greatest(rank(a), rank(b))
    high = F.greatest(high, F.lit(1)) if op == "/" else high
    if op == "/":
        out = F.when((high <= 1) & (y == 0), error("double")).otherwise(out)
    return Value(F.when(out.isNotNull(), F.struct(out.alias("x"), high.cast("int").alias("rank"))), NUMBER)


def keep_rank(v: Value, function: Callable[[Column], Column]) -> Value:
    """A function from numbers to numbers of the same type."""
    if v.kind in (INTEGER, DECIMAL, DOUBLE, FLOAT):
        kinds = {"integer": "long", "decimal": "decimal(38,10)", "double": "double", "float": "double"}
        return Value(function(v.col).cast(kinds[v.kind.name]), v.kind)
    x = as_number(v)
    return Value(F.when(x.isNotNull(), F.struct(function(x.cast("double")).cast("double").alias("x"), rank(v).cast("int").alias("rank"))), NUMBER)


# --- functions --------------------------------------------------------------------------------


def _regex(pattern: Column, flags: Column | None) -> Column:
    if flags is None:
        return pattern
    inline = F.concat_ws("", *[F.when(flags.contains(f), f) for f in "ismx"])
    prefix = F.when(inline == "", "").otherwise(F.concat(F.lit("(?"), inline, F.lit(")")))
    return F.when(flags.contains("q"), F.concat(prefix, F.lit("\\Q"), pattern, F.lit("\\E"))).otherwise(F.concat(prefix, pattern))


def _zone(v: Value) -> Column:
    return F.regexp_extract(as_text(v), r"(Z|[+-]\d\d:\d\d)$", 1)


def _local(v: Value) -> Column:
    """The instant's clock time in the zone that the literal names."""
    if v.kind == DATETIME:
        return v.col
    at = as_instant(v)
    return F.when(at.isNotNull(), F.regexp_replace(as_text(v), r"(Z|[+-]\d\d:\d\d)$", "").try_cast("timestamp"))


def _cast(name: str, v: Value) -> Value:
    s = F.trim(as_text(v))
    plain = v.kind != TERM or None
    if name == "string":
        return Value(as_text(v), STRING)
    if name == "boolean":
        x = as_number(v)
        return boolean(F.when(s.isin("true", "1"), True).when(s.isin("false", "0"), False).when(x.isNotNull(), x != 0) if plain is None or v.numeric or v.kind in (STRING, BOOLEAN) else error("boolean"))
    number = as_number(v) if v.numeric else s
    if v.kind == BOOLEAN:
        number = v.col.cast("int")
    if name == "integer":
        ok = F.coalesce(s.rlike(r"^[+-]?\d+$"), F.lit(False)) if v.kind == STRING else F.lit(True)
        return Value(F.when(ok, (number if v.numeric or v.kind == BOOLEAN else number.try_cast("double")).try_cast("long")), INTEGER)
    if name == "decimal":
        return Value((number if v.numeric or v.kind == BOOLEAN else F.when(number.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$|[eE]"), number)).try_cast("decimal(38,10)"), DECIMAL)
    if name in ("double", "float"):
        number = number if v.numeric or v.kind == BOOLEAN else F.when(number == "INF", "Infinity").when(number == "-INF", "-Infinity").otherwise(number)
        return Value(number.try_cast("double"), DOUBLE if name == "double" else FLOAT)
    if name == "dateTime":
        return Value(v.col if v.kind == DATETIME else F.when(s.rlike(r"^\d{4}-\d\d-\d\dT"), s.try_cast("timestamp")), DATETIME)
    raise Unsupported(f"no cast to {name}")


_DIGESTS = {"MD5": lambda s: F.md5(s), "SHA1": lambda s: F.sha1(s), "SHA256": lambda s: F.sha2(s, 256), "SHA384": lambda s: F.sha2(s, 384), "SHA512": lambda s: F.sha2(s, 512)}


class Evaluator:
    """Expressions to values, given the value of each variable (None: never bound)."""

    def __init__(self, variable: Callable[[str], Value | None], exists: Callable[[Expr], Column] | None = None):
        self.variable, self.exists = variable, exists

    def condition(self, e: Expr) -> Column:
        return truth(self(e))

    def __call__(self, e: Expr) -> Value:
        if e.op == "var":
            return self.variable(e.args[0]) or Value(error(), TERM)
        if e.op == "term":
            return constant(e.args[0])
        if e.op in ("exists", "not exists"):
            if self.exists is None:
                raise Unsupported("EXISTS is not evaluated here")
            return boolean(self.exists(e))
        if e.op == "&&":
            return boolean(self.condition(e.args[0]) & self.condition(e.args[1]))
        if e.op == "||":
            return boolean(self.condition(e.args[0]) | self.condition(e.args[1]))
        if e.op == "!":
            return boolean(~self.condition(e.args[0]))
        if e.op == "BOUND":
            found = self.variable(e.args[0].args[0])
            return boolean(found.col.isNotNull() if found else F.lit(False))
        if e.op == "COALESCE":
            return self._choose([self(a) for a in e.args], lambda cols: F.coalesce(*cols))
        if e.op == "IF":
            test, values = self.condition(e.args[0]), [self(a) for a in e.args[1:]]
            return self._choose(values, lambda cols: F.when(test, cols[0]).when(~test, cols[1]))
        if e.op == "call":
            return self._call(e)
        args = [self(a) for a in e.args]
        if e.op == "=":
            return boolean(equal(*args))
        if e.op == "!=":
            return boolean(~equal(*args))
        if e.op in ("<", ">", "<=", ">="):
            return boolean(compare(e.op, *args))
        if e.op == "in":
            tests = [equal(args[0], b) for b in args[1:]]
            out = F.lit(False)
            for t in tests:
                out = out | t
            return boolean(out)
        if e.op in ("+", "-", "*", "/"):
            return arithmetic(e.op, *args)
        if e.op == "neg":
            return keep_rank(args[0], lambda x: -x)
        function = getattr(self, f"_f_{e.op.lower()}", None)
        if function:
            return function(*args)
        if e.op in _DIGESTS:
            return Value(_DIGESTS[e.op](as_string(args[0])), STRING)
        raise Unsupported(f"{e.op} is not evaluated")

    @staticmethod
    def _choose(values: list[Value], how: Callable[[list[Column]], Column]) -> Value:
        kinds = {v.kind for v in values}
        if len(kinds) == 1:
            return Value(how([v.col for v in values]), values[0].kind)
        return Value(how([as_term(v) for v in values]), TERM)

    def _call(self, e: Expr) -> Value:
        name = e.extra["iri"]
        args = [self(a) for a in e.args]
        if name.startswith(XSD):
            return _cast(name[len(XSD) :], *args)
        if name in _CUSTOM:
            return Value(_CUSTOM[name](*[as_term(a) for a in args]), TERM)
        raise Unsupported(f"no function is registered as {name}")

    # terms
    def _f_str(self, a):
        return Value(as_text(a), STRING)

    def _f_lang(self, a):
        t = as_term(a)
        return Value(F.when(t.startswith('"'), F.when(T.suffix(t).startswith("@"), F.substring(T.suffix(t), 2, 1000)).otherwise("")), STRING)

    def _f_datatype(self, a):
        return Value(F.concat(F.lit("<"), T.datatype(as_term(a)), F.lit(">")), TERM)

    def _f_langmatches(self, a, b):
        tag, wide = F.lower(as_string(a)), F.lower(as_string(b))
        return boolean(F.when(wide == "*", tag != "").otherwise((tag == wide) | tag.startswith(F.concat(wide, F.lit("-")))))

    def _f_iri(self, a):
        t = as_term(a)
        return Value(F.when(t.startswith("<"), t).otherwise(F.concat(F.lit("<"), as_string(a), F.lit(">"))), TERM)

    _f_uri = _f_iri

    def _f_bnode(self, *a):
        """With a label: the same node wherever a solution has that label, another in each solution."""
        row = F.concat(F.lit("|"), F.monotonically_increasing_id().cast("string"))
        return Value(F.concat(F.lit("_:b"), F.md5(F.concat(as_string(a[0]), row)) if a else F.replace(F.uuid(), F.lit("-"), F.lit(""))), TERM)

    def _f_strdt(self, a, b):
        kind = T.text(as_term(b))
        return Value(F.when(kind == XSD + "string", F.concat(F.lit('"'), as_string(a), F.lit('"'))).otherwise(F.concat(F.lit('"'), as_string(a), F.lit('"^^<'), kind, F.lit(">"))), TERM)

    def _f_strlang(self, a, b):
        return Value(F.concat(F.lit('"'), as_string(a), F.lit('"@'), F.lower(as_string(b))), TERM)

    def _f_uuid(self):
        return Value(F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">")), TERM)

    def _f_struuid(self):
        return Value(F.uuid(), STRING)

    def _f_sameterm(self, a, b):
        return boolean(a.col == b.col if a.kind == b.kind and a.kind != NUMBER else as_term(a) == as_term(b))

    def _f_isiri(self, a):
        return boolean(as_term(a).startswith("<"))

    _f_isuri = _f_isiri

    def _f_isblank(self, a):
        return boolean(as_term(a).startswith("_:"))

    def _f_isliteral(self, a):
        return boolean(as_term(a).startswith('"'))

    def _f_isnumeric(self, a):
        return boolean(F.when(as_term(a).isNotNull(), as_number(a).isNotNull()))

    # strings
    def _f_strlen(self, a):
        return Value(F.length(as_string(a)).cast("long"), INTEGER)

    def _f_substr(self, a, start, n=None):
        s, at = as_string(a), F.round(as_number(start).cast("double")).cast("int")
        if n is None:
            return like(a, F.substring(s, F.greatest(at, F.lit(1)), F.length(s)))
        end = at + F.round(as_number(n).cast("double")).cast("int")
        first = F.greatest(at, F.lit(1))
        return like(a, F.substring(s, first, F.greatest(end - first, F.lit(0))))

    def _f_ucase(self, a):
        return like(a, F.upper(as_string(a)))

    def _f_lcase(self, a):
        return like(a, F.lower(as_string(a)))

    def _f_strstarts(self, a, b):
        return boolean(as_string(a).startswith(as_string(b)))

    def _f_strends(self, a, b):
        return boolean(as_string(a).endswith(as_string(b)))

    def _f_contains(self, a, b):
        return boolean(as_string(a).contains(as_string(b)))

    def _f_strbefore(self, a, b):
        s, t = as_string(a), as_string(b)
        return self._part(a, s, t, F.substring(s, F.lit(1), F.position(t, s) - 1))

    def _f_strafter(self, a, b):
        s, t = as_string(a), as_string(b)
        return self._part(a, s, t, F.substring(s, F.position(t, s) + F.length(t), F.length(s)))

    @staticmethod
    def _part(a, s, t, found):
        v = like(a, found)
        return Value(F.when(s.contains(t), as_term(v)).when(s.isNotNull() & t.isNotNull(), F.lit('""')), TERM)

    def _f_concat(self, *args):
        if all(a.kind == STRING for a in args):
            return Value(F.concat(*[a.col for a in args]) if args else F.lit(""), STRING)
        tails = [F.coalesce(T.suffix(as_term(a)), F.lit("")) for a in args]
        same = F.lit(True)
        for t in tails[1:]:
            same = same & (t == tails[0])
        body = F.concat(*[as_string(a) for a in args])
        return Value(F.concat(F.lit('"'), body, F.lit('"'), F.when(same & tails[0].startswith("@"), tails[0]).otherwise("")), TERM)

    def _f_encode_for_uri(self, a):
        s = F.url_encode(as_string(a))
        for raw, shown in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
            s = F.replace(s, F.lit(raw), F.lit(shown))
        return Value(s, STRING)

    def _f_regex(self, a, pattern, flags=None):
        return boolean(F.rlike(as_string(a), _regex(as_string(pattern), as_string(flags) if flags else None)))

    def _f_replace(self, a, pattern, new, flags=None):
        return like(a, F.regexp_replace(as_string(a), _regex(as_string(pattern), as_string(flags) if flags else None), as_string(new)))

    # numbers
    def _f_abs(self, a):
        return keep_rank(a, F.abs)

    def _f_round(self, a):
        return keep_rank(a, lambda x: F.floor(x.cast("double") + 0.5))

    def _f_ceil(self, a):
        return keep_rank(a, F.ceil)

    def _f_floor(self, a):
        return keep_rank(a, F.floor)

    def _f_rand(self):
        return Value(F.rand(), DOUBLE)

    # dates
    def _f_now(self):
        return Value(F.current_timestamp(), DATETIME)

    def _f_year(self, a):
        return Value(F.year(_local(a)).cast("long"), INTEGER)

    def _f_month(self, a):
        return Value(F.month(_local(a)).cast("long"), INTEGER)

    def _f_day(self, a):
        return Value(F.dayofmonth(_local(a)).cast("long"), INTEGER)

    def _f_hours(self, a):
        return Value(F.hour(_local(a)).cast("long"), INTEGER)

    def _f_minutes(self, a):
        return Value(F.minute(_local(a)).cast("long"), INTEGER)

    def _f_seconds(self, a):
        return Value(F.extract(F.lit("SECONDS"), _local(a)).cast("decimal(38,10)"), DECIMAL)

    def _f_tz(self, a):
        return Value(F.when(as_instant(a).isNotNull(), _zone(a)), STRING)

    def _f_timezone(self, a):
        z = _zone(a)
        hours, minutes = F.regexp_extract(z, r"(\d\d):", 1).try_cast("int"), F.regexp_extract(z, r":(\d\d)", 1).try_cast("int")
        part = F.concat(F.when(z.startswith("-"), "-").otherwise(""), F.lit("PT"), F.when(hours > 0, F.concat(hours.cast("string"), F.lit("H"))).otherwise(""), F.when(minutes > 0, F.concat(minutes.cast("string"), F.lit("M"))).otherwise(""))
        text = F.when(z.isin("Z", "+00:00", "-00:00"), "PT0S").when(z != "", part)
        return Value(F.concat(F.lit('"'), text, F.lit(f'"^^<{XSD}dayTimeDuration>')), TERM)
