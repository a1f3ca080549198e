"""Plans of solutions and the operators on them: joins, optionals, negation, unions.

A Plan is a DataFrame with a column per variable (null: unbound), what each column holds, and the
variables that every row binds. Variables that are certain on both sides join by equality; where a
side may leave one unbound, rows are split by which are bound, and each split joins by equality on
what both have (a condition with OR would make Catalyst plan a product).
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import terms as T
from tessera.functions.scalar import NUMBER, Value
from tessera.functions.scalar import as_term as value_term
from tessera.terms import TERM, Kind


def name_of(var: str) -> str:
    """A variable's column: Spark doesn't tell letter case apart, variables do."""
    return re.sub("[A-Z]", lambda m: "$" + m[0].lower(), var).replace(".", "%")


def col_of(var: str, df: DataFrame | None = None) -> Column:
    return df[f"`{name_of(var)}`"] if df is not None else F.col(f"`{name_of(var)}`")


@dataclass
class Plan:
    df: DataFrame
    kinds: dict[str, Kind]
    certain: set[str] = field(default_factory=set)

    def value(self, var: str) -> Value | None:
        return Value(col_of(var), self.kinds[var]) if var in self.kinds else None

    def select(self, names: list[str]) -> Plan:
        names = [v for v in names if v in self.kinds]
        return Plan(self.df.select(*[col_of(v) for v in names]), {v: self.kinds[v] for v in names}, self.certain & set(names))

    def where(self, condition: Column) -> Plan:
        return Plan(self.df.where(condition), self.kinds, self.certain)

    def with_kinds(self, kinds: dict[str, Kind]) -> Plan:
        """The same solutions with columns of other kinds (to canonical terms only)."""
        cols = []
        for v, k in self.kinds.items():
            want = kinds.get(v, k)
            cols.append((col_of(v) if want == k else value_term(Value(col_of(v), k))).alias(name_of(v)))
        return Plan(self.df.select(*cols), {v: kinds.get(v, k) for v, k in self.kinds.items()}, self.certain)

    def distinct(self) -> Plan:
        return Plan(self.df.distinct(), self.kinds, self.certain)


def unit(spark: SparkSession) -> Plan:
    """One solution without variables."""
    return Plan(spark.range(1).select(), {}, set())


def nothing(spark: SparkSession, names: list[str]) -> Plan:
    df = spark.range(0).select(*[F.lit(None).cast("string").alias(name_of(v)) for v in names])
    return Plan(df, dict.fromkeys(names, TERM), set(names))


def _native(term: Column, kind: Kind, dtype: str) -> Column | None:
    """The native value of a canonical term, null if it has none of this kind; None: don't try."""
    if kind.name == "iri":
        start = "<" + kind.prefix
        body = F.substring(term, F.lit(len(start) + 1), F.length(term) - len(start) - 1)
        body = F.when(term.startswith(start), body)
    elif kind.name == "string":
        return F.when(T.suffix(term) == "", T.lexical(term))
    elif kind.name == "integer":
        body = F.when(T.suffix(term) == f"^^<{T.XSD}integer>", T.lexical(term))
    else:
        return None
    value = body.try_cast(dtype)
    return F.when(value.cast("string") == body, value)


def _aligned(left: Plan, right: Plan, keys: list[str]) -> tuple[Plan, Plan, list[tuple[Column, Column]]]:
    """Both sides with the columns that keys are compared by; right's keys get a prefix."""
    cols_l: dict[str, Column] = {}
    cols_r: dict[str, Column] = {}
    for v in keys:
        a, b = left.kinds[v], right.kinds[v]
        x, y = col_of(v), col_of(v)
        if a == b and a != NUMBER:
            pass
        elif a == TERM and (n := _native(x, b, dict(right.df.dtypes)[name_of(v)])) is not None:
            x = n
        elif b == TERM and (n := _native(y, a, dict(left.df.dtypes)[name_of(v)])) is not None:
            y = n
        else:
            x, y = value_term(Value(x, a)), value_term(Value(y, b))
        cols_l[v], cols_r[v] = x, y
    ldf = left.df.withColumns({f"l:{name_of(v)}": c for v, c in cols_l.items()}) if keys else left.df
    rdf = right.df.select(*[col_of(v).alias(f"r:{name_of(v)}") for v in right.kinds], *[c.alias(f"k:{name_of(v)}") for v, c in cols_r.items()])
    pairs = [(F.col(f"`l:{name_of(v)}`"), F.col(f"`k:{name_of(v)}`")) for v in keys]
    return Plan(ldf, left.kinds, left.certain), Plan(rdf, right.kinds, right.certain), pairs


def _on(pairs: list[tuple[Column, Column]]) -> Column:
    out = F.lit(True)
    for i, (a, b) in enumerate(pairs):
        out = (a == b) if i == 0 else out & (a == b)
    return out


Condition = Callable[[Callable[[str], Value | None]], Column]


def _both(left: Plan, right: Plan) -> Callable[[str], Value | None]:
    """Values of variables while both sides stand in one row: left's, where both have one."""

    def value(v: str) -> Value | None:
        if v in left.kinds and (v not in right.kinds or v in left.certain):
            return Value(col_of(v), left.kinds[v])
        if v in left.kinds:
            return Value(F.coalesce(value_term(Value(col_of(v), left.kinds[v])), value_term(Value(F.col(f"`r:{name_of(v)}`"), right.kinds[v]))), TERM)
        return Value(F.col(f"`r:{name_of(v)}`"), right.kinds[v]) if v in right.kinds else None

    return value


def _joined(left: Plan, right: Plan, keys: list[str], how: str, condition: Condition | None = None) -> Plan:
    """Equality on keys, which both sides bind in all rows. how: inner, left, left_semi, left_anti."""
    l, r, pairs = _aligned(left, right, keys)
    on = _on(pairs)
    if condition is not None:
        on = on & F.coalesce(condition(_both(left, right)), F.lit(False)) if keys else F.coalesce(condition(_both(left, right)), F.lit(False))
    if how in ("left_semi", "left_anti"):
        out = l.df.join(r.df, on, how)
        return Plan(out.select(*[col_of(v) for v in left.kinds]), left.kinds, left.certain)
    out = l.df.join(r.df, on, how) if keys or condition is not None or how == "left" else l.df.crossJoin(r.df)
    kinds, cols = {}, []
    for v in left.kinds:
        if how == "inner" and v in keys and left.kinds[v] == TERM and right.kinds[v] not in (TERM, NUMBER):
            kinds[v] = right.kinds[v]
            cols.append(F.col(f"`r:{name_of(v)}`").alias(name_of(v)))
        elif v in right.kinds and v not in keys:
            kinds[v] = left.kinds[v] if left.kinds[v] == right.kinds[v] else TERM
            x, y = Value(col_of(v), left.kinds[v]), Value(F.col(f"`r:{name_of(v)}`"), right.kinds[v])
            cols.append((F.coalesce(x.col, y.col) if kinds[v] != TERM or x.kind == y.kind else F.coalesce(value_term(x), value_term(y))).alias(name_of(v)))
        else:
            kinds[v] = left.kinds[v]
            cols.append(col_of(v))
    for v in right.kinds:
        if v not in left.kinds:
            kinds[v] = right.kinds[v]
            cols.append(F.col(f"`r:{name_of(v)}`").alias(name_of(v)))
    certain = left.certain | right.certain if how == "inner" else set(left.certain)
    return Plan(out.select(*cols), kinds, certain)


def _splits(plan: Plan, names: list[str]) -> list[tuple[Plan, set[str]]]:
    """The rows by which of names are bound."""
    loose = [v for v in names if v not in plan.certain]
    out = []
    for n in range(len(loose) + 1):
        for unbound in combinations(loose, n):
            test = F.lit(True)
            for v in loose:
                test = test & (col_of(v).isNull() if v in unbound else col_of(v).isNotNull())
            bound = set(names) - set(unbound)
            out.append((Plan(plan.df.where(test) if loose else plan.df, plan.kinds, plan.certain | bound), bound))
    return out


def shared(left: Plan, right: Plan) -> list[str]:
    return sorted(set(left.kinds) & set(right.kinds))


def join(left: Plan, right: Plan, condition: Condition | None = None) -> Plan:
    """All pairs of compatible solutions."""
    if not left.kinds and not right.kinds or not right.kinds:
        return _joined(left, right, [], "inner", condition)
    names = shared(left, right)
    if set(names) <= left.certain & right.certain:
        return _joined(left, right, names, "inner", condition)
    out: Plan | None = None
    for l, bl in _splits(left, names):
        for r, br in _splits(right, names):
            part = _joined(l, r, sorted(bl & br), "inner", condition)
            out = part if out is None else union(out, part)
    assert out is not None
    return Plan(out.df, out.kinds, left.certain | right.certain)


def _same(plan: Plan, other: Plan, how: str) -> Plan:
    """Rows of plan that occur (semi) or don't (anti) in other, which has the same columns."""
    kinds = {v: TERM for v in plan.kinds if plan.kinds[v] != other.kinds[v]}
    a, b = (p.with_kinds(kinds) if kinds else p for p in (plan, other))
    right = b.df.select(*[col_of(v).alias(f"r:{name_of(v)}") for v in a.kinds]).distinct()
    on = F.lit(True)
    for i, v in enumerate(a.kinds):
        test = col_of(v).eqNullSafe(F.col(f"`r:{name_of(v)}`"))
        on = test if i == 0 else on & test
    return Plan(a.df.join(right, on, how), a.kinds, plan.certain)


def left_join(left: Plan, right: Plan, condition: Condition | None = None, inner: Plan | None = None) -> Plan:
    """OPTIONAL: left's solutions, extended where right has compatible ones that meet condition.
    inner: the pairs, where they had to be made otherwise (a condition with EXISTS)."""
    names = shared(left, right)
    if inner is None and set(names) <= left.certain & right.certain:
        return _joined(left, right, names, "left", condition)
    found = inner if inner is not None else join(left, right, condition)
    rest = _same(left, found.select(list(left.kinds)), "left_anti")
    out = union(found, rest)
    return Plan(out.df, out.kinds, set(left.certain))


def semi_join(left: Plan, right: Plan, anti: bool = False, condition: Condition | None = None) -> Plan:
    """EXISTS and NOT EXISTS: left's solutions with (without) a compatible one in right."""
    names = shared(left, right)
    how = "left_anti" if anti else "left_semi"
    if set(names) <= left.certain & right.certain:
        if not names and condition is None:
            right = Plan(right.df.limit(1), right.kinds, right.certain)
        return _joined(left, right, names, how, condition)
    found = join(left, right, condition).select(list(left.kinds))
    return _same(left, found, how)


def minus(left: Plan, right: Plan) -> Plan:
    """Left's solutions without those that a compatible one in right shares a bound variable with."""
    names = shared(left, right)
    if not names:
        return left
    if set(names) <= left.certain & right.certain:
        return _joined(left, right, names, "left_anti")
    out: Plan | None = None
    for l, bl in _splits(left, names):
        for r, br in _splits(right, names):
            if bl & br:
                l = _joined(l, r, sorted(bl & br), "left_anti")
        out = l if out is None else union(out, l)
    assert out is not None
    return Plan(out.df, out.kinds, set(left.certain))


def union(left: Plan, right: Plan) -> Plan:
    """All solutions of both (a bag)."""
    kinds = {v: k if left.kinds.get(v, k) == right.kinds.get(v, k) and k != NUMBER else TERM for v, k in {**right.kinds, **left.kinds}.items()}
    sides = []
    for p in (left, right):
        p = p.with_kinds({v: kinds[v] for v in p.kinds})
        sides.append(p)
    types = {name_of(v): t for p in sides for v, t in ((v, dict(p.df.dtypes)[name_of(v)]) for v in p.kinds)}
    frames = [p.df.select(*[(col_of(v) if v in p.kinds else F.lit(None).cast(types[name_of(v)]).alias(name_of(v))) for v in kinds]) for p in sides]
    return Plan(frames[0].union(frames[1]), kinds, left.certain & right.certain)
