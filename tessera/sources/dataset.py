"""Datasets: what a triple pattern is matched against."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce
from itertools import pairwise

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import terms as T
from tessera.operators.solutions import Plan, col_of, name_of, nothing, union
from tessera.plans.algebra import Triple, Var
from tessera.terms import TERM, Kind


class Dataset:
    """match() and star() give plans of the solutions of triple patterns; quads() everything as
    (s, p, o, g), g being null in the default graph."""

    spark: SparkSession
    #: Matches read stored columns, and are different ones: they need neither be written nor compared.
    direct = False

    def match(self, t: Triple, graph: str | None = None) -> Plan:
        raise NotImplementedError

    def star(self, subject: Var, arms: list[tuple[str, str]], graph: str | None = None) -> Plan | None:
        """Patterns of one subject in one scan, or None where a join has to do it."""
        return None

    def quads(self) -> DataFrame:
        raise NotImplementedError

    def nodes(self, graph: str | None = None) -> DataFrame:
        """(n): all subjects and objects, different ones."""
        q = self.match(Triple(Var("s"), Var("p"), Var("o")), graph)
        q = q.with_kinds({v: TERM for v in q.kinds}).df
        return q.select(F.col("s").alias("n")).union(q.select(F.col("o").alias("n"))).distinct()


def _pattern(df: DataFrame, columns: dict[str, str], given: dict[str, str]) -> Plan:
    """given: position -> constant or variable; columns: position -> column of canonical terms."""
    seen: dict[str, str] = {}
    for position, t in given.items():
        c = F.col(columns[position])
        if not isinstance(t, Var):
            df = df.where(c == t)
        elif t in seen:
            df = df.where(c == F.col(seen[t]))
        else:
            seen[t] = columns[position]
    return Plan(df.select(*[F.col(c).alias(name_of(v)) for v, c in seen.items()]), dict.fromkeys(seen, TERM), set(seen))


@dataclass
class QuadDataset(Dataset):
    """A table of quads (s, p, o, g). merged: the default graph is the union of all graphs, as a
    run's evaluation has it; unique: no triple is in it twice, so that need not be seen to."""

    table: DataFrame
    merged: bool = True
    unique: bool = False

    def __post_init__(self) -> None:
        self.spark = self.table.sparkSession

    def match(self, t: Triple, graph: str | None = None) -> Plan:
        df, given, cols = self.table, {"s": t.s, "p": t.p, "o": t.o}, {"s": "s", "p": "p", "o": "o"}
        keep = ["s", "p", "o"]
        for position in keep:  # below the removal of repeats, where the scan can use them
            if not isinstance(given[position], Var):
                df = df.where(F.col(position) == given[position])
        if graph is None:
            df = df if self.merged else df.where("g is null")
        elif isinstance(graph, Var):
            df, keep = df.where("g is not null"), [*keep, "g"]
            given, cols = {**given, "g": graph}, {**cols, "g": "g"}
        else:
            df = df.where(F.col("g") == graph)
        df = df.select(*keep)
        return _pattern(df if self.unique else df.distinct(), cols, given)  # type: ignore[arg-type]

    def quads(self) -> DataFrame:
        return self.table.select("s", "p", "o", "g")


@dataclass
class Lifted:
    """A relational table as triples: a subject per row, its class, a literal per column and an
    object property per foreign key. The key must be unique; null cells have no triple."""

    df: DataFrame
    prefix: str
    key: Column
    of_class: str
    columns: dict[str, tuple[str, Kind]] = field(default_factory=dict)
    links: dict[str, tuple[str, str]] = field(default_factory=dict)

    def arm(self, p: str) -> tuple[Column, Kind] | None:
        if p == T.TYPE:
            cut = max(self.of_class.rfind("/"), self.of_class.rfind("#")) + 1
            return F.lit(self.of_class[cut:]), Kind("iri", self.of_class[:cut])
        if p in self.columns:
            name, kind = self.columns[p]
            return F.col(name), kind
        if p in self.links:
            name, prefix = self.links[p]
            return F.col(name), Kind("iri", prefix)
        return None


def _is(value: Column, kind: Kind, term: str, dtype: str) -> Column:
    """value stands for the constant term: on the native column where that is exact."""
    what, text, lang, datatype = T.parts(term)
    if kind.name == "iri":
        if what != "uri" or not text.startswith(kind.prefix):
            return F.lit(False)
        rest = text[len(kind.prefix) :]
        if dtype in ("int", "bigint", "smallint", "tinyint"):
            return value == int(rest) if rest.isascii() and rest.isdigit() and str(int(rest)) == rest and len(rest) < 19 else F.lit(False)
        return value == rest
    if what != "literal" or lang:
        return F.lit(False)
    if kind.name == "string":
        return value == text if datatype is None else F.lit(False)
    if kind.name == "integer" and datatype == T.XSD + "integer":
        return value == int(text) if text.lstrip("-").isdigit() and str(int(text)) == text and len(text) < 19 else F.lit(False)
    if datatype != T.XSD + kind.name:
        return F.lit(False)
    exact = T.as_term(value, kind) == term
    if kind.name == "double":
        try:
            return (value == float(text)) & exact
        except ValueError:
            return F.lit(False)
    return exact


class LiftedDataset(Dataset):
    """Tables lifted to triples when they are asked for. A pattern with a constant predicate reads
    the columns it needs of the tables that have it; patterns of one subject are one scan."""

    def __init__(self, tables: Iterable[Lifted]):
        self.tables = list(tables)
        self.spark = self.tables[0].df.sparkSession
        starts = sorted(t.prefix for t in self.tables)  # no row of one table may be named like another's
        self.direct = not any(b.startswith(a) for a, b in pairwise(starts))

    def _rows(self, table: Lifted, subject: str, arms: list[tuple[str, str]]) -> Plan | None:
        df = table.df.withColumn("s:key", table.key)
        types = dict(df.dtypes)
        cols: dict[str, tuple[Column, Kind]] = {}
        kind = Kind("iri", table.prefix)
        if isinstance(subject, Var):
            cols[subject] = (F.col("`s:key`"), kind)
        else:
            df = df.where(_is(table.key, kind, subject, types["s:key"]))
        for p, o in arms:
            found = table.arm(p)
            if found is None:
                return None
            value, k = found
            dtype = "string" if p == T.TYPE else types[(table.columns.get(p) or table.links[p])[0]]
            if p != T.TYPE:
                df = df.where(value.isNotNull())
            if not isinstance(o, Var):
                if p == T.TYPE:
                    if o != f"<{table.of_class}>":
                        return None
                else:
                    df = df.where(_is(value, k, o, dtype))
            elif o in cols:
                x, kx = cols[o]
                df = df.where(x == value if kx == k else T.as_term(x, kx) == T.as_term(value, k))
            else:
                cols[o] = (value, k)
        return Plan(df.select(*[c.alias(name_of(v)) for v, (c, _) in cols.items()]), {v: k for v, (_, k) in cols.items()}, set(cols))

    def star(self, subject: str, arms: list[tuple[str, str]], graph: str | None = None) -> Plan | None:
        if graph is not None or any(isinstance(p, Var) or not isinstance(p, str) for p, _ in arms):
            return None
        found = [x for x in (self._rows(t, subject, arms) for t in self.tables) if x is not None]
        names = [v for v in dict.fromkeys([subject, *(o for _, o in arms)]) if isinstance(v, Var)]
        return reduce(union, found) if found else nothing(self.spark, names)

    def match(self, t: Triple, graph: str | None = None) -> Plan:
        if graph is not None:
            return nothing(self.spark, sorted({*t.variables(), *([graph] if isinstance(graph, Var) else [])}))
        if not isinstance(t.p, Var):
            return self.star(t.s, [(t.p, t.o)])  # type: ignore[return-value, arg-type]
        parts = []
        for table in self.tables:
            df = table.df
            if not isinstance(t.s, Var):
                rows = df.withColumn("s:key", table.key)
                df = rows.where(_is(table.key, Kind("iri", table.prefix), t.s, dict(rows.dtypes)["s:key"])).drop("s:key")
            arms = []
            for p in [T.TYPE, *table.columns, *table.links]:
                value, kind = table.arm(p)  # type: ignore[misc]
                arms.append(F.struct(F.lit(p).alias("p"), T.as_term(value, kind).alias("o")))
            df = df.select(T.as_term(table.key, Kind("iri", table.prefix)).alias("s"), F.explode(F.array(*arms)).alias("po")).select("s", "po.p", "po.o").where("o is not null")
            parts.append(_pattern(df, {"s": "s", "p": "p", "o": "o"}, {"s": t.s, "p": t.p, "o": t.o}))
        return reduce(union, parts)

    def quads(self) -> DataFrame:
        plan = self.match(Triple(Var("s"), Var("p"), Var("o")))
        return plan.df.select("s", "p", "o", F.lit(None).cast("string").alias("g"))


class UnionDataset(Dataset):
    """Several sources as one graph. disjoint: no triple is in two of them."""

    def __init__(self, sources: Iterable[Dataset], disjoint: bool = False):
        self.sources, self.disjoint = list(sources), disjoint
        self.spark = self.sources[0].spark

    def match(self, t: Triple, graph: str | None = None) -> Plan:
        parts = [s.match(t, graph) for s in self.sources]
        out = reduce(union, parts)
        return out if self.disjoint or len(parts) == 1 else out.distinct()

    def star(self, subject: Var, arms: list[tuple[str, str]], graph: str | None = None) -> Plan | None:
        """Only where one source alone has any of the predicates: arms may join across sources."""
        able = []
        for s in self.sources:
            if not isinstance(s, LiftedDataset):
                return None
            if any(t.arm(p) for t in s.tables for p, _ in arms if p != T.TYPE):
                able.append(s)
        return able[0].star(subject, arms, graph) if len(able) == 1 and any(p != T.TYPE for p, _ in arms) else None

    def quads(self) -> DataFrame:
        out = reduce(DataFrame.union, [s.quads() for s in self.sources])
        return out if self.disjoint else out.distinct()


def bound_only(plan: Plan, keys: DataFrame, names: list[str]) -> Plan:
    """The solutions whose values of names are among keys (columns of canonical terms)."""
    terms = plan.with_kinds({v: TERM for v in names})
    right = keys.select(*[col_of(v).alias(f"k:{name_of(v)}") for v in names])
    on = reduce(lambda a, b: a & b, [col_of(v) == F.col(f"`k:{name_of(v)}`") for v in names])
    return Plan(terms.df.join(right, on, "left_semi"), terms.kinds, plan.certain)


def _native_term(plan: Plan, var: str, term: str) -> Column:
    """var has the value of the constant term: compared natively where its kind is known."""
    kind = plan.kinds[var]
    if kind == TERM:
        return col_of(var) == term
    return _is(col_of(var), kind, term, dict(plan.df.dtypes)[name_of(var)])
