"""Property paths.

Sequences and inverses are joins and swaps. Closures are semi-naive iterations: each round joins
only the pairs that are new with the edges, and keeps those not met before. Every round's pairs are a
written table, and every few rounds all of them are written together, so the plan stays small and a
lost executor costs one round at most. With a constant endpoint the iteration starts there, and never
computes all pairs. Without one, after LINEAR rounds new pairs are joined with all pairs found instead
of with the edges, which doubles the length that a round reaches: a chain of n nodes takes about
LINEAR + log2(n) rounds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalar import Unsupported
from tessera.operators.solutions import Plan, col_of, join, name_of, union
from tessera.operators.tables import written
from tessera.plans.algebra import Path, Triple, Var
from tessera.sources.dataset import Dataset, _native_term
from tessera.terms import TERM

S, O = Var(".s"), Var(".o")
#: Rounds that follow single edges; rounds after which all pairs are written together.
LINEAR, TOGETHER = 4, 4


def nullable(p: Path) -> bool:
    """The path matches a node and itself."""
    if p.op in ("star", "opt"):
        return True
    if p.op in ("plus", "inv"):
        return nullable(p.args[0])
    if p.op == "seq":
        return all(nullable(a) for a in p.args)
    return p.op == "alt" and any(nullable(a) for a in p.args)


def predicates(p: Path) -> list[str]:
    """The IRIs whose triples the path needs; none for negated sets."""
    if p.op == "link":
        return [p.args[0]]
    return [] if p.op == "neg" else list(dict.fromkeys(x for a in p.args for x in predicates(a)))


def text_of(p: Path | str) -> str:
    """The path as a query has it."""
    if isinstance(p, str):
        return p
    if p.op == "link":
        return p.args[0]
    if p.op in ("seq", "alt"):
        return "(" + {"seq": "/", "alt": "|"}[p.op].join(text_of(a) for a in p.args) + ")"
    if p.op == "inv":
        return "^" + text_of(p.args[0])
    if p.op == "neg":
        return "!(" + "|".join(("^" if inverse else "") + i for i, inverse in p.args) + ")"
    return f"({text_of(p.args[0])})" + {"star": "*", "plus": "+", "opt": "?"}[p.op]


def _renamed(plan: Plan, names: dict[str, str]) -> Plan:
    df = plan.df.select(*[col_of(v).alias(name_of(names[v])) for v in plan.kinds])
    return Plan(df, {names[v]: k for v, k in plan.kinds.items()}, {names[v] for v in plan.certain})


def pairs(data: Dataset, p: Path, graph: str | None, start: str | None = None, end: str | None = None) -> Plan:
    """Plan of (S, O): the pairs that the path connects; start, end: constants that limit them
    where that saves work (the caller limits them in any case)."""
    if p.op == "link":
        return _limited(data.match(Triple(S, p.args[0], O), graph), start, end)
    if p.op == "inv":
        return _renamed(pairs(data, p.args[0], graph, end, start), {S: O, O: S}).select([S, O])
    if p.op == "alt":
        return reduce(union, [pairs(data, a, graph, start, end) for a in p.args])
    if p.op == "seq":
        out = pairs(data, p.args[0], graph, start, None)
        for i, a in enumerate(p.args[1:]):
            mid, last = Var(f".m{i}"), i == len(p.args) - 2
            step = _renamed(pairs(data, a, graph, None, end if last else None), {S: mid, O: O})
            out = join(_renamed(out, {S: S, O: mid}), step).select([S, O])
        return out
    if p.op == "neg":
        v = Var(".p")
        sides = []
        every = data.match(Triple(S, v, O), graph).with_kinds({S: TERM, O: TERM, v: TERM})
        for inverse in (False, True):
            names = [i for i, back in p.args if back == inverse]
            if names or not inverse and not any(back for _, back in p.args):
                kept = every.where(~col_of(v).isin(names)) if names else every
                kept = kept.select([S, O])
                sides.append(_renamed(kept, {S: O, O: S}).select([S, O]) if inverse else kept)
        return reduce(union, sides)
    edges = pairs(data, p.args[0], graph, start if p.op == "opt" else None, end if p.op == "opt" else None)
    if isinstance(graph, Var):
        raise Unsupported("a path of any length inside GRAPH with a variable")
    out = edges.distinct() if p.op == "opt" else _closure(edges, start, end)
    if p.op == "plus":
        return out
    out = out.with_kinds({S: TERM, O: TERM})
    if start or end:
        spark = data.spark
        same = spark.createDataFrame([(t, t) for t in {start or end}], f"`{name_of(S)}` string, `{name_of(O)}` string")
    else:
        same = data.nodes(graph).select(F.col("n").alias(name_of(S)), F.col("n").alias(name_of(O)))
    return union(out, Plan(same, {S: TERM, O: TERM}, {S, O})).distinct()


def _limited(plan: Plan, start: str | None, end: str | None) -> Plan:
    for v, t in ((S, start), (O, end)):
        if t:
            plan = plan.where(_native_term(plan, v, t))
    return plan


def _closure(edges: Plan, start: str | None, end: str | None) -> Plan:
    """One or more steps; different pairs."""
    if edges.kinds[S] != edges.kinds[O]:
        edges = edges.with_kinds({S: TERM, O: TERM})
    kind = edges.kinds[S]
    e = written(edges.df.select(col_of(S).alias("a"), col_of(O).alias("b")).distinct(), "path")
    seeded = Plan(e, {"a": kind, "b": kind}, {"a", "b"})
    forward = start is not None or end is None
    first = seeded.where(_native_term(seeded, "a" if forward else "b", start if forward else end)) if start or end else seeded  # type: ignore[arg-type]
    delta = reach = first.df
    rounds, seed = 0, bool(start or end)
    while not delta.isEmpty():
        rounds += 1
        if not seed and rounds > LINEAR:
            there = reach.select(F.col("a").alias("x"), F.col("b").alias("y"))
            on = delta.join(there, F.col("b") == F.col("x")).select("a", F.col("y").alias("b"))
            back = delta.join(there, F.col("a") == F.col("y")).select(F.col("x").alias("a"), "b")
            step = on.union(back)
        elif forward:
            step = delta.join(e.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").select("a", F.col("c").alias("b"))
        else:
            step = delta.join(e.select(F.col("a").alias("z"), F.col("b").alias("a")), "a").select(F.col("z").alias("a"), "b")
        delta = written(step.distinct().join(reach, ["a", "b"], "left_anti"), "path")
        reach = reach.union(delta)
        if rounds % TOGETHER == 0:
            reach = written(reach, "path")
    out: DataFrame = reach.select(F.col("a").alias(name_of(S)), F.col("b").alias(name_of(O)))
    return Plan(out, {S: kind, O: kind}, {S, O})


def path_plan(data: Dataset, t: Triple, graph: str | None = None) -> Plan:
    """The solutions of a pattern whose predicate is a path."""
    start = None if isinstance(t.s, Var) else t.s
    end = None if isinstance(t.o, Var) else t.o
    assert isinstance(t.p, Path)
    out = _limited(pairs(data, t.p, graph, start, end), start, end)
    if isinstance(t.s, Var) and t.s == t.o:
        both = out.with_kinds({S: TERM, O: TERM}) if out.kinds[S] != out.kinds[O] else out
        out = both.where(col_of(S) == col_of(O)).select([S])
        return _renamed(out, {S: t.s})
    kept = [v for v, x in ((S, t.s), (O, t.o)) if isinstance(x, Var)]
    return _renamed(out.select(kept), {S: t.s, O: t.o})
