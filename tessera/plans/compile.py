"""Algebra to DataFrames: bottom-up, as the algebra nests, one Catalyst plan per query.

Only property-path closures run jobs of their own (tessera.operators.paths).
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import terms as T
from tessera.functions.scalar import NUMBER, Evaluator, Unsupported, Value, as_number, as_text, order_keys, rank
from tessera.functions.scalar import as_term as value_term
from tessera.operators.paths import path_plan
from tessera.operators.solutions import Plan, col_of, join, left_join, minus, name_of, nothing, semi_join, union, unit
from tessera.operators.tables import written
from tessera.plans import algebra as A
from tessera.plans.parser import parse
from tessera.sources.dataset import Dataset
from tessera.terms import DECIMAL, INTEGER, STRING, TERM


class Compiler:
    def __init__(self, dataset: Dataset):
        self.dataset, self.spark = dataset, dataset.spark
        self.fresh = 0

    def __call__(self, node: object, graph: str | None = None) -> Plan:
        return getattr(self, f"_{type(node).__name__.lower()}")(node, graph)

    # --- patterns ---

    def _bgp(self, node: A.BGP, graph: str | None) -> Plan:
        """Patterns of one subject together where the dataset can; then joins along shared
        variables, the parts with most constants first."""
        if not node.triples:
            return unit(self.spark)
        parts: list[Plan] = []
        weight: list[int] = []
        by_subject: dict[str, list[A.Triple]] = {}
        for t in dict.fromkeys(node.triples):
            if isinstance(t.p, A.Path):
                parts.append(path_plan(self.dataset, t, graph))
                weight.append(0)
            else:
                by_subject.setdefault(t.s, []).append(t)
        for s, triples in by_subject.items():
            whole = self.dataset.star(s, [(t.p, t.o) for t in triples], graph) if not any(isinstance(t.p, A.Var) for t in triples) else None
            found = [whole] if whole is not None else [self.dataset.match(t, graph) for t in triples]
            constants = [sum(not isinstance(x, A.Var) for x in (t.s, t.o)) + (t.p != T.TYPE) for t in triples]
            parts += found
            weight += [max(constants)] if whole is not None else constants
        order = sorted(range(len(parts)), key=lambda i: -weight[i])
        out = parts[order.pop(0)]
        while order:
            linked = [i for i in order if set(parts[i].kinds) & set(out.kinds)]
            pick = linked[0] if linked else order[0]
            order.remove(pick)
            out = join(out, parts[pick])
        return out

    def _join(self, node: A.Join, graph: str | None) -> Plan:
        return join(self(node.left, graph), self(node.right, graph))

    def _leftjoin(self, node: A.LeftJoin, graph: str | None) -> Plan:
        left, right = self(node.left, graph), self(node.right, graph)
        if node.condition is None:
            return left_join(left, right)
        if A.exists_bodies(node.condition):
            inner = self._filtered(join(left, right), node.condition, graph)
            return left_join(left, right, inner=inner)
        return left_join(left, right, lambda value: Evaluator(value).condition(node.condition))

    def _union(self, node: A.Union, graph: str | None) -> Plan:
        return union(self(node.left, graph), self(node.right, graph))

    def _minus(self, node: A.Minus, graph: str | None) -> Plan:
        return minus(self(node.left, graph), self(node.right, graph))

    def _graph(self, node: A.Graph, graph: str | None) -> Plan:
        return self(node.body, node.name)

    def _service(self, node: A.Service, graph: str | None) -> Plan:
        if node.silent:
            return unit(self.spark)
        raise Unsupported("SERVICE: give the endpoint as a source of the query instead")

    def _values(self, node: A.Values, graph: str | None) -> Plan:
        if not node.names:
            return unit(self.spark) if node.rows else nothing(self.spark, [])
        schema = ", ".join(f"`{name_of(v)}` string" for v in node.names)
        df = self.spark.createDataFrame([tuple(r) for r in node.rows], schema)
        certain = {v for i, v in enumerate(node.names) if all(r[i] is not None for r in node.rows)}
        return Plan(df, dict.fromkeys(node.names, TERM), certain)

    # --- expressions ---

    def _evaluator(self, plan: Plan) -> Evaluator:
        return Evaluator(plan.value)

    def _filter(self, node: A.Filter, graph: str | None) -> Plan:
        if isinstance(node.body, A.Join) and node.condition.op == "=" and not A.exists_bodies(node.condition):
            joined = self._value_join(node, graph)
            if joined is not None:
                return joined
        return self._filtered(self(node.body, graph), node.condition, graph)

    def _value_join(self, node: A.Filter, graph: str | None) -> Plan | None:
        """FILTER(?a = ?b) over a product, as a join by equality of their native values."""
        args = node.condition.args
        if any(a.op != "var" for a in args):
            return None
        left, right = self(node.body.left, graph), self(node.body.right, graph)
        a, b = (x.args[0] for x in args)
        if a in right.kinds:
            a, b = b, a
        if set(left.kinds) & set(right.kinds) or a not in left.certain or b not in right.certain or left.kinds[a] != right.kinds[b] or left.kinds[a] in (TERM, NUMBER):
            return None
        renamed = Plan(right.df.withColumn(name_of(a), col_of(b)), {**right.kinds, a: right.kinds[b]}, right.certain | {a})
        return join(left, renamed)

    def _filtered(self, plan: Plan, condition: A.Expr, graph: str | None) -> Plan:
        if condition.op == "&&":
            return self._filtered(self._filtered(plan, condition.args[0], graph), condition.args[1], graph)
        if condition.op in ("exists", "not exists"):
            return self._exists(plan, condition, graph)
        if condition.op == "!" and condition.args[0].op in ("exists", "not exists"):
            inner = condition.args[0]
            return self._exists(plan, A.Expr("exists" if inner.op == "not exists" else "not exists", [], inner.extra), graph)
        if A.exists_bodies(condition):
            # EXISTS inside another expression: once for its rows, once for the others
            first = next(x for x in A.expressions(condition) if x.op in ("exists", "not exists"))
            found = A.Expr("exists", [], first.extra)
            yes = self._filtered(self._exists(plan, found, graph), _replaced(condition, first, first.op == "exists"), graph)
            no = self._filtered(self._exists(plan, A.Expr("not exists", [], first.extra), graph), _replaced(condition, first, first.op != "exists"), graph)
            return union(yes, no)
        return plan.where(self._evaluator(plan).condition(condition))

    def _exists(self, plan: Plan, e: A.Expr, graph: str | None) -> Plan:
        """As a semi or anti join; filters of the pattern that use outer variables join with it."""
        body, outer = e.extra["body"], []
        while isinstance(body, A.Filter) and not A.exists_bodies(body.condition) and not A.variables_of(body.condition) <= A.in_scope(body.body):
            outer.append(body.condition)
            body = body.body
        inner = self(body, graph)
        if len(outer) == 1 and (reduced := self._extreme(plan, inner, outer[0])) is not None:
            inner = reduced
        condition = None
        if outer:
            condition = lambda value: reduce(lambda a, b: a & b, [Evaluator(value).condition(c) for c in outer])
        return semi_join(plan, inner, e.op == "not exists", condition)

    def _extreme(self, plan: Plan, inner: Plan, e: A.Expr) -> Plan | None:
        """Where a test has one comparison of an outer with an inner variable, the least or greatest
        inner value of each key tells: so a common key has one row there, not one for each pair."""
        if e.op not in ("<", "<=", ">", ">=") or any(a.op != "var" for a in e.args):
            return None
        (x, y), names = (a.args[0] for a in e.args), set(plan.kinds) & set(inner.kinds)
        turned = x in inner.kinds
        far, near = (x, y) if turned else (y, x)
        if far in names or near in inner.kinds or near not in plan.kinds or far not in inner.certain:
            return None
        if not names <= plan.certain & inner.certain or any(plan.kinds[v] != inner.kinds[v] for v in names):
            return None
        kind = inner.kinds[far]
        if kind != plan.kinds[near] or kind not in (T.INTEGER, T.DOUBLE, T.DATETIME):
            return None
        value = col_of(far)
        rows = inner.df.where(~F.isnan(value)) if kind == T.DOUBLE else inner.df
        # far < near asks for the least far, near < far for the greatest
        best = (F.min if (e.op in ("<", "<=")) == turned else F.max)(value).alias(name_of(far))
        keys = [col_of(v) for v in sorted(names)]
        df = rows.groupBy(*keys).agg(best) if keys else rows.agg(best).where(col_of(far).isNotNull())
        return Plan(df, {v: inner.kinds[v] for v in (*sorted(names), far)}, {*names, far})

    def _extend(self, node: A.Extend, graph: str | None) -> Plan:
        plan = self(node.body, graph)
        if A.exists_bodies(node.value):
            first = next(x for x in A.expressions(node.value) if x.op in ("exists", "not exists"))
            sides = [self._extended(self._exists(plan, A.Expr(op, [], first.extra), graph), node.var, _replaced(node.value, first, (op == first.op))) for op in ("exists", "not exists")]
            return union(*sides)
        return self._extended(plan, node.var, node.value)

    def _extended(self, plan: Plan, var: str, e: A.Expr) -> Plan:
        value = self._evaluator(plan)(e)
        certain = plan.certain | ({var} if e.op == "term" or (e.op == "var" and e.args[0] in plan.certain) else set())
        return Plan(plan.df.withColumn(name_of(var), value.col), {**plan.kinds, var: value.kind}, certain)

    # --- groups ---

    def _group(self, node: A.Group, graph: str | None) -> Plan:
        plan = self(node.body, graph)
        for v, e in node.keys:
            if not (e.op == "var" and e.args[0] == v):
                plan = self._extended(plan, v, e)
        keys = [v for v, _ in node.keys]
        for v in keys:
            if v not in plan.kinds:  # a key that the pattern never binds: one group, unbound
                plan = Plan(plan.df.withColumn(name_of(v), F.lit(None).cast("string")), {**plan.kinds, v: TERM}, plan.certain)
            elif plan.kinds[v] == NUMBER:
                plan = plan.with_kinds({v: TERM})
        aggs: list[Column] = []
        kinds = {v: plan.kinds[v] for v in keys}
        certain = plan.certain & set(keys)
        for v, e in node.aggregates:
            value = self._aggregate(plan, e)
            aggs.append(value.col.alias(name_of(v)))
            kinds[v] = value.kind
            if e.extra["name"] == "COUNT":
                certain = certain | {v}
        if not keys:
            df = plan.df.agg(*aggs) if aggs else plan.df.agg(F.count("*")).select()
        elif aggs:
            df = plan.df.groupBy(*[col_of(v) for v in keys]).agg(*aggs)
        else:
            df = plan.df.select(*[col_of(v) for v in keys]).distinct()
        return Plan(df, kinds, certain)

    def _aggregate(self, plan: Plan, e: A.Expr) -> Value:
        name, distinct = e.extra["name"], e.extra["distinct"]
        if name == "COUNT" and not e.args:
            everything = F.struct(*[col_of(v) for v in plan.kinds]) if plan.kinds else F.lit(1)
            return Value((F.count_distinct(everything) if distinct else F.count("*")).cast("long"), INTEGER)
        x = self._evaluator(plan)(e.args[0])
        if name == "COUNT":
            col = value_term(x) if x.kind == NUMBER else x.col
            return Value(F.count_distinct(col) if distinct else F.count(col), INTEGER)
        if name in ("SUM", "AVG"):
            number = as_number(x)
            number = number.cast("long") if x.kind == INTEGER else number
            whole = F.count(number) == F.count("*")  # a row without a number makes it an error
            add, mean = (F.sum_distinct, lambda c: F.sum_distinct(c) / F.count_distinct(c)) if distinct else (F.try_sum, F.avg)
            if x.kind == INTEGER and name == "SUM":
                return Value(F.when(F.count("*") == 0, F.lit(0).cast("long")).when(whole, add(number)), INTEGER)
            if x.kind in (INTEGER, DECIMAL):
                number = number.cast("decimal(28,10)")
                col = add(number) if name == "SUM" else F.try_divide(add(number), F.count_distinct(number) if distinct else F.count(number))
                return Value(F.when(F.count("*") == 0, F.lit(0)).when(whole, col).cast("decimal(38,10)"), DECIMAL)
            col = add(number.cast("double")) if name == "SUM" else mean(number.cast("double"))
            if x.kind not in (TERM, NUMBER):
                return Value(F.when(F.count("*") == 0, F.lit(0.0)).when(whole, col), x.kind if x.numeric else T.DOUBLE)
            high = F.coalesce(F.max(rank(x)), F.lit(0))
            high = F.greatest(high, F.lit(1)) if name == "AVG" else high
            col = F.when(F.count("*") == 0, F.lit(0.0)).when(whole, col)
            return Value(F.when(col.isNotNull(), F.struct(col.alias("x"), F.when(F.count("*") == 0, 0).otherwise(high).cast("int").alias("rank"))), NUMBER)
        if name in ("MIN", "MAX"):
            best = F.min if name == "MIN" else F.max
            if x.kind not in (TERM, NUMBER):
                return Value(best(x.col), x.kind)
            keys = order_keys(x)
            made = F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)], value_term(x).alias("t"))
            return Value(best(F.when(x.col.isNotNull(), made))["t"], TERM)
        if name == "SAMPLE":
            return Value(F.min(x.col if x.kind != NUMBER else value_term(x)), x.kind if x.kind != NUMBER else TERM)
        strings = as_text(x)
        listed = F.collect_set(strings) if distinct else F.collect_list(strings)
        return Value(F.array_join(F.array_sort(listed), e.extra.get("separator", " ")), STRING)

    # --- modifiers ---

    def _project(self, node: A.Project, graph: str | None) -> Plan:
        return self(node.body, graph).select(list(node.names))

    def _distinct(self, node: A.Distinct, graph: str | None) -> Plan:
        inner = node.body
        if isinstance(inner, A.Project) and isinstance(inner.body, A.OrderBy):
            order = inner.body
            wanted = {v for e, _ in order.keys for v in A.variables_of(e)}
            if wanted <= set(inner.names):  # sort what is left, as a set has no order
                plan = _distinct(self(A.Project(order.body, inner.names), graph))
                return self._sorted(plan, order.keys)
        return _distinct(self(inner, graph))

    def _orderby(self, node: A.OrderBy, graph: str | None) -> Plan:
        return self._sorted(self(node.body, graph), node.keys)

    def _sorted(self, plan: Plan, keys: list[tuple[A.Expr, bool]]) -> Plan:
        cols = []
        for e, up in keys:
            for c in order_keys(self._evaluator(plan)(e)):
                cols.append(c.asc_nulls_first() if up else c.desc_nulls_last())
        return Plan(plan.df.orderBy(*cols), plan.kinds, plan.certain)

    def _slice(self, node: A.Slice, graph: str | None) -> Plan:
        plan = self(node.body, graph)
        df = plan.df.offset(node.offset) if node.offset else plan.df
        return Plan(df.limit(node.limit) if node.limit is not None else df, plan.kinds, plan.certain)


def _distinct(plan: Plan) -> Plan:
    plan = plan.with_kinds({v: TERM for v, k in plan.kinds.items() if k == NUMBER})
    return plan.distinct() if plan.kinds else Plan(plan.df.limit(1), {}, set())


def _replaced(e: A.Expr, what: A.Expr, by: bool) -> A.Expr:
    if e is what:
        return A.Expr("term", [T.literal(str(by).lower(), T.XSD + "boolean")])
    return A.Expr(e.op, [_replaced(a, what, by) if isinstance(a, A.Expr) else a for a in e.args], e.extra)


def solve(query: str | A.Query, dataset: Dataset) -> Plan:
    """The plan of a SELECT query's solutions, with native columns where kinds are known."""
    q = parse(query) if isinstance(query, str) else query
    return Compiler(dataset)(q.body)


def evaluate(query: str | A.Query, dataset: Dataset) -> DataFrame:
    """A query's result: SELECT, a column of canonical terms per variable (null: unbound); ASK, one
    row with `boolean`; CONSTRUCT and DESCRIBE, different triples `subject, predicate, object`."""
    q = parse(query) if isinstance(query, str) else query
    plan = Compiler(dataset)(q.body)
    if q.form == "select":
        names = {v.lower() for v in q.names}
        shown = [v if len(names) == len(q.names) else name_of(v) for v in q.names]
        return plan.df.select(*[(value_term(plan.value(v)) if v in plan.kinds else F.lit(None).cast("string")).alias(n) for v, n in zip(q.names, shown, strict=True)])
    if q.form == "ask":
        return plan.df.limit(1).agg((F.count("*") > 0).alias("boolean"))
    if q.form == "construct":
        return _construct(q, plan)
    return _describe(q, plan, dataset)


def _construct(q: A.Query, plan: Plan) -> DataFrame:
    run = uuid.uuid4().hex[:8]
    row = F.sha2(F.concat_ws("|", *[F.coalesce(value_term(plan.value(v)), F.lit("")) for v in plan.kinds]), 256)

    def cell(t: str) -> Column:
        if isinstance(t, A.Var) and t.startswith(".") and t not in plan.kinds:
            return F.concat(F.lit(f"_:{run}{t[1:]}"), F.substring(row, 1, 16))  # a new blank node per solution
        if isinstance(t, A.Var):
            return value_term(plan.value(t)) if t in plan.kinds else F.lit(None).cast("string")
        return F.lit(t)

    made = F.array(*[F.struct(cell(t.s).alias("subject"), cell(t.p).alias("predicate"), cell(t.o).alias("object")) for t in q.template])  # type: ignore[arg-type]
    df = plan.df.select(F.explode(made).alias("t")).select("t.*")
    legal = ~F.col("subject").startswith('"') & F.col("predicate").startswith("<") & F.col("object").isNotNull()
    return df.where(legal).distinct()


def _describe(q: A.Query, plan: Plan, dataset: Dataset) -> DataFrame:
    """Concise bounded descriptions: the triples of each resource, and those of the blank nodes
    they lead to."""
    spark: SparkSession = dataset.spark
    named = [t for t in dict.fromkeys(q.described) if not isinstance(t, A.Var)]
    asked = [value_term(plan.value(v)) for v in q.described if isinstance(v, A.Var) and v in plan.kinds]
    every = dataset.match(A.Triple(A.Var("s"), A.Var("p"), A.Var("o")))
    triples = every.with_kinds({v: TERM for v in every.kinds}).df.select("s", "p", "o")
    parts = []
    for t in named:  # constants reach the scan
        own = dataset.match(A.Triple(t, A.Var("p"), A.Var("o")))
        parts.append(own.with_kinds({v: TERM for v in own.kinds}).df.select(F.lit(t).alias("s"), "p", "o"))
    found = [spark.createDataFrame([(t,) for t in named], "n string")]
    if asked:
        wanted = reduce(DataFrame.union, [plan.df.select(c.alias("n")) for c in asked]).where("n is not null").distinct()
        found.append(written(wanted, "described"))
        parts.append(triples.join(found[-1].withColumnRenamed("n", "s"), "s", "left_semi"))
    step = written(reduce(DataFrame.union, parts), "described") if parts else triples.limit(0)
    seen, out = reduce(DataFrame.union, found), step
    while True:
        further = step.where(F.col("o").startswith("_:")).select(F.col("o").alias("n")).distinct()
        further = written(further.join(seen, "n", "left_anti"), "described")
        if further.isEmpty():
            return out.select(F.col("s").alias("subject"), F.col("p").alias("predicate"), F.col("o").alias("object")).distinct()
        step = written(triples.join(further.withColumnRenamed("n", "s"), "s", "left_semi"), "described")
        out, seen = out.union(step), seen.union(further)
