"""The algebra of queries, and which variables its parts bind."""

from __future__ import annotations

from dataclasses import dataclass, field


class Var(str):
    """A variable, without its question mark. Names that start with a dot are blank nodes'."""

    __slots__ = ()


@dataclass(frozen=True)
class Path:
    """op: link (args: one iri), seq, alt, inv, plus, star, opt (args: paths) or neg (args: pairs
    of an iri and whether it is inverse)."""

    op: str
    args: tuple


@dataclass(frozen=True)
class Triple:
    s: str
    p: str | Path
    o: str

    def variables(self) -> set[Var]:
        return {t for t in (self.s, self.p, self.o) if isinstance(t, Var)}


@dataclass
class Expr:
    """op: var, term, a function's or an operator's name, exists, not exists, or agg."""

    op: str
    args: list = field(default_factory=list)
    extra: dict = field(default_factory=dict)


@dataclass
class BGP:
    triples: list[Triple]


@dataclass
class Join:
    left: object
    right: object


@dataclass
class LeftJoin:
    left: object
    right: object
    condition: Expr | None


@dataclass
class Union:
    left: object
    right: object


@dataclass
class Minus:
    left: object
    right: object


@dataclass
class Filter:
    condition: Expr
    body: object


@dataclass
class Extend:
    body: object
    var: Var
    value: Expr


@dataclass
class Graph:
    name: str
    body: object


@dataclass
class Service:
    name: str
    body: object
    silent: bool = False


@dataclass
class Values:
    names: list[Var]
    rows: list[list[str | None]]


@dataclass
class Group:
    body: object
    keys: list[tuple[Var, Expr]]
    aggregates: list[tuple[Var, Expr]]


@dataclass
class Project:
    body: object
    names: list[Var]
    subquery: bool = False


@dataclass
class Distinct:
    body: object


@dataclass
class OrderBy:
    body: object
    keys: list[tuple[Expr, bool]]  # (expression, ascending)


@dataclass
class Slice:
    body: object
    offset: int
    limit: int | None


@dataclass
class Query:
    """form: select, ask, construct or describe."""

    form: str
    body: object
    names: list[Var] = field(default_factory=list)
    template: list[Triple] = field(default_factory=list)
    described: list[str] = field(default_factory=list)
    text: str = ""


def children(node: object) -> list:
    if isinstance(node, (Join, LeftJoin, Union, Minus)):
        return [node.left, node.right]
    return [node.body] if hasattr(node, "body") else []


def in_scope(node: object) -> set[Var]:
    """Variables that may be bound, as SELECT * sees them."""
    if isinstance(node, BGP):
        return {v for t in node.triples for v in t.variables()}
    if isinstance(node, Values):
        return set(node.names)
    if isinstance(node, Minus):
        return in_scope(node.left)
    if isinstance(node, Project):
        return set(node.names)
    if isinstance(node, Group):
        return {v for v, _ in node.keys} | {v for v, _ in node.aggregates}
    own = {node.var} if isinstance(node, Extend) else {node.name} if isinstance(node, Graph) and isinstance(node.name, Var) else set()
    return own.union(*(in_scope(c) for c in children(node)))


def certain(node: object) -> set[Var]:
    """Variables that every solution of node binds."""
    if isinstance(node, (Join, LeftJoin, Minus, Union)):
        left = certain(node.left)
        if isinstance(node, Join):
            return left | certain(node.right)
        return left & certain(node.right) if isinstance(node, Union) else left
    if isinstance(node, BGP):
        return in_scope(node)
    if isinstance(node, Values):
        return {v for i, v in enumerate(node.names) if all(r[i] is not None for r in node.rows)}
    if isinstance(node, (Group, Service)):
        return set()
    inner = certain(node.body) if hasattr(node, "body") else set()
    if isinstance(node, Project):
        return inner & set(node.names)
    if isinstance(node, Graph) and isinstance(node.name, Var):
        return inner | {node.name}
    return inner


def constant(term: str | None) -> str | None:
    return None if isinstance(term, Var) else term


def expressions(e: Expr | None) -> list[Expr]:
    """e and all expressions in it, those inside EXISTS excluded."""
    if e is None:
        return []
    return [e, *(x for a in e.args if isinstance(a, Expr) for x in expressions(a))]


def exists_bodies(e: Expr | None) -> list[tuple[str, object]]:
    return [(x.op, x.extra["body"]) for x in expressions(e) if x.op in ("exists", "not exists")]


def variables_of(e: Expr | None) -> set[Var]:
    """Variables of an expression, those inside EXISTS excluded."""
    return {x.args[0] for x in expressions(e) if x.op == "var"}
