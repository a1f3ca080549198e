"""Operators that the catalogue's tables don't show, over small graphs."""

import pytest

from tessera import terms as T
from tessera.plans.compile import evaluate
from tessera.sources.dataset import QuadDataset

NS = "http://t/"
SCHEMA = "s string, p string, o string, g string"


def iri(x):
    return f"<{NS}{x}>"


def number(x, kind="integer"):
    return T.literal(str(x), T.XSD + kind)


def data(spark, rows):
    return QuadDataset(spark.createDataFrame([(iri(s), T.TYPE if p == "a" else iri(p), o if o[0] in '"_<' else iri(o), None) if s[0] != "_" else (s, iri(p), o if o[0] in '"_<' else iri(o), None) for s, p, o in rows], SCHEMA))


def run(spark, rows, query):
    return [tuple(r) for r in evaluate(f"PREFIX : <{NS}> " + query, data(spark, rows)).collect()]


@pytest.mark.parametrize("n", [2, 40])
def test_closure_of_a_chain(spark, n):
    """Deep enough for doubling, and for pairs to be written together."""
    rows = [(f"n{i}", "next", f"n{i + 1}") for i in range(n)]
    got = run(spark, rows, "SELECT ?a ?b { ?a :next+ ?b }")
    assert sorted(got) == sorted((iri(f"n{i}"), iri(f"n{j}")) for i in range(n + 1) for j in range(i + 1, n + 1))
    assert len(run(spark, rows, "SELECT ?b { :n1 :next+ ?b }")) == n - 1 and len(run(spark, rows, "SELECT ?a { ?a :next* :n1 }")) == 2


def test_closure_of_rings(spark):
    rows = [(f"a{i}", "next", f"a{(i + 1) % 12}") for i in range(12)] + [(f"b{i}", "next", f"b{(i + 1) % 7}") for i in range(7)] + [("a0", "next", "b0")]
    assert len(run(spark, rows, "SELECT ?a ?b { ?a :next+ ?b }")) == 12 * 19 + 49


def test_describe_follows_blank_nodes(spark):
    rows = [("x", "p", "_:b1"), ("_:b1", "q", "_:b2"), ("_:b2", "r", number(1)), ("_:b2", "q", "_:b1"), ("y", "p", number(2)), ("z", "p", "x")]
    assert len(run(spark, rows, "DESCRIBE :x")) == 4
    assert len(run(spark, rows, "DESCRIBE ?n { ?n :p 2 }")) == 1 and len(run(spark, rows, "DESCRIBE :x ?n { ?n :p :x }")) == 5
    assert run(spark, rows, "DESCRIBE :none") == []


@pytest.mark.parametrize("op", ["<", "<=", ">", ">="])
@pytest.mark.parametrize("turned", [False, True])
@pytest.mark.parametrize("word", ["EXISTS", "NOT EXISTS"])
def test_one_inequality(spark, op, turned, word):
    """By lifted columns, as only native values are reduced."""
    from tessera.sources.dataset import Lifted, LiftedDataset
    from pyspark.sql import functions as F

    rows = [(i, i % 3, v) for i, v in enumerate([1.0, 5.0, 2.0, 1.0, float("nan"), 9.0, 3.0, 5.0, float("nan"), None])]
    df = spark.createDataFrame(rows, "id long, k long, v double")
    table = LiftedDataset([Lifted(df, NS + "r/", F.col("id"), NS + "Row", {iri("k"): ("k", T.INTEGER), iri("v"): ("v", T.DOUBLE)})])
    test = f"?w {op} ?v" if turned else f"?v {op} ?w"
    got = evaluate(f"PREFIX : <{NS}> SELECT ?x {{ ?x :k ?k ; :v ?v FILTER {word} {{ ?y :k ?k ; :v ?w FILTER({test}) }} }}", table).collect()
    compare = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}[op]
    there = [(i, k, v) for i, k, v in rows if v is not None]
    want = {i for i, k, v in there if any(l == k and (compare(w, v) if turned else compare(v, w)) for _, l, w in there) == (word == "EXISTS")}
    assert {int(r.x.rsplit("/")[-1][:-1]) for r in got} == want


def test_functions_not_shown_elsewhere(spark):
    rows = [("x", "d", T.literal("2024-05-06T07:08:09.5Z", T.XSD + "dateTime")), ("x", "l", T.literal("hello", lang="en-GB")), ("x", "n", number("2.5", "decimal"))]
    q = 'SELECT (SECONDS(?d) AS ?s) (TZ(?d) AS ?tz) (LANGMATCHES(LANG(?l), "en") AS ?m) (isBLANK(BNODE("a")) AS ?b) (sameTerm(BNODE("a"), BNODE("a")) AS ?same) (xsd:float(?n) AS ?f) (SHA384("x") AS ?h) (STRLEN(SHA512("x")) AS ?k) { ?x :d ?d ; :l ?l ; :n ?n }'
    (got,) = run(spark, rows, "PREFIX xsd: <http://www.w3.org/2001/XMLSchema#> " + q)
    import hashlib

    assert got[0].startswith('"9.5') and got[2].startswith('"true') and got[3].startswith('"true') and got[4].startswith('"true') and got[5].startswith('"2.5') and got[6] == f'"{hashlib.sha384(b"x").hexdigest()}"' and '"128"' in got[7]


def test_bnode_differs_by_solution(spark):
    rows = [(f"x{i}", "p", number(i)) for i in range(5)]
    got = run(spark, rows, 'SELECT ?x ?b (BNODE("same") AS ?c) { ?x :p ?o BIND(BNODE("same") AS ?b) }')
    assert len({r[1] for r in got}) == 5


def test_reduced_and_sample(spark):
    rows = [("x", "p", number(1)), ("y", "p", number(1))]
    assert len(set(run(spark, rows, "SELECT REDUCED ?o { ?x :p ?o }"))) == 1
    assert run(spark, rows, "SELECT (SAMPLE(?o) AS ?s) { ?x :p ?o }") == [(number(1),)]
