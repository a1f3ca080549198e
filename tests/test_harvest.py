"""Harvest-then-evaluate gives what evaluation over everything gives."""

import pytest

from tessera.plans import harvest as harvesting
from tessera.plans.compile import evaluate
from tessera.plans.demand import decompose, includes, narrowing, order, with_path_support
from tessera.plans.harvest import answer, harvest, run_dataset, stats_table, strict_triples
from tessera.plans.parser import parse
from tessera.sources.dataset import LiftedDataset, QuadDataset
from tessera.sources.lift import lifted
from tessera.sources.provenance import evaluate_published, nanopublication, publish, to_rows
from tessera.sources.remote import Config, DatasetSource, open_source
from tests.railway import NS, PRE, QUERIES, by_vocabulary, quads

SCHEMA = "s string, p string, o string, g string"


def rows(df):
    return sorted(map(str, (sorted((k, v) for k, v in r.asDict().items() if v is not None) for r in df.collect())))


@pytest.fixture(scope="module")
def whole(spark):
    return QuadDataset(spark.createDataFrame(quads(), SCHEMA).cache())


@pytest.fixture(scope="module")
def split(spark):
    return [QuadDataset(spark.createDataFrame(h, SCHEMA).cache()) for h in by_vocabulary()]


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ("path_onwards", "bgp_any_predicate")])
def test_isolated_sources_are_complete(spark, whole, split, name):
    q = PRE + QUERIES[name]
    got, found = answer(spark, q, [DatasetSource(d, f"http://source/{k}") for k, d in enumerate(split)])
    assert rows(got) == rows(evaluate(q, whole))
    assert len(found) == 2


def test_one_source_and_publication(spark, whole, tmp_path):
    q = PRE + QUERIES["leftjoin_inside"]
    source = DatasetSource(whole, "http://source/all", Config.of(page_size=5))
    found = harvest(spark, q, [source])
    assert {"full"} < set(found[0].stats.decisions()) <= {"full", "full+filter", "bind"}
    want = rows(evaluate(q, whole))
    assert rows(evaluate(q, run_dataset(found, "r"))) == want
    nano = nanopublication(found[0], "r", 1)
    assert nano.select("g").distinct().count() == 4
    for form in ("parquet", "nquads", "trig"):
        paths = publish(found, "r", str(tmp_path / form), form)
        assert rows(evaluate_published(spark, q, paths)) == want
    assert stats_table(spark, found).count() == 3
    assert to_rows(evaluate(PRE + QUERIES["bgp_tagged"], whole), typed=True) == [{"stop": {"type": "uri", "value": NS + "s5"}}]


def test_forced_dump_is_declared(spark, whole):
    q = PRE + "SELECT * { ?x r:noSuchThing ?y . ?y ?p ?o }"
    found = harvest(spark, q, [DatasetSource(whole, "http://source/all")])
    assert found[0].stats.decisions() == ["empty", "skipped-dump"] and found[0].stats.declared_incomplete
    found = harvest(spark, q, [DatasetSource(whole, "http://source/all", Config.of(skip_forced_dumps=False))])
    assert found[0].stats.decisions() == ["empty", "full"] and not found[0].stats.declared_incomplete


def test_strict_harvest_leaves_out_what_nothing_narrows(spark, whole):
    """Nothing has noSuchThing, so nothing is known of ?y, and its regions are not fetched."""
    q = PRE + "SELECT * { ?x r:noSuchThing ?y . ?y r:inRegion ?region . ?train r:runBy r:c1 }"
    got = strict_triples(spark, q, [DatasetSource(whole, "x")]).collect()
    want = {q[:3] for q in quads() if q[1] == f"<{NS}runBy>" and q[2] == f"<{NS}c1>"}
    assert {tuple(r) for r in got} == want
    found = harvest(spark, q, [DatasetSource(whole, "x")], strict=True)
    assert sorted(found[0].stats.decisions()) == ["empty", "full", "skipped"]


def test_reuse(spark, whole):
    q = PRE + "SELECT * { { ?a r:next ?b } UNION { ?c r:next r:s1 } UNION { r:s2 r:next ?d } UNION { ?e r:next ?e } }"
    found = harvest(spark, q, [DatasetSource(whole, "x")])
    assert rows(evaluate(q, run_dataset(found, "r"))) == rows(evaluate(q, whole))
    a, b = decompose(PRE + "SELECT * { ?a r:next ?b . ?c r:next r:s1 }")
    assert includes(a, b) and not includes(b, a)
    twice, other, named = decompose(PRE + "SELECT * { ?a r:next ?a . ?x r:next ?y GRAPH r:g { ?x r:next ?z } }")
    assert includes(other, twice) and not includes(twice, other) and not includes(other, named)


def patterns(q):
    return decompose(PRE + q)


def names(target, t, at_hand):
    found = narrowing(target, t, at_hand)
    return found and found[1]


@pytest.mark.parametrize("text", ["OPTIONAL { ?m r:b ?x }", "MINUS { ?m r:b ?x }", "FILTER EXISTS { ?m r:b ?x }", "FILTER NOT EXISTS { ?m r:b ?x }"])
def test_what_is_required_narrows_the_other_side_only(text):
    t = patterns(f"SELECT * {{ ?p r:a ?m {text} }}")
    assert names(1, t, [0]) == ["m"] and names(0, t, [1]) is None


@pytest.mark.parametrize("text", ["{ SELECT ?m { ?m r:b ?x } LIMIT 2 }", "{ SELECT ?m (COUNT(?x) AS ?n) { ?m r:b ?x } GROUP BY ?m }", "SERVICE <http://x/> { ?m r:b ?x }"])
def test_nothing_crosses_into_or_out_of(text):
    t = patterns(f"SELECT * {{ ?p r:a ?m {text} }}")
    assert all(names(i, t, [1 - i]) is None for i in range(len(t)))


def test_branches():
    t = patterns("SELECT * { { ?p r:a ?m } UNION { ?m r:b ?x } }")
    assert names(1, t, [0]) is None and names(0, t, [1]) is None
    t = patterns("SELECT * { ?p r:c ?q { ?p r:a ?m } UNION { ?p r:b ?x } }")
    assert names(1, t, [0]) == names(2, t, [0]) == ["p"] and names(0, t, [1, 2]) is None


def test_only_what_is_surely_bound_is_handed_on():
    t = patterns("SELECT * { ?x r:a ?y OPTIONAL { ?y r:b ?z OPTIONAL { ?z r:c ?x } } }")
    assert names(2, t, [0, 1]) == ["z"]
    t = patterns("SELECT * { ?x r:a ?y OPTIONAL { ?y r:b ?z } OPTIONAL { ?z r:c ?w } }")
    assert names(2, t, [0, 1]) is None  # ?z may be unbound, and then anything matches
    t = patterns("SELECT * { ?x r:a ?y OPTIONAL { ?x r:b ?z FILTER EXISTS { ?z r:c ?y } } }")
    assert names(2, t, [0, 1]) == ["y", "z"]


def test_what_is_not_linked_takes_no_part():
    t = patterns("SELECT * { ?a r:a ?b . ?c r:b ?d . ?d r:c ?e }")
    assert narrowing(2, t, [0, 1])[0].members == [1]
    assert order(t, [5, 9, 1]) == [2, 1, 0]


def test_paths_and_repeats_are_not_narrowed():
    t = with_path_support(patterns("SELECT * { ?a r:a ?b . ?b r:k+ ?c }"))
    assert [p.support for p in t] == [False, False, True] and names(1, t, [0]) is None and names(2, t, [0]) is None
    t = patterns("SELECT * { ?a r:a ?b { ?b r:b ?c } UNION { ?b r:b ?c } }")
    assert names(1, t, [0]) is None


def test_paths_narrow_once_their_predicates_are_there(spark, whole):
    """The seats of trains that get to stop 5 are asked for; those of others are not fetched."""
    found = harvest(spark, PRE + QUERIES["path_narrows"], [DatasetSource(whole, "x", Config.of(page_size=2))])
    by_pattern = {p.pattern: p for p in found[0].stats.patterns}
    seats = next(p for name, p in by_pattern.items() if "seats" in name)
    assert seats.decision == "bind" and 0 < seats.triples < seats.bindings < 40
    # a path of no steps connects anything with itself, so it narrows nothing
    found = harvest(spark, PRE + "SELECT * { ?train r:stopsAt? ?x . ?train r:seats ?n }", [DatasetSource(whole, "x")])
    assert next(p for p in found[0].stats.patterns if "seats" in p.pattern).decision == "full"


def test_open_source(spark, tmp_path):
    (tmp_path / "d.nt").write_text(f"<{NS}a> <{NS}p> <{NS}b> .\nrubbish\n")
    q = f"SELECT * {{ ?s <{NS}p> ?o }}"
    for spec in (str(tmp_path / "d.nt"), {"type": "dump", "path": str(tmp_path / "d.nt")}, f"dump:{tmp_path}/d.nt"):
        got, found = answer(spark, q, [spec])
        assert got.count() == 1 and found[0].stats.triples_dropped == 1 and found[0].stats.declared_incomplete
    with pytest.raises(ValueError):
        open_source(spark, {"type": "nonsense", "url": "http://x"})
    with pytest.raises(ValueError):
        Config.of(nonsense=1)
    assert parse(q).form == "select"


def test_dump_that_cannot_be_read_is_declared(spark, tmp_path):
    (tmp_path / "bad.ttl").write_text("this is {{{ no Turtle")
    q = f"SELECT * {{ ?s <{NS}p> ?o }}"
    for spec in (str(tmp_path / "missing.nt"), str(tmp_path / "bad.ttl"), "dump:http://127.0.0.1:9/none.nt"):
        got, found = answer(spark, q, [{"type": "dump", "path": spec.removeprefix("dump:")}], Config.of(retries=0, timeout=2.0))
        assert got.count() == 0 and found[0].stats.declared_incomplete, spec
        assert found[0].stats.decisions() in (["unreachable"], ["empty"]) and found[0].stats.errors + found[0].stats.triples_dropped >= 1


# --- own tables: fragments are plans ---

TABLES = {
    "region": ("r_regionkey int, r_name string", [(0, "A"), (1, "B")]),
    "nation": ("n_nationkey int, n_name string, n_regionkey int", [(k, f"n{k}", k % 2) for k in range(5)]),
    "customer": ("c_custkey bigint, c_nationkey int, c_acctbal double", [(k, k % 4 if k % 6 else None, k * 0.5) for k in range(20)]),
    "supplier": ("s_suppkey int, s_nationkey int, s_acctbal double", [(k, k % 3, 1.0) for k in range(4)]),
    "orders": ("o_orderkey bigint, o_custkey bigint, o_orderstatus string", [(k, k % 23, "OPF"[k % 3]) for k in range(40)]),
    "lineitem": ("l_orderkey bigint, l_partkey int, l_suppkey int, l_linenumber int, l_quantity double", [(k % 45, k % 7, k % 5, k % 3, float(k % 9)) for k in range(90)]),
}
EX = "PREFIX ex: <http://ex.org/>\nPREFIX nation: <http://ex.org/nation/>\nPREFIX region: <http://ex.org/region/>\n"
FEDERATED = 'SELECT ?o ?r ?q { ?n ex:inRegion ?r . ?c ex:inNation ?n . ?o ex:placedBy ?c ; ex:o_orderstatus "P" . ?l ex:ofOrder ?o ; ex:l_quantity ?q }'
#: Two repositories; links that lead back and forth between them; tables that both have.
APART = ["region", "nation", "customer"], ["orders", "lineitem", "supplier"]
ACROSS = ["region", "customer", "lineitem"], ["nation", "orders"]
SHARED = ["region", "nation", "customer"], ["nation", "customer", "orders", "lineitem"]
#: Queries by name, each over one way of dividing the tables.
OWN = {
    "federated": (SHARED, FEDERATED),
    "narrowed": (APART, "SELECT * { ?n ex:inRegion region:1 . ?c ex:inNation ?n ; ex:c_acctbal ?b }"),
    "reused": (APART, "SELECT * { ?c ex:inNation ?n . ?x ex:inNation nation:1 . ?y ex:inNation ?n }"),
    "any_predicate": (SHARED, "SELECT * { ?c ex:inNation nation:1 ; ?p ?v }"),
    "path_narrows": (APART, "SELECT * { ?c (ex:inNation|ex:inRegion)+ region:1 ; ex:c_acctbal ?b }"),
    "optional": (ACROSS, "SELECT * { ?o ex:o_orderstatus \"F\" ; ex:placedBy ?c OPTIONAL { ?c ex:inNation ?n OPTIONAL { ?n ex:inRegion ?r } } }"),
    "minus": (ACROSS, "SELECT * { ?c ex:c_acctbal ?b MINUS { ?o ex:placedBy ?c ; ex:o_orderstatus \"P\" } }"),
    "graph": (SHARED, "SELECT ?n ?r ?c { GRAPH ?g { ?n ex:inRegion ?r } ?c ex:inNation ?n }"),
}


@pytest.fixture(scope="module")
def own(spark):
    return {t: lifted(spark.createDataFrame(r, schema).coalesce(1).cache(), t) for t, (schema, r) in TABLES.items()}


def sources(own, sides, as_quads):
    for k, tables in enumerate(sides):
        data = LiftedDataset(own[t] for t in tables)
        yield DatasetSource(QuadDataset(data.quads(), unique=True) if as_quads else data, f"http://source/{k}", Config.of(page_size=5))


def decided(h):
    s = h.stats
    return [(p.index, p.estimate, p.decision, p.triples, p.bindings, p.reused_from, p.incomplete) for p in s.patterns], s.triples_received, s.triples_stored, s.declared_incomplete


@pytest.mark.parametrize("name", OWN)
def test_own_tables_give_what_their_quads_give(spark, own, name):
    sides, q = OWN[name]
    got, found = answer(spark, EX + q, sources(own, sides, False))
    want, quads_found = answer(spark, EX + q, sources(own, sides, True))
    assert rows(got) == rows(want)
    for a, b in zip(found, quads_found, strict=True):
        assert decided(a) == decided(b)
        assert rows(a.triples) == rows(b.triples)


def test_own_tables_are_read_and_not_copied(spark, own, monkeypatch):
    """Whole fragments are neither written nor turned to terms, so no line item's id is made."""
    labels = []
    keep = harvesting.written
    monkeypatch.setattr(harvesting, "written", lambda df, label: labels.append(label) or keep(df, label))
    got, found = answer(spark, EX + FEDERATED, sources(own, APART, False))
    assert {d for h in found for d in h.stats.decisions()} == {"full", "empty"}
    assert set(labels) <= {"keys"}
    assert "sha2" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert got.count() > 0
