"""A railway as quads, made by arithmetic, and a query for each operator of the algebra."""

from tessera import terms as T

NS = "http://rail.test/"
PRE = f"PREFIX r: <{NS}>\n"
STATIONS, TRAINS, DRIVERS, COMPANIES = 24, 40, 6, 4


def node(name: str) -> str:
    return f"<{NS}{name}>"


def text(value: object, kind: str | None = None, lang: str | None = None) -> str:
    return T.literal(str(value), T.XSD + kind if kind else None, lang)


def _stations():
    for i in range(STATIONS):
        yield f"s{i}", "title", text(f"Stop {i}", lang="en"), None
        if i % 4 == 1:
            yield f"s{i}", "title", text(f"Halt {i}", lang="de"), None
        if i % 5 != 4:
            yield f"s{i}", "inRegion", node(f"region{i % 3}"), None
        if i % 6 != 5:
            yield f"s{i}", "next", node(f"s{i + 1}"), None
    yield "s7", "next", node("s7"), None
    yield "s23", "next", node("s18"), None
    for i in range(3):
        yield f"region{i}", "inCountry", node(f"land{i % 2}"), None


def _trains():
    for i in range(TRAINS):
        yield f"t{i}", "runBy", node(f"c{i % COMPANIES}"), None
        yield f"t{i}", "seats", text(80 + 13 * i % 97, "integer"), None
        yield f"t{i}", "speed", text(f"{60 + 7 * i % 90}.{i % 10}", "decimal"), None
        if i % 8 != 3:
            yield f"t{i}", "stopsAt", node(f"s{7 * i % STATIONS}"), None
        if i % 5 < 3:
            yield f"t{i}", "drivenBy", node(f"d{i % DRIVERS}"), None
        if i % 11 == 5:
            yield f"t{i}", "retired", text("yes"), None
        if i % 3 == 0:
            yield f"t{i}", "image", text(f"train-{i}.png"), node("graphs/images")


def quads() -> list[tuple]:
    kinds = [("Station", "s", STATIONS), ("Train", "t", TRAINS), ("Driver", "d", DRIVERS), ("Company", "c", COMPANIES), ("Region", "region", 3), ("Country", "land", 2)]
    out = [(node(f"{letter}{i}"), T.TYPE, node(kind), None) for kind, letter, n in kinds for i in range(n)]
    rest = [*_stations(), *_trains()]
    rest += [(f"d{i}", "title", text(f"Driver {i}", lang="en"), None) for i in range(DRIVERS)]
    rest += [(f"c{i}", "label", text(f"Company {i}"), None) for i in range(COMPANIES)]
    return out + [(node(s), node(p), o, g) for s, p, o, g in rest]


def by_vocabulary() -> list[list[tuple]]:
    """Two sources: what trains have, types among it, and the rest."""
    own = {node(p) for p in ("runBy", "seats", "speed", "stopsAt", "drivenBy", "retired", "image")} | {T.TYPE}
    return [[q for q in quads() if (q[1] in own) == first] for first in (True, False)]


QUERIES = {
    "bgp": "SELECT * { ?train r:stopsAt ?stop . ?stop r:inRegion ?region }",
    "bgp_of_one_subject": "SELECT * { ?train r:runBy r:c1 ; r:seats ?n ; a r:Train }",
    "bgp_one_variable_twice": "SELECT * { ?stop r:next ?stop }",
    "bgp_anonymous": "SELECT ?train { ?train r:stopsAt [ r:inRegion r:region2 ] }",
    "bgp_tagged": 'SELECT * { ?stop r:title "Halt 5"@de }',
    "bgp_typed": "SELECT * { ?train r:seats 106 }",
    "bgp_any_predicate": "SELECT * { r:t9 ?p ?o }",
    "leftjoin": "SELECT * { ?train r:stopsAt ?stop OPTIONAL { ?train r:drivenBy ?who } }",
    "leftjoin_condition": 'SELECT * { ?train r:runBy ?firm OPTIONAL { ?train r:image ?file FILTER(CONTAINS(?file, "2")) } }',
    "leftjoin_inside": "SELECT * { ?train r:runBy ?firm OPTIONAL { ?train r:drivenBy ?who OPTIONAL { ?who r:title ?name } } }",
    "leftjoin_loose": 'SELECT * { ?stop r:inRegion ?region . { ?train r:retired "yes" OPTIONAL { ?train r:stopsAt ?stop } } }',
    "leftjoin_tested": "SELECT * { ?train r:runBy ?firm OPTIONAL { ?train r:stopsAt ?stop FILTER EXISTS { ?stop r:inRegion r:region1 } } }",
    "minus": 'SELECT * { ?train r:runBy ?firm MINUS { ?train r:retired "yes" } }',
    "minus_apart": 'SELECT * { ?train r:runBy r:c0 MINUS { ?other r:retired "yes" } }',
    "filter_without": "SELECT * { ?train r:runBy ?firm FILTER NOT EXISTS { ?train r:drivenBy ?who } }",
    "filter_with": "SELECT DISTINCT ?stop { ?stop r:inRegion ?region FILTER EXISTS { ?train r:stopsAt ?stop } }",
    "union": "SELECT * { { ?train r:drivenBy ?who } UNION { ?train r:retired ?since } }",
    "union_joined": "SELECT * { ?train r:runBy r:c2 { { ?train r:drivenBy ?who } UNION { ?train r:stopsAt ?stop } } }",
    "slice": "SELECT * { { SELECT ?train { ?train r:speed ?v } ORDER BY DESC(?v) ?train LIMIT 6 } ?train r:seats ?n }",
    "group": "SELECT ?firm (COUNT(?train) AS ?n) (AVG(?v) AS ?mean) { ?train r:runBy ?firm ; r:speed ?v } GROUP BY ?firm",
    "values_extend": "SELECT * { VALUES ?firm { r:c0 r:c3 } ?train r:runBy ?firm BIND(STR(?train) AS ?t) }",
    "path_steps": "SELECT * { ?train r:stopsAt/r:inRegion/r:inCountry ?land }",
    "path_onwards": "SELECT * { ?stop r:next+ ?later }",
    "path_from": "SELECT * { r:s2 r:next* ?later }",
    "path_either": "SELECT * { ?x (^r:drivenBy|r:next) ?y }",
    "path_narrows": "SELECT * { ?train (r:stopsAt|r:next)+ r:s5 . ?train r:seats ?n }",
    "ask": "ASK { ?train r:runBy r:c1 ; r:retired ?since }",
}
