"""Queries over the driver's tables, each with the SQL that gives the same rows.

They are SPARQL texts over the lifted tables; a result's columns are read as the types named.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.scalar import as_number, as_text
from tessera.operators.shapes import ANY, index, match_shapes, query_shapes
from tessera.operators.solutions import col_of
from tessera.operators.tables import shared_dir, written
from tessera.plans.compile import evaluate, solve
from tessera.plans.demand import decompose
from tessera.plans.harvest import answer, harvest, nanopub
from tessera.sources.dataset import Dataset, QuadDataset
from tessera.sources.lift import NS, TABLES, dataset
from tessera.sources.provenance import evaluate_published, nanopublication, publish
from tessera.sources.remote import DatasetSource

PREFIX = f"PREFIX ex: <{NS}>\nPREFIX xsd: <http://www.w3.org/2001/XMLSchema#>\n"


def read_as(query: str, data: Dataset, types: dict[str, str]) -> DataFrame:
    """A SELECT query's result with a column of each named type: long, double, string (the
    characters), key (the number that ends an IRI) or boolean."""
    plan = solve(PREFIX + query, data)
    cols = []
    for v, t in types.items():
        value = plan.value(v)
        if value is None:  # never bound
            cols.append(F.lit(None).cast("string" if t == "string" else "double" if t == "double" else "long").alias(v))
            continue
        if t == "key":
            native = value.kind.name == "iri" and dict(plan.df.dtypes)[col_of(v)._jc.toString()] in ("int", "bigint")
            c = (value.col if native else F.regexp_extract(as_text(value), r"(\d+)$", 1)).cast("long")
        elif t in ("long", "double"):
            c = as_number(value).cast(t)
        elif t == "boolean":
            c = value.col if value.kind.name == "boolean" else as_text(value).cast("boolean")
        else:
            c = as_text(value)
        cols.append(c.alias(v))
    return plan.df.select(*cols)


QUERIES: dict[str, tuple[str, dict[str, str], str]] = {
    "bgp_chain": (
        "SELECT ?c ?n ?r { ?c ex:inNation ?nation ; a ex:Customer ; ex:c_name ?n . ?nation ex:inRegion ?region . ?region ex:r_name ?r }",
        {"c": "key", "n": "string", "r": "string"},
        "SELECT c_custkey AS c, c_name AS n, r_name AS r FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    ),
    "bgp_star": (
        'SELECT ?p ?name ?size { ?p ex:p_type "ECONOMY" ; ex:p_name ?name ; ex:p_size ?size ; a ex:Part }',
        {"p": "key", "name": "string", "size": "long"},
        "SELECT p_partkey AS p, p_name AS name, CAST(p_size AS BIGINT) AS size FROM part WHERE p_type = 'ECONOMY'",
    ),
    "snowflake": (
        "SELECT ?o ?nation ?qty { ?l ex:ofOrder ?o ; ex:l_quantity ?qty . ?o ex:placedBy ?c ; ex:o_orderstatus \"F\" . ?c ex:inNation ?n . ?n ex:n_name ?nation }",
        {"o": "key", "nation": "string", "qty": "double"},
        "SELECT o_orderkey AS o, n_name AS nation, l_quantity AS qty FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'F'",
    ),
    "filter_compare": (
        'SELECT ?o ?t { ?o ex:o_totalprice ?t ; ex:o_orderstatus ?s FILTER(?t > 400000 && ?s = "F") }',
        {"o": "key", "t": "double"},
        "SELECT o_orderkey AS o, o_totalprice AS t FROM orders WHERE o_totalprice > 400000 AND o_orderstatus = 'F'",
    ),
    "filter_logic": (
        'SELECT ?p ?s { ?p ex:p_size ?s ; ex:p_brand ?b FILTER(!(?s < 10) && (?s <= 12 || ?s >= 49) && ?b != "Brand#11") }',
        {"p": "key", "s": "long"},
        "SELECT p_partkey AS p, CAST(p_size AS BIGINT) AS s FROM part WHERE NOT (p_size < 10) AND (p_size <= 12 OR p_size >= 49) AND p_brand <> 'Brand#11'",
    ),
    "theta_join": (
        "SELECT ?a ?b { ?a ex:inNation ?n ; a ex:Supplier ; ex:s_name ?x . ?b ex:inNation ?n ; a ex:Supplier ; ex:s_name ?y FILTER(?x < ?y) }",
        {"a": "key", "b": "key"},
        "SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_name < b.s_name",
    ),
    "value_join": (
        "SELECT ?r ?n { { ?r ex:r_regionkey ?x } { ?n ex:n_nationkey ?y } FILTER(?x = ?y) }",
        {"r": "key", "n": "key"},
        "SELECT CAST(r_regionkey AS BIGINT) AS r, CAST(n_nationkey AS BIGINT) AS n FROM region JOIN nation ON r_regionkey = n_nationkey",
    ),
    "cross_join": (
        "SELECT ?r ?big { ?r a ex:Region { SELECT (MAX(?b) AS ?big) { ?c ex:c_acctbal ?b } } }",
        {"r": "key", "big": "double"},
        "SELECT CAST(r_regionkey AS BIGINT) AS r, (SELECT max(c_acctbal) FROM customer) AS big FROM region",
    ),
    "optional": (
        "SELECT ?o ?q { ?o a ex:Order OPTIONAL { ?l ex:ofOrder ?o ; ex:l_quantity ?q } }",
        {"o": "key", "q": "double"},
        "SELECT o_orderkey AS o, l_quantity AS q FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey",
    ),
    "optional_cond": (
        "SELECT ?o ?q { ?o ex:o_orderstatus ?s OPTIONAL { ?l ex:ofOrder ?o ; ex:l_quantity ?q FILTER(?q > 40 && ?s = \"O\") } }",
        {"o": "key", "q": "double"},
        "SELECT o_orderkey AS o, l_quantity AS q FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_quantity > 40 AND o_orderstatus = 'O'",
    ),
    "optional_nested": (
        'SELECT ?n ?s ?c { ?n a ex:Nation OPTIONAL { ?x ex:inNation ?n ; ex:s_name ?s ; ex:s_acctbal ?b FILTER(?b > 9000) OPTIONAL { ?y ex:inNation ?n ; ex:c_name ?c ; ex:c_acctbal ?d FILTER(?d > 9900) } } }',
        {"n": "key", "s": "string", "c": "string"},
        "SELECT CAST(n_nationkey AS BIGINT) AS n, s_name AS s, c_name AS c FROM nation LEFT JOIN (SELECT * FROM supplier LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 9900) ON c_nationkey = s_nationkey WHERE s_acctbal > 9000) ON s_nationkey = n_nationkey",
    ),
    "optional_exists": (
        "SELECT ?n ?s { ?n a ex:Nation OPTIONAL { ?s ex:inNation ?n ; a ex:Supplier FILTER EXISTS { ?l ex:bySupplier ?s ; ex:l_quantity \"50.0\"^^xsd:double } FILTER EXISTS { ?s ex:s_acctbal ?b FILTER(?b > 5000) } } }",
        {"n": "key", "s": "key"},
        "SELECT CAST(n_nationkey AS BIGINT) AS n, s_suppkey AS s FROM nation LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 5000 AND EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity = 50)) ON s_nationkey = n_nationkey",
    ),
    "optional_not_well_designed": (
        "SELECT ?n ?r ?s { ?n ex:inRegion ?r { ?s a ex:Supplier OPTIONAL { ?s ex:inNation ?n ; ex:s_acctbal ?b FILTER(?b > 5000) } } }",
        {"n": "key", "r": "key", "s": "key"},
        "SELECT CAST(n_nationkey AS BIGINT) AS n, CAST(n_regionkey AS BIGINT) AS r, s_suppkey AS s FROM nation JOIN supplier ON s_acctbal <= 5000 OR s_nationkey = n_nationkey",
    ),
    "negation_bound": (
        "SELECT ?o { ?o a ex:Order OPTIONAL { ?l ex:ofOrder ?o } FILTER(!bound(?l)) }",
        {"o": "key"},
        "SELECT o_orderkey AS o FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)",
    ),
    "not_exists": (
        "SELECT ?o ?t { ?o ex:o_totalprice ?t FILTER NOT EXISTS { ?l ex:ofOrder ?o } }",
        {"o": "key", "t": "double"},
        "SELECT o_orderkey AS o, o_totalprice AS t FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)",
    ),
    "exists": (
        "SELECT ?p { ?p a ex:Part FILTER EXISTS { ?l ex:ofPart ?p ; ex:l_quantity ?q FILTER(?q >= 50) } }",
        {"p": "key"},
        "SELECT p_partkey AS p FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity >= 50)",
    ),
    "exists_correlated": (
        "SELECT ?c { ?c ex:c_acctbal ?b ; ex:inNation ?n FILTER NOT EXISTS { ?d ex:inNation ?n ; ex:c_acctbal ?e FILTER(?e > ?b) } }",
        {"c": "key"},
        "SELECT c_custkey AS c FROM customer x WHERE NOT EXISTS (SELECT 1 FROM customer y WHERE y.c_nationkey = x.c_nationkey AND y.c_acctbal > x.c_acctbal)",
    ),
    "minus": (
        'SELECT ?c { ?c a ex:Customer MINUS { ?o ex:placedBy ?c ; ex:o_orderstatus "P" } }',
        {"c": "key"},
        "SELECT c_custkey AS c FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')",
    ),
    "minus_disjoint": (
        'SELECT ?n { ?n a ex:Nation MINUS { ?x ex:r_name "ASIA" } }',
        {"n": "key"},
        "SELECT CAST(n_nationkey AS BIGINT) AS n FROM nation",
    ),
    "union_all": (
        "SELECT ?x ?name { { ?x ex:c_name ?name } UNION { ?x ex:s_name ?name } }",
        {"x": "key", "name": "string"},
        "SELECT c_custkey AS x, c_name AS name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier",
    ),
    "union_distinct": (
        "SELECT DISTINCT ?n { { ?x ex:inNation ?n ; a ex:Customer } UNION { ?x ex:inNation ?n ; a ex:Supplier } }",
        {"n": "key"},
        "SELECT CAST(c_nationkey AS BIGINT) AS n FROM customer UNION SELECT s_nationkey FROM supplier",
    ),
    "union_compat": (
        "SELECT ?n ?s ?name { { { ?n a ex:Nation } UNION { ?s a ex:Supplier } } ?s ex:inNation ?n ; ex:s_name ?name }",
        {"n": "key", "s": "key", "name": "string"},
        "SELECT CAST(s_nationkey AS BIGINT) AS n, s_suppkey AS s, s_name AS name FROM supplier UNION ALL SELECT s_nationkey, s_suppkey, s_name FROM supplier",
    ),
    "values_inline": (
        'SELECT ?n ?r { VALUES ?r { "ASIA" "EUROPE" } ?x ex:r_name ?r . ?n ex:inRegion ?x }',
        {"n": "key", "r": "string"},
        "SELECT CAST(n_nationkey AS BIGINT) AS n, r_name AS r FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('ASIA', 'EUROPE')",
    ),
    "values_undef": (
        "SELECT ?n ?r { ?n ex:inRegion ?x . ?x ex:r_regionkey ?r VALUES (?n ?r) { (UNDEF 1) (<http://ex.org/nation/3> UNDEF) } }",
        {"n": "key", "r": "long"},
        "SELECT CAST(n_nationkey AS BIGINT) AS n, CAST(n_regionkey AS BIGINT) AS r FROM nation WHERE n_regionkey = 1 UNION ALL SELECT n_nationkey, n_regionkey FROM nation WHERE n_nationkey = 3",
    ),
    "bind_expr": (
        'SELECT ?n ?u ?s { ?n ex:n_name ?name BIND(UCASE(?name) AS ?u) BIND(CONCAT(SUBSTR(?name, 2, 3), "-", STR(?n)) AS ?s) }',
        {"n": "key", "u": "string", "s": "string"},
        "SELECT CAST(n_nationkey AS BIGINT) AS n, upper(n_name) AS u, substr(n_name, 2, 3) || '-http://ex.org/nation/' || n_nationkey AS s FROM nation",
    ),
    "group_count": (
        "SELECT ?s (COUNT(?o) AS ?n) { ?o ex:o_orderstatus ?s } GROUP BY ?s",
        {"s": "string", "n": "long"},
        "SELECT o_orderstatus AS s, count(*) AS n FROM orders GROUP BY 1",
    ),
    "group_avg": (
        "SELECT ?f (ROUND(AVG(?q) * 1000) AS ?a) { ?l ex:l_returnflag ?f ; ex:l_quantity ?q } GROUP BY ?f",
        {"f": "string", "a": "long"},
        "SELECT l_returnflag AS f, CAST(floor(avg(l_quantity) * 1000 + 0.5) AS BIGINT) AS a FROM lineitem GROUP BY 1",
    ),
    "group_minmax": (
        "SELECT ?b (MIN(?p) AS ?lo) (MAX(?p) AS ?hi) (MIN(?n) AS ?first) { ?x ex:p_brand ?b ; ex:p_retailprice ?p ; ex:p_name ?n } GROUP BY ?b",
        {"b": "string", "lo": "double", "hi": "double", "first": "string"},
        "SELECT p_brand AS b, min(p_retailprice) AS lo, max(p_retailprice) AS hi, min(p_name) AS first FROM part GROUP BY 1",
    ),
    "group_sum": (
        "SELECT ?b (SUM(?s) AS ?total) { ?x ex:p_brand ?b ; ex:p_size ?s } GROUP BY ?b",
        {"b": "string", "total": "long"},
        "SELECT p_brand AS b, CAST(sum(p_size) AS BIGINT) AS total FROM part GROUP BY 1",
    ),
    "group_expr": (
        "SELECT ?y (COUNT(*) AS ?n) { ?o ex:o_orderdate ?d } GROUP BY (YEAR(?d) AS ?y)",
        {"y": "long", "n": "long"},
        "SELECT year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1",
    ),
    "having": (
        "SELECT ?c (COUNT(?o) AS ?n) { ?o ex:placedBy ?c } GROUP BY ?c HAVING(COUNT(?o) > 12 && SUM(1) < 100)",
        {"c": "key", "n": "long"},
        "SELECT o_custkey AS c, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 12 AND count(*) < 100",
    ),
    "implicit_group": (
        "SELECT (COUNT(*) AS ?n) (MAX(?t) AS ?top) (SUM(?k) AS ?none) { ?o ex:o_totalprice ?t ; ex:o_orderkey ?k FILTER(?t < 0) }",
        {"n": "long", "top": "double", "none": "long"},
        "SELECT count(*) AS n, max(o_totalprice) AS top, CAST(0 AS BIGINT) AS none FROM orders WHERE o_totalprice < 0",
    ),
    "nested_agg": (
        "SELECT ?r ?n ?top { { SELECT ?r (MAX(?k) AS ?top) { { SELECT ?r ?n (COUNT(?c) AS ?k) { ?c ex:inNation ?n ; a ex:Customer . ?n ex:inRegion ?r } GROUP BY ?r ?n } } GROUP BY ?r } { SELECT ?r ?n (COUNT(?c) AS ?k2) { ?c ex:inNation ?n ; a ex:Customer . ?n ex:inRegion ?r } GROUP BY ?r ?n } FILTER(?k2 = ?top) }",
        {"r": "key", "n": "key", "top": "long"},
        "WITH k AS (SELECT n_regionkey AS r, n_nationkey AS n, count(*) AS k FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2) SELECT CAST(k.r AS BIGINT) AS r, CAST(k.n AS BIGINT) AS n, m.top AS top FROM k JOIN (SELECT r, max(k) AS top FROM k GROUP BY 1) m ON k.r = m.r AND k.k = m.top",
    ),
    "count_distinct": (
        "SELECT ?s (COUNT(DISTINCT ?c) AS ?n) (COUNT(DISTINCT *) AS ?all) { ?o ex:o_orderstatus ?s ; ex:placedBy ?c } GROUP BY ?s",
        {"s": "string", "n": "long", "all": "long"},
        'SELECT o_orderstatus AS s, count(DISTINCT o_custkey) AS n, count(*) AS "all" FROM orders GROUP BY 1',
    ),
    "group_concat": (
        'SELECT ?r (GROUP_CONCAT(?n ; SEPARATOR = ",") AS ?names) (SAMPLE(?r2) AS ?one) { ?x ex:n_name ?n ; ex:inRegion ?y . ?y ex:r_name ?r BIND(?r AS ?r2) } GROUP BY ?r',
        {"r": "string", "names": "string", "one": "string"},
        "SELECT r_name AS r, string_agg(n_name, ',' ORDER BY n_name) AS names, r_name AS one FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1",
    ),
    "topk": (
        "SELECT ?o ?t { ?o ex:o_totalprice ?t } ORDER BY DESC(?t) ?o LIMIT 25",
        {"o": "key", "t": "double"},
        "SELECT o_orderkey AS o, o_totalprice AS t FROM orders ORDER BY o_totalprice DESC, CAST(o_orderkey AS VARCHAR) LIMIT 25",
    ),
    "offset": (
        "SELECT ?k { ?o ex:o_orderkey ?k } ORDER BY ?k LIMIT 20 OFFSET 35",
        {"k": "long"},
        "SELECT o_orderkey AS k FROM orders ORDER BY 1 LIMIT 20 OFFSET 35",
    ),
    "order_distinct": (
        "SELECT DISTINCT ?b { ?p ex:p_brand ?b } ORDER BY DESC(?b) LIMIT 7",
        {"b": "string"},
        "SELECT DISTINCT p_brand AS b FROM part ORDER BY b DESC LIMIT 7",
    ),
    "order_aggregate": (
        "SELECT ?n (COUNT(?c) AS ?k) { ?c ex:inNation ?n ; a ex:Customer } GROUP BY ?n ORDER BY DESC(COUNT(?c) + 1) ?n LIMIT 5",
        {"n": "key", "k": "long"},
        "SELECT CAST(c_nationkey AS BIGINT) AS n, count(*) AS k FROM customer GROUP BY 1 ORDER BY k DESC, CAST(n AS VARCHAR) LIMIT 5",
    ),
    "subquery_topk": (
        "SELECT ?o ?c ?name { { SELECT ?o ?c { ?o ex:placedBy ?c ; ex:o_totalprice ?t } ORDER BY DESC(?t) ?o LIMIT 10 } ?c ex:c_name ?name }",
        {"o": "key", "c": "key", "name": "string"},
        "SELECT o_orderkey AS o, o_custkey AS c, c_name AS name FROM (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10) JOIN customer ON o_custkey = c_custkey",
    ),
    "constant_subject": (
        "SELECT ?p ?o { <http://ex.org/nation/7> ?p ?o }",
        {"p": "string", "o": "string"},
        "SELECT unnest(['http://www.w3.org/1999/02/22-rdf-syntax-ns#type', 'http://ex.org/n_nationkey', 'http://ex.org/n_name', 'http://ex.org/n_regionkey', 'http://ex.org/inRegion']) AS p, unnest(['http://ex.org/Nation', CAST(n_nationkey AS VARCHAR), n_name, CAST(n_regionkey AS VARCHAR), 'http://ex.org/region/' || n_regionkey]) AS o FROM nation WHERE n_nationkey = 7",
    ),
    "var_predicate": (
        "SELECT ?p (COUNT(*) AS ?n) { ?x a ex:Supplier ; ?p ?o } GROUP BY ?p",
        {"p": "string", "n": "long"},
        "SELECT unnest(['http://www.w3.org/1999/02/22-rdf-syntax-ns#type', 'http://ex.org/s_suppkey', 'http://ex.org/s_name', 'http://ex.org/s_nationkey', 'http://ex.org/s_acctbal', 'http://ex.org/inNation']) AS p, (SELECT count(*) FROM supplier) AS n",
    ),
    "repeated_variable": (
        "SELECT ?x { ?x ex:n_nationkey ?k ; ex:n_regionkey ?k }",
        {"x": "key"},
        "SELECT CAST(n_nationkey AS BIGINT) AS x FROM nation WHERE n_nationkey = n_regionkey",
    ),
    "blank_node": (
        'SELECT ?c { ?c a ex:Customer ; ex:inNation [ ex:inRegion [ ex:r_name "ASIA" ] ] }',
        {"c": "key"},
        "SELECT c_custkey AS c FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'",
    ),
    "path_seq": (
        "SELECT ?o ?r { ?o ex:placedBy/ex:inNation/ex:inRegion ?r }",
        {"o": "key", "r": "key"},
        "SELECT o_orderkey AS o, CAST(n_regionkey AS BIGINT) AS r FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey",
    ),
    "path_alt": (
        "SELECT ?x ?v { ?x (ex:c_name|ex:s_name) ?v }",
        {"x": "key", "v": "string"},
        "SELECT c_custkey AS x, c_name AS v FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier",
    ),
    "path_inverse": (
        "SELECT ?r ?n { ?r ^ex:inRegion ?n }",
        {"r": "key", "n": "key"},
        "SELECT CAST(n_regionkey AS BIGINT) AS r, CAST(n_nationkey AS BIGINT) AS n FROM nation",
    ),
    "path_negated": (
        "SELECT ?r ?o { ?r a ex:Region ; !(ex:r_regionkey|^ex:inRegion) ?o }",
        {"r": "key", "o": "string"},
        "SELECT CAST(r_regionkey AS BIGINT) AS r, r_name AS o FROM region UNION ALL SELECT r_regionkey, 'http://ex.org/Region' FROM region",
    ),
    "string_fns": (
        'SELECT ?n (STRLEN(?v) AS ?l) (STRBEFORE(?v, "A") AS ?b) (STRAFTER(?v, "A") AS ?f) (REPLACE(?v, "[AEI]", "_") AS ?r) (LCASE(?v) AS ?w) (ENCODE_FOR_URI(CONCAT(?v, " &*")) AS ?u) { ?n ex:n_name ?v FILTER(CONTAINS(?v, "A") || STRSTARTS(?v, "N") || REGEX(?v, "^.1", "i") || STRENDS(?v, "9")) }',
        {"n": "key", "l": "long", "b": "string", "f": "string", "r": "string", "w": "string", "u": "string"},
        "SELECT CAST(n_nationkey AS BIGINT) AS n, CAST(length(n_name) AS BIGINT) AS l, CASE WHEN contains(n_name, 'A') THEN substr(n_name, 1, strpos(n_name, 'A') - 1) ELSE '' END AS b, CASE WHEN contains(n_name, 'A') THEN substr(n_name, strpos(n_name, 'A') + 1) ELSE '' END AS f, regexp_replace(n_name, '[AEI]', '_', 'g') AS r, lower(n_name) AS w, replace(n_name, ' ', '%20') || '%20%26%2A' AS u FROM nation WHERE contains(n_name, 'A') OR starts_with(n_name, 'N') OR regexp_matches(n_name, '^.1') OR ends_with(n_name, '9')",
    ),
    "numeric_fns": (
        "SELECT ?p (ABS(?s - 25) AS ?a) (CEIL(?r) AS ?c) (FLOOR(?r) AS ?f) (ROUND(?r) AS ?n) (xsd:double(?s / 4) AS ?q) (?s * 2 + 1 AS ?m) (-?s AS ?neg) { ?p ex:p_size ?s ; ex:p_retailprice ?r }".replace("(?s * 2 + 1 AS ?m)", "((?s * 2 + 1) AS ?m)").replace("(-?s AS ?neg)", "((-?s) AS ?neg)"),
        {"p": "key", "a": "long", "c": "double", "f": "double", "n": "double", "q": "double", "m": "long", "neg": "long"},
        "SELECT p_partkey AS p, CAST(abs(p_size - 25) AS BIGINT) AS a, ceil(p_retailprice) AS c, floor(p_retailprice) AS f, floor(p_retailprice + 0.5) AS n, p_size / 4.0 AS q, CAST(p_size * 2 + 1 AS BIGINT) AS m, CAST(-p_size AS BIGINT) AS neg FROM part",
    ),
    "date_fns": (
        "SELECT ?o (YEAR(?d) AS ?y) (MONTH(?d) AS ?m) (DAY(?d) AS ?t) (HOURS(?d) AS ?h) (MINUTES(?d) AS ?i) { ?o ex:o_orderdate ?d FILTER(?d >= \"1995-01-01T00:00:00\"^^xsd:dateTime) }",
        {"o": "key", "y": "long", "m": "long", "t": "long", "h": "long", "i": "long"},
        "SELECT o_orderkey AS o, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS t, hour(o_orderdate) AS h, minute(o_orderdate) AS i FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01'",
    ),
    "hash_fns": (
        "SELECT ?n (MD5(?v) AS ?m) (SHA1(?v) AS ?s) (SHA256(?v) AS ?t) { ?n ex:n_name ?v }",
        {"n": "key", "m": "string", "s": "string", "t": "string"},
        "SELECT CAST(n_nationkey AS BIGINT) AS n, md5(n_name) AS m, sha1(n_name) AS s, sha256(n_name) AS t FROM nation",
    ),
    "casts": (
        'SELECT ?p (xsd:integer(?r) AS ?i) (xsd:string(?s) AS ?t) (xsd:double(?t) AS ?d) (xsd:boolean(?s) AS ?b) (xsd:integer("x") AS ?none) { ?p ex:p_size ?s ; ex:p_retailprice ?r }',
        {"p": "key", "i": "long", "t": "string", "d": "double", "b": "boolean", "none": "long"},
        "SELECT p_partkey AS p, CAST(trunc(p_retailprice) AS BIGINT) AS i, CAST(p_size AS VARCHAR) AS t, CAST(p_size AS DOUBLE) AS d, p_size <> 0 AS b, CAST(NULL AS BIGINT) AS none FROM part",
    ),
    "conditionals": (
        'SELECT ?p (IF(?s > 25, "big", "small") AS ?k) (COALESCE(?none, ?s) AS ?v) { ?p ex:p_size ?s FILTER(?s IN (1, 2, 3, 30) && ?s NOT IN (2) && sameTerm(?s, ?s)) }',
        {"p": "key", "k": "string", "v": "long"},
        "SELECT p_partkey AS p, CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END AS k, CAST(p_size AS BIGINT) AS v FROM part WHERE p_size IN (1, 3, 30)",
    ),
    "sample_reduced": (
        "SELECT REDUCED ?n (SAMPLE(?c) AS ?some) (COUNT(DISTINCT ?m) AS ?k) { ?s ex:inNation ?n ; ex:c_mktsegment ?m ; ex:c_custkey ?c } GROUP BY ?n",
        {"n": "key", "some": "long", "k": "long"},
        "SELECT CAST(c_nationkey AS BIGINT) AS n, min(c_custkey) AS some, count(DISTINCT c_mktsegment) AS k FROM customer GROUP BY 1",
    ),
    "more_fns": (
        'SELECT ?o (xsd:double(SECONDS(?d)) AS ?s) (isBLANK(?o) AS ?b) (langMatches(LANG(STRLANG(?p, "en-GB")), "en") AS ?m) (langMatches("", "*") AS ?none) (xsd:double(xsd:decimal(?t)) AS ?c) (xsd:double(xsd:float("1.5")) AS ?f) (SUBSTR(?p, 3, 4) AS ?sub) (UCASE(?p) AS ?up) (YEAR(xsd:dateTime("2024-02-29T01:02:03Z")) AS ?y) { ?o ex:o_orderdate ?d ; ex:o_orderpriority ?p ; ex:o_totalprice ?t }',
        {"o": "key", "s": "double", "b": "boolean", "m": "boolean", "none": "boolean", "c": "double", "f": "double", "sub": "string", "up": "string", "y": "long"},
        "SELECT o_orderkey AS o, CAST(second(o_orderdate) AS DOUBLE) AS s, false AS b, true AS m, false AS none, o_totalprice AS c, 1.5::DOUBLE AS f, substr(o_orderpriority, 3, 4) AS sub, upper(o_orderpriority) AS up, 2024::BIGINT AS y FROM orders",
    ),
    "term_fns": (
        'SELECT ?n (isIRI(?n) AS ?i) (isLiteral(?v) AS ?l) (isNumeric(?k) AS ?u) (STR(DATATYPE(?k)) AS ?d) (LANG(STRLANG(?v, "EN")) AS ?g) (STR(IRI(CONCAT("http://x/", ?v))) AS ?r) { ?n ex:n_name ?v ; ex:n_nationkey ?k }',
        {"n": "key", "i": "boolean", "l": "boolean", "u": "boolean", "d": "string", "g": "string", "r": "string"},
        "SELECT CAST(n_nationkey AS BIGINT) AS n, true AS i, true AS l, true AS u, 'http://www.w3.org/2001/XMLSchema#integer' AS d, 'en' AS g, 'http://x/' || n_name AS r FROM nation",
    ),
}


# --- queries over other datasets than the lifted tables -----------------------------------------


def ring(spark: SparkSession, sf_dir: str) -> QuadDataset:
    """nation n leads to nation (7 n + 3) mod 25: a graph with cycles."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("n"))
    node = lambda c: F.concat(F.lit(f"<{NS}nation/"), c.cast("string"), F.lit(">"))
    return QuadDataset(n.select(node(F.col("n")).alias("s"), F.lit(f"<{NS}next>").alias("p"), node((F.col("n") * 7 + 3) % 25).alias("o"), F.lit(None).cast("string").alias("g")), unique=True)


_STEPS = "WITH RECURSIVE e AS (SELECT CAST(n_nationkey AS BIGINT) AS a, CAST((n_nationkey * 7 + 3) % 25 AS BIGINT) AS b FROM nation), r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)"
RING: dict[str, tuple[str, dict[str, str], str]] = {
    "path_plus": ("SELECT ?a ?b { ?a ex:next+ ?b }", {"a": "key", "b": "key"}, f"{_STEPS} SELECT a, b FROM r"),
    "path_star": ("SELECT ?a ?b { ?a ex:next* ?b }", {"a": "key", "b": "key"}, f"{_STEPS} SELECT a, b FROM r UNION SELECT a, a FROM e UNION SELECT b, b FROM e"),
    "path_opt": ("SELECT ?a ?b { ?a ex:next? ?b }", {"a": "key", "b": "key"}, f"{_STEPS} SELECT a, b FROM e UNION SELECT a, a FROM e UNION SELECT b, b FROM e"),
    "path_star_constant": ("SELECT ?b { <http://ex.org/nation/4> ex:next* ?b }", {"b": "key"}, f"{_STEPS} SELECT b FROM r WHERE a = 4 UNION SELECT 4"),
}


#: Two repositories: those who buy and what is sold, and what is ordered.
SIDES = (["region", "nation", "customer", "part", "events"], ["orders", "lineitem", "supplier"])


def _halves(spark: SparkSession, sf_dir: str) -> list[DatasetSource]:
    return [DatasetSource(dataset(spark, sf_dir, t), f"http://ex.org/source/{k}") for k, t in enumerate(SIDES, 1)]


def graph_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRAPH with a variable: a graph per region."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    text = lambda start, c: F.concat(F.lit(f"<{NS}{start}/"), c.cast("string"), F.lit(">"))
    q = n.select(text("nation", F.col("n_nationkey")).alias("s"), F.lit(f"<{NS}n_name>").alias("p"), F.concat(F.lit('"'), "n_name", F.lit('"')).alias("o"), text("region", F.col("n_regionkey")).alias("g"))
    found = evaluate(PREFIX + "SELECT ?g (COUNT(?s) AS ?n) { GRAPH ?g { ?s ex:n_name ?o } } GROUP BY ?g", QuadDataset(q))
    return found.select(F.regexp_extract("g", r"(\d+)>$", 1).cast("long").alias("g"), F.regexp_extract("n", r'"(\d+)"', 1).cast("long").alias("n"))


def ask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate(PREFIX + "ASK { ?o ex:o_totalprice ?t ; ex:o_orderstatus \"F\" FILTER(?t > 100000) }", dataset(spark, sf_dir))


def construct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate(PREFIX + "CONSTRUCT { ?r ex:holds ?n . ?n ex:label ?name } { ?n ex:inRegion ?r ; ex:n_name ?name }", dataset(spark, sf_dir))


def describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate(PREFIX + "DESCRIBE <http://ex.org/region/2>", dataset(spark, sf_dir, ["region", "nation"]))


def harvest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of a query's patterns at a repository of quads: one job for all of them."""
    source = DatasetSource(QuadDataset(dataset(spark, sf_dir, ["nation", "region", "supplier"]).quads(), unique=True), "x")
    patterns = decompose(PREFIX + 'SELECT * { ?s ex:inNation ?n ; ex:s_name ?a . ?n ex:inRegion ?r . ?r ex:r_name "ASIA" . ?x ?p ?y }')
    return spark.createDataFrame(list(enumerate(source.counts(patterns))), "pattern long, n long")


HARVESTED = "SELECT ?c ?n { ?n ex:inRegion <http://ex.org/region/2> . ?c ex:inNation ?n ; ex:c_acctbal ?b }"


def harvest_restricted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many triples of each predicate are left when patterns narrow one another."""
    found = harvest(spark, PREFIX + HARVESTED, [DatasetSource(dataset(spark, sf_dir, ["region", "nation", "customer"]), "http://ex.org/source/1")])
    return found[0].triples.groupBy(F.regexp_extract("p", r"([A-Za-z_]+)>$", 1).alias("p")).agg(F.count("*").alias("n"))


def federated_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A join across two repositories, harvested one by one."""
    df, _ = answer(spark, PREFIX + 'SELECT ?o ?r ?q { ?n ex:inRegion ?r . ?c ex:inNation ?n . ?o ex:placedBy ?c ; ex:o_orderstatus "P" . ?l ex:ofOrder ?o ; ex:l_quantity ?q }', _halves(spark, sf_dir))
    return df.select(*[F.regexp_extract(c, r"(\d+)>$", 1).cast("long").alias(c) for c in ("o", "r")], F.regexp_extract("q", '^"([^"]*)"', 1).cast("double").alias("q"))


def path_restricts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a path allows is all that is fetched: how many triples of each predicate."""
    q = "SELECT ?c ?b { ?c (ex:inNation|ex:inRegion)+ <http://ex.org/region/3> ; ex:c_acctbal ?b }"
    found = harvest(spark, PREFIX + q, [DatasetSource(dataset(spark, sf_dir, ["region", "nation", "customer"]), "http://ex.org/source/1")])
    return found[0].triples.groupBy(F.regexp_extract("p", r"([A-Za-z_]+)>$", 1).alias("p")).agg(F.count("*").alias("n"))


def index_apb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shapes of two repositories."""
    parts = [index(s.data, s.identity) for s in _halves(spark, sf_dir)]
    return parts[0].union(parts[1]).select("source", F.regexp_replace("a", NS, "").alias("a"), F.regexp_replace("p", NS, "").alias("p"), F.regexp_replace("b", NS, "").alias("b"))


def select_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which repositories answer to which of three queries, by which rules."""
    shapes = index_apb(spark, sf_dir).select("source", "a", "p", F.when(F.col("b") == "", ANY).otherwise(F.col("b")).alias("b"))
    shapes = written(shapes, "shapes")  # few rows, which seven rules read
    shapes = shapes.select("source", *[F.when(F.col(c) == ANY, ANY).otherwise(F.concat(F.lit(NS), c)).alias(c) for c in "apb"])
    out = None
    for k, q in ASKED.items():
        rows = spark.createDataFrame(sorted(query_shapes(PREFIX + q)), "a string, p string, b string")
        part = match_shapes(rows, shapes, shapes.select("source", "p").distinct()).select(F.lit(k).cast("long").alias("query"), "source", F.col("rule").cast("long").alias("rule"))
        out = part if out is None else out.union(part)
    return out  # type: ignore[return-value]


#: A query for each rule, and one that no source answers to.
ASKED = {
    1: "SELECT * { ?c a ex:Customer ; ex:inNation ?n . ?n a ex:Nation }",
    2: "SELECT * { ?o a ex:Order ; ex:placedBy ?c . ?c a ex:Customer }",
    3: "SELECT * { ?l a ex:LineItem ; ex:ofOrder ?o }",
    4: "SELECT * { ?o ex:placedBy ?c }",
    5: "SELECT * { ?l a ex:LineItem ; ?p ?o . ?o a ex:Order }",
    6: "SELECT * { ?o a ex:Event ; ?p ?c }",
    7: "SELECT * { ?s ?p ?o . ?o a ex:Supplier }",
    8: "SELECT * { ?r a ex:Region ; ex:placedBy ?c }",
}


def provenance_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four graphs of a harvest's nanopublication, by size."""
    found = harvest(spark, PREFIX + HARVESTED, [DatasetSource(dataset(spark, sf_dir, ["region", "nation", "customer"]), "http://ex.org/source/1")])
    return nanopublication(found[0], "catalogue", 1).groupBy("g").agg(F.count("*").alias("n"))


def published_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A harvest published as nanopublications, gathered again and asked."""
    found = harvest(spark, PREFIX + HARVESTED, [DatasetSource(dataset(spark, sf_dir, ["region", "nation", "customer"]), "http://ex.org/source/1")])
    paths = publish(found, "catalogue", f"{shared_dir(spark)}/published-{uuid.uuid4().hex}")
    df = evaluate_published(spark, PREFIX + HARVESTED, paths)
    return df.select(*[F.regexp_extract(c, r"(\d+)>$", 1).cast("long").alias(c) for c in ("c", "n")])


_CLASS = {t: TABLES[t][0] for t in TABLES}
_COLUMNS = {"region": "r_regionkey r_name", "nation": "n_nationkey n_name n_regionkey", "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment", "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority", "supplier": "s_suppkey s_name s_nationkey s_acctbal", "part": "p_partkey p_name p_brand p_type p_size p_retailprice", "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate", "events": "event_id ts user_id event_type value props"}


def _apb_sql() -> str:
    """Shapes by looking at the tables: a column's, if any cell is filled; a link's, by a join with
    the rows that the same repository has."""
    parts = []
    for k, tables in enumerate(SIDES, 1):
        said = f"'http://ex.org/source/{k}' AS source"
        for t in tables:
            parts += [f"SELECT DISTINCT {said}, '{_CLASS[t]}' AS a, '{c}' AS p, '' AS b FROM {t} WHERE {c} IS NOT NULL" for c in _COLUMNS[t].split()]
            for column, (p, to) in TABLES[t][2].items():
                far = f"CASE WHEN {column} IN (SELECT {TABLES[to][1]} FROM {to}) THEN '{_CLASS[to]}' ELSE '' END" if to in tables else "''"
                parts.append(f"SELECT DISTINCT {said}, '{_CLASS[t]}', '{p}', {far} FROM {t} WHERE {column} IS NOT NULL")
    return " UNION ".join(parts)


def _rules_sql() -> str:
    """The seven rules over that relation and the queries' shapes."""
    asked = [(k, *("ANY" if x == ANY else x.removeprefix(NS) for x in shape)) for k, q in ASKED.items() for shape in sorted(query_shapes(PREFIX + q))]
    rules = {
        1: "q.a <> 'ANY' AND q.p <> 'ANY' AND q.b <> 'ANY' AND h.a = q.a AND h.p = q.p AND h.b = q.b",
        2: "q.a <> 'ANY' AND q.p <> 'ANY' AND h.b = 'ANY' AND h.a = q.a AND h.p = q.p",
        3: "q.a <> 'ANY' AND q.p <> 'ANY' AND q.b = 'ANY' AND h.b <> 'ANY' AND h.a = q.a AND h.p = q.p",
        4: "q.a = 'ANY' AND q.p <> 'ANY' AND h.p = q.p",
        5: "q.a <> 'ANY' AND q.p = 'ANY' AND q.b <> 'ANY' AND h.a = q.a AND h.b IN (q.b, 'ANY')",
        6: "q.a <> 'ANY' AND q.p = 'ANY' AND q.b = 'ANY' AND h.a = q.a",
        7: "q.a = 'ANY' AND q.p = 'ANY' AND q.b <> 'ANY' AND h.b = q.b",
    }
    head = f"WITH h AS (SELECT source, a, p, CASE WHEN b = '' THEN 'ANY' ELSE b END AS b FROM ({_apb_sql()})), q AS (SELECT * FROM (VALUES {', '.join(map(str, asked))}) v(query, a, p, b))"
    return head + " " + " UNION ".join(f"SELECT CAST(query AS BIGINT) AS query, source, CAST({k} AS BIGINT) AS rule FROM q JOIN h ON {on}" for k, on in rules.items())


EXTRA: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "graph_scan": (graph_scan, "SELECT CAST(n_regionkey AS BIGINT) AS g, count(*) AS n FROM nation GROUP BY 1"),
    "ask": (ask, "SELECT EXISTS (SELECT 1 FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'F') AS \"boolean\""),
    "construct": (
        construct,
        "SELECT '<http://ex.org/region/' || n_regionkey || '>' AS subject, '<http://ex.org/holds>' AS predicate, '<http://ex.org/nation/' || n_nationkey || '>' AS object FROM nation UNION SELECT '<http://ex.org/nation/' || n_nationkey || '>', '<http://ex.org/label>', '\"' || n_name || '\"' FROM nation",
    ),
    "describe": (
        describe,
        "SELECT '<http://ex.org/region/2>' AS subject, unnest(['<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>', '<http://ex.org/r_regionkey>', '<http://ex.org/r_name>']) AS predicate, unnest(['<http://ex.org/Region>', '\"2\"^^<http://www.w3.org/2001/XMLSchema#integer>', '\"' || r_name || '\"']) AS object FROM region WHERE r_regionkey = 2",
    ),
    "harvest_counts": (
        harvest_counts,
        "SELECT unnest([0, 1, 2, 3, 4])::BIGINT AS pattern, unnest([(SELECT count(*) FROM supplier), (SELECT count(*) FROM supplier), (SELECT count(*) FROM nation), (SELECT count(*) FROM region WHERE r_name = 'ASIA'), (SELECT 6 * count(*) FROM supplier) + (SELECT 5 * count(*) FROM nation) + (SELECT 3 * count(*) FROM region)])::BIGINT AS n",
    ),
    "harvest_restricted": (
        harvest_restricted,
        "WITH n AS (SELECT * FROM nation WHERE n_regionkey = 2), c AS (SELECT * FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM n)) SELECT 'inRegion' AS p, count(*) AS n FROM n UNION ALL SELECT 'inNation', count(*) FROM c UNION ALL SELECT 'c_acctbal', count(*) FROM c",
    ),
    "federated_join": (
        federated_join,
        "SELECT o_orderkey AS o, CAST(n_regionkey AS BIGINT) AS r, l_quantity AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'P'",
    ),
    "path_restricts": (
        path_restricts,
        "WITH c AS (SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 3) SELECT 'inNation' AS p, count(*) AS n FROM customer UNION ALL SELECT 'inRegion', count(*) FROM nation UNION ALL SELECT 'c_acctbal', count(*) FROM c",
    ),
    "index_apb": (index_apb, _apb_sql()),
    "select_sources": (select_sources, _rules_sql()),
    "published_join": (
        published_join,
        "SELECT c_custkey AS c, CAST(n_nationkey AS BIGINT) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2",
    ),
    "provenance_patterns": (
        provenance_patterns,
        # 12 quads about the harvest, and 4 about each of three patterns
        "WITH n AS (SELECT * FROM nation WHERE n_regionkey = 2), c AS (SELECT * FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM n)) "
        f"SELECT '<{nanopub('catalogue', 1)}#' || part || '>' AS g, n FROM (SELECT 'Head' AS part, 4::BIGINT AS n UNION ALL SELECT 'pubinfo', 3 UNION ALL SELECT 'provenance', 24 UNION ALL SELECT 'assertion', (SELECT count(*) FROM n) + 2 * (SELECT count(*) FROM c))",
    ),
}


def _sparql(name: str) -> Callable[[SparkSession, str], DataFrame]:
    over, data = (QUERIES, dataset) if name in QUERIES else (RING, ring)
    query, types, _ = over[name]
    return lambda spark, sf_dir: read_as(query, data(spark, sf_dir), types)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _sparql(name) for name in (*QUERIES, *RING)} | {name: f for name, (f, _) in EXTRA.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, _, sql) in (QUERIES | RING).items()} | {name: sql for name, (_, sql) in EXTRA.items() if sql}
