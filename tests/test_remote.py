"""Fragments and SPARQL sources against servers in this process."""

import json
import re
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

import pytest

from tessera import terms as T
from tessera.plans.compile import evaluate
from tessera.plans.harvest import answer
from tessera.sources.dataset import QuadDataset
from tessera.sources.remote import UNREACHABLE, Config, FragmentsSource, SparqlSource
from tests.railway import PRE, QUERIES, quads

DATA = sorted({q[:3] for q in quads()})
SCHEMA = "s string, p string, o string, g string"
PAGE = 25
HYDRA = "http://www.w3.org/ns/hydra/core#"
TOKEN = r'\?\w+|<[^>]*>|"(?:[^"\\]|\\.)*"(?:@[\w-]+|\^\^<[^>]*>)?'


class Handler(BaseHTTPRequestHandler):
    def log_message(self, *args):
        pass

    def send(self, body, kind):
        self.send_response(200)
        self.send_header("Content-Type", kind)
        self.end_headers()
        self.wfile.write(body.encode())

    def do_GET(self):
        args = {k: v[0] for k, v in parse_qs(urlsplit(self.path).query).items()}
        want = [args.get(k) for k in ("subject", "predicate", "object")]
        want = [w if w is None or w.startswith('"') else f"<{w}>" for w in want]
        rows = [t for t in DATA if all(w is None or w == x for w, x in zip(want, t, strict=True))]
        page, base = int(args.get("page", 1)), f"http://{self.headers['Host']}"
        own = f"<{base}{self.path}>"
        lines = [f"{' '.join(map(T.nt, t))} ." for t in rows[(page - 1) * PAGE : page * PAGE]]
        lines += [f'{own} <{HYDRA}totalItems> "{len(rows)}" <{base}/#metadata> .', f'{own} <{HYDRA}itemsPerPage> "{PAGE}" <{base}/#metadata> .']
        if page * PAGE < len(rows):
            follow = re.sub(r"[?&]page=\d+", "", self.path)
            lines.append(f"{own} <{HYDRA}next> <{base}{follow}{'&' if '?' in follow else '?'}page={page + 1}> <{base}/#metadata> .")
        self.send("\n".join(lines), "application/n-quads")

    def do_POST(self):
        query = parse_qs(self.rfile.read(int(self.headers["Content-Length"])).decode())["query"][0]
        if query.startswith("ASK") or "DISTINCT ?c" in query or "DISTINCT ?p" in query:
            return self.explore(query)
        given = re.search(r"VALUES \(([^)]*)\) \{ (.*?) \} \{", query)
        names = re.findall(r"\?(\w+)", given[1]) if given else []
        tokens = re.findall(TOKEN, given[2]) if given else []
        allowed = {tuple(tokens[i : i + len(names)]) for i in range(0, len(tokens), len(names))} if names else None
        pattern = re.findall(TOKEN, re.search(r"\{ ([^{}]*) \} UNION", query)[1])
        found = []
        for t in DATA:
            b = {}
            if all(b.setdefault(w[1:], x) == x if w[0] == "?" else w == T.nt(x) for w, x in zip(pattern, t, strict=True)):
                if allowed is None or tuple(T.nt(b[n]) for n in names) in allowed:
                    found.append(b)
        if "COUNT" in query:
            found = [{"n": f'"{len(found)}"'}]

        def cell(term):
            kind, value, lang, datatype = T.parts(term)
            return {"type": kind, "value": value} | ({"xml:lang": lang} if lang else {}) | ({"datatype": datatype} if datatype else {})

        rows = [{k: cell(v) for k, v in b.items()} for b in found]
        self.send(json.dumps({"head": {}, "results": {"bindings": rows}}), "application/sparql-results+json")


    def explore(self, query):
        """Questions about classes, answered by this engine itself."""
        found = evaluate(query, QuadDataset(self.server.spark.createDataFrame(quads(), SCHEMA), merged=False))
        if query.startswith("ASK"):
            return self.send(json.dumps({"head": {}, "boolean": found.first()[0]}), "application/sparql-results+json")
        cells = [{k: dict(zip(("type", "value"), T.parts(v)[:2], strict=True)) for k, v in r.asDict().items() if v is not None} for r in found.collect()]
        self.send(json.dumps({"head": {}, "results": {"bindings": cells}}), "application/sparql-results+json")


@pytest.fixture(scope="module")
def server(spark):
    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    s.spark = spark
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}/"
    s.shutdown()


def rows(df):
    return sorted(str(sorted((k, v) for k, v in r.asDict().items() if v is not None)) for r in df.collect())


@pytest.mark.parametrize("kind", [FragmentsSource, SparqlSource])
@pytest.mark.parametrize("name", ["leftjoin_inside", "minus", "bgp_one_variable_twice", "bgp_tagged", "path_steps"])
def test_remote_is_complete(spark, server, kind, name):
    whole = QuadDataset(spark.createDataFrame([(*t, None) for t in DATA], SCHEMA))
    got, found = answer(spark, PRE + QUERIES[name], [kind(spark, server, Config.of(values_block=7, retries=0))])
    assert rows(got) == rows(evaluate(PRE + QUERIES[name], whole)) and not found[0].stats.declared_incomplete


def test_unreachable_is_declared(spark):
    for kind in (FragmentsSource, SparqlSource):
        _, found = answer(spark, PRE + QUERIES["bgp"], [kind(spark, "http://127.0.0.1:9/", Config.of(retries=0, timeout=2.0))])
        assert found[0].stats.decisions() == ["unreachable"] * 2 and found[0].stats.declared_incomplete
        assert found[0].stats.patterns[0].estimate == UNREACHABLE


def test_page_of_dropped_statements_doesnt_end_the_walk(monkeypatch):
    from tessera.plans.algebra import Var
    from tessera.plans.demand import Pattern
    from tessera.sources import remote

    t = ("<urn:s>", "<urn:p>", "<urn:o>")
    pages = {"http://f/": remote.Page([], 3, 2, "http://f/?page=2", True, 2), "http://f/?page=2": remote.Page([t], 3, 2, None, True, 0)}
    monkeypatch.setattr(remote, "read_page", lambda url, config, meter: pages[url])
    got = list(FragmentsSource(None, "http://f/", Config()).answer(Pattern(Var("s"), Var("p"), Var("o")), [{}], remote.Meter()))
    assert got == [(None, None, None, False, 2, 0, 1, 0, 0), (*t, False, 0, 0, 0, 0, 0)]


def test_index_of_services(spark, server, tmp_path):
    """An endpoint, a fragments server, a dump and a table have the same shapes; what can't be read is told."""
    from tessera.operators.indexing import Unindexed, index_source, index_sources, mode_of
    from tessera.operators.shapes import index

    table = spark.createDataFrame(quads(), SCHEMA)
    want = {(r.a, r.p, r.b) for r in index(table, "x").collect()}
    config = Config.of(retries=0, timeout=60.0, page_size=PAGE, concurrent_requests=1)  # the server needs tasks of its own
    (tmp_path / "rail.nq").write_text("\n".join(" ".join(map(T.nt, filter(None, q))) + " ." for q in quads()))
    specs = [SparqlSource(spark, server, config), FragmentsSource(spark, server, config), QuadDataset(table), f"dump:{tmp_path}/rail.nq", "sparql:http://127.0.0.1:9/", f"dump:{tmp_path}/none.nq", "fragments:http://127.0.0.1:9/"]
    shapes, failed = index_sources(spark, specs, Config.of(retries=0, timeout=60.0))
    found = {}
    for r in shapes.collect():
        found.setdefault(r.source, []).append((r.a, r.p, r.b, r.g))
    assert len(found) == 3 and set(failed) == {"http://127.0.0.1:9/", f"file://{tmp_path}/none.nq"}  # two services at one address
    assert all({x[:3] for x in rows} == want for rows in found.values())
    endpoint = index_source(SparqlSource(spark, server, config))
    assert {r.g for r in endpoint.where(f"p = 'http://rail.test/image'").collect()} == {"http://rail.test/graphs/images"}
    assert mode_of(SparqlSource(spark, server, config)) == "mixed" and mode_of(SparqlSource(spark, "http://127.0.0.1:9/", Config.of(retries=0, timeout=2.0))) == "default"
    with pytest.raises(Unindexed):
        index_source(SparqlSource(spark, "http://127.0.0.1:9/", Config.of(retries=0, timeout=2.0)))
    with pytest.raises(ValueError):
        index_sources(spark, [{"type": "nonsense", "url": "http://x"}])


def test_requests_and_pages_are_counted(spark, server):
    config = Config.of(values_block=7, retries=0)
    _, found = answer(spark, PRE + QUERIES["leftjoin_inside"], [FragmentsSource(spark, server, config)])
    stats = found[0].stats
    assert stats.pages == stats.requests > 3 and stats.bytes > 1000 and set(stats.phases) == {"count", "fetch"}
    # pages that were read for the counts need not be read again by the same worker
    source = FragmentsSource(spark, server, config)
    from tessera.plans.demand import decompose
    from tessera.sources.remote import Meter

    p, meter = decompose(PRE + QUERIES["bgp"])[0], Meter()
    list(source.answer(p, [{}], meter))
    first = meter.pages
    list(source.answer(p, [{}], meter))
    assert meter.pages == first > 1 and meter.cache_hits == first


def test_repaired_iris_are_asked_for_as_they_were_spelled(spark, monkeypatch):
    """A server with IRIs that none may have: they are repaired, and its fragments found all the same."""
    from tessera.sources import remote

    strange = f"<http://x/a b|{{c}}>"
    rows = [(f"<http://x/s{i}>", "<http://x/p>", strange if i % 2 else "<http://x/plain>") for i in range(6)] + [(strange, "<http://x/q>", '"found"'), ("<http://x/plain>", "<http://x/q>", '"plain"')] + [(f"<http://x/z{i}>", "<http://x/q>", '"other"') for i in range(300)]

    class Strange(BaseHTTPRequestHandler):
        log_message, send = Handler.log_message, Handler.send

        def do_GET(self):
            args = {k: v[0] for k, v in parse_qs(urlsplit(self.path).query).items()}
            want = [args.get(k) for k in ("subject", "predicate", "object")]
            hits = [t for t in rows if all(w is None or x in (w, f"<{w}>") for w, x in zip(want, t, strict=True))]
            own = f"<http://{self.headers['Host']}{self.path}>"
            lines = [" ".join(t) + " ." for t in hits] + [f'{own} <{HYDRA}totalItems> "{len(hits)}" <http://m/#metadata> .', f'{own} <{HYDRA}itemsPerPage> "2" <http://m/#metadata> .']
            self.send("\n".join(lines), "application/n-quads")

    s = ThreadingHTTPServer(("127.0.0.1", 0), Strange)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    try:
        got, found = answer(spark, "SELECT * { ?s <http://x/p> ?o . ?o <http://x/q> ?v }", [FragmentsSource(spark, f"http://127.0.0.1:{s.server_port}/", Config.of(retries=0, values_block=1))])
        assert found[0].stats.decisions() == ["full", "bind"] and found[0].stats.iris_rewritten == 2  # the one IRI, in either fetch
        assert sorted({(r.o, r.v) for r in got.collect()}) == [("<http://x/a%20b%7C%7Bc%7D>", '"found"'), ("<http://x/plain>", '"plain"')]
    finally:
        s.shutdown()
    assert remote.repaired("http://x/a b") == "http://x/a%20b"
