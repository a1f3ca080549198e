"""Readers agree, are lenient, and repair IRIs; harvests are posted to a store."""

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from tessera import terms as T
from tessera.plans.harvest import harvest
from tessera.sources.dataset import QuadDataset
from tessera.sources.provenance import nanopublication, publish_remote
from tessera.sources.rdf import parse_document, read_counted, read_rdf, repaired, write_nquads, write_trig
from tests.railway import PRE, QUERIES, quads

SCHEMA = "s string, p string, o string, g string"
XSD = T.XSD
WANT = {
    ("<http://x/a>", T.TYPE, "<http://x/Thing>"),
    ("<http://x/a>", "<http://x/name>", '"Ada"@en'),
    ("<http://x/a>", "<http://x/age>", f'"36"^^<{XSD}integer>'),
    ("<http://x/a>", "<http://x/knows>", "<http://x/b>"),
    ("<http://x/b>", "<http://x/note>", '"two\nlines \\ and \"quotes\""'),
}
TEXTS = {
    "turtle": '@prefix x: <http://x/> . x:a a x:Thing ; x:name "Ada"@EN ; x:age 36 ; x:knows x:b .\nx:b x:note "two\\nlines \\\\ and \\"quotes\\"" .',
    "trig": 'PREFIX x: <http://x/>\n{ x:a a x:Thing ; x:name "Ada"@en ; x:age 36 ; x:knows x:b . } { x:b x:note """two\nlines \\\\ and "quotes\\"""" }',
    "ntriples": f'<http://x/a> {T.TYPE} <http://x/Thing> .\n<http://x/a> <http://x/name> "Ada"@en .\n<http://x/a> <http://x/age> "36"^^<{XSD}integer> . # years\n\n# a comment\n<http://x/a> <http://x/knows> <http://x/b> .\n<http://x/b> <http://x/note> "two\\nlines \\\\ and \\"quotes\\"" .',
    "rdfxml": f"""<?xml version="1.0"?><rdf:RDF xmlns:rdf="{T.RDF}" xmlns:x="http://x/" xml:base="http://x/"><x:Thing rdf:about="a"><x:name xml:lang="en">Ada</x:name>
      <x:age rdf:datatype="{XSD}integer">36</x:age><x:knows><rdf:Description rdf:about="http://x/b"><x:note>two\nlines \\ and "quotes"</x:note></rdf:Description></x:knows></x:Thing></rdf:RDF>""",
    "jsonld": json.dumps({"@context": {"x": "http://x/", "knows": {"@id": "x:knows", "@type": "@id"}}, "@graph": [{"@id": "x:a", "@type": "x:Thing", "x:name": {"@value": "Ada", "@language": "en"}, "x:age": 36, "knows": "x:b"}, {"@id": "x:b", "x:note": 'two\nlines \\ and "quotes"'}]}),
}
ENDINGS = {"turtle": "ttl", "trig": "trig", "ntriples": "nt", "rdfxml": "rdf", "jsonld": "jsonld"}


@pytest.mark.parametrize("form", TEXTS)
def test_readers_agree(spark, tmp_path, form):
    assert {q[:3] for q in parse_document(TEXTS[form], form).quads} == WANT
    path = tmp_path / f"data.{ENDINGS[form]}"
    path.write_text(TEXTS[form])
    assert {tuple(r)[:3] for r in read_rdf(spark, str(path)).collect()} == WANT


def test_what_cannot_be_read_costs_only_itself(spark, tmp_path):
    good = "<http://x/a> <http://x/p> <http://x/b> ."
    for form, text in {"nt": f"{good}\nnonsense\n<http://x/a> <http://x/p> .\n", "ttl": f"@prefix x: <http://x/> .\nx:a x:p x:b .\nx:a x:p ] .\nx:a x:q x:c .\n"}.items():
        path = tmp_path / f"bad.{form}"
        path.write_text(text)
        rows = read_counted(spark, str(path)).collect()
        assert ("<http://x/a>", "<http://x/p>", "<http://x/b>") in {tuple(r)[:3] for r in rows}
        assert sum(r.dropped for r in rows) == (2 if form == "nt" else 1)
    with pytest.raises(ValueError):
        parse_document("<rdf", "rdfxml")
    (tmp_path / "bad.rdf").write_text("<rdf")
    assert [r.dropped for r in read_counted(spark, str(tmp_path / "bad.rdf")).collect()] == [1]


def test_iris_are_repaired(spark, tmp_path):
    assert repaired("http://x/a b|é") == "http://x/a%20b%7Cé"
    found = parse_document("<http://x/a b> <http://x/p> <http://x/c`d> .\n<http://x/a\\u0020b> <http://x/p> <http://x/e> .", "ntriples")
    assert {q[0] for q in found.quads} == {"<http://x/a%20b>"} and found.origins == {"http://x/a%20b": "http://x/a b", "http://x/c%60d": "http://x/c`d"}
    (tmp_path / "odd.nt").write_text("<http://x/a b> <http://x/p> <http://x/c`d> .\n<http://x/a\\u0020b> <http://x/p> <http://x/e> .\n")
    assert {tuple(r)[:3] for r in read_rdf(spark, str(tmp_path / "odd.nt")).collect()} == {q[:3] for q in found.quads}


def test_written_quads_are_read_again(spark, tmp_path):
    df = spark.createDataFrame(quads(), SCHEMA)
    write_nquads(df, str(tmp_path / "all.nq"))
    write_trig(df, str(tmp_path / "all.trig"))
    for name in ("all.nq", "all.trig"):
        assert {tuple(r) for r in read_rdf(spark, str(tmp_path / name)).collect()} == set(quads())


class Store(BaseHTTPRequestHandler):
    """Takes N-Quads; serves a dump."""

    def log_message(self, *args):
        pass

    def do_POST(self):
        body = self.rfile.read(int(self.headers["Content-Length"])).decode()
        self.server.lines += body.split("\n")
        self.send_response(204)
        self.end_headers()

    def do_GET(self):
        self.send_response(200)
        self.end_headers()
        self.wfile.write((TEXTS["ntriples"] if self.path.endswith(".nt") else TEXTS["turtle"]).encode() + b"\nrubbish\n")


@pytest.fixture
def store():
    s = ThreadingHTTPServer(("127.0.0.1", 0), Store)
    s.lines = []
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield s
    s.shutdown()


def test_harvests_are_posted(spark, store):
    found = harvest(spark, PRE + QUERIES["bgp"], [QuadDataset(spark.createDataFrame(quads(), SCHEMA))])
    n = publish_remote(found, "r", f"http://127.0.0.1:{store.server_port}/statements", batch=7)
    sent = {tuple(q) for q in parse_document("\n".join(store.lines), "nquads").quads}
    want = {tuple(r) for r in nanopublication(found[0], "r", 1).collect()}
    assert n == len(store.lines) == len(want) and {q[:2] for q in sent} == {q[:2] for q in want}
    assert {q[:3] for q in sent if q[3].endswith("#assertion>")} == {tuple(r) for r in found[0].triples.collect()}


@pytest.mark.parametrize("name", ["data.nt", "data.ttl"])
def test_dumps_are_downloaded(spark, store, name):
    rows = read_counted(spark, f"http://127.0.0.1:{store.server_port}/{name}").collect()
    assert {tuple(r)[:3] for r in rows if r.s} == WANT and sum(r.dropped for r in rows) == 1
