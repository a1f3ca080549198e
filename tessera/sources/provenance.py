"""Harvests as nanopublications: what was retrieved, from where, when, and what is missing.

A harvest gives four graphs: head, assertion, provenance and publication info. The assertion is
the harvest's table as it is; the other three are a few dozen quads.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from urllib.request import Request, urlopen

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import terms as T
from tessera.operators.tables import written
from tessera.plans.compile import evaluate
from tessera.plans.demand import label
from tessera.plans.harvest import Harvest, nanopub
from tessera.sources.dataset import QuadDataset
from tessera.sources.rdf import Quad, as_lines, read_rdf, write_nquads, write_trig

NP = "http://www.nanopub.org/nschema#"
NPX = "http://purl.org/nanopub/x/"
PROV = "http://www.w3.org/ns/prov#"
DCAT = "http://www.w3.org/ns/dcat#"
DCT = "http://purl.org/dc/terms/"
OWN = "urn:tessera:vocabulary:"
AGENT = "urn:tessera:agent"
VERSION = "0.1"
#: Why a pattern was not retrieved, by what was decided.
REASONS = {
    "skipped": "nothing that was retrieved narrows it down, and a strict run fetches nothing whole",
    "skipped-dump": "without bindings it would be the whole source",
    "unreachable": "the source couldn't be reached or read",
}


def describing(h: Harvest, base: str) -> list[Quad]:
    """The quads of the head, provenance and publication info graphs."""
    i = T.iri
    head, fact, prov, info = (i(f"{base}#{n}") for n in ("Head", "assertion", "provenance", "pubinfo"))
    me, activity, place = i(base), i(f"{base}#harvestActivity"), i(h.source.identity)
    when = lambda t: T.literal(t.isoformat(), T.XSD + "dateTime")
    access = "downloadURL" if h.source.kind == "Dataset" else "endpointURL"
    out: list[Quad] = [
        (me, T.TYPE, i(NP + "Nanopublication"), head),
        (me, i(NP + "hasAssertion"), fact, head),
        (me, i(NP + "hasProvenance"), prov, head),
        (me, i(NP + "hasPublicationInfo"), info, head),
        (fact, T.TYPE, i(DCAT + "Dataset"), prov),
        (fact, i(PROV + "wasGeneratedBy"), activity, prov),
        (fact, i(PROV + "wasDerivedFrom"), place, prov),
        (place, T.TYPE, i(DCAT + h.source.kind), prov),
        (place, i(DCAT + access), place, prov),
        (activity, T.TYPE, i(PROV + "Activity"), prov),
        (activity, i(PROV + "used"), place, prov),
        (activity, i(PROV + "wasAssociatedWith"), i(AGENT), prov),
        (activity, i(PROV + "startedAtTime"), when(h.started), prov),
        (activity, i(PROV + "endedAtTime"), when(h.ended), prov),
        (i(AGENT), T.TYPE, i(PROV + "SoftwareAgent"), prov),
        (i(AGENT), i(DCT + "hasVersion"), T.literal(VERSION), prov),
        (me, i(DCT + "created"), when(h.ended), info),
        (me, i(DCT + "creator"), i(AGENT), info),
        (me, i(NPX + "hasNanopubType"), i(NPX + "ProvenanceRecord"), info),
    ]
    for n in h.stats.patterns:
        entity, p = i(f"{base}#pattern{n.index}"), h.patterns[n.index]
        name = f"Support pattern {n.index} (for a property path)" if p.support else f"Triple pattern {n.index}"
        out += [(activity, i(PROV + "used"), entity, prov), (entity, T.TYPE, i(PROV + "Entity"), prov)]
        out += [(entity, i(T.RDFS + "label"), T.literal(name), prov), (entity, i(T.RDFS + "comment"), T.literal(label(p)), prov)]
        if n.decision in ("skipped", "skipped-dump", "unreachable"):
            out += [(entity, i(OWN + "notRetrievedFrom"), place, prov), (entity, i(OWN + "skipReason"), T.literal(REASONS[n.decision]), prov)]
        elif n.incomplete:
            out += [(entity, i(OWN + "incompletelyRetrievedFrom"), place, prov), (entity, i(OWN + "skipReason"), T.literal("failed requests or unreadable statements"), prov)]
    if h.stats.declared_incomplete:
        out.append((fact, i(OWN + "declaredIncomplete"), T.literal("true", T.XSD + "boolean"), prov))
    if h.stats.iris_rewritten:
        out.append((fact, i(OWN + "rewrittenIRIs"), T.literal(str(h.stats.iris_rewritten), T.XSD + "integer"), prov))
    if h.stats.triples_dropped:
        out.append((fact, i(OWN + "droppedStatements"), T.literal(str(h.stats.triples_dropped), T.XSD + "integer"), prov))
    return out


def nanopublication(h: Harvest, run: str, number: int) -> DataFrame:
    """(s, p, o, g): all four graphs of a harvest."""
    base = nanopub(run, number)
    about = h.triples.sparkSession.createDataFrame(describing(h, base), "s string, p string, o string, g string")
    return h.triples.select("s", "p", "o", F.lit(f"<{base}#assertion>").alias("g")).union(about)


def slug(address: str) -> str:
    return re.sub("[^A-Za-z0-9]+", "_", address).strip("_")


def publish(harvests: list[Harvest], run: str, folder: str, form: str = "parquet") -> list[str]:
    """A folder for each harvest: parquet, nquads or trig. Complete when it is there."""
    out = []
    for k, h in enumerate(harvests, 1):
        path = os.path.join(folder, f"{k:03d}_{slug(h.source.identity)}.{ {'parquet': 'parquet', 'nquads': 'nq', 'trig': 'trig'}[form]}")
        quads = nanopublication(h, run, k)
        if form == "parquet":
            quads.write.mode("errorifexists").parquet(path)
        else:
            (write_nquads if form == "nquads" else write_trig)(quads, path)
        out.append(path)
    return out


def post(quads: DataFrame, url: str, batch: int = 100_000, timeout: float = 60) -> int:
    """Sends quads to a store as N-Quads, `batch` lines at a time, from the tasks; how many. A
    request that isn't taken is an error, and the task is tried again: stores hold sets."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[str] = []

        def send() -> int:
            body = "\n".join(held).encode()
            request = Request(url, body, {"Content-Type": "application/n-quads"})
            with urlopen(request, timeout=timeout) as r:
                if r.status not in (200, 201, 204):
                    raise OSError(f"{url} answered {r.status}")
            n = len(held)
            held.clear()
            return n

        sent = 0
        for b in batches:
            for value in b.column(0).to_pylist():
                held.append(value)
                if len(held) >= batch:
                    sent += send()
        sent += send() if held else 0
        yield pa.RecordBatch.from_arrays([pa.array([sent], pa.int64())], names=["n"])

    # written first: counted once, however often a task is tried
    return written(as_lines(quads).mapInArrow(work, "n long"), "sent").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def publish_remote(harvests: list[Harvest], run: str, url: str, batch: int = 100_000) -> int:
    """Each harvest's assertion first, what describes it last."""
    n = 0
    for k, h in enumerate(harvests, 1):
        quads, fact = nanopublication(h, run, k), f"<{nanopub(run, k)}#assertion>"
        n += post(quads.where(F.col("g") == fact), url, batch) + post(quads.where(F.col("g") != fact), url, batch)
    return n


def gather(spark: SparkSession, paths: list[str]) -> QuadDataset:
    """The assertions of published harvests as one dataset."""
    out = None
    for path in paths:
        form = path.rstrip("/").rsplit(".", 1)[-1]
        quads = spark.read.parquet(path) if form == "parquet" else read_rdf(spark, path)
        quads = quads.where(F.col("g").endswith("#assertion>")).select("s", "p", "o", "g")
        out = quads if out is None else out.union(quads)
    return QuadDataset(out if out is not None else spark.createDataFrame([], "s string, p string, o string, g string"))


def evaluate_published(spark: SparkSession, query: str, paths: list[str]) -> DataFrame:
    return evaluate(query, gather(spark, paths))


def to_rows(result: DataFrame, typed: bool = False) -> list[dict]:
    """A result as dictionaries, unbound variables left out: plain values, or SPARQL-JSON terms."""
    out = []
    for r in result.toLocalIterator():
        row: dict = {}
        for name, v in r.asDict().items():
            if v is None:
                continue
            if not isinstance(v, str):
                row[name] = v
                continue
            kind, value, lang, datatype = T.parts(v)
            if typed:
                row[name] = {"type": kind, "value": value} | ({"xml:lang": lang} if lang else {}) | ({"datatype": datatype} if datatype else {})
            else:
                row[name] = value
        out.append(row)
    return out


