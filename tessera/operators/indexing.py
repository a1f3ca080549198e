"""Shape indexes of repositories of any kind: datasets, dumps, SPARQL endpoints, fragments servers.

A dataset's or dump's index is a job over its quads. An endpoint is asked for its classes, and then,
by tasks, for the shapes of each class: as many answers as it has different shapes, not triples. A
fragments server has no such questions; what its typed subjects have is harvested and indexed, but for
the descriptions that it adds of itself.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import terms as T
from tessera.operators.shapes import DEFAULT_GRAPH, graph_mode, index
from tessera.operators.tables import written
from tessera.plans.harvest import harvest
from tessera.sources.remote import Config, DatasetSource, DumpSource, Meter, Source, SparqlSource, open_source

SCHEMA = "source string, a string, p string, b string, g string"
TYPED = f"SELECT * {{ ?s {T.TYPE} ?c . ?s ?p ?o OPTIONAL {{ ?o {T.TYPE} ?d }} }}"


class Unindexed(OSError):
    """A repository that couldn't be read."""


def mode_of(source: Source) -> str:
    """Where a repository's triples are: default, named, mixed or none. An endpoint is asked twice;
    if it answers neither, its default graph is taken. Fragments servers show a single graph."""
    if isinstance(source, DatasetSource):
        return graph_mode(source.data.quads())
    if isinstance(source, SparqlSource):
        plain, named = source.holds("ASK { ?s ?p ?o }"), source.holds("ASK { GRAPH ?g { ?s ?p ?o } }")
        if plain is None and named is None:
            return "default"
        return "mixed" if plain and named else "default" if plain else "named" if named else "none"
    return "default"


def scoped(mode: str, content: str, graph: str) -> str:
    """content where a repository's triples are; graph: the variable that names the graph."""
    inside = f"GRAPH ?{graph} {{ {content} }}"
    return content if mode == "default" else inside if mode == "named" else f"{{ {content} }} UNION {{ {inside} }}"


def classes_query(mode: str) -> str:
    return f"SELECT DISTINCT ?c {{ {scoped(mode, f'?s {T.TYPE} ?c', 'h')} }}"


def shapes_query(mode: str, of_class: str) -> str:
    """(?p ?b ?g) of the triples of a class's members: the classes of their objects, and the graphs."""
    parts = [scoped(mode, f"?s {T.TYPE} <{of_class}>", "h"), scoped(mode, "?s ?p ?o", "g")]
    grouped = " ".join(f"{{ {p} }}" for p in parts)
    return f"SELECT DISTINCT ?p ?b ?g {{ {grouped} OPTIONAL {{ {scoped(mode, f'?o {T.TYPE} ?b', 'i')} }} FILTER(?p != {T.TYPE}) }}"


def _explored(source: SparqlSource) -> DataFrame:
    mode = mode_of(source)
    listed = source._ask(classes_query(mode))
    if listed is None:
        raise Unindexed(f"{source.identity} doesn't list its classes")
    names = sorted({r["c"]["value"] for r in listed if r.get("c", {}).get("type") == "uri"})
    spark, ask, identity = source.spark, source._ask, source.identity

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name in b.column(0).to_pylist():
                rows = ask(shapes_query(mode, name), Meter())
                if rows is None:
                    raise Unindexed(f"{identity} doesn't tell the shapes of <{name}>")
                value = lambda r, v, other: r[v]["value"] if r.get(v, {}).get("type") == "uri" else other
                cells = [(identity, name, r["p"]["value"], value(r, "b", ""), value(r, "g", DEFAULT_GRAPH)) for r in rows if "p" in r]
                yield pa.RecordBatch.from_arrays([pa.array([c[i] for c in cells], pa.string()) for i in range(5)], names=["source", "a", "p", "b", "g"])

    tasks = max(1, min(len(names), source.config.concurrent_requests))
    classes = spark.createDataFrame([(n,) for n in names], "a string").repartition(tasks)
    return written(classes.mapInArrow(work, SCHEMA).distinct(), "shapes")


def index_source(source: Source) -> DataFrame:
    """(source, a, p, b, g) of one repository; Unindexed if it can't be read."""
    if isinstance(source, DumpSource) and source.error is not None:
        raise Unindexed(f"{source.identity}: {source.error}") from source.error
    if isinstance(source, DatasetSource):
        return index(source.data, source.identity)
    if isinstance(source, SparqlSource):
        return _explored(source)
    found = harvest(source.spark, TYPED, [source], source.config, strict=True)[0]
    if found.stats.errors:
        raise Unindexed(f"{source.identity}: {found.stats.errors} requests failed")
    return index(found.triples.withColumn("g", F.lit(None).cast("string")), source.identity, descriptive=False)


def index_sources(spark: SparkSession, specs: Iterable[object], config: Config | None = None) -> tuple[DataFrame, dict[str, str]]:
    """The index of several repositories, and why those that aren't in it couldn't be read. What
    specs may be, open_source tells; one of an unknown type is a ValueError."""
    opened = [open_source(spark, s, config) for s in specs]
    parts, failed = [spark.createDataFrame([], SCHEMA)], {}
    for source in opened:
        try:
            parts.append(index_source(source))
        except Exception as error:  # noqa: BLE001  whatever a service does; the others go on
            failed[source.identity] = f"{type(error).__name__}: {error}"[:500]
    return reduce(DataFrame.union, parts), failed
