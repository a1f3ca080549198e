"""Repositories: what triple patterns are harvested from.

A Source counts a pattern's triples and fetches them, all or only those with given bindings, as
(s, p, o) with notes: rows without a subject tell of failed requests, of statements that couldn't be
read, of requests made, and (p, o) how an IRI was spelled before it was repaired. Requests to services
are made by tasks, a block of bindings each, so neither bindings nor triples pass through the driver.
Bindings are different ones, so no address is asked for twice in a fetch; a worker keeps the pages that
it has read, and there are no more tasks at a service than `concurrent_requests`.
"""

from __future__ import annotations

import json
import os
import time
import urllib.error
import urllib.request
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from urllib.parse import parse_qsl, urlencode, urlsplit, urlunsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import terms as T
from tessera.operators.solutions import Plan, col_of, name_of
from tessera.operators.tables import written
from tessera.plans.algebra import Triple, Var
from tessera.plans.demand import Pattern
from tessera.sources.dataset import Dataset, QuadDataset
from tessera.sources.rdf import FORMATS, MEDIA, parse_document, read_counted, repaired
from tessera.terms import TERM

UNREACHABLE = 999_999_999
#: Said to be a pattern's count where a service only shows that there is more than a page.
MANY = 10_000
ACCEPT = "application/trig;q=1.0, application/n-quads;q=0.9, text/turtle;q=0.8, application/n-triples;q=0.7"
HYDRA, VOID = "http://www.w3.org/ns/hydra/core#", "http://rdfs.org/ns/void#"
NOTES = ("incomplete", "dropped", "requests", "pages", "bytes", "cache_hits")
SCHEMA = "s string, p string, o string, incomplete boolean, dropped int, requests int, pages int, bytes long, cache_hits int"
_PLAIN = (False, 0, 0, 0, 0, 0)


@dataclass
class Config:
    """Settings of retrieval; unknown names are errors."""

    values_block: int = 100
    page_size: int = 1000
    full_page_weight: float = 1.0
    timeout: float = 60.0
    retries: int = 2
    skip_forced_dumps: bool = True
    parallel_sources: int = 4
    concurrent_requests: int = 16
    page_cache: int = 2048
    strict: bool = False

    @classmethod
    def of(cls, **settings: object) -> Config:
        odd = set(settings) - set(cls.__dataclass_fields__)
        if odd:
            raise ValueError(f"unknown settings: {', '.join(sorted(odd))}")
        return cls(**settings)  # type: ignore[arg-type]


@dataclass
class Meter:
    """What was asked of a service."""

    requests: int = 0
    pages: int = 0
    bytes: int = 0
    cache_hits: int = 0

    def note(self, incomplete: bool = False, dropped: int = 0) -> tuple:
        """A row of what has happened since the last one."""
        out = (None, None, None, incomplete, dropped, self.requests, self.pages, self.bytes, self.cache_hits)
        self.requests = self.pages = self.bytes = self.cache_hits = 0
        return out


def request(url: str, config: Config, accept: str, data: bytes | None = None, kind: str = "", meter: Meter | None = None) -> tuple[bytes, str] | None:
    """(body, media type); None if it failed, also when tried again."""
    headers = {"Accept": accept} | ({"Content-Type": kind} if kind else {})
    meter = meter or Meter()
    for attempt in range(config.retries + 1):
        meter.requests += 1
        try:
            with urllib.request.urlopen(urllib.request.Request(url, data, headers), timeout=config.timeout) as r:
                body = r.read()
                meter.bytes += len(body)
                return body, r.headers.get_content_type()
        except urllib.error.HTTPError as error:
            if error.code != 429 and error.code < 500:
                return None
        except (OSError, ValueError):
            pass
        time.sleep(0.3 * 2**attempt * (attempt < config.retries))
    return None


def _matching(rows: list[tuple[str, str, str]], p: Pattern) -> list[tuple[str, str, str]]:
    """Triples that the pattern selects: constants, and equal terms where a variable repeats."""

    def fits(t: tuple[str, str, str]) -> bool:
        seen: dict[str, str] = {}
        return all(seen.setdefault(x, v) == v if isinstance(x, Var) else x == v for x, v in zip((p.s, p.p, p.o), t, strict=True))

    return [t for t in rows if fits(t)]


def _bound(p: Pattern, values: dict[str, str]) -> Pattern:
    one = lambda x: values.get(x, x) if isinstance(x, Var) else x
    return Pattern(one(p.s), one(p.p), one(p.o), p.graph)  # type: ignore[arg-type]


class Source:
    """One repository. identity and kind are for provenance."""

    page_size = 1000
    kind = "DataService"
    data: Dataset | None = None  # what is read, where that is at hand

    def __init__(self, spark: SparkSession, identity: str, config: Config | None = None):
        self.spark, self.identity, self.config = spark, identity, config or Config()
        self.meter = Meter()  # of the driver's own requests
        self.dropped = 0  # statements of a document that couldn't be read
        self.token = uuid.uuid4().hex

    def note_origins(self, origins: DataFrame) -> None:
        """Remembers how repaired IRIs (iri, origin) were spelled."""

    def count(self, p: Pattern) -> int:
        raise NotImplementedError

    def counts(self, patterns: list[Pattern]) -> list[int]:
        return [self.count(p) for p in patterns]

    def fetch(self, p: Pattern) -> DataFrame:
        raise NotImplementedError

    def fetch_bound(self, p: Pattern, keys: DataFrame, names: list[str]) -> DataFrame:
        raise NotImplementedError

    def keep(self, p: Pattern, fetched: DataFrame, keys: DataFrame, names: list[str]) -> DataFrame:
        """The fetched triples whose terms at names are among keys (and the marks of failures)."""
        at = {v: c for c, v in (("o", p.o), ("p", p.p), ("s", p.s)) if isinstance(v, Var)}
        right = keys.select(*[col_of(v).alias(f"k:{at[v]}") for v in names])
        on = [F.col(at[v]) == F.col(f"`k:{at[v]}`") for v in names]
        condition = on[0]
        for c in on[1:]:
            condition = condition & c
        kept = fetched.where("s is not null").join(right, condition, "left_semi")
        return kept.union(fetched.where("s is null"))


class DatasetSource(Source):
    """A dataset of this engine; counts of all patterns of a table of quads are one job."""

    kind = "Dataset"

    def __init__(self, data: Dataset, identity: str, config: Config | None = None):
        super().__init__(data.spark, identity, config)
        self.data, self.page_size = data, self.config.page_size

    def _triple(self, p: Pattern) -> Triple:
        return Triple(p.s, p.p, p.o)

    def counts(self, patterns: list[Pattern]) -> list[int]:
        if not patterns:
            return []
        if not isinstance(self.data, QuadDataset):  # an aggregate for each pattern, all in one job
            plans = [self.plan(p).df for p in patterns]
            parts = [df.agg(F.count("*").alias("n")).select(F.lit(i).alias("i"), "n") for i, df in enumerate(plans)]
            found = {r.i: r.n for r in reduce(DataFrame.union, parts).collect()}
            return [found[i] for i in range(len(patterns))]
        sums = []
        for i, p in enumerate(patterns):
            test, seen = F.lit(True), {}
            for c, x in (("s", p.s), ("p", p.p), ("o", p.o)):
                if not isinstance(x, Var):
                    test = test & (F.col(c) == x)
                elif x in seen:
                    test = test & (F.col(c) == F.col(seen[x]))
                else:
                    seen[x] = c
            if p.graph is not None and not isinstance(p.graph, Var):
                test = test & (F.col("g") == p.graph)
            sums.append(F.coalesce(F.sum(F.when(test, 1).otherwise(0)), F.lit(0)).cast("long").alias(f"n{i}"))
        row = self.data.table.agg(*sums).first()
        return [row[i] for i in range(len(patterns))]

    def _graph(self, p: Pattern) -> str | None:
        return None if isinstance(p.graph, Var) else p.graph  # a variable: any graph

    def count(self, p: Pattern) -> int:
        return self.plan(p).df.count()

    def plan(self, p: Pattern) -> Plan:
        return self.data.match(self._triple(p), self._graph(p))

    def fetch(self, p: Pattern) -> DataFrame:
        plan = self.plan(p)
        plan = plan.with_kinds({v: TERM for v in plan.kinds})
        cell = lambda x: col_of(x) if isinstance(x, Var) else F.lit(x)
        notes = [F.lit(v).cast("long" if n == "bytes" else "boolean" if n == "incomplete" else "int").alias(n) for n, v in zip(NOTES, _PLAIN, strict=True)]
        return plan.df.select(cell(p.s).alias("s"), cell(p.p).alias("p"), cell(p.o).alias("o"), *notes)

    def fetch_bound(self, p: Pattern, keys: DataFrame, names: list[str]) -> DataFrame:
        return self.keep(p, self.fetch(p), keys, names)


class DumpSource(DatasetSource):
    """An RDF file, folder or http(s) address, read once into a table of its own. Blank nodes have no
    identity outside their file, so their triples aren't harvested. One that can't be read is
    unreachable, and what couldn't be read of one is dropped: a harvest declares both."""

    def __init__(self, spark: SparkSession, path: str, form: str | None = None, config: Config | None = None):
        config = config or Config()
        self.error: Exception | None = None
        nothing = spark.createDataFrame([], "s string, p string, o string, g string")
        try:
            read = written(read_counted(spark, path, form, timeout=config.timeout), "dump")
            dropped = read.agg(F.coalesce(F.sum("dropped"), F.lit(0))).first()[0]
            quads = read.where("s is not null").where(~F.col("s").startswith("_:") & ~F.col("o").startswith("_:")).drop("dropped")
        except Exception as error:  # noqa: BLE001  whatever the reader meets
            quads, dropped, self.error = nothing, 0, error
        super().__init__(QuadDataset(quads), path if "://" in path else f"file://{os.path.abspath(path)}", config)
        self.dropped = dropped

    def counts(self, patterns: list[Pattern]) -> list[int]:
        return [UNREACHABLE] * len(patterns) if self.error else super().counts(patterns)


def _table(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["s", "p", "o", *NOTES])


class _Service(Source):
    """A source whose triples come from requests, which tasks make."""

    def answer(self, p: Pattern, block: list[dict[str, str]], meter: Meter) -> Iterator[tuple]:
        """Rows for a block of bindings; a binding's key "v:origin" is how v's value was spelled."""
        raise NotImplementedError

    block = 1
    origins: DataFrame | None = None

    def _task(self, p: Pattern, names: list[str]):
        answer, size = self.answer, self.block

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[dict[str, str]] = []
            meter = Meter()
            for b in batches:
                held += [{k: v for k, v in zip(names, r, strict=True) if v is not None} for r in zip(*(c.to_pylist() for c in b.columns), strict=True)] if names else [{}] * b.num_rows
                while len(held) >= size:
                    yield _table([*answer(p, held[:size], meter), meter.note()])
                    held = held[size:]
            if held:
                yield _table([*answer(p, held, meter), meter.note()])

        return work

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("spark", "origins")}

    def note_origins(self, origins: DataFrame) -> None:
        self.origins = origins if self.origins is None else self.origins.union(origins).dropDuplicates(["iri"])

    def fetch(self, p: Pattern) -> DataFrame:
        return written(self.spark.range(1, numPartitions=1).mapInArrow(self._task(p, []), SCHEMA), "fetched")

    def fetch_bound(self, p: Pattern, keys: DataFrame, names: list[str]) -> DataFrame:
        rows = keys.select(*[col_of(v).alias(name_of(v)) for v in names]).distinct()
        asked = list(names)
        if self.origins is not None:
            for v in names:
                spelled = self.origins.select(F.col("iri").alias(f"i:{v}"), F.col("origin").alias(f"{name_of(v)}:origin"))
                rows = rows.join(spelled, col_of(v) == F.col(f"`i:{v}`"), "left").drop(f"i:{v}")
                asked.append(f"{v}:origin")
            rows = rows.select(*[col_of(v) for v in names], *[F.col(f"`{name_of(v)}:origin`") for v in names])
        rows = rows.coalesce(max(1, self.config.concurrent_requests))
        return written(rows.mapInArrow(self._task(p, asked), SCHEMA), "fetched")


class SparqlSource(_Service):
    """A SPARQL endpoint: patterns with VALUES blocks over its default and named graphs. Triples
    with blank nodes are left out, as these can't be asked for again."""

    def __init__(self, spark: SparkSession, url: str, config: Config | None = None):
        super().__init__(spark, url, config)
        self.block = self.config.values_block

    def _where(self, p: Pattern) -> str:
        shown = " ".join(f"?{name_of(x).replace('$', '_').replace('%', '_')}" if isinstance(x, Var) else T.nt(x) for x in (p.s, p.p, p.o))  # type: ignore[arg-type]
        if p.graph is not None and not isinstance(p.graph, Var):
            return f"GRAPH {p.graph} {{ {shown} }}"
        return f"{{ {shown} }} UNION {{ GRAPH ?any_graph {{ {shown} }} }}"

    def _said(self, query: str, meter: Meter | None = None) -> dict | None:
        got = request(self.identity, self.config, "application/sparql-results+json", urlencode({"query": query}).encode(), "application/x-www-form-urlencoded", meter or self.meter)
        try:
            return json.loads(got[0]) if got else None
        except ValueError:
            return None

    def holds(self, query: str) -> bool | None:
        """The answer to an ASK query; None if there is none."""
        said = self._said(query)
        return said.get("boolean") if isinstance(said, dict) else None

    def _ask(self, query: str, meter: Meter | None = None) -> list[dict] | None:
        said = self._said(query, meter)
        try:
            return said["results"]["bindings"] if said is not None else None
        except (ValueError, KeyError, TypeError):
            return None

    def count(self, p: Pattern) -> int:
        rows = self._ask(f"SELECT (COUNT(*) AS ?n) {{ {self._where(p)} }}")
        try:
            return int(rows[0]["n"]["value"]) if rows else UNREACHABLE
        except (KeyError, ValueError):
            return UNREACHABLE

    def answer(self, p: Pattern, block: list[dict[str, str]], meter: Meter) -> Iterator[tuple]:
        block = [{v: b.get(f"{v}:origin", x) for v, x in b.items() if not v.endswith(":origin")} for b in block]
        plain = lambda v: name_of(v).replace("$", "_").replace("%", "_")
        names = list(dict.fromkeys(x for x in (p.s, p.p, p.o) if isinstance(x, Var)))
        bound = list(block[0])
        values = f"VALUES ({' '.join('?' + plain(v) for v in bound)}) {{ {' '.join('(' + ' '.join(T.nt(b[v]) for v in bound) + ')' for b in block)} }} " if bound else ""
        rows = self._ask(f"SELECT DISTINCT {' '.join('?' + plain(v) for v in names) or '*'} {{ {values}{self._where(p)} }}", meter)
        if rows is None:
            yield meter.note(incomplete=True)
            return
        origins: dict[str, str] = {}
        for r in rows:
            found: dict[str, str] = {}
            for v in names:
                b = r.get(plain(v), {"type": "bnode"})
                if b["type"] == "bnode":
                    break
                found[v] = T.iri(repaired(b["value"], origins)) if b["type"] == "uri" else T.literal(b["value"], b.get("datatype"), b.get("xml:lang"))
            else:
                s, q, o = (found.get(x, x) for x in (p.s, p.p, p.o))
                if s.startswith("<") and q.startswith("<"):
                    yield (s, q, o, *_PLAIN)
        yield from ((None, T.iri(i), T.iri(was), *_PLAIN) for i, was in origins.items())


@dataclass
class Page:
    triples: list[tuple[str, str, str]]
    total: int | None
    per_page: int | None
    next_url: str | None
    ok: bool
    dropped: int
    origins: dict[str, str] = field(default_factory=dict)


def read_page(url: str, config: Config, meter: Meter | None = None) -> Page:
    """A page of a fragment, its data apart from what it says about itself."""
    got = request(url, config, ACCEPT, meter=meter)
    if got is None:
        return Page([], None, None, None, False, 0)
    body, media = got
    text = body.decode("utf-8", "replace")
    parsed = None
    for form in dict.fromkeys([MEDIA.get(media, "trig"), "nquads"]):
        try:
            parsed = parse_document(text, form, url)
        except ValueError:
            continue
        if parsed.quads:
            break
    if parsed is None:
        return Page([], None, None, None, False, 0)
    own, totals, per_page, following, data = f"<{url}>", {}, None, None, []
    numbers = {f"<{HYDRA}totalItems>", f"<{VOID}triples>"}
    base = url.split("?")[0]
    for s, p, o, g in parsed.quads:
        about = (g or "").rstrip(">").endswith("#metadata") or p.startswith((f"<{HYDRA}", f"<{VOID}")) or (g is None and s.startswith(f"<{base}"))
        if not about:
            data.append((s, p, o))
        elif p in numbers:
            digits = T.parts(o)[1].translate({ord(c): None for c in ",±~ "})
            if digits.isdigit():
                totals[s] = int(digits)
        elif p == f"<{HYDRA}itemsPerPage>":
            per_page = int(T.parts(o)[1]) if T.parts(o)[1].isdigit() else None
        elif p in (f"<{HYDRA}next>", f"<{HYDRA}nextPage>"):
            following = T.parts(o)[1]
    total = totals.get(own, min(totals.values()) if totals else None)
    return Page(data, total, per_page, following, True, parsed.dropped, parsed.origins)


#: Pages that a worker has read, by source and address, the latest last.
_pages: OrderedDict[tuple[str, str], Page] = OrderedDict()


class FragmentsSource(_Service):
    """A triple-pattern-fragments server: pages, one after another; one request per binding."""

    def __init__(self, spark: SparkSession, url: str, config: Config | None = None):
        super().__init__(spark, url, config)
        self.page_size = 100

    def url(self, p: Pattern, spelled: dict[str, str] | None = None) -> str:
        """A fragment's address; spelled: how repaired IRIs are spelled there."""
        parts, spelled = urlsplit(self.identity), spelled or {}
        query = parse_qsl(parts.query)
        for name, x in (("subject", p.s), ("predicate", p.p), ("object", p.o), ("graph", p.graph)):
            if x is not None and not isinstance(x, Var):
                x = spelled.get(x, x)  # type: ignore[arg-type]
                query.append((name, T.parts(x)[1] if x.startswith("<") else x))
        return urlunsplit((*parts[:3], urlencode(query), ""))

    def _page(self, url: str, meter: Meter) -> Page:
        key = (self.token, url)
        if key in _pages:
            meter.cache_hits += 1
            _pages.move_to_end(key)
            return _pages[key]
        page = read_page(url, self.config, meter)
        meter.pages += 1
        if page.ok:
            _pages[key] = page
            while len(_pages) > self.config.page_cache:
                _pages.popitem(last=False)
        return page

    def count(self, p: Pattern) -> int:
        page = self._page(self.url(p), self.meter)
        if not page.ok:
            return UNREACHABLE
        self.page_size = page.per_page or self.page_size
        return page.total if page.total is not None else MANY if page.next_url else len(page.triples)

    def answer(self, p: Pattern, block: list[dict[str, str]], meter: Meter) -> Iterator[tuple]:
        for values in block:
            one = _bound(p, values)
            url: str | None = self.url(one, {values[v]: values[f"{v}:origin"] for v in values if f"{v}:origin" in values})
            seen: set[str] = set()
            while url and url not in seen:
                seen.add(url)
                page = self._page(url, meter)
                if not page.ok or page.dropped:
                    yield meter.note(not page.ok, page.dropped)
                yield from ((*t, *_PLAIN) for t in _matching(page.triples, one))
                yield from ((None, T.iri(i), T.iri(was), *_PLAIN) for i, was in page.origins.items())
                short = page.per_page and len(page.triples) + page.dropped < page.per_page
                url = page.next_url if page.ok and (page.triples or page.dropped) and not short else None


def open_source(spark: SparkSession, spec: object, config: Config | None = None) -> Source:
    """A Source as it is, a Dataset, a dictionary (type, location or url or path, format), or an
    address: with a prefix (fragments:, sparql:, dump:), a file's, or a fragments server's."""
    if isinstance(spec, Source):
        return spec
    if isinstance(spec, Dataset):
        return DatasetSource(spec, f"urn:dataset:{id(spec)}", config)
    form = None
    if isinstance(spec, dict):
        kind = str(spec.get("type", "")).lower()
        place = spec.get("location") or spec.get("url") or spec.get("path")
        form = spec.get("format")
    else:
        kind, place = "", str(spec)
        head = place.split(":", 1)[0].lower()
        if head in ("tpf", "qpf", "fragments", "sparql", "dump"):
            kind, place = head, place.split(":", 1)[1]
    if not place:
        raise ValueError(f"a source needs a location: {spec!r}")
    place = str(place).removeprefix("file://")
    if not kind:
        kind = "dump" if place.rsplit(".", 1)[-1].lower() in FORMATS or os.path.exists(place) else "fragments"
    if kind in ("dump", "file"):
        return DumpSource(spark, place, form, config)
    if kind == "sparql":
        return SparqlSource(spark, repaired(place), config)
    if kind in ("fragments", "tpf", "qpf"):
        return FragmentsSource(spark, repaired(place), config)
    raise ValueError(f"unknown type of source: {kind!r}")
