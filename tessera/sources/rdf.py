"""RDF files as tables of quads: N-Triples, N-Quads, Turtle, TriG, N3, RDF/XML and JSON-LD.

Line formats are split and parsed by Spark's own expressions (lines with numeric escapes excepted);
the others are read a file at a time, on the executors. Reading is lenient: a statement that can't
be read costs only itself, IRIs with forbidden characters are repaired, and both are counted.
"""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import terms as T
from tessera.plans.algebra import Triple, Var
from tessera.plans.parser import Parser, QueryError, unescape

FORMATS = {"ttl": "turtle", "turtle": "turtle", "nt": "ntriples", "ntriples": "ntriples", "n-triples": "ntriples", "nq": "nquads", "nquads": "nquads", "n-quads": "nquads", "trig": "trig", "n3": "turtle", "rdf": "rdfxml", "xml": "rdfxml", "owl": "rdfxml", "rdfxml": "rdfxml", "jsonld": "jsonld", "json": "jsonld"}
MEDIA = {"application/trig": "trig", "application/n-quads": "nquads", "text/turtle": "turtle", "application/n-triples": "ntriples", "application/rdf+xml": "rdfxml", "application/ld+json": "jsonld", "text/n3": "turtle"}
SCHEMA = "s string, p string, o string, g string"

_FORBIDDEN = re.compile('[\x00-\x20<>"{}|^`\\\\\x7f-\x9f]')
Quad = tuple[str, str, str, str | None]


def repaired(iri: str, origins: dict[str, str] | None = None) -> str:
    """The IRI with forbidden characters percent-encoded; origins remembers how it was spelled."""
    out = _FORBIDDEN.sub(lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), iri)
    if origins is not None and out != iri:
        origins[out] = iri
    return out


def format_of(path: str, given: str | None = None) -> str:
    name = (given or path.rstrip("/").rsplit(".", 1)[-1]).lower()
    if name not in FORMATS:
        raise ValueError(f"unknown RDF format {name!r}")
    return FORMATS[name]


# --- line formats -----------------------------------------------------------------------------

_LINE = r'^\s*(<[^>]*>|_:\S+)\s+(<[^>]*>)\s+(<[^>]*>|_:\S+|"(?:[^"\\]|\\.)*+"(?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?)\s*(<[^>]*>|_:\S+)?\s*\.\s*(?:#.*)?$'
_PY_LINE = re.compile(_LINE)


def _term(token: str, origins: dict[str, str] | None = None) -> str:
    if token.startswith("<"):
        return T.iri(repaired(unescape(token[1:-1]), origins))
    if token.startswith("_:"):
        return token.rstrip(".")
    end = token.rindex('"')
    lexical, tail = unescape(token[1:end]), token[end + 1 :]
    if tail.startswith("@"):
        return T.literal(lexical, lang=tail[1:])
    return T.literal(lexical, repaired(unescape(tail[3:-1])) if tail else None)


def line(text: str, origins: dict[str, str] | None = None) -> Quad | None:
    """The quad of one line; None if there is none, or it can't be read."""
    m = _PY_LINE.match(text)
    return (*(_term(m[i], origins) for i in (1, 2, 3)), _term(m[4], origins) if m[4] else None) if m else None  # type: ignore[return-value]


def _columns(value: Column) -> list[Column]:
    """line() by Spark's expressions, for lines without numeric escapes."""
    parts = [F.regexp_extract(value, _LINE, i) for i in range(1, 5)]

    def iri(x: Column) -> Column:
        inner = F.substring(x, F.lit(2), F.length(x) - 2)
        for c in [*map(chr, range(33)), *'"{}|^`\\', *map(chr, range(0x7F, 0xA0))]:
            inner = F.replace(inner, F.lit(c), F.lit(repaired(c)))
        odd = x.rlike(r'[\x{00}-\x{20}"{}|^`\\\x{7f}-\x{9f}]')
        return F.when(odd, F.concat(F.lit("<"), inner, F.lit(">"))).otherwise(x)

    def literal(x: Column) -> Column:
        lex = T.lexical(x)
        hold = "\x00"  # stands for a backslash meanwhile; it can't be in a line
        made = F.replace(lex, F.lit("\\\\"), F.lit(hold))
        for shown, raw in (('\\"', '"'), ("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ("\\b", "\b"), ("\\f", "\f"), ("\\'", "'")):
            made = F.replace(made, F.lit(shown), F.lit(raw))
        lex = F.when(lex.contains("\\"), F.replace(made, F.lit(hold), F.lit("\\"))).otherwise(lex)
        tail = T.suffix(x)
        tail = F.when(tail.startswith("@"), F.lower(tail)).when(tail == f"^^<{T.XSD}string>", "").otherwise(tail)
        return F.concat(F.lit('"'), lex, F.lit('"'), tail)

    node = lambda x: F.when(x.startswith("<"), iri(x)).when(x.startswith("_:"), F.regexp_replace(x, r"\.+$", "")).when(x.startswith('"'), literal(x))
    return [node(x) for x in parts]


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(s, p, o, g, dropped) of N-Triples or N-Quads files of any size; dropped: the line held a
    statement that couldn't be read (its terms are then null)."""
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(?:#.*)?$"))
    plain = lines.where(~F.col("value").rlike(r"\\[uU]")).select(*[c.alias(n) for c, n in zip(_columns(F.col("value")), "spog", strict=True)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [line(v) or (None,) * 4 for v in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([q[i] for q in found], pa.string()) for i in range(4)], names=list("spog"))

    escaped = lines.where(F.col("value").rlike(r"\\[uU]")).mapInArrow(work, SCHEMA)
    return plain.union(escaped).withColumn("dropped", F.col("s").isNull())


# --- Turtle and TriG --------------------------------------------------------------------------


class _Document(Parser):
    """Turtle and TriG by the query parser's grammar of terms and triples."""

    def __init__(self, text: str, base: str, scope: str, origins: dict[str, str] | None = None):
        text = re.sub(r"<([^<>\n]*)>", lambda m: f"<{repaired(unescape(m[1]), origins)}>", text)
        super().__init__(text)
        self.base, self.scope = base, scope

    def anonymous(self) -> Var:  # a blank node, not a variable
        return f"_:{self.scope}b{next(self.fresh)}"  # type: ignore[return-value]

    def term(self) -> str:
        if self.peek()[0] == "var":
            raise QueryError("a variable in data")
        if self.peek()[0] == "bnode":
            return f"_:{self.scope}{self.next()[1][2:]}"
        return super().term()

    def directive(self) -> bool:
        kind, text = self.peek()
        if kind == "lang" and text.lower() in ("@prefix", "@base"):
            word = text[1:].lower()
            dotted = True
        elif self.is_word("PREFIX", "BASE"):
            word, dotted = text.lower(), False
        else:
            return False
        self.at += 1
        if word == "prefix":
            name = self.next()[1][:-1]
            self.prefixes[name] = self.resolve(unescape(self.next()[1][1:-1]))
        else:
            self.base = self.resolve(unescape(self.next()[1][1:-1]))
        if dotted:
            self.need(".")
        return True

    def block(self, graph: str | None) -> list[Quad]:
        out: list[Triple] = []
        node = self.node(out)
        if not (out and self.is_op(".", "}")):
            self.properties(node, out)
        return [(t.s, t.p, t.o, graph) for t in out]  # type: ignore[misc]

    def quads(self) -> list[Quad]:
        out: list[Quad] = []
        while self.peek()[0] != "end":
            if self.directive():
                continue
            named = self.word("GRAPH")
            start = self.at
            graph: str | None = None
            if not self.is_op("{"):
                if self.op("[") and self.op("]"):
                    graph = self.anonymous()
                elif self.peek()[0] in ("iri", "pname", "bnode"):
                    self.at = start
                    graph = self.term()
                if not self.is_op("{"):
                    if named:
                        raise QueryError("a graph expected")
                    self.at = start
                    out += self.block(None)
                    self.need(".")
                    continue
            self.need("{")
            while not self.op("}"):
                out += self.block(graph)
                if not self.op(".") and not self.is_op("}"):
                    raise QueryError("'.' expected")
        return out


def turtle(text: str, base: str = "", scope: str = "", origins: dict[str, str] | None = None) -> list[Quad]:
    return _Document(text, base, scope, origins).quads()


# --- RDF/XML ----------------------------------------------------------------------------------

_XML = "{http://www.w3.org/XML/1998/namespace}"
_R = "{" + T.RDF + "}"


def rdfxml(text: str, base: str = "", scope: str = "") -> list[Quad]:
    """RDF/XML: node and property elements, attributes, typed nodes, parseType Resource,
    Collection and Literal, li."""
    out: list[Quad] = []
    count = iter(range(1 << 60))
    name = lambda tag: T.iri(tag[1:].replace("}", "", 1))
    fresh = lambda: f"_:{scope}x{next(count)}"

    def resolve(ref: str, at: str) -> str:
        return T.iri(repaired(urljoin(at, ref) if at else ref))

    def node(e: ET.Element, at: str, lang: str | None) -> str:
        at, lang = e.get(_XML + "base", at), e.get(_XML + "lang", lang)
        if _R + "about" in e.attrib:
            s = resolve(e.attrib[_R + "about"], at)
        elif _R + "ID" in e.attrib:
            s = resolve("#" + e.attrib[_R + "ID"], at)
        else:
            s = f"_:{scope}{e.attrib[_R + 'nodeID']}" if _R + "nodeID" in e.attrib else fresh()
        if e.tag != _R + "Description":
            out.append((s, T.TYPE, name(e.tag), None))
        attributes(s, e, at, lang)
        members(s, e, at, lang)
        return s

    def attributes(s: str, e: ET.Element, at: str, lang: str | None) -> None:
        for k, v in e.attrib.items():
            if k == _R + "type":
                out.append((s, T.TYPE, resolve(v, at), None))
            elif k.startswith("{") and not k.startswith((_R, _XML)):
                out.append((s, name(k), T.literal(v, lang=lang), None))

    def members(s: str, e: ET.Element, at: str, lang: str | None) -> None:
        li = 0
        for m in e:
            if m.tag == _R + "li":
                li += 1
            member(s, f"<{T.RDF}_{li}>" if m.tag == _R + "li" else name(m.tag), m, at, lang)

    def member(s: str, p: str, e: ET.Element, at: str, lang: str | None) -> None:
        at, lang = e.get(_XML + "base", at), e.get(_XML + "lang", lang)
        kind = e.get(_R + "parseType")
        if kind == "Resource":
            o = fresh()
            members(o, e, at, lang)
        elif kind == "Collection":
            cells = [(fresh(), node(x, at, lang)) for x in e]
            for (c, item), (rest, _) in zip(cells, [*cells[1:], (f"<{T.RDF}nil>", "")], strict=True):
                out.extend([(c, f"<{T.RDF}first>", item, None), (c, f"<{T.RDF}rest>", rest, None)])
            o = cells[0][0] if cells else f"<{T.RDF}nil>"
        elif kind:
            o = T.literal((e.text or "") + "".join(ET.tostring(x, encoding="unicode") for x in e), T.RDF + "XMLLiteral")
        elif _R + "resource" in e.attrib or _R + "nodeID" in e.attrib:
            o = resolve(e.attrib[_R + "resource"], at) if _R + "resource" in e.attrib else f"_:{scope}{e.attrib[_R + 'nodeID']}"
            attributes(o, e, at, lang)
        elif len(e):
            o = node(e[0], at, lang)
        elif any(k.startswith("{") and not k.startswith((_R, _XML)) for k in e.attrib):
            o = fresh()
            attributes(o, e, at, lang)
        else:
            datatype = e.get(_R + "datatype")
            o = T.literal(e.text or "", urljoin(at, datatype) if datatype else None, None if datatype else lang)
        out.append((s, p, o, None))

    root = ET.fromstring(text)
    start, lang = root.get(_XML + "base", base), root.get(_XML + "lang")
    for e in root if root.tag == _R + "RDF" else [root]:
        node(e, start, lang)
    return out


# --- JSON-LD ----------------------------------------------------------------------------------


def jsonld(text: str, base: str = "", scope: str = "") -> list[Quad]:
    """A subset: inline contexts (terms, prefixes, @vocab, @base, @language, @type coercion), @id,
    @type, @value, @language, @list, @set, @reverse and @graph. Remote contexts are not fetched."""
    out: list[Quad] = []
    count = iter(range(1 << 60))

    def extended(ctx: dict, new: object) -> dict:
        ctx = dict(ctx)
        for part in new if isinstance(new, list) else [new]:
            if isinstance(part, dict):
                ctx.update(part)
        return ctx

    def expand(value: str, ctx: dict, vocab: bool) -> str | None:
        if value.startswith("@"):
            return value
        if vocab and value in ctx:
            d = ctx[value]
            d = d.get("@id", value) if isinstance(d, dict) else d
            return d if d is None or d == value else expand(d, ctx, True)
        if value.startswith("_:"):
            return f"_:{scope}{value[2:]}"
        prefix, colon, rest = value.partition(":")
        if colon:
            d = ctx.get(prefix)
            d = d.get("@id") if isinstance(d, dict) else d
            return value if rest.startswith("//") or not isinstance(d, str) else (expand(d, ctx, True) or "") + rest
        if vocab:
            return ctx["@vocab"] + value if ctx.get("@vocab") else None
        at = ctx.get("@base", base)
        return urljoin(at, value) if at else value

    def term(i: str) -> str:
        return i if i.startswith("_:") else T.iri(repaired(i))

    def fresh() -> str:
        return f"_:{scope}j{next(count)}"

    def value(v: object, ctx: dict, how: dict, g: str | None) -> str | None:
        if isinstance(v, dict):
            if "@value" in v:
                x, kind, lang = v["@value"], v.get("@type"), v.get("@language")
                return scalar(x, expand(kind, ctx, True) if kind else None, lang)
            if "@list" in v:
                return listed(v["@list"], ctx, how, g)
            return node(v, ctx, g)
        kind = how.get("@type")
        if kind in ("@id", "@vocab") and isinstance(v, str):
            i = expand(v, ctx, kind == "@vocab")
            return term(i) if i else None
        return scalar(v, expand(kind, ctx, True) if kind else None, how.get("@language", ctx.get("@language")) if isinstance(v, str) and not kind else None)

    def scalar(x: object, kind: str | None, lang: str | None) -> str | None:
        if x is None:
            return None
        if isinstance(x, bool):
            return T.literal(str(x).lower(), kind or T.XSD + "boolean")
        if isinstance(x, int) or isinstance(x, float) and x == int(x) and abs(x) < 1e21:
            return T.literal(str(int(x)), kind or T.XSD + "integer")
        if isinstance(x, float):
            return T.literal(repr(x), kind or T.XSD + "double")
        return T.literal(str(x), kind, lang)

    def listed(items: object, ctx: dict, how: dict, g: str | None) -> str:
        items = items if isinstance(items, list) else [items]
        made = [v for v in (value(x, ctx, how, g) for x in items) if v is not None]
        cells = [fresh() for _ in made] + [f"<{T.RDF}nil>"]
        for c, item, rest in zip(cells, made, cells[1:]):
            out.extend([(c, f"<{T.RDF}first>", item, g), (c, f"<{T.RDF}rest>", rest, g)])
        return cells[0]

    def node(n: dict, ctx: dict, g: str | None) -> str:
        ctx = extended(ctx, n["@context"]) if "@context" in n else ctx
        key = lambda k: expand(k, ctx, True)
        own = next((v for k, v in n.items() if key(k) == "@id"), None)
        s = term(expand(own, ctx, False) or "") if isinstance(own, str) else fresh()
        for k, v in n.items():
            p = key(k)
            items = v if isinstance(v, list) else [v]
            if p is None or p in ("@id", "@context"):
                continue
            if p == "@type":
                out.extend((s, T.TYPE, term(i), g) for i in (expand(x, ctx, True) for x in items) if i)
            elif p == "@graph":
                for x in items:
                    node(x, ctx, s if own or len(n) > 2 or "@context" not in n and len(n) > 1 else g)
            elif p == "@reverse":
                for q, xs in v.items():
                    for x in xs if isinstance(xs, list) else [xs]:
                        o, name = value(x, ctx, {"@type": "@id"}, g), expand(q, ctx, True)
                        if o and name:
                            out.append((o, T.iri(name), s, g))
            elif not p.startswith("@") and ":" in p:
                how = ctx[k] if isinstance(ctx.get(k), dict) else {}
                if how.get("@container") == "@list":
                    out.append((s, T.iri(repaired(p)), listed(items, ctx, how, g), g))
                    continue
                for x in items:
                    for y in x["@set"] if isinstance(x, dict) and "@set" in x else [x]:
                        if (o := value(y, ctx, how, g)) is not None:
                            out.append((s, T.iri(repaired(p)), o, g))
        return s

    data = json.loads(text)
    for n in data if isinstance(data, list) else [data]:
        node(n, {}, None)
    return out


# --- whole documents --------------------------------------------------------------------------


@dataclass
class Parsed:
    """origins: how repaired IRIs were spelled."""

    quads: list[Quad] = field(default_factory=list)
    dropped: int = 0
    origins: dict[str, str] = field(default_factory=dict)


def parse_document(text: str, form: str, base: str = "", scope: str = "") -> Parsed:
    """All statements of a document; if it can't be read as a whole, those that can be read line
    by line or statement by statement. ValueError if there are none."""
    out = Parsed()
    if form in ("ntriples", "nquads"):
        for x in text.split("\n"):
            if x.strip() and not x.lstrip().startswith("#"):
                quad = line(x, out.origins)
                out.quads += [quad] if quad else []
                out.dropped += quad is None
        return out
    try:
        if form in ("turtle", "trig"):
            out.quads = turtle(text, base, scope, out.origins)
        else:
            out.quads = {"rdfxml": rdfxml, "jsonld": jsonld}[form](text, base, scope)
        return out
    except (QueryError, ValueError, ET.ParseError, IndexError) as error:
        if form in ("turtle", "trig"):
            out = Parsed()
            head = "\n".join(re.findall(r"(?im)^\s*@?(?:prefix|base)\b.*$", text))
            for part in re.split(r"(?<=\.)\s*\n", text):
                if not part.strip() or re.fullmatch(r"(?is)(\s*@?(?:prefix|base)\b[^\n]*\n?)*", part):
                    continue
                try:
                    out.quads += turtle(head + "\n" + part, base, scope, out.origins)
                except (QueryError, IndexError):
                    out.dropped += 1
            if out.quads:
                return out
        raise ValueError(f"no statement of this {form} document can be read: {error}") from error


COUNTED = SCHEMA + ", dropped int"


def _counted(quads: list[Quad], dropped: int) -> Iterator[pa.RecordBatch]:
    """Batches of COUNTED: the quads, and a row without terms if statements were dropped."""
    rows = [(*q, 0) for q in quads] + ([(None, None, None, None, dropped)] if dropped else [])
    types = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int32())
    for at in range(0, len(rows), 20_000):
        part = rows[at : at + 20_000]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in part], t) for i, t in enumerate(types)], names=["s", "p", "o", "g", "dropped"])


def _downloaded(spark: SparkSession, url: str, form: str, base: str, timeout: float) -> DataFrame:
    """A document at an address, read by a task: line formats as they come in, others whole."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import urllib.request

        for _ in batches:
            with urllib.request.urlopen(urllib.request.Request(url, headers={"Accept": "*/*"}), timeout=timeout) as r:
                if form not in ("ntriples", "nquads"):
                    yield from _document(r.read(), form, base or url, url)
                    return
                held = []
                for raw in r:
                    held.append(raw.decode("utf-8", "replace").rstrip("\r\n"))
                    if len(held) >= 20_000:
                        found = parse_document("\n".join(held), form)
                        yield from _counted(found.quads, found.dropped)
                        held = []
                found = parse_document("\n".join(held), form)
                yield from _counted(found.quads, found.dropped)

    return spark.range(1, numPartitions=1).mapInArrow(work, COUNTED)


def _document(content: bytes, form: str, base: str, name: str) -> Iterator[pa.RecordBatch]:
    """A document's quads; one that can't be read at all is a dropped statement."""
    import zlib

    try:
        found = parse_document(content.decode("utf-8", "replace"), form, base, f"f{zlib.crc32(name.encode()):08x}")
    except ValueError:
        found = Parsed(dropped=1)
    yield from _counted(found.quads, found.dropped)


def read_counted(spark: SparkSession, path: str, form: str | None = None, base: str = "", timeout: float = 60.0) -> DataFrame:
    """A file, folder or http(s) address as COUNTED (s, p, o, g, dropped): rows without terms tell
    how many statements couldn't be read. Blank nodes are kept apart by file."""
    form = format_of(path, form)
    if path.startswith(("http://", "https://")):
        return _downloaded(spark, path, form, base, timeout)
    if form in ("ntriples", "nquads"):
        return read_lines(spark, path).withColumn("dropped", F.col("dropped").cast("int"))
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                yield from _document(content, form, base or name, name)

    return files.mapInArrow(work, COUNTED)


def read_rdf(spark: SparkSession, path: str, form: str | None = None, base: str = "") -> DataFrame:
    """What can be read of a file, folder or address as quads (s, p, o, g)."""
    return read_counted(spark, path, form, base).where("s is not null").drop("dropped")


# --- writers ----------------------------------------------------------------------------------


def as_lines(quads: DataFrame) -> DataFrame:
    """(value) an N-Quads line for each quad."""
    graph = F.when(F.col("g").isNotNull(), F.concat(F.lit(" "), T.nt_column(F.col("g")))).otherwise("")
    parts = [T.nt_column(F.col(c)) for c in "spo"]
    return quads.select(F.concat(parts[0], F.lit(" "), parts[1], F.lit(" "), parts[2], graph, F.lit(" .")).alias("value"))


def write_nquads(quads: DataFrame, path: str) -> None:
    as_lines(quads).write.text(path)


def write_trig(quads: DataFrame, path: str) -> None:
    """TriG, a graph's triples wrapped line by line, so that no graph has to fit in a task."""
    graph = F.when(F.col("g").isNotNull(), F.concat(T.nt_column(F.col("g")), F.lit(" "))).otherwise("")
    parts = [T.nt_column(F.col(c)) for c in "spo"]
    quads.select(F.concat(graph, F.lit("{ "), parts[0], F.lit(" "), parts[1], F.lit(" "), parts[2], F.lit(" . }")).alias("value")).write.text(path)
