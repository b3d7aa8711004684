"""Sources of events: JSON documents and event lists, XML documents, text at hand, and streams.

All give rows of source_file, event_ord, event_json and namespaces (schema.EVENTS).
"""

from __future__ import annotations

import json
import sys
import urllib.request
from collections.abc import Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.canonical_tree import namespaces_of
from plumbline.schema import ELEMENTS, EPC_LISTS, EVENT_TYPES, EVENTS, UNNAMED


def from_text(spark: SparkSession, text: str, *, format: str = "json", name: str = "") -> DataFrame:
    """Events of one document at hand (standard input, a response)."""
    return explode(spark.createDataFrame([(name, text)], "source_file string, raw string"), format)


def from_url(spark: SparkSession, url: str, *, format: str | None = None) -> DataFrame:
    """Events of a document fetched by the driver."""
    with urllib.request.urlopen(url) as r:  # noqa: S310
        return from_text(spark, r.read().decode(), format=format or format_of(url), name=url)


def format_of(path: str) -> str:
    return "xml" if path.lower().endswith(".xml") else "json"


def of_content_type(content_type: str) -> str:
    return "xml" if any(x in content_type.lower() for x in ("application/xml", "text/xml")) else "json"


def from_stdin(spark: SparkSession, *, format: str = "json") -> DataFrame:
    """Events of one document from standard input, read by the driver."""
    return from_text(spark, sys.stdin.read(), format=format, name="-")


def read(spark: SparkSession, *paths: str, format: str | None = None, stream: bool = False, max_files: int = 100) -> DataFrame:
    """Events of files (globs allowed): each file whole, a JSON document or list of events, or an XML document.

    Without a format it goes by each file's name. One file is one task; put large volumes into JSON lines (read_lines).
    """
    if stream:
        df = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", max_files).load(*paths)
    else:
        df = spark.read.text(list(paths), wholetext=True)
    df = df.select(F.col("_metadata.file_path").alias("source_file"), F.col("value").alias("raw"))
    if format:
        return explode(df, format)
    xml = F.lower("source_file").endswith(".xml")
    return explode(df.filter(~xml), "json").unionByName(explode(df.filter(xml), "xml"))


def read_lines(spark: SparkSession, *paths: str, namespaces: dict[str, str] | None = None) -> DataFrame:
    """Events as JSON lines, split over as many tasks as the files allow."""
    ns = F.create_map(*[F.lit(x) for kv in (namespaces or {}).items() for x in kv]) if namespaces else F.expr("cast(map() as map<string,string>)")
    return spark.read.text(list(paths)).select(F.col("_metadata.file_path").alias("source_file"), F.lit(0).alias("event_ord"), F.col("value").alias("event_json"), ns.alias("namespaces"))


def explode(documents: DataFrame, format: str = "json", *, xml_exclude: tuple[str, ...] = ()) -> DataFrame:
    """source_file, raw to events. A JSON array is a list of events; an object with epcisBody a document; any other object an event.

    Raw text that is neither, or no XML, gives one row whose event_json is a JSON string that says so: hashing makes it a row with an
    error, and the other documents go on. In lists, the prefixes gs1 and cbvmda are known. xml_exclude: XML elements whose path holds
    one of these names, even as a part, are left out.
    """
    if format == "json":
        raw = F.trim("raw")
        body = F.get_json_object("raw", "$.epcisBody")
        lists = [F.get_json_object(body, p) for p in ("$.eventList", "$.queryResults.resultsBody.eventList")]
        one = F.when(raw.startswith("["), raw).when(body.isNotNull(), F.coalesce(*lists, F.lit("[]"))).when(raw.startswith("{"), F.concat(F.lit("["), raw, F.lit("]")))
        bad = F.array(F.lit(json.dumps("Expecting a JSON document or array of events")))
        # A single event's own @context is looked at with the event.
        context = F.when(raw.startswith("["), F.lit("[]")).otherwise(F.get_json_object("raw", "$['@context']"))
        named = documents.select("source_file", F.posexplode(F.coalesce(F.from_json(one, "array<string>"), bad)).alias("event_ord", "event_json"), context.alias("context"))
        return named.select("source_file", "event_ord", "event_json", _namespaces("context").alias("namespaces"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(name, i, json.dumps(e, ensure_ascii=False), ns) for name, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True) for i, (e, ns) in enumerate(_or_error(raw, xml_exclude))]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.string()), pa.array([list(r[3].items()) for r in rows], pa.map_(pa.string(), pa.string()))], EVENTS.names)

    return documents.select("source_file", "raw").mapInArrow(run, EVENTS)


def _or_error(raw: str | None, exclude: tuple[str, ...]) -> list[tuple[dict | str, dict[str, str]]]:
    try:
        return xml_events(raw or "", exclude)
    except ValueError as e:
        return [(str(e), {})]


def document_events(raw: str, format: str = "json") -> list[tuple[str, dict[str, str]]]:
    """(event_json, namespaces) of the events of one document, as explode has them."""
    if format == "xml":
        return [(json.dumps(e, ensure_ascii=False), ns) for e, ns in _or_error(raw, ())]
    try:
        doc = json.loads(raw, parse_float=_Raw)
    except ValueError:
        doc = None
    if not isinstance(doc, (dict, list)):
        return [(json.dumps("Expecting a JSON document or array of events"), {})]
    if isinstance(doc, list):
        return [(_dump(e), namespaces_of([])) for e in doc]
    ns = namespaces_of(doc["@context"]) if "@context" in doc else {}
    body = doc.get("epcisBody")
    if body is None:
        return [(_dump(doc), ns)]
    events = body.get("eventList") or body.get("queryResults", {}).get("resultsBody", {}).get("eventList") or []
    return [(_dump(e), ns) for e in events]


class _Raw(float):
    """A float that keeps its text."""

    def __new__(cls, text: str):
        self = super().__new__(cls, text)
        self.text = text
        return self

    def __repr__(self) -> str:
        return self.text


def _dump(x: object) -> str:
    """JSON with floats as they were written."""
    if isinstance(x, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{_dump(v)}" for k, v in x.items()) + "}"
    if isinstance(x, list):
        return "[" + ",".join(map(_dump, x)) + "]"
    return x.text if isinstance(x, _Raw) else json.dumps(x, ensure_ascii=False)


def _namespaces(context: str) -> F.Column:
    """namespaces_of as an expression: objects of the array (or the object itself) in turn, later prefixes over earlier ones."""
    raw = F.col(context)
    parts = F.when(raw.startswith("["), F.from_json(raw, "array<string>")).otherwise(F.array(raw))
    maps = F.transform(F.filter(parts, lambda x: x.startswith("{")), lambda x: F.from_json(x, "map<string,string>"))
    fixed = F.create_map(*[F.lit(x) for kv in namespaces_of([]).items() for x in kv])
    merged = F.aggregate(F.concat(maps, F.array(fixed)), F.expr("cast(map() as map<string,string>)"), lambda acc, m: F.map_concat(F.map_filter(acc, lambda k, _: ~F.map_contains_key(m, k)), m))
    return F.when(raw.isNotNull(), merged).otherwise(F.expr("cast(map() as map<string,string>)"))


class _Element:
    __slots__ = ("name", "attributes", "children", "text", "path")

    def __init__(self, name: str, attributes: dict[str, str], path: str):
        self.name, self.attributes, self.children, self.text, self.path = name, attributes, [], "", path


def xml_events(text: str, exclude: tuple[str, ...] = ()) -> list[tuple[dict, dict[str, str]]]:
    """Events of an XML document in the shape of their JSON form, each with the namespaces seen. Document types are refused.
    Elements of events whose path (names from the event on, joined by /) holds one of exclude are left out."""
    events: list[tuple[dict, dict[str, str]]] = []
    stack: list[_Element] = []
    namespaces = namespaces_of([])

    def start(name: str, attributes: dict[str, str]) -> None:
        if attributes:
            namespaces.update({k[6:]: v for k, v in attributes.items() if k.startswith("xmlns:")})
            attributes = {k: v for k, v in attributes.items() if not k.startswith(("xmlns", "xsi:")) and not v.startswith("xsd:")}
        if stack:
            stack.append(_Element(name, attributes, f"{stack[-1].path}/{name}" if exclude else ""))
        elif name in EVENT_TYPES:
            stack.append(_Element(name, attributes, name))

    def end(_: str) -> None:
        if stack:
            done = stack.pop()
            for x in exclude:
                if x in done.path:
                    return
            if stack:
                stack[-1].children.append(done)
            else:
                events.append(({"type": done.name, **_members(done)}, dict(namespaces)))

    def characters(data: str) -> None:
        if stack:
            stack[-1].text += data

    def refuse(*_: object) -> None:
        raise ValueError("document types are not allowed")

    parser = expat.ParserCreate()
    parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler, parser.StartDoctypeDeclHandler = start, end, characters, refuse
    try:
        parser.Parse(text.encode(), True)
    except expat.ExpatError as e:
        raise ValueError(f"not an XML document: {e}") from e
    return events


def _members(e: _Element) -> dict:
    """Children as fields; those of one name are an array. Attributes count on elements without children only."""
    out: dict = {}
    many: set[str] = set()
    for c in e.children:
        value = _xml_value(c)
        if value is None:
            continue
        if c.name in out:
            out[c.name] = [*(out[c.name] if c.name in many else [out[c.name]]), value]
            many.add(c.name)
        else:
            out[c.name] = value
    return out


def _xml_value(e: _Element) -> object:
    text = e.text.strip()
    if e.name in EPC_LISTS:
        return [x for c in e.children if (x := c.text.strip())]
    if e.name in ELEMENTS:
        return [x for c in e.children if (x := _xml_value(c))]
    if e.name in UNNAMED:
        return [{**c.attributes, c.name: c.text.strip()} for c in e.children]
    if e.children:
        return _members(e) or None
    if e.attributes:
        return {**e.attributes, **({"#text": text} if text else {})}
    return text or None
