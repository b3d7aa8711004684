import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from plumbline.functions import hashing
from plumbline.functions.identifiers import digital_link, digital_link_column, short_names
from plumbline.functions.values import instant, java_double, number, number_column
from plumbline.operators import canonical, store
from plumbline.operators.canonical_tree import prehash
from plumbline.plans.hashing import hash_events, hash_one
from plumbline.schema import ALGORITHMS, EVENTS, EXCLUDED, Options
from plumbline.sources import documents

# The events of published examples, whose digests are known.
SENSOR = {
    "type": "ObjectEvent", "eventTime": "2021-05-27T14:00:00+01:00", "eventTimeZoneOffset": "+01:00", "epcList": ["https://id.gs1.org/8003/030013450007718765"], "action": "OBSERVE",
    "bizStep": "sensor_reporting", "readPoint": {"id": "urn:epc:id:sgln:4012345.00005.0"},
    "sensorElementList": [{"sensorMetadata": {"time": "2021-05-27T13:50:00+01:00"}, "sensorReport": [
        {"type": "gs1:Length", "value": 2477583.57, "component": "cbv:Comp-easting", "uom": "MTR", "coordinateReferenceSystem": "http://www.opengis.net/def/crs/EPSG/0/27700"},
        {"type": "Length", "value": -477979.89, "component": "cbv:Comp-northing", "uom": "MTR", "coordinateReferenceSystem": "http://www.opengis.net/def/crs/EPSG/0/27700"}]}],
}
AGGREGATION = {
    "type": "AggregationEvent", "eventTime": "2020-06-08T18:11:16Z", "eventTimeZoneOffset": "+02:00", "parentID": "https://id.gs1.org/01/19520010123455/21/22222223333",
    "childEPCs": ["https://id.gs1.org/01/09520001123467/21/10000001001"], "action": "DELETE", "bizStep": "unpacking", "disposition": "in_progress",
    "persistentDisposition": {"set": ["completeness_verified"], "unset": ["completeness_inferred"]}, "readPoint": {"id": "https://id.gs1.org/414/9529999999993"}, "bizLocation": {"id": "https://id.gs1.org/414/9529999999993"},
}
# Our own.
PLAIN = {
    "type": "ObjectEvent", "eventTime": "2019-04-02T15:00:00.12+01:00", "eventTimeZoneOffset": "+01:00", "epcList": ["urn:epc:id:sgtin:4012345.011111.9876", "urn:epc:id:sscc:4012345.0111111111"],
    "action": "OBSERVE", "bizStep": "inspecting", "disposition": "urn:epcglobal:cbv:disp:active", "readPoint": {"id": "urn:epc:id:sgln:4012345.00005.12"},
    "quantityList": [{"epcClass": "urn:epc:class:lgtin:4023333.055555.ABC123", "quantity": 25.0, "uom": "KGM"}, {"epcClass": "urn:epc:idpat:sgtin:4023333.055555.*", "quantity": 7}],
    "bizTransactionList": [{"type": "po", "bizTransaction": "urn:epcglobal:cbv:bt:0614141073467:1152"}, {"bizTransaction": "x"}], "sourceList": [{"type": "owning_party", "source": "urn:epc:id:pgln:4023333.00000"}],
    "parentID": "urn:epc:id:grai:4012345.55555.1", "eventID": "x",
}
EXTENDED = {**PLAIN, "ex:b": {"ex:y": 1, "ex:x": "007"}, "ex:a": [3, 1], "readPoint": {"id": "urn:epc:id:sgln:4012345.00005.0", "ex:k": "v"}, "ilmd": {"cbvmda:lotNumber": "L"}, "@context": [{"ex": "https://ex.example/"}]}


def frame(spark, *events):
    return spark.createDataFrame([("", i, e if isinstance(e, str) else json.dumps(e), {}) for i, e in enumerate(events)], EVENTS)


def flat(event, **more):
    return prehash(json.dumps(event), more.pop("ns", {}), EXCLUDED, **more).replace("\n", "")


@pytest.mark.parametrize(("event", "digest"), [(SENSOR, "a8eb4ec50f76d2d5dd7bf64e86d0b4210315c8feaf3114ef9ccd6d7372e4473e"), (AGGREGATION, "2615bc5627c3b3611e3df868aca2312882370ee78af44bcc20433ec028ebfc99")])
def test_published_hashes(event, digest):
    assert hashlib.sha256(flat(event).encode()).hexdigest() == digest


def test_native_path_equals_tree(spark):
    df = frame(spark, PLAIN, SENSOR, AGGREGATION, EXTENDED, {"type": "ObjectEvent", "eventTime": "2019-04-02T15:00:00Z", "epcList": []}, {"type": "ObjectEvent", "eventTime": "bad"}, "bogus", {"type": "EPCISDocument"})
    plain = canonical.parsed(df).select(canonical.is_plain(Options()))
    assert [r[0] for r in plain.collect()] == [True, False, False, False, True, False, False, False]
    one, two = (f(df).orderBy("event_ord").select("prehash", "error").collect() for f in (canonical.prehash, canonical.by_tree))
    assert one == two
    assert one[5].error and one[6].error and one[7].prehash == ""
    assert hash_events(df).count() == 7


def test_order_does_not_matter_and_values_do():
    rng = random.Random(3)

    def shuffled(x):
        if isinstance(x, dict):
            items = [(k, shuffled(v)) for k, v in x.items()]
            rng.shuffle(items)
            return dict(items)
        if isinstance(x, list):
            x = [shuffled(y) for y in x]
            rng.shuffle(x)
        return x

    for event in (SENSOR, AGGREGATION, PLAIN, EXTENDED):
        for version in ("2.0", "2.1"):
            want = flat(event, version=version)
            assert all(flat(shuffled(event), version=version) == want for _ in range(5))
    assert flat({**PLAIN, "eventID": "other", "recordTime": "x"}) == flat(PLAIN)
    assert flat({**PLAIN, "action": "ADD"}) != flat(PLAIN)


def test_extensions():
    text = flat(EXTENDED)
    assert text.endswith("readPoint{https://ex.example/}k=v{https://ex.example/}a=1{https://ex.example/}a=3{https://ex.example/}b{https://ex.example/}x=7{https://ex.example/}y=1")
    assert "ilmd{urn:epcglobal:cbv:mda}lotNumber=L" in text
    assert "readPointid=https://id.gs1.org/414/4012345000054{https://ex.example/}k=v" in flat(EXTENDED, version="2.1")
    assert flat({"type": "ObjectEvent", "x": None, "y": ""}) == "eventType=ObjectEventx=nully"


def test_xml_equals_json(spark):
    xml = """<e:EPCISDocument xmlns:e="urn:epcglobal:epcis:xsd:2" xmlns:ex="https://ex.example/"><EPCISBody><EventList><ObjectEvent><eventTime>2019-04-02T14:00:00.120Z</eventTime>
      <eventTimeZoneOffset>+01:00</eventTimeZoneOffset><epcList><epc>urn:epc:id:sgtin:4012345.011111.9876</epc></epcList><action>OBSERVE</action><bizStep>urn:epcglobal:cbv:bizstep:inspecting</bizStep>
      <readPoint><id>urn:epc:id:sgln:4012345.00005.0</id></readPoint><bizTransactionList><bizTransaction type="urn:epcglobal:cbv:btt:po">x</bizTransaction></bizTransactionList>
      <quantityList><quantityElement><epcClass>urn:epc:idpat:sgtin:4023333.055555.*</epcClass><quantity>7.0</quantity></quantityElement></quantityList>
      <sensorElementList><sensorElement><sensorMetadata time="2019-04-02T14:05:00Z"/><sensorReport type="gs1:Temperature" value="26.0" uom="CEL"/></sensorElement></sensorElementList>
      <ex:a><ex:b>1</ex:b></ex:a></ObjectEvent></EventList></EPCISBody></e:EPCISDocument>"""
    event = {
        "type": "ObjectEvent", "eventTime": "2019-04-02T15:00:00.12+01:00", "eventTimeZoneOffset": "+01:00", "epcList": ["urn:epc:id:sgtin:4012345.011111.9876"], "action": "OBSERVE", "bizStep": "inspecting",
        "readPoint": {"id": "urn:epc:id:sgln:4012345.00005.0"}, "bizTransactionList": [{"type": "po", "bizTransaction": "x"}], "quantityList": [{"epcClass": "urn:epc:idpat:sgtin:4023333.055555.*", "quantity": 7}],
        "sensorElementList": [{"sensorMetadata": {"time": "2019-04-02T14:05:00Z"}, "sensorReport": [{"type": "Temperature", "value": 26, "uom": "CEL"}]}], "ex:a": {"ex:b": 1},
    }
    doc = json.dumps({"@context": ["https://ref.gs1.org/standards/epcis/epcis-context.jsonld", {"ex": "https://ex.example/"}], "type": "EPCISDocument", "epcisBody": {"eventList": [event]}})
    a, b = documents.from_text(spark, xml, format="xml"), documents.from_text(spark, doc)
    one, two = hash_events(a).select("`sha-256`"), hash_events(b).select("`sha-256`")
    assert one.count() == 1 and store.equivalent(one, two, "sha-256").isEmpty()
    with pytest.raises(Exception, match="document types"):
        documents.xml_events("<!DOCTYPE x><x/>")
    assert documents.from_text(spark, json.dumps([PLAIN, SENSOR])).count() == 2


def test_bad_documents(spark):
    """Bad documents give rows with errors; with failfast, hashing raises."""
    docs = spark.createDataFrame([("a", "bogus-data"), ("b", json.dumps(PLAIN)), ("c", "[1"), ("d", "{" * 20_000)], "source_file string, raw string")
    rows = {r.source_file: r for r in hash_events(documents.explode(docs)).collect()}
    assert "JSON document" in rows["a"].error and "JSON document" in rows["c"].error and rows["d"].error and rows["b"].error is None
    xml = spark.createDataFrame([("a", "<x"), ("b", None), ("c", "<!DOCTYPE x><x/>"), ("d", "<ObjectEvent><eventTime>2019-04-02T15:00:00Z</eventTime></ObjectEvent>")], "source_file string, raw string")
    rows = {r.source_file: r.error for r in hash_events(documents.explode(xml, "xml")).collect()}
    assert "XML" in rows["a"] and "XML" in rows["b"] and "document types" in rows["c"] and rows["d"] is None
    with pytest.raises(Exception, match="during event hash generation"):
        hash_events(documents.explode(docs), Options(failfast=True)).collect()
    deep = frame(spark, '{"type":"ObjectEvent","x":' + "[" * 20_000 + "]" * 20_000 + "}", PLAIN)
    assert [r.error is None for r in canonical.prehash(deep).orderBy("event_ord").collect()] == [False, True]


def test_files(spark, tmp_path):
    """Documents of many lines, by glob: JSON (a document, a query document, a list, one event) and XML."""
    doc = {"@context": [{"ex": "https://ex.example/"}], "type": "EPCISDocument", "epcisBody": {"eventList": [{**PLAIN, "ex:a": 1}, SENSOR]}}
    query = {"type": "EPCISQueryDocument", "epcisBody": {"queryResults": {"resultsBody": {"eventList": [PLAIN]}}}}
    for name, x in {"doc": doc, "query": query, "list": [PLAIN, {**PLAIN, "ilmd": {"cbvmda:lotNumber": "L"}}], "one": PLAIN}.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(x, indent=2))
    (tmp_path / "x.xml").write_text("<d xmlns:ex='https://ex.example/'>\n<ObjectEvent>\n<eventTime>2019-04-02T15:00:00Z</eventTime>\n<ex:a>1</ex:a>\n<ex:reasonCode>2</ex:reasonCode></ObjectEvent>\n</d>")
    rows = hash_events(documents.read(spark, f"{tmp_path}/*.json", f"{tmp_path}/*.xml"), Options(("prehash", "sha-256"))).collect()
    by = {}
    for r in rows:
        assert r.error is None
        by.setdefault(r.source_file.rsplit("/", 1)[1], []).append(r.prehash)
    assert {k: len(v) for k, v in by.items()} == {"doc.json": 2, "query.json": 1, "list.json": 2, "one.json": 1, "x.xml": 1}
    assert by["query.json"] == by["one.json"] == [flat(PLAIN)] and by["list.json"][1].endswith("ilmd{urn:epcglobal:cbv:mda}lotNumber=L")
    assert by["x.xml"] == ["eventType=ObjectEventeventTime=2019-04-02T15:00:00.000Z{https://ex.example/}a=1{https://ex.example/}reasonCode=2"]
    whole = documents.explode(spark.read.text(f"{tmp_path}/x.xml", wholetext=True).selectExpr("'' AS source_file", "value AS raw"), "xml", xml_exclude=tuple(EXCLUDED))
    assert hash_events(whole, Options(("prehash",))).first().prehash == "eventType=ObjectEventeventTime=2019-04-02T15:00:00.000Z{https://ex.example/}a=1"


def test_time_zones(spark):
    """The session's time zone changes no hash, on either path."""
    df, found = frame(spark, PLAIN, {**PLAIN, "eventTime": "2024-03-31T01:30:00.9999Z"}, {**PLAIN, "eventTime": "1969-12-31T23:59:59.5-11:30"}), []
    for zone in ("UTC", "America/New_York", "Europe/Berlin"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        found += [[r[0] for r in f(df).orderBy("event_ord").select("prehash").collect()] for f in (canonical.prehash, canonical.by_tree)]
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert all(x == found[0] for x in found) and "eventTime=2019-04-02T14:00:00.120Z" in found[0][0]


def test_plan(spark, tmp_path):
    """One scan, and each event parsed twice, whatever is asked for."""
    frame(spark, PLAIN).write.parquet(str(tmp_path / "e"))
    plan = hash_events(spark.read.parquet(str(tmp_path / "e")), Options(("prehash", "sha-256", "md5")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("from_json") == 2


def test_sql_functions(spark):
    from plumbline.plans.hashing import register

    register(spark)
    frame(spark, PLAIN, EXTENDED, "bogus").createOrReplaceTempView("own_events")
    want = [{x: r[x] for x in ALGORITHMS} for r in hash_events(frame(spark, PLAIN, EXTENDED), Options(tuple(ALGORITHMS))).orderBy("event_ord").collect()]
    columns = ", ".join(f"event_hash(event_json, namespaces, '{x}', '2.0') AS `{x}`" for x in ALGORITHMS)
    got = spark.sql(f"SELECT event_prehash(event_json, namespaces, '2.0') AS p, {columns}, event_hash(event_json, NULL, 'rsa', '2.1') AS other FROM own_events ORDER BY event_ord").collect()
    assert [{x: r[x] for x in ALGORITHMS} for r in got[:2]] == want and [r.p for r in got] == [flat(PLAIN), flat(EXTENDED), None]
    assert got[0].other.startswith("ni:///sha-256;") and got[0].other.endswith("?ver=CBV2.1") and got[2]["sha-256"] is None
    doc = json.dumps({"@context": {"ex": "https://ex.example/"}, "epcisBody": {"eventList": [PLAIN, SENSOR]}})
    rows = spark.sql("SELECT * FROM explode_events(:doc, 'json')", args={"doc": doc}).collect()
    assert [json.loads(r.event_json) for r in rows] == [PLAIN, SENSOR] and rows[0].namespaces["ex"] == "https://ex.example/"
    assert [(r.event_ord, r.event_json) for r in documents.from_text(spark, doc).collect()][0][0] == rows[0].event_ord


def test_values(spark):
    assert [java_double(x) for x in ("26.10", "1e7", "12345678.5", "0.005", "0.0001", "-0.0", "5e-324")] == ["26.1", "1.0E7", "1.23456785E7", "0.005", "1.0E-4", "-0.0", "5.0E-324"]
    assert [number(x) for x in ("25.0", "007", "-0.0", "10000000.0", "0.50")] == ["25", "7", "0", "10000000.0", "0.50"]
    assert instant("2020-01-01T00:30:00.9999+01:00") == "2019-12-31T23:30:00.999Z"
    texts = ["25.0", "007", "-0.0", "10000000.0", "0.50", "12\n", "x"]
    df = spark.createDataFrame([(x,) for x in texts], "x string")
    assert [r[0] for r in df.select(number_column(F.col("x"))).collect()] == ["25", "7", "0", "10000000.0", "0.50", "12\n", "x"]
    urns = ["urn:epc:id:sgtin:4012345.011111.9876", "urn:epc:id:sgln:4012345.00005.0", "urn:epc:id:sgln:4023333.00001.12", "urn:epc:id:giai:4000001.111", "urn:epc:id:sscc:4012345.0111111111", "urn:epc:id:grai:4012345.55555.1.2",
            "urn:epc:id:gdti:4012345.00005.987", "urn:epc:class:lgtin:4023333.055555.ABC", "urn:epc:idpat:sgtin:4023333.055555.*", "urn:epc:id:pgln:4023333.00000", "urn:epc:id:nope:1.2", "x"]
    df = spark.createDataFrame([(x,) for x in urns], "x string")
    assert [r[0] for r in df.select(digital_link_column(F.col("x"))).collect()] == [digital_link(x) for x in urns]
    tips = [f"urn:epc:id:itip:4012345.011111.01{x}" for x in ("", ".02", ".02.9", ".02.*", ".02.a.b")]
    df = spark.createDataFrame([(x,) for x in tips], "x string")
    assert [r[0] for r in df.select(digital_link_column(F.col("x"))).collect()] == [digital_link(x) for x in tips]
    assert digital_link(urns[1]) == "https://id.gs1.org/414/4012345000054"
    assert digital_link(urns[3]) == "https://id.gs1.org/8004/4000001111"
    assert short_names("https://example.org/some/gtin/09520001123467/ser/1") == "https://id.gs1.org/01/09520001123467/21/1"


def test_hashes(spark):
    names = {"sha-1": "sha1", "sha-224": "sha224", "sha-256": "sha256", "sha-384": "sha384", "sha-512": "sha512", "sha3-224": "sha3_224", "sha3-256": "sha3_256", "sha3-384": "sha3_384", "sha3-512": "sha3_512", "md5": "md5"}
    df = spark.createDataFrame([("a\nb",)], "p string")
    row = df.select(*[hashing.hash_id(F.col("p"), x).alias(x) for x in [*names, "MD2", "rsa"]]).first()
    for x, f in names.items():
        assert row[x] == f"ni:///{x};{hashlib.new(f, b'ab').hexdigest()}?ver=CBV2.0"
    assert row["MD2"].startswith("ni:///md2;") and row["rsa"].startswith("ni:///sha-256;")
    with pytest.raises(ValueError, match="unknown"):
        hashing.hash_id(F.col("p"), "rsa", strict=True)
    out = hash_one(spark, json.dumps(PLAIN), options=Options.of(hash_algorithm="sha-256, md5", prehash=True, beautify=True, ignore_fields="bizStep", cbv_version="2.1.0"))
    assert list(out) == ["prehash", "sha-256", "md5"] and "bizStep" not in out["prehash"] and out["md5"].endswith("?ver=CBV2.1")


def test_store(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (3, "b"), (4, None)], "id long, h string")
    assert {tuple(r) for r in store.keep_first(df, "h", "id").select("id", "h").collect()} == {(1, "a"), (3, "b"), (4, None)}
    one, two = (df.filter("h is not null").repartition(n).agg(store.set_digest(F.col("h"))).first()[0] for n in (1, 3))
    assert one == two != df.filter("id < 3").agg(store.set_digest(F.col("h"))).first()[0]
    assert [tuple(r) for r in store.duplicate_groups(df, "h", "id").orderBy("h").collect()] == [("a", 2, 1), ("b", 2, 3)]


def test_stream(spark, tmp_path):
    from plumbline.streaming.dedup import dedup_stream, hash_stream, with_event_time

    for i in range(2):
        (tmp_path / f"{i}.json").write_text(json.dumps([PLAIN, SENSOR]))
    stream = dedup_stream(hash_stream(with_event_time(documents.read(spark, str(tmp_path), format="json", stream=True, max_files=1))))
    q = stream.select("sha-256").writeStream.format("memory").queryName("hashes").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("hashes").count() == 2


def test_sinks(spark, tmp_path):
    from plumbline.sources import sinks

    df = hash_events(frame(spark, PLAIN, SENSOR).withColumn("source_file", F.lit("/x/a.json")), Options(("prehash", "sha-256")))
    sinks.write_batch(df, str(tmp_path / "out"), ["prehash", "sha-256"])
    assert spark.read.text(str(tmp_path / "out/hashes")).count() == 2
    assert json.loads(df.select(sinks.as_json(["sha-256"])).first()[0])["sha-256"].startswith("ni:///")


def test_command_line(spark, tmp_path, capsys):
    from plumbline.__main__ import main

    (tmp_path / "a.json").write_text(json.dumps([PLAIN, SENSOR], indent=1))
    (tmp_path / "bad.json").write_text("bogus")
    assert main(["-p", "-a", "sha-256,md5", f"{tmp_path}/a.json"], spark) == 0
    shown = capsys.readouterr().out.splitlines()
    assert len(shown) == 6 and shown[0] == flat(PLAIN) and shown[1].startswith("ni:///sha-256;") and shown[2].startswith("ni:///md5;")
    assert main(["-b", f"{tmp_path}/*.json"], spark) == 1 and "bad.json: event 0" in capsys.readouterr().err
    assert (tmp_path / "a.hashes").read_text().splitlines() == [shown[1], shown[4]] and not (tmp_path / "bad.hashes").exists()
    with pytest.raises(SystemExit):
        main(["-b", "-"], spark)


def test_each_field_is_sorted_once_a_part(monkeypatch):
    """Fields are sorted no more often the deeper they lie."""
    from plumbline.operators.canonical_tree import Canonical

    sort, sorts = Canonical._sort, []
    monkeypatch.setattr(Canonical, "_sort", lambda self, f, standard: (sorts.append(f), sort(self, f, standard))[1])
    nested = ["completeness_verified"]
    for _ in range(12):
        nested = [nested, ["available"]]
    text = flat({"type": "ObjectEvent", "persistentDisposition": {"set": nested}})
    assert text.count("set=") == 13 and len(sorts) < 200
    sorts.clear()
    flat(SENSOR)
    assert len(sorts) <= 3 * 10


def test_headers_do_not_depend_on_order():
    for name in ("ex:b", "deviceID"):
        one, two = ({"type": "ObjectEvent", "ex:a": {name: {k: "1" for k in keys}}} for keys in ([name, "ex:y"], ["ex:y", name]))
        assert all(flat(one, version=v) == flat(two, version=v) for v in ("2.0", "2.1"))


def test_plain_events_of_many_forms(spark):
    """Long lists, companies of 12 digits, fields left out and values with white space are as the tree has them."""
    epcs = [f"urn:epc:id:sgtin:4012345.{i % 1000000:06d}.{i}" for i in range(20_000)]
    events = [
        {**PLAIN, "epcList": epcs}, {**PLAIN, "parentID": "urn:epc:id:pgln:401234500000."}, {**PLAIN, "transformationID": "urn:epc:id:gdti:123456789012..5"}, {**PLAIN, "quantityList": [{}, {"quantity": 3}]},
        {**PLAIN, "epcList": ["urn:epc:id:sgtin:4012345.011111.9", 5, None]}, {**PLAIN, "epcList": None}, {**PLAIN, "action": None}, {**PLAIN, "bizStep": ""}, {**PLAIN, "bizStep": " [x"}, {**PLAIN, "readPoint": {}},
        {**PLAIN, "sourceList": [{"type": " ", "source": " "}]}, {**PLAIN, "readPoint": "x"}, {**PLAIN, "action": [1]}, {**PLAIN, "eventTime": "2019-02-30T15:00:00Z"}, {**PLAIN, "disposition": "gs1:x", "bizStep": "12.0"},
    ]
    df = frame(spark, *events, '{"type": "ObjectEvent", "eventTime": "2019-04-02T15:00:00Z", "action": \n {"a": 1}, "epcList": \n ["urn:epc:id:sgtin:4012345.011111.9"]}')
    routed = [r[0] for r in canonical.parsed(df).orderBy("event_ord").select(canonical.is_plain(Options())).collect()]
    assert routed[:4] == [True] * 4 and not routed[4] and not routed[12] and not routed[-1]
    for options in (Options(), Options(exclude=("type", "source", "bizTransaction", "bizStep"))):
        one, two = (f(df, options).orderBy("event_ord").select("prehash", "error").collect() for f in (canonical.prehash, canonical.by_tree))
        assert one == two


def test_rows_are_dealt_out(spark, tmp_path):
    """One row group is no longer one task; what is spread or small is left alone."""
    from plumbline import queries

    spark.range(60_000).coalesce(1).write.parquet(str(tmp_path / "one.parquet"))
    spark.range(60_000).repartition(4).write.parquet(str(tmp_path / "spread.parquet"))
    spark.range(1000).coalesce(1).write.parquet(str(tmp_path / "small.parquet"))
    largest = lambda df: max(r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect())
    dealt = queries._dealt(spark, str(tmp_path), "one")
    assert dealt.count() == 60_000 and largest(dealt) < 30_000
    for name in ("spread", "small"):
        assert "Exchange" not in queries._dealt(spark, str(tmp_path), name)._jdf.queryExecution().executedPlan().toString()


def test_new_events_reads_and_hashes_each_event_once(spark):
    from plumbline import queries

    plan = queries.new_events_anti(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 2 and plan.count("from_json") == 4
