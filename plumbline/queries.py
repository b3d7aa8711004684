"""Queries of the event engine over the driver's tables, and the same in SQL."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import hashing
from plumbline.functions.identifiers import digital_link_column, vocabulary_column
from plumbline.functions.values import instant_column, number_column
from plumbline.operators import canonical, store
from plumbline.plans.hashing import hash_events, register
from plumbline.schema import ALGORITHMS, Options
from plumbline.sources.documents import explode

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows that are worth a shuffle, and how many times its share the largest task may have without one.
_MANY, _UNEVEN = 50_000, 1.5


def _dealt(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's rows, dealt out to all cores if the scan leaves cores idle: hashing takes long a row, and a file of one row group is one
    task, however many rows it has. Rows a task are counted first, from the files' footers."""
    df = _table(spark, sf_dir, name)
    counts = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("task")).count().collect()]
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if sum(counts) > _MANY and max(counts) * cores > _UNEVEN * sum(counts) else df


def _event(json: Column, *keys: str, namespaces: dict[str, str] | None = None) -> list[Column]:
    ns = F.create_map(*[F.lit(x) for kv in namespaces.items() for x in kv]) if namespaces else F.expr("cast(map() as map<string,string>)")
    return [*map(F.col, keys), json.alias("event_json"), ns.alias("namespaces")]


def _iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")


def _object_fields() -> list[Column]:
    epc = F.concat(F.lit("urn:epc:id:sgtin:4012345."), F.lpad(F.col("user_id").cast("string"), 6, "0"), F.lit("."), F.col("event_id").cast("string"))
    return [F.lit("OBSERVE").alias("action"), F.array(epc).alias("epcList"), _iso(F.col("ts")).alias("eventTime"), F.lit("+00:00").alias("eventTimeZoneOffset"), F.col("event_type").alias("bizStep"), F.lit("ObjectEvent").alias("type"), F.concat(F.lit("ni:///x;"), F.col("event_id").cast("string")).alias("eventID")]


def object_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dealt(spark, sf_dir, "events").select(*_event(F.to_json(F.struct(*_object_fields())), "event_id"))


_CHECK = "((10 - list_sum(list_transform(range(1, len({d}) + 1), lambda i: ({d})[i]::INT * CASE WHEN (len({d}) - i) % 2 = 0 THEN 3 ELSE 1 END)) % 10) % 10)::INT::VARCHAR"
_EPC_SQL = f"(SELECT 'https://id.gs1.org/01/' || d || {_CHECK.format(d='d')} FROM (SELECT lpad(user_id::VARCHAR, 6, '0')[1] || '4012345' || lpad(user_id::VARCHAR, 6, '0')[2:] AS d)) || '/21/' || event_id"
_TIME_SQL = "strftime(date_trunc('millisecond', {t}), '%Y-%m-%dT%H:%M:%S.%g') || 'Z'"
_HEAD_SQL = f"'eventType=ObjectEventeventTime=' || {_TIME_SQL.format(t='ts')} || 'eventTimeZoneOffset=+00:00'"
_OBJECT_SQL = f"{_HEAD_SQL} || 'epcListepc=' || {_EPC_SQL} || 'action=OBSERVEbizStep=https://ref.gs1.org/cbv/BizStep-' || event_type"


def _joined(df: DataFrame, *keys: str, join: str = "") -> DataFrame:
    return df.select(*keys, hashing.shown(F.col("prehash"), join).alias("prehash"))


def _hashes(name: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return hash_events(object_events(spark, sf_dir), Options((name,))).select("event_id", F.col(f"`{name}`").alias("hash_id"))

    return query


def prehash_object_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined(canonical.prehash(object_events(spark, sf_dir)), "event_id")


def prehash_join_newline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined(canonical.prehash(object_events(spark, sf_dir)), "event_id", join="\n")


def _sscc() -> Column:
    return F.concat(F.lit("urn:epc:id:sscc:4012345."), F.lpad(F.col("l_orderkey").cast("string"), 10, "0"))


def _gtin() -> Column:
    return F.concat(F.lit("urn:epc:id:sgtin:4012345."), F.lpad((F.col("l_partkey") % 1000000).cast("string"), 6, "0"), F.lit("."), F.col("l_linenumber").cast("string"))


def prehash_aggregation_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One event an order: its lines are the children, sorted by their URNs."""
    orders = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(_gtin()).alias("children"))
    json = F.to_json(F.struct(F.lit("AggregationEvent").alias("type"), F.lit("2024-01-01T00:00:00Z").alias("eventTime"), _sscc().alias("parentID"), F.col("children").alias("childEPCs"), F.lit("ADD").alias("action")))
    return _joined(canonical.prehash(orders.select(*_event(json, "l_orderkey"))), "l_orderkey")


def prehash_quantity_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.struct(F.concat(F.lit("urn:epc:idpat:sgtin:4012345."), F.lpad((F.col("l_partkey") % 1000000).cast("string"), 6, "0"), F.lit(".*")).alias("epcClass"), F.col("l_quantity").alias("quantity"), F.lit("KGM").alias("uom"))
    orders = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(line).alias("q"))
    json = F.to_json(F.struct(F.lit("ObjectEvent").alias("type"), F.lit("2024-01-01T00:00:00Z").alias("eventTime"), F.col("q").alias("quantityList"), F.lit("ADD").alias("action")))
    return _joined(canonical.prehash(orders.select(*_event(json, "l_orderkey"))), "l_orderkey")


def prehash_sensor_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = F.struct(F.lit("Temperature").alias("type"), F.col("value"), F.lit("CEL").alias("uom"))
    sensor = F.struct(F.struct(_iso(F.col("ts")).alias("time")).alias("sensorMetadata"), F.array(report).alias("sensorReport"))
    json = F.to_json(F.struct(F.lit("ObjectEvent").alias("type"), _iso(F.col("ts")).alias("eventTime"), F.lit("OBSERVE").alias("action"), F.array(sensor).alias("sensorElementList")))
    return _joined(canonical.prehash(_dealt(spark, sf_dir, "events").select(*_event(json, "event_id"))), "event_id")


_EXAMPLE = {"example": "https://ns.example.com/epcis"}


def _extended(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    place = F.struct(F.lit("urn:epc:id:sgln:4012345.00005.0").alias("id"), k.alias("example:k"))
    json = F.to_json(F.struct(F.lit("ObjectEvent").alias("type"), _iso(F.col("ts")).alias("eventTime"), F.lit("OBSERVE").alias("action"), place.alias("readPoint"), F.col("event_type").alias("example:kind")))
    return _dealt(spark, sf_dir, "events").select(*_event(json, "event_id", namespaces=_EXAMPLE))


def prehash_extension_ns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined(canonical.prehash(_extended(spark, sf_dir)), "event_id")


def prehash_cbv21_inline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined(canonical.prehash(_extended(spark, sf_dir), Options(version="2.1")), "event_id")


_EXTENDED_HEAD = f"'eventType=ObjectEventeventTime=' || {_TIME_SQL.format(t='ts')} || 'action=OBSERVEreadPointid=https://id.gs1.org/414/4012345000054'"
_K_SQL = "'{https://ns.example.com/epcis}k=' || (props::JSON->>'$.k')"


def normalise_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").select("event_id", number_column(F.col("value").cast("string")).alias("number"), number_column(F.lpad(F.col("user_id").cast("string"), 5, "0")).alias("padded"))


def normalise_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders").select("o_orderkey", instant_column(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'+02:00'")).alias("instant"))


def _links(table: str, key: str, urn: Callable[[Column], Column]) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _table(spark, sf_dir, table).select(key, digital_link_column(urn(F.col(key).cast("string"))).alias("link"))

    return query


def cbv_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").select("event_id", vocabulary_column(F.concat(F.lit("urn:epcglobal:cbv:bizstep:"), F.col("event_type"))).alias("biz_step"), vocabulary_column(F.concat(F.lit("urn:epcglobal:cbv:disp:"), F.col("event_type"))).alias("disposition"))


def exclude_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined(canonical.prehash(object_events(spark, sf_dir), Options(exclude=("bizStep", "epcList"))), "event_id")


def explode_event_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of all events of a user, exploded again."""
    fields = F.struct(F.col("event_id").alias("n"), F.col("event_type").alias("bizStep"))
    docs = _table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(fields)).alias("eventList"))
    raw = F.to_json(F.struct(F.lit("EPCISDocument").alias("type"), F.struct("eventList").alias("epcisBody")))
    events = explode(docs.select(F.col("user_id").cast("string").alias("source_file"), raw.alias("raw")))
    return events.select(F.col("source_file").cast("long").alias("user_id"), F.col("event_ord").cast("long").alias("event_ord"), F.get_json_object("event_json", "$.n").cast("long").alias("event_id"), F.get_json_object("event_json", "$.bizStep").alias("biz_step"))


def explode_events_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """explode_event_list by the table function, of query documents."""
    register(spark)
    fields = F.struct(F.col("event_id").alias("n"), F.col("event_type").alias("bizStep"))
    docs = _table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(fields)).alias("eventList"))
    body = F.struct(F.struct(F.struct("eventList").alias("resultsBody")).alias("queryResults"))
    docs = docs.select("user_id", F.to_json(F.struct(F.lit("EPCISQueryDocument").alias("type"), body.alias("epcisBody"))).alias("raw"))
    rows = spark.sql("SELECT user_id, e.* FROM {docs}, LATERAL explode_events(raw, 'json') e", docs=docs)
    return rows.select("user_id", F.col("event_ord").cast("long").alias("event_ord"), F.get_json_object("event_json", "$.n").cast("long").alias("event_id"), F.get_json_object("event_json", "$.bizStep").alias("biz_step"))


def sql_event_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hash_sha256 by the SQL functions."""
    register(spark)
    return spark.sql("SELECT event_id, event_hash(event_json, namespaces, 'sha-256', '2.0') AS hash_id FROM {events}", events=object_events(spark, sf_dir))


def _of_region(name: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        """A fixed text for each region, digested."""
        texts = F.element_at(F.array(*map(F.lit, _TEXTS)), (F.col("r_regionkey") + 1).cast("int"))
        return _table(spark, sf_dir, "region").select("r_regionkey", hashing.hash_id(texts, name).alias("hash_id"))

    return query


#: Texts of the published test vectors of MD2 (fixed values), and their digests.
_TEXTS = ["", "a", "abc", "message digest", "abcdefghijklmnopqrstuvwxyz"]
_MD2 = ["8350e5a3e24c153df2275c9f80692773", "32ec01ec4a6dac72c0ab96fb34c0b5d1", "da853b0d3f88d99b30283a69e6ded6bb", "ab4f496bfb2a530b219ff33031fe06b0", "4e8ddff3650292ab5a4108c3aa47940b"]


def _digests(name: str) -> list[str]:
    return _MD2 if name == "md2" else [hashlib.new(name.replace("sha3-", "sha3_").replace("sha-", "sha"), x.encode()).hexdigest() for x in _TEXTS]


def _order_events(spark: SparkSession, sf_dir: str, *fields: Column) -> DataFrame:
    head = [F.lit("2024-01-01T02:00:00+02:00").alias("eventTime"), F.lit("+02:00").alias("eventTimeZoneOffset")]
    return _dealt(spark, sf_dir, "orders").select(*_event(F.to_json(F.struct(*fields, *head)), "o_orderkey", namespaces={"cbvmda": "urn:epcglobal:cbv:mda"}))


def _key(lead: str) -> Column:
    return F.concat(F.lit(lead), F.col("o_orderkey").cast("string"))


def prehash_transaction_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Business transactions, sources and destinations, their fields and items in another order than written."""
    of = lambda name, kind, value: F.struct(value.alias(name), F.lit(kind).alias("type"))
    return _joined(canonical.prehash(_order_events(
        spark, sf_dir, F.array(of("destination", "location", _key("d:"))).alias("destinationList"), F.array(of("bizTransaction", "po", _key("p:")), of("bizTransaction", "inv", _key("i:"))).alias("bizTransactionList"),
        F.array(of("source", "owning_party", F.lit("urn:epc:id:pgln:4012345.00000"))).alias("sourceList"), F.lit("TransactionEvent").alias("type"), F.lit("ADD").alias("action"),
    )), "o_orderkey")


def prehash_transformation_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inputs, outputs, a transformation's ID, and ilmd under a known prefix."""
    ilmd = F.struct(_key("L").alias("cbvmda:lotNumber"), F.lit("2024-02-01").alias("cbvmda:itemExpirationDate"))
    return _joined(canonical.prehash(_order_events(
        spark, sf_dir, F.lit("TransformationEvent").alias("type"), _key("urn:epc:id:gdti:4012345.00001.").alias("transformationID"), ilmd.alias("ilmd"),
        F.array(_key("urn:epc:id:giai:4012345.")).alias("outputEPCList"), F.array(_key("urn:epc:id:grai:4012345.00001.")).alias("inputEPCList"),
    )), "o_orderkey")


def prehash_association_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persistent dispositions, of which several are sorted, and excluded fields."""
    kept = F.struct(F.array(F.lit("completeness_verified"), F.lit("available")).alias("set"), F.array(F.lit("urn:epcglobal:cbv:disp:in_transit")).alias("unset"))
    return _joined(canonical.prehash(_order_events(
        spark, sf_dir, F.lit("AssociationEvent").alias("type"), F.array(_key("urn:epc:id:giai:4012345.")).alias("childEPCs"), _key("urn:epc:id:grai:4012345.00001.").alias("parentID"), kept.alias("persistentDisposition"),
        F.lit("2025-01-01T00:00:00Z").alias("recordTime"), _key("urn:uuid:").alias("eventID"), F.struct(F.lit("incorrect_data").alias("reason")).alias("errorDeclaration"), F.lit("https://id.gs1.org/417/4012345000009").alias("certificationInfo"),
    )), "o_orderkey")


def prehash_event_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bare arrays of events, in which cbvmda and gs1 are known prefixes; a value given as a Digital Link with short names."""
    lot = F.struct(F.concat(F.lit("L"), F.col("event_id").cast("string")).alias("cbvmda:lotNumber"))
    epc = F.concat(F.lit("https://example.com/gtin/09520001123467/ser/"), F.col("event_id").cast("string"))
    event = F.struct(F.lit("ObjectEvent").alias("type"), F.lit("2024-01-01T00:00:00Z").alias("eventTime"), F.array(epc).alias("epcList"), F.lit("gs1:x").alias("gs1:note"), lot.alias("ilmd"), F.col("event_id").alias("eventID"))
    docs = _table(spark, sf_dir, "events").groupBy("user_id").agg(F.to_json(F.collect_list(event)).alias("raw"))
    events = explode(docs.select(F.col("user_id").cast("string").alias("source_file"), "raw"))
    return _joined(canonical.prehash(events.withColumn("event_id", F.get_json_object("event_json", "$.eventID").cast("long"))), "event_id")


def bad_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of all events, some of them cut off: those give a row with an error, the others go on."""
    raw = F.to_json(F.struct(F.struct(F.array(F.struct(*_object_fields())).alias("eventList")).alias("epcisBody")))
    cut = F.when(F.col("event_type") == "error", F.concat(F.lit("cut off "), raw)).otherwise(raw)
    out = canonical.prehash(explode(_dealt(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("source_file"), cut.alias("raw"))))
    return out.select(F.col("source_file").cast("long").alias("event_id"), F.col("error").isNull().alias("fine"))


_XML = ("<epcis:EPCISDocument xmlns:epcis=\"urn:epcglobal:epcis:xsd:2\" xmlns:example=\"https://ns.example.com/epcis\">\n <EPCISBody>\n  <EventList>\n", "  </EventList>\n </EPCISBody>\n</epcis:EPCISDocument>\n")


def _xml_documents(spark: SparkSession, sf_dir: str, step: Column) -> DataFrame:
    """A document of all events of a user, in the form of XML: lists, attributes, sensor data and an extension."""
    epc = F.concat(F.lit("urn:epc:id:sgtin:4012345."), F.lpad(F.col("user_id").cast("string"), 6, "0"), F.lit("."), F.col("event_id").cast("string"))
    event = F.concat(
        F.lit("<ObjectEvent>\n <eventTime>"), _iso(F.col("ts")), F.lit("</eventTime>\n <eventTimeZoneOffset>+00:00</eventTimeZoneOffset>\n <baseExtension><eventID>ni:///x;"), F.col("event_id").cast("string"), F.lit("</eventID></baseExtension>\n <epcList><epc>"),
        epc, F.lit("</epc></epcList>\n <action>OBSERVE</action>\n <bizStep>urn:epcglobal:cbv:bizstep:"), step, F.lit("</bizStep>\n <bizTransactionList><bizTransaction type=\"urn:epcglobal:cbv:btt:po\">p"), F.col("event_id").cast("string"),
        F.lit("</bizTransaction></bizTransactionList>\n <sensorElementList><sensorElement><sensorMetadata time=\""), _iso(F.col("ts")), F.lit("\"/><sensorReport type=\"gs1:Temperature\" value=\"26.0\" uom=\"CEL\"/></sensorElement></sensorElementList>\n <example:kind>"),
        F.col("event_type"), F.lit("</example:kind>\n</ObjectEvent>\n"),
    )
    docs = _table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_join(F.collect_list(event), "").alias("events"))
    return docs.select(F.col("user_id").cast("string").alias("source_file"), F.concat(F.lit(_XML[0]), "events", F.lit(_XML[1])).alias("raw"))


def _as_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of _xml_documents as JSON."""
    transaction = F.struct(F.lit("po").alias("type"), F.concat(F.lit("p"), F.col("event_id").cast("string")).alias("bizTransaction"))
    report = F.struct(F.lit("Temperature").alias("type"), F.lit(26).alias("value"), F.lit("CEL").alias("uom"))
    sensor = F.struct(F.struct(_iso(F.col("ts")).alias("time")).alias("sensorMetadata"), F.array(report).alias("sensorReport"))
    fields = [F.col("event_type").alias("example:kind"), F.array(sensor).alias("sensorElementList"), F.array(transaction).alias("bizTransactionList"), *_object_fields()]
    return _dealt(spark, sf_dir, "events").select(*_event(F.to_json(F.struct(*fields)), "event_id", namespaces=_EXAMPLE))


def prehash_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of XML documents; the event's ID, which is excluded, tells them apart only before hashing."""
    events = explode(_xml_documents(spark, sf_dir, F.col("event_type")), "xml", xml_exclude=("baseExtension",))
    key = F.substring(F.get_json_object("event_json", "$.bizTransactionList[0].bizTransaction"), 2, 20).cast("long")
    return _joined(canonical.prehash(events.withColumn("event_id", key)), "event_id")


def _unmatched(one: DataFrame, two: DataFrame) -> DataFrame:
    """How many hashes of each corpus the other lacks, repeats counted, and how many events the first has."""
    both = one.select("hash_id", F.lit(1).alias("n")).unionByName(two.select("hash_id", F.lit(-1).alias("n")))
    sums = both.groupBy("hash_id").agg(F.sum("n").alias("n"), F.count_if(F.col("n") > 0).alias("l"))
    return sums.agg(F.sum(F.greatest("n", F.lit(0))).cast("long").alias("left_only"), F.sum(F.greatest(-F.col("n"), F.lit(0))).cast("long").alias("right_only"), F.sum("l").cast("long").alias("events"))


def _hashed(events: DataFrame) -> DataFrame:
    return hash_events(events).withColumnRenamed("sha-256", "hash_id")


def xml_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same events as XML and as JSON have the same hashes, but for those whose business step was changed in the XML (error events)."""
    step = F.when(F.col("event_type") == "error", F.concat(F.lit("not_"), F.col("event_type"))).otherwise(F.col("event_type"))
    return _unmatched(_hashed(explode(_xml_documents(spark, sf_dir, step), "xml", xml_exclude=("baseExtension",))), _hashed(_as_json(spark, sf_dir)))


def format_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same events in another key order, and bizStep as URN; one event type is another one there."""
    fields = list(reversed(_object_fields()))
    changed = F.when(F.col("event_type") == "error", "fault").otherwise(F.col("event_type"))
    fields[2] = F.concat(F.lit("urn:epcglobal:cbv:bizstep:"), changed).alias("bizStep")
    two = _dealt(spark, sf_dir, "events").select(*_event(F.to_json(F.struct(*fields)), "event_id"))
    return _unmatched(_hashed(object_events(spark, sf_dir)), _hashed(two))


def _user_events(spark: SparkSession, sf_dir: str, where: Column | None = None) -> DataFrame:
    """Hashes of events that tell no more than who did what, so that many are the same; a third each is in one of three spellings.
    where: which events of the table are hashed at all."""
    table = _dealt(spark, sf_dir, "events")
    epc = F.concat(F.lit("urn:epc:id:giai:4012345."), F.col("user_id").cast("string"))
    spelled = lambda step, time: F.to_json(F.struct(step.alias("bizStep"), F.array(epc).alias("epcList"), F.lit(time).alias("eventTime"), F.lit("ObjectEvent").alias("type"), F.col("event_id").alias("eventID")))
    plain, kind = F.col("event_type"), F.col("event_id") % 3
    json = F.when(kind == 0, spelled(plain, "2024-01-01T00:00:00Z")).when(kind == 1, spelled(F.concat(F.lit("urn:epcglobal:cbv:bizstep:"), plain), "2024-01-01T01:00:00.000+01:00"))
    json = json.otherwise(spelled(F.concat(F.lit("https://ref.gs1.org/cbv/BizStep-"), plain), "2023-12-31T23:30:00-00:30"))
    return _hashed((table if where is None else table.filter(where)).select(*_event(json, "event_id", "user_id", "event_type"))).select("event_id", "user_id", "event_type", "hash_id")


def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.duplicate_groups(_user_events(spark, sf_dir), "hash_id", "event_id")


def dedup_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.keep_first(_user_events(spark, sf_dir).select("event_id", "hash_id"), "hash_id", "event_id")


def new_events_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events after the first day whose hash no event of that day has."""
    old = F.dayofmonth("ts") == 1
    return store.new_events(_user_events(spark, sf_dir, ~old), _user_events(spark, sf_dir, old), "hash_id").select("event_id", "hash_id")


def integrity_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored hashes of error events were spoiled, and those of some users are gone."""
    e = _user_events(spark, sf_dir)
    spoiled = F.when(F.col("event_type") == "error", "ni:///sha-256;00?ver=CBV2.0").otherwise(F.col("hash_id"))
    return store.integrity(e.select("event_id", "hash_id"), e.filter("user_id % 10 <> 3").select("event_id", spoiled.alias("hash_id")), "event_id", "hash_id")


def set_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _user_events(spark, sf_dir).groupBy("user_id").agg(store.set_digest(F.col("hash_id")).alias("digest"))


#: For each scheme: the URN of a key (k: seven digits that are no zeros), and the DuckDB expression of its link without the domain; c(x) adds the check digit.
_SCHEME_CASES = {
    "sgtin": ("urn:epc:id:sgtin:4012345.0{k5}.S1", "'01/' || c('04012345' || k5) || '/21/S1'"),
    "upui": ("urn:epc:id:upui:4012345.1{k5}.T", "'01/' || c('14012345' || k5) || '/235/T'"),
    "lgtin": ("urn:epc:class:lgtin:4012345.2{k5}.LOT", "'01/' || c('24012345' || k5) || '/10/LOT'"),
    "sgtin_class": ("urn:epc:idpat:sgtin:4012345.0{k5}.*", "'01/' || c('04012345' || k5)"),
    "sscc": ("urn:epc:id:sscc:4012345.30000{k5}", "'00/' || c('340123450000' || k5)"),
    "sgln": ("urn:epc:id:sgln:4012345.{k5}.7", "'414/' || c('4012345' || k5) || '/254/7'"),
    "sgln_zero": ("urn:epc:id:sgln:4012345.{k5}.0", "'414/' || c('4012345' || k5)"),
    "pgln": ("urn:epc:id:pgln:4012345.{k5}", "'417/' || c('4012345' || k5)"),
    "grai": ("urn:epc:id:grai:4012345.{k5}.9", "'8003/0' || c('4012345' || k5) || '9'"),
    "gdti": ("urn:epc:id:gdti:4012345.{k5}.9", "'253/' || c('4012345' || k5) || '9'"),
    "sgcn": ("urn:epc:id:sgcn:4012345.{k5}.9", "'255/' || c('4012345' || k5) || '9'"),
    "gsrn": ("urn:epc:id:gsrn:4012345.00000{k5}", "'8018/' || c('401234500000' || k5)"),
    "gsrnp": ("urn:epc:id:gsrnp:4012345.00000{k5}", "'8017/' || c('401234500000' || k5)"),
    "gsin": ("urn:epc:id:gsin:4012345.0000{k5}", "'402/' || c('40123450000' || k5)"),
    "giai": ("urn:epc:id:giai:4012345.A{k5}", "'8004/4012345A' || k5"),
    "ginc": ("urn:epc:id:ginc:4012345.{k5}", "'401/4012345' || k5"),
    "cpi": ("urn:epc:id:cpi:4012345.P{k5}.5", "'8010/4012345P' || k5 || '/8011/5'"),
    "itip": ("urn:epc:id:itip:4012345.0{k5}.01.02.S", "'8006/' || c('04012345' || k5) || '0102/21/S'"),
}


def links_of_schemes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of every scheme in turn, as a part's events have them, by the tree and by expressions."""
    k = F.lpad((F.col("p_partkey") % 100_000).cast("string"), 5, "0")
    urns = [F.concat(F.lit(urn.split("{k5}")[0]), k, F.lit(urn.split("{k5}")[1])) for urn, _ in _SCHEME_CASES.values()]
    urn = F.element_at(F.array(*urns), (F.col("p_partkey") % len(urns) + 1).cast("int"))
    json = F.to_json(F.struct(F.lit("ObjectEvent").alias("type"), F.lit("2024-01-01T00:00:00Z").alias("eventTime"), urn.alias("parentID")))
    events = _dealt(spark, sf_dir, "part").select(*_event(json, "p_partkey"), urn.alias("urn"))
    one = canonical.prehash(events).select("p_partkey", "urn", F.regexp_extract("prehash", "parentID=(.*)", 1).alias("link"))
    return one.select("p_partkey", "link", (digital_link_column(F.col("urn")) == F.col("link")).alias("same"))


#: Algorithms that DuckDB has.
_IN_SQL = {"sha-256": "sha256", "sha-1": "sha1", "md5": "md5"}


def _hash_name(algorithm: str) -> str:
    return f"hash_{algorithm.replace('-', '_') if algorithm.startswith('sha3') else algorithm.replace('-', '')}"


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {_hash_name(x): _hashes(x) if x in _IN_SQL else _of_region(x) for x in ALGORITHMS}
    more = (explode_events_sql, sql_event_hash, prehash_transaction_event, prehash_transformation_event, prehash_association_event, prehash_event_list, bad_documents, prehash_xml, xml_equivalence, links_of_schemes)
    for f in (*more, prehash_object_event, prehash_join_newline, prehash_aggregation_event, prehash_quantity_list, prehash_sensor_report, prehash_extension_ns, prehash_cbv21_inline, normalise_numbers, normalise_time, cbv_vocab, exclude_fields, explode_event_list, duplicate_groups, dedup_keep_first, new_events_anti, integrity_check, format_equivalence, set_digest):
        out[f.__name__] = f
    out["urn_to_digital_link_sgtin"] = _links("part", "p_partkey", lambda k: F.concat(F.lit("urn:epc:id:sgtin:4012345."), F.lpad(k, 6, "0"), F.lit(".S"), k))
    out["urn_to_digital_link_sgln"] = _links("supplier", "s_suppkey", lambda k: F.concat(F.lit("urn:epc:id:sgln:4012345."), F.lpad(k, 5, "0"), F.lit("."), k))
    out["urn_to_digital_link_sscc"] = _links("orders", "o_orderkey", lambda k: F.concat(F.lit("urn:epc:id:sscc:4012345."), F.lpad(k, 10, "0")))
    return out


_USER_SQL = "'eventType=ObjectEventeventTime=2024-01-01T00:00:00.000ZepcListepc=https://id.gs1.org/8004/4012345' || user_id || 'bizStep=https://ref.gs1.org/cbv/BizStep-' || event_type"


def _with_check(sql: str) -> str:
    """c(x) in an expression becomes x with its check digit."""
    before, found, rest = sql.partition("c('")
    if not found:
        return sql
    inner, _, after = ("'" + rest).partition(")")
    return f"{before}{inner} || {_CHECK.format(d=f'({inner})')}{after}"


def _ni(digest: str, name: str) -> str:
    return f"'ni:///{name};' || {digest} || '?ver=CBV2.0'"


def oracle_sql() -> dict[str, str]:
    gtin = "lpad((l_partkey % 1000000)::VARCHAR, 6, '0')"
    link = f"'https://id.gs1.org/01/' || g[1] || '4012345' || g[2:] || {_CHECK.format(d='(g[1] || chr(52) || chr(48) || chr(49) || chr(50) || chr(51) || chr(52) || chr(53) || g[2:])')}"
    sscc = "lpad({k}::VARCHAR, 10, '0')"
    sscc_key = f"{sscc}[1] || '4012345' || {sscc}[2:]"
    events = {_hash_name(a): f"SELECT event_id, {_ni(f'{f}({_OBJECT_SQL})', a)} AS hash_id FROM events" for a, f in _IN_SQL.items()}
    for name in ALGORITHMS:
        if name not in _IN_SQL:
            rows = ", ".join(f"({k}, 'ni:///{name};{x}?ver=CBV2.0')" for k, x in enumerate(_digests(name)))
            events[_hash_name(name)] = f"SELECT r_regionkey, hash_id FROM region JOIN (VALUES {rows}) v(k, hash_id) ON r_regionkey = k"
    user_hash = f"SELECT event_id, user_id, event_type, ts, {_ni('sha256(' + _USER_SQL + ')', 'sha-256')} AS hash_id FROM events"
    order_head = "'eventTime=2024-01-01T00:00:00.000ZeventTimeZoneOffset=+02:00'"
    checked = lambda x: f"({x}) || {_CHECK.format(d=f'({x})')}"
    giai, grai = "'epc=https://id.gs1.org/8004/4012345' || o_orderkey", "'=https://id.gs1.org/8003/0' || " + checked("'401234500001'") + " || o_orderkey"
    limbs = " || ".join(f"printf('%08x', (coalesce(sum(('0x' || substr(sha256(hash_id), {8 * k + 1}, 8))::BIGINT), 0) % 4294967296)::BIGINT)" for k in range(8))
    xml = f"{_OBJECT_SQL} || 'bizTransactionListtype=https://ref.gs1.org/cbv/BTT-pobizTransaction=p' || event_id || 'sensorElementsensorMetadatatime=' || {_TIME_SQL.format(t='ts')} || 'sensorReporttype=https://gs1.org/voc/Temperaturevalue=26uom=CEL' || '{{https://ns.example.com/epcis}}kind=' || event_type"
    cases = " ".join(f"WHEN {k} THEN {_with_check(sql)}" for k, (_, sql) in enumerate(_SCHEME_CASES.values()))
    return {
        **events,
        "prehash_object_event": f"SELECT event_id, {_OBJECT_SQL} AS prehash FROM events",
        "prehash_join_newline": f"SELECT event_id, 'eventType=ObjectEvent' || chr(10) || 'eventTime=' || {_TIME_SQL.format(t='ts')} || chr(10) || 'eventTimeZoneOffset=+00:00' || chr(10) || 'epcList' || chr(10) || 'epc=' || {_EPC_SQL} || chr(10) || 'action=OBSERVE' || chr(10) || 'bizStep=https://ref.gs1.org/cbv/BizStep-' || event_type AS prehash FROM events",
        "prehash_aggregation_event": f"""
            WITH l AS (SELECT l_orderkey, {gtin} AS g, l_linenumber AS n FROM lineitem), p AS (SELECT l_orderkey, '4012345.' || g || '.' || n AS urn, 'epc=' || {link} || '/21/' || n AS epc FROM l),
            o AS (SELECT l_orderkey, string_agg(epc, '' ORDER BY urn) AS epcs, {sscc_key.format(k='l_orderkey')} AS s FROM p GROUP BY l_orderkey)
            SELECT l_orderkey, 'eventType=AggregationEventeventTime=2024-01-01T00:00:00.000ZparentID=https://id.gs1.org/00/' || s || {_CHECK.format(d='s')} || 'childEPCs' || epcs || 'action=ADD' AS prehash FROM o""",
        "prehash_quantity_list": f"""
            WITH l AS (SELECT l_orderkey, {gtin} AS g, l_quantity AS q FROM lineitem),
            e AS (SELECT l_orderkey, 'epcClass=' || {link} || 'quantity=' || CASE WHEN q = floor(q) THEN q::BIGINT::VARCHAR ELSE q::VARCHAR END || 'uom=KGM' AS e FROM l)
            SELECT l_orderkey, 'eventType=ObjectEventeventTime=2024-01-01T00:00:00.000ZquantityList' || string_agg('quantityElement' || e, '' ORDER BY e) || 'action=ADD' AS prehash FROM e GROUP BY l_orderkey""",
        "prehash_sensor_report": f"SELECT event_id, 'eventType=ObjectEventeventTime=' || {_TIME_SQL.format(t='ts')} || 'action=OBSERVEsensorElementsensorMetadatatime=' || {_TIME_SQL.format(t='ts')} || 'sensorReporttype=https://gs1.org/voc/Temperaturevalue=' || CASE WHEN value = floor(value) THEN value::BIGINT::VARCHAR ELSE value::VARCHAR END || 'uom=CEL' AS prehash FROM events",
        "prehash_extension_ns": f"SELECT event_id, {_EXTENDED_HEAD} || 'readPoint' || {_K_SQL} || '{{https://ns.example.com/epcis}}kind=' || event_type AS prehash FROM events",
        "prehash_cbv21_inline": f"SELECT event_id, {_EXTENDED_HEAD} || {_K_SQL} || '{{https://ns.example.com/epcis}}kind=' || event_type AS prehash FROM events",
        "normalise_numbers": "SELECT event_id, CASE WHEN value = floor(value) THEN value::BIGINT::VARCHAR ELSE value::VARCHAR END AS number, user_id::VARCHAR AS padded FROM events",
        "normalise_time": f"SELECT o_orderkey, {_TIME_SQL.format(t='o_orderdate - INTERVAL 2 HOUR')} AS instant FROM orders",
        "cbv_vocab": "SELECT event_id, 'https://ref.gs1.org/cbv/BizStep-' || event_type AS biz_step, 'https://ref.gs1.org/cbv/Disp-' || event_type AS disposition FROM events",
        "exclude_fields": f"SELECT event_id, {_HEAD_SQL} || 'action=OBSERVE' AS prehash FROM events",
        "explode_event_list": "SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS event_ord, event_id, event_type AS biz_step FROM events",
        "explode_events_sql": "SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS event_ord, event_id, event_type AS biz_step FROM events",
        "sql_event_hash": events["hash_sha256"],
        "prehash_transaction_event": f"SELECT o_orderkey, 'eventType=TransactionEvent' || {order_head} || 'action=ADDbizTransactionListtype=https://ref.gs1.org/cbv/BTT-invbizTransaction=i:' || o_orderkey || 'type=https://ref.gs1.org/cbv/BTT-pobizTransaction=p:' || o_orderkey || 'sourceListtype=https://ref.gs1.org/cbv/SDT-owning_partysource=https://id.gs1.org/417/' || {checked("'401234500000'")} || 'destinationListtype=https://ref.gs1.org/cbv/SDT-locationdestination=d:' || o_orderkey AS prehash FROM orders",
        "prehash_transformation_event": f"SELECT o_orderkey, 'eventType=TransformationEvent' || {order_head} || 'inputEPCListepc' || {grai} || 'outputEPCList' || {giai} || 'transformationID=https://id.gs1.org/253/' || {checked("'401234500001'")} || o_orderkey || 'ilmd{{urn:epcglobal:cbv:mda}}itemExpirationDate=2024-02-01{{urn:epcglobal:cbv:mda}}lotNumber=L' || o_orderkey AS prehash FROM orders",
        "prehash_association_event": f"SELECT o_orderkey, 'eventType=AssociationEvent' || {order_head} || 'parentID' || {grai} || 'childEPCs' || {giai} || 'persistentDispositionset=https://ref.gs1.org/cbv/Disp-availableset=https://ref.gs1.org/cbv/Disp-completeness_verifiedunset=https://ref.gs1.org/cbv/Disp-in_transit' AS prehash FROM orders",
        "prehash_event_list": "SELECT event_id, 'eventType=ObjectEventeventTime=2024-01-01T00:00:00.000ZepcListepc=https://id.gs1.org/01/09520001123467/21/' || event_id || 'ilmd{urn:epcglobal:cbv:mda}lotNumber=L' || event_id || '{https://gs1.org/voc/}note=gs1:x' AS prehash FROM events",
        "bad_documents": "SELECT event_id, event_type <> 'error' AS fine FROM events",
        "prehash_xml": f"SELECT event_id, {xml} AS prehash FROM events",
        "xml_equivalence": "SELECT count(*) FILTER (event_type = 'error') AS left_only, count(*) FILTER (event_type = 'error') AS right_only, count(*) AS events FROM events",
        "format_equivalence": "SELECT count(*) FILTER (event_type = 'error') AS left_only, count(*) FILTER (event_type = 'error') AS right_only, count(*) AS events FROM events",
        "links_of_schemes": f"SELECT p_partkey, 'https://id.gs1.org/' || CASE p_partkey % {len(_SCHEME_CASES)} {cases} END AS link, true AS same FROM (SELECT p_partkey, lpad((p_partkey % 100000)::VARCHAR, 5, '0') AS k5 FROM part)",
        "duplicate_groups": f"SELECT hash_id, count(*) AS n, min(event_id) AS first_id FROM ({user_hash}) GROUP BY hash_id HAVING count(*) > 1",
        "dedup_keep_first": f"SELECT min(event_id) AS event_id, hash_id FROM ({user_hash}) GROUP BY hash_id",
        "new_events_anti": f"WITH e AS ({user_hash}) SELECT event_id, hash_id FROM e WHERE day(ts) > 1 AND hash_id NOT IN (SELECT hash_id FROM e WHERE day(ts) = 1)",
        "integrity_check": f"SELECT event_id, hash_id, CASE WHEN user_id % 10 <> 3 THEN 'ni:///sha-256;00?ver=CBV2.0' END AS stored_hash FROM ({user_hash}) WHERE event_type = 'error' OR user_id % 10 = 3",
        "set_digest": f"SELECT user_id, sha256({limbs} || ':' || count(hash_id)) AS digest FROM ({user_hash}) GROUP BY user_id",
        "urn_to_digital_link_sgtin": f"SELECT p_partkey, 'https://id.gs1.org/01/' || s || {_CHECK.format(d='s')} || '/21/S' || p_partkey AS link FROM (SELECT p_partkey, lpad(p_partkey::VARCHAR, 6, '0')[1] || '4012345' || lpad(p_partkey::VARCHAR, 6, '0')[2:] AS s FROM part)",
        "urn_to_digital_link_sgln": f"SELECT s_suppkey, 'https://id.gs1.org/414/' || s || {_CHECK.format(d='s')} || CASE WHEN s_suppkey = 0 THEN '' ELSE '/254/' || s_suppkey END AS link FROM (SELECT s_suppkey, '4012345' || lpad(s_suppkey::VARCHAR, 5, '0') AS s FROM supplier)",
        "urn_to_digital_link_sscc": f"SELECT o_orderkey, 'https://id.gs1.org/00/' || s || {_CHECK.format(d='s')} AS link FROM (SELECT o_orderkey, {sscc_key.format(k='o_orderkey')} AS s FROM orders)",
    }
