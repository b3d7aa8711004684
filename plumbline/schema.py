"""The EPCIS 2.0 event template, constants of the Core Business Vocabulary, and options."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# Field order and names of the EPCIS 2.0 and CBV standards.
TOP = "type eventTime eventTimeZoneOffset certificationInfo epcList parentID inputEPCList childEPCs quantityList childQuantityList inputQuantityList outputEPCList outputQuantityList action transformationID bizStep disposition persistentDisposition readPoint bizLocation bizTransactionList sourceList destinationList sensorElementList ilmd".split()
_QUANTITY = ["epcClass", "quantity", "uom"]
EPC_LISTS = ["epcList", "inputEPCList", "childEPCs", "outputEPCList"]
QUANTITY_LISTS = ["quantityList", "childQuantityList", "inputQuantityList", "outputQuantityList"]
#: Fields in order, by the field that holds them.
TEMPLATE: dict[str, list[str]] = {
    "": TOP,
    **{x: ["epc"] for x in EPC_LISTS},
    **{x: _QUANTITY for x in QUANTITY_LISTS},
    "persistentDisposition": ["set", "unset"],
    "readPoint": ["id"],
    "bizLocation": ["id"],
    "bizTransactionList": ["type", "bizTransaction"],
    "sourceList": ["type", "source"],
    "destinationList": ["type", "destination"],
    "sensorElementList": ["sensorMetadata", "sensorReport"],
    "sensorMetadata": "time startTime endTime deviceID deviceMetadata rawData dataProcessingMethod bizRules".split(),
    "sensorReport": "type exception deviceID deviceMetadata rawData dataProcessingMethod time microorganism chemicalSubstance value component stringValue booleanValue hexBinaryValue uriValue minValue maxValue meanValue sDev percRank percValue uom coordinateReferenceSystem".split(),
}
# Fixed values, too: names of the standards, and which fields count for nothing.
#: What the objects of these lists are called; those of the others have no name.
ELEMENTS = {**{x: "quantityElement" for x in QUANTITY_LISTS}, "sensorElementList": "sensorElement"}
UNNAMED = ["bizTransactionList", "sourceList", "destinationList"]
EVENT_TYPES = ["ObjectEvent", "AggregationEvent", "TransactionEvent", "TransformationEvent", "AssociationEvent"]
EXCLUDED = ["errorDeclaration", "declarationTime", "reason", "correctiveEventIDs", "correctiveEventID", "recordTime", "eventID", "certificationInfo", "@context", "rdfs:comment", "#text", "comment"]
TIMES = ["eventTime", "time", "startTime", "endTime"]
SHORT_NAME_FIELDS = "epc epcClass id deviceID deviceMetadata rawData dataProcessingMethod bizRules microorganism chemicalSubstance coordinateReferenceSystem uriValue".split()
VOC, CBV, DL, MDA = "https://gs1.org/voc/", "https://ref.gs1.org/cbv/", "https://id.gs1.org", "urn:epcglobal:cbv:mda"
#: URN prefixes of the vocabulary and what they become below CBV.
CBV_URNS = {"urn:epcglobal:cbv:bizstep:": "BizStep-", "urn:epcglobal:cbv:disp:": "Disp-", "urn:epcglobal:cbv:btt:": "BTT-", "urn:epcglobal:cbv:sdt:": "SDT-", "urn:epcglobal:cbv:er:": "ER-"}
#: Bare words of these fields, (field that holds it, field), belong to the vocabulary.
BARE = {("", "bizStep"): "BizStep-", ("", "disposition"): "Disp-", ("bizTransactionList", "type"): "BTT-", ("persistentDisposition", "set"): "Disp-", ("persistentDisposition", "unset"): "Disp-", ("sourceList", "type"): "SDT-", ("destinationList", "type"): "SDT-"}
#: Of a sensor report, what its type, exception and component are relative to.
SENSOR_BASE = {"type": VOC, "exception": VOC, "component": f"{CBV}Comp-"}

# Schemes and application identifiers of the GS1 standards.
#: EPC schemes as GS1 Digital Links: (AI, how the key is made, leading text, whether the serial follows the key, AI of the serial).
#: Keys: "indicator" moves the first digit of the item before the company and adds a check digit; "check" only adds it; "join" neither.
SCHEMES: dict[str, tuple[str, str, str, bool, str | None]] = {
    "sgtin": ("01", "indicator", "", False, "21"),
    "upui": ("01", "indicator", "", False, "235"),
    "lgtin": ("01", "indicator", "", False, "10"),
    "sscc": ("00", "indicator", "", False, None),
    "sgln": ("414", "check", "", False, "254"),
    "pgln": ("417", "check", "", False, None),
    "grai": ("8003", "check", "0", True, None),
    "gdti": ("253", "check", "", True, None),
    "sgcn": ("255", "check", "", True, None),
    "gsrn": ("8018", "check", "", False, None),
    "gsrnp": ("8017", "check", "", False, None),
    "gsin": ("402", "check", "", False, None),
    "giai": ("8004", "join", "", False, None),
    "ginc": ("401", "join", "", False, None),
    "cpi": ("8010", "join", "", False, "8011"),
}
#: Short names of application identifiers in Digital Links.
SHORT_NAMES = {"gtin": "01", "sscc": "00", "gln": "414", "party": "417", "itip": "8006", "cpid": "8010", "grai": "8003", "giai": "8004", "gdti": "253", "gcn": "255", "gsrn": "8018", "gsrnp": "8017", "gsin": "402", "ginc": "401", "ser": "21", "lot": "10", "cpv": "22", "glnx": "254", "cpsn": "8011"}
KEY_AIS = ["01", "00", "414", "417", "8006", "8010", "8003", "8004", "253", "255", "8018", "8017", "402", "401"]

ALGORITHMS = ["sha-1", "sha-224", "sha-256", "sha-384", "sha-512", "sha3-224", "sha3-256", "sha3-384", "sha3-512", "md2", "md5"]


@dataclass(frozen=True)
class Options:
    """algorithms: outputs, "prehash" among them if wanted. exclude: fields left out besides the standard ones. join: put between the
    lines of a shown pre-hash. version: 2.0 or 2.1. strict: refuse unknown algorithms, which otherwise mean sha-256. failfast: raise on
    the first bad event, which otherwise gets a row with its error."""

    algorithms: tuple[str, ...] = ("sha-256",)
    exclude: tuple[str, ...] = ()
    join: str = ""
    version: str = "2.0"
    strict: bool = False
    failfast: bool = False

    def excluded(self) -> list[str]:
        return [*EXCLUDED, *(x for x in self.exclude if x not in EXCLUDED)]

    @classmethod
    def of(cls, *, hash_algorithm: str = "sha-256", prehash: bool = False, beautify: bool = False, ignore_fields: str = "", cbv_version: str = "2.0.0", **more) -> Options:
        """From the option names of a command line or request; lists are comma-separated."""
        split = lambda x: tuple(y.strip() for y in x.split(",") if y.strip())
        algorithms = (("prehash",) if prehash else ()) + (split(hash_algorithm) or ("sha-256",))
        return cls(algorithms, split(ignore_fields), "\n" if beautify else "", cbv_version[:3], **more)


#: What a source gives: where the event stood, its JSON, and the namespaces in force.
EVENTS = T.StructType([T.StructField("source_file", T.StringType()), T.StructField("event_ord", T.IntegerType()), T.StructField("event_json", T.StringType()), T.StructField("namespaces", T.MapType(T.StringType(), T.StringType()))])

