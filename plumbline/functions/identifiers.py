"""EPC URNs as GS1 Digital Links and vocabulary words as web URIs, from the GS1 Tag Data Standard, the Digital Link URI syntax and
the CBV: for Python strings and, from the same tables, as Column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.schema import CBV, CBV_URNS, DL, KEY_AIS, SCHEMES, SHORT_NAMES

_URN = re.compile(r"urn:epc:(id|class|idpat):([a-z]+):(.+)", re.DOTALL)
_LINK = re.compile(rf"https?://[^/?#]+(?:/[^?#]*?)??/((?:{'|'.join([*KEY_AIS, *SHORT_NAMES])})/[^?#]+)")


def check_digit(digits: str) -> str:
    """GS1 modulo 10."""
    return str(-sum(int(c) * (3 if i % 2 == 0 else 1) for i, c in enumerate(reversed(digits))) % 10)


def digital_link(urn: str) -> str:
    """The link of an EPC, class or pattern URN; what is none, or not well formed, is returned as it is."""
    m = _URN.fullmatch(urn)
    if not m or (m[2] not in SCHEMES and m[2] != "itip"):
        return urn
    parts = m[3].split(".", 4 if m[2] == "itip" else 2)
    company, item, serial = (*parts, "", "")[:3]
    if not company.isdigit() or (m[2] not in ("giai", "cpi") and not item.isdigit() and not (item == "" and len(company) == 12)):
        return urn
    if m[2] == "itip":
        if len(parts) < 4:
            return urn
        key = item[:1] + company + item[1:]
        tail = f"/21/{parts[4]}" if len(parts) > 4 and parts[4] != "*" else ""
        return f"{DL}/8006/{key}{check_digit(key)}{parts[2]}{parts[3]}{tail}"
    ai, kind, lead, follows, qualifier = SCHEMES[m[2]]
    key = item[:1] + company + item[1:] if kind == "indicator" else company + item
    if kind != "join":
        key += check_digit(key)
    serial = "" if serial == "*" else serial
    link = f"{DL}/{ai}/{lead}{key}{serial if follows else ''}"
    if qualifier and serial and not (m[2] == "sgln" and serial == "0"):
        link += f"/{qualifier}/{serial}"
    return link


def short_names(uri: str) -> str:
    """A Digital Link of any domain, with short names or without, as one of id.gs1.org with numeric identifiers; else as it is."""
    m = _LINK.fullmatch(uri)
    if not m:
        return uri
    parts = m[1].split("/")
    return f"{DL}/" + "/".join(SHORT_NAMES.get(x, x) if i % 2 == 0 else x for i, x in enumerate(parts))


def vocabulary(urn: str) -> str:
    for prefix, name in CBV_URNS.items():
        if urn.startswith(prefix):
            return f"{CBV}{name}{urn[len(prefix) :]}"
    return urn


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body mentions it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def check_digit_column(digits: Column) -> Column:
    """check_digit; up to 18 digits are taken off a number, more one by one."""

    def short(n: Column) -> Column:
        places = [F.call_function("div", n, F.lit(10**i)) % 10 for i in range(18)]
        return F.pmod(-(sum(places[2::2], places[0]) * 3 + sum(places[3::2], places[1])), F.lit(10)).cast("string")

    return F.when(F.length(digits) <= 18, let(digits.try_cast("long"), short)).otherwise(_long_check_digit(digits))


def _long_check_digit(digits: Column) -> Column:
    weighted = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.coalesce(c.try_cast("int"), F.lit(0)) * F.when(i % 2 == 0, 3).otherwise(1))
    return F.pmod(-F.aggregate(weighted, F.lit(0), lambda a, x: a + x), F.lit(10)).cast("string")


def _rules() -> Column:
    """A map of the schemes: what stands before the key, how the key is made, whether the serial follows it, and the qualifier."""
    rule = lambda lead, kind, follows, qualifier: F.struct(F.lit(lead).alias("lead"), F.lit(kind).alias("kind"), F.lit(follows).alias("follows"), F.lit(qualifier).alias("qualifier"))
    rules = {x: rule(f"{DL}/{ai}/{lead}", kind, follows, f"/{more}/" if more else "") for x, (ai, kind, lead, follows, more) in SCHEMES.items()} | {"itip": rule(f"{DL}/8006/", "indicator", False, "")}
    return F.create_map(*[y for x, r in rules.items() for y in (F.lit(x), r)])


def digital_link_column(urn: Column) -> Column:
    """digital_link without a UDF: one formula for all of SCHEMES, with what differs by scheme looked up, and one for itip."""
    part = lambda parts, k: F.coalesce(F.get(parts, F.lit(k)), F.lit(""))

    def split(parts: Column) -> Column:  # urn, epc, id, scheme, company, item, serial
        return F.struct(part(parts, 3).alias("scheme"), part(parts, 4).alias("company"), part(parts, 5).alias("item"), part(parts, 6).alias("rest"), F.element_at(_rules(), F.get(parts, F.lit(3))).alias("rule"))

    def link(u: Column) -> Column:
        rule, item = u["rule"], u["item"]
        fine = rule.isNotNull() & u["company"].rlike(r"^[0-9]+\z") & (u["scheme"].isin("giai", "cpi") | item.rlike(r"^[0-9]+\z") | (item == "") & (F.length(u["company"]) == 12))
        key = F.when(rule["kind"] == "indicator", F.concat(F.substring(item, 1, 1), u["company"], F.substr(item, F.lit(2)))).otherwise(F.concat(u["company"], item))
        checked = F.when(rule["kind"] == "join", key).otherwise(let(key, lambda k: F.concat(k, check_digit_column(k))))
        return F.when(fine, let(F.concat(rule["lead"], checked), lambda head: F.when(u["scheme"] == "itip", itip(u, head)).otherwise(F.concat(head, tail(u))))).otherwise(urn)

    def tail(u: Column) -> Column:
        rule, serial = u["rule"], F.when(u["rest"] == "*", "").otherwise(u["rest"])
        return F.when(rule["follows"], serial).when((rule["qualifier"] == "") | u["rest"].isin("", "*") | ((u["scheme"] == "sgln") & (u["rest"] == "0")), "").otherwise(F.concat(rule["qualifier"], u["rest"]))

    def itip(u: Column, head: Column) -> Column:
        def pieces(p: Column) -> Column:  # piece, total, serial
            count, total, last = (F.get(p, F.lit(k)) for k in range(3))
            return F.when(total.isNotNull(), F.concat(head, count, total, F.when(last != "*", F.concat(F.lit("/21/"), last)).otherwise(""))).otherwise(urn)

        return let(F.split(u["rest"], "[.]", 3), pieces)

    return F.when(urn.rlike(r"^urn:epc:(id|class|idpat):[a-z]+:[0-9]"), let(let(F.split(urn, "[:.]", 7), split), link)).otherwise(urn)


def vocabulary_column(urn: Column) -> Column:
    out = urn
    for prefix, name in CBV_URNS.items():
        out = F.when(urn.startswith(prefix), F.concat(F.lit(CBV + name), F.substr(urn, F.lit(len(prefix) + 1)))).otherwise(out)
    return out
