"""Normal forms of numbers and times, for Python strings and as Column expressions."""

from __future__ import annotations

import re
from datetime import datetime, timezone
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = re.compile(r"-?\d+(\.\d+)?", re.ASCII)


def java_double(text: str) -> str:
    """A JSON float as the shortest decimal in Java's form: plain from 0.001 up to 10**7, else with an exponent."""
    d = float(text)
    if d == 0:
        return "-0.0" if text.startswith("-") else "0.0"
    if 1e-3 <= abs(d) < 1e7:
        s = f"{d!r}"
        if "e" in s:
            s = f"{d:f}".rstrip("0")
        return s if "." in s else f"{s}.0"
    mantissa, exponent = f"{d!r}".split("e") if "e" in f"{d!r}" else _scientific(d)
    return f"{mantissa if '.' in mantissa else mantissa + '.0'}E{int(exponent)}"


def _scientific(d: float) -> tuple[str, str]:
    digits = repr(abs(d)).replace(".", "").strip("0") or "0"
    exponent = len(repr(abs(d)).split(".")[0]) - 1 if abs(d) >= 1 else -(len(repr(abs(d)).split(".")[1]) - len(repr(abs(d)).split(".")[1].lstrip("0")) + 1)
    return ("-" if d < 0 else "") + digits[0] + "." + (digits[1:] or "0"), str(exponent)


def number(text: str) -> str:
    """Whole numbers below 10**7 lose their fraction and leading zeros; others stay."""
    d = float(text)
    return str(int(d)) if abs(d) < 1e7 and d == int(d) else text


def number_column(text: Column) -> Column:
    d = text.try_cast("double")
    return F.when(text.rlike(r"^-?[0-9]+([.][0-9]+)?\z") & (F.abs(d) < 1e7) & (d % 1 == 0), d.cast("long").cast("string")).otherwise(text)


_INSTANT = re.compile(r"(\d{4}-\d\d-\d\dT\d\d:\d\d(?::\d\d)?)(?:\.(\d{1,9}))?(Z|[+-]\d\d:?\d\d)")


@lru_cache(1024)
def instant(text: str) -> str:
    """An ISO time with offset as UTC with three digits of the second, cut off."""
    m = _INSTANT.fullmatch(text)
    if not m:
        raise ValueError(f"not a time with offset: {text!r}")
    at = datetime.fromisoformat(f"{m[1]}{'+00:00' if m[3] == 'Z' else m[3]}").astimezone(timezone.utc)
    return f"{at.isoformat()[:19]}.{(m[2] or '').ljust(3, '0')[:3]}Z"


def instant_column(text: Column) -> Column:
    """instant; null where the text is no time with an offset. Written from microseconds since 1970, so the session's time zone is of no effect.

    No part is mentioned twice, as lambdas compute each mention anew. The microsecond that is added shows all digits of the second.
    """
    at = F.unix_micros(F.date_trunc("MILLISECOND", timestamp_column(text)))
    shown = F.timestamp_add("MICROSECOND", at + 1, F.lit("1970-01-01").cast("timestamp_ntz")).cast("string")
    return F.concat(F.translate(F.regexp_replace(shown, r"\d{3}\z", ""), " ", "T"), F.lit("Z"))


def timestamp_column(text: Column) -> Column:
    """The time of a text with an offset, else null."""
    return F.try_to_timestamp(F.when(text.rlike(r"(Z|[+-]\d\d:?\d\d)\z"), text))
