"""Named field transforms, content hashes and identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Transform names accepted in a field mapping, any case.
TRANSFORMS = ["lowercase", "uppercase", "trim", "iso8601-date", "parse-int", "parse-decimal", "sha256", "none"]

_DATE = r"\d{4}-\d{2}-\d{2}"
_OFFSET = r"(Z|[+-]\d{2}:\d{2}(:\d{2})?)"
_WITH_TIME = rf"^{_DATE}T\d{{2}}:\d{{2}}(:\d{{2}}(\.\d{{1,9}})?)?{_OFFSET}$"
_DATE_ONLY = rf"^{_DATE}{_OFFSET}?$"


def iso_date(text: Column) -> Column:
    """ISO date-time with an offset to its UTC instant, or a date as it stands.

    A date-time without an offset is no instant and gives null.
    """
    clean = F.trim(text)
    at = F.try_to_timestamp(clean)
    # no, three or six digits of the second; the only Z is the last character
    micros = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    instant = F.replace(F.replace(micros, F.lit(".000000Z"), F.lit("Z")), F.lit("000Z"), F.lit("Z"))
    day = clean.substr(1, 10).try_cast("date").isNotNull()
    return F.when(clean.rlike(_WITH_TIME), instant).when(clean.rlike(_DATE_ONLY) & day, clean)


def transform(name: str | None, text: Column) -> Column:
    """The named transform of ``text``; null means null input or a failure."""
    kind = (name or "none").lower()
    if kind not in TRANSFORMS:
        raise ValueError(f"unknown transform: {name}")
    if kind == "lowercase":
        return F.lower(text)
    if kind == "uppercase":
        return F.upper(text)
    if kind == "trim":
        return F.trim(text)
    if kind == "iso8601-date":
        return iso_date(text)
    if kind == "parse-int":
        clean = F.trim(text)
        return F.when(clean.rlike(r"^[+-]?\d+$"), clean.try_cast("bigint"))
    if kind == "parse-decimal":
        clean = F.trim(text)
        usual = clean.rlike(r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$")
        plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(clean, r"^\+", ""), r"^(-?)\.", "$10."), r"\.($|[eE])", "$1")
        return F.when(usual, clean).when(clean.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), plain)
    if kind == "sha256":
        return F.sha2(text, 256)
    return text


def content_hash(fields: dict[str, Column]) -> Column:
    """SHA-256 of ``target=value`` lines sorted by target; null is empty."""
    lines = [
        F.concat(F.lit(f"{name}="), F.coalesce(fields[name].cast("string"), F.lit("")))
        for name in sorted(fields)
    ]
    return F.sha2(F.concat_ws("\n", *lines), 256)


def joined_hash(*parts: Column) -> Column:
    """SHA-256 of the parts joined by a colon: document and change ids."""
    return F.sha2(F.concat_ws(":", *parts), 256)


def similarity(a: Column, b: Column) -> Column:
    """One minus edit distance over the longer length; empty or null is 0."""
    longest = F.greatest(F.length(a), F.length(b))
    score = 1.0 - F.levenshtein(a, b) / longest
    return F.when((F.length(a) > 0) & (F.length(b) > 0), score).otherwise(F.lit(0.0))
