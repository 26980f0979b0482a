"""Column expressions for times, numbers and text. No Python runs per row."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Text forms in which exports write a local date and time (read as UTC).
EXPORT_TIME_FORMATS = (
    "M/d/yyyy, h:mm:ss[.SSSSSSSSS] a X",
    "M/d/yyyy h:mm:ss[.SSSSSSSSS] a X",
    "M/d/yyyy, H:mm:ss[.SSSSSSSSS] X",
    "M/d/yyyy H:mm:ss[.SSSSSSSSS] X",
    "M/d/yyyy h:mm a X",
    "M/d/yyyy H:mm X",
)
# JSON number and ISO date-time patterns.
NUMBER_TEXT = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
ISO_TEXT = (
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"
    r"([T ][0-9]{2}:[0-9]{2}(:[0-9]{2}([.,][0-9]+)?)?\s*(Z|[+-][0-9]{2}:?[0-9]{2})?)?$"
)
ISO_STRICT_TEXT = (
    r"^[0-9]{4}(-[0-9]{2}(-[0-9]{2}(T[0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?(Z|[+-][0-9]{2}:?[0-9]{2})?)?)?)?$"
)
# Fixed value: a date-time that needs no completing.
ISO_WHOLE_TEXT = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?Z\z"
DEFAULT_LOOKBACK_MS = 2 * 3600 * 1000


def is_text(c: Column) -> Column:
    """True for text with at least one non-space character."""
    return F.coalesce(c.rlike(r"\S"), F.lit(False))


def epoch_ms_text(c: Column) -> Column:
    """Whole epoch milliseconds written with an optional sign and thousands commas, else NULL."""
    text = F.trim(c)
    return F.when(text.rlike(r"^[+-]?[0-9][0-9,]*$"), F.regexp_replace(text, ",", "").try_cast("bigint"))


def _iso_instant(text: Column) -> Column:
    """Timestamp of ISO text; without a zone it is UTC whatever the session zone is. Names ``text`` once."""
    steps = (
        (r"^([0-9]{4})$", "$1-01"),
        (r"^([0-9]{4}-[0-9]{2})$", "$1-01"),
        (r"^([0-9]{4}-[0-9]{2}-[0-9]{2})$", "$1T00:00:00Z"),
        (r"([T ][0-9:.]+)$", "$1Z"),
        (r"([T ].*[+-][0-9]{2})([0-9]{2})$", "$1:$2"),
    )
    for pattern, better in steps:
        text = F.regexp_replace(text, pattern, better)
    return F.try_to_timestamp(text)


def iso_ms(c: Column) -> Column:
    """Epoch ms of an ISO date or date-time, cut to whole milliseconds; anything else is NULL."""
    completed = _iso_instant(F.regexp_extract(c, ISO_STRICT_TEXT, 0))
    return F.unix_millis(F.when(c.rlike(ISO_WHOLE_TEXT), F.try_to_timestamp(c)).otherwise(completed))


def datetime_ms_text(c: Column) -> Column:
    """Epoch ms of an ISO or US-style date-time; no zone means UTC."""
    text = F.trim(c)
    iso = _iso_instant(F.regexp_replace(F.regexp_extract(text, ISO_TEXT, 0), r"\s+(?=Z|[+-])", ""))
    spoken = F.when(text.rlike(r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}"), F.concat(text, F.lit(" Z")))
    forms = [F.try_to_timestamp(spoken, F.lit(form)) for form in EXPORT_TIME_FORMATS]
    bare = F.when(text.rlike(r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$"), F.concat(text, F.lit(" 0:00 Z")))
    return F.unix_millis(F.coalesce(iso, *forms, F.try_to_timestamp(bare, F.lit("M/d/yyyy H:mm X"))))


def finite(c: Column) -> Column:
    """``c`` as double where it is a finite number, else NULL (NaN compares above every number)."""
    number = c.cast("double")
    return F.when(F.abs(number) < F.lit(float("inf")), number)


def finite_or_zero(c: Column) -> Column:
    return F.coalesce(finite(c), F.lit(0.0))


def mib(c: Column) -> Column:
    """Bytes as MiB, nothing counting as zero."""
    return finite_or_zero(c) / F.lit(1048576.0)


def ratio(top: Column, bottom: Column, empty: Column | None = None) -> Column:
    """``top / bottom`` where the bottom is positive, else ``empty`` (0 by default)."""
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0) if empty is None else empty)


def coerce_comparable(v: Column) -> Column:
    """A VARIANT checkpoint value as double: number, ISO time as epoch ms, or numeric text."""
    kind = F.schema_of_variant(v)
    number = finite(F.try_variant_get(v, "$", "double"))
    text = F.trim(F.try_variant_get(v, "$", "string"))
    numeric = F.regexp_replace(text, ",", "")
    from_text = F.when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T"), iso_ms(text).cast("double")).when(
        numeric.rlike(NUMBER_TEXT), finite(numeric.try_cast("double"))
    )
    return F.when(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), number).when(kind == "STRING", from_text)


def source_seq(ref: Column) -> Column:
    """Sequence number after the last slash of a ``partition/sequence`` reference, else NULL."""
    last = F.element_at(F.split(ref, "/"), -1)
    return F.nullif(F.regexp_extract(last, r"^\s*([+-]?[0-9]+)", 1), F.lit("")).try_cast("bigint")


def natural_sort_key(c: Column) -> Column:
    """Text key under which digit runs of any length compare as numbers; equal ones are told apart by the text itself."""
    runs = F.regexp_extract_all(c, F.lit(r"(\d+|\D+)"), F.lit(1))

    def counted(run: Column) -> Column:
        digits = F.regexp_replace(run, r"^0+(?=\d)", "")
        return F.concat(F.lpad(F.length(digits).cast("string"), 10, "0"), digits)

    keyed = F.transform(runs, lambda r: F.when(r.rlike(r"^\d"), counted(r)).otherwise(r))
    return F.concat(F.array_join(keyed, ""), F.lit("\0"), c)


def iso_duration_ms(text: str | None) -> int:
    """Milliseconds of an ISO 8601 day/time duration parameter; blank is two hours, other text an error."""
    if text is None or not text.strip():
        return DEFAULT_LOOKBACK_MS
    found = re.fullmatch(
        r"(-?)P(?:(\d+)D)?(?:T(?=\d)(?:(\d+)H)?(?:(\d+)M)?(?:(\d+(?:\.\d+)?)S)?)?", text.strip()
    )
    if not found or not any(found.groups()[1:]):
        raise ValueError(f"not an ISO 8601 duration: {text!r}")
    sign, days, hours, minutes, seconds = found.groups()
    total = ((int(days or 0) * 24 + int(hours or 0)) * 60 + int(minutes or 0)) * 60 + float(seconds or 0)
    return round(total * 1000) * (-1 if sign else 1)


def clock_duration_ms(text: str) -> int:
    """Milliseconds of a ``d.hh:mm:ss`` duration parameter."""
    found = re.fullmatch(r"(?:(\d+)\.)?(\d{1,2}):(\d{2})(?::(\d{2}(?:\.\d+)?))?", text.strip())
    if not found:
        raise ValueError(f"not a d.hh:mm:ss duration: {text!r}")
    days, hours, minutes, seconds = found.groups()
    return round((((int(days or 0) * 24 + int(hours)) * 60 + int(minutes)) * 60 + float(seconds or 0)) * 1000)
