"""Validation of JSON values as error columns: NULL when the value is good, else what is wrong and where.

``root`` is an object that ``variants.shaped`` took apart: a struct whose members are VARIANT or shaped in turn.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from logtel.functions import variants as v
from logtel.functions.scalars import is_text, iso_ms


# The complaints, whose wording is part of the poll and artifact formats.


def _unless(good: Column, where: Column, complaint: str) -> Column:
    return F.when(~F.coalesce(good, F.lit(False)), F.concat(where, F.lit(f" {complaint}")))


def _allowing(good: Column, kind: Column, nullable: bool, optional: bool) -> Column:
    if nullable:
        good = good | F.coalesce(kind == "VOID", F.lit(False))
    if optional:
        good = good | kind.isNull()
    return good


def at(where: Column, key: str) -> Column:
    return F.concat(where, F.lit(f".{key}"))


def text(root: Column, key: str, where: Column, nullable: bool = False, optional: bool = False) -> Column:
    """Non-blank text; ``nullable`` also takes JSON null, ``optional`` also an absent member."""
    good = _allowing(is_text(v.text(root[key])), v.kind(root[key]), nullable, optional)
    return _unless(good, at(where, key), "must be a non-empty string.")


def number(root: Column, key: str, where: Column, nullable: bool = False, optional: bool = False) -> Column:
    good = _allowing(v.is_number(root[key]), v.kind(root[key]), nullable, optional)
    return _unless(good, at(where, key), "must be a finite number.")


def moment(root: Column, key: str, where: Column) -> Column:
    """Text that reads as an ISO date-time."""
    unreadable = F.concat(at(where, key), F.lit(" must be a valid ISO timestamp."))
    return F.when(iso_ms(v.text(root[key])).isNull(), F.coalesce(text(root, key, where), unreadable))


def one_of(root: Column, key: str, where: Column, allowed: Sequence[str]) -> Column:
    good = v.text(root[key]).isin(*allowed)
    return _unless(good, at(where, key), f"must be one of: {', '.join(allowed)}.")


def an_object(part: Column, where: Column) -> Column:
    """``part`` as ``shaped`` gives it: NULL unless it was an object."""
    return _unless(part.isNotNull(), where, "must be an object.")


def an_array(part: Column, where: Column) -> Column:
    return _unless(part.isNotNull(), where, "must be an array.")


def each(items: Column, check, where: Column) -> Column:
    """First complaint over the items of an array, with the item's index in its place."""
    found = F.transform(items, lambda x, i: check(x, F.concat(where, F.lit("["), i.cast("string"), F.lit("]"))))
    return F.get(F.filter(found, lambda e: e.isNotNull()), 0)


def numbers(root: Column, keys: Sequence[str], where: Column, nullable: bool = False, optional: bool = False) -> Column:
    """Complaint about the first of ``keys`` that is no number."""
    return F.coalesce(*[number(root, key, where, nullable, optional) for key in keys])


def texts(root: Column, keys: Sequence[str], where: Column, nullable: bool = False, optional: bool = False) -> Column:
    return F.coalesce(*[text(root, key, where, nullable, optional) for key in keys])


# --- a quick look ---------------------------------------------------------------------------
# Reading numbers with a schema of doubles costs a fraction of looking at their kinds one by one. It only finds
# values that are surely good; all others take the checks above.

_SUSPECT = "_suspect"
_STRICT = {"columnNameOfCorruptRecord": _SUSPECT, "allowSingleQuotes": "false", "allowNonNumericNumbers": "false", "mode": "PERMISSIVE"}
# Words that are no JSON number, object, array or truth value, as which text read with a schema may come out.
_SURE_WORD = r"(?!true\b|false\b)[A-Za-z_][A-Za-z0-9_]*"


def quick(text: Column, members: str) -> Column:
    """JSON text read with a schema; anything that does not fit it shows in ``_suspect``, which ``sure`` looks at."""
    return F.from_json(text, f"{members}, {_SUSPECT} string", _STRICT)


def sure(read: Column, needed: Sequence[Column], optional: Sequence[Column] = ()) -> Column:
    """True only if all of what was read fits, and the doubles ``needed`` are there and finite; ``optional`` ones may be missing."""
    total = F.lit(0.0)
    for number in (*needed, *[F.coalesce(c, F.lit(0.0)) for c in optional]):
        total = total + F.abs(number)
    return F.coalesce(read.isNotNull() & read[_SUSPECT].isNull() & (total < F.lit(float("inf"))), F.lit(False))


def sure_words(items: Column) -> Column:
    """True only if every item of an array is there and a plain word."""
    words = F.array_join(items, "\n").rlike(rf"^{_SURE_WORD}(\n{_SURE_WORD})*\z")
    return F.coalesce(~F.array_contains(items, "") & ((F.size(items) == 0) | words), F.lit(False))


def sure_numbers(items: Column) -> Column:
    """True only if every item of an array is there and finite."""
    infinite = [F.array_contains(items, F.lit(float(x))) for x in ("inf", "-inf", "nan")]
    return F.coalesce(~infinite[0] & ~infinite[1] & ~infinite[2], F.lit(False))
