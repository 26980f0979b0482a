"""Personal data, with offset-preserving deobfuscation.

*Base* detection runs four patterns on the text as it is. The *method* then
reads a normalised text: transducers rewrite look-alike characters, spelled
digits and written-out ``at`` and ``dot``, and every character they write
remembers where the characters it replaces began and ended. The same patterns
run on the normalised text, and their spans are mapped back to the source. A
mapped span is added if it covers no part of a base span of its kind; base
spans always stay. A single spelled digit next to digits may belong to them or
not, so the text is also read with it as a digit, and spans that cover no part
of those found before are added.

Patterns run in linear time on any text: an e-mail address is looked for from
its ``@``, numbers from the start of a run of digits.

Results by case: a null text is an empty one and has no span; equal starts are
ordered by kind; spans of different kinds may overlap; repeated rows are read
one by one; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logtel.llm.common import texts_of

Span = tuple[int, int]

#: The kinds, in the order of equal starts.
KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")


def emails(text: str) -> list[Span]:
    found, free = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            found.append((start, match.end()))
            free = match.end()
        else:
            # a local part cannot reach over this sign
            free = at + 1
        at = text.find("@", max(free, at + 1))
    return found


def ips(text: str) -> list[Span]:
    return [m.span() for m in _IP.finditer(text) if all(_at_most_255(p) for p in m.group().split("."))]


def _at_most_255(digits: str) -> bool:
    digits = digits.lstrip("0") or "0"
    return len(digits) <= 3 and int(digits) <= 255


def _luhn(digits: str) -> bool:
    doubled = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (doubled + sum(map(int, digits[-1::-2]))) % 10 == 0


def cards(text: str) -> list[Span]:
    found = []
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and _luhn(digits):
            found.append(m.span())
    return found


def phones(text: str) -> list[Span]:
    return [m.span() for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m.group())) <= 15]


_DETECTORS: dict[str, Callable[[str], list[Span]]] = {"email": emails, "ip": ips, "card": cards, "phone": phones}


def detect(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns."""
    found = [(a, b, "email") for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for kind in KINDS[1:]:
            found += [(a, b, kind) for a, b in _DETECTORS[kind](text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


# Look-alikes of ASCII characters that compatibility normalisation does not fold.
_LOOKALIKES = {
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s",
    "ѵ": "v", "ԝ": "w", "х": "x", "у": "y", "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K",
    "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "Υ": "Y", "Ζ": "Z", "Α": "A", "Β": "B", "Ε": "E", "Η": "H",
    "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Χ": "X", "α": "a", "ο": "o", "ν": "v", "ρ": "p",
    "ι": "i", "κ": "k", "υ": "u", "ɑ": "a", "ɡ": "g", "ı": "i", "ո": "n", "ս": "u", "օ": "o", "•": ".", "·": ".", "․": ".",
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", " ": " ", " ": " ", " ": " ", " ": " ",
    "​": "", "‌": "", "‍": "", "⁠": "", "﻿": "", "­": "",
}
# The digits' names.
_NAMES = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine")

_ODD = re.compile("[^\x00-\x9f\xa1-\xac\xae-\xb6\xb8-İĲ-ɐ]")
_SPELLED = re.compile(rf"(?<![^\W_])(?:{'|'.join(_NAMES)})(?:[ \t,.-]{{1,3}}(?:{'|'.join(_NAMES)}))+(?![^\W_])", re.I)
_NAME = re.compile("|".join(_NAMES), re.I)
#: Found much faster than ``_SPELLED``, and in every lower-cased text in which that is found.
_PERHAPS_SPELLED = re.compile(rf"(?:{'|'.join(_NAMES)})[ \t,.-]{{1,3}}(?:{'|'.join(_NAMES)})")
#: A single name counts next to digits; what separates them stays. Digits on both sides are surer than on one.
_SINGLE = re.compile(rf"(?<![^\W_])(?:{'|'.join(_NAMES)})(?![^\W_])", re.I)
_BEFORE = re.compile(r"[0-9][ \t,.()-]{1,3}\Z")
_AFTER = re.compile(r"[ \t,.()-]{1,3}[0-9]")
#: In every lower-cased text that has a single name next to digits.
_PERHAPS_SINGLE = re.compile(rf"[0-9][ \t,.()-]{{1,3}}(?:{'|'.join(_NAMES)})|(?:{'|'.join(_NAMES)})[ \t,.()-]{{1,3}}[0-9]")
_BRACKETED = re.compile(r"[ \t]*(?:\([ \t]*(at|dot)[ \t]*\)|\[[ \t]*(at|dot)[ \t]*\]|\{[ \t]*(at|dot)[ \t]*\}|<[ \t]*(at|dot)[ \t]*>)[ \t]*", re.I)
_LAST = r"(?:xn--[A-Za-z0-9-]++|[A-Za-z]{2,}+)(?!\.?[A-Za-z0-9-])"
#: Words ``at`` and ``dot`` without brackets count only together: a name, at, a host and at least one dot. All dots may be signs if
#: the last label is letters, so that a time or an amount behind ``at`` is no host.
_WORDED = re.compile(
    r"(?<![^\s<(\[])(?<!dot )[A-Za-z0-9_%+-]++(?:(?:\.|[ \t]+dot[ \t]+)[A-Za-z0-9_%+-]++)*+"
    r"(?:(?:[ \t]+at[ \t]+|@)[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+[ \t]+dot[ \t]+[A-Za-z0-9-]++(?:(?:\.|[ \t]+dot[ \t]+)[A-Za-z0-9-]++)*+"
    r"|@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
    rf"|[ \t]+at[ \t]+[A-Za-z0-9-]++(?:\.(?!{_LAST})[A-Za-z0-9-]++)*+\.{_LAST})",
    re.I,
)
_WORDED_IP = re.compile(r"(?<![^\W_])[0-9]{1,3}(?:[ \t]+dot[ \t]+[0-9]{1,3}){3}(?![^\W_])", re.I)
_WORD = re.compile(r"[ \t]+(at|dot)[ \t]+", re.I)
#: In every lower-cased text in which ``_WORD`` is found.
_PERHAPS_WORDED = re.compile(r"[ \t](?:at|dot)[ \t]")
_SIGN = {"at": "@", "dot": "."}
_PLUS = re.compile(r"(?<![^\W_])plus[ \t]+(?=\(?[0-9])", re.I)


class Tape:
    """A text that transducers rewrite, with the source range of each of its characters (none while unchanged)."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.starts: list[int] | None = None
        self.ends: list[int] | None = None

    def rewrite(self, changes: list[tuple[int, int, str]]) -> None:
        """Replace ranges, given in order and not overlapping, each by a text of which every character stands for the range."""
        if not changes:
            return
        size = len(self.text)
        old_starts = self.starts if self.starts is not None else range(size)
        old_ends = self.ends if self.ends is not None else range(1, size + 1)
        text, starts, ends, at = [], [], [], 0
        for a, b, written in changes:
            text += (self.text[at:a], written)
            starts.extend(old_starts[at:a])
            ends.extend(old_ends[at:a])
            starts.extend([old_starts[a]] * len(written))
            ends.extend([old_ends[b - 1]] * len(written))
            at = b
        text.append(self.text[at:])
        starts.extend(old_starts[at:])
        ends.extend(old_ends[at:])
        self.text, self.starts, self.ends = "".join(text), starts, ends

    def source(self, start: int, end: int) -> Span:
        return (start, end) if self.starts is None else (self.starts[start], self.ends[end - 1])


def _lookalikes(text: str) -> list[tuple[int, int, str]]:
    changes = []
    for m in _ODD.finditer(text):
        c = m.group()
        plain = _LOOKALIKES.get(c)
        if plain is None:
            plain = unicodedata.normalize("NFKC", c)
            digit = unicodedata.digit(c, None)
            plain = plain if plain != c and plain.isascii() else None if digit is None else str(digit)
        if plain is not None:
            changes.append((*m.span(), plain))
    return changes


def _spelled(text: str) -> list[tuple[int, int, str]]:
    changes = []
    for run in _SPELLED.finditer(text):
        names = list(_NAME.finditer(text, *run.span()))
        for name, after in zip(names, [*names[1:], None]):
            # what separates two names goes with the first of them
            upto = after.start() if after else name.end()
            changes.append((name.start(), upto, str(_NAMES.index(name.group().lower()))))
    return changes


def _single(text: str, sides: int) -> list[tuple[int, int, str]]:
    changes = []
    for m in _SINGLE.finditer(text):
        before, name = _BEFORE.search(text[max(0, m.start() - 4) : m.start()]), m.group().lower()
        if name in _NAMES and bool(before) + bool(_AFTER.match(text, m.end())) >= sides:
            changes.append((*m.span(), str(_NAMES.index(name))))
    return changes


def _disguises(text: str) -> list[tuple[int, int, str]]:
    changes = [(*m.span(), _SIGN[next(filter(None, m.groups())).lower()]) for m in _BRACKETED.finditer(text)]
    return changes


def _worded(text: str, pattern: re.Pattern) -> list[tuple[int, int, str]]:
    return [(*w.span(), _SIGN[w.group(1).lower()]) for m in pattern.finditer(text) for w in _WORD.finditer(text, *m.span())]


def _digits(text: str) -> Tape:
    """The text after look-alikes and runs of spelled digits."""
    tape = Tape(text)
    if not text.isascii():
        tape.rewrite(_lookalikes(tape.text))
    if _PERHAPS_SPELLED.search(tape.text.lower()):
        tape.rewrite(_spelled(tape.text))
    return tape


def _signs(tape: Tape) -> Tape:
    """Written-out signs as well."""
    lower = tape.text.lower()
    if "plus" in lower:
        tape.rewrite([(*m.span(), "+") for m in _PLUS.finditer(tape.text)])
    if "dot" in lower or "at" in lower:
        if "(" in lower or "[" in lower or "{" in lower or "<" in lower:
            tape.rewrite(_disguises(tape.text))
        for pattern in (_WORDED, _WORDED_IP) if _PERHAPS_WORDED.search(lower) else ():
            tape.rewrite(_worded(tape.text, pattern))
    return tape


def readings(text: str) -> Iterator[Tape]:
    """The text after all transducers: single spelled digits left as they are, read between digits, and read next to digits.

    A word such as the ``one`` in ``1111 one of them`` would spoil a number, so no reading takes the place of another.
    """
    yield _signs(_digits(text))
    if _PERHAPS_SINGLE.search(_digits(text).text.lower()):
        read: list = []
        for sides in (2, 1):
            tape = _digits(text)
            changes = _single(tape.text, sides)
            if changes and changes != read:
                tape.rewrite(changes)
                yield _signs(tape)
            read = changes


def normalised(text: str) -> Tape:
    """The text after all transducers, single spelled digits left as they are."""
    return next(readings(text))


def find(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans, and all spans."""
    base = spans = detect(text)
    for tape in readings(text):
        if tape.starts is None:
            continue
        ends = {kind: [b for _, b, k in spans if k == kind] for kind in KINDS}
        starts = {kind: [a for a, _, k in spans if k == kind] for kind in KINDS}
        added = []
        for a, b, kind in detect(tape.text):
            start, end = tape.source(a, b)
            after = bisect_right(ends[kind], start)  # the first span of the kind that ends later
            if after == len(starts[kind]) or starts[kind][after] >= end:
                added.append((start, end, kind))
        spans = sorted(spans + added, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
    return base, spans


def find_personal_data(docs: DataFrame) -> DataFrame:
    """Per row ``doc_id``, ``base`` and ``spans``: arrays of (kind, start, end) in code points, end exclusive."""
    span = "array<struct<kind:string,start:bigint,end:bigint>>"
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [find(t.as_py()) for t in batch.column("text")]
            columns = [pa.array([[{"kind": k, "start": a, "end": b} for a, b, k in p[n]] for p in pairs], kind) for n in (0, 1)]
            yield pa.record_batch([batch.column("doc_id"), *columns], names=["doc_id", "base", "spans"])

    return texts_of(docs).mapInArrow(run, f"doc_id bigint, base {span}, spans {span}")
