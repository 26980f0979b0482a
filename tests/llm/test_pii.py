import random
import re

import pytest
from awkward import ROWS, documents

from logtel.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def base(text):
    found = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m.group())
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return [(a, b, pii.KINDS[k]) for a, k, b in sorted(found)]


def test_base_equals_the_plain_patterns():
    rng = random.Random(3)
    parts = list("ab.@%+-_ 0123456789()") + ["a@b.c", "1.2.3.4", "+1 ", "4111111111111111", "@", "é", "\n"]
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 50)))
        assert pii.detect(text) == base(text)


@pytest.mark.parametrize(
    "text, hidden, kind",
    [
        ("mail john (at) example (dot) com now", "john (at) example (dot) com", "email"),
        ("john at example dot com", "john at example dot com", "email"),
        ("write to jоhn@exаmple.com please", "jоhn@exаmple.com", "email"),
        ("a＠b．com", "a＠b．com", "email"),
        ("john dot smith [AT] mail [DOT] example [dot] org!", "john dot smith [AT] mail [DOT] example [dot] org", "email"),
        ("call plus one four one five five five five zero one two three", "plus one four one five five five five zero one two three", "phone"),
        ("é ＋1 (017) 555-7713.", "＋1 (017) 555-7713", "phone"),
        ("card four one one one 1111 1111 1111", "four one one one 1111 1111 1111", "card"),
        ("4111​1111​1111​1111", "4111​1111​1111​1111", "card"),
        ("at 10 dot 0 dot 0 dot 1 there", "10 dot 0 dot 0 dot 1", "ip"),
    ],
)
def test_disguises_map_back_to_the_source(text, hidden, kind):
    found, spans = pii.find(text)
    assert found == []
    assert [(text[a:b], k) for a, b, k in spans] == [(hidden, kind)]


def test_base_spans_stay_and_are_not_doubled():
    text = "x (at) y (dot) com, a.b@c.de and jо (dot) a.b@c.de"
    found, spans = pii.find(text)
    assert found == base(text) and set(found) < set(spans)
    assert [text[a:b] for a, b, _ in spans] == ["x (at) y (dot) com", "a.b@c.de", "a.b@c.de"]


def test_ordinary_prose_has_none():
    for text in ("He sat at the table. One two buckle my shoe", "The point at issue, dot and line", "one of five or six at noon", "Привет, мир"):
        assert pii.find(text) == ([], [])


@pytest.mark.parametrize("part", ["a", "1", "1.", "+1 ", "x dot ", "a.a", "one ", "@a", "( ", "1 ", "x at ", "а"])
def test_long_texts_take_linear_time(part):
    pii.find(part * 100_000)


def test_awkward_rows(spark):
    got = pii.find_personal_data(documents(spark)).collect()
    assert [r.doc_id for r in got] == [d for d, _ in ROWS]
    for r, (_, text) in zip(got, ROWS):
        assert [(s.start, s.end, s.kind) for s in r.base] == base(text or "")
    assert pii.find_personal_data(documents(spark, [])).collect() == []


#: Disguises that must not depend on what else a text holds: (text, hidden part, kind).
ALONE = [
    ("write to john at example.com now", "john at example.com", "email"),
    ("john.smith AT mail.example.co.uk.", "john.smith AT mail.example.co.uk", "email"),
    ("john at example dot com", "john at example dot com", "email"),
    ("at 10 dot 0 dot 0 dot 1 there", "10 dot 0 dot 0 dot 1", "ip"),
    ("card 4 one 1 one 1111 1111 1111", "4 one 1 one 1111 1111 1111", "card"),
    ("card 4111 1111 1111 111 one", "4111 1111 1111 111 one", "card"),
    ("card four 111 1111 1111 1111", "four 111 1111 1111 1111", "card"),
    ("host 10.zero.0.1", "10.zero.0.1", "ip"),
    ("call plus one (415) 555-0123", "plus one (415) 555-0123", "phone"),
    ("call +1 four 15 five five 5 zero 123", "+1 four 15 five five 5 zero 123", "phone"),
]
AROUND = ["an anecdote", "someone@example.org", "that cat sat", "one of them", "page 4 one", "1 one", "(", "call one two three", "Ünïcode"]


@pytest.mark.parametrize("text, hidden, kind", ALONE)
def test_disguises_are_found_whatever_else_the_text_holds(text, hidden, kind):
    want = (hidden, kind)
    assert [(text[a:b], k) for a, b, k in pii.find(text)[1]] == [want]
    for other in AROUND:
        for whole in (f"{text}\n\n{other}", f"{other}\n\n{text}", f"{other}; {text}; {other}"):
            base_spans, spans = pii.find(whole)
            assert [(whole[a:b], k) for a, b, k in spans if (a, b, k) not in base_spans] == [want], whole


def test_a_word_behind_a_number_does_not_spoil_it():
    for text in ("4111\u200b1111\u200b1111\u200b1111 one of them", "4 one 1 one 1111 1111 1111 one of them", "four one one one 1111 1111 1111 one"):
        assert [k for _, _, k in pii.find(text)[1]] == ["card"]


@pytest.mark.parametrize("other", ["", " an anecdote", " someone@example.org"])
def test_times_and_amounts_behind_at_are_no_hosts(other):
    for text in ("we meet at 5.30", "we meet at 5.30pm today", "closed at 3.25.", "He sat at the table. One two"):
        base_spans, spans = pii.find(text + other)
        assert spans == base_spans


@pytest.mark.parametrize("part", ["x at a.b ", "x at a.b.", "1 one ", "one 1 ", "x at a dot ", "a.bc", "x at xn--", "x\t \t", "one (1) "])
def test_long_disguises_take_linear_time(part):
    pii.find(part * 100_000)
    pii.find("x at " + part * 100_000)
