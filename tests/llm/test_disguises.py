"""Disguised personal data: recall, false alarms, the gate before the transducers, and time on long texts."""

import random
import re
import time

import pytest

from runledger.llm import pii


def found(text):
    return [(k, text[a:b]) for k, a, b in pii.disguised_spans(text, pii.plain_spans(text))]


SPELLED = "zero one two three four five six seven eight nine".split()


def spelled(number, between=" "):
    return between.join(SPELLED[int(d)] for d in number)


def disguises():
    """(kind, disguised identifier) of every form the transducers are for."""
    rng = random.Random(2)
    looks = str.maketrans({"a": "\u0430", "o": "\u043e", "e": "\u0435", "c": "\u0441"})
    out = []
    for _ in range(30):
        name, host = rng.choice(["joe", "anna.b", "c_d", "oleg"]), rng.choice(["mail", "shop", "uni-x"])
        for at in (" at ", " [at] ", "(at)", "@", " <AT> ", "{arroba}"):
            for dot in (" dot ", "[.]", " (dot) ", " DOT ", " [punto] "):
                out.append(("email", f"{name}{at}{host}{dot}com"))
        out += [("email", f"{name}@{host}.com".translate(looks)), ("email", f"{name}@{host}\u2024com"), ("email", f"{name}\u200b@{host}.com"), ("email", f"{name}\uff20{host}.com")]
        parts = [str(rng.randrange(256)) for _ in range(4)]
        out += [("ip", rng.choice([" dot ", " point ", "[.]", "(dot)"]).join(parts)), ("ip", " dot ".join(map(spelled, parts))), ("ip", " point ".join(spelled(p, "-") for p in parts))]
        out += [("ip", ".".join(p.translate(str.maketrans("0123456789", "\uff10\uff11\uff12\uff13\uff14\uff15\uff16\uff17\uff18\uff19")) for p in parts))]
        phone = "49" + "".join(rng.choices("0123456789", k=9))
        out += [("phone", "plus " + spelled(phone)), ("phone", "+" + spelled(phone, ", ")), ("phone", f"+{phone[:6]} " + spelled(phone[6:], "-"))]
        card = next(c for c in ("".join(rng.choices("0123456789", k=16)) for _ in range(1000)) if pii.luhn(c))
        out += [("card", spelled(card)), ("card", spelled(card[:8]) + " " + " ".join(card[8:]))]
    return out


def test_recall_on_disguises():
    all_of = disguises()
    hit = 0
    for kind, text in all_of:
        around = f"write to {text}; thanks"
        hit += any(k == kind and text.strip() in span for k, span in found(around))
    assert hit >= 0.97 * len(all_of)


@pytest.mark.parametrize("text", ["the dot com bubble", "look at example.com", "meet at noon", "one two three go", "we are at one point", "a list (at most) of [dot] things", "at 10 point 5 percent", "seven eight nine ten", "f(at) = x", "5 point 1 point 2"])
def test_no_false_alarm(text):
    assert found(text) == []


def test_forms_without_another_trigger():
    assert found("at 192 point 168 point 1 point 10 now") == [("ip", "192 point 168 point 1 point 10")]
    assert found("one point two point three point four") == [("ip", "one point two point three point four")]
    phone = "plus one.two,three.four,five.six,seven.eight,nine.one"
    assert found("call " + phone) == [("phone", phone)]
    card = "four 1 one 1 one 1 one 1 one 1 one 1 one 1 one 1"
    assert found("card " + card) == [("card", card)]


def test_gated_and_ungated_agree():
    rng = random.Random(4)
    parts = ["one", "Two", "oh", "nine", "1", "42", "192", "+", "plus", "dot", "point", "at", "@", "[at]", "(dot)", "<", ")", "mail", "x", "org", "é", "\u0430"]
    gaps = ["", " ", " ", " ", "  ", ".", ",", "-", ", ", " (", ") ", "\t", "\n"]
    seen = 0
    for _ in range(30_000):
        text = "".join(rng.choice(parts) + rng.choice(gaps) for _ in range(rng.randrange(2, 9)))
        t = pii.Traced(text)
        for edits in (pii._strange, pii._marked, pii._runs, pii._spoken):
            t.rewrite(edits(t))
        if t.text != text:
            seen += 1
            assert pii._may_hold(text), text
            assert all(0 <= a < b <= len(text) for a, b in zip(t.start, t.end, strict=True))
        plain = pii.plain_spans(text)
        assert pii.disguised_spans(text, plain) == pii.rewritten_spans(text, plain), text
    assert seen > 5_000


def test_mapped_span_beside_a_plain_part():
    assert found("j\u043ehn@mail.com") == [("email", "j\u043ehn@mail.com")]  # Cyrillic o: the plain span is hn@mail.com
    assert found("+49 30 123456 seven eight nine") == [("phone", "+49 30 123456 seven eight nine")]
    assert found("a.b@c.de\u200b one") == []  # within the plain span


BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def base(text):
    digits = lambda s: re.sub("[^0-9]", "", s)

    def luhn(d):
        total = 0
        for i, c in enumerate(reversed(d)):
            n = int(c) * (1 + i % 2)
            total += n - 9 * (n > 9)
        return total % 10 == 0

    keep = {
        "email": lambda m: True,
        "ip": lambda m: all(int(p) <= 255 for p in m[0].split(".")),
        "card": lambda m: 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0])),
        "phone": lambda m: 9 <= len(digits(m[0])) <= 15,
    }
    return [(k, *m.span()) for k in pii.KINDS for m in BASE[k].finditer(text) if keep[k](m)]


def test_base_spans_are_those_of_the_patterns():
    rng = random.Random(9)
    seen = dict.fromkeys(pii.KINDS, 0)
    for _ in range(40_000):
        letters = rng.choice(["a@.-_%+Z9é ", "0129. ", "0123456789 -", "+(012345) .-", "a@.0129+ -("])
        text = "".join(rng.choices(letters, k=rng.randrange(1, 40)))
        want = base(text)
        assert pii.plain_spans(text) == want, text
        for k, *_ in want:
            seen[k] += 1
    assert min(seen.values()) > 100


def test_empty_repeated_clashing_and_long_rows(spark):
    long = "one " * 100_000 + "joe at mail dot org " + "word " * 50_000
    rows = [(1, "a@b.c", "x", 1), (1, "a@b.c", "x", 1), (None, None, "y", 2), (2, "", "z", 3), (3, long, "w", 4)]
    got = pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string, spans string, t int")).collect()
    spans = sorted(((r.doc_id, [(s.kind, s.start, s.end, s.base) for s in r.spans]) for r in got), key=repr)
    assert spans == sorted([(1, [("email", 0, 5, True)])] * 2 + [(None, []), (2, []), (3, [("email", 400_000, 419_999 - 19_980, False)])], key=repr)
    assert pii.find_personal_data(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("unit", ["one ", "1 ", "a", "1.", "a.", "a at ", "a dot ", "one.", "(", "[at]", "+1 ", "@", "a@b.", "one dot ", "QUJD"])
def test_a_megabyte_takes_seconds(unit):
    text = unit * (1_000_000 // len(unit)) + " dot one"
    start = time.process_time()
    pii.disguised_spans(text, pii.plain_spans(text))
    assert time.process_time() - start < 20
