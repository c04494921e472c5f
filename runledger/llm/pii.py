"""Personal data in plain and in disguised form, with offsets into the source text.

Plain identifiers are found in the text as it stands. The text then passes a chain of transducers: homoglyphs and
invisible characters, bracketed at and dot, runs of numerals, spoken at and dot. Each rewrites what it finds and
carries, for every character, the source span it came from; identifiers found in the rewritten text are mapped
back. A mapped span is added only if rewriting touched it and it does not lie within a plain span of its kind, so
texts without disguises get plain spans only. It may overlap a plain span: of a disguised identifier that span
often covers a part only. Every transducer reads a text once, whatever it holds: runs are matched whole, without
going back, and an address is looked for around each at only.

Defined cases: null text counts as empty; ill-formed UTF-8 is replaced by U+FFFD first; offsets are code
points, end exclusive; a null doc_id and repeated rows are rows like others; an empty table gives an empty
result; other columns are never read.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .store import text_rows

KINDS = ("email", "ip", "card", "phone")

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A digit run that fails at its first digit fails at all its digits; the look-behind saves those attempts.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")


def emails(text: str) -> list[tuple[int, int]]:
    """A match holds one @, the first after its start; so each @ is tried once, with the longest local part left of it."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def _card(m: re.Match) -> bool:
    digits = m[0].replace(" ", "").replace("-", "")
    return 13 <= len(digits) <= 19 and luhn(digits)


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def plain_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans by kind, then start."""
    out = [("email", *s) for s in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(map(_octet, m.groups()))]
        out += [("card", *m.span()) for m in _CARD.finditer(text) if m.end() - m.start() >= 13 and _card(m)]
        if "+" in text:
            out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m[0])) <= 15]
    return out


# Letters of other scripts that look like ASCII letters.
_LOOKS = dict(
    zip(
        "аеорсухіѕјԁԛԝһӏАВЕКМНОРСТУХІЅЈԌαοορνικυτρχεΑΒΕΖΗΙΚΜΝΟΡΤΥΧ",
        "aeopcyxisjdqwhlABEKMHOPCTYXISJGaooovikutpxeABEZHIKMNOPTYX",
        strict=True,
    )
)
_LOOKS |= {"ρ": "p", "ν": "v", "ł": "l", "ı": "i", "ɑ": "a", "ɡ": "g", "•": ".", "․": ".", "。": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-"}
_INVISIBLE = "­​‌‍⁠﻿"
_SPACES = "    "
_STRANGE = re.compile(f"[{''.join(map(re.escape, _LOOKS))}{_INVISIBLE}{_SPACES}٠-٩۰-۹०-९①-⓿！-～\U0001d400-\U0001d7ff]")

_DIGITS = {w: str(i) for i, w in enumerate("zero one two three four five six seven eight nine".split())} | {"oh": "0"}
_WRITTEN = "|".join(_DIGITS)
_WORDS = re.compile(rf"\b(?:{_WRITTEN})\b", re.I)
_DOTS = "dot|punto|punkt|point"
_OPEN, _SHUT = r"\x20?[\[({<]\x20?", r"\x20?[\])}>]\x20?"
_MARKED = re.compile(rf"{_OPEN}(?:(?P<at>at|@|arroba|ät)|dot|\.|punto|point|punkt){_SHUT}", re.I)
# Numerals and what may stand between two of them; a run is matched whole.
_NUMERAL = rf"(?:{_WRITTEN}|[0-9]++)"
_BETWEEN = rf"(?:\x20++(?:dot|point)\x20++|[\x20\t]?[-,.][\x20\t]?|[\x20\t]|\x20?[()]\x20?)"
_RUN = re.compile(rf"(?:\bplus[\x20-]|\+\x20?)?\b{_NUMERAL}\b(?:{_BETWEEN}{_NUMERAL}\b)++", re.I)
_NUMERALS = re.compile(_NUMERAL, re.I)
_SPOKEN_DOT = re.compile(r"\x20(?:dot|point)\x20", re.I)
_AT = re.compile(r"\x20at\x20|@", re.I)
_HOST = re.compile(rf"[A-Za-z0-9-]++(?:(?:\.|\x20(?:{_DOTS})\x20)[A-Za-z0-9-]++)++", re.I)
_ANY_DOT = re.compile(rf"\.|\x20(?:{_DOTS})\x20", re.I)
_LAST_DOT = tuple(f" {d} " for d in _DOTS.split("|"))


class Traced:
    """A text with the source span of each of its characters, and whether rewriting made it."""

    def __init__(self, text: str):
        self.text, self.made = text, np.zeros(len(text), bool)
        self.start = np.arange(len(text))
        self.end = self.start + 1

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace text[a:b] by new for each (a, b, new), in order and apart from one another."""
        parts, start, end, made, at = [], [], [], [], 0
        for a, b, new in edits:
            parts += [self.text[at:a], new]
            n = len(new)
            start += [self.start[at:a], np.full(n, self.start[a])]
            end += [self.end[at:a], np.full(n, self.end[b - 1])]
            touched = self.made[at:a]
            if not n and a > at:  # a span that crosses the gap counts as touched
                touched = touched.copy()
                touched[-1] = True
            made += [touched, np.ones(n, bool)]
            at = b
        if edits:
            self.text = "".join([*parts, self.text[at:]])
            self.start, self.end, self.made = (np.concatenate([*x, y[at:]]) for x, y in ((start, self.start), (end, self.end), (made, self.made)))


def _look(m: re.Match) -> str:
    c = m[0]
    if c in _LOOKS:
        return _LOOKS[c]
    if c in _INVISIBLE:
        return ""
    if c in _SPACES:
        return " "
    plain = unicodedata.normalize("NFKC", c)
    if plain.isascii():
        return plain
    return str(unicodedata.digit(c)) if unicodedata.digit(c, None) is not None else c


def _strange(t: Traced):
    return [(*m.span(), new) for m in _STRANGE.finditer(t.text) if (new := _look(m)) != m[0]]


def _marked(t: Traced):
    return [(*m.span(), "@" if m["at"] else ".") for m in _MARKED.finditer(t.text)]


def _digits(numerals: list[str]) -> str:
    return "".join(_DIGITS.get(n.lower(), n) for n in numerals)


def _runs(t: Traced):
    """Runs of numerals: groups around dots become an address, three written digits or more a number."""
    out = []
    for m in _RUN.finditer(t.text):
        run, a = m[0], m.start()
        written, spoken = _WORDS.findall(run), _SPOKEN_DOT.search(run)
        if not written and not spoken:
            continue
        numbers = list(_NUMERALS.finditer(run))
        # Groups of numerals with single spaces or hyphens inside; whether a dot, spoken or not, leads to the next one.
        groups, dotted = [[numbers[0]]], []
        for x, y in zip(numbers, numbers[1:], strict=False):
            gap = run[x.end() : y.start()]
            if gap in (" ", "-"):
                groups[-1].append(y)
            else:
                dotted.append(gap.strip().lower() in (".", "dot", "point"))
                groups.append([y])
        values = [_digits([n[0] for n in g]) for g in groups]
        i, found = 0, []
        while i + 4 <= len(groups):
            if all(dotted[i : i + 3]) and all(map(_octet, values[i : i + 4])):
                found.append((a + groups[i][0].start(), a + groups[i + 3][-1].end(), ".".join(values[i : i + 4])))
                i += 4
            else:
                i += 1
        if found:
            out += [e for e in found if t.text[e[0] : e[1]] != e[2]]
        elif len(written) >= 3:
            out.append((*m.span(), "+" * (run[0] in "+pP") + _digits([n[0] for n in numbers])))
    return out


def _spoken(t: Traced):
    """name at host dot tld: an at counts only beside a dot that is spoken or was rewritten."""
    out, text, done = [], t.text, 0
    for at in _AT.finditer(text):
        a, b = at.span()
        host = _HOST.match(text, b) if a >= done else None
        if not host:
            continue
        dots = [d.span() for d in _ANY_DOT.finditer(text, b, host.end())]
        if not any(t.made[x:y].any() or y - x > 1 for x, y in dots) and not (at[0] != "@" and t.made[b : host.end()].any()):
            continue
        start, pieces = a, []
        while start > done:
            if text[start - 1] in _LOCAL:
                start -= 1
            elif (gap := next((g for g in _LAST_DOT if text[max(done, start - len(g)) : start].lower() == g), None)) and start - len(gap) > done and text[start - len(gap) - 1] in _LOCAL:
                pieces.append((start - len(gap), start, "."))
                start -= len(gap)
            else:
                break
        if start == a:
            continue
        pieces = pieces[::-1] + [(a, b, "@")] * (at[0] != "@") + [(x, y, ".") for x, y in dots if y - x > 1]
        out += pieces
        done = host.end()
    return out


def _may_hold(text: str) -> bool:
    """Whether a transducer could change the text: a superset, by plain searches."""
    if not text.isascii() and _STRANGE.search(text):
        return True
    low = text.lower()
    if any(c in low for c in "[({<") and _MARKED.search(text):
        return True
    if any(f" {d} " in low for d in _DOTS.split("|")):
        return True
    return any(w in low for w in _DIGITS) and _WORDS.search(text) is not None


def disguised_spans(text: str, plain: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return rewritten_spans(text, plain) if _may_hold(text) else []


def rewritten_spans(text: str, plain: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    t = Traced(text)
    for edits in (_strange, _marked, _runs, _spoken):
        t.rewrite(edits(t))
    if not t.made.any():
        return []
    out, touched = [], np.concatenate([[0], np.cumsum(t.made)])
    spans = {k: [(x, y) for kind, x, y in plain if kind == k] for k in KINDS}
    for kind, a, b in plain_spans(t.text):
        if touched[b] > touched[a]:
            s, e = int(t.start[a]), int(t.end[b - 1])
            near = spans[kind]
            i = bisect_right(near, (s, len(text) + 1)) - 1  # plain spans of a kind are apart and in order
            if i < 0 or near[i][1] < e:
                out.append((kind, s, e))
    return out


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())])


def _scan(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(_SPAN))])
    for batch in batches:
        found = []
        for text in batch.column(1):
            text = text.as_py().decode("utf-8", "replace")
            plain = plain_spans(text)
            all_spans = [(*s, True) for s in plain] + [(*s, False) for s in disguised_spans(text, plain)]
            found.append([dict(zip(("kind", "start", "end", "base"), s, strict=True)) for s in sorted(all_spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(_SPAN))], schema=schema)


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id and spans (kind, start, end, base: found in the text as it stands), by kind and start."""
    return text_rows(docs, id_col, text_col).mapInArrow(_scan, "doc_id long, spans array<struct<kind:string,start:int,end:int,base:boolean>>")
