"""Personal data behind disguises, reported at source offsets.

Three finite-state rewriters run in turn, each keeping the spans it rewrote: look-alike characters become ASCII and
invisible ones vanish; runs of spelled digits become digits; disguised at and dot become ``@`` and ``.``. Identifiers are
detected in the normalised text and each span is carried back through the rewriters to the characters of the source.

Rows: NULL and empty texts have no findings; overlapping findings are settled by the order of ``DETECTORS``; equal
findings of repeated rows are all reported, one for each row; further columns of any name pass through ``find``.
Texts of any length are scanned whole, in time linear in their length: addresses have the greatest lengths that RFC 5321 allows. An
empty table gives no rows.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FINDINGS = T.ArrayType(
    T.StructType([
        T.StructField("kind", T.StringType()),
        T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
        T.StructField("source_text", T.StringType()),
        T.StructField("value", T.StringType()),
    ]),
    False,
)


class Mapped:
    """A rewritten text and how its offsets relate to those of the text before."""

    def __init__(self, text: str, edits: list[tuple[int, int, str]]) -> None:
        parts: list[str] = []
        self.at: list[int] = []
        self.spans: list[tuple[int, int, int]] = []  # end in the new text; start and end in the old one
        old = new = 0
        for start, end, put in edits:
            parts += (text[old:start], put)
            new += start - old
            self.at.append(new)
            new += len(put)
            self.spans.append((new, start, end))
            old = end
        parts.append(text[old:])
        self.text = "".join(parts) if edits else text

    def back(self, start: int, end: int) -> tuple[int, int]:
        """The span of the text before that became ``[start, end)``; an edit counts whole when it is touched."""
        if not self.at:
            return start, end
        k = bisect_right(self.at, start) - 1
        first = start if k < 0 else self.spans[k][1] if start < self.spans[k][0] else self.spans[k][2] + start - self.spans[k][0]
        k = bisect_right(self.at, end - 1) - 1
        last = end if k < 0 else self.spans[k][2] if end <= self.spans[k][0] else self.spans[k][2] + end - self.spans[k][0]
        return first, max(last, first)


def _look_alikes() -> dict[str, str]:
    """Characters of other scripts and styles that read as ASCII, and invisible characters, which map to nothing."""
    pairs = dict(zip(
        "АВЕКМНОРСТУХаеорсухіјѕԁԛԝһІЈЅ" "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοανικρ" "ɑɡıǀℓ",
        "ABEKMHOPCTYXaeopcyxijsdqwhIJS" "ABEZHIKMNOPTYXoavikp" "agill",
    ))
    for cp in [*range(0xFF01, 0xFF5F), *range(0x1D400, 0x1D800), *range(0x2070, 0x208F), *range(0x2460, 0x2474), *range(0x24B6, 0x24EA)]:
        plain = unicodedata.normalize("NFKC", chr(cp))
        if plain != chr(cp) and len(plain) == 1 and plain.isascii() and plain.isprintable():
            pairs[chr(cp)] = plain
    for cp in range(0x0660, 0x1000):  # decimal digits of other scripts
        if unicodedata.category(chr(cp)) == "Nd":
            pairs[chr(cp)] = str(unicodedata.digit(chr(cp)))
    pairs |= dict.fromkeys("​‌‍⁠﻿­᠎", "")
    pairs |= dict.fromkeys("‐‑‒–—−﹣", "-") | dict.fromkeys("。․﹒｡", ".") | {"﹫": "@"}
    pairs |= dict.fromkeys("      　", " ")
    return pairs


LOOK_ALIKES = _look_alikes()
_look_alike = re.compile("[" + re.escape("".join(LOOK_ALIKES)) + "]+")

DIGITS = {
    word: str(n)
    for n, spelled in enumerate((
        "zero oh cero null", "one uno un eins", "two dos deux zwei", "three tres trois drei", "four cuatro quatre vier",
        "five cinco cinq fünf", "six seis sechs", "seven siete sept sieben", "eight ocho huit acht", "nine nueve neuf neun",
    ))
    for word in spelled.split()
}
_digit = "(?:" + "|".join(sorted(DIGITS, key=len, reverse=True)) + ")"
#: At least three digits in a row, words or figures, one of them a word.
_gap = r"(?:[ \t]*[-.,])?[ \t]*"
_spelled = re.compile(rf"(?<!\w)(?:{_digit}(?!\w){_gap}|\d+{_gap}(?={_digit}(?!\w))){{2,}}(?:{_digit}|\d+)(?!\w)", re.I)
_one = re.compile(rf"{_digit}|\d+", re.I)

#: A match begins at the first of several blanks, so a run of them is scanned once.
_bracket = re.compile(r"(?<!\s)\s*[\[({<]\s*(at|dot|punkt|punto|point|arroba|arobase|@|\.)\s*[\])}>]\s*", re.I)
#: Endings of an address that is written in words; with signs any letters will do.
_TOP = r"(?:com|org|net|edu|gov|mil|int|info|biz|name|dev|app|xyz|online|site|shop|tech|cloud|[a-z]{2})"
_AT, _DOT = r"(?:at|arroba|arobase|@)", r"(?:dot|punkt|punto|point|\.)"
#: An address has at most 64 characters before its sign and 255 after it (RFC 5321), so no more labels than these are read.
_name = rf"(?<![\w.+-])[\w+-]{{1,64}}(?:(?:[ \t]+{_DOT}[ \t]+|\.)[\w+-]{{1,64}}){{0,31}}"
_plain = re.compile(
    rf"{_name}(?:[ \t]+{_AT}[ \t]+|@)[\w-]{{1,63}}(?:(?:[ \t]+{_DOT}[ \t]+|\.)[\w-]{{1,63}}){{0,126}}[ \t]+{_DOT}[ \t]+{_TOP}(?!\w)"
    rf"|(?<![\w.+-])[\w+-]{{1,64}}(?:\.[\w+-]{{1,64}}){{0,31}}[ \t]+(?:arroba|arobase|@)[ \t]+[\w-]{{1,63}}(?:\.[\w-]{{1,63}}){{0,126}}\.[a-z]{{2,}}(?!\w)",
    re.I,
)
_inner = re.compile(rf"[ \t]+(?:({_AT})|{_DOT})[ \t]+", re.I)
#: Without one of these words no plain disguise can match.
_PLAIN_HINTS = (" dot ", " punkt ", " punto ", " point ", " . ", " arroba ", " arobase ", " @ ")
_figure = re.compile(r"\d")


def _may_spell(low: str) -> bool:
    """No for sure, or maybe: in a run of three the middle one is a figure, or a word between blanks, dashes, dots or commas."""
    if _figure.search(low):
        return True
    return not DIGITS.keys().isdisjoint(low.replace("-", " ").replace(",", " ").replace(".", " ").split())


def undisguise(text: str) -> list[Mapped]:
    """The rewriters in turn; the last one's text is the normalised text."""
    edits = [] if text.isascii() or LOOK_ALIKES.keys().isdisjoint(set(text)) else [(m.start() + i, m.start() + i + 1, LOOK_ALIKES[c]) for m in _look_alike.finditer(text) for i, c in enumerate(m[0])]
    chain = [Mapped(text, edits)]
    text = chain[-1].text
    edits = []
    low = text.lower()
    if _may_spell(low):
        for run in _spelled.finditer(text):
            previous = None
            for m in _one.finditer(text, run.start(), run.end()):
                word = DIGITS.get(m[0].lower())
                grouped = word is None and len(m[0]) > 1  # figures that are written as a group stay one
                if previous is not None:
                    between = text[previous[0] : m.start()].strip()
                    edits.append((previous[0], m.start(), between if between in ("-", ".") else " " if grouped or previous[1] else ""))
                if word is not None:
                    edits.append((m.start(), m.end(), word))
                previous = m.end(), grouped
    chain.append(Mapped(text, [e for e in edits if e[0] < e[1]]))
    text = chain[-1].text
    edits = []
    if "(" in text or "[" in text or "{" in text or "<" in text:
        edits = [(m.start(), m.end(), "@" if m[1][0] in "aA@" else ".") for m in _bracket.finditer(text)]
    chain.append(Mapped(text, edits))
    text = chain[-1].text
    edits = []
    low = text.lower().replace("\t", " ")
    if any(hint in low for hint in _PLAIN_HINTS):
        for m in _plain.finditer(text):
            edits += [(x.start(), x.end(), "@" if x[1] else ".") for x in _inner.finditer(text, m.start(), m.end())]
    chain.append(Mapped(text, edits))
    return chain


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _card(value: str) -> bool:
    digits = re.sub(r"\D", "", value)
    return 13 <= len(digits) <= 19 and len(set(digits)) > 1 and luhn(digits)


def _phone(value: str) -> bool:
    return 10 <= len(re.sub(r"\D", "", value)) <= 15


def _iban(value: str) -> bool:
    v = value.replace(" ", "").upper()
    return 15 <= len(v) <= 34 and int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1


#: kind, cheap test of the text, pattern, test of the match
DETECTORS = (
    ("email", re.compile("@"), re.compile(r"(?<![\w.+%-])[^\W_][\w.+%-]*@(?:[^\W_](?:[\w-]*[^\W_])?\.)+[^\W\d_]{2,}(?!\w)"), None),
    ("secret", re.compile(r"[\"']|\d"), re.compile(
        r"(?<!\w)(?:AKIA[0-9A-Z]{16}|ghp_[0-9A-Za-z]{36}|sk-[0-9A-Za-z]{20,}|(?i:[0-9a-f]{40}|[0-9a-f]{64}|[0-9a-f]{32}))(?!\w)"
        r"|(?i:(?<!\w)(?:token|secret|api[_-]?key|password)\s*[=:]\s*)[\"'][^\"'\s]{8,}[\"']"), lambda v: "=" in v or ":" in v or _figure.search(v)),
    ("iban", re.compile(r"\d"), re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?!\w)"), _iban),
    ("card", re.compile(r"\d"), re.compile(r"(?<![\w.-])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){2}[ -]\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5})(?!\w)"), _card),
    ("ip", re.compile(r"\d\.\d"), re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d)"), None),
    ("ssn", re.compile(r"\d-\d"), re.compile(r"(?<![\w-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\w-])"), None),
    ("phone", re.compile(r"\d"), re.compile(
        r"(?<![\w.+-])(?:\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}|\(\d{3}\)[ .-]?\d{3}[ .-]?\d{4}|\d{3}[ .-]?\d{3}[ .-]\d{4}|\d{3}[ .-]\d{7}|\d{10})(?!\w|-\d)"), _phone),
)


def detect(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value) in a normalised text, by position; no two overlap."""
    taken = bytearray(len(text))
    found = []
    for kind, hint, pattern, good in DETECTORS:
        if not hint.search(text):
            continue
        for m in pattern.finditer(text):
            if (good is None or good(m[0])) and taken.find(1, *m.span()) < 0:
                taken[m.start() : m.end()] = b"\1" * (m.end() - m.start())
                found.append((kind, m.start(), m.end(), m[0]))
    return sorted(found, key=lambda f: f[1])


def find_in(text: str | None) -> list[dict]:
    if not text:
        return []
    chain = undisguise(text)
    found = []
    for kind, start, end, value in detect(chain[-1].text):
        for step in reversed(chain):
            start, end = step.back(start, end)
        found.append({"kind": kind, "start": start, "end": end, "source_text": text[start:end], "value": value})
    return found


def find(text: Column) -> Column:
    """array<struct(kind, start, end, source_text, value)>: offsets count the characters of the source text."""
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("source_text", pa.string()), ("value", pa.string())]))

    @F.arrow_udf(FINDINGS)
    def run(column: pa.Array) -> pa.Array:
        return pa.array([find_in(x.as_py()) for x in column], arrow)

    return run(text)


def redact(text: Column) -> Column:
    """The text with each finding replaced by its kind in angle brackets; NULL of NULL."""

    @F.arrow_udf(T.StringType())
    def run(column: pa.Array) -> pa.Array:
        def one(t: str | None) -> str | None:
            for f in reversed(find_in(t)):
                t = f"{t[: f['start']]}<{f['kind']}>{t[f['end'] :]}"
            return t

        return pa.array([one(x.as_py()) for x in column], pa.string())

    return run(text)


def findings(docs: DataFrame) -> DataFrame:
    """One row for each finding: doc_id, kind, start, end, source_text, value. No shuffle; texts are read once."""
    return docs.select("doc_id", F.inline(find(F.col("text"))))
