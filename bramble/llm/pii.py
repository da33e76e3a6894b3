"""Personal data: patterns propose spans, checksums confirm them, context adjusts the score.

Base kinds (email, ip, card, phone) always stay once confirmed; further kinds
(iban by mod 97, ssn and passport numbers by their form) stay when their score, raised by
context words close by, reaches a threshold.

Defined results: a null text is the empty text, without spans; every row, also a
repeated one, gives one row; an empty table gives an empty result; other columns
are not read.  Offsets count code points.  Texts are never cut, and every
pattern runs in time linear in the text.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

from bramble.llm.spans import find_spans

BASE_KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = ("iban", "ssn", "passport")
KINDS = BASE_KINDS + MORE_KINDS
#: Code points on either side in which context words count.
CONTEXT = 48
LEAST_SCORE = 0.5

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# A match never starts within a run of digits: what precedes it would have taken the run.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# The head is looked ahead from, so that a rejected run does not swallow an IBAN within it.
_IBAN = re.compile(r"(?<![A-Za-z0-9])(?=([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}))[A-Z]{2}[0-9]{2}")
_ALNUM = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
#: Country -> characters of its IBAN.
_IBAN_LENGTHS = {
    c: n
    for n, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
        23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
        29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for c in countries.split()
}
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
# Six to nine capitals and digits, four digits at least: C01X00T47, 123456789, AB1234567.
_PASSPORT = re.compile(r"(?<![A-Za-z0-9])(?=(?:[A-Z]*[0-9]){4})[A-Z0-9]{6,9}(?![A-Za-z0-9])")
_WORD = re.compile(r"[^\W\d_]+")
_DIGITS = {c: int(c) for c in "0123456789"}

#: Kind -> (score of a confirmed match, words that raise it).
_SCORES = {
    "email": (0.9, frozenset({"mail", "email", "contact", "write"})),
    "ip": (0.6, frozenset({"ip", "host", "server", "address"})),
    "card": (0.7, frozenset({"card", "visa", "mastercard", "credit", "payment"})),
    "phone": (0.6, frozenset({"phone", "tel", "call", "mobile", "fax"})),
    "iban": (0.8, frozenset({"iban", "bank", "account", "transfer"})),
    "ssn": (0.3, frozenset({"ssn", "social", "security"})),
    "passport": (0.3, frozenset({"passport", "passeport", "reisepass", "pasaporte", "passaporto"})),
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = _DIGITS[c] * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def mod97(text: str) -> bool:
    """The check of an IBAN: country and check digits last, letters as 10 to 35."""
    rest = 0
    for c in text[4:] + text[:4]:
        for d in str(int(c, 36)):
            rest = (rest * 10 + int(d)) % 97
    return rest == 1


def _emails(text: str) -> list[tuple[int, int]]:
    """What [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+ finds, from each @ outwards."""
    out, past, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > past and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            past = found.end()
            out.append((start, past))
        at = text.find("@", max(at + 1, past))
    return out


def _ibans(text: str) -> list[tuple[int, int]]:
    """IBANs of their country's length; of a country outside the table, the longest that ends with a word and passes."""
    out, past = [], 0
    for m in _IBAN.finditer(text):
        start, run = m.start(), m[1]
        if start < past:
            continue
        length = _IBAN_LENGTHS.get(run[:2])
        for n in range(len(run), 14, -1):
            if text[start + n : start + n + 1] in _ALNUM or run[n - 1] == " ":
                continue
            plain = run[:n].replace(" ", "")
            if len(plain) >= 15 and (length is None or len(plain) == length) and mod97(plain):
                past = start + n
                out.append((start, past))
                break
    return out


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or "0") <= 255


def _digits(text: str) -> str:
    return "".join(c for c in text if c in _DIGITS)


def _proposed(text: str):
    """(kind, start, end) of what the checksums confirm."""
    for a, b in _emails(text):
        yield "email", a, b
    for m in _IP.finditer(text):
        if all(map(_small, m[0].split("."))):
            yield "ip", *m.span()
    for m in _CARD.finditer(text):
        if 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            yield "card", *m.span()
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                yield "phone", *m.span()
    for a, b in _ibans(text):
        yield "iban", a, b
    for m in _SSN.finditer(text):
        yield "ssn", *m.span()
    small = text.lower()
    if any(cue in small for cue in _SCORES["passport"][1]):  # without one no number reaches the threshold
        for m in _PASSPORT.finditer(text):
            yield "passport", *m.span()


def personal_spans(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) of one text."""
    out = []
    for kind, a, b in _proposed(text):
        score, cues = _SCORES[kind]
        near = text[max(0, a - CONTEXT) : a] + " " + text[b : b + CONTEXT]
        if cues & {w.lower() for w in _WORD.findall(near)}:
            score = min(1.0, score + 0.3)
        if kind in BASE_KINDS or score >= LEAST_SCORE:
            out.append((kind, a, b, score))
    return out


def _find(texts: pa.Array) -> list[list[tuple]]:
    return [personal_spans(t) for t in texts.to_pylist()]


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans (kind, start, end, score) of the personal data of each text."""
    return find_spans(docs, _find, id_col, text_col)
