"""Secret scans behind a trigram inverted index.

A Boolean trigram query is derived from the parse tree of each rule's regular
expression.  Each block of texts gets an inverted index (trigram -> texts), the
queries' postings are intersected and united, and only the candidates are
verified with the regular expression.  A rule whose query is empty (no mandatory
trigram, such as a run of hex digits) scans every text in full.  The index folds
A-Z to a-z, so a case-insensitive rule keeps its trigrams.

Defined results: a null text is the empty text, without spans; every row, also a
repeated one, gives one row; an empty table gives an empty result; other columns
are not read.  Offsets count code points.  Texts are never cut.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from re import _constants as sre
from re import _parser as sre_parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from bramble.llm.spans import find_spans
from bramble.llm.words import chunks, string_buffers

#: Alternatives that the derivation keeps apart before it gives up on exact strings.
MOST_STRINGS = 64


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    accept: Callable[[re.Match], bool] = bool


def _letters(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_KEY = "|".join([*map(_letters, ("password", "passwd", "secret", "token")), _letters("api") + "_?" + _letters("key")])

BASE_RULES = (
    Rule("assign", rf"({_KEY})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[2]) >= 12),
    Rule("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18),
    # The maximal runs of [0-9a-f]+ that are long enough are the matches of this one.
    Rule("hex", r"[0-9a-f]{16,}"),
)
#: Rules beyond the base.
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"sk_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("key_block", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
RULES = BASE_RULES + MORE_RULES

# A query is True (anything), or ("and" | "or", queries), or a trigram as bytes.


def _both(kind: str, parts: list) -> object:
    if kind == "and":
        parts = [p for p in parts if p is not True]
        return True if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))
    return True if not parts or any(p is True for p in parts) else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _of_strings(strings: set[str]) -> object:
    """Any of the strings, each by all its trigrams; one that asks for more than another adds nothing."""
    held = {s: {s[i : i + 3] for i in range(len(s) - 2)} for s in strings}
    least = [s for s in sorted(strings, key=lambda s: (len(held[s]), s)) if held[s]]
    if len(least) < len(strings):
        return True
    kept: list[str] = []
    for s in least:
        if not any(held[k] <= held[s] for k in kept):
            kept.append(s)
    return _both("or", [_both("and", [s[i : i + 3].encode() for i in range(len(s) - 2)]) for s in kept])


def _class(items) -> set[str] | None:
    """The strings of a character class, folded, if they are few ASCII letters."""
    out: set[str] = set()
    for op, arg in items:
        if op is sre.LITERAL and arg < 128:
            out.add(chr(arg).lower())
        elif op is sre.RANGE and arg[1] < 128 and arg[1] - arg[0] < 8:
            out |= {chr(c).lower() for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return out if len(out) <= 8 else None


def _walk(tree) -> tuple[set[str] | None, object]:
    """(all strings that the tree matches, or None if they are not few; its query)."""
    exact: set[str] | None = {""}
    queries = []

    def flush() -> None:
        nonlocal exact
        if exact is not None:
            queries.append(_of_strings(exact))
        exact = None

    whole = True
    for op, arg in tree:
        query: object = True
        strings: set[str] | None = None
        if op is sre.LITERAL and arg < 128:
            strings = {chr(arg).lower()}
        elif op is sre.IN:
            strings = _class(arg)
        elif op is sre.SUBPATTERN:
            strings, query = _walk(arg[3])
        elif op is sre.BRANCH:
            parts = [_walk(x) for x in arg[1]]
            strings = set().union(*(s for s, _ in parts)) if all(s is not None for s, _ in parts) else None
            query = _both("or", [q for _, q in parts])
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
            least, most, body = arg
            inner, inner_query = _walk(body)
            if inner is not None and (least, most) == (0, 1):
                strings = inner | {""}
            elif least >= 1:
                query = inner_query
        elif op is sre.AT:
            strings = {""}
        if strings is not None and exact is not None and len(strings) * len(exact) <= MOST_STRINGS:
            exact = {a + b for a in exact for b in strings}
            continue
        flush()
        whole = False
        if strings is not None and len(strings) <= MOST_STRINGS:
            exact = strings
        else:
            queries.append(query)
            exact = {""}
    if whole:
        return exact, _of_strings(exact or {""})
    flush()
    return None, _both("and", queries)


def trigram_query(pattern: str) -> object:
    """The Boolean trigram query that every match of the pattern satisfies; True if there is none."""
    return _walk(sre_parser.parse(pattern))[1]


def _trigrams(query: object) -> set[bytes]:
    return set() if query is True else {query} if isinstance(query, bytes) else set().union(*map(_trigrams, query[1]))


class TrigramScanner:
    """The rules with their queries; one index a block of texts."""

    def __init__(self, rules: tuple[Rule, ...] = RULES) -> None:
        self.rules = [(r, re.compile(r.pattern), trigram_query(r.pattern)) for r in rules]
        self.trigrams = sorted(set().union(*(_trigrams(q) for _, _, q in self.rules)))
        self.place = np.zeros(1 << 24, np.uint16)
        for i, t in enumerate(self.trigrams):
            self.place[int.from_bytes(t, "big")] = i + 1
        self.fold = np.arange(256, dtype=np.uint32)
        self.fold[0x41:0x5B] += 32

    def postings(self, body: np.ndarray, at: np.ndarray) -> dict[bytes, np.ndarray]:
        """trigram -> which of the texts body[at[i]:at[i+1]] hold it."""
        b = self.fold[body[at[0] : at[-1]]]
        found = self.place[(b[:-2] << 16) | (b[1:-1] << 8) | b[2:]] if len(b) > 2 else np.zeros(0, np.uint16)
        where = np.flatnonzero(found)
        text = np.searchsorted(at, where + at[0], side="right") - 1
        held = np.zeros((len(self.trigrams) + 1, len(at) - 1), bool)
        held[found[where], text] = True
        return {t: held[i + 1] for i, t in enumerate(self.trigrams)}

    def _candidates(self, query: object, lists: dict[bytes, np.ndarray], n: int) -> np.ndarray:
        if query is True:
            return np.ones(n, bool)
        if isinstance(query, bytes):
            return lists[query]
        fold = np.logical_and if query[0] == "and" else np.logical_or
        return fold.reduce([self._candidates(q, lists, n) for q in query[1]])

    def __call__(self, texts: pa.Array) -> list[list[tuple]]:
        body, at = string_buffers(texts)
        out: list[list[tuple]] = [[] for _ in range(len(texts))]
        for a, b in chunks(at):
            lists = self.postings(body, at[a : b + 1])
            wanted = np.array([self._candidates(q, lists, b - a) for _, _, q in self.rules])
            for i in np.flatnonzero(wanted.any(axis=0)):
                text = texts[a + int(i)].as_py()
                for (rule, pattern, _), yes in zip(self.rules, wanted[:, i], strict=True):
                    if yes:
                        out[a + i] += [(rule.kind, m.start(), m.end(), 1.0) for m in pattern.finditer(text) if rule.accept(m)]
        return out


_SCANNERS: dict[tuple, TrigramScanner] = {}


def _find(texts: pa.Array) -> list[list[tuple]]:
    """With the module's rules; the scanner is built once a worker."""
    if RULES not in _SCANNERS:
        _SCANNERS[RULES] = TrigramScanner(RULES)
    return _SCANNERS[RULES](texts)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans (kind, start, end, score) of the secrets of each text."""
    return find_spans(docs, _find, id_col, text_col)
