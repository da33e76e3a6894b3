"""Decontamination: alignment against a plain dynamic program, and planted copies, exact and edited."""

import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from bramble.llm import decontaminate as decontamination
from bramble.llm.decontaminate import GAP, LEAST_SCORE, LEAST_WORDS, MATCH, MISMATCH, align, decontaminate, find_contamination


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=12), st.lists(st.integers(0, 4), min_size=1, max_size=15))
def test_align(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (MATCH if a[i - 1] == b[j - 1] else MISMATCH), h[i - 1][j] + GAP, h[i][j - 1] + GAP)
    assert align(np.array(a), np.array(b)) == max(map(max, h))


def planted():
    r = random.Random(4)
    vocabulary = ["".join(r.choice("abcdefghijklmno") for _ in range(r.randint(2, 7))) for _ in range(2000)]
    prose = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [(i, prose(r.randint(15, 60))) for i in range(20)]
    docs, dirty = [], set()
    for d in range(300):
        text = prose(r.randint(0, 400))
        if d % 5 == 0:
            i, item = items[r.randrange(20)]
            copy = [w for w in item]
            if d % 10 == 0:  # edited: every seventh word or so changed, dropped or doubled
                copy = [x for w in item for x in (([r.choice(vocabulary)], [], [w, w])[r.randrange(3)] if r.random() < 0.12 else [w])]
            at = r.randint(0, len(text))
            text[at:at] = [copy[0].capitalize(), *copy[1:-1], copy[-1] + "."] if copy else []
            dirty.add((d, i))
        docs.append((d, " ".join(text)))
    return [(i, " ".join(t)) for i, t in items], docs, dirty


def test_planted_copies(spark):
    items, docs, dirty = planted()
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    table = spark.createDataFrame(docs, "doc_id long, text string")
    found = {(r.doc_id, r.item_id) for r in find_contamination(table, benchmark).collect()}
    assert found == dirty
    left = {r.doc_id for r in decontaminate(table, benchmark).collect()}
    assert left == {d for d, _ in docs} - {d for d, _ in dirty}


def test_evenly_edited_copies(spark):
    """One word in six or seven replaced: most 4-grams of the item are gone, beside exact copies or without them."""
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefghijklmno") for _ in range(r.randint(3, 8)))
    items = [(i, [word() for _ in range(r.randint(15, 59))]) for i in range(60)]
    docs = []
    for i, item in items:
        spots = {int(k * 20 / 3) for k in range(len(item))}
        docs.append((i, " ".join(word() if k in spots else w for k, w in enumerate(item))))
        docs += [(1000 + 10 * i + k, " ".join(item)) for k in range(3) if i % 2]
    benchmark = spark.createDataFrame([(i, " ".join(t)) for i, t in items], "item_id long, text string")
    found = {(x.doc_id, x.item_id) for x in find_contamination(spark.createDataFrame(docs, "doc_id long, text string"), benchmark).collect()}
    assert found == {(d, d if d < 1000 else (d - 1000) // 10) for d, _ in docs}


def test_texts_of_many_pairs(monkeypatch):
    """Hits are expanded a few at a time, texts whole, with the same result."""
    rows = [(i, " ".join(f"w{i}x{k % 5}" if k % 3 else "same" for k in range(20)) + " one common line of words") for i in range(12)]
    items = decontamination.Items.of(rows)
    _, hashes, first = next(decontamination._hashed(pa.array([t for _, t in rows] + ["one common line of words", "", "x " * 9 + rows[3][1]])))
    want = sorted(decontamination._matches(items, hashes, first))
    assert {(t, i) for t, i, _ in want} == {*((i, i) for i in range(12)), (14, 3)}
    for few in (1, 7, 100):
        monkeypatch.setattr(decontamination, "PAIRS", few)
        assert sorted(decontamination._matches(items, hashes, first)) == want


def test_short_items_and_scripts_without_spaces(spark):
    """Items of one to three words, and of Han or Thai, are found inside longer documents; words of Latin or Hangul stay whole."""
    items = [(1, "zebra"), (2, "blue Heron"), (3, "one two three"), (4, "今天天气很好我们去公园散步吧"), (5, "ภาษาไทยง่ายมาก"), (6, "é"), (7, "한국"), (8, "𠀀𠀁")]
    docs = [
        (1, "There was a zebra, then a blue heron."), (2, "blue as a heron; zebras"), (3, "Count one two three four"), (4, "one two and three"),
        (5, "他说今天天气很好我们去公园散步吧。然后走了"), (6, "คนพูดภาษาไทยง่ายมากครับ"), (7, "été 한국어"), (8, "看𠀀𠀁x"), (9, "x 한국 é"), (10, ""), (11, None),
    ]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in find_contamination(spark.createDataFrame(docs, "doc_id long, text string"), benchmark).collect()}
    assert found == {(1, 1), (1, 2), (3, 3), (5, 4), (6, 5), (8, 8), (9, 6), (9, 7)}


def test_awkward_rows(spark, small_tables, empty_tables):
    docs = spark.read.parquet(f"{small_tables}/documents.parquet")
    benchmark = spark.createDataFrame([(1, None), (2, ""), (3, "the SAME text"), (4, "mail a b c org 4111 1111 1111 1111 and")], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in find_contamination(docs, benchmark).collect()}
    assert found == {(1, 3), (2, 3), (8, 4)}
    assert decontaminate(docs, benchmark).columns == docs.columns and decontaminate(docs, benchmark).count() == 9
    assert find_contamination(spark.read.parquet(f"{empty_tables}/documents.parquet"), benchmark).count() == 0
    assert find_contamination(docs, benchmark.limit(0)).count() == 0


@pytest.mark.parametrize("words", [10, 15, 24, 40])
@pytest.mark.parametrize("rate", [0.1, 0.2, 0.3])
def test_recall_against_alignment_of_all_pairs(words, rate):
    """Of the pairs that an alignment of every item with every whole document scores as copies, nine in ten are found, and no others."""
    r = random.Random(words * 100 + int(rate * 10))
    vocabulary = [f"w{i}" for i in range(900)]
    prose = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [prose(words) for _ in range(40)]
    docs = []
    for item in items:
        for _ in range(3):
            copy = [x for w in item for x in (([r.choice(vocabulary)], [], [w, r.choice(vocabulary)])[r.randrange(3)] if r.random() < rate else [w])]
            text = prose(r.randint(0, 80))
            at = r.randint(0, len(text))
            docs.append([*text[:at], *copy, *text[at:]])
    number = {w: i + 1 for i, w in enumerate(vocabulary)}
    coded = [np.array([number[w] for w in d]) for d in docs]
    want = set()
    for i, item in enumerate(items):
        sequence = np.array([number[w] for w in item])
        for d, text in enumerate(coded):
            weight = align(sequence, text) if len(text) else 0
            if weight >= MATCH * max(LEAST_SCORE * words, min(LEAST_WORDS, words)):
                want.add((d, i))
    held = decontamination.Items.of([(i, " ".join(t)) for i, t in enumerate(items)])
    got = set()
    for a, hashes, first in decontamination._hashed(pa.array([" ".join(d) for d in docs])):
        got |= {(a + t, held.ids[i]) for t, i, _ in decontamination._matches(held, hashes, first)}
    assert got <= want and len(got) >= 0.9 * len(want) > 0, (len(got), len(want))


def test_short_items_inside_longer_texts(spark):
    items = [(1, "red green blue"), (2, "one"), (3, "Red, GREEN")]
    docs = [(1, "one two red green blue three four"), (2, "green blue red"), (3, "so red green it is"), (4, None), (5, "")]
    rows = find_contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == {(1, 1), (1, 2), (1, 3), (3, 3)}
