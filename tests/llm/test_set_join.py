"""The set similarity join against brute force over all pairs, with groups that stress its parts."""

import random
import re

import pytest
from pyspark.sql import functions as F

from bramble.llm import set_join
from bramble.llm.components import connected_components
from bramble.llm.queries import QUERIES
from bramble.llm.set_join import drop_near_duplicates, set_similarity_components
from tests.llm.conftest import ROWS


def brute(rows, k, least):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * common >= least * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted((i, len(sets[i]), find(i)) for i in ids)


def corpus(seed, n=260):
    """Near copies at all distances, chains, a shared passage in a third of all, families without a center."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    prose = lambda m: [r.choice(vocabulary) for _ in range(m)]
    passage, base = prose(30), prose(90)
    rows = []
    for i in range(n):
        kind = i % 6
        if kind == 0:
            text = prose(r.randint(0, 60)) + passage + prose(r.randint(0, 40))
        elif kind == 1:
            text = [w if r.random() > r.choice([0.01, 0.02, 0.04]) else r.choice(vocabulary) for w in base]
        elif kind == 2 and rows:
            text = r.choice(rows)[1].split()
            for _ in range(r.randint(0, 3)):
                text.insert(r.randint(0, len(text)), r.choice(vocabulary))
        elif kind == 3 and rows:
            text = r.choice(rows)[1].split()[r.randint(0, 6) :]
        else:
            text = prose(r.choice([0, 1, 3, 4, 5, 20, 80]))
        rows.append((i * 3 % n + 1000 * (i * 3 // n), " ".join(text)))
    return rows


@pytest.mark.parametrize("seed, k, least, common, open_pairs", [(1, 4, 85, 24, 32), (2, 2, 70, 3, 0), (3, 5, 80, 4, 0)])
def test_equals_brute_force(spark, monkeypatch, seed, k, least, common, open_pairs):
    monkeypatch.setattr(set_join, "BLOCK_SETS", 4)
    monkeypatch.setattr(set_join, "OPEN_PAIRS", open_pairs)
    monkeypatch.setattr(set_join, "COMMON", common)
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in set_similarity_components(docs, k, least).collect())
    assert got == brute(rows, k, least)


def test_dealing_in_two_steps(spark, monkeypatch):
    """As with buckets beyond a unit's fan: units of a few tokens, coarse buckets, then fine ones."""
    for name, value in {"FAN": 4, "UNIT_TOKENS": 700, "BUCKET_TOKENS": 300, "COMMON": 5}.items():
        monkeypatch.setattr(set_join, name, value)
    rows = corpus(6)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in set_similarity_components(docs, 3, 75).collect())
    assert got == brute(rows, 3, 75)


def test_awkward_rows(spark, small_tables, empty_tables):
    rows = QUERIES["op1_ngram_jaccard"](spark, small_tables).collect()
    assert len(rows) == 12
    want = brute([(i, t) for i, t, _, _ in ROWS if i is not None], 4, 85)
    assert sorted({(r.doc_id, r.n_shingles, r.component_id) for r in rows if r.doc_id is not None}) == want
    assert [r.component_id for r in rows if r.doc_id is None] == [None]
    assert QUERIES["op1_ngram_jaccard"](spark, empty_tables).count() == 0


def test_repeated_and_null_ids(spark):
    """Rows of different texts under one id are documents of their own; those without an id join components too."""
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(1, "a b c d"), (1, "e f g h"), (2, "e f g h"), (None, long), (None, long), (7, long + " end"), (None, "x y"), (None, "x  y"), (None, None), (5, "E F G H")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in set_similarity_components(docs, 5, 80).collect()), key=str)
    assert got == sorted([(1, 1, 1), (1, 1, 1), (2, 1, 1), (5, 1, 1), (None, 36, 7), (None, 36, 7), (7, 37, 7), (None, 1, None), (None, 1, None), (None, 0, None)], key=str)
    kept = sorted(((r.doc_id, (r.text or "").replace("  ", " ")) for r in drop_near_duplicates(docs).collect()), key=str)
    assert kept == sorted([(1, "a b c d"), (1, "e f g h"), (7, long + " end"), (None, ""), (None, "x y")], key=str)


def test_words_end_at_every_white_space(spark):
    rows = [(1, "a\x0bb\x0cc\rd e"), (2, "A b\tC\nd E"), (3, "a\x1cb c d e"), (4, "a\u00a0b c d e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in set_similarity_components(docs, 4, 85).collect())
    assert got == brute(rows, 4, 85) == [(1, 2, 1), (2, 2, 1), (3, 1, 3), (4, 1, 4)]


def test_overlaps_are_derived_from_the_leader(spark, monkeypatch):
    """Copies of one text at many distances: pairs that a leader's answers leave open get their overlap from them."""
    r = random.Random(4)
    base = [f"b{i}" for i in range(80)]
    rows = [(i, " ".join(w if r.random() > i % 9 / 40 else f"x{r.randrange(60)}" for w in base)) for i in range(150)]
    seen = []
    original = set_join._derive

    def compared(pairs, answers, sets, least):
        """The pairs left open, with a lower threshold too, where many of them link."""
        for bound in (least, 55, 70):
            derived = sorted(map(tuple, original(pairs, answers, sets, bound).collect()))
            assert derived == sorted(map(tuple, set_join._compare(pairs.select("a", "b"), sets, bound).where("linked").select("a", "b").collect()))
            seen.append(len(derived))
        return original(pairs, answers, sets, least)

    monkeypatch.setattr(set_join, "_derive", compared)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((x.doc_id, x.n_shingles, x.component_id) for x in set_similarity_components(docs, 1, 86).collect())
    assert got == brute(rows, 1, 86) and seen[1] > seen[2] > 0, seen


def test_parts_of_a_family_are_led_one_after_another(spark, monkeypatch):
    """Parts whose members link among themselves and not with the family's center: further leaders leave few pairs to expand."""
    r = random.Random(8)
    base, rows = [f"b{i}" for i in range(120)], []
    less = lambda words, n: r.sample(words, len(words) - n)
    for part in range(6):
        own = [w for i, w in enumerate(base) if i % 6 != part]
        rows += [(len(rows) + i, " ".join(x)) for i, x in enumerate({tuple(sorted(less(own, 2))) for _ in range(40)})]
    rows += [(1000 + i, " ".join(x)) for i, x in enumerate({tuple(sorted(less(base, 3))) for _ in range(10)})]
    expanded = dict.fromkeys((1 << 30, 0), 0)
    original = set_join._open_pairs

    def counted(blocks, least):
        expanded[set_join.OPEN_PAIRS] += blocks.agg(F.sum(F.size("x_sets") * F.size("y_sets"))).first()[0] or 0
        return original(blocks, least)

    monkeypatch.setattr(set_join, "_open_pairs", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for limit in (1 << 30, 0):
        monkeypatch.setattr(set_join, "OPEN_PAIRS", limit)
        got = sorted((x.doc_id, x.n_shingles, x.component_id) for x in set_similarity_components(docs, 1, 90).collect())
        assert got == brute(rows, 1, 90)
    assert expanded[0] < expanded[1 << 30] / 2, expanded


def test_drop_keeps_one_of_each(spark):
    rows = corpus(7)
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, size string")
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [i for i, _, c in brute(rows, 5, 80) if i == c]


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (102, 101), (7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in (100, 101, 102)}}
