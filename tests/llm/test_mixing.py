"""Mixing: targets by brute force, the knapsack by exhaustion, and the limits of the mix."""

from collections import defaultdict
from itertools import product

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from bramble.llm.mixing import apply_mix, bounded_knapsack, fill_targets, fit_lengths, mix_sources
from bramble.llm.queries import QUERIES


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 12), st.integers(1, 3)), min_size=1, max_size=4, unique_by=lambda x: x[0]), st.integers(0, 40))
def test_knapsack(items, budget):
    lengths, counts = [a for a, _ in items], [b for _, b in items]
    taken = bounded_knapsack(lengths, counts, budget)
    assert all(0 <= t <= c for t, c in zip(taken, counts, strict=True))
    best = max(s for n in product(*(range(c + 1) for c in counts)) if (s := sum(a * b for a, b in zip(n, lengths, strict=True))) <= budget)
    assert sum(a * b for a, b in zip(taken, lengths, strict=True)) == best


def test_targets():
    assert fill_targets([10, 10, 10], [1, 2, 3]) == [5, 10, 15]
    assert fill_targets([100, 1, 100], [1, 2, 3]) == [(201 - 3) / 4, 3, (201 - 3) * 3 / 4]
    assert fill_targets([0, 0], [1, 2]) == [0, 0]
    assert sum(fill_targets([7, 1000, 3, 20, 1], [1, 2, 3, 1, 2])) == 1031


def check_mix(rows, docs):
    sizes, got = defaultdict(int), defaultdict(int)
    assert sorted((r.doc_id, r.size) for r in rows if r.doc_id is not None) == sorted((i, len((t or "").split())) for i, t, _ in docs if i is not None)
    for r in rows:
        sizes[r.source] += r.size
        got[r.source] += r.taken
        assert r.taken <= 3 * r.size
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    want = targets_of(sizes)
    most = max(r.size for r in rows)
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
    for s in order:
        assert abs(got[s] - want[s]) <= max(1, min(most, 0.01 * want[s] + 1)), (s, got[s], want[s])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(1, 30)), min_size=1, max_size=8, unique_by=lambda x: x[0]), st.floats(0, 4))
def test_fit(items, times):
    """The fit never exceeds the counts or the target, and falls short of it by less than the shortest document left."""
    lengths, counts = (np.array(x, np.int64) for x in zip(*items, strict=True))
    size = int((lengths * counts).sum())
    target = min(times * size, 3.0 * size)
    whole, extra = fit_lengths(lengths, counts, target)
    assert (extra >= 0).all() and (extra <= counts).all() and 0 <= whole <= 3 and (whole < 3 or not extra.any())
    got = whole * size + int((extra * lengths).sum())
    assert got <= target + 0.5
    left = lengths[(lengths > 0) & (extra < counts)]
    assert whole == 3 or not len(left) or target - got < left.min() + 0.5


def targets_of(sizes):
    """The contract, by hand: shares by weight, at most three times a source's size, the excess reshared."""
    weight = {s: 1 + i % 3 for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in sizes if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: 3 * sizes[s] for s in over}


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = QUERIES["op2_mixing"](spark, sf).collect()
    check_mix(rows, [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()])
    again = QUERIES["op2_mixing"](spark, sf).collect()
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, again), key=str)


def test_awkward_rows(spark, small_tables, empty_tables):
    rows = QUERIES["op2_mixing"](spark, small_tables).collect()
    assert len(rows) == 12 and all(0 <= r.taken <= 3 * r.size for r in rows)
    assert {r.doc_id for r in rows if r.size == 0} == {4, 5, 6}
    assert QUERIES["op2_mixing"](spark, empty_tables).count() == 0


def test_rows_that_share_an_id(spark):
    """One id, or none, on most rows: the mix still meets its targets, row by row, in the query and in the stage."""
    rows = [(7, "a b c", "x")] * 300 + [(None, "d e", "y")] * 200 + [(None, f"f{i} g", "y") for i in range(100)] + [(i, "h " * (i % 5), None) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    mixed = mix_sources(docs).collect()
    check_mix(mixed, rows)
    taken = defaultdict(int)
    for r in mixed:
        taken[r.source, r.size, r.copies] += 1
    got = defaultdict(int)
    for r in apply_mix(docs).collect():
        got[r.source, len(r.text.split()), r.copies] += 1
    assert dict(got) == {k: n for k, n in taken.items() if k[2] > 0}
