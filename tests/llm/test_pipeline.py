"""The pipeline's stages against brute force, row by row, on the smallest tables with repeated and null ids added."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from bramble.llm import decontaminate, language
from bramble.llm.decontaminate import align
from tests.llm.test_language import plain_features
from tests.llm.test_mixing import targets_of
from tests.llm.test_set_join import brute

SF = "/root/testdata/sf0.001"
LAST = 1 << 63


def place(row):
    """Order of the rows of a group: ids first, the smallest one first."""
    return (row.doc_id is None, row.doc_id or 0)


def recognised(rows, model):
    def known(text):
        if not any(map(str.isalpha, text or "")):
            return False
        return len(text.encode()) < language.LEAST_BYTES or float((model.profiles @ plain_features(text)).max()) >= model.floor

    return [r for r in rows if known(r.text)]


def exact(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", r.text or "")].append(r)
    return [min(g, key=lambda r: (-len(r.text or ""), place(r))) for g in groups.values()]


def near(rows):
    group = {i: c for i, _, c in brute([(i, r.text) for i, r in enumerate(rows)], 5, 80)}
    members = defaultdict(list)
    for i, r in enumerate(rows):
        members[group[i]].append(r)
    return [min(g, key=place) for g in members.values()]


def clean(rows, items):
    """Rows that no alignment of a whole item with the whole text scores as a copy."""
    numbers: dict[str, int] = {}
    coded = lambda t: np.array([numbers.setdefault(w, len(numbers)) for w in re.findall(r"[^\W_]+", (t or "").lower())])
    items = [x for x in map(coded, items) if len(x)]

    def copied(text):
        words = coded(text)
        for item in items:
            least = 2 * max(decontaminate.LEAST_SCORE * len(item), min(decontaminate.LEAST_WORDS, len(item)))
            if 2 * np.isin(item, words).sum() >= least and align(item, words) >= least:
                return True
        return False

    return [r for r in rows if not copied(r.text)]


@pytest.fixture(scope="module")
def documents(spark):
    """The smallest documents; other texts under ids that are there, copies and near copies without an id, other scripts."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.orderBy("doc_id").collect()
    kinds = {f.name: f.dataType for f in docs.schema}
    more = [
        (rows[0].doc_id, rows[1].text + "!"), (rows[0].doc_id, "Another text under one id, and not a short one either."), (rows[2].doc_id, rows[2].text), (rows[3].doc_id, (rows[3].text or "") + " "),
        (None, rows[4].text), (None, rows[4].text), (None, "Only here, without an id, twice in all."), (None, "Only  here, without an id, twice in all."), (None, (rows[5].text or "") + " end"),
        (None, "Привет, как дела, сегодня хорошая погода"), (None, None), (rows[6].doc_id, "今日はとても良い天気ですね"), (rows[7].doc_id, "!!! 12345"),
    ]
    extra = spark.createDataFrame([tuple({"doc_id": i, "text": t, "source": "extra", "lang": None}.get(c) for c in kinds) for i, t in more], docs.schema)
    return docs.unionByName(extra)


def test_stages(spark, documents, tmp_path):
    columns = documents.columns
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    frame, rows = documents, documents.collect()
    model = language.fit_language_model(documents)
    expected = [lambda x: recognised(x, model), exact, near, lambda x: clean(x, items)]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, frame, SF)
        out.write.parquet(f"{tmp_path}/{k}")
        frame = spark.read.parquet(f"{tmp_path}/{k}")
        got = frame.collect()
        if k < 4:
            assert out.columns == columns
            want = expected[k](rows)
            assert Counter((r.doc_id, r.text) for r in got) == Counter((r.doc_id, r.text) for r in want), name
            assert len(got) < len(rows), name  # every stage has work to do
        else:
            assert out.columns == [*columns, "copies"]
            check_copies(got, rows)
        rows = got


def check_copies(got, rows):
    """Targets are met to within the shortest document that could still be taken; no row is taken more than three times."""
    size = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    whole, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        whole[r.source] += size(r)
    for r in got:
        taken[r.source] += r.copies * size(r)
        assert 1 <= r.copies <= 3
    assert not Counter((r.doc_id, r.text) for r in got) - Counter((r.doc_id, r.text) for r in rows)
    target = targets_of(whole)
    for source in whole:
        left = [size(r) for r in rows if r.source == source and size(r)]
        assert target[source] - max(left) <= taken[source] <= target[source] + 0.5, source


def test_run_is_the_stages_in_turn(spark):
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, SF)
    again = corpus_pipeline.run(spark, SF)
    assert Counter(map(tuple, again.collect())) == Counter(map(tuple, frame.collect()))


def test_awkward_rows_and_empty_tables(spark, small_tables, empty_tables, tmp_path):
    """Nulls, repeated rows, clashing columns and a long text pass through every stage; empty tables stay empty."""
    spark.createDataFrame([(1, "mail a b c org 4111 1111 1111"), (2, None)], "item_id long, text string").write.parquet(f"{small_tables}/benchmark.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{empty_tables}/benchmark.parquet")
    docs = spark.read.parquet(f"{small_tables}/documents.parquet")
    left = [{1, 2, 3, 7, 8, 9, 10, None}, {1, 7, 8, 9, 10, None}, {1, 7, 8, 9, 10, None}, {1, 7, 9, 10, None}]
    for (name, stage), want in zip(corpus_pipeline.STAGES, left):
        out = stage(spark, docs, small_tables)
        assert out.columns == docs.columns, name
        assert {r.doc_id for r in out.collect()} == want, name
        path = f"{tmp_path}/{name.replace(' ', '_')}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, small_tables)
    assert mixed.columns == [*docs.columns, "copies"]
    assert {r.doc_id for r in mixed.collect()} <= left[-1]
    assert corpus_pipeline.run(spark, empty_tables).count() == 0


def test_last_stage_on_repeated_and_null_ids(spark):
    rows = [(1, "a b c", "x", 7), (1, "a b c", "x", 7), (None, "d e", "y", 7), (None, "f g h i", "y", 7), (2, "j", None, 7), (1, "k l", "x", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copies int")
    out = corpus_pipeline.STAGES[-1][1](spark, docs, "")
    assert out.columns == ["doc_id", "text", "source", "copies"]
    check_copies(out.collect(), docs.collect())
