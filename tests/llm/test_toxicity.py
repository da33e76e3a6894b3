"""Toxicity: the chain's held-out accuracy on planted words, and awkward rows."""

import math
import random
import re

import numpy as np
import pyarrow as pa

from bramble.llm.queries import QUERIES
from bramble.llm.toxicity import FOLDS, ChainModel, _texts, fit_toxicity, logistic, score_toxicity


def corpus(n, seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(n):
        toxic = r.random() < 0.2
        text = [r.choice(words) for _ in range(r.randint(20, 200))]
        for _ in range(r.randint(1, 3) if toxic else 0):
            text.insert(r.randrange(len(text)), r.choice(["vile", "nasty", "Éhonté"]))
        rows.append((i, " ".join(text), int(toxic)))
    return rows


def test_held_out_accuracy(spark):
    train, test = corpus(800, 1), corpus(400, 2)
    ddl = "doc_id long, text string, toxic int"
    docs = spark.createDataFrame(train, ddl)
    model = fit_toxicity(docs.select("doc_id", "text"), docs.selectExpr("doc_id", "toxic", "CAST(doc_id % 2 AS INT) AS quality"))
    got = {r.doc_id: r for r in score_toxicity(spark.createDataFrame(test, ddl), model).collect()}
    wrong = [i for i, _, y in test if got[i].toxic != bool(y)]
    assert len(wrong) <= 4
    assert all(0 <= r.p_quality <= 1 and 0 <= r.p_toxic <= 1 for r in got.values())


def test_awkward_rows(spark, small_tables, empty_tables, tmp_path):
    docs = spark.read.parquet(f"{small_tables}/documents.parquet")
    labels = spark.createDataFrame([(1, None, 0), (7, 1, 1), (10, 0, None), (None, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
    rows = score_toxicity(docs, fit_toxicity(docs, labels)).collect()
    assert len(rows) == 12
    empty = spark.read.parquet(f"{empty_tables}/documents.parquet")
    assert score_toxicity(empty, fit_toxicity(empty, labels.limit(0))).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in QUERIES["op3_toxicity"](spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    clean = [r for r in labels if r.toxic == 0]
    assert len(rows) == 1000 and sum(rows[r.doc_id].toxic for r in clean) <= 0.05 * len(clean)


def plain_figures(text):
    """The figures of a text, counted character by character."""
    data = text.encode()
    words = re.findall(rb"[0-9A-Za-z\x80-\xff]+", data)
    size, count = max(len(data), 1), len(words)
    is_mark = lambda b: b > 0x20 and not (0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80)
    return [
        sum(0x41 <= b <= 0x5A for b in data) / size, sum(0x30 <= b <= 0x39 for b in data) / size, sum(map(is_mark, data)) / size, data.count(b"\n") / size,
        math.log1p(count) / 10, len(data) / max(count, 1) / 20,
    ]


def test_chain_equals_a_plain_reimplementation():
    """Out-of-fold probabilities of each category feed the next; final models and predictions follow, all by loops over rows."""
    rows = corpus(240, 3)
    texts = [t + ("!! Ünd SO\n" if i % 3 == 0 else "") for i, t, _ in rows]
    labels = np.array([[float(i % 3 == 0) if i % 11 else np.nan, float(y)] for i, _, y in rows])
    bags, figures, hashes_of = [], [], []
    for _, hashes, first, numbers in _texts(pa.array(texts)):
        hashes_of += [hashes[first[i] : first[i + 1]] for i in range(len(numbers))]
        figures += list(numbers)
    assert np.allclose(figures, [plain_figures(t) for t in texts], atol=1e-6)
    bags = [np.unique(h) for h in hashes_of]
    model = ChainModel(bags, np.stack(figures), labels, ["quality", "toxic"], np.ones(len(rows)))

    known_words = [int(h) for h in model.vocabulary]
    x = np.array([[float(h in set(bag.tolist())) for h in known_words] + list(f) for bag, f in zip(bags, figures, strict=True)], np.float32)
    sigmoid = lambda row, w: 1 / (1 + math.exp(-max(-30, min(30, float(sum(a * b for a, b in zip(row, w, strict=False))) + float(w[-1])))))
    final = []
    for c in range(2):
        marked = [i for i in range(len(rows)) if not math.isnan(labels[i, c])]
        unseen = np.zeros(len(rows), np.float32)
        for k in range(FOLDS):
            seen = [i for i in marked if i % FOLDS != k]
            w = logistic(x[seen], labels[seen, c] == 1)
            for i in range(k, len(rows), FOLDS):
                unseen[i] = sigmoid(x[i], w[:-1].tolist() + [w[-1]])
        final.append(logistic(x[marked], labels[marked, c] == 1))
        assert np.allclose(final[-1], model.models[c], atol=1e-4)
        x = np.hstack([x, unseen[:, None]])
    got = np.concatenate([model.predict(h, f, n) for _, h, f, n in _texts(pa.array(texts))])
    for i in range(0, len(rows), 7):
        row = list(x[i, :-2])
        for c in range(2):
            row.append(sigmoid(row, final[c]))
            assert abs(row[-1] - got[i, c]) < 1e-3


def test_logistic_is_at_its_minimum():
    """The gradient of the weighted loss, by differences, vanishes at the solution."""
    r = np.random.default_rng(5)
    x = r.normal(size=(60, 3)).astype(np.float32)
    y = x[:, 0] + 0.7 * r.normal(size=60) > 0.2
    w = logistic(x, y, penalty=1e-2, steps=4000).astype(float)
    weight = np.where(y, 0.5 / y.sum(), 0.5 / (~y).sum())

    def loss(w):
        margin = x @ w[:-1] + w[-1]
        return float((weight * np.log1p(np.exp(np.where(y, -margin, margin)))).sum() + 0.5e-2 * (w**2).sum())

    for k in range(4):
        step = np.zeros(4)
        step[k] = 1e-4
        assert abs(loss(w + step) - loss(w - step)) / 2e-4 < 1e-3
