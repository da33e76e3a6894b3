"""Toxicity by a chain of linear classifiers.

The categories are predicted one after the other; each later model gets the
probabilities of the earlier ones as features.  While training these are
out-of-fold predictions, so that a later model sees them as good or bad as they
will be.  Features are the presence of the words most telling of a category and
a few figures of the whole text.  Models are fitted on the driver from a bounded
sample of labelled documents (``sample_rows`` for each value of a label); every
document is then scored over its whole text.

Defined results: a null text is the empty text; a document with a null label is
not learned from for that category; a category with one value only gives that
value's rate to all; repeated rows are scored one by one; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bramble.llm.words import MARKS, chunks, lower_latin, string_buffers, words

#: Words kept for each category.
VOCABULARY = 500
#: Documents that a word must be in, of the sample.
LEAST_DOCUMENTS = 4
FOLDS = 5
_FIGURES = 6


def _texts(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first text, word hashes, first word of each text, figures of each text) by chunks."""
    body, at = string_buffers(column)
    for a, b in chunks(at):
        lo = int(at[a])
        text, cut = body[lo : at[b]], at[a : b + 1] - lo
        hashes, starts, ends, first = words(lower_latin(text), cut, fold=False, between=MARKS)
        sums = [np.concatenate(([0], np.cumsum(x)))[cut] for x in ((text >= 0x41) & (text <= 0x5A), (text >= 0x30) & (text <= 0x39), MARKS[text] & (text > 0x20), text == 0x0A)]
        size, count = np.maximum(np.diff(cut), 1), np.diff(first)
        figures = [*(np.diff(s) / size for s in sums), np.log1p(count) / 10.0, np.diff(cut) / np.maximum(count, 1) / 20.0]
        yield a, hashes, first, np.stack(figures, axis=1).astype(np.float32)


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-4, steps: int = 250) -> np.ndarray:
    """Weights (the last one the bias) of a class-balanced logistic regression, by accelerated gradient descent."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    weight = np.where(y, 0.5 / max(y.sum(), 1), 0.5 / max((~y).sum(), 1)).astype(np.float32)
    target = y.astype(np.float32)
    v = np.ones(x.shape[1], np.float32)
    for _ in range(12):  # the largest curvature, by power iteration
        v = x.T @ (weight * (x @ (v / np.linalg.norm(v))))
    step = 3.6 / max(float(np.linalg.norm(v)), 1e-6)
    w = ahead = np.zeros(x.shape[1], np.float32)
    for k in range(steps):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ ahead, -30, 30)))
        new = ahead - step * (x.T @ (weight * (p - target)) + penalty * ahead)
        ahead, w = new + (k / (k + 3.0)) * (new - w), new
    return w.astype(np.float32)


def _probability(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


def best_threshold(p: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The probability from which on flagging gives the best F1 over weighted rows."""
    order = np.argsort(-p, kind="stable")
    p, hit = p[order], np.cumsum((weight * y)[order])
    flagged = np.cumsum(weight[order])
    f1 = 2 * hit / (flagged + (weight * y).sum())
    f1[:-1][p[:-1] == p[1:]] = 0.0
    k = int(f1.argmax())
    below = p[k + 1] if k + 1 < len(p) else 0.0
    return float(np.clip((p[k] + below) / 2, 0.05, 0.99))


class ChainModel:
    """One linear model a category, in order; each sees the probabilities of those before it."""

    def __init__(self, bags: list[np.ndarray], figures: np.ndarray, labels: np.ndarray, categories: Sequence[str], weight: np.ndarray) -> None:
        """labels: a row a document, a column a category, NaN where unknown; weight: rows that each stands for."""
        self.thresholds: list[float] = []
        self.categories = list(categories)
        self.vocabulary = self._telling(bags, labels)
        x = np.hstack([self._presence(bags), figures])
        fold = np.arange(len(bags)) % FOLDS
        self.models: list[np.ndarray | float] = []
        for c in range(len(self.categories)):
            known = ~np.isnan(labels[:, c])
            y = labels[:, c] == 1
            if len(set(y[known])) < 2:
                rate = float(y[known].mean()) if known.any() else 0.0
                self.models.append(rate)
                self.thresholds.append(0.5)
                x = np.hstack([x, np.full((len(x), 1), rate, np.float32)])
                continue
            unseen = np.zeros(len(x), np.float32)
            for k in range(FOLDS):
                rows = known & (fold != k)
                unseen[fold == k] = _probability(x[fold == k], logistic(x[rows], y[rows])) if len(set(y[rows])) == 2 else y[rows].mean() if rows.any() else 0.0
            self.models.append(logistic(x[known], y[known]))
            self.thresholds.append(best_threshold(unseen[known], y[known], weight[known]))
            x = np.hstack([x, unseen[:, None]])

    def _telling(self, bags: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
        """The sorted hashes of the words most telling of each category."""
        if not bags:
            return np.zeros(0, np.uint64)
        every, place, counts = np.unique(np.concatenate(bags), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
        chosen = np.zeros(len(every), bool)
        for c in range(labels.shape[1]):
            known, y = ~np.isnan(labels[:, c]), labels[:, c] == 1
            yes = np.bincount(place[y[owner]], minlength=len(every))
            no = np.bincount(place[(known & ~y)[owner]], minlength=len(every))
            p, q = (yes + 0.5) / (y.sum() + 1), (no + 0.5) / ((known & ~y).sum() + 1)
            spread = np.sqrt(p * (1 - p).clip(1e-9) / (y.sum() + 1) + q * (1 - q).clip(1e-9) / ((known & ~y).sum() + 1))
            score = np.where(counts >= LEAST_DOCUMENTS, np.abs(p - q) / spread, 0.0)
            order = np.lexsort((every, -score))[:VOCABULARY]
            chosen[order[score[order] > 2.0]] = True
        return every[chosen]

    def _presence(self, bags: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(bags), len(self.vocabulary)), np.float32)
        for i, bag in enumerate(bags):
            out[i, self._places(bag)] = 1.0
        return out

    def _places(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.vocabulary) or not len(hashes):
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return at[self.vocabulary[at] == hashes]

    def predict(self, hashes: np.ndarray, first: np.ndarray, figures: np.ndarray) -> np.ndarray:
        """Probabilities, a row a text and a column a category."""
        n, size = len(figures), len(self.vocabulary)
        tail = figures
        out = np.zeros((n, len(self.categories)), np.float32)
        text = np.repeat(np.arange(n), np.diff(first))
        if size and len(hashes):
            at = np.minimum(np.searchsorted(self.vocabulary, hashes), size - 1)
            hit = self.vocabulary[at] == hashes
            pairs = np.unique(text[hit] * size + at[hit])
        else:
            pairs = np.zeros(0, np.int64)
        for c, w in enumerate(self.models):
            if isinstance(w, float):
                out[:, c] = w
            else:
                margin = np.bincount(pairs // max(size, 1), weights=w[pairs % max(size, 1)], minlength=n) if len(pairs) else np.zeros(n)
                out[:, c] = 1.0 / (1.0 + np.exp(-np.clip(margin + tail @ w[size:-1] + w[-1], -30, 30)))
            tail = np.hstack([tail, out[:, c : c + 1]])
        return out


def fit_toxicity(docs: DataFrame, labels: DataFrame, categories: Sequence[str] = ("quality", "toxic"), id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 1500) -> ChainModel:
    """A chain from about sample_rows labelled documents for each combination of labels."""
    names = [f"`{c}`" for c in categories]
    marks = labels.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), *[F.col(c).cast("double").alias(f"y{i}") for i, c in enumerate(names)]).where(F.col("doc_id").isNotNull())
    ys = [f"y{i}" for i in range(len(categories))]
    chosen, share = F.lit(False), F.lit(1.0)
    for r in marks.groupBy(*ys).count().collect():  # at most 3 ** categories rows
        same = F.lit(True)
        for y in ys:
            same = same & F.col(y).eqNullSafe(F.lit(r[y]))
        share = F.when(same, F.lit(max(1.0, r["count"] / sample_rows))).otherwise(share)
        chosen = chosen | (same & (F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(1 << 30)) <= int((1 << 30) * min(1.0, sample_rows / r["count"]))))
    sample = marks.where(chosen).withColumn("stands_for", share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, hashes, first, figures in _texts(batch.column("text")):
                n = len(figures)
                bags = [np.unique(hashes[first[i] : first[i + 1]]).tobytes() for i in range(n)]
                marked = pa.array([list(x) for x in zip(*(batch.column(y).slice(a, n).to_pylist() for y in ys), strict=True)], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, n), marked, pa.array(bags, pa.binary()), pa.array([f.tobytes() for f in figures], pa.binary()), batch.column("stands_for").slice(a, n)], names=["doc_id", "y", "bag", "figures", "stands_for"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id")
    got = sorted(rows.mapInArrow(run, "doc_id long, y array<double>, bag binary, figures binary, stands_for double").collect(), key=lambda r: (r["doc_id"], r["bag"], str(r["y"])))
    bags = [np.frombuffer(r["bag"], np.uint64) for r in got]
    figures = np.frombuffer(b"".join(r["figures"] for r in got), np.float32).reshape(len(got), _FIGURES)
    y = np.array([[np.nan if v is None else v for v in r["y"]] for r in got], float).reshape(len(got), len(categories))
    return ChainModel(bags, figures, y, categories, np.array([r["stands_for"] for r in got], float))


def score_toxicity(docs: DataFrame, model: ChainModel, flag: str = "toxic", threshold: float | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, p_<category> of each category, and whether that of flag reaches the threshold.

    Without one, the threshold is that of the best F1 over the out-of-fold predictions.
    """
    names = [f"p_{c}" for c in model.categories]
    ddl = "doc_id long, " + ", ".join(f"`{n}` double" for n in names) + f", `{flag}` boolean"
    place = model.categories.index(flag)
    threshold = model.thresholds[place] if threshold is None else threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, hashes, first, figures in _texts(batch.column("text")):
                p = model.predict(hashes, first, figures).astype(np.float64)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, len(p)), *(pa.array(c) for c in p.T), pa.array(p[:, place] >= threshold)], names=["doc_id", *names, flag])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, ddl)
