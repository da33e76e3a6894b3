"""Language identification by hierarchical discrimination.

A linear classifier on hashed byte n-grams predicts the language family; within
the family, one-versus-one linear support vector machines separate its
languages by vote.  Models are fitted on the driver from a bounded sample of
labelled rows (``sample_rows``, spread evenly over the languages by a hash of
the id); every document is then scored over its whole text.

``reject_unknown`` also drops texts of no learned language.  The hierarchy
predicts each text's language; the text goes if that is ``und``, if the score of
the prediction is below a floor, or, since margins say nothing of n-grams never
seen, if it is too unlike the mean profile of the language predicted.  Floors are
``FLOOR_SHARE`` of the least score and likeness among training rows, each row
predicted by a hierarchy fitted on the half of its language's rows that it is not
in.  A text with fewer than ``LEAST_BYTES`` bytes of letters is too short to tell
and stays.

Defined results: a null text, or one without a letter, is ``und`` with score 0;
a language outside the table of families is a family of its own; without any
labelled row all is ``und``; every row, also a repeated one, gives one row; a
null id is neither learned from nor held out; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bramble.llm.words import chunks, string_buffers

UNKNOWN = "und"
#: Hash buckets of the n-grams of 1 to 3 bytes.
BUCKETS = 2048
#: Texts in one feature matrix.
TEXTS = 512
#: Texts with so many bytes of letters are rejected below that share of the least score or likeness of training texts of so many bytes.
LEAST_BYTES, FLOOR_SHARE = 20, 0.7
#: Language families, fixed values.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "bs", "sl", "mk"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
    "indic": ("hi", "mr", "ne", "bn", "pa", "gu", "ur"),
    "semitic": ("ar", "he", "am"),
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes}


def _features(body: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Row-normalised square roots of n-gram counts of the texts body[at[i]:at[i+1]]."""
    n = len(at) - 1
    text = body[at[0] : at[-1]].astype(np.uint32)
    text[(text >= 0x41) & (text <= 0x5A)] += 32
    owner = np.repeat(np.arange(n, dtype=np.int64), np.diff(at)) * BUCKETS
    counts = np.zeros(n * BUCKETS)
    gram = np.zeros(len(text), np.uint32)
    for k in range(3):
        if len(text) <= k:
            break
        gram = (gram[: len(text) - k] << np.uint32(8)) | text[k:]
        hashed = ((gram * np.uint32(2654435761) + np.uint32(k * 40503)) >> np.uint32(13)) % np.uint32(BUCKETS)
        inside = owner[: len(gram)] == owner[k:]  # n-grams never cross texts
        counts += np.bincount(owner[: len(gram)][inside] + hashed[inside], minlength=n * BUCKETS)
    out = np.sqrt(counts.reshape(n, BUCKETS))
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def features(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(index of the first text, feature matrix) by blocks of whole texts."""
    body, at = string_buffers(column)
    for a, b in chunks(at):
        for first in range(a, b, TEXTS):
            yield first, _features(body, at[first : min(first + TEXTS, b) + 1])


def linear_svm(x: np.ndarray, y: np.ndarray, penalty: float = 1e-4, steps: int = 200) -> np.ndarray:
    """Weights (the last one the bias) of a squared-hinge linear SVM for y in {-1, 1}, by accelerated gradient descent."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(np.float32)
    w = np.zeros(x.shape[1], np.float32)
    ahead, step = w, 1.0 / (4.0 + penalty)
    for k in range(steps):
        slack = np.maximum(0.0, 1.0 - y * (x @ ahead)).astype(np.float32)
        new = ahead - step * (penalty * ahead - 2.0 * (x.T @ (weight * y * slack)))
        ahead, w = new + (k / (k + 3.0)) * (new - w), new
    return w


def mean_profiles(x: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """The unit mean features of each language, in order of its name."""
    means = [x[labels == g].mean(axis=0) for g in sorted(set(labels))]
    return np.stack([m / max(float(np.linalg.norm(m)), 1e-12) for m in means])


class HierarchicalModel:
    """Family by one-versus-rest margins, language within it by one-versus-one votes."""

    #: Least score and likeness of a recognised text; ``set_floors`` raises them.
    least_score = floor = 0.0

    def __init__(self, x: np.ndarray, langs: list[str]) -> None:
        """x: features of the training texts."""
        self.langs = sorted(set(langs))
        family = [_FAMILY.get(g, g) for g in langs]
        self.families = {f: sorted({g for g in langs if _FAMILY.get(g, g) == f}) for f in sorted(set(family))}
        labels, groups = np.array(langs), np.array(family)
        sign = lambda hit: np.where(hit, 1.0, -1.0).astype(np.float32)
        self.of_family = [linear_svm(x, sign(groups == f)) for f in self.families] if len(self.families) > 1 else []
        self.pairs = {}
        for members in self.families.values():
            for a, b in combinations(members, 2):
                rows = (labels == a) | (labels == b)
                self.pairs[a, b] = linear_svm(x[rows], sign(labels[rows] == a))
        self.profiles = mean_profiles(x, labels)

    def set_floors(self, x: np.ndarray, langs: list[str], sizes: np.ndarray) -> None:
        """Floors from the training texts of these sizes in bytes, each predicted by a model of the other half."""
        labels, place = np.array(langs), np.zeros(len(x), int)
        for g in self.langs:
            rows = np.flatnonzero(labels == g)
            place[rows] = np.arange(len(rows))
        scores, likes = [], []
        for side in (place % 2 == 1, place % 2 == 0):  # the first is predicted by a model of all languages
            if side.all():
                continue
            other = HierarchicalModel(x[~side], [g for g, inside in zip(langs, side) if not inside])
            told = side & (sizes >= LEAST_BYTES) & np.isin(labels, other.langs)
            if told.any() and (scores or other.langs == self.langs):  # one without some of them is too sure to set floors alone
                lang, score = other.predict(x[told])
                scores.append(score.min())
                likes.append(other.likeness(x[told], lang).min())
        self.least_score = FLOOR_SHARE * float(min(scores, default=0.0))
        self.floor = FLOOR_SHARE * float(min(likes, default=0.0))

    def likeness(self, x: np.ndarray, lang: np.ndarray | None = None) -> np.ndarray:
        """How like the profile of its language, the one predicted if not given, each row is, from 0 to 1."""
        lang = self.predict(x)[0] if lang is None else lang
        place = {g: i for i, g in enumerate(self.langs)}
        return (x @ self.profiles.T)[np.arange(len(x)), [place[g] for g in lang]]

    def recognised(self, x: np.ndarray) -> np.ndarray:
        """Whether the hierarchy puts each row in a language, surely enough, whose profile it is like."""
        lang, score = self.predict(x)
        return (lang != UNKNOWN) & (score >= self.least_score) & (self.likeness(x, lang) >= self.floor)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(language, score from 0 to 1) of each row."""
        x = np.hstack([x, np.ones((len(x), 1), np.float32)])
        squash = lambda m: 1.0 / (1.0 + np.exp(-3.0 * np.clip(m, -20, 20)))
        names = list(self.families)
        margins = np.stack([x @ w for w in self.of_family], axis=1) if self.of_family else np.ones((len(x), 1))
        family = margins.argmax(axis=1)
        score = squash(margins[np.arange(len(x)), family])
        lang = np.empty(len(x), object)
        for i, name in enumerate(names):
            rows, members = np.flatnonzero(family == i), self.families[name]
            votes, sure = np.zeros((len(rows), len(members))), np.zeros((len(rows), len(members)))
            for (p, a), (q, b) in combinations(enumerate(members), 2):
                m = x[rows] @ self.pairs[a, b]
                votes[:, p] += m > 0
                votes[:, q] += m <= 0
                sure[:, p] += squash(m)
                sure[:, q] += squash(-m)
            best = (votes + sure / (len(members) + 1)).argmax(axis=1)
            lang[rows] = np.array(members, object)[best]
            if len(members) > 1:
                score[rows] *= sure[np.arange(len(rows)), best] / (len(members) - 1)
        return lang, score


def held_out_column(id_col: str = "doc_id"):
    """Whether crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit_language_model(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = 3000, floors: bool = True) -> HierarchicalModel | None:
    """A model from at most about sample_rows labelled rows that are not held out, with floors for ``reject_unknown`` if wanted; None without any."""
    key, lang = F.col(f"`{id_col}`"), F.col(f"`{lang_col}`")
    rows = docs.where(lang.isNotNull() & F.col(f"`{text_col}`").isNotNull() & key.isNotNull() & ~held_out_column(id_col))
    counts = {r["lang"]: r["n"] for r in rows.groupBy(lang.alias("lang")).agg(F.count("*").alias("n")).collect()}  # one row a language
    if not counts:
        return None
    share = max(1, sample_rows // len(counts))
    chosen = F.lit(False)
    for name, n in counts.items():
        chosen = chosen | ((lang == name) & (F.pmod(F.xxhash64(key, F.lit(17)), F.lit(1 << 30)) <= int((1 << 30) * min(1.0, share / n))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, x in features(batch.column("text")):
                yield pa.RecordBatch.from_arrays([batch.column("lang").slice(a, len(x)), batch.column("id").slice(a, len(x)), pa.array([r.tobytes() for r in x], pa.binary()), pc.binary_length(batch.column("text").slice(a, len(x))).cast(pa.int64())], names=["lang", "id", "x", "bytes"])

    sample = rows.where(chosen).select(lang.alias("lang"), key.cast("long").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, "lang string, id long, x binary, bytes long")
    got = sorted(sample.collect(), key=lambda r: (r["id"], r["lang"], r["x"]))
    if not got:
        return None
    x, langs = np.frombuffer(b"".join(r["x"] for r in got), np.float32).reshape(len(got), BUCKETS), [r["lang"] for r in got]
    model = HierarchicalModel(x, langs)
    if floors:
        model.set_floors(x, langs, np.array([r["bytes"] for r in got]))
    return model


def predict_languages(docs: DataFrame, model: HierarchicalModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text")
            for a, x in features(text):
                n = len(x)
                letters = _has_letter(text.slice(a, n))
                lang, score = model.predict(x) if model else (np.full(n, UNKNOWN, object), np.zeros(n))
                lang[~letters], score[~letters] = UNKNOWN, 0.0
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, n), batch.column("held_out").slice(a, n), pa.array(lang, pa.string()), pa.array(score.astype(np.float64))],
                    names=["doc_id", "held_out", "lang_pred", "score"],
                )

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), held_out_column(id_col).alias("held_out"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def _has_letter(text: pa.Array) -> np.ndarray:
    return np.array([t is not None and any(map(str.isalpha, t)) for t in text.to_pylist()], bool)


def _too_short(text: str) -> bool:
    return len("".join(islice(filter(str.isalpha, text), LEAST_BYTES)).encode()) < LEAST_BYTES


def reject_unknown(docs: DataFrame, model: HierarchicalModel | None, text_col: str = "text") -> DataFrame:
    """docs whose language the model recognises, in the same columns; nothing is shuffled.

    Null texts, texts without a letter, and longer ones that the hierarchy puts in
    no learned language, or not surely enough, go.  Without a model only those
    without a letter do.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(text_col)
            keep = np.zeros(batch.num_rows, bool)
            for a, x in features(text):
                part = text.slice(a, len(x))
                known = np.ones(len(x), bool) if model is None else model.recognised(x)
                for i in np.flatnonzero(~known):
                    known[i] = _too_short(part[int(i)].as_py() or "")
                keep[a : a + len(x)] = _has_letter(part) & known
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
