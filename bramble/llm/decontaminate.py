"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

The test items are a stated query set: their n-grams are held in blocks of a
fixed number, and each block passes over all documents.  Every n-gram of an item
is a seed, also one that many documents hold: which of them an edit leaves in a
copy cannot be told from their document frequencies, and seeds chosen by rarity
lost copies.  Short items have shorter seeds.  The seeds are joined with the passages of each
document in place, without a shuffle; around each run of hits a local alignment
of word sequences scores exact, edited and paraphrased copies alike, unless the
words that item and passage share already bound the score below a copy's.  A
score is the alignment's weight over that of the whole item.

Defined results: words are runs of letters and digits, small letters and
capitals alike, or single code points of a script that puts no space between
words; a null or empty text or item matches nothing; an item shorter than an
n-gram is one n-gram of its own length, found anywhere in a document; repeated
rows are matched one by one; a document is listed once for an item, with its
best score; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bramble.llm.words import MARKS, chunks, lower_latin, shingles, string_buffers, words

#: Words of a seed, and of one of an item shorter than that many words, whose edited copies keep shorter runs.
SEED_WORDS, SHORT_SEED_WORDS, SHORT_ITEM = 4, 3, 24
#: Least score of a copy, and least aligned weight in words.
LEAST_SCORE, LEAST_WORDS = 0.5, 6
#: n-grams of the items held at once (8 bytes each, and the items' words).
BLOCK_GRAMS = 1 << 20
#: Pairs of a hit and an item expanded at once, or those of one text.
PAIRS = 1 << 21
MATCH, MISMATCH, GAP = 2, -1, -1


#: First code points, and those past the last, of scripts without spaces: Thai and Lao, Myanmar, Khmer, kana and bopomofo, Han.
_UNSPACED = ((0x0E00, 0x0F00), (0x1000, 0x10A0), (0x1780, 0x1800), (0x3040, 0x3130), (0x3400, 0x4DC0), (0x4E00, 0xA000), (0xF900, 0xFB00), (0x20000, 0x33480))


def _spaced(body: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """body and offsets with a space on either side of each code point of the scripts without spaces."""
    lead = np.flatnonzero(body >= 0xE0)
    if not len(lead):
        return body, at
    wide = body[lead] >= 0xF0
    rest = [(body[np.minimum(lead + k, len(body) - 1)] & 0x3F).astype(np.int64) for k in (1, 2, 3)]
    point = np.where(wide, ((body[lead].astype(np.int64) & 7) << 18) | (rest[0] << 12) | (rest[1] << 6) | rest[2], ((body[lead].astype(np.int64) & 15) << 12) | (rest[0] << 6) | rest[1])
    hit = np.zeros(len(lead), bool)
    for a, b in _UNSPACED:
        hit |= (point >= a) & (point < b)
    if not hit.any():
        return body, at
    added = np.zeros(len(body) + 1, np.int64)
    added[lead[hit]] += 1
    added[(lead + np.where(wide, 4, 3))[hit]] += 1
    shift = np.cumsum(added)
    out = np.full(len(body) + int(shift[-1]), 0x20, np.uint8)
    out[np.arange(len(body)) + shift[:-1]] = body
    return out, at + shift[at]


def _hashed(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, word hashes, first word of each text) by chunks of whole texts."""
    body, at = string_buffers(column)
    for a, b in chunks(at):
        lo = int(at[a])
        text, cut = _spaced(body[lo : at[b]], at[a : b + 1] - lo)
        hashes, _, _, first = words(lower_latin(text), cut, fold=False, between=MARKS)
        yield a, hashes, first


def seed_words(n: int) -> int:
    """Words of the seeds of an item of n words."""
    return min(n, SHORT_SEED_WORDS if n < SHORT_ITEM else SEED_WORDS)


@dataclass
class Items:
    """A block of test items: their words, and their n-grams with places, sorted by n-gram."""

    ids: list
    words: list[np.ndarray]
    grams: np.ndarray
    item: np.ndarray
    place: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple]) -> Items:
        ids, seqs, grams, item, place = [], [], [], [], []
        for key, text in rows:
            _, hashes, first = next(_hashed(pa.array([text or ""])), (0, np.zeros(0, np.uint64), np.zeros(2, np.int64)))
            if not len(hashes):
                continue
            g, _ = shingles(hashes, first, seed_words(len(hashes)))
            grams.append(g)
            item.append(np.full(len(g), len(ids)))
            place.append(np.arange(len(g)))
            ids.append(key)
            seqs.append(hashes)
        if not ids:
            return cls([], [], np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        all_grams, all_items, all_places = np.concatenate(grams), np.concatenate(item), np.concatenate(place)
        order = np.argsort(all_grams, kind="stable")
        return cls(ids, seqs, all_grams[order], all_items[order], all_places[order])


def align(item: np.ndarray, passage: np.ndarray) -> int:
    """The best local alignment of two word sequences, row by row; gaps along a row by a running maximum."""
    n = len(passage)
    slope = np.arange(n) * GAP
    row, best = np.zeros(n, np.int64), 0
    for word in item:
        diagonal = np.concatenate(([0], row[:-1])) + np.where(passage == word, MATCH, MISMATCH)
        up = np.maximum(np.maximum(diagonal, row + GAP), 0)
        row = np.maximum.accumulate(up - slope) + slope
        best = max(best, int(row.max()))
    return best


def _matches(items: Items, hashes: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, float]]:
    """(text, item, score) of the copies among the texts of a chunk."""
    for k in sorted({seed_words(len(w)) for w in items.words}):  # an item has n-grams of one length
        yield from _seeds(items, hashes, first, *shingles(hashes, first, k))


def _seeds(items: Items, hashes: np.ndarray, first: np.ndarray, grams: np.ndarray, cut: np.ndarray) -> Iterator[tuple[int, int, float]]:
    """The copies around the n-grams of one length; text i has grams[cut[i]:cut[i + 1]]."""
    if not len(grams):
        return
    left = np.searchsorted(items.grams, grams, side="left")
    hit = np.flatnonzero((left < len(items.grams)) & (items.grams[np.minimum(left, len(items.grams) - 1)] == grams))
    if not len(hit):
        return
    right = np.searchsorted(items.grams, grams[hit], side="right")
    times = right - left[hit]
    pairs, owner = np.cumsum(times), np.searchsorted(cut, hit, side="right") - 1
    a = 0
    while a < len(hit):
        b = int(np.searchsorted(pairs, pairs[a] - times[a] + PAIRS, side="right"))
        if b < len(hit):  # back to the border of a text, or on to the end of a longer one
            b = int(np.searchsorted(owner, owner[b], side="left"))
            b = b if b > a else int(np.searchsorted(owner, owner[a], side="right"))
        yield from _aligned(items, hashes, first, cut, hit[a:b], left[hit[a:b]], times[a:b])
        a = b


def _aligned(items: Items, hashes: np.ndarray, first: np.ndarray, cut: np.ndarray, hit: np.ndarray, left: np.ndarray, times: np.ndarray) -> Iterator[tuple[int, int, float]]:
    """The copies around the hits of some texts: n-gram hit[k] is that of items.grams[left[k]] and the times[k] - 1 after it."""
    at = np.repeat(hit, times)
    which = np.repeat(left, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    text = np.searchsorted(cut, at, side="right") - 1
    item, start = items.item[which], at - cut[text] - items.place[which]  # where the item would begin in the text
    order = np.lexsort((start, item, text))
    text, item, start = text[order], item[order], start[order]
    size = np.array([len(w) for w in items.words])[item]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (start[1:] - start[:-1] > size[1:] // 2)
    opens = np.flatnonzero(new)
    best: dict[tuple[int, int], float] = {}
    for a, b in zip(opens, np.append(opens[1:], len(text)), strict=True):
        t, i = int(text[a]), int(item[a])
        if best.get((t, i), 0.0) >= 1.0:
            continue
        seq, doc = items.words[i], hashes[first[t] : first[t + 1]]
        m = len(seq)
        s = int(start[a])
        if 0 <= s <= len(doc) - m and np.array_equal(doc[s : s + m], seq):
            score = 1.0
        else:
            lo, hi = max(0, s - m // 2), min(len(doc), int(start[b - 1]) + m + m // 2)
            least = MATCH * max(LEAST_SCORE * m, min(LEAST_WORDS, m))
            if MATCH * np.isin(seq, doc[lo:hi]).sum() < least:  # no alignment weighs more
                continue
            weight = align(seq, doc[lo:hi])
            score = weight / (MATCH * m) if weight >= least else 0.0
        if score >= LEAST_SCORE:
            best[t, i] = max(best.get((t, i), 0.0), score)
    for (t, i), score in best.items():
        yield t, i, score


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple]]:
    """The items in blocks of at most BLOCK_GRAMS words (or one longer item), in order of the id."""
    rows, held = [], 0
    for r in benchmark.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{text_col}`").alias("t")).orderBy("i", "t").toLocalIterator():
        n = len((r["t"] or "").split())
        if rows and held + n > BLOCK_GRAMS:
            yield rows
            rows, held = [], 0
        rows.append((r["i"], r["t"]))
        held += n
    if rows:
        yield rows


def _seeded(benchmark: DataFrame, item_col: str, item_text_col: str) -> Iterator[Items]:
    for rows in _blocks(benchmark, item_col, item_text_col):
        items = Items.of(rows)
        if items.ids:
            yield items


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, item_id, score of each document and item of which it holds a copy."""
    out = docs.sparkSession.createDataFrame([], "doc_id long, item_id long, score double")
    for items in _seeded(benchmark, item_col, item_text_col):

        def run(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column("doc_id")
                for a, hashes, first in _hashed(batch.column("text")):
                    found = list(_matches(items, hashes, first))
                    if found:
                        text, item, score = zip(*found, strict=True)
                        keys = pa.array([items.ids[i] for i in item], pa.int64())
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array([a + t for t in text])), keys, pa.array(score, pa.float64())], names=["doc_id", "item_id", "score"])

        rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
        out = out.unionByName(rows.mapInArrow(run, "doc_id long, item_id long, score double"))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """docs without the documents that hold a copy of an item; whole rows pass through, nothing is shuffled."""
    out = docs
    for items in _seeded(benchmark, item_col, item_text_col):

        def run(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for a, hashes, first in _hashed(batch.column(text_col)):
                    for t, _, _ in _matches(items, hashes, first):
                        keep[a + t] = False
                yield batch.filter(pa.array(keep))

        out = out.mapInArrow(run, docs.schema)
    return out
