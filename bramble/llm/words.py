"""Vectorised word and shingle hashing over Arrow string columns.

Words are maximal runs of bytes outside ``[\\x20\\x09-\\x0D]``; A-Z fold to a-z
and nothing else does.  Every function works on whole texts, in chunks of whole
documents, so its memory is bounded by one chunk or by the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; each takes about 40 bytes of temporaries.
CHUNK_BYTES = 1 << 20

#: The bytes that count as white space.
SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: Everything that is no letter, digit or part of a longer code point parts words too.
MARKS = np.ones(256, dtype=bool)
MARKS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_RNG = np.random.Generator(np.random.PCG64(20240229))
_CODE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_MIX = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def _folding(code: np.ndarray) -> np.ndarray:
    out = code.copy()
    out[0x41:0x5B] = code[0x61:0x7B]
    return out


#: Two independent hashes of words: (codes of bytes, codes with A-Z folded, base).
_HASHES = [(c, _folding(c), b) for c, b in ((_CODE, _BASE), (_RNG.integers(1, 1 << 63, 256, dtype=np.uint64), 0xD1342543DE82EF95))]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """The first n powers of base, kept up to the size of a chunk."""
    if n > CHUNK_BYTES + 1:
        return _powers(base, n)
    if base not in _POWERS:
        _POWERS[base] = _powers(base, CHUNK_BYTES + 1)
    return _POWERS[base][:n]


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return body, at


def chunks(at: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts with at most so many bytes, or of one longer text."""
    first, n = 0, len(at) - 1
    while first < n:
        last = int(np.searchsorted(at, at[first] + most, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def lower_latin(body: np.ndarray) -> np.ndarray:
    """body with A-Z and the capitals of U+00C0 to U+00DE as small letters."""
    out = body.copy()
    capital = np.flatnonzero((body[:-1] == 0xC3) & (body[1:] >= 0x80) & (body[1:] <= 0x9E) & (body[1:] != 0x97)) + 1
    out[capital] += 0x20
    out[(body >= 0x41) & (body <= 0x5A)] += 0x20
    return out


def words(body: np.ndarray, at: np.ndarray, fold: bool = True, between: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, ends, first) of the words of texts body[at[i]:at[i+1]].

    starts and ends are offsets into body; first[i] is the number of words
    before text i, so text i has the words first[i]:first[i+1].  between marks
    the bytes that part words.
    """
    lo, hi = int(at[0]), int(at[-1])
    text = body[lo:hi]
    if not len(text):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, np.zeros(len(at), np.int64)
    inside = ~between[text]
    border = np.zeros(len(text) + 1, dtype=bool)
    border[at - lo] = True
    opens = inside.copy()
    opens[1:] &= ~inside[:-1] | border[1:-1]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:] | border[1:-1]
    starts, ends = np.flatnonzero(opens) + lo, np.flatnonzero(closes) + 1 + lo
    return word_hashes(body, lo, hi, starts, ends, fold), starts, ends, np.searchsorted(starts, at)


def word_hashes(body: np.ndarray, lo: int, hi: int, starts: np.ndarray, ends: np.ndarray, fold: bool = True, which: int = 0) -> np.ndarray:
    """Hashes of the words body[starts:ends] within body[lo:hi]; which chooses one of two independent functions."""
    code, folded, base = _HASHES[which]
    text = body[lo:hi]
    total = np.zeros(len(text) + 1, dtype=np.uint64)
    np.cumsum((folded if fold else code)[text] * powers(base, len(text)), out=total[1:])
    hashes = (total[ends - lo] - total[starts - lo]) * powers(pow(base, -1, 1 << 64), len(text) + 1)[starts - lo]
    return mix(hashes + (ends - starts).astype(np.uint64))


def shingles(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first) of the k-word shingles; a shorter text is one shingle, a text without words has none."""
    counts = np.diff(first)
    n = len(hashes)
    rolled = np.zeros(max(n - k + 1, 0), dtype=np.uint64)
    for j in range(k if n >= k else 0):
        rolled += hashes[j : n - k + 1 + j] * _MIX[j]
    rolled = mix(rolled)
    made = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    out_first = np.zeros(len(first), dtype=np.int64)
    np.cumsum(made, out=out_first[1:])
    owner = np.repeat(np.arange(len(counts)), made)
    place = np.arange(int(out_first[-1])) - out_first[owner] + first[owner]
    out = np.empty(len(place), dtype=np.uint64)
    whole = counts[owner] >= k
    out[whole] = rolled[place[whole]]
    for i in np.flatnonzero(~whole):
        text = owner[i]
        span = hashes[first[text] : first[text + 1]]
        out[i] = mix((span * _MIX[: len(span)]).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(span)))[0]
    return out, out_first


def shingle_sets(column: pa.Array, k: int) -> Iterator[tuple[int, list[np.ndarray], np.ndarray, np.ndarray]]:
    """Yields (index of the first text, sorted distinct shingle hashes of each text, two digests of each set) by chunks.

    The second digest is of an independent hash of the shingles, so that sets
    alike in both are equal to 128 bits.
    """
    body, at = string_buffers(column)
    for a, b in chunks(at):
        cut = at[a : b + 1]
        hashes, starts, ends, first = words(body, cut)
        out, at_text = shingles(hashes, first, k)
        other, _ = shingles(word_hashes(body, int(cut[0]), int(cut[-1]), starts, ends, which=1) if len(starts) else hashes, first, k)
        values = [mix(out ^ np.uint64(_BASE)), mix(other)]
        sums = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(v, dtype=np.uint64))) for v in values]
        digests = [t[at_text[1:]] - t[at_text[:-1]] for t in sums]
        sets = []
        for i, (x, y) in enumerate(zip(at_text[:-1].tolist(), at_text[1:].tolist(), strict=True)):
            found = np.sort(out[x:y])
            if y - x > 1 and (found[1:] == found[:-1]).any():
                found, at_first = np.unique(out[x:y], return_index=True)
                for d, v in zip(digests, values, strict=True):
                    d[i] = v[x:y][at_first].sum(dtype=np.uint64)
            sets.append(found)
        yield a, sets, *map(mix, digests)
