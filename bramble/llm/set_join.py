"""Exact set-similarity join of word n-gram sets, with links as connected components.

Sets that are equal are one set from the start: a class, by two independent
64-bit digests.  The rest follows the two ideas of joins that use relations
between sets.

*Index lists, skipped by blocks.*  A token's order is its document frequency,
rare first, so the prefix of a set holds tokens that few other sets have.  The
frequencies are exact: tokens travel in packed blobs to the bucket of their
range, are counted there, and only postings of tokens that two sets share travel
on, to the group of their document.  A set with fewer shared tokens than an
overlap needs is linked with nothing and leaves here; most sets do, and so do
sets so small that only an equal one could link.  A token that is frequent
within one unit of input is sent once a unit with its count and comes last in
the order, so a passage in a third of all documents makes no hot bucket.  The
inverted lists of the prefix tokens are kept in blocks by size, position and
overlap with the list's leader; pairs of blocks whose bounds cannot reach the
threshold are skipped as a whole.

*Answers from a similar set.*  Each list has a leader, its most central set, and
every set of the list is compared with the leader in full.  Links so found are
components already, and pairs within one need no comparison.  For a pair across
components the answers against the leader bound the overlap,

    |x & y| <= min(|x & L|, |y & L|) + min(|x - L|, |y - L|),

and where the pair may still link, its overlap is derived from the leader's
answer and the tokens in which either set differs from the leader,

    |x & y| = |x & L| - |L - y| + |(L - x) & (L - y)| + |(x - L) & (y - L)|,

without the sets themselves.  Where many pairs are left open, what is outside the
leader's component is led anew.

Each text is read and hashed once; rows are told apart by their place in the
input, so ids may repeat or be null.

Defined results: a null text is the empty text; a text without words has the
empty set and is linked with nothing; a text with fewer words than an n-gram has
its whole sequence as its one element; rows of different texts under one id are
documents of their own; a component is named by its smallest id, null where none
of its documents has one; repeated rows are repeated in the result; an empty
table gives an empty result; other columns are not read.  Shingles are compared
by a 64-bit hash, equal sets by 128 bits.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bramble.llm.common import keep_rows, materialize, release, remove, scratch, shuffle_partitions, stable
from bramble.llm.components import connected_components
from bramble.llm.words import shingle_sets

#: Tokens of a unit of input, of a bucket at most on average, and postings in a row that only passes through.
UNIT_TOKENS, BUCKET_TOKENS, SLICE = 1 << 19, 1 << 20, 1 << 15
#: Buckets that a unit of input is dealt to at once.
FAN = 1 << 13
#: Documents of one unit that make a token a common one, at most; fewer do where there are so many units that a token below it would fill HOT buckets.
COMMON, HOT = 16, 8
#: The frequency of common tokens: after all others.
LAST = np.uint32(1 << 30)
#: Sets in a block of an index list, on average at most.
BLOCK_SETS = 128
#: Open pairs a listed set that are expanded at once, and comparisons for one link beyond which further leaders do not pay.
OPEN_PAIRS, LINKED = 32, 16
#: Bytes of text from which on the shuffle files of a step are worth a garbage collection of the driver.
RELEASED = 64 << 20
#: Tasks that the rows of one class are dealt to.
SALTS = 16
#: Steps of a block's size (to the factor e) and of its overlap with the leader; a block's bounds are as tight as these.
CLASSES = 64
#: Bytes of text for each token, about; it only sets the number of buckets.
TOKEN_BYTES = 6


def _pack(tokens: np.ndarray) -> bytes:
    """Tokens as planes of bytes, high bytes apart, which compress well."""
    return np.ascontiguousarray(tokens.view(np.uint8).reshape(-1, 8).T).tobytes()


def _unpack(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).reshape(-1).view(np.uint64)


def _zip(*columns: np.ndarray) -> bytes:
    """Small columns of integers as one block: their differences, as planes of bytes, compressed."""
    raw = pickle.dumps([(c.dtype.str, np.ascontiguousarray(np.diff(c, prepend=c.dtype.type(0)).view(np.uint8).reshape(len(c), -1).T).tobytes()) for c in columns])
    return len(raw).to_bytes(4, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unzip(data: bytes) -> list[np.ndarray]:
    out = []
    for kind, body in pickle.loads(pa.decompress(data[4:], int.from_bytes(data[:4], "little"), codec="zstd", asbytes=True)):
        width = np.dtype(kind).itemsize
        out.append(np.cumsum(np.ascontiguousarray(np.frombuffer(body, np.uint8).reshape(width, -1).T).view(kind).reshape(-1), dtype=kind))
    return out


_BLOB_DDL = "bucket int, kind int, head binary, tokens binary"
_GROUP_DDL = "kind int, part int, head binary, tokens binary"
_LIVE_DDL = "id long, n int, shared int, probes int, central double, tokens binary"
_SIGN_DDL = "key long, doc_id long, n long, s1 long, s2 long"
_POSTINGS, _PASSED, _COMMON, _SIGNS = 0, 1, 2, 3
#: Blocks are compressed as they are made; a codec of Parquet would take its buffers outside the heap.
_PLAIN = {"compression": "none", "parquet.enable.dictionary": "false"}


def _runs(owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first of each run of equal values, lengths)."""
    first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1]))) if len(owner) else np.zeros(0, np.int64)
    return first, np.diff(np.append(first, len(owner)))


def _blobs(k: int, buckets: int, least: int, often: int):
    """Texts by units: the postings of their sets, packed by bucket, and the signature of each text."""

    def flush(keys: list, sets: list, signs: list, turn: int) -> pa.RecordBatch:
        rows: list[tuple] = []
        key, doc_id, none, n, s1, s2 = (np.concatenate(c) for c in zip(*signs, strict=True))
        rows.append((int((key[0] + turn * 7919) % buckets), _SIGNS, _zip(key, doc_id, none.astype(np.int8), n), np.concatenate((s1, s2)).tobytes()))
        if sets:
            postings(rows, np.array(keys, np.int64), sets, turn)
        kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in _BLOB_DDL.split(", ")])

    def postings(rows: list[tuple], keys: np.ndarray, sets: list, turn: int) -> None:
        lengths = np.array([len(s) for s in sets], np.int64)
        sizes, tokens = lengths.astype(np.int32), np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), lengths)
        bucket = _bucket(tokens, buckets)
        order = np.argsort(tokens, kind="stable")
        first, count = _runs(tokens[order])
        common = np.zeros(len(tokens), bool)
        common[order] = np.repeat(count >= often, count)

        def add(where: int, kind: int, owner: np.ndarray, tokens: np.ndarray) -> None:
            start, runs = _runs(owner)
            who = owner[start]
            rows.append((where, kind, _zip(keys[who], sizes[who], runs.astype(np.int32)), _pack(tokens)))

        rare = np.flatnonzero(~common)
        rare = rare[np.argsort(bucket[rare], kind="stable")]
        start, runs = _runs(bucket[rare])
        for a, m in zip(start, runs, strict=True):
            part = rare[a : a + m]
            add(int(bucket[part[0]]), _POSTINGS, owner[part], tokens[part])
        if common.any():
            kinds = tokens[order][first[count >= often]]
            where = _bucket(kinds, buckets)
            start, runs = _runs(where)
            for a, m in zip(start, runs, strict=True):
                rows.append((int(where[a]), _COMMON, b"", _pack(kinds[a : a + m])))
            held = np.flatnonzero(common)
            for i, a in enumerate(range(0, len(held), SLICE)):
                part = held[a : a + SLICE]
                add(int((keys[0] + turn * 7919 + i * 104729) % buckets), _PASSED, owner[part], tokens[part])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sets, signs, seen, held, turn = [], [], [], set(), 0, 0
        key = TaskContext.get().partitionId() << 40
        for batch in batches:
            ids = batch.column("doc_id")
            for a, found, s1, s2 in shingle_sets(batch.column("text"), k):
                n = np.array([len(s) for s in found], np.int64)
                part = ids.slice(a, len(found))
                signs.append((np.arange(key, key + len(found)), part.fill_null(0).to_numpy(), part.is_null().to_numpy(zero_copy_only=False), n, s1, s2))
                for i in np.flatnonzero((n > 0) & (n * (100 - least) >= least)).tolist():  # a smaller set links only with its equal
                    sign = (int(n[i]), int(s1[i]), int(s2[i]))
                    if sign not in seen:  # once a unit; the first row of a class in all is the first of its unit
                        seen.add(sign)
                        keys.append(key + i)
                        sets.append(found[i])
                        held += len(found[i])
                key += len(found)
                if held >= UNIT_TOKENS:
                    yield flush(keys, sets, signs, turn)
                    keys, sets, signs, seen, held, turn = [], [], [], set(), 0, turn + 1
        if signs:
            yield flush(keys, sets, signs, turn)

    return run


def _bucket(tokens: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each token's range."""
    return ((tokens >> np.uint64(40)).astype(np.int64) * buckets) >> 24


def _dealt_again(coarse: int, buckets: int):
    """Blobs of one coarse bucket, those of many units together, dealt to the buckets within its range."""
    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    names = [c.split()[0] for c in _BLOB_DDL.split(", ")]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def flush(held: list[tuple]) -> pa.RecordBatch:
        docs, sizes, tokens = (np.concatenate(c) for c in zip(*held, strict=True))
        bucket = _bucket(tokens, buckets)
        order = np.lexsort((docs, bucket))
        docs, sizes, tokens, bucket = docs[order], sizes[order], tokens[order], bucket[order]
        rows = []
        for a, m in zip(*_runs(bucket), strict=True):
            start, runs = _runs(docs[a : a + m])
            rows.append((int(bucket[a]), _POSTINGS, _zip(docs[a : a + m][start], sizes[a : a + m][start], runs.astype(np.int32)), _pack(tokens[a : a + m])))
        return batch(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, turn = [], 0, 0
        for part in batches:
            rows = []
            for row in part.to_pylist():
                if row["kind"] == _POSTINGS:
                    (docs, sizes, times), tokens = _unzip(row["head"]), _unpack(row["tokens"])
                    held.append((np.repeat(docs, times), np.repeat(sizes, times), tokens))
                    count += len(tokens)
                elif row["kind"] == _COMMON:
                    tokens = np.sort(_unpack(row["tokens"]))
                    bucket = _bucket(tokens, buckets)
                    rows += [(int(bucket[a]), _COMMON, b"", _pack(tokens[a : a + m])) for a, m in zip(*_runs(bucket), strict=True)]
                else:  # anywhere will do
                    rows.append(((row["bucket"] * buckets + turn * 7919) // coarse % buckets, row["kind"], row["head"], row["tokens"]))
                    turn += 1
                if count >= UNIT_TOKENS:
                    yield flush(held)
                    held, count = [], 0
            if rows:
                yield batch(rows)
        if held:
            yield flush(held)

    return run


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for head, tokens in zip(batch.column("head").to_pylist(), batch.column("tokens").to_pylist(), strict=True):
            (key, doc_id, none, n), (s1, s2) = _unzip(head), np.frombuffer(tokens, np.int64).reshape(2, -1)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(doc_id, mask=none != 0), pa.array(n), pa.array(s1), pa.array(s2)], names=["key", "doc_id", "n", "s1", "s2"])


def _count_bucket(groups: int):
    """Postings of one range of tokens -> those that two documents share, by group of the document."""

    def run(table: pa.Table) -> pa.Table:
        parts: dict[int, list] = {_POSTINGS: [], _PASSED: [], _COMMON: []}
        rows: list[tuple] = []
        for row in table.to_pylist():
            if row["kind"] == _SIGNS:
                rows.append((_SIGNS, 0, row["head"], row["tokens"]))
                continue
            tokens = _unpack(row["tokens"])
            if row["kind"] == _COMMON:
                parts[_COMMON].append(tokens)
            else:
                who, sizes_, times = _unzip(row["head"])
                parts[row["kind"]].append((np.repeat(who, times), np.repeat(sizes_, times), tokens))
        docs, sizes, tokens, freqs = [], [], [], []
        if parts[_POSTINGS]:  # arrays are let go as soon as the next ones are made
            d, s, t = (np.concatenate(x) for x in zip(*parts.pop(_POSTINGS), strict=True))
            order = np.argsort(t, kind="stable")
            t = t[order]
            first, count = _runs(t)
            freq = count.astype(np.uint32)
            if parts[_COMMON]:
                often = np.unique(np.concatenate(parts[_COMMON]))
                at = np.minimum(np.searchsorted(often, t[first]), len(often) - 1)
                freq[often[at] == t[first]] = LAST
            freq = np.repeat(freq, count)
            keep = freq > 1
            order = order[keep]
            docs.append(d[order]), sizes.append(s[order]), tokens.append(t[keep]), freqs.append(freq[keep])
            del d, s, t, order, keep, freq
        for d, s, t in parts.pop(_PASSED):
            docs.append(d), sizes.append(s), tokens.append(t), freqs.append(np.full(len(t), LAST))
        if docs:
            d, s, t, f = map(np.concatenate, (docs, sizes, tokens, freqs))
            del docs, sizes, tokens, freqs
            group = _group(d, groups)
            order = np.lexsort((d, group))
            d, s, t, f, group = d[order], s[order], t[order], f[order], group[order]
            for a, m in zip(*_runs(group), strict=True):
                start, runs = _runs(d[a : a + m])
                rows.append((_POSTINGS, int(group[a]), _zip(d[a : a + m][start], s[a : a + m][start], runs.astype(np.int32), f[a : a + m].astype(np.int32)), _pack(t[a : a + m])))
        kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary()]
        return pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=[c.split()[0] for c in _GROUP_DDL.split(", ")])

    return run


def _whole(step, ddl: str):
    """A step over the one table of a partition, which holds one bucket or group."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "bigint": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in ddl.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b.cast(schema) for b in batches if b.num_rows]
        if held:
            table = pa.Table.from_batches(held, schema)
            held.clear()
            yield from step(table).to_batches()

    return run


def _group(docs: np.ndarray, groups: int) -> np.ndarray:
    """The group of each document, as _part has it."""
    return (docs ^ (docs >> 11)) % groups


def _grouped_again(groups: int):
    """Shared postings of one coarse group of documents, those of many buckets together, dealt to the groups."""

    def flush(held: list[tuple]) -> pa.RecordBatch:
        docs, sizes, tokens, freqs = (np.concatenate(c) for c in zip(*held, strict=True))
        group = _group(docs, groups)
        order = np.lexsort((docs, group))
        docs, sizes, tokens, freqs, group = docs[order], sizes[order], tokens[order], freqs[order], group[order]
        rows = []
        for a, m in zip(*_runs(group), strict=True):
            start, runs = _runs(docs[a : a + m])
            rows.append((int(group[a]), _zip(docs[a : a + m][start], sizes[a : a + m][start], runs.astype(np.int32), freqs[a : a + m]), _pack(tokens[a : a + m])))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["part", "head", "tokens"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for part in batches:
            for head, tokens in zip(part.column("head").to_pylist(), part.column("tokens").to_pylist(), strict=True):
                docs, sizes, times, freqs = _unzip(head)
                held.append((np.repeat(docs, times), np.repeat(sizes, times), _unpack(tokens), freqs))
                count += len(freqs)
                if count >= UNIT_TOKENS:
                    yield flush(held)
                    held, count = [], 0
        if held:
            yield flush(held)

    return run


def _part(key: str, groups: int) -> Column:
    """The group of a document."""
    return F.pmod(F.col(key).bitwiseXOR(F.shiftright(key, 11)), F.lit(groups)).cast("int")


def _gather_documents(least: int):
    """Shared postings of one group of documents -> the sets, one a class, that may have a link, tokens rarest first."""

    def run(table: pa.Table) -> pa.Table:
        cols: list[list] = [[], [], [], []]
        classes = table.column("rep").drop_null().to_numpy()
        for row in table.filter(pc.is_null(table.column("rep"))).to_pylist():
            who, sizes, times, freqs = _unzip(row["head"])
            for column, values in zip(cols, (np.repeat(who, times), np.repeat(sizes, times), _unpack(row["tokens"]), freqs), strict=True):
                column.append(values)
        d, s, t, f = (np.concatenate(c) if c else np.zeros(0, kind) for c, kind in zip(cols, (np.int64, np.int32, np.uint64, np.int32), strict=True))
        first = np.isin(d, classes)
        d, s, t, f = d[first], s[first], t[first], f[first]
        order = np.lexsort((t, f, d))
        d, s, t, f = d[order], s[order], t[order], f[order]
        new = np.ones(len(d), bool)
        new[1:] = (d[1:] != d[:-1]) | (t[1:] != t[:-1])
        d, s, t, f = d[new], s[new], t[new], f[new]
        rows = []
        weight = np.concatenate(([0.0], np.cumsum(np.log(f))))
        for a, m in zip(*_runs(d), strict=True):
            n = int(s[a])
            need = -(-least * n // 100)
            if m >= need:
                rows.append((int(d[a]), n, int(m), int(m) - need + 1, float((weight[a + m] - weight[a]) / n), _pack(t[a : a + m])))
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.binary()]
        return pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=[c.split()[0] for c in _LIVE_DDL.split(", ")])

    return run


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The prefix tokens of each set with their positions."""
    for batch in batches:
        ids, n, shared, probes, central = (batch.column(c).to_numpy() for c in ("id", "n", "shared", "probes", "central"))
        tokens = [_unpack(t.as_py())[:p].view(np.int64) for t, p in zip(batch.column("tokens"), probes, strict=True)]
        who = np.repeat(np.arange(len(ids)), probes)
        position = np.concatenate([np.arange(p) for p in probes]) if len(ids) else np.zeros(0, np.int64)
        out = [np.concatenate(tokens) if len(ids) else np.zeros(0, np.int64), ids[who], n[who], shared[who], (position + (n - shared)[who]).astype(np.int32), central[who]]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["token", "id", "n", "shared", "position", "central"])


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a, b and the size of the intersection of their sets."""
    for batch in batches:
        left, right = batch.column("left_tokens"), batch.column("right_tokens")
        size = [len(np.intersect1d(_unpack(x.as_py()), _unpack(y.as_py()), assume_unique=True)) for x, y in zip(left, right, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(size, pa.int32()), batch.column("na"), batch.column("nb")], names=["a", "b", "overlap", "na", "nb"])


def _linked(least: int) -> Column:
    return (F.lit(100 + least) * F.col("overlap")) >= F.lit(least) * (F.col("na") + F.col("nb"))


def _compare(pairs: DataFrame, sets: DataFrame, least: int) -> DataFrame:
    """pairs (a, b) with the overlap of their sets and whether they link; computed once."""
    left = sets.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("left_tokens"))
    right = sets.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("right_tokens"))
    both = pairs.join(right, "b").join(left, "a").select("a", "b", "na", "nb", "left_tokens", "right_tokens")
    found = both.mapInArrow(_overlaps, "a long, b long, overlap int, na int, nb int")
    return materialize(found.withColumn("linked", _linked(least)))


def _differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a set lacks of its leader's tokens, and what it has besides them."""
    for batch in batches:
        lost, gained = [], []
        for own, of_leader in zip(batch.column("tokens"), batch.column("leader_tokens"), strict=True):
            x, y = _unpack(own.as_py()), _unpack(of_leader.as_py())
            lost.append(_pack(np.setdiff1d(y, x, assume_unique=True)))
            gained.append(_pack(np.setdiff1d(x, y, assume_unique=True)))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("leader", "id", "n", "inside")), pa.array(lost, pa.binary()), pa.array(gained, pa.binary())], names=["leader", "id", "n", "inside", "lost", "gained"])


def _derived(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a, b and the overlap of their sets, from a's answer against the leader and the differences of both."""

    def common(x: bytes, y: bytes) -> int:
        return len(np.intersect1d(_unpack(x), _unpack(y), assume_unique=True))

    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("inside", "left_lost", "left_gained", "right_lost", "right_gained"))
        size = [inside - len(right_lost) // 8 + common(left_lost, right_lost) + common(left_gained, right_gained) for inside, left_lost, left_gained, right_lost, right_gained in zip(*columns, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(size, pa.int32()), batch.column("na"), batch.column("nb")], names=["a", "b", "overlap", "na", "nb"])


def _derive(pairs: DataFrame, answers: DataFrame, sets: DataFrame, least: int) -> DataFrame:
    """The links among pairs (leader, a, b), from the answers against their leaders."""
    needed = pairs.select("leader", F.col("a").alias("id")).union(pairs.select("leader", "b")).distinct()
    known = needed.join(answers.select(F.col("a").alias("leader"), F.col("b").alias("id"), F.col("overlap").alias("inside")), ["leader", "id"])
    own = known.join(sets.select("id", "n", "tokens"), "id").join(sets.select(F.col("id").alias("leader"), F.col("tokens").alias("leader_tokens")), "leader")
    ddl = "leader long, id long, n int, inside int, lost binary, gained binary"
    differences = materialize(own.select("leader", "id", "n", "inside", "tokens", "leader_tokens").mapInArrow(_differences, ddl))
    left = differences.select("leader", F.col("id").alias("a"), F.col("n").alias("na"), "inside", F.col("lost").alias("left_lost"), F.col("gained").alias("left_gained"))
    right = differences.select("leader", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("lost").alias("right_lost"), F.col("gained").alias("right_gained"))
    both = pairs.join(left, ["leader", "a"]).join(right, ["leader", "b"]).drop("leader")
    return materialize(both.mapInArrow(_derived, "a long, b long, overlap int, na int, nb int").where(_linked(least)).select("a", "b"))


def _mixed(lists: DataFrame, components: DataFrame) -> DataFrame:
    """The entries of lists that span components, with their component, and whether it is another than their leader's."""
    entries = lists.join(components.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    led = F.max(F.when(F.col("id") == F.col("leader"), F.col("component"))).alias("led")
    mixed = entries.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"), led).where("low <> high").select("token", "led")
    entries = entries.join(materialize(mixed), "token").withColumn("minor", F.col("component") != F.col("led")).drop("led")
    return materialize(entries)  # as a table of its own, so that a skewed token can be split


def _may_reach(least: int, n_x: Column, n_y: Column, left: Column, inside: Column, outside: Column) -> Column:
    """Whether an overlap of at most least(left), and at most inside + outside, can link sets of these sizes."""
    need = F.lit(least) * (n_x + n_y)
    return (F.lit(100 + least) * left >= need) & (F.lit(100 + least) * (inside + outside) >= need)


def _open_blocks(mixed: DataFrame, answers: DataFrame, least: int) -> DataFrame:
    """Pairs of blocks of one list, the first outside its leader's component, that the bounds cannot skip: leader, x_sets, y_sets, y_minor."""
    known = answers.select(F.col("a").alias("leader"), F.col("b").alias("id"), "overlap")
    entries = mixed.where("id <> leader").join(known, ["leader", "id"]).select(
        "token", "held", "leader", "id", "n", "position", "component", "minor", F.col("overlap").alias("inside"), (F.col("shared") - F.col("overlap")).alias("outside"),
    )
    place = [
        F.floor(F.log(F.col("n").cast("double")) * CLASSES).cast("int").alias("size_class"),
        F.floor(F.col("position") * 4 / F.col("n")).cast("int").alias("position_class"),
        F.floor(F.col("inside") * CLASSES / F.col("n")).cast("int").alias("inside_class"),
        F.floor(F.col("outside") * CLASSES / F.col("n")).cast("int").alias("outside_class"),
        F.pmod(F.xxhash64("id"), F.ceil(F.col("held") / BLOCK_SETS)).cast("int").alias("salt"),
    ]
    classes = ["token", "minor", "size_class", "position_class", "inside_class", "outside_class", "salt"]
    blocks = entries.select("*", *place).repartition(*classes).groupBy(*classes).agg(  # dealt by block, not by token
        F.collect_list(F.struct("id", "n", "position", "inside", "outside", "component")).alias("sets"), F.first("leader").alias("leader"),
        F.min("n").alias("least_n"), F.max("n").alias("most_n"), F.max(F.col("n") - F.col("position")).alias("left"), F.max("inside").alias("inside"), F.max("outside").alias("outside"),
    )
    blocks = materialize(blocks.select("token", "leader", "minor", "sets", "least_n", "most_n", "left", "inside", "outside"))
    x = blocks.where("minor").select("token", *[F.col(c).alias(f"x_{c}") for c in blocks.columns if c not in ("token", "leader")])
    y = blocks.select("token", "leader", *[F.col(c).alias(f"y_{c}") for c in blocks.columns if c not in ("token", "leader")])
    sizes = (F.lit(100) * F.col("y_most_n") >= F.lit(least) * F.col("x_least_n")) & (F.lit(100) * F.col("x_most_n") >= F.lit(least) * F.col("y_least_n"))
    bound = _may_reach(least, F.col("x_least_n"), F.col("y_least_n"), F.least("x_left", "y_left"), F.least("x_inside", "y_inside"), F.least("x_outside", "y_outside"))
    return x.join(y, "token").where(sizes & bound).select("leader", "x_sets", "y_sets", "y_minor")


def _open_pairs(blocks: DataFrame, least: int) -> DataFrame:
    """Pairs of open blocks, across components, that the answers against a leader leave open: leader, a, b; one, the closest, leader a pair."""
    pairs = blocks.select("leader", F.explode("x_sets").alias("x"), F.col("y_sets")).select("leader", "x", F.explode("y_sets").alias("y"))
    left = F.least(F.col("x.n") - F.col("x.position"), F.col("y.n") - F.col("y.position"))
    fine = _may_reach(least, F.col("x.n"), F.col("y.n"), left, F.least("x.inside", "y.inside"), F.least("x.outside", "y.outside"))
    pairs = pairs.where(fine & (F.col("x.component") != F.col("y.component")))
    pairs = pairs.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"), "leader", (F.col("x.inside") + F.col("y.inside")).alias("near"))
    return pairs.groupBy("a", "b").agg(F.max_by("leader", F.struct("near", "leader")).alias("leader"))


def _linked_components(lists: DataFrame, sets: DataFrame, least: int) -> DataFrame:
    """The components of all links, as node and component.

    Pairs that the leaders' answers leave open are expanded at once where they
    are few a set, or where leaders find few links.  Else, as in a family of
    several parts, only the pairs with a leader's own component are, for which
    its answers bound best; what is left of a list gets a leader of its own, and
    so part after part becomes one component at one comparison a set.
    """
    edges = None
    while True:
        answers = _compare(lists.where("id <> leader").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct(), sets, least)
        links = answers.where("linked").select("a", "b")
        edges = links if edges is None else edges.unionByName(links)
        components = connected_components(edges)
        mixed = _mixed(lists, components)
        entries = mixed.count()
        if not entries:
            return components
        blocks = _open_blocks(mixed, answers, least)
        work = blocks.agg(F.sum(F.size("x_sets").cast("long") * F.size("y_sets"))).first()[0] or 0
        last = work <= OPEN_PAIRS * entries or LINKED * links.count() < answers.count()
        more = _derive(materialize(_open_pairs(blocks if last else blocks.where("NOT y_minor"), least)), answers, sets, least)
        if not more.isEmpty():
            edges = edges.unionByName(more)
            components = connected_components(edges)
        if last:
            return components
        lists = _led(mixed.where("minor").select("token", "id", "n", "shared", "position", "central"))


def _led(postings: DataFrame) -> DataFrame:
    """Lists of two sets or more, each with its most central set as leader: token, held, leader, id, n, shared, position, central."""
    leaders = postings.groupBy("token").agg(F.count("*").alias("held"), F.max(F.struct("central", (-F.col("id")).alias("id"))).alias("top")).where("held > 1")
    leaders = materialize(leaders.select("token", "held", (-F.col("top.id")).alias("leader")))
    return materialize(postings.join(leaders, "token").select("token", "held", "leader", "id", "n", "shared", "position", "central"))


def _components(docs: DataFrame, words: int, least: int, id_col: str, text_col: str) -> DataFrame:
    """One row a document: doc_id, n, s1, s2, component_id, and whether it is the first of its component."""
    spark = docs.sparkSession
    rows = stable(docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(2 * shuffle_partitions(spark), -(-size // (TOKEN_BYTES * BUCKET_TOKENS)))

    units = 1 + size // (TOKEN_BYTES * UNIT_TOKENS)
    often = max(2, min(COMMON, HOT * BUCKET_TOKENS // units))

    path = scratch(spark, "shared-postings")
    coarse = parts if parts <= FAN else math.isqrt(parts)
    dealt = rows.mapInArrow(_blobs(words, coarse, least, often), _BLOB_DDL).repartitionById(coarse, "bucket")  # a task a bucket, however many there are
    if coarse < parts:  # so many buckets that a unit has a few tokens for each: in two steps
        dealt = dealt.mapInArrow(_dealt_again(coarse, parts), _BLOB_DDL).repartitionById(parts, "bucket")
    dealt.mapInArrow(_whole(_count_bucket(coarse), _BLOB_DDL), _GROUP_DDL).write.partitionBy("kind").options(**_PLAIN).parquet(path)
    del dealt
    if size > RELEASED:
        release(spark)
    shared = spark.read.schema(_GROUP_DDL).parquet(path)
    base = materialize(shared.where(F.col("kind") == _SIGNS).select("head", "tokens").mapInArrow(_signatures, _SIGN_DDL))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("best")
    classes = materialize(base.where("n > 0").groupBy("n", "s1", "s2").agg(F.min("key").alias("rep"), best, F.count("*").alias("copies")))
    firsts = classes.select(_part("rep", parts).alias("part"), "rep", *[F.lit(None).cast(k).alias(c) for c, k in (x.split() for x in _GROUP_DDL.split(", ")[2:])])
    postings = shared.where(F.col("kind") == _POSTINGS).select("part", "head", "tokens")
    if coarse < parts:
        postings = postings.repartitionById(coarse, "part").mapInArrow(_grouped_again(parts), "part int, head binary, tokens binary")
    postings = postings.select("part", F.lit(None).cast("long").alias("rep"), *firsts.columns[2:])
    live = postings.unionByName(firsts).repartitionById(parts, "part").mapInArrow(_whole(_gather_documents(least), ", ".join(f"{c} {k}" for c, k in firsts.dtypes)), _LIVE_DDL)
    sets = materialize(live)
    del shared, postings, firsts, live
    remove(spark, path)

    postings = sets.mapInArrow(_postings, "token long, id long, n int, shared int, position int, central double")
    components = _linked_components(_led(postings), sets, least)
    joined = classes.join(components.withColumnRenamed("node", "rep"), "rep", "left")
    first = joined.where("component IS NOT NULL").groupBy("component").agg(F.min("best").alias("first"))
    named = joined.where("copies > 1 OR component IS NOT NULL").join(first, "component", "left").select("n", "s1", "s2", F.coalesce("first", "best").alias("first"))
    salted = named.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))  # a class may hold a third of all rows
    out = base.withColumn("salt", F.pmod("key", F.lit(SALTS)).cast("int")).join(materialize(salted), ["n", "s1", "s2", "salt"], "left")
    alone = F.col("first").isNull()
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id"))
    return out.select("doc_id", "n", "s1", "s2", component.alias("component_id"), (alone | (F.col("first.key") == F.col("key"))).alias("kept"))


def set_similarity_components(docs: DataFrame, words: int = 5, least: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id.

    Two documents link when the Jaccard similarity of their sets of word n-grams
    is at least ``least`` percent; a component is named by its smallest id.
    """
    return _components(docs, words, least, id_col, text_col).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def drop_near_duplicates(docs: DataFrame, words: int = 5, least: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each component, that of the smallest id, in the same columns."""
    marks = ["__n", "__s1", "__s2"]

    def mark(rows: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a, sets, s1, s2 in shingle_sets(batch.column(text_col), words):
                    signs = [pa.array([len(s) for s in sets], pa.int64()), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64))]
                    yield pa.RecordBatch.from_arrays([*batch.slice(a, len(sets)).columns, *signs], names=[*batch.schema.names, *marks])

        return rows.mapInArrow(run, T.StructType([*rows.schema.fields, *(T.StructField(m, T.LongType()) for m in marks)]))

    found = _components(docs, words, least, id_col, text_col)
    return keep_rows(docs, found.select("doc_id", "kept", *[F.col(m[2:]).alias(m) for m in marks]), mark, id_col)
