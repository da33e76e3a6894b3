"""Strings with expiry and hashes, by key, over a DataFrame.

The frame has key, kind (string or hash), str BINARY, h MAP<STRING, BINARY>, ttl
(milliseconds since 1970, 0 for none) and id, the order of insertion.  A read
first drops what has expired.  Writes replace the frame that the object holds;
every ``checkpoint_every`` writes it is stored, which bounds the lineage.  Point
commands are a Spark job each; the ``bulk_`` ones and ``strings``, ``hashes``
and ``hash_summary`` are joins and projections over any number of keys.
"""

from __future__ import annotations

import hashlib
import random
import re
import time
from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bramble.plans.bql import BqlError
from bramble.storage import materialize

DDL = "key string, kind string, str binary, h map<string,binary>, ttl bigint, id bigint"
_INT = (-(1 << 31), (1 << 31) - 1)


def _bytes(x: Any) -> bytes:
    return x if isinstance(x, bytes) else str(x).encode()


class Stash:
    """One keyspace.  Point commands run on the driver's behalf; each is a filter on the key."""

    def __init__(self, spark: SparkSession, table: DataFrame | None = None, clock: Callable[[], int] | None = None, checkpoint_every: int = 50) -> None:
        self.spark = spark
        self.table = table if table is not None else spark.createDataFrame([], DDL)
        self.clock = clock or (lambda: int(time.time() * 1000))
        self.checkpoint_every, self._writes = checkpoint_every, 0
        self._next = self._last_id() if table is not None else 0
        self._queue: list[tuple] | None = None
        self._watched: dict[str, Any] = {}

    # frames

    def live(self) -> DataFrame:
        return self.table.where((F.col("ttl") == 0) | (F.col("ttl") > self.clock()))

    def _swap(self, table: DataFrame) -> None:
        self._writes += 1
        self.table = materialize(table) if self._writes % self.checkpoint_every == 0 else table

    def _last_id(self) -> int:
        return self.table.agg(F.max("id")).first()[0] or 0

    def _row(self, key: str, kind: str | None = None) -> Any:
        found = self.live().where(F.col("key") == key).first()
        if found is not None and kind is not None and found["kind"] != kind:
            raise BqlError("WRONGTYPE the key holds another kind of value")
        return found

    def _store(self, rows: Iterable[tuple]) -> None:
        """Rows (key, kind, str, h, ttl) in place of those of the same keys."""
        rows = list(rows)
        made = []
        for key, kind, text, h, ttl in rows:
            self._next += 1
            made.append((key, kind, bytearray(text) if text is not None else None, {f: bytearray(v) for f, v in h.items()} if h is not None else None, ttl, self._next))
        keep = self.live().where(~F.col("key").isin([r[0] for r in rows]))
        self._swap(keep.unionByName(self.spark.createDataFrame(made, DDL)) if made else keep)

    def _bulk(self, rows: DataFrame) -> None:
        """Rows (key, kind, str, h, ttl) in place of those of the same keys, with ids after all others: an anti-join and a union, at any size."""
        columns = ["key", "kind", "str", "h", "ttl", "id"]
        new = materialize(rows.withColumn("id", F.lit(self._next + 1) + F.monotonically_increasing_id()))  # ids are made once
        self._swap(materialize(self.live().join(new.select("key"), "key", "left_anti").select(*columns).unionByName(new.select(*columns))))
        self._next = max(self._next, self._last_id())

    def bulk_load(self, pairs: DataFrame) -> None:
        """SET for every row of a frame (key, value)."""
        self._bulk(pairs.select("key", F.lit("string").alias("kind"), F.col("value").cast("binary").alias("str"), F.lit(None).cast("map<string,binary>").alias("h"), F.lit(0).cast("bigint").alias("ttl")))

    def _with(self, keys: DataFrame, kind: str) -> DataFrame:
        """keys with what is stored under them; raises where it is of another kind."""
        joined = keys.join(self.live().select("key", "kind", "str", "h", "ttl"), "key", "left")
        if not joined.where(F.col("kind") != kind).isEmpty():
            raise BqlError("WRONGTYPE a key holds another kind of value")
        return joined

    def bulk_append(self, pairs: DataFrame) -> None:
        """APPEND for every row of a frame (key, value), one a key."""
        joined = self._with(pairs.select("key", F.col("value").cast("binary").alias("more")), "string")
        text = F.concat(F.coalesce("str", F.lit(b"")), F.col("more"))
        self._bulk(joined.select("key", F.lit("string").alias("kind"), text.alias("str"), "h", F.coalesce("ttl", F.lit(0)).cast("bigint").alias("ttl")))

    def bulk_incrby(self, deltas: DataFrame) -> None:
        """INCRBY for the sum of each key's rows of a frame (key, delta); a value or result that is no 32-bit integer raises."""
        joined = self._with(deltas.groupBy("key").agg(F.sum("delta").cast("decimal(38,0)").alias("delta")), "string")
        old = F.coalesce(F.col("str").cast("string"), F.lit("0"))
        number = F.when(old.rlike(r"^[+-]?[0-9]+$"), old.try_cast("decimal(38,0)") + F.col("delta"))
        joined = joined.withColumn("number", number)
        if not joined.where(F.col("number").isNull() | ~F.col("number").between(*_INT)).isEmpty():
            raise BqlError("value is not an integer or out of range")
        self._bulk(joined.select("key", F.lit("string").alias("kind"), F.col("number").cast("string").cast("binary").alias("str"), "h", F.coalesce("ttl", F.lit(0)).cast("bigint").alias("ttl")))

    def bulk_hset(self, fields: DataFrame) -> None:
        """HSET for every row of a frame (key, field, value); of a field's rows the largest value stays."""
        one = fields.groupBy("key", "field").agg(F.max(F.col("value").cast("binary")).alias("value"))
        new = one.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("new"))
        joined = self._with(new, "hash")
        kept = F.map_filter(F.coalesce("h", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<binary>"))), lambda k, v: ~F.map_contains_key("new", k))
        self._bulk(joined.select("key", F.lit("hash").alias("kind"), F.lit(None).cast("binary").alias("str"), F.map_concat(kept, "new").alias("h"), F.lit(0).cast("bigint").alias("ttl")))

    def bulk_hdel(self, fields: DataFrame) -> None:
        """HDEL for every row of a frame (key, field); a hash without fields goes."""
        gone = fields.groupBy("key").agg(F.collect_set("field").alias("gone"))
        left = self.live().join(gone, "key", "left")
        h = F.when(F.col("gone").isNotNull() & (F.col("kind") == "hash"), F.map_filter("h", lambda k, v: ~F.array_contains("gone", k))).otherwise(F.col("h"))
        self._swap(left.withColumn("h", h).where((F.col("kind") != "hash") | (F.cardinality("h") > 0)).select("key", "kind", "str", "h", "ttl", "id"))

    def bulk_delete(self, keys: DataFrame) -> None:
        """DEL for every key of a frame."""
        self._swap(self.live().join(keys.select("key"), "key", "left_anti"))

    def bulk_expireat(self, times: DataFrame) -> None:
        """PEXPIREAT for every row of a frame (key, at), milliseconds since 1970; the latest of a key counts, hashes stay."""
        at = times.groupBy("key").agg(F.max("at").alias("at"))
        joined = self.live().join(at, "key", "left")
        ttl = F.when(F.col("at").isNotNull() & (F.col("kind") == "string"), F.greatest("at", F.lit(1))).otherwise(F.col("ttl")).alias("ttl")
        self._swap(joined.select("key", "kind", "str", "h", ttl, "id"))

    def strings(self) -> DataFrame:
        """GET, STRLEN and PTTL of all strings: key, value, bytes, ttl."""
        left = F.when(F.col("ttl") == 0, F.lit(-1)).otherwise(F.col("ttl") - F.lit(self.clock())).cast("bigint")
        return self.live().where("kind = 'string'").select("key", F.col("str").alias("value"), F.octet_length("str").alias("bytes"), left.alias("ttl"))

    def hashes(self) -> DataFrame:
        """HGETALL and HSTRLEN of all hashes: key, field, value, bytes."""
        rows = self.live().where("kind = 'hash'").select("key", F.explode("h").alias("field", "value"))
        return rows.select("key", "field", "value", F.octet_length("value").alias("bytes"))

    def hash_summary(self) -> DataFrame:
        """HLEN and HKEYS of all hashes: key, fields, names in order."""
        return self.live().where("kind = 'hash'").select("key", F.cardinality("h").alias("fields"), F.array_sort(F.map_keys("h")).alias("names"))

    # strings

    def set(self, key: str, value: Any) -> str:
        self._store([(key, "string", _bytes(value), None, 0)])
        return "OK"

    def get(self, key: str) -> bytes | None:
        found = self._row(key, "string")
        return bytes(found["str"]) if found else None

    def setnx(self, key: str, value: Any) -> int:
        if self._row(key):
            return 0
        self.set(key, value)
        return 1

    def setex(self, key: str, seconds: int, value: Any) -> str:
        if seconds <= 0:
            raise BqlError("invalid expire time")
        self._store([(key, "string", _bytes(value), None, self.clock() + seconds * 1000)])
        return "OK"

    def mset(self, pairs: dict[str, Any]) -> str:
        self._store([(k, "string", _bytes(v), None, 0) for k, v in pairs.items()])
        return "OK"

    def msetnx(self, pairs: dict[str, Any]) -> int:
        if self.exists(*pairs):
            return 0
        self.mset(pairs)
        return 1

    def mget(self, *keys: str) -> list[bytes | None]:
        found = {r["key"]: bytes(r["str"]) for r in self.live().where(F.col("key").isin(list(keys)) & (F.col("kind") == "string")).collect()}
        return [found.get(k) for k in keys]

    def getset(self, key: str, value: Any) -> bytes | None:
        old = self.get(key)
        self.set(key, value)
        return old

    def getdel(self, key: str) -> bytes | None:
        old = self.get(key)
        self.delete(key)
        return old

    def append(self, key: str, value: Any) -> int:
        found = self._row(key, "string")
        text = (bytes(found["str"]) if found else b"") + _bytes(value)
        self._store([(key, "string", text, None, found["ttl"] if found else 0)])
        return len(text)

    def strlen(self, key: str) -> int:
        return len(self.get(key) or b"")

    def getrange(self, key: str, start: int, end: int) -> bytes:
        text = self.get(key) or b""
        n = len(text)
        start = max(start + n, 0) if start < 0 else start
        end = end + n if end < 0 else end
        return text[start : end + 1] if start <= end else b""

    substr = getrange

    def setrange(self, key: str, offset: int, value: Any) -> int:
        if offset < 0:
            raise BqlError("offset is out of range")
        found = self._row(key, "string")
        text, new = bytes(found["str"]) if found else b"", _bytes(value)
        if not new:
            return len(text)
        text = text.ljust(offset, b"\0")
        text = text[:offset] + new + text[offset + len(new) :]
        self._store([(key, "string", text, None, found["ttl"] if found else 0)])
        return len(text)

    def incrby(self, key: str, n: int) -> int:
        found = self._row(key, "string")
        total = _integer(bytes(found["str"]) if found else b"0") + n
        if not _INT[0] <= total <= _INT[1]:
            raise BqlError("increment or decrement would overflow")
        self._store([(key, "string", _bytes(total), None, 0)])
        return total

    def incr(self, key: str) -> int:
        return self.incrby(key, 1)

    def decr(self, key: str) -> int:
        return self.incrby(key, -1)

    def decrby(self, key: str, n: int) -> int:
        return self.incrby(key, -n)

    def incrbyfloat(self, key: str, x: float) -> float:
        total = _float(self.get(key) or b"0") + x
        self._store([(key, "string", _bytes(repr(total)), None, 0)])
        return total

    # hashes

    def _hash(self, key: str) -> dict[str, bytes]:
        found = self._row(key, "hash")
        return {f: bytes(v) for f, v in found["h"].items()} if found else {}

    def _store_hash(self, key: str, h: dict[str, bytes]) -> None:
        if h:
            self._store([(key, "hash", None, h, 0)])
        else:
            self.delete(key)

    def hset(self, key: str, fields: dict[str, Any]) -> int:
        h = self._hash(key)
        new = len(set(fields) - set(h))
        self._store_hash(key, h | {f: _bytes(v) for f, v in fields.items()})
        return new

    def hmset(self, key: str, fields: dict[str, Any]) -> str:
        self.hset(key, fields)
        return "OK"

    def hsetnx(self, key: str, field: str, value: Any) -> int:
        return 0 if field in self._hash(key) else self.hset(key, {field: value})

    def hget(self, key: str, field: str) -> bytes | None:
        return self._hash(key).get(field)

    def hmget(self, key: str, *fields: str) -> list[bytes | None]:
        h = self._hash(key)
        return [h.get(f) for f in fields]

    def hgetall(self, key: str) -> dict[str, bytes]:
        return self._hash(key)

    def hkeys(self, key: str) -> list[str]:
        return list(self._hash(key))

    def hvals(self, key: str) -> list[bytes]:
        return list(self._hash(key).values())

    def hlen(self, key: str) -> int:
        return len(self._hash(key))

    def hexists(self, key: str, field: str) -> int:
        return int(field in self._hash(key))

    def hdel(self, key: str, *fields: str) -> int:
        h = self._hash(key)
        gone = [f for f in dict.fromkeys(fields) if f in h]
        if gone:
            self._store_hash(key, {f: v for f, v in h.items() if f not in gone})
        return len(gone)

    def hstrlen(self, key: str, field: str) -> int:
        return len(self._hash(key).get(field, b""))

    def hincrby(self, key: str, field: str, n: int) -> int:
        total = _integer(self._hash(key).get(field, b"0"), 64) + n
        self.hset(key, {field: total})
        return total

    def hincrbyfloat(self, key: str, field: str, x: float) -> float:
        total = _float(self._hash(key).get(field, b"0")) + x
        self.hset(key, {field: repr(total)})
        return total

    def hrandfield(self, key: str, count: int | None = None, with_values: bool = False) -> Any:
        h = self._hash(key)
        if count is None:
            return random.choice(list(h)) if h else None
        names = random.sample(list(h), min(count, len(h))) if count >= 0 else random.choices(list(h), k=min(-count, len(h))) if h else []
        return [(n, h[n]) for n in names] if with_values else names

    # keys

    def delete(self, *keys: str) -> int:
        n = self.exists(*dict.fromkeys(keys))
        if n:
            self._swap(self.live().where(~F.col("key").isin(list(keys))))
        return n

    def exists(self, *keys: str) -> int:
        held = {r["key"] for r in self.live().where(F.col("key").isin(list(keys))).select("key").collect()}
        return sum(k in held for k in keys)

    def type(self, key: str) -> str:
        found = self._row(key)
        return found["kind"] if found else "none"

    def rename(self, old: str, new: str) -> str:
        if not self._row(old):
            raise BqlError("no such key")
        if old != new:
            key: Column = F.when(F.col("key") == old, F.lit(new)).otherwise(F.col("key"))
            self._swap(self.live().where(F.col("key") != new).withColumn("key", key))
        return "OK"

    def renamenx(self, old: str, new: str) -> int:
        if not self._row(old):
            raise BqlError("no such key")
        if self._row(new):
            return 0
        self.rename(old, new)
        return 1

    def randomkey(self) -> str | None:
        found = self.live().orderBy(F.rand()).select("key").first()
        return found["key"] if found else None

    def scan(self, cursor: int = 0, count: int = 10, match: str | None = None, kind: str | None = None) -> tuple[int, list[str]]:
        """(next cursor, keys): ids after the cursor in order; 0 once nothing is left."""
        page = self.live().where(F.col("id") > cursor).orderBy("id").limit(count).select("id", "key", "kind").collect()
        pattern = re.compile("".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in match), re.S) if match else None
        keys = [r["key"] for r in page if (not pattern or pattern.fullmatch(r["key"])) and (not kind or r["kind"] == kind)]
        return (page[-1]["id"] if len(page) == count else 0), keys

    def pexpireat(self, key: str, when: int, option: str | None = None) -> int:
        found = self._row(key)
        if found is None:
            return 0
        if found["kind"] != "string":
            raise BqlError("only strings expire")
        old = found["ttl"]
        refused = {"NX": old != 0, "XX": old == 0, "GT": old == 0 or when <= old, "LT": old != 0 and when >= old}
        if option is not None and option not in refused:
            raise BqlError(f"unknown option {option}")
        if option is not None and refused[option]:
            return 0
        self._swap(self.live().withColumn("ttl", F.when(F.col("key") == key, F.lit(max(when, 1))).otherwise(F.col("ttl"))))
        return 1

    def expire(self, key: str, seconds: int, option: str | None = None) -> int:
        return self.pexpireat(key, self.clock() + seconds * 1000, option)

    def pexpire(self, key: str, ms: int, option: str | None = None) -> int:
        return self.pexpireat(key, self.clock() + ms, option)

    def expireat(self, key: str, seconds: int, option: str | None = None) -> int:
        return self.pexpireat(key, seconds * 1000, option)

    def pttl(self, key: str) -> int:
        found = self._row(key)
        return -2 if found is None else -1 if found["ttl"] == 0 else found["ttl"] - self.clock()

    def ttl(self, key: str) -> int:
        left = self.pttl(key)
        return left if left < 0 else -(-left // 1000)

    def persist(self, key: str) -> int:
        if self.pttl(key) < 0:
            return 0
        self._swap(self.live().withColumn("ttl", F.when(F.col("key") == key, F.lit(0)).otherwise(F.col("ttl"))))
        return 1

    def flushdb(self, mode: str = "SYNC") -> str:
        if mode not in ("SYNC", "ASYNC"):
            raise BqlError("FLUSHDB takes SYNC or ASYNC")
        self.table = self.spark.createDataFrame([], DDL)
        return "OK"

    flushall = flushdb

    # transactions and connection

    def multi(self) -> str:
        if self._queue is not None:
            raise BqlError("MULTI calls can not be nested")
        self._queue = []
        return "OK"

    def queue(self, name: str, *args: Any) -> str:
        if self._queue is None:
            raise BqlError("no MULTI")
        self._queue.append((name, args))
        return "QUEUED"

    def exec(self) -> list | None:
        """Runs the queue; None, and nothing changed, if a watched key has changed."""
        if self._queue is None:
            raise BqlError("EXEC without MULTI")
        queued, self._queue = self._queue, None
        stale = any(self._state(k) != v for k, v in self._watched.items())
        self._watched = {}
        if stale:
            return None
        return [getattr(self, name)(*args) for name, args in queued]

    def discard(self) -> str:
        if self._queue is None:
            raise BqlError("DISCARD without MULTI")
        self._queue, self._watched = None, {}
        return "OK"

    def _state(self, key: str) -> Any:
        found = self._row(key)
        return None if found is None else (found["kind"], found["str"], found["h"], found["ttl"], found["id"])

    def watch(self, *keys: str) -> str:
        if self._queue is not None:
            raise BqlError("WATCH inside MULTI is not allowed")
        self._watched |= {k: self._state(k) for k in keys}
        return "OK"

    def unwatch(self) -> str:
        self._watched = {}
        return "OK"

    def select(self, index: int) -> str:
        if index != 0:
            raise BqlError("DB index is out of range")
        return "OK"

    def readonly(self) -> str:
        return "OK"

    readwrite = readonly

    def cluster_myid(self) -> str:
        """The id of the one node that a Spark application is: 40 hex digits of its application id."""
        return hashlib.sha1(self.spark.sparkContext.applicationId.encode()).hexdigest()

    def cluster_slots(self) -> list[list]:
        """All slots, with that node."""
        return [[0, 16383, ["127.0.0.1", 0, self.cluster_myid()]]]

    def cluster_nodes(self) -> str:
        return f"{self.cluster_myid()} 127.0.0.1:0@0 myself,master - 0 0 0 connected 0-16383\n"

    def cluster_keyslot(self, key: str) -> int:
        """CRC-16 (XMODEM) of the key, or of its {tag}, modulo 16384."""
        tag = re.search(r"\{([^}]+)\}", key)
        crc = 0
        for byte in _bytes(tag[1] if tag else key):
            crc ^= byte << 8
            for _ in range(8):
                crc = (crc << 1 ^ 0x1021 if crc & 0x8000 else crc << 1) & 0xFFFF
        return crc % 16384


def _integer(text: bytes, bits: int = 32) -> int:
    if not re.fullmatch(rb"[+-]?[0-9]+", text) or not -(1 << (bits - 1)) <= int(text) < 1 << (bits - 1):
        raise BqlError("value is not an integer or out of range")
    return int(text)


def _float(text: bytes) -> float:
    try:
        return float(text)
    except ValueError as error:
        raise BqlError("value is not a valid float") from error
