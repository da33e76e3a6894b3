"""Buckets, sessions and the catalogue: the commands of the document model over DataFrames.

A bucket is an immutable DataFrame with metadata; a change swaps in a new one.
Within a transaction changes are staged and published together.
"""

from __future__ import annotations

import json
import re
import secrets
import time
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bramble.functions.collation import Collation, resolve_collation
from bramble.functions.paths import Row
from bramble.operators import dynamic
from bramble.operators import index as indexes
from bramble.operators import update as updates
from bramble.operators.project import project
from bramble.operators.sort import Cursor, sort_order
from bramble.operators.vector import DEFAULT_CANDIDATES, DEFAULT_TOP, vector_search
from bramble.plans import bql
from bramble.plans.access import Histogram, Path, access_path
from bramble.plans.bql import And, BqlError, Const, Leaf, Or
from bramble.plans.compiler import Compiler
from bramble.plans.dynamic import DynamicCompiler
from bramble.plans.normalize import explain, normalize
from bramble.sources.bson import as_json, decode, to_bson
from bramble.sources.documents import DOCUMENT, is_dynamic, to_json
from bramble.storage import materialize

DEFAULT_LIMIT = 100
ID = "_id"


def new_object_id() -> str:
    """24 hex digits: seconds, then random bytes."""
    return f"{int(time.time()):08x}{secrets.token_hex(8)}"


@dataclass(frozen=True)
class Bucket:
    """A table of documents with its indexes and default collation."""

    name: str
    table: DataFrame
    id_col: str = ID
    indexes: Mapping[str, indexes.Index] = field(default_factory=dict)
    collation: Collation | None = None
    removed: bool = False

    @property
    def dynamic(self) -> bool:
        """Whether documents are schemaless, in one VARIANT column."""
        return is_dynamic(self.table)

    def compiler(self, collation: Collation | None = None) -> Compiler:
        return DynamicCompiler(DOCUMENT) if self.dynamic else Compiler(self.table.schema, collation)

    def _scalar(self, path: str) -> bool:
        value = Row(self.table.schema).at(path)
        return value.kind is not None and not value.is_array

    def tree(self, query: Any) -> Any:
        parsed = bql.parse(query) if isinstance(query, str | bytes | Mapping) else query
        return normalize(parsed, self._scalar)

    def find(self, query: Any = None, collation: Any = None) -> DataFrame:
        """All rows that a query matches."""
        tree = self.tree(query if query is not None else {})
        if tree == Const(True):
            return self.table
        return self.table.where(self.compiler(self._collation(tree, collation)).condition(tree))

    def _collation(self, tree: Any, given: Any) -> Collation | None:
        if given is not None:
            return Collation.of(given)
        found = {resolve_collation(None, p, self.indexes, self.collation) for p in bql.paths(tree)}
        return found.pop() if len(found) == 1 else self.collation

    def query(
        self, query: Any = None, *, sort_by: tuple[str, str] | None = None, result_sort: tuple[str, str] | None = None, projection: Mapping[str, Any] | None = None,
        limit: int | None = DEFAULT_LIMIT, collation: Any = None, strict_sort: bool = False,
    ) -> DataFrame:
        """Filter, order, limit and projection; limit None for all rows, 0 for the default."""
        if sort_by and result_sort and sort_by[0] == result_sort[0]:
            raise BqlError("SORTBY and RESULTSORT name one field")
        tree = self.tree(query if query is not None else {})
        collated = self._collation(tree, collation)
        rows = self.find(tree, collated)
        if sort_by and strict_sort:
            self.check_sort(tree, sort_by[0], collated)
        limit = DEFAULT_LIMIT if limit == 0 else limit
        if sort_by:
            order = sort_order(rows, *sort_by, id_col=self.id_col, collation=collated)
            rows = rows.orderBy(*order) if limit is None else rows.orderBy(*order).limit(limit)
        elif limit is not None:
            rows = rows.orderBy(self.id_col).limit(limit)
        if result_sort:
            rows = rows.orderBy(*sort_order(rows, *result_sort, id_col=self.id_col, collation=collated))
        if self.dynamic:
            return dynamic.project_dynamic(rows, projection or {}, tree, self.id_col)
        return project(rows, projection or {}, tree, self.id_col)

    def check_sort(self, tree: Any, field_name: str, collation: Collation | None = None) -> None:
        """Raises unless an index gives this order under the query."""
        if field_name == self.id_col:
            return
        single = [i for i in self.indexes.values() if i.kind == "single" and i.fields == (field_name,) and not i.multi_key and i.status == "READY"]
        compound = [i for i in self.indexes.values() if i.kind == "compound" and field_name in i.fields and i.status == "READY"]
        if any(i.collation != collation for i in (*single, *compound) if i.collation or collation):
            raise BqlError(f"the index on {field_name!r} has another collation")
        conditions = tree.children if isinstance(tree, And) else () if tree == Const(True) else (tree,)
        leaves = [c for c in conditions if isinstance(c, Leaf)]
        equal = {c.path for c in leaves if c.op == "eq"}
        if single:
            if isinstance(tree, Or) and not all(isinstance(c, Leaf) and c.op == "eq" and c.path == field_name for c in tree.children):
                raise BqlError("a disjunction has no natural order")
            return
        for i in compound:
            prefix = i.fields[: i.fields.index(field_name)]
            if all(p in equal for p in prefix):
                return
            if any(c.path in prefix and c.op != "eq" for c in leaves):
                raise BqlError(f"a range precedes {field_name!r} in index {i.name!r}")
        raise BqlError(f"no index gives the order of {field_name!r}")

    def cursor(self, query: Any = None, *, sort_by: tuple[str, str] | None = None, limit: int = DEFAULT_LIMIT, collation: Any = None) -> Cursor:
        tree = self.tree(query if query is not None else {})
        name, direction = sort_by or (None, "ASC")
        return Cursor(self.find(tree, collation), limit or DEFAULT_LIMIT, self.id_col, name, direction, self._collation(tree, collation) if name else None)

    def vector(self, path: str, vector: Any, *, filter: Any = None, top: int = DEFAULT_TOP, threshold: float = 0.0, candidates: int | None = DEFAULT_CANDIDATES, distance: str | None = None, projection: Mapping[str, Any] | None = None, collation: Any = None, overquery: float = 1.0) -> DataFrame:
        """The rows nearest to a vector; the index on the path settles dimensions and distance.

        overquery widens an approximate search; the search here is exact, so it is checked and changes nothing.
        """
        if isinstance(overquery, bool) or not isinstance(overquery, int | float) or overquery < 1:
            raise BqlError("OVERQUERY is a number of at least 1")
        index = next((i for i in self.indexes.values() if i.kind == "vector" and i.fields == (path,)), None)
        tree = self.tree(filter) if filter is not None else None
        found = vector_search(
            self.table, path, vector, top=top, threshold=threshold, distance=distance or (index.distance if index else "COSINE"), query=tree,
            candidates=candidates, dimensions=index.dimensions if index else None, id_col=self.id_col, collation=Collation.of(collation) or self.collation,
        )
        if not projection:
            return found
        return project(found, {**projection, "_score": 1} if any(v in (1, True) for v in projection.values()) else projection, tree or And(()), self.id_col)

    def path(self, query: Any, sort_by: tuple[str, str] | None = None, histograms: Mapping[str, Histogram] | None = None) -> Path:
        """The index that would serve a query, and what it leaves to test."""
        return access_path(self.tree(query), self.indexes, self.id_col, sort_by[0] if sort_by else None, histograms)

    def statistics(self) -> dict[str, Histogram]:
        """Histograms of the indexes' first fields, at most ten buckets each."""
        out = {}
        for one in self.indexes.values():
            if one.kind != "vector":
                entries, rows = self.analyze_index(one.name)
                out[one.name] = Histogram(tuple((r["low"], r["high"], r["distinct_values"]) for r in rows.orderBy("bucket").collect()), entries)
        return out

    def explain(self, query: Any, sort_by: tuple[str, str] | None = None) -> str:
        """The normalised query, its access path, and Spark's plan."""
        tree = self.tree(query)
        plan = self.query(tree, sort_by=sort_by, limit=None)._jdf.queryExecution().explainString(plan_mode(plan_session(self.table)))
        path = "\n".join(self.path(tree, sort_by).lines())
        return f"{explain(tree)}\n{path}\n{plan}"

    def insert(self, documents: DataFrame | Iterable[Mapping[str, Any]]) -> Bucket:
        """With more documents; ids are generated where absent, and uniqueness is checked."""
        spark = self.table.sparkSession
        if self.dynamic and not isinstance(documents, DataFrame):
            rows = [(d.get(self.id_col) or new_object_id(), json.dumps({k: v for k, v in d.items() if k != self.id_col}, default=str)) for d in documents]
            documents = spark.createDataFrame(rows, f"`{self.id_col}` {self._id_type().simpleString()}, json string").select(self.id_col, F.parse_json("json").alias(DOCUMENT))
        elif not isinstance(documents, DataFrame):
            rows = [json.dumps(d, default=str) for d in documents]
            kinds = self.table.schema.simpleString() if self.table.columns else None
            text = spark.createDataFrame([(r,) for r in rows], "json string")
            documents = text.select(F.from_json("json", self.table.schema if kinds else F.schema_of_json(rows[0])).alias("d")).select("d.*")
        if self.id_col not in documents.columns:
            documents = documents.withColumn(self.id_col, F.lit(None).cast(self._id_type()))
        if isinstance(documents.schema[self.id_col].dataType, T.StringType):
            lead = F.concat(F.lit(secrets.token_hex(16)), F.monotonically_increasing_id().cast("string"))
            made = F.substring(F.sha2(lead, 256), 1, 24)
            documents = materialize(documents.withColumn(self.id_col, F.coalesce(self.id_col, made)))  # ids are made once
        for one in self._unique_keys():
            indexes.check_added(self.table, documents, one)
        self._check_types(documents)
        return replace(self, table=self.table.unionByName(documents, allowMissingColumns=True))

    def _unique_keys(self) -> list[indexes.Index]:
        return [indexes.Index("primary", (self.id_col,), kind="primary", unique=True), *(i for i in self.indexes.values() if i.unique)]

    def _check_types(self, documents: DataFrame) -> None:
        """Raises where schemaless documents have values that an index of strict types does not take."""
        if not self.dynamic:
            return
        for one in self.indexes.values():
            if one.strict and not indexes.type_violations(documents, one).isEmpty():
                raise BqlError(f"type mismatch for index {one.name!r}")

    def _id_type(self) -> T.DataType:
        return self.table.schema[self.id_col].dataType if self.id_col in self.table.columns else T.StringType()

    def update(self, query: Any, spec: Mapping[str, Any], *, sort_by: tuple[str, str] | None = None, limit: int | None = None, collation: Any = None, new_id: Any = None) -> tuple[Bucket, DataFrame]:
        tree = bql.parse(query) if isinstance(query, str | bytes | Mapping) else query
        order = sort_order(self.table, *sort_by, id_col=self.id_col) if sort_by else None
        if new_id is None and isinstance(self._id_type(), T.StringType):
            new_id = new_object_id()
        if self.dynamic:
            changed = dynamic.update_dynamic(self.table, tree, spec, id_col=self.id_col, limit=limit, order=order, new_id=new_id)
            table = materialize(changed.table)  # documents change in Python: once
            self._check_types(table)
            for one in self.indexes.values():
                indexes.check_unique(table, one)
            return replace(self, table=table), changed.ids
        done = updates.update(self.table, tree, spec, id_col=self.id_col, limit=limit, order=order, new_id=new_id, collation=self._collation(tree, collation))
        for one in self.indexes.values():
            indexes.check_unique(done.table, one)
        return replace(self, table=done.table), done.ids

    def delete(self, query: Any, *, limit: int | None = None, collation: Any = None) -> tuple[Bucket, DataFrame]:
        tree = bql.parse(query) if isinstance(query, str | bytes | Mapping) else query
        compiler = self.compiler(self._collation(tree, collation))
        done = updates.delete(self.table, tree, id_col=self.id_col, limit=limit, compiler=compiler)
        return replace(self, table=done.table), done.ids

    def create_index(self, spec: Mapping[str, Any], strict_types: bool = True) -> Bucket:
        """With more indexes, checked against the rows and ready."""
        made = dict(self.indexes)
        for one in indexes.parse_indexes(spec):
            if one.name in made:
                raise BqlError(f"index {one.name!r} exists")
            one = replace(one, strict=strict_types)
            if strict_types and self.dynamic:
                if not indexes.type_violations(self.table, one).isEmpty():
                    raise BqlError(f"type mismatch for index {one.name!r}")
            elif strict_types and (wrong := indexes.type_errors(self.table, one)):
                raise BqlError(f"type mismatch: {'; '.join(wrong)}")
            indexes.check_unique(self.table, one)
            made[one.name] = one.ready()
        return replace(self, indexes=made)

    def drop_index(self, name: str) -> Bucket:
        if name not in self.indexes:
            raise BqlError(f"no index {name!r}")
        return replace(self, indexes={k: v for k, v in self.indexes.items() if k != name})

    def describe_index(self, name: str) -> dict[str, Any]:
        one = self.indexes[name]
        return {"name": one.name, "selectors": list(one.fields), "types": list(one.types), "kind": one.kind, "unique": one.unique, "multi_key": one.multi_key, "status": one.status}

    def index_tasks(self, name: str) -> list[dict[str, Any]]:
        """The tasks of an index: the build that ran when it was created, completed, with the entries that it counted."""
        described = self.describe_index(name)
        entries = 0 if described["kind"] == "vector" else indexes.cardinality(self.table, self.indexes[name])
        return [{"kind": "BUILD", "index": name, "status": "COMPLETED" if described["status"] == "READY" else described["status"], "processed": entries}]

    def analyze_index(self, name: str) -> tuple[int, DataFrame]:
        """(cardinality, histogram of the first field)."""
        one = self.indexes[name]
        return indexes.cardinality(self.table, one), indexes.histogram(self.table, one.fields[0])

    def approximate_size(self) -> int:
        """Bytes that the planner expects the bucket to take, from file sizes and statistics; nothing is read."""
        return int(str(self.table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))

    def locate(self) -> list[str]:
        """The files that hold the bucket."""
        return sorted(self.table.inputFiles())


def plan_session(df: DataFrame) -> SparkSession:
    return df.sparkSession


def plan_mode(spark: SparkSession):
    return spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")


@dataclass
class ChangeCursor:
    """An UPDATE or DELETE that goes on batch by batch: each takes the next rows of the query's order and changes those alone.

    A batch has at most limit rows; the place after the last one is kept, so a row is visited once even if it still matches.
    """

    operation: str
    bucket: str
    query: Any
    spec: Mapping[str, Any] | None
    limit: int
    sort_by: tuple[str, str] | None = None
    collation: Any = None
    last: tuple[Any, Any] | None = None
    done: bool = False

    def advance(self, bucket: Bucket) -> tuple[Bucket, list]:
        """(the bucket after the next batch, the ids that it changed); no ids once exhausted."""
        if self.done:
            return bucket, []
        reading = bucket.cursor(self.query, sort_by=self.sort_by, limit=self.limit, collation=self.collation)
        reading.last = self.last
        ids = [r[bucket.id_col] for r in reading.advance()]
        self.last, self.done = reading.last, not ids
        if not ids:
            return bucket, []
        batch = materialize(bucket.table.where(F.col(bucket.id_col).isin(ids)))
        rest = bucket.table.where(~F.col(bucket.id_col).isin(ids) | F.col(bucket.id_col).isNull())
        if self.operation == "DELETE":
            return replace(bucket, table=rest), ids
        changed, done = replace(bucket, table=batch, indexes={}).update({}, {k: v for k, v in self.spec.items() if k != "upsert"}, collation=self.collation)
        table = rest.unionByName(changed.table, allowMissingColumns=True)
        for one in bucket.indexes.values():
            indexes.check_unique(table, one)
        return replace(bucket, table=table), sorted(r[0] for r in done.collect())


_NAME = re.compile(r"[A-Za-z0-9_-]+(\.[A-Za-z0-9_-]+)*")


class Catalog:
    """Namespaces, each with its buckets; a published version counts commits."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.namespaces: dict[str, dict[str, Bucket]] = {"global": {}}
        self.tombstones: set[str] = set()
        self.version = 0
        #: (namespace, bucket) -> the version that changed it last.
        self.changed: dict[tuple[str, str], int] = {}

    def session(self) -> Session:
        return Session(self)


_ATTRIBUTES = {"input_type": ("json", "bson"), "reply_type": ("json", "json_text", "bson"), "object_id_format": ("hex", "bytes")}


class Session:
    """One client's view: its namespace, attributes, cursors, and at most one transaction."""

    def __init__(self, catalog: Catalog) -> None:
        self.catalog = catalog
        self.namespace = "global"
        self.attributes: dict[str, Any] = {"limit": DEFAULT_LIMIT, "input_type": "json", "reply_type": "json", "object_id_format": "hex"}
        self.cursors: dict[str, dict[int, Cursor | ChangeCursor]] = {"QUERY": {}, "UPDATE": {}, "DELETE": {}}
        self.staged: dict[str, dict[str, Bucket]] | None = None
        self.read_version: int | None = None
        self.read_set: dict[tuple[str, str], None] = {}
        self.snapshot = False
        self._next = 0

    # namespaces

    def _existing(self, name: str) -> str:
        if name not in self.catalog.namespaces or name in self.catalog.tombstones:
            raise BqlError(f"no namespace {name!r}")
        return name

    def namespace_create(self, name: str) -> None:
        if not _NAME.fullmatch(name):
            raise BqlError(f"invalid namespace {name!r}")
        if name in self.catalog.namespaces:
            raise BqlError(f"namespace {name!r} exists")
        parts = name.split(".")
        for i in range(len(parts)):
            self.catalog.namespaces.setdefault(".".join(parts[: i + 1]), {})

    def namespace_use(self, name: str) -> None:
        self.namespace = self._existing(name)

    def namespace_current(self) -> str:
        return self.namespace

    def namespace_exists(self, name: str) -> bool:
        return name in self.catalog.namespaces and name not in self.catalog.tombstones

    def namespace_list(self, parent: str | None = None) -> list[str]:
        """The direct children only."""
        lead = f"{self._existing(parent)}." if parent else ""
        return sorted(n[len(lead) :] for n in self.catalog.namespaces if n.startswith(lead) and "." not in n[len(lead) :] and n not in self.catalog.tombstones)

    def _below(self, name: str) -> list[str]:
        return [n for n in self.catalog.namespaces if n == name or n.startswith(name + ".")]

    def namespace_move(self, old: str, new: str) -> None:
        self._existing(old)
        if new in self.catalog.namespaces or new.startswith(old + "."):
            raise BqlError(f"cannot move {old!r} to {new!r}")
        parent = new.rpartition(".")[0]
        if parent:
            self._existing(parent)
        for n in self._below(old):
            self.catalog.namespaces[new + n[len(old) :]] = self.catalog.namespaces.pop(n)

    def namespace_remove(self, name: str) -> None:
        self._existing(name)
        self.catalog.tombstones |= set(self._below(name))

    def namespace_purge(self, name: str) -> None:
        if name not in self.catalog.tombstones:
            raise BqlError(f"namespace {name!r} is not removed")
        for n in self._below(name):
            self.catalog.namespaces.pop(n)
            self.catalog.tombstones.discard(n)

    # transactions

    def begin(self) -> None:
        if self.staged is not None:
            raise BqlError("a transaction is open")
        self.staged, self.read_version, self.read_set = {}, self.catalog.version, {}

    def snapshot_read(self, on: bool = True) -> None:
        """Reads of the open transaction add no conflicts while on."""
        self.snapshot = on

    def commit(self, returning: str | None = None) -> int | str:
        """Publishes the staged buckets: the committed version, or with RETURNING a versionstamp.

        A bucket that the transaction has read (other than by snapshot) or written, and that another commit changed since, is a conflict.
        """
        if self.staged is None:
            raise BqlError("no transaction is open")
        if returning not in (None, "COMMITTED_VERSION", "VERSIONSTAMP"):
            raise BqlError("COMMIT returns COMMITTED_VERSION or VERSIONSTAMP")
        touched = {(n, b) for n, changed in self.staged.items() for b in changed} | set(self.read_set)
        if self.staged and any(self.catalog.changed.get(t, 0) > self.read_version for t in touched):
            self.rollback()
            raise BqlError("transaction conflict")
        for namespace, changed in self.staged.items():
            self.catalog.namespaces[namespace].update(changed)
        self.catalog.version += bool(self.staged)
        self.catalog.changed |= {(n, b): self.catalog.version for n, changed in self.staged.items() for b in changed}
        self.staged, self.snapshot = None, False
        return f"{self.catalog.version:020x}" if returning == "VERSIONSTAMP" else self.catalog.version

    def close_session(self) -> None:
        """Gives up the open transaction and all cursors."""
        self.staged, self.snapshot = None, False
        for open_ in self.cursors.values():
            open_.clear()

    def rollback(self) -> None:
        if self.staged is None:
            raise BqlError("no transaction is open")
        self.staged, self.snapshot = None, False

    def tick(self) -> int:
        return self.catalog.version

    def get_read_version(self) -> int:
        return self.read_version if self.staged is not None else self.catalog.version

    def set_attribute(self, name: str, value: Any) -> None:
        if name not in self.attributes:
            raise BqlError(f"unknown session attribute {name!r}")
        allowed = _ATTRIBUTES.get(name)
        if name == "limit" and (isinstance(value, bool) or not isinstance(value, int) or value < 0) or allowed and value not in allowed:
            raise BqlError(f"invalid value {value!r} of session attribute {name!r}")
        self.attributes[name] = value

    def get_attribute(self, name: str) -> Any:
        if name not in self.attributes:
            raise BqlError(f"unknown session attribute {name!r}")
        return self.attributes[name]

    def list_attributes(self) -> dict[str, Any]:
        return dict(self.attributes)

    # buckets

    def _put(self, bucket: Bucket) -> None:
        if self.staged is not None:
            self.staged.setdefault(self.namespace, {})[bucket.name] = bucket
        else:
            self.catalog.namespaces[self._existing(self.namespace)][bucket.name] = bucket
            self.catalog.version += 1
            self.catalog.changed[self.namespace, bucket.name] = self.catalog.version

    def bucket(self, name: str) -> Bucket:
        found = (self.staged or {}).get(self.namespace, {}).get(name) or self.catalog.namespaces[self._existing(self.namespace)].get(name)
        if found is None or found.removed:
            raise BqlError(f"no bucket {name!r}")
        if self.staged is not None and not self.snapshot:
            self.read_set[self.namespace, name] = None
        return found

    def approximate_size(self) -> int:
        """Bytes of the namespace's buckets, as the planner expects them."""
        return sum(self.bucket(n).approximate_size() for n in self.list_buckets())

    def create(self, name: str, table: DataFrame | None = None, *, indexes: Mapping[str, Any] | None = None, collation: Any = None, id_col: str = ID, if_not_exists: bool = False, dynamic: bool = False) -> Bucket:
        if name in self.catalog.namespaces[self._existing(self.namespace)]:
            if if_not_exists:
                return self.bucket(name)
            raise BqlError(f"bucket {name!r} exists")
        table = table if table is not None else self.catalog.spark.createDataFrame([], f"{id_col} string" + (f", {DOCUMENT} variant" if dynamic else ""))
        made = Bucket(name, table, id_col, collation=Collation.of(collation))
        made = made.create_index(indexes) if indexes else made
        self._put(made)
        return made

    def list_buckets(self) -> list[str]:
        return sorted(n for n, b in self.catalog.namespaces[self._existing(self.namespace)].items() if not b.removed)

    def insert(self, name: str, documents: Any) -> None:
        """A frame, or documents: BSON ones as bytes where the session's input_type says so."""
        if self.attributes["input_type"] == "bson" and not isinstance(documents, DataFrame):
            documents = [json.loads(as_json(decode(d))) for d in documents]
        self._put(self.bucket(name).insert(documents))

    def query(self, name: str, query: Any = None, **options: Any) -> DataFrame:
        """The rows of a query; one column of JSON or BSON documents where the session's reply_type asks for it."""
        options.setdefault("limit", self.attributes["limit"])
        rows = self.bucket(name).query(query, **options)
        if self.attributes["reply_type"] == "json":
            return rows
        texts = to_json(rows)
        return texts if self.attributes["reply_type"] == "json_text" else to_bson(texts, "json")

    def update(self, name: str, query: Any, spec: Mapping[str, Any], **options: Any) -> DataFrame:
        changed, ids = self.bucket(name).update(query, spec, **options)
        self._put(changed)
        return ids

    def delete(self, name: str, query: Any, **options: Any) -> DataFrame:
        changed, ids = self.bucket(name).delete(query, **options)
        self._put(changed)
        return ids

    def remove(self, name: str) -> None:
        self._put(replace(self.bucket(name), removed=True))

    def purge(self, name: str) -> None:
        found = self.catalog.namespaces[self.namespace].get(name)
        if found is None or not found.removed:
            raise BqlError(f"bucket {name!r} is not removed")
        del self.catalog.namespaces[self.namespace][name]

    # cursors

    def open_cursor(self, name: str, query: Any = None, operation: str = "QUERY", spec: Mapping[str, Any] | None = None, **options: Any) -> int:
        """A cursor's id; ``advance`` reads, updates by spec, or deletes the next rows, at most limit of them."""
        options.setdefault("limit", self.attributes["limit"])
        if operation not in self.cursors:
            raise BqlError(f"unknown operation {operation!r}")
        if (spec is None) != (operation != "UPDATE"):
            raise BqlError("a cursor takes an update if it is one of UPDATE")
        self._next += 1
        self.cursors[operation][self._next] = self.bucket(name).cursor(query, **options) if operation == "QUERY" else ChangeCursor(operation, name, query, spec, **options)
        return self._next

    def advance(self, operation: str, cursor: int) -> list:
        """The next rows of a query, or the ids that an update or a delete has changed next; empty once exhausted."""
        if cursor not in self.cursors.get(operation, {}):
            raise BqlError(f"no cursor {cursor}")
        found = self.cursors[operation][cursor]
        if isinstance(found, Cursor):
            return found.advance()
        changed, ids = found.advance(self.bucket(found.bucket))
        if ids:
            self._put(changed)
        return ids

    def close(self, operation: str, cursor: int) -> None:
        if self.cursors[operation].pop(cursor, None) is None:
            raise BqlError(f"no cursor {cursor}")

    def list_cursors(self, operation: str | None = None) -> dict[str, list[int]]:
        return {op: sorted(c) for op, c in self.cursors.items() if operation in (None, op)}
