"""Where transactions go. A sink's write returns once they are durable, and raises else."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
import uuid
from collections.abc import Callable, Sequence
from typing import Any, Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deltaview.model import WEIGHT
from deltaview.operators import log, zset
from deltaview.streaming import files


class SinkError(RuntimeError):
    """Changes could not be delivered."""


class ConfigError(SinkError):
    """A sink that cannot be built."""


class WriteError(SinkError):
    """The target could not be reached, or failed."""


class RejectedError(SinkError):
    """The target refused the changes."""


class Sink(Protocol):
    def write(self, changes: DataFrame, batch_id: int) -> None: ...


def _in_order(changes: DataFrame):
    """Transactions as JSON envelopes, one at a time to the driver, by commit position."""
    packed = log.transactions(changes).select("commit_lsn", F.to_json(F.struct("commit_lsn", "changes"), {"ignoreNullFields": "false"}).alias("body"))
    return packed.orderBy("commit_lsn").toLocalIterator()


class ConsoleSink:
    """A header line per transaction, then a line per change and one for each of its images."""

    def __init__(self, out: Callable[[str], Any] = print):
        self.out = out

    def write(self, changes: DataFrame, batch_id: int) -> None:
        for row in _in_order(changes):
            txn = json.loads(row["body"])
            self.out(f"=== txn commit_lsn={txn['commit_lsn']} changes={len(txn['changes'])} ===")
            for c in txn["changes"]:
                self.out(f"  {c['op']} {c['namespace']}.{c['table']} lsn={c['lsn']} #{c['index_in_txn']}")
                for side, label in (("before", "before: "), ("after", "after:  ")):
                    if c["op"] != "T" and c[side] is not None:
                        self.out(f"    {label}{json.dumps(c[side], ensure_ascii=False)}")


class HttpSink:
    """POSTs a JSON envelope per transaction; any 2xx answer means durable.

    Delivery is in order of commit, one transaction at a time, so it runs on the driver.
    """

    def __init__(self, url: str, attempts: int = 8, backoff: float = 0.1, timeout: float = 10.0, sleep: Callable[[float], None] = time.sleep):
        if not url.startswith(("http://", "https://")):
            raise ConfigError(f"not an HTTP address: {url!r}")
        self.url, self.attempts, self.backoff, self.timeout, self.sleep = url, attempts, backoff, timeout, sleep

    def write(self, changes: DataFrame, batch_id: int) -> None:
        for row in _in_order(changes):
            self._post(row["body"].encode())

    def _post(self, body: bytes) -> None:
        wait, why = self.backoff, "no attempts made"
        for attempt in range(1, self.attempts + 1):
            request = urllib.request.Request(self.url, body, {"Content-Type": "application/json"}, method="POST")
            try:
                with urllib.request.urlopen(request, timeout=self.timeout):
                    return
            except urllib.error.HTTPError as e:
                why = f"attempt {attempt}: HTTP {e.code}"
            except OSError as e:
                why = f"attempt {attempt}: {e}"
            if attempt < self.attempts:
                self.sleep(wait)
                wait *= 2
        raise WriteError(why)


class VersionedTableSink:
    """Appends every change with its version to `<path>/<namespace>.<table>/batch=<id>`, so that a
    batch that is delivered twice replaces itself. `read` collapses keys to their latest version."""

    def __init__(self, path: str, keys: dict[str, list[str]]):
        self.path, self.keys = path.rstrip("/"), keys

    def _key(self, name: str, columns: Sequence[str]) -> list[str]:
        key = self.keys.get(name) or [columns[0]]
        if missing := set(key) - set(columns):
            raise RejectedError(f"{name} has no key column {', '.join(sorted(missing))}")
        return key

    def write(self, changes: DataFrame, batch_id: int) -> None:
        columns = changes.schema["after"].dataType.names
        for t in changes.select("namespace", "table").distinct().collect():
            name = f"{t['namespace']}.{t['table']}"
            own = changes.where((F.col("namespace") == t["namespace"]) & (F.col("table") == t["table"]))
            log.versions(own, self._key(name, columns)).write.mode("overwrite").parquet(f"{self.path}/{name}/batch={batch_id}")
            cut = own.where(F.col("op") == "T").agg(F.max("commit_lsn").alias("_version"), F.max(F.struct("commit_lsn", "index_in_txn"))["index_in_txn"].alias("_index")).where("_version is not null")
            cut.write.mode("overwrite").parquet(f"{self.path}/{name}.truncates/batch={batch_id}")

    def read(self, spark: SparkSession, name: str) -> DataFrame:
        """The table as it stands: rows after its last truncate, latest versions, no deletions."""
        rows = spark.read.parquet(f"{self.path}/{name}").drop("batch")
        cut = spark.read.parquet(f"{self.path}/{name}.truncates").agg(F.max(F.struct("_version", "_index"))).scalar()
        rows = rows.where(F.coalesce(F.struct("_version", "_index") > cut, F.lit(True)))
        columns = [c for c in rows.columns if c not in ("namespace", "table", "_version", "_index", "_is_deleted")]
        return log.latest(rows, self._key(name, columns)).select(*columns)


class ColumnarHttpSink:
    """A columnar store with an HTTP query interface and versioned replacement of rows.

    Tables are made from the schema, ordered by the plan's key (else the first column), with
    `_version` (the commit position) and `_is_deleted`. A batch is one INSERT per table, in
    JSON lines; rows of one key keep their order. A truncate empties the table first, and what
    a batch held before it is left out. A table's name holds its namespace.
    """

    #: The store's name of each Spark type.
    TYPES = {"bigint": "Int64", "int": "Int64", "double": "Float64", "boolean": "Bool"}

    def __init__(self, url: str, database: str, keys: dict[str, list[str]] | None = None, timeout: float = 10.0, rows_per_request: int = 50_000):
        if not url.startswith(("http://", "https://")):
            raise ConfigError(f"not an HTTP address: {url!r}")
        self.url, self.database, self.keys, self.timeout, self.rows = url.rstrip("/"), database, keys or {}, timeout, rows_per_request
        self.made: set[str] = set()

    def _send(self, sql: str, body: bytes = b"") -> None:
        request = urllib.request.Request(f"{self.url}/?{urllib.parse.urlencode({'query': sql})}", body, method="POST")
        try:
            with urllib.request.urlopen(request, timeout=self.timeout):
                return
        except urllib.error.HTTPError as e:
            kind = RejectedError if e.code < 500 else WriteError
            raise kind(f"HTTP {e.code}: {e.read(300).decode('utf-8', 'replace')}") from e
        except OSError as e:
            raise WriteError(str(e)) from e

    def _table(self, name: str) -> str:
        quote = lambda x: '"' + x.replace("\\", "\\\\").replace('"', '\\"') + '"'
        return f"{quote(self.database)}.{quote(name)}"

    def ddl(self, name: str, columns: Sequence[tuple[str, str]]) -> str:
        key = self.keys.get(name) or [columns[0][0]]
        kinds = ((c, self.TYPES.get(kind, "String")) for c, kind in columns)
        body = ", ".join(f'"{c}" {kind if c in key else f"Nullable({kind})"}' for c, kind in kinds)
        order = ", ".join(f'"{c}"' for c in key)
        return f"CREATE TABLE IF NOT EXISTS {self._table(name)} ({body}, _version UInt64, _is_deleted UInt8) ENGINE = ReplacingMergeTree(_version) ORDER BY ({order})"

    def write(self, changes: DataFrame, batch_id: int) -> None:
        image = changes.schema["after"].dataType
        for t in changes.select("namespace", "table").distinct().collect():
            name = f"{t['namespace']}.{t['table']}"
            own = changes.where((F.col("namespace") == t["namespace"]) & (F.col("table") == t["table"]))
            if name not in self.made:
                self._send(self.ddl(name, [(f.name, f.dataType.simpleString()) for f in image.fields]))
                self.made.add(name)
            if not own.where("op = 'T'").isEmpty():
                self._send(f"TRUNCATE TABLE {self._table(name)}")
            rows = log.versions(zset.since_truncate(own), self.keys.get(name) or [image.names[0]])
            line = F.to_json(F.struct(*image.names, "_version", F.col("_is_deleted").cast("int").alias("_is_deleted")), {"ignoreNullFields": "false"})
            self._insert(name, (r["line"] for r in rows.orderBy("_version", "_index", ~F.col("_is_deleted")).select(line.alias("line")).toLocalIterator()))

    def _insert(self, name: str, lines) -> None:
        waiting: list[str] = []
        for x in lines:
            waiting.append(x)
            if len(waiting) == self.rows:
                self._send(f"INSERT INTO {self._table(name)} FORMAT JSONEachRow", "\n".join(waiting).encode())
                waiting = []
        if waiting:
            self._send(f"INSERT INTO {self._table(name)} FORMAT JSONEachRow", "\n".join(waiting).encode())


class ViewTableSink:
    """Keeps the canonical rows of a view in buckets of Parquet files; a batch's delta is added to
    the buckets that it touches, and the others stay as they are.

    `current.json` says which folder holds each bucket, and what the state has taken in: the last
    commit position, and the last batch (snapshot rows have no position). It is replaced last, so a
    batch that fails is done again from the state before it, and one that comes again adds
    nothing. A truncate takes away what the state holds of its table, whatever its weight.
    `shape` turns a delta into the view's rows, as a reference join does; None takes it as it is.
    """

    def __init__(self, path: str, buckets: int = 16, shape: Callable[[DataFrame], DataFrame] | None = None):
        self.path, self.buckets, self.shape = path.rstrip("/"), buckets, shape

    def _held(self, spark: SparkSession) -> dict[str, Any]:
        return files.load(spark, f"{self.path}/current.json") or {"lsn": 0, "batch": -1, "buckets": {}, "schema": None}

    def _rows(self, spark: SparkSession, held: dict[str, Any], buckets: Sequence[str]) -> DataFrame:
        schema = T.StructType.fromJson(held["schema"])
        paths = [f"{self.path}/{held['buckets'][b]}/_bucket={b}" for b in buckets if b in held["buckets"]]
        return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)

    def write(self, changes: DataFrame, batch_id: int) -> None:
        spark, held = changes.sparkSession, self._held(changes.sparkSession)
        snapshot = F.col("commit_lsn") == log.SNAPSHOT_LSN
        fresh = changes.where((F.col("commit_lsn") > held["lsn"]) | (snapshot & F.lit(batch_id > held["batch"])))
        fresh = fresh.withColumn("_table", F.concat_ws(".", "namespace", "table")).persist()
        try:
            last = fresh.agg(F.max("commit_lsn")).head()[0]
            if last is None:
                return
            emptied = [r["_table"] for r in fresh.where("op = 'T'").select("_table").distinct().collect()]
            delta = zset.delta(zset.since_truncate(fresh), ["_table"])
            delta = zset.canonical(delta if self.shape is None else self.shape(delta))
            columns = sorted(c for c in delta.columns if c != WEIGHT)
            bucket = F.pmod(F.xxhash64(*columns), F.lit(self.buckets)).cast("string")
            delta = delta.withColumn("_bucket", bucket).persist()
            touched = list(held["buckets"]) if emptied else []
            touched = sorted({*touched, *(r["_bucket"] for r in delta.select("_bucket").distinct().collect())})
            folder = f"state-{batch_id}-{uuid.uuid4().hex[:8]}"
            rows = delta.drop("_bucket")
            if held["schema"]:
                rows = zset.canonical(zset.merge(self._rows(spark, held, touched).where(~F.col("_table").isin(emptied)), rows))
            rows.withColumn("_bucket", bucket).write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
            made = {n.removeprefix("_bucket=") for n in files.names(spark, f"{self.path}/{folder}") if n.startswith("_bucket=")}
            kept = {b: f for b, f in held["buckets"].items() if b not in touched}
            files.save(spark, f"{self.path}/current.json", {"lsn": max(held["lsn"], last), "batch": max(held["batch"], batch_id), "buckets": kept | dict.fromkeys(made, folder), "schema": json.loads(rows.schema.json())})
            for b in touched:
                if b in held["buckets"]:
                    files.remove(spark, f"{self.path}/{held['buckets'][b]}/_bucket={b}")
            delta.unpersist()
        finally:
            fresh.unpersist()

    def read(self, spark: SparkSession) -> DataFrame | None:
        """The view's rows with their weights; None before the first batch."""
        held = self._held(spark)
        if not held["schema"]:
            return None
        return zset.canonical(self._rows(spark, held, list(held["buckets"])).drop("_table"))


class FanOutSink:
    """Delivers to several sinks, one after another; the first failure ends the batch, so that
    sinks before it may see it again."""

    def __init__(self, sinks: Sequence[Sink]):
        self.sinks = list(sinks)

    def write(self, changes: DataFrame, batch_id: int) -> None:
        changes = changes.persist()
        try:
            for sink in self.sinks:
                sink.write(changes, batch_id)
        finally:
            changes.unpersist()


def build(spec: dict[str, Any] | None, keys: dict[str, list[str]] | None = None) -> Sink:
    """A sink from a plan's `sink` section; console if there is none."""
    spec = spec or {"type": "console"}
    kind = spec.get("type")
    try:
        if kind == "console":
            return ConsoleSink()
        if kind == "http":
            return HttpSink(spec["url"])
        if kind == "columnar":
            return ColumnarHttpSink(spec["url"], spec["database"], keys)
        if kind == "table":
            return VersionedTableSink(spec["path"], keys or {})
        if kind == "fanout":
            return FanOutSink([build(s, keys) for s in spec["sinks"]])
    except KeyError as e:
        raise ConfigError(f"sink {kind!r} lacks {e}") from e
    raise ConfigError(f"unknown sink {kind!r}")
