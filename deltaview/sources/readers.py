"""Change logs from files of replication events, as batches and as streams.

An event file holds rows (seq long, kind string, lsn long, payload binary) in order of seq;
captures of a replication stream are kept so. Images come as map<string, string>;
`typed` gives them a table's columns. Besides changes there are rows of op "R", definitions
of relations, and "H", heartbeats, which `typed` leaves out.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from deltaview.functions.values import decode
from deltaview.model import type_of_oid
from deltaview.sources.pgoutput import HEARTBEATS, Column, Decoder, Relation, transactions

RAW_SCHEMA = "commit_lsn long, lsn long, index_in_txn int, relation_id long, namespace string, `table` string, op string, before map<string,string>, after map<string,string>, unchanged array<string>"


def _system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


def _names(path: str) -> list[str]:
    system, at = _system(path)
    if system.get_file_info(at).type != fs.FileType.Directory:
        return [path]
    return sorted(f"{path.rstrip('/')}/{f.base_name}" for f in system.get_file_info(fs.FileSelector(at)) if f.base_name.endswith(".parquet"))


def _file(name: str) -> pq.ParquetFile:
    system, at = _system(name)
    return pq.ParquetFile(system.open_input_file(at))


def _events(names: list[str]) -> Iterator[tuple[str, int, bytes]]:
    for name in names:
        for batch in _file(name).iter_batches(columns=["kind", "lsn", "payload"]):
            yield from zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)


@dataclass(frozen=True)
class EventFile:
    """What is to be known of an event file without its rows' payloads."""

    name: str
    stamp: tuple[int, int]  # size and time of change
    last: int  # the last position that ends a transaction or is a heartbeat; 0: none
    open: bool  # ends inside a transaction
    relations: tuple[tuple[int, bytes], ...]  # relation messages with their positions


def _index(path: str, known: dict[str, EventFile]) -> list[EventFile]:
    """The files in order. Only those that are new or have changed are read, without row payloads."""
    out = []
    for name in _names(path):
        system, at = _system(name)
        about = system.get_file_info(at)
        stamp = (about.size, about.mtime_ns)
        if name not in known or known[name].stamp != stamp:
            file = _file(name)
            last, inside, relations = 0, bool(out) and out[-1].open, []
            for batch in file.iter_batches(columns=["kind", "lsn", "payload"]):
                starts = pc.equal(pc.binary_slice(pc.cast(batch.column(2), pa.binary()), 0, 1), b"R")
                kinds = batch.column(0)
                some = pc.or_kleene(pc.not_equal(kinds, "data"), starts).fill_null(False)
                for kind, lsn, payload in zip(*(batch.column(i).filter(some).to_pylist() for i in range(3)), strict=True):
                    if kind == "begin":
                        inside = True
                    elif kind == "commit":
                        last, inside = max(last, lsn), False
                    elif kind in HEARTBEATS and not inside:
                        last = max(last, lsn)
                    elif kind == "data":
                        relations.append((lsn, payload))
            known[name] = EventFile(name, stamp, last, inside, tuple(relations))
        out.append(known[name])
    return out


def _needed(files: list[EventFile], after: int, upto: int | None) -> tuple[list[str], list[bytes]]:
    """The files that hold the transactions after a position up to another, and the relations defined before them."""
    first = next((i for i, f in enumerate(files) if f.last > after), len(files))
    while first > 0 and files[first - 1].open:
        first -= 1
    last = next((i for i, f in enumerate(files) if upto is not None and f.last >= upto), len(files) - 1)
    return [f.name for f in files[first : last + 1]], [r for f in files[:first] for _, r in f.relations]


def _rows(names: list[str], relations: list[bytes], layout: str, after: int, upto: int | None = None) -> Iterator[tuple]:
    """Rows of whole transactions committed after a position, up to another."""
    decoder = Decoder(layout)
    for r in relations:
        decoder.decode(r)
    for commit_lsn, changes in transactions(_events(names), decoder, control=True):
        if commit_lsn <= after or upto is not None and commit_lsn > upto:
            continue
        for c in changes:
            yield (commit_lsn, c["lsn"], c["index_in_txn"], c["relation_id"], c["namespace"], c["table"], c["op"], c["before"], c["after"], c["unchanged"])


class _Batch(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def read(self, partition) -> Iterator[tuple]:
        after = int(self.options.get("startlsn", 0))
        names, relations = _needed(_index(self.options["path"], {}), after, None)
        return _rows(names, relations, self.options.get("layout", "protocol"), after)


class _Between(InputPartition):
    def __init__(self, start: int, end: int, names: list[str], relations: list[bytes]):
        super().__init__(0)
        self.start, self.end, self.names, self.relations = start, end, names, relations


class _Stream(DataSourceStreamReader):
    """Offsets are positions of commits and heartbeats, so that a batch never splits a transaction.
    What lies between two offsets is read again in the same way after a failure. The driver keeps
    an index of the files; a batch reads the files that hold its transactions."""

    def __init__(self, options: dict[str, str]):
        self.options = options
        self.start = int(options.get("startlsn", 0))
        self.known: dict[str, EventFile] = {}

    def initialOffset(self) -> dict:
        return {"lsn": self.start}

    def latestOffset(self) -> dict:
        return {"lsn": max([self.start, *(f.last for f in _index(self.options["path"], self.known))])}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        names, relations = _needed(_index(self.options["path"], self.known), start["lsn"], end["lsn"])
        return [_Between(start["lsn"], end["lsn"], names, relations)]

    def read(self, partition: _Between) -> Iterator[tuple]:
        return _rows(partition.names, partition.relations, self.options.get("layout", "protocol"), partition.start, partition.end)

    def commit(self, end: dict) -> None:
        pass


class ReplicationLog(DataSource):
    """`spark.read.format("replication_log")`, and readStream. Options: path, layout, startLsn. One replication stream is one ordered log: it is read by one task."""

    @classmethod
    def name(cls) -> str:
        return "replication_log"

    def schema(self) -> str:
        return RAW_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Batch(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the source known, and let Python workers import this package when only the driver has it on its path."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)
    spark.dataSource.register(ReplicationLog)


def typed(raw: DataFrame, relation: Relation) -> DataFrame:
    """The changes of one relation with typed images; values that don't parse are null."""
    image = lambda side: F.when(F.col(side).isNotNull(), F.struct(*(decode(F.col(side)[c.name], c.type_oid).cast(type_of_oid(c.type_oid)).alias(c.name) for c in relation.columns)))
    own = raw.where((F.col("namespace") == relation.namespace) & (F.col("table") == relation.name) & F.col("op").isin("I", "U", "D", "T"))
    return own.select("commit_lsn", "lsn", "index_in_txn", "namespace", "table", "op", image("before").alias("before"), F.when(F.col("op") != "T", image("after")).alias("after"), "unchanged")


def relation_of(text: str) -> Relation:
    """A relation from JSON: {"id", "namespace", "name", "columns": [["name", oid], ...]}."""
    d = json.loads(text)
    return Relation(d["id"], d["namespace"], d["name"], tuple(Column(n, o) for n, o in d["columns"]))


def read_snapshot(spark: SparkSession, path: str | None = None, url: str | None = None, table: str | None = None, **options: str) -> DataFrame:
    """A table's rows, from Parquet files or through JDBC (with partitioning options for large tables)."""
    if path:
        return spark.read.parquet(path)
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()
