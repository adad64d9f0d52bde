"""Kept views, several tables behind one position, drift, heartbeats, stops, and the ops loop."""

import json
import sqlite3
import threading

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from test_streaming import HISTORY, RELATION, insert, relation_bytes, users, write_events

from deltaview import cli
from deltaview.operators import log, refjoin, views
from deltaview.plans.document import Plan
from deltaview.sinks import sinks
from deltaview.sources import readers, snapshot
from deltaview.sources.config import ReaderConfig
from deltaview.sources.pgoutput import Column
from deltaview.streaming import files
from deltaview.streaming.engine import Checkpoint, Engine, JoinedView, Runner, Stopped, view_aggregates
from deltaview.streaming.metrics import Metrics
from deltaview.streaming.ops import OpsLoop
from deltaview.streaming.windowed import WindowedView


def rows_of_view(spark, view):
    return {tuple(r) for r in view.read(spark).collect()}


def test_state_files(spark, tmp_path):
    path = f"file://{tmp_path}/a/state.json"
    assert files.load(spark, path) is None
    for value in ({"x": [1, "é"]}, {"x": 2}):
        files.save(spark, path, value)
        assert files.load(spark, path) == value
    assert "state.json" in files.names(spark, f"{tmp_path}/a") and files.names(spark, f"{tmp_path}/none") == []


def test_view_replay(spark, tmp_path):
    """Batches that come again, and a batch whose first part was taken in."""
    view = sinks.ViewTableSink(str(tmp_path / "v"))
    assert view.read(spark) is None
    first = users(spark, [("I", None, (1, "a")), ("I", None, (2, "b"))], 10)
    for batch in (0, 0, 5):  # 5: the stream's own numbers began anew
        view.write(first, batch)
    assert rows_of_view(spark, view) == {(1, "a", 1), (2, "b", 1)}
    view.write(first.unionByName(users(spark, [("D", (1, "a"), None)], 20)), 6)
    assert rows_of_view(spark, view) == {(2, "b", 1)}
    view.write(users(spark, [("D", (2, "b"), None)], 30), 7)
    assert rows_of_view(spark, view) == set()
    snap = log.snapshot(spark.createDataFrame([(1, "s")], "id long, name string"), "public", "users")
    for _ in range(2):
        view.write(snap, 8)
    assert rows_of_view(spark, view) == {(1, "s", 1)}


def test_view_buckets(spark, tmp_path):
    """A batch rewrites the buckets that it touches, and old ones are deleted."""
    view = sinks.ViewTableSink(str(tmp_path / "v"), buckets=8)
    view.write(users(spark, [("I", None, (i, str(i))) for i in range(100)], 10), 0)
    before = files.load(spark, f"{tmp_path}/v/current.json")["buckets"]
    view.write(users(spark, [("I", None, (100, "x"))], 20), 1)
    after = files.load(spark, f"{tmp_path}/v/current.json")["buckets"]
    changed = [b for b in after if after[b] != before.get(b)]
    assert len(before) == 8 and len(changed) == 1 and view.read(spark).count() == 101
    assert f"_bucket={changed[0]}" not in files.names(spark, f"{tmp_path}/v/{before[changed[0]]}")


def test_view_truncate(spark, tmp_path):
    view = sinks.ViewTableSink(str(tmp_path / "v"))
    view.write(users(spark, [("I", None, (1, "a")), ("I", None, (1, "a")), ("I", None, (2, "b"))], 10), 0)
    other = users(spark, [("I", None, (1, "a"))], 20).withColumn("table", F.lit("others"))
    view.write(other, 1)
    assert rows_of_view(spark, view) == {(1, "a", 3), (2, "b", 1)}
    cut = users(spark, [("I", None, (8, "before")), ("T", None, None), ("I", None, (9, "after"))], 30)
    for _ in range(2):
        view.write(cut, 2)
    assert rows_of_view(spark, view) == {(1, "a", 1), (9, "after", 1)}


class FailsOnce:
    """A checkpoint that fails between the view and the position."""

    def __init__(self, checkpoint):
        self.inner, self.failed = checkpoint, False

    def __getattr__(self, name):
        return getattr(self.inner, name)

    def advance(self, *args):
        if not self.failed:
            self.failed = True
            raise OSError("crash")
        self.inner.advance(*args)


def test_crash_between_view_and_position(spark, tmp_path):
    view = sinks.ViewTableSink(str(tmp_path / "v"))
    checkpoint = FailsOnce(Checkpoint(str(tmp_path / "position.json"), spark))
    engine = Engine("public.users", Plan(), sinks.ConsoleSink(lambda _: None), checkpoint, view)
    batch = users(spark, [("I", None, (1, "a")), ("U", (1, "a"), (1, "b"))], 10)
    with pytest.raises(OSError):
        engine.process(batch, 0)
    assert Checkpoint(str(tmp_path / "position.json"), spark).lsn == 0
    engine.process(batch, 0)
    assert Checkpoint(str(tmp_path / "position.json"), spark).lsn == 10 and rows_of_view(spark, view) == {(1, "b", 1)}


def test_windows_truncate(spark, tmp_path):
    at = lambda rows, commit, op="I": spark.createDataFrame([(commit, commit, i, "public", "t", op, None, r, []) for i, r in enumerate(rows)], "commit_lsn long, lsn long, index_in_txn int, namespace string, `table` string, op string, before struct<ts:long,v:long>, after struct<ts:long,v:long>, unchanged array<string>")
    config, metrics = views.ViewConfig((), "v", True, views.WindowSpec("ts", 1000)), Metrics()
    view = WindowedView(f"{tmp_path}/w", config, 5000, spark, metrics)
    view.write(at([(100, 1), (200, 2)], 10), 0)
    view.write(at([None], 20, "T").unionByName(at([(300, 7)], 30)), 1)
    assert [(r["window_start"], r["count"], r["sum"]) for r in view.open_windows(spark).collect()] == [(0, 1, 7)]
    view.write(at([(9000, 1)], 40), 2)
    view = WindowedView(f"{tmp_path}/w", config, 5000, spark, metrics)
    view.write(at([(400, 1)], 50), 3)
    assert metrics["late"] == 1 and view.state["dropped_late"] == 1


def test_joined_view(spark, tmp_path):
    reference = lambda rows, commit: spark.createDataFrame([(commit, commit, i, "public", "tiers", op, b, a, []) for i, (op, b, a) in enumerate(rows)], "commit_lsn long, lsn long, index_in_txn int, namespace string, `table` string, op string, before struct<uid:long,tier:string>, after struct<uid:long,tier:string>, unchanged array<string>")
    view = JoinedView(str(tmp_path / "j"), views.JoinSpec("id", "uid"))
    assert view.reference_len(spark) == 0
    view.apply_reference(reference([("I", None, (1, "gold")), ("I", None, (2, "tin"))], 5), 0)
    view.write(users(spark, [("I", None, (1, "a")), ("I", None, (3, "c"))], 10), 0)
    view.apply_reference(reference([("U", (1, "gold"), (1, "silver"))], 15), 1)
    view.write(users(spark, [("I", None, (1, "later"))], 20), 1)
    view = JoinedView(str(tmp_path / "j"), views.JoinSpec("id", "uid"))  # all of it is on disk
    assert view.reference_len(spark) == 2 and refjoin.reference_len(spark.createDataFrame([(1,), (1,)], "x int")) == 1
    assert {(r["id"], r["name"], r["tier"]) for r in view.read(spark).collect()} == {(1, "a", "gold"), (3, "c", None), (1, "later", "silver")}
    assert {tuple(r) for r in view_aggregates(view.read(spark), views.ViewConfig(("tier",), count=True)).collect()} == {("gold", 1), (None, 1), ("silver", 1)}


def runner_of(spark, tmp_path, plan=None):
    checkpoint = Checkpoint(str(tmp_path / "position.json"), spark)
    engine = Engine("public.users", plan or Plan(), sinks.ConsoleSink(lambda _: None), checkpoint, sinks.ViewTableSink(str(tmp_path / "v")))
    return Runner({"public.users": (RELATION, engine)}, checkpoint, metrics=engine.metrics)


def events_file(path, events):
    kind, lsn, payload = zip(*events, strict=True)
    pq.write_table(pa.table({"seq": list(range(len(events))), "kind": list(kind), "lsn": list(lsn), "payload": list(payload)}), path)


def test_runner(spark, tmp_path):
    """Drift and heartbeats across restarts, over files that are added one by one."""
    readers.register(spark)
    log_dir = tmp_path / "log"
    log_dir.mkdir()

    def run():
        runner = runner_of(spark, tmp_path, Plan.parse("tables: {public.users: [{type: filter, op: ne, column: name, value: b}]}"))
        raw = spark.readStream.format("replication_log").option("path", str(log_dir)).load()
        runner.start(raw, str(tmp_path / "stream"), availableNow=True).awaitTermination()
        return runner

    write_events(log_dir / "0.parquet", HISTORY[:2])
    first = run()
    assert [d.kind for d in first.drifts] == ["new_relation"] and first.checkpoint.lsn == 29
    # The second file starts with a transaction that the first relation message describes, and ends inside another one.
    events_file(log_dir / "1.parquet", [("begin", 30, b""), ("data", 31, insert("3", "c")), ("commit", 39, b""), ("heartbeat", 45, b""), ("begin", 50, b""), ("data", 51, insert("4", "d"))])
    second = run()
    assert second.drifts == [] and second.checkpoint.lsn == 45 and second.metrics["changes"] == 1
    wider = (*RELATION.columns, Column("extra", 25))
    events_file(log_dir / "2.parquet", [("data", 52, insert("5", "e")), ("commit", 59, b""), ("begin", 60, b""), ("data", 61, relation_bytes(columns=wider)), ("data", 62, insert("6", "f", "x")), ("commit", 69, b"")])
    third = run()
    assert [(d.kind, d.column) for d in third.drifts] == [("column_added", "extra")] and third.metrics["drift"] == 1 and third.checkpoint.lsn == 69
    assert rows_of_view(spark, third.engines["public.users"][1].view) == {(1, "A", 1), (3, "c", 1), (4, "d", 1), (5, "e", 1), (6, "f", 1)}


def test_index_reads_what_is_needed(tmp_path):
    (tmp_path / "log").mkdir()
    for i in range(4):
        events_file(tmp_path / f"log/{i}.parquet", [*([("data", 0, relation_bytes())] if i == 0 else []), ("begin", 10 * i + 1, b""), ("data", 10 * i + 2, insert(str(i), "x")), ("commit", 10 * i + 9, b"")])
    index = readers._index(str(tmp_path / "log"), {})
    names, relations = readers._needed(index, 19, 29)
    assert [n[-9:] for n in names] == ["2.parquet"] and len(relations) == 1
    assert [r[0] for r in readers._rows(names, relations, "protocol", 19, 29)] == [29]
    assert readers._needed(index, 39, None)[0] == []


def test_stop(spark, tmp_path):
    """A stop waits for the batch that runs; batches after it are not delivered."""
    runner = runner_of(spark, tmp_path)
    ended = []

    class Query:
        def stop(self):
            ended.append(runner.busy.locked())

    with runner.busy:
        thread = threading.Thread(target=runner.stop, args=(Query(),))
        thread.start()
        thread.join(0.3)
        assert not ended
    thread.join()
    assert ended == [True]
    with pytest.raises(Stopped):
        runner.process(spark.createDataFrame([], readers.RAW_SCHEMA), 0)


def test_cli_run(spark, tmp_path, capsys):
    """The view stands behind the plan."""
    files_dir = tmp_path / "log.parquet"
    write_events(files_dir, HISTORY)
    (tmp_path / "plan.yaml").write_text("tables: {public.users: [{type: redact, columns: [name]}]}\nsink: {type: table, path: '" + str(tmp_path / "table") + "'}\n")
    relation = {"id": 1, "namespace": "public", "name": "users", "columns": [["id", 23], ["name", 25]]}
    env = {"DELTAVIEW_LOG": str(files_dir), "DELTAVIEW_RELATION": json.dumps(relation), "DELTAVIEW_PLAN": str(tmp_path / "plan.yaml"), "DELTAVIEW_CHECKPOINT": str(tmp_path / "c.json"), "DELTAVIEW_STATE": str(tmp_path / "state"), "DELTAVIEW_VIEW": "name:count"}
    assert cli.run(env) == 0
    out = capsys.readouterr().out.splitlines()
    assert json.loads(out[-2]) == {"name": "***", "count": 3} and "txns=4" in out[-1] and "drift=1" in out[-1]


def test_snapshot_envelopes(spark):
    rows = log.snapshot(spark.range(2500).selectExpr("id", "'x' as name"), "public", "users")
    sizes = [len(r["changes"]) for r in log.transactions(rows).collect()]
    assert sum(sizes) == 2500 and max(sizes) <= log.SNAPSHOT_ROWS


def test_handoff():
    class Cursor:
        def execute(self, sql):
            self.sql = sql

        def fetchone(self):
            return ("s", "1/20", "00000003-1", "pgoutput")

    class Connection:
        def cursor(self):
            return Cursor()

    handoff = snapshot.create_slot(Connection(), "s")
    assert handoff == snapshot.Handoff("00000003-1", (1 << 32) + 32, "s")
    options = snapshot.scan_options(ReaderConfig(host="db"), "public.users", handoff, split="id", bounds=(0, 100), partitions=4)
    assert options["url"] == "jdbc:postgresql://db:5432/postgres" and options["numPartitions"] == "4"
    assert options["sessionInitStatement"].endswith("SET TRANSACTION SNAPSHOT '00000003-1'")


def test_ops_loop():
    sent, lines, calls = [], [], []

    def connect():
        calls.append(1)
        if len(calls) == 1:
            raise OSError("down")
        connection = sqlite3.connect(":memory:", check_same_thread=False)
        connection.create_function("pg_logical_emit_message", 3, lambda *a: sent.append(a) or "0/1")
        connection.create_function("pg_current_wal_lsn", 0, lambda: "0/64")
        connection.execute("CREATE TABLE pg_replication_slots (slot_name, confirmed_flush_lsn, active)")
        connection.execute("INSERT INTO pg_replication_slots VALUES ('s', '0/14', 1)")
        return connection

    loop = OpsLoop(connect, "s", Metrics(), lines.append, interval=0.02, retry=0.02)
    loop.start()
    loop.join(0.4)
    loop.stop()
    assert lines[0] == "ops connection failed: down" and loop.lag.bytes == 80 and len(sent) >= 2
    assert sent[0][1:] == ("deltaview", "heartbeat") and lines[1].startswith("lag_bytes=80 ")
