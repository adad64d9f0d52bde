"""Decoder, sources, sinks and the streaming engine, with restarts and failures."""

import http.server
import json
import struct
import threading

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from deltaview.operators import log, views, zset
from deltaview.plans.document import Plan
from deltaview.sinks import sinks
from deltaview.sources import readers
from deltaview.sources.config import ReaderConfig
from deltaview.sources.pgoutput import Column, DecodeError, Decoder, Relation, transactions
from deltaview.streaming.engine import Checkpoint, Engine, stream_view, stream_windows
from deltaview.streaming.metrics import Lag, Metrics

RELATION = Relation(1, "public", "users", (Column("id", 23, 1), Column("name", 25)))


def relation_bytes(compact=False, columns=RELATION.columns):
    out = b"R" + struct.pack(">I", 1) + b"public\0users\0" + (b"" if compact else b"f") + struct.pack(">H", len(columns))
    for c in columns:
        out += struct.pack(">B", c.flags) + c.name.encode() + b"\0" + struct.pack(">I", c.type_oid) + (b"" if compact else struct.pack(">i", -1))
    return out


def tuple_bytes(*values):
    out = struct.pack(">H", len(values))
    for v in values:
        out += b"n" if v is None else b"u" if v is ... else b"t" + struct.pack(">I", len(v)) + v.encode()
    return out


def row(op, *parts):
    return op + struct.pack(">I", 1) + b"".join(parts)


def insert(*values):
    return row(b"I", b"N" + tuple_bytes(*values))


@pytest.mark.parametrize("compact", [False, True])
def test_decoder(compact):
    d = Decoder("compact" if compact else "protocol")
    assert d.decode(relation_bytes(compact)).columns == RELATION.columns
    assert d.decode(b"") is None
    (c,) = d.decode(insert("42", "ada"))
    assert (c["op"], c["before"], c["after"]) == ("I", None, {"id": "42", "name": "ada"})
    (c,) = d.decode(insert("42", ...))
    assert c["after"] == {"id": "42", "name": None} and c["unchanged"] == ["name"]
    (c,) = d.decode(row(b"U", b"O" + tuple_bytes("42", "ada"), b"N" + tuple_bytes("42", "grace")))
    assert c["before"]["name"] == "ada" and c["after"]["name"] == "grace"
    (c,) = d.decode(row(b"D", b"K" + tuple_bytes("42", None)))
    assert (c["op"], c["before"], c["after"]) == ("D", {"id": "42", "name": None}, None)
    (c,) = d.decode(b"T" + struct.pack(">IB", 1, 0) + struct.pack(">I", 1))
    assert (c["op"], c["table"], c["after"]) == ("T", "users", None)
    (c,) = d.decode(insert("7"))
    assert c["unchanged"] == ["name"]


@pytest.mark.parametrize("data", [b"X", b"I" + struct.pack(">I", 99), insert("1")[:-1], row(b"I", b"Q"), row(b"D", b"N")])
def test_decoder_errors(data):
    d = Decoder()
    d.decode(relation_bytes())
    with pytest.raises(DecodeError):
        d.decode(data)


def test_transactions():
    d = Decoder()
    events = [("data", 1, relation_bytes()), ("data", 2, insert("0", "lost")), ("begin", 3, b""), ("data", 4, insert("1", "a")), ("keepalive", 5, b""), ("data", 6, insert("2", "b")), ("commit", 7, b""), ("begin", 8, b""), ("commit", 9, b"")]
    (txn,) = transactions(iter(events), d)
    assert txn[0] == 7 and [(c["index_in_txn"], c["lsn"], c["after"]["id"]) for c in txn[1]] == [(0, 4, "1"), (1, 6, "2")]


def write_events(path, transactions_, first=1):
    """Event files: a relation, then transactions of row payloads."""
    events = [("data", 0, relation_bytes())]
    for n, payloads in enumerate(transactions_, first):
        events += [("begin", n * 10, b""), *(("data", n * 10 + i, p) for i, p in enumerate(payloads, 1)), ("commit", n * 10 + 9, b"")]
    kind, lsn, payload = zip(*events, strict=True)
    pq.write_table(pa.table({"seq": list(range(len(events))), "kind": list(kind), "lsn": list(lsn), "payload": list(payload)}), path)


HISTORY = [
    [insert("1", "a"), insert("2", "b")],
    [row(b"U", b"O" + tuple_bytes("1", "a"), b"N" + tuple_bytes("1", "A"))],
    [row(b"D", b"O" + tuple_bytes("2", "b")), insert("3", "c")],
    [insert("4", "c")],
]


def test_batch_source(spark, tmp_path):
    readers.register(spark)
    write_events(tmp_path / "log.parquet", HISTORY)
    raw = spark.read.format("replication_log").option("path", str(tmp_path / "log.parquet")).load()
    view = zset.canonical(zset.delta(readers.typed(raw, RELATION)))
    assert {(r["id"], r["name"]) for r in view.collect()} == {(1, "A"), (3, "c"), (4, "c")}
    later = spark.read.format("replication_log").option("path", str(tmp_path / "log.parquet")).option("startLsn", 29).load()
    assert {r["commit_lsn"] for r in later.collect()} == {39, 49}


def engine_of(tmp_path, sink=None, plan=None):
    return Engine("public.users", plan or Plan(), sink or sinks.ConsoleSink(lambda _: None), Checkpoint(str(tmp_path / "position.json")), sinks.ViewTableSink(str(tmp_path / "view")))


def run(spark, engine, tmp_path, files):
    stream = spark.readStream.format("replication_log").option("path", str(files)).load()
    engine.start(readers.typed(stream, RELATION), str(tmp_path / "stream"), availableNow=True).awaitTermination()


def test_engine_restarts(spark, tmp_path):
    """Two runs over a growing log end where one run over all of it ends."""
    readers.register(spark)
    files = tmp_path / "log.parquet"
    (tmp_path / "view").mkdir()
    write_events(files, HISTORY[:2])
    run(spark, engine_of(tmp_path), tmp_path, files)
    write_events(files, HISTORY)
    engine = engine_of(tmp_path)
    assert engine.checkpoint.lsn == 29
    run(spark, engine, tmp_path, files)
    assert engine.checkpoint.lsn == 49 and engine.metrics["acked"] == 2
    assert {(r["id"], r["name"], r["w"]) for r in engine.view.read(spark).collect()} == {(1, "A", 1), (3, "c", 1), (4, "c", 1)}


class Failing:
    def __init__(self):
        self.calls = 0

    def write(self, changes, batch_id):
        self.calls += 1
        raise sinks.WriteError("down")


def users(spark, rows, commit=10):
    image = "struct<id:long,name:string>"
    return spark.createDataFrame([(commit, commit, i, "public", "users", op, b, a, []) for i, (op, b, a) in enumerate(rows)], f"commit_lsn long, lsn long, index_in_txn int, namespace string, `table` string, op string, before {image}, after {image}, unchanged array<string>")


def test_position_waits_for_the_sink(spark, tmp_path):
    engine = engine_of(tmp_path, Failing())
    with pytest.raises(sinks.WriteError):
        engine.process(users(spark, [("I", None, (1, "a"))]), 0)
    assert engine.checkpoint.lsn == 0 and engine.metrics["sink_errors"] == 1
    engine.sink, engine.view = sinks.ConsoleSink(lambda _: None), None
    for _ in range(2):
        engine.process(users(spark, [("I", None, (1, "a"))]), 0)
    assert engine.metrics["acked"] == 1 and engine.metrics["deduped"] == 1
    assert Checkpoint(engine.checkpoint.path).lsn == 10


def test_checkpoint_version(tmp_path):
    (tmp_path / "c").write_text(json.dumps({"version": 2, "lsn": 1, "state": {}}))
    with pytest.raises(ValueError):
        Checkpoint(str(tmp_path / "c"))


def test_console(spark):
    lines = []
    sinks.ConsoleSink(lines.append).write(users(spark, [("U", (1, "a"), (1, "b")), ("T", None, None)]), 0)
    assert lines == ["=== txn commit_lsn=10 changes=2 ===", "  U public.users lsn=10 #0", '    before: {"id": 1, "name": "a"}', '    after:  {"id": 1, "name": "b"}', "  T public.users lsn=10 #1"]


def test_http(spark):
    seen, answers = [], [500, 200, 200]

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            seen.append(json.loads(self.rfile.read(int(self.headers["Content-Length"]))))
            self.send_response(answers.pop(0) if answers else 503)
            self.end_headers()

        def log_message(self, *args):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url, waits = f"http://127.0.0.1:{server.server_port}/hook", []
    both = users(spark, [("I", None, (1, "a"))], 20).unionByName(users(spark, [("I", None, (2, None))], 10))
    sinks.HttpSink(url, sleep=waits.append).write(both, 0)
    assert [s["commit_lsn"] for s in seen] == [10, 10, 20] and waits == [0.1]
    assert seen[0]["changes"][0]["after"] == {"id": 2, "name": None}
    with pytest.raises(sinks.WriteError, match="attempt 3: HTTP 503"):
        sinks.HttpSink(url, attempts=3, sleep=waits.append).write(users(spark, [("I", None, (1, "a"))]), 0)
    server.shutdown()


def test_versioned_table(spark, tmp_path):
    sink = sinks.VersionedTableSink(str(tmp_path), {"public.users": ["id"]})
    first = users(spark, [("I", None, (1, "a")), ("I", None, (2, "b")), ("U", (1, "a"), (1, "c"))], 10)
    sink.write(first, 0)
    sink.write(first, 0)
    assert {tuple(r) for r in sink.read(spark, "public.users").collect()} == {(1, "c"), (2, "b")}
    sink.write(users(spark, [("T", None, None), ("I", None, (3, "d"))], 20), 1)
    assert {tuple(r) for r in sink.read(spark, "public.users").collect()} == {(3, "d")}
    with pytest.raises(sinks.RejectedError):
        sinks.VersionedTableSink(str(tmp_path), {"public.users": ["nope"]}).write(first, 0)


def test_fanout_and_factory(spark):
    lines, failing = [], Failing()
    with pytest.raises(sinks.WriteError):
        sinks.FanOutSink([sinks.ConsoleSink(lines.append), failing, failing]).write(users(spark, [("I", None, (1, "a"))]), 0)
    assert len(lines) == 3 and failing.calls == 1
    assert isinstance(sinks.build(None), sinks.ConsoleSink)
    built = sinks.build({"type": "fanout", "sinks": [{"type": "console"}, {"type": "http", "url": "http://x"}, {"type": "table", "path": "/tmp/x"}]})
    assert [type(s).__name__ for s in built.sinks] == ["ConsoleSink", "HttpSink", "VersionedTableSink"]
    for bad in ({"type": "nope"}, {"type": "http"}, {"type": "http", "url": "ftp://x"}):
        with pytest.raises(sinks.ConfigError):
            sinks.build(bad)


def log_files(spark, tmp_path, sf, parts=4):
    """The event log in files of increasing position."""
    from deltaview.fixtures import event_log

    changes = event_log(spark, sf).persist()
    edges = [0, 3000, 5000, 9000, 10**9]
    for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        changes.where((F.col("commit_lsn") > a) & (F.col("commit_lsn") <= b)).coalesce(1).write.mode("overwrite").parquet(str(tmp_path / f"in/part={i}"))
    return changes


def test_stream_view_is_batch_view(spark, tmp_path, sf):
    changes = log_files(spark, tmp_path, sf)
    config = views.ViewConfig(("event_type",), "cents", True)
    stream = spark.readStream.schema(changes.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    q = stream_view(stream, config).writeStream.outputMode("complete").format("memory").queryName("sums").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    expected = {tuple(r) for r in views.aggregates(zset.delta(changes), config).collect()}
    assert {tuple(r) for r in spark.table("sums").where("count <> 0").collect()} == expected


def test_stream_windows(spark, tmp_path, sf):
    changes = log_files(spark, tmp_path, sf).withColumns({i: F.when(F.col(i).isNotNull(), F.struct(f"{i}.event_id", f"{i}.cents", F.timestamp_millis(f"{i}.ts_ms").alias("ts"))) for i in ("before", "after")}).where("op = 'I'")
    changes.coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "typed"))
    config = views.ViewConfig((), "cents", True, views.WindowSpec("ts", 3_600_000))
    stream = spark.readStream.schema(changes.schema).parquet(str(tmp_path / "typed"))
    q = stream_windows(stream, config, "0 seconds").writeStream.outputMode("append").format("memory").queryName("closed").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    rows = changes.agg(F.max("after.ts").alias("m")).head()["m"]
    expected = changes.groupBy(F.window("after.ts", "1 hour").alias("w")).agg(F.count("*").alias("n")).where(F.col("w.end") <= F.lit(rows)).count()
    assert spark.table("closed").count() == expected > 0


def test_metrics():
    m = Metrics()
    m.add("txns", 2)
    assert m.snapshot() == "txns=2 changes=0 acked=0 deduped=0 sink_errors=0 late=0 drift=0"
    assert Lag(10, 25).bytes == 15


def test_reader_config():
    c = ReaderConfig.from_env({"DELTAVIEW_HOST": "db", "DELTAVIEW_PORT": "6000"})
    assert c.jdbc_url() == "jdbc:postgresql://db:6000/postgres"


def test_snapshot_reader(spark, sf):
    rows = readers.read_snapshot(spark, f"{sf}/nation.parquet")
    assert log.snapshot(rows, "public", "nation").where("commit_lsn = 0 and op = 'I'").count() == 25


def test_columnar_store(spark):
    from urllib.parse import parse_qs, urlparse

    seen, code = [], [200]

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            body = self.rfile.read(int(self.headers["Content-Length"] or 0)).decode()
            seen.append((parse_qs(urlparse(self.path).query)["query"][0], [json.loads(x) for x in body.splitlines()]))
            self.send_response(code[0])
            self.end_headers()

        def log_message(self, *args):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    sink = sinks.build({"type": "columnar", "url": f"http://127.0.0.1:{server.server_port}", "database": "db"}, {"public.users": ["id"]})
    sink.write(users(spark, [("I", None, (1, "a'\\")), ("U", (1, "a'\\"), (2, None)), ("D", (2, None), None)]), 0)
    assert seen[0][0] == 'CREATE TABLE IF NOT EXISTS "db"."public.users" ("id" Int64, "name" Nullable(String), _version UInt64, _is_deleted UInt8) ENGINE = ReplacingMergeTree(_version) ORDER BY ("id")'
    assert [(r["id"], r["name"], r["_is_deleted"]) for r in seen[1][1]] == [(1, "a'\\", 0), (1, "a'\\", 1), (2, None, 0), (2, None, 1)]
    sink.write(users(spark, [("I", None, (5, "old")), ("T", None, None), ("I", None, (6, "new"))], 20), 1)
    assert [q.split()[0] for q, _ in seen[2:]] == ["TRUNCATE", "INSERT"] and [r["id"] for r in seen[3][1]] == [6]
    for status, error in ((400, sinks.RejectedError), (503, sinks.WriteError)):
        code[0] = status
        with pytest.raises(error):
            sink.write(users(spark, [("I", None, (1, "a"))]), 2)
    server.shutdown()


def test_windowed_view(spark, tmp_path, sf):
    """Batches of the late-rows recipe, the last ones after a restart, against the batch query's rows."""
    from deltaview import catalogue
    from deltaview.fixtures import event_rows
    from deltaview.streaming.windowed import WindowedView

    rows = event_rows(spark, sf).withColumn("batch", F.floor((F.col("event_id") + F.when(F.col("event_id") % 13 == 0, 700).otherwise(0)) / 500).cast("int")).persist()
    config = views.ViewConfig((), "cents", True, views.WindowSpec("ts_ms", 3_600_000))
    n = rows.agg(F.max("batch")).head()[0] + 1
    for batch in range(n):
        if batch in (0, 2):
            view = WindowedView(str(tmp_path / "w"), config, 3_600_000)
        view.write(log.snapshot(rows.where(F.col("batch") == batch).drop("batch"), "public", "events"), batch)
        view.write(log.snapshot(rows.limit(1).drop("batch"), "public", "events"), batch)  # delivered again: no effect
    got = {r["window_start"]: (r["count"], r["sum"]) for df in (view.open_windows(spark), view.closed_windows(spark)) for r in df.collect()}
    assert got == {r["window_start"]: (r["count"], r["sum"]) for r in catalogue.queries()["late_drop"](spark, sf).collect()}
    assert view.state["dropped_late"] == catalogue.queries()["late_counter"](spark, sf).head()["dropped_late"] > 0
    assert view.closed_windows(spark).agg(F.max("window_end")).head()[0] <= view.state["watermark"]


def test_drift_detector():
    from deltaview.streaming.drift import DriftDetector

    d = DriftDetector()
    at = lambda *columns: Relation(1, "public", "t", tuple(Column(*c) for c in columns))
    assert d.observe(at(("a", 23))).kind == "new_relation" and d.observe(at(("a", 23))) is None
    assert (d.observe(at(("a", 20), ("b", 25))).kind, d.observe(at(("a", 20))).column) == ("column_added", "b")
    d = DriftDetector(d.state())
    drift = d.observe(at(("a", 25)))
    assert (drift.kind, drift.old_oid, drift.new_oid, drift.table) == ("type_changed", 20, 25, "public.t")
