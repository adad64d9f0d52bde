"""Change logs that follow from the plain tables by fixed rules, for queries and tests."""

from __future__ import annotations

import struct
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaview.operators.windows import event_millis


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, user_id, event_type, cents, ts_ms."""
    e = table(spark, sf_dir, "events")
    cents = F.round(F.col("value") * 100).cast("bigint")
    return e.select("event_id", "user_id", "event_type", cents.alias("cents"), event_millis("ts", e.schema["ts"].dataType).alias("ts_ms"))


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event is inserted; every fifth is updated (100 cents more; every tenth becomes a
    purchase); every seventh is deleted in the end."""
    rows = event_rows(spark, sf_dir)
    image = lambda kind, cents: F.struct("event_id", "user_id", kind.alias("event_type"), cents.alias("cents"), "ts_ms")
    i = F.col("event_id")
    first = image(F.col("event_type"), F.col("cents"))
    second = image(F.when(i % 10 == 0, "purchase").otherwise(F.col("event_type")), F.col("cents") + 100)
    null = F.lit(None).cast(rows.schema)
    change = lambda op, lsn, before, after: F.struct(F.lit(op).alias("op"), lsn.alias("lsn"), before.alias("before"), after.alias("after"))
    inserted = change("I", 4 * i + 1, null, first)
    updated = F.when(i % 5 == 0, change("U", 4 * (i + 1000) + 2, first, second))
    deleted = F.when(i % 7 == 0, change("D", 4 * (i + 2000) + 3, F.when(i % 5 == 0, second).otherwise(first), null))
    log = rows.select(F.explode(F.array_compact(F.array(inserted, updated, deleted))).alias("c")).select("c.*")
    return log.select(
        (F.floor(F.col("lsn") / 64) * 64 + 63).alias("commit_lsn"), "lsn", (F.col("lsn") % 64).cast("int").alias("index_in_txn"),
        F.lit("public").alias("namespace"), F.lit("events").alias("table"), "op", "before", "after", F.array().cast("array<string>").alias("unchanged"),
    )


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder name in the shared folder, a local one in tests without one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{(shared or tempfile.mkdtemp(prefix='deltaview-')).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def order_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as replication events (seq, kind, lsn, payload): a relation message, then a transaction for
    each order with its insert; for every fourth one an update that doesn't send the customer; for
    every ninth one a delete by key. One message in 100 orders is a heartbeat."""
    word = lambda n, width: F.unhex(F.lpad(F.hex(n), 2 * width, "0"))
    raw = lambda text: F.lit(text).cast("binary")
    value = lambda c: F.concat(raw("t"), word(F.octet_length(c), 4), c.cast("binary"))
    image = lambda *values: F.concat(word(F.lit(len(values)), 2), *values)
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("k"), F.col("o_custkey").cast("string").alias("c"), F.col("o_orderstatus").alias("s"))
    k, old = F.col("o_orderkey"), image(*(value(F.col(x)) for x in "kcs"))
    message = lambda op, *parts: F.concat(raw(op), word(F.lit(7), 4), *parts)
    unsent = image(value(F.col("k")), raw("u"), value(F.lit("X")))
    data = F.array(
        message("I", raw("N"), old), F.when(k % 4 == 0, message("U", raw("O"), old, raw("N"), unsent)),
        F.when(k % 9 == 0, message("D", raw("O"), image(value(F.col("k")), value(F.col("c")), value(F.when(k % 4 == 0, "X").otherwise(F.col("s")))))),
    )
    event = lambda kind, at, payload: F.struct((k * 10 + at).alias("lsn"), F.lit(kind).alias("kind"), payload.alias("payload"))
    rows = F.array(event("begin", 0, raw("")), *(F.when(data[i].isNotNull(), event("data", i + 1, data[i])) for i in range(3)), event("commit", 8, raw("")), F.when(k % 100 == 0, event("heartbeat", 9, raw(""))))
    columns = b"".join(struct.pack(">B", 1 if i == 0 else 0) + n + b"\0" + struct.pack(">Ii", oid, -1) for i, (n, oid) in enumerate(((b"o_orderkey", 20), (b"o_custkey", 20), (b"o_orderstatus", 25))))
    relation = spark.createDataFrame([(0, "data", bytearray(b"R" + struct.pack(">I", 7) + b"public\0orders\0f" + struct.pack(">H", 3) + columns))], "lsn long, kind string, payload binary")
    events = relation.unionByName(o.select(F.explode(F.array_compact(rows)).alias("e")).select("e.*"))
    return events.select(F.col("lsn").alias("seq"), "kind", "lsn", "payload")


#: SQL of the same rules: the rows, the log, and what is left in the end.
EVENTS_SQL = """
  base AS (SELECT event_id, user_id, event_type, CAST(round(value * 100) AS BIGINT) AS cents, epoch_us(ts) // 1000 AS ts_ms FROM events),
  second AS (SELECT event_id, user_id, CASE WHEN event_id % 10 = 0 THEN 'purchase' ELSE event_type END AS event_type, cents + 100 AS cents, ts_ms FROM base WHERE event_id % 5 = 0),
  last AS (SELECT * FROM second UNION ALL SELECT * FROM base WHERE event_id % 5 <> 0),
  view AS (SELECT * FROM last WHERE event_id % 7 <> 0),
  log AS (
    SELECT 4 * event_id + 1 AS lsn, 'I' AS op, event_id FROM base
    UNION ALL SELECT 4 * (event_id + 1000) + 2, 'U', event_id FROM base WHERE event_id % 5 = 0
    UNION ALL SELECT 4 * (event_id + 2000) + 3, 'D', event_id FROM base WHERE event_id % 7 = 0)"""
