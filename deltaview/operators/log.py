"""Operations on change logs: replay, transactions, latest versions, unsent columns, drift."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deltaview.model import DELETE, INSERT, TRUNCATE

#: Snapshot rows are transaction 0; they are exempt from replay checks.
SNAPSHOT_LSN = 0
#: Snapshot rows that are delivered together, at most.
SNAPSHOT_ROWS = 1_000


def without_replays(changes: DataFrame, committed_lsn: int = 0) -> DataFrame:
    """Changes after the committed position, each place of a transaction once; all snapshot rows."""
    streamed = changes.where(F.col("commit_lsn") > committed_lsn).dropDuplicates(["commit_lsn", "index_in_txn"])
    return changes.where(F.col("commit_lsn") == SNAPSHOT_LSN).unionByName(streamed)


def transactions(changes: DataFrame) -> DataFrame:
    """commit_lsn and `changes`, in order: the envelopes that sinks deliver.

    A transaction is gathered in one row, as it has to be delivered as one. Snapshot rows are no
    transaction of the source: they come in envelopes of SNAPSHOT_ROWS at most.
    """
    packed = F.struct("index_in_txn", *(c for c in changes.columns if c not in ("commit_lsn", "index_in_txn")))
    piece = F.when(F.col("commit_lsn") == SNAPSHOT_LSN, F.floor(F.monotonically_increasing_id() / SNAPSHOT_ROWS))
    return changes.select("commit_lsn", packed.alias("change"), piece.alias("piece")).groupBy("commit_lsn", "piece").agg(F.sort_array(F.collect_list("change")).alias("changes")).drop("piece")


def snapshot(rows: DataFrame, namespace: str, table: str) -> DataFrame:
    """A table's rows as the inserts of transaction 0."""
    image = F.struct(*(F.col(c) for c in rows.columns))
    return rows.select(
        F.lit(SNAPSHOT_LSN).cast("bigint").alias("commit_lsn"), F.lit(SNAPSHOT_LSN).cast("bigint").alias("lsn"), F.lit(0).alias("index_in_txn"),
        F.lit(namespace).alias("namespace"), F.lit(table).alias("table"), F.lit(INSERT).alias("op"),
        F.lit(None).cast(rows.schema).alias("before"), image.alias("after"), F.array().cast("array<string>").alias("unchanged"),
    )


def backfill_then_stream(rows: DataFrame, changes: DataFrame, start_lsn: int, namespace: str, table: str) -> DataFrame:
    """The snapshot taken at start_lsn, then the changes committed after it."""
    return snapshot(rows, namespace, table).unionByName(changes.where(F.col("commit_lsn") > start_lsn))


def resolved(changes: DataFrame) -> DataFrame:
    """Columns that were not sent take their value from the before image."""
    schema: T.StructType = changes.schema["after"].dataType
    sent = [F.when(F.array_contains("unchanged", n), F.col("before")[n]).otherwise(F.col("after")[n]).alias(n) for n in schema.names]
    full = F.when(F.col("after").isNotNull(), F.struct(*sent))
    return changes.withColumns({"after": full, "unchanged": F.array().cast("array<string>")})


def versions(changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per change and key: namespace, table, the table's columns, _version, _index,
    _is_deleted. A change of key also deletes the old one. Truncates are left out; see
    zset.since_truncate."""
    row = lambda image, gone: F.struct(F.col(image).alias("row"), F.lit(gone).alias("gone"))
    same = lambda a, b: F.struct(*(F.col(a)[k] for k in keys)).eqNullSafe(F.struct(*(F.col(b)[k] for k in keys)))
    moved = F.col("before").isNotNull() & ~same("before", "after")
    sides = F.when(F.col("op") == DELETE, F.array(row("before", True))).when(moved & (F.col("op") != INSERT), F.array(row("before", True), row("after", False))).otherwise(F.array(row("after", False)))
    out = changes.where(F.col("op") != TRUNCATE).select("namespace", "table", "commit_lsn", "index_in_txn", F.explode(sides).alias("side"))
    return out.select("namespace", "table", "side.row.*", F.col("commit_lsn").alias("_version"), F.col("index_in_txn").alias("_index"), F.col("side.gone").alias("_is_deleted"))


def latest(rows: DataFrame, keys: Sequence[str], deleted: bool = False) -> DataFrame:
    """Of each key the row of the highest version, deletions left out.

    max_by aggregates before the shuffle, so that a key with many versions costs a row per task.
    """
    by = ["namespace", "table", *keys]
    whole = F.struct(*(F.col(c) for c in rows.columns))
    # Of the two rows of one change, the one that lives wins.
    newest = rows.groupBy(*by).agg(F.max_by(whole, F.struct("_version", "_index", ~F.col("_is_deleted"))).alias("_row")).select("_row.*")
    return newest if deleted else newest.where(~F.col("_is_deleted"))


def drift(relations: DataFrame) -> DataFrame:
    """What changed between a relation's successive definitions.

    `relations`: relation_id, seq, name, columns array<struct<name string, type_oid int>>.
    Returns relation_id, seq, name, kind, column, old_oid, new_oid: new_relation for the first
    definition; else the first column added, or removed, or of another type, in this order
    of kinds; equal definitions give nothing.
    """
    before = F.lag("columns").over(Window.partitionBy("relation_id").orderBy("seq"))
    d = relations.withColumn("old", before)
    added = F.expr("get(filter(columns, c -> not exists(old, o -> o.name = c.name)), 0)")
    removed = F.expr("get(filter(old, o -> not exists(columns, c -> c.name = o.name)), 0)")
    changed = F.expr("get(filter(columns, c -> exists(old, o -> o.name = c.name and o.type_oid <> c.type_oid)), 0)")
    d = d.withColumns({"_a": added, "_r": removed, "_c": changed})
    first = F.col("old").isNull()
    kind = F.when(first, "new_relation").when(F.col("_a").isNotNull(), "column_added").when(F.col("_r").isNotNull(), "column_removed").when(F.col("_c").isNotNull(), "type_changed")
    d = d.withColumn("kind", kind).where(F.col("kind").isNotNull())
    column = F.when(~first, F.coalesce("_a.name", "_r.name", "_c.name"))
    typed = F.col("kind") == "type_changed"
    old = F.expr("get(filter(old, o -> o.name = _c.name), 0).type_oid")
    return d.select("relation_id", "seq", "name", "kind", column.alias("column"), F.when(typed, old).alias("old_oid"), F.when(typed, F.col("_c.type_oid")).alias("new_oid"))


def slot_lag(changes: DataFrame, confirmed_lsn: int, active: bool = True) -> DataFrame:
    """confirmed_lsn, current_lsn and lag_bytes between them; no row for an inactive reader."""
    now = changes.agg(F.coalesce(F.max("lsn"), F.lit(0)).cast("bigint").alias("current_lsn"))
    out = now.select(F.lit(confirmed_lsn).cast("bigint").alias("confirmed_lsn"), "current_lsn", (F.col("current_lsn") - confirmed_lsn).alias("lag_bytes"))
    return out if active else out.where(F.lit(False))
