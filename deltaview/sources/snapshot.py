"""From a table's snapshot to the stream that goes on from it, without a gap.

A slot that is created with an exported snapshot names the state of the database at its own
start position. Every partition of the scan opens that snapshot, so that a parallel scan sees one
state, and the stream is read from the position on.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from deltaview.functions.lsn import lsn_of
from deltaview.operators import log
from deltaview.sources.config import ReaderConfig


@dataclass(frozen=True)
class Handoff:
    snapshot_id: str
    start_lsn: int
    slot: str


def create_slot(connection: Any, slot: str) -> Handoff:
    """Create a slot over a DB-API connection in replication mode. The snapshot lives as long as the connection is open and idle."""
    cursor = connection.cursor()
    cursor.execute(f'CREATE_REPLICATION_SLOT "{slot}" LOGICAL pgoutput EXPORT_SNAPSHOT')
    name, position, snapshot_id, _ = cursor.fetchone()
    return Handoff(snapshot_id, lsn_of(position), name)


def scan_options(config: ReaderConfig, table: str, handoff: Handoff, split: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 1) -> dict[str, str]:
    """Options of a JDBC scan in the handoff's snapshot; `split` and `bounds` deal it out over partitions."""
    snapshot = handoff.snapshot_id.replace("'", "''")
    options = {
        "url": config.jdbc_url(), "user": config.user, "password": config.password, "dbtable": table,
        "fetchsize": "10000",  # rows come in pieces, inside a transaction
        "sessionInitStatement": f"SET TRANSACTION ISOLATION LEVEL REPEATABLE READ; SET TRANSACTION SNAPSHOT '{snapshot}'",
    }
    if split is not None and bounds is not None:
        options |= {"partitionColumn": split, "lowerBound": str(bounds[0]), "upperBound": str(bounds[1]), "numPartitions": str(partitions)}
    return options


def scan(spark: SparkSession, config: ReaderConfig, table: str, handoff: Handoff, **split: Any) -> DataFrame:
    return spark.read.format("jdbc").options(**scan_options(config, table, handoff, **split)).load()


def backfill(rows: DataFrame, changes: DataFrame, handoff: Handoff, namespace: str, table: str) -> DataFrame:
    """The snapshot's rows as transaction 0, then the changes committed after the handoff's position."""
    return log.backfill_then_stream(rows, changes, handoff.start_lsn, namespace, table)
