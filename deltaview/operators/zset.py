"""Signed multisets of rows: a delta is rows with a weight, a view the sum of its deltas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltaview.model import DELETE, INSERT, TRUNCATE, UPDATE, WEIGHT

#: Copies of a row that are made at a time.
EXPAND = 16_384


def delta(changes: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """A table's columns and w: +1 for rows that changes put in, -1 for rows they take out.

    One scan and one explode. An insert's before image is ignored, as is an update's where
    there is none; truncates give nothing (see since_truncate). `keep` names columns of the
    log to carry along.
    """
    out = F.struct(F.col("before").alias("row"), F.lit(-1).cast("bigint").alias(WEIGHT))
    into = F.struct(F.col("after").alias("row"), F.lit(1).cast("bigint").alias(WEIGHT))
    sides = F.when(F.col("op") == INSERT, F.array(into)).when(F.col("op") == UPDATE, F.array(out, into)).when(F.col("op") == DELETE, F.array(out))
    rows = changes.select(*keep, F.explode(sides).alias("side")).where(F.col("side.row").isNotNull())
    return rows.select(*keep, "side.row.*", f"side.{WEIGHT}")


def merge(*deltas: DataFrame) -> DataFrame:
    """The sum of deltas, not yet canonical."""
    out = deltas[0]
    for d in deltas[1:]:
        out = out.unionByName(d)
    return out


def canonical(rows: DataFrame) -> DataFrame:
    """One row per distinct row, weights summed, zeros left out; negative weights stay."""
    columns = [c for c in rows.columns if c != WEIGHT]
    return rows.groupBy(*columns).agg(F.sum(WEIGHT).alias(WEIGHT)).where(F.col(WEIGHT) != 0)


def negated(rows: DataFrame) -> DataFrame:
    return rows.withColumn(WEIGHT, -F.col(WEIGHT))


def positive(rows: DataFrame) -> DataFrame:
    """The rows of a canonical view that are in it."""
    return rows.where(F.col(WEIGHT) > 0)


def expanded(rows: DataFrame) -> DataFrame:
    """A canonical view as plain rows, each as often as its weight says.

    Large weights are split into parts of at most EXPAND copies, dealt out before they are
    exploded: no task makes all copies of a row, nor holds more than one part's at a time.
    """
    columns = [c for c in rows.columns if c != WEIGHT]
    part = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(WEIGHT) - 1, F.lit(EXPAND).cast("bigint")))
    parts = positive(rows).select("*", part.alias("_from")).select(*columns, F.least(F.lit(EXPAND).cast("bigint"), F.col(WEIGHT) - F.col("_from")).alias("_copies"))
    dealt = parts.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return dealt.select(*columns, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_copies"))).alias("_copy")).drop("_copy")


def equal(a: DataFrame, b: DataFrame) -> bool:
    """Whether two multisets are the same."""
    return canonical(merge(a, negated(b.select(*a.columns)))).isEmpty()


def since_truncate(changes: DataFrame) -> DataFrame:
    """The changes of each table after its last truncate: its whole view is made of these."""
    cuts = changes.where(F.col("op") == TRUNCATE).groupBy("namespace", "table").agg(F.max(F.struct("lsn", "index_in_txn")).alias("_cut"))
    at = F.struct("lsn", "index_in_txn")
    kept = changes.where(F.col("op") != TRUNCATE).join(cuts, ["namespace", "table"], "left").where(F.col("_cut").isNull() | (at > F.col("_cut")))
    return kept.select(*changes.columns)
