"""Left joins of facts to a reference table that changes, too."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deltaview.functions.values import render
from deltaview.model import WEIGHT
from deltaview.operators.zset import canonical, positive

#: An as-of join cuts the HOT_KEYS largest keys, of those of more than HOT_ROWS rows, into so many parts.
HOT_ROWS, HOT_KEYS, PARTS = 1_000_000, 1_000, 128


def _key(df: DataFrame, column: str, other: DataFrame, other_column: str) -> Column:
    """The column itself where both have one type, else its text, as whole floats equal integers."""
    kind = df.schema[column].dataType
    return F.col(column) if kind == other.schema[other_column].dataType else render(F.col(column), kind)


def join_current(facts: DataFrame, reference: DataFrame, fact_key: str, reference_key: str) -> DataFrame:
    """Facts with the columns of every reference row of their key, null where there is none.

    `reference` is a delta or plain rows. A fact keeps its weight, and its value where names
    collide. Null keys match nothing. Spark broadcasts the reference if statistics say that
    it is small enough, and else shuffles both sides by key.
    """
    rows = positive(canonical(reference)).drop(WEIGHT) if WEIGHT in reference.columns else reference
    added = [c for c in rows.columns if c not in facts.columns]
    left = facts.withColumn("_key", _key(facts, fact_key, rows, reference_key))
    right = rows.select(_key(rows, reference_key, facts, fact_key).alias("_key"), *added)
    return left.join(right, "_key", "left").select(*facts.columns, *added)


def reference_len(reference: DataFrame) -> int:
    """Distinct rows that a reference, a delta or plain rows, holds."""
    return (positive(canonical(reference)) if WEIGHT in reference.columns else reference.distinct()).count()


def _dealt(rows: DataFrame, spread: Column) -> DataFrame:
    """Rows (_key, _at, _side, _version, _fact) with a _part of their key's positions, and those
    versions again that are in force where a part begins.

    Keys with many rows are cut at quantiles of their positions. Where many facts share a
    position that is an edge, several edges in a row as a rule, they are dealt out over the parts
    between; the version of that position goes to the first of them.
    """
    known = rows.where(F.col("_key").isNotNull())
    many = known.groupBy("_key").agg(F.count("*").alias("n")).where(F.col("n") > HOT_ROWS)
    if many.isEmpty():
        return rows.withColumn("_part", F.when(F.col("_key").isNull(), spread).otherwise(0))
    hot = F.broadcast(many.orderBy(F.desc("n"), "_key").limit(HOT_KEYS).select("_key"))
    cuts = F.percentile_approx("_at", [i / PARTS for i in range(1, PARTS)], 100 * PARTS)
    edges = F.broadcast(known.select("_key", "_at").join(hot, "_key").groupBy("_key").agg(cuts.alias("_edges")))
    low, high = (F.coalesce(F.size(F.filter("_edges", f)).cast("long"), F.lit(0).cast("long")) for f in (lambda e: e < F.col("_at"), lambda e: e <= F.col("_at")))
    part = F.when(F.col("_side") == 0, low).when(F.col("_key").isNull(), spread).otherwise(low + F.pmod(spread, high - low + 1))
    dealt = rows.join(edges, "_key", "left").withColumn("_part", F.when(F.col("_edges").isNull() & F.col("_key").isNotNull(), F.lit(0).cast("long")).otherwise(part))
    last = dealt.where("_side = 0 and _edges is not null").groupBy("_key", "_part").agg(F.max_by("_version", "_at").alias("_version"))
    following = F.coalesce(F.lead("_part").over(Window.partitionBy("_key").orderBy("_part")), F.lit(PARTS - 1).cast("long"))
    carried = last.withColumn("_next", following).where("_part < _next").withColumn("_part", F.explode(F.sequence(F.col("_part") + 1, "_next")))
    return dealt.drop("_edges").unionByName(carried.select("_key", "_part", "_version", F.lit(0).alias("_side")), allowMissingColumns=True)


def join_asof(facts: DataFrame, versions: DataFrame, fact_key: str, reference_key: str, lsn: str = "lsn") -> DataFrame:
    """Facts with the columns of their key's latest version at or before their own position.

    `versions` holds one row per key and position; a position may come without a row's values
    (a delete), given by a false `live` column if there is one. Versions and facts are merged
    in one stream per key, so that a fact costs one row, whatever the number of versions. The
    stream of a key with more than HOT_ROWS rows, if it is one of the HOT_KEYS largest, is cut into
    PARTS ranges of positions; the rest have less than 1 / HOT_KEYS of all rows each. Whether there
    are such keys is counted when the join is made, by one pass over the keys. Null keys match nothing.
    """
    added = [c for c in versions.columns if c not in facts.columns and c != "live"]
    live = F.col("live") if "live" in versions.columns else F.lit(True)
    held = F.when(live, F.struct(*(F.col(c) for c in added)))
    # Left as null, a version's values would be skipped by last(ignorenulls): wrap them.
    right = versions.select(_key(versions, reference_key, facts, fact_key).alias("_key"), F.col(lsn).alias("_at"), F.lit(0).alias("_side"), F.struct(held.alias("v")).alias("_version"), F.lit(None).cast(facts.schema).alias("_fact"))
    left = facts.select(_key(facts, fact_key, versions, reference_key).alias("_key"), F.col(lsn).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(right.schema["_version"].dataType).alias("_version"), F.struct(*(F.col(c) for c in facts.columns)).alias("_fact"))
    hashable = [F.col("_fact")[c] for c in facts.columns if "map<" not in facts.schema[c].dataType.simpleString()]
    dealt = _dealt(right.where(F.col("_key").isNotNull()).unionByName(left), F.xxhash64(*hashable))
    order = Window.partitionBy("_key", "_part").orderBy(F.col("_at").asc_nulls_first(), "_side").rowsBetween(Window.unboundedPreceding, 0)
    seen = dealt.withColumn("_seen", F.last("_version", ignorenulls=True).over(order))
    known = F.when(F.col("_key").isNotNull(), F.col("_seen")["v"])
    return seen.where("_side = 1").select("_fact.*", *(known[c].alias(c) for c in added))
