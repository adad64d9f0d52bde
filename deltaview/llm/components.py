"""Connected components by alternating large-star and small-star steps, all in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltaview.llm.runtime import forget, stored


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges lead from the larger to the smaller end."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    rest = edges.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def _fingerprint(edges: DataFrame) -> tuple:
    # bit_xor and count together: no sum that could overflow
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).head())


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """From edges (a, b): one row (id, component) per id that is not the smallest of its own.

    component is the smallest id that links reach. Every step partially aggregates before it
    shuffles, is written to the shared folder, and ends once a round changes nothing; rounds
    grow with the logarithm of the longest path. Nulls and self-links are left out.
    """
    known = edges.where("a is not null and b is not null and a <> b")
    now = known.select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v"))
    now = stored(now.distinct(), name)
    mark = _fingerprint(now)
    while mark[0]:
        last_table, now = now, stored(_small_star(_large_star(now)), name)
        forget(last_table)
        last, mark = mark, _fingerprint(now)
        if mark == last:
            break
    return now.select(F.col("u").alias("id"), F.col("v").alias("component"))
