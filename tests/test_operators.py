"""Deltas, views, windows, joins and logs on small rows and against independent oracles."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from deltaview.functions.lsn import format_lsn, lsn_of
from deltaview.functions.values import iso_to_millis, truncated
from deltaview.operators import log, refjoin, views, windows, zset

CHANGES = "commit_lsn long, lsn long, index_in_txn int, namespace string, `table` string, op string, before struct<id:long,g:long,v:long>, after struct<id:long,g:long,v:long>, unchanged array<string>"


def changes(spark, rows):
    """(op, before, after) in order, a transaction each."""
    return spark.createDataFrame([(i, i, 0, "public", "t", op, b, a, []) for i, (op, b, a) in enumerate(rows, 1)], CHANGES)


def view_of(spark, rows):
    return {tuple(r)[:-1]: r["w"] for r in zset.canonical(zset.delta(changes(spark, rows))).collect()}


def test_insert_update_delete(spark):
    rows = [("I", None, (1, 0, 10)), ("U", (1, 0, 10), (1, 0, 20)), ("D", (1, 0, 20), None)]
    assert view_of(spark, rows[:2]) == {(1, 0, 20): 1}
    assert view_of(spark, rows) == {}
    assert view_of(spark, [("I", (9, 9, 9), (1, 0, 10)), ("T", None, None)]) == {(1, 0, 10): 1}
    assert view_of(spark, [("U", None, (1, 0, 10)), ("D", (2, 0, 0), None)]) == {(1, 0, 10): 1, (2, 0, 0): -1}


def test_aggregates(spark):
    rows = [("I", None, (1, 1, 10)), ("I", None, (2, 1, 50)), ("I", None, (3, 2, 100)), ("I", None, (4, None, 7)), ("I", None, (5, None, None))]
    got = views.aggregates(zset.delta(changes(spark, rows)), views.ViewConfig(("g",), "v", True))
    assert {r["g"]: (r["sum"], r["count"]) for r in got.collect()} == {1: (60, 2), 2: (100, 1), None: (7, 2)}
    empty = views.aggregates(zset.delta(changes(spark, rows[:0])), views.ViewConfig((), "v", True))
    assert empty.collect() == []


def random_changes(seed, n):
    """Valid changes over few ids, and the rows that are left."""
    r, rows, out = random.Random(seed), {}, []
    for _ in range(n):
        i = r.randrange(40)
        if i not in rows:
            rows[i] = (i, r.randrange(4), r.randrange(50))
            out.append(("I", None, rows[i]))
        elif r.random() < 0.6:
            new = (i, r.randrange(4), r.randrange(50))
            out.append(("U", rows[i], new))
            rows[i] = new
        else:
            out.append(("D", rows.pop(i), None))
    return out, rows


@pytest.mark.parametrize("seed", range(5))
def test_differential(spark, seed):
    rows, left = random_changes(seed, 400)
    assert view_of(spark, rows) == dict.fromkeys(left.values(), 1)
    sums, counts = defaultdict(int), Counter()
    for _, g, v in left.values():
        sums[g] += v
        counts[g] += 1
    got = views.aggregates(zset.delta(changes(spark, rows)), views.ViewConfig(("g",), "v", True)).collect()
    assert {r["g"]: (r["sum"], r["count"]) for r in got} == {g: (sums[g], counts[g]) for g in counts}


def test_duplicates_count_unless_dropped(spark):
    log_ = changes(spark, [("I", None, (1, 0, 10))])
    twice = log_.unionByName(log_)
    assert zset.canonical(zset.delta(twice)).head()["w"] == 2
    assert zset.canonical(zset.delta(log.without_replays(twice))).head()["w"] == 1
    assert log.without_replays(twice, committed_lsn=1).count() == 0


def test_snapshot_rows_are_no_replays(spark):
    rows = spark.createDataFrame([(1, 0, 5), (2, 0, 6)], "id long, g long, v long")
    both = log.backfill_then_stream(rows, changes(spark, [("I", None, (3, 0, 1)), ("D", (1, 0, 5), None)]), 1, "public", "t")
    assert {r["id"] for r in zset.canonical(zset.delta(log.without_replays(both))).collect()} == {2}


def test_truncate(spark):
    rows = [("I", None, (1, 0, 1)), ("T", None, None), ("I", None, (2, 0, 2))]
    assert [r["id"] for r in zset.delta(zset.since_truncate(changes(spark, rows))).collect()] == [2]


def test_zset_equal(spark):
    a = spark.createDataFrame([(1, 1), (1, 1), (2, 1)], "x long, w long")
    b = spark.createDataFrame([(2, 1), (1, 2)], "x long, w long")
    assert zset.equal(a, b) and not zset.equal(a, b.limit(1))
    assert sorted(r["x"] for r in zset.expanded(zset.canonical(a)).collect()) == [1, 1, 2]


def test_expanded_weights(spark):
    """Weights of several parts, and one beyond what an array can hold."""
    weights = {0: 1, 1: zset.EXPAND, 2: zset.EXPAND + 1, 3: 3 * zset.EXPAND, 4: -5, 5: 0}
    got = zset.expanded(spark.createDataFrame(list(weights.items()), "x long, w long"))
    assert got.columns == ["x"]
    assert {r["x"]: r["count"] for r in got.groupBy("x").count().collect()} == {x: w for x, w in weights.items() if w > 0}
    assert zset.expanded(spark.createDataFrame([(1, 3_000_000_000)], "x long, w long")).count() == 3_000_000_000


def test_float_sums(spark):
    values = [2.7, -2.7, float("nan"), 1e300, -1e300, None]
    got = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select(truncated(F.col("v")).alias("t"), "i").orderBy("i")
    assert [r["t"] for r in got.collect()] == [2, -2, 0, 2**63 - 1, -(2**63), 0]


def test_view_spec():
    assert views.parse_view("a,b:count") == views.ViewConfig(("a", "b"), count=True)
    assert views.parse_view("a:sum:v") == views.ViewConfig(("a",), sum_column="v")
    for bad in ("a", "a:sum", "a:max:v", "a:sum:v:w"):
        with pytest.raises(ValueError):
            views.parse_view(bad)


def test_windows(spark):
    rows = spark.createDataFrame([(1200, 1), (1700, 2), (2600, 4), (-1, 8), (None, 16)], "ts long, v long")
    got = windows.assign(rows, "ts", 1000).groupBy("window_start", "window_end").agg(F.sum("v").alias("v"))
    assert {r["window_start"]: r["v"] for r in got.collect()} == {1000: 3, 2000: 4, -1000: 8}
    assert {r["window_start"] for r in windows.closed(got, 2100).collect()} == {1000, -1000}
    assert {r["window_start"] for r in windows.open_(got, 2100).collect()} == {2000}


def test_late(spark):
    rows = spark.createDataFrame([(0, 1200, 1), (0, 2100, 1), (1, 1500, -3), (1, 2500, 1)], "batch long, ts long, w long")
    kept, late = windows.split_late(windows.assign(windows.arrival_watermarks(rows, "ts", "batch", 0), "ts", 1000))
    assert sorted(r["ts"] for r in kept.collect()) == [1200, 2100, 2500]
    assert windows.late_count(late).head()["dropped_late"] == 3


@pytest.mark.parametrize(
    ("text", "millis"),
    [("2024-01-01T00:00:00Z", 1704067200000), ("2024-01-01 00:00:00.5", 1704067200500), ("2024-01-01T05:30:00+05:30", 1704067200000), ("2024-01-01 02:00:00+02", 1704067200000), ("2023-12-31 19:00:00-05", 1704067200000), ("not a timestamp at all", None), ("2024-13-01T00:00:00", None), ("2024-01-01", None)],
)
def test_iso(spark, text, millis):
    assert spark.createDataFrame([(text,)], "t string").select(iso_to_millis(F.col("t")).alias("m")).head()["m"] == millis


def test_reference_join(spark):
    facts = spark.createDataFrame([(10, "28"), (20, "99"), (30, None)], "amount long, merchant_id string").withColumn("w", F.lit(1).cast("long"))
    reference = spark.createDataFrame([(28, "gold", 1, 1), (28, "gold", 1, -1), (28, "silver", 2, 1), (None, "x", 3, 1)], "id long, tier string, amount long, w long")
    got = {r["amount"]: (r["id"], r["tier"], r["w"]) for r in refjoin.join_current(facts, reference, "merchant_id", "id").collect()}
    assert got == {10: (28, "silver", 1), 20: (None, None, 1), 30: (None, None, 1)}


def test_asof_join(spark):
    facts = spark.createDataFrame([(1, "28"), (5, "28"), (9, "28"), (20, "28"), (9, "99"), (9, None)], "lsn long, m string")
    versions = spark.createDataFrame([("28", "gold", 5, True), ("28", "silver", 8, True), ("28", None, 15, False)], "id string, tier string, lsn long, live boolean")
    got = {(r["lsn"], r["m"]): r["tier"] for r in refjoin.join_asof(facts, versions, "m", "id").collect()}
    assert got == {(1, "28"): None, (5, "28"): "gold", (9, "28"): "silver", (20, "28"): None, (9, "99"): None, (9, None): None}


@pytest.mark.parametrize("parts", [2, 5, 16])
def test_asof_join_hot_key(spark, monkeypatch, parts):
    """A key with most facts, many of them at one position, and null keys, against a plain loop."""
    monkeypatch.setattr(refjoin, "HOT_ROWS", 20)
    monkeypatch.setattr(refjoin, "HOT_KEYS", 10)
    monkeypatch.setattr(refjoin, "PARTS", parts)
    r = random.Random(parts)
    at = lambda: 50 if r.random() < 0.4 else r.randrange(100)
    rows = [(i, "hot" if i % 3 else r.choice(["a", "b", "late", None]), at()) for i in range(600)] + [(i, None, 5) for i in range(600, 700)]
    held = [("hot", f"v{i}", i, i % 4 > 0) for i in [0, 3, 4, 31, 50, 51, 77, 98]] + [("late", "w", 200, True), ("a", "x", 10, True), ("gone", "y", 1, True)]
    facts = spark.createDataFrame(rows, "n long, m string, lsn long").withColumn("extra", F.create_map(F.lit("k"), F.col("n")))
    versions = spark.createDataFrame(held, "id string, tier string, lsn long, live boolean")
    out = refjoin.join_asof(facts, versions, "m", "id")
    got = sorted((x["n"], x["m"], x["lsn"], x["tier"]) for x in out.collect())
    want = []
    for n, m, lsn in rows:
        seen = [(x[2], x[1] if x[3] else None) for x in held if x[0] == m and x[2] <= lsn]
        want.append((n, m, lsn, max(seen)[1] if seen else None))
    assert [x[0] for x in got] == [x[0] for x in want] and got == sorted(want, key=lambda x: x[0])
    key = [x["n"] for x in refjoin._dealt(facts.select(F.col("m").alias("_key"), F.col("lsn").alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast("string").alias("_version"), F.struct("n").alias("_fact")), F.xxhash64(F.col("_fact.n"))).where("_key = 'hot'").groupBy("_part").agg(F.count("*").alias("n")).collect()]
    assert sum(key) == sum(m == "hot" for _, m, _ in rows) and max(key) < 3 * sum(key) / parts


def test_latest(spark):
    rows = [("I", None, (1, 0, 1)), ("U", (1, 0, 1), (2, 0, 1)), ("U", (2, 0, 1), (2, 0, 5)), ("I", None, (3, 0, 1)), ("D", (3, 0, 1), None)]
    got = log.latest(log.versions(changes(spark, rows), ["id"]), ["id"]).collect()
    assert [(r["id"], r["v"]) for r in got] == [(2, 5)]


def test_unsent_columns(spark):
    c = changes(spark, [("U", (1, 2, 3), (1, None, 4))]).withColumn("unchanged", F.array(F.lit("g")))
    assert tuple(log.resolved(c).head()["after"]) == (1, 2, 4)


def test_drift(spark):
    columns = lambda *xs: [(x, 23) if isinstance(x, str) else x for x in xs]
    rows = [(1, 1, "t", columns("a")), (1, 2, "t", columns("a")), (1, 3, "t", columns("a", "b")), (1, 4, "t", columns("b")), (1, 5, "t", columns(("b", 25))), (2, 1, "u", columns())]
    got = log.drift(spark.createDataFrame(rows, "relation_id long, seq long, name string, columns array<struct<name:string,type_oid:int>>")).collect()
    assert {(r["relation_id"], r["seq"]): (r["kind"], r["column"], r["old_oid"], r["new_oid"]) for r in got} == {
        (1, 1): ("new_relation", None, None, None), (1, 3): ("column_added", "b", None, None), (1, 4): ("column_removed", "a", None, None), (1, 5): ("type_changed", "b", 23, 25), (2, 1): ("new_relation", None, None, None),
    }


def test_lsn():
    assert lsn_of("16/B374D848") == 0x16B374D848 and lsn_of("zz/1") == 0 and lsn_of("1") == 0
    assert format_lsn(lsn_of("1A/2B")) == "1A/2B"


def test_lag(spark):
    c = changes(spark, [("I", None, (1, 0, 1))] * 7)
    assert tuple(log.slot_lag(c, 3).head()) == (3, 7, 4)
    assert log.slot_lag(c, 3, active=False).count() == 0
