"""The registered queries of the change-data operators, each with SQL that knows nothing of
changes: it computes the end state from the plain tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaview.fixtures import EVENTS_SQL, event_log, event_rows, order_events, table, work_dir
from deltaview.functions import lsn, values
from deltaview.model import WEIGHT
from deltaview.operators import log, refjoin, views, windows, zset
from deltaview.plans import compiler
from deltaview.plans.document import Plan, operator
from deltaview.sinks.sinks import ViewTableSink
from deltaview.sources import readers
from deltaview.sources.pgoutput import Column, Relation
from deltaview.streaming.engine import JoinedView, batch_windows, view_aggregates

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

HOUR = 3_600_000


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__], _SQL[f.__name__] = f, sql
        return f

    return add


def _with(sql: str) -> str:
    return f"WITH {EVENTS_SQL} {sql}"


def _ops(*specs: dict) -> list:
    return [operator(s, "query") for s in specs]


# Deltas and views


@query(_with("""SELECT event_id, event_type, cents, 1::BIGINT AS w FROM base
  UNION ALL SELECT event_id, event_type, cents, -1::BIGINT FROM base WHERE event_id % 5 = 0
  UNION ALL SELECT event_id, event_type, cents, 1::BIGINT FROM second
  UNION ALL SELECT event_id, event_type, cents, -1::BIGINT FROM last WHERE event_id % 7 = 0"""))
def cdc_delta(spark, sf_dir):
    return zset.delta(event_log(spark, sf_dir)).select("event_id", "event_type", "cents", "w")


@query(_with("SELECT event_id, user_id, event_type, cents, ts_ms, 1::BIGINT AS w FROM view"))
def zset_view(spark, sf_dir):
    return zset.canonical(zset.delta(event_log(spark, sf_dir)))


@query("SELECT l_orderkey, l_linenumber, count(*) AS w FROM lineitem GROUP BY ALL")
def zset_multiset(spark, sf_dir):
    return zset.canonical(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.lit(1).cast("bigint").alias(WEIGHT)))


@query("SELECT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def zset_expanded(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber", F.lit(1).cast("bigint").alias(WEIGHT))
    return zset.expanded(zset.canonical(rows))


@query("SELECT o_orderkey, o_custkey, w FROM (SELECT o_orderkey, o_custkey, 1::BIGINT AS w FROM orders EXCEPT ALL SELECT o_orderkey, o_custkey, 1::BIGINT FROM orders WHERE o_custkey % 2 = 0)")
def zset_merge_cancel(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.lit(1).cast("bigint").alias(WEIGHT))
    return zset.canonical(zset.merge(rows, zset.negated(rows.where("o_custkey % 2 = 0"))))


@query(_with("SELECT event_id, event_type, cents, 1::BIGINT AS w FROM view WHERE 4 * event_id + 1 > 2002"))
def truncate_epoch(spark, sf_dir):
    """All rows go at position 2002; changes to rows that went are not in the log."""
    changes = event_log(spark, sf_dir)
    i = F.coalesce("after.event_id", "before.event_id")
    changes = changes.where((F.col("lsn") <= 2002) | (4 * i + 1 > 2002))
    cut = changes.limit(1).select(
        F.lit(2047).cast("bigint").alias("commit_lsn"), F.lit(2002).cast("bigint").alias("lsn"), F.lit(18).alias("index_in_txn"), F.lit("public").alias("namespace"), F.lit("events").alias("table"),
        F.lit("T").alias("op"), F.lit(None).cast(changes.schema["before"].dataType).alias("before"), F.lit(None).cast(changes.schema["after"].dataType).alias("after"), F.array().cast("array<string>").alias("unchanged"),
    )
    return zset.canonical(zset.delta(zset.since_truncate(changes.unionByName(cut)))).select("event_id", "event_type", "cents", "w")


@query(_with("SELECT event_type, sum(cents)::BIGINT AS sum, count(*) AS count FROM view GROUP BY event_type"))
def view_sum_count(spark, sf_dir):
    return views.aggregates(zset.delta(event_log(spark, sf_dir)), views.ViewConfig(("event_type",), "cents", True))


@query(_with("SELECT CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_type END AS event_type, user_id % 5 AS bucket, sum(cents)::BIGINT AS sum, count(*) AS count FROM view GROUP BY 1, 2"))
def view_multi_key(spark, sf_dir):
    delta = zset.delta(event_log(spark, sf_dir)).withColumns({"event_type": F.expr("case when event_id % 11 = 0 then null else event_type end"), "bucket": F.expr("user_id % 5")})
    # The update may change the type of a row whose key is null: both sides of it are null.
    return views.aggregates(delta, views.ViewConfig(("event_type", "bucket"), "cents", True))


@query(_with("SELECT sum(cents)::BIGINT AS sum, count(*) AS count FROM view HAVING count(*) <> 0"))
def view_global(spark, sf_dir):
    return views.aggregates(zset.delta(event_log(spark, sf_dir)), views.ViewConfig((), "cents", True))


@query("SELECT event_type, count(*) AS count FROM events WHERE event_id < 0 GROUP BY event_type")
def view_empty(spark, sf_dir):
    """Every insert taken back: no group is left."""
    delta = zset.delta(event_log(spark, sf_dir).where("op = 'I'"))
    return views.aggregates(zset.merge(delta, zset.negated(delta)), views.ViewConfig(("event_type",), count=True))


@query("SELECT l_returnflag, sum(CAST(trunc(l_extendedprice) AS BIGINT))::BIGINT AS sum, count(*) AS count FROM lineitem GROUP BY l_returnflag")
def sum_int_trunc(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn(WEIGHT, F.lit(1).cast("bigint"))
    return views.aggregates(rows, views.ViewConfig(("l_returnflag",), "l_extendedprice", True), truncate_floats=True)


# Plans


@query("SELECT c_custkey AS id, c_name, c_mktsegment AS segment FROM customer")
def plan_select_rename(spark, sf_dir):
    ops = _ops({"type": "select", "columns": ["c_mktsegment", "c_name", "c_custkey", "nope"]}, {"type": "rename", "from": {"c_custkey": "id", "c_mktsegment": "segment", "nope": "x"}})
    return compiler.on_rows(table(spark, sf_dir, "customer"), ops)


@query("SELECT * FROM nation")
def plan_pass_through(spark, sf_dir):
    rows = table(spark, sf_dir, "nation")
    changes = log.snapshot(rows, "public", "nation")
    return compiler.compile_plan(Plan())("public.nation", changes).select("after.*")


_CAST_TEXT = "CASE o_orderkey % 6 WHEN 0 THEN CAST(o_orderkey AS VARCHAR) WHEN 1 THEN '-7' WHEN 2 THEN ' 42 ' WHEN 3 THEN 'abc' WHEN 4 THEN 't' ELSE NULL END"


@query(f"""SELECT o_orderkey, CASE WHEN regexp_matches(t, '^[+-]?[0-9]+$') THEN TRY_CAST(t AS BIGINT) END AS as_int,
  CASE WHEN regexp_matches(t, '^[+-]?[0-9]+$') THEN TRY_CAST(t AS DOUBLE) END AS as_float,
  CASE WHEN t IN ('t', 'true', 'T', 'TRUE') THEN true WHEN t IN ('f', 'false', 'F', 'FALSE') THEN false END AS as_bool,
  CAST(o_orderkey AS VARCHAR) AS as_text FROM (SELECT *, {_CAST_TEXT} AS t FROM orders)""")
def plan_cast(spark, sf_dir):
    text = F.expr(_CAST_TEXT.replace("VARCHAR", "STRING"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", text.alias("as_int"), text.alias("as_float"), text.alias("as_bool"), F.col("o_orderkey").alias("as_text"))
    return compiler.on_rows(rows, _ops(*({"type": "cast", "column": f"as_{t}", "to": t} for t in ("int", "float", "bool", "text"))))


@query("SELECT l_orderkey, l_linenumber, CAST(l_linenumber * 2 + 1 AS BIGINT) AS odd, CAST(l_orderkey - l_partkey * l_linenumber AS BIGINT) AS mixed, NULL::BIGINT AS none FROM lineitem")
def plan_map(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    ops = _ops(
        {"type": "map", "column": "odd", "expr": "l_linenumber * 2 + 1"}, {"type": "map", "column": "mixed", "expr": "l_orderkey - l_partkey * l_linenumber"},
        {"type": "map", "column": "none", "expr": "l_returnflag + 1"}, {"type": "select", "columns": ["l_orderkey", "l_linenumber", "odd", "mixed", "none"]},
    )
    return compiler.on_rows(rows, ops)


@query("SELECT c_custkey, '***' AS c_name, '***' AS c_acctbal, c_mktsegment FROM customer")
def plan_redact(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    return compiler.on_rows(rows, _ops({"type": "redact", "columns": ["c_name", "c_acctbal"]}))


@query("SELECT c_custkey AS id, '***' AS name, c_acctbal AS balance, CAST(c_custkey * 2 AS BIGINT) AS double_id FROM customer WHERE c_mktsegment = 'BUILDING'")
def pipeline_sample(spark, sf_dir):
    plan = Plan.parse("""
keys: {public.customer: [id]}
tables:
  public.customer:
    - {type: rename, from: {c_custkey: id, c_name: name, c_acctbal: balance}}
    - {type: filter, op: eq, column: c_mktsegment, value: BUILDING}
    - {type: select, columns: [id, name, balance]}
    - {type: redact, columns: [name]}
    - {type: cast, column: balance, to: float}
    - {type: map, column: double_id, expr: "id * 2"}
""")
    changes = log.snapshot(table(spark, sf_dir, "customer"), "public", "customer")
    return compiler.compile_plan(plan)("public.customer", changes).select("after.*")


# Filters


def _orders(spark, sf_dir, **spec) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    return compiler.on_rows(rows, _ops({"type": "filter", **spec}))


_ORDERS = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE "


def _add_comparison(op: str, sign: str) -> None:
    def run(spark, sf_dir):
        return _orders(spark, sf_dir, op=op, column="o_custkey", value=77)

    run.__name__ = f"filter_{op}"
    query(_ORDERS + f"o_custkey {sign} 77")(run)


for _op, _sign in (("eq", "="), ("ne", "<>"), ("lt", "<"), ("gt", ">"), ("le", "<="), ("ge", ">=")):
    _add_comparison(_op, _sign)


@query(_ORDERS + "(o_orderstatus = 'F' OR o_totalprice > 250000) AND NOT (o_custkey < 50)")
def filter_bool_tree(spark, sf_dir):
    either = {"op": "or", "exprs": [{"op": "eq", "column": "o_orderstatus", "value": "F"}, {"op": "gt", "column": "o_totalprice", "value": 250000}]}
    return _orders(spark, sf_dir, op="and", exprs=[either, {"op": "not", "expr": {"op": "lt", "column": "o_custkey", "value": 50}}])


@query(_ORDERS + "false")
def filter_missing_column(spark, sf_dir):
    return _orders(spark, sf_dir, op="ne", column="nope", value=1)


def _with_nulls(spark, sf_dir) -> DataFrame:
    return event_rows(spark, sf_dir).select("event_id", F.expr("case when event_id % 11 = 0 then null else cents end").alias("cents"))


_NULLS = "WITH " + EVENTS_SQL + ", n AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE cents END AS cents FROM base) SELECT * FROM n WHERE "


@query(_NULLS + "cents <= 2000")
def filter_mixed_default(spark, sf_dir):
    return compiler.on_rows(_with_nulls(spark, sf_dir), _ops({"type": "filter", "op": "le", "column": "cents", "value": 2000}))


@query(_NULLS + "cents <= 2000 OR cents IS NULL")
def filter_mixed_parity(spark, sf_dir):
    return compiler.on_rows(_with_nulls(spark, sf_dir), _ops({"type": "filter", "op": "le", "column": "cents", "value": 2000}), mixed_is_true=True)


_RICH = {"type": "filter", "op": "ge", "column": "cents", "value": 1000}


@query(_with("""SELECT lsn, CASE WHEN b AND a THEN 'U' WHEN a THEN 'I' ELSE 'D' END AS op, CASE WHEN b THEN bc END AS before_cents, CASE WHEN a THEN ac END AS after_cents
  FROM (SELECT lsn, CASE WHEN op = 'I' THEN NULL WHEN op = 'U' THEN base.cents ELSE last.cents END AS bc, CASE op WHEN 'I' THEN base.cents WHEN 'U' THEN last.cents END AS ac,
    coalesce(bc >= 1000, false) AS b, coalesce(ac >= 1000, false) AS a FROM log JOIN base USING (event_id) JOIN last USING (event_id)) WHERE a OR b"""))
def filter_transitions(spark, sf_dir):
    out = compiler.apply(event_log(spark, sf_dir), _ops(_RICH))
    return out.select("lsn", "op", F.col("before.cents").alias("before_cents"), F.col("after.cents").alias("after_cents"))


@query(_with("SELECT event_id, cents, 1::BIGINT AS w FROM view WHERE cents >= 1000"))
def filtered_view(spark, sf_dir):
    return zset.canonical(zset.delta(compiler.apply(event_log(spark, sf_dir), _ops(_RICH, {"type": "select", "columns": ["event_id", "cents"]}))))


# Windows


@query(_with(f"SELECT event_id, ts_ms, ts_ms - ts_ms % {HOUR} AS window_start, ts_ms - ts_ms % {HOUR} + {HOUR} AS window_end FROM base"))
def tumbling_assign(spark, sf_dir):
    return windows.assign(event_rows(spark, sf_dir).select("event_id", "ts_ms"), "ts_ms", HOUR)


@query(_with(f"SELECT ts_ms - ts_ms % {HOUR} AS window_start, ts_ms - ts_ms % {HOUR} + {HOUR} AS window_end, event_type, sum(cents)::BIGINT AS sum, count(*) AS count FROM base GROUP BY ALL"))
def tumbling_agg(spark, sf_dir):
    inserts = event_log(spark, sf_dir).where("op = 'I'")
    return batch_windows(inserts, views.ViewConfig(("event_type",), "cents", True, views.WindowSpec("ts_ms", HOUR)))


@query(_with(f"SELECT ts_ms - ts_ms % {HOUR} AS window_start, ts_ms - ts_ms % {HOUR} + {HOUR} AS window_end, event_type, sum(cents)::BIGINT AS sum, count(*) AS count FROM view GROUP BY ALL"))
def tumbling_retract(spark, sf_dir):
    return batch_windows(event_log(spark, sf_dir), views.ViewConfig(("event_type",), "cents", True, views.WindowSpec("ts_ms", HOUR)))


def _late_split(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Every 13th event arrives 700 places late; batches hold 500 places; the delay is an hour."""
    rows = event_rows(spark, sf_dir).withColumn("batch", F.floor((F.col("event_id") + F.when(F.col("event_id") % 13 == 0, 700).otherwise(0)) / 500))
    return windows.split_late(windows.assign(windows.arrival_watermarks(rows, "ts_ms", "batch", HOUR), "ts_ms", HOUR))


_LATE = "WITH " + EVENTS_SQL + f""",
  arrived AS (SELECT *, (event_id + CASE WHEN event_id % 13 = 0 THEN 700 ELSE 0 END) // 500 AS batch FROM base),
  marks AS (SELECT batch, max(max(ts_ms)) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - {HOUR} AS mark FROM arrived GROUP BY batch),
  judged AS (SELECT *, ts_ms - ts_ms % {HOUR} AS window_start, coalesce(ts_ms - ts_ms % {HOUR} + {HOUR} <= mark, false) AS late FROM arrived JOIN marks USING (batch))
"""


@query(_LATE + "SELECT window_start, count(*) AS count, sum(cents)::BIGINT AS sum FROM judged WHERE NOT late GROUP BY window_start")
def late_drop(spark, sf_dir):
    kept, _ = _late_split(spark, sf_dir)
    return kept.groupBy("window_start").agg(F.count("*").alias("count"), F.sum("cents").alias("sum"))


@query(_LATE + "SELECT count(*) AS dropped_late FROM judged WHERE late")
def late_counter(spark, sf_dir):
    return windows.late_count(_late_split(spark, sf_dir)[1])


def _per_window(spark, sf_dir) -> tuple[DataFrame, F.Column]:
    """Windows of the view, and a watermark: a day before the last event, as a scalar subquery."""
    out = batch_windows(event_log(spark, sf_dir), views.ViewConfig((), "cents", True, views.WindowSpec("ts_ms", HOUR)))
    return out, event_rows(spark, sf_dir).agg(F.max("ts_ms") - 24 * HOUR).scalar()


_PER_WINDOW = "WITH " + EVENTS_SQL + f""", m AS (SELECT max(ts_ms) - {24 * HOUR} AS mark FROM base),
  per AS (SELECT ts_ms - ts_ms % {HOUR} AS window_start, ts_ms - ts_ms % {HOUR} + {HOUR} AS window_end, sum(cents)::BIGINT AS sum, count(*) AS count FROM view GROUP BY ALL)
"""


@query(_PER_WINDOW + "SELECT per.* FROM per, m WHERE window_end <= mark")
def windows_closed(spark, sf_dir):
    return windows.closed(*_per_window(spark, sf_dir))


@query(_PER_WINDOW + "SELECT sum(sum)::BIGINT AS sum, sum(count)::BIGINT AS count FROM per, m WHERE window_end > mark")
def windows_open_union(spark, sf_dir):
    return windows.open_(*_per_window(spark, sf_dir)).agg(F.sum("sum").alias("sum"), F.sum("count").alias("count"))


@query(_with("""SELECT event_id, ts_ms - CASE event_id % 4 WHEN 1 THEN 5 * 3600000 WHEN 2 THEN -(3 * 3600000 + 1800000) ELSE 0 END AS ms
  FROM (SELECT * FROM base WHERE event_id % 9 <> 0) UNION ALL SELECT event_id, NULL FROM base WHERE event_id % 9 = 0"""))
def iso_to_millis(spark, sf_dir):
    """Text with no offset, +05, -03:30 and Z; every ninth is no timestamp."""
    e = table(spark, sf_dir, "events")
    text = F.regexp_replace(F.rpad(F.regexp_replace(F.col("ts").cast("string"), r"^([^.]*)$", "$1."), 23, "0"), " ", "T")
    ends = F.expr("case event_id % 4 when 1 then '+05' when 2 then '-03:30' when 3 then 'Z' else '' end")
    iso = F.when(F.col("event_id") % 9 == 0, F.lit("not a time at all")).otherwise(F.concat(text, ends))
    return e.select("event_id", values.iso_to_millis(iso).alias("ms"))


# Reference joins


def _customers(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "customer").where("c_custkey % 10 <> 0").select("c_custkey", "c_mktsegment", "c_nationkey")


@query(_with("SELECT event_id, user_id, cents, c_custkey, c_mktsegment, c_nationkey FROM view LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 10 <> 0) ON c_custkey = user_id"))
def ref_join_left(spark, sf_dir):
    facts = zset.canonical(zset.delta(event_log(spark, sf_dir).select("op", "before", "after"))).select("event_id", "user_id", "cents")
    return refjoin.join_current(facts, _customers(spark, sf_dir), "user_id", "c_custkey")


@query("SELECT o_orderkey, o_custkey, l_orderkey, l_partkey, l_linenumber FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey")
def ref_join_multi(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    return refjoin.join_current(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), lines, "o_orderkey", "l_orderkey")


def _versions(spark, sf_dir) -> DataFrame:
    """Each customer's segment from the start, and another one from a later position on."""
    c = _customers(spark, sf_dir)
    first = F.struct(F.lit(0).cast("bigint").alias("lsn"), F.col("c_mktsegment").alias("segment"))
    second = F.struct((F.col("c_custkey") * 12).alias("lsn"), F.lit("UPGRADED").alias("segment"))
    return c.select("c_custkey", F.explode(F.array(first, second)).alias("v")).select("c_custkey", "v.*")


@query(_with("SELECT event_id, 4 * event_id + 1 AS lsn, user_id, c_custkey, CASE WHEN c_custkey * 12 <= 4 * event_id + 1 THEN 'UPGRADED' ELSE c_mktsegment END AS segment FROM base LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 10 <> 0) ON c_custkey = user_id"))
def ref_join_asof(spark, sf_dir):
    facts = event_log(spark, sf_dir).where("op = 'I'").select("after.event_id", "lsn", "after.user_id")
    return refjoin.join_asof(facts, _versions(spark, sf_dir), "user_id", "c_custkey")


@query(_with("SELECT event_id, user_id, c_custkey, CASE WHEN c_custkey IS NULL THEN NULL ELSE 'UPGRADED' END AS segment FROM base LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 10 <> 0) ON c_custkey = user_id"))
def ref_join_current(spark, sf_dir):
    v = _versions(spark, sf_dir)
    old = v.where("lsn = 0").drop("lsn")
    new = v.where("lsn > 0").drop("lsn")
    reference = zset.merge(old.withColumn("w", F.lit(1).cast("bigint")), old.withColumn("w", F.lit(-1).cast("bigint")), new.withColumn("w", F.lit(1).cast("bigint")))
    return refjoin.join_current(event_rows(spark, sf_dir).select("event_id", "user_id"), reference, "user_id", "c_custkey")


@query(_with(f"SELECT ts_ms - ts_ms % {HOUR} AS window_start, ts_ms - ts_ms % {HOUR} + {HOUR} AS window_end, c_mktsegment, sum(cents)::BIGINT AS sum, count(*) AS count FROM view LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 10 <> 0) ON c_custkey = user_id GROUP BY ALL"))
def join_window_agg(spark, sf_dir):
    delta = refjoin.join_current(zset.delta(event_log(spark, sf_dir)), _customers(spark, sf_dir), "user_id", "c_custkey")
    rows = windows.assign(delta, "ts_ms", HOUR)
    return views.aggregates(rows, views.ViewConfig(("window_start", "window_end", "c_mktsegment"), "cents", True))


@query(_with("SELECT event_id, user_id, c_key, c_mktsegment FROM base LEFT JOIN (SELECT CAST(c_custkey AS VARCHAR) AS c_key, c_mktsegment FROM customer) ON c_key = CAST(user_id AS VARCHAR)"))
def ref_join_text_key(spark, sf_dir):
    """Integer keys meet keys that are text."""
    reference = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("c_key"), "c_mktsegment")
    return refjoin.join_current(event_rows(spark, sf_dir).select("event_id", "user_id"), reference, "user_id", "c_key")


# Kept views


def _batches(spark, sf_dir, write, edges=(0, 3000, 20000, 2**62)) -> None:
    """The event log in three batches, the second one twice."""
    changes = event_log(spark, sf_dir)
    parts = [changes.where((F.col("commit_lsn") > a) & (F.col("commit_lsn") <= b)) for a, b in zip(edges, edges[1:], strict=False)]
    for batch, part in ((0, parts[0]), (1, parts[1]), (1, parts[1]), (2, parts[2])):
        write(part, batch)


@query(_with("SELECT event_id, user_id, event_type, cents, ts_ms, 1::BIGINT AS w FROM view"))
def kept_view_replay(spark, sf_dir):
    """A view kept over batches, one of which is delivered again after it was taken in."""
    view = ViewTableSink(work_dir(spark, "kept-view"))
    _batches(spark, sf_dir, view.write)
    return view.read(spark)


@query(_with("SELECT event_id, event_type, cents, 1::BIGINT AS w FROM base WHERE event_id % 3 = 0"))
def kept_view_truncate(spark, sf_dir):
    """A view kept over batches, then a truncate in a later batch, and every third row again."""
    view = ViewTableSink(work_dir(spark, "kept-view"))
    _batches(spark, sf_dir, view.write)
    rows = event_rows(spark, sf_dir).where("event_id % 3 = 0")
    again = log.snapshot(rows, "public", "events").withColumns({"commit_lsn": F.lit(2**40).cast("bigint"), "lsn": F.lit(2**40).cast("bigint"), "index_in_txn": F.lit(1)})
    cut = spark.range(1).select(
        F.lit(2**40).cast("bigint").alias("commit_lsn"), F.lit(2**40).cast("bigint").alias("lsn"), F.lit(0).alias("index_in_txn"), F.lit("public").alias("namespace"), F.lit("events").alias("table"), F.lit("T").alias("op"),
        *(F.lit(None).cast(rows.schema).alias(side) for side in ("before", "after")), F.array().cast("array<string>").alias("unchanged"),
    )
    view.write(again.unionByName(cut), 3)
    return view.read(spark).select("event_id", "event_type", "cents", "w")


@query(_with("SELECT c_mktsegment, sum(cents)::BIGINT AS sum, count(*) AS count FROM view LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 10 <> 0) ON c_custkey = user_id GROUP BY ALL"))
def kept_join_view(spark, sf_dir):
    """A view of facts joined to a kept reference; both come in batches, the reference first."""
    view = JoinedView(work_dir(spark, "kept-join"), views.JoinSpec("user_id", "c_custkey"))
    view.apply_reference(log.snapshot(_customers(spark, sf_dir), "public", "customer"), 0)
    _batches(spark, sf_dir, view.write)
    return view_aggregates(view.read(spark), views.ViewConfig(("c_mktsegment",), "cents", True))


@query("SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 4 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, 1::BIGINT AS w FROM orders WHERE o_orderkey % 9 <> 0")
def decoded_log(spark, sf_dir):
    """Orders as replication messages in event files, decoded into a view."""
    readers.register(spark)
    path = work_dir(spark, "events")
    order_events(spark, sf_dir).orderBy("seq").write.parquet(path)
    raw = spark.read.format("replication_log").option("path", path).load()
    relation = Relation(7, "public", "orders", (Column("o_orderkey", 20), Column("o_custkey", 20), Column("o_orderstatus", 25)))
    return zset.canonical(zset.delta(log.resolved(readers.typed(raw, relation))))


# Logs


@query(_with("SELECT op, count(*) AS changes, sum(lsn)::BIGINT AS lsns FROM log WHERE (lsn // 64) * 64 + 63 > 1000 GROUP BY op"))
def dedupe_replay(spark, sf_dir):
    """The log with its first part sent again, after position 1000 was committed."""
    changes = event_log(spark, sf_dir)
    again = changes.unionByName(changes.where("commit_lsn < 9000"))
    return log.without_replays(again, 1000).groupBy("op").agg(F.count("*").alias("changes"), F.sum("lsn").alias("lsns"))


@query(_with("SELECT (lsn // 64) * 64 + 63 AS commit_lsn, count(*) AS changes, min(lsn) AS first_lsn, max(lsn) AS last_lsn, string_agg(op, '' ORDER BY lsn) AS ops FROM log GROUP BY 1"))
def txn_envelope(spark, sf_dir):
    t = log.transactions(event_log(spark, sf_dir))
    return t.select("commit_lsn", F.size("changes").cast("bigint").alias("changes"), F.col("changes")[0]["lsn"].alias("first_lsn"), F.element_at("changes", -1)["lsn"].alias("last_lsn"), F.array_join(F.col("changes.op"), "").alias("ops"))


@query(_with("SELECT event_id, event_type, cents, (CASE WHEN event_id % 5 = 0 THEN 4 * (event_id + 1000) + 2 ELSE 4 * event_id + 1 END // 64) * 64 + 63 AS _version FROM view"))
def latest_version(spark, sf_dir):
    rows = log.versions(event_log(spark, sf_dir), ["event_id"])
    return log.latest(rows, ["event_id"]).select("event_id", "event_type", "cents", "_version")


@query("SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 4 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, 1::BIGINT AS w FROM orders WHERE o_orderkey % 9 <> 0")
def backfill_then_stream(spark, sf_dir):
    """A snapshot at 500, then updates and deletes, and one transaction that the snapshot holds."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    image = F.struct("o_orderkey", "o_custkey", "o_orderstatus")
    moved = F.struct("o_orderkey", "o_custkey", F.lit("X").alias("o_orderstatus"))
    null, k = F.lit(None).cast(rows.schema), F.col("o_orderkey")
    change = lambda at, op, before, after: F.struct((k * 3 + at).alias("commit_lsn"), F.lit(op).alias("op"), before.alias("before"), after.alias("after"))
    updated = F.when(k % 4 == 0, change(1000, "U", image, moved))
    deleted = F.when(k % 9 == 0, change(1001, "D", F.when(k % 4 == 0, moved).otherwise(image), null))
    known = F.when(k % 50 == 1, F.struct(F.lit(400).cast("bigint").alias("commit_lsn"), F.lit("I").alias("op"), null.alias("before"), image.alias("after")))
    stream = rows.select(F.explode(F.array_compact(F.array(updated, deleted, known))).alias("c")).select("c.*")
    stream = stream.select("commit_lsn", F.col("commit_lsn").alias("lsn"), F.lit(0).alias("index_in_txn"), F.lit("public").alias("namespace"), F.lit("orders").alias("table"), "op", "before", "after", F.array().cast("array<string>").alias("unchanged"))
    return zset.canonical(zset.delta(log.backfill_then_stream(rows, stream, 500, "public", "orders")))


@query("SELECT doc_id, length(text) AS chars, md5(text) AS digest, CASE WHEN doc_id % 2 = 0 THEN 'moved' ELSE source END AS source FROM documents")
def toast_resolve(spark, sf_dir):
    """Updates that leave the unchanged text out."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    image = F.struct("doc_id", "text", "source")
    sent = F.struct("doc_id", F.lit(None).cast("string").alias("text"), F.lit("moved").alias("source"))
    even = F.col("doc_id") % 2 == 0
    changes = rows.select(F.when(even, "U").otherwise("I").alias("op"), F.when(even, image).alias("before"), F.when(even, sent).otherwise(image).alias("after"), F.when(even, F.array(F.lit("text"))).otherwise(F.array().cast("array<string>")).alias("unchanged"))
    return log.resolved(changes).select("after.*").select("doc_id", F.length("text").cast("bigint").alias("chars"), F.md5("text").alias("digest"), "source")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 8 <> 0 THEN o_custkey END AS as_int, CASE WHEN o_orderkey % 8 <> 0 THEN o_totalprice END AS as_float,
  CASE WHEN o_orderkey % 8 <> 0 THEN o_custkey % 2 = 0 END AS as_bool, o_orderstatus AS as_text FROM orders""")
def typed_decode(spark, sf_dir):
    """Columns sent as text; every eighth row is unreadable."""
    bad = lambda c: F.when(F.col("o_orderkey") % 8 == 0, F.lit("?")).otherwise(c)
    flag = F.when(F.col("o_custkey") % 2 == 0, "t").otherwise("f")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", values.decode(bad(F.col("o_custkey").cast("string")), 20).alias("as_int"), values.decode(bad(F.col("o_totalprice").cast("string")), 701).alias("as_float"),
        values.decode(bad(flag), 16).alias("as_bool"), values.decode(F.col("o_orderstatus"), 25).alias("as_text"),
    )


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 0 ELSE o_custkey * 4294967296 + o_orderkey END AS lsn FROM orders")
def parse_lsn(spark, sf_dir):
    text = F.concat(F.hex("o_custkey"), F.when(F.col("o_orderkey") % 10 == 0, "").otherwise("/"), F.lower(F.hex("o_orderkey")))
    return table(spark, sf_dir, "orders").select("o_orderkey", lsn.parse_lsn(text).alias("lsn"))


@query("""SELECT n_nationkey::BIGINT AS relation_id, 1::BIGINT AS seq, n_name AS name, 'new_relation' AS kind, NULL AS "column", NULL::INTEGER AS old_oid, NULL::INTEGER AS new_oid FROM nation
  UNION ALL SELECT n_nationkey, 2, n_name, CASE n_nationkey % 4 WHEN 0 THEN 'column_added' WHEN 1 THEN 'column_removed' ELSE 'type_changed' END,
    CASE n_nationkey % 4 WHEN 0 THEN 'extra' WHEN 1 THEN 'name' ELSE 'id' END, CASE WHEN n_nationkey % 4 = 2 THEN 23 END, CASE WHEN n_nationkey % 4 = 2 THEN 20 END FROM nation WHERE n_nationkey % 4 <> 3""")
def schema_drift(spark, sf_dir):
    """Relations defined twice: one column more, one less, another type, or the same."""
    column = lambda n, oid: F.struct(F.lit(n).alias("name"), F.lit(oid).alias("type_oid"))
    old = F.array(column("id", 23), column("name", 25))
    kind = F.col("n_nationkey") % 4
    new = F.when(kind == 0, F.array(column("id", 20), column("extra", 25), column("name", 25))).when(kind == 1, F.array(column("id", 23))).when(kind == 2, F.array(column("id", 20), column("name", 25))).otherwise(old)
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("relation_id"), F.col("n_name").alias("name"), F.explode(F.array(F.struct(F.lit(1).cast("bigint").alias("seq"), old.alias("columns")), F.struct(F.lit(2).cast("bigint").alias("seq"), new.alias("columns")))).alias("d"))
    return log.drift(rows.select("relation_id", "name", "d.*"))


@query(_with("SELECT 1234::BIGINT AS confirmed_lsn, max(lsn) AS current_lsn, max(lsn) - 1234 AS lag_bytes FROM log"))
def slot_lag(spark, sf_dir):
    return log.slot_lag(event_log(spark, sf_dir), 1234)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
