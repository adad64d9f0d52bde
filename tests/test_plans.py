import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deltaview.cli import main
from deltaview.plans import compiler, mapexpr, predicates
from deltaview.plans.document import Plan, PlanError, operator

IMAGE = T.StructType([T.StructField("id", T.LongType()), T.StructField("active", T.BooleanType())])


def log(spark, rows):
    return spark.createDataFrame(rows, T.StructType([T.StructField("op", T.StringType()), T.StructField("before", IMAGE), T.StructField("after", IMAGE)]))


def ops(*specs):
    return [operator(s, "test") for s in specs]


ACTIVE = {"type": "filter", "op": "eq", "column": "active", "value": True}


def test_filter_transitions(spark):
    out, inn = (1, False), (1, True)
    rows = [("U", out, out), ("U", out, inn), ("U", inn, inn), ("U", inn, out), ("T", None, None), ("I", None, inn), ("D", inn, None), ("D", out, None)]
    got = [tuple(r) for r in compiler.apply(log(spark, rows), ops(ACTIVE)).collect()]
    assert got == [("I", None, inn), ("U", inn, inn), ("D", inn, None), ("T", None, None), ("I", None, inn), ("D", inn, None)]


@pytest.mark.parametrize(("text", "value"), [("balance * 2 + 1", 21), ("10*2+1", 21), ("1 + 2 * 3 - 4", 3), ("balance - balance * balance", -90), ("nope + 1", None), ("name + 1", None), ("9223372036854775807 + balance", None)])
def test_map_expression(spark, text, value):
    row = spark.createDataFrame([(10, "x")], "balance long, name string")
    assert compiler.on_rows(row, ops({"type": "map", "column": "out", "expr": text})).head()["out"] == value


@pytest.mark.parametrize("text", ["a +", "a $ b", "", "a b", "* a", "(a)", "-1", "1.5 $"])
def test_bad_expression(text):
    with pytest.raises(ValueError):
        mapexpr.parse(text)


def test_map_keeps_old_integer(spark):
    row = spark.createDataFrame([(5, "x")], "balance long, name string")
    got = compiler.on_rows(row, ops({"type": "map", "column": "balance", "expr": "name * 2"}, {"type": "map", "column": "double_balance", "expr": "balance * 2"})).head()
    assert (got["balance"], got["double_balance"]) == (5, 10)


def test_both_images(spark):
    """What an update takes back looks like what an insert put in."""
    rows = log(spark, [("U", (1, True), (2, False))])
    got = compiler.apply(rows, ops({"type": "redact", "columns": ["id"]}, {"type": "cast", "column": "active", "to": "text"})).head()
    assert (tuple(got["before"]), tuple(got["after"])) == (("***", "true"), ("***", "false"))


def test_select_rename(spark):
    row = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    assert compiler.on_rows(row, ops({"type": "select", "columns": ["c", "a", "z"]})).columns == ["a", "c"]
    assert compiler.on_rows(row, ops({"type": "rename", "from": {"a": "b", "b": "a"}})).columns == ["b", "a", "c"]
    with pytest.raises(PlanError):
        compiler.on_rows(row, ops({"type": "rename", "from": {"a": "c"}}))


def matches(spark, kind, value, op, literal, mixed=False):
    df = spark.createDataFrame([(value,)], T.StructType([T.StructField("v", kind)]))
    p = predicates.parse({"op": op, "column": "v", "value": literal})
    return df.select(predicates.compile_predicate(p, lambda n: (F.col("v"), kind), mixed).alias("m")).head()["m"]


@pytest.mark.parametrize(
    ("kind", "value", "literal", "order"),
    [
        (T.LongType(), 5, 5, 0), (T.LongType(), 5, 6, -1), (T.LongType(), 5, 1.5, None), (T.LongType(), 1, True, 0), (T.LongType(), 5, "5", None), (T.LongType(), None, 5, None), (T.LongType(), 5, None, None),
        (T.DoubleType(), 2.5, 2, 1), (T.DoubleType(), math.nan, 7, 0), (T.DoubleType(), 2.5, "2", None), (T.BooleanType(), True, True, 0), (T.BooleanType(), True, False, None),
        (T.StringType(), "b", "a", 1), (T.StringType(), "10", 9, 1), (T.StringType(), "x", 9, None), (T.StringType(), "x", True, None),
    ],
)
def test_comparisons(spark, kind, value, literal, order):
    for mixed in (False, True):
        for op, holds in {"eq": order == 0, "lt": order == -1, "gt": order == 1, "ne": order not in (0, None), "le": order in (-1, 0), "ge": order in (0, 1)}.items():
            expected = holds if order is not None or op in ("eq", "lt", "gt") else mixed
            if op == "ne" and isinstance(kind, T.BooleanType):
                expected = value != literal
            assert matches(spark, kind, value, op, literal, mixed) == expected, (op, mixed)


def test_empty_trees(spark):
    row = spark.createDataFrame([(1,)], "a int")
    assert compiler.on_rows(row, ops({"type": "filter", "op": "and", "exprs": []})).count() == 1
    assert compiler.on_rows(row, ops({"type": "filter", "op": "or", "exprs": []})).count() == 0
    assert compiler.on_rows(row, ops({"type": "filter", "op": "not", "expr": {"op": "ne", "column": "zzz", "value": 1}})).count() == 1


@pytest.mark.parametrize(
    ("value", "kind", "to", "out"),
    [
        ("42", "string", "int", 42), (" 42 ", "string", "int", None), ("1.5", "string", "int", None), ("1.5", "string", "float", 1.5), ("y", "string", "bool", None), ("t", "string", "bool", True), ("FALSE", "string", "bool", False),
        (3, "long", "float", 3.0), (3, "long", "bool", None), (1.0, "double", "text", "1"), (1.5, "double", "text", "1.5"), (1.5, "double", "int", None), (True, "boolean", "text", "true"), (True, "boolean", "int", None), (None, "string", "int", None),
        ("99999999999999999999", "string", "int", None),
    ],
)
def test_casts(spark, value, kind, to, out):
    row = spark.createDataFrame([(value,)], f"v {kind}")
    assert compiler.on_rows(row, ops({"type": "cast", "column": "v", "to": to})).head()["v"] == out


@pytest.mark.parametrize("text", ["tables: {t: [{type: nope}]}", "tables: {t: [{type: cast, column: a, to: date}]}", "tables: {t: [{type: map, column: a, expr: 'a +'}]}", "tables: {t: [{type: select}]}", "x: 1", "[", "- a", "tables: {t: [{type: filter, op: like, column: a, value: b}]}"])
def test_bad_plans(text):
    with pytest.raises(PlanError):
        Plan.parse(text)


PLAN = """
keys: {public.users: [id]}
tables:
  public.users:
    - {type: select, columns: [id, name]}
    - {type: rename, from: {name: label}}
    - {type: map, column: twice, expr: id * 2}
    - {type: filter, op: and, exprs: [{op: gt, column: id, value: 1}, {op: not, expr: {op: eq, column: label, value: x}}]}
"""


def test_plan_check(tmp_path, capsys):
    (tmp_path / "p.yaml").write_text(PLAN)
    assert main(["plan", "check", str(tmp_path / "p.yaml")]) == 0
    out = capsys.readouterr().out
    assert "rename {name->label}" in out and "key public.users: [id]" in out and "plan OK (1 table(s))" in out
    (tmp_path / "q.yaml").write_text("tables: {t: [{type: nope}]}")
    assert main(["plan", "check", str(tmp_path / "q.yaml")]) == 1
    assert main(["plan"]) == 2
