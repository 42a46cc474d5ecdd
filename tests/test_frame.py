"""The behaviour checklist of the dataframe operators, on small rows with nulls, and the documented semantics."""

from __future__ import annotations

import math

import pyarrow as pa
import pytest
from pyspark.sql import types as T

import quillframe as qf
from quillframe import col, lit
from quillframe.sources.csv import infer

PEOPLE = {
    "id": [1, 2, 3, 4, 5],
    "name": ["Alice", "Bob", "Charlie", "Diana", "Eve"],
    "age": [28, 35, 22, 31, 29],
    "salary": [85000.0, 92000.0, 60000.0, 105000.0, 95000.0],
    "dept": ["Engineering", "Sales", "Engineering", "Marketing", "Engineering"],
}


def frame(spark, columns, schema=None):
    if schema:
        return qf.LazyFrame(spark.createDataFrame(list(zip(*columns.values(), strict=True)), schema))
    return qf.from_columns([(k, pa.array(v)) for k, v in columns.items()], spark)


@pytest.fixture(scope="module")
def people(spark):
    return frame(spark, PEOPLE)


@pytest.fixture(scope="module")
def depts(spark):
    return frame(spark, {"dept": ["Engineering", "Sales", "Legal"], "manager": ["Grace", "Jordan", "Ann"]})


@pytest.fixture(scope="module")
def nulls(spark):
    return frame(
        spark,
        {"i": [1, None, 3, 4], "j": [0, 2, None, 3], "f": [1.5, None, -2.0, 0.0], "s": ["a", None, "Éb", ""], "b": [True, None, False, True]},
        "i int, j int, f double, s string, b boolean",
    )


def rows(f, *order):
    got = [tuple(r) for r in f.df.collect()]
    return sorted(got, key=lambda r: tuple((x is None, x) for x in r)) if not order else got


def values(f, expr):
    return [r[0] for r in f.with_column("__v", expr).select(["__v"]).df.collect()]


# --- Select, filter, derived columns.


def test_select(people):
    out = people.select(["salary", "name"])
    assert out.columns == ["salary", "name"] and out.num_rows() == 5 and out.num_columns() == 2
    assert people.select(["id", "id"]).columns == ["id", "id"]
    with pytest.raises(KeyError):
        people.select(["nope"])


@pytest.mark.parametrize(
    ("predicate", "ids"),
    [
        (col("age") > 30, [2, 4]), (col("age") == 22, [3]), (col("age") <= 28, [1, 3]), (col("age") >= 31, [2, 4]),
        (col("age") < 23, [3]), (col("age") != 22, [1, 2, 4, 5]), (col("dept") == "Sales", [2]), (col("dept") != "Engineering", [2, 4]),
        ((col("age") > 25) & (col("salary") < 93000.0), [1, 2]), ((col("age") > 34) | (col("salary") > 100000.0), [2, 4]),
        (~(col("age") > 25), [3]), (col("age") > 28.5, [2, 4, 5]), (lit(30) < col("age"), [2, 4]), (col("age") > 1000, []),
        (col("age") > 0, [1, 2, 3, 4, 5]), (lit(True), [1, 2, 3, 4, 5]), (col("salary") > col("salary").mean(), [2, 4, 5]),
    ],
)
def test_filter(people, predicate, ids):
    assert rows(people.filter(predicate).select(["id"])) == [(i,) for i in ids]


def test_filter_then_select_and_chains(people):
    out = people.filter(col("age") > 30).select(["name", "salary"]).filter(col("salary") > 100000.0)
    assert rows(out) == [("Diana", 105000.0)]


@pytest.mark.parametrize(
    ("expr", "expected"),
    [
        (col("salary") + col("salary"), [170000.0, 184000.0, 120000.0, 210000.0, 190000.0]),
        (col("age") - 20, [8, 15, 2, 11, 9]), (col("age") / 10, [2, 3, 2, 3, 2]), (col("age") % 10, [8, 5, 2, 1, 9]),
        (-col("age"), [-28, -35, -22, -31, -29]), ((col("age") - 30).abs(), [2, 5, 8, 1, 1]),
        ((col("age") + 1) * 2 - col("id"), [57, 70, 43, 60, 55]), (lit(100) - col("age"), [72, 65, 78, 69, 71]),
        (col("age").max(), [35] * 5), (col("age").min(), [22] * 5), (col("age").sum(), [145] * 5), (col("age").count(), [5] * 5),
        (col("age").mean(), [29.0] * 5), (col("name").alias("x").length(), [5, 3, 7, 5, 3]),
    ],
)
def test_expressions(people, expr, expected):
    assert values(people, expr) == expected


def test_with_column_placement(people):
    assert people.with_column("age", col("age") * 2).columns == people.columns
    assert people.with_column("new", lit("x")).columns == [*people.columns, "new"]


# --- Semantics of nulls, types and zero.


def test_null_rules(nulls):
    assert values(nulls, col("i").is_null()) == [False, True, False, False]
    assert values(nulls, col("i").is_not_null()) == [True, False, True, True]
    assert values(nulls, col("i") + col("j")) == [1, None, None, 7]
    assert values(nulls, (col("i") > 0) & (col("j") > 100)) == [False, None, None, False]
    assert values(nulls, (col("i") > 0) | (col("j") > 100)) == [True, None, None, True]
    assert rows(nulls.filter((col("i") > 0) | (col("j") > 100)).select(["i"])) == [(1,), (4,)]
    assert values(nulls, ~col("b")) == [False, None, True, False]
    assert rows(nulls.filter(col("b")).select(["i"])) == [(1,), (4,)]


def test_division_and_remainder(spark):
    f = frame(spark, {"a": [7, -7, 5, None], "b": [2, 2, 0, 0]}, "a int, b int")
    assert values(f, col("a") / col("b")) == [3, -3, 0, None]
    assert values(f, col("a") % col("b")) == [1, -1, 0, None]
    assert f.with_column("q", col("a") / col("b")).df.schema["q"].dataType == T.IntegerType()
    d = frame(spark, {"a": [1.0, -1.0, 0.0, 1.0, None], "b": [0.0, 0.0, 0.0, -0.0, 0.0]}, "a double, b double")
    got = values(d, col("a") / col("b"))
    assert got[0] == math.inf and got[1] == -math.inf and math.isnan(got[2]) and got[3] == -math.inf and got[4] is None
    with pytest.raises(TypeError):
        d.with_column("x", col("a") % col("b"))


def test_promotion(spark):
    f = frame(spark, {"i": [1], "l": [2], "f": [0.5], "d": [0.25]}, "i int, l long, f float, d double")
    kind = lambda e: f.with_column("x", e).df.schema["x"].dataType
    assert kind(col("i") + col("l")) == T.LongType() and kind(col("l") + col("f")) == T.FloatType()
    assert kind(col("f") / col("f")) == T.FloatType() and kind(col("f") * col("d")) == T.DoubleType()
    assert kind(col("i") * 1.5) == T.DoubleType() and values(f, col("i") * 1.5) == [1.5]


def test_type_errors(people, nulls):
    for bad in (
        lambda: people.filter(col("name") < "x"), lambda: nulls.filter(col("b") == True), lambda: people.filter(col("age") & col("age")),  # noqa: E712
        lambda: people.with_column("x", col("name") + 1), lambda: people.with_column("x", col("age").length()), lambda: people.filter(col("age")),
        lambda: people.with_column("x", col("age").contains("1")), lambda: people.with_column("x", ~col("age")), lambda: bool(col("a") == 1),
    ):
        with pytest.raises(TypeError):
            bad()


def test_strings(nulls):
    assert values(nulls, col("s").length()) == [1, None, 3, 0]
    assert values(nulls, col("s").to_upper()) == ["A", None, "ÉB", ""]
    assert values(nulls, col("s").to_lower()) == ["a", None, "Éb", ""]
    assert values(nulls, col("s").contains("")) == [True, None, True, True]
    assert values(nulls, col("s").starts_with("É")) == [False, None, True, False]
    assert values(nulls, col("s").ends_with("b")) == [False, None, True, False]


def test_names_are_exact(spark):
    f = frame(spark, {"a.b": [1], "A": [2]}, "`a.b` int, A int")
    assert rows(f.filter(col("a.b") == 1).select(["a.b"])) == [(1,)]
    with pytest.raises(KeyError):
        f.select(["a"])


def test_to_string():
    assert str((col("a") + lit(2**40)) > 1.5) == '((col("a") + lit(1099511627776L)) > lit(1.5))'
    assert str(col("s").contains("x")) == 'col("s").contains("x")' and str(col("x").sum()) == 'col("x").sum()'
    assert str(~col("b")) == 'not(col("b"))'


# --- Sort, head.


def test_sort_and_head(people, nulls):
    assert [r[0] for r in rows(people.sort(["salary"], False).head(2).select(["id"]), 1)] == [4, 5]
    assert [r[0] for r in rows(people.sort(["dept", "age"]).select(["id"]), 1)] == [3, 1, 5, 4, 2]
    assert [r[0] for r in rows(nulls.sort(["i"]).select(["i"]), 1)] == [1, 3, 4, None]
    assert [r[0] for r in rows(nulls.sort(["i"], False).select(["i"]), 1)] == [4, 3, 1, None]
    assert people.head(0).num_rows() == 0 and people.head(99).num_rows() == 5 and people.sort([]) is people
    assert rows(people.sort_top_n(["dept", "age"], True, 2).select(["id"]), 1) == [(3,), (1,)]
    assert people.sort_top_n(["age"], True, -1).num_rows() == 0
    with pytest.raises(ValueError):
        people.head(-1)
    assert "TakeOrderedAndProject" in people.sort(["age"]).head(2).df._jdf.queryExecution().executedPlan().toString()


# --- Groups and joins.


def test_group_by(people):
    out = people.group_by(["dept"]).aggregate([("salary", "mean"), ("id", "count"), ("age", "sum"), ("age", "min"), ("age", "max")])
    assert out.columns == ["dept", "salary_mean", "id_count", "age_sum", "age_min", "age_max"]
    assert rows(out)[0] == ("Engineering", 80000.0, 3, 79, 22, 29)
    with pytest.raises(ValueError):
        people.group_by(["dept"]).aggregate([("age", "median")])
    with pytest.raises(ValueError):
        people.group_by([]).aggregate([("age", "sum")])


def test_group_by_nulls(spark):
    f = frame(spark, {"k": ["a", None, "", None], "n": [1, None, 1, None], "x": [1, 2, 3, None]}, "k string, n int, x int")
    assert rows(f.group_by(["k"]).aggregate([("x", "sum")])) == [("", 3), ("a", 1)]
    assert rows(f.group_by(["n"]).aggregate([("x", "count")])) == [(1, 2), (None, 1)]
    assert rows(f.group_by(["k", "n"]).aggregate([("x", "sum")])) == [("", 1, 3), ("a", 1, 1), (None, None, 2)]


def test_joins(people, depts):
    inner = people.join(depts, ["dept"])
    assert inner.columns == [*people.columns, "manager"] and rows(inner.select(["id"])) == [(1,), (2,), (3,), (5,)]
    left = people.join(depts, ["dept"], "left")
    assert rows(left.filter(col("manager").is_null()).select(["id"])) == [(4,)]
    outer = people.join(depts, ["dept"], "outer")
    assert rows(outer.filter(col("id").is_null()).select(["dept", "manager"])) == [("Legal", "Ann")]
    assert outer.num_rows() == 6
    assert people.join(depts.filter(col("dept") == "none"), ["dept"]).num_rows() == 0
    own = people.join(people, ["id"])
    assert own.num_rows() == 5 and "name_right" in own.columns
    with pytest.raises(ValueError):
        people.join(depts, ["dept"], "cross")
    with pytest.raises(ValueError):
        own.join(people, ["id"])


def test_join_keys(spark):
    a = frame(spark, {"k": [1, 1, None], "m": ["x", "y", "z"], "v": [1, 2, 3]}, "k int, m string, v int")
    b = frame(spark, {"k": [1, 1, None], "m": ["x", "w", "z"], "v": [7, 8, 9]}, "k int, m string, v int")
    assert rows(a.join(b, ["k", "m"])) == [(1, "x", 1, 7)]
    assert rows(a.join(b, ["k", "m"], "outer"))[-1] == (None, "z", None, 9)
    assert len(rows(a.join(b, ["k", "m"], "outer"))) == 5
    with pytest.raises(TypeError):
        a.join(frame(spark, {"k": ["1"]}, "k string"), ["k"])


# --- Sources, sinks, plans.


def test_csv(spark, tmp_path):
    text = 'i,b,d,t,x,s,v\n1,true,2020-01-01,2020-01-01 10:00:00,1.5,"a ""q"", b",\n-2,0,NA,,NaN,NA,\n,FALSE,2021-02-03,2020-01-02 00:00:00,3,  pad ,\n'
    (tmp_path / "in.csv").write_text(text)
    f = qf.read_csv(str(tmp_path / "in.csv"), spark=spark)
    kinds = [x.dataType.simpleString() for x in f.df.schema]
    assert kinds == ["bigint", "boolean", "date", "timestamp_ntz", "double", "string", "void"]
    got = f.df.collect()
    assert [r["i"] for r in got] == [1, -2, None] and [r["s"] for r in got] == ['a "q", b', "NA", "  pad "]
    assert [r["b"] for r in got] == [True, False, False] and got[1]["d"] is None and got[1]["x"] is None
    assert qf.read_csv(str(tmp_path / "in.csv"), ["s", "i"], spark).columns == ["s", "i"]
    with pytest.raises(KeyError):
        qf.read_csv(str(tmp_path / "in.csv"), ["nope"], spark)
    assert infer(spark.createDataFrame([("1",), ("x",)], "c string"))["c"].dataType == T.StringType()


def test_round_trips(people, spark, tmp_path):
    for single in (False, True):
        people.write_csv(str(tmp_path / f"c{single}"), single_file=single)
        people.write_parquet(str(tmp_path / f"p{single}"), single_file=single)
        assert (tmp_path / f"c{single}").is_file() == single
        assert rows(qf.read_csv(str(tmp_path / f"c{single}"), spark=spark)) == rows(people)
        assert rows(qf.read_parquet(str(tmp_path / f"p{single}"), spark=spark)) == rows(people)
    assert qf.read_parquet(str(tmp_path / "pTrue"), ["name", "nope"], spark).columns == ["name"]
    assert qf.read_parquet(str(tmp_path / "pTrue"), ["nope"], spark).columns == people.columns


def test_from_columns(spark):
    f = qf.from_columns([("a", pa.array([1, None])), ("b", ["x", "y"])], spark)
    assert rows(f.filter(col("a") == 1)) == [(1, "x")] and f.get_table().num_rows == 2
    assert qf.from_columns([("a", pa.array([], pa.int64()))], spark).num_rows() == 0
    for bad in ([("a", [1]), ("a", [2])], [("a", [1]), ("b", [1, 2])]):
        with pytest.raises(ValueError):
            qf.from_columns(bad, spark)


def test_lazy(people, spark, tmp_path):
    people.write_parquet(str(tmp_path / "p"))
    lazy = qf.scan_parquet(str(tmp_path / "p"), spark=spark)
    out = lazy.select(["name", "salary"]).filter(col("salary") > 90000.0)
    assert rows(out.collect()) == [("Bob", 92000.0), ("Diana", 105000.0), ("Eve", 95000.0)]
    plan = out.df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(salary,90000.0)" in plan and "age" not in plan.split("ReadSchema")[1]
    both = lazy.filter((col("age") > 25) & (col("age") < 30))
    assert "LessThan(age,30)" in both.df._jdf.queryExecution().executedPlan().toString()
    out.sink_csv(str(tmp_path / "s"))
    assert rows(qf.read_csv(str(tmp_path / "s"), spark=spark)) == rows(out)
    dot = lazy.join(lazy, ["id"]).explain(str(tmp_path / "plan.png"))
    assert dot.startswith("digraph") and dot.count("scan parquet") == 1 and (tmp_path / "plan.png").exists()


def test_stream(people, spark, tmp_path):
    from quillframe.streaming import stream_parquet

    people.write_parquet(str(tmp_path / "in"))
    out = stream_parquet(spark, str(tmp_path / "in"), people.df.schema).filter(col("age") > 30).select(["id"])
    run = out.df.writeStream.format("memory").queryName("older").start()
    run.processAllAvailable()
    run.stop()
    assert sorted(r.id for r in spark.table("older").collect()) == [2, 4]
