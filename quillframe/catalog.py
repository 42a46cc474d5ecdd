"""The named queries of the dataframe operators, each with its SQL.

``CATALOG`` maps a name to a pair: a function of a session and a table folder, and DuckDB SQL over the same tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import quillframe as qf
from quillframe import col, lit
from quillframe.operators.frame import LazyFrame
from quillframe.sources.scratch import new_path

Query = Callable[[SparkSession, str], DataFrame]
CATALOG: dict[str, tuple[Query, str]] = {}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "events")


def add(name: str, sql: str):
    """Registers a function from a table opener to a frame."""

    def register(build: Callable[[Callable[[str], LazyFrame]], qf.Frame]):
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(lambda table: qf.scan_parquet(f"{sf_dir}/{table}.parquet", spark=spark)).df

        CATALOG[name] = (query, sql)
        return build

    return register


def one(name: str, table: str, build: Callable[[LazyFrame], qf.Frame], sql: str) -> None:
    add(name, sql)(lambda t: build(t(table)))


for _table in TABLES:
    one(f"scan_parquet_{_table}", _table, lambda f: f, f"SELECT * FROM {_table}")

# Projection and limit.
one("select_cols", "orders", lambda f: f.select(["o_orderkey", "o_totalprice"]), "SELECT o_orderkey, o_totalprice FROM orders")
one("select_reorder", "nation", lambda f: f.select(["n_name", "n_nationkey"]), "SELECT n_name, n_nationkey FROM nation")
one("select_single", "region", lambda f: f.select(["r_name"]), "SELECT r_name FROM region")
one("head_n", "orders", lambda f: f.sort(["o_orderkey"]).head(10), "SELECT * FROM orders ORDER BY o_orderkey LIMIT 10")
one("head_zero", "orders", lambda f: f.head(0), "SELECT * FROM orders LIMIT 0")
one("head_large", "nation", lambda f: f.head(1000), "SELECT * FROM nation LIMIT 1000")

# Filters.
LI = ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount"]
_LI = ", ".join(LI)
for _name, _expr, _sql in (
    ("gt", col("l_quantity") > 45, "l_quantity > 45"),
    ("ge", col("l_quantity") >= 45, "l_quantity >= 45"),
    ("lt", col("l_quantity") < 5, "l_quantity < 5"),
    ("le", col("l_quantity") <= 5, "l_quantity <= 5"),
    ("eq_num", col("l_linenumber") == 3, "l_linenumber = 3"),
    ("ne_num", col("l_linenumber") != 3, "l_linenumber <> 3"),
    ("eq_str", col("l_returnflag") == "R", "l_returnflag = 'R'"),
    ("ne_str", col("l_returnflag") != "R", "l_returnflag <> 'R'"),
    ("and", (col("l_quantity") > 30) & (col("l_discount") < 0.03), "l_quantity > 30 AND l_discount < 0.03"),
    ("or", (col("l_quantity") > 48) | (col("l_discount") < 0.01), "l_quantity > 48 OR l_discount < 0.01"),
    ("not", ~(col("l_quantity") > 10), "NOT l_quantity > 10"),
    ("promoted", col("l_linenumber") > 2.5, "l_linenumber > 2.5"),
    ("eq_columns", col("l_returnflag") == col("l_linestatus"), "l_returnflag = l_linestatus"),
    ("aliased", (col("l_quantity") > 45).alias("much"), "l_quantity > 45"),
    ("folded", col("l_quantity") > lit(5) * 9, "l_quantity > 45"),
    ("empty", col("l_quantity") > 1e9, "false"),
    ("all", col("l_quantity") > -1, "true"),
):
    one(f"filter_{_name}", "lineitem", lambda f, e=_expr: f.filter(e).select(LI), f"SELECT {_LI} FROM lineitem WHERE {_sql}")
one(
    "filter_chain", "lineitem",
    lambda f: f.filter(col("l_quantity") > 10).filter(col("l_tax") < 0.05).filter(col("l_returnflag") == "N").select(LI),
    f"SELECT {_LI} FROM lineitem WHERE l_quantity > 10 AND l_tax < 0.05 AND l_returnflag = 'N'",
)

# Derived columns.
for _name, _table, _expr, _sql in (
    ("add", "lineitem", col("l_quantity") + col("l_extendedprice"), "l_quantity + l_extendedprice"),
    ("sub", "lineitem", col("l_extendedprice") - col("l_quantity"), "l_extendedprice - l_quantity"),
    ("mul", "lineitem", col("l_extendedprice") * col("l_discount"), "l_extendedprice * l_discount"),
    ("div_float", "lineitem", col("l_extendedprice") / col("l_quantity"), "l_extendedprice / l_quantity"),
    ("div_int", "lineitem", col("l_orderkey") / col("l_linenumber"), "l_orderkey // l_linenumber"),
    ("mod", "lineitem", col("l_orderkey") % 7, "l_orderkey % 7"),
    ("neg", "customer", -col("c_acctbal"), "-c_acctbal"),
    ("abs", "customer", col("c_acctbal").abs(), "abs(c_acctbal)"),
    ("nested", "lineitem", col("l_extendedprice") * (1 - col("l_discount")) * (1 + col("l_tax")), "l_extendedprice * (1 - l_discount) * (1 + l_tax)"),
    ("compare", "lineitem", col("l_quantity") >= 25, "l_quantity >= 25"),
    ("literal_int", "nation", lit(7), "CAST(7 AS INTEGER)"),
    ("literal_str", "nation", lit("x"), "'x'"),
    ("literal_bool", "nation", lit(True), "true"),
    ("literal_double", "nation", lit(0.5), "CAST(0.5 AS DOUBLE)"),
    ("alias", "nation", (col("n_regionkey") + 1).alias("next"), "n_regionkey + 1"),
):
    one(f"wc_{_name}", _table, lambda f, e=_expr: f.with_column("value", e), f"SELECT *, {_sql} AS value FROM {_table}")
one("wc_replace", "part", lambda f: f.with_column("p_size", col("p_size") * 2), "SELECT * REPLACE (p_size * 2 AS p_size) FROM part")
one(
    "div_int_zero", "part", lambda f: f.with_column("value", col("p_size") / (col("p_size") - col("p_size"))),
    "SELECT *, CAST(0 AS INTEGER) AS value FROM part",
)
one(
    "mod_zero", "lineitem", lambda f: f.with_column("value", col("l_orderkey") % (col("l_linenumber") % 2)),
    "SELECT *, CAST(0 AS BIGINT) AS value FROM lineitem",
)
one(
    "div_float_zero", "customer",
    lambda f: f.with_column("value", col("c_acctbal") / (col("c_acctbal") - col("c_acctbal"))),
    "SELECT *, CASE WHEN c_acctbal > 0 THEN CAST('inf' AS DOUBLE) WHEN c_acctbal < 0 THEN CAST('-inf' AS DOUBLE)"
    " ELSE CAST('nan' AS DOUBLE) END AS value FROM customer",
)

# Strings.
_LOW, _UP = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
for _name, _expr, _sql in (
    ("length", col("text").length(), "CAST(strlen(text) AS INTEGER)"),
    ("upper", col("text").to_upper(), f"translate(text, '{_LOW}', '{_UP}')"),
    ("lower", col("text").to_lower(), f"translate(text, '{_UP}', '{_LOW}')"),
    ("contains", col("text").contains("the "), "contains(text, 'the ')"),
    ("starts_with", col("text").starts_with("The"), "starts_with(text, 'The')"),
    ("ends_with", col("text").ends_with("."), "ends_with(text, '.')"),
):
    one(
        f"str_{_name}", "documents", lambda f, e=_expr: f.with_column("value", e).select(["doc_id", "value"]),
        f"SELECT doc_id, {_sql} AS value FROM documents",
    )


# Nulls, made by a left join.
def _labelled(t) -> qf.Frame:
    return t("documents").select(["doc_id", "lang", "n_chars"]).join(t("labels"), ["doc_id"], "left")


_LABELLED = "(SELECT d.doc_id, lang, n_chars, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"
for _name, _expr, _sql in (
    ("is_null", col("quality").is_null(), "quality IS NULL"),
    ("is_not_null", col("quality").is_not_null(), "quality IS NOT NULL"),
    ("null_arith", col("quality") + col("toxic") * 2, "quality + toxic * 2"),
    ("bool_strict_and", (col("quality") == 1) & (col("n_chars") < 0), "CASE WHEN quality IS NOT NULL THEN quality = 1 AND n_chars < 0 END"),
    ("bool_strict_or", (col("quality") == 1) | (col("n_chars") > 0), "CASE WHEN quality IS NOT NULL THEN quality = 1 OR n_chars > 0 END"),
):
    add(_name, f"SELECT *, {_sql} AS value FROM {_LABELLED}")(lambda t, e=_expr: _labelled(t).with_column("value", e))
add("null_filter", f"SELECT * FROM {_LABELLED} WHERE quality = 1")(lambda t: _labelled(t).filter(col("quality") == 1))
add("filter_strict_or", f"SELECT * FROM {_LABELLED} WHERE quality IS NOT NULL AND (quality = 1 OR n_chars > 0)")(
    lambda t: _labelled(t).filter((col("quality") == 1) | (col("n_chars") > 0))
)

# Grouped aggregates.
for _func, _sql in (("sum", "ROUND(SUM({c}), 2)"), ("mean", "ROUND(AVG({c}), 6)"), ("count", "COUNT({c})"), ("min", "MIN({c})"), ("max", "MAX({c})")):

    def _grouped(f: LazyFrame, func: str = _func) -> qf.Frame:
        out = f.group_by(["l_returnflag", "l_linestatus"]).aggregate([("l_extendedprice", func)])
        digits = {"sum": 2, "mean": 6}.get(func)
        name = f"l_extendedprice_{func}"
        return out.derive(out.df.withColumn(name, F.round(name, digits)), "round") if digits else out

    one(
        f"agg_{_func}", "lineitem", _grouped,
        f"SELECT l_returnflag, l_linestatus, {_sql.format(c='l_extendedprice')} AS l_extendedprice_{_func} FROM lineitem GROUP BY ALL",
    )
one(
    "agg_int_sum", "lineitem", lambda f: f.group_by(["l_shipdate"]).aggregate([("l_linenumber", "sum"), ("l_orderkey", "max")]),
    "SELECT l_shipdate, CAST(SUM(l_linenumber) AS BIGINT) AS l_linenumber_sum, MAX(l_orderkey) AS l_orderkey_max FROM lineitem GROUP BY ALL",
)
one(
    "groupby_multi_key", "orders", lambda f: f.group_by(["o_orderstatus", "o_orderpriority"]).aggregate([("o_orderkey", "count"), ("o_totalprice", "max")]),
    "SELECT o_orderstatus, o_orderpriority, COUNT(o_orderkey) AS o_orderkey_count, MAX(o_totalprice) AS o_totalprice_max FROM orders GROUP BY ALL",
)
one(
    "groupby_single_group", "region", lambda f: f.with_column("k", lit(1)).group_by(["k"]).aggregate([("r_regionkey", "count")]),
    "SELECT CAST(1 AS INTEGER) AS k, COUNT(r_regionkey) AS r_regionkey_count FROM region GROUP BY ALL",
)
_FLAGS = "(SELECT d.doc_id, f.lang FROM documents d LEFT JOIN (SELECT doc_id, lang FROM documents WHERE lang <> 'en') f ON d.doc_id = f.doc_id)"


@add("groupby_null_str_key", f"SELECT lang, COUNT(doc_id) AS doc_id_count FROM {_FLAGS} WHERE lang IS NOT NULL GROUP BY lang")
def _null_str_key(t):
    other = t("documents").filter(col("lang") != "en").select(["doc_id", "lang"])
    return t("documents").select(["doc_id"]).join(other, ["doc_id"], "left").group_by(["lang"]).aggregate([("doc_id", "count")])


add("groupby_null_int_key", f"SELECT quality, COUNT(doc_id) AS doc_id_count FROM {_LABELLED} GROUP BY quality")(
    lambda t: _labelled(t).group_by(["quality"]).aggregate([("doc_id", "count")])
)

# Whole-table aggregates.
for _func in ("sum", "mean", "count", "min", "max"):
    _call = {"mean": "AVG"}.get(_func, _func.upper())

    def _scalar(f: LazyFrame, func: str = _func) -> qf.Frame:
        out = f.select(["o_orderkey", "o_totalprice"]).with_column("value", getattr(col("o_totalprice"), func)())
        return out.derive(out.df.withColumn("value", F.round("value", 2)), "round") if func in ("sum", "mean") else out

    _value = f"{_call}(o_totalprice)"
    _value = f"ROUND({_value}, 2)" if _func in ("sum", "mean") else _value
    one(f"scalar_{_func}", "orders", _scalar, f"SELECT o_orderkey, o_totalprice, (SELECT {_value} FROM orders) AS value FROM orders")
one(
    "filter_above_mean", "orders", lambda f: f.filter(col("o_totalprice") > col("o_totalprice").mean() * 1.5),
    "SELECT * FROM orders WHERE o_totalprice > (SELECT AVG(o_totalprice) FROM orders) * 1.5",
)

# Of no rows: null, and 0 for a count.
for _func, _sql in (("sum", "CAST(NULL AS DOUBLE)"), ("mean", "CAST(NULL AS DOUBLE)"), ("count", "CAST(0 AS BIGINT)"), ("min", "CAST(NULL AS DOUBLE)"), ("max", "CAST(NULL AS DOUBLE)")):

    @add(f"scalar_{_func}_no_rows", f"SELECT n_name, {_sql} AS value FROM nation")
    def _scalar_none(t, func=_func):
        none = t("nation").with_column("d", lit(0.5)).filter(col("n_nationkey") < 0)
        value = getattr(col("d"), func)().evaluate(none)
        return none.derive(t("nation").df.select("n_name", value.alias("value")), "with the aggregate")


# Joins.
def _customers(t) -> qf.Frame:
    """Customers under the order's key name."""
    c = t("customer").with_column("o_custkey", col("c_custkey"))
    return c.select(["o_custkey", "c_name", "c_acctbal", "c_mktsegment", "c_nationkey"])


_CUST = "(SELECT c_custkey AS o_custkey, c_name, c_acctbal, c_mktsegment, c_nationkey FROM customer)"
_ORD = ["o_custkey", "o_orderkey", "o_totalprice"]
for _name, _how in (("inner", "JOIN"), ("left", "LEFT JOIN"), ("outer", "FULL JOIN")):

    @add(
        f"join_{_name}",
        f"SELECT o_custkey, o_orderkey, o_totalprice, c_name, c_acctbal, c_mktsegment, c_nationkey FROM"
        f" (SELECT {', '.join(_ORD)} FROM orders WHERE o_totalprice > 200000) o {_how}"
        f" (SELECT * FROM {_CUST} WHERE c_acctbal > 2000) c USING (o_custkey)",
    )
    def _join(t, how=_name):
        right = _customers(t).filter(col("c_acctbal") > 2000)
        return t("orders").select(_ORD).filter(col("o_totalprice") > 200000).join(right, ["o_custkey"], how)


@add("join_self", "SELECT a.*, b.n_nationkey AS n_nationkey_right, b.n_name AS n_name_right FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey")
def _join_self(t):
    return t("nation").join(t("nation"), ["n_regionkey"])


@add("join_empty", "SELECT o_custkey, o_orderkey, c_name FROM orders JOIN (SELECT c_custkey AS o_custkey, c_name FROM customer) USING (o_custkey) WHERE false")
def _join_empty(t):
    none = _customers(t).filter(col("c_acctbal") > 1e12).select(["o_custkey", "c_name"])
    return t("orders").select(["o_custkey", "o_orderkey"]).join(none, ["o_custkey"])


@add(
    "join_multi_key",
    "SELECT l_orderkey, l_linenumber, l_quantity, m FROM lineitem JOIN (SELECT l_orderkey, l_linenumber, MAX(l_extendedprice) AS m"
    " FROM lineitem GROUP BY ALL) USING (l_orderkey, l_linenumber)",
)
def _join_multi(t):
    keys = ["l_orderkey", "l_linenumber"]
    best = t("lineitem").group_by(keys).aggregate([("l_extendedprice", "max")])
    best = best.with_column("m", col("l_extendedprice_max")).select([*keys, "m"])
    return t("lineitem").select([*keys, "l_quantity"]).join(best, keys)


@add(
    "join_suffix",
    "SELECT a.doc_id, a.lang, a.n_chars, b.lang AS lang_right FROM documents a JOIN documents b ON a.doc_id = b.doc_id WHERE b.n_chars > 2000",
)
def _join_suffix(t):
    right = t("documents").filter(col("n_chars") > 2000).select(["doc_id", "lang"])
    return t("documents").select(["doc_id", "lang", "n_chars"]).join(right, ["doc_id"])


_CHAIN = f"orders JOIN {_CUST} USING (o_custkey) JOIN nation ON c_nationkey = n_nationkey"


@add("join_chain", f"SELECT o_orderkey, c_name, n_name FROM {_CHAIN} WHERE o_totalprice > 300000")
def _join_chain(t):
    nations = t("nation").with_column("c_nationkey", col("n_nationkey")).select(["c_nationkey", "n_name"])
    big = t("orders").filter(col("o_totalprice") > 300000)
    return big.join(_customers(t), ["o_custkey"]).join(nations, ["c_nationkey"]).select(["o_orderkey", "c_name", "n_name"])


@add(
    "join_outer_multi_key",
    "SELECT o_custkey, o_orderstatus, o_totalprice_max, o_totalprice_min FROM"
    " (SELECT o_custkey, o_orderstatus, MAX(o_totalprice) AS o_totalprice_max FROM orders WHERE o_totalprice > 150000 GROUP BY ALL) FULL JOIN"
    " (SELECT o_custkey, o_orderstatus, MIN(o_totalprice) AS o_totalprice_min FROM orders WHERE o_totalprice < 100000 GROUP BY ALL)"
    " USING (o_custkey, o_orderstatus)",
)
def _join_outer_multi(t):
    keys = ["o_custkey", "o_orderstatus"]
    high = t("orders").filter(col("o_totalprice") > 150000).group_by(keys).aggregate([("o_totalprice", "max")])
    low = t("orders").filter(col("o_totalprice") < 100000).group_by(keys).aggregate([("o_totalprice", "min")])
    return high.join(low, keys, "outer")


# Sorting and top-k.
_O = ["o_orderkey", "o_custkey", "o_totalprice"]
_SEL = f"SELECT {', '.join(_O)} FROM orders"
one("sort_asc", "orders", lambda f: f.select(_O).sort(["o_totalprice", "o_orderkey"]), f"{_SEL} ORDER BY 3, 1")
one("sort_desc", "orders", lambda f: f.select(_O).sort(["o_totalprice", "o_orderkey"], False), f"{_SEL} ORDER BY 3 DESC, 1 DESC")
one("sort_multi", "orders", lambda f: f.select(_O).sort(["o_custkey", "o_orderkey"]), f"{_SEL} ORDER BY 2, 1")
one("top_n", "orders", lambda f: f.select(_O).sort_top_n(["o_orderkey"], False, 25), f"{_SEL} ORDER BY 1 DESC LIMIT 25")
one(
    "top_n_multi", "orders", lambda f: f.select(_O).sort(["o_custkey", "o_orderkey"], False).head(40),
    f"{_SEL} ORDER BY 2 DESC, 1 DESC LIMIT 40",
)
add("sort_nulls_last", f"SELECT * FROM {_LABELLED} ORDER BY quality DESC NULLS LAST, doc_id DESC")(
    lambda t: _labelled(t).sort(["quality", "doc_id"], False)
)

# Chains.
one(
    "chain_filter_sort_head", "orders", lambda f: f.filter(col("o_orderstatus") == "F").sort(["o_totalprice", "o_orderkey"], False).head(20).select(_O),
    f"{_SEL} WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 20",
)
one(
    "chain_wc_filter_groupby", "lineitem",
    lambda f: f.with_column("net", col("l_extendedprice") * (1 - col("l_discount"))).filter(col("net") > 30000).group_by(["l_returnflag"]).aggregate([("net", "count"), ("net", "max")]),
    "SELECT l_returnflag, COUNT(net) AS net_count, MAX(net) AS net_max FROM (SELECT *, l_extendedprice * (1 - l_discount) AS net FROM lineitem)"
    " WHERE net > 30000 GROUP BY 1",
)
one(
    "chain_select_wc", "part", lambda f: f.select(["p_partkey", "p_size"]).with_column("twice", col("p_size") + col("p_size")),
    "SELECT p_partkey, p_size, p_size + p_size AS twice FROM part",
)


@add(
    "chain_full_pipeline",
    "SELECT c_mktsegment, ROUND(SUM(o_totalprice), 2) AS o_totalprice_sum, COUNT(o_orderkey) AS o_orderkey_count,"
    f" ROUND(AVG(c_acctbal), 6) AS c_acctbal_mean FROM orders JOIN {_CUST} USING (o_custkey)"
    " WHERE o_orderstatus = 'F' AND o_totalprice > 100000 GROUP BY 1 ORDER BY 2 DESC NULLS LAST LIMIT 3",
)
def flagship(t):
    orders = t("orders").filter((col("o_orderstatus") == "F") & (col("o_totalprice") > 100000))
    joined = orders.join(_customers(t), ["o_custkey"])
    groups = joined.group_by(["c_mktsegment"]).aggregate([("o_totalprice", "sum"), ("o_orderkey", "count"), ("c_acctbal", "mean")])
    top = groups.sort(["o_totalprice_sum"], False).head(3)
    rounded = top.df.withColumns({"o_totalprice_sum": F.round("o_totalprice_sum", 2), "c_acctbal_mean": F.round("c_acctbal_mean", 6)})
    return top.derive(rounded, "round")


@add(
    "lazy_pushdown_join",
    f"SELECT o_orderkey, c_name FROM orders JOIN {_CUST} USING (o_custkey) WHERE o_totalprice > 250000 AND c_acctbal > 5000",
)
def _pushdown(t):
    joined = t("orders").join(_customers(t), ["o_custkey"])
    return joined.filter((col("o_totalprice") > 250000) & (col("c_acctbal") > 5000)).select(["o_orderkey", "c_name"])


# Files and memory.
@add("csv_roundtrip", "SELECT * FROM customer")
def _csv(t):
    frame = t("customer").collect()
    frame.write_csv(path := new_path(frame.df.sparkSession, "csv"))
    back = qf.read_csv(path, spark=frame.df.sparkSession)
    return back.derive(back.df.withColumn("c_nationkey", F.col("c_nationkey").cast("int")), "int")


@add("parquet_roundtrip", "SELECT * FROM supplier")
def _parquet_roundtrip(t):
    frame = t("supplier")
    frame.sink_parquet(path := new_path(frame.df.sparkSession, "parquet"))
    return qf.scan_parquet(path, spark=frame.df.sparkSession)


@add("from_columns", "SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'a', CAST(0.5 AS DOUBLE)), (2, 'b', NULL), (3, NULL, 2.5)) t(id, name, value)")
def _from_columns(t):
    import pyarrow as pa

    spark = t("region").df.sparkSession
    return qf.from_columns([("id", pa.array([1, 2, 3])), ("name", pa.array(["a", "b", None])), ("value", pa.array([0.5, None, 2.5]))], spark)


def _session(t) -> SparkSession:
    return t("region").df.sparkSession


def _single(t, **values) -> qf.Frame:
    return qf.from_columns([(name, [value]) for name, value in values.items()], _session(t))


@add("read_csv_columns", "SELECT s_name, s_suppkey FROM supplier")
def _csv_columns(t):
    frame = t("supplier")
    frame.sink_csv(path := new_path(_session(t), "csv"))
    return qf.read_csv(path, ["s_name", "s_suppkey"], _session(t))


@add("scan_csv_schema", "SELECT r_regionkey, r_name FROM region")
def _csv_schema(t):
    frame = t("region")
    frame.sink_csv(path := new_path(_session(t), "csv"))
    return qf.scan_csv(path, spark=_session(t), schema=frame.df.schema)


@add("sink_csv", "SELECT p_partkey, p_name, p_retailprice FROM part WHERE p_size > 25")
def _sink_csv(t):
    frame = t("part").filter(col("p_size") > 25).select(["p_partkey", "p_name", "p_retailprice"])
    frame.sink_csv(path := new_path(_session(t), "csv"), single_file=True)
    return qf.read_csv(path, spark=_session(t))


@add("write_parquet", "SELECT * FROM nation")
def _write_parquet(t):
    t("nation").collect().write_parquet(path := new_path(_session(t), "parquet"), single_file=True)
    return qf.read_parquet(path, spark=_session(t))


@add("read_parquet_direct", "SELECT * FROM supplier")
def _read_parquet(t):
    t("supplier").sink_parquet(path := new_path(_session(t), "parquet"))
    return qf.read_parquet(path, spark=_session(t))


@add("read_parquet_columns", "SELECT s_name FROM supplier")
def _read_parquet_columns(t):
    t("supplier").sink_parquet(path := new_path(_session(t), "parquet"))
    return qf.read_parquet(path, ["s_name", "no such column"], _session(t))


@add("table_size", "SELECT (SELECT COUNT(*) FROM orders) AS n_rows, CAST(6 AS BIGINT) AS n_columns, (SELECT COUNT(*) FROM nation) AS table_rows")
def _table_size(t):
    orders = t("orders").collect()
    return _single(t, n_rows=orders.num_rows(), n_columns=orders.num_columns(), table_rows=t("nation").collect().get_table().num_rows)


@add("promotion_float", "SELECT i, CAST(CAST(i AS FLOAT) + f AS FLOAT) AS added, CAST(f AS DOUBLE) * d AS times, i > f AS more FROM (VALUES (CAST(1 AS BIGINT), CAST(0.5 AS FLOAT), CAST(0.1 AS DOUBLE)), (16777217, 1.0, 3.0), (-3, -3.5, 2.0)) t(i, f, d)")
def _promotion_float(t):
    import pyarrow as pa

    columns = [("i", pa.array([1, 16777217, -3])), ("f", pa.array([0.5, 1.0, -3.5], pa.float32())), ("d", pa.array([0.1, 3.0, 2.0]))]
    frame = qf.from_columns(columns, _session(t)).with_column("added", col("i") + col("f")).with_column("times", col("f") * col("d"))
    return frame.with_column("more", col("i") > col("f")).select(["i", "added", "times", "more"])


@add("decimal_aggregates", "SELECT k, CAST(SUM(x) AS DOUBLE) AS x_sum, CAST(AVG(x) AS DOUBLE) AS x_mean, COUNT(x) AS x_count FROM (VALUES ('a', CAST(1.25 AS DECIMAL(9, 2))), ('a', 2.50), ('b', NULL), ('b', 4.00)) t(k, x) GROUP BY k")
def _decimal_aggregates(t):
    import decimal

    columns = [("k", ["a", "a", "b", "b"]), ("x", [decimal.Decimal("1.25"), decimal.Decimal("2.50"), None, decimal.Decimal("4.00")])]
    return qf.from_columns(columns, _session(t)).group_by(["k"]).aggregate([("x", "sum"), ("x", "mean"), ("x", "count")])


@add("expression_text", """SELECT '((col("a") + lit(1)) > lit(2.5))' AS comparison, 'col("s").contains("x")' AS match, 'not(col("b"))' AS negated, true AS valid, false AS empty""")
def _expression_text(t):
    texts = {"comparison": (col("a") + 1 > 2.5).to_string(), "match": col("s").contains("x").to_string(), "negated": (~col("b")).to_string()}
    return _single(t, **texts, valid=col("a").valid(), empty=qf.Expr().valid())


@add("plan_text", "SELECT 'digraph plan {' AS first, CAST(3 AS BIGINT) AS steps, 'head 5' AS label")
def _plan_text(t):
    frame = t("nation").filter(col("n_regionkey") == 1).head(5)
    dot = frame.explain()
    return _single(t, first=dot.splitlines()[0], steps=dot.count("[label="), label=frame.plan().label)


def _error(call) -> str:
    try:
        call()
    except Exception as e:
        return type(e).__name__
    return ""


@add(
    "errors",
    "SELECT 'ValueError' AS unknown_function, 'TypeError' AS string_order, 'TypeError' AS boolean_comparison, 'KeyError' AS unknown_column,"
    " 'ValueError' AS unknown_join, 'TypeError' AS sum_of_strings",
)
def _errors(t):
    nation = t("nation")
    return _single(
        t,
        unknown_function=_error(lambda: nation.group_by(["n_regionkey"]).aggregate([("n_nationkey", "median")])),
        string_order=_error(lambda: nation.filter(col("n_name") < "M")),
        boolean_comparison=_error(lambda: nation.filter((col("n_nationkey") > 1) == lit(True))),
        unknown_column=_error(lambda: nation.select(["nope"])),
        unknown_join=_error(lambda: nation.join(nation, ["n_nationkey"], "cross")),
        sum_of_strings=_error(lambda: nation.with_column("x", col("n_name").sum())),
    )
