"""Checked queries: sources, cleaning, targets, statistics and chart tables.

Each query runs one operator over whole tables; its SQL twin computes the same columns with a plain
query engine.  The tables have no gaps, so gaps, units and near copies are derived on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabspark.columns import SEED
from tabspark.functions.special import chi2_tail, f_tail
from tabspark.operators import charts, correlation, density, effects, filters, missing, outliers, target
from tabspark.operators.profile import profile, top_shares
from tabspark.session import shared_scratch
from tabspark.sources import readers, runlog

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn
    return register


def read(spark: SparkSession, sf: str, name: str, *columns: str) -> DataFrame:
    return readers.load_parquet(spark, f"{sf}/{name}.parquet", list(columns) or None)


def rounded(df: DataFrame, digits: int = 4, **special: int) -> DataFrame:
    """Round every double; adding zero turns a negative zero into zero."""
    return df.select(*[
        (F.round(F.col(f"`{c}`"), special.get(c, digits)) + F.lit(0.0)).alias(c) if t in ("double", "float") else F.col(f"`{c}`").cast("bigint").alias(c) if t == "int" else F.col(f"`{c}`")
        for c, t in df.dtypes
    ])


LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def union_sql(template: str, names: list[str]) -> str:
    return " UNION ALL ".join(template.replace("{c}", c) for c in names)


# -- sources and sinks -----------------------------------------------------------------------------

@query("SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def load_csv(spark, sf):
    path = f"{shared_scratch(spark)}/orders.csv"
    read(spark, sf, "orders").write.csv(path, header=True, sep=";")
    df = readers.load_csv(spark, path, delimiter=";", schema="o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate string, o_orderpriority string")
    return rounded(df.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total")), 2)


@query("SELECT l_returnflag, count(*) AS n, round(avg(l_quantity), 4) AS mean_quantity FROM lineitem WHERE l_discount > 0.05 GROUP BY 1")
def load_parquet_columns(spark, sf):
    df = readers.load_parquet(spark, f"{sf}/lineitem.parquet", ["l_returnflag", "l_quantity"], where="l_discount > 0.05")
    return rounded(df.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.avg("l_quantity").alias("mean_quantity")))


@query("SELECT c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer GROUP BY 1")
def load_file_by_suffix(spark, sf):
    path = f"{shared_scratch(spark)}/customer.tsv"
    read(spark, sf, "customer").write.csv(path, header=True, sep="\t")
    df = readers.load_file(spark, path)
    return rounded(df.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.sum("c_acctbal").alias("total")), 2)


@query("""
SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events
UNION ALL
SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events WHERE event_type = 'click'
""")
def json_records(spark, sf):
    events = read(spark, sf, "events", "event_id", "event_type", "props")
    body = (F.when(F.col("event_type") == "click", F.concat(F.lit("["), "props", F.lit(","), "props", F.lit("]")))
            .when(F.col("event_type") == "error", F.concat(F.lit('{"status": "ok", "results": ['), "props", F.lit("]}"))).otherwise(F.col("props")))
    return readers.json_records(events.withColumn("body", body), "body", "k bigint", keep=["event_id"])


TIDY = "CASE WHEN l_quantity > 40 THEN NULL ELSE {c} END"


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CASE WHEN event_id % 97 = 0 THEN event_id END AS late FROM events")
def json_records_inferred(spark, sf):
    """Objects with a text under a list key are records themselves; a field of few documents is in the inferred schema."""
    events = read(spark, sf, "events", "event_id", "props")
    late = F.when(F.col("event_id") % 97 == 0, F.concat(F.lit(', "late": '), F.col("event_id").cast("string"))).otherwise("")
    body = F.concat(F.lit('{"event_id": '), F.col("event_id").cast("string"), F.lit(', "data": "[1,2]", "k": '), F.get_json_object("props", "$.k"), late, F.lit("}"))
    documents = events.select(body.alias("body"))
    return readers.json_records(documents, "body", readers.infer_record_schema(documents, "body")).select("event_id", "k", "late")


@query(union_sql(f"SELECT '{{c}}' AS name, count({TIDY}) AS n, (SELECT count(*) FROM lineitem WHERE l_quantity <= 40) AS rows_after, 8 AS columns_before, 6 AS columns_after FROM lineitem",
                 ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]))
def tidy_on_load(spark, sf):
    """Rows without any value, an empty column and a constant column disappear."""
    line = read(spark, sf, "lineitem")
    names = [*LINE_NUMBERS, "l_returnflag", "l_linestatus"]
    keep = F.col("l_quantity") <= 40
    gappy = line.select(*[F.when(keep, F.col(c)).alias(c) for c in names], F.lit(None).cast("double").alias("empty"), F.when(keep, F.lit(7)).alias("constant"))
    tidy = readers.tidy_on_load(gappy)
    report = readers.load_report(gappy, tidy)
    counts = tidy.select(*[F.col(c).isNotNull().cast("int").alias(c) for c in tidy.columns])
    cells = counts.agg(*[F.sum(c).alias(c) for c in tidy.columns])
    long = cells.select(F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("n")) for c in tidy.columns])))
    return long.join(F.broadcast(report.select("rows_after", "columns_before", "columns_after")))  # one row


@query("SELECT doc_id, md5(text) AS md5, sha256(text) AS sha256 FROM documents")
def text_fingerprints(spark, sf):
    docs = read(spark, sf, "documents", "doc_id", "text")
    return docs.select("doc_id", readers.digest(F.col("text"), "md5").alias("md5"), readers.digest(F.col("text"), "sha256").alias("sha256"))


@query()
def file_fingerprints(spark, sf):
    return readers.content_hash(spark, f"{sf}/*.parquet").select(F.element_at(F.split("path", "/"), -1).alias("name"), "algorithm", "hash", "size_bytes")


@query("SELECT o_orderpriority, count(*) AS n, round(avg(o_totalprice), 4) AS mean_price FROM orders GROUP BY 1")
def write_table(spark, sf):
    path = runlog.write_table(read(spark, sf, "orders"), shared_scratch(spark), "statistics", partition_by="o_orderstatus")
    return rounded(spark.read.parquet(path).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.avg("o_totalprice").alias("mean_price")))


def _runs(spark, sf):
    orders = read(spark, sf, "orders")
    return orders.select(
        F.col("o_orderpriority").alias("experiment"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("run_id"), F.lit("model").alias("step"),
        F.col("o_orderstatus").alias("module"), F.when(F.col("o_totalprice") > 250000, "FAILED").otherwise("FINISHED").alias("status"),
        F.col("o_orderdate").alias("start_time"), F.create_map(F.lit("customer"), F.col("o_custkey").cast("string")).alias("params"),
        F.create_map(F.lit("mae"), F.col("o_totalprice")).alias("metrics"), F.create_map(F.lit("k"), F.lit("v")).alias("tags"))


RUNS_SQL = """WITH runs AS (SELECT o_orderpriority AS experiment, lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS run_id, o_orderstatus AS module,
  CASE WHEN o_totalprice > 250000 THEN 'FAILED' ELSE 'FINISHED' END AS status, o_orderdate AS start_time, o_totalprice AS mae FROM orders) """


@query(RUNS_SQL + "SELECT run_id, module, round(mae, 2) AS mae FROM runs WHERE experiment = '1-URGENT' ORDER BY start_time DESC, run_id LIMIT 50")
def list_runs(spark, sf):
    path = runlog.write_table(_runs(spark, sf), shared_scratch(spark), "runs")
    newest = runlog.list_runs(runlog.run_log(spark, path), "1-URGENT", ["model"], limit=50)
    return newest.select("run_id", "module", F.round(F.col("metrics")["mae"], 2).alias("mae"))


@query(RUNS_SQL + "SELECT module, arg_max(run_id, (start_time, run_id)) AS run_id FROM runs WHERE experiment = '5-LOW' AND status = 'FINISHED' GROUP BY 1")
def finished_models(spark, sf):
    return runlog.finished_models(_runs(spark, sf), "5-LOW")


@query()
def list_run_artifacts(spark, sf):
    base = shared_scratch(spark)
    runlog.write_table(read(spark, sf, "nation").repartition(1), base, "nation")
    runlog.write_table(read(spark, sf, "customer").repartition(2), base, "customer")
    return runlog.list_run_artifacts(spark, base).select(F.regexp_extract("path", "/([a-z]+)[.]parquet/", 1).alias("name"), "size_bytes")


# -- cleaning ---------------------------------------------------------------------------------------

GAP = "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END"
GAP_TEXT = "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderpriority END"


def gappy_orders(spark, sf) -> DataFrame:
    orders = read(spark, sf, "orders")
    return orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate",
                         F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("price"),
                         F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")).alias("priority"))


@query("SELECT o_orderkey, o_totalprice FROM orders")
def common_filter(spark, sf):
    return filters.common_filter(read(spark, sf, "orders"), drop=["o_custkey", "unknown"], remain=["o_orderkey", "o_custkey", "o_totalprice"])


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def drop_missing(spark, sf):
    orders = read(spark, sf, "orders", "o_orderkey", "o_custkey", "o_totalprice")
    wide = orders.withColumn("mostly_empty", F.when(F.col("o_orderkey") % 4 == 0, F.col("o_totalprice"))).withColumn("half_empty", F.when(F.col("o_orderkey") % 2 == 0, F.lit("x")))
    return filters.drop_missing(wide, 0.6, {"half_empty": 0.4})


def _filled(spark, sf, columns=("o_orderkey", "price"), **kw):
    df = gappy_orders(spark, sf).select(*dict.fromkeys([*columns, *kw.pop("extra", [])]))
    return missing.fill_missing(df, **kw)


@query(f"SELECT o_orderkey, round(coalesce({GAP}, (SELECT avg({GAP}) FROM orders)), 4) AS price, CAST(o_orderkey % 7 = 0 AS BIGINT) AS price_is_missing FROM orders")
def fill_mean(spark, sf):
    return rounded(_filled(spark, sf, strategy="mean"))


@query(f"SELECT o_orderkey, round(coalesce({GAP}, (SELECT quantile_cont({GAP}, 0.5) FROM orders)), 4) AS price, CAST(o_orderkey % 7 = 0 AS BIGINT) AS price_is_missing FROM orders")
def fill_median(spark, sf):
    return rounded(_filled(spark, sf, strategy="median"))


MODE_SQL = f"SELECT v FROM (SELECT {GAP_TEXT} AS v, count(*) AS n FROM orders GROUP BY 1) WHERE v IS NOT NULL ORDER BY n DESC, v LIMIT 1"


@query(f"SELECT o_orderkey, coalesce({GAP_TEXT}, ({MODE_SQL})) AS priority FROM orders")
def fill_mode(spark, sf):
    return _filled(spark, sf, ("o_orderkey", "priority"), strategy="mode", missing_indicator=False)


@query(f"SELECT o_orderkey, coalesce({GAP_TEXT}, 'none') AS priority FROM orders")
def fill_value(spark, sf):
    return _filled(spark, sf, ("o_orderkey", "priority"), strategy="fill", column_fill_value={"priority": "none"}, missing_indicator=False)


@query(f"SELECT o_orderkey, coalesce({GAP}, (SELECT quantile_cont({GAP}, 0.5) FROM orders)) AS price, coalesce({GAP_TEXT}, 'Unknown') AS priority FROM orders")
def fill_fallback(spark, sf):
    """A number with a text-only strategy takes its median, a text with a numeric one the fill value."""
    return _filled(spark, sf, ("o_orderkey", "price", "priority"), strategy="fill", column_strategy={"priority": "mean"}, missing_indicator=False)


EVENT_GAP = "CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END"


def gappy_events(spark, sf) -> DataFrame:
    events = read(spark, sf, "events", "event_id", "user_id", "ts", "value")
    return events.withColumn("value", F.when(F.col("event_id") % 3 != 0, F.col("value")))


@query(f"SELECT event_id, user_id, last_value({EVENT_GAP} IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS value FROM events")
def fill_forward(spark, sf):
    return missing.fill_missing(gappy_events(spark, sf), "forward", order_by=["ts", "event_id"], partition_by="user_id", missing_indicator=False).select("event_id", "user_id", "value")


@query(f"SELECT event_id, first_value({EVENT_GAP} IGNORE NULLS) OVER (ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS value FROM events")
def fill_backward(spark, sf):
    return missing.fill_missing(gappy_events(spark, sf), "backward", order_by=["ts", "event_id"], missing_indicator=False).select("event_id", "value")


@query(f"""
WITH base AS (SELECT event_id, {EVENT_GAP} AS v, row_number() OVER (ORDER BY ts, event_id) AS pos FROM events),
spots AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN pos END IGNORE NULLS) OVER (ORDER BY pos ROWS UNBOUNDED PRECEDING) AS p0,
  first_value(CASE WHEN v IS NOT NULL THEN pos END IGNORE NULLS) OVER (ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS p1,
  last_value(v IGNORE NULLS) OVER (ORDER BY pos ROWS UNBOUNDED PRECEDING) AS v0,
  first_value(v IGNORE NULLS) OVER (ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS v1 FROM base)
SELECT event_id, round(CASE WHEN v IS NOT NULL THEN v WHEN v0 IS NULL THEN NULL WHEN v1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * (pos - p0) / (p1 - p0) END, 6) AS value FROM spots
""")
def fill_interpolate(spark, sf):
    out = missing.fill_missing(gappy_events(spark, sf), "interpolate", order_by=["ts", "event_id"], missing_indicator=False)
    return rounded(out.select("event_id", "value"), 6)


@query(f"""
WITH g AS (SELECT o_orderkey, o_orderstatus, {GAP_TEXT} AS priority, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_custkey END AS cust FROM orders),
mt AS (SELECT o_orderstatus, priority AS m FROM (SELECT o_orderstatus, priority, row_number() OVER (PARTITION BY o_orderstatus ORDER BY count(*) DESC, priority) AS k FROM g WHERE priority IS NOT NULL GROUP BY 1, 2) WHERE k = 1),
mc AS (SELECT o_orderstatus, cust AS m FROM (SELECT o_orderstatus, cust, row_number() OVER (PARTITION BY o_orderstatus ORDER BY count(*) DESC, cust) AS k FROM g WHERE cust IS NOT NULL GROUP BY 1, 2) WHERE k = 1)
SELECT o_orderkey, coalesce(g.priority, mt.m) AS priority, CAST(coalesce(g.cust, mc.m) AS DOUBLE) AS cust FROM g JOIN mt USING (o_orderstatus) JOIN mc USING (o_orderstatus)
""")
def fill_grouped_mode(spark, sf):
    df = gappy_orders(spark, sf).select("o_orderkey", "o_orderstatus", "priority", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_custkey")).cast("double").alias("cust"))
    return missing.fill_missing(df, "fill_grouped_mode", group_by="o_orderstatus", missing_indicator=False).select("o_orderkey", "priority", "cust")


@query("SELECT p_partkey, CAST(p_size AS DOUBLE) AS \"weight(kg)\", p_retailprice AS \"p_retailprice(usd)\" FROM part")
def strip_units(spark, sf):
    part = read(spark, sf, "part", "p_partkey", "p_size", "p_retailprice")
    labelled = part.select("p_partkey", F.concat(F.col("p_size").cast("string"), F.lit(" kg")).alias("weight"), "p_retailprice")
    return filters.strip_units(labelled, {"weight": "kg", "p_retailprice": "usd"})


@query("SELECT l_returnflag, l_linestatus, l_quantity, l_extendedprice FROM lineitem")
def variance_filter(spark, sf):
    line = read(spark, sf, "lineitem", "l_returnflag", "l_linestatus", *LINE_NUMBERS)
    return filters.variance_filter(line.withColumn("constant", F.lit(3.0)), 0.01)


ROW_MEAN = "((l_quantity + l_discount + l_tax) / 3)"


@query(f"""SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax FROM (SELECT *, (power(l_quantity - {ROW_MEAN}, 2) + power(l_discount - {ROW_MEAN}, 2)
 + power(l_tax - {ROW_MEAN}, 2)) / 2 AS v FROM lineitem) WHERE v >= 30.123""")
def row_variance_filter(spark, sf):
    line = read(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax")
    key = F.struct("l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber")).alias("key")
    out = filters.row_variance_filter(line.select(key, "l_quantity", "l_discount", "l_tax"), 30.123)
    return out.select("key.*", "l_quantity", "l_discount", "l_tax")


@query("SELECT l_returnflag, l_quantity, l_discount, l_extendedprice * 1.01 + l_tax AS near_copy FROM lineitem")
def correlation_filter(spark, sf):
    line = read(spark, sf, "lineitem", "l_returnflag", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    wide = line.select("l_returnflag", "l_quantity", "l_extendedprice", "l_discount", (F.col("l_extendedprice") * 1.01 + F.col("l_tax")).alias("near_copy"))
    return filters.correlation_filter(wide, 0.99)


@query("SELECT p_name, p_size FROM part")
def correlation_filter_ranks(spark, sf):
    """A monotone but far from linear copy: only ranks tell."""
    part = read(spark, sf, "part", "p_name", "p_size")
    return filters.correlation_filter(part.withColumn("curve", F.exp(-F.col("p_size").cast("double"))), 0.99)


IQR_SQL = """WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.75) AS b FROM orders),
f AS (SELECT a - 0.4 * (b - a) AS lo, b + 0.4 * (b - a) AS hi FROM q) """


@query(IQR_SQL + "SELECT o_orderkey, o_totalprice FROM orders, f WHERE o_totalprice BETWEEN lo AND hi")
def iqr_remove(spark, sf):
    return outliers.iqr_detector(read(spark, sf, "orders", "o_orderkey", "o_totalprice"), threshold=0.4, columns="o_totalprice")


@query(IQR_SQL + "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, round(least(greatest(o_totalprice, lo), hi), 4) AS o_totalprice FROM orders, f")
def iqr_cap(spark, sf):
    orders = read(spark, sf, "orders", "o_orderkey", "o_totalprice").withColumn("o_orderkey", F.col("o_orderkey").cast("string"))
    return rounded(outliers.iqr_detector(orders, "cap", threshold=0.4))


@query(IQR_SQL + "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CASE WHEN o_totalprice BETWEEN lo AND hi THEN o_totalprice ELSE -1 END AS o_totalprice FROM orders, f")
def iqr_replace(spark, sf):
    orders = read(spark, sf, "orders", "o_orderkey", "o_totalprice").withColumn("o_orderkey", F.col("o_orderkey").cast("string"))
    return outliers.iqr_detector(orders, "replace", threshold=0.4, replace_value=-1.0)


Z_SQL = "WITH s AS (SELECT avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS d FROM orders) "


@query(Z_SQL + "SELECT o_orderkey, o_totalprice FROM orders, s WHERE abs(o_totalprice - m) / d <= 1.5")
def zscore_remove(spark, sf):
    return outliers.zscore_detector(read(spark, sf, "orders", "o_orderkey", "o_totalprice"), threshold=1.5, columns=["o_totalprice"])


@query("WITH s AS (SELECT avg(value) AS m, stddev_samp(value) AS d FROM events) SELECT CAST(event_id AS VARCHAR) AS event_id, round(least(greatest(value, m - 3 * d), m + 3 * d), 4) AS value FROM events, s")
def zscore_cap(spark, sf):
    events = read(spark, sf, "events", "event_id", "value").withColumn("event_id", F.col("event_id").cast("string"))
    return rounded(outliers.zscore_detector(events, "cap", cap_method="std"))


@query(Z_SQL + "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CASE WHEN abs(o_totalprice - m) / d <= 1.5 THEN o_totalprice ELSE 0 END AS o_totalprice FROM orders, s")
def zscore_replace(spark, sf):
    orders = read(spark, sf, "orders", "o_orderkey", "o_totalprice").withColumn("o_orderkey", F.col("o_orderkey").cast("string"))
    return outliers.zscore_detector(orders, "replace", threshold=1.5, columns="o_totalprice", replace_value=0.0)


@query("""
SELECT 'row_removed' AS change, CAST(c_custkey AS VARCHAR) AS key, NULL AS "column", NULL AS before, NULL AS after FROM customer WHERE c_acctbal < 0
UNION ALL SELECT 'cell_changed', CAST(c_custkey AS VARCHAR), 'c_mktsegment', c_mktsegment, 'CARS' FROM customer WHERE c_acctbal >= 0 AND c_mktsegment = 'AUTOMOBILE'
UNION ALL SELECT 'column_removed', NULL, 'c_name', NULL, NULL
""")
def clean_report(spark, sf):
    before = read(spark, sf, "customer")
    after = before.filter("c_acctbal >= 0").withColumn("c_mktsegment", F.when(F.col("c_mktsegment") == "AUTOMOBILE", "CARS").otherwise(F.col("c_mktsegment"))).drop("c_name")
    return filters.clean_report(before, after, "c_custkey")


@query("SELECT c_nationkey, count(*) AS n FROM customer WHERE c_acctbal > 0 GROUP BY 1")
def custom_functions(spark, sf):
    df = readers.custom_load(spark, lambda s: s.read.parquet(f"{sf}/customer.parquet"))
    df = readers.custom_clean(df, lambda d: d.filter("c_acctbal > 0"))
    return df.groupBy(F.col("c_nationkey").cast("bigint").alias("c_nationkey")).agg(F.count(F.lit(1)).alias("n"))


# -- targets ----------------------------------------------------------------------------------------

@query(f"SELECT o_orderkey, CAST(o_custkey AS DOUBLE) AS o_custkey, o_orderstatus, o_orderdate, {GAP} AS price FROM orders WHERE {GAP} IS NOT NULL")
def model_table(spark, sf):
    df = gappy_orders(spark, sf).select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "price")
    return target.x_y(df, "price", keep="o_orderkey").df


@query(union_sql("SELECT '{c}' AS y_name, round(count(DISTINCT {c}) / count({c}), 4) AS unique_ratio, CASE WHEN '{c}' IN ('p_brand', 'p_size') THEN 'classification' ELSE 'regression' END AS task FROM part",
                 ["p_brand", "p_size", "p_partkey"])
       + " UNION ALL SELECT 'p_retailprice', round(count(DISTINCT p_retailprice) / count(p_retailprice), 4), 'regression' FROM part"
       + " UNION ALL SELECT 'fifth', round(count(DISTINCT p_partkey // 5) / count(*), 4), 'classification' FROM part"
       + " UNION ALL SELECT 'gaps', round(count(DISTINCT (p_partkey // 5) * 3) / count(*), 4), 'regression' FROM part")
def infer_task(spark, sf):
    part = read(spark, sf, "part").withColumn("fifth", F.floor(F.col("p_partkey") / 5)).withColumn("gaps", F.floor(F.col("p_partkey") / 5) * 3)
    return target.task_evidence(part, ["p_brand", "p_size", "p_partkey", "p_retailprice", "fifth", "gaps"]).select("y_name", "unique_ratio", "task")


@query("SELECT CASE WHEN count(DISTINCT l_linestatus) = 2 THEN 'binary' ELSE 'multiclass' END AS one, CASE WHEN count(DISTINCT l_returnflag) = 2 THEN 'binary' ELSE 'multiclass' END AS two, 'multi-regression' AS three FROM lineitem")
def subtask(spark, sf):
    line = read(spark, sf, "lineitem", "l_linestatus", "l_returnflag", "l_quantity", "l_tax")
    found = (target.subtask(line, "l_linestatus", "classification"), target.subtask(line, "l_returnflag", "classification"), target.subtask(line, ["l_quantity", "l_tax"], "regression"))
    return spark.createDataFrame([found], "one string, two string, three string")


# -- statistics -------------------------------------------------------------------------------------

def profile_lineitem(spark, sf) -> DataFrame:
    return profile(read(spark, sf, "lineitem", "l_orderkey", *LINE_NUMBERS))


@query(union_sql("""SELECT '{c}' AS name, '0 (0.0%)' AS missing, count(DISTINCT {c}) AS nunique, round(count(DISTINCT {c}) / sqrt(count({c})), 4) AS cardinality_ratio,
 count({c}) AS count, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, round(CAST(min({c}) AS DOUBLE), 4) AS min, round(quantile_cont({c}, 0.25), 4) AS q25,
 round(quantile_cont({c}, 0.5), 4) AS q50, round(quantile_cont({c}, 0.75), 4) AS q75, round(CAST(max({c}) AS DOUBLE), 4) AS max, round(skewness({c}), 4) AS skew, round(kurtosis({c}), 4) AS kurt,
 (count(DISTINCT {c}) = count({c}) AND '{c}' = 'l_orderkey') AS is_id, count(DISTINCT {c}) = 1 AS is_constant FROM lineitem""", ["l_orderkey", *LINE_NUMBERS]))
def profile_numeric(spark, sf):
    return profile_lineitem(spark, sf).select("name", "missing", "nunique", "cardinality_ratio", "count", "mean", "std", "min", "q25", "q50", "q75", "max", "skew", "kurt", "is_id", "is_constant")


@query(union_sql("SELECT '{c}' AS name, count(*) - count({c}) AS missing_rows, count(DISTINCT {c}) AS nunique, count({c}) > 0 AND count(DISTINCT {c}) = count({c}) AS is_id, NULL AS first_time, NULL AS last_time FROM customer", ["c_name", "c_mktsegment"])
       + " UNION ALL SELECT 'o_orderdate', count(*) - count(o_orderdate), count(DISTINCT o_orderdate), count(DISTINCT o_orderdate) = count(*), strftime(min(o_orderdate), '%Y-%m-%d'), strftime(max(o_orderdate), '%Y-%m-%d') FROM orders")
def profile_text_and_time(spark, sf):
    text = profile(read(spark, sf, "customer", "c_name", "c_mktsegment"))
    time = profile(read(spark, sf, "orders", "o_orderdate"), "yyyy-MM-dd")
    return text.unionByName(time).select("name", F.split("missing", " ")[0].cast("bigint").alias("missing_rows"), "nunique", "is_id", "first_time", "last_time")


TOP_SQL = """SELECT '{c}' AS name, value, round(n / (SELECT count(*) FROM lineitem), 4) AS share FROM (SELECT CAST({c} AS VARCHAR) AS value, count(*) AS n,
 row_number() OVER (ORDER BY count(*) DESC, CAST({c} AS VARCHAR)) AS k FROM lineitem GROUP BY 1) WHERE k <= 10
 UNION ALL SELECT '{c}', 'others', round(sum(n) / (SELECT count(*) FROM lineitem), 4) FROM (SELECT count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, CAST({c} AS VARCHAR)) AS k
 FROM lineitem GROUP BY CAST({c} AS VARCHAR)) WHERE k > 10 HAVING count(*) > 0"""


@query(union_sql(TOP_SQL, ["l_quantity", "l_tax", "l_returnflag", "l_partkey"]))
def profile_top_values(spark, sf):
    return top_shares(read(spark, sf, "lineitem"), ["l_quantity", "l_tax", "l_returnflag", "l_partkey"])


EFFECT_SQL = """
SELECT '{t}' AS target, '{c}' AS categorical_col, category, count, round(mean, 4) AS mean, round(std, 4) AS std, round(q25, 4) AS q25, round(q50, 4) AS q50, round(q75, 4) AS q75,
  round((ssb / (k - 1)) / (ssw / (nn - k)), 4) AS F, round(ssb / (ssb + ssw), 4) AS eta_sq,
  CASE WHEN k = 2 THEN round(gap / sqrt(ssw / (nn - 2)), 4) END AS cohens_d,
  CASE WHEN k = 3 THEN round(power(1 + 2 * ((ssb / 2) / (ssw / (nn - 3))) / (nn - 3), -(nn - 3) / 2.0), 6) END AS p_three
FROM (SELECT *, sum(count) OVER () AS nn, count(*) OVER () AS k, sum(count * power(mean - grand, 2)) OVER () AS ssb, sum((count - 1) * v) OVER () AS ssw,
  first_value(mean) OVER (ORDER BY category ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) - last_value(mean) OVER (ORDER BY category ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS gap
  FROM (SELECT {c} AS category, count({t}) AS count, avg({t}) AS mean, stddev_samp({t}) AS std, var_samp({t}) AS v, quantile_cont({t}, 0.25) AS q25, quantile_cont({t}, 0.5) AS q50,
    quantile_cont({t}, 0.75) AS q75, (SELECT avg({t}) FROM lineitem) AS grand FROM lineitem GROUP BY 1))"""


@query(" UNION ALL ".join(EFFECT_SQL.replace("{t}", t).replace("{c}", c) for t in ("l_quantity", "l_tax") for c in ("l_returnflag", "l_linestatus")))
def effect_size_numeric(spark, sf):
    out = effects.effect_size(read(spark, sf, "lineitem", "l_quantity", "l_tax", "l_returnflag", "l_linestatus"), ["l_quantity", "l_tax"], ["l_returnflag", "l_linestatus"])
    p_three = F.when(F.col("categorical_col") == "l_returnflag", F.col("p_value")).alias("p_three")
    return rounded(out.select("target", "categorical_col", "category", "count", "mean", "std", "q25", "q50", "q75", "F", "eta_sq", "cohens_d", p_three), p_three=6)


CHI_SQL = """
WITH o AS (SELECT {c} AS category, {t} AS value, count(*) AS o FROM {from} GROUP BY 1, 2),
r AS (SELECT category, sum(o) AS r FROM o GROUP BY 1), k AS (SELECT value, sum(o) AS k FROM o GROUP BY 1), n AS (SELECT sum(o) AS n FROM o),
e AS (SELECT r.category, k.value, coalesce(o.o, 0) AS o, r.r * k.k / n.n AS e FROM r CROSS JOIN k CROSS JOIN n LEFT JOIN o ON o.category = r.category AND o.value = k.value),
x AS (SELECT sum(power({shift}, 2) / e) AS chi2 FROM e),
g AS (SELECT category, sum(o) AS count, count(*) AS "unique", max(o) AS freq, arg_min(value, (-o, value)) AS top FROM o GROUP BY 1)
SELECT '{t}' AS target, '{c}' AS categorical_col, category, CAST(count AS BIGINT) AS count, "unique", top, freq, round(chi2, 4) AS chi2,
  round(sqrt(chi2 / ((SELECT n FROM n) * (least((SELECT count(*) FROM r), (SELECT count(*) FROM k)) - 1))), 4) AS cramers_v{p} FROM g, x"""


@query(CHI_SQL.format(c="l_returnflag", t="l_linestatus", shift="o - e", p=", round(exp(-chi2 / 2), 6) AS p_value", **{"from": "lineitem"}))
def effect_size_text(spark, sf):
    out = effects.effect_size(read(spark, sf, "lineitem", "l_returnflag", "l_linestatus"), "l_linestatus", "l_returnflag")
    return out.select("target", "categorical_col", "category", "count", "unique", "top", "freq", "chi2", "cramers_v", "p_value")


@query(CHI_SQL.format(c="big", t="l_linestatus", shift="greatest(abs(o - e) - 0.5, 0)", p="", **{"from": "(SELECT l_linestatus, CASE WHEN l_quantity > 25 THEN 'big' ELSE 'small' END AS big FROM lineitem)"}))
def effect_size_two_by_two(spark, sf):
    line = read(spark, sf, "lineitem").select("l_linestatus", F.when(F.col("l_quantity") > 25, "big").otherwise("small").alias("big"))
    return effects.effect_size(line, "l_linestatus", "big").select("target", "categorical_col", "category", "count", "unique", "top", "freq", "chi2", "cramers_v")


TOP_EFFECT_SQL = """SELECT '{t}' AS target, 'l_returnflag' AS categorical_col, power(1 + 2 * ((ssb / 2) / (ssw / (nn - 3))) / (nn - 3), -(nn - 3) / 2.0) AS p FROM (
 SELECT sum(n) AS nn, sum(n * power(m - (SELECT avg({t}) FROM lineitem), 2)) AS ssb, sum((n - 1) * v) AS ssw FROM (SELECT count(*) AS n, avg({t}) AS m, var_samp({t}) AS v FROM lineitem GROUP BY l_returnflag))"""


@query("SELECT target, categorical_col, round(p, 6) AS p_value FROM (" + " UNION ALL ".join(TOP_EFFECT_SQL.replace("{t}", t) for t in LINE_NUMBERS) + ") ORDER BY p LIMIT 3")
def top_effects(spark, sf):
    out = effects.effect_size(read(spark, sf, "lineitem", "l_returnflag", *LINE_NUMBERS), LINE_NUMBERS, "l_returnflag")
    return effects.top_effects(out, 3)


@query("""SELECT l_linenumber, round(exp(-l_linenumber / 2.0), 8) AS chi2_p, round(power(1 + 2 * l_linenumber / 40.0, -20), 8) AS f_p FROM (SELECT DISTINCT CAST(l_linenumber AS BIGINT) AS l_linenumber FROM lineitem)""")
def tail_probabilities(spark, sf):
    """Both tails have closed forms for two degrees of freedom."""
    x = read(spark, sf, "lineitem", "l_linenumber").select(F.col("l_linenumber").cast("bigint").alias("l_linenumber")).distinct()
    v, two = F.col("l_linenumber").cast("double"), F.lit(2.0)
    return rounded(x.select("l_linenumber", chi2_tail(v, two).alias("chi2_p"), f_tail(v, two, F.lit(40.0)).alias("f_p")), 8)


def pairs_sql(names: list[str], one: str) -> str:
    return " UNION ALL ".join(one.replace("{a}", a).replace("{b}", b) for i, a in enumerate(names) for b in names[i + 1:])


@query(pairs_sql(LINE_NUMBERS, "SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr({a}, {b}), 6) AS r, count(*) AS n FROM lineitem"))
def correlation_pearson(spark, sf):
    return rounded(correlation.correlation_long(read(spark, sf, "lineitem", *LINE_NUMBERS), method="pearson").select("col_a", "col_b", "r", "n"), 6)


RANK_SQL = "WITH r AS (SELECT " + ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in LINE_NUMBERS) + " FROM lineitem) "


@query(RANK_SQL + pairs_sql(LINE_NUMBERS, "SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr({a}, {b}), 6) AS r, count(*) AS n FROM r"))
def correlation_spearman(spark, sf):
    return rounded(correlation.correlation_long(read(spark, sf, "lineitem", *LINE_NUMBERS), method="spearman").select("col_a", "col_b", "r", "n"), 6)


GAP_RANK = """SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr(ra, rb), 6) AS r, count(*) AS n FROM (SELECT rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2.0 AS ra,
 rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2.0 AS rb FROM g WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"""


@query(f"WITH g AS (SELECT o_orderkey, o_custkey, {GAP} AS price FROM orders) " + pairs_sql(["o_orderkey", "o_custkey", "price"], GAP_RANK))
def correlation_spearman_gaps(spark, sf):
    df = gappy_orders(spark, sf).select("o_orderkey", "o_custkey", "price")
    return rounded(correlation.correlation_long(df, method="spearman").select("col_a", "col_b", "r", "n"), 6)


TAU_SQL = """SELECT '{a}' AS col_a, '{b}' AS col_b, round(sum(sign(x.{a} - y.{a}) * sign(x.{b} - y.{b})) / sqrt(CAST(sum(abs(sign(x.{a} - y.{a}))) AS DOUBLE) * sum(abs(sign(x.{b} - y.{b})))), 6) AS r
 FROM customer x, customer y"""


@query(pairs_sql(["c_custkey", "c_nationkey", "c_acctbal"], TAU_SQL))
def correlation_kendall(spark, sf):
    return rounded(correlation.correlation_long(read(spark, sf, "customer"), method="kendall").select("col_a", "col_b", "r"), 6)


@query("SELECT 'l_extendedprice' AS col_a, 'near_copy' AS col_b, round(corr(l_extendedprice, l_extendedprice * 1.01 + l_tax), 4) AS r FROM lineitem")
def high_correlation_pairs(spark, sf):
    line = read(spark, sf, "lineitem", *LINE_NUMBERS).withColumn("near_copy", F.col("l_extendedprice") * 1.01 + F.col("l_tax"))
    return correlation.high_correlation_pairs(line, method="pearson", threshold=0.95)


# -- chart tables -----------------------------------------------------------------------------------

@query(" UNION ALL ".join(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, round({'1.0' if a == b else f'corr({a}, {b})'}, 6) AS r, {['l_quantity', 'l_tax', 'l_extendedprice'].index(a)} AS at_a, {['l_quantity', 'l_tax', 'l_extendedprice'].index(b)} AS at_b FROM lineitem GROUP BY ()"
                          for a in ("l_quantity", "l_tax", "l_extendedprice") for b in ("l_quantity", "l_tax", "l_extendedprice")))
def correlation_heatmap(spark, sf):
    line = read(spark, sf, "lineitem", "l_quantity", "l_extendedprice", "l_tax").withColumn("constant", F.lit(1.0))
    return rounded(charts.correlation_heatmap(line, "l_extendedprice", "pearson").select("feature_a", "feature_b", "r", "at_a", "at_b"), 6)


HIST_SQL = """SELECT '{c}' AS name, bin, round(lo + bin * w, 6) AS left, round(lo + (bin + 1) * w, 6) AS right, count(*) AS n, round(count(*) / any_value(total) / any_value(w), 6) AS density
 FROM (SELECT *, (hi - lo) / 20 AS w, CAST(least(floor(({c} - lo) / ((hi - lo) / 20)), 19) AS BIGINT) AS bin FROM lineitem, (SELECT min({c}) AS lo, max({c}) AS hi, count(*) AS total FROM lineitem)) GROUP BY bin, lo, w"""


@query(union_sql(HIST_SQL, ["l_quantity", "l_extendedprice"]))
def numeric_histogram(spark, sf):
    return rounded(density.histogram(read(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice"], bins=20), 6)


KDE_SQL = """SELECT {keys}, point, round(x, 4) AS x, round(sum(w * exp(-0.5 * power((x - mid) / h, 2))) / (any_value(n) * any_value(h) * sqrt(2 * pi())), {digits}) AS density FROM (
 SELECT {keys}, p AS point, lo - {cut} * h + p * (hi - lo + 2 * {cut} * h) / 199 AS x, w, mid, n, h FROM (
  SELECT {keys}, bin, lo, hi, h, n, count(*) AS w, avg(value) AS mid FROM (SELECT c.*, lo, hi, h, n, floor((value - lo) / (h / 8)) AS bin FROM cells c JOIN (
    SELECT {keys}, count(*) AS n, min(value) AS lo, max(value) AS hi, stddev_samp(value) * power(count(*), -0.2) AS h FROM cells GROUP BY {keys} HAVING count(*) > 1) s USING ({keys})) GROUP BY {keys}, bin, lo, hi, h, n)
 , (SELECT unnest(range(200)) AS p)) GROUP BY {keys}, point, x"""


@query("WITH cells AS (SELECT 'l_quantity' AS name, l_quantity AS value FROM lineitem UNION ALL SELECT 'l_discount', l_discount FROM lineitem) " + KDE_SQL.format(keys="name", cut=0, digits=5))
def numeric_density(spark, sf):
    return rounded(charts.numeric_kde(read(spark, sf, "lineitem"), ["l_quantity", "l_discount"]), 5, x=4)


@query(union_sql("SELECT '{c}' AS name, round(quantile_cont({c}, 0.25), 4) AS q1, round(quantile_cont({c}, 0.5), 4) AS q2, round(quantile_cont({c}, 0.75), 4) AS q3 FROM lineitem", LINE_NUMBERS))
def numeric_quartiles(spark, sf):
    return rounded(charts.quartile_table(read(spark, sf, "lineitem", *LINE_NUMBERS)))


BOX = """WITH f AS (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {t}) """


@query(union_sql("""SELECT '{c}' AS name, round(min({c}), 4) AS min, round(any_value(q1), 4) AS q1, round(quantile_cont({c}, 0.5), 4) AS median, round(any_value(q3), 4) AS q3, round(max({c}), 4) AS max, round(avg({c}), 4) AS mean,
 round(any_value(q1 - 1.5 * (q3 - q1)), 4) AS whisker_low, round(any_value(q3 + 1.5 * (q3 - q1)), 4) AS whisker_high, count(*) FILTER ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS outlier_count
 FROM lineitem, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM lineitem)""", LINE_NUMBERS))
def box_stats(spark, sf):
    return rounded(charts.box_stats(read(spark, sf, "lineitem", *LINE_NUMBERS)))


@query("""SELECT 'value' AS name, value FROM events, (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events) WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)""")
def box_outliers(spark, sf):
    return charts.box_outliers(read(spark, sf, "events", "value"))


@query("""SELECT 'l_extendedprice' AS target, f AS feature, count(*) AS n, round(avg(x), 4) AS mean_x, round(avg(y), 2) AS mean_y, round(corr(x, y), 6) AS r FROM (
 SELECT 'l_quantity' AS f, l_quantity AS x, l_extendedprice AS y FROM lineitem UNION ALL SELECT 'l_tax', l_tax, l_extendedprice FROM lineitem) GROUP BY 1, 2""")
def target_trend(spark, sf):
    out = charts.target_trend(read(spark, sf, "lineitem", "l_quantity", "l_extendedprice", "l_tax"), "l_extendedprice", method="pearson")
    return rounded(out.groupBy("target", "feature").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean_x"), F.avg("y").alias("mean_y"), F.max("r").alias("r")), r=6, mean_y=2)


@query("SELECT feature FROM (SELECT 'l_quantity' AS feature, abs(corr(l_quantity, l_extendedprice)) AS r FROM lineitem UNION ALL SELECT 'l_tax', abs(corr(l_tax, l_extendedprice)) FROM lineitem UNION ALL SELECT 'l_discount', abs(corr(l_discount, l_extendedprice)) FROM lineitem) ORDER BY r DESC LIMIT 1")
def target_trend_strongest(spark, sf):
    return charts.trend_correlations(read(spark, sf, "lineitem", *LINE_NUMBERS), "l_extendedprice", top_k=1, method="pearson").select("feature")


@query()
def target_trend_lines(spark, sf):
    line = read(spark, sf, "lineitem", "l_quantity", "l_extendedprice", "l_tax")
    return charts.trend_lines(charts.target_trend(line, "l_extendedprice", method="pearson"))


@query("WITH cells AS (SELECT 'l_linestatus' AS target, 'l_quantity' AS feature, l_linestatus AS class, l_quantity AS value FROM lineitem) " + KDE_SQL.format(keys="target, feature, class", cut=3, digits=6))
def target_separation(spark, sf):
    return rounded(charts.target_separation(read(spark, sf, "lineitem", "l_linestatus", "l_quantity"), "l_linestatus"), 6, x=4)


@query("WITH cells AS (SELECT 'value' AS target, 'event_type' AS categorical_col, event_type AS category, value FROM events) " + KDE_SQL.format(keys="target, categorical_col, category", cut=3, digits=6))
def target_effect(spark, sf):
    return rounded(charts.target_effect(read(spark, sf, "events", "event_type", "value"), "value"), 6, x=4)


@query(f"""SELECT 'o_orderstatus' AS target, 'priority' AS categorical_col, p AS category, o_orderstatus AS value, count(*) AS n, round(count(*) / any_value(t), 4) AS share
 FROM (SELECT {GAP_TEXT} AS p, o_orderstatus, count(*) OVER (PARTITION BY {GAP_TEXT}) AS t FROM orders) GROUP BY p, o_orderstatus""")
def target_association(spark, sf):
    return charts.target_association(gappy_orders(spark, sf).select("o_orderstatus", "priority"), "o_orderstatus", "priority")
