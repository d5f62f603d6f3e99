"""Checked queries: folds, feature transforms, models, metrics, diagnosis, contributions, search and jobs.

Where a result depends on a hash or a random forest, the SQL twin checks what must hold whatever the
draw: sizes, coverage, groups kept together, contributions that add up to the prediction.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabspark.operators import boosting, density, diagnose, folds, metrics, models, search, shap, training
from tabspark.operators import transforms as tr
from tabspark.operators.target import CLASSIFICATION, REGRESSION, x_y
from tabspark.plans import jobs
from tabspark.plans.catalog_tables import GAP, LINE_NUMBERS, QUERIES, SQL, gappy_orders, query, read, rounded, union_sql
from tabspark.session import materialize, shared_scratch
from tabspark.sources import runlog
from tabspark.streaming import apply as streams

__all__ = ["QUERIES", "SQL"]

# -- folds ------------------------------------------------------------------------------------------


def orders_key(spark, sf) -> DataFrame:
    return read(spark, sf, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")


@query("""WITH n AS (SELECT count(*) AS n FROM orders), c AS (SELECT n, CAST(ceil((1::DOUBLE - 0.7::DOUBLE - 0.2::DOUBLE) * n) AS BIGINT) AS test FROM n),
v AS (SELECT *, CAST(ceil(0.2::DOUBLE / (0.7::DOUBLE + 0.2::DOUBLE) * (n - test)) AS BIGINT) AS val FROM c) SELECT 0 AS fold, n - test - val AS train, val, test FROM v""")
def simple_cv(spark, sf):
    return folds.simple_cv(orders_key(spark, sf), "o_orderkey", 0.7, 0.2).summary()


@query("SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY o_orderkey) <= floor(0.8 * (SELECT count(*) FROM orders)) THEN 'train' ELSE 'test' END AS split FROM orders")
def simple_cv_ordered(spark, sf):
    return folds.simple_cv(orders_key(spark, sf), "o_orderkey", shuffle=False).table.select("o_orderkey", "split")


K_FOLD_SQL = """SELECT o_orderkey, CASE WHEN r < x * (s + 1) THEN r // (s + 1) ELSE (r - x * (s + 1)) // s + x END AS fold
 FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS r, count(*) OVER () // 7 AS s, count(*) OVER () % 7 AS x FROM orders)"""


@query(K_FOLD_SQL)
def k_fold_ordered(spark, sf):
    return folds.k_fold(orders_key(spark, sf), "o_orderkey", 7, shuffle=False).table.select("o_orderkey", "fold")


FOLD_SIZES = "SELECT i AS fold, n - t AS train, 0 AS val, t AS test FROM (SELECT i, n, n // 7 + CAST(i % 7 < n % 7 AS INTEGER) AS t FROM (SELECT count(*) AS n FROM orders), (SELECT unnest(range({folds})) AS i))"


@query(FOLD_SIZES.format(folds=7))
def k_fold_summary(spark, sf):
    return folds.k_fold(orders_key(spark, sf), "o_orderkey", 7).summary()


@query(FOLD_SIZES.format(folds=21))
def repeated_k_fold(spark, sf):
    return folds.repeated_k_fold(orders_key(spark, sf), "o_orderkey", 7, 3).summary()


@query("""SELECT o_orderkey, (r + start) % 5 AS fold FROM (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1 AS r FROM orders)
 JOIN (SELECT o_orderstatus, CAST(sum(n) OVER (ORDER BY o_orderstatus) - n AS BIGINT) AS start FROM (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1)) USING (o_orderstatus)""")
def stratified_k_fold_ordered(spark, sf):
    return folds.stratified_k_fold(orders_key(spark, sf), "o_orderkey", "o_orderstatus", 5, shuffle=False).table.select("o_orderkey", "fold")


@query("""SELECT label, r AS place, t // 5 + CAST(r < t % 5 AS INTEGER) AS rows_of_label FROM
 (SELECT 'quality' AS label, CAST(sum(quality) AS BIGINT) AS t FROM labels UNION ALL SELECT 'toxic', CAST(sum(toxic) AS BIGINT) FROM labels UNION ALL SELECT 'rows', count(*) FROM labels), (SELECT unnest(range(5)) AS r)""")
def stratified_multilabel(spark, sf):
    """Rows and every label are spread over the folds as evenly as whole rows allow: counts per fold, largest first."""
    f = folds.stratified_k_fold(read(spark, sf, "labels"), "doc_id", ["quality", "toxic"], 5).table
    per_fold = f.groupBy("fold").agg(F.count(F.lit(1)).alias("rows"), F.sum("quality").alias("quality"), F.sum("toxic").alias("toxic"))
    every = F.array_sort(F.collect_list("n"))
    long = per_fold.select(F.inline(F.array(*[F.struct(F.lit(c).alias("label"), F.col(c).alias("n")) for c in ("rows", "quality", "toxic")])))
    return long.groupBy("label").agg(F.reverse(every).alias("all")).select("label", F.posexplode("all").alias("place", "rows_of_label")).withColumn("place", F.col("place").cast("bigint"))


@query("SELECT 3 * count(*) AS n, 15 AS folds, true AS balanced FROM orders")
def repeated_stratified_k_fold(spark, sf):
    orders = orders_key(spark, sf)
    f = folds.repeated_stratified_k_fold(orders, "o_orderkey", "o_orderstatus", 5, 3).table.join(orders, "o_orderkey")
    sizes = f.groupBy("repeat", "fold", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    per_class = sizes.groupBy("repeat", "o_orderstatus").agg(F.sum("n").alias("n"), (F.max("n") - F.min("n") <= 1).alias("even"))
    return per_class.agg(F.sum("n").alias("n")).select("n", F.lit(15).cast("bigint").alias("folds")).join(per_class.agg(F.bool_and("even").alias("balanced")))


GROUP_CHECK = "SELECT count(*) AS n, count(DISTINCT o_custkey) AS groups, 0 AS straddling, 5 AS folds, true AS balanced FROM orders"


def _group_facts(table: DataFrame, group: str, slack: float) -> DataFrame:
    by_group = table.groupBy(group).agg(F.count_distinct("fold").alias("k"), F.count(F.lit(1)).alias("rows"))
    groups = by_group.agg(F.sum("rows").alias("n"), F.count(F.lit(1)).alias("groups"), F.count(F.when(F.col("k") > 1, 1)).alias("straddling"))
    sizes = table.groupBy("fold").agg(F.count(F.lit(1)).alias("rows")).agg(
        F.count(F.lit(1)).alias("folds"), (F.max("rows") - F.min("rows") <= slack * F.avg("rows")).alias("balanced"))
    return groups.join(F.broadcast(sizes))  # one row each


@query(GROUP_CHECK)
def group_k_fold(spark, sf):
    return _group_facts(folds.group_k_fold(orders_key(spark, sf), "o_orderkey", "o_custkey", 5).table, "o_custkey", 0.02)


@query(GROUP_CHECK)
def stratified_group_k_fold(spark, sf):
    return _group_facts(folds.stratified_group_k_fold(orders_key(spark, sf), "o_orderkey", "o_orderstatus", "o_custkey", 5).table, "o_custkey", 0.1)


@query("SELECT c_custkey, dense_rank() OVER (ORDER BY c_nationkey) - 1 AS fold FROM customer")
def leave_one_group_out(spark, sf):
    return folds.leave_one_group_out(read(spark, sf, "customer"), "c_custkey", "c_nationkey").table.select("c_custkey", F.col("fold").cast("bigint").alias("fold"))


@query("SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS fold FROM supplier")
def leave_one_out(spark, sf):
    return folds.leave_one_out(read(spark, sf, "supplier"), "s_suppkey").table.select("s_suppkey", "fold")


# -- feature transforms -----------------------------------------------------------------------------


@query("SELECT o_orderkey, round((o_totalprice - (SELECT avg(o_totalprice) FROM orders)) / (SELECT stddev_pop(o_totalprice) FROM orders), 6) + 0.0 AS o_totalprice FROM orders")
def standard_scaler(spark, sf):
    df = read(spark, sf, "orders", "o_orderkey", "o_totalprice")
    return rounded(tr.standard_scaler(df, "o_totalprice").apply(df), 6)


@query("SELECT o_orderkey, round((o_totalprice - (SELECT min(o_totalprice) FROM orders)) / (SELECT max(o_totalprice) - min(o_totalprice) FROM orders) * 2 - 1, 6) + 0.0 AS o_totalprice FROM orders")
def minmax_scaler(spark, sf):
    df = read(spark, sf, "orders", "o_orderkey", "o_totalprice")
    return rounded(tr.minmax_scaler(df, "o_totalprice", (-1, 1), clip=True).apply(df), 6)


@query("SELECT o_orderkey, round((o_totalprice - (SELECT quantile_cont(o_totalprice, 0.5) FROM orders)) / (SELECT quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25) FROM orders), 6) + 0.0 AS o_totalprice FROM orders")
def robust_scaler(spark, sf):
    df = read(spark, sf, "orders", "o_orderkey", "o_totalprice")
    return rounded(tr.robust_scaler(df, "o_totalprice").apply(df), 6)


@query("SELECT c_custkey, round(ln(c_acctbal + (SELECT abs(min(c_acctbal)) + 1 FROM customer)), 6) + 0.0 AS c_acctbal FROM customer")
def log_transformer(spark, sf):
    df = read(spark, sf, "customer", "c_custkey", "c_acctbal")
    return rounded(tr.log_transformer(df, "c_acctbal", handle_negative="shift").apply(df), 6)


@query("SELECT count(*) AS n, 0.0::DOUBLE AS mean_gap, 1.0::DOUBLE AS std, 0.0::DOUBLE AS slope FROM orders")
def power_transformer(spark, sf):
    """Standardised output, and an exponent at which the likelihood is flat."""
    df = read(spark, sf, "orders", "o_orderkey", "o_totalprice")
    fitted = tr.power_transformer(df, "o_totalprice")
    lam, x = fitted.params["lambda"]["o_totalprice"], F.col("o_totalprice")
    def llf(v):
        t = tr._power(x, v, "yeo-johnson")
        return -F.count(x) / 2 * F.ln(F.var_pop(t)) + (v - 1) * F.sum(F.signum(x) * F.ln(F.abs(x) + 1))
    slope = (llf(lam + 1e-3) - llf(lam - 1e-3)) / (2e-3 * F.count(x))
    out = fitted.apply(df).agg(F.count(F.lit(1)).alias("n"), F.abs(F.avg("o_totalprice")).alias("mean_gap"), F.stddev_pop("o_totalprice").alias("std"))
    return rounded(out.join(df.agg(F.abs(slope).alias("slope"))), 3)  # one row each


@query("SELECT o_orderkey, CAST(o_totalprice > q1 AS BIGINT) + CAST(o_totalprice > q2 AS BIGINT) + CAST(o_totalprice > q3 AS BIGINT) AS o_totalprice FROM orders, (SELECT quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.5) AS q2, quantile_cont(o_totalprice, 0.75) AS q3 FROM orders)")
def numerical_binner(spark, sf):
    df = read(spark, sf, "orders", "o_orderkey", "o_totalprice")
    return rounded(tr.numerical_binner(df, "o_totalprice", "4class").apply(df))


@query("""WITH s AS (SELECT avg(p_size) AS ma, avg(p_retailprice) AS mb, var_samp(p_size) AS a, var_samp(p_retailprice) AS c, covar_samp(p_size, p_retailprice) AS b FROM part),
e AS (SELECT *, (a + c + sqrt(power(a - c, 2) + 4 * b * b)) / 2 AS l1 FROM s),
v AS (SELECT *, b / sqrt(b * b + power(l1 - a, 2)) AS u1, (l1 - a) / sqrt(b * b + power(l1 - a, 2)) AS u2 FROM e),
w AS (SELECT *, CASE WHEN abs(u1) > abs(u2) THEN sign(u1) ELSE sign(u2) END AS s1, CASE WHEN abs(u2) > abs(u1) THEN sign(u2) ELSE sign(-u1) END AS s2 FROM v)
SELECT p_partkey, round(s1 * (u1 * (p_size - ma) + u2 * (p_retailprice - mb)), 5) + 0.0 AS pca0, round(s2 * (u2 * (p_size - ma) - u1 * (p_retailprice - mb)), 5) + 0.0 AS pca1 FROM part, w""")
def pca_reducer(spark, sf):
    df = read(spark, sf, "part", "p_partkey", "p_size", "p_retailprice")
    return rounded(tr.pca_reducer(df, ["p_size", "p_retailprice"], n_components=2).apply(df), 5)


@query("SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax, round(CASE WHEN l_tax = 0 THEN CASE WHEN l_discount > 0 THEN 1e300 END ELSE l_discount / l_tax END, 6) AS ratio, round(l_quantity * l_tax, 6) AS l_quantity_x_l_tax FROM lineitem")
def interaction_creator(spark, sf):
    df = read(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax")
    out = tr.interaction_creator(df, [["l_discount", "l_tax"]], "divide", template="ratio").apply(df)
    out = tr.interaction_creator(out, [["l_quantity", "l_tax"]]).apply(out)
    return rounded(out.withColumn("ratio", F.when(F.col("ratio") == float("inf"), 1e300).otherwise(F.col("ratio"))), 6)


@query("SELECT o_orderkey, " + ", ".join(f"CAST(o_orderpriority = '{p}' AS BIGINT) AS \"o_orderpriority_{p}\"" for p in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")) + " FROM orders")
def onehot_encoder(spark, sf):
    df = read(spark, sf, "orders", "o_orderkey", "o_orderpriority")
    return rounded(tr.onehot_encoder(df, "o_orderpriority").apply(df))


ORDINAL_SQL = "SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN -1 ELSE dense_rank() OVER (ORDER BY p_brand) - 1 END AS p_brand FROM part"


def gappy_brands(spark, sf) -> tuple[DataFrame, DataFrame]:
    part = read(spark, sf, "part", "p_partkey", "p_brand")
    return part, part.withColumn("p_brand", F.when(F.col("p_partkey") % 9 != 0, F.col("p_brand")))


@query(ORDINAL_SQL)
def ordinal_encoder(spark, sf):
    part, gappy = gappy_brands(spark, sf)
    return tr.ordinal_encoder(part, "p_brand").apply(gappy)


@query(ORDINAL_SQL)
def label_encoder(spark, sf):
    part, gappy = gappy_brands(spark, sf)
    return tr.label_encoder(part, "p_brand").apply(gappy)


@query("""WITH g AS (SELECT avg(o_totalprice) AS m, var_pop(o_totalprice) AS v FROM orders), c AS (SELECT o_orderpriority, count(*) AS n, avg(o_totalprice) AS mi, var_pop(o_totalprice) AS vi FROM orders GROUP BY 1)
SELECT o_orderkey, round(v * n / (v * n + vi) * mi + (1 - v * n / (v * n + vi)) * m, 3) AS o_orderpriority FROM orders JOIN c USING (o_orderpriority), g""")
def target_encoder(spark, sf):
    df = read(spark, sf, "orders", "o_orderkey", "o_orderpriority", "o_totalprice")
    return rounded(tr.target_encoder(df, "o_totalprice", "o_orderkey", "o_orderpriority").apply(df).select("o_orderkey", "o_orderpriority"), 3)


@query("SELECT o_orderpriority AS category, count(*) AS n, 5 AS encodings FROM orders GROUP BY 1")
def target_encoder_cross_fitted(spark, sf):
    """Training rows of a category get one value per inner fold."""
    df = read(spark, sf, "orders", "o_orderkey", "o_orderpriority", "o_totalprice").withColumn("category", F.col("o_orderpriority"))
    out = tr.target_encoder(df, "o_totalprice", "o_orderkey", "o_orderpriority").fit_apply(df)
    return out.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_orderpriority").alias("encodings"))


@query("SELECT count(*) AS n, 2 * count(*) AS ones, true AS stable FROM orders")
def hash_encoder(spark, sf):
    df = read(spark, sf, "orders", "o_orderkey", "o_orderpriority", "o_orderstatus").withColumn("level", F.concat("o_orderpriority", F.lit("|"), "o_orderstatus"))
    kept = df.select("o_orderkey", F.struct("level").alias("kept"), "o_orderpriority", "o_orderstatus")
    out = tr.hash_encoder(kept, ["o_orderpriority", "o_orderstatus"], 8).apply(kept)
    code = F.concat_ws(",", *[f"hash{i}" for i in range(8)])
    per_level = out.groupBy("kept").agg(F.count(F.lit(1)).alias("n"), F.sum(sum(F.col(f"hash{i}") for i in range(8))).alias("ones"), F.count_distinct(code).alias("codes"))
    return per_level.agg(F.sum("n").alias("n"), F.sum("ones").alias("ones"), (F.max("codes") == 1).alias("stable"))


@query("SELECT event_id, round((value - (SELECT avg(value) FROM events)) / (SELECT stddev_pop(value) FROM events), 6) + 0.0 AS value FROM events")
def stream_transforms(spark, sf):
    """A scaler fitted on the table and applied to the same rows as a stream."""
    events = read(spark, sf, "events", "event_id", "value")
    base = shared_scratch(spark)
    path = runlog.write_table(events, base, "events")
    stream = streams.transform_stream(spark.readStream.schema(events.schema).parquet(path), [tr.standard_scaler(events, "value")])
    streams.write_stream(stream, f"{base}/out", f"{base}/checkpoint", available_now=True).awaitTermination()
    return rounded(spark.read.parquet(f"{base}/out"), 6)


# -- metrics and diagnosis over predictions that are expressions of the data ------------------------

PRED_SQL = """WITH p AS (SELECT model, CAST(l_linenumber AS BIGINT) AS fold, 'test' AS type, 'price' AS y_name, l_extendedprice AS y,
 CASE WHEN model = 'A' THEN l_extendedprice * 1.02 - 10 * l_quantity ELSE l_extendedprice * 0.97 + 3000 * l_tax END AS y_pred FROM lineitem, (SELECT unnest(['A', 'B']) AS model)) """


def price_predictions(spark, sf) -> DataFrame:
    line = read(spark, sf, "lineitem", "l_linenumber", "l_extendedprice", "l_quantity", "l_tax")
    price = F.col("l_extendedprice")
    guess = F.when(F.col("model") == "A", price * 1.02 - 10 * F.col("l_quantity")).otherwise(price * 0.97 + 3000 * F.col("l_tax"))
    return line.withColumn("model", F.explode(F.array(F.lit("A"), F.lit("B")))).select(
        "model", F.col("l_linenumber").cast("bigint").alias("fold"), F.lit("test").alias("type"), F.lit("price").alias("y_name"), price.alias("y"), guess.alias("y_pred"))


REG_SQL = """SELECT {k}, round(avg(abs(y_pred - y)), 4) AS mae, round(sqrt(avg(power(y_pred - y, 2))), 4) AS rmse, round(1 - sum(power(y_pred - y, 2)) / (count(*) * var_pop(y)), 6) AS r2,
 round(avg(abs(y_pred - y) / greatest(abs(y), 2.220446049250313e-16)), 6) AS mape FROM p GROUP BY {k}"""


@query(PRED_SQL + REG_SQL.format(k="model, fold, type, y_name"))
def regression_metrics(spark, sf):
    return rounded(metrics.regression_metrics(price_predictions(spark, sf)), r2=6, mape=6)


@query(PRED_SQL + "SELECT model, 'mae' AS metric, round(avg(v), 4) AS value FROM (SELECT model, fold, avg(abs(y_pred - y)) AS v FROM p GROUP BY 1, 2) GROUP BY 1")
def overall_metric(spark, sf):
    return rounded(metrics.overall_metric(metrics.metrics_long(metrics.regression_metrics(price_predictions(spark, sf)))))


CLASS_SQL = """WITH p AS (SELECT 'M' AS model, CAST(l_linenumber AS BIGINT) AS fold, 'test' AS type, 'flag' AS y_name, l_returnflag AS y, CASE WHEN l_quantity > 40 THEN 'A' WHEN l_tax > 0.04 THEN 'N' ELSE l_returnflag END AS y_pred FROM lineitem) """


def flag_predictions(spark, sf) -> DataFrame:
    line = read(spark, sf, "lineitem", "l_linenumber", "l_returnflag", "l_quantity", "l_tax", "l_discount")
    guess = F.when(F.col("l_quantity") > 40, "A").when(F.col("l_tax") > 0.04, "N").otherwise(F.col("l_returnflag"))
    score = F.round(0.2 + 0.5 * F.col("l_discount") + F.when(F.col("l_returnflag") == "R", 0.1).otherwise(0.0), 4)
    return line.select(F.lit("M").alias("model"), F.col("l_linenumber").cast("bigint").alias("fold"), F.lit("test").alias("type"), F.lit("flag").alias("y_name"),
                       F.col("l_returnflag").alias("y"), guess.alias("y_pred"), score.alias("score"))


@query(CLASS_SQL + """, s AS (SELECT fold, y AS label, count(*) AS s, count(*) FILTER (y = y_pred) AS tp FROM p GROUP BY 1, 2), d AS (SELECT fold, y_pred AS label, count(*) AS d FROM p GROUP BY 1, 2),
j AS (SELECT fold, label, coalesce(s, 0) AS s, coalesce(tp, 0) AS tp, coalesce(d, 0) AS d FROM s FULL JOIN d USING (fold, label))
SELECT 'M' AS model, fold, 'test' AS type, 'flag' AS y_name, round(sum(tp) / sum(s), 6) AS accuracy, round(sum(CASE WHEN d > 0 THEN s * tp / d ELSE 0 END) / sum(s), 6) AS precision,
 round(sum(CASE WHEN s > 0 THEN tp ELSE 0 END) / sum(s), 6) AS recall, round(sum(s * 2.0 * tp / (s + d)) / sum(s), 6) AS f1 FROM j GROUP BY fold""")
def classification_metrics(spark, sf):
    return rounded(metrics.classification_metrics(flag_predictions(spark, sf).drop("score")), 6)


SCORE_SQL = "(SELECT CAST(l_linenumber AS BIGINT) AS fold, l_returnflag = 'R' AS hit, round(0.2 + 0.5 * l_discount + CASE WHEN l_returnflag = 'R' THEN 0.1 ELSE 0 END, 4) AS score FROM lineitem)"


@query(f"""SELECT fold, round((sum(CASE WHEN hit THEN r END) - pos * (pos + 1) / 2.0) / (pos * CAST(neg AS DOUBLE)), 6) AS auc_roc, round(any_value(loss), 6) AS log_loss FROM (
 SELECT fold, hit, rank() OVER (PARTITION BY fold ORDER BY score) + (count(*) OVER (PARTITION BY fold, score) - 1) / 2.0 AS r, count(*) FILTER (hit) OVER (PARTITION BY fold) AS pos,
 count(*) FILTER (NOT hit) OVER (PARTITION BY fold) AS neg, avg(-ln(CASE WHEN hit THEN score ELSE 1 - score END)) OVER (PARTITION BY fold) AS loss FROM {SCORE_SQL}) GROUP BY fold, pos, neg""")
def auc_and_log_loss(spark, sf):
    p = flag_predictions(spark, sf)
    hit = (F.col("y") == "R").cast("int").cast("string")
    binary = p.select("model", "fold", "type", "y_name", hit.alias("y"), hit.alias("y_pred"), F.create_map(F.lit("0"), 1 - F.col("score"), F.lit("1"), F.col("score")).alias("proba"))
    return rounded(metrics.auc_roc(binary).join(metrics.log_loss(binary), metrics.GROUP).select("fold", "auc_roc", "log_loss"), 6)


@query(PRED_SQL + "SELECT model, type, y_name, count(*) AS n, count(DISTINCT fold) AS folds, round(avg(y_pred), 2) AS mean_pred FROM p GROUP BY 1, 2, 3")
def predictions_long(spark, sf):
    p = price_predictions(spark, sf)
    both = diagnose.predictions_long({m: p.filter(F.col("model") == m).drop("model") for m in ("A", "B")}, "test")
    return rounded(both.groupBy("model", "type", "y_name").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("fold").alias("folds"), F.avg("y_pred").alias("mean_pred")), 2)


@query(PRED_SQL + "SELECT y_name, model, type, r2, rmse FROM (" + REG_SQL.format(k="y_name, model, type") + ")")
def prediction_scatter_stats(spark, sf):
    return rounded(diagnose.prediction_scatter_stats(price_predictions(spark, sf)), r2=6)


@query()
def residual_trend(spark, sf):
    return diagnose.residual_trend(price_predictions(spark, sf))


@query(PRED_SQL + "SELECT model, axis, count(*) AS points, true AS sums_to_one FROM (SELECT DISTINCT model FROM p), (SELECT unnest(['prediction', 'residual']) AS axis), range(200) GROUP BY 1, 2")
def residual_densities(spark, sf):
    curves = diagnose.residual_densities(price_predictions(spark, sf))
    area = F.sum("density") * (F.max("x") - F.min("x")) / (F.count(F.lit(1)) - 1)
    return curves.groupBy("model", "axis").agg(F.count(F.lit(1)).alias("points"), (F.abs(area - 1) < 0.02).alias("sums_to_one"))


@query(PRED_SQL + """, q AS (SELECT model, quantile_cont(y_pred - y, 0.25) AS q1, quantile_cont(y_pred - y, 0.5) AS median, quantile_cont(y_pred - y, 0.75) AS q3 FROM p GROUP BY 1)
SELECT model, y_name, count(*) AS n, round(avg(y_pred - y), 4) AS mean, round(stddev_pop(y_pred - y), 4) AS std, round(any_value(q1), 4) AS q1, round(any_value(median), 4) AS median, round(any_value(q3), 4) AS q3,
 round(avg(power((y_pred - y - m) / s, 3)), 5) + 0.0 AS skew, round(avg(power((y_pred - y - m) / s, 4)), 5) AS kurtosis,
 count(*) FILTER (y_pred - y < q1 - 1.5 * (q3 - q1) OR y_pred - y > q3 + 1.5 * (q3 - q1)) AS outliers
 FROM p JOIN q USING (model) JOIN (SELECT model, avg(y_pred - y) AS m, stddev_pop(y_pred - y) AS s FROM p GROUP BY 1) USING (model) GROUP BY 1, 2""")
def error_distribution(spark, sf):
    out = diagnose.error_distribution(price_predictions(spark, sf), ("model", "y_name"))
    return rounded(out.drop("whisker_low", "whisker_high"), skew=5, kurtosis=5)


@query(PRED_SQL + """, e AS (SELECT model, y_pred - y AS e FROM p), s AS (SELECT model, avg(e) AS m, stddev_pop(e) AS d, count(*) AS n FROM e GROUP BY 1)
SELECT model, any_value(n) AS n, count(DISTINCT e) AS points, round(min((e - m) / d), 4) AS least, round(max((e - m) / d), 4) AS most, true AS rising FROM e JOIN s USING (model) GROUP BY 1""")
def qq_points(spark, sf):
    """Every error is on the curve, and larger errors meet larger quantiles."""
    qq = diagnose.qq_points(price_predictions(spark, sf), ("model",))
    facts = qq.groupBy("model").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("points"), F.min("sample").alias("least"), F.max("sample").alias("most"), (F.corr("sample", "theoretical") > 0.8).alias("rising"))
    return rounded(facts)


@query(CLASS_SQL + "SELECT model, y_name, y, y_pred, count(*) AS n FROM p GROUP BY ALL")
def confusion_matrix(spark, sf):
    return diagnose.confusion_matrix(flag_predictions(spark, sf))


@query(PRED_SQL + """, s AS (SELECT y_name, model, stddev_samp(y) AS so, stddev_samp(y_pred) AS sp, corr(y, y_pred) AS r, avg(y_pred - y) AS bias, sqrt(avg(power(y_pred - y, 2))) AS total FROM p GROUP BY 1, 2)
SELECT y_name, model, round(sp / so, 5) AS sigma_ratio, round(r, 5) AS correlation, round(sqrt(1 + power(sp / so, 2) - 2 * sp / so * r), 5) AS rmse_norm, round(bias / so, 5) AS bias_norm, round(total / so, 5) AS rmse_total_norm,
 CAST(rank() OVER (ORDER BY total / so) AS DOUBLE) AS rank, CAST(rank() OVER (ORDER BY total / so) AS DOUBLE) AS total_rank FROM s""")
def taylor_stats(spark, sf):
    return rounded(diagnose.taylor_stats(price_predictions(spark, sf)), 5)


# -- models -----------------------------------------------------------------------------------------

FEATURES = ["p_size", "p_type", "p_brand", "p_partkey"]


def part_table(spark, sf):
    """Retail price of parts from size, type, brand and number."""
    part = read(spark, sf, "part", "p_partkey", "p_size", "p_type", "p_brand", "p_retailprice").withColumn("key", F.col("p_partkey"))
    return x_y(part, "p_retailprice", task=REGRESSION, keep="key")


def segment_table(spark, sf, target="o_orderstatus"):
    orders = read(spark, sf, "orders", "o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", "o_orderstatus")
    orders = orders.withColumn("dear", F.when(F.col("o_totalprice") > 250000, "dear").otherwise("cheap"))
    return x_y(orders.drop(*({"o_orderstatus", "dear"} - {target})), target, task=CLASSIFICATION, keep="o_orderkey")


def _two_folds(table, key):
    return folds.k_fold(table.df, key, 2)


def _check(result: training.CVResult) -> DataFrame:
    """Rows predicted once each, with a score for every fold."""
    counts = result.predictions.groupBy("model", "y_name").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("fold").alias("folds"))
    scores = result.long_metrics().groupBy("model", "y_name").agg(F.count_distinct("metric").alias("metrics"))
    return counts.join(F.broadcast(scores), ["model", "y_name"])  # one row per model and target


CV_SQL = "SELECT '{m}' AS model, '{y}' AS y_name, count(*) AS n, 2 AS folds, {k} AS metrics FROM {t}"


@query(CV_SQL.format(m="RF", y="p_retailprice", k=4, t="part"))
def cross_validate_forest(spark, sf):
    t = part_table(spark, sf)
    steps = [lambda d, y: tr.standard_scaler(d, ["p_size"]), lambda d, y: tr.target_encoder(d, y, "key", ["p_brand"]), lambda d, y: tr.onehot_encoder(d, ["p_type"])]
    return _check(training.cross_validate(t, _two_folds(t, "key"), models.random_forest(n_estimators=10, max_depth=6), steps))


@query(CV_SQL.format(m="XGB", y="p_retailprice", k=4, t="part"))
def cross_validate_boosted(spark, sf):
    t = part_table(spark, sf)
    return _check(training.cross_validate(t, _two_folds(t, "key"), models.gbt("xgb", n_estimators=8, max_depth=4)))


@query(CV_SQL.format(m="LGBM", y="p_retailprice", k=4, t="part"))
def cross_validate_leafwise_preset(spark, sf):
    t = part_table(spark, sf)
    return _check(training.cross_validate(t, _two_folds(t, "key"), models.gbt("lgbm", n_estimators=5, num_leaves=15)))


@query(CV_SQL.format(m="CAT", y="dear", k=6, t="orders"))
def cross_validate_category_preset(spark, sf):
    t = segment_table(spark, sf, "dear")
    return _check(training.cross_validate(t, _two_folds(t, "o_orderkey"), models.gbt("cat", n_estimators=4, depth=3)))


STUMP_SQL = """cum AS (SELECT *, sum(n) OVER w AS nl, sum(g) OVER w AS gl, sum(h) OVER w AS hl, sum(g) OVER t AS gt, sum(h) OVER t AS ht, row_number() OVER (PARTITION BY k ORDER BY x DESC) AS last
 FROM v WINDOW w AS (PARTITION BY k ORDER BY x), t AS (PARTITION BY k)),
gain AS (SELECT *, (gl * gl / (hl + 1) + (gt - gl) * (gt - gl) / (ht - hl + 1) - gt * gt / (ht + 1)) / 2 AS gain FROM cum WHERE last > 1)
SELECT k AS output, CAST(x AS DOUBLE) AS threshold, round(gain, 3) AS gain, CAST(nl AS DOUBLE) AS left_rows, round(-gl / (hl + 1), 6) AS left_value, round(-(gt - gl) / (ht - hl + 1), 6) AS right_value
FROM gain QUALIFY row_number() OVER (PARTITION BY k ORDER BY gain DESC, x) = 1"""


def _stumps(spark, model, labels) -> DataFrame:
    rows = [(labels[k], t.threshold[0], t.gain[0], t.cover[t.left[0]], t.value[t.left[0]], t.value[t.right[0]]) for k, t in enumerate(model.rounds[0])]
    out = spark.createDataFrame(rows, "output string, threshold double, gain double, left_rows double, left_value double, right_value double")  # one row per output
    return out.select("output", "threshold", F.round("gain", 3).alias("gain"), "left_rows", F.round("left_value", 6).alias("left_value"), F.round("right_value", 6).alias("right_value"))


@query("WITH v AS (SELECT 'value' AS k, p_size AS x, count(*) AS n, sum(b - p_retailprice) AS g, CAST(count(*) AS DOUBLE) AS h FROM part, (SELECT avg(p_retailprice) AS b FROM part) GROUP BY p_size), " + STUMP_SQL)
def boosted_round_regression(spark, sf):
    """The first split of second-order boosting is the best of all splits by closed form."""
    part = read(spark, sf, "part", "p_size", "p_retailprice").withColumn("__label", F.col("p_retailprice"))
    return _stumps(spark, boosting.fit(part, ["p_size"], {}, "squared", 1, boosting.Settings("level", 1, max_depth=1)), ["value"])


@query("""WITH d AS (SELECT month(o_orderdate) AS x, o_orderpriority AS y FROM orders), c AS (SELECT y AS k, count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM d) AS p FROM d GROUP BY y),
v AS (SELECT k, x, count(*) AS n, sum(p - CASE WHEN y = k THEN 1 ELSE 0 END) AS g, count(*) * p * (1 - p) AS h FROM d, c GROUP BY k, x, p), """ + STUMP_SQL)
def boosted_round_classes(spark, sf):
    """One round of a five-class ensemble has a tree of its own for each class."""
    orders = read(spark, sf, "orders").select(F.month("o_orderdate").alias("x"), "o_orderpriority")
    names = models.class_labels(orders, "o_orderpriority")
    label = (F.array_position(F.array(*[F.lit(v) for v in names]), F.col("o_orderpriority")) - 1).cast("double")
    return _stumps(spark, boosting.fit(orders.withColumn("__label", label), ["x"], {}, "softmax", len(names), boosting.Settings("level", 1, max_depth=1)), names)


@query("SELECT 15 AS leaves, CAST(count(*) AS DOUBLE) AS cover, round(avg(p_retailprice), 4) AS mean_prediction FROM part")
def leafwise_tree(spark, sf):
    """Best-first growth stops at its number of leaves; unpenalised leaves are means, so predictions average to the target's mean."""
    part = read(spark, sf, "part", "p_size", "p_partkey", "p_retailprice").withColumn("__label", F.col("p_retailprice"))
    model = boosting.fit(part, ["p_size", "p_partkey"], {}, "squared", 1, boosting.Settings("leaf", 1, 1.0, 0, 15, reg_lambda=0.0, min_child_samples=5))
    (t,) = model.rounds[0]
    leaf = [i for i, f in enumerate(t.feature) if f < 0]
    mean = model.facts["start"][0] + sum(t.value[i] * t.cover[i] for i in leaf) / t.cover[0]
    return spark.createDataFrame([(len(leaf), float(sum(t.cover[i] for i in leaf)), mean)], "leaves int, cover double, mean_prediction double").withColumn("mean_prediction", F.round("mean_prediction", 4))


@query("""WITH t AS (SELECT p_brand, p_retailprice AS y FROM part WHERE p_partkey % 5 <> 0), m AS (SELECT avg(y) AS prior FROM t)
SELECT p_brand, count(*) AS n, round((sum(y) + any_value(prior)) / (count(*) + 1), 6) AS statistic FROM t, m GROUP BY p_brand""")
def category_statistics(spark, sf):
    """Rows that training does not see get the statistic of all training rows of their level."""
    part = read(spark, sf, "part").select("p_brand", F.col("p_retailprice").alias("y"), (F.col("p_partkey") % 5 == 0).alias("held"))
    out, _ = boosting.ordered_statistics(part, ["p_brand"], {"y": F.col("y")}, "held")
    return out.groupBy("p_brand").agg(F.count(F.when(~F.col("held"), 1)).alias("n"), F.round(F.max(F.when(F.col("held"), F.col("p_brand__y"))), 6).alias("statistic"))


@query(CV_SQL.format(m="MLP", y="p_retailprice", k=4, t="part"))
def cross_validate_network_regression(spark, sf):
    t = part_table(spark, sf)
    steps = [lambda d, y: tr.standard_scaler(d, ["p_size", "p_partkey"]), lambda d, y: tr.onehot_encoder(d, ["p_type", "p_brand"])]
    return _check(training.cross_validate(t, _two_folds(t, "key"), models.mlp(hidden=[8], epochs=4), steps))


@query(CV_SQL.format(m="MLP", y="label", k=6, t="embeddings"))
def cross_validate_perceptron(spark, sf):
    emb = read(spark, sf, "embeddings", "vec_id", "embedding", "label")
    width = emb.agg(F.max(F.size("embedding"))).first()[0]
    wide = emb.select("vec_id", "label", *[F.get("embedding", F.lit(i)).cast("double").alias(f"e{i}") for i in range(width)])
    t = x_y(materialize(wide), "label", task=CLASSIFICATION, keep="vec_id")
    return _check(training.cross_validate(t, _two_folds(t, "vec_id"), models.mlp(hidden=[16], epochs=30)))


@query("SELECT m AS model, 'test' AS kind, count(*) AS n FROM part, (SELECT unnest(['RF', 'XGB']) AS m) GROUP BY 1")
def model_comparison(spark, sf):
    part = read(spark, sf, "part", "p_partkey", "p_size", "p_type", "p_retailprice")
    out = jobs.modeling(spark, part, "p_retailprice", "p_partkey", [models.random_forest(n_estimators=6), models.gbt(n_estimators=4)], task=REGRESSION, make_folds=lambda d: folds.k_fold(d, "p_partkey", 2))
    ranked = out["taylor"].select("model")
    return out["predictions"].join(F.broadcast(ranked), "model").groupBy("model", F.col("type").alias("kind")).agg(F.count(F.lit(1)).alias("n"))  # one row per model


@query("SELECT 3 AS trials, true AS best_is_least FROM part LIMIT 1")
def tuning(spark, sf):
    t = part_table(spark, sf)
    f = folds.simple_cv(t.df, "key")
    found = training.tune(t, f, models.random_forest(n_estimators=4), {"max_depth": search.Choice([2, 4, 6]), "min_samples_leaf": search.Range(1, 4)}, n_trials=3)
    return found.trials.agg(F.count(F.lit(1)).alias("trials"), (F.min("value") == F.lit(found.score)).alias("best_is_least"))


@query("SELECT t AS type, 100 AS iterations, CASE WHEN t = 'train' THEN true END AS training_falls FROM (SELECT unnest(['train', 'val']) AS t), (SELECT count(*) FROM part)")
def loss_curve(spark, sf):
    t = part_table(spark, sf)
    f = folds.simple_cv(t.df, "key", 0.6, 0.2)
    curve = training.mean_loss(training.loss_curve(training.cross_validate(t, f, models.gbt()), f))  # all rounds of the preset
    return curve.groupBy("type").agg(F.count(F.lit(1)).alias("iterations"), F.min_by("loss", "iteration").alias("first"), F.max_by("loss", "iteration").alias("last")).select(
        "type", "iterations", F.when(F.col("type") == "train", F.col("first") >= F.col("last")).alias("training_falls"))  # held-out loss may rise


@query("SELECT count(*) AS n, true AS between_folds FROM part")
def ensemble_predict(spark, sf):
    t = part_table(spark, sf)
    ms = training.cross_validate(t, _two_folds(t, "key"), models.random_forest(n_estimators=5)).models
    out = training.ensemble_predict(ms, ms[1].score(ms[0].score(t.df, "a"), "b"))
    inside = F.col("p_retailprice_pred").between(F.least("a", "b") - 1e-9, F.greatest("a", "b") + 1e-9)
    return out.agg(F.count(F.lit(1)).alias("n"), F.bool_and(inside).alias("between_folds"))


@query("SELECT count(*) AS n, 0.0::DOUBLE AS gap FROM orders")
def stored_models(spark, sf):
    """Models written and read again give the same classes."""
    t = segment_table(spark, sf, "dear")
    f = _two_folds(t, "o_orderkey")
    ms = training.cross_validate(t, f, models.random_forest(n_estimators=4), [lambda d, y: tr.ordinal_encoder(d, ["o_orderpriority"])]).models
    root = shared_scratch(spark)
    for m in ms:
        models.save_model(m, root, "run")
    again = models.load_models(spark, root, "run", "RF")
    both = ms[0].score(again[0].score(t.df, "a"), "b")
    return both.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("a") != F.col("b")).cast("double")).alias("gap"))


@query("SELECT f AS feature, true AS positive FROM (SELECT unnest(['p_partkey', 'p_size']) AS f), (SELECT count(*) FROM part)")
def feature_importance(spark, sf):
    t = part_table(spark, sf)
    ms = training.cross_validate(t, _two_folds(t, "key"), models.gbt(n_estimators=4)).models
    found = training.feature_importance(ms).groupBy("feature").agg((F.avg("importance") >= 0).alias("positive"))
    return found.filter(F.col("feature").isin("p_partkey", "p_size"))


@query("SELECT 'p_partkey' AS strongest, 4 AS features, (SELECT count(*) FROM part) AS n")
def permutation_importance(spark, sf):
    t = part_table(spark, sf)
    m = training.cross_validate(t, folds.simple_cv(t.df, "key"), models.random_forest(n_estimators=6, max_features="all")).models[0]
    found = training.permutation_importance(m, t.df, "key", n_repeats=2)
    return found.agg(F.max_by("feature", "importance").alias("strongest"), F.count(F.lit(1)).alias("features")).withColumn("n", F.lit(t.df.count()))


@query("SELECT 'RF' AS model, 2 AS folds, 'loaded' AS origin FROM part LIMIT 1")
def reuse_finished_models(spark, sf):
    t = part_table(spark, sf)
    f = _two_folds(t, "key")
    spec, root = models.random_forest(n_estimators=3), shared_scratch(spark)
    for m in training.cross_validate(t, f, spec).models:
        models.save_model(m, root, "first")
    runlog.append_run(spark, f"{root}-log", "e", "model", "RF", run_id="first")
    trained: list[str] = []
    got = training.reuse_or_train(runlog.run_log(spark, f"{root}-log"), "e", [spec], root, lambda s: trained.append(s.label) or [])
    return spark.createDataFrame([("RF", len(got["RF"]), "trained" if trained else "loaded")], "model string, folds bigint, origin string")


# -- contributions ----------------------------------------------------------------------------------


def _explained(spark, sf, spec=None):
    t = part_table(spark, sf)
    f = _two_folds(t, "key")
    ms = training.cross_validate(t, f, spec or models.random_forest(n_estimators=5, max_depth=5, max_features="all")).models
    return t, f, ms


@query("SELECT count(*) AS n, 0.0::DOUBLE AS gap FROM part")
def tree_shap(spark, sf):
    """Contributions of every row add up to its prediction."""
    t, f, ms = _explained(spark, sf)
    total = F.col("base") + F.aggregate(F.map_values("shap"), F.lit(0.0), lambda a, x: a + x)
    parts = [shap.tree_shap(m, m.score(f.test(m.fold), "pred").withColumn("row", F.struct("key", "pred")), "row").select("row.pred", total.alias("total")) for m in ms]
    both = parts[0].unionByName(parts[1])
    return rounded(both.agg(F.count(F.lit(1)).alias("n"), F.max(F.abs(F.col("pred") - F.col("total"))).alias("gap")), 6)


@query("SELECT 4 * count(*) AS cells, 4 AS features, 'p_partkey' AS strongest FROM part")
def shap_tables(spark, sf):
    t, f, ms = _explained(spark, sf)
    long = shap.shap_long(shap.explain_folds(ms, f.test, "key"), "key")
    first = shap.shap_summary(long).filter("rank = 1").select(F.col("feature").alias("strongest"))
    return long.agg(F.count(F.lit(1)).alias("cells"), F.count_distinct("feature").alias("features")).join(F.broadcast(first))  # one row


@query()
def shap_dependence(spark, sf):
    t, f, ms = _explained(spark, sf)
    return shap.shap_dependence(shap.explain_folds(ms, f.test, "key"), "key", top_n=None).line


@query("SELECT 4 AS steps, 0.0::DOUBLE AS gap FROM part LIMIT 1")
def sample_waterfall(spark, sf):
    t, f, ms = _explained(spark, sf)
    values = shap.tree_shap(ms[0], t.df, "key")
    fall = shap.sample_waterfall(values, "key", 3)
    return rounded(fall.agg(F.count(F.lit(1)).alias("steps"), F.abs(F.max_by("end", "step") - F.min_by("start", "step") - F.sum("shap_value")).alias("gap")), 6)


# -- search and jobs --------------------------------------------------------------------------------


@query("SELECT min(p_size) AS size_low, max(p_size) AS size_high, round(min(p_retailprice), 2) AS price_low, round(max(p_retailprice), 2) AS price_high, count(DISTINCT p_type) AS types FROM part")
def infer_space(spark, sf):
    space = search.infer_space(read(spark, sf, "part", "p_size", "p_retailprice", "p_type"))
    row = (space["p_size"].start, space["p_size"].end, round(space["p_retailprice"].start, 2), round(space["p_retailprice"].end, 2), len(space["p_type"].values))
    return spark.createDataFrame([row], "size_low bigint, size_high bigint, price_low double, price_high double, types bigint")


@query("SELECT 5000 AS n, true AS inside, count(DISTINCT p_type) AS types FROM part")
def sample_candidates(spark, sf):
    part = read(spark, sf, "part", "p_size", "p_type")
    out = search.sample_candidates(spark, search.infer_space(part), 5000)
    bounds = part.agg(F.min("p_size").alias("lo"), F.max("p_size").alias("hi"))
    return out.join(F.broadcast(bounds)).agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("p_size").between(F.col("lo"), F.col("hi"))).alias("inside"), F.count_distinct("p_type").alias("types"))  # one row


@query("SELECT true AS rule_holds, true AS beats_half, true AS ranked FROM part LIMIT 1")
def inverse_search(spark, sf):
    t, f, ms = _explained(spark, sf)
    out = search.inverse_search(ms, search.infer_space(t.df, ms[0].x_names), {"p_retailprice": "maximize"}, rule=F.col("p_size") < 40, n_trials=600)
    typical = training.ensemble_predict(ms, t.df).agg(F.percentile("p_retailprice_pred", 0.5).alias("typical"))
    return out.join(F.broadcast(typical)).agg(  # one row
        F.bool_and(F.col("p_size") < 40).alias("rule_holds"), (F.max("p_retailprice") > F.max("typical")).alias("beats_half"),
        (F.min_by("p_retailprice", "rank") == F.max("p_retailprice")).alias("ranked"))


@query("""SELECT o_orderkey, NOT EXISTS (SELECT 1 FROM orders b WHERE b.o_totalprice >= a.o_totalprice AND b.o_custkey <= a.o_custkey AND (b.o_totalprice > a.o_totalprice OR b.o_custkey < a.o_custkey)) AS pareto FROM orders a""")
def pareto_front(spark, sf):
    orders = read(spark, sf, "orders", "o_orderkey", "o_totalprice", "o_custkey").withColumnRenamed("o_orderkey", "id")
    return search.with_pareto_flag(orders, {"o_totalprice": "maximize", "o_custkey": "minimize"}).select(F.col("id").alias("o_orderkey"), "pareto")


@query("SELECT part, CASE part WHEN 'profile' THEN 5 WHEN 'box_stats' THEN 4 WHEN 'quartiles' THEN 4 ELSE 800 END AS n FROM (SELECT unnest(['profile', 'box_stats', 'quartiles', 'kde']) AS part), (SELECT count(*) FROM supplier)")
def data_profile(spark, sf):
    """Profile job over a table with one constant column too many."""
    line = read(spark, sf, "lineitem", *LINE_NUMBERS, "l_returnflag").withColumn("constant", F.lit(1))
    out = jobs.data_profile(spark, line)
    parts = [out[p].agg(F.count(F.lit(1)).alias("n")).select(F.lit(p).alias("part"), "n") for p in ("profile", "box_stats", "quartiles", "kde")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("SELECT part, CASE part WHEN 'effect_size' THEN (SELECT count(DISTINCT o_orderpriority) + count(DISTINCT o_orderstatus) FROM orders) WHEN 'correlation' THEN 4 ELSE (SELECT count(*) FROM orders) END AS n FROM (SELECT unnest(['effect_size', 'correlation', 'trend']) AS part)")
def exploratory_analysis(spark, sf):
    orders = read(spark, sf, "orders", "o_custkey", "o_totalprice", "o_orderstatus", "o_orderpriority")
    out = jobs.eda(spark, orders, "o_totalprice")
    parts = [out[p].agg(F.count(F.lit(1)).alias("n")).select(F.lit(p).alias("part"), "n") for p in ("effect_size", "correlation", "trend")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT 'regression' AS price, 'classification' AS status, 'multiclass' AS status_kind FROM orders LIMIT 1")
def infer_task_type(spark, sf):
    path = f"{sf}/orders.parquet"
    price, status = jobs.infer_task_type(spark, path, "o_totalprice"), jobs.infer_task_type(spark, path, "o_orderstatus")
    return spark.createDataFrame([(price["task"], status["task"], status["subtask"])], "price string, status string, status_kind string")


@query("SELECT count(*) AS n, count(*) AS predicted FROM part")
def predict_from_run(spark, sf):
    """Train and store, then score the file with the stored ensemble."""
    base = shared_scratch(spark)
    part = read(spark, sf, "part", "p_partkey", "p_size", "p_type", "p_retailprice")
    jobs.modeling(spark, part, "p_retailprice", "p_partkey", [models.random_forest(n_estimators=3)], task=REGRESSION, make_folds=lambda d: folds.k_fold(d, "p_partkey", 2), out_dir=base, experiment="parts")
    run_id = runlog.finished_models(runlog.run_log(spark, f"{base}/runs"), "parts").first()["run_id"]
    out = jobs.predict(spark, f"{sf}/part.parquet", f"{base}/models", run_id, "RF", out_dir=f"{base}/scored")
    return out.agg(F.count(F.lit(1)).alias("n"), F.count("p_retailprice_pred").alias("predicted"))


@query("SELECT count(*) AS explained, 'p_partkey' AS strongest FROM part")
def explanation(spark, sf):
    t, f, ms = _explained(spark, sf, models.gbt(n_estimators=4, max_depth=3))
    out = jobs.explanation(ms, f.test, "key", top_n=2)
    first = out["summary"].filter("rank = 1").select(F.col("feature").alias("strongest"))
    return out["shap"].agg(F.count(F.lit(1)).alias("explained")).join(F.broadcast(first))  # one row


@query("SELECT 300 AS n, true AS small FROM part LIMIT 1")
def inverse_optimization(spark, sf):
    t, f, ms = _explained(spark, sf)
    out = jobs.inverse_optimization(spark, t.df, ms, {"p_retailprice": "minimize"}, columns={"p_size": search.Range(1, 10)}, n_trials=300)
    return out.agg(F.count(F.lit(1)).alias("n"), (F.max("p_size") <= 10).alias("small"))
