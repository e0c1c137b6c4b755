"""Relational queries: DataFrame plans, each beside the SQL it is checked against."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import relational as R
from tessera.plans.registry import load_all, query

D = F.col


def text_query(name: str, tables: str, sql: str, spark_sql: str | None = None) -> None:
    """A query given as SQL text on both sides; tables are passed as parameters, not as global views."""
    names = tables.split()
    run = (spark_sql or sql).replace(";", "")
    for t in names:
        run = _braced(run, t)

    @query(name, sql)
    def plan(spark, sf_dir, run=run, names=names):
        return spark.sql(run, **load_all(spark, sf_dir, *names))


def _braced(sql: str, table: str) -> str:
    import re

    return re.sub(rf"(\bFROM|\bJOIN|,)\s+{table}\b", rf"\1 {{{table}}}", sql)


@query("f1_projection", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def _(spark, d):
    return load_all(spark, d, "customer")["customer"].select("c_custkey", "c_name", "c_acctbal")


@query("f2_equality_first", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 1")
def _(spark, d):
    return load_all(spark, d, "orders")["orders"].where(D("o_orderstatus") == "F").select("o_orderkey", "o_totalprice").orderBy("o_orderkey").limit(1)


@query("f3_isin", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def _(spark, d):
    c = load_all(spark, d, "customer")["customer"]
    return c.where(D("c_mktsegment").isin("BUILDING", "MACHINERY")).select("c_custkey", "c_mktsegment")


text_query("f4_comparisons", "lineitem", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45 AND l_returnflag <> 'N' AND l_shipdate IS NOT NULL")
text_query(
    "f5_between", "orders",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE CAST(o_totalprice AS BIGINT) BETWEEN 1000 AND 50000 AND o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-12-31'",
    # SQL's cast takes the nearest integer, Spark's cuts the fraction off
    "SELECT o_orderkey, o_totalprice FROM orders WHERE CAST(rint(o_totalprice) AS BIGINT) BETWEEN 1000 AND 50000 AND o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-12-31'",
)

_NAN = "CASE WHEN c_custkey % 7 = 0 THEN CAST('NaN' AS DOUBLE) WHEN c_custkey % 11 = 0 THEN NULL ELSE c_acctbal END"


@query("f6_nan_exclusion", f"SELECT c_custkey, x FROM (SELECT c_custkey, {_NAN} AS x FROM customer) t WHERE NOT isnan(x)")
def _(spark, d):
    c = load_all(spark, d, "customer")["customer"].selectExpr("c_custkey", f"{_NAN} AS x")
    return c.where(~F.isnan("x") & D("x").isNotNull())


@query("f7_sentinels", "SELECT p_partkey, nullif(p_size, 1) AS p_size, nullif(p_brand, 'Brand#11') AS p_brand FROM part")
def _(spark, d):
    from tessera.functions.scalars import without

    p = load_all(spark, d, "part")["part"]
    return p.select("p_partkey", without(D("p_size"), 1).alias("p_size"), without(D("p_brand"), "Brand#11").alias("p_brand"))


@query("f8_dropna", f"SELECT c_custkey, x FROM (SELECT c_custkey, {_NAN} AS x FROM customer) t WHERE x IS NOT NULL AND NOT isnan(x)")
def _(spark, d):
    return load_all(spark, d, "customer")["customer"].selectExpr("c_custkey", f"{_NAN} AS x").dropna(subset=["x"])


@query("f9_fillna", f"SELECT c_custkey, CASE WHEN x IS NULL OR isnan(x) THEN 0.0 ELSE x END AS x FROM (SELECT c_custkey, {_NAN} AS x FROM customer) t")
def _(spark, d):
    return load_all(spark, d, "customer")["customer"].selectExpr("c_custkey", f"{_NAN} AS x").na.fill(0.0, ["x"])


@query("f10_rename_drop", "SELECT s_suppkey AS id, s_name AS name FROM supplier")
def _(spark, d):
    s = load_all(spark, d, "supplier")["supplier"]
    return s.withColumnRenamed("s_suppkey", "id").drop("s_nationkey", "s_acctbal").toDF("id", "name")


@query("f11_case_tolerance", "SELECT l_orderkey, l_linenumber, CASE WHEN abs(l_quantity - 25) <= 5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS near FROM lineitem")
def _(spark, d):
    li = load_all(spark, d, "lineitem")["lineitem"]
    return li.select("l_orderkey", "l_linenumber", F.when(F.abs(D("l_quantity") - 25) <= 5, 1.0).otherwise(0.0).alias("near"))


text_query("f12_boolean_label", "lineitem", "SELECT l_orderkey, l_linenumber, CAST(CAST(l_returnflag = 'R' AS INT) AS DOUBLE) AS label FROM lineitem")


@query("f13_suffix", "SELECT c_custkey FROM customer WHERE suffix(CAST(c_custkey AS VARCHAR), '3')")
def _(spark, d):
    return load_all(spark, d, "customer")["customer"].where(F.endswith(D("c_custkey").cast("string"), F.lit("3"))).select("c_custkey")


@query("f14_malformed_rows", "SELECT p_partkey FROM part WHERE len(string_split(replace(p_name, 'e', ','), ',')) = 3")
def _(spark, d):
    return load_all(spark, d, "part")["part"].where(F.size(F.split(F.replace(D("p_name"), F.lit("e"), F.lit(",")), ",")) == 3).select("p_partkey")


@query("f15_random_split", "SELECT c_custkey, CAST(1 AS BIGINT) AS times FROM customer")
def _(spark, d):
    """How often each row is in a part: the parts are disjoint and complete."""
    train, test = load_all(spark, d, "customer")["customer"].select("c_custkey").randomSplit([0.8, 0.2], seed=42)
    return train.unionByName(test).groupBy("c_custkey").agg(F.count(F.lit(1)).alias("times"))


@query(
    "f16_positional_split",
    "SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY o_orderkey) <= floor(0.9 * count(*) OVER ()) THEN 'train' ELSE 'test' END AS part FROM orders",
)
def _(spark, d):
    train, test = R.split_by_position(load_all(spark, d, "orders")["orders"].select("o_orderkey"), 0.9, "o_orderkey")
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


text_query("f17_literal_tag", "events", "SELECT '2021' AS year, event_id FROM events")


@query("f18_explicit_cast", "SELECT event_id, TRY_CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS n, TRY_CAST(event_type AS DOUBLE) AS bad FROM events")
def _(spark, d):
    from tessera.functions.scalars import number

    e = load_all(spark, d, "events")["events"]
    return e.select("event_id", number(F.regexp_extract("props", "([0-9]+)", 1)).alias("n"), number(D("event_type")).alias("bad"))


# joins
text_query("j1_inner_join", "orders customer", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
text_query("j2_expression_key", "supplier nation", "SELECT s_suppkey, n_name FROM supplier JOIN nation ON CAST(substr(s_name, length(s_name) - 1, 2) AS INT) % 25 = n_nationkey")
text_query(
    "j3_three_way", "supplier nation region", "SELECT s_name, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
)
text_query("j4_comma_join", "customer nation region", "SELECT c_custkey, n_name, r_name FROM customer, nation, region WHERE c_nationkey = n_nationkey AND n_regionkey = r_regionkey")
text_query(
    "j5_case_insensitive_join", "lineitem part supplier nation",
    "SELECT DISTINCT p_partkey, s_suppkey, n_name FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey "
    "WHERE lower(p_brand) = lower('BRAND#12') AND lower(n_name) = lower('china')",
)


@query("j6_broadcast_join", "SELECT o_orderkey, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def _(spark, d):
    t = load_all(spark, d, "orders", "customer", "nation")
    # nation has 25 rows by its definition
    return t["orders"].join(t["customer"], D("o_custkey") == D("c_custkey")).join(F.broadcast(t["nation"]), D("c_nationkey") == D("n_nationkey")).select("o_orderkey", "n_name")


@query("j7_semi_join", "SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)")
def _(spark, d):
    t = load_all(spark, d, "customer", "nation")
    return t["customer"].join(t["nation"].where("n_regionkey = 2"), D("c_nationkey") == D("n_nationkey"), "left_semi").select("c_custkey")


_EXISTS = ["event_type = 'purchase' AND value BETWEEN 20 AND 30", "event_type = 'view' AND value < 30", "event_type = 'click' AND value > 10", "event_type <> 'error' AND value >= 40"]


@query("j8_exists_fused", "SELECT DISTINCT c_custkey FROM customer WHERE " + " AND ".join(f"EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey AND {c})" for c in _EXISTS))
def _(spark, d):
    t = load_all(spark, d, "customer", "events")
    keyed = t["customer"].select(D("c_custkey").alias("user_id")).distinct()
    return R.exists_all(keyed, t["events"], "user_id", [F.expr(c) for c in _EXISTS]).select(D("user_id").alias("c_custkey"))


text_query(
    "j9_scalar_subquery", "orders",
    "WITH top AS (SELECT o_custkey AS k FROM orders GROUP BY o_custkey ORDER BY count(*) DESC, o_custkey LIMIT 1) SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = (SELECT k FROM top)",
)
text_query(
    "j10_left_outer", "customer orders",
    "SELECT c_custkey, coalesce(n, 0) AS n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) o ON c_custkey = o_custkey",
)
text_query("j12_join_same_name", "labels documents", "SELECT doc_id, quality, toxic, n_chars FROM labels JOIN documents USING (doc_id)")
text_query("j13_inner_merge", "part lineitem", "SELECT p_partkey, l_orderkey, l_linenumber FROM part JOIN lineitem ON p_partkey = l_partkey WHERE p_size = 7")
text_query("j14_residual", "supplier", "SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey")
text_query(
    "j17_join_types", "nation region",
    "SELECT 'left' AS kind, count(*) AS n FROM region LEFT JOIN nation ON r_regionkey = n_regionkey AND n_nationkey < 3 UNION ALL "
    "SELECT 'right', count(*) FROM nation RIGHT JOIN region ON r_regionkey = n_regionkey AND n_nationkey < 3 UNION ALL "
    "SELECT 'full', count(*) FROM nation FULL JOIN region ON r_regionkey = n_nationkey UNION ALL SELECT 'cross', count(*) FROM nation CROSS JOIN region",
)

# aggregates
text_query("a1_min_max", "orders", "SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi, min(o_orderdate) AS first_day FROM orders WHERE o_totalprice <> 0")


@query("a2_max_per_key", "SELECT user_id, max(value) AS max_value FROM events GROUP BY user_id")
def _(spark, d):
    from tessera.streaming.running import running_max

    return running_max(load_all(spark, d, "events")["events"], "user_id", "value")


text_query("a3_count_group", "lineitem", "SELECT l_returnflag, l_linestatus, count(*) AS n, count(l_shipdate) AS dated FROM lineitem GROUP BY l_returnflag, l_linestatus")
text_query(
    "a4_average", "lineitem orders",
    "SELECT o_orderpriority, round(avg(CAST(l_quantity AS DOUBLE)), 6) AS quantity, round(avg(l_extendedprice - l_discount), 4) AS net FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderpriority",
)
text_query("a5_sum", "lineitem", "SELECT l_suppkey, CAST(sum(l_linenumber) AS BIGINT) AS lines, round(sum(l_quantity), 4) AS quantity FROM lineitem GROUP BY l_suppkey")
text_query("a6_group_by_alias", "events", "SELECT substr(CAST(CAST(ts AS DATE) AS STRING), 6, 2) AS month, round(avg(value), 6) AS mean FROM events GROUP BY month")
text_query("a7_bare_column", "customer nation", "SELECT n_nationkey, min(n_name) AS n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_nationkey")


@query("a8_adjacency", "SELECT s_nationkey AS id, list_sort(list(DISTINCT s_suppkey)) AS neighbors FROM supplier GROUP BY s_nationkey")
def _(spark, d):
    from tessera.operators.graph import adjacency

    return adjacency(load_all(spark, d, "supplier")["supplier"].select(D("s_nationkey").alias("src"), D("s_suppkey").alias("dst")))


@query("a9_modal_class", "SELECT label AS modal FROM embeddings GROUP BY label ORDER BY count(*) DESC, label LIMIT 1")
def _(spark, d):
    e = load_all(spark, d, "embeddings")["embeddings"]
    return e.groupBy("label").count().orderBy(F.desc("count"), "label").limit(1).select(D("label").alias("modal"))


text_query("a10_accuracy", "lineitem", "SELECT round(avg(CAST(CAST(abs(l_quantity - 25) <= 10 AS INT) AS DOUBLE)), 6) AS accuracy FROM lineitem")


@query(
    "a11_regression_metrics",
    "SELECT round(sqrt(avg(e * e)), 6) AS rmse, round(avg(abs(e)), 6) AS mae, round(avg(CASE WHEN abs(e) <= 500 THEN 1.0 ELSE 0.0 END), 6) AS accuracy, "
    "round(1 - sum(e * e) / (var_pop(y) * count(*)), 6) AS r2 FROM (SELECT l_extendedprice AS y, l_quantity * 1000 - l_extendedprice AS e FROM lineitem) t",
)
def _(spark, d):
    from tessera.operators.ml import regression_report

    li = load_all(spark, d, "lineitem")["lineitem"].select(D("l_extendedprice").alias("label"), (D("l_quantity") * 1000).alias("prediction"))
    r = regression_report(li, tolerance=500.0)
    return r.select(*[F.round(c, 6).alias(c) for c in r.columns])


@query("a12_dedupe", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1")
def _(spark, d):
    return R.dedupe(load_all(spark, d, "orders")["orders"], ["o_custkey"], D("o_orderdate"), D("o_orderkey")).select("o_custkey", "o_orderkey")


text_query("a13_distinct", "lineitem", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
text_query("a14_sorted_unique", "orders", "SELECT DISTINCT o_custkey FROM orders ORDER BY o_custkey")


@query("a15_any_in_group", "SELECT o_custkey, bool_or(o_orderstatus = 'P') AS any_p FROM orders GROUP BY o_custkey")
def _(spark, d):
    return load_all(spark, d, "orders")["orders"].groupBy("o_custkey").agg(F.bool_or(D("o_orderstatus") == "P").alias("any_p"))


@query("a16_argmax", "SELECT o_custkey, arg_max(o_orderkey, o_totalprice) AS best FROM orders GROUP BY o_custkey")
def _(spark, d):
    return load_all(spark, d, "orders")["orders"].groupBy("o_custkey").agg(F.max_by("o_orderkey", "o_totalprice").alias("best"))


text_query("a17_set_union", "orders lineitem", "SELECT o_custkey AS k FROM orders UNION SELECT l_suppkey FROM lineitem")


@query("a18_vector_sum", "SELECT CAST(i - 1 AS INT) AS at, round(sum(embedding[i]::DOUBLE), 4) AS total FROM embeddings, range(1, 65) r(i) GROUP BY i")
def _(spark, d):
    e = load_all(spark, d, "embeddings")["embeddings"]
    return e.select(F.posexplode(D("embedding").cast("array<double>")).alias("at", "x")).groupBy("at").agg(F.round(F.sum("x"), 4).alias("total"))


text_query("a19_mean_std", "lineitem", "SELECT round(avg(l_quantity), 6) AS mean, round(stddev_pop(l_quantity), 6) AS sd_pop, round(stddev_samp(l_quantity), 6) AS sd_samp FROM lineitem")

_M = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_COV = ", ".join([f"round(avg({c}), 4)" for c in _M] + [f"round(covar_samp({a}, {b}), 2) + 0.0" for i, a in enumerate(_M) for b in _M[i:]])


@query("a20_mean_covariance", f"SELECT l_suppkey, [{_COV}] AS features FROM lineitem GROUP BY l_suppkey")
def _(spark, d):
    """Sums of each row group's rows in their order, then of the row groups: as the SQL adds up where each of a supplier's row groups has its own thread."""
    from tessera.operators.features import in_row_groups, rounded_mean_and_covariance

    li = in_row_groups(load_all(spark, d, "lineitem")["lineitem"], ["l_suppkey", *_M])
    f = rounded_mean_and_covariance(li, "l_suppkey", _M, [D("part"), D("row")], (4, 2), D("part"))
    return f.select("l_suppkey", F.concat(F.slice("features", 1, 4), F.transform(F.slice("features", 5, 10), lambda x: x + 0.0)).alias("features"))


@query("a21_bloom_filter", "SELECT added, CASE WHEN added THEN 'all' ELSE 'few' END AS found FROM (SELECT DISTINCT suffix(CAST(c_custkey AS VARCHAR), '3') AS added FROM customer) t")
def _(spark, d):
    """Of what was added all is found; of the rest no more than 3 in 100."""
    from tessera.operators import sketch

    c = load_all(spark, d, "customer")["customer"].select("c_custkey", (D("c_custkey") % 4).alias("part"), F.endswith(D("c_custkey").cast("string"), F.lit("3")).alias("added"))
    bits = sketch.bits_for(c.where("added").count())
    merged = sketch.merge_large(reduce(DataFrame.unionByName, [sketch.build_large(c.where(D("added") & (D("part") == k)), "c_custkey", bits, 5) for k in range(4)]))
    found = sketch.contains_large(c, "c_custkey", merged, bits, 5).groupBy("added").agg(F.avg(D("maybe").cast("int")).alias("share"))
    return found.select("added", F.when(D("share") == 1, "all").when(D("share") <= 0.03, "few").otherwise("some").alias("found"))


# positions of a key in a filter of so many bits: halves of its MD5 digest, added up
FILTER_BITS = 100_000
FILTER_AT = f"unnest(list_transform(range(7), lambda k: (('0x' || substr(md5(x::VARCHAR), 1, 15))::BIGINT % {FILTER_BITS} + ('0x' || substr(md5(x::VARCHAR), 17, 15))::BIGINT % {FILTER_BITS} * k) % {FILTER_BITS}))"


@query(
    "a21_large_filter",
    f"WITH bits AS (SELECT DISTINCT {FILTER_AT} AS spot FROM (SELECT c_custkey AS x FROM customer WHERE c_custkey % 3 = 0)), "
    f"asked AS (SELECT x, {FILTER_AT} AS spot FROM (SELECT DISTINCT o_custkey AS x FROM orders)), "
    "maybe AS (SELECT x, bool_and(bits.spot IS NOT NULL) AS maybe FROM asked LEFT JOIN bits ON asked.spot = bits.spot GROUP BY x) "
    "SELECT o_orderkey, maybe FROM orders JOIN maybe ON o_custkey = x",
)
def _(spark, d):
    """Orders of customers that a filter in four parts of 100,000 bits may hold, false positives as well."""
    from tessera.operators import sketch

    t = load_all(spark, d, "customer", "orders")
    c = t["customer"].where("c_custkey % 3 = 0")
    parts = [sketch.build_large(c.where(D("c_custkey") % 4 == k), "c_custkey", FILTER_BITS) for k in range(4)]
    whole = sketch.merge_large(reduce(DataFrame.unionByName, parts))
    return sketch.contains_large(t["orders"].select("o_orderkey", "o_custkey"), "o_custkey", whole, FILTER_BITS).select("o_orderkey", "maybe")


@query("a22_first_per_group", "SELECT o_orderpriority, arg_min(o_orderkey, o_orderkey) AS first_key FROM orders GROUP BY o_orderpriority")
def _(spark, d):
    return load_all(spark, d, "orders")["orders"].groupBy("o_orderpriority").agg(F.min_by("o_orderkey", "o_orderkey").alias("first_key"))


@query(
    "a23_mean_melt",
    "UNPIVOT (SELECT l_returnflag, round(avg(l_quantity), 6) AS quantity, round(avg(l_discount), 6) AS discount FROM lineitem GROUP BY l_returnflag) ON quantity, discount INTO NAME measure VALUE mean",
)
def _(spark, d):
    g = load_all(spark, d, "lineitem")["lineitem"].groupBy("l_returnflag").agg(F.round(F.avg("l_quantity"), 6).alias("quantity"), F.round(F.avg("l_discount"), 6).alias("discount"))
    return g.unpivot("l_returnflag", ["quantity", "discount"], "measure", "mean")


text_query("a24_histogram", "embeddings", "SELECT label, count(*) AS n FROM embeddings GROUP BY label")
text_query("a25_xor", "orders", "SELECT o_orderpriority, bit_xor(o_orderkey) AS x FROM orders GROUP BY o_orderpriority")
text_query(
    "a26_first_release_cascade", "supplier lineitem orders",
    "WITH own AS (SELECT l_suppkey, min(o_orderdate) AS d FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' GROUP BY l_suppkey), "
    "anyof AS (SELECT l_suppkey, min(l_shipdate) AS d FROM lineitem GROUP BY l_suppkey) "
    "SELECT s_suppkey, CAST(split_part(CAST(CAST(coalesce(o.d, a.d) AS DATE) AS STRING), '-', 1) AS INT) AS year "
    "FROM supplier LEFT JOIN own o ON s_suppkey = o.l_suppkey LEFT JOIN anyof a ON s_suppkey = a.l_suppkey",
)


@query("a27_min_max_scaling", "SELECT p_partkey, round((p_retailprice - min(p_retailprice) OVER ()) / greatest(max(p_retailprice) OVER () - min(p_retailprice) OVER (), 1e-6), 6) AS scaled FROM part")
def _(spark, d):
    p = load_all(spark, d, "part")["part"].select("p_partkey", "p_retailprice")
    return R.min_max(p, "p_retailprice", "scaled").select("p_partkey", F.round("scaled", 6).alias("scaled"))


text_query("a28_variance", "customer", "SELECT c_mktsegment, round(var_samp(c_acctbal), 2) AS v, round(sum(c_acctbal), 2) AS s, count(c_acctbal) AS n FROM customer GROUP BY c_mktsegment")


@query("w1_row_number", "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS row_number FROM orders")
def _(spark, d):
    return R.row_numbers(load_all(spark, d, "orders")["orders"].select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey").select("o_orderkey", "row_number")


# sorts and limits
@query(
    "t1_order_by_limit",
    "SELECT c_custkey, c_name, n_orders, total FROM (SELECT o_custkey, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey) o "
    "JOIN customer ON o_custkey = c_custkey ORDER BY total DESC, c_custkey LIMIT 10",
)
def _(spark, d):
    t = load_all(spark, d, "orders", "customer")
    per = t["orders"].groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    joined = per.join(t["customer"], D("o_custkey") == D("c_custkey")).select("c_custkey", "c_name", "n_orders", "total")
    return R.top_k(joined, 10, F.desc("total"), F.asc("c_custkey"))


text_query("t2_four_keys", "customer", "SELECT c_custkey, c_mktsegment, c_acctbal FROM customer ORDER BY c_mktsegment DESC, c_nationkey ASC, c_acctbal DESC, c_custkey ASC LIMIT 50")
text_query("t3_full_sort", "nation", "SELECT n_nationkey, n_name FROM nation ORDER BY n_name")


@query(
    "t4_top_200_nan_last",
    f"SELECT c_custkey, x FROM (SELECT c_custkey, CASE WHEN isnan(x) THEN NULL ELSE x END AS x FROM (SELECT c_custkey, {_NAN} AS x FROM customer) t) u ORDER BY x DESC NULLS LAST, c_custkey LIMIT 200",
)
def _(spark, d):
    c = load_all(spark, d, "customer")["customer"].selectExpr("c_custkey", f"{_NAN} AS x")
    return R.top_k(c.withColumn("x", F.when(~F.isnan("x"), D("x"))), 200, F.desc_nulls_last("x"), F.asc("c_custkey"))


text_query("t5_top_by_key", "part", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 20")
text_query("t6_slice", "supplier", "SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 5")
text_query("t7_first", "region", "SELECT r_regionkey, r_name FROM region ORDER BY r_regionkey LIMIT 1")
text_query("t8_top_tags", "part", "SELECT p_type, count(*) AS n FROM part GROUP BY p_type ORDER BY n DESC, p_type LIMIT 20")
text_query("t9_aggregate_alias", "orders", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderpriority ORDER BY n DESC, o_orderpriority LIMIT 3")


# unions
text_query(
    "u1_union_all", "events",
    " UNION ALL ".join(f"SELECT '{t}' AS kind, user_id, count(*) AS n FROM events WHERE event_type = '{t}' GROUP BY user_id" for t in ("view", "click", "purchase", "signup")),
)


@query("u2_union_of_frames", "SELECT l_returnflag, l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 40")
def _(spark, d):
    # one plan in place of a union over the flags' values
    return load_all(spark, d, "lineitem")["lineitem"].where("l_quantity > 40").select("l_returnflag", "l_orderkey", "l_linenumber")


text_query("u3_set_union", "customer supplier", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")


@query("u4_union_by_name", "SELECT s_suppkey AS id, s_name AS name FROM supplier UNION ALL SELECT c_custkey, c_name FROM customer")
def _(spark, d):
    t = load_all(spark, d, "supplier", "customer")
    return t["supplier"].select(D("s_suppkey").alias("id"), D("s_name").alias("name")).unionByName(t["customer"].select(D("c_name").alias("name"), D("c_custkey").alias("id")))
