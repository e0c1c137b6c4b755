"""Scalar functions and parsing."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.plans.registry import load_all, query
from tessera.plans.relational import text_query

D = F.col

text_query("x1_substr", "part", "SELECT p_partkey, substr(p_brand, 7, 2) AS code FROM part")
text_query("x2_lower", "nation", "SELECT n_nationkey, lower(n_name) AS name FROM nation WHERE lower(n_name) = lower('China')")


@query("x3_split_explode", "SELECT p_partkey, trim(w) AS word FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part) t")
def _(spark, d):
    return load_all(spark, d, "part")["part"].select("p_partkey", F.explode(F.split("p_name", " ")).alias("w")).select("p_partkey", F.trim("w").alias("word"))


@query("x4_blob_lines", "SELECT doc_id, length(line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) t")
def _(spark, d):
    docs = load_all(spark, d, "documents")["documents"].select("doc_id", D("text").cast("binary").alias("content"))
    return docs.select("doc_id", F.explode(F.split(F.decode("content", "UTF-8"), "\n", -1)).alias("line")).select("doc_id", F.length("line").alias("n"))


@query("x5_parameterised_sql", "SELECT n_nationkey FROM nation WHERE n_name = 'CHINA'' OR 1=1' OR n_nationkey = 3")
def _(spark, d):
    return spark.sql("SELECT n_nationkey FROM {nation} WHERE n_name = :name OR n_nationkey = :key", args={"name": "CHINA' OR 1=1", "key": 3}, **load_all(spark, d, "nation"))


@query("x6_decode", "SELECT doc_id, octet_length(encode(text)) AS n_bytes, length(text) AS n_chars FROM documents")
def _(spark, d):
    docs = load_all(spark, d, "documents")["documents"]
    return docs.select("doc_id", F.octet_length(F.encode("text", "UTF-8")).alias("n_bytes"), F.length(F.decode(D("text").cast("binary"), "UTF-8")).alias("n_chars"))


@query("x7_sha256", "SELECT page_id, sha256(html) AS checksum FROM pages")
def _(spark, d):
    return load_all(spark, d, "pages")["pages"].select("page_id", F.sha2(D("html").cast("binary"), 256).alias("checksum"))


text_query("x16_math", "customer", "SELECT c_custkey, round(sqrt(abs(c_acctbal)), 6) AS root, CAST(abs(c_nationkey - 12) AS INT) AS off FROM customer")


@query("x17_sigmoid", "SELECT c_custkey, round(1 / (1 + exp(-c_acctbal / 1000)), 8) AS p FROM customer")
def _(spark, d):
    return load_all(spark, d, "customer")["customer"].select("c_custkey", F.round(S.sigmoid(D("c_acctbal") / 1000), 8).alias("p"))


@query(
    "x18_date_year",
    "SELECT o_orderkey, TRY_CAST(split_part(nullif(t, '0000-00-00'), '-', 1) AS INT) AS year FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN '0000-00-00' ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS t FROM orders) u",
)
def _(spark, d):
    text = F.when(D("o_orderkey") % 5 == 0, "0000-00-00").otherwise(D("o_orderdate").cast("date").cast("string"))
    return load_all(spark, d, "orders")["orders"].select("o_orderkey", S.date_year(text).alias("year"))


@query(
    "x19_numeric_not_text_order",
    "SELECT t, n FROM (SELECT t, TRY_CAST(t AS DOUBLE) AS n FROM (VALUES ('9'), ('998'), ('1000'), ('-999'), ('\\N')) v(t)) u ORDER BY n DESC NULLS LAST",
)
def _(spark, d):
    rows = spark.createDataFrame([("9",), ("998",), ("1000",), ("-999",), ("\\N",)], "t string")
    return rows.select("t", S.number(D("t")).alias("n")).orderBy(F.desc_nulls_last("n"))


@query("x20_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def _(spark, d):
    return load_all(spark, d, "events")["events"].select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("x21_row_ids", "SELECT o_orderkey, CAST(1 AS BIGINT) AS times, true AS rising FROM orders")
def _(spark, d):
    """Each row's id: how often it occurs, and whether it is above that of the row before it in the row's partition."""
    rows = load_all(spark, d, "orders")["orders"].select("o_orderkey", F.monotonically_increasing_id().alias("id"), F.spark_partition_id().alias("part"))
    before = F.lag("id").over(Window.partitionBy("part").orderBy("id"))
    times = rows.groupBy("id").agg(F.count(F.lit(1)).alias("times"))
    return rows.withColumn("rising", F.coalesce(D("id") > before, F.lit(True))).join(times, "id").select("o_orderkey", "times", "rising")


@query("x22_weight_texts", "SELECT * FROM (VALUES ('a', 3.0::DOUBLE), ('b', 0.5::DOUBLE)) v(id, weight)")
def _(spark, d):
    return spark.createDataFrame(sorted(S.parse_weights(["a:1", "b:0.5", "a:2"]).items()), "id string, weight double")


@query("x23_weighted_blend", "SELECT p_partkey, round(p_size * 0.75 + p_retailprice * 0.25, 6) AS score FROM part")
def _(spark, d):
    return load_all(spark, d, "part")["part"].select("p_partkey", F.round(S.weighted_blend([(D("p_size"), 3.0), (D("p_retailprice"), 1.0)]), 6).alias("score"))


text_query("x24_unit_scale", "events", "SELECT event_id, round(value / 10, 6) AS degrees FROM events WHERE event_type = 'view'")


@query("weather_monthly_average", "SELECT month(ts) AS m, event_type, round(avg(value), 6) AS mean FROM events WHERE value <> -999 GROUP BY month(ts), event_type ORDER BY m, event_type")
def _(spark, d):
    date = S.compact_date(F.date_format("ts", "yyyyMMdd"))
    e = load_all(spark, d, "events")["events"].where(S.without(D("value"), -999.0).isNotNull())
    return e.groupBy(F.month(date).alias("m"), "event_type").agg(F.round(F.avg("value"), 6).alias("mean")).orderBy("m", "event_type")
