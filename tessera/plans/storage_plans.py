"""Sources and sinks: written to the session's shared folder and read back."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalars import round_scaled
from tessera.plans.registry import load_all, query
from tessera.plans.relational import FILTER_AT, FILTER_BITS
from tessera.sources import avro as AVRO
from tessera.sources import readers as IN
from tessera.sources import sinks as OUT
from tessera.sources import sqlite as SQLITE
from tessera.storage import new_path

D = F.col


fresh = new_path


@query("s4_csv_schema", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def _(spark, d):
    path = fresh(spark, "csv")
    load_all(spark, d, "supplier")["supplier"].select("s_suppkey", "s_name", "s_acctbal").write.csv(path)
    return IN.read_csv(spark, path, "s_suppkey long, s_name string, s_acctbal double")


@query("s5_csv_inferred", "SELECT n_nationkey AS nkey, n_name AS name FROM nation")
def _(spark, d):
    path = fresh(spark, "csv")
    n = load_all(spark, d, "nation")["nation"].select(D("n_nationkey").alias(" n.key"), D("n_name").alias("name "))
    n.write.option("header", True).csv(path)
    return IN.read_csv_inferred(spark, path)


@query("s6_gzip_positional", "SELECT CAST(n_nationkey AS VARCHAR) AS a, n_name AS b FROM nation")
def _(spark, d):
    path = fresh(spark, "gz")
    load_all(spark, d, "nation")["nation"].select("n_nationkey", "n_name").write.option("compression", "gzip").csv(path)
    return IN.read_positional(spark, path, ["a", "b"])


@query("s7_tsv_nulls", "SELECT s_suppkey, nullif(s_name, 'Supplier#000000001') AS s_name FROM supplier")
def _(spark, d):
    path = fresh(spark, "tsv")
    s = load_all(spark, d, "supplier")["supplier"]
    name = F.when(D("s_name") == "Supplier#000000001", "\\N").otherwise(D("s_name"))
    s.select("s_suppkey", name.alias("s_name")).write.option("sep", "\t").option("header", True).option("escape", "").csv(path)
    return IN.read_csv(spark, path, "s_suppkey long, s_name string", header=True, sep="\t", null="\\N")


@query("s8_parquet_scan", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity = 50")
def _(spark, d):
    return load_all(spark, d, "lineitem")["lineitem"].where("l_quantity = 50").select("l_orderkey", "l_linenumber")


@query("s9_lookups_as_join", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (1, 2, 3)")
def _(spark, d):
    keys = spark.createDataFrame([(1,), (2,), (3,)], "o_custkey long")
    return load_all(spark, d, "orders")["orders"].join(F.broadcast(keys), "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


@query("s12_small_files", "SELECT n_nationkey, n_name, true AS whole FROM nation")
def _(spark, d):
    path = fresh(spark, "files")
    load_all(spark, d, "nation")["nation"].select("n_nationkey", "n_name").repartition(5).write.json(path)
    f = IN.read_files(spark, path, "*.json").select((F.octet_length("content") == D("size")).alias("whole"), F.explode(F.split(F.trim(F.decode("content", "UTF-8"), F.lit("\n")), "\n")).alias("line"))
    return f.select(F.from_json("line", "n_nationkey int, n_name string").alias("r"), "whole").select("r.n_nationkey", "r.n_name", "whole")


@query("s13_json_lines", "SELECT r_regionkey, r_name FROM region")
def _(spark, d):
    path = fresh(spark, "json")
    OUT.write_json_lines(load_all(spark, d, "region")["region"], path)
    return IN.read_json_lines(spark, path, "r_regionkey int, r_name string")


@query("s15_literal_relation", "SELECT * FROM (VALUES (1, 'a'), (2, 'b')) t(k, v)")
def _(spark, d):
    return spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")


@query("s16_people_generator", "SELECT CAST(1000 AS BIGINT) AS n, true AS graded, true AS repeated, true AS named, true AS spread, true AS again")
def _(spark, d):
    """Names of six letters, ids below 300 that repeat, grades of 0 to 100 all over; the same rows each time."""
    p, again = IN.people(spark, 1000, 300), IN.people(spark, 1000, 300)
    same = p.exceptAll(again).isEmpty() and again.exceptAll(p).isEmpty() and not p.exceptAll(IN.people(spark, 1000, 300, seed=43)).isEmpty()
    return p.agg(
        F.count(F.lit(1)).alias("n"), F.bool_and(D("grade").between(0, 100)).alias("graded"), F.count_distinct("student_id").between(250, 300).alias("repeated"),
        F.bool_and(D("name").rlike("^[A-Z][a-z]{5}$")).alias("named"), (F.avg("grade").between(45, 55) & (F.count_distinct("grade") > 90)).alias("spread"),
    ).withColumn("again", F.lit(same))


@query("k1_parquet_round_trip", "SELECT c_custkey, c_name FROM customer")
def _(spark, d):
    path = fresh(spark, "k1")
    OUT.write_parquet(load_all(spark, d, "customer")["customer"].select("c_custkey", "c_name"), path)
    return spark.read.parquet(path)


@query("k3_json_features", "SELECT vec_id, list_transform(embedding, lambda x: round(x::DOUBLE, 6)) AS v FROM embeddings WHERE vec_id = 3")
def _(spark, d):
    path = fresh(spark, "k3")
    e = load_all(spark, d, "embeddings")["embeddings"].where("vec_id = 3")
    e.select("vec_id", F.to_json(D("embedding").cast("array<double>")).alias("j")).write.json(path)
    text = spark.read.schema("vec_id long, j string").json(path)
    return text.select("vec_id", F.transform(F.from_json("j", "array<double>"), lambda x: round_scaled(x, 6)).alias("v"))


@query("k4_partitioned_write", "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey")
def _(spark, d):
    path = fresh(spark, "k4")
    OUT.write_parquet(load_all(spark, d, "nation")["nation"], path, ["n_regionkey"])
    return spark.read.parquet(path).groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("n"))


@query("k4_avro_file_per_group", "SELECT CAST(n_regionkey AS VARCHAR) || '.avro' AS file, n_nationkey, n_name FROM nation")
def _(spark, d):
    path = fresh(spark, "k4-avro")
    AVRO.write_by_group(load_all(spark, d, "nation")["nation"].select("n_regionkey", "n_nationkey", "n_name"), path, "n_regionkey")
    each = [AVRO.read(spark, f"{path}/{k}.avro").select(F.lit(f"{k}.avro").alias("file"), "n_nationkey", "n_name") for k in range(5)]
    return reduce(DataFrame.unionByName, each)


@query("k5_merge_files", "SELECT s_suppkey AS id, s_name AS name FROM supplier UNION ALL SELECT c_custkey, NULL FROM customer")
def _(spark, d):
    a, b = fresh(spark, "k5"), fresh(spark, "k5")
    t = load_all(spark, d, "supplier", "customer")
    t["supplier"].select(D("s_suppkey").alias("id"), D("s_name").alias("name")).write.parquet(a)
    t["customer"].select(D("c_custkey").alias("id"), D("c_acctbal").alias("other")).write.parquet(b)
    return IN.read_merged(spark, [a, b, fresh(spark, "absent")])


_SUPPLIER = "SELECT s_suppkey, s_name, s_acctbal, s_nationkey FROM supplier"


@query("s1_avro_scan", _SUPPLIER)
def _(spark, d):
    path = fresh(spark, "s1")
    AVRO.write(load_all(spark, d, "supplier")["supplier"].select("s_suppkey", "s_name", "s_acctbal", "s_nationkey"), path, "deflate")
    return IN.read_avro(spark, path)


@query("s3_avro_word_pairs", "SELECT string_split(p_name, ' ')[1] AS key, count(*) AS n FROM part GROUP BY 1")
def _(spark, d):
    """A grouped count over Avro records, as a map and reduce job reads them."""
    path = fresh(spark, "s3")
    AVRO.write(load_all(spark, d, "part")["part"].select("p_partkey", "p_name").repartition(3), path)
    return AVRO.read(spark, path).groupBy(F.split("p_name", " ")[0].alias("key")).agg(F.count(F.lit(1)).alias("n"))


@query("k5_merge_avro", "SELECT s_suppkey AS id, s_name AS name FROM supplier UNION ALL SELECT c_custkey, NULL FROM customer")
def _(spark, d):
    """Several Avro files as one: the first one's columns, a damaged file skipped, the output not read again."""
    path = fresh(spark, "k5-avro")
    t = load_all(spark, d, "supplier", "customer")
    AVRO.write(t["supplier"].select(D("s_suppkey").alias("id"), D("s_name").alias("name")).coalesce(1), path, name="a")
    AVRO.write(t["customer"].select(D("c_custkey").alias("id"), D("c_acctbal").alias("other")).coalesce(1), path, "null", name="b")
    with open(f"{path.removeprefix('file://')}/c-damaged.avro", "wb") as f:
        f.write(b"Obj\x01 not a container")
    merged = fresh(spark, "k5-merged")
    AVRO.write(AVRO.read(spark, path, skip_unreadable=True).coalesce(1), merged, name="whole")
    return AVRO.read(spark, merged)


@query("k6_pack_files", "SELECT CAST(page_id AS VARCHAR) AS filename, sha256(html) AS checksum FROM pages")
def _(spark, d):
    path = fresh(spark, "k6")
    pages = load_all(spark, d, "pages")["pages"].select(D("page_id").cast("string").alias("filename"), D("html").cast("binary").alias("content"))
    OUT.pack_files(pages, path)
    return spark.read.parquet(path).select("filename", "checksum")


@query("k7_verified_unpack", "SELECT CAST(page_id AS VARCHAR) AS filename, html AS text FROM pages")
def _(spark, d):
    path = fresh(spark, "k7")
    pages = load_all(spark, d, "pages")["pages"].select(D("page_id").cast("string").alias("filename"), D("html").cast("binary").alias("content"))
    OUT.pack_files(pages, path)
    return OUT.verified(spark.read.parquet(path)).select("filename", F.decode("content", "UTF-8").alias("text"))


@query("k8_create_table_as", "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey ORDER BY n_regionkey")
def _(spark, d):
    """A table made from a query, in the format asked for, read back by its name."""
    n, name = load_all(spark, d, "nation")["nation"].groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("n")), f"k8_{uuid.uuid4().hex}"
    OUT.create_table_as(spark, name, n, "csv", path=fresh(spark, "k8"))
    return spark.table(name).orderBy("n_regionkey")


@query("k9_insert_many", "SELECT p_partkey, string_split(p_name, ' ')[1] AS word FROM part UNION ALL SELECT p_partkey, string_split(p_name, ' ')[2] FROM part")
def _(spark, d):
    """An empty table, then two inserts into it."""
    p, name = load_all(spark, d, "part")["part"], f"k9_{uuid.uuid4().hex}"
    words = [p.select("p_partkey", F.split("p_name", " ")[k].alias("word")) for k in (0, 1)]
    OUT.create_table_as(spark, name, words[0].limit(0), path=fresh(spark, "k9"))
    for w in words:
        OUT.insert_into(w, name)
    return spark.table(name)


@query("k10_append_metrics", "SELECT * FROM (VALUES ('a', 1.5::DOUBLE), ('b', 2.5::DOUBLE)) t(model, rmse)")
def _(spark, d):
    path = fresh(spark, "k10")
    for row in [("a", 1.5), ("b", 2.5)]:
        OUT.append_metrics(spark.createDataFrame([row], "model string, rmse double"), path)
    return IN.read_csv(spark, path, "model string, rmse double", header=True)


@query("k11_key_values", "SELECT CAST(user_id AS VARCHAR) AS key, CAST(max(event_id) AS VARCHAR) AS value FROM events GROUP BY user_id")
def _(spark, d):
    path = fresh(spark, "k11")
    e = load_all(spark, d, "events")["events"].groupBy(D("user_id").alias("key")).agg(F.max("event_id").alias("value"))
    OUT.write_key_values(e, path)
    return IN.read_positional(spark, path, ["key", "value"], sep="\t")


@query("k12_filter_column", "SELECT added, CASE WHEN added THEN 'all' ELSE 'few' END AS found FROM (SELECT DISTINCT suffix(CAST(c_custkey AS VARCHAR), '7') AS added FROM customer) t")
def _(spark, d):
    """A filter that was written and read finds all that was added, and no more than 3 in 100 of the rest."""
    from tessera.operators import sketch

    path = fresh(spark, "k12")
    c = load_all(spark, d, "customer")["customer"].select("c_custkey", F.endswith(D("c_custkey").cast("string"), F.lit("7")).alias("added"))
    bits = sketch.bits_for(c.where("added").count())
    sketch.build_large(c.where("added"), "c_custkey", bits, 5).write.parquet(path)
    found = sketch.contains_large(c, "c_custkey", spark.read.parquet(path), bits, 5).groupBy("added").agg(F.avg(D("maybe").cast("int")).alias("share"))
    return found.select("added", F.when(D("share") == 1, "all").when(D("share") <= 0.03, "few").otherwise("some").alias("found"))


@query(
    "k12_large_filter",
    f"WITH bits AS (SELECT DISTINCT {FILTER_AT} AS spot FROM (SELECT p_partkey AS x FROM part WHERE p_size > 25)), "
    f"asked AS (SELECT x, {FILTER_AT} AS spot FROM (SELECT DISTINCT l_partkey AS x FROM lineitem)), "
    "maybe AS (SELECT x FROM asked LEFT JOIN bits ON asked.spot = bits.spot GROUP BY x HAVING bool_and(bits.spot IS NOT NULL)) "
    "SELECT l_orderkey, l_linenumber FROM lineitem JOIN maybe ON l_partkey = x",
)
def _(spark, d):
    """Lines of parts that a filter of 100,000 bits, written as a table of bitmaps and read back, may hold."""
    from tessera.operators import sketch

    t, path = load_all(spark, d, "part", "lineitem"), fresh(spark, "k12-large")
    sketch.build_large(t["part"].where("p_size > 25"), "p_partkey", FILTER_BITS).write.parquet(path)
    lines = t["lineitem"].select("l_orderkey", "l_linenumber", "l_partkey")
    return sketch.contains_large(lines, "l_partkey", spark.read.parquet(path), FILTER_BITS).where("maybe").select("l_orderkey", "l_linenumber")


@query("k13_id_vectors", "SELECT vec_id, list_transform(embedding, lambda x: round(x::DOUBLE, 6)) AS v FROM embeddings")
def _(spark, d):
    path = fresh(spark, "k13")
    load_all(spark, d, "embeddings")["embeddings"].select("vec_id", "embedding").write.parquet(path)
    return spark.read.parquet(path).select("vec_id", F.transform("embedding", lambda x: round_scaled(x.cast("double"), 6)).alias("v"))


@query("c1_compact_files", "SELECT o_orderkey, o_totalprice FROM orders")
def _(spark, d):
    a, b = fresh(spark, "c1"), fresh(spark, "c1")
    load_all(spark, d, "orders")["orders"].select("o_orderkey", "o_totalprice").repartition(20).write.parquet(a)
    OUT.compact(spark, a, b)
    return spark.read.parquet(b)


@query("c1_compact_groups", "SELECT CAST(n_regionkey AS VARCHAR) AS file_group, n_nationkey, n_name FROM nation")
def _(spark, d):
    """Many small files in folders, compacted folder by folder."""
    a, b = fresh(spark, "c1"), fresh(spark, "c1")
    load_all(spark, d, "nation")["nation"].select("n_regionkey", "n_nationkey", "n_name").repartition(7).write.partitionBy("n_regionkey").parquet(a)
    OUT.compact(spark, a, b, group_pattern="n_regionkey=([0-9]+)")
    return spark.read.schema("n_nationkey long, n_name string, file_group string").parquet(b).select("file_group", "n_nationkey", "n_name")


@query("s11_recursive_discovery", "SELECT CAST(n_regionkey AS VARCHAR) AS folder, n_nationkey FROM nation")
def _(spark, d):
    """Files found in folders of folders: what each holds, by the folder it lies in."""
    path = fresh(spark, "s11")
    load_all(spark, d, "nation")["nation"].select("n_regionkey", "n_nationkey").coalesce(1).write.partitionBy("n_regionkey").json(f"{path}/deep")
    f = IN.read_files(spark, path, "*.json")
    rows = f.select(F.regexp_extract("filename", "n_regionkey=([0-9]+)", 1).alias("folder"), F.explode(F.split(F.trim(F.decode("content", "UTF-8"), F.lit("\n")), "\n")).alias("line"))
    return rows.select("folder", F.from_json("line", "n_nationkey int")["n_nationkey"].alias("n_nationkey"))


@query("k2_single_json_file", "SELECT CAST(1 AS BIGINT) AS files, n_nationkey, n_name FROM nation")
def _(spark, d):
    path = fresh(spark, "k2")
    OUT.write_json_lines(load_all(spark, d, "nation")["nation"].select("n_nationkey", "n_name").repartition(4), path)
    files = IN.read_files(spark, path, "*.json").agg(F.count(F.lit(1)).alias("files"))
    return IN.read_json_lines(spark, path, "n_nationkey int, n_name string").crossJoin(F.broadcast(files)).select("files", "n_nationkey", "n_name")


@query("s14_lookup_exists", "SELECT count(*) > 0 AS found FROM supplier WHERE lower(s_name) = lower('SUPPLIER#000000003')")
def _(spark, d):
    s = load_all(spark, d, "supplier")["supplier"]
    return spark.sql("SELECT count(*) > 0 AS found FROM {s} WHERE lower(s_name) = lower(:name)", args={"name": "SUPPLIER#000000003"}, s=s)


_DERBY = "org.apache.derby.iapi.jdbc.AutoloadedDriver"


def _shared_files(spark):
    """Whether a database must be files that all executors read: a cluster for which no server is named."""
    master = spark.sparkContext.master
    return not spark.conf.get("spark.tessera.jdbc.url", "") and (not master.startswith("local") or master.startswith("local-cluster"))


def in_database(spark, df, name, types):
    """The table in the database of ``spark.tessera.jdbc.url``, else in one inside this process for a local session: (url, name, driver).

    Columns get upper-case names, so that conditions needn't quote them.
    """
    url = spark.conf.get("spark.tessera.jdbc.url", f"jdbc:derby:memory:tessera{uuid.uuid4().hex};create=true")
    table = f"{name}_{uuid.uuid4().hex[:12]}"
    df.toDF(*[c.upper() for c in df.columns]).write.format("jdbc").options(url=url, dbtable=table, driver=spark.conf.get("spark.tessera.jdbc.driver", _DERBY), createTableColumnTypes=types).save()
    return url, table, spark.conf.get("spark.tessera.jdbc.driver", _DERBY)


@query(
    "s14_parallel_scan",
    "SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'F'",
)
def _(spark, d):
    """Orders loaded into a database and read back by ranges of their key, with a filter that the database runs."""
    orders = load_all(spark, d, "orders")["orders"].select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    if _shared_files(spark):
        files = SQLITE.write(orders, "orders", index="o_orderkey")
        parts = [f"{r} AND o_totalprice > 100000 AND o_orderstatus = 'F'" for r in SQLITE.ranges(files, "orders", "o_orderkey", 6)]
        return SQLITE.read(files, "orders", orders.schema, parts)
    url, table, driver = in_database(spark, orders, "orders", "o_orderstatus VARCHAR(8)")
    back = IN.read_jdbc(spark, url, table, column="o_orderkey", partitions=6, driver=driver)
    return back.where("o_totalprice > 100000 AND o_orderstatus = 'F'").select(*[D(c).alias(c.lower()) for c in back.columns])


@query("s14_scan_by_conditions", "SELECT c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer GROUP BY 1")
def _(spark, d):
    """Customers read by one query for each remainder of their key."""
    customers = load_all(spark, d, "customer")["customer"].select("c_custkey", "c_mktsegment", "c_acctbal")
    if _shared_files(spark):
        back = SQLITE.read(SQLITE.write(customers, "customer"), "customer", customers.schema, [f"c_custkey % 4 = {k}" for k in range(4)])
    else:
        url, table, driver = in_database(spark, customers, "customer", "c_mktsegment VARCHAR(16)")
        back = IN.read_jdbc_parts(spark, url, table, [f"MOD(c_custkey, 4) = {k}" for k in range(4)], driver=driver)
    return back.groupBy(D("c_mktsegment").alias("c_mktsegment")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("s9_database_lookup", "SELECT n_name, count(*) AS suppliers FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey IN (1, 3) GROUP BY n_name")
def _(spark, d):
    """Suppliers by nation, names looked up in a database that filters them itself; one join, no query a row."""
    t = load_all(spark, d, "nation", "supplier")
    nation = t["nation"].select("n_nationkey", "n_name", "n_regionkey")
    if _shared_files(spark):
        names = SQLITE.read(SQLITE.write(nation, "nation"), "nation", nation.schema, ["n_regionkey IN (1, 3)"])
    else:
        url, table, driver = in_database(spark, nation, "nation", "n_name VARCHAR(32)")
        names = IN.read_jdbc(spark, url, table, where="n_regionkey IN (1, 3)", driver=driver)
    return t["supplier"].join(names, D("s_nationkey") == D("n_nationkey")).groupBy(D("n_name").alias("n_name")).agg(F.count(F.lit(1)).alias("suppliers"))


@query("s17_pandas_csv", "SELECT r_regionkey, r_name FROM region")
def _(spark, d):
    """A small file read with a header and inferred types, on the driver as a pandas frame and back."""
    path = fresh(spark, "s17")
    load_all(spark, d, "region")["region"].select("r_regionkey", "r_name").coalesce(1).write.option("header", True).csv(path)
    return spark.createDataFrame(IN.read_csv_inferred(spark, path).toPandas())


@query("p2_partition_closure", "SELECT l_returnflag, max(l_quantity)::DOUBLE AS most FROM lineitem GROUP BY l_returnflag")
def _(spark, d):
    """A Python closure over each partition's batches, then a merge of what the partitions found."""

    def run(batches):
        import numpy as np
        import pandas as pd

        best = {}
        for b in batches:
            for flag, q in b.groupby("l_returnflag", dropna=False)["l_quantity"].max().items():
                flag = None if pd.isna(flag) else flag
                best[flag] = np.fmax(best.get(flag, q), q)
        # a partition may have no rows, and an empty column no type that Arrow could take for text
        if best:
            yield pd.DataFrame({"l_returnflag": pd.Series(list(best), dtype=object), "most": [float(v) for v in best.values()]})

    li = load_all(spark, d, "lineitem")["lineitem"].select("l_returnflag", D("l_quantity").cast("double"))
    return li.mapInPandas(run, "l_returnflag string, most double").groupBy("l_returnflag").agg(F.max("most").alias("most"))


@query("p3_external_programs", "SELECT CAST(user_id AS VARCHAR) AS key, CAST(max(event_id) AS VARCHAR) AS value FROM events GROUP BY user_id")
def _(spark, d):
    """A mapper and a reducer that are programs of their own, reading and writing lines."""
    from tessera.operators.external import map_reduce

    lines = load_all(spark, d, "events")["events"].select(F.concat_ws(",", D("event_id"), D("user_id")).alias("line"))
    mapper = ["awk", "-F,", "{print $2 \"\\t\" $1}"]
    reducer = ["awk", "-F\\t", "NR == 1 || $1 \"\" != key \"\" {if (NR > 1) print key \"\\t\" most; key = $1; most = $2} $2 + 0 > most + 0 {most = $2} END {if (NR) print key \"\\t\" most}"]
    return map_reduce(lines, mapper, reducer)
