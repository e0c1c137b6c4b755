"""Avro containers, packed files, compaction, external programs and databases."""

import datetime
import json
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from tessera.operators import external
from tessera.sources import avro, readers, sinks

KINDS = "i int, l long, f float, d double, b boolean, s string, x binary, a array<int>, m map<string, double>, r struct<p: string, q: array<struct<z: long>>>, day date, at timestamp"


def odd_rows():
    at = datetime.datetime(2020, 2, 29, 23, 59, 59, 123456)
    return [
        (1, 2**62, 0.5, -1e300, True, "é日本\n", b"\x00\xff", [1, None, -7], {"k": 1.5, "n": None}, ("p", [(5,), (None,)]), datetime.date(1969, 7, 20), at),
        (-(2**31), -(2**63), float("inf"), 0.0, False, "", b"", [], {}, (None, []), datetime.date(9999, 12, 31), datetime.datetime(1960, 1, 1)),
        tuple([None] * 12),
    ]


@pytest.mark.parametrize("codec", ["null", "deflate", "snappy"])
def test_avro_round_trip(spark, tmp_path, codec):
    df = spark.createDataFrame(odd_rows() * 40, KINDS).repartition(3)
    assert avro.write(df, str(tmp_path), codec) == 3
    back = readers.read_avro(spark, str(tmp_path))
    assert back.dtypes == df.dtypes
    assert sorted(map(repr, back.collect())) == sorted(map(repr, df.collect()))
    assert not list(tmp_path.glob("*.part"))


def by_hand(schema, body, codec="null", sync=b"s" * 16, count=1):
    meta = {b"avro.schema": json.dumps(schema).encode(), b"avro.codec": codec.encode()}
    head = avro.zigzag(len(meta)) + b"".join(avro.zigzag(len(k)) + k + avro.zigzag(len(v)) + v for k, v in meta.items()) + b"\x00"
    return avro.MAGIC + head + sync + avro.zigzag(count) + avro.zigzag(len(body)) + body + sync


def test_avro_of_other_writers(spark, tmp_path):
    """Enums, fixed bytes, names used again, blocks of arrays with a size, millisecond times, unions of int and long."""
    pair = {"type": "record", "name": "pair", "namespace": "n", "fields": [{"name": "v", "type": "int"}]}
    schema = {"type": "record", "name": "row", "fields": [
        {"name": "e", "type": {"type": "enum", "name": "e", "symbols": ["no", "yes"]}}, {"name": "h", "type": {"type": "fixed", "name": "h", "size": 2}},
        {"name": "p", "type": pair}, {"name": "q", "type": ["null", "n.pair"]}, {"name": "a", "type": {"type": "array", "items": "string"}},
        {"name": "t", "type": {"type": "long", "logicalType": "timestamp-millis"}}, {"name": "u", "type": ["int", "long", "null"]},
    ]}
    z = avro.zigzag
    body = z(1) + b"\x01\x02" + z(7) + z(1) + z(8) + z(-2) + z(4) + z(1) + b"x" + z(1) + b"y" + z(0) + z(1500) + z(1) + z(2**40)
    (tmp_path / "a.avro").write_bytes(by_hand(schema, body))
    packer = zlib.compressobj(9, zlib.DEFLATED, -15)
    (tmp_path / "b.avro").write_bytes(by_hand(schema, packer.compress(body + body) + packer.flush(), "deflate", count=2))
    rows = avro.read(spark, str(tmp_path)).collect()
    assert len(rows) == 3 and len(set(map(repr, rows))) == 1
    r = rows[0]
    assert (r.e, bytes(r.h), r.p.v, r.q.v, r.a, r.u) == ("yes", b"\x01\x02", 7, 8, ["x", "y"], 2**40) and r.t.microsecond == 500_000


def test_avro_faults(spark, tmp_path):
    """Damaged files raise, or are skipped; the first file's columns count; an own output isn't read."""
    spark_rows = spark.createDataFrame([(1, "a"), (2, "b")], "id int, s string").coalesce(1)
    avro.write(spark_rows, str(tmp_path), name="a")
    avro.write(spark.createDataFrame([(3, 4.0)], "id int, other double").coalesce(1), str(tmp_path), name="b")
    good = next(tmp_path.glob("b-*.avro")).read_bytes()
    assert sorted((r.id, r.s) for r in avro.read(spark, str(tmp_path)).collect()) == [(1, "a"), (2, "b"), (3, None)]
    (tmp_path / "c.avro").write_bytes(good[:-20])
    (tmp_path / "d.avro").write_bytes(good[:-1] + b"!")
    (tmp_path / "e.avro").write_bytes(b"nothing")
    (tmp_path / "merged.avro").write_bytes(good)
    got = avro.read(spark, str(tmp_path), skip_unreadable=True, exclude="merged.avro")
    assert sorted((r.id, r.s) for r in got.collect()) == [(1, "a"), (2, "b"), (3, None)]
    with pytest.raises(Exception, match="not an Avro|cut short|sync"):
        avro.read(spark, str(tmp_path)).collect()
    with pytest.raises(FileNotFoundError):
        avro.read(spark, str(tmp_path), pattern="e.avro", skip_unreadable=True)
    raw = pytest.importorskip("pyarrow").Codec("snappy").compress(b"abc", asbytes=True)
    assert avro.inflate("snappy", raw + struct.pack(">I", zlib.crc32(b"abc"))) == b"abc"
    with pytest.raises(avro.DamagedFile):
        avro.inflate("snappy", raw + b"0000")


def test_avro_file_per_group(spark, tmp_path):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), "id")
    assert avro.write_by_group(df, f"file://{tmp_path}", "g") == 3
    assert sorted(p.name for p in tmp_path.iterdir()) == ["0.avro", "1.avro", "2.avro"]
    assert avro.read(spark, f"{tmp_path}/1.avro").agg(F.count("*"), F.min("g"), F.max("g")).first()[:] == (333, 1, 1)


def test_unpack_keeps_folders(spark, tmp_path):
    """Files of one name in several folders stay apart; names that leave the folder or repeat are refused."""
    rows = lambda names: spark.createDataFrame([(n, n.encode()) for n in names], "filename string, content binary").withColumn("checksum", F.sha2("content", 256))
    names = ["/data/x/a.txt", "file:/data/y/a.txt", "file:///data/a.txt", "b/c.txt"]
    assert sinks.unpack_files(rows(names), str(tmp_path / "out"), root="file:///data") == 4
    found = {str(p.relative_to(tmp_path / "out")): p.read_bytes().decode() for p in (tmp_path / "out").rglob("*") if p.is_file()}
    assert found == {"x/a.txt": names[0], "y/a.txt": names[1], "a.txt": names[2], "b/c.txt": names[3]}
    for bad in (["../up.txt"], ["a/../../b.txt"], ["/"], ["a.txt", "/a.txt"]):
        with pytest.raises(ValueError, match="below the folder|several files"):
            sinks.unpack_files(rows(bad), str(tmp_path / "no"))
    assert not (tmp_path / "no").exists()


def test_compaction(spark, tmp_path):
    """Small files become few, by group where asked, and a large group more than one file."""
    df = spark.range(30_000).select((F.col("id") % 3 * F.col("id") % 2).alias("g"), F.sha2(F.col("id").cast("string"), 256).alias("s"))
    df.repartition(12).write.partitionBy("g").parquet(str(tmp_path / "in"))
    sinks.compact(spark, str(tmp_path / "in"), str(tmp_path / "one"))
    assert len(list((tmp_path / "one").glob("*.parquet"))) == 1
    sinks.compact(spark, str(tmp_path / "in"), str(tmp_path / "groups"), target_bytes=300_000, group_pattern="g=([0-9]+)")
    files = {g: len(list((tmp_path / "groups" / f"file_group={g}").glob("*.parquet"))) for g in (0, 1)}
    assert files[0] > files[1] >= 1 and sum(files.values()) < 12
    back = spark.read.parquet(str(tmp_path / "groups"))
    assert back.groupBy("file_group").count().orderBy("file_group").collect()[:] == df.groupBy("g").count().orderBy("g").collect()[:]
    assert back.select("s").exceptAll(df.select("s")).isEmpty() and back.count() == 30_000


def test_external_programs(spark):
    lines = spark.createDataFrame([("b",), ("a é",), (None,), ("",)], "line string").coalesce(1)
    assert sorted(r.line for r in external.pipe(lines, ["cat"]).collect()) == ["", "a é", "b"]
    assert external.pipe(lines, ["head", "-n", "1"]).count() == 1
    assert external.pipe(spark.range(200_000).select(F.col("id").cast("string").alias("line")).coalesce(1), ["tail", "-n", "1"]).first().line == "199999"
    with pytest.raises(Exception, match="status 3"):
        external.pipe(lines, ["sh", "-c", "cat > /dev/null; exit 3"]).collect()


def test_database(spark, tmp_path):
    """A table written to and read from a database over JDBC, with a filter that the database runs."""
    url, driver = f"jdbc:derby:{tmp_path}/db;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    rows = spark.createDataFrame([(1, "Björk"), (2, "björk"), (3, "other")], "id int, name string")
    rows.write.format("jdbc").option("url", url).option("dbtable", "artists").option("driver", driver).save()
    table = readers.read_jdbc(spark, url, "artists", driver=driver)
    assert table.where("id > 1").count() == 2
    found = table.where(F.lower("name") == "björk")
    assert sorted(r[0] for r in found.select("id").collect()) == [1, 2]
    assert "WHERE" in found._jdf.queryExecution().executedPlan().toString() or "PushedFilters: [IsNotNull(" in table.where("id > 1")._jdf.queryExecution().executedPlan().toString().replace("*", "")


def test_database_in_parts(spark):
    """Ranges and conditions are queries of their own, filters go to the database, and no row is lost or read twice."""
    url, driver = "jdbc:derby:memory:parts;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    rows = spark.createDataFrame([(None if i == 7 else i * i, f"n{i % 5}") for i in range(100)], "ID int, NAME string")
    rows.write.format("jdbc").options(url=url, dbtable="t", driver=driver, createTableColumnTypes="NAME VARCHAR(8)").save()
    table = readers.read_jdbc(spark, url, "t", column="ID", partitions=5, driver=driver)
    assert table.rdd.getNumPartitions() == 5 and table.exceptAll(rows).isEmpty() and table.count() == 100
    found = table.where("ID > 50 AND NAME = 'n3'")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(ID,50)" in plan and "EqualTo(NAME,n3)" in plan and found.count() == sum(i % 5 == 3 and i * i > 50 for i in range(100))
    some = readers.read_jdbc(spark, url, "t", column="ID", where="NAME = 'n2'", driver=driver)
    assert some.count() == 20  # the null key's row as well
    assert readers.read_jdbc(spark, url, "t", column="ID", where="ID = 9", driver=driver).count() == 1
    assert readers.read_jdbc(spark, url, "t", column="ID", where="ID < 0", driver=driver).count() == 0
    parts = readers.read_jdbc_parts(spark, url, "t", [f"NAME = 'n{k}'" for k in range(5)], driver=driver)
    assert parts.rdd.getNumPartitions() == 5 and parts.exceptAll(rows).isEmpty() and parts.count() == 100


def test_tables_by_name(spark, tmp_path):
    first = spark.range(3).select("id", (F.col("id") * 2).alias("v"))
    sinks.create_table_as(spark, "made", first, path=str(tmp_path / "made"))
    sinks.insert_into(first.where("id = 1"), "made")
    assert spark.table("made").agg(F.sum("v"), F.count("*")).first()[:] == (8, 4)
    spark.sql("DROP TABLE made")


def test_sqlite_files(spark):
    """Rows written by several tasks come back once each, by ranges of a column with nulls; NaN is refused."""
    from tessera.sources import sqlite

    rows = [(k if k % 50 else None, k / 3, f"n'{k}" if k % 7 else None) for k in range(-100, 900)]
    df = spark.createDataFrame(rows, "id long, x double, name string").repartition(3)
    files = sqlite.write(df, "t", index="id")
    parts = sqlite.ranges(files, "t", "id", 6)
    assert files.count() == 3 and len(parts) == 6
    key = lambda r: repr(tuple(r))
    assert sorted(map(key, sqlite.read(files, "t", df.schema, parts).collect())) == sorted(map(key, rows))
    assert sqlite.read(files, "t", df.schema, ["name = 'n''5'"]).collect()[0]["id"] == 5
    assert sqlite.read(sqlite.write(df.limit(0), "t"), "t", df.schema).count() == 0
    with pytest.raises(Exception, match="NaN"):
        sqlite.write(df.selectExpr("id", "double('NaN') AS x"), "t")


@pytest.mark.parametrize("name", ["s14_parallel_scan", "s14_scan_by_conditions", "s9_database_lookup"])
def test_database_queries_of_a_cluster(spark, monkeypatch, name):
    """Where executors are processes of their own no embedded database is opened, and the rows are the same."""
    from tessera.plans import storage_plans
    from tessera.plans.registry import QUERIES

    want = sorted(map(tuple, QUERIES[name](spark, "/root/testdata/sf0.001").collect()))
    monkeypatch.setattr(storage_plans, "_shared_files", lambda spark: True)
    monkeypatch.setattr(storage_plans, "in_database", None)
    assert sorted(map(tuple, QUERIES[name](spark, "/root/testdata/sf0.001").collect())) == want
