"""Golden factors, round trips, and edge cases of the operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import scalars, vector
from tessera.operators import features, graph, linalg, ml, recommend, relational, sketch
from tessera.sources import readers, sinks

SIX = [
    [6.0, 1.0, 2.0, 0.0, 1.0, 0.0],
    [1.0, 7.0, 0.0, 1.0, 0.0, 2.0],
    [2.0, 0.0, 8.0, 1.0, 1.0, 0.0],
    [0.0, 1.0, 1.0, 9.0, 0.0, 1.0],
    [1.0, 0.0, 1.0, 0.0, 5.0, 1.0],
    [0.0, 2.0, 0.0, 1.0, 1.0, 6.0],
]


def coordinates(spark, m):
    return spark.createDataFrame([(i, j, float(m[i][j])) for i in range(len(m)) for j in range(i + 1)], "i int, j int, v double")


@pytest.mark.parametrize(
    ("matrix", "factor"),
    [([[25, -50], [-50, 101]], [[5, 0], [-10, 1]]), ([[25, 15, -5], [15, 18, 0], [-5, 0, 11]], [[5, 0, 0], [3, 3, 0], [-1, 1, 3]]), (SIX, np.linalg.cholesky(SIX))],
)
def test_cholesky(spark, matrix, factor):
    n = len(matrix)
    f = linalg.cholesky(coordinates(spark, matrix), n)
    got = np.zeros((n, n))
    for r in f.collect():
        got[r.i, r.j] = r.v
    assert np.allclose(got, factor)
    back = {(r.i, r.j): r.v for r in linalg.product_with_transpose(f).collect()}
    assert all(back[i, j] == pytest.approx(matrix[i][j]) for i in range(n) for j in range(i + 1))


def test_cholesky_refuses(spark):
    with pytest.raises(ValueError, match="missing"):
        linalg.cholesky(coordinates(spark, [[4, 1], [1, 3]]).where("i = j"), 2)
    with pytest.raises(ValueError, match="positive"):
        linalg.cholesky(coordinates(spark, [[1, 2], [2, 1]]), 2)


@pytest.mark.parametrize("n", [1, 2, 5, 8])
def test_lu(n):
    a = np.random.default_rng(n).normal(size=(n, n))
    p, lower, u = linalg.lu(a.tolist())
    assert np.allclose(p @ a, lower @ u) and np.allclose(np.triu(u), u) and np.allclose(np.tril(lower), lower) and (np.abs(lower) <= 1 + 1e-12).all()


def test_bloom(spark):
    ids = spark.range(0, 500).select(F.col("id"), (F.col("id") % 3).alias("g"))
    each = sketch.build(ids, "id", 8000, 5, ["g"])
    whole = sketch.build(ids, "id", 8000, 5)
    assert bytes(sketch.merge(each).first()["filter"]) == bytes(whole.first()["filter"])
    got = sketch.contains(spark.range(0, 3000), "id", whole, 8000, 5)
    assert got.where("id < 500 AND NOT maybe").count() == 0
    assert got.where("id >= 500 AND maybe").count() < 100


def test_vectors(spark):
    rows = [(1, [1.0, float("nan"), 3.0], [1.0, 5.0, 3.0]), (2, [0.0, 0.0, 0.0], [1.0, 0.0, 0.0]), (3, None, [1.0]), (4, [3.0, 4.0], [4.0, 3.0])]
    df = spark.createDataFrame(rows, "id int, a array<double>, b array<double>")
    got = {r.id: r for r in df.select("id", vector.cosine(F.col("a"), F.col("b")).alias("c"), vector.fit_length(F.col("a"), 3).alias("p"), vector.normalise(F.col("a")).alias("n")).collect()}
    assert got[1].c == pytest.approx(10 / (np.sqrt(10) * np.sqrt(35))) and got[2].c == float("-inf") and got[4].c == pytest.approx(0.96)
    assert got[3].p == [0.0] * 3 and got[4].p == [3.0, 4.0, 0.0] and got[2].n == [0.0] * 3 and got[4].n == pytest.approx([0.6, 0.8])


def test_paths(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (9, 9)], "src int, dst int")
    pairs = spark.createDataFrame([(1, 1), (1, 5), (5, 1), (1, 9), (7, 1), (7, 7), (2, 1)], "src int, dst int")
    got = {(r.src, r.dst): r.distance for r in graph.shortest_paths(edges, pairs).collect()}
    assert got == {(1, 1): 0, (1, 5): 4, (5, 1): -1, (1, 9): -1, (7, 1): -1, (7, 7): -1, (2, 1): 2}
    assert {(r.src, r.dst): r.distance for r in graph.shortest_paths(edges, pairs, depth=3).collect()}[1, 5] == -1
    scores = {r.id: r.score for r in graph.proximity_scores(edges, spark.createDataFrame([(1,), (2,)], "seed int"), 2).collect()}
    assert scores == {2: 1.0, 3: 1.5, 1: 0.5, 4: 0.5}


def test_bucket_join_finds_most(spark):
    from pyspark.ml.functions import array_to_vector

    x = np.random.default_rng(1).normal(size=(150, 6))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, v array<double>").select("id", array_to_vector("v").alias("features"))
    got = {(r.src, r.dst) for r in graph.bucket_edges(df, 1.5, bucket=2.0, tables=6, seed=7).collect()}
    want = {(i, j) for i in range(150) for j in range(150) if i != j and np.linalg.norm(x[i] - x[j]) < 1.5}
    assert got <= want and len(got) >= 0.9 * len(want)


def test_recommend(spark):
    items = spark.createDataFrame(
        [(1, 10, 0.5, [1.0, 0.0]), (2, 11, float("nan"), [1.0, 0.1]), (3, 11, 0.9, [0.0, 1.0]), (4, 12, None, [1.0, 1.0]), (5, 99, 0.9, [1.0, 0.0])],
        "item int, owner int, hotness double, v array<double>",
    )
    edges = spark.createDataFrame([(10, 11), (11, 12)], "src int, dst int")
    assert [r["item"] for r in recommend.bfs_recommend(edges, items, 1).collect()] == [2, 4, 3]
    assert [r["item"] for r in recommend.bfs_recommend(edges, items, 1, candidates=1).collect()] == [3]
    assert [r["item"] for r in recommend.bfs_recommend(edges, items, 1, mode="last_frontier").collect()] == [4]


def test_nearest(spark):
    x = np.random.default_rng(2).normal(size=(60, 5))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, v array<double>")
    got = {}
    for r in recommend.exact_nearest(df, df.where("id % 7 = 0"), 4, most_queries=3).collect():
        got.setdefault(r.query, []).append((-r.similarity, r.id))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q, found in got.items():
        s = unit @ unit[q]
        assert [i for _, i in sorted(found)] == [i for i in np.argsort(-s) if i != q][:4]
    assert len(got) == 9


def test_row_numbers_and_split(spark):
    df = spark.range(0, 1000).select(((F.col("id") * 7919) % 1000).alias("k"))
    assert all(r.k + 1 == r.row_number for r in relational.row_numbers(df, "k").collect())
    train, test = relational.split_by_position(df, 0.9, "k")
    assert train.count() == 900 and test.agg(F.min("k")).first()[0] == 900


def test_features_of_one_row_and_bad_width(spark):
    df = spark.createDataFrame([("a", [[1.0, 2.0]]), ("b", [[1.0, 2.0], [3.0, 6.0]])], "id string, m array<array<double>>")
    got = {r.id: r.features for r in features.mean_and_covariance_of_rows(df, "id", "m", 2).collect()}
    assert got == {"a": [1.0, 2.0, None, None, None], "b": [2.0, 4.0, 2.0, 4.0, 8.0]}
    with pytest.raises(Exception, match="must have 3"):
        features.mean_and_covariance_of_rows(df, "id", "m", 3).collect()


def test_rounded_means_add_up_in_order(spark, tmp_path, monkeypatch):
    """Means on a half of the fourth decimal: as sums in the rows' order give them, whatever the partitions."""
    import pandas as pd

    rng = np.random.default_rng(41)
    cents = rng.integers(100_000, 10_000_000, (400, 32))
    cents[:, 0] += (4 - cents.sum(1)) % 8  # the 32nd part of 8k + 4 cents has four decimals and a half
    prices = cents / 100
    rows = pd.DataFrame({"k": np.tile(np.arange(400), 32), "x": prices.T.ravel(), "y": np.repeat(np.arange(32.0), 400)})
    rows.loc[rows.k == 399, "k"] = None
    for part, at in enumerate(np.array_split(np.arange(len(rows)), 5)):
        rows.iloc[at].astype({"k": "Int64"}).to_parquet(tmp_path / f"part-{part}.parquet")
    df = spark.read.parquet(str(tmp_path))
    nulls = df.withColumn("y", F.when(F.col("y") > 0, F.col("y")))
    for frame, most in ((df, features.MOST_BROADCAST), (nulls, features.MOST_BROADCAST), (df, 0)):
        monkeypatch.setattr(features, "MOST_BROADCAST", most)
        found = features.rounded_mean_and_covariance(frame, "k", ["x", "y"], [F.col("_metadata.file_path"), F.col("_metadata.row_index")]).collect()
        got = {399 if r.k is None else r.k: r.features for r in found}
        assert len(found) == len(got) == 400
        for k, x in enumerate(prices.tolist()):
            total = 0.0
            for v in x:
                total += v
            assert got[k][0] == np.floor(total / 32 * 1e4 + 0.5) / 1e4
    # what is near no half is as it was
    plain = {399 if r.k is None else r.k: r.features for r in features.mean_and_covariance(df, "k", ["x", "y"]).collect()}
    got = {399 if r.k is None else r.k: r.features for r in features.rounded_mean_and_covariance(df, "k", ["x", "y"], [F.col("_metadata.file_path"), F.col("_metadata.row_index")]).collect()}
    assert all(got[k] == pytest.approx(plain[k], abs=0.0051) for k in got)
    assert any(got[k][0] != np.floor(plain[k][0] * 1e4 + 0.5) / 1e4 for k in got)  # some do depend on the order


def test_rounded_means_add_up_row_groups(spark, tmp_path):
    """Means on a half of the fourth decimal: as sums of the row groups' sums give them, as of threads that have one each."""
    import pandas as pd

    rng = np.random.default_rng(42)
    cents = rng.integers(100_000, 10_000_000, (400, 32))
    cents[:, 0] += (4 - cents.sum(1)) % 8
    prices = cents / 100
    rows = pd.DataFrame({"k": np.tile(np.arange(400), 32), "x": prices.T.ravel(), "y": np.repeat(np.arange(32.0), 400)})
    folder = tmp_path / "a b.parquet"
    folder.mkdir()
    rows.iloc[:6400].to_parquet(folder / "part 0.parquet", row_group_size=3200)
    rows.iloc[6400:].to_parquet(folder / "part 1.parquet", row_group_size=3200)
    df = spark.read.parquet(str(folder))
    for frame in (df, df.withColumn("y", F.when(F.col("y") > 0, F.col("y")))):
        at = features.in_row_groups(frame, ["k", "x", "y"])
        assert {(r.part, r["count"]) for r in at.groupBy("part").count().collect()} == {(k, 3200) for k in range(4)}
        order = [F.col("part"), F.col("row")]
        got = {r.k: r.features for r in features.rounded_mean_and_covariance(at, "k", ["x", "y"], order, part=F.col("part")).collect()}
        plain = {r.k: r.features for r in features.mean_and_covariance(frame, "k", ["x", "y"]).collect()}
        other = 0
        for k, x in enumerate(prices.tolist()):
            parts = [0.0] * 4
            for i, v in enumerate(x):
                parts[i // 8] += v
            whole, each = np.add.accumulate(parts)[-1], np.add.accumulate(x)[-1]
            assert got[k][0] == np.floor(whole / 32 * 1e4 + 0.5) / 1e4
            assert got[k] == pytest.approx(plain[k], abs=0.0051)
            other += got[k][0] != np.floor(each / 32 * 1e4 + 0.5) / 1e4
        assert other  # some do depend on it


def test_descent_learns(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(800, 2))
    y = (x @ [2.0, -1.0] + 0.3 > 0).astype(float)
    df = spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y, strict=True)], "a double, b double, label double")
    for method, more in [("batch", {"rate": 1.0}), ("steepest", {"rate": 0.3}), ("averaged", {"rate": 0.2}), ("stochastic", {"rate": 1.0, "fraction": 0.2})]:
        w = ml.descend(df, ["a", "b"], method, rounds=15, **more)
        assert ml.accuracy(ml.classify_with(df, ["a", "b"], w)).first()[0] > 0.9, method


def test_pack_and_unpack(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    (source / "deep").mkdir(parents=True)
    out.mkdir()
    contents = {"a.txt": b"line\r\nno end", "b.txt": b"", "c.txt": bytes(range(256))}
    for k, (name, body) in enumerate(contents.items()):
        ((source / "deep") if k else source).joinpath(name).write_bytes(body)
    (source / "skip.bin").write_bytes(b"x")
    sinks.pack_files(readers.read_files(spark, str(source), "*.txt"), str(tmp_path / "packed"))
    packed = spark.read.parquet(str(tmp_path / "packed"))
    contents.pop("b.txt")  # Spark passes over empty files
    assert sinks.unpack_files(packed, str(out), root=str(source)) == 2
    assert {p.name: p.read_bytes() for p in out.rglob("*.txt")} == contents and (out / "deep" / "c.txt").exists()
    with pytest.raises(Exception, match="checksum mismatch"):
        sinks.verified(packed.withColumn("checksum", F.lit("0"))).collect()


def test_scalars(spark):
    assert scalars.parse_weights(["a:1", "a:2.5", "x:y:3"]) == {"a": 3.5, "x:y": 3.0}
    for bad in ("a", ":1", "a:b"):
        with pytest.raises(ValueError):
            scalars.parse_weights([bad])
    row = spark.sql("SELECT '1999-02-03' AS a, '0000-00-00' AS b, '20200230' AS c, '20200229' AS d").select(
        scalars.date_year(F.col("a")).alias("a"), scalars.date_year(F.col("b")).alias("b"), scalars.compact_date(F.col("c")).alias("c"), scalars.compact_date(F.col("d")).alias("d")
    )
    assert tuple(map(str, row.first())) == ("1999", "None", "None", "2020-02-29")


def test_exists_all(spark):
    e = spark.createDataFrame([(1, 5), (1, 50), (2, 5), (3, None)], "k int, v int")
    keys = spark.createDataFrame([(1,), (2,), (3,), (4,)], "k int")
    assert [r.k for r in relational.exists_all(keys, e, "k", [F.col("v") < 10, F.col("v") > 40]).collect()] == [1]


def test_stream(spark, tmp_path):
    from tessera.streaming.running import running_max

    spark.createDataFrame([(1, 2.0), (1, 5.0), (2, -3.0)], "k int, v double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k int, v double").parquet(str(tmp_path / "in"))
    q = running_max(stream, "k", "v").writeStream.outputMode("complete").format("memory").queryName("peaks").start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.sql("SELECT * FROM peaks").collect()} == {(1, 5.0), (2, -3.0)}


def test_cosine_matrix_keeps_every_seed(spark):
    seeds = spark.range(10_050).select(F.col("id").alias("seed"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("v"))
    points = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, v array<double>")
    got = recommend.cosine_matrix(points, seeds)
    assert got.count() == 20_100 and got.select("seed").distinct().count() == 10_050


def cosines(spark, sf="/root/testdata/sf0.01"):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    x = np.array([r.embedding for r in rows], float)
    return np.array([r.vec_id for r in rows]), x, x / np.linalg.norm(x, axis=1, keepdims=True)


def recall(found, want):
    """Share of the wanted pairs that are found; nothing else may be found."""
    return len(found & want) / max(len(want), 1)


def test_indexes_find_most_neighbours(spark):
    """LSH and HNSW against brute force: at least nine tenths of each query's nearest."""
    from tessera.operators import hnsw

    ids, _, unit = cosines(spark)
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    queries = [i for i in ids.tolist() if i % 100 == 0]
    at = {i: k for k, i in enumerate(ids.tolist())}
    best = lambda q: [int(ids[j]) for j in np.argsort(-(unit @ unit[at[q]]), kind="stable") if ids[j] != q][:10]
    want = {(q, i) for q in queries for i in best(q)}
    for rows in (5000, 150):
        index = hnsw.build_index(e, shard_rows=rows)
        got = {(r["query"], r["id"]) for r in hnsw.nearest(index, e.where("id % 100 = 0"), 10).collect()}
        assert recall(got, want) >= 0.95 and len(got) == len(want)
    model, rows = recommend.lsh_index(e, bucket=0.5, tables=5, seed=42)
    hits = 0
    for q in queries[:3]:
        near = recommend.lsh_recommend(model, rows, unit[at[q]].tolist(), [q], 10).collect()
        hits += len({(q, r["id"]) for r in near} & want)
    assert hits >= 0.9 * 30


def test_hnsw_shards_do_not_grow_as_the_rows(spark):
    """As many shards for more rows, and a graph of more rows than a layer's width still finds most neighbours."""
    from tessera.operators import hnsw

    few = [hnsw.build_index(spark.range(n).selectExpr("id", "array(double(id), 1.0D) AS v").repartition(4)).select("shard").count() for n in (900, 33_000, 50_000)]
    assert few[0] == 1 and few[1] == few[2] <= hnsw.SHARDS
    v = hnsw._unit(np.random.default_rng(3).normal(size=(6000, 32)).astype(np.float32))
    graph = hnsw.Graph(v)
    hits = sum(len({i for _, i in graph.nearest(v[q], 11, 200)} & set(np.argsort(-(v @ v[q]))[:11].tolist())) for q in range(0, 6000, 200))
    assert hits >= 0.95 * 11 * 30


def test_hnsw_of_odd_tables(spark):
    from tessera.operators import hnsw

    df = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.0]), ("b", [1.0, 0.0]), ("c", [0.0, 0.0])], "id string, v array<double>")
    got = hnsw.nearest(hnsw.build_index(df), df.where("id = 'a'"), 2).collect()
    assert [(r["query"], r["id"], r["similarity"]) for r in got] == [("a", "b", 1.0)] * 2
    empty = hnsw.build_index(df.limit(0))
    assert empty.count() == 0 and hnsw.nearest(empty, df, 2).count() == 0 and hnsw.nearest(hnsw.build_index(df), df.limit(0), 2).count() == 0


def test_bucket_joins_of_the_queries(spark):
    """The registered joins find only pairs within their limits, and nine tenths of those."""
    from tessera.plans.registry import QUERIES

    d = "/root/testdata/sf0.01"
    ids, x, unit = cosines(spark)

    def within(points, limit):
        gaps = np.linalg.norm(points[:, None, :] - points[None, :, :], axis=2)
        return {(int(ids[i]), int(ids[j])) for i, j in zip(*np.nonzero(gaps < limit), strict=True) if i != j}

    scaled = (x - x.mean(0)) / x.std(0, ddof=1)
    _, _, axes = np.linalg.svd(scaled - scaled.mean(0), full_matrices=False)
    found = {(r.src, r.dst) for r in QUERIES["j11_bucket_self_join"](spark, d).collect()}
    want = within(unit, 1.2)
    assert found <= want and recall(found, want) >= 0.9
    for name, points, limit in (("g1_similarity_graph", scaled @ axes[:3].T, 1.25), ("g2_item_graph", scaled, 9.0)):
        found = {(r.id, n) for r in QUERIES[name](spark, d).collect() for n in r.neighbors}
        want = within(points, limit)
        assert want and len(found - want) <= 0.001 * len(want) and recall(found, want) >= 0.9, name


def test_dense_buckets_are_dealt_out(spark):
    """One bucket with all rows, in chunks: as a plain loop finds."""
    from pyspark.ml.functions import array_to_vector

    x = np.random.default_rng(5).normal(size=(300, 3)) * 0.1 + 7
    df = spark.createDataFrame([(f"p{i}", v.tolist()) for i, v in enumerate(x)], "id string, v array<double>").select("id", array_to_vector("v").alias("features"))
    got = {(r.src, r.dst) for r in graph.bucket_edges(df, 0.1, bucket=100.0, tables=1, chunk=40).collect()}
    assert got == {(f"p{i}", f"p{j}") for i in range(300) for j in range(300) if i != j and np.linalg.norm(x[i] - x[j]) < 0.1}


def test_lists_of_dense_buckets_are_made_without_pairs(spark, monkeypatch):
    """Where most rows share buckets no pair is shuffled, and the lists are those of the way by buckets, whatever the ids' type."""
    monkeypatch.setattr(graph, "CHUNK", 37)
    monkeypatch.setattr(graph, "BITS", 250 * 20)
    x = np.random.default_rng(8).normal(size=(250, 3))
    df = spark.createDataFrame([(i * 7 % 250, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").repartition(3)
    odd = df.unionByName(spark.createDataFrame([(None, [0.0, 0.0, 0.0])], "id long, v array<double>"))
    for kind in (odd, df.selectExpr("concat('p', id) AS id", "v")):
        found = {}
        for dense in (0.25, float("inf")):
            monkeypatch.setattr(graph, "DENSE", dense)
            lists = graph.similarity_graph(kind, 0.7, components=3, bucket=3.0, tables=2)
            found[dense] = {r.id: r.neighbors for r in lists.collect()}
            assert ("collect_list" in lists._jdf.queryExecution().executedPlan().toString()) == (dense > 1)
        assert found[0.25] == found[float("inf")] and len(found[0.25]) > 200
        assert all(i not in near and near == sorted(near) for i, near in found[0.25].items())
    assert graph.similarity_graph(df.limit(1), 0.7, components=None).count() == 0


def test_pairs_of_several_shared_buckets_leave_one_block(spark, monkeypatch):
    """What is shuffled after the comparison has each pair once in either direction, not once a table, and nothing makes pairs distinct."""
    from pyspark.ml.functions import array_to_vector

    from tessera.operators.neighbours import projections

    monkeypatch.setattr(graph, "TILE", 16)
    x = np.random.default_rng(6).normal(size=(200, 3))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    b = np.floor(x @ np.array([r["p"] for r in projections(spark, 3, 4).orderBy("table").collect()]).T / 50.0)
    want = {(i, j) for i in range(200) for j in range(200) if i != j and np.linalg.norm(x[i] - x[j]) < 1.0 and (b[i] == b[j]).any()}
    for kind in (df.select("id", F.col("v").alias("features")), df.select("id", array_to_vector("v").alias("features"))):
        edges = graph.bucket_edges(kind, 1.0, bucket=50.0, tables=4, chunk=30)
        rows = [(r.src, r.dst) for r in edges.collect()]
        plan = edges._jdf.queryExecution().executedPlan().toString()
        assert len(rows) == len(set(rows)) and set(rows) == want and "HashAggregate(keys=[src" not in plan
    # ids that repeat, and nulls
    odd = spark.createDataFrame([(1, [0.0]), (1, [0.1]), (2, [0.0]), (2, [0.1]), (None, [0.0]), (3, None)], "id long, features array<double>")
    assert sorted((r.src, r.dst) for r in graph.bucket_edges(odd, 1.0, bucket=9.0, tables=2).collect()) == [(1, 2), (2, 1)]
    assert graph.bucket_edges(odd.where("false"), 1.0).count() == 0


def test_distances_by_packs(spark):
    """Rows and queries meet in packs, not pair by pair in the plan; a null vector has null distances, equal ids are left out."""
    rows = [(i, [float(i), 2.0 * (i % 5), 1e6]) for i in range(600)] + [(600, None)]
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(3)
    pairs = recommend.distances_from(df.where("id % 200 = 0"), df)
    assert "zip_with" not in pairs._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.a, r.b): r.d for r in pairs.collect()}
    x = [v for _, v in rows]
    want = {(a, b): None if x[a] is None or x[b] is None else float(np.linalg.norm(np.subtract(x[a], x[b]))) for a in range(0, 601, 200) for b in range(601) if a != b}
    assert got.keys() == want.keys() and all(got[k] == want[k] or abs(got[k] - want[k]) < 1e-9 for k in want)
    assert recommend.distances_from(df.limit(0), df).count() == 0


def test_trees_predict(spark):
    """Forest and boosted trees explain most of a label that depends on its columns."""
    rng = np.random.default_rng(8)
    x = rng.random((600, 2))
    rows = [(float(a), float(b), float(10 * (a > 0.5) + 5 * b)) for a, b in x]
    df = spark.createDataFrame(rows, "a double, b double, label double")
    for kind in ("forest", "boosted"):
        model = ml.train(df.limit(400), ["a", "b"], kind, **({"numTrees": 10} if kind == "forest" else {"maxIter": 10}))
        assert ml.regression_report(model.transform(df)).first()["r2"] > 0.9, kind


def test_trees_learn_from_cells(spark, monkeypatch):
    """A fit's rounds read cells of bins, no more of them for more rows, and predict what a fit over all rows does."""
    sizes, write = [], ml.materialise
    monkeypatch.setattr(ml, "materialise", lambda df, *a, **k: sizes.append(df.count()) or write(df, *a, **k))
    df = spark.range(40_000).selectExpr("double(id % 10) AS a", "double(id % 7) AS b", "double(id % 10) * (id % 7) + double(id % 3) / 10 AS label")
    odd = df.unionByName(spark.createDataFrame([(None, 1.0, 900.0), (1.0, 1.0, None)], df.schema))
    for kind, more in (("boosted", {"maxIter": 5}), ("forest", {"numTrees": 5})):
        for rows in (df.limit(20_000), odd):
            cells = ml.train(rows, ["a", "b"], kind, **more).transform(df)
        plain = ml.Pipeline(stages=[*ml.assembled(["a", "b"]), ml.regressor(kind, **more)]).fit(df).transform(df)
        r2 = [ml.regression_report(p).first()["r2"] for p in (cells, plain)]
        assert r2[0] > r2[1] - 0.02, kind
    assert max(sizes) <= 70 * ml.SHARES and len(sizes) == 4


def test_large_filter(spark):
    """Ten million bits, a million values: all are found, and under 1.5 in 100 others; a union is that of its buckets."""
    from tessera.operators import sketch

    bits = 10_000_000
    added = spark.range(1_000_000).select((F.col("id") * 3).alias("x"))
    parts = [sketch.build_large(added.where(F.col("x") % 2 == k), "x", bits) for k in (0, 1)]
    whole = sketch.merge_large(parts[0].unionByName(parts[1])).persist()
    assert whole.count() == -(-bits // 32768) and whole.exceptAll(sketch.build_large(added, "x", bits)).isEmpty()
    asked = spark.range(60_000).select((F.col("id") * 49 + F.col("id") % 3).alias("x"), F.lit(1).alias("bucket"))
    rows = sketch.contains_large(asked, "x", whole, bits).groupBy((F.col("x") % 3 == 0).alias("in")).agg(F.avg(F.col("maybe").cast("int")).alias("share"), F.count("*").alias("n")).collect()
    share = {r["in"]: r["share"] for r in rows}
    assert sum(r["n"] for r in rows) == 60_000 and share[True] == 1.0 and share[False] < 0.015
    whole.unpersist()


def test_large_filter_of_odd_values(spark):
    from tessera.operators import sketch

    df = spark.createDataFrame([("é",), ("é",), (None,), ("",)], "x string")
    large = sketch.build_large(df.where("x = 'é'"), "x", 1 << 40, 3)
    assert [(r["x"], r["maybe"]) for r in sketch.contains_large(df, "x", large, 1 << 40, 3).orderBy("x").collect()] == [(None, None), ("", False), ("é", True), ("é", True)]
    empty = sketch.build_large(df.where("false"), "x", 100)
    assert empty.count() == 0 and sketch.contains_large(df, "x", empty, 100).where("maybe").count() == 0
    with pytest.raises(ValueError, match="bits"):
        sketch.build_large(df, "x", 0)


def test_entry_without_llm(monkeypatch):
    """Whatever the llm subpackage's import lacks, the other queries stay."""
    import sys

    import __spark_entry__ as entry
    from tessera.plans.registry import QUERIES

    for name in [m for m in sys.modules if m.startswith("tessera.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "tessera.llm", None)
    assert set(entry.queries()) == set(QUERIES)


def test_stage_tables_go_with_the_next_stage(spark):
    from tessera import storage

    def exists(df):
        path = spark._jvm.org.apache.hadoop.fs.Path(df._tessera_path)
        return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)

    docs = spark.range(5)
    with storage.stage_tables(docs, "one"):
        a, b = storage.materialise(docs, "a"), storage.materialise(docs, "b")
    with storage.stage_tables(a.where("id > 1"), "two"):  # reads a, which therefore stays
        c = storage.materialise(a, "c")
    assert exists(a) and not exists(b) and exists(c)
    with storage.stage_tables(docs, "three"):
        pass
    assert not exists(a) and not exists(c)
    outside = storage.materialise(docs, "d")
    with storage.stage_tables(docs, "four"):
        pass
    assert exists(outside)


def test_scratch_deletes_what_operators_wrote(spark):
    from tessera import storage
    from tessera.operators import relational

    def exists(path):
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)

    with storage.scratch(spark) as outer:
        kept = storage.materialise(spark.range(3), "outer")
        with storage.scratch(spark) as paths:
            out = relational.row_numbers(spark.range(10).select((F.col("id") * 7 % 10).alias("x")), "x").collect()
            assert len(out) == 10 and paths and all(exists(p) for p in paths)
        assert not any(exists(p) for p in paths) and exists(kept._tessera_path) and set(paths) < set(outer)
    assert not exists(kept._tessera_path)
    after = storage.materialise(spark.range(3), "after")
    assert exists(after._tessera_path)


def test_local_frame(spark):
    from tessera.storage import local_frame

    assert [tuple(r) for r in local_frame(spark, [(1, "a", None), (2, None, 1.5)], "k int, s string, d double").collect()] == [(1, "a", None), (2, None, 1.5)]
    assert local_frame(spark, [], "k int").count() == 0


def test_steps_over_memberships(spark):
    """Walks over groups reach what walks over their pairs reach: lone members, a seed without any, a seed given twice."""
    rows = [(1, "a"), (2, "a"), (2, "b"), (3, "b"), (3, "c"), (4, "c"), (4, "d"), (5, "d"), (6, "e"), (2, "c"), (7, "f"), (8, "f")]
    members = spark.createDataFrame(rows, "id long, group string")
    pairs = spark.createDataFrame(sorted({(a, b) for a, g in rows for b, h in rows if g == h and a != b}), "src long, dst long")
    seeds = spark.createDataFrame([(1,), (6,), (7,), (99,), (7,)], "seed long")
    for depth in (1, 2, 3):
        for walk in (graph.levels, graph.last_frontier):
            found, want = (sorted(map(tuple, walk(links, seeds, depth).collect())) for links in (members, pairs))
            assert found == want and found
    asked = spark.createDataFrame([(1, 5), (1, 1), (1, 7), (99, 99), (7, 8)], "src long, dst long")
    found, want = (sorted(map(tuple, graph.shortest_paths(links, asked).collect())) for links in (members, pairs))
    assert found == want == [(1, 1, 0), (1, 5, 3), (1, 7, -1), (7, 8, 1), (99, 99, -1)]


@pytest.mark.parametrize("name", ["g3_shortest_path", "g5_proximity_scores", "g6_last_frontier", "g7_ball", "g8_owner_items", "j15_frontier_expansion"])
def test_customer_walks_write_no_pairs(spark, tmp_path, monkeypatch, name):
    """400 customers of one day have 159,600 pairs; the tables that a walk writes have a row a customer and seed."""
    from tessera.plans.registry import QUERIES

    orders = spark.range(400).selectExpr("id AS o_orderkey", "id AS o_custkey", "TIMESTAMP '1995-01-01' AS o_orderdate", "'5-LOW' AS o_orderpriority")
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    written, write = [], graph.materialise
    monkeypatch.setattr(graph, "materialise", lambda df, *a, **more: [out := write(df, *a, **more), written.append(out.count())][0])
    assert QUERIES[name](spark, str(tmp_path)).count() in (5, 399, 400) and written and max(written) <= 800  # a row a customer for each of two seeds at most
