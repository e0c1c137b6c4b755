"""Blocks, descents, Newton steps and boosting against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import blocks as K
from tessera.operators import boosting as B
from tessera.operators import descent as D


@pytest.fixture(scope="module")
def rows(spark):
    r = np.random.default_rng(3)
    x = np.round(r.normal(size=(1000, 3)), 1)
    y = (x @ [1.0, -2.0, 0.5] + r.normal(size=1000) > 0.3).astype(float)
    df = spark.createDataFrame([(*map(float, a), float(b), k) for k, (a, b) in enumerate(zip(x, y, strict=True))], "a double, b double, c double, label double, id long")
    return df.repartition(3), x, y


@pytest.fixture(scope="module")
def packed(rows):
    return K.pack(rows[0], F.array("a", "b", "c"), F.col("label"), F.col("id"), rows_a_block=100)


def test_pack_keeps_all_rows(rows, packed, spark):
    found = [np.column_stack([np.frombuffer(r["key"], np.int64), np.frombuffer(r["x"]).reshape(-1, 3)]) for r in packed.table.collect()]
    found = np.vstack(found)
    assert packed.rows == 1000 and np.array_equal(found[np.argsort(found[:, 0]), 1:], rows[1])
    holes = spark.createDataFrame([([1.0, None], 1.0), (None, 1.0), ([1.0, 2.0], None), ([1.0, 2.0], 0.0)], "f array<double>, label double")
    assert K.pack(holes, F.col("f"), F.col("label")).rows == 1
    empty = K.pack(holes.where("false"), F.col("f"), F.col("label"))
    assert empty.rows == 0 and empty.iterate(None, None, np.ones(2), 3).tolist() == [1.0, 1.0]
    uneven = spark.createDataFrame([([1.0, 2.0], 1.0), ([1.0], 1.0)], "f array<double>, label double")
    with pytest.raises(Exception, match="features"):
        K.pack(uneven.coalesce(1), F.col("f"), F.col("label"))


def test_sums_by_a_tree_of_tasks(packed, monkeypatch):
    part = lambda blocks, s, k: np.array([sum(x.sum() for x, _, _ in blocks)])
    plain = packed.total(part, np.zeros(0))
    monkeypatch.setattr(K, "TREE", 0)
    assert np.allclose(plain, packed.total(part, np.zeros(0)))


def _replay(x, y, key, method, rate, rounds, fraction):
    w, x = np.zeros(4), np.column_stack([x, np.ones(len(y))])
    for k in range(rounds):
        some = np.ones(len(y), bool)
        if method == "stochastic":
            some = np.array([int(i) * (1 + k * 69621 % 2147483646) % 2147483647 < fraction * 2147483647 for i in key])
        g = (1 / (1 + np.exp(-(x[some] @ w))) - y[some]) @ x[some]
        if some.any():
            w = w - rate * (g / np.linalg.norm(g) if method == "steepest" else g if method == "summed" else g / some.sum())
    return w


@pytest.mark.parametrize(("method", "rate"), [("batch", 0.5), ("summed", 1e-3), ("steepest", 0.1), ("stochastic", 0.5)])
def test_descents(rows, packed, method, rate):
    want = _replay(rows[1], rows[2], np.arange(1000), method, rate, 6, 0.2)
    assert np.allclose(D.descend_blocks(packed, method, rate, 6, 0.2), want)


def test_averaged_descent_is_that_of_its_partitions(packed):
    """One barrier stage: each task's passes, then the mean by rows, replayed over the same shares."""
    shares = {}
    for r in packed.dealt(3).withColumn("p", F.spark_partition_id()).collect():
        shares.setdefault(r["p"], []).append((np.frombuffer(r["x"]).reshape(-1, 3), np.frombuffer(r["y"])))
    w = np.zeros(4)
    for passes in (2, 2, 1):
        own = []
        for blocks in shares.values():
            v = w.copy()
            for _ in range(passes):
                for x, y in blocks:
                    for lo in range(0, len(y), 64):
                        part = np.column_stack([x[lo : lo + 64], np.ones(len(y[lo : lo + 64]))])
                        v = v - 0.1 * (1 / (1 + np.exp(-(part @ v))) - y[lo : lo + 64]) @ part / len(part)
            own.append((v, sum(len(y) for _, y in blocks)))
        w = sum(v * n for v, n in own) / 1000
    assert np.allclose(D.descend_blocks(packed, "averaged", 0.1, 5, exchange=2, tasks=3), w)


def test_a_barrier_stage_keeps_in_memory_what_it_may(packed, monkeypatch):
    """Blocks beyond that are read from a file in each pass, with the same result."""
    w = D.descend_blocks(packed, "averaged", 0.1, 4, exchange=2, tasks=3)
    monkeypatch.setattr(K, "HELD_BYTES", 3000)
    assert np.array_equal(D.descend_blocks(packed, "averaged", 0.1, 4, exchange=2, tasks=3), w)
    held, blocks = K.Held(2, 100), [(np.full((n, 2), float(n)), np.full(n, n / 2), np.full(n, n)) for n in (2, 9, 1)]
    for block in blocks:
        held.add(block)
    assert (len(held), len(held.memory)) == (3, 1)
    for _ in range(2):
        assert all(np.array_equal(a, b) for got, block in zip(held, blocks, strict=True) for a, b in zip(got, block, strict=True))


def test_a_barrier_stage_that_cannot_hold_its_blocks_raises(packed, monkeypatch):
    monkeypatch.setattr(K, "TASK_BYTES", 100)
    with pytest.raises(ValueError, match="more than"):
        D.descend_blocks(packed, "averaged", 0.1, 1)


def test_newton_reaches_the_minimum(rows, packed):
    w = D.newton(packed, ridge=0.1)
    x = np.column_stack([rows[1], np.ones(1000)])
    g = (1 / (1 + np.exp(-(x @ w))) - rows[2]) @ x / 1000 + 0.1 * np.append(w[:-1], 0)
    assert np.abs(g).max() < 1e-8


def test_newton_on_classes_that_can_be_separated(spark):
    df = spark.createDataFrame([([float(i)], float(i > 5)) for i in range(12)], "f array<double>, label double")
    w = D.newton(K.pack(df, F.col("f"), F.col("label")))
    assert all((i * w[0] + w[1] > 0) == (i > 5) for i in range(12))


def _plain_tree(x, g, depth, ridge=1.0):
    """Node -> (feature, threshold) of a tree by trying every split of every node."""
    out, todo = {}, [(0, np.arange(len(g)), depth)]
    while todo:
        node, own, left = todo.pop()
        best = (0.0, None)
        for f in range(x.shape[1]):
            for t in np.unique(x[own, f])[:-1]:
                a = x[own, f] <= t
                ga, gb, ha, hb = g[own][a].sum(), g[own][~a].sum(), a.sum(), (~a).sum()
                gain = (ga**2 / (ha + ridge) + gb**2 / (hb + ridge) - (ga + gb) ** 2 / (ha + hb + ridge)) / 2
                if gain > best[0] * (1 + 1e-9):
                    best = (gain, (f, t))
        if best[1] and left:
            out[node] = best[1]
            a = x[own, best[1][0]] <= best[1][1]
            todo += [(2 * node + 1, own[a], left - 1), (2 * node + 2, own[~a], left - 1)]
    return out


def test_first_tree_is_that_of_a_plain_search(rows, packed):
    _, x, y = rows
    model = B.boost_blocks(packed, 1, 4, 0.3, 1.0, 0.0, 1.0, 256, "squared", 10)
    t = model.trees[0]
    want = _plain_tree(x, y.mean() - y, 4)
    assert {k: (int(t.feature[k]), t.threshold[k]) for k in np.flatnonzero(t.feature >= 0)} == want


def test_margins_that_are_kept_change_nothing(rows, packed):
    a, b = (B.boost_blocks(packed, 6, 3, 0.3, 1.0, 0.0, 1.0, 32, "logistic", keep) for keep in (2, 100))
    x = np.vstack([rows[1][:50], [[np.nan, 0.0, 1.0]]])
    assert np.allclose(a.margins(x), b.margins(x))
    p = D.sigmoid(a.margins(rows[1]))
    assert ((p > 0.5) == (rows[2] > 0)).mean() > 0.85


def test_boosting_predicts_after_reading_back(rows, packed, spark, tmp_path):
    model = B.boost_blocks(packed, 3, 2, 0.3, 1.0, 0.0, 1.0, 16, "squared", 10)
    model.table(spark).write.parquet(str(tmp_path / "m"))
    again = B.Boosted.load(spark.read.parquet(str(tmp_path / "m")))
    df = spark.createDataFrame([([1.0, 2.0, 3.0],), (None,), ([float("nan"), 0.0, None],)], "f array<double>")
    got = [r["prediction"] for r in B.predict(df.coalesce(1), again, F.col("f")).collect()]
    want = model.margins(np.array([[1.0, 2.0, 3.0], [np.nan, 0.0, np.nan]]))
    assert got[1] is None and np.allclose([got[0], got[2]], want)


def test_missing_values_go_where_they_gain(spark):
    df = spark.createDataFrame([([float(i)], float(i > 4)) for i in range(10)] + [([float("nan")], 1.0)] * 5, "f array<double>, label double")
    t = B.boost(df, F.col("f"), F.col("label"), trees=1, depth=1).trees[0]
    assert t.threshold[0] == 4.0 and not t.missing_left[0] and t.cover[2] == 10


def test_boosting_edge_cases(spark):
    df = spark.createDataFrame([([1.0], 2.0)] * 3, "f array<double>, label double")
    assert B.boost(df.where("false"), F.col("f"), F.col("label")).trees == []
    m = B.boost(df, F.col("f"), F.col("label"), trees=2)
    assert m.margins(np.array([[5.0]])).tolist() == [2.0]
    with pytest.raises(ValueError, match="loss"):
        B.boost(df, F.col("f"), F.col("label"), loss="other")


def test_quantile_edges_split_weight_evenly(spark):
    r = np.random.default_rng(1)
    v = r.exponential(size=20_000)
    rows = K.pack(spark.createDataFrame([([float(a)], 0.0) for a in v], "f array<double>, label double").repartition(5), F.col("f"), F.col("label"), rows_a_block=500)
    (edges,) = B.quantile_edges(rows, 16)
    share = np.diff(np.append(0, np.searchsorted(np.sort(v), edges, "right"))) / len(v)
    assert len(edges) <= 16 and edges[-1] == v.max() and np.abs(share - 1 / 16).max() < 0.02


def test_singular_values_keep_the_digits_that_a_gram_matrix_loses(spark):
    from tessera.operators import linalg as L

    r = np.random.default_rng(2)
    u, v = np.linalg.qr(r.normal(size=(700, 64)))[0], np.linalg.qr(r.normal(size=(64, 64)))[0]
    want = np.logspace(0, -10, 64)
    x = u * want @ v.T
    df = spark.createDataFrame([([float(a) for a in row],) for row in x], "f array<double>").repartition(5)
    got = L.singular_values_of_rows(df, F.col("f"))
    assert np.abs(got - want).max() < 1e-14 and np.abs(got / want - 1).max() < 1e-4
    gram = np.sqrt(np.clip(np.linalg.eigvalsh(x.T @ x)[::-1], 0, None))
    assert np.abs(gram / want - 1).max() > 0.1
    few = spark.createDataFrame([([3.0, 4.0],), (None,)], "f array<double>")
    assert np.allclose(L.singular_values_of_rows(few, F.col("f")), [5.0]) and len(L.singular_values_of_rows(few.where("false"), F.col("f"))) == 0


def test_kept_margins_are_those_of_all_trees(spark):
    """Margins added up tree by tree, or computed afresh, give the same trees, with missing values and early leaves; nothing stays persisted."""
    from pyspark.sql import functions as F

    from tessera.operators import boosting

    df = spark.range(900).selectExpr("double(id % 37) AS a", "CASE WHEN id % 11 = 0 THEN double('NaN') ELSE double(id % 5) END AS b").selectExpr("*", "a * a + CASE WHEN isnan(b) THEN 40 ELSE b END AS y")
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    models = [boosting.boost(df, F.array("a", "b"), F.col("y"), trees=5, depth=3, keep=k, least_child=60.0) for k in (1, 2, 10)]
    assert spark.sparkContext._jsc.getPersistentRDDs().size() <= before
    for m in models:
        assert len(m.trees) == 5
        for one, other in zip(m.trees, models[0].trees, strict=True):
            assert (one.feature == other.feature).all() and (one.bin == other.bin).all() and abs(one.weight - other.weight).max() < 1e-9


def test_rounds_read_cells_not_rows(spark, monkeypatch):
    """Rows with the same bins are one cell, whatever their labels; the trees are those of all rows, and predictions those of the trees."""
    from tessera.operators import boosting

    seen = []
    monkeypatch.setattr(boosting, "materialise", lambda df, *a, f=boosting.materialise, **b: (seen.append(f(df, *a, **b)), seen[-1])[1])
    df = spark.range(6000).selectExpr("double(id % 7) AS a", "CASE WHEN id % 11 = 0 THEN double('NaN') ELSE double(id % 5) END AS b", "double(id) AS l")
    df = df.selectExpr("*", "a * a + CASE WHEN isnan(b) THEN 40 ELSE b END + l % 3 AS y").repartition(5)
    rows = np.array(df.select("a", "b", "y").collect(), float)
    x, y = rows[:, :2], rows[:, 2:]
    monkeypatch.setattr(boosting, "discard", lambda df: seen.append(df.count()))
    model = boosting.boost(df, F.array("a", "b"), F.col("y"), trees=4, depth=3)
    assert seen[1:] == [7 * 6] and model.base == pytest.approx(y.mean())
    # the first split, from all rows
    t, g = model.trees[0], y.mean() - y[:, 0]
    left = ~(x[:, t.feature[0]] > t.threshold[0])
    assert t.cover[1] == left.sum() and t.weight[1] == pytest.approx(-g[left].sum() / (left.sum() + 1) * 0.3)
    for known in (boosting.KNOWN, 0):
        monkeypatch.setattr(boosting, "KNOWN", known)
        r = boosting.Remembered(model)
        assert (r.margins(x[:50]) == model.margins(x[:50])).all() and (r.margins(x) == model.margins(x)).all()
