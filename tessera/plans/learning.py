"""Learning and linear algebra queries."""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from tessera.functions.vector import dot
from tessera.operators import boosting as B
from tessera.operators import linalg as L
from tessera.operators import ml as M
from tessera.plans.registry import load_all, query
from tessera.plans.vectors import embeddings
from tessera.storage import local_frame

D = F.col
X = ["l_quantity", "l_discount", "l_tax"]
# fixed matrices with known factors
SPD = {
    "2": [[25.0, -50.0], [-50.0, 101.0]],
    "3": [[25.0, 15.0, -5.0], [15.0, 18.0, 0.0], [-5.0, 0.0, 11.0]],
}


def _det(m):
    (a, b, c), (d, e, f), (g, h, i) = m
    return f"({a} * ({e} * {i} - {f} * {h}) - {b} * ({d} * {i} - {f} * {g}) + {c} * ({d} * {h} - {e} * {g}))"


def _weights_sql(condition: str = "true", ridge: float = 0.0) -> str:
    """CTEs: rows (x0, x1, x2, y, l_orderkey, l_linenumber), and their least squares weights (w0, w1, w2, b) by Cramer's rule.

    With ``ridge``, on standardised columns, the penalty is divided by the label's deviation, as Spark does.
    """
    c = [[f"c{min(i, j)}{max(i, j)}" if i != j else "d" + str(i) for j in range(3)] for i in range(3)]
    put = lambda k: [[f"r{i}" if j == k else c[i][j] for j in range(3)] for i in range(3)]
    corr = [f"covar_pop(x{i}, x{j}) / (stddev_pop(x{i}) * stddev_pop(x{j})) AS c{i}{j}" for i in range(3) for j in range(i + 1, 3)]
    corr += [f"1.0 + {ridge} / stddev_pop(y) AS d{i}, covar_pop(x{i}, y) / (stddev_pop(x{i}) * stddev_pop(y)) AS r{i}, stddev_pop(y) / stddev_pop(x{i}) AS u{i}, avg(x{i}) AS m{i}" for i in range(3)]
    return (
        "rows AS (SELECT l_quantity::DOUBLE AS x0, l_discount::DOUBLE AS x1, l_tax::DOUBLE AS x2, l_extendedprice::DOUBLE AS y, l_orderkey, l_linenumber FROM lineitem), "
        f"stats AS (SELECT {', '.join(corr)}, avg(y) AS my FROM rows WHERE {condition}), "
        f"each AS (SELECT *, {', '.join(f'u{k} * {_det(put(k))} / {_det(c)} AS w{k}' for k in range(3))} FROM stats), "
        "w AS (SELECT w0, w1, w2, my - w0 * m0 - w1 * m1 - w2 * m2 AS b FROM each)"
    )


_FIT = "w0 * x0 + w1 * x1 + w2 * x2 + b"
_TRAIN, _TEST = "l_orderkey % 10 <> 0", "l_orderkey % 10 = 0"


def _descent_sql(step: str, rate: float, rounds: int = 150, sample: str = "true") -> str:
    """Accuracy after ``rounds`` steps of logistic descent on standardised columns; ``step``: what divides the summed gradient, ``sample``: the rows of round k."""
    z = "w0 * x0 + w1 * x1 + w2 * x2 + b"
    x = ", ".join(f"coalesce(({c} - avg({c}) OVER ()) / nullif(stddev_pop({c}) OVER (), 0), 0)::DOUBLE AS x{k}" for k, c in enumerate(X))
    g = [f"sum((1 / (1 + exp(-({z}))) - y) * x{k})" for k in range(3)] + [f"sum(1 / (1 + exp(-({z}))) - y)"]
    return (
        "WITH RECURSIVE positive AS (SELECT l_returnflag AS flag FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1), "
        f"rows AS (SELECT {x}, (l_returnflag = flag)::INT::DOUBLE AS y, l_orderkey, l_linenumber FROM lineitem, positive), "
        "w(k, w0, w1, w2, b) AS (SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE UNION ALL "
        f"SELECT k + 1, w0 - {rate} * g0 / {step}, w1 - {rate} * g1 / {step}, w2 - {rate} * g2 / {step}, b - {rate} * g3 / {step} FROM "
        f"(SELECT k, w0, w1, w2, b, {', '.join(f'{e} AS g{i}' for i, e in enumerate(g))}, count(*) AS n FROM w, rows WHERE k < {rounds} AND {sample} GROUP BY k, w0, w1, w2, b) t) "
        f"SELECT round(avg((({z} > 0)::INT = y)::INT), 4) AS accuracy FROM rows, w WHERE k = {rounds}"
    )


def lines(spark, d):
    return load_all(spark, d, "lineitem")["lineitem"].select(*X, D("l_extendedprice").alias("label"), "l_orderkey", "l_linenumber", "l_returnflag")


@query("m1_assemble", "SELECT l_orderkey, l_linenumber, [l_quantity, l_discount, l_tax] AS v FROM lineitem")
def _(spark, d):
    out = VectorAssembler(inputCols=X, outputCol="raw").transform(lines(spark, d))
    return out.select("l_orderkey", "l_linenumber", vector_to_array("raw").alias("v"))


@query("m2_standard_scaler", "SELECT l_orderkey, l_linenumber, round((l_quantity - avg(l_quantity) OVER ()) / stddev_samp(l_quantity) OVER (), 6) AS z FROM lineitem")
def _(spark, d):
    raw = VectorAssembler(inputCols=["l_quantity"], outputCol="raw").transform(lines(spark, d))
    out = StandardScaler(inputCol="raw", outputCol="z", withMean=True, withStd=True).fit(raw).transform(raw)
    return out.select("l_orderkey", "l_linenumber", F.round(vector_to_array("z")[0], 6).alias("z"))


def _turned(model) -> list[float]:
    """A sign for each component, so that its largest loading is above 0 in every run."""
    loads = model.pc.toArray()
    return np.sign(loads[np.abs(loads).argmax(axis=0), np.arange(loads.shape[1])]).tolist()


@query("m3_pca")
def _(spark, d):
    e = embeddings(spark, d).select("id", array_to_vector("v").alias("raw"))
    model = PCA(k=3, inputCol="raw", outputCol="p").fit(e)
    signs = F.array(*[F.lit(x) for x in _turned(model)])
    return model.transform(e).select("id", F.zip_with(vector_to_array("p"), signs, lambda x, y: x * y).alias("p"))


@query("m3_pca_norms", "SELECT vec_id AS id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 5) AS energy FROM embeddings")
def _(spark, d):
    """All components together keep each row's squared length: they are a turned basis."""
    e = embeddings(spark, d).select("id", array_to_vector("v").alias("raw"))
    p = PCA(k=64, inputCol="raw", outputCol="p").fit(e).transform(e).select("id", vector_to_array("p").alias("p"))
    return p.select("id", F.round(dot(D("p"), D("p")), 5).alias("energy"))


@query(
    "m3_pca_variance",
    "SELECT round((a + c + sqrt((a - c) * (a - c) + 4 * b * b)) / 2, 4) AS first, round((a + c - sqrt((a - c) * (a - c) + 4 * b * b)) / 2, 6) AS second FROM "
    "(SELECT var_samp(l_quantity::DOUBLE) AS a, covar_samp(l_quantity::DOUBLE, l_discount::DOUBLE) AS b, var_samp(l_discount::DOUBLE) AS c FROM lineitem) t",
)
def _(spark, d):
    raw = VectorAssembler(inputCols=X[:2], outputCol="raw").transform(lines(spark, d))
    rows = PCA(k=2, inputCol="raw", outputCol="p").fit(raw).transform(raw).select(vector_to_array("p").alias("p"))
    return rows.agg(F.round(F.var_samp(D("p")[0]), 4).alias("first"), F.round(F.var_samp(D("p")[1]), 6).alias("second"))


# with one column that has over nine tenths of the variance, so does the first component
@query(
    "m4_components_for_share",
    "SELECT CASE WHEN greatest(a, b, c) >= 0.9 * (a + b + c) THEN 1 END::INT AS components FROM "
    "(SELECT var_samp(l_quantity::DOUBLE) AS a, var_samp(l_discount::DOUBLE) AS b, var_samp(l_tax::DOUBLE) AS c FROM lineitem) t",
)
def _(spark, d):
    return spark.createDataFrame([(M.components_for(lines(spark, d), X, 0.9),)], "components int")


@query(
    "m5_linear_regression",
    "SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept FROM lineitem",
)
def _(spark, d):
    from pyspark.ml.regression import LinearRegression

    raw = VectorAssembler(inputCols=["l_quantity"], outputCol="features").transform(lines(spark, d))
    m = LinearRegression(solver="normal").fit(raw)
    return spark.createDataFrame([(float(m.coefficients[0]), float(m.intercept))], "slope double, intercept double").select(F.round("slope", 4).alias("slope"), F.round("intercept", 2).alias("intercept"))


def _fit_report(kind, **more):
    def plan(spark, d):
        rows = lines(spark, d)
        model = M.train(rows.where(_TRAIN), X, kind, **more)
        report = M.regression_report(model.transform(rows.where(_TEST)), tolerance=5000.0)
        return report.select(F.round("rmse", 3).alias("rmse"), F.round("mae", 3).alias("mae"), F.round("accuracy", 6).alias("accuracy"), F.round("r2", 6).alias("r2"))

    return plan


query(
    "m5_ridge",
    f"WITH {_weights_sql(_TRAIN, 0.1)}, e AS (SELECT y, {_FIT} - y AS e FROM rows, w WHERE {_TEST}) SELECT round(sqrt(avg(e * e)), 3) AS rmse, round(avg(abs(e)), 3) AS mae, "
    "round(avg((abs(e) <= 5000)::INT), 6) AS accuracy, round(1 - sum(e * e) / (var_pop(y) * count(*)), 6) AS r2 FROM e",
)(_fit_report("ridge"))
# trees are judged on what a line is charged, which depends on price, discount and tax
CHARGE = ["l_extendedprice", "l_discount", "l_tax"]
_CHARGED = "l_extendedprice * (1 - l_discount) * (1 + l_tax)"


def charges(spark, d):
    return load_all(spark, d, "lineitem")["lineitem"].select(*CHARGE, F.expr(_CHARGED).alias("label"), "l_orderkey", "l_linenumber")


def _floor_sql(least: float) -> str:
    """The error of the train rows' mean on the test rows; that the model's R2 there is above ``least`` is what must hold."""
    return (
        f"SELECT count(*) AS n, round(sqrt(avg(({_CHARGED} - m) * ({_CHARGED} - m))), 3) AS mean_rmse, true AS r2_above_{int(100 * least)} "
        f"FROM lineitem, (SELECT avg({_CHARGED}) AS m FROM lineitem WHERE {_TRAIN}) t WHERE {_TEST}"
    )


def _above_mean(predicted, train, least):
    """Rows, the error of the mean predictor, and whether the predictions' R2 against it is above ``least``."""
    e, m = D("prediction") - D("label"), D("label") - D("m")
    rows = predicted.crossJoin(F.broadcast(train.agg(F.avg("label").alias("m"))))
    one = rows.agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(m * m)).alias("mean_rmse"), (1 - F.sum(e * e) / F.sum(m * m) > least).alias(f"r2_above_{int(100 * least)}"))
    return one.withColumn("mean_rmse", F.round("mean_rmse", 3))


def _tree_report(kind):
    def plan(spark, d):
        rows = charges(spark, d)
        train = rows.where(_TRAIN)
        return _above_mean(M.train(train, CHARGE, kind).transform(rows.where(_TEST)), train, 0.9)

    return plan


query("m6_random_forest", _floor_sql(0.9))(_tree_report("forest"))
query("m7_boosted_trees", _floor_sql(0.9))(_tree_report("boosted"))


@query("m8_boosted_second_order", _floor_sql(0.97))
def _(spark, d):
    """100 trees of depth 5 from second-order gains; the model is written and read back before it predicts."""
    from tessera.plans.storage_plans import fresh

    rows = charges(spark, d)
    train, path = rows.where(_TRAIN), fresh(spark, "model-m8")
    B.boost(train, F.array(*CHARGE), D("label"), trees=100, depth=5).table(spark).write.parquet(path)
    model = B.Boosted.load(spark.read.parquet(path))
    return _above_mean(B.predict(rows.where(_TEST), model, F.array(*CHARGE)), train, 0.97)


def _tree_sql(label: str, ridge: float = 1.0) -> str:
    """The first tree's two upper levels: splits of largest gain among all distinct values, from sums of gradients."""
    # gradients of the squared loss at the mean; Hessians are 1
    each = f"SELECT {label} AS y, [{', '.join(f'{c}::DOUBLE' for c in X)}] AS x FROM lineitem"
    score = lambda g, h: f"({g}) * ({g}) / ({h} + {ridge})"

    def split(name, source):
        return (
            f"{name}_cells AS (SELECT node, f, v, sum(g) AS g, count(*)::DOUBLE AS h FROM (SELECT node, g, unnest([0, 1, 2]) AS f, unnest(x) AS v FROM {source}) GROUP BY node, f, v), "
            f"{name}_sums AS (SELECT *, sum(g) OVER w AS gl, sum(h) OVER w AS hl, sum(g) OVER (PARTITION BY node, f) AS ga, sum(h) OVER (PARTITION BY node, f) AS ha FROM {name}_cells "
            "WINDOW w AS (PARTITION BY node, f ORDER BY v)), "
            f"{name}_gains AS (SELECT *, ({score('gl', 'hl')} + {score('ga - gl', 'ha - hl')} - {score('ga', 'ha')}) / 2 AS gain FROM {name}_sums WHERE ha - hl >= 1), "
            f"{name}_tops AS (SELECT *, max(gain) OVER (PARTITION BY node) AS top FROM {name}_gains), "
            f"{name} AS (SELECT node, f, v, gain, ha FROM {name}_tops QUALIFY row_number() OVER (PARTITION BY node ORDER BY round(gain / top, 9) DESC, f, v) = 1)"
        )

    return (
        f"WITH each AS ({each}), start AS (SELECT 0 AS node, x, avg(y) OVER () - y AS g FROM each), {split('one', 'start')}, "
        "below AS (SELECT CASE WHEN s.x[one.f + 1] <= one.v THEN 1 ELSE 2 END AS node, x, g FROM start s, one), "
        f"{split('two', 'below')} "
        "SELECT node, f AS feature, v AS threshold, round(gain / 1000, 0) AS gain, ha AS cover FROM (SELECT * FROM one UNION ALL SELECT * FROM two)"
    )


@query("m8_first_splits", _tree_sql("l_extendedprice"))
def _(spark, d):
    """The root's split and its children's; quantity, discount and tax have fewer values than bins, so their splits are exact."""
    model = B.boost(lines(spark, d), F.array(*X), D("label"), trees=1, depth=2)
    return model.table(spark).where("tree = 0 AND feature >= 0").select(D("node"), D("feature"), "threshold", F.round(D("gain") / 1000, 0).alias("gain"), "cover")


@query("m9_save_load_predict", f"WITH {_weights_sql()} SELECT l_orderkey, l_linenumber, round({_FIT}, 3) AS prediction FROM rows, w")
def _(spark, d):
    from tessera.plans.storage_plans import fresh

    path = fresh(spark, "model-m9")
    M.train(lines(spark, d), X, "linear", path=path)
    return M.load_model(path).transform(lines(spark, d)).select("l_orderkey", "l_linenumber", F.round("prediction", 3).alias("prediction"))


def _verdict(components):
    def plan(spark, d):
        rows = lines(spark, d)
        v = M.train_test_verdict(rows.where(_TRAIN), rows.where(_TEST), X, components)
        return local_frame(spark, [(round(v["train_rmse"], 3), round(v["test_rmse"], 3), round(v["test_r2"], 6), v["verdict"])], "train_rmse double, test_rmse double, test_r2 double, verdict string")

    return plan


query("m10_verdict")(_verdict(2))
# all components together are the columns, turned: the regression on them is that on the columns
query(
    "m10_verdict_all_components",
    f"WITH {_weights_sql(_TRAIN)}, e AS (SELECT y, {_FIT} - y AS e, {_TEST} AS test FROM rows, w), "
    "s AS (SELECT sqrt(avg(e * e) FILTER (NOT test)) AS a, sqrt(avg(e * e) FILTER (test)) AS b, 1 - sum(e * e) FILTER (test) / (var_pop(y) FILTER (test) * count(*) FILTER (test)) AS r2 FROM e) "
    "SELECT round(a, 3) AS train_rmse, round(b, 3) AS test_rmse, round(r2, 6) AS test_r2, CASE WHEN r2 > 0.7 AND b < 1.5 * a THEN 'good' WHEN r2 > 0.5 THEN 'fair' ELSE 'poor' END AS verdict FROM s",
)(_verdict(3))


@query("m11_logistic_regression")
def _(spark, d):
    rows = M.one_vs_rest(embeddings(spark, d), "label", 1).withColumn("part", F.pmod(F.xxhash64(F.lit(42), "id"), F.lit(5)))
    w = M.logistic(rows.where("part > 0"), "v", ridge=0.01)
    return M.accuracy(M.classify_vectors(rows.where("part = 0"), w, "v"))


def _newton_sql(steps: int) -> str:
    """Weights of a logistic regression on three standardised columns after so many Newton steps, solved by Cramer's rule."""
    z = "1 / (1 + exp(-(w0 * x0 + w1 * x1 + w2 * x2 + w3 * x3)))"
    g = [f"sum(({z} - y) * x{i}) AS g{i}" for i in range(4)]
    h = [f"sum({z} * (1 - {z}) * x{i} * x{j}) AS h{i}{j}" for i in range(4) for j in range(i, 4)]
    cell = [[f"h{min(i, j)}{max(i, j)}" for j in range(4)] for i in range(4)]
    put = lambda k: [[f"g{i}" if j == k else cell[i][j] for j in range(4)] for i in range(4)]

    def det(m):
        minor = lambda c: [[m[i][j] for j in range(4) if j != c] for i in range(1, 4)]
        return "(" + " + ".join(f"{'-' if c % 2 else ''}{m[0][c]} * {_det(minor(c))}" for c in range(4)) + ")"

    x = ", ".join(f"((l.{c} - avg(l.{c}) OVER ()) / stddev_pop(l.{c}) OVER ())::DOUBLE AS x{k}" for k, c in enumerate(X))
    return (
        f"WITH RECURSIVE rows AS (SELECT {x}, 1.0::DOUBLE AS x3, (l_returnflag = 'R')::INT::DOUBLE AS y FROM lineitem l), "
        "w(k, w0, w1, w2, w3) AS (SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE UNION ALL "
        f"SELECT k + 1, {', '.join(f'w{i} - {det(put(i))} / {det(cell)}' for i in range(4))} FROM "
        f"(SELECT k, w0, w1, w2, w3, {', '.join(g + h)} FROM w, rows WHERE k < {steps} GROUP BY k, w0, w1, w2, w3) t) "
        f"SELECT v.i, round(v.w, 6) AS weight FROM w, (VALUES {', '.join(f'({i}, w{i})' for i in range(4))}) v(i, w) WHERE k = {steps}"
    )


@query("m11_newton_weights", _newton_sql(8))
def _(spark, d):
    """Weights of three standardised columns and the intercept."""
    rows = M.standardised(M.one_vs_rest(lines(spark, d).drop("label"), "l_returnflag", "R").select(*X, "label"), X)
    w = M.logistic(rows.select(F.array(*X).alias("features"), "label"))
    return local_frame(spark, [(i, round(float(x), 6) + 0.0) for i, x in enumerate(w)], "i int, weight double")


def _descend(method, **more):
    def plan(spark, d):
        rows = M.standardised(M.one_vs_rest(lines(spark, d).drop("label"), "l_returnflag").select(*X, "label", "l_orderkey", "l_linenumber"), X)
        w = M.descend(rows, X, method, key=F.expr("l_orderkey * 8 + l_linenumber"), **more)
        return M.accuracy(M.classify_with(rows, X, w)).select(F.round("accuracy", 4).alias("accuracy"))

    return plan


_SAMPLE = "(l_orderkey * 8 + l_linenumber) % 2147483647 * (1 + k * 69621 % 2147483646) % 2147483647 < 0.1 * 2147483647"
query("m12_stochastic_descent", _descent_sql("n", 0.05, sample=_SAMPLE))(_descend("stochastic", fraction=0.1))


@query(
    "m13_averaged_descent",
    "SELECT round(greatest(share, 1 - share), 4) AS larger_class, true AS not_below FROM (SELECT avg((l_returnflag = (SELECT l_returnflag FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1))::INT) AS share FROM lineitem) t",
)
def _(spark, d):
    """The share of the larger class, and whether the classifier's accuracy is that at least (but for 1 in 100)."""
    accuracy = _descend("averaged")(spark, d)
    share = M.one_vs_rest(lines(spark, d).drop("label"), "l_returnflag").agg(F.avg("label").alias("share")).select(F.round(F.greatest("share", 1 - D("share")), 4).alias("larger_class"))
    return share.crossJoin(F.broadcast(accuracy)).select("larger_class", (D("accuracy") >= D("larger_class") - 0.01).alias("not_below"))


query("m13_batch_descent", _descent_sql("n", 0.05))(_descend("batch"))
query("m14_summed_gradient", _descent_sql("1", 1e-5))(_descend("summed", rate=1e-5))
query("m15_steepest_descent", _descent_sql("greatest(sqrt(g0 * g0 + g1 * g1 + g2 * g2 + g3 * g3), 1e-12)", 0.05))(_descend("steepest"))


@query("m14_gradient", "SELECT round(sum((0.5 - (l_returnflag = 'R')::INT) * l_quantity)::DOUBLE, 3) AS g0, round(sum(0.5 - (l_returnflag = 'R')::INT)::DOUBLE, 3) AS g1 FROM lineitem")
def _(spark, d):
    g, _n = M.gradient(M.one_vs_rest(lines(spark, d).drop("label"), "l_returnflag", "R"), ["l_quantity"], np.zeros(2))
    return spark.createDataFrame([(round(float(g[0]), 3), round(float(g[1]), 3))], "g0 double, g1 double")


@query("m16_one_vs_rest", "SELECT l_orderkey, l_linenumber, (l_returnflag = (SELECT l_returnflag FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1))::INT::DOUBLE AS label FROM lineitem")
def _(spark, d):
    return M.one_vs_rest(lines(spark, d).drop("label"), "l_returnflag").select("l_orderkey", "l_linenumber", "label")


@query("m17_accuracy", "SELECT round(avg((l_linestatus = CASE WHEN l_shipdate > TIMESTAMP '1995-06-17' THEN 'O' ELSE 'F' END)::INT), 6) AS accuracy FROM lineitem")
def _(spark, d):
    li = load_all(spark, d, "lineitem")["lineitem"]
    guess = F.when(D("l_shipdate") > F.expr("TIMESTAMP_NTZ '1995-06-17'"), "O").otherwise("F")
    return M.accuracy(li.select(D("l_linestatus").alias("label"), guess.alias("prediction"))).select(F.round("accuracy", 6).alias("accuracy"))


@query("m18_class_split", "SELECT label, count(*) AS n FROM embeddings WHERE label IN (1, 2) GROUP BY label")
def _(spark, d):
    return spark.sql("SELECT label, count(*) AS n FROM {e} WHERE label IN (1, 2) GROUP BY label", e=embeddings(spark, d))


def coordinates(spark, m):
    return spark.createDataFrame([(i, j, m[i][j]) for i in range(len(m)) for j in range(i + 1)], "i int, j int, v double")


@query("l1_cholesky", "SELECT * FROM (VALUES (0, 0, 5.0::DOUBLE), (1, 0, 3.0), (1, 1, 3.0), (2, 0, -1.0), (2, 1, 1.0), (2, 2, 3.0)) t(i, j, v)")
def _(spark, d):
    return L.cholesky(coordinates(spark, SPD["3"]), 3).select("i", "j", F.round("v", 9).alias("v"))


@query("l2_reconstruct", "SELECT * FROM (VALUES (0, 0, 25.0::DOUBLE), (1, 0, -50.0), (1, 1, 101.0)) t(i, j, v)")
def _(spark, d):
    return L.product_with_transpose(L.cholesky(coordinates(spark, SPD["2"]), 2)).select("i", "j", F.round("v", 9).alias("v"))


@query("l3_lu", "SELECT * FROM (VALUES ('L', 0, 0, 1.0::DOUBLE), ('L', 0, 1, 0.0), ('L', 1, 0, -0.5), ('L', 1, 1, 1.0), ('P', 0, 0, 0.0), ('P', 0, 1, 1.0), ('P', 1, 0, 1.0), ('P', 1, 1, 0.0), ('U', 0, 0, -50.0), ('U', 0, 1, 101.0), ('U', 1, 0, 0.0), ('U', 1, 1, 0.5)) t(factor, i, j, v)")
def _(spark, d):
    rows = spark.createDataFrame([("a", SPD["2"])], "name string, m array<array<double>>")
    return L.lu_each(rows).select("factor", "i", "j", F.round("v", 9).alias("v"))


@query("l4_gram", "SELECT * FROM (SELECT 0 AS i, 0 AS j, round(sum(l_quantity * l_quantity), 2) AS v FROM lineitem UNION ALL SELECT 0, 1, round(sum(l_quantity * l_discount), 2) FROM lineitem UNION ALL SELECT 1, 1, round(sum(l_discount * l_discount), 2) FROM lineitem) t")
def _(spark, d):
    return L.gram(lines(spark, d), ["l_quantity", "l_discount"]).select("i", "j", F.round("v", 2).alias("v"))


@query(
    "l4_singular_values",
    "WITH g AS (SELECT sum(l_quantity::DOUBLE * l_quantity) AS a, sum(l_quantity::DOUBLE * l_discount) AS b, sum(l_discount::DOUBLE * l_discount) AS c FROM lineitem) "
    "SELECT 0 AS k, round(sqrt((a + c + sqrt((a - c) * (a - c) + 4 * b * b)) / 2), 4) AS value FROM g UNION ALL "
    "SELECT 1, round(sqrt((a * c - b * b) / ((a + c + sqrt((a - c) * (a - c) + 4 * b * b)) / 2)), 4) FROM g",
)
def _(spark, d):
    values = L.singular_values(lines(spark, d), X[:2])
    return local_frame(spark, [(k, round(float(v), 4)) for k, v in enumerate(values)], "k int, value double")


def _three_singular_values_sql() -> str:
    """Roots of the 3 x 3 Gram matrix's characteristic polynomial, by the cosine formula."""
    g = [f"sum({X[i]}::DOUBLE * {X[j]}) AS g{i}{j}" for i in range(3) for j in range(i, 3)]
    b = lambda i, j: f"((g{min(i, j)}{max(i, j)}{' - q' if i == j else ''}) / p)"
    return (
        f"WITH g AS (SELECT {', '.join(g)} FROM lineitem), m AS (SELECT *, (g00 + g11 + g22) / 3 AS q FROM g), "
        "s AS (SELECT *, sqrt(((g00 - q) * (g00 - q) + (g11 - q) * (g11 - q) + (g22 - q) * (g22 - q) + 2 * (g01 * g01 + g02 * g02 + g12 * g12)) / 6) AS p FROM m), "
        f"a AS (SELECT q, p, acos(greatest(-1, least(1, {_det([[b(i, j) for j in range(3)] for i in range(3)])} / 2))) / 3 AS phi FROM s) "
        "SELECT k::INT AS k, round(sqrt(q + 2 * p * cos(phi + 2 * pi() * CASE k WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 1 END / 3)), 3) AS value FROM a, range(3) r(k)"
    )


@query("l4_singular_values_of_three", _three_singular_values_sql())
def _(spark, d):
    values = L.singular_values_of_rows(lines(spark, d), F.array(*X))
    return local_frame(spark, [(k, round(float(v), 3)) for k, v in enumerate(values)], "k int, value double")


@query("l4_energy", "SELECT count(*) AS n, round(sum(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS energy, 64::INT AS \"rank\" FROM embeddings")
def _(spark, d):
    """All 64 singular values of the embeddings: their squares add up to the squared entries, and none is 0."""
    e = embeddings(spark, d)
    values = L.singular_values_of_rows(e, D("v"))
    return local_frame(spark, [(e.count(), round(float((values**2).sum()), 6), int((values > 1e-9 * values[0]).sum()))], "n long, energy double, rank int")


@query("l5_newton_steps", "SELECT round(regr_slope(l_extendedprice, l_quantity), 3) AS slope FROM lineitem")
def _(spark, d):
    from pyspark.ml.regression import GeneralizedLinearRegression

    raw = VectorAssembler(inputCols=["l_quantity"], outputCol="features").transform(lines(spark, d))
    m = GeneralizedLinearRegression(family="gaussian", link="identity", maxIter=10).fit(raw)
    return spark.createDataFrame([(round(float(m.coefficients[0]), 3),)], "slope double")
