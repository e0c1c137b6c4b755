"""Vector expressions and nearest neighbours."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tessera.functions import vector as V
from tessera.functions.scalars import round_scaled
from tessera.operators import neighbours as N
from tessera.operators import recommend as R
from tessera.plans.registry import load_all, query

D = F.col
_E = "list_transform(embedding, lambda x: x::DOUBLE)"
_COS = "list_cosine_similarity(a.v, b.v)"
_T = f"WITH e AS (SELECT vec_id, label, {_E} AS v FROM embeddings)"


def embeddings(spark, d):
    return load_all(spark, d, "embeddings")["embeddings"].select(D("vec_id").alias("id"), "label", D("embedding").cast("array<double>").alias("v"))


@query("x8_array_items", f"{_T} SELECT vec_id, round(v[1], 6) AS e0, round(v[12], 6) AS e11, round(v[64], 6) AS e63 FROM e")
def _(spark, d):
    e = embeddings(spark, d)
    return e.select(D("id").alias("vec_id"), *[round_scaled(D("v")[k], 6).alias(f"e{k}") for k in (0, 11, 63)])


_R6 = "lambda x: round(x, 6)"


@query("x9_pad_truncate", f"{_T} SELECT vec_id, list_transform(v[1:12], {_R6}) AS cut, list_transform(list_concat(v, list_resize([]::DOUBLE[], 26, 0.0)), {_R6}) AS padded FROM e")
def _(spark, d):
    e = embeddings(spark, d)
    rounded = lambda size: F.transform(V.fit_length(D("v"), size), lambda x: round_scaled(x, 6))
    return e.select(D("id").alias("vec_id"), rounded(12).alias("cut"), rounded(90).alias("padded"))


@query("x10_feature_vector", f"{_T} SELECT vec_id, list_transform(list_concat([label::DOUBLE, 0.0], list_concat(v, list_resize([]::DOUBLE[], 26, 0.0))), {_R6}) AS features FROM e")
def _(spark, d):
    """A scalar, a missing scalar as 0, and the vector padded."""
    f = V.features([D("label"), F.lit(None).cast("double")], D("v"), 90)
    return embeddings(spark, d).select(D("id").alias("vec_id"), F.transform(f, lambda x: round_scaled(x, 6)).alias("features"))


@query("x11_norm", f"{_T} SELECT vec_id, round(sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS norm, CASE WHEN list_sum(list_transform(v, lambda x: x * x)) = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS unit FROM e")
def _(spark, d):
    return embeddings(spark, d).select(D("id").alias("vec_id"), F.round(V.norm(D("v")), 6).alias("norm"), F.round(V.norm(V.normalise(D("v"))), 6).alias("unit"))


@query("x12_cosine", f"{_T} SELECT a.vec_id, round({_COS}, 6) AS similarity FROM e a, e b WHERE b.vec_id = 0")
def _(spark, d):
    e = embeddings(spark, d)
    one = e.where("id = 0").select(D("v").alias("w"))
    return e.crossJoin(F.broadcast(one)).select(D("id").alias("vec_id"), F.round(V.cosine(D("v"), D("w")), 6).alias("similarity"))


@query("x13_distance_to_cosine", f"{_T} SELECT a.vec_id, round({_COS}, 6) AS similarity FROM e a, e b WHERE b.vec_id = 1")
def _(spark, d):
    e = embeddings(spark, d).select("id", V.normalise(D("v")).alias("v"))
    one = e.where("id = 1").select(D("v").alias("w"))
    return e.crossJoin(F.broadcast(one)).select(D("id").alias("vec_id"), F.round(V.cosine_of_unit_distance(V.distance(D("v"), D("w"))), 6).alias("similarity"))


@query(
    "x14_taste_vector",
    f"{_T}, m AS (SELECT i, sum(v[i] * (vec_id + 1)) / sum(vec_id + 1) AS m FROM e, range(1, 65) r(i) WHERE vec_id < 3 GROUP BY i) "
    "SELECT CAST(i - 1 AS INT) AS at, round(m / sqrt((SELECT sum(m * m) FROM m)), 6) AS x FROM m",
)
def _(spark, d):
    rows = embeddings(spark, d).where("id < 3").select((D("id") + 1).cast("double").alias("weight"), "v")
    return R.weighted_mean(rows, 64).select(F.posexplode("v").alias("at", "x")).select("at", F.round("x", 6).alias("x"))


@query("x15_cosine_matrix", f"{_T} SELECT a.vec_id AS id, b.vec_id AS seed, round({_COS}, 6) AS similarity FROM e a, e b WHERE b.vec_id < 3")
def _(spark, d):
    e = embeddings(spark, d)
    return R.cosine_matrix(e.select("id", "v"), e.where("id < 3").select(D("id").alias("seed"), "v")).select("id", "seed", F.round("similarity", 6).alias("similarity"))


@query("p1_vector_udf", f"{_T} SELECT vec_id, round(list_sum(list_transform(v, lambda x: x * x)), 4) AS energy FROM e")
def _(spark, d):
    @F.pandas_udf("double")
    def energy(v):
        return v.map(lambda x: float((x * x).sum()))

    return embeddings(spark, d).select(D("id").alias("vec_id"), F.round(energy("v"), 4).alias("energy"))


@query("j16_all_pairs_distance", f"{_T} SELECT a.vec_id AS a, b.vec_id AS b, round(list_distance(a.v, b.v), 5) AS d FROM e a, e b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id")
def _(spark, d):
    e = embeddings(spark, d)
    return R.distances_from(e.where("id % 100 = 0"), e).select("a", "b", F.round("d", 5).alias("d"))


@query("n1_lsh_index", f"{_T} SELECT vec_id AS id, true AS same FROM e")
def _(spark, d):
    """Each row's buckets under a model that was saved and loaded, beside those under the one that was fitted."""
    from tessera.plans.storage_plans import fresh

    model, unit = R.lsh_index(embeddings(spark, d), bucket=0.5, tables=5, seed=42)
    path = fresh(spark, "lsh")
    R.save_lsh(model, path)
    buckets = lambda m, name: m.transform(unit).select("id", F.transform("hashes", lambda h: vector_to_array(h)[0]).alias(name))
    both = buckets(model, "fitted").join(buckets(R.load_lsh(path), "loaded"), "id")
    return both.select("id", (D("fitted") == D("loaded")).alias("same"))


@query("n3_hnsw_index", f"{_T} SELECT vec_id AS id FROM e")
def _(spark, d):
    """The ids that a written and reread index holds."""
    from tessera.operators import hnsw
    from tessera.plans.storage_plans import fresh

    path = fresh(spark, "hnsw")
    hnsw.build_index(embeddings(spark, d)).write.parquet(path)
    return spark.read.parquet(path).select(F.explode("ids").alias("id"))


@query("n4_hnsw_nearest")
def _(spark, d):
    from tessera.operators import hnsw
    from tessera.storage import materialise

    e = embeddings(spark, d).select("id", "v")
    return hnsw.nearest(materialise(hnsw.build_index(e), "hnsw"), e.where("id % 100 = 0"), 10)


def buckets_sql(points: str, tables: int, width: float, seed: int = 42, size: int = 64) -> str:
    """CTEs: projections (the rule of ``neighbours.projections``) and keyed (id, t, place, bucket, v) of ``points`` (id, v)."""
    p = 2147483647
    return (
        f"numbers AS (SELECT t, i, c, {seed} * 1000003::BIGINT + 2 * (t * {size} + i) + c AS j FROM range({tables}) a(t), range({size}) b(i), range(2) d(c)), "
        f"one AS (SELECT *, (j * 48271 + 11) % {p} AS x FROM numbers), two AS (SELECT *, (x * x + j) % {p} AS y FROM one), three AS (SELECT *, (y * y + x) % {p} AS z FROM two), "
        f"uniform AS (SELECT t, i, c, ((z * z + y) % {p} + 0.5::DOUBLE) / {p} AS u FROM three), "
        "normal AS (SELECT a.t, a.i, sqrt(-2 * ln(a.u)) * cos(2 * pi() * b.u) AS x FROM uniform a JOIN uniform b ON a.t = b.t AND a.i = b.i AND a.c = 0 AND b.c = 1), "
        "projections AS (SELECT t, list(x / n ORDER BY i) AS p FROM normal JOIN (SELECT t, sqrt(sum(x * x)) AS n FROM normal GROUP BY t) USING (t) GROUP BY t), "
        f"placed AS (SELECT id, t, v, list_dot_product(v, p) / {width} AS place FROM {points}, projections), "
        "keyed AS (SELECT id, t, v, place, floor(place)::BIGINT AS bucket FROM placed)"
    )


UNIT_SQL = f"{_T}, unit AS (SELECT vec_id AS id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM e)"
_BUCKETS = {"tables": 5, "width": 0.5}


@query("n1_bucket_index", f"{UNIT_SQL}, {buckets_sql('unit', **_BUCKETS)} SELECT id, t AS \"table\", bucket FROM keyed")
def _(spark, d):
    """Each row's bucket in each hash table, from projections that were written and read back."""
    from tessera.plans.storage_plans import fresh

    path = fresh(spark, "projections")
    N.projections(spark, 64, _BUCKETS["tables"]).write.parquet(path)
    e = embeddings(spark, d).select("id", V.normalise(D("v")).alias("v"))
    return N.buckets(e, spark.read.parquet(path), _BUCKETS["width"]).select("id", "table", "bucket")


@query(
    "n2_lsh_nearest",
    f"{UNIT_SQL}, {buckets_sql('unit', **_BUCKETS)}, "
    "probes AS (SELECT id, t, v, unnest([bucket, CASE WHEN place - bucket >= 0.5 THEN bucket + 1 ELSE bucket - 1 END]) AS bucket FROM keyed WHERE id % 100 = 0), "
    "pairs AS (SELECT DISTINCT q.id AS query, k.id, q.v AS a, k.v AS b FROM probes q JOIN keyed k ON q.t = k.t AND q.bucket = k.bucket AND q.id <> k.id), "
    "ranked AS (SELECT query, id, list_dot_product(a, b) AS s FROM pairs) "
    "SELECT query, id, round(s, 5) AS similarity FROM ranked QUALIFY row_number() OVER (PARTITION BY query ORDER BY round(s, 12) DESC, id) <= 10",
)
def _(spark, d):
    """Ten neighbours of every hundredth row, all queries at once, from two buckets a hash table."""
    e = embeddings(spark, d).select("id", "v")
    found = N.bucket_nearest(e, e.where("id % 100 = 0"), 10, N.projections(spark, 64, _BUCKETS["tables"]), _BUCKETS["width"], near=2)
    return found.select("query", "id", F.round("similarity", 5).alias("similarity"))


@query(
    "n4_exact_nearest",
    f"{_T} SELECT query, id, similarity FROM (SELECT a.vec_id AS query, b.vec_id AS id, round({_COS}, 5) AS similarity, "
    f"row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS} DESC, b.vec_id) AS r FROM e a, e b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id) t WHERE r <= 10",
)
def _(spark, d):
    e = embeddings(spark, d).select("id", "v")
    return R.exact_nearest(e, e.where("id % 100 = 0"), 10).select("query", "id", F.round("similarity", 5).alias("similarity"))
