"""Recommendation: graph expansion, hybrid blending, nearest neighbours."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import BucketedRandomProjectionLSH, BucketedRandomProjectionLSHModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessera.functions.scalars import weighted_blend
from tessera.functions.vector import cosine, cosine_of_unit_distance, normalise
from tessera.operators.graph import k_hop, proximity_scores
from tessera.operators.relational import min_max, top_k


def bfs_recommend(
    edges: DataFrame, items: DataFrame, seed_item, depth: int = 2, candidates: int = 200, k: int = 20, exclude_owner: bool = False, mode: str = "ball",
) -> DataFrame:
    """Items near a seed item's owner, the hottest ``candidates`` of them, by cosine to the seed item.

    items: (item, owner, hotness, v). A NaN hotness counts as missing, and missing comes last.
    """
    seed = items.where(F.col("item") == F.lit(seed_item)).select(F.col("owner").alias("seed"), F.col("v").alias("__v"))
    owners = k_hop(edges, seed.select("seed"), depth, mode).select("seed", F.col("id").alias("owner"))
    if exclude_owner:
        owners = owners.where("owner != seed")
    hotness = F.when(F.isnan("hotness"), None).otherwise(F.col("hotness"))
    near = items.join(owners.select("owner").distinct(), "owner", "left_semi").where(F.col("item") != F.lit(seed_item))
    hot = top_k(near.withColumn("hotness", hotness), candidates, F.desc_nulls_last("hotness"), F.asc("item"))
    scored = hot.crossJoin(F.broadcast(seed.select("__v"))).withColumn("similarity", cosine(F.col("v"), F.col("__v")))
    return top_k(scored.select("item", "owner", "similarity"), k, F.desc("similarity"), F.asc("item"))


def weighted_mean(rows: DataFrame, size: int) -> DataFrame:
    """One row (v): the weighted mean of rows (weight, v), of unit length."""
    each = rows.select("weight", F.posexplode("v").alias("at", "x"))
    means = each.groupBy("at").agg((F.sum(F.col("weight") * F.col("x")) / F.sum("weight")).alias("m"))
    v = F.transform(F.array_sort(F.collect_list(F.struct("at", "m"))), lambda s: s["m"])
    return means.agg(v.alias("v")).select(normalise(F.col("v")).alias("v"))


def hybrid_recommend(
    edges: DataFrame, items: DataFrame, seeds: list, k: int = 10, depth: int = 3, weights: tuple[float, float, float] = (0.4, 0.4, 0.2), exclude_seeds: bool = True,
) -> DataFrame:
    """(id, score): graph proximity, similarity to the seeds' mean vector and hotness, blended.

    items: (id, hotness, v). Similarity and hotness are scaled to 0..1 over the candidates.
    """
    spark = items.sparkSession
    seed_rows = spark.createDataFrame([(s,) for s in seeds], ["seed"]).select(F.col("seed").cast(items.schema["id"].dataType).alias("seed"))
    near = proximity_scores(edges, seed_rows, depth)
    if exclude_seeds:
        near = near.join(F.broadcast(seed_rows), near["id"] == seed_rows["seed"], "left_anti")
    mean = weighted_mean(items.join(F.broadcast(seed_rows), items["id"] == seed_rows["seed"]).select(F.lit(1.0).alias("weight"), "v"), 0)
    # only near items' vectors are shuffled
    rows = items.join(near, "id").dropDuplicates(["id"]).crossJoin(F.broadcast(mean.withColumnRenamed("v", "__m")))
    rows = rows.select("id", "score", F.coalesce(F.nanvl("hotness", F.lit(None).cast("double")), F.lit(0.0)).alias("hot"), cosine(F.col("v"), F.col("__m")).alias("sim"))
    rows = min_max(min_max(rows, "sim", "sim01"), "hot", "hot01")
    blend = weighted_blend([(F.col("score"), weights[0]), (F.col("sim01"), weights[1]), (F.col("hot01"), weights[2])])
    return top_k(rows.select("id", blend.alias("score")), k, F.desc("score"), F.asc("id"))


def lsh_index(points: DataFrame, bucket: float = 0.1, tables: int = 5, seed: int = 42):
    """A model over rows (id, v), with its unit vectors; ``save_lsh`` and ``load_lsh`` keep the model."""
    unit = points.select("id", array_to_vector(normalise(F.col("v"))).alias("features"))
    return BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", bucketLength=bucket, numHashTables=tables, seed=seed).fit(unit), unit


def save_lsh(model, path: str) -> None:
    model.write().overwrite().save(path)


def load_lsh(path: str) -> BucketedRandomProjectionLSHModel:
    return BucketedRandomProjectionLSHModel.load(path)


def lsh_recommend(model, unit: DataFrame, query: list[float], seeds: list, k: int) -> DataFrame:
    """(id, similarity) of about the k nearest to a unit vector, without the seeds."""
    from pyspark.ml.linalg import Vectors

    found = model.approxNearestNeighbors(unit, Vectors.dense(query), k + len(seeds), distCol="d")
    found = found.where(~F.col("id").isin(seeds)) if seeds else found
    return top_k(found.select("id", cosine_of_unit_distance(F.col("d")).alias("similarity")), k, F.desc("similarity"), F.asc("id"))


def blocks_of(rows: DataFrame, size: int) -> Iterator[list]:
    """The rows in lists of ``size``, one list on the driver at a time."""
    block = []
    for r in rows.toLocalIterator():
        block.append(r)
        if len(block) == size:
            yield block
            block = []
    if block:
        yield block


def exact_nearest(points: DataFrame, queries: DataFrame, k: int, most_queries: int = 5000) -> DataFrame:
    """(query, id, similarity): the k most similar rows (id, v) to each query row, itself left out.

    Queries are sent to all tasks in blocks of ``most_queries``; a task keeps k a query from each batch, so
    what moves is k rows a query and task, never all pairs. Similarities of 256 queries and a batch are in memory.
    """
    spark = points.sparkSession
    ids = points.schema["id"].dataType.simpleString()
    numbered = queries.select(F.col("id"), F.col("v").cast("array<double>").alias("v"))
    out = None
    for block in blocks_of(numbered, most_queries):
        names = np.array([r["id"] for r in block])
        q = np.array([r["v"] for r in block], float)
        q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
        shared = spark.sparkContext.broadcast((names, q))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, q = shared.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                v = np.array(batch.column(1).to_pylist(), float)
                v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
                own, kind = np.array(batch.column(0).to_pylist()), batch.column(0).type
                n = min(k, len(own))
                for lo in range(0, len(names), 256):  # 256 queries against a batch at a time
                    some = names[lo : lo + 256]
                    s = q[lo : lo + 256] @ v.T
                    s[some[:, None] == own[None, :]] = -np.inf
                    # all that reach the k-th best similarity, ties by id
                    least = np.partition(s, s.shape[1] - n, axis=1)[:, s.shape[1] - n]
                    rows, at = np.nonzero((s >= least[:, None] - 1e-12) & np.isfinite(s))
                    order = np.lexsort((own[at], -np.round(s[rows, at], 12), rows))
                    rows, at = rows[order], at[order]
                    begin = np.searchsorted(rows, np.arange(len(some)))
                    ok = np.arange(len(rows)) - begin[rows] < n
                    rows, at = rows[ok], at[ok]
                    yield pa.RecordBatch.from_arrays([pa.array(some[rows]).cast(kind), pa.array(own[at]).cast(kind), pa.array(s[rows, at])], names=["query", "id", "similarity"])

        found = points.select("id", F.col("v").cast("array<double>")).mapInArrow(run, f"query {ids}, id {ids}, similarity double")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], f"query {ids}, id {ids}, similarity double")
    from tessera.operators.relational import top_per_key

    return top_per_key(out, ["query"], k, F.desc("similarity"), F.asc("id"))


def cosine_matrix(candidates: DataFrame, seeds: DataFrame) -> DataFrame:
    """(id, seed, similarity) for every candidate (id, v) and every seed (seed, v); few seeds are broadcast by the planner."""
    return candidates.crossJoin(seeds.select("seed", F.col("v").alias("__v"))).select("id", "seed", cosine(F.col("v"), F.col("__v")).alias("similarity"))


def _packs(rows: DataFrame, size: int = 1024) -> DataFrame:
    """(ids, x) for rows (id, v): vectors of up to ``size`` rows of a task as a binary matrix; a null vector is all NaN."""
    kind = rows.schema["id"].dataType.simpleString()
    rows = rows.select("id", F.col("v").cast("array<double>").alias("v"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, size):
                part = batch.slice(lo, size)
                lists, there = part.column(1), np.asarray(part.column(1).is_valid())
                flat = np.asarray(lists.flatten(), float)
                x = np.full((len(there), len(flat) // max(1, there.sum())), np.nan)
                x[there] = flat.reshape(there.sum(), -1)
                ids = pa.ListArray.from_arrays(pa.array([0, len(there)], pa.int32()), part.column(0))
                yield pa.RecordBatch.from_arrays([ids, pa.array([x.tobytes()], pa.binary())], names=["ids", "x"])

    return rows.mapInArrow(pack, f"ids array<{kind}>, x binary")


def distances_from(queries: DataFrame, rows: DataFrame) -> DataFrame:
    """(a, b, d): the Euclidean distance from each query row (id, v) to every other row (id, v); null where a vector is.

    Packs of rows meet packs of queries, each two of them once in some task, and are compared in numpy: nothing is
    shuffled but the packs, and a task holds a few packs whatever the numbers of rows and queries.
    """
    context, kind = rows.sparkSession.sparkContext, rows.schema["id"].dataType
    arrow_id, name = to_arrow_type(kind), kind.simpleString()
    some = lambda t, most: max(1, min(most, t.count() // 256))
    cores = context.defaultParallelism
    left = _packs(rows.select("id", "v").repartition(some(rows, 4 * cores))).toDF("b", "vb")
    right = _packs(queries.select(F.col("id").cast(name).alias("id"), "v").repartition(some(queries, 4))).toDF("a", "va")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                (b, x), (a, y) = ((batch.column(k)[at].values, np.frombuffer(batch.column(k + 1)[at].as_buffer())) for k in (0, 2))
                x, y = x.reshape(len(b), -1), y.reshape(len(a), -1)
                if not x.shape[1] or not y.shape[1]:  # only null vectors
                    x, y = np.full((len(b), 1), np.nan), np.full((len(a), 1), np.nan)
                names, asked = (c.to_numpy(zero_copy_only=False) for c in (b, a))
                for lo in range(0, len(a), 64):
                    d = np.empty((len(y[lo : lo + 64]), len(b)))
                    for k, q in enumerate(y[lo : lo + 64]):
                        gap = x - q
                        d[k] = np.sqrt(np.einsum("ij,ij->i", gap, gap))
                    i, j = np.nonzero(asked[lo : lo + 64][:, None] != names[None, :])
                    found = d[i, j]
                    yield pa.RecordBatch.from_arrays([a.take(pa.array(i + lo)), b.take(pa.array(j)), pa.array(found, pa.float64(), mask=np.isnan(found))], names=["a", "b", "d"])

    pairs = left.hint("shuffle_replicate_nl").crossJoin(right)
    return pairs.mapInArrow(compare, f"a {name}, b {name}, d double")
