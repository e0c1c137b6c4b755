"""Factorisations: Cholesky over coordinate rows, LU, eigenvalues and singular values."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.blocks import TREE, Blocks, pack
from tessera.storage import discard, materialise


def cholesky(lower: DataFrame, n: int, least_pivot: float = 1e-9) -> DataFrame:
    """L of A = L L^T for rows (i, j, v) of A's lower triangle, i >= j from 0; right-looking by columns.

    Each step scales a column and subtracts its outer product from the rest, as joins on i and j. Raises
    ValueError for a missing element or a pivot below ``least_pivot``.
    """
    if lower.select("i", "j").distinct().count() != n * (n + 1) // 2:
        raise ValueError("an element of the lower triangle is missing")
    rest, done = materialise(lower.select("i", "j", F.col("v").cast("double").alias("v")), "cholesky"), None
    for k in range(n):
        pivot = rest.where((F.col("i") == k) & (F.col("j") == k)).first()["v"]
        if not pivot >= least_pivot:
            raise ValueError(f"the matrix is not positive definite (pivot {k}: {pivot})")
        root = float(np.sqrt(pivot))
        column = rest.where(F.col("j") == k).select("i", F.lit(k).alias("j"), (F.col("v") / root).alias("v"))
        column = materialise(column, "cholesky-column")
        done = column if done is None else done.unionByName(column)
        li, lj = column.select("i", F.col("v").alias("x")), column.select(F.col("i").alias("j"), F.col("v").alias("y"))
        left = rest.where(F.col("j") > k).join(li, "i", "left").join(lj, "j", "left")
        nxt = materialise(left.select("i", "j", (F.col("v") - F.coalesce(F.col("x") * F.col("y"), F.lit(0.0))).alias("v")), "cholesky")
        discard(rest)
        rest = nxt
    return done


def product_with_transpose(factor: DataFrame) -> DataFrame:
    """The lower triangle of L L^T from rows (i, j, v) of L."""
    a, b = factor.select("i", F.col("j").alias("k"), F.col("v").alias("x")), factor.select(F.col("i").alias("j"), F.col("j").alias("k"), F.col("v").alias("y"))
    return a.join(b, "k").where("i >= j").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("v"))


def lu(matrix: list[list[float]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """P, L, U with P A = L U by partial pivoting, of a small square matrix."""
    u = np.array(matrix, float)
    n = len(u)
    p, lower = np.eye(n), np.eye(n)
    for k in range(n):
        best = k + int(np.argmax(np.abs(u[k:, k])))
        if best != k:
            u[[k, best]] = u[[best, k]]
            p[[k, best]] = p[[best, k]]
            lower[[k, best], :k] = lower[[best, k], :k]
        if u[k, k] != 0:
            factors = u[k + 1 :, k] / u[k, k]
            lower[k + 1 :, k] = factors
            u[k + 1 :] -= factors[:, None] * u[k]
    return p, lower, np.triu(u)


def lu_each(matrices: DataFrame) -> DataFrame:
    """(name, factor, i, j, v) for rows (name, m array<array<double>>): factors P, L and U."""

    def run(batches):
        import pandas as pd

        for batch in batches:
            rows = [
                (name, f, i, j, float(x))
                for name, m in zip(batch["name"], batch["m"], strict=True)
                for f, values in zip("PLU", lu([list(r) for r in m]), strict=True)
                for (i, j), x in np.ndenumerate(values)
            ]
            yield pd.DataFrame(rows, columns=["name", "factor", "i", "j", "v"])

    return matrices.select("name", "m").mapInPandas(run, "name string, factor string, i int, j int, v double")


def gram(df: DataFrame, columns: list[str]) -> DataFrame:
    """(i, j, v) for i <= j of X^T X: one pass of sums, whatever the number of rows."""
    sums = [F.sum(F.col(a) * F.col(b)).alias(f"{i}_{j}") for i, a in enumerate(columns) for j, b in enumerate(columns) if i <= j]
    one = df.agg(*sums)
    each = F.array(*[F.struct(F.lit(int(c.split("_")[0])).alias("i"), F.lit(int(c.split("_")[1])).alias("j"), F.col(c).cast("double").alias("v")) for c in one.columns])
    return one.select(F.inline(each))


def triangular_factor(rows: Blocks) -> np.ndarray:
    """R of the rows' matrix X = Q R, by a tree: each task factors its blocks one after another, and pairs of factors are factored again.

    Only R, as wide as the features, leaves a task. Its singular values are those of X to about the machine's
    precision times the largest, where those of X^T X lose half of their digits.
    """

    def factor(blocks):
        out = None
        for x, _, _ in blocks:
            out = np.linalg.qr(x if out is None else np.vstack([out, x]), mode="r")
        return iter([] if out is None else [out])

    parts, add = rows.kept.mapPartitions(factor), lambda a, b: np.linalg.qr(np.vstack([a, b]), mode="r")
    return parts.treeReduce(add, 2) if parts.getNumPartitions() > TREE else parts.reduce(add)


def singular_values_of_rows(df: DataFrame, features: Column) -> np.ndarray:
    """Singular values of the matrix of an array<double> column, descending; at most as many as rows. Rows with a null are left out."""
    rows = pack(df, features, F.lit(0.0))
    try:
        return np.linalg.svd(triangular_factor(rows), compute_uv=False) if rows.rows else np.zeros(0)
    finally:
        rows.discard()


def singular_values(df: DataFrame, columns: list[str]) -> list[float]:
    """Singular values of the rows' matrix from the eigenvalues of its small Gram matrix, descending."""
    n = len(columns)
    g = np.zeros((n, n))
    for r in gram(df, columns).collect():  # n * (n + 1) / 2 rows
        g[r["i"], r["j"]] = g[r["j"], r["i"]] = r["v"]
    return np.sqrt(np.clip(np.linalg.eigvalsh(g)[::-1], 0, None)).tolist()
