"""Connected components by alternating large-star and small-star steps, each step a grouped aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tessera.storage import discard, materialise


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    linked = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return linked.unionByName(least.select("a", F.col("m").alias("b"))).where("a != b").distinct()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root), written, for rows (a, b): root is the smallest node of the component; nodes with no link are absent.

    A node that meets itself counts as no link; repeated and reversed links count once. The number of
    rounds grows with the logarithm of the longest path.
    """
    edges = materialise(links.where("a != b").select("a", "b").distinct(), "cc", few=True)
    sign = None
    for _ in range(most_rounds):
        seen = Observation()  # counted while the round is written
        stars = _small_star(_large_star(edges)).observe(
            seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b") % 1_000_003).alias("x"), F.sum(F.xxhash64("b", "a") % 999_983).alias("y")
        )
        nxt = materialise(stars, "cc", few=True)
        now = seen.get
        discard(edges)
        edges = nxt
        if now == sign:
            break
        sign = now
    else:
        raise RuntimeError("components didn't settle")
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
    out = materialise(roots, "cc-roots", few=True)
    discard(edges)
    return out
