"""Feature vectors from grouped measurements."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.storage import local_frame, materialise

MOST_BROADCAST = 2_000_000  # keys; beyond that rows are shuffled


def _moments(columns: list[str]) -> Column:
    means = [F.avg(c) for c in columns]
    pairs = [F.covar_samp(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    return F.array(*means, *pairs)


def mean_and_covariance(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, features): the columns' means, then their sample covariances for i <= j, row by row.

    One row in a group leaves its covariances null.
    """
    return df.groupBy(key).agg(_moments(columns).alias("features"))


def _combined(k: int, pairs: list[tuple[int, int]]) -> Column:
    """The moments of a group of ``k`` columns from a list ``parts`` of its parts' (rows, n, total, c), combined from first to last.

    n and total: a column's values and their sum; c: a pair's sum of products of deviations. Covariances are null if a value is.
    """
    i, j = (f"array({', '.join(str(pair[side]) for pair in pairs)})" for side in (0, 1))
    zeros = f"array_repeat(0D, {k})"
    start = f"named_struct('m', 0D, 'n', array_repeat(0L, {k}), 't', {zeros}, 'x', {zeros}, 'c', array_repeat(0D, {len(pairs)}))"
    apart = lambda side: f"(a.x[{side}[q]] - s.total[{side}[q]] / s.rows)"
    added = f"transform(s.c, (c, q) -> c + a.c[q] + {apart(i)} * {apart(j)} * s.rows * a.m / (s.rows + a.m))"
    mean = "zip_with(a.x, s.total, (x, t) -> (t + a.m * x) / (s.rows + a.m))"
    total = "zip_with(a.t, s.total, (t, v) -> t + coalesce(v, 0D))"
    state = f"named_struct('m', s.rows + a.m, 'n', zip_with(a.n, s.n, (n, v) -> n + v), 't', {total}, 'x', {mean}, 'c', {added})"
    last = "concat(zip_with(a.t, a.n, (t, n) -> t / nullif(n, 0)), transform(a.c, c -> if(a.m > 1 AND forall(a.n, n -> n = a.m), c / (a.m - 1), null)))"
    return F.expr(f"aggregate(parts, {start}, (a, s) -> {state}, a -> {last})")


def in_row_groups(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of rows of Parquet files, the number of their row group in the order of the files' names as ``part``, and their number in the file as ``row``.

    Row groups are those of the files' footers; rows of a file without one are in part -1.
    """
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    rows, before = [], 0
    for file in sorted(df.inputFiles()):
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(file))
        reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(path, conf))
        try:
            counts = [block.getRowCount() for block in reader.getFooter().getBlocks()]
        finally:
            reader.close()
        # a file's name has one slash or three after its scheme
        rows += [(name, before, [sum(counts[:i]) for i in range(len(counts))]) for name in {file, re.sub(":/+", ":/", file, count=1)}]
        before += len(counts)
    starts = local_frame(df.sparkSession, rows, "file string, before long, starts array<long>")
    file, row = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    rows = df.select(*columns, file.alias("file"), row.alias("row")).join(F.broadcast(starts), "file", "left")
    part = F.col("before") + F.size(F.filter("starts", lambda s: s <= F.col("row"))) - 1
    return rows.select(*columns, F.coalesce(part, F.lit(-1)).alias("part"), "row")


def rounded_mean_and_covariance(df: DataFrame, key: str, columns: list[str], order: list[Column], decimals: tuple[int, int] = (4, 2), part: Column | None = None) -> DataFrame:
    """``mean_and_covariance``, means and covariances rounded, as if the rows were added up in the order of ``order``.

    A sum of doubles depends on the order of its terms, which decides how a value next to a half of the last
    decimal is rounded. Groups are combined as Spark does it; those with a value so near to a half that the
    rounding errors of two orders could lie on both sides are added up again from their rows in order. Such a
    group's rows go through one task, sorted, one at a time, since each sum starts from the one before.
    With ``part`` each part of a group is added up for itself, and then the parts in their order.
    """
    k = len(columns)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    scale = F.array(*[F.lit(10.0 ** decimals[0])] * k, *[F.lit(10.0 ** decimals[1])] * len(pairs))
    names, places = [f"c{i}" for i in range(k)], [f"place{i}" for i in range(len(order))]
    named = [F.col(c).alias(n) for c, n in zip(columns, names, strict=True)]
    whole = reduce(Column.__and__, [F.col(n).isNotNull() for n in names])
    once = df.select(F.col(key).alias("key"), *named).groupBy("key").agg(_moments(names).alias("features"), F.count(F.lit(1)).alias("n"), F.count_if(whole).alias("whole"))
    # two orders of n terms differ by less than 4n + 16 roundings of a term as large as the root of the mean square;
    # a covariance leaves rows with a null out
    size = [f"sqrt(features[{i}] * features[{i}] + coalesce(features[{k + pairs.index((i, i))}], 0D))" for i in range(k)]
    error = [f"size[{i}]" for i in range(k)] + [f"n / greatest(whole - 1, 1) * size[{i}] * size[{j}]" for i, j in pairs]
    once = once.withColumn("size", F.expr(f"array({', '.join(size)})")).withColumn("error", F.expr(f"array({', '.join(error)})"))
    within = F.zip_with("error", scale, lambda e, s: e * s * (4 * F.col("n") + 16) * 2.0**-53)
    to_half = F.zip_with("features", scale, lambda x, s: F.abs(F.abs(x * s) % 1 - 0.5))
    near = F.exists(F.zip_with(to_half, within, lambda x, e: F.coalesce(x <= e, F.lit(False))), lambda b: b)
    once = materialise(once.select("key", "features", near.alias("near")), "moments", few=True)
    again = once.where("near").select("key")
    if again.count() <= MOST_BROADCAST:
        again = F.broadcast(again)
    rows = df.select(F.col(key).alias("of"), *named, *[o.alias(p) for o, p in zip(order, places, strict=True)], *([] if part is None else [part.alias("part")]))
    rows = rows.join(again, F.col("of").eqNullSafe(F.col("key")), "left_semi").repartition("of").sortWithinPartitions("of", *places)
    if part is None:
        exact = rows.groupBy("of").agg(_moments(names).alias("exact"))
    else:
        sums = [F.count(F.lit(1)).cast("double").alias("rows"), F.array(*[F.count(n) for n in names]).alias("n"), F.array(*[F.sum(n) for n in names]).alias("total")]
        sums.append(F.array(*[F.covar_pop(names[i], names[j]) * F.count(F.lit(1)) for i, j in pairs]).alias("c"))
        parts = rows.groupBy("of", "part").agg(*sums)
        lists = parts.groupBy("of").agg(F.sort_array(F.collect_list(F.struct("part", "rows", "n", "total", "c"))).alias("parts"))
        # a group with nulls keeps its covariances
        exact = lists.select("of", _combined(k, pairs).alias("exact"))
    found = once.join(exact, F.col("key").eqNullSafe(F.col("of")), "left").select(F.col("key").alias(key), F.expr("if(near AND exact IS NOT NULL, zip_with(exact, features, (e, f) -> coalesce(e, f)), features)").alias("features"))
    # as SQL rounds a double: the nearest integer to the value times a power of ten
    rounded = F.zip_with("features", scale, lambda x, s: F.when(F.abs(x * s) == float("inf"), x).otherwise(F.round(x * s) / s))
    return found.select(key, rounded.alias("features"))


def mean_and_covariance_of_rows(df: DataFrame, key: str, matrix: str, width: int = 12) -> DataFrame:
    """The same over an array<array<double>> column; rows of another width raise an error."""
    rows = df.select(key, F.explode(matrix).alias("__r"))
    ok = F.when(F.size("__r") == width, F.col("__r")).otherwise(F.raise_error(F.lit(f"a row must have {width} values")).cast("array<double>"))
    rows = rows.select(key, ok.alias("__r"))
    flat = rows.select(key, *[F.col("__r")[i].alias(f"__{i}") for i in range(width)])
    return mean_and_covariance(flat, key, [f"__{i}" for i in range(width)])
