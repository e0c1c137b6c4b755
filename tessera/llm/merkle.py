"""Merkle manifest of a dataset: every row's proof, built bottom-up and pushed top-down.

Rows are leaves in the order of a key within their group. Every ``arity`` consecutive nodes of a group have a
parent, until one node is left, the group's subroot; subroots in the order of the groups have parents likewise,
up to the root. Each level is a written table of nodes that keep their children's digests, made from the one
below by a grouped aggregation. Proofs come down again: a node's proof joins it by its number, and each child
prepends its siblings to it, so a level moves only its own nodes and no row ever meets its ancestors one by one.
The lowest nodes keep their leaves' rows, so the longest proofs never leave the task that makes them.

Numbers come from range partitions and their counts, so a group with most rows is in many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.relational import row_numbers
from tessera.storage import materialise

PROOF = "array<struct<before:string,after:string>>"


def framed(value: Column) -> Column:
    """UTF-8 byte count, ``:``, value; ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*fields: Column) -> Column:
    """Digest of a row's fields, each framed."""
    return F.sha2(F.concat(*[framed(f) for f in fields]), 256)


def fold(start: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, start, lambda digest, step: F.sha2(F.concat(step["before"], digest, step["after"]), 256))


def digest_of_proof(proof: Column) -> Column:
    """Digest of all siblings, level by level from the leaf, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda step: F.concat(step["before"], step["after"])), ""), 256)


def _numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Written rows with ``g`` (a number a group, ascending with it), ``idx`` from 0 and ``size`` within their group."""
    keys = [group, *order, "__at"]  # the place in the input tells repeated rows apart
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = materialise(ranged.select("*", F.spark_partition_id().alias("__p"), F.monotonically_increasing_id().alias("__k")), "merkle-leaves")
    # a row for each group that a partition holds
    parts = placed.groupBy("__p", group).agg(F.count(F.lit(1)).alias("__n"), F.min("__k").alias("__first"))
    whole = Window.partitionBy(group)
    parts = parts.select(
        "__p", F.col(group).alias("__group"), "__first", F.min("__first").over(whole).alias("g"), F.sum("__n").over(whole).alias("size"),
        (F.sum("__n").over(whole.orderBy("__p")) - F.col("__n")).alias("__before"),
    )
    out = placed.join(parts.withColumnRenamed("__p", "__q"), (F.col("__p") == F.col("__q")) & F.col(group).eqNullSafe(F.col("__group")))
    return out.select("g", (F.col("__before") + F.col("__k") - F.col("__first")).alias("idx"), "size", F.struct(*rows.columns).alias("row"))


def _heights(most: int, arity: int) -> Iterator[int]:
    """Sizes of the levels over ``most`` nodes, down to 1."""
    while most > 1:
        most = -(-most // arity)
        yield most


def _rise(nodes: DataFrame, most: int, arity: int, child: Column) -> list[DataFrame]:
    """Written levels above ``nodes`` (g, idx, size, ...), lowest first: (g, idx, size, digest, children).

    ``child``: what of a node its parent keeps, a struct with ``digest`` among its fields.
    """
    levels = []
    for _ in _heights(most, arity):
        up = nodes.where("size > 1").groupBy("g", F.expr(f"idx DIV {arity}").alias("up"), F.ceil(F.col("size") / arity).alias("fewer"))
        # at most ``arity`` children
        kept = up.agg(F.array_sort(F.collect_list(F.struct(F.col("idx").alias("at"), child.alias("child")))).alias("found"))
        kept = kept.select("g", F.col("up").alias("idx"), F.col("fewer").alias("size"), F.transform("found", lambda x: x["child"]).alias("children"))
        digest = F.sha2(F.array_join(F.transform("children", lambda x: x["digest"]), ""), 256)
        nodes = materialise(kept.withColumn("digest", digest), "merkle-level")
        levels.append(nodes)
        child = F.struct("digest")
    return levels


def _children(nodes: DataFrame, arity: int, *carried: str) -> DataFrame:
    """(g, idx, child, proof, *carried) for each child of nodes that have their own proof: its siblings come before it."""
    parts = nodes.select("g", F.col("idx").alias("up"), F.col("children").alias("c"), F.posexplode("children").alias("at", "child"), F.col("proof").alias("above"), *carried)
    before = F.array_join(F.transform(F.slice("c", F.lit(1), F.col("at")), lambda x: x["digest"]), "")
    after = F.array_join(F.transform(F.slice("c", F.col("at") + 2, F.lit(arity)), lambda x: x["digest"]), "")
    step = F.array(F.struct(before.alias("before"), after.alias("after")))
    return parts.select("g", (F.col("up") * arity + F.col("at")).alias("idx"), "child", F.concat(step, F.col("above")).cast(PROOF).alias("proof"), *carried)


def manifest(rows: DataFrame, group: str, order: list[str], digest: str = "digest", arity: int = 3) -> DataFrame:
    """``rows`` with ``subroot``, ``root`` and ``proof``: an array of the siblings before and after, from the leaf to the root.

    ``digest`` is the column of the leaves' digests. Groups are ordered by their value, null first, and rows of
    a group by ``order``, nulls first, then by digest; rows equal in all of these follow one another in the
    order of the input. Null groups are a group. A table of one row has an empty proof; an empty one has no
    rows. Columns whose names begin with two underscores are reserved.
    """
    names = rows.columns
    kept = rows.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)], F.monotonically_increasing_id().alias("__at"))
    at = {c: f"c{k}" for k, c in enumerate(names)}
    rows = materialise(kept, "merkle-rows")
    leaves = _numbered(rows, at[group], [*[at[c] for c in order], at[digest]])
    leaves = leaves.withColumn("digest", F.col(f"row.{at[digest]}"))
    most = leaves.agg(F.max("size")).first()[0] or 0
    levels = _rise(leaves, most, arity, F.struct("digest", "row"))

    # subroots: the only node of a group, at whatever level
    alone = leaves.where("size = 1").select("g", F.lit(0).alias("level"), "digest")
    tops = reduce(DataFrame.unionByName, [alone, *[n.where("size = 1").select("g", F.lit(k).alias("level"), "digest") for k, n in enumerate(levels, 1)]])
    tops = row_numbers(tops, "g", name="number")
    count = tops.count()
    tops = materialise(tops.select(F.lit(0).cast("long").alias("g"), (F.col("number") - 1).alias("idx"), F.lit(count).cast("long").alias("size"), "digest", F.col("g").alias("group"), "level"), "merkle-tops")
    over = _rise(tops, count, arity, F.struct("digest", "group", "level"))
    root = (over[-1] if over else tops).first()
    root = F.lit(root["digest"] if root else None).cast("string")

    none = F.array().cast(PROOF)
    if over:
        down = over[-1].select("g", "idx", none.alias("proof"))
        for k in range(len(over) - 1, -1, -1):
            children = _children(over[k].join(down, ["g", "idx"]), arity)
            down = children.select("g", "idx", "proof") if k else children
        proofs = down.select(F.col("child.group").alias("g"), F.col("child.level").alias("level"), F.col("child.digest").alias("subroot"), "proof")
    else:
        proofs = tops.select(F.col("group").alias("g"), "level", F.col("digest").alias("subroot"), none.alias("proof"))
    proofs = materialise(proofs, "merkle-proofs")

    down = None
    for k in range(len(levels), 0, -1):
        begins = proofs.where(F.col("level") == k).select("g", F.lit(0).cast("long").alias("idx"), "proof", "subroot")
        down = begins if down is None else down.unionByName(begins)
        children = _children(levels[k - 1].join(down, ["g", "idx"]), arity, "subroot")
        down = children.select("g", "idx", "proof", "subroot") if k > 1 else children
    lone = leaves.where("size = 1").join(proofs.where("level = 0"), "g").select("row", "subroot", "proof")
    out = lone if down is None else down.select(F.col("child.row").alias("row"), "subroot", "proof").unionByName(lone)
    return out.select(*[F.col(f"row.c{k}").alias(c) for k, c in enumerate(names)], "subroot", root.alias("root"), "proof")
