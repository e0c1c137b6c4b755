"""Sequence packing by non-negative least squares over a length histogram.

Documents are cut at multiples of the window; whole windows are sequences as they are. What is left of
each document is a tail shorter than the window. Tail lengths are put in bins whose upper edges divide
the window; shallow combinations of bins (up to ``depth`` parts) that fill the window exactly are
enumerated, and Lawson-Hanson non-negative least squares finds how often to repeat each so that their
sum matches the histogram. Counts are rounded down to what the bins hold, further combinations are taken
greedily, and the tails that remain are packed end to end, cut where a window ends.

The driver sees the histogram (one count a bin) and the plan (a few rows a combination), never rows of
documents. Ranks within a bin are built from salted groups, so a bin that holds most tails is split.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import column, groups_of, slices, small_batches
from tessera.llm.tokens import proven_tokens, word_tokens
from tessera.storage import local_frame, materialise

ROWS_PER_SALT = 10_000


def combinations(bins: int, depth: int) -> list[tuple[int, ...]]:
    """All descending tuples of up to ``depth`` positive integers with the sum ``bins``."""
    found: list[tuple[int, ...]] = []

    def extend(head: tuple[int, ...], rest: int, most: int) -> None:
        if rest == 0:
            found.append(head)
        elif len(head) < depth:
            for part in range(min(rest, most), 0, -1):
                if part * (depth - len(head)) < rest:
                    break
                extend((*head, part), rest - part, part)

    extend((), bins, bins)
    return found


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """Lawson-Hanson: x >= 0 that minimises |a x - b|."""
    x, active = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    gram, right = a.T @ a, a.T @ b
    slack = 1e-9 * max(1.0, float(np.abs(b).max(initial=0)))
    for _ in range(rounds):
        gain = right - gram @ x
        gain[active] = -np.inf
        best = int(np.argmax(gain))
        if gain[best] <= slack:
            break
        active[best] = True
        while True:
            at = np.flatnonzero(active)
            try:
                trial = np.linalg.solve(gram[np.ix_(at, at)], right[at])
            except np.linalg.LinAlgError:  # columns that depend on each other
                trial = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if (trial > 0).all():
                x[:] = 0
                x[at] = trial
                break
            low = trial <= 0
            step = np.min(x[at][low] / np.maximum(x[at][low] - trial[low], 1e-300))
            x[at] += step * (trial - x[at])
            active[at[low & (x[at] <= slack)]] = False
            x[~active] = 0
            if not active.any():
                break
    return x


def plan(histogram: np.ndarray, depth: int = 3) -> list[tuple[tuple[int, ...], int]]:
    """(combination, repeats) whose bins together hold no more than ``histogram`` (index 0 unused)."""
    bins = len(histogram) - 1
    combos = combinations(bins, depth)
    a = np.zeros((bins, len(combos)))
    for k, combo in enumerate(combos):
        for part in combo:
            a[part - 1, k] += 1
    left = histogram[1:].astype(np.int64).copy()
    x = nnls(a, left.astype(float))
    repeats = np.zeros(len(combos), np.int64)
    shallow = np.argsort([len(c) for c in combos], kind="stable")
    for order, wanted in ((np.argsort(-x, kind="stable"), np.floor(x + 1e-6)), (shallow, np.full(len(combos), np.inf))):
        for k in order:
            need = a[:, k].astype(np.int64)
            most = int((left[need > 0] // need[need > 0]).min())
            take = int(min(most, wanted[k]))
            if take > 0:
                repeats[k] += take
                left -= take * need
    return [(combos[k], int(repeats[k])) for k in np.flatnonzero(repeats)]


def token_blocks(docs: DataFrame, path: str, window: int, end_id: int | None, id_col: str, text_col: str) -> DataFrame:
    """(key, id, doc_tokens, start, length, ids) for each window of each document; key numbers these rows."""

    whole = proven_tokens(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, end = word_tokens(path, whole.value), array("I", [] if end_id is None else [end_id]).tobytes()
        step = 4 * window
        for batch in slices(batches):
            texts = column(batch, 1)
            for lo, hi in groups_of(texts):
                row, start, ids, total = [], [], [], []
                for i, one in enumerate(tokens.encode(texts[lo:hi]), lo):
                    one += end
                    for at in range(0, len(one), step):
                        row.append(i)
                        start.append(at // 4)
                        total.append(len(one) // 4)
                        ids.append(one[at : at + step])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row, pa.int32())), pa.array(total, pa.int64()), pa.array(start, pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                    names=["id", "doc_tokens", "start", "length", "ids"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    found = rows.mapInArrow(run, f"id {kind}, doc_tokens long, start long, length long, ids binary")
    return found.select(F.monotonically_increasing_id().alias("key"), "*")


def place_tails(tails: DataFrame, window: int, bins: int, depth: int) -> DataFrame:
    """(key, at, take, sequence, offset) for rows (key, length): where each tail, or part of one, goes."""
    spark, width = tails.sparkSession, window // bins
    binned = tails.select("key", "length", F.ceil(F.col("length") / width).cast("int").alias("bin"))
    histogram = np.zeros(bins + 1, np.int64)
    for r in binned.groupBy("bin").count().collect():  # at most one row a bin
        histogram[r["bin"]] = r["count"]
    salts = max(16, -(-int(histogram.max()) // ROWS_PER_SALT))
    binned = binned.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(salts)).cast("int"))

    slots, base = [], 0
    used = np.zeros(bins + 1, np.int64)
    for combo, repeats in plan(histogram, depth):
        for position, part in enumerate(combo):
            slots.append((part, int(used[part]), int(used[part]) + repeats, base, position))
            used[part] += repeats
        base += repeats
    slot_rows = local_frame(spark, slots, "slot_bin int, lo long, hi long, base long, position int")

    group = Window.partitionBy("bin", "salt")
    sizes = binned.groupBy("bin", "salt").agg(F.count("*").alias("n"))
    before = sizes.select("bin", "salt", (F.sum("n").over(Window.partitionBy("bin").orderBy("salt")) - F.col("n")).alias("before"))
    ranked = binned.withColumn("rank", F.row_number().over(group.orderBy("key")) - 1).join(before, ["bin", "salt"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("before"))
    # slot_rows is broadcast: its size is bounded by the number of combinations a basic solution and
    # the greedy pass can use, whatever the number of documents.
    fits = (F.col("bin") == F.col("slot_bin")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))
    dealt = ranked.join(F.broadcast(slot_rows), fits, "left").select(
        "key", "length", "bin", "salt", "rank", "position", (F.col("base") + F.col("rank") - F.col("lo")).alias("sequence")
    )
    dealt = materialise(dealt, "pack-dealt")

    own = Window.partitionBy("sequence").orderBy("position")
    planned = dealt.where("sequence is not null").select(
        "key", F.lit(0).cast("long").alias("at"), F.col("length").alias("take"), "sequence",
        (F.sum("length").over(own) - F.col("length")).alias("offset"),
    )
    rest = dealt.where("sequence is null")
    # a row a salt: the bins' sums on the driver, the salts' within each bin
    sums = rest.groupBy("bin", "salt").agg(F.sum("length").alias("n"))
    total, starts = 0, []
    for r in sorted(sums.groupBy("bin").agg(F.sum("n").alias("n")).collect()):  # at most a row a bin
        starts.append((r["bin"], total))
        total += r["n"]
    within = sums.select("bin", "salt", (F.sum("n").over(Window.partitionBy("bin").orderBy("salt")) - F.col("n")).alias("within"))
    before = within.join(F.broadcast(local_frame(spark, starts, "bin int, start long")), "bin").select("bin", "salt", (F.col("within") + F.col("start")).alias("before"))
    from_ = F.col("before") + F.sum("length").over(group.orderBy("rank")) - F.col("length")
    stream = rest.join(before, ["bin", "salt"]).withColumn("from", from_)
    end = F.col("from") + F.col("length")
    edge = F.least(end, (F.floor(F.col("from") / window) + 1) * window)
    cut = F.array(
        F.struct(F.col("from").alias("a"), edge.alias("b")),
        F.struct(edge.alias("a"), end.alias("b")),
    )
    streamed = (
        stream.select("key", "from", F.explode(cut).alias("p"))
        .where("p.b > p.a")
        .select(
            "key", (F.col("p.a") - F.col("from")).alias("at"), (F.col("p.b") - F.col("p.a")).alias("take"),
            (F.floor(F.col("p.a") / window) + base).alias("sequence"), (F.col("p.a") % window).alias("offset"),
        )
    )
    return planned.unionByName(streamed)


def pack(
    docs: DataFrame, path: str, window: int = 2048, bins: int = 128, depth: int = 3, end_id: int | None = 1, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, start, length, ids, doc_tokens, sequence_id, offset) per piece; ids are unsigned 32-bit, little-endian.

    Every id of every row is in exactly one piece; null text counts as empty and still has the end id.
    Without an end id an empty document has no piece. Repeated rows are packed each on its own. An empty
    table gives an empty result. Columns other than id and text are not read.
    """
    small_batches(docs.sparkSession)
    blocks = materialise(token_blocks(docs, path, window, end_id, id_col, text_col), "pack-blocks")
    full = blocks.where(F.col("length") == window)
    tails = blocks.where(F.col("length") < window)
    # even numbers: whole windows, by their key; odd numbers: the planned sequences
    whole = full.select(
        F.col("id").alias(id_col), "start", "length", "ids", "doc_tokens",
        (F.col("key") * 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
    )
    placed = place_tails(tails.select("key", "length"), window, bins, depth)
    cut = tails.join(placed, "key").select(
        F.col("id").alias(id_col), (F.col("start") + F.col("at")).alias("start"), F.col("take").alias("length"),
        F.expr("substring(ids, cast(at * 4 + 1 as int), cast(take * 4 as int))").alias("ids"), "doc_tokens",
        (F.col("sequence") * 2 + 1).alias("sequence_id"), F.col("offset").cast("long"),
    )
    return whole.unionByName(cut)
