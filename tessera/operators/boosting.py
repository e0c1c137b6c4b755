"""Boosted regression trees of second order over matrix blocks.

Features become bin numbers once: a weighted quantile sketch, merged over the tasks, gives each feature's edges,
and every distinct value has its own bin where there are no more of them than bins. Rows with the same bin numbers are
one cell, since every tree gives them the same margin: their number and their labels' sum are all that a sum of gradients
needs. So rounds read cells, of which there are no more than rows and than products of bins. A level of a tree is one
pass over them: tasks sum gradients and Hessians by (node, feature, bin), a tree of tasks adds the sums, and the driver,
which sees only these sums (nodes x features x bins), takes the split of largest gain for every node. Missing
values (NaN) go to the side where they gain more. A tree's first pass adds the tree
before it to the cells' margins and keeps these for the other levels; every ``keep`` trees they are computed afresh, so
no lineage grows with the trees.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.blocks import TREE, Blocks, pack
from tessera.operators.descent import sigmoid
from tessera.storage import discard, local_frame, materialise

#: Cells that a task adds up before it sends them on, cells of a block, and cells whose margin a predicting task remembers.
CELLS, SENT, KNOWN = 1 << 19, 1 << 16, 1 << 20
SCHEMA = "tree int, node int, feature int, threshold double, bin int, missing_left boolean, weight double, gain double, cover double"


@dataclass
class Tree:
    """A complete binary tree in heap order: node k has the children 2k + 1 and 2k + 2; feature -1 marks a leaf."""

    feature: np.ndarray
    bin: np.ndarray
    threshold: np.ndarray
    missing_left: np.ndarray
    weight: np.ndarray
    gain: np.ndarray
    cover: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return cls(np.full(n, -1), np.zeros(n, int), np.zeros(n), np.zeros(n, bool), np.zeros(n), np.zeros(n), np.zeros(n))

    def nodes(self, x: np.ndarray, ends: np.ndarray, missing, levels: int) -> np.ndarray:
        """The node of each row of ``x`` after ``levels`` levels: left where its number is at most the node's of ``ends``."""
        at = np.zeros(len(x), np.int64)
        flat, base = np.ascontiguousarray(x).ravel(), np.arange(len(x)) * x.shape[1]
        inner, feature = self.feature >= 0, np.maximum(self.feature, 0)
        for _ in range(levels):
            v = flat.take(base + feature.take(at))
            right = v > ends.take(at)
            gone = missing(v)
            if gone.any():
                right[gone] = ~self.missing_left.take(at[gone])
            at = np.where(inner.take(at), 2 * at + 1 + right, at)
        return at

    def of_bins(self, bins: np.ndarray, levels: int, last: int) -> np.ndarray:
        return self.nodes(bins, self.bin, lambda v: v == last, levels)

    def of_values(self, x: np.ndarray, levels: int) -> np.ndarray:
        return self.nodes(x, self.threshold, np.isnan, levels)


@dataclass
class Boosted:
    """Trees, and what they were fitted with."""

    base: float
    depth: int
    loss: str
    trees: list[Tree] = field(default_factory=list)

    def margins(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for t in self.trees:
            out += t.weight[t.of_values(x, self.depth)]
        return out

    def table(self, spark: SparkSession) -> DataFrame:
        """A row a node, and one of tree -1 with the base; ``load`` reads them back."""
        rows = [(-1, self.depth, -1 if self.loss == "squared" else -2, 0.0, 0, False, float(self.base), 0.0, 0.0)]
        for k, t in enumerate(self.trees):
            for i in range(len(t.feature)):
                rows.append((k, i, int(t.feature[i]), float(t.threshold[i]), int(t.bin[i]), bool(t.missing_left[i]), float(t.weight[i]), float(t.gain[i]), float(t.cover[i])))
        return local_frame(spark, rows, SCHEMA)

    @classmethod
    def load(cls, table: DataFrame) -> Boosted:
        """The model behind a written ``table``; at most 2 ** (depth + 1) rows a tree."""
        rows = sorted(table.collect(), key=lambda r: (r["tree"], r["node"]))
        out = cls(rows[0]["weight"], rows[0]["node"], "squared" if rows[0]["feature"] == -1 else "logistic")
        size = 2 ** (out.depth + 1) - 1
        for lo in range(1, len(rows), size):
            part = rows[lo : lo + size]
            out.trees.append(Tree(*(np.array([r[c] for r in part]) for c in ("feature", "bin", "threshold", "missing_left", "weight", "gain", "cover"))))
        return out


class Remembered:
    """A model's margins, computed once for all rows between the same thresholds, while there may be no more than ``KNOWN`` such cells."""

    def __init__(self, model: Boosted):
        self.model, self.ends = model, {}
        for f in {int(f) for t in model.trees for f in t.feature if f >= 0}:
            self.ends[f] = np.unique(np.concatenate([t.threshold[t.feature == f] for t in model.trees]))
        # after the last threshold there is one place more, and one for missing values
        cells = np.prod([len(e) + 2.0 for e in self.ends.values()])
        self.margin = np.full(int(cells), np.nan) if cells <= KNOWN else None

    def margins(self, x: np.ndarray) -> np.ndarray:
        if self.margin is None:
            return self.model.margins(x)
        at = np.zeros(len(x), np.int64)
        for f, e in self.ends.items():
            at = at * (len(e) + 2) + np.where(np.isnan(x[:, f]), len(e) + 1, np.searchsorted(e, x[:, f]))
        new, first = np.unique(at[np.isnan(self.margin[at])], return_index=True)
        if len(new):
            self.margin[new] = self.model.margins(x[np.flatnonzero(np.isnan(self.margin[at]))[first]])
        return self.margin[at]


def predict(df: DataFrame, model: Boosted, features: Column, name: str = "prediction") -> DataFrame:
    """Adds the predicted value (for the logistic loss the probability); null features give null, NaN counts as missing."""

    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        remembered = Remembered(model)
        for batch in batches:
            known = batch.is_valid().to_numpy(zero_copy_only=False)
            lists = batch.drop_null()
            out = np.full(len(batch), np.nan)
            if len(lists):
                # a null among the features counts as NaN
                m = remembered.margins(np.asarray(lists.flatten().to_numpy(zero_copy_only=False), float).reshape(len(lists), -1))
                out[known] = m if model.loss == "squared" else sigmoid(m)
            yield pa.array(out, mask=~known)

    return df.withColumn(name, run(features.cast("array<double>")))


def _reduce(parts: RDD, add):
    return parts.treeReduce(add, 2) if parts.getNumPartitions() > TREE else parts.reduce(add)


def _summary(values: np.ndarray, weights: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values with their weights; beyond ``size`` of them neighbours are put together, by equal weight."""
    order = np.argsort(values, kind="stable")
    values, weights = values[order], weights[order]
    first = np.append(True, values[1:] != values[:-1]) if len(values) else np.zeros(0, bool)
    values, weights = values[first], np.add.reduceat(weights, np.flatnonzero(first)) if len(values) else weights
    if len(values) <= size:
        return values, weights
    # each kept value stands for the weight up to it
    ends = np.cumsum(weights)
    at = np.unique(np.minimum(np.searchsorted(ends, np.linspace(0, ends[-1], size + 1)[1:]), len(values) - 1))
    return values[at], np.diff(np.append(0.0, ends[at]))


def quantile_edges(rows: Blocks, bins: int, weight=None) -> list[np.ndarray]:
    """Each feature's upper bin edges by a weighted quantile sketch: at most ``bins`` of them, the last one the largest value.

    ``weight(y)`` gives the rows' weights (default 1). Summaries of 8 values a bin are merged pairwise; each merge
    adds at most 1 / (8 * bins) of the weight to a rank's error, and none while all distinct values are kept.
    """
    width, size = rows.width, 8 * bins

    def sketch(blocks: Iterator) -> Iterator[list]:
        out = None
        for x, y, _ in blocks:
            w = np.ones(len(y)) if weight is None else weight(y)
            one = []
            for f in range(width):
                known = ~np.isnan(x[:, f])
                one.append(_summary(x[known, f], w[known], size))
            out = one if out is None else merge(out, one)
        return iter([] if out is None else [out])

    def merge(a: list, b: list) -> list:
        return [_summary(np.append(va, vb), np.append(wa, wb), size) for (va, wa), (vb, wb) in zip(a, b, strict=True)]

    return [_summary(v, w, bins)[0] for v, w in _reduce(rows.kept.mapPartitions(sketch), merge)]


def _slopes(loss: str, margin: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the loss's gradients and Hessians at the margin, over ``n`` rows whose labels' sum is ``y``."""
    if loss == "squared":
        return n * margin - y, n
    p = sigmoid(margin)
    return n * p - y, n * p * (1 - p)


def _merged(b: np.ndarray, n: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal rows of ``b`` once, with the sums of n and y."""
    size = [int(m) + 1 for m in b.max(axis=0)]
    if np.prod(np.array(size, float)) < 2.0**62:
        code = np.zeros(len(b), np.int64)
        for f, m in enumerate(size):
            code = code * m + b[:, f]
    else:
        code = np.ascontiguousarray(b).view(np.dtype((np.void, b.shape[1] * b.itemsize)))[:, 0]
    _, first, own = np.unique(code, return_index=True, return_inverse=True)
    return b[first], np.bincount(own, n), np.bincount(own, y)


def _cells(rows: Blocks, binned, spark: SparkSession) -> DataFrame:
    """(bins binary, n, y): the written cells, added up block by block in each task, and then by their bins."""

    def run(blocks: Iterator) -> Iterator[tuple]:
        held, size = [], 0
        for x, y, _ in blocks:
            b = binned(x)
            held.append((b, np.ones(len(b)), y))
            size += len(b)
            if size >= CELLS:
                held = [_merged(*(np.concatenate(c) for c in zip(*held, strict=True)))]
                size = len(held[0][0])
                if size > CELLS // 2:  # they hardly repeat
                    yield from sent(held)
                    held, size = [], 0
        if held:
            yield from sent([_merged(*(np.concatenate(c) for c in zip(*held, strict=True)))])

    def sent(held: list) -> Iterator[tuple]:
        for b, n, y in held:
            for lo in range(0, len(b), SENT):
                part = b[lo : lo + SENT]
                yield bytearray(part.tobytes()), bytearray(n[lo : lo + SENT].tobytes()), bytearray(y[lo : lo + SENT].tobytes()), part.shape[1] * part.itemsize

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bins, n, y, width in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                keys = pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(bins) // width, [None, pa.py_buffer(bins)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([keys, pa.array(np.frombuffer(n)), pa.array(np.frombuffer(y))], names=["bins", "n", "y"])

    parts = spark.createDataFrame(rows.kept.mapPartitions(run), "bins binary, n binary, y binary, width int")
    cells = parts.mapInArrow(spread, "bins binary, n double, y double").groupBy("bins").agg(F.sum("n").alias("n"), F.sum("y").alias("y"))
    return materialise(cells, "cells", few=False)


def _best_splits(sums: np.ndarray, ridge: float, least_gain: float, least_child: float) -> list[tuple | None]:
    """For each node of (nodes, features, bins + 1, 2) sums the split of largest gain: (gain, feature, bin, missing left, left sums).

    Of equal gains the one of the smaller feature, then bin, with missing values on the right, wins.
    """
    out = []
    score = lambda g, h: g * g / (h + ridge)
    for node in sums:
        g, h = node[..., 0], node[..., 1]
        whole_g, whole_h = g[0].sum(), h[0].sum()
        best = None
        for missing_left in (False, True):
            gl = np.cumsum(g[:, :-1], axis=1) + (g[:, -1:] if missing_left else 0)
            hl = np.cumsum(h[:, :-1], axis=1) + (h[:, -1:] if missing_left else 0)
            gr, hr = whole_g - gl, whole_h - hl
            ok = (hl >= least_child) & (hr >= least_child)
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(ok, (score(gl, hl) + score(gr, hr) - score(whole_g, whole_h)) / 2, -np.inf)
            top = gain.max()
            # sums that differ only by rounding are ties
            f, b = divmod(int(np.flatnonzero(gain.ravel() >= top - 1e-9 * abs(top))[0]), gain.shape[1])
            if np.isfinite(top) and top > least_gain and (best is None or top > best[0] + 1e-9 * abs(top)):
                best = (float(top), f, b, missing_left, np.array([gl[f, b], hl[f, b]]))
        out.append(best)
    return out


def boost(
    df: DataFrame, features: Column, label: Column, trees: int = 100, depth: int = 5, rate: float = 0.3, ridge: float = 1.0, least_gain: float = 0.0, least_child: float = 1.0,
    bins: int = 256, loss: str = "squared", keep: int = 10,
) -> Boosted:
    """Trees fitted one after another to the loss's gradients and Hessians.

    loss: squared (base: the mean label) or logistic (labels 0 and 1; base: the log odds). ``least_child`` is the
    least sum of Hessians of a child, ``ridge`` what is added to it, ``rate`` what a leaf's weight is multiplied
    by. Rows with a null feature or label are left out, NaN is a missing value. Without rows there are no trees.
    """
    # read twice, for edges and for cells; no copy of the rows is written or kept
    rows = pack(df, features, label, key=F.lit(0), written=False)
    try:
        return boost_blocks(rows, trees, depth, rate, ridge, least_gain, least_child, bins, loss, keep)
    finally:
        rows.discard()


def boost_blocks(rows: Blocks, trees: int, depth: int, rate: float, ridge: float, least_gain: float, least_child: float, bins: int, loss: str, keep: int) -> Boosted:
    """``boost`` over rows that are packed already."""
    if loss not in ("squared", "logistic"):
        raise ValueError(f"unknown loss {loss!r}")
    if not rows.width:
        return Boosted(0.0, depth, loss)
    edges = quantile_edges(rows, bins)
    last = max(len(e) for e in edges)
    small = np.uint8 if last < 256 else np.uint16

    def binned(x: np.ndarray) -> np.ndarray:
        b = np.column_stack([np.where(np.isnan(x[:, f]), last, np.minimum(np.searchsorted(e, x[:, f]), max(len(e) - 1, 0))) for f, e in enumerate(edges)])
        return b.astype(small)

    cells, width = _cells(rows, binned, rows.table.sparkSession), rows.width
    count, total = cells.agg(F.sum("n"), F.sum("y")).first()
    mean = total / count
    model = Boosted(mean if loss == "squared" else float(np.log(max(mean, 1e-9) / max(1 - mean, 1e-9))), depth, loss)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, SENT):
                part = batch.slice(lo, SENT)
                b = b"".join(part.column(0).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in (b, *(np.asarray(part.column(c), float).tobytes() for c in (1, 2)))], names=["bins", "n", "y"])

    packed = cells.mapInArrow(blocks, "bins binary, n binary, y binary").rdd
    source = packed.map(lambda r: (np.frombuffer(r[0], small).reshape(-1, width), np.frombuffer(r[2]), np.frombuffer(r[1]))).persist(StorageLevel.MEMORY_AND_DISK)

    def put(tree: Tree, i: int, sums: np.ndarray) -> None:
        """A node's weight as if it were a leaf, from its rows' gradients and Hessians."""
        g, h = sums
        tree.weight[i], tree.cover[i] = -g / (h + ridge) * rate if h + ridge > 0 else 0.0, h

    def keep_margins(margins: RDD) -> RDD:
        return margins.persist(StorageLevel.MEMORY_AND_DISK)

    kept, before = keep_margins(source.map(lambda r: (*r, np.full(len(r[1]), model.base)))), None
    for number in range(trees):
        if number:
            before, newest = kept, model.trees[-1]
            if number % keep:
                kept = keep_margins(before.map(lambda r, newest=newest: (*r[:3], r[3] + _margin(r[0], 0.0, [newest], depth, last))))
            else:
                fresh = list(model.trees)
                kept = keep_margins(source.map(lambda r, fresh=fresh: (*r, _margin(r[0], model.base, fresh, depth, last))))
        tree = Tree.empty(depth)
        alive = [0]
        for level in range(depth):
            first = 2**level - 1

            def histogram(parts: Iterator, tree=tree, level=level, first=first) -> Iterator[np.ndarray]:
                out = None
                for b, y, n, margin in parts:
                    g, h = _slopes(loss, margin, y, n)
                    at = tree.of_bins(b, level, last) - first
                    own = at >= 0  # rows of a leaf above stay there
                    if out is None:
                        out = np.zeros((2**level, b.shape[1], last + 1, 2))
                    for f in range(b.shape[1]):
                        cell = at[own] * (last + 1) + b[own, f]
                        for c, v in enumerate((g, h)):
                            out[:, f, :, c] += np.bincount(cell, v[own], 2**level * (last + 1)).reshape(2**level, last + 1)
                return iter([] if out is None else [out])

            sums = _reduce(kept.mapPartitions(histogram), np.add)
            if level == 0:
                put(tree, 0, sums[0, 0].sum(axis=0))
            ahead = []
            for k, best in zip(alive, _best_splits(sums[alive], ridge, least_gain, least_child), strict=True):
                if best is not None:
                    gain, f, b, missing_left, left = best
                    i = first + k
                    tree.feature[i], tree.bin[i], tree.threshold[i], tree.missing_left[i], tree.gain[i] = f, b, edges[f][min(b, len(edges[f]) - 1)], missing_left, gain
                    put(tree, 2 * i + 1, left)
                    put(tree, 2 * i + 2, sums[k, 0].sum(axis=0) - left)
                    ahead += [2 * k, 2 * k + 1]
            alive = ahead
            if not alive:
                break
        model.trees.append(tree)
        if before is not None:
            before.unpersist()
    source.unpersist()
    kept.unpersist()
    discard(cells)
    return model


def _margin(b: np.ndarray, base: float, trees: list[Tree], depth: int, last: int) -> np.ndarray:
    out = np.full(len(b), base)
    for t in trees:
        out += t.weight[t.of_bins(b, depth, last)]
    return out
