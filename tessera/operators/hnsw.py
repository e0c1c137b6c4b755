"""A partitioned HNSW index: navigable small-world graphs over shards of the points, kept as a table.

Points are dealt to shards by a hash of their ids; a task builds a shard's graph, and a row of the index
table holds it. A query walks every shard's graph, and the shards' nearest are merged. Distances are
Euclidean over unit vectors, so that similarities are cosines.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessera.operators.recommend import blocks_of
from tessera.operators.relational import top_per_key

#: As many shards as that, of no more and no fewer rows than these: a query walks every shard, and with a number of
#: shards that grew as the rows do, walks would grow with the square of them.
SHARDS, MOST_ROWS, LEAST_ROWS = 32, 20_000, 1_000


class Graph:
    """Layers of links over vectors; the lowest layer has all points."""

    def __init__(self, vectors: np.ndarray, links: int = 16, width: int = 100, seed: int = 42):
        """links: neighbours kept for a point in each layer, twice as many in the lowest; width: how many points these are chosen from."""
        self.vectors = vectors.astype(np.float32)
        n = len(vectors)
        draw = np.random.default_rng(seed).random(max(n, 1))
        self.level = np.minimum(np.floor(-np.log(np.maximum(draw, 1e-12)) / math.log(links)).astype(int), 8)[:n]
        self.near: list[list[list[int]]] = [[[] for _ in range(k + 1)] for k in self.level]
        self.entry, self.links, self.width = int(self.level.argmax()) if n else -1, links, width
        self._link()

    def _distances(self, q: np.ndarray, at: list[int]) -> np.ndarray:
        d = self.vectors[at] - q
        return np.einsum("ij,ij->i", d, d)

    def _search(self, q: np.ndarray, start: list[tuple[float, int]], width: int, layer: int) -> list[tuple[float, int]]:
        """The ``width`` nearest that a walk over one layer finds, ascending."""
        seen = {i for _, i in start}
        open_, best = list(start), [(-d, i) for d, i in start]
        heapq.heapify(open_)
        heapq.heapify(best)
        while open_:
            d, i = heapq.heappop(open_)
            if d > -best[0][0] and len(best) >= width:
                break
            fresh = [j for j in self.near[i][layer] if j not in seen]
            if not fresh:
                continue
            seen.update(fresh)
            for x, j in zip(self._distances(q, fresh).tolist(), fresh, strict=True):
                if len(best) < width:
                    heapq.heappush(best, (-x, j))
                elif x < -best[0][0]:
                    heapq.heapreplace(best, (-x, j))
                else:
                    continue
                heapq.heappush(open_, (x, j))
        return sorted((-d, i) for d, i in best)

    def _chosen(self, found: np.ndarray, reach: np.ndarray, most: int) -> list[int]:
        """Neighbours of a point among ``found``, ascending by distance ``reach``: those nearer to a chosen one only if there is room."""
        if len(found) <= most:
            return found.tolist()
        v = self.vectors[found]
        norms = np.einsum("ij,ij->i", v, v)
        between = norms[:, None] + norms - 2 * (v @ v.T)
        kept, free = [], np.full(len(found), np.inf, np.float32)
        for k, d in enumerate(reach.tolist()):
            if free[k] > d:
                kept.append(k)
                if len(kept) == most:
                    break
                np.minimum(free, between[k], out=free)
        chosen = set(kept)
        return found[kept + [k for k in range(len(found)) if k not in chosen][: most - len(kept)]].tolist()

    def _earlier(self, members: np.ndarray, block: int = 256) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Each member with its ``width`` nearest among those before it, and their distances, ascending."""
        v = self.vectors[members]
        norms = np.einsum("ij,ij->i", v, v)
        for lo in range(0, len(members), block):
            hi = min(len(members), lo + block)
            d = np.maximum(norms[lo:hi, None] + norms[:hi] - 2 * (v[lo:hi] @ v[:hi].T), 0)
            d[np.arange(hi) >= np.arange(lo, hi)[:, None]] = np.inf
            if hi > self.width:
                at = np.argpartition(d, self.width - 1, axis=1)[:, : self.width]
                d = np.take_along_axis(d, at, 1)
            else:
                at = np.broadcast_to(np.arange(hi), d.shape)
            order = np.argsort(d, axis=1, kind="stable")
            d, at = np.take_along_axis(d, order, 1), np.take_along_axis(at, order, 1)
            for k in range(hi - lo):
                n = min(lo + k, self.width)
                yield lo + k, members[at[k, :n]], d[k, :n]

    def _link(self) -> None:
        """Points come one after the other; what a walk would look for, the nearest points before, a matrix product finds."""
        for layer in range(int(self.level.max(initial=-1)) + 1):
            members = np.flatnonzero(self.level >= layer)
            most = self.links * (2 if layer == 0 else 1)
            for k, found, reach in self._earlier(members):
                i = int(members[k])
                for j in (own := self._chosen(found, reach, self.links)):
                    self.near[j][layer].append(i)
                self.near[i][layer] = own
            for j in members.tolist():
                if len(self.near[j][layer]) > most:
                    found = np.array(self.near[j][layer])
                    reach = self._distances(self.vectors[j], found)
                    order = np.argsort(reach, kind="stable")
                    self.near[j][layer] = self._chosen(found[order], reach[order], most)

    def nearest(self, q: np.ndarray, k: int, width: int) -> list[tuple[float, int]]:
        """(squared distance, point) of about the k nearest, ascending."""
        if self.entry < 0:
            return []
        here = [(float(self._distances(q, [self.entry])[0]), self.entry)]
        for layer in range(int(self.level[self.entry]), 0, -1):
            here = self._search(q, here, 1, layer)[:1]
        return self._search(q, here, max(width, k), 0)[:k]

    def pack(self) -> dict[str, object]:
        """Vectors and links as a few binary values: per point and layer the number of links, then the links."""
        flat = [layer for point in self.near for layer in point]
        return {
            "vectors": self.vectors.tobytes(), "level": self.level.astype(np.int32).tobytes(), "entry": self.entry,
            "counts": np.array([len(x) for x in flat], np.int32).tobytes(), "links": np.array([j for x in flat for j in x], np.int32).tobytes(),
        }

    @staticmethod
    def unpack(row: dict[str, object], dimensions: int) -> Graph:
        g = Graph(np.zeros((0, max(dimensions, 1))))
        g.vectors, g.level, g.entry = np.frombuffer(row["vectors"], np.float32).reshape(-1, max(dimensions, 1)), np.frombuffer(row["level"], np.int32), row["entry"]
        counts, links = np.frombuffer(row["counts"], np.int32), np.frombuffer(row["links"], np.int32)
        parts = iter([x.tolist() for x in np.split(links, np.cumsum(counts)[:-1])] if len(counts) else [])
        g.near = [[next(parts) for _ in range(k + 1)] for k in g.level.tolist()]
        return g


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-30)


def build_index(points: DataFrame, shard_rows: int | None = None, links: int = 16, width: int = 100, seed: int = 42) -> DataFrame:
    """A row a shard (shard, ids, dimensions, vectors, level, entry, counts, links) over rows (id, v); write it to keep it.

    Every row is indexed, in shards of about ``shard_rows`` (default: ``SHARDS`` shards, where the rows allow it); vectors
    have one length. Null vectors raise.
    """
    n = points.count()
    shards = max(1, -(-n // shard_rows) if shard_rows else max(min(SHARDS, -(-n // LEAST_ROWS)), -(-n // MOST_ROWS)))
    rows = points.select("id", F.col("v").cast("array<float>").alias("v"), F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(shards)).cast("int").alias("shard"))
    kind = rows.schema["id"].dataType
    arrow_id = to_arrow_type(kind)

    def build(group: pa.Table) -> pa.Table:
        group = group.sort_by("id")
        v = np.array(group.column("v").to_pylist(), np.float32)
        row = Graph(_unit(v), links, width, seed).pack()
        columns = {"shard": pa.array([group.column("shard")[0].as_py()], pa.int32()), "ids": pa.array([group.column("id").to_pylist()], pa.list_(arrow_id)), "dimensions": pa.array([v.shape[1]], pa.int32())}
        kinds = {"entry": pa.int32()}
        return pa.table({**columns, **{k: pa.array([x], kinds.get(k, pa.binary())) for k, x in row.items()}})

    schema = f"shard int, ids array<{kind.simpleString()}>, dimensions int, vectors binary, level binary, entry int, counts binary, links binary"
    return rows.groupBy("shard").applyInArrow(build, schema)


def nearest(index: DataFrame, queries: DataFrame, k: int, width: int = 200, block: int = 2000) -> DataFrame:
    """(query, id, similarity): about the k most similar indexed rows to each query row (id, v), itself left out.

    Queries are sent to the shards in blocks; each shard answers with k rows a query.
    """
    spark, kind = index.sparkSession, index.schema["ids"].dataType.elementType
    arrow_id, ids = to_arrow_type(kind), kind.simpleString()
    # a row of the index is as large as a shard: one at a time
    index = index.repartition(F.col("shard"))

    def answers(rows: list) -> DataFrame:
        names, q = [r["id"] for r in rows], _unit(np.array([r["v"] for r in rows], np.float32))
        shared = spark.sparkContext.broadcast((names, q))  # ``block`` queries at most

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, q = shared.value
            for batch in batches:
                for at in range(batch.num_rows):
                    row = batch.slice(at, 1).to_pylist()[0]
                    graph, own = Graph.unpack(row, row["dimensions"]), row["ids"]
                    found = [(name, own[i], 1 - d / 2) for name, v in zip(names, q, strict=True) for d, i in graph.nearest(v, k + 1, width) if own[i] != name]
                    a, b, s = zip(*found, strict=True) if found else ((), (), ())
                    yield pa.RecordBatch.from_arrays([pa.array(a, arrow_id), pa.array(b, arrow_id), pa.array(s, pa.float64())], names=["query", "id", "similarity"])

        return index.mapInArrow(run, f"query {ids}, id {ids}, similarity double")

    out = None
    for rows in blocks_of(queries.select("id", F.col("v").cast("array<float>").alias("v")), block):
        out = answers(rows) if out is None else out.unionByName(answers(rows))
    if out is None:
        return index.sparkSession.createDataFrame([], f"query {ids}, id {ids}, similarity double")
    return top_per_key(out, ["query"], k, F.desc("similarity"), F.asc("id"))
