"""N-gram Jaccard join by count-vector R-trees.

A document's set is its distinct word n-grams, hashed to 64 bits. Hashing a set's tokens into ``GROUPS``
groups and counting gives a point; of two points the sum of coordinate minima bounds the sets' overlap
from above. An R-tree over points (sort-tile-recursive, node corners at the coordinate maxima) finds all
points whose bound reaches the threshold, and pairs that survive are verified on the sets themselves.

One tree over all documents would not prune: far apart documents look alike in few dimensions. So trees
are built per block, and blocks are chosen so that no link is lost:

1. Sets that are equal become one node (map-side combining, then one grouped aggregation).
2. Tokens that only one node has can't be shared. A node with too few shared tokens for any link leaves.
   This needs a count per token; it runs over each set's smallest 40 % of hashes, which by the prefix
   argument loses nothing (``prefix_need``). Tokens that several sets of one batch hold are known to be
   shared there and then, and only one entry of each goes on, so that a common token stays small.
3. First pass: nodes meet in blocks keyed by their smallest and largest shared token, cut into chunks of
   at most ``CHUNK`` nodes; each chunk's tree yields verified links, and only those that join two
   components are kept. Of blocks with several chunks the components' representatives meet again until a
   round finds little.
4. Second pass, exact: in the global order by frequency, two linked nodes share one of their first
   n - ceil(t n) + 1 tokens, and the smaller one has it among its first n - ceil(2 t n / (1 + t)) + 1. Tokens
   with the same holders are one. For every such token whose holders lie in more than one component, a tree
   over the holders that have it in the shorter prefix yields the pairs of different components that the
   bound admits, all of which are verified. A pair leaves the block of the first token that both have, not
   those of its other tokens (``FIRSTS``), and only if a bound by finer groups admits it too (``FINE``).
   The holders of a token with many are dealt out by bands of their sets' sizes, as only sets of the same or of neighbouring bands can link, and as pairs of chunks;
   the members of its largest component meet only those of others.

Links within a component found earlier change nothing, so the components are those of all links.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from tessera.llm.common import column, hold, small_batches
from tessera.llm.components import components
from tessera.storage import discard, materialise

GROUPS = 256
FINE = 1024  # groups of the bound by which pairs leave a block; a multiple of GROUPS
FIRSTS = 32  # how many of a node's first tokens its rows carry
LEAF = 16
CHUNK = 256
KEEP = 0.15
SHARED = -(1 << 63)  # stands for any set: a token of its runs is shared
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_MULTIPLIERS = [np.uint64(0x9E3779B97F4A7C15 + 2 * k * 0x1D8E4E27C47D124F & 0xFFFFFFFFFFFFFFFF | 1) for k in range(64)]


class _Words(dict):
    """Word to 64-bit hash, memoised in a bounded table."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_words = _Words()


def shingles(text: str | None, n: int = 5) -> np.ndarray:
    """Ascending distinct hashes of a text's word n-grams; with fewer words the whole sequence is one."""
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    width = min(n, len(h))
    s = np.full(len(h) - width + 1, np.uint64(width))
    for k in range(width):
        s = (s ^ (s >> np.uint64(29))) * _MULTIPLIERS[k] + h[k : len(h) - width + 1 + k]
    s ^= s >> np.uint64(32)
    s *= _MULTIPLIERS[40]
    s ^= s >> np.uint64(29)
    s *= _MULTIPLIERS[41]
    return np.unique(s ^ (s >> np.uint64(32)))


def least_overlap(n: int, percent: int) -> int:
    """Tokens that a set of n shares with any set it links with."""
    return -(-percent * n // 100)


def prefix_size(n: int, percent: int) -> int:
    """How many of a set's smallest hashes step 2 looks at: n - overlap + k, with k = KEEP * n rounded up."""
    return min(n, n - least_overlap(n, percent) + int(np.ceil(KEEP * n)))


def prefix_need(n: int, percent: int) -> int:
    """How many of those are shared if the set has a link.

    Sets of sizes n <= m with overlap o share at least k of their (n - o + k) and (m - o + k) smallest
    hashes. o is at least ``least_overlap`` of either, and the smaller partner has at least percent of n.
    """
    return max(1, int(np.ceil(KEEP * least_overlap(n, percent))))


def group_counts(tokens: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    return np.bincount((tokens & np.uint64(groups - 1)).astype(np.int64), minlength=groups).astype(np.int32)


class CountTree:
    """R-tree over count vectors; a node keeps its coordinate maxima and the range of set sizes."""

    def __init__(self, points: np.ndarray, percent: int):
        self.percent, self.points, self.sizes = percent, points, points.sum(1)
        self.order = self._tile(np.arange(len(points)), 0)
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        top, low, high = points[self.order], self.sizes[self.order], self.sizes[self.order]
        while len(top) > 1 or not self.levels:
            cut = np.arange(0, len(top), LEAF)
            top, low, high = np.maximum.reduceat(top, cut), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut)
            self.levels.append((top, low, high))

    def _tile(self, rows: np.ndarray, depth: int) -> np.ndarray:
        """Sort by size first, then by the coordinate of the widest spread, in tiles."""
        if len(rows) <= LEAF or depth > 8:
            return rows
        if depth == 0:
            key = self.sizes[rows]
        else:
            spread = self.points[rows].max(0) - self.points[rows].min(0)
            key = self.points[rows, int(spread.argmax())]
        rows = rows[np.argsort(key, kind="stable")]
        half = -(-len(rows) // (2 * LEAF)) * LEAF
        return np.concatenate([self._tile(rows[:half], depth + 1), self._tile(rows[half:], depth + 1)])

    def bound_ok(self, point: np.ndarray, size: int, tops: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Where some point below may link: sizes allow it, and the summed minima reach the overlap needed."""
        p = self.percent
        fits = (100 * low <= 100 * 100 * size // p) & (high * 100 >= p * size)
        need = p * (size + np.maximum(low, p * size // 100)) / (100 + p)
        return fits & (np.minimum(point, tops).sum(1) + 1e-9 >= need)

    def query(self, point: np.ndarray) -> np.ndarray:
        """Row numbers whose bound admits a link with ``point``."""
        size, at = int(point.sum()), np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            top, low, high = self.levels[depth]
            at = at[self.bound_ok(point, size, top[at], low[at], high[at])]
            below = len(self.levels[depth - 1][0]) if depth else len(self.order)
            at = (at[:, None] * LEAF + np.arange(LEAF)).ravel()
            at = at[at < below]
        rows = self.order[at]
        return rows[self.bound_ok(point, size, self.points[rows], self.sizes[rows], self.sizes[rows])]


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


class Union:
    def __init__(self, n: int):
        self.of = list(range(n))

    def find(self, i: int) -> int:
        while self.of[i] != i:
            self.of[i] = self.of[self.of[i]]
            i = self.of[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.of[max(i, j)] = min(i, j)
        return i != j


def shingle_sets(docs: DataFrame, n: int, id_col: str, text_col: str, percent: int | None = None) -> DataFrame:
    """(id, s1, s2, n, tokens): s1, s2 sign the set; tokens only at the first such set of a task's batch.

    With ``percent`` tokens are only the smallest ones, as many as the counting step looks at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("shingles", _words.clear)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                seen, first, second, size, tokens = set(), [], [], [], []
                for text in column(part, 1):
                    s = shingles(text, n)
                    raw = s.tobytes()
                    one = xxhash.xxh3_128_intdigest(raw)
                    first.append((one >> 64) - (1 << 63))
                    second.append((one & (1 << 64) - 1) - (1 << 63))
                    size.append(len(s))
                    tokens.append(None if one in seen or not len(s) else raw if percent is None else s[: prefix_size(len(s), percent)].tobytes())
                    seen.add(one)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(first, pa.int64()), pa.array(second, pa.int64()), pa.array(size, pa.int64()), pa.array(tokens, pa.binary())],
                    names=["id", "s1", "s2", "n", "tokens"],
                )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, s1 long, s2 long, n long, tokens binary")


def _token_blocks(sets: DataFrame, parts: int, percent: int) -> DataFrame:
    """Each set's smallest hashes dealt by hash, one row a part and batch: tokens, and the set of each.

    Sets go by the first 64 bits of their signatures here: two linked sets that agree in these would have to
    have no other partner to be lost. A part below 0 has, per set, how many shared tokens it needs, and how many
    another set of the same batch has. Those tokens go on once a batch, as the set ``SHARED``'s, and count as
    shared wherever they are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("join")
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                yield deal(batch.slice(lo, 2000))

    def deal(part: pa.RecordBatch) -> pa.RecordBatch:
        ids, once = np.unique(np.array(part.column(0).to_pylist(), np.int64), return_index=True)  # copies within the batch are one
        sizes, raws = column(part, 1), column(part, 2)
        heads = [np.frombuffer(raws[k], np.uint64) for k in once]
        needs = [prefix_need(sizes[k], percent) for k in once]
        owner = np.repeat(np.arange(len(ids)), [len(h) for h in heads])
        tokens = np.concatenate([np.zeros(0, np.uint64), *heads])
        order = np.argsort(tokens, kind="stable")
        tokens, owner = tokens[order], owner[order]
        first = np.r_[True, tokens[1:] != tokens[:-1]][: len(tokens)]
        several = ~first
        several[:-1] |= ~first[1:]
        local = np.bincount(owner[several], minlength=len(ids))
        kept = first | ~several
        owners = np.where(several, SHARED, ids[owner])[kept]
        tokens = tokens[kept]
        to = ((tokens >> np.uint64(8)) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        to, owners, short = to[order], owners[order], (tokens[order] >> np.uint64(24)).astype(np.uint32)
        keys = [-1 - int(ids[0]) % parts]
        cols = [[np.array(needs, np.uint32).tobytes() + local.astype(np.uint32).tobytes()], [ids.tobytes()]]
        edges = [*np.flatnonzero(np.r_[True, to[1:] != to[:-1]][: len(to)]).tolist(), len(to)]
        for lo, hi in pairwise(edges):
            keys.append(int(to[lo]))
            cols[0].append(short[lo:hi].tobytes())
            cols[1].append(owners[lo:hi].tobytes())
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), *(pa.array(c, pa.binary()) for c in cols)], names=["part", "tokens", "owners"])

    return sets.select("s1", "n", "tokens").mapInArrow(run, "part int, tokens binary, owners binary")


def _shared_counts(block: pd.DataFrame) -> pd.DataFrame:
    """(s1, need, shared, near): of a part's entries those whose token a different set has too, counted per set.

    Tokens are compared by 32 of their bits: a chance agreement counts as shared, which only keeps a set.
    """
    zero = np.zeros
    if block["part"].iat[0] < 0:
        ids = [np.frombuffer(b, np.int64) for b in block["owners"]]
        both = [np.frombuffer(b, np.uint32).astype(np.int64).reshape(2, -1) for b in block["tokens"]]
        ids, both = np.concatenate(ids), np.concatenate(both, axis=1)
        return pd.DataFrame({"s1": ids, "need": both[0], "shared": zero(len(ids), np.int64), "near": both[1]})
    tokens = np.concatenate([np.frombuffer(b, np.uint32) for b in block["tokens"]])
    names, number = np.unique(np.concatenate([np.frombuffer(b, np.int64) for b in block["owners"]]), return_inverse=True)
    # token and set in one number: the same set may come from several batches, and counts once
    pair = np.unique((tokens.astype(np.uint64) << np.uint64(32)) | number.astype(np.uint64))
    token, owner = pair >> np.uint64(32), (pair & np.uint64(0xFFFFFFFF)).astype(np.int64)
    start = np.flatnonzero(np.r_[True, token[1:] != token[:-1]][: len(token)])
    size = np.diff(np.r_[start, len(token)])
    known = np.maximum.reduceat(names[owner] == SHARED, start) if len(start) else zero(0, bool)
    count = np.bincount(owner[np.repeat((size > 1) | known, size)], minlength=len(names))
    at = np.flatnonzero((count > 0) & (names != SHARED))
    return pd.DataFrame({"s1": names[at], "need": zero(len(at), np.int64), "shared": count[at], "near": zero(len(at), np.int64)})


def alive_signatures(heads: DataFrame, percent: int) -> DataFrame:
    """Written (s1) of the sets that step 2 doesn't rule out, from the smallest tokens of each."""
    total = heads.agg(F.sum("n")).first()[0] or 0
    # few entries of a set share a part at any size, so that what is counted grows as the input does
    parts = int(min(2**31 - 1, max(256, total // 250_000)))
    counts = _token_blocks(heads, parts, percent).groupBy("part").applyInPandas(_shared_counts, "s1 long, need long, shared long, near long")
    # a copy in another batch may have found other tokens shared there, so the largest local count is what counts
    sums = counts.groupBy("s1").agg(F.sum("shared").alias("shared"), F.max("near").alias("near"), F.max("need").alias("need"))
    return materialise(sums.where("shared + near >= need").select("s1"), "join-alive-ids", few=True)


@dataclass
class Sets:
    """Documents, and their sets' written signatures (``light``) and smallest tokens (``heads``)."""

    docs: DataFrame
    n: int
    id_col: str
    text_col: str
    heads: DataFrame
    light: DataFrame


def survivors(sets: Sets, percent: int, most_broadcast: int = 2_000_000) -> DataFrame:
    """(node, s1, s2, n, tokens) of the sets that step 2 doesn't rule out, each once and numbered.

    One document of each such set is read again and its shingles are made anew: that is cheaper than to keep the
    tokens of all sets, which are larger than the texts. Rows that share its id, or have none like it, are read too
    and go again by their signatures.
    """
    alive = alive_signatures(sets.heads.where("tokens is not null"), percent)
    discard(sets.heads)
    few = alive.count() <= most_broadcast  # 8 bytes each; beyond that a shuffled join
    small = (lambda t: F.broadcast(t)) if few else (lambda t: t)
    one = sets.light.where("n > 0").join(small(alive), "s1", "left_semi").groupBy("s1", "s2").agg(F.min("id").alias("__id")).select("__id").distinct()
    one = materialise(one, "join-alive-documents", few=True)
    # ids of another type than numbers have no known size
    plain = few and isinstance(one.schema["__id"].dataType, NumericType)
    texts = sets.docs.select(F.col(sets.id_col).alias("id"), F.col(sets.text_col).alias("t"))
    texts = texts.join(F.broadcast(one) if plain else one, F.col("id").eqNullSafe(F.col("__id")), "left_semi")
    rows = shingle_sets(texts, sets.n, "id", "t").where("tokens is not null").join(small(alive), "s1", "left_semi").dropDuplicates(["s1", "s2"])
    nodes = materialise(rows.select(F.monotonically_increasing_id().alias("node"), "s1", "s2", "n", "tokens"), "join-nodes")
    discard(one)
    discard(alive)
    return nodes


def _blocks_in(group: pd.DataFrame, *keys: str) -> tuple[dict[str, np.ndarray], Iterator[slice]]:
    """A group's columns, sorted, and the slices with one value of ``keys``."""
    order = np.lexsort([group[k].to_numpy() for k in ("node", *reversed(keys))])
    columns = {c: group[c].to_numpy()[order] for c in group.columns}
    new = np.ones(len(order), bool)
    new[1:] = np.any([columns[k][1:] != columns[k][:-1] for k in keys], axis=0)
    edges = [*np.flatnonzero(new).tolist(), len(order)]
    return columns, (slice(lo, hi) for lo, hi in zip(edges[:-1], edges[1:], strict=True) if hi > lo + 1)


def _chunk_links(percent: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        """Links that join different components among the nodes of each chunk."""
        hold("join")
        columns, blocks = _blocks_in(group, "key", "chunk")
        found = [x for at in blocks for x in links(columns["node"][at].tolist(), columns["root"][at].tolist(), columns["tokens"][at])]
        return pd.DataFrame(found, columns=["a", "b"], dtype=np.int64)

    def links(nodes: list[int], roots: list[int], tokens: np.ndarray) -> list[tuple[int, int]]:
        sets = [np.frombuffer(t, np.uint64) for t in tokens]
        tree, union = CountTree(np.array([group_counts(s) for s in sets]), percent), Union(len(sets))
        first: dict[int, int] = {}
        for i, r in enumerate(roots):
            union.join(i, first.setdefault(r, i))
        found = []
        for i in range(len(sets)):
            for j in tree.query(tree.points[i]).tolist():
                if j < i and union.find(i) != union.find(j) and linked(sets[i], sets[j], percent):
                    union.join(i, j)
                    found.append((nodes[i], nodes[j]))
        return found

    return run


def _rooted(nodes: DataFrame, roots: DataFrame | None) -> DataFrame:
    if roots is None:
        return nodes.withColumn("root", F.col("node"))
    return nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def first_pass(keyed: DataFrame, nodes: DataFrame, percent: int, most_rounds: int = 8) -> tuple[list[DataFrame], DataFrame | None]:
    """Written links from blocks (key, node), one table a round, and the components they make, None where there is no link."""
    links, roots, total = [], None, 0
    buckets = max(64, keyed.count() // CHUNK)
    for round_ in range(most_rounds):
        rows = _rooted(keyed, roots)
        if roots is not None:  # one node of each component and key goes on
            rows = rows.groupBy("key", "root").agg(F.min_by("node", F.struct(F.xxhash64("node", F.lit(round_)), "node")).alias("node"))
        size = materialise(rows.groupBy("key").agg(F.count(F.lit(1)).alias("holders")).where("holders > 1"), "join-sizes", few=True)
        rows = rows.join(size, "key")
        chunks = F.ceil(F.col("holders") * 1.25 / CHUNK).cast("long")
        chunk = F.pmod(F.xxhash64("node", F.lit(100 + round_)), chunks)
        rows = rows.select("key", chunk.alias("chunk"), "node", "root").join(nodes.select("node", "tokens"), "node")
        # small blocks share a call: about 50 a group
        rows = rows.withColumn("bucket", F.pmod(F.xxhash64("key", "chunk"), F.lit(buckets)))
        found = materialise(rows.groupBy("bucket").applyInPandas(_chunk_links(percent), "a long, b long"), "join-links", few=True)
        new = found.count()
        if not new:
            discard(found)
            break
        links.append(found)
        total += new
        before, roots = roots, components(reduce(DataFrame.unionByName, links))
        if before is not None:
            discard(before)
        # a block of one chunk has been compared whole; only keys with more chunks meet again
        open_ = size.where(chunks > 1).select("key")
        if new * 20 < total or open_.isEmpty():  # what few links are left the second pass finds
            break
        keyed = keyed.join(open_, "key", "left_semi")
    return links, roots


def _pack(points: np.ndarray) -> bytes:
    """Counts in as few bytes as hold them."""
    return points.astype(np.uint8 if points.max() < 256 else np.int32).tobytes()


def _unpack(point: bytes) -> np.ndarray:
    return np.frombuffer(point, np.uint8 if len(point) == FINE else np.int32)


def _before(firsts: np.ndarray, token: int) -> set[int]:
    """A node's first tokens that come before ``token``; all of them where it is none of these."""
    first = firsts.tolist()
    return set(first[: first.index(token)] if token in first else first)


def _block_pairs(percent: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        """Pairs of different components, a left and a right one, in each block that the bounds admit.

        Two nodes with an earlier token in common meet in its block as well: tokens come in one order, and a
        right node is right for all tokens before, so that the pair leaves that block and not this one.
        """
        hold("join")
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        columns, blocks = _blocks_in(group, "token", "band", "hot", "c1", "c2")
        for at in blocks:
            nodes, right, roots = (columns[c][at] for c in ("node", "right", "root"))
            trees, left = np.flatnonzero(right), np.flatnonzero(~right)
            if not len(trees) or not len(left):
                continue
            fine = np.array([_unpack(p) for p in columns["point"][at]])
            points = fine.reshape(len(fine), -1, GROUPS).sum(1, dtype=np.int32)
            before = [_before(f, columns["token"][at.start]) for f in columns["firsts"][at]]
            sizes, tree = points.sum(1), CountTree(points[trees], percent)
            for i in left.tolist():
                near = trees[tree.query(points[i])]
                near = near[roots[near] != roots[i]]
                near = near[[before[i].isdisjoint(before[j]) for j in near.tolist()]] if before[i] else near
                near = near[tree.bound_ok(fine[i], sizes[i], fine[near], sizes[near], sizes[near])]
                if len(near):
                    a.append(np.minimum(nodes[near], nodes[i]))
                    b.append(np.maximum(nodes[near], nodes[i]))
        return pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)}).drop_duplicates()

    return run


def _blocks(rows: DataFrame, percent: int) -> DataFrame:
    """(token, band, hot, c1, c2, node, root, right) from rows (token, holders, node, n, root, indexed): who meets whom.

    In a block every left row meets every right one. Right are the rows in whose shorter prefix the token is
    (``indexed``): of two linked sets the smaller one has their first common token there. Of a token with more
    than ``CHUNK`` holders the right rows of its most frequent component are ``hot`` and meet only those of other
    components; right rows are in the band of their own size, left ones in it and the one below. Both sides are
    cut into chunks.
    """
    fixed = ["token", "node", "root"]
    small = rows.where(F.col("holders") <= CHUNK)
    none = [F.lit(-1).alias("band"), F.lit(False).alias("hot"), F.lit(0).alias("c1"), F.lit(0).alias("c2")]
    small = small.select(*fixed, *none, F.lit(False).alias("right")).unionByName(small.where("indexed").select(*fixed, *none, F.lit(True).alias("right")))
    large = rows.where(F.col("holders") > CHUNK)
    most = large.groupBy("token", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("token").agg(F.max_by("root", F.struct("n", "root")).alias("most"))
    band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / percent * 1.005 + 1e-9))).cast("int")
    large = large.join(most, "token").withColumn("own", band).withColumn("is_most", F.col("root") == F.col("most"))
    right = large.where("indexed").select(*fixed, F.col("own").alias("band"), F.col("is_most").alias("hot"), F.lit(True).alias("right"))
    left = large.select(*fixed, F.explode(F.array("own", F.col("own") - 1)).alias("band"), "is_most")
    left = left.select(*fixed, "band", F.explode(F.when(F.col("is_most"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))).alias("hot"), F.lit(False).alias("right"))
    members = left.unionByName(right)
    is_right = F.col("right").cast("long")
    sizes = members.groupBy("token", "band", "hot").agg(F.sum(1 - is_right).alias("lefts"), F.sum(is_right).alias("rights"))
    sizes = materialise(sizes.where("lefts > 0 and rights > 0"), "join-bands", few=True)
    cut = lambda n, size: F.ceil(F.col(n) / size).cast("int")
    members = members.join(sizes, ["token", "band", "hot"]).withColumn("l", cut("lefts", 8 * CHUNK)).withColumn("r", cut("rights", 2 * CHUNK))
    h = F.xxhash64("node")
    members = members.withColumn("mine", F.when(F.col("right"), F.pmod(h, F.col("r"))).otherwise(F.pmod(h, F.col("l"))).cast("int"))
    # a row goes to the blocks of its chunk with each chunk of the other side
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("right"), F.col("l")).otherwise(F.col("r")) - 1)))
    chunk = lambda of_left: F.when(F.col("right") != F.lit(of_left), F.col("mine")).otherwise(F.col("other"))
    large = members.select(*fixed, "band", "hot", chunk(True).alias("c1"), chunk(False).alias("c2"), "right")
    blocks = materialise(small.unionByName(large), "join-blocks")
    discard(sizes)
    return blocks


def second_pass(prefixes: DataFrame, nodes: DataFrame, roots: DataFrame | None, percent: int) -> DataFrame:
    """All links between different components of ``roots``, from rows (token, node, n, at, indexed); ``at``: the token's place in the node's prefix."""
    rows = _rooted(prefixes, roots)
    held = rows.groupBy("token").agg(
        F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("holders"), F.max("indexed").alias("any_indexed"),
        F.bit_xor(F.xxhash64("node", "indexed")).alias("x1"), F.bit_xor(F.xxhash64(F.lit(1), "node", "indexed")).alias("x2"),
    )
    # of tokens with the same holders (by 128 bits of their hashes) one is looked at
    mixed = held.where("lo < hi and any_indexed").groupBy("holders", "x1", "x2").agg(F.min("token").alias("token"))
    mixed = materialise(mixed.select("token", "holders"), "join-mixed", few=True)
    met = materialise(rows.join(mixed, "token"), "join-met")  # read several times
    blocks = _blocks(met, percent)
    buckets = max(64, blocks.count() // 1000)

    @F.pandas_udf("binary")
    def point(tokens: pd.Series) -> pd.Series:
        return tokens.map(lambda t: _pack(group_counts(np.frombuffer(t, np.uint64), FINE)))

    firsts = met.groupBy("node").agg(F.slice(F.sort_array(F.collect_list(F.struct("at", "token"))), 1, FIRSTS)["token"].alias("firsts"))
    points = nodes.join(firsts, "node").select("node", point("tokens").alias("point"), "firsts")
    # small blocks share a call, about 1000 rows a group
    dealt = blocks.join(points, "node").withColumn("bucket", F.pmod(F.xxhash64("token", "band", "hot", "c1", "c2"), F.lit(buckets)))
    pairs = materialise(dealt.groupBy("bucket").applyInPandas(_block_pairs(percent), "a long, b long").distinct(), "join-pairs", few=True)
    for done in (mixed, met, blocks):
        discard(done)

    @F.pandas_udf("boolean")
    def verified(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([linked(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64), percent) for p, q in zip(x, y, strict=True)], dtype=bool)

    sets = nodes.select("node", "tokens")
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("tokens").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("tokens").alias("y")), "b")
    links = materialise(both.where(verified("x", "y")).select("a", "b"), "join-verified", few=True)
    discard(pairs)
    return links


def near_duplicates(docs: DataFrame, percent: int = 75, n: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) per row of docs.

    Two documents link when 100 * intersection >= percent * union of their shingle sets; component_id is
    the smallest id that links reach. Words are what lies between ASCII white space, A to Z lower-cased.
    A text without words, or null, has no shingles and links with nothing, not even its copies. Rows that
    repeat an id are documents of their own with that id. A null id is never the smallest unless alone.
    ``docs`` is read twice, and must give the same rows both times: write it first where it might not.
    """
    small_batches(docs.sparkSession)
    heads = materialise(shingle_sets(docs, n, id_col, text_col, percent), "join-heads")
    light = materialise(heads.select("id", "s1", "s2", "n"), "join-light")
    # a node is a set that may have a link; sets are told apart by all 128 bits of their signatures
    nodes = survivors(Sets(docs, n, id_col, text_col, heads, light), percent)

    @F.pandas_udf("array<long>")
    def numbers(tokens: pd.Series) -> pd.Series:
        return tokens.map(lambda t: np.frombuffer(t, np.int64))

    each = nodes.select("node", "n", F.explode(numbers("tokens")).alias("token"))
    often = each.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    shared = each.join(often, "token").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("ts"))
    # overlaps that a set needs with any other, and with one that is no smaller
    need, need_larger = F.ceil(F.col("n") * percent / 100).cast("int"), F.ceil(F.col("n") * 2 * percent / (100 + percent)).cast("int")
    ready = materialise(
        shared.where(F.size("ts") >= need).select(
            "node", "n", F.array_min("ts.token").alias("k1"), F.array_max("ts.token").alias("k2"),
            # of the first n - need + 1 tokens by (df, token), those with df 1 come first and are in one set only
            F.slice("ts.token", 1, F.greatest(F.lit(1), F.size("ts") - need + 1)).alias("prefix"), (F.size("ts") - need_larger + 1).alias("shorter"),
        ),
        "join-prefixes",
    )
    keyed = ready.select("node", F.explode(F.array_distinct(F.array("k1", "k2"))).alias("key"))
    links, roots = first_pass(keyed, nodes, percent)
    prefixes = ready.select("node", "n", "shorter", F.posexplode("prefix").alias("at", "token"))
    rest = second_pass(prefixes.select("token", "node", "n", "at", (F.col("at") < F.col("shorter")).alias("indexed")), nodes, roots, percent)
    discard(ready)
    if roots is not None:
        discard(roots)
    roots = components(reduce(DataFrame.unionByName, [*links, rest]))
    for done in (*links, rest):
        discard(done)

    signed = light.where("n > 0").groupBy("s1", "s2").agg(F.min("id").alias("least"))
    numbered = nodes.select("s1", "s2", "node").join(roots, "node").select("s1", "s2", "root")
    # sets without a link are alone; those with one take the least id of their component
    named = materialise(signed.join(numbered, ["s1", "s2"], "left"), "join-named")
    discard(nodes)
    discard(roots)
    least = named.where("root is not null").groupBy("root").agg(F.min("least").alias("component_id"))
    linked_sets = named.where("root is not null").join(least, "root").select("s1", "s2", "component_id")
    alone = named.where("root is null").select("s1", "s2", F.col("least").alias("component_id"))
    out = light.where("n > 0").select("id", "s1", "s2", "n").join(linked_sets.unionByName(alone), ["s1", "s2"]).select("id", "n", "component_id")
    empty = light.where("n = 0").select("id", "n", F.col("id").alias("component_id"))
    return out.unionByName(empty).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")
