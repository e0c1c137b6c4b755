"""Benchmark decontamination by latent semantic retrieval.

Index: the benchmark's passages as TF-IDF rows over lower-case words; of a passage longer than
``MAX_PART`` words each part of about ``WINDOW`` words is a row. A randomised SVD (Gaussian range
finder with power iterations) gives the leading right singular vectors: each iteration is one distributed
pass that sums A^T (A Q) by term over blocks of rows, so the driver holds only terms x rank matrices.
Document frequencies are counted by Spark over the whole benchmark. A benchmark of more than ``SHARD_BYTES``
is dealt into shards, each with an index of its own, and each searched against all documents.

Search: every document is cut into overlapping windows of ``WINDOW`` words; a window's vector is the sum
of its words' weighted latent vectors, and every window of every document is compared with all rows
of the benchmark, in blocks: by cosine, and by how far it reaches along the row's direction, since a window
with a single known word has a high cosine with the rows that hold that word. Passages of which a
document has too few distinctive words for the check below are left out of its search; this loses nothing.

Check: of a candidate the longest common subsequence of words between the passage and the surroundings
of the window must cover ``MIN_LCS`` of the passage, or ``MIN_PARAPHRASE`` of it if the passage's answer
(its last sentence) is nearly whole as well.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from tessera.llm.common import column, hold, slices, small_batches
from tessera.storage import discard, materialise

RANK = 64
OVERSAMPLE = 16
POWER = 2
WINDOW = 48
STRIDE = 16
MAX_PART = 64
SHARD_BYTES = 4 << 20  # of passages in one index
TERM_BLOCK = 2048
MIN_COSINE = 0.35
MIN_COVERAGE = 0.38
MIN_LCS = 0.75
MIN_PARAPHRASE = 0.5
MIN_ANSWER = 0.9
ASCII_MARKS = "".join(c for c in map(chr, range(128)) if not c.isalnum() and c != "_")
TRIM = re.compile(r"^[^\w]+|[^\w]+$")


def words_of(text: str) -> list[str]:
    return text.lower().split()


def trimmed(words: list[str]) -> list[str]:
    """Words without marks around them; marks alone aren't words."""
    found = [t for w in words if (t := w.strip(ASCII_MARKS))]
    if all(map(str.isascii, found)):
        return found
    return [t for w in found if (t := w if w.isascii() or w.isalnum() else TRIM.sub("", w))]


def common_subsequence(short: list[int], long: list[int]) -> int:
    """Length of the longest common subsequence, by bit-parallel rows over ``short``."""
    masks: dict[int, int] = {}
    for k, w in enumerate(short):
        masks[w] = masks.get(w, 0) | (1 << k)
    full = (1 << len(short)) - 1
    v = full
    for w in long:
        u = v & masks.get(w, 0)
        v = ((v + u) | (v - u)) & full
    return len(short) - v.bit_count()


def parts_of(words: list[int]) -> list[list[int]]:
    """Equal parts that a window can hold most of; up to ``MAX_PART`` words the whole."""
    n = 1 if len(words) <= MAX_PART else math.ceil(len(words) / WINDOW)
    cuts = [len(words) * k // n for k in range(n + 1)]
    return [words[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


class Index:
    """Benchmark passages: term numbers, word sequences, and latent vectors of their parts."""

    def __init__(self, items: list[tuple[object, list[str], int]], df: dict[str, int], n: int, id_type: DataType):
        """items: (id, words, words of the answer at the end); df, n: passages by word, and all, of the whole benchmark."""
        self.items, self.id_type = items, id_type
        self.terms = {w: k for k, w in enumerate(sorted({w for _, ws, _ in items for w in ws}))}
        held = np.array([df[w] for w in self.terms], float)
        n = max(n, 1)
        self.idf = np.log((1 + n) / held) if len(held) else np.zeros(0)
        self.distinctive = held <= max(2, n // 20)
        self.words = [[self.terms[w] for w in ws] for _, ws, _ in items]
        self.parts = [p for ws in self.words for p in parts_of(ws)]
        self.passage = np.repeat(np.arange(len(items)), [len(parts_of(ws)) for ws in self.words])
        # Each word that a common subsequence leaves out takes away one distinctive word at most, so a
        # document that holds passage k has at least least[k] of its different distinctive words.
        rare_words = [{w for w in ws if self.distinctive[w]} for ws in self.words]
        self.least = np.array(
            [max(0, min(len(r) - math.floor((1 - MIN_LCS) * len(ws)), math.ceil(MIN_PARAPHRASE * len(r)))) for r, ws in zip(rare_words, self.words, strict=True)], np.int64
        )
        pairs = np.array([(w, k) for k, r in enumerate(rare_words) for w in r], np.int64).reshape(-1, 2)
        pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
        self.holders = pairs[:, 1]
        self.first = np.searchsorted(pairs[:, 0], np.arange(len(self.terms) + 1))
        self.always = np.flatnonzero(self.least == 0)
        self.basis = np.zeros((len(self.terms), 0), np.float32)
        self.rows = np.zeros((len(self.parts), 0), np.float32)

    def tfidf(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        at, tf = np.unique(np.array(self.parts[k], np.int64), return_counts=True)
        x = (1 + np.log(tf)) * self.idf[at]
        return at, x / max(np.linalg.norm(x), 1e-12)


def randomised_svd(spark, index: Index, rank: int = RANK, seed: int = 3) -> np.ndarray:
    """terms x rank: the leading right singular vectors of the parts' TF-IDF rows."""
    terms, width = len(index.terms), min(rank + OVERSAMPLE, max(1, min(len(index.parts), len(index.terms))))
    if not terms:
        return np.zeros((0, 0), np.float32)
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(terms, width)))[0]
    shared = spark.sparkContext.broadcast(index)  # at most about SHARD_BYTES of passages
    blocks = spark.range(0, len(index.parts), 1, max(1, min(64, len(index.parts) // 500 + 1)))
    for step in range(POWER + 1):
        basis = spark.sparkContext.broadcast(q)

        def gram(batches: Iterator[pa.RecordBatch], basis=basis) -> Iterator[pa.RecordBatch]:
            index, q = shared.value, basis.value
            total, touched = np.zeros_like(q), np.zeros(len(q), bool)
            for batch in batches:
                for k in column(batch, 0):
                    at, x = index.tfidf(k)
                    total[at] += x[:, None] * (x @ q[at])[None, :]
                    touched[at] = True
            for lo in range(0, len(q), TERM_BLOCK):
                if touched[lo : lo + TERM_BLOCK].any():
                    yield pa.RecordBatch.from_arrays([pa.array([lo], pa.int64()), pa.array([total[lo : lo + TERM_BLOCK].tobytes()], pa.binary())], names=["lo", "z"])

        def add(block: pa.Table) -> pa.Table:
            z = sum(np.frombuffer(x.as_py()) for x in block.column("z"))
            return pa.table({"lo": block.column("lo").slice(0, 1), "z": pa.array([z.tobytes()], pa.binary())})

        z = np.zeros_like(q)
        for r in blocks.mapInArrow(gram, "lo long, z binary").groupBy("lo").applyInArrow(add, "lo long, z binary").collect():  # one terms x rank matrix
            z[r["lo"] : r["lo"] + TERM_BLOCK] = np.frombuffer(r["z"]).reshape(-1, width)
        basis.unpersist()
        u, s, _ = np.linalg.svd(z, full_matrices=False)
        q = u
    shared.unpersist()
    return q[:, : min(rank, int((s > 1e-9 * s[0]).sum()))].astype(np.float32)


def passages(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, words, answer, size) of the passages that have words; answer: how many words its last sentence has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            row, words, answer, size = [], [], [], []
            for i, text in enumerate(column(batch, 1)):
                found = trimmed(words_of(text))
                if found:
                    last = [s for s in re.split(r"(?<=[.!?])\s+|\n", text.strip()) if s.strip()][-1:]
                    row.append(i), words.append(found), size.append(len(text))
                    answer.append(sum(len(trimmed(words_of(s))) for s in last))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int32())), pa.array(words, pa.list_(pa.string())), pa.array(answer, pa.int64()), pa.array(size, pa.int64())],
                names=["id", "words", "answer", "size"],
            )

    rows = benchmark.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).where("id is not null and t is not null")
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, words array<string>, answer long, size long")


def build_index(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> list[Index]:
    """One index, or more where the passages are larger than ``shard_bytes``; null and empty passages are left out.

    The driver holds a shard's passages at a time while it builds, and the indexes until they are sent out.
    Ids may be of any type; a passage that repeats is found as often.
    """
    spark = benchmark.sparkSession
    rows = materialise(passages(benchmark, id_col, text_col), "benchmark-passages", few=True)
    n, size = rows.agg(F.count(F.lit(1)), F.sum("size")).first()
    shards = max(1, -(-(size or 0) // shard_bytes))
    shard = F.pmod(F.xxhash64("id", "words"), F.lit(shards))
    terms = rows.select(shard.alias("shard"), F.explode(F.array_distinct("words")).alias("w"))
    df = materialise(terms.groupBy("w").agg(F.count(F.lit(1)).alias("df"), F.collect_set("shard").alias("shards")), "benchmark-terms", few=True)
    found = []
    for k in range(shards):
        mine = df.where(F.array_contains("shards", F.lit(k).cast("long"))) if shards > 1 else df
        items = [(r["id"], r["words"], r["answer"]) for r in rows.where(shard == k).collect()]
        index = Index(sorted(items, key=lambda r: (r[0], r[1])), {r["w"]: r["df"] for r in mine.select("w", "df").collect()}, n, rows.schema["id"].dataType)
        index.basis = randomised_svd(spark, index)
        vectors = np.zeros((len(index.parts), index.basis.shape[1]), np.float32)
        for p in range(len(index.parts)):
            at, x = index.tfidf(p)
            vectors[p] = x @ index.basis[at]
        index.rows = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
        found.append(index)
    discard(rows)
    discard(df)
    return found


class Searcher:
    def __init__(self, index: Index):
        self.index = index
        # the last row, all zero, is what number -1 finds
        self.weighted = np.vstack([index.basis * index.idf[:, None], np.zeros((1, index.basis.shape[1]))]).astype(np.float32)
        self.is_distinctive = np.append(index.distinctive, False)
        # how far a window must reach along each part's direction to hold enough of it
        whole = [self.weighted[w].sum(0) for w in index.parts]
        self.least_along = MIN_COVERAGE * np.array([v @ r for v, r in zip(whole, index.rows, strict=True)], np.float32)

    def numbers(self, text: str) -> np.ndarray:
        """Term numbers of a text's words, -1 for words of no passage."""
        get = self.index.terms.get
        return np.array([get(w, -1) for w in trimmed(words_of(text))], np.int32)

    def possible(self, ids: np.ndarray) -> np.ndarray:
        """Passages of which the document has enough distinctive words for any common subsequence asked for."""
        index = self.index
        seen = np.zeros(len(self.is_distinctive), bool)
        seen[ids] = True
        rare = np.flatnonzero(seen & self.is_distinctive)
        lo, size = index.first[rare], index.first[rare + 1] - index.first[rare]
        if not len(rare):
            return index.always
        held = index.holders[np.repeat(lo - np.cumsum(size) + size, size) + np.arange(size.sum())]
        hits = np.bincount(held, minlength=len(index.items))
        return np.flatnonzero((hits >= index.least) & ((hits > 0) | (index.least == 0)))

    def search(self, text: str) -> list[tuple[object, float, float]]:
        """(passage, cosine, share of the passage in the longest common subsequence) of what the text holds."""
        index = self.index
        ids = self.numbers(text)
        n = len(ids)
        if n == 0 or not index.items:
            return []
        possible = self.possible(ids)
        if not len(possible):
            return []
        active = np.flatnonzero(np.isin(index.passage, possible))
        starts = np.arange(0, max(1, n - WINDOW + STRIDE), STRIDE)
        ends = np.minimum(starts + WINDOW, n)
        rows, least_along = index.rows[active], self.least_along[active]
        keep = np.arange(len(starts))
        found: dict[int, tuple[float, float]] = {}
        for lo in range(0, len(keep), 512):
            at = keep[lo : lo + 512]
            # a window is a few blocks of STRIDE words; each block's vector is summed once
            first, last = int(starts[at[0]]), int(ends[at[-1]])
            blocks = np.add.reduceat(self.weighted[ids[first:last]], np.arange(0, last - first, STRIDE))
            blocks = np.vstack([blocks, np.zeros((WINDOW // STRIDE, blocks.shape[1]), np.float32)])
            base = (starts[at] - first) // STRIDE
            vectors = sum(blocks[base + k] for k in range(WINDOW // STRIDE))
            norm = np.linalg.norm(vectors, axis=1, keepdims=True)
            along = vectors @ rows.T
            cosine = along / np.maximum(norm, 1e-9)
            near_enough = (cosine >= MIN_COSINE) & (along >= least_along)
            for k, item in zip(*np.nonzero(near_enough), strict=True):
                item, c = index.passage[active[item]], float(cosine[k, item])
                words = index.words[item]
                a, b = max(0, starts[at[k]] - len(words) - 8), min(n, ends[at[k]] + len(words) + 8)
                best = found.get(int(item), (0.0, 0.0))
                near = ids[a:b].tolist()
                # a subsequence has no more words than both have in common
                if best[1] >= 0.999 or sum(map(set(near).__contains__, words)) < MIN_PARAPHRASE * len(words):
                    continue
                share = common_subsequence(words, near) / len(words)
                tail = words[len(words) - index.items[item][2] :]
                answered = share >= MIN_PARAPHRASE and common_subsequence(tail, near) >= MIN_ANSWER * len(tail)
                if share >= MIN_LCS or share >= MIN_PARAPHRASE and answered and self.dense(words, near):
                    found[int(item)] = max(best, (c, share))
        return [(index.items[k][0], c, s) for k, (c, s) in sorted(found.items())]

    def dense(self, words: list[int], near: list[int]) -> bool:
        """Half of the passage's distinctive words occur nearby: common words alone prove nothing."""
        rare = {w for w in words if self.index.distinctive[w]}
        return len(rare) > 0 and len(rare.intersection(near)) >= MIN_PARAPHRASE * len(rare)


_searchers: dict[str, Searcher] = {}


def searcher_for(key: str, shared) -> Searcher:
    """One searcher a worker: the index is broadcast once, its memo lives across tasks."""
    hold("decontam", _searchers.clear)
    if key not in _searchers:
        _searchers.clear()
        _searchers[key] = Searcher(shared.value)
    return _searchers[key]


def find_contamination(docs: DataFrame, indexes: list[Index], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, item_id, cosine, lcs_share), a row per row of docs and passage that it holds.

    Null and empty texts hold nothing; a repeated row is reported again; an empty benchmark finds nothing.
    Texts are read whole, once for each index; of a very long one 512 windows at a time are compared. Other
    columns aren't read, so their names don't matter.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    kind = rows.schema["id"].dataType.simpleString()

    def found_by(index: Index) -> DataFrame:
        shared, key = docs.sparkSession.sparkContext.broadcast(index), uuid.uuid4().hex  # about SHARD_BYTES of passages
        arrow_id = to_arrow_type(index.id_type)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            searcher = searcher_for(key, shared)
            for batch in slices(batches):
                row, item, cosine, share = [], [], [], []
                for i, text in enumerate(column(batch, 1)):
                    for k, c, s in searcher.search(text or ""):
                        row.append(i), item.append(k), cosine.append(c), share.append(s)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row, pa.int32())), pa.array(item, arrow_id), pa.array(cosine, pa.float64()), pa.array(share, pa.float64())],
                    names=["id", "item_id", "cosine", "lcs_share"],
                )

        return rows.mapInArrow(run, f"id {kind}, item_id {index.id_type.simpleString()}, cosine double, lcs_share double")

    return reduce(DataFrame.unionByName, map(found_by, indexes)).withColumnRenamed("id", id_col)


def is_contaminated(docs: DataFrame, indexes: list[Index], text_col: str = "text") -> Column:
    """A boolean column for filters: the text holds a passage. Null text holds none."""
    small_batches(docs.sparkSession)

    def held_by(index: Index) -> Column:
        shared, key = docs.sparkSession.sparkContext.broadcast(index), uuid.uuid4().hex

        @F.arrow_udf("boolean")
        def held(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            searcher = searcher_for(key, shared)
            for batch in batches:
                yield pa.array([bool(searcher.search(t or "")) for lo in range(0, len(batch), 500) for t in batch.slice(lo, 500).to_pylist()], pa.bool_())

        return held(F.col(text_col))

    return reduce(lambda a, b: a | b, map(held_by, indexes))
