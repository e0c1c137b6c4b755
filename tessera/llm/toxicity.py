"""Toxicity scores by a factorization machine over hashed terms.

A text's terms are its lower-case words and their first 4, 5 and 6 letters, hashed into 2**BITS buckets;
a bucket is present or absent, whatever the text's length. Buckets whose presence says something of the label (a chi-square of at least
``MIN_CHI2``, at most ``MAX_FEATURES`` of them) are the features, and so are those of the ``PAIR_TERMS`` most
frequent buckets that say something only together with another of these (a chi-square of ``MIN_PAIR_CHI2``
of whether both, one or none is present, beyond what each says alone). Spark counts; the driver gets the
chosen buckets, and of each labelled row of the sample which of them it has. On them

    score = sigmoid(w0 + sum_i w_i + sum_{i<j} <v_i, v_j>)

is fitted by mini-batches with Adam; the pair term learns that two words matter together, which additive
weights can't. Fitting uses a bounded sample of labelled rows; scoring reads every word of every text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import SAMPLE_TASKS, column, groups_of, hold, slices, small_batches
from tessera.storage import discard, materialise

BITS = 20
MIN_CHI2 = 10.0
PAIR_TERMS = 256
MIN_PAIR_CHI2 = 45.0  # of some 30,000 pairs without any link less than one reaches this
PREFIXES = (4, 5, 6)
MEMO_WORDS = 100_000
WORD = re.compile(r"[^\W\d_]+")


def word_buckets(word: str) -> list[int]:
    """Buckets of a word's terms: the word, and its first letters, which an inflected form shares."""
    mask = (1 << BITS) - 1
    return [zlib.crc32(t.encode()) & mask for t in (word, *(word[:k] + "*" for k in PREFIXES if len(word) >= k))]


def term_buckets(text: str) -> np.ndarray:
    """Distinct buckets of a text's terms, ascending."""
    words = set(WORD.findall(text.lower()))
    return np.unique(np.array([b for w in words for b in word_buckets(w)], np.int32))


class FactorizationMachine:
    def __init__(self, factors: int = 8, epochs: int = 40, rate: float = 0.05, decay: float = 1e-4, batch: int = 256, seed: int = 7, spread: float = 0.05):
        self.factors, self.epochs, self.rate, self.decay, self.batch, self.seed, self.spread = factors, epochs, rate, decay, batch, seed, spread
        self.feature: dict[int, int] = {}
        self.memo: dict[str, tuple[int, ...]] = {}
        self.w0, self.w, self.v = 0.0, np.zeros(1), np.zeros((1, factors))

    def choose(self, buckets: list[int]) -> None:
        self.feature = {bucket: k + 1 for k, bucket in enumerate(buckets)}  # 0 pads

    @staticmethod
    def padded(found: list[list[int]]) -> np.ndarray:
        """Feature numbers, padded with 0 to one width."""
        out = np.zeros((len(found), max([1, *map(len, found)])), np.int64)
        for i, f in enumerate(found):
            out[i, : len(f)] = f
        return out

    def features(self, text: str) -> list[int]:
        """Numbers of the features present in a text; words' features are memoised in a bounded table."""
        memo, get, found = self.memo, self.feature.get, set()
        for w in set(WORD.findall(text.lower())):
            known = memo.get(w)
            if known is None:
                if len(memo) >= MEMO_WORDS:
                    memo.clear()
                known = memo[w] = tuple(k for b in word_buckets(w) if (k := get(b)))
            if known:
                found.update(known)
        return sorted(found)

    def margin(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        vs = self.v[x]
        total = vs.sum(1)
        return self.w0 + self.w[x].sum(1) + 0.5 * ((total**2).sum(1) - (vs**2).sum((1, 2))), total

    def fit(self, buckets: list[np.ndarray], y: np.ndarray) -> FactorizationMachine:
        """Fit on rows of buckets, of which those that ``choose`` was given count."""
        rng = np.random.default_rng(self.seed)
        size = len(self.feature) + 1
        rate = min(max((y.sum() + 0.5) / (len(y) + 1), 1e-3), 1 - 1e-3)
        self.w0, self.w = float(np.log(rate / (1 - rate))), np.zeros(size)
        self.v = rng.normal(0, self.spread, (size, self.factors))
        self.v[0] = 0
        if size == 1:
            return self
        get = self.feature.get
        x = self.padded([[k for b in r.tolist() if (k := get(b))] for r in buckets])
        m = [np.zeros(1), np.zeros(size), np.zeros_like(self.v)]
        s = [np.zeros(1), np.zeros(size), np.zeros_like(self.v)]
        step = 0
        for _ in range(self.epochs):
            order = rng.permutation(len(y))
            for lo in range(0, len(order), self.batch):
                at = order[lo : lo + self.batch]
                xb = x[at]
                margin, total = self.margin(xb)
                err = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y[at]) / len(at)
                gw = np.bincount(xb.ravel(), weights=np.repeat(err, xb.shape[1]), minlength=size)
                gv = np.zeros_like(self.v)
                for f in range(self.factors):
                    each = err[:, None] * (total[:, f, None] - self.v[xb, f])
                    gv[:, f] = np.bincount(xb.ravel(), weights=each.ravel(), minlength=size)
                grads = [np.array([err.sum()]), gw + self.decay * self.w, gv + self.decay * self.v]
                step += 1
                moves = []
                for k, g in enumerate(grads):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    s[k] = 0.999 * s[k] + 0.001 * g * g
                    moves.append(self.rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8))
                self.w0 -= float(moves[0][0])
                self.w -= moves[1]
                self.v -= moves[2]
                self.w[0] = 0
                self.v[0] = 0
        return self

    def score(self, texts: list[str | None]) -> np.ndarray:
        x = self.padded([self.features(t or "") for t in texts])
        return np.concatenate([1 / (1 + np.exp(-np.clip(self.margin(x[lo : lo + 256])[0], -30, 30))) for lo in range(0, max(len(x), 1), 256)])


def chi_square(a: np.ndarray, present: np.ndarray, positive: float, n: float) -> np.ndarray:
    """Of presence and label: ``a`` positive rows among ``present``, ``positive`` among all ``n``."""
    b, c = present - a, positive - a
    d = n - positive - b
    chi2 = n * (a * d - b * c) ** 2 / np.maximum(present * (n - present) * positive * (n - positive), 1)
    # a cell expected to hold fewer than 3 rows makes the statistic unreliable
    return np.where(present * min(positive, n - positive) / max(n, 1) < 3, chi2 * 0.25, chi2)


def select(rows: DataFrame, max_features: int | None = None, pair_terms: int = PAIR_TERMS) -> list[int]:
    """The buckets that go with the label, by chi-square over presence, from rows (y, terms).

    All terms that tell something alone (``MIN_CHI2``), at most ``max_features`` of them if that is given, and those of
    the ``pair_terms`` most frequent that do in a pair. Pairs are counted as a matrix of that many terms a side.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, a = np.zeros((1 << BITS) + 1, np.int64), np.zeros((1 << BITS) + 1, np.int64)
        for batch in batches:
            for y, raw in zip(column(batch, 0), column(batch, 1), strict=True):
                at = np.append(np.frombuffer(raw, np.int32), 1 << BITS)  # the last counts rows
                n[at] += 1
                a[at] += y > 0.5
        k = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(n[k]), pa.array(a[k])], names=["k", "n", "a"])

    sums = materialise(rows.mapInArrow(count, "k int, n long, a long").groupBy("k").agg(F.sum("n").alias("n"), F.sum("a").alias("a")), "toxicity-terms", few=True)
    whole = sums.where(F.col("k") == 1 << BITS).first()
    n, positive = (float(whole["n"]), float(whole["a"])) if whole else (0.0, 0.0)
    if not 0 < positive < n:
        discard(sums)
        return []

    @F.arrow_udf("double")
    def chi2(a: pa.Array, present: pa.Array) -> pa.Array:
        return pa.array(chi_square(a.to_numpy(False).astype(float), present.to_numpy(False).astype(float), positive, n))

    terms = sums.where(F.col("k") < 1 << BITS).withColumn("chi2", chi2("a", "n"))
    telling = terms.where(F.col("chi2") >= MIN_CHI2).orderBy(F.desc("chi2"), "k").select("k")
    alone = [r["k"] for r in (telling if max_features is None else telling.limit(max_features)).collect()]  # no more than buckets
    # the most frequent ones that some rows lack
    often = np.array(sorted(r["k"] for r in sums.where((F.col("k") < 1 << BITS) & (F.col("n") < 0.9 * n) & (F.col("n") >= 30)).orderBy(F.desc("n"), "k").limit(PAIR_TERMS).collect()), np.int32)
    discard(sums)

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for batch in batches:
            x = np.array([np.isin(often, np.frombuffer(raw, np.int32)) for raw in column(batch, 1)]).reshape(-1, len(often))
            y = np.array(column(batch, 0)) > 0.5
            found.append(np.stack([x.T.astype(np.float32) @ x, x[y].T.astype(np.float32) @ x[y]]))
        both = sum(found, np.zeros((2, len(often), len(often)))).astype(np.int64)
        at = np.flatnonzero(both[0].ravel())
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(both[0].ravel()[at]), pa.array(both[1].ravel()[at])], names=["at", "n", "a"])

    pairs = np.zeros((2, len(often) ** 2))
    found = rows.mapInArrow(together, "at long, n long, a long").groupBy("at").agg(F.sum("n").alias("n"), F.sum("a").alias("a")).toArrow()  # at most pair_terms squared
    pairs[:, found["at"].to_numpy()] = found["n"].to_numpy(), found["a"].to_numpy()
    return alone + [int(k) for k in often[paired(*pairs.reshape(2, len(often), len(often)), positive, n)] if int(k) not in set(alone)]


def paired(both: np.ndarray, good: np.ndarray, positive: float, n: float) -> np.ndarray:
    """Which terms tell something in a pair; both, good: rows, and positive rows, with both terms of a pair.

    Of the three degrees that the four cases of a pair have, those of the single terms are taken away.
    """
    one, a = np.diag(both), np.diag(good)
    cases = [(both, good), (one[:, None] - both, a[:, None] - good), (one[None, :] - both, a[None, :] - good), (n - one[:, None] - one[None, :] + both, positive - a[:, None] - a[None, :] + good)]
    rate = positive / n
    whole = sum(np.where(m * min(rate, 1 - rate) >= 3, (g - m * rate) ** 2 / np.maximum(m * rate * (1 - rate), 1e-12), 0.0) for m, g in cases)
    single = chi_square(a, one, positive, n)
    extra = whole - single[:, None] - single[None, :]
    np.fill_diagonal(extra, 0.0)
    return np.flatnonzero((extra >= MIN_PAIR_CHI2).any(1))


def fit(
    docs: DataFrame, labels: DataFrame, eligible: Column, max_rows: int = 8_000, max_features: int | None = None, pair_terms: int = PAIR_TERMS,
    label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", **machine,
) -> FactorizationMachine:
    """Fit on at most ``max_rows`` labelled rows, those with the smallest hashes of their ids.

    ``eligible`` is a condition on ``docs``'s id. Rows with a null label, or an id without document, don't
    count; null text counts as empty; an id with several labels counts once for each. Without any labelled
    row every score is the prior, one half. The features are all that ``select`` finds: their number is bounded by the
    2 ** 20 buckets (64 MB of factors), and by ``max_features`` only where it is given.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("y")).where("y is not null and id is not null")
    picked = known.join(docs.where(eligible).select(F.col(id_col).alias("id")), "id", "left_semi")
    picked = picked.orderBy(F.xxhash64(F.lit(11), "id"), "id", "y").limit(max_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            terms = [term_buckets(t or "").tobytes() for t in column(batch, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(terms, pa.binary())], names=["y", "terms"])

    # at most max_rows pairs of numbers are broadcast, and as many lists of terms written; the sample is dealt
    # anew, so that all tasks of the scan stay and few files are written
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).join(F.broadcast(picked), "id")
    rows = materialise(rows.select("y", "t").repartition(SAMPLE_TASKS).mapInArrow(run, "y double, terms binary"), "toxicity-sample", few=True)
    model = FactorizationMachine(**machine)
    model.choose(select(rows, max_features, pair_terms))
    chosen = np.array(sorted(model.feature), np.int32)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = [np.intersect1d(np.frombuffer(raw, np.int32), chosen, assume_unique=True).tobytes() for raw in column(batch, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(terms, pa.binary())], names=["y", "terms"])

    got = rows.mapInArrow(keep, "y double, terms binary").collect()  # max_rows rows, the features that each has
    discard(rows)
    got.sort(key=lambda r: (bytes(r["terms"]), r["y"]))
    return model.fit([np.frombuffer(r["terms"], np.int32) for r in got], np.array([r["y"] for r in got]))


def score(docs: DataFrame, machine: FactorizationMachine, keep: list[Column] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted) per row, plus the columns ``keep``; null text counts as empty.

    Repeated rows stay repeated, texts are read whole, other columns aren't read, so their names don't matter.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # at most MAX_FEATURES rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = shared.value
        hold("toxicity", lambda: machine.memo.clear())
        for batch in batches:
            texts = column(batch, 1)
            scores = [s for lo, hi in groups_of(texts) for s in machine.score(texts[lo:hi]).tolist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), *batch.columns[2:]],
                names=["id", "score", "predicted", *more],
            )

    extra = [c.alias(f"k{i}") for i, c in enumerate(keep or [])]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), *extra)
    more = [f"k{i}" for i in range(len(extra))]
    kinds = ", ".join([f"id {rows.schema['id'].dataType.simpleString()}, score double, predicted int", *(f"{m} {rows.schema[m].dataType.simpleString()}" for m in more)])
    return rows.mapInArrow(run, kinds).withColumnRenamed("id", id_col)
