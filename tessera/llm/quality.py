"""Quality classifier: document evidence shrunk towards the record of its host and path.

1. Evidence of a text: its shape (twelve ratios) and its terms. Terms are words and runs of three bytes,
   hashed; a term's weight is the log ratio of the shares of good and bad labelled documents that hold it.
   A logistic regression over shape and mean weights gives each document's own log odds. Weights that a
   labelled row is fitted with come from the other half of the labelled rows.
2. Grouped aggregation sums the documents' probabilities per path and per host.
3. Empirical Bayes: a host's rate has a beta prior around the global rate, a path's rate one around its
   host's. The global rate and the priors' strengths come from the labelled rows, the latter from the
   spread of the groups by the method of moments, so that a sparse site stays near its parent and a site
   with many documents keeps its own rate. The document itself is left out of its site's record.
4. The final log odds add the path's departure from the global rate, weighted, to the document's own.

Host and path come from a source such as ``host/dir/page``: the host before the first slash, the path up
to the last. Where sources have no path, the language section of the host takes its place.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import SAMPLE_TASKS, column, hold, slices, small_batches
from tessera.storage import discard, materialise

SHAPE = 12
FEATURES = SHAPE + 4
SITE_WEIGHT = 0.5
RUNS, WORDS = 1 << 14, 1 << 16  # buckets of byte runs, then of words
TERMS = RUNS + WORDS
MEMO_WORDS = 100_000
BLOCK = 1 << 20  # bytes of a text whose runs are hashed at once
PRIOR = 2.0  # documents that a term is taken to have been seen in besides


def _bytes(letters: str) -> np.ndarray:
    return np.frombuffer(letters.encode(), np.uint8)


UPPER, LOWER, SYMBOLS, MARKS, DIGITS = map(_bytes, ("ETAONSIR", "etaonsir", "#$%&*!|<>{}[]=_~^", ".!?", "0123456789"))


def shape(text: str) -> list[float]:
    """Features of a whole text, each within about 0 to 3."""
    words = text.split()
    n, size = len(words), max(len(text), 1)
    if not n:
        return [0.0] * SHAPE
    distinct = set(words)
    raw = text.encode()
    count = np.zeros(256, np.int64)
    for at in range(0, len(raw), BLOCK):
        count += np.bincount(np.frombuffer(raw, np.uint8, min(BLOCK, len(raw) - at), at), minlength=256)
    upper, lower, symbols, marks, digits = (int(count[at].sum()) for at in (UPPER, LOWER, SYMBOLS, MARKS, DIGITS))
    bare = sum(w == "|" for w in words) if "|" in text else 0
    longest = max(map(len, distinct))
    same = sum(map(str.__eq__, words, words[1:])) if 3 * len(distinct) < 2 * n or n > len(distinct) else 0
    return [
        upper / max(upper + lower, 1),
        min(3.0, 10 * symbols / size),
        bare / n * 2,
        same / n,
        len(distinct) / n,
        min(3.0, len(zlib.compress(raw, 1)) / max(len(raw), 1) * 2),
        min(3.0, (size / n) / 6),
        min(3.0, longest / 30),
        min(3.0, marks / n * 8),
        min(3.0, 10 * digits / size),
        min(3.0, math.log1p(n) / 3),
        int(count[10]) / n,
    ]


class _Buckets(dict):
    """Word to bucket, memoised in a bounded table."""

    def __missing__(self, word: str) -> int:
        if len(self) > MEMO_WORDS:
            self.clear()
        value = self[word] = RUNS + (zlib.crc32(word.encode()) & (WORDS - 1))
        return value


_buckets = _Buckets()


def terms(text: str) -> np.ndarray:
    """Ascending distinct buckets of a whole text's terms, in lower case."""
    low = text.lower()
    raw = np.frombuffer(low.encode(), np.uint8)
    held = np.zeros(RUNS, bool)
    for at in range(0, max(len(raw) - 2, 0), BLOCK):
        b = raw[at : at + BLOCK + 2].astype(np.uint32)
        held[((b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761)) >> np.uint32(18)] = True
    words = np.unique(np.fromiter(map(_buckets.__getitem__, set(low.split())), np.int64))
    return np.concatenate([np.flatnonzero(held), words])


class Evidence:
    """Weights of terms; ``features`` joins a text's shape with the means of its terms' weights."""

    def __init__(self, good: np.ndarray, bad: np.ndarray, n_good: int, n_bad: int):
        """good, bad: per bucket the labelled documents that hold it. A term in neither weighs 0."""
        n = max(n_good + n_bad, 1)
        each = [np.log((held + PRIOR * size / n) / size) if size else None for held, size in ((good, n_good), (bad, n_bad))]
        self.weights = (each[0] - each[1]).astype(np.float32) if n_good and n_bad else np.zeros(TERMS, np.float32)

    def features(self, text: str) -> list[float]:
        found = terms(text)
        cut = int(np.searchsorted(found, RUNS))
        out = shape(text)
        for part in (found[:cut], found[cut:]):
            total, n = float(self.weights[part].sum(dtype=np.float64)), max(len(part), 1)
            out += [total / n, total / math.sqrt(n) / 10]
        return out


class Logistic:
    """Ridge logistic regression on standardised features and their squares, by Newton steps."""

    def __init__(self, ridge: float = 1.0):
        self.ridge, self.mean, self.scale, self.w = ridge, np.zeros(2 * FEATURES), np.ones(2 * FEATURES), np.zeros(2 * FEATURES + 1)

    def expand(self, x: np.ndarray) -> np.ndarray:
        x = np.hstack([x, x * x])
        return np.hstack([(x - self.mean) / self.scale, np.ones((len(x), 1))])

    def fit(self, x: np.ndarray, y: np.ndarray) -> Logistic:
        if len(y) == 0:
            return self
        both = np.hstack([x, x * x])
        self.mean, self.scale = both.mean(0), both.std(0) + 1e-6
        z = self.expand(x)
        penalty = np.full(z.shape[1], self.ridge)
        penalty[-1] = 1e-3
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(z @ self.w, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * self.w)
            self.w = self.w + step
            if np.abs(step).max() < 1e-6:
                break
        return self

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.expand(x) @ self.w, -12, 12)


class Model:
    """What ``fit`` learns: the evidence, the regression, and the sites' priors."""

    def __init__(self, evidence: Evidence, logistic: Logistic, rate: float, host_strength: float, path_strength: float):
        self.evidence, self.logistic = evidence, logistic
        self.rate, self.host_strength, self.path_strength = rate, host_strength, path_strength

    def log_odds(self, texts: list[str | None]) -> np.ndarray:
        return self.logistic.log_odds(np.array([self.evidence.features(t or "") for t in texts]).reshape(-1, FEATURES))


def _term_counts(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Documents per (half, label) and bucket, and per (half, label), from rows (half, y, t)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("quality", _buckets.clear)
        counts = np.zeros((4, TERMS + 1), np.int64)
        for batch in slices(batches):
            for half, y, t in zip(*(column(batch, k) for k in range(3)), strict=True):
                group = counts[2 * half + int(y > 0.5)]
                group[terms(t or "")] += 1
                group[TERMS] += 1
        group, bucket = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(group, pa.int32()), pa.array(bucket, pa.int32()), pa.array(counts[group, bucket])], names=["g", "k", "n"])

    parts = rows.select("half", "y", "t").mapInArrow(run, "g int, k int, n long")
    counts = np.zeros((4, TERMS + 1), np.int64)
    found = parts.groupBy("g", "k").agg(F.sum("n").alias("n")).toArrow()  # at most 4 rows a bucket
    counts[found["g"].to_numpy(), found["k"].to_numpy()] = found["n"].to_numpy()
    return counts[:, :TERMS], counts[:, TERMS]


def _evidence(counts: np.ndarray, sizes: np.ndarray, halves: tuple[int, ...]) -> Evidence:
    good, bad = ([2 * h + y for h in halves] for y in (1, 0))
    return Evidence(counts[good].sum(0), counts[bad].sum(0), int(sizes[good].sum()), int(sizes[bad].sum()))


def fit(
    docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text",
    source_col: str = "source", section_col: str = "lang",
) -> Model:
    """Fit the classifier on at most ``max_rows`` labelled rows, those with the smallest hashes of their ids.

    The sites' priors come from all labelled rows. Rows with a null label, or an id without document,
    don't count. Without labelled rows all log odds are 0.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("y")).where("y is not null and id is not null")
    sited = docs.select(F.col(id_col).alias("id"), host_of(F.col(source_col)).alias("host"), path_of(F.col(source_col), F.col(section_col)).alias("path"))
    paths = materialise(known.join(sited, "id").groupBy("host", "path").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum((F.col("y") > 0.5).cast("double")).alias("s")), "quality-labelled", few=True)
    priors = site_priors(paths)
    discard(paths)

    # at most max_rows pairs of numbers are broadcast, and as many texts written; the sample is dealt anew, so
    # that all tasks of the scan stay and few files are written
    picked = known.join(docs.select(F.col(id_col).alias("id")), "id", "left_semi").orderBy(F.xxhash64(F.lit(5), "id"), "id", "y").limit(max_rows)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).join(F.broadcast(picked), "id")
    sample = rows.select("y", F.pmod(F.xxhash64(F.lit(6), "id"), F.lit(2)).cast("int").alias("half"), "t")
    rows = materialise(sample.repartition(SAMPLE_TASKS), "quality-sample", few=True)
    counts, sizes = _term_counts(rows)
    halves = docs.sparkSession.sparkContext.broadcast([_evidence(counts, sizes, (1 - h,)) for h in (0, 1)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("quality", _buckets.clear)
        for batch in slices(batches):
            x = [np.array(halves.value[half].features(t or "")).tobytes() for half, t in zip(column(batch, 1), column(batch, 2), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.binary())], names=["y", "x"])

    got = sorted((bytes(r["x"]), r["y"]) for r in rows.select("y", "half", "t").mapInArrow(run, "y double, x binary").collect())
    discard(rows)
    x = np.array([np.frombuffer(b) for b, _ in got]).reshape(-1, FEATURES)
    logistic = Logistic().fit(x, np.array([float(y > 0.5) for _, y in got]))
    return Model(_evidence(counts, sizes, (0, 1)), logistic, *priors)


def host_of(source: Column) -> Column:
    bare = F.regexp_replace(F.coalesce(source, F.lit("")), "^[a-z]+://", "")
    return F.substring_index(bare, "/", 1)


def path_of(source: Column, section: Column) -> Column:
    """Host and directories; the section where the source has no slash."""
    bare = F.regexp_replace(F.coalesce(source, F.lit("")), "^[a-z]+://", "")
    return F.when(F.contains(bare, F.lit("/")), F.regexp_replace(bare, "/[^/]*$", "")).otherwise(
        F.concat(bare, F.lit("#"), F.coalesce(section, F.lit("")))
    )


def document_log_odds(text: Column, model: Model, spark) -> Column:
    """The classifier's log odds of whole texts."""
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # a fixed number of weights

    @F.arrow_udf("double")
    def log_odds(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hold("quality", _buckets.clear)
        for batch in batches:
            parts = [shared.value.log_odds(batch.slice(lo, 500).to_pylist()) for lo in range(0, len(batch), 500)]
            yield pa.array(np.concatenate([np.zeros(0), *parts]))

    return log_odds(text)


def strength(n: str, s: str, parent: Column) -> Column:
    """Aggregate: prior strength from the spread of group rates around ``parent``, by moments; 2 to 200.

    Between-group variance: the weighted spread of the rates, less what sampling explains.
    """
    rate = F.col(s) / F.col(n)
    noise = F.sum(parent * (1 - parent))
    spread = F.sum(F.col(n) * (rate - parent) * (rate - parent))
    between = (spread - noise) / F.greatest(F.sum(F.col(n)) - F.sum(F.col(n) * F.col(n)) / F.sum(F.col(n)), F.lit(1.0))
    mean_var = noise / F.count(F.lit(1))
    return F.when(between <= 1e-6, F.lit(200.0)).otherwise(F.least(F.lit(200.0), F.greatest(F.lit(2.0), mean_var / between - 1)))


def site_priors(paths: DataFrame) -> tuple[float, float, float]:
    """(global rate, strength of hosts' priors, strength of paths' priors) from rows (host, path, n, s)."""
    total = paths.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    g = ((total["s"] or 0.0) + 0.5) / ((total["n"] or 0.0) + 1)
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"))
    m_host = hosts.agg(strength("hn", "hs", F.lit(g)).alias("m")).first()["m"] or 200.0
    rates = hosts.select("host", ((F.col("hs") + m_host * g) / (F.col("hn") + m_host)).alias("host_rate"))
    m_path = paths.join(rates, "host").agg(strength("n", "s", F.col("host_rate")).alias("m")).first()["m"] or 200.0
    return g, m_host, m_path


def site_shift(p: Column, n: Column, s: Column, hn: Column, hs: Column, model: Model) -> Column:
    """The path's posterior log odds less the global ones, without the document of probability ``p`` itself."""
    g, m_host, m_path = model.rate, model.host_strength, model.path_strength
    less = lambda total: F.greatest(total - p, F.lit(0.0))
    host = (less(hs) + m_host * g) / (hn - 1 + m_host)
    rate = (less(s) + m_path * host) / (n - 1 + m_path)
    rate = F.least(F.lit(0.9999), F.greatest(F.lit(0.0001), rate))
    return F.ln(rate / (1 - rate)) - math.log(g / (1 - g))


def scored(docs: DataFrame, model: Model, columns: list[str], text_col: str = "text", source_col: str = "source", section_col: str = "lang") -> DataFrame:
    """(row struct of ``columns``, own, site, quality), one row per row of docs."""
    # as a struct the columns can't clash with the names used here
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`").alias(c) for c in columns]).alias("row"), host_of(F.col(source_col)).alias("host"),
        path_of(F.col(source_col), F.col(section_col)).alias("path"), document_log_odds(F.col(text_col), model, docs.sparkSession).alias("own"),
    )
    rows = materialise(rows, "quality-own").withColumn("p", 1 / (1 + F.exp(-F.col("own"))))
    sites = rows.groupBy("host", "path").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("p").alias("s"))
    sites = materialise(sites, "quality-sites", few=True)
    hosts = sites.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"))
    both = sites.join(hosts, "host").select(F.col("host").alias("h2"), F.col("path").alias("p2"), "n", "s", "hn", "hs")
    joined = rows.join(both, (F.col("host") == F.col("h2")) & (F.col("path") == F.col("p2")), "left")
    site = site_shift(F.col("p"), F.col("n"), F.col("s"), F.col("hn"), F.col("hs"), model) * SITE_WEIGHT
    return joined.select("row", "own", site.alias("site")).withColumn("quality", 1 / (1 + F.exp(-(F.col("own") + F.col("site")))))


def classify(
    docs: DataFrame, model: Model, columns: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    section_col: str = "lang",
) -> DataFrame:
    """``columns`` (default: the id) and __own, __site, __quality (0 to 1), one row per row of docs.

    Null or empty text has the classifier's value for no words; null source and section are sites of
    their own. Repeated rows stay repeated. Columns of docs with the three names are replaced. Very long
    texts are hashed in blocks, whole. Texts are read once: the log odds are written beside ``columns``, and
    only the table of paths is joined to them; where that is small it is broadcast, else rows are dealt by site,
    and adaptive execution splits hot ones.
    """
    out = scored(docs, model, columns or [id_col], text_col, source_col, section_col)
    new = {"__own": "own", "__site": "site", "__quality": "quality"}
    kept = [F.col("row")[c].alias(c) for c in (columns or [id_col]) if c not in new]
    return out.select(*kept, *[F.col(v).alias(k) for k, v in new.items()])


def keep_good(docs: DataFrame, model: Model, least: float = 0.5, **names: str) -> DataFrame:
    """The rows of docs, unchanged, whose quality is ``least`` or more."""
    return scored(docs, model, docs.columns, **names).where(F.col("quality") >= least).select("row.*")
