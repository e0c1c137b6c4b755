"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text is built. A text is parsed into phrases, each the
longest match of what follows in that automaton; a character that the automaton lacks is a phrase of its
own. The language whose automaton needs the fewest phrases for the text's letters wins; all automata are
built from samples of the same bounded length, so the counts compare. Letters of all scripts have their
own codes; Han, Hangul and the like are spelled as two codes a letter.

The automata are tables, dense where letters are few and hashed where they are many, so that all of them stay
below about 100 MB whatever the scripts. All pieces of a batch walk them in lockstep: one gather per character
position. Texts longer than ``SEGMENT`` letters are walked as several pieces, each at first as if a phrase
began there. Then each piece is walked again from the state in which the piece before it ends, until that
walk meets the first one; from there on both are the same. So phrases are those of the whole text.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import column, groups_of, small_batches

SEGMENT = 1024


WIDE = 0x3400  # from here on scripts have thousands of letters: Han, Yi, Hangul and others
HIGH = WIDE  # codes of such a letter's upper bits; those of its lower 7 bits follow
LOW = HIGH + (0x110000 >> 7)
LETTERS = LOW + 128


def letter_tables() -> tuple[np.ndarray, np.ndarray]:
    """By code point: the lower-case letter's code point, 0 for white space and marks; and which are letters.

    Vowel signs and accents that are characters of their own are part of words, but aren't letters.
    """
    folded, letter = np.zeros(0x110000, np.uint32), np.zeros(0x110000, bool)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            folded[c], letter[c] = ord(ch.lower()[0]), True
        elif c >= 0x300 and unicodedata.category(ch) in ("Mn", "Mc") and not (0xFE00 <= c <= 0xFE0F or c >= 0xE0000):  # not variation selectors
            folded[c] = c
    return folded, letter


FOLDED, IS_LETTER = letter_tables()


def encode(text: str) -> np.ndarray:
    """Codes of the letters of ``text``, with a run of other characters as one 0; empty if there is no letter.

    A letter below ``WIDE`` is one code, a later one two, so that automata need few columns.
    """
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if not IS_LETTER[points].any():
        return np.zeros(0, np.uint16)
    folded = FOLDED[points]
    keep = folded > 0
    keep[1:] |= folded[:-1] > 0
    folded = folded[keep]
    codes = np.minimum(folded, WIDE).astype(np.uint16)
    at = np.flatnonzero(folded >= WIDE)
    if len(at):
        codes[at] = HIGH + (folded[at] >> 7)
        codes = np.insert(codes, at + 1, (LOW + (folded[at] & 127)).astype(np.uint16))
    return codes


#: Bytes of the transition tables of all languages together, while they are dense.
TABLE_BYTES = 80 << 20


class Sparse:
    """Transitions as a hash table with linear probing, for automata whose dense table would be large."""

    def __init__(self, step: list[dict], symbols: int):
        self.symbols = symbols
        key = np.array([s * symbols + c for s, to in enumerate(step) for c in to], np.int64)
        to = np.array([t for d in step for t in d.values()], np.int32)
        self.bits = max(4, int(2 * len(key)).bit_length())
        self.keys, self.to = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        slot, left = self._slot(key), np.arange(len(key))
        while len(left):
            free = self.keys[slot[left]] < 0
            self.keys[slot[left[free]]] = key[left[free]]  # of several for a slot one stays
            mine = self.keys[slot[left]] == key[left]
            self.to[slot[left[mine]]] = to[left[mine]]
            left = left[~mine]
            slot[left] = (slot[left] + 1) % len(self.keys)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def after(self, state: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        key = state.astype(np.int64) * self.symbols + symbols
        slot = self._slot(key)
        found = self.keys[slot]
        open_ = np.flatnonzero((found != key) & (found >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) % len(self.keys)
            found = self.keys[slot[open_]]
            open_ = open_[(found != key[open_]) & (found >= 0)]
        return np.where(self.keys[slot] == key, self.to[slot], 0).astype(np.int32)


class SuffixAutomaton:
    """Blumer's automaton of one string; state 0 is the start, 0 also 'none'. ``table`` is dense up to ``most_bytes``, else sparse."""

    def __init__(self, codes: np.ndarray, symbols: int, most_bytes: int = TABLE_BYTES):
        link, length, step, last = [-1], [0], [{}], 0
        for c in codes.tolist():
            new = len(step)
            step.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in step[p]:
                step[p][c] = new
                p = link[p]
            if p >= 0:
                q = step[p][c]
                if length[p] + 1 == length[q]:
                    link[new] = q
                else:
                    twin = len(step)
                    step.append(dict(step[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and step[p].get(c) == q:
                        step[p][c] = twin
                        p = link[p]
                    link[q] = link[new] = twin
            last = new
        if 4 * len(step) * symbols > most_bytes:
            self.table = Sparse(step, symbols)
            return
        self.table = np.zeros((len(step), symbols), np.int32)
        for s, to in enumerate(step):
            if to:
                self.table[s, list(to)] = list(to.values())


class CrossParser:
    def __init__(self, samples: dict[str, np.ndarray]):
        """samples: codes of labelled text per language."""
        self.languages = sorted(samples)
        used = np.zeros(LETTERS, bool)
        for codes in samples.values():
            used[codes] = True
        n = int(used.sum())
        self.symbol = np.where(used, np.cumsum(used), 0).astype(np.uint8 if n < 256 else np.uint16)  # 0: a letter in no sample
        # each language's table has columns for its own letters; column 0 stands for all others
        self.own, self.tables, self.width = [], [], []
        for name in self.languages:
            sample = self.symbol[samples[name]]
            mine = np.unique(sample)
            own = np.zeros(n + 1, np.uint16)
            own[mine] = np.arange(1, len(mine) + 1)
            self.own.append(own)
            table = SuffixAutomaton(own[sample], len(mine) + 1, TABLE_BYTES // len(samples)).table
            # states are multiples of a dense table's width
            self.width.append(1 if isinstance(table, Sparse) else len(mine) + 1)
            self.tables.append(table if isinstance(table, Sparse) else table.ravel())

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Number of phrases, a row per text and a column per language."""
        owner, pieces = [], []
        for i, codes in enumerate(texts):
            for lo in range(0, len(codes), SEGMENT):
                owner.append(i)
                pieces.append(codes[lo : lo + SEGMENT])
        counts = np.zeros((len(texts), len(self.languages)), np.int64)
        if not pieces:
            return counts
        size = np.array([len(p) for p in pieces])
        order = np.argsort(-size, kind="stable")
        size, place = size[order], np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        grid = np.zeros((size[0], len(pieces)), self.symbol.dtype)
        for k, i in enumerate(order):
            grid[: size[k], k] = self.symbol[pieces[i]]
        owner = np.array(owner)
        # columns of the grid that continue a text, and the columns they continue
        later = np.flatnonzero(owner[1:] == owner[:-1]) + 1
        after, before = place[later], place[later - 1]
        for lang in range(len(self.languages)):
            np.add.at(counts[:, lang], owner[order], self._walk(lang, grid, size, after, before))
        return counts

    def _step(self, lang: int, state: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(states after a letter, whether a phrase begins with it); states are multiples of the table's width."""
        own, table, width = self.own[lang], self.tables[lang], self.width[lang]
        c = own[symbols]
        after = table.after if isinstance(table, Sparse) else lambda s, c: table[s + c]
        to = after(state, c)
        fresh = state == 0
        fresh |= to == 0
        to *= width
        stuck = np.flatnonzero(to == 0)
        if len(stuck):
            to[stuck] = after(np.zeros(len(stuck), np.int32), c[stuck]) * width
        return to, fresh

    def _walk(self, lang: int, grid: np.ndarray, size: np.ndarray, after: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Phrases that begin in each column: column after[k] goes on where column before[k] ends."""
        n = len(size)
        state, found = np.zeros(n, np.int32), np.zeros(n, np.int64)
        live = np.searchsorted(-size, -np.arange(1, size[0] + 1), side="right")
        several = len(after) > 0
        # only columns that continue a text are walked again; they are among the first, with those before them
        kept = int(max(after.max(), before.max())) + 1 if several else 0
        states, begins = np.zeros((size[0], kept), np.int32), np.zeros((size[0], kept), bool)
        for t in range(size[0]):
            m = live[t]
            to, fresh = self._step(lang, state[:m], grid[t, :m])
            found[:m] += fresh
            state[:m] = to
            if several:
                states[t, : min(m, kept)], begins[t, : min(m, kept)] = to[:kept], fresh[:kept]
        if not several:
            return found
        start = np.zeros(n, np.int32)  # the state that each column's walk has begun with
        while True:
            wrong = start[after] != state[before]
            at, now = after[wrong], state[before[wrong]]
            if not len(at):
                return found
            start[at] = now
            for t in range(size[0]):
                inside = t < size[at]
                at, now = at[inside], now[inside]
                if not len(at):
                    break
                now, fresh = self._step(lang, now, grid[t, at])
                found[at] += fresh.astype(np.int64) - begins[t, at]
                same = states[t, at] == now
                states[t, at], begins[t, at] = now, fresh
                ended = size[at] == t + 1
                state[at[ended]] = now[ended]
                at, now = at[~same], now[~same]


def fit(
    docs: DataFrame, eligible, rows_per_language: int = 300, letters_per_language: int = 40_000, letters_in_all: int = 800_000,
    lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text",
) -> CrossParser | None:
    """Learn from rows where ``eligible`` holds and text and language aren't null.

    Bounds: per language at most ``rows_per_language`` rows and ``letters_per_language`` characters, or fewer
    where languages are so many that ``letters_in_all`` would be passed. Rows whose texts are short enough for
    many to fit come first, by hash of the id, longer ones by length, so a language with many short rows learns
    from these alone. Texts are learned whole. A language whose first row is longer than its bound learns that row
    alone, whole up to the language's share of ``letters_in_all``, which is all that the driver can hold; only
    beyond that is it cut. So no more than ``letters_in_all`` characters go to the driver.
    """
    rows = docs.where(eligible & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    languages = rows.select(lang_col).distinct().count()
    if not languages:
        return None
    at_most = letters_in_all // languages
    most = min(letters_per_language, at_most)
    share = max(200, 4 * most // rows_per_language)
    h = F.xxhash64(F.lit(17), F.col(id_col))
    light = rows.select(
        F.col(lang_col).alias("lang"), F.col(id_col).alias("id"), F.length(text_col).alias("n"),
        F.when(F.length(text_col) <= share, 0).otherwise(F.length(text_col)).alias("late"), h.alias("h"), F.pmod(F.xxhash64(F.lit(18), F.col(id_col)), F.lit(256)).alias("salt"),
    )
    best = ["late", "h", "id", "n"]
    # the first rows of each salt, then of each language: no task gets a language's rows
    light = light.withColumn("k", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*best))).where(F.col("k") <= rows_per_language)
    order = Window.partitionBy("lang").orderBy(*best)
    light = light.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= rows_per_language)
    light = light.withColumn("letters", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    picked = light.where((F.col("letters") <= most) | (F.col("rank") == 1)).select(F.col("id").alias("__id"), F.col("lang").alias("__lang"), F.col("n").alias("__n"))
    # a broadcast of rows_per_language ids a language at most
    whole = rows.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("t"))
    same = (F.col("id") == F.col("__id")) & (F.col("lang") == F.col("__lang")) & (F.length("t") == F.col("__n"))
    found = whole.join(F.broadcast(picked.distinct()), same, "left_semi").select("id", "lang", F.substring("t", 1, at_most).alias("t")).distinct().collect()
    samples: dict[str, list[np.ndarray]] = {}
    for r in sorted(found, key=lambda r: (r["lang"], r["id"], r["t"])):
        samples.setdefault(r["lang"], []).append(np.append(encode(r["t"]), np.uint16(0)))
    return CrossParser({k: np.concatenate(v) for k, v in samples.items()})


def predict(docs: DataFrame, parser: CrossParser | None, keep: list | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) per row, plus the columns ``keep``.

    ``und`` with score 0 where text is null or has no letter of any script, or nothing could be learned. score: 1 minus
    the ratio of phrases needed by the best and by the second best language, scaled to 0..1; a tie goes
    to the first language in alphabetical order. Repeated rows stay repeated. Texts are parsed whole, very
    long ones too; other columns aren't read but for ``keep``, so their names don't matter.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(parser)  # bounded by letters_in_all

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = shared.value
        for batch in batches:
            texts = column(batch, 1)
            names, scores = [], []
            for lo, hi in groups_of(texts, 1_000_000):
                codes = [encode(t or "") for t in texts[lo:hi]]
                if parser is None:
                    names += ["und"] * (hi - lo)
                    scores += [0.0] * (hi - lo)
                    continue
                n = parser.phrases(codes)
                best = n.argmin(1)
                two = np.partition(n, 1, axis=1) if n.shape[1] > 1 else np.column_stack([n[:, 0], n[:, 0] * 2])
                margin = np.clip(4 * (1 - two[:, 0] / np.maximum(two[:, 1], 1)), 0, 1)
                for i, c in enumerate(codes):
                    known = bool(c.any())
                    names.append(parser.languages[best[i]] if known else "und")
                    scores.append(float(margin[i]) if known else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), *batch.columns[2:]], names=["id", "lang_pred", "score", *more])

    extra = [c.alias(f"k{i}") for i, c in enumerate(keep or [])]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), *extra)
    more = [f"k{i}" for i in range(len(extra))]
    kinds = ", ".join([f"id {rows.schema['id'].dataType.simpleString()}, lang_pred string, score double", *(f"{m} {rows.schema[m].dataType.simpleString()}" for m in more)])
    out = rows.mapInArrow(run, kinds)
    return out.withColumnRenamed("id", id_col)
