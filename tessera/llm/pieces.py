"""SentencePiece encoding and decoding by vectorised merge rounds.

Texts are cut where no piece of the vocabulary can span the cut: before each run of white space, and
between any two characters that stand side by side in no piece. Merges in one such word don't touch
another, so all words of a batch are merged together in flat numpy arrays: each round finds the least
rank among the pairs of each word, merges that pair's leftmost occurrences, and compacts, until no pair
is left. Words of common length are remembered in a table of bounded size.

Merging all occurrences at once equals the library's one at a time where a piece's rank is its own and no
longer piece that starts or ends with it ranks as well or better; for other pieces (``alone`` below) a round
merges the leftmost occurrence in a word only.

Memory: texts go through in slices of about a million characters that end before white space, so a slice
is longer only where a text has no white space for that long. The memo lets go of words beyond its bound.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import column, groups_of, hold, slices, small_batches

SPACE = "▁"
MEMO_ENTRIES = 200_000
MEMO_LENGTH = 40
SLICE = 1_000_000
TOGETHER = 32_768  # words merged at once
EDGE = re.compile("(?<! ) ")
NONE = np.iinfo(np.int32).max


def _fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = message[at]
            at, out, shift = at + 1, out | (byte & 127) << shift, shift + 7
            if byte < 128:
                return out

    while at < len(message):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
            continue
        size = number() if kind == 2 else 8 if kind == 1 else 4
        yield key >> 3, message[at : at + size]
        at += size


class Pieces:
    """Ids of texts, and texts of ids, under a BPE model of the ``sentencepiece`` library with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=path)
        self._demand_plain(library.serialized_model_proto())
        n = library.get_piece_size()
        self.begin, self.end, unknown = library.bos_id(), library.eos_id(), library.unk_id()
        names = [library.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (library.is_control(i) or library.is_unknown(i) or library.is_byte(i))]
        if any(library.is_unused(i) for i in plain):
            raise ValueError("vocabularies with unused pieces aren't handled")
        self.byte_id = np.zeros(256, np.int32)
        for i in range(n):
            if library.is_byte(i):
                self.byte_id[int(names[i][3:5], 16)] = i
        self.is_byte = np.array([library.is_byte(i) for i in range(n)])
        # what an id adds to a decoded text, in UTF-8; ids of control pieces add nothing
        self.surface = [b""] * n
        for i in plain:
            self.surface[i] = names[i].replace(SPACE, " ").encode()
        for byte, i in enumerate(self.byte_id):
            self.surface[i] = bytes([byte])
        self.surface[unknown] = " ⁇ ".encode()

        # symbols: pieces by their ids; characters that only occur inside pieces get numbers after them
        symbol = {names[i]: i for i in plain}
        for c in sorted(set(chain.from_iterable(names[i] for i in plain))):
            symbol.setdefault(c, n + len(symbol))
        scores = {i: library.get_score(i) for i in plain}
        order = {s: k for k, s in enumerate(sorted(set(scores.values()), reverse=True))}
        rank = np.full(max(symbol.values()) + 1, NONE, np.int32)
        rank[plain] = [order[scores[i]] for i in plain]
        pairs = {}
        for i in plain:
            name = names[i]
            for cut in range(1, len(name)):
                left, right = symbol.get(name[:cut]), symbol.get(name[cut:])
                if left is not None and right is not None:
                    pairs[left, right] = i
        self.width = len(rank) + 1  # one more: a character of no piece
        # a hash table of pairs with linear probing; its last entry is no pair
        self.pair_key = np.array([*(a * self.width + b for a, b in pairs), -1], np.int64)
        self.pair_piece = np.array([*pairs.values(), self.width - 1], np.int32)
        self.slots = np.full(1 << (4 * len(pairs)).bit_length(), len(pairs), np.int32)
        free = np.arange(len(pairs))
        slot = self._slot(self.pair_key[:-1])
        while len(free):
            empty = self.slots[slot] == len(pairs)
            self.slots[slot[empty]] = free[empty]  # of several pairs for a slot one stays
            left = self.slots[slot] != free
            free, slot = free[left], (slot[left] + 1) % len(self.slots)
        self.rank = np.append(rank, NONE)

        shared = np.bincount(rank[plain], minlength=len(order) + 1) > 1
        alone = shared[np.minimum(rank, len(order))] & (rank < NONE)
        for (left, right), i in pairs.items():
            for part in (left, right):
                if rank[part] >= rank[i]:
                    alone[part] = True
        self.alone_rank = np.zeros(len(order) + 1, bool)
        self.alone_rank[rank[:n][alone[:n] & (rank[:n] < NONE)]] = True

        chars = {c: s for c, s in symbol.items() if len(c) == 1}
        points = np.array(sorted(map(ord, chars)), np.int64)
        self.char_point, self.char_symbol = points, np.array([chars[chr(p)] for p in points], np.int32)
        beside = {(ord(a), ord(b)) for i in plain for a, b in zip(names[i], names[i][1:], strict=False)}
        self.beside = np.array(sorted(a << 21 | b for a, b in beside), np.int64)
        if any(b == ord(SPACE) and a != b for a, b in beside):
            raise ValueError("a piece has white space after another character: words can't be cut there")
        self.words = re.compile(self._word_pattern({i: names[i] for i in plain}, rank))
        self.memo: dict[str, bytes] = {}

    @staticmethod
    def _demand_plain(proto: bytes) -> None:
        """The rounds are proven for BPE with byte fallback, no normalisation, and white space kept and escaped."""
        top = list(_fields(proto))
        trainer = dict(x for f, v in top if f == 2 for x in _fields(v))
        normal = dict(x for f, v in top if f == 3 for x in _fields(v))
        wanted = [trainer.get(3) == 2, trainer.get(35) == 1, not trainer.get(24, 0), not normal.get(2), normal.get(3, 1) == 1, normal.get(4, 1) == 0, normal.get(5, 1) == 1]
        if not all(wanted):
            raise ValueError("only BPE models with byte fallback, a dummy prefix and no normalisation are handled")

    def _word_pattern(self, names: dict[int, str], rank: np.ndarray) -> str:
        """White space and what follows it; a run far longer than the longest piece of white space gives that piece first.

        That is exact where all such pieces share the last rank: they merge after all others, from the left,
        and the longest can't grow.
        """
        blank = {len(name): i for i, name in names.items() if SPACE * 2 in name}
        longest = max(blank, default=1)
        same = all(names[i] == SPACE * k and rank[i] == max(rank[list(names)]) for k, i in blank.items())
        whole = longest > 1 and same and self._merge([SPACE * longest], cut=False)[0] == array("I", [blank[longest]]).tobytes()
        return (f" {{{longest}}}(?= {{{longest}}})|" if whole else "") + " *[^ ]+| +"

    def _lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that each pair of symbols makes; the last symbol (no rank) where it makes none."""
        key = left.astype(np.int64) * self.width + right
        slot = self._slot(key)
        at = self.slots[slot]
        open_ = np.flatnonzero((self.pair_key[at] != key) & (at < len(self.pair_key) - 1))
        while len(open_):
            slot[open_] = (slot[open_] + 1) % len(self.slots)
            at[open_] = found = self.slots[slot[open_]]
            open_ = open_[(self.pair_key[found] != key[open_]) & (found < len(self.pair_key) - 1)]
        return self.pair_piece[at]

    def _slot(self, key: np.ndarray) -> np.ndarray:
        bits = len(self.slots).bit_length() - 1
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)

    def _merge(self, words: list[str], cut: bool = True) -> list[bytes]:
        """Ids of each word (not empty, white space as the escape character) as bytes."""
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        sizes = np.array([len(w) for w in words])
        first = np.zeros(len(points), bool)
        first[np.cumsum(sizes) - sizes] = True
        if cut:
            key = points[:-1] << 21 | points[1:]
            at = np.minimum(np.searchsorted(self.beside, key), len(self.beside) - 1)
            first[1:] |= self.beside[at] != key
        at = np.minimum(np.searchsorted(self.char_point, points), len(self.char_point) - 1)
        known = self.char_point[at] == points
        symbols, starts = self._rounds(np.where(known, self.char_symbol[at], self.width - 1), np.flatnonzero(first))

        # characters of no piece become their bytes; the others kept one symbol each per piece
        lone = symbols >= len(self.surface)
        counts = np.ones(len(symbols), np.int64)
        spelled = points[starts[lone]]
        counts[lone] = 1 + (spelled >= 0x80) + (spelled >= 0x800) + (spelled >= 0x10000)
        ids = np.repeat(symbols, counts)
        if lone.any():
            raw = np.frombuffer("".join(map(chr, spelled.tolist())).encode(), np.uint8)
            ids[np.repeat(lone, counts)] = self.byte_id[raw]
        ends = np.cumsum(counts)[np.searchsorted(starts, np.cumsum(sizes)) - 1]
        flat = ids.astype("<u4").tobytes()
        return [flat[4 * a : 4 * b] for a, b in zip(np.append(0, ends[:-1]).tolist(), ends.tolist(), strict=True)]

    def _rounds(self, symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols after all merges and the character at which each begins, for words that begin at ``starts``."""
        at = np.arange(len(symbols))
        size = np.diff(np.append(starts, len(symbols)))
        last = np.zeros(len(symbols), bool)
        last[starts + size - 1] = True
        made = np.full(len(symbols), self.width - 1, np.int32)
        made[:-1] = self._lookup(symbols[:-1], symbols[1:])
        made[last] = self.width - 1
        rank = self.rank[made]
        done = []
        while len(symbols):
            least = np.minimum.reduceat(rank, starts)
            over = least == NONE
            if over.any():  # words without a pair leave
                gone = np.repeat(over, size)
                done.append((at[gone], symbols[gone]))
                stay = ~gone
                at, symbols, made, rank, last = at[stay], symbols[stay], made[stay], rank[stay], last[stay]
                size, least = size[~over], least[~over]
                if not len(size):
                    break
                starts = np.cumsum(size) - size
            hit = rank == np.repeat(least, size)
            where = np.flatnonzero(hit)
            word = np.searchsorted(starts, where, "right") - 1
            # of overlapping occurrences every other one, from the left
            fresh = np.append(True, np.diff(where) > 1)
            run = np.maximum.accumulate(np.where(fresh, np.arange(len(where)), 0))
            take = (np.arange(len(where)) - run) % 2 == 0
            one = self.alone_rank[least[word]]
            take &= ~one | np.append(True, np.diff(word) > 0)
            where, word = where[take], word[take]
            symbols[where] = made[where]
            last[where] = last[where + 1]
            stay = np.ones(len(symbols), bool)
            stay[where + 1] = False
            moved = np.cumsum(stay) - 1
            at, symbols, made, rank, last = at[stay], symbols[stay], made[stay], rank[stay], last[stay]
            size = size - np.bincount(word, minlength=len(size))
            starts = np.cumsum(size) - size
            fresh = np.zeros(len(symbols), bool)
            fresh[moved[where]] = True
            fresh[moved[where[where > 0]] - 1] = True
            changed = np.flatnonzero(fresh)
            made[changed] = self._lookup(symbols[changed], symbols[np.minimum(changed + 1, len(symbols) - 1)])
            made[changed[last[changed]]] = self.width - 1
            rank[changed] = self.rank[made[changed]]
        if not done:
            return symbols, at
        place = np.concatenate([a for a, _ in done])
        order = np.argsort(place, kind="stable")
        return np.concatenate([s for _, s in done])[order], place[order]

    def _slices(self, text: str) -> Iterator[str]:
        """Parts of about ``SLICE`` characters, cut before a run of blanks, whose first one is left out."""
        lo = 0
        while len(text) - lo > SLICE:
            found = EDGE.search(text, lo + SLICE)
            if not found:
                break
            yield text[lo : found.start()]
            lo = found.end()
        yield text[lo:]

    def encode(self, texts: list[str | None], begin: bool = True, end: bool = True) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit numbers, per text; null counts as empty. The texts' words are merged together."""
        head = array("I", [self.begin] if begin else []).tobytes()
        tail = array("I", [self.end] if end else []).tobytes()
        words = [self._cut(t.replace(SPACE, " ")) if t and len(t) <= SLICE else [] for t in texts]
        out = [head + ids + tail for ids in self._ids(words)]
        for k, text in enumerate(texts):
            if text and len(text) > SLICE:
                parts = [self._ids([self._cut(part)])[0] for part in self._slices(text.replace(SPACE, " "))]
                out[k] = b"".join([head, *parts, tail])
        return out

    def _cut(self, text: str) -> list[str]:
        """Words of a text before which a blank is put, each without its first blank."""
        if "  " in text or text[:1] == " ":
            return [w[1:] for w in self.words.findall(" " + text)]
        return text.split(" ")

    def _ids(self, texts: list[list[str]]) -> list[bytes]:
        """The ids of each text's words; those of all texts that the memo lacks are merged together."""
        needed = set(chain.from_iterable(texts))
        missing = list(needed.difference(self.memo))
        if len(self.memo) + len(missing) > MEMO_ENTRIES:
            # what these words use stays, the common ones among it
            self.memo = {w: self.memo[w] for w in needed.intersection(self.memo)}
        lo = 0
        for hi in range(0, len(missing) + TOGETHER, TOGETHER):
            some = missing[lo:hi]
            if some:
                self.memo.update(zip(some, self._merge([SPACE + w.replace(" ", SPACE) for w in some]), strict=True))
            lo = hi
        get = self.memo.__getitem__
        out = [b"".join(map(get, words)) for words in texts]
        for w in missing:
            if len(w) > MEMO_LENGTH:
                del self.memo[w]
        return out

    def decode(self, ids: bytes) -> str:
        """The text of ids as ``encode`` gives them; bytes that are no UTF-8 become U+FFFD, each on its own."""
        numbers = np.frombuffer(ids, "<u4")
        parts = list(map(self.surface.__getitem__, numbers.tolist()))
        # the blank that encoding put before a text is the first piece's; begin and end ids add nothing
        for k, part in enumerate(parts):
            if part:
                if part[:1] == b" " and not self.is_byte[numbers[k]] and part != self.surface[0]:
                    parts[k] = part[1:]
                break
        raw = b"".join(parts)
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return self._decode_broken(numbers, parts)

    def _decode_broken(self, numbers: np.ndarray, parts: list[bytes]) -> str:
        byte, out, k = self.is_byte[numbers], [], 0
        edges = np.flatnonzero(np.diff(byte)) + 1
        for hi in [*edges.tolist(), len(parts)]:
            raw = b"".join(parts[k:hi])
            while raw:
                size = next((s for s in range(1, 5) if _is_char(raw[:s])), 0)
                out.append(raw[:size].decode() if size else "�")
                raw = raw[size or 1 :]
            k = hi
        return "".join(out)


def _is_char(raw: bytes) -> bool:
    try:
        return len(raw.decode()) == 1
    except UnicodeDecodeError:
        return False


_loaded: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """One a worker; its tables are let go when another operator starts there."""
    hold("pieces", _loaded.clear)
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def encode(docs: DataFrame, path: str, begin: bool = True, end: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, n_tokens) per row of ``docs``: ids as little-endian unsigned 32-bit numbers, begin and end ids among them.

    Null text counts as empty: begin and end only. Repeated rows stay repeated, a null id stays null, other
    columns are not read. A very long text goes through in slices; equal texts get equal ids wherever they are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for batch in slices(batches):
            texts = column(batch, 1)
            for lo, hi in groups_of(texts):
                ids = pa.array(model.encode(texts[lo:hi], begin, end), pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), ids], names=["id", "ids"])

    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(run, f"id {kind}, ids binary")
    return out.select(F.col("id").alias(id_col), "ids", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"))


def decode(ids: Column, path: str) -> Column:
    """The text of a binary column of ids; null stays null, no ids give an empty text."""

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = pieces(path)
        for batch in batches:
            yield pa.array([None if x is None else model.decode(x) for x in batch.to_pylist()], pa.string())

    return run(ids)
