"""Token counts by the whole-token shortcut.

A vocabulary string that is itself one pre-token, and that the library encodes to one id, is proven
to be a whole token. Texts are cut at white space, pieces are cut into pre-tokens; a proven pre-token
gets its id directly and only the others go through the library's merges. Results of merges are
memoised per Python worker in a table of bounded size.

Where it can't be shown that cutting at white space commutes with the library's normaliser (characters
above U+024F, separators U+001C to U+001F, U+0130, or a special token's string inside the text), the
library encodes the whole text.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import column, groups_of, hold, slices, small_batches

UNSAFE = re.compile("[^\x00-ɏ]|[\x1c-\x1fİ]")
MEMO_ENTRIES = 300_000


def _byte_letters() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the rest are shifted up."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    letters = {chr(b): b for b in own}
    for k, b in enumerate(b for b in range(256) if b not in set(own)):
        letters[chr(256 + k)] = b
    return letters


class WordTokens:
    """Ids of texts under a word-level BPE file of the ``tokenizers`` library."""

    def __init__(self, path: str, whole: dict[str, bytes] | None = None):
        """``whole``: the proven whole tokens, where they are known already."""
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        spec = json.loads(self.library.to_str())
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        steps = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if steps != ["NFC", "Replace", "Lowercase"] or split["behavior"] != "Removed" or not split["invert"]:
            raise ValueError("the shortcut is proven for NFC, white-space folding and lower case only")
        self.pre_tokens = regex.compile(split["pattern"]["Regex"]).findall
        self.suffix = spec["model"]["end_of_word_suffix"]
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.merges = self.library.model.tokenize
        self.letter = {b: c for c, b in _byte_letters().items()}
        self.whole = self.prove_whole_tokens() if whole is None else whole
        self.parts: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}

    def prove_whole_tokens(self) -> dict[str, bytes]:
        """Strings that are one pre-token and that the library encodes to the one id of that string."""
        letters = _byte_letters()
        found = {}
        for token, i in self.library.get_vocab(with_added_tokens=False).items():
            if not token.endswith(self.suffix):
                continue
            try:
                text = bytes(letters[c] for c in token[: -len(self.suffix)]).decode()
            except (KeyError, UnicodeDecodeError):
                continue
            if text and text == text.lower() and not UNSAFE.search(text) and self.pre_tokens(text) == [text]:
                found[text] = i
        encoded = self.library.encode_batch_fast(list(found), add_special_tokens=False)
        return {t: array("I", [i]).tobytes() for (t, i), e in zip(found.items(), encoded, strict=True) if e.ids == [i]}

    def _merge(self, word: str) -> bytes:
        """The library's merges for a pre-token that isn't a whole token, in the byte-level alphabet."""
        if not word.isascii() or not word.isprintable():
            word = "".join([self.letter[b] for b in word.encode()])
        return array("I", [t.id for t in self.merges(word)]).tobytes()

    def _cut(self, chunk: str) -> list[str]:
        """Pre-tokens of a piece without white space; letters alone are one, by the pattern."""
        if chunk[-1] in ".,;:!?" and chunk[:-1].isalpha():
            return [chunk[:-1], chunk[-1]]
        return self.pre_tokens(chunk)

    def _resolve(self, missing: set[str]) -> None:
        """Puts the ids of these pieces into ``chunks``; what punctuation divides is also kept in ``parts``."""
        if len(self.parts) > MEMO_ENTRIES // 2:
            self.parts = {}
        whole, parts, chunks, merge = self.whole.get, self.parts, self.chunks, self._merge
        divided = []
        for chunk in missing:
            if chunk.isalpha():
                chunks[chunk] = whole(chunk) or merge(chunk)
            else:
                divided.append(chunk)
        for chunk in divided:
            ids = []
            for word in self._cut(chunk):
                known = whole(word) or chunks.get(word) or parts.get(word)
                if known is None:
                    known = parts[word] = merge(word)
                ids.append(known)
            chunks[chunk] = ids[0] if len(ids) == 1 else b"".join(ids)

    def _is_plain(self, text: str) -> bool:
        """No special token's string, and only characters for which cutting at white space is exact."""
        if any(s in text for s in self.special) or any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return False
        if text.isascii():
            return True
        try:
            text.encode("latin-1")
            return True
        except UnicodeEncodeError:
            return not UNSAFE.search(text)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit numbers, per text; null counts as empty."""
        words: list[list[str] | bytes] = []
        for text in texts:
            text = text or ""
            if self._is_plain(text):
                words.append(text.lower().split())
            else:
                words.append(array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes())
        needed = set(chain.from_iterable(w for w in words if isinstance(w, list)))
        missing = needed.difference(self.chunks)
        if missing:
            if len(self.chunks) + len(missing) > MEMO_ENTRIES:
                # what these texts use stays, the common words among it
                self.chunks = {c: self.chunks[c] for c in needed.intersection(self.chunks)}
            self._resolve(missing)
        get = self.chunks.__getitem__
        return [w if isinstance(w, bytes) else b"".join(map(get, w)) for w in words]


_loaded: dict[str, WordTokens] = {}


_proven: dict[str, dict[str, bytes]] = {}


def proven_tokens(spark: SparkSession, path: str) -> Broadcast:
    """The vocabulary's whole tokens, proven once on the driver and sent to all workers: less than the vocabulary file."""
    if path not in _proven:
        _proven[path] = WordTokens(path).whole
    return spark.sparkContext.broadcast(_proven[path])


def word_tokens(path: str, whole: dict[str, bytes] | None = None) -> WordTokens:
    """One a worker; its tables are let go when another operator starts there."""
    hold("tokens", _loaded.clear)
    if path not in _loaded:
        _loaded[path] = WordTokens(path, whole)
    return _loaded[path]


def count_tokens(docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) per row of ``docs``.

    Null text counts as empty: 0 bytes, 0 tokens. Repeated rows stay repeated, a null id stays null,
    other columns are not read.
    """

    whole = proven_tokens(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = word_tokens(path, whole.value)
        for batch in slices(batches):
            texts = column(batch, 1)
            counts = [len(x) // 4 for lo, hi in groups_of(texts) for x in tokens.encode(texts[lo:hi])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts, pa.int64())], names=["id", "n_bytes", "n_tokens"])

    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("b"))
    out = rows.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
