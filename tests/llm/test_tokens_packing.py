import random

import numpy as np
import pytest

from tessera.llm import packing
from tessera.llm.queries import vocabulary
from tessera.llm.tokens import WordTokens, count_tokens


@pytest.fixture(scope="module")
def tokens():
    return WordTokens(vocabulary())


def library_ids(tokens, text):
    return tokens.library.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize(
    "text",
    [None, "", "don't 'S ''s", "a\x85b\xa0c ½²", "x\x1cy", "İstanbul ΑΣ ﬁ", "é é 's!'s", "<| <|endof <|a", "\x00\x01 ª", "in <|endoftext|>side", "ẞ ß Ĳ ŉ", "日本", "a" * 9000],
)
def test_ids_are_the_librarys(tokens, text):
    assert np.frombuffer(tokens.encode([text])[0], np.uint32).tolist() == library_ids(tokens, text)


def test_random_texts_and_small_memo(tokens, monkeypatch):
    from tessera.llm import tokens as module

    monkeypatch.setattr(module, "MEMO_ENTRIES", 20)
    rng, letters = random.Random(1), "abcDEF éß'.,!1²\n\t<|>-"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(300)]
    for lo in range(0, 300, 50):
        got = tokens.encode(texts[lo : lo + 50])
        assert [np.frombuffer(g, np.uint32).tolist() for g in got] == [library_ids(tokens, t) for t in texts[lo : lo + 50]]


def test_whole_tokens_are_proven(tokens):
    assert len(tokens.whole) > 10_000
    for word in random.Random(2).sample(sorted(tokens.whole), 300):
        assert library_ids(tokens, word) == np.frombuffer(tokens.whole[word], np.uint32).tolist()


def test_counts(make_docs, tokens, odd):
    rows = count_tokens(make_docs(odd), vocabulary(), limit=100).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in rows} == {
        i: (len((t or "").encode()), len(n), len(n) > 100) for i, t in enumerate(odd) for n in [library_ids(tokens, t)]
    }
    assert count_tokens(make_docs([]), vocabulary()).count() == 0


def test_very_long_and_repeated_texts(make_docs, tokens):
    """Texts of a megabyte, one without white space, are counted and packed whole; repeated rows each count."""
    rng = random.Random(4)
    long = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 8))) for _ in range(220_000))
    texts = [long, "xyz" * 60_000, "word", "word", long[:500_000] + "日本"]
    docs = make_docs([*enumerate(texts), (2, "word")])
    counts = [len(library_ids(tokens, t)) for t in texts]
    got = sorted((r.doc_id, r.n_tokens) for r in count_tokens(docs, vocabulary()).collect())
    assert got == sorted([*enumerate(counts), (2, counts[2])])
    pieces = packing.pack(docs, vocabulary()).where("doc_id in (0, 1, 4)").select("doc_id", "start", "ids").collect()
    for k in (0, 1, 4):
        whole = b"".join(bytes(r.ids) for r in sorted((r for r in pieces if r.doc_id == k), key=lambda r: r.start))
        assert np.frombuffer(whole, np.uint32).tolist() == [*library_ids(tokens, texts[k]), 1]


def check_packing(pieces, expected, window):
    by_doc, by_sequence = {}, {}
    for r in pieces:
        ids = np.frombuffer(bytes(r.ids), np.uint32).tolist()
        assert len(ids) == r.length <= window
        by_doc.setdefault(r.doc_id, []).append((r.start, ids, r.doc_tokens))
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for doc, parts in by_doc.items():
        parts.sort()
        joined = []
        for start, ids, total in parts:
            assert start == len(joined) and total == len(expected[doc])
            joined += ids
        assert joined == expected[doc]
    assert by_doc.keys() == {d for d, ids in expected.items() if ids}
    totals = []
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
        totals.append(at)
    return totals


def test_packing_round_trip(make_docs, tokens, odd):
    rng = random.Random(3)
    texts = odd + [" ".join(rng.choice("the of and to in it".split()) for _ in range(rng.randrange(1, 400))) for _ in range(150)]
    expected = {i: library_ids(tokens, t) + [1] for i, t in enumerate(texts)}
    totals = check_packing(packing.pack(make_docs(texts), vocabulary(), window=128, bins=16).collect(), expected, 128)
    assert sum(128 - t for t in totals) < 0.06 * sum(totals) + 128
    without = packing.pack(make_docs(["", "a"]), vocabulary(), window=128, bins=16, end_id=None).collect()
    assert [r.doc_id for r in without] == [1]
    assert packing.pack(make_docs([]), vocabulary(), window=128, bins=16).count() == 0


def test_copies_and_repeated_ids(make_docs, tokens):
    docs = make_docs(["the of and " * 30] * 200)
    totals = check_packing(packing.pack(docs, vocabulary(), window=128, bins=16).collect(), {i: library_ids(tokens, "the of and " * 30) + [1] for i in range(200)}, 128)
    assert len(totals) <= -(-sum(totals) // 128) + 5
    twice = packing.pack(make_docs([(7, "a b"), (7, "a b")]), vocabulary(), window=128, bins=16).collect()
    assert sum(r.length for r in twice) == 6


def test_nnls_and_plan():
    a, x = np.random.default_rng(0).random((20, 30)), np.zeros(30)
    x[[3, 9, 17]] = 2, 5, 1
    got = packing.nnls(a, a @ x)
    assert (got >= 0).all() and np.allclose(a @ got, a @ x, atol=1e-6)
    assert all(sum(c) == 16 and len(c) <= 3 for c in packing.combinations(16, 3))
    assert len(packing.combinations(128, 3)) == 1 + 64 + 1365
    histogram = np.array([0, 5, 0, 7, 0, 0, 9, 1, 30])
    held = np.zeros(9, int)
    for combo, repeats in packing.plan(histogram):
        for part in combo:
            held[part] += repeats
    assert (held <= histogram).all() and held[8] == 30
