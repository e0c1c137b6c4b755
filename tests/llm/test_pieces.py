"""SentencePiece rounds against the library."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")

from tessera.llm import pieces as P  # noqa: E402

PATH = public_tokenizers.path("piece_bpe_32k.model")
PARTS = [" ", "  ", "a", "b", "the", "ing", "é", "①", "\n", "▁", "aaaa", "日本", " " * 17, "\x00", "\U0001f600", "<s>", "<0x41>", "̈", "\r\n", "."]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def model():
    return P.Pieces(PATH)


def _check(model, library, texts):
    for text, ids in zip(texts, model.encode(texts), strict=True):
        want = library.encode(text or "", add_bos=True, add_eos=True)
        assert np.frombuffer(ids, "<u4").tolist() == want, text[:100]
        assert model.decode(ids) == library.decode(want), text[:100]


def test_mixed_texts(model, library, odd):
    r = random.Random(5)
    texts = ["".join(r.choice(PARTS) for _ in range(r.randint(0, 25))) for _ in range(3000)]
    _check(model, library, [*texts, *odd])


def test_letters_without_white_space(model, library):
    r = random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyz"
    _check(model, library, ["".join(r.choice(letters) for _ in range(n)) for n in (1, 2, 40, 41, 3000, 20_000)])


def test_runs_of_blanks_and_of_a_letter(model, library):
    texts = [" " * k for k in range(70)] + [" " * k + "abc" for k in range(60)] + ["x" + " " * k + "<" for k in range(60)] + ["a" * k for k in range(100)]
    _check(model, library, texts)


def test_a_very_long_text_goes_in_slices(model, library, monkeypatch):
    r = random.Random(7)
    text = "".join(r.choice(PARTS) for _ in range(4000))
    for size in (1, 7, 100, 1000):
        monkeypatch.setattr(P, "SLICE", size)
        _check(model, library, [text, text + "x" * 500, " " * 300 + text])


def test_the_memo_lets_go(model, library, monkeypatch):
    monkeypatch.setattr(P, "MEMO_ENTRIES", 20)
    monkeypatch.setattr(P, "TOGETHER", 7)
    model.memo = {}
    r = random.Random(8)
    for _ in range(30):
        _check(model, library, [" ".join(r.choice(["in", "on", "able", "x" * 50]) + str(r.randint(0, 99)) for _ in range(8))])
        assert len(model.memo) <= 20 + 8


def test_ids_that_are_no_text(model, library):
    """Broken bytes, control pieces in the middle, the unknown piece."""
    byte = model.byte_id
    for ids in ([1, byte[0xE2], byte[0x82], 2], [byte[0xFF], 400, byte[0xC3], byte[0xA9]], [1, 1, 400, 2, 2, 400], [0, 400], [], [byte[0x20], 400], [byte[0xF0], byte[0x9F], byte[0x98], byte[0x80]]):
        ids = [int(i) for i in ids]
        assert model.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids), ids


def test_other_models_are_refused(tmp_path):
    with pytest.raises(ValueError, match="byte fallback"):
        P.Pieces._demand_plain(b"")


def test_frames(spark, make_docs, odd, library):
    docs = make_docs([*odd, odd[3]]).repartition(3)
    out = P.encode(docs, PATH).withColumn("text", P.decode(F.col("ids"), PATH))
    got = {r["doc_id"]: r for r in out.collect()}
    assert len(got) == len(odd) + 1
    for k, text in enumerate(odd):
        want = library.encode(text or "", add_bos=True, add_eos=True)
        assert np.frombuffer(got[k]["ids"], "<u4").tolist() == want and got[k]["n_tokens"] == len(want) and got[k]["text"] == library.decode(want)
    assert got[3]["ids"] == got[len(odd)]["ids"]
    bare = P.encode(docs.where("doc_id = 3"), PATH, begin=False, end=False).first()
    assert np.frombuffer(bare["ids"], "<u4").tolist() == library.encode(odd[3])
    assert P.encode(docs.where("false"), PATH).count() == 0
    twice = make_docs([(None, "same")] * 2)
    assert [r["doc_id"] for r in P.encode(twice, PATH).collect()] == [None, None]
    assert spark.range(1).select(P.decode(F.lit(None).cast("binary"), PATH).alias("t")).first()["t"] is None


def test_query(spark, tmp_path, library, make_docs, odd):
    from tessera.llm.queries import QUERIES

    make_docs(odd).write.parquet(str(tmp_path / "documents.parquet"))
    for r in QUERIES["op11_pieces"](spark, str(tmp_path)).collect():
        ids = library.encode(odd[r["doc_id"]] or "", add_bos=True, add_eos=True)
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
