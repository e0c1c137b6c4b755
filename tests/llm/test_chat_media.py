import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import chat, media

MARKS = chat.INSTRUCTION_TEMPLATE.markers()
SCHEMA = "conv_id long, turn long, role string, text string, segments string, valid int"


def turns(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def test_round_trip(spark):
    nasty = ["\\", "\\a\\\\b", "".join(MARKS), "\\</s>", "</s", "[INST", "", None, "ünï\n\n", "\\\\</s>\\", "a\\" * 5]
    rows = [(1, i, ["user", "assistant", "system", "tool</s>", None, ""][i % 6], t) for i, t in enumerate(nasty)]
    out = chat.format_chat(turns(spark, rows)).select("*", chat.parse(F.col("formatted")).alias("p"), chat.loss_text(F.col("segments")).alias("loss")).first()
    assert [(t.role, t.text) for t in out.p] == [(r or "", t or "") for _, _, r, t in rows]
    assert out.loss == "".join(t or "" for _, _, r, t in rows if r == "assistant")
    assert out.formatted == "".join(s.text for s in out.segments) and not out.valid and out.state == "error"


def test_machine(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a")]
    rows += [(2, 0, "user", "u"), (2, 1, "user", "u")] + [(3, 0, "user", "u")] + [(4, 1, "assistant", "a"), (4, 0, "user", "u")]
    rows += [(None, None, "user", "u"), (None, 1, "assistant", "a"), (5, 0, "user", "b"), (5, 0, "user", "a")]
    out = {r.conv_id: r for r in chat.format_chat(turns(spark, rows)).collect()}
    assert {k: r.valid for k, r in out.items()} == {1: True, 2: False, 3: False, 4: True, None: True, 5: False}
    assert out[1].formatted == "<<SYS>>s<</SYS>>[INST]u[/INST]<s>a</s>" and out[3].state == "user"
    assert out[5].formatted == "[INST]a[/INST][INST]b[/INST]" and out[5].n_turns == 2
    assert chat.format_chat(turns(spark, [])).count() == 0


def test_templates_are_checked():
    with pytest.raises(ValueError):
        chat.Template({"user": chat.Role("<a", "<ab")})
    with pytest.raises(ValueError):
        chat.Template({"user": chat.Role("", "x")})


@pytest.mark.parametrize("kind", range(5))
@pytest.mark.parametrize("shape", [(1, 1, 1), (7, 5, 1), (9, 64, 1), (6, 3, 3), (4, 5, 4), (3, 3, 2)])
def test_png_round_trip(kind, shape):
    samples = np.random.default_rng(kind).integers(0, 256, shape, np.uint8)
    assert (media.decode_png(media.encode_png(samples, kind)) == samples).all()


def test_damage_is_found():
    good = media.encode_png(np.arange(64, dtype=np.uint8).reshape(1, 64))
    for bad in (b"", good[:-1], good[:20], good[:40] + bytes([good[40] ^ 1]) + good[41:], b"x" + good[1:]):
        with pytest.raises(media.DamagedImage):
            media.decode_png(bad)


def test_hash_is_perceptual():
    y, x = np.mgrid[0:64, 0:64]
    smooth = (127 + 100 * np.sin(x / 9) * np.cos(y / 7)).astype(np.uint8)[:, :, None]
    noisy = np.clip(smooth.astype(int) + np.random.default_rng(0).integers(-3, 4, smooth.shape), 0, 255).astype(np.uint8)
    bits = lambda s: int(media.dct_hash(s), 16)
    assert (bits(smooth) ^ bits(noisy)).bit_count() <= 6
    assert (bits(smooth) ^ bits(np.rot90(smooth))).bit_count() > 10


def test_texts_as_media(make_docs, odd):
    out = media.media_features(media.text_to_media(make_docs(odd))).collect()
    assert len(out) == len(odd)
    for r in out:
        body = (odd[r.doc_id] or "").encode()
        payload = body + bytes(-len(body) % 64 or (0 if body else 64))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(body), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-64:]) and r.fault is None and len(r.feature) == 16
    assert len({(r.payload_sha256, r.feature, bytes(r.media)) for r in out if odd[r.doc_id] == "word"}) == 1
    assert media.media_features(media.text_to_media(make_docs([]))).count() == 0


def test_null_media(spark):
    row = media.media_features(spark.createDataFrame([(1, 0, None)], "doc_id long, n_bytes long, media binary")).first()
    assert row.fault and row.payload_sha256 is None


def plain_hash(samples):
    """The hash by loops: means of 32 x 32 cells, cosine sums, signs against the median."""
    grey = samples.astype(float).mean(2)

    def cell_weights(n, k):
        lo, hi = k * n / 32, (k + 1) * n / 32
        return [max(0.0, min(hi, i + 1) - max(lo, i)) / (n / 32) for i in range(n)]

    h, w = grey.shape
    down, across = np.array([cell_weights(h, k) for k in range(32)]), np.array([cell_weights(w, k) for k in range(32)])
    small = down @ grey @ across.T
    low = []
    for u in range(8):
        for v in range(8):
            low.append(sum(small[y, x] * np.cos(np.pi / 32 * (y + 0.5) * u) * np.cos(np.pi / 32 * (x + 0.5) * v) for y in range(32) for x in range(32)))
    bits = np.round(low, 6) > np.round(np.median(low[1:]), 6)
    return "".join(f"{int(''.join('1' if b else '0' for b in bits[k : k + 4]), 2):x}" for k in range(0, 64, 4))


@pytest.mark.parametrize("shape", [(1, 64, 1), (33, 64, 1), (64, 40, 1), (65, 64, 1), (100, 70, 3), (997, 64, 1), (2048, 33, 2)])
def test_hash_against_plain_sums(shape):
    samples = np.random.default_rng(shape[0]).integers(0, 256, shape, np.uint8)
    assert media.dct_hash(samples) == plain_hash(samples)


def test_each_row_its_own_filter():
    """Rows of all five filters in one image, as other writers mix them."""
    rng = np.random.default_rng(5)
    samples = rng.integers(0, 256, (40, 21), np.uint8)
    kinds = rng.integers(0, 5, 40)
    body = np.empty((40, 22), np.uint8)
    for y, kind in enumerate(kinds):
        body[y, 0], body[y, 1:] = kind, media.filter_rows(samples, 3, int(kind))[y]
    assert (media.unfilter(body, 3) == samples).all()
    body[3, 0] = 9
    with pytest.raises(media.DamagedImage):
        media.unfilter(body, 3)


def test_rows_take_the_smaller_filter():
    """The query's images have rows of both filters, and they come back whole."""
    ramp, noise = np.arange(64, dtype=np.uint8) * 3, np.tile([0, 255], 32).astype(np.uint8)
    samples = np.vstack([ramp, noise] * 5)
    image = media.encode_png(samples, None)
    at = image.index(b"IDAT")
    kinds = np.frombuffer(zlib.decompress(image[at + 4 : at + 4 + int.from_bytes(image[at - 4 : at], "big")]), np.uint8).reshape(10, 65)[:, 0]
    assert kinds.tolist() == [1, 0] * 5
    assert (media.decode_png(image)[:, :, 0] == samples).all()


def test_inflating_stops_at_the_promised_size():
    """Data that inflate to more, or less, than the header says are damaged, and aren't inflated whole."""
    head = media._chunk(b"IHDR", bytes.fromhex("0000004000000002" + "0800000000"))
    for size in (0, 129, 131, 200_000_000):
        image = media.SIGNATURE + head + media._chunk(b"IDAT", zlib.compress(bytes(size), 9)) + media._chunk(b"IEND", b"")
        with pytest.raises(media.DamagedImage):
            media.decode_png(image)
    parts = zlib.compress(bytes(130))
    split = b"".join(media._chunk(b"IDAT", parts[k : k + 3]) for k in range(0, len(parts), 3))
    assert media.decode_png(media.SIGNATURE + head + split + media._chunk(b"IEND", b"")).shape == (2, 64, 1)


def test_very_long_texts_and_repeated_rows(spark):
    rows = [(1, "long text " * 400_000), (1, "x"), (1, "x"), (None, None)]
    out = media.media_features(media.text_to_media(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    assert sorted(r.n_bytes for r in out) == [0, 1, 1, 4_000_000] and all(r.fault is None for r in out)
    assert next(r.payload_sha256 for r in out if r.n_bytes == 4_000_000) == hashlib.sha256(b"long text " * 400_000).hexdigest()


def test_a_conversation_of_very_many_turns(spark):
    """Nulls in any column, a very long text, thousands of turns, repeated rows."""
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"turn {i}") for i in range(4000)]
    rows += [(2, 0, "user", "x" * 1_000_000), (2, 1, "assistant", "[INST]" * 50_000), (3, None, None, None), (None, 0, "user", "a"), (4, 0, "user", "a"), (4, 0, "user", "a")]
    out = {r.conv_id: r for r in chat.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).withColumn("parsed", chat.parse(F.col("formatted"))).collect()}
    assert [t.text for t in out[1].parsed] == [f"turn {i}" for i in range(4000)]
    assert [t.text for t in out[2].parsed] == ["x" * 1_000_000, "[INST]" * 50_000]
    assert set(out) == {1, 2, 3, 4, None} and len(out[4].parsed) == 2
