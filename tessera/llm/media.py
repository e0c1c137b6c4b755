"""Binary media columns: PNG images written and read chunk by chunk.

``encode_png`` and ``decode_png`` handle 8-bit grey, grey with alpha, RGB and RGBA images without
interlacing: signature, chunks with CRC-32, zlib data, and the five row filters in numpy. ``dct_hash``
is a perceptual hash: the image shrunk to 32 x 32, its two-dimensional cosine transform, and the signs
of the 64 lowest frequencies against their median.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import column, hold, small_batches

# fixed values of the PNG format
SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}
WIDTH = 64


class DamagedImage(ValueError):
    pass


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def filter_rows(rows: np.ndarray, bpp: int, kind: int) -> np.ndarray:
    """rows (height, bytes) after one filter for all rows."""
    a = np.zeros_like(rows)
    a[:, bpp:] = rows[:, :-bpp]
    b = np.zeros_like(rows)
    b[1:] = rows[:-1]
    if kind == 0:
        return rows
    if kind == 1:
        return rows - a
    if kind == 2:
        return rows - b
    if kind == 3:
        return rows - ((a.astype(np.int16) + b) // 2).astype(np.uint8)
    c = np.zeros_like(rows)
    c[1:, bpp:] = rows[:-1, :-bpp]
    return rows - paeth(a, b, c)


def paeth(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    left, up, corner = a.astype(np.int16), b.astype(np.int16), c.astype(np.int16)
    p = left + up - corner
    pa_, pb, pc = np.abs(p - left), np.abs(p - up), np.abs(p - corner)
    return np.where((pa_ <= pb) & (pa_ <= pc), a, np.where(pb <= pc, b, c)).astype(np.uint8)


def unfilter(data: np.ndarray, bpp: int) -> np.ndarray:
    """Rows of samples from rows that begin with their filter's number; runs of rows with one filter at once."""
    kinds, rows = data[:, 0], data[:, 1:].copy()
    if not kinds.any():
        return rows
    if kinds.max() > 4:
        raise DamagedImage("unknown row filter")
    height, width = rows.shape
    # rows of filter 1 depend on no other row
    left = kinds == 1
    if left.any():
        rows[left] = np.add.accumulate(rows[left].reshape(-1, width // bpp, bpp), axis=1, dtype=np.uint8).reshape(-1, width)
    starts = np.flatnonzero(np.r_[True, kinds[1:] != kinds[:-1]])
    for lo, hi in zip(starts, np.r_[starts[1:], height], strict=True):
        if kinds[lo] < 2:
            continue
        above = rows[lo - 1] if lo else np.zeros(width, np.uint8)
        if kinds[lo] == 2:
            rows[lo:hi] = np.add.accumulate(np.vstack([above[None], rows[lo:hi]]), axis=0, dtype=np.uint8)[1:]
        else:
            rows[lo:hi] = _unfilter_diagonals(rows[lo:hi], above, bpp, kinds[lo] == 4)
    return rows


def _unfilter_diagonals(rows: np.ndarray, above: np.ndarray, bpp: int, is_paeth: bool) -> np.ndarray:
    """A run of rows filtered by average or Paeth: pixels of one diagonal depend only on the two diagonals before."""
    height, pixels = len(rows), rows.shape[1] // bpp
    full = np.zeros((height + 1, pixels + 1, bpp), np.uint8)
    full[0, 1:] = above.reshape(pixels, bpp)
    given = rows.reshape(height, pixels, bpp)
    for d in range(height + pixels - 1):
        y = np.arange(max(0, d - pixels + 1), min(height, d + 1))
        x = d - y
        a, b = full[y + 1, x], full[y, x + 1]
        guess = paeth(a, b, full[y, x]) if is_paeth else ((a.astype(np.int16) + b) // 2).astype(np.uint8)
        full[y + 1, x + 1] = given[y, x] + guess
    return full[1:, 1:].reshape(height, -1)


def encode_png(samples: np.ndarray, filter_kind: int | None = 0, level: int = 1) -> bytes:
    """samples: (height, width) or (height, width, channels), unsigned bytes.

    ``filter_kind``: one filter for all rows, or None: for each row that of 0 and 1 with the smaller sum of
    absolute differences, as the format advises.
    """
    if samples.ndim == 2:
        samples = samples[:, :, None]
    height, width, channels = samples.shape
    color = next(k for k, v in CHANNELS.items() if v == channels)
    plain = samples.reshape(height, width * channels)
    body = np.empty((height, width * channels + 1), np.uint8)
    if filter_kind is None:
        moved = filter_rows(plain, channels, 1)
        size = lambda rows: np.minimum(rows, 0 - rows).sum(1, dtype=np.int64)
        better = size(moved) < size(plain)
        body[:, 0], body[:, 1:] = better, np.where(better[:, None], moved, plain)
    else:
        body[:, 0], body[:, 1:] = filter_kind, filter_rows(plain, channels, filter_kind)
    head = struct.pack(">IIBBBBB", width, height, 8, color, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(body.data, level)) + _chunk(b"IEND", b"")


def decode_png(media: bytes) -> np.ndarray:
    """(height, width, channels); raises DamagedImage where a checksum or a length is wrong."""
    if media[:8] != SIGNATURE:
        raise DamagedImage("not a PNG")
    at, head, data, ended = 8, None, [], False
    while at < len(media) and not ended:
        if at + 12 > len(media):
            raise DamagedImage("cut short")
        (size,) = struct.unpack_from(">I", media, at)
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + size]
        if at + 12 + size > len(media) or zlib.crc32(kind + body) != struct.unpack_from(">I", media, at + 8 + size)[0]:
            raise DamagedImage("checksum of a chunk")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        elif kind == b"IEND":
            ended = True
        elif not kind[0] & 0x20:
            raise DamagedImage("unknown critical chunk")
        at += 12 + size
    if head is None or not ended:
        raise DamagedImage("no header or no end")
    width, height, depth, color, _, _, interlace = head
    if depth != 8 or color not in CHANNELS or interlace:
        raise DamagedImage("only 8-bit images without palette and interlacing")
    bpp = CHANNELS[color]
    size = height * (1 + width * bpp)
    inflater, raw = zlib.decompressobj(), bytearray()
    try:
        for part in data:  # never more than the header promises
            raw += inflater.decompress(part, size + 1 - len(raw))
            if len(raw) > size:
                raise DamagedImage("number of samples")
        raw += inflater.decompress(inflater.unconsumed_tail, size + 1 - len(raw))
    except zlib.error as e:
        raise DamagedImage("zlib data") from e
    if len(raw) != size or not inflater.eof:
        raise DamagedImage("number of samples")
    return unfilter(np.frombuffer(raw, np.uint8).reshape(height, -1), bpp).reshape(height, width, bpp)


def _cosines(n: int, k: int) -> np.ndarray:
    return np.cos(np.pi / n * (np.arange(n) + 0.5)[None, :] * np.arange(k)[:, None])


_DCT = _cosines(32, 8)


def _band_means(samples: np.ndarray) -> np.ndarray:
    """32 rows: the means of 32 equal bands of rows, those that an edge cuts counted in part."""
    n = len(samples)
    edges = np.linspace(0, n, 33)
    if n <= 64:
        at = np.arange(n)[None, :]
        share = np.clip(np.minimum(edges[1:, None], at + 1) - np.maximum(edges[:-1, None], at), 0, None)
        return share @ samples / (n / 32)
    first, last = np.ceil(edges[:-1]).astype(int), np.floor(edges[1:]).astype(int)
    out = np.add.reduceat(samples, np.column_stack([first, np.minimum(last, n - 1)]).ravel(), axis=0, dtype=np.float64)[::2]
    out[-1] += samples[n - 1] if last[-1] == n else 0  # reduceat's end is left out
    out += (first - edges[:-1])[:, None] * samples[np.maximum(first - 1, 0)] + (edges[1:] - last)[:, None] * samples[np.minimum(last, n - 1)]
    return out / (n / 32)


def dct_hash(samples: np.ndarray) -> str:
    """16 hexadecimal digits. Of a tall image only 32 rows of means are held beside it."""
    height, width, channels = samples.shape
    rows = _band_means(samples.reshape(height, width * channels)).reshape(32, width, channels).mean(2)
    low = (_DCT @ _band_means(rows.T).T @ _DCT.T).ravel()
    bits = np.round(low, 6) > np.round(np.median(low[1:]), 6)
    return np.packbits(bits).tobytes().hex()


def text_payload(text: str | None) -> tuple[int, bytes]:
    body = (text or "").encode()
    return len(body), body + bytes(-len(body) % WIDTH or (0 if body else WIDTH))


def text_to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each text's UTF-8, padded with 0 to rows of 64 samples, as a grey PNG.

    Null text counts as empty and gives one row of zeros. Repeated rows stay repeated; equal texts have
    equal media. A very long text is one image, whose bytes are held a few times over. Other columns aren't read.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("media")
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                sizes, media = [], []
                for text in column(part, 1):
                    n, payload = text_payload(text)
                    sizes.append(n)
                    media.append(encode_png(np.frombuffer(payload, np.uint8).reshape(-1, WIDTH), None))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=["id", "n_bytes", "media"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_bytes long, media binary").withColumnRenamed("id", id_col)


def media_features(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """Decode each image and add payload_bytes, payload_sha256, tail_crc32 and feature; media and n_bytes stay.

    A damaged or null image gets null in these columns and its reason in ``fault``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                size, sha, crc, feature, fault = [], [], [], [], []
                for image in column(part, 2):
                    try:
                        samples = decode_png(image or b"")
                    except DamagedImage as e:
                        size.append(None), sha.append(None), crc.append(None), feature.append(None), fault.append(str(e))
                        continue
                    payload = samples.tobytes()
                    size.append(len(payload)), sha.append(hashlib.sha256(payload).hexdigest()), crc.append(zlib.crc32(payload[-64:]))
                    feature.append(dct_hash(samples)), fault.append(None)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(size, pa.int64()), pa.array(sha, pa.string()), pa.array(crc, pa.int64()), pa.array(feature, pa.string()), pa.array(fault, pa.string())],
                    names=["id", "n_bytes", "media", "payload_bytes", "payload_sha256", "tail_crc32", "feature", "fault"],
                )

    rows = media.select(F.col(id_col).alias("id"), "n_bytes", F.col(media_col).alias("media"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"id {kind}, n_bytes long, media binary, payload_bytes long, payload_sha256 string, tail_crc32 long, feature string, fault string")
    return out.withColumnRenamed("id", id_col)
