"""Media columns: Netpbm and BMP decoded to numpy arrays, resized by areas over integral images,
written as NPY tiles, and summed up by difference hashes."""

from __future__ import annotations

import hashlib
import io
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.llm.shared import map_texts, ship
from ravelin.llm.text import column

WIDTH = 64
ROW = WIDTH * 3


def encode_ppm(pixels: np.ndarray) -> bytes:
    """Binary Netpbm of (h, w, 3) or (h, w) 8-bit samples."""
    kind = b"P6" if pixels.ndim == 3 else b"P5"
    return kind + b"\n%d %d\n255\n" % (pixels.shape[1], pixels.shape[0]) + pixels.astype(np.uint8).tobytes()


def encode_bmp(pixels: np.ndarray) -> bytes:
    """A 24-bit BMP of (h, w, 3) samples: rows from the bottom, blue first, padded to 4 bytes."""
    h, w, _ = pixels.shape
    rows = np.zeros((h, -(-w * 3 // 4) * 4), np.uint8)
    rows[:, : w * 3] = pixels[::-1, :, ::-1].reshape(h, w * 3)
    i = lambda x, n=4: int(x).to_bytes(n, "little")
    return b"BM" + i(54 + rows.size) + i(0) + i(54) + i(40) + i(w) + i(h) + i(1, 2) + i(24, 2) + i(0) + i(rows.size) + i(2835) * 2 + i(0) * 2 + rows.tobytes()


def _netpbm(data: bytes) -> np.ndarray:
    kind, need, at, found = data[:2], 2 if data[:2] in (b"P1", b"P4") else 3, 2, []
    while len(found) < need:
        m = re.compile(rb"(?:\s|#[^\n]*\n)*(\d+)").match(data, at)
        if not m:
            raise ValueError("a Netpbm header ends early")
        found.append(int(m[1]))
        at = m.end()
    w, h = found[:2]
    most = found[2] if need == 3 else 1
    if most > 255:
        raise ValueError("samples of more than 8 bits")
    depth = 3 if kind in (b"P3", b"P6") else 1
    if kind in (b"P1", b"P2", b"P3"):
        body = re.sub(rb"#[^\n]*", b"", data[at:])
        x = np.array([c - 48 for c in body if c in b"01"] if kind == b"P1" else [int(v) for v in body.split()], np.int64)[: w * h * depth]
    elif kind == b"P4":
        x = np.unpackbits(np.frombuffer(data, np.uint8, h * (-(-w // 8)), at + 1).reshape(h, -1), axis=1)[:, :w].ravel()
    else:
        x = np.frombuffer(data, np.uint8, w * h * depth, at + 1)
    if len(x) != w * h * depth:
        raise ValueError("a Netpbm body ends early")
    if kind in (b"P1", b"P4"):
        x = (1 - x) * 255
    elif most != 255:
        x = (x.astype(np.int64) * 255 + most // 2) // max(most, 1)
    x = x.astype(np.uint8)
    return x.reshape(h, w, 3) if depth == 3 else x.reshape(h, w)


def _bmp(data: bytes) -> np.ndarray:
    u = lambda at, n=4, signed=False: int.from_bytes(data[at : at + n], "little", signed=signed)
    at, head, w, h, bits, packed = u(10), u(14), u(18, signed=True), u(22, signed=True), u(28, 2), u(30)
    if packed or bits not in (8, 24, 32) or w <= 0:
        raise ValueError("a BMP that is packed, or of other than 8, 24 or 32 bits")
    size = -(-w * bits // 32) * 4
    rows = np.frombuffer(data, np.uint8, abs(h) * size, at).reshape(abs(h), size)
    rows = rows[::-1] if h > 0 else rows
    if bits == 8:
        colours = np.frombuffer(data, np.uint8, 4 * (u(46) or 256), 14 + head).reshape(-1, 4)
        return colours[rows[:, :w]][:, :, 2::-1]
    return rows[:, : w * bits // 8].reshape(abs(h), w, bits // 8)[:, :, 2::-1]


def decode(data: bytes) -> np.ndarray:
    """The samples of a Netpbm (P1 to P6) or BMP file: (h, w) or (h, w, 3), 8 bits each. Anything else: ValueError."""
    if re.match(rb"P[1-6]\s|P[1-6]#", data[:3]):
        return _netpbm(data)
    if data[:2] == b"BM":
        return _bmp(data)
    raise ValueError("neither Netpbm nor BMP")


def resize(gray: np.ndarray, h: int, w: int) -> np.ndarray:
    """Means over h x w equal areas, whose edges may cut pixels, from the integral image."""
    total = np.zeros((gray.shape[0] + 1, gray.shape[1] + 1))
    total[1:, 1:] = gray.cumsum(0, dtype=np.float64).cumsum(1)

    def edges(n: int, k: int):
        x = np.linspace(0, n, k + 1)
        i = np.minimum(x.astype(np.int64), n - 1)
        return i, x - i

    (y, fy), (x, fx) = edges(gray.shape[0], h), edges(gray.shape[1], w)
    rows = total[y] * (1 - fy)[:, None] + total[y + 1] * fy[:, None]
    at = rows[:, x] * (1 - fx) + rows[:, x + 1] * fx
    area = (gray.shape[0] / h) * (gray.shape[1] / w)
    return (at[1:, 1:] - at[:-1, 1:] - at[1:, :-1] + at[:-1, :-1]) / area


def luma(pixels: np.ndarray) -> np.ndarray:
    """Integer luma of (h, w, 3), or (h, w) as it is."""
    return (pixels.astype(np.int32) @ np.array([299, 587, 114], np.int32)) // 1000 if pixels.ndim == 3 else pixels


def difference_hash(gray: np.ndarray) -> str:
    """16 hex digits: whether each of 8 x 8 areas is darker than the one to its right."""
    a = np.round(resize(gray, 8, 9) * 4096)
    return np.packbits(a[:, :-1] < a[:, 1:]).tobytes().hex()


def npy(a: np.ndarray) -> bytes:
    """The array as an NPY file."""
    f = io.BytesIO()
    np.save(f, a)
    return f.getvalue()


def tiles(gray: np.ndarray, side: int = 8) -> bytes:
    """An NPY file of the picture resized to side x side 8-bit samples."""
    return npy(np.clip(np.floor(resize(gray, side, side) + 0.5), 0, 255).astype(np.uint8))


def store(docs: DataFrame, kind: str = "both") -> DataFrame:
    """doc_id, n_bytes, media: every whole text of docs as a picture of WIDTH columns of three 8-bit samples.

    The payload is the text's UTF-8 (a null text: none) with blanks up to a positive multiple of 192 bytes,
    that is one row of pixels. kind: ppm, bmp, or both, each for half of the payloads by their CRC. Equal texts give equal bytes;
    repeated rows and null ids stay; an empty table gives an empty result; other columns are not read.
    """
    kinds = {"ppm": [encode_ppm], "bmp": [encode_bmp], "both": [encode_ppm, encode_bmp]}[kind]

    def run(part: pa.RecordBatch) -> dict:
        size, media = [], []
        for t in column(part):
            b = t.as_buffer().to_pybytes() if len(t.as_py()) else b""
            size.append(len(b))
            b += b" " * ((-len(b)) % ROW if b else ROW)
            media.append(kinds[zlib.crc32(b) % len(kinds)](np.frombuffer(b, np.uint8).reshape(-1, WIDTH, 3)))
        return {"doc_id": part.column(0), "n_bytes": size, "media": pa.array(media, pa.binary())}

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_texts(src, ["doc_id", "text"], run, "doc_id long, n_bytes long, media binary")


def describe(stored: DataFrame) -> DataFrame:
    """Read the media of store() back: payload digests, the stored form's digest, a feature (the difference hash) and the NPY tile."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = {k: [] for k in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tile")}
                for m in part.column(2):
                    data = m.as_py()
                    pixels = decode(data)
                    payload, gray = pixels.tobytes(), luma(pixels)
                    tile = tiles(gray)
                    row = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), difference_hash(gray), tile)
                    for k, v in zip(out, row, strict=True):
                        out[k].append(v)
                yield pa.RecordBatch.from_pydict({"doc_id": part.column(0), "n_bytes": part.column(1)} | out)

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile binary"
    ship(stored.sparkSession)
    return stored.mapInArrow(run, schema)
