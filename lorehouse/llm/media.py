"""Media columns: Netpbm and BMP images as numpy arrays, area-resized, stored as NPY tiles with difference hashes."""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, in_arrow, plus

WIDTH = 64
TILE = 32


def encode_pgm(samples: np.ndarray) -> bytes:
    """A grey image of 8-bit samples as binary Netpbm."""
    return b"P5\n%d %d\n255\n" % (samples.shape[1], samples.shape[0]) + samples.tobytes()


def encode_bmp(samples: np.ndarray) -> bytes:
    """A grey image of 8-bit samples as an uncompressed BMP with a grey palette, rows bottom up."""
    h, w = samples.shape
    pad = -w % 4
    body = np.zeros((h, w + pad), np.uint8)
    body[:, :w] = samples[::-1]
    start = 14 + 40 + 1024
    palette = np.repeat(np.arange(256, dtype=np.uint8), 4).reshape(256, 4)
    palette[:, 3] = 0
    head = struct.pack("<2sIHHI", b"BM", start + body.size, 0, 0, start) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 8, 0, body.size, 2835, 2835, 256, 256)
    return head + palette.tobytes() + body.tobytes()


_TOKEN = re.compile(rb"(?:\s|#[^\n]*\n)*([^\s#]+)")


def _samples(raw: bytes, kind: np.dtype | type, n: int, start: int) -> np.ndarray:
    """n samples from raw; ValueError if it holds fewer."""
    if start < 0 or n < 0 or start + n * np.dtype(kind).itemsize > len(raw):
        raise ValueError("image data cut short")
    return np.frombuffer(raw, kind, n, start)


def decode_netpbm(raw: bytes) -> np.ndarray:
    """P1 to P6 as (height, width) or (height, width, 3), uint8 or, for a maximum over 255, uint16.

    ValueError if malformed, which a sample over the maximum is too.
    """
    kind, at, head = raw[:2], 2, []
    for _ in range(2 if kind in (b"P1", b"P4") else 3):
        if not (m := _TOKEN.match(raw, at)) or not m[1].isdigit() or len(m[1]) > 9:
            raise ValueError("Netpbm header")
        head.append(int(m[1]))
        at = m.end()
    w, h, most = head[0], head[1], head[2] if len(head) > 2 else 1
    depth = 3 if kind in (b"P3", b"P6") else 1
    if not (w > 0 and h > 0 and 0 < most < 65536):
        raise ValueError("Netpbm size")
    wide, n = np.dtype(np.uint8) if most < 256 else np.dtype(">u2"), w * h * depth
    if kind == b"P4":
        rows = _samples(raw, np.uint8, h * (-(-w // 8)), at + 1).reshape(h, -1)
        out = (1 - np.unpackbits(rows, axis=1)[:, :w]) * np.uint8(255)
    elif kind == b"P1":
        bits = _samples(re.sub(rb"#[^\n]*|\s", b"", raw[at:]), np.uint8, n, 0)
        if not np.isin(bits, (48, 49)).all():
            raise ValueError("Netpbm bits")
        out = (ord("1") - bits) * np.uint8(255)
    elif kind in (b"P2", b"P3"):
        found = re.sub(rb"#[^\n]*", b"", raw[at:]).split()[:n]
        if len(found) < n or not all(x.isdigit() and len(x) < 10 for x in found):
            raise ValueError("Netpbm samples")
        values = np.array(found, np.int64)
        if values.max() > most:
            raise ValueError("Netpbm samples")
        out = values.astype(wide.newbyteorder("="))
    elif kind in (b"P5", b"P6"):
        out = _samples(raw, wide, n, at + 1).astype(wide.newbyteorder("="))
        if out.max() > most:
            raise ValueError("Netpbm samples")
    else:
        raise ValueError("not Netpbm")
    return out.reshape((h, w) if depth == 1 else (h, w, 3))


def decode_bmp(raw: bytes) -> np.ndarray:
    """Uncompressed BMP of 1, 4, 8, 24 or 32 bits a pixel; grey palettes give (height, width), all else RGB. ValueError if malformed."""
    if raw[:2] != b"BM" or len(raw) < 54:
        raise ValueError("not BMP")
    (start,) = struct.unpack_from("<I", raw, 10)
    size, w, h, _, bits, packing = struct.unpack_from("<IiiHHI", raw, 14)
    if packing or w <= 0 or not h or bits not in (1, 4, 8, 24, 32):
        raise ValueError("BMP form")
    line = (w * bits + 31) // 32 * 4
    rows = _samples(raw, np.uint8, line * abs(h), start).reshape(abs(h), line)
    if h > 0:
        rows = rows[::-1]
    if bits >= 24:
        return rows[:, : w * bits // 8].reshape(abs(h), w, bits // 8)[:, :, 2::-1].copy()
    if bits == 8:
        index = rows[:, :w]
    elif bits == 4:
        index = np.stack([rows >> 4, rows & 15], axis=2).reshape(abs(h), -1)[:, :w]
    else:
        index = np.unpackbits(rows, axis=1)[:, :w]
    (used,) = struct.unpack_from("<I", raw, 46)
    table = np.zeros((256, 4), np.uint8)
    colours = _samples(raw, np.uint8, min(used or 1 << bits, (start - 14 - size) // 4, 256) * 4, 14 + size).reshape(-1, 4)
    table[: len(colours)] = colours
    rgb = table[:, 2::-1]
    return rgb[:, 0][index] if (rgb[:, :1] == rgb).all() else rgb[index]


def decode(raw: bytes) -> np.ndarray:
    return decode_bmp(raw) if raw[:2] == b"BM" else decode_netpbm(raw)


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means over the areas of a height x width grid, with fractional borders, from the image's integral."""
    total = np.zeros((image.shape[0] + 1, image.shape[1] + 1, *image.shape[2:]))
    np.cumsum(image, axis=0, out=total[1:, 1:])
    np.cumsum(total[1:, 1:], axis=1, out=total[1:, 1:])

    def at(t: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        low = np.minimum(cuts.astype(np.int64), len(t) - 2)
        part = (cuts - low).reshape(-1, *[1] * (t.ndim - 1))
        return t[low] * (1 - part) + t[low + 1] * part

    rows = at(total, np.arange(height + 1) * (image.shape[0] / height))
    cells = at(rows.swapaxes(0, 1), np.arange(width + 1) * (image.shape[1] / width)).swapaxes(0, 1)
    sums = cells[1:, 1:] - cells[:-1, 1:] - cells[1:, :-1] + cells[:-1, :-1]
    return sums / (image.shape[0] / height * image.shape[1] / width)


def difference_hash(image: np.ndarray) -> str:
    """64 bits as 16 hex digits: whether each of 8 x 9 area means is over its right neighbour's."""
    grey = image.mean(axis=2) if image.ndim == 3 else image
    small = np.round(area_resize(grey, 8, 9), 6)
    return np.packbits(small[:, :-1] > small[:, 1:]).tobytes().hex()


def to_npy(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array(out, np.ascontiguousarray(array), version=(1, 0), allow_pickle=False)
    return out.getvalue()


def from_npy(raw: bytes) -> np.ndarray:
    return np.lib.format.read_array(io.BytesIO(raw), allow_pickle=False)


def payload(text: str | None) -> tuple[int, bytes]:
    """UTF-8 length, and the bytes with zeros up to a positive multiple of WIDTH."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + bytes(-len(raw) % WIDTH or (0 if raw else WIDTH))


def text_image(raw: bytes) -> bytes:
    """A payload as an image of 8-bit samples, WIDTH wide: PGM for an odd number of rows, BMP for an even one."""
    samples = np.frombuffer(raw, np.uint8).reshape(-1, WIDTH)
    return encode_pgm(samples) if len(samples) % 2 else encode_bmp(samples)


def media_columns(raw: bytes | None, tile: int = TILE) -> tuple[bytes | None, bytes | None, str | None]:
    """The samples of an image as NPY, lossless; its tile x tile area means as uint8 in NPY; its difference hash. Nulls if malformed."""
    try:
        image = decode(raw or b"")
    except (ValueError, struct.error):
        return None, None, None
    small = area_resize(image, tile, tile)
    if image.dtype == np.uint16:
        small = small / 257
    return to_npy(image), to_npy(np.clip(np.rint(small), 0, 255).astype(np.uint8)), difference_hash(image)


def decode_media(df: DataFrame, media_col: str = "media", tile: int = TILE) -> DataFrame:
    """Decode a binary column of Netpbm or BMP images.

    Replaces the column by npy binary (the samples, lossless), tile binary (tile x tile area means as uint8, in NPY)
    and dhash string. Null, empty or malformed media give nulls; repeated rows each give theirs; an empty table gives
    an empty result. Columns of df with these names are replaced.
    """
    source = df.drop("npy", "tile", "dhash")
    names = [c for c in source.columns if c != media_col]
    source = source.select(*names, media_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, min(batch.num_rows, 1 + int(batch.num_rows * 4_000_000 / max(1, batch.column(len(names)).nbytes))))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                out = [media_columns(x, tile) for x in part.column(len(names)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *(pa.array([x[i] for x in out], t) for i, t in enumerate((pa.binary(), pa.binary(), pa.string())))], [*names, "npy", "tile", "dhash"])

    return in_arrow(source, run, plus(source.select(*names), npy="binary", tile="binary", dhash="string"))


_DIGEST = {"n_bytes": "long", "payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media_bytes": "long", "media_sha256": "string", "tile_bytes": "long", "tile_sha256": "string", "feature": "string"}


def text_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tile: int = TILE) -> DataFrame:
    """What each text gives as media: the text becomes an image file, which is decoded into media columns, and these are read back.

    Returns the id and n_bytes (of the text), payload_bytes, payload_sha256 and tail_crc32 (of the samples that the NPY
    holds), media_bytes and media_sha256 (of that NPY), tile_bytes and tile_sha256 (of the tile's NPY), feature (the
    difference hash). Media stay within the task that makes them. A null text counts as empty and gives one row of
    zeros; equal texts give equal media; repeated rows each give theirs; an empty table gives an empty result.
    """
    source = df.select(id_col, F.col(text_col).alias("_text"))
    kinds = {"long": pa.int64(), "string": pa.string()}

    def one(text: str | None) -> tuple:
        n, raw = payload(text)
        npy, small, feature = media_columns(text_image(raw), tile)
        back = from_npy(npy).tobytes()
        sha = lambda x: hashlib.sha256(x).hexdigest()
        return n, len(back), sha(back), zlib.crc32(back[-WIDTH:]), len(npy), sha(npy), len(small), sha(small), feature

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "_text"):
            rows = [one(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], kinds[k]) for i, k in enumerate(_DIGEST.values()))], [id_col, *_DIGEST])

    return in_arrow(source, run, plus(source.select(id_col), **_DIGEST))
