"""Media columns: Netpbm and BMP images in binary columns, decoded to numpy arrays.

Images are resized by area with integral images and stored as NPY tiles beside
difference hashes.  Every codec here is lossless.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import bounded_batches, stored

#: Bytes of one row of the images that carry texts: 64 RGB pixels.
ROW_BYTES = 192


def encode_ppm(image: np.ndarray) -> bytes:
    """Binary Netpbm: P6 for (h, w, 3), P5 for (h, w), 8 bits a sample."""
    kind = b"P6" if image.ndim == 3 else b"P5"
    return kind + b"\n%d %d\n255\n" % (image.shape[1], image.shape[0]) + np.ascontiguousarray(image, np.uint8).tobytes()


def encode_bmp(image: np.ndarray) -> bytes:
    """Uncompressed 24-bit BMP: bottom row first, blue first, rows padded to four bytes."""
    h, w, _ = image.shape
    pad = -w * 3 % 4
    rows = np.pad(image[::-1, :, ::-1].reshape(h, w * 3), ((0, 0), (0, pad))).astype(np.uint8)
    head = struct.pack("<2sIHHI", b"BM", 54 + rows.size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, rows.size, 2835, 2835, 0, 0)
    return head + rows.tobytes()


def _netpbm_header(data: bytes, n: int) -> tuple[list[int], int]:
    """The first n numbers after the magic and the offset behind the one blank that ends them; # starts a comment."""
    values, at = [], 2
    while len(values) < n:
        while data[at : at + 1].isspace() or data[at : at + 1] == b"#":
            at = data.index(b"\n", at) + 1 if data[at : at + 1] == b"#" else at + 1
        end = at
        while data[end : end + 1].isdigit():
            end += 1
        values.append(int(data[at:end]))
        at = end
    return values, at + 1


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 as (h, w) or (h, w, 3); samples of more than 8 bits give uint16; bitmaps give 0 for black, 255 for white."""
    kind = data[1] - 48
    if data[:1] != b"P" or not 1 <= kind <= 6:
        raise ValueError("not a Netpbm image")
    head, at = _netpbm_header(data, 2 if kind in (1, 4) else 3)
    w, h = head[:2]
    deep = 3 if kind in (3, 6) else 1
    if kind == 4:
        bits = np.unpackbits(np.frombuffer(data, np.uint8, h * ((w + 7) // 8), at).reshape(h, -1), axis=1)[:, :w]
        return (1 - bits) * np.uint8(255)
    if kind == 1:
        bits = np.array([c - 48 for c in data[at - 1 :] if c in (48, 49)], np.uint8)[: w * h]
        return (1 - bits.reshape(h, w)) * np.uint8(255)
    sample = np.dtype(np.uint8 if head[2] < 256 else ">u2")
    if kind in (2, 3):
        flat = np.array(data[at - 1 :].split()[: w * h * deep], np.int64).astype(sample)
    else:
        flat = np.frombuffer(data, sample, w * h * deep, at)
    return flat.reshape((h, w, 3) if deep == 3 else (h, w))


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed 24- or 32-bit BMP as (h, w, 3), red first, top row first."""
    if data[:2] != b"BM":
        raise ValueError("not a BMP image")
    begin = struct.unpack_from("<I", data, 10)[0]
    w, h, _, bits, packed = struct.unpack_from("<iiHHI", data, 18)
    if bits not in (24, 32) or packed not in (0, 3):
        raise ValueError("only uncompressed BMP of 24 or 32 bits")
    deep = bits // 8
    stride = (w * deep + 3) // 4 * 4
    rows = np.frombuffer(data, np.uint8, stride * abs(h), begin).reshape(abs(h), stride)[:, : w * deep].reshape(abs(h), w, deep)
    return (rows[::-1] if h > 0 else rows)[:, :, 2::-1]


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def decoded(data: bytes) -> np.ndarray | None:
    """The image, or None if the bytes hold none that is whole and has pixels."""
    try:
        image = decode(data)
    except (ValueError, IndexError, struct.error, OverflowError):
        return None
    return image if image.size else None


def to_npy(image: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array(out, np.ascontiguousarray(image), version=(1, 0), allow_pickle=False)
    return out.getvalue()


def from_npy(data: bytes) -> np.ndarray:
    return np.lib.format.read_array(io.BytesIO(data), allow_pickle=False)


def luma(image: np.ndarray) -> np.ndarray:
    """Grey values as float64 (ITU-R 601 weights)."""
    return image @ np.array([0.299, 0.587, 0.114]) if image.ndim == 3 else image.astype(np.float64)


def area_resize(grey: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean over each target pixel's area, parts of pixels counted, from the integral image."""
    h, w = grey.shape
    total = np.zeros((h + 1, w + 1))
    np.cumsum(np.cumsum(grey, 0), 1, out=total[1:, 1:])

    def along(table: np.ndarray, size: int, n: int) -> np.ndarray:
        cuts = np.arange(n + 1) * size / n
        low = np.minimum(cuts.astype(np.int64), size - 1)
        part = (cuts - low)[:, None]
        return table[low] * (1 - part) + table[low + 1] * part

    table = along(along(total, h, height).T, w, width).T
    sums = table[1:, 1:] - table[:-1, 1:] - table[1:, :-1] + table[:-1, :-1]
    return sums / (h / height * w / width)


def difference_hash(image: np.ndarray) -> str:
    """64 bits in hex: whether each of 8 x 8 cells is darker than its right neighbour in the 8 x 9 image."""
    small = np.round(area_resize(luma(image), 8, 9), 6)
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def text_image(payload: bytes) -> np.ndarray:
    return np.frombuffer(payload, np.uint8).reshape(-1, ROW_BYTES // 3, 3)


def padded(raw: bytes) -> bytes:
    """The bytes with blanks up to a positive multiple of ROW_BYTES."""
    return raw.ljust(max(1, -(-len(raw) // ROW_BYTES)) * ROW_BYTES, b" ")


def text_images(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kind: str = "ppm") -> DataFrame:
    """(doc_id, n_bytes, image): each whole text's bytes as an RGB image of 64 pixels a row, as P6 or BMP file bytes."""
    encode = {"ppm": encode_ppm, "bmp": encode_bmp}[kind]

    def run(batches):
        for batch in batches:
            for begin in range(0, len(batch), 256):
                part = batch.slice(begin, 256)
                raws = [t or b"" for t in part.column(1).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(r) for r in raws], pa.int64()), pa.array([encode(text_image(padded(r))) for r in raws], pa.binary())], names=["doc_id", "n_bytes", "image"])

    base = bounded_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return base.mapInArrow(run, "doc_id long, n_bytes long, image binary")


def npy_tiles(images: DataFrame, image_col: str = "image") -> DataFrame:
    """The images decoded and written as NPY tiles: other columns, ``tile`` and ``dhash``.

    A null image, or one that can't be decoded (cut off, empty, of another kind),
    gives a null tile and a null hash.  The input's own ``tile`` and ``dhash``
    give way to the new ones.
    """
    keep = [f for f in images.schema.fields if f.name not in (image_col, "tile", "dhash")]

    def run(batches):
        for batch in batches:
            for begin in range(0, len(batch), 256):
                part = batch.slice(begin, 256)
                arrays = [None if b is None else decoded(b) for b in part.column(part.schema.get_field_index(image_col)).to_pylist()]
                cols = [part.column(part.schema.get_field_index(f.name)) for f in keep]
                tiles = pa.array([None if a is None else to_npy(a) for a in arrays], pa.binary())
                hashes = pa.array([None if a is None else difference_hash(a) for a in arrays], pa.string())
                yield pa.RecordBatch.from_arrays([*cols, tiles, hashes], names=[*[f.name for f in keep], "tile", "dhash"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep)
    return images.mapInArrow(run, f"{fields}, tile binary, dhash string")


def store_tiles(tiles: DataFrame) -> DataFrame:
    """Write the tiles as a table in the shared folder and read it back."""
    return stored(tiles, "tiles")


def tile_digests(tiles: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature) from stored tiles.

    A null tile gives nulls.  Each tile is parsed and all but the last six columns
    follow from the samples: the payload's digests, and a feature of the difference hash with
    the mean of each quarter of a 2 x 2 area resize.
    """

    def run(batches):
        for batch in batches:
            for begin in range(0, len(batch), 256):
                part = batch.slice(begin, 256)
                rows = []
                for tile, dhash in zip(part.column(2).to_pylist(), part.column(3).to_pylist()):
                    if tile is None:
                        rows.append((None,) * 6)
                        continue
                    image = from_npy(tile)
                    payload = image.tobytes()
                    means = np.round(area_resize(luma(image), 2, 2).ravel(), 3)
                    rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(tile), hashlib.sha256(tile).hexdigest(), f"dhash={dhash};rows={image.shape[0]};means=" + ",".join(f"{m:.3f}" for m in means)))
                cols = list(zip(*rows))
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *[pa.array(c, k) for c, k in zip(cols, kinds)]], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    fields = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return tiles.select("doc_id", "n_bytes", "tile", "dhash").mapInArrow(run, fields)


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kind: str = "ppm") -> DataFrame:
    """Texts stored as images and read back, with digests of what was read.

    One row per input row; a null text is an empty one, whose payload is blanks;
    null ids stay null, repeated rows are stored each; equal texts give equal
    values; other columns are ignored; empty input gives no rows.
    """
    return tile_digests(store_tiles(npy_tiles(text_images(docs, id_col, text_col, kind))))
