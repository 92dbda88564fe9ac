"""Media columns: Netpbm and BMP images as numpy arrays, area-resized by integral images, cut
into NPY tiles with difference hashes.

Empty or null media give null results with an error text instead of failing the job; an image
that cannot be decoded does the same. Equal bytes give equal results; repeated rows repeat them.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common

#: Side of the thumbnail, of a tile of it, and the grid of a difference hash (rows, columns).
THUMB, TILE, HASH_GRID = 64, 32, (8, 9)
#: A payload is filled up with FILL to a multiple of UNIT bytes.
UNIT, SIDE, FILL = 576, 24, b"\xff"


class MediaError(ValueError):
    """Bytes that are not an image of a supported kind."""


def _fields(data: bytes, at: int, count: int) -> tuple[list[int], int]:
    """Decimal fields of a Netpbm header; # starts a comment up to the line's end."""
    out: list[int] = []
    while len(out) < count:
        while at < len(data) and (data[at : at + 1].isspace() or data[at] == 35):
            if data[at] == 35:
                while at < len(data) and data[at] not in b"\r\n":
                    at += 1
            else:
                at += 1
        start = at
        while at < len(data) and 48 <= data[at] <= 57:
            at += 1
        if at == start:
            raise MediaError("bad Netpbm header")
        out.append(int(data[start:at]))
    return out, at


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 as (height, width, channels); bitmaps as 0 and 1 with 1 for black."""
    kind = data[1:2]
    if data[:1] != b"P" or kind not in (b"1", b"2", b"3", b"4", b"5", b"6"):
        raise MediaError("not Netpbm")
    bits, channels = kind in b"14", 3 if kind in b"36" else 1
    head, at = _fields(data, 2, 2 if bits else 3)
    width, height = head[:2]
    top = 1 if bits else head[2]
    if not width or not height or not 0 < top < 65536:
        raise MediaError("bad Netpbm size")
    n = width * height * channels
    if kind in b"123":
        body = data[at:]
        if b"#" in body:
            body = b"\n".join(line.split(b"#", 1)[0] for line in body.splitlines())
        if kind == b"1":
            raw = np.frombuffer(body, np.uint8)
            values = raw[(raw == 48) | (raw == 49)] - 48
        else:
            values = np.array(body.split(), dtype=np.int64)
        if len(values) < n:
            raise MediaError("short Netpbm data")
        if n and not 0 <= int(values[:n].min()) <= int(values[:n].max()) <= top:
            raise MediaError("Netpbm sample out of range")
        image = values[:n].astype(np.uint8 if top < 256 else np.uint16)
    else:
        at += 1
        stride = (width + 7) // 8 if bits else width * channels * (1 if top < 256 else 2)
        body = data[at : at + stride * height]
        if len(body) < stride * height:
            raise MediaError("short Netpbm data")
        if bits:
            image = np.unpackbits(np.frombuffer(body, np.uint8).reshape(height, stride), axis=1)[:, :width]
        else:
            image = np.frombuffer(body, np.uint8 if top < 256 else ">u2")
            image = image if top < 256 else image.astype(np.uint16)
    return image.reshape(height, width, channels)


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 1, 4, 8 (palette), 24 or 32 bits as (height, width, 3) red, green, blue."""
    if data[:2] != b"BM" or len(data) < 54:
        raise MediaError("not BMP")
    offset, size = struct.unpack_from("<II", data, 10)
    width, height, _, depth, packing, _, _, _, colours = struct.unpack_from("<iiHHIIiiI", data, 18)
    if size < 40 or packing != 0 or depth not in (1, 4, 8, 24, 32) or width <= 0 or height == 0:
        raise MediaError("BMP kind not supported")
    rows, stride = abs(height), (width * depth + 31) // 32 * 4
    if len(data) < offset + stride * rows:
        raise MediaError("short BMP data")
    body = np.frombuffer(data, np.uint8, stride * rows, offset).reshape(rows, stride)
    if height > 0:
        body = body[::-1]
    if depth >= 24:
        return body[:, : width * depth // 8].reshape(rows, width, depth // 8)[:, :, 2::-1]
    index = np.unpackbits(body, axis=1) if depth == 1 else np.stack([body >> 4, body & 15], axis=2).reshape(rows, -1) if depth == 4 else body
    palette = np.zeros((256, 3), np.uint8)
    given = np.frombuffer(data, np.uint8, 4 * min(colours or 1 << depth, 256), 14 + size).reshape(-1, 4)
    palette[: len(given)] = given[:, 2::-1]
    return palette[index[:, :width]]


def decode(data: bytes) -> np.ndarray:
    """The image; MediaError for bytes of any sort that are none."""
    try:
        return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)
    except MediaError:
        raise
    except (ValueError, OverflowError, IndexError, struct.error) as e:  # a number or table that makes no sense
        raise MediaError(f"bad image: {e}") from e


def encode_pgm(image: np.ndarray) -> bytes:
    """Binary 8-bit grey Netpbm of a (height, width) array."""
    return b"P5\n%d %d\n255\n" % (image.shape[1], image.shape[0]) + image.astype(np.uint8).tobytes()


def encode_bmp(image: np.ndarray) -> bytes:
    """24-bit bottom-up BMP of a (height, width, 3) array."""
    height, width, _ = image.shape
    stride = (width * 3 + 3) // 4 * 4
    body = np.zeros((height, stride), np.uint8)
    body[:, : width * 3] = image[::-1, :, ::-1].reshape(height, width * 3)
    return struct.pack("<2sIHHI", b"BM", 54 + body.size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, body.size, 2835, 2835, 0, 0) + body.tobytes()


def area_sums(image: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """Exact sums over equal areas of a 2-D image, times rows * columns, by its integral image.

    An area's edge at row i * height / rows may cut pixels; the integral image is linear inside
    a pixel, so whole-number weights of the two rows beside the edge give its value there."""
    height, width = image.shape
    integral = np.zeros((height + 1, width + 1), np.int64)
    integral[1:, 1:] = image
    np.cumsum(integral, axis=0, out=integral)
    np.cumsum(integral, axis=1, out=integral)
    for axis, (length, parts) in enumerate(((height, rows), (width, columns))):
        edge = np.arange(parts + 1, dtype=np.int64) * length
        low, part = edge // parts, edge % parts
        high = np.minimum(low + 1, length)
        shape = (-1, 1) if axis == 0 else (1, -1)
        integral = integral.take(low, axis) * (parts - part).reshape(shape) + integral.take(high, axis) * part.reshape(shape)
    return integral[1:, 1:] - integral[:-1, 1:] - integral[1:, :-1] + integral[:-1, :-1]


def area_resize(image: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """Mean of each area, rounded half up; (height, width) or (height, width, channels)."""
    if image.ndim == 3:
        return np.stack([area_resize(image[:, :, c], rows, columns) for c in range(image.shape[2])], axis=2)
    area = image.shape[0] * image.shape[1]
    return ((2 * area_sums(image, rows, columns) + area) // (2 * area)).astype(image.dtype)


def grey(image: np.ndarray) -> np.ndarray:
    """One channel: the whole-number luma of red, green and blue."""
    if image.ndim == 2 or image.shape[2] == 1:
        return image.reshape(image.shape[:2])
    c = image.astype(np.int64)
    return ((299 * c[:, :, 0] + 587 * c[:, :, 1] + 114 * c[:, :, 2] + 500) // 1000).astype(image.dtype)


def difference_hash(image: np.ndarray) -> str:
    """64 bits as hex: whether an area is darker than its right neighbour, exactly."""
    sums = area_sums(image, *HASH_GRID)
    return np.packbits(sums[:, :-1] < sums[:, 1:]).tobytes().hex()


def npy(tile: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array(out, np.ascontiguousarray(tile), version=(1, 0), allow_pickle=False)
    return out.getvalue()


def tiles(image: np.ndarray) -> list[tuple[bytes, str]]:
    """NPY bytes and difference hash of each tile of the image's thumbnail, row by row."""
    small = area_resize(image, THUMB, THUMB)
    return [(npy(part), difference_hash(grey(part))) for y in range(0, THUMB, TILE) for x in range(0, THUMB, TILE) for part in [small[y : y + TILE, x : x + TILE]]]


def text_payload(text: str) -> tuple[int, bytes]:
    """UTF-8 bytes filled up to a positive multiple of UNIT; their number before."""
    raw = text.encode()
    return len(raw), raw + FILL * (-len(raw) % UNIT if raw else UNIT)


def payload_image(payload: bytes) -> np.ndarray:
    """The payload as an image whose sides are multiples of SIDE, as square as they can be."""
    k = len(payload) // UNIT
    across = next(m for m in range(int(k**0.5), 0, -1) if k % m == 0)
    return np.frombuffer(payload, np.uint8).reshape(-1, SIDE * across)


def text_media(text: str) -> bytes:
    return encode_pgm(payload_image(text_payload(text)[1]))


_MEDIA = pa.schema([("id", pa.int64()), ("width", pa.int64()), ("height", pa.int64()), ("channels", pa.int64()), ("dhash", pa.string()), ("tile_npy", pa.list_(pa.binary())), ("tile_dhash", pa.list_(pa.string())), ("error", pa.string())])


def decode_media(media: DataFrame, key: str, column: str) -> DataFrame:
    """Each media value decoded: key as id, width, height, channels, dhash, tile_npy (the four
    NPY files of the thumbnail), tile_dhash, error. A narrow map; memory is one image's."""
    common.ready(media.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    if not data:
                        raise MediaError("no data")
                    image = decode(data)
                    cut = tiles(image)
                    rows.append((k, image.shape[1], image.shape[0], image.shape[2], difference_hash(grey(image)), [t for t, _ in cut], [h for _, h in cut], None))
                except MediaError as e:
                    rows.append((k, None, None, None, None, None, None, str(e)))
            yield common.batch(_MEDIA, {f.name: [r[i] for r in rows] for i, f in enumerate(_MEDIA)})

    return common.need(media, key, column).mapInArrow(run, common.ddl(_MEDIA))


_TEXT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("tiles_sha256", pa.string())])


def text_media_digests(docs: DataFrame) -> DataFrame:
    """Texts stored as grey images, read back and described.

    The feature is the image's difference hash and those of the four tiles; tiles_sha256 is of the
    tiles' NPY files, one after another. A null text is empty: one unit of fill bytes. One narrow map, so that no image crosses the network."""
    common.ready(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict = {f.name: [] for f in _TEXT}
            out["doc_id"] = b.column(0).to_pylist()
            for text in common.texts(b.column(1)):
                n, payload = text_payload(text)
                stored = encode_pgm(payload_image(payload))
                image = decode(stored)
                back = image.tobytes()
                cut = tiles(image)
                feature = ".".join([difference_hash(grey(image)), *(h for _, h in cut)])
                files = hashlib.sha256(b"".join(t for t, _ in cut)).hexdigest()
                for name, value in zip(_TEXT.names[1:], (n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), feature, files)):
                    out[name].append(value)
            yield common.batch(_TEXT, out)

    return common.need(docs, "doc_id", "text").mapInArrow(run, common.ddl(_TEXT))


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_media_digests(common.table(spark, sf_dir, "documents"))
