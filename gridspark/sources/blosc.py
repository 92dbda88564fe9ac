"""Decoding of Blosc (version 1) buffers with the codecs that pyarrow, zlib and zstandard offer.

Layout, from the public format: a 16-byte header (version, codec version, flags, type size, then
bytes, block size and compressed bytes as little-endian 32-bit numbers), the offsets of the blocks,
and each block as one or `type size` streams, each with its own compressed length."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa

from ..errors import ZarrError

_BYTE_SHUFFLE, _COPIED, _BIT_SHUFFLE, _WHOLE = 0x1, 0x2, 0x4, 0x10
_LEAST_SPLIT, _WIDEST_SPLIT = 128, 16


def _inner(kind: int, data: bytes, size: int) -> bytes:
    if kind == 1:
        return pa.Codec("lz4_raw").decompress(data, decompressed_size=size, asbytes=True)
    if kind == 2:
        return pa.Codec("snappy").decompress(data, decompressed_size=size, asbytes=True)
    if kind == 3:
        return zlib.decompress(data)
    if kind == 4:
        import zstandard

        return zstandard.ZstdDecompressor().decompress(data, max_output_size=size)
    raise ZarrError("Blosc buffers by blosclz are not supported")


def _unshuffled(block: bytes, width: int) -> bytes:
    whole = len(block) // width * width
    return np.frombuffer(block[:whole], np.uint8).reshape(width, -1).T.tobytes() + block[whole:]


def _unbitshuffled(block: bytes, width: int) -> bytes:
    """Eight elements at a time; what is left over was never shuffled."""
    count = len(block) // width // 8 * 8
    if not count:
        return block
    used = count * width
    bits = np.unpackbits(np.frombuffer(block[:used], np.uint8), bitorder="little").reshape(width * 8, count)
    return np.packbits(bits.T.reshape(-1), bitorder="little").tobytes() + block[used:]


def decode(data: bytes) -> bytes:
    if len(data) < 16:
        raise ZarrError("short Blosc buffer")
    _, _, flags, width = data[:4]
    size, block_size, total = struct.unpack_from("<III", data, 4)
    if len(data) < total:
        raise ZarrError("short Blosc buffer")
    if flags & _COPIED:
        return data[16 : 16 + size]
    if not size:
        return b""
    blocks = -(-size // block_size)
    starts = struct.unpack_from(f"<{blocks}I", data, 16)
    out = []
    for n, at in enumerate(starts):
        length = min(block_size, size - n * block_size)
        split = not flags & _WHOLE and width <= _WIDEST_SPLIT and block_size // width >= _LEAST_SPLIT and length == block_size
        streams = width if split else 1
        parts = []
        for _ in range(streams):
            (packed,) = struct.unpack_from("<i", data, at)
            piece = data[at + 4 : at + 4 + packed]
            parts.append(piece if packed == length // streams else _inner(flags >> 5, piece, length // streams))
            at += 4 + packed
        block = b"".join(parts)
        if flags & _BYTE_SHUFFLE and width > 1:
            block = _unshuffled(block, width)
        elif flags & _BIT_SHUFFLE:
            block = _unbitshuffled(block, width)
        out.append(block)
    return b"".join(out)
