import hashlib
import io
import struct
import zlib

import numpy as np
import pytest

from gridspark.llm import media


def test_netpbm_kinds():
    grey = np.arange(6, dtype=np.uint8).reshape(2, 3)
    assert (media.decode(media.encode_pgm(grey))[:, :, 0] == grey).all()
    assert media.decode(b"P1 # bits\n3 2\n101\n0 1 0")[:, :, 0].tolist() == [[1, 0, 1], [0, 1, 0]]
    assert media.decode(b"P2\n2 1 #w h\n255\n7 # x\n9")[:, :, 0].tolist() == [[7, 9]]
    assert media.decode(b"P3 1 2 9 1 2 3 4 5 6").tolist() == [[[1, 2, 3]], [[4, 5, 6]]]
    assert media.decode(b"P4\n10 2\n" + bytes([0b10000000, 0b01000000, 0, 0]))[:, :, 0].tolist() == [[1, *[0] * 8, 1], [0] * 10]
    assert media.decode(b"P5 1 2 65535\n" + struct.pack(">HH", 300, 7))[:, :, 0].tolist() == [[300], [7]]
    assert media.decode(b"P6\n1 1\n255\n\x01\x02\x03").tolist() == [[[1, 2, 3]]]
    for bad in (b"", b"P7", b"P5\n2 2\n255\nabc", b"P5 0 1 255\n", b"BMxx", b"P5 x"):
        with pytest.raises(media.MediaError):
            media.decode(bad)


def test_bmp_kinds():
    image = np.random.default_rng(0).integers(0, 256, (3, 5, 3), dtype=np.uint8)
    data = media.encode_bmp(image)
    assert (media.decode(data) == image).all()
    down = bytearray(data)
    struct.pack_into("<i", down, 22, -3)
    assert (media.decode(bytes(down)) == image[::-1]).all()
    palette = struct.pack("<2sIHHI", b"BM", 70, 0, 0, 62) + struct.pack("<IiiHHIIiiII", 40, 3, 1, 1, 1, 0, 4, 0, 0, 2, 0) + bytes([1, 2, 3, 0, 9, 8, 7, 0]) + bytes([0b01000000, 0, 0, 0])
    assert media.decode(palette).tolist() == [[[3, 2, 1], [7, 8, 9], [3, 2, 1]]]


def test_area_sums_are_exact():
    rng = np.random.default_rng(2)
    for shape, out in (((7, 5), (3, 4)), ((2, 3), (5, 7)), ((24, 24), (8, 9)), ((1, 1), (4, 4))):
        image = rng.integers(0, 256, shape)
        fine = np.kron(image, np.ones(out, int))  # every pixel cut in out[0] x out[1] parts
        want = fine.reshape(out[0], shape[0], out[1], shape[1]).sum(axis=(1, 3))
        assert (media.area_sums(image, *out) == want).all()
    assert (media.area_resize(np.full((9, 9), 77, np.uint8), 4, 4) == 77).all()


def test_query_form(spark, docs_of, odd):
    got = sorted(map(tuple, media.text_media_digests(docs_of(odd)).collect()), key=str)
    for d, t in odd:
        raw = (t or "").encode()
        payload = raw + b"\xff" * ((-len(raw)) % 576 or (0 if raw else 576))
        rows = [r for r in got if r[0] == d and r[1] == len(raw)]
        assert rows and rows[0][2:5] == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        stored = media.text_media(t or "")
        assert rows[0][5:7] == (len(stored), hashlib.sha256(stored).hexdigest())
        files = [t for t, _ in media.tiles(media.decode(stored))]
        assert rows[0][8] == hashlib.sha256(b"".join(files)).hexdigest() and all(np.load(io.BytesIO(f)).shape == (32, 32, 1) for f in files)
    assert len(got) == len(odd) and media.text_media_digests(docs_of([])).count() == 0


def test_media_columns(spark):
    image = np.arange(48, dtype=np.uint8).reshape(4, 4, 3)
    df = spark.createDataFrame([(1, bytearray(media.encode_bmp(image))), (2, None), (3, bytearray(b"no image")), (4, bytearray(b""))], "k long, m binary")
    rows = {r["id"]: r for r in media.decode_media(df, "k", "m").collect()}
    assert (rows[1]["width"], rows[1]["height"], rows[1]["channels"]) == (4, 4, 3) and len(rows[1]["tile_npy"]) == 4
    tile = np.load(io.BytesIO(rows[1]["tile_npy"][0]))
    assert (tile == media.area_resize(image, 64, 64)[:32, :32]).all()
    # numbers that make no sense, a palette that is cut off, samples over the top: each gives an error row
    short = struct.pack("<2sIHHI", b"BM", 60, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 3, 1, 1, 1, 0, 4, 0, 0, 256, 0) + bytes(4)
    broken = [b"P2 2 1 255 x y", b"P2 1 1 255 " + b"9" * 40, b"P5 " + b"1" * 5000 + b" 1 255\n", short, b"P2 1 1 9 10", b"P2 1 1 9 -1"]
    bad = media.decode_media(spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate(broken)], "k long, m binary"), "k", "m").collect()
    assert len(bad) == len(broken) and all(r["error"] and r["width"] is None for r in bad)
    assert rows[2]["error"] == rows[4]["error"] == "no data" and rows[3]["error"] == "not Netpbm"
