"""Headers of real encodings built byte by byte, cut at every length."""

import random
import struct
import zlib

from plumbline.sources import images


def png(w, h):
    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    return images.PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0" * (w + 1))) + chunk(b"IEND", b"")


def jpeg(rng, w, h, before=3):
    out = b"\xff\xd8"
    for _ in range(before):
        out += b"\xff" * rng.randint(1, 3)
        if rng.random() < 0.2:
            out += bytes([rng.choice((0x01, 0xD3))])
        else:
            body = rng.randbytes(rng.choice((0, 5, 300)))
            out += bytes([rng.choice((0xE0, 0xE1, 0xDB, 0xC4, 0xFE))]) + struct.pack(">H", len(body) + 2) + body
    frame = struct.pack(">BHHB", 8, h, w, 1) + b"\1\x11\0"
    return out + b"\xff" + bytes([rng.choice((0xC0, 0xC1, 0xC2, 0xCF))]) + struct.pack(">H", len(frame) + 2) + frame + b"\xff\xda\0\4xx\xff\xd9"


def test_sizes_are_read_and_prefixes_suffice():
    rng = random.Random(1)
    for _ in range(200):
        w, h = rng.randint(1, 65535), rng.randint(1, 65535)
        for data, mime in ((png(w, h), "image/png"), (jpeg(rng, w, h, rng.randrange(5)), "image/jpeg")):
            want = (mime, w, h, None)
            assert images.header(data, len(data)) == want
            got = [images.header(data[:k], len(data)) for k in range(8, len(data) + 1)]
            assert set(got) <= {want, images._MORE} and got[-1] == want


def test_cut_files_never_give_a_size_or_an_error():
    rng = random.Random(2)
    for _ in range(40):
        data = jpeg(rng, 300, 200)
        for k in range(len(data)):
            mime, w, h, code = images.header(data[:k], k)
            assert (code is None) == (mime is not None) and code != "more" and (mime is None or (w, h) == (300, 200))
        for _ in range(200):
            noise = bytearray(data)
            noise[rng.randrange(2, len(noise))] = rng.randrange(256)
            images.header(bytes(noise), len(noise))


def test_files_are_read_and_declarations_checked(spark, tmp_path):
    rng = random.Random(3)
    long = b"\xff\xd8" + (b"\xff\xe1\xff\xff" + b"x" * 65533) * 2 + jpeg(rng, 40, 30)[2:]
    files = {"a/one.png": png(7, 9), "two.jpg": long, "bad.bin": b"GIF89a", "short.jpg": b"\xff\xd8"}
    for name, data in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    rows = images.read_images(spark, str(tmp_path))
    got = {r.path.rpartition("/")[2]: (r.mime, r.width, r.height, r.code) for r in rows.collect()}
    assert got == {"one.png": ("image/png", 7, 9, None), "two.jpg": ("image/jpeg", 40, 30, None), "bad.bin": (None, None, None, "unsupported"), "short.jpg": (None, None, None, "no_frame")}
    short = rows.withColumn("path", images.F.substring_index("path", "/", -1))
    declared = spark.createDataFrame([("one.png", "image/png", 7, 9), ("two.jpg", "image/jpeg", 30, 40), ("bad.bin", "image/png", 1, 1), ("none.png", "image/png", 1, 1), ("one.png", "image/jpeg", 7, 9)], "path string, mime string, width long, height long")
    assert sorted(map(tuple, images.dimension_issues(short, declared).collect())) == [("bad.bin", "unreadable:unsupported"), ("none.png", "missing"), ("one.png", "mime"), ("two.jpg", "dimensions")]
