import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import reconstruct
from gridloom.sources import files, pixels, readers

IMAGE = np.random.default_rng(1).integers(0, 256, (9, 7, 3)).astype(np.uint8)


def part(kind, data, crc=None):
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data) if crc is None else crc)


def png(*parts, width=7, height=9, kind=2, end=True):
    head = part(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, kind, 0, 0, 0))
    return b"\x89PNG\r\n\x1a\n" + head + b"".join(parts) + (part(b"IEND", b"") if end else b"")


def odd_files():
    raw = np.concatenate([np.zeros((9, 1), np.uint8), IMAGE.reshape(9, -1)], 1).tobytes()
    filtered = bytearray(raw)
    filtered[::22] = bytes(i % 5 for i in range(9))
    z, data = zlib.compress(raw), lambda x, crc=None: part(b"IDAT", x, crc)
    return {
        "ok": png(data(z)), "filters": png(data(zlib.compress(bytes(filtered)))), "no such filter": png(data(zlib.compress(b"\x07" + raw[1:]))), "wrong crc": png(data(z, 5)), "wrong sum": png(data(z[:-1] + b"\0")),
        "cut": png(data(z[:40])), "cut file": png(data(z))[:70], "no end": png(data(z), end=False), "two": png(data(z[:30]), data(z[30:])), "more": png(data(zlib.compress(raw + bytes(400)))), "text": png(part(b"tEXt", b"a\0b"), data(z)),
        "apart": png(data(z[:30]), part(b"tEXt", b"a\0b"), data(z[30:])), "gamma": png(part(b"gAMA", struct.pack(">I", 45455)), data(z)), "clear": png(part(b"tRNS", bytes(6)), data(z)), "gray": png(data(z), width=21, kind=0),
        "no width": png(data(z), width=0), "no data": png(), "empty": b"", "words": b"hello", "a+b [1]": png(data(z)), "c+d [2]*": png(data(z), width=21, kind=0), "_hidden": png(data(z)),
    }


@pytest.mark.parametrize("named", [10_000, 3])
def test_decoding_is_sparks(spark, tmp_path, monkeypatch, named):
    """Whether tasks read a file or Spark does, by name or with its folder, what can be decoded and its pixels are those of Spark's image source."""
    monkeypatch.setattr(pixels, "NAMED", named)
    for name, content in odd_files().items():
        (tmp_path / f"{name}.png").write_bytes(content)
    image = spark.read.format("image").option("dropInvalid", True).load(str(tmp_path)).select("image.*").collect()
    want = {r.origin.rsplit("/", 1)[-1].replace("%20", " ").replace("%5B", "[").replace("%5D", "]"): r for r in image}
    got = {r.file_name: r for r in pixels.decoded(spark, str(tmp_path), True).collect()}
    assert {k: (r.width, r.height, bytes(r.pixels)) for k, r in got.items()} == {k: (r.width, r.height, bytes(r.data)) for k, r in want.items()} and 10 < len(got) < 20
    assert {(r.file_name, r.disk_width) for r in readers.decoded(spark, str(tmp_path)).collect()} == {(k, r.width) for k, r in want.items()}
    assert {r.file_name for r in pixels.load(spark, str(tmp_path)).collect()} == {k for k, r in want.items() if r.nChannels == 3}


def test_the_driver_holds_no_listing(spark, tmp_path):
    folder = str(tmp_path)
    for i in range(30):
        (tmp_path / f"{i}.png").write_bytes(pixels.png(IMAGE))
        (tmp_path / f"{i}.txt").write_text("0 .5 .5 .1 .1" if i else "")
    for name in (".x.png", "_x.png", "_x.txt"):
        (tmp_path / name).write_bytes(b"hidden")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "31.png").write_bytes(b"below")
    found = readers.image_listing(spark, folder)
    loaded, sizes, lines = pixels.load(spark, folder), readers.decoded(spark, folder), readers.label_lines(spark, folder)
    for rows, own in ((found, ""), (loaded, ".png"), (sizes, ".png"), (lines, "")):  # the text files are few enough to be Spark's by name
        assert not [f for f in rows.inputFiles() if f"{folder}/" in f and f.endswith(own)]
    assert [tuple(r) for r in found.collect()] == sorted((f"file:{folder}/{i}.png", os.path.getsize(tmp_path / f"{i}.png"), f"{i}.png") for i in range(30))
    assert {bytes(r.pixels) for r in loaded.collect()} == {IMAGE.tobytes()} and sizes.count() == 30
    assert sorted(map(tuple, lines.collect())) == sorted((f"{i}.txt", "0 .5 .5 .1 .1" if i else "") for i in range(30))


def test_partitions_and_other_folders(spark, tmp_path):
    (tmp_path / "day=1").mkdir()
    (tmp_path / "day=1" / "a.png").write_bytes(b"12")
    assert [(r.file_name, r.bytes) for r in readers.image_listing(spark, str(tmp_path)).collect()] == [("a.png", 2)]
    assert files.mounted(spark, f"{tmp_path}/none") is None and files.mounted(spark, f"{tmp_path}/day=1/a.png") is None
    assert [r.bytes for r in readers.image_listing(spark, f"{tmp_path}/day=1/a.png").collect()] == [2]


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_pixels_move_once(spark, monkeypatch):
    """Tiles that stand in their image's row are cut without a shuffle, an image is rebuilt with one, and of its comparison only digests move."""
    image = spark.createDataFrame([(i, 7, 9, IMAGE.tobytes()) for i in range(5)], "image_id long, width int, height int, pixels binary")
    tiles = F.array(*[F.struct(F.col("width"), F.col("height"), F.lit(4).alias("tile_width"), F.lit(5).alias("tile_height"), F.lit(x).alias("x"), F.lit(y).alias("y")) for x in (0, 3) for y in (0, 4)])
    monkeypatch.setattr(files, "BYTES", 100)
    cut = pixels.cut(image.withColumn("tiles", tiles))
    again = reconstruct.rebuild(cut, 50)
    assert exchanges(cut) == 0 and exchanges(again) == 1
    assert cut.count() == 20 and {bytes(r.pixels) for r in again.collect()} == {IMAGE.tobytes()} and again.count() == 5
    tiled = image.select("image_id", F.inline(tiles))
    assert sorted(map(tuple, pixels.cropped(image, tiled).collect())) == sorted(map(tuple, cut.collect()))
    other = image.withColumn("pixels", F.when(F.col("image_id") == 3, F.lit(b"x")).otherwise(F.col("pixels")))
    assert [r.image_id for r in reconstruct.mismatches(other, again).collect()] == [3]
