"""Raw video and pictures as data sources: ranges, pushed filters, commit and abort, decoders against plain loops."""

import os
import re
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from vireo.sources import frames as S
from vireo.sources import pictures as PI
from vireo.sources import rawsource as R
from vireo.sources import rawvideo


def clip(spark, name, n, seed=1):
    form = R.format_of(name)
    luma, chroma = form.planes
    rng = np.random.default_rng(seed)
    rows = [(name, f, bytearray(rng.bytes(luma)), bytearray(rng.bytes(chroma)), bytearray(rng.bytes(chroma))) for f in range(n)]
    return spark.createDataFrame(rows, "path string, frame long, luma binary, u binary, v binary")


def test_names():
    for name in ("clip_640x360_10b_444_2020_60fps.yuv", "x_1280x720_8b_422_709_23.976fps.yuv", "a_8x6_8b_420_709_24fps.yuv"):
        assert R.name_of(name.split("_")[0], R.format_of(name)) == name
    assert R.format_of("d/x_1280x720p50_422_hdr.yuv") == R.Format(1280, 720, 8, "422", "2020", 50.0) and R.format_of("plain.yuv") == R.Format()


def test_write_read_and_ranges(spark, tmp_path):
    at, names = str(tmp_path / "v"), ("a_8x6_8b_420_709_24fps.yuv", "b_6x4_10b_444_2020_30fps.yuv")
    made = clip(spark, names[0], 150).union(clip(spark, names[1], 70, 2)).repartition(7)
    R.write_video(made, at)
    assert sorted(os.listdir(at)) == sorted(names)
    back = R.read_video(spark, at, partitionBytes=1000)
    assert back.rdd.getNumPartitions() > 10
    held = {(r.path.rsplit("/", 1)[1], r.frame): (bytes(r.luma), bytes(r.u), bytes(r.v)) for r in back.collect()}
    assert held == {(r.path, r.frame): (bytes(r.luma), bytes(r.u), bytes(r.v)) for r in made.collect()}
    some = back.where("frame >= 100 AND frame < 104 AND path LIKE '%a_8x6%'")
    assert sorted(r.frame for r in some.collect()) == [100, 101, 102, 103]
    assert back.where(F.col("frame") == 69).count() == 2 and back.where("frame > 149").count() == 0 and back.where("frame BETWEEN 5 AND 6 AND frame % 2 = 0").count() == 2
    rgb = S.rgb_frames(back.where("frame = 3"))
    assert rgb.count() == 2
    # the whole-file reader agrees
    assert rawvideo.read_raw_video(spark, at).count() == 220


def test_only_the_needed_bytes_are_read(tmp_path, monkeypatch):
    name = "a_8x6_8b_420_709_24fps.yuv"
    (tmp_path / name).write_bytes(bytes(72 * 1000))
    reader = R.RawReader({"path": str(tmp_path), "partitionbytes": "7200"})
    left = list(reader.pushFilters([R.GreaterThanOrEqual(("frame",), 500), R.LessThan(("frame",), 530), R.EqualTo(("space",), "709")]))
    assert left == [R.EqualTo(("space",), "709")]
    parts = reader.partitions()
    assert [(p.first, p.end) for p in parts] == [(500, 530)]
    asked, opened = [], R._opened

    class File:
        def __init__(self, f):
            self.f = f

        def __enter__(self):
            return self

        def __exit__(self, *a):
            self.f.close()

        def read_at(self, n, at):
            asked.append((at, n))
            return self.f.read_at(n, at)

    class System:
        def __init__(self, s):
            self.s = s

        def open_input_file(self, p):
            return File(self.s.open_input_file(p))

    monkeypatch.setattr(R, "_opened", lambda p: (System(opened(p)[0]), opened(p)[1]))
    assert sum(b.num_rows for p in parts for b in reader.read(p)) == 30
    assert sum(n for _, n in asked) == 30 * 72 and min(a for a, _ in asked) == 500 * 72


def test_damaged_video(spark, tmp_path):
    name = "a_8x6_8b_420_709_24fps.yuv"
    (tmp_path / name).write_bytes(bytes(72 * 3 + 5))
    assert R.read_video(spark, str(tmp_path)).count() == 3
    with pytest.raises(Exception, match="within a frame"):
        R.read_video(spark, str(tmp_path), strict="true").count()


def test_nothing_is_left_by_failing_tasks(spark, tmp_path):
    name, at = "a_8x6_8b_420_709_24fps.yuv", str(tmp_path / "out")
    good = clip(spark, name, 130)
    bad = good.withColumn("u", F.when(F.col("frame") == 129, F.lit(b"x")).otherwise(F.col("u")))
    with pytest.raises(Exception, match="must have 72 bytes"):
        R.write_video(bad, at)
    with pytest.raises(Exception, match="missing or there twice"):
        R.write_video(good.where("frame <> 7"), at)
    assert os.listdir(at) == []
    R.write_video(good, at)
    with pytest.raises(Exception, match="exists"):
        R.write_video(good, at)
    R.write_video(good.where("frame < 10"), at, overwrite=True)
    assert os.listdir(at) == [name]


def plain_png(x, kinds, depth, colour):
    """A PNG file of rows (h, bytes) with a predictor for each row, by loops."""
    unit = max(1, {0: 1, 2: 3, 4: 2, 6: 4}[colour] * depth // 8)
    lines, before = [], bytes(x.shape[1])
    for row, kind in zip(x.tolist(), kinds):
        line = [kind]
        for i, v in enumerate(row):
            a, b, c = (row[i - unit] if i >= unit else 0), before[i], (before[i - unit] if i >= unit else 0)
            p = a + b - c
            nearest = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            line.append((v - (0, a, b, (a + b) // 2, nearest)[kind]) % 256)
        lines.append(bytes(line))
        before = row
    return lines


def chunked(w, h, depth, colour, body, interlaced=0, more=b""):
    chunk = lambda n, b: struct.pack(">I", len(b)) + n + b + struct.pack(">I", zlib.crc32(n + b))
    half = len(body) // 2
    return PI.PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, colour, 0, 0, interlaced)) + more + chunk(b"IDAT", body[:half]) + chunk(b"IDAT", body[half:]) + chunk(b"IEND", b"")


@pytest.mark.parametrize("depth,colour", [(8, 0), (8, 2), (16, 2), (16, 6), (8, 4), (2, 0), (1, 0), (4, 3)])
def test_png_against_plain_loops(depth, colour):
    rng = np.random.default_rng(depth + colour)
    h, w, n = 13, 11, PI.SAMPLES_OF[colour]
    codes = rng.integers(0, 2**depth, (h, w, n))
    if depth == 16:
        rows = np.frombuffer(codes.astype(">u2").tobytes(), np.uint8).reshape(h, -1)
    elif depth == 8:
        rows = codes.astype(np.uint8).reshape(h, -1)
    else:
        bits = ((codes[:, :, 0, None] >> np.arange(depth)[::-1]) & 1).reshape(h, -1).astype(np.uint8)
        rows = np.packbits(bits, axis=1)
    palette = rng.integers(0, 256, (16, 3), dtype=np.uint8)
    more = b"" if colour != 3 else struct.pack(">I", 48) + b"PLTE" + palette.tobytes() + struct.pack(">I", zlib.crc32(b"PLTE" + palette.tobytes()))
    data = chunked(w, h, depth, colour, zlib.compress(b"".join(plain_png(rows, [k % 5 for k in range(h)], depth, 0 if colour == 3 else colour))), more=more)
    want = palette[codes[:, :, 0]] / 255 if colour == 3 else codes / (2**depth - 1)
    assert np.array_equal(PI.decode_png(data), want)
    bent = bytearray(data)
    bent[-30] ^= 1
    with pytest.raises((ValueError, zlib.error)):
        PI.decode_png(bytes(bent))
    with pytest.raises(ValueError):
        PI.decode_png(data[: len(data) // 2])


def test_interlaced_png():
    codes = np.random.default_rng(3).integers(0, 256, (10, 9), dtype=np.uint8)
    lines = [line for y, x, dy, dx in PI.PASSES for line in plain_png(codes[y::dy, x::dx], [4] * 10, 8, 0) if codes[y::dy, x::dx].size]
    assert np.array_equal(PI.decode_png(chunked(9, 10, 8, 0, zlib.compress(b"".join(lines)), 1))[:, :, 0], codes / 255)


def test_float_pictures():
    x = np.random.default_rng(4).random((5, 7, 3)).astype("f4")
    assert np.array_equal(PI.decode_pfm(PI.encode_pfm(x)), x) and PI.decode_pfm(PI.encode_pfm(x[:, :, 0])).shape == (5, 7, 1)
    assert np.array_equal(PI.decode_pfm(b"Pf\n2 1\n1.0\n" + struct.pack(">ff", 1.5, -2))[0, :, 0], [1.5, -2])
    rows = np.random.default_rng(5).integers(0, 256, (3, 9, 4), dtype=np.uint8)
    rows[1, :, :] = rows[1, 0]
    rows[2, 4, 3] = 0
    body = b""
    for row in rows:
        body += bytes([2, 2, 0, 9])
        for c in range(4):
            v = row[:, c].tobytes()
            body += bytes([128 + 9, v[0]]) if len(set(v)) == 1 else bytes([4]) + v[:4] + bytes([5]) + v[4:]
    head = b"#?RADIANCE\nFORMAT=32-bit_rle_rgbe\n\n-Y 3 +X 9\n"
    want = np.where(rows[:, :, 3:] > 0, 2.0 ** (rows[:, :, 3:].astype(float) - 136) * (rows[:, :, :3] + 0.5), 0)
    assert np.allclose(PI.decode_radiance(head + body), want) and np.allclose(PI.decode_radiance(head + rows.tobytes()), want)
    for bad in (b"none", head + body[:-3], b"#?RADIANCE\n\n-Y 3 +X 9\n"):
        with pytest.raises((ValueError, IndexError)):
            PI.decode_radiance(bad)
    with pytest.raises(ValueError):
        PI.decode_pfm(PI.encode_pfm(x)[:-1])


def test_picture_files(spark, tmp_path):
    rng, at = np.random.default_rng(6), str(tmp_path / "p")
    held = {f"x{k}.{e}": np.floor(rng.random((3, 6, 5)) * 65535) / 65535 for k, e in enumerate(("png", "pfm", "png"))}
    rows = spark.createDataFrame([(n, 6, 5, *(p.ravel().tolist() for p in x)) for n, x in held.items()], "name string, h int, w int, v0 array<double>, v1 array<double>, v2 array<double>")
    PI.write_pictures(rows, at, PI.RGB)
    assert sorted(os.listdir(at)) == sorted(held)
    back = {r.clip.rsplit("/", 1)[1]: np.array([r.v0, r.v1, r.v2]).reshape(3, 6, 5) for r in S.read_frames(spark, at + "/*.png").union(S.read_frames(spark, at + "/*.pfm")).collect()}
    assert set(back) == set(held) and all(np.allclose(back[n], held[n], atol=0 if "png" in n else 1e-7) for n in held)
    with pytest.raises(Exception, match="planes|reshape"):
        PI.write_pictures(rows.withColumn("w", F.lit(4)), str(tmp_path / "bad"), PI.RGB)
    with pytest.raises(Exception, match="one name"):
        PI.write_pictures(rows.union(rows), str(tmp_path / "bad"), PI.RGB)
    assert os.listdir(tmp_path / "bad") == []
    (tmp_path / "p" / "x9.png").write_bytes(b"nothing")
    with pytest.raises(Exception, match="x9.png isn't a picture"):
        PI.read_pictures(spark, at + "/*.png").count()


def test_long_sequences(spark):
    """Frames beyond the number 9999 stay."""
    names = spark.range(10_050).select(F.format_string("img_%d.png", "id").alias("name"))
    assert rawvideo.sequence_frames(names, "img_%d.png").count() == 10_050
    assert re.search("9999", open(rawvideo.__file__).read()) is None
