"""File sources and numbering on small fixtures."""

import numpy as np
import pytest

from vireo.operators.numbering import numbered
from vireo.sources import rawvideo as raw


def test_video_names(spark):
    names = ["/a/clip_640x360_10b_444_2020_60fps.yuv", "x_1280x720p50_422_hdr.yuv", "plain.yuv", "a_1920x1080p30_25fps_8bit_sdr.yuv", None]
    got = [(r.width, r.height, r.bits, r.chroma, r.space, r.fps) for r in raw.with_video_format(spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, path string")).orderBy("i").collect()]
    default = (1920, 1080, 8, "420", "709", 24.0)
    assert got == [(640, 360, 10, "444", "2020", 60.0), (1280, 720, 8, "422", "2020", 50.0), default, (1920, 1080, 8, "420", "709", 25.0), default]


def test_raw_video(spark, tmp_path):
    rng = np.random.default_rng(1)
    files = {"a_8x6_8b_420_709_24fps.yuv": (rng.integers(0, 256, 3 * 72, dtype=np.uint8), 8), "b_4x4_10b_444_2020_30fps.yuv": (rng.integers(0, 1024, 2 * 48, dtype=np.uint16), 10)}
    for name, (codes, _) in files.items():
        (tmp_path / name).write_bytes(codes.tobytes() + b"rest"[: 4 if "8b" in name else 3])
    frames = raw.read_raw_video(spark, str(tmp_path))
    assert frames.count() == 5
    for r in frames.collect():
        codes, bits = files[r.path.rsplit("/", 1)[1]]
        size = 72 if bits == 8 else 48
        assert r.luma + r.u + r.v == codes[r.frame * size : (r.frame + 1) * size].tobytes()
    luma = {(r.frame, r.y, r.x): r.code for r in raw.plane_samples(frames.where("bits = 10")).collect()}
    want = files["b_4x4_10b_444_2020_30fps.yuv"][0]
    assert luma == {(f, y, x): int(want[f * 48 + y * 4 + x]) for f in range(2) for y in range(4) for x in range(4)}
    assert raw.plane_samples(frames.where("bits = 8"), "u").count() == 3 * 12
    raw.write_raw_video(frames, str(tmp_path / "out"))
    back = {}
    for r in spark.read.parquet(str(tmp_path / "out")).orderBy("path", "frame").collect():
        name = r.path.rsplit("/", 1)[1]
        back[name] = back.get(name, b"") + bytes(r.content)
    with pytest.raises(Exception, match="within a frame"):
        raw.read_raw_video(spark, str(tmp_path / "*.yuv"), strict=True).count()
    assert back == {name: codes.tobytes() for name, (codes, _) in files.items()}


def test_sequence_stops_at_the_first_gap(spark):
    names = spark.createDataFrame([(f"d/img_{k:03d}.png",) for k in (0, 1, 2, 2, 4, 5)] + [("d/other.png",), (None,)], "name string")
    found = lambda **k: sorted(r.frame for r in raw.sequence_frames(names, "d/img_%03d.png", **k).collect())
    assert found() == [0, 1, 2] and found(start=0, step=2) == [0, 2, 4] and found(start=3) == [] and found(last=1) == [0, 1]


def test_condition_table(spark, tmp_path):
    path = tmp_path / "q.csv"
    path.write_text('# quality\nfull-range: true\nfps: 30\n\ntest,jod\n"a,b.mp4",9.5\nc.mp4,8\n')
    rows, settings = raw.read_condition_table(spark, str(path), "test string, jod double")
    assert {r.key: r.value for r in settings.collect()} == {"full_range": "true", "fps": "30"}
    assert sorted((r.test, r.jod) for r in rows.collect()) == [("a,b.mp4", 9.5), ("c.mp4", 8.0)]


def test_numbering(spark):
    keys = [None, 5, 3, 3, 9, -1, 100, 7]
    got = sorted((r.k, r.v) for r in numbered(spark.createDataFrame([(k,) for k in keys], "v long"), "v").collect())
    assert [k for k, _ in got] == list(range(1, 9)) and [v for _, v in got[1:]] == [-1, 3, 3, 5, 7, 9, 100] and got[0][1] is None
    assert numbered(spark.createDataFrame([], "v long"), "v").count() == 0
