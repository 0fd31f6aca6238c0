"""Filters over planes of any size, clips of any length, sources, displays and metrics, against plain versions."""

import math

import numpy as np
import pytest

from vireo.functions import displays as D
from vireo.functions.lookup import sensitivity_of, stand_in
from vireo.operators import linear as L
from vireo.operators import metrics as M
from vireo.operators import planes as P
from vireo.operators import reports as R
from vireo.operators import temporal as T
from vireo.operators import visibility as V
from vireo.sources import frames as S
from vireo.sources import rawvideo as raw

K = np.array(L.KERNEL)


def plain_reduce_axis(x, odd):
    """Rows of x smoothed and halved: zeros outside, then the mirrored samples added at both ends."""
    n = len(x)
    out = np.array([sum(K[k] * x[2 * o + k - 2] for k in range(5) if 0 <= 2 * o + k - 2 < n) for o in range(-(-n // 2))])
    out[0] += K[1] * x[0] + K[0] * x[1]
    out[-1] += K[3] * x[-1] + K[4] * x[-2] if odd else K[4] * x[-1]
    return out


def plain_expand_axis(x, n):
    z = np.zeros((n + 4, *x.shape[1:]))
    z[2:-2:2], z[0], z[-2 + n % 2] = x, x[0], x[-1]
    return np.array([2 * sum(K[k] * z[o + k] for k in range(5)) for o in range(n)])


def sized(rng, h, w):
    return rng.random((h, w))


@pytest.mark.parametrize("h", range(3, 40, 3))
def test_pyramids_of_any_size(h):
    rng = np.random.default_rng(h)
    for w in (3, 4, 17, 22, 39):
        x = rng.random((2, 2, h, w))
        want = plain_reduce_axis(plain_reduce_axis(x[1, 0], h % 2).T, h % 2).T
        assert np.allclose(P.reduce(x)[1, 0], want)
        assert np.allclose(P.expand(P.reduce(x), h, w)[1, 0], plain_expand_axis(plain_expand_axis(want, h).T, w).T)
        levels = int(np.log2(min(h, w)))
        assert np.allclose(P.reconstruct(P.laplacian(x, levels)), x)
        with pytest.raises(ValueError):
            P.gaussian(x, levels + 1)


def test_resizing_keeps_constants_and_lines():
    x = np.arange(12.0)[None, None, :, None] * np.ones((1, 1, 12, 9))
    for method in L.RESIZE:
        assert np.allclose(P.resize(np.ones((1, 1, 12, 9)), 7, 20, method), 1)
    assert np.allclose(P.resize(x, 6, 9, "area")[0, 0, :, 0], np.arange(6) * 2 + 0.5)
    assert np.allclose(P.resize(x, 24, 9, "bicubic")[0, 0, 6:18, 0], (np.arange(6, 18) + 0.5) / 2 - 0.5, atol=0.06)
    assert P.resize(x, 4, 9, "nearest")[0, 0, :, 0].tolist() == [0, 3, 6, 9]


def test_planes_of_mixed_sizes(spark):
    rng = np.random.default_rng(2)
    images = [(k, *s, rng.random(s).ravel().tolist()) for k, s in enumerate([(5, 7), (8, 6), (5, 7), (33, 12)])]
    df = spark.createDataFrame(images, "id long, h int, w int, v array<double>")
    got = {(r.id, r.band): np.array(r.v).reshape(r.h, r.w) for r in P.over_planes(df, lambda x: enumerate(P.laplacian(x, 2)), ["v"], keep=["id"]).collect()}
    for k, h, w, v in images:
        for band, want in enumerate(P.laplacian(np.array(v).reshape(1, 1, h, w), 2)):
            assert np.allclose(got[k, band], want[0, 0])
    back = P.reconstructed(P.over_planes(df, lambda x: enumerate(P.laplacian(x, 2)), ["v"], keep=["id"]), ["id"], "v")
    assert all(np.allclose(r.v, images[r.id][3]) for r in back.collect())
    samples = P.long(df, ["v"], ["id"])
    assert samples.count() == 35 + 48 + 35 + 396
    assert {(r.id, r.h, r.w): r.v for r in P.planes_of(samples, ["id"]).collect()} == {(k, h, w): v for k, h, w, v in images}
    assert P.filtered(df.where("false"), P.reduce, ["v"]).count() == 0
    with pytest.raises(Exception, match="h \\* w samples"):
        P.filtered(df.withColumn("h", df.h + 1), P.reduce, ["v"]).count()


def plain_channels(clip, fps, padding):
    """Filtered frames (frames, channels) of a clip of numbers."""
    n, out = len(clip), []
    for f in range(n):
        row = []
        for c in ("Ysust", "RG", "YV", "Ytrans"):
            taps = L.temporal_taps(fps, c)
            at = [(max(f - k, 0) if padding == "replicate" else L.reflected(f - k, n) if f - k < 0 else f - k) for k in range(len(taps))]
            row.append(sum(w * clip[i] for w, i in zip(taps, at)))
        out.append(row)
    return np.array(out)


@pytest.mark.parametrize("padding", T.PADDINGS)
def test_clips_longer_and_shorter_than_a_block(spark, padding):
    rng = np.random.default_rng(4)
    clips = {1: rng.random(150), 2: rng.random(3), 3: rng.random(1), 4: rng.random(64), None: rng.random(65)}
    rows = [(c, f, 1, 1, [float(v)], [float(1 - v)]) for c, clip in clips.items() for f, v in enumerate(clip)]
    df = spark.createDataFrame(rows, "clip long, frame int, h int, w int, t array<double>, r array<double>").repartition(5)
    got = {(r.clip, r.frame): [r[f"{s}{c}"][0] for s in "tr" for c in range(4)] for r in T.temporal_channels(df, 30, ["t", "r"], padding=padding).collect()}
    assert len(got) == sum(map(len, clips.values()))
    for c, clip in clips.items():
        want = np.concatenate([plain_channels(clip, 30, padding), plain_channels(1 - clip, 30, padding)], 1)
        assert np.allclose([got[c, f] for f in range(len(clip))], want)
    with pytest.raises(Exception, match="missing or there twice"):
        T.temporal_channels(df.where("frame <> 2"), 30, ["t", "r"]).count()
    assert T.temporal_channels(df.where("false"), 30, ["t", "r"]).count() == 0
    with pytest.raises(ValueError):
        T.temporal_channels(df, 30, ["t", "r"], padding="valid")


def test_common_rates():
    assert [T.resampled_rate(*p) for p in ((24, 60), (30, 48), (25, 50), (23.976, 24), (120, 60))] == [120, 166, 50, 166, 120]
    with pytest.raises(ValueError):
        T.resampled_rate(240, 24)


def test_bands():
    assert [len(V.band_frequencies(h, h, ppd)) for ppd in (75.4024493, 37.8425039) for h in (8, 64, 1080, 2160)] == [3, 6, 9, 9, 3, 6, 8, 8]
    assert np.allclose(V.band_frequencies(2160, 3840, 75.4024493)[:8], [37.7012, 12.17, 6.085, 3.0425, 1.5212, 0.7606, 0.3803, 0.1902], atol=1e-3)


def frames(spark, images, columns):
    return spark.createDataFrame([(k, 0, *x.shape[-2:], *(p.ravel().tolist() for p in x)) for k, x in images.items()], "clip long, frame int, h int, w int, " + ", ".join(f"{c} array<double>" for c in columns))


def test_scores(spark):
    """Identical sides score 10 in every model; stronger noise scores lower; nearer displays show more."""
    rng = np.random.default_rng(5)
    base, noise = rng.random((3, 40, 50)) * 0.5 + 0.2, rng.standard_normal((3, 40, 50))
    columns = [f"{s}{k}" for s in "tr" for k in range(3)]
    pairs = frames(spark, {k: np.concatenate([base + noise * s, base]) for k, s in enumerate((0, 0.02, 0.05, 0.1))}, columns)
    for masking in ("mult-mutual", "mult-transducer", "mult-transducer-texture", "add-mutual", "mult-none", "mult-mutual-old", "mult-perceptual"):
        got = {r.clip: r.value for r in M.visible_difference(pairs, masking=masking).collect()}
        assert got[0] == pytest.approx(10) and got[1] > got[2] > got[3], masking
    near, far = ({r.clip: r.value for r in M.visible_difference(pairs, ppd=p).collect()} for p in (20, 300))
    assert near[3] < far[3]
    got = {(r.clip, r.metric): r.value for r in M.evaluate(pairs, ["psnr_rgb", "ssim", "pu_psnr_y"]).collect()}
    assert got[0, "psnr_rgb"] == math.inf and got[0, "ssim"] == pytest.approx(1)
    x = np.concatenate([base + noise * 0.05, base])
    assert got[2, "psnr_rgb"] == pytest.approx(20 * math.log10(1 / np.sqrt(((x[:3] - x[3:]) ** 2).mean())))
    clip = pairs.withColumn("frame", pairs.clip.cast("int")).drop("clip").selectExpr("0 AS clip", "*")
    video = M.visible_difference(clip, fps=30).collect()
    assert len(video) == 1 and video[0].value < 10
    with pytest.raises(ValueError):
        next(V.contrast_bands(np.ones((1, 2, 8, 8)), 2, "other"))


def test_a_full_frame(spark):
    """One pair of 1080 x 1920: as many bands as its size and the display allow, and no shuffle before pooling."""
    rng = np.random.default_rng(6)
    x = rng.random((2, 1080, 1920)) * 100
    x[1] = x[0] + rng.random((1080, 1920)) * 5
    got = V.band_values(frames(spark, {1: x}, ["t", "r"]), ["t", "r"], ["clip"])
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    values = got.first().channels
    assert len(values) == 1 and len(values[0]) == 9 and all(math.isfinite(v) and v > 0 for v in values[0])


def test_sensitivity_from_json():
    held = stand_in()
    text = {"L_bkg": (10**held.log_l).tolist(), "rho": (10**held.log_rho).tolist(), "omega": [0, 5]} | {f"o{o}_c{c + 1}": held.tables[k, c].tolist() for k, o in enumerate((0, 5)) for c in range(1 if k else 3)}
    import json

    back = sensitivity_of(json.dumps(text))
    for c in range(4):
        log_l = np.array([-5.0, -1.3, 0.0, 2.71, 9.0])
        assert np.allclose(back.of(log_l, 3.3, c), held.of(log_l, 3.3, c))
    assert held.of(np.array([2.0]), 10**0.5, 0) > held.of(np.array([2.0]), 30, 0) > held.of(np.array([-2.0]), 30, 0)


def test_sources(spark, tmp_path):
    rng = np.random.default_rng(7)
    t = rng.integers(0, 256, (6, 5, 3, 2), dtype=np.uint8)
    rows = S.checked(S.array_source(spark, t, t[..., ::-1].copy(), "HWCF", 30), ["t0", "r2"]).collect()
    assert [(r.clip, r.frame, r.h, r.w) for r in rows] == [(0, 0, 6, 5), (0, 1, 6, 5)] and np.allclose(rows[1].t2, t[:, :, 2, 1].ravel() / 255) and np.allclose(rows[1].r0, t[:, :, 0, 0].ravel() / 255)
    packed = np.array([[0, -1, -32768, 32767]], np.int16)
    assert np.allclose(S.as_unit(packed), [[0, 1, 32768 / 65535, 32767 / 65535]])
    for bad in (lambda: S.array_source(spark, t, t, "HWCF"), lambda: S.array_source(spark, t, t[:5], "HWCF", 30), lambda: S.ordered(t, "HHCF")):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(TypeError):
        S.as_unit(np.zeros(3, np.int64))
    with pytest.raises(Exception, match="not a source"):
        S.checked(S.array_source(spark, t[:, :, :1, 0], t[:, :, :1, 0], "HWC").withColumn("h", raw.F.lit(9)), ["t0"]).count()


def test_images_and_sequences(spark, tmp_path):
    from py4j.java_gateway import java_import

    jvm = spark.sparkContext._jvm
    java_import(jvm, "java.awt.image.BufferedImage")
    for k in (0, 1, 3):
        picture = jvm.BufferedImage(4, 3, 1)
        for y in range(3):
            for x in range(4):
                picture.setRGB(x, y, (10 * k + x) << 16 | (50 + y) << 8 | 200)
        jvm.javax.imageio.ImageIO.write(picture, "png", jvm.java.io.File(f"{tmp_path}/f_{k:02d}.png"))
    got = {r.frame: r for r in S.read_frames(spark, f"{tmp_path}/f_%02d.png").collect()}
    assert sorted(got) == [0, 1] and (got[1].h, got[1].w) == (3, 4)
    assert np.allclose(np.array(got[1].v0).reshape(3, 4) * 255, [[10, 11, 12, 13]] * 3) and np.allclose(np.array(got[0].v1).reshape(3, 4)[:, 0] * 255, [50, 51, 52]) and np.allclose(got[0].v2, 200 / 255)
    assert S.read_frames(spark, f"{tmp_path}/f_03.png", keep=True).count() == 1
    with pytest.raises(ValueError):
        S.read_frames(spark, "x.mat")


def test_raw_video_to_rgb(spark, tmp_path):
    rng = np.random.default_rng(8)
    codes = rng.integers(16, 236, 3 * 72, dtype=np.uint8)
    (tmp_path / "a_8x6_8b_420_709_24fps.yuv").write_bytes(codes.tobytes())
    got = {r.frame: r for r in S.read_frames(spark, f"{tmp_path}/a_8x6_8b_420_709_24fps.yuv").collect()}
    y, u, v = (codes[72:144][a:b].astype(float) for a, b in ((0, 48), (48, 60), (60, 72)))
    y = np.clip(y.reshape(6, 8) / 219 - 16 / 219, 0, 1)
    u, v = (P.resize(np.clip(c.reshape(3, 4) / 224 - 128 / 224, -0.5, 0.5)[None, None], 6, 8)[0, 0] for c in (u, v))
    assert len(got) == 3 and np.allclose(np.array(got[1].v0).reshape(6, 8), np.clip(y + 1.5748 * v, 0, 1)) and np.allclose(np.array(got[1].v2).reshape(6, 8), np.clip(y + 1.8556 * u, 0, 1))
    cut = S.frame_range(S.read_frames(spark, f"{tmp_path}/a_8x6_8b_420_709_24fps.yuv"), first=1, frames=5)
    assert sorted(r.frame for r in cut.collect()) == [0, 1]


def test_pairs_must_fit(spark):
    rows = lambda h, fps, n: spark.createDataFrame([(1, f, h, 2, fps, [0.0] * (2 * h)) for f in range(n)], "clip long, frame int, h int, w int, fps double, v array<double>")
    assert S.paired(rows(3, 24.0, 4), rows(3, 24.0, 6), ["v"]).count() == 4
    for other in (rows(4, 24.0, 4), rows(3, 25.0, 4)):
        with pytest.raises(Exception, match="differ in size or frame rate"):
            S.paired(rows(3, 24.0, 4), other, ["v"]).count()


def test_displays(tmp_path, monkeypatch):
    for bad in ('{"x": {"resolution": [1, 1]}}', '{"x": {"resolution": [1, 1], "max_luminance": 1, "fov_horizontal": 1, "fov_vertical": 1}}'):
        with pytest.raises(ValueError):
            D.display_rows(bad)
    (tmp_path / "displays_own.json").write_text("{}")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "displays.json").write_text("{}")
    assert D.find_file("displays.json", [str(tmp_path / "displays_own.json")]).endswith("displays_own.json")
    assert D.find_file("displays.json", [str(tmp_path / "sub")]).endswith("sub/displays.json")
    monkeypatch.setenv("VIREO_CONFIG", str(tmp_path / "sub"))
    assert D.find_file("displays.json").endswith("sub/displays.json")
    with pytest.raises(FileNotFoundError):
        D.find_file("other.json")
    spaces = D.colour_spaces('{"a": {"EOTF": "PQ", "RGB2X": [1, 2, 3], "RGB2Y": [4, 5, 6], "RGB2Z": [7, 8, 9]}, "luminance": {"EOTF": "linear"}}')
    assert spaces == {"a": ("PQ", ((1, 2, 3), (4, 5, 6), (7, 8, 9))), "luminance": ("linear", None)}


def test_reports():
    rng = np.random.default_rng(9)
    flat = R.tone_mapped(np.full((4, 4), 3.0))
    assert np.allclose(flat, 0.2)
    wide = R.tone_mapped(rng.random((40, 40)) * 1000)
    assert wide.min() >= 0.2 - 1e-9 and wide.max() <= 0.8 + 1e-9
    picture = R.coloured(np.array([[[0.0, 0.15, 0.9]]]), None)
    assert picture.shape == (1, 3, 1, 3) and np.allclose(picture[0, :, 0, 1], 0.5 / 1.0001)
    import json

    assert len(json.loads(R.parameters("x"))["xcm_weights"]) == 16
