"""Displays by row, gaps and high frame rates, knots in tables, clocks, windows, feature files, dumps."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vireo.functions import displays as D
from vireo.functions import expressions as E
from vireo.operators import brackets, clock, regression
from vireo.operators import linear as L
from vireo.operators import metrics as M
from vireo.operators import planes as P
from vireo.operators import reports as R
from vireo.operators import temporal as T
from vireo.operators import visibility as V
from vireo.sources import frames as S
from vireo.sources import rawvideo

COLUMNS = [f"{s}{k}" for s in "tr" for k in range(3)]


def pairs(spark, n=6, seed=1, noise=0.05):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        base = rng.random((3, 12, 14)) * 0.6 + 0.2
        test = np.clip(base + noise * rng.standard_normal(base.shape), 0, 1)
        rows.append((k, 0, 12, 14, *(p.ravel().tolist() for p in (*test, *base))))
    return spark.createDataFrame(rows, "clip long, frame int, h int, w int, " + ", ".join(f"{c} array<double>" for c in COLUMNS))


def test_light_as_sql(spark):
    """Displays in numpy and as SQL expressions agree, with exposure and values out of range."""
    x = np.random.default_rng(2).random((1, 3, 4, 5)) * 1.4 - 0.2
    held = spark.createDataFrame([tuple(map(float, x[0, :, k // 5, k % 5])) for k in range(20)], "a double, b double, c double").withColumn("k", F.monotonically_increasing_id())
    for eotf, peak, ambient, exposure in (("sRGB", 200, 250, 1), ("sRGB", 100, 0, 2), ("PQ", 1500, 10, 1), ("PQ", 600, 10, 0.5), ("linear", 1500, 10, 900), ("HLG", 900, 10, 1), ("HLG", 1500, 10, 0.7), ("2.2", 300, 5, 1)):
        d = D.Display(peak=peak, contrast=1e4, ambient=ambient, exposure=exposure, eotf=eotf)
        sql = E.display_colours(("a", "b", "c"), peak=peak, contrast=1e4, ambient=ambient, eotf=eotf, exposure=exposure)
        got = np.array([[float(v) for v in r] for r in held.selectExpr(*(f"{e} AS x{k}" for k, e in enumerate(sql))).collect()])
        want = d.light(x)[0].reshape(3, 20).T
        assert np.allclose(np.sort(got, 0), np.sort(want, 0), rtol=1e-9), eotf
    assert D.Display(eotf="PQ", peak=1000, contrast=1000, ambient=0).light(np.zeros((1, 1, 1, 1))).item() == pytest.approx(1.005)
    with pytest.raises(ValueError):
        D.Display(primaries=None).to()


def test_displays_by_row(spark):
    held = pairs(spark).withColumn("display", F.element_at(F.array(*map(F.lit, ("standard_4k", "standard_hdr_pq", "standard_phone"))), (F.col("clip") % 3 + 1).cast("int")))
    names = ["psnr_rgb", "pu_psnr_y", "ssim", "visible_difference"]
    both = M.evaluate(held, names)
    assert both.columns == ["clip", "display", "metric", "value"]
    got = {(r.clip, r.metric): r.value for r in both.collect()}
    for k, name in enumerate(("standard_4k", "standard_hdr_pq", "standard_phone")):
        own = {(r.clip, r.metric): r.value for r in M.evaluate(pairs(spark).where(f"clip % 3 = {k}"), names, display=name).collect()}
        assert own and all(got[key] == pytest.approx(v) for key, v in own.items())
    # no display: the standard one; its name says the same
    plain, named = ({(r.clip, r.metric): r.value for r in M.evaluate(pairs(spark), names, **o).collect()} for o in ({}, {"display": "standard_4k"}))
    assert plain.keys() == named.keys() and all(plain[k] == pytest.approx(named[k], abs=1e-6) for k in plain)
    assert {r.value for r in M.evaluate(pairs(spark), ["visible_difference"], display="standard_hdr_pq").collect()} != {r.value for r in M.evaluate(pairs(spark), ["visible_difference"]).collect()}
    # clips: displays go through the filter over time
    clip = held.withColumn("frame", F.floor(F.col("clip") / 3).cast("int")).withColumn("clip", F.col("clip") % 3)
    video = {r.display: r.value for r in M.evaluate(clip, ["visible_difference"], fps=30).collect()}
    assert len(video) == 3 and len({round(v, 3) for v in video.values()}) == 3


def test_own_displays_and_errors(spark):
    held = pairs(spark, 2)
    own = D.display_table(spark, ['{"mine": {"resolution": [100, 100], "pixels_per_degree": 30, "max_luminance": 80, "colorspace": "wide"}}'])
    spaces = D.SPACES | D.colour_spaces('{"wide": {"EOTF": "1.8", "RGB2X": [0.8, 0.1, 0.1], "RGB2Y": [0.3, 0.6, 0.1], "RGB2Z": [0.0, 0.1, 0.9]}}')
    assert M.evaluate(held, ["visible_difference", "psnr_rgb"], display="mine", displays=own, spaces=spaces).count() == 4
    with pytest.raises(Exception, match="no colour space named wide"):
        M.evaluate(held, ["psnr_rgb"], display="mine", displays=own).count()
    with pytest.raises(Exception, match="no display named other"):
        M.evaluate(held, ["psnr_rgb"], display="other").count()
    with pytest.raises(TypeError, match="no options nonsense"):
        M.evaluate(held, ["psnr_rgb"], nonsense=1)
    with pytest.raises(TypeError, match="no options fps"):
        M.evaluate(held, ["psnr_rgb", "ssim"], fps=30)
    with pytest.raises(ValueError, match="no metric named other"):
        M.evaluate(held, ["psnr_rgb", "other"])

    @M.frame_metric("largest", "")
    def largest(t, r, display, scale: float = 1.0):
        return np.abs(t - r).max((1, 2, 3)) * scale

    one, two = (M.evaluate(held, ["largest"], **o).orderBy("clip").collect() for o in ({}, {"scale": 2.0}))
    assert [2 * r.value for r in one] == pytest.approx([r.value for r in two])
    del M.METRICS["largest"]


def test_one_pass_for_all_metrics(spark):
    plan = M.result_table(M.evaluate(pairs(spark), ["psnr_rgb", "ssim", "visible_difference"]), ["psnr_rgb", "ssim", "visible_difference"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("Exchange hashpartitioning") <= 2


def flat(spark, numbers, clip=1):
    return spark.createDataFrame([(clip, f, 1, 1, [float(f % 7)], [1.0]) for f in numbers], "clip long, frame int, h int, w int, t array<double>, r array<double>").repartition(4)


@pytest.mark.parametrize("lost", [range(50, 60), range(55, 56), range(56, 57), range(51, 64), range(63, 64), range(64, 65), range(65, 66), range(60, 72), range(0, 1), range(0, 64), range(0, 65)])
def test_no_frame_is_lost_around_a_border(spark, lost):
    kept = [f for f in range(100) if f not in lost]
    with pytest.raises(Exception, match="missing or there twice"):
        T.temporal_channels(flat(spark, kept), 30, ["t", "r"]).count()
    whole = T.temporal_channels(flat(spark, range(100)), 30, ["t", "r"])
    assert whole.count() == 100


@pytest.mark.parametrize("fps,padding", [(300, "replicate"), (300, "symmetric"), (600, "replicate"), (1000, "symmetric")])
def test_high_frame_rates(spark, fps, padding):
    n = 400
    got = {r.frame: r.t0[0] for r in T.temporal_channels(flat(spark, range(n)), fps, ["t", "r"], padding=padding).collect()}
    taps = L.temporal_taps(fps, "Ysust")
    at = lambda f: f if f >= 0 else 0 if padding == "replicate" else L.reflected(f, n)
    assert len(got) == n and all(got[f] == pytest.approx(sum(w * float(at(f - k) % 7) for k, w in enumerate(taps))) for f in (0, 1, 5, 63, 64, 130, n - 1))


def test_frames_without_number(spark):
    with pytest.raises(Exception, match="no number"):
        T.temporal_channels(flat(spark, range(3)).withColumn("frame", F.when(F.col("frame") < 2, F.col("frame"))), 30, ["t", "r"]).count()


@pytest.mark.parametrize("above", [True, False])
def test_knots_in_tables(spark, above):
    rng = np.random.default_rng(3)
    knots = {c: sorted(set(rng.integers(0, 50, n).tolist())) for c, n in ((1, 9), (2, 1), (3, 2), (4, 40))}
    table = [(c, float(k), float(rng.random()), float(rng.random())) for c, ks in knots.items() for k in ks] + [(1, None, 5.0, 5.0)]
    values = [(i, int(rng.integers(1, 6)), float(rng.integers(-5, 60)) + float(rng.integers(0, 2)) / 2) for i in range(300)] + [(900, 1, None), (901, 1, float(knots[1][0])), (902, 1, float(knots[1][-1])), (901, 1, float(knots[1][0]))]
    rows = spark.createDataFrame(values, "i long, c long, x double").repartition(3)
    made = brackets.looked_up(rows, spark.createDataFrame(table, "c long, k double, a double, b double").repartition(2), "x", "k", ["a", "b"], ["c"], above)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    got = sorted(((r.i, r.a, r.b) for r in made.collect()), key=str)

    def plain(c, x, v):
        own = sorted((r for r in table if r[0] == c and r[1] is not None), key=lambda r: r[1])
        if not own or x is None:
            return None
        k = next((j for j, r in enumerate(own) if r[1] >= x), None)
        if k == 0 or len(own) == 1 or (k is None and not above):
            return own[0 if k == 0 else -1][v]
        k = len(own) - 1 if k is None else k
        p, q = own[k - 1], own[k]
        return p[v] + (x - p[1]) * (q[v] - p[v]) / (q[1] - p[1] + 1e-6)

    want = sorted(((i, plain(c, x, 2), plain(c, x, 3)) for i, c, x in values), key=str)
    assert len(got) == len(want) and all(g[0] == w[0] and all(a is b is None or a == pytest.approx(b) for a, b in zip(g[1:], w[1:])) for g, w in zip(got, want))


def test_knots_without_key_equal_literals(spark):
    from vireo.functions.lookup import interp

    ks, vs = [0.0, 0.1, 0.35, 0.7], [0.2, 1.0, 0.4, 2.0]
    rows = spark.range(200).selectExpr("id", "id / 180e0 - 5e-2 AS x")
    both = brackets.looked_up(rows, spark.createDataFrame(list(zip(ks, vs)), "k double, y double"), "x", "k", ["y"]).withColumn("z", F.expr(interp("x", ks, vs)))
    assert both.count() == 200 and both.where("abs(y - z) > 1e-9").count() == 0


def test_clock(spark):
    rates = {1: (24, 30), 2: (30, 48), 3: (23.976, 24), 4: (60, 60), 5: (1, 50), 6: (25, 25)}
    sides = {(c, s): list(range({5: (3, 160)}.get(c, (40, 55))[s])) for c in rates for s in (0, 1)}
    sides[6, 1].remove(7)
    df = lambda s: spark.createDataFrame([(c, f, float(rates[c][s]), f * 10.0 + s) for (c, k), fs in sides.items() if k == s for f in fs], "clip long, frame long, fps double, v double").repartition(3)
    got = sorted((r.clip, r.frame, r.rate, r.test_frame, r.reference_frame, r.t0, r.r0) for r in clock.on_one_clock(df(0), df(1), ["v"]).collect())
    want = []
    for c, (a, b) in rates.items():
        rate = T.resampled_rate(a, b)
        n = min(int(math.floor((max(sides[c, s]) + 1) * rate / rates[c][s] + 1e-6)) for s in (0, 1))
        for i in range(n):
            f = [int(math.floor((i + 0.5) * rates[c][s] / rate + 1e-6)) for s in (0, 1)]
            if all(f[s] in sides[c, s] for s in (0, 1)):
                want.append((c, i, rate, *f, f[0] * 10.0, f[1] * 10.0 + 1))
    assert got == sorted(want)
    with pytest.raises(Exception, match="can't be resampled"):
        clock.on_one_clock(df(0).withColumn("fps", F.lit(200.0)), df(1), ["v"]).count()


@pytest.mark.parametrize("width", [1, 2, 3, 5, 7, 8, 13, 39, 40])
def test_windows_of_any_width(width):
    x = np.random.default_rng(width).random((2, 3, 23, 31)) + 1000
    mean, var = P.window_moments(x, width)
    assert mean.shape == (2, 3, -(-23 // width), -(-31 // width))
    for y in range(mean.shape[2]):
        for z in range(mean.shape[3]):
            part = x[:, :, y * width : (y + 1) * width, z * width : (z + 1) * width]
            assert np.allclose(mean[:, :, y, z], part.mean((2, 3))) and np.allclose(var[:, :, y, z], part.var((2, 3)), atol=1e-9)


def test_patches():
    x = np.random.default_rng(5).random((2, 6, 40, 50)) * 50 + 20
    made = dict(V.Model(ppd=7.3).patches(x))
    assert made[0].shape == (2, 18, 5, 7) and all(np.isfinite(v).all() for v in made.values())
    same = np.concatenate([x[:, :3], x[:, :3]], 1)
    assert np.allclose(dict(V.Model(ppd=7.3).patches(same))[0].reshape(2, 3, 6, 5, 7)[:, :, 4:], 0, atol=1e-4)


def test_feature_files_of_the_common_layout(spark):
    """A file written elsewhere: keys at the top level, two batches, further keys."""
    text = json.dumps({"rho_band": [37.7, 12.1, 0.1], "frames_per_second": 30.0, "width": 1920, "height": 1080, "N_frames": 2, "t0_b0": [[1.0, 2.0], [3.0, 4.0]], "t3_b10": [[5.5, 6.0], [7.0, 8.0]], "t0_bx": [1]}, indent=4)
    rows = spark.createDataFrame([("a", text), ("b", '{"N_frames": 0}'), ("c", None)], "clip string, features string")
    got = {(r.clip, r.batch, r.channel, r.band, r.frame): r.q for r in R.read_features(rows).collect()}
    assert got == {("a", b, c, k, f): v for c, k, vs in ((0, 0, [[1, 2], [3, 4]]), (3, 10, [[5.5, 6], [7, 8]])) for b, own in enumerate(vs) for f, v in enumerate(own)}
    about = {r.clip: r for r in R.read_about(rows).collect()}
    assert about["a"].rho_band == [37.7, 12.1, 0.1] and about["a"].width == 1920 and about["a"].N_frames == 2 and about["b"].width is None and about["c"].N_frames is None
    values = spark.createDataFrame([(1, f, [[f + 0.5, 2.0], [3.0, f * 1.0]], 24.0) for f in (1, 0)], "clip long, frame int, channels array<array<double>>, frames_per_second double")
    written = json.loads(R.features_json(values, about=["frames_per_second"]).first().features)
    assert written == {"frames_per_second": 24.0, "N_frames": 2, "t0_b0": [[0.5, 1.5]], "t0_b1": [[2.0, 2.0]], "t1_b0": [[3.0, 3.0]], "t1_b1": [[0.0, 1.0]]}


def test_dark_pictures_and_dumps():
    assert np.array_equal(R.tone_mapped(np.zeros((3, 4))), np.full((3, 4), 0.2)) and np.array_equal(R.tone_mapped(np.full((2, 2), -1.0)), np.full((2, 2), 0.2))
    x = np.array([[0.0, 1.0], [2.0, -3.0]])
    assert np.isfinite(R.tone_mapped(x)).all() and R.tone_mapped(x)[0, 0] == R.tone_mapped(x)[0, 1]
    bands = [np.full((1, 4, 3, h, w), k + 1.0) + np.arange(4)[None, :, None, None, None] * 10 for k, (h, w) in enumerate(((9, 12), (5, 6), (3, 3), (2, 2)))]
    made = R._mosaic(bands, 0.5)
    assert made.shape == (1, 3, 24, 40)
    for q in range(4):
        part = made[0, 0, q // 2 * 12 :, q % 2 * 20 :]
        corners = [part[y, x] for y, x in ((0, 0), (0, 13), (6, 13), (6, 17))]  # right by 13, down by 6, right by 4
        assert corners == [1 + 10 * q, 2 + 10 * q, 3 + 10 * q, 4 + 10 * q] and part[0, 12] == 0.5 and part[8, 0] == 1 + 10 * q
    assert sum((made[0, 0] == v).sum() for v in (1, 11, 21, 31)) == 4 * 9 * 12


def test_previews(spark):
    held = pairs(spark, 2)
    for kind, (linear, beside) in R.PREVIEWS.items():
        row = R.previews(held, kind).first()
        assert (row.h, row.w) == ((24, 14) if beside else (12, 14))
        lit = row.red if beside else row.test_red
        assert (max(lit) > 1) == linear


def test_packed_frames(spark):
    rng = np.random.default_rng(6)
    y, u, v = rng.integers(16, 235, 24), rng.integers(16, 240, 6), rng.integers(16, 240, 6)
    rows = spark.createDataFrame([(1, [2.0, 4.0, 6.0, 8.0, 420.0, 8.0, 12.0, *map(float, [*y, *u, *v, *y, *u, *v])])], "k long, packed array<double>")
    made = S.unpacked(rows, "packed", ["k"], yuv=True).collect()
    assert [(r.frame, r.h, r.w) for r in made] == [(0, 8, 12), (1, 8, 12)] and made[0].v0 == made[1].v0
    raw = spark.createDataFrame([("p", 0, 6, 4, 8, "420", "709", *(bytearray(x.astype(np.uint8).tobytes()) for x in (y, u, v)))], "path string, frame int, width int, height int, bits int, chroma string, space string, luma binary, u binary, v binary")
    assert np.allclose(P.resize(np.array(S.rgb_frames(raw).first().v0).reshape(4, 6), 8, 12), np.array(made[0].v0).reshape(8, 12))
    with pytest.raises(Exception, match="header says"):
        S.unpacked(rows.withColumn("packed", F.slice("packed", 1, 50)), "packed", ["k"], yuv=True).count()


def test_probe(spark, tmp_path):
    (tmp_path / "a_8x6_8b_420_709_23.976fps.yuv").write_bytes(bytes(72 * 5 + 1))
    (tmp_path / "other.txt").write_bytes(b"x")
    row = rawvideo.probed(spark, str(tmp_path)).collect()
    assert [(r.frames, r.width, r.fps, r.cut) for r in row] == [(5, 8, 23.976, True)]


def test_least_squares(spark):
    rng = np.random.default_rng(7)
    x, m = rng.random((50, 3)), rng.random((2, 3))
    rows = spark.createDataFrame([(*map(float, a), *map(float, a @ m.T)) for a in x] + [(None, 1.0, 1.0, 1.0, 1.0)], "a double, b double, c double, p double, q double").repartition(3)
    assert np.allclose(regression.least_squares(rows, ["a", "b", "c"], ["p", "q"]), m)
    with pytest.raises(ValueError):
        regression.least_squares(rows.where("false"), ["a"], ["p"])
