"""Queries over sources, displays and metrics: geometry of displays, colour frames, raw video, pairing, resampling, result tables."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vireo.functions import displays as D
from vireo.functions import expressions as E
from vireo.operators import linear as L
from vireo.operators import metrics as M
from vireo.operators import planes as P
from vireo.operators import reports as R
from vireo.operators import temporal as T
from vireo.operators import visibility as V
from vireo.operators.calibration import condition_id
from vireo.plans import image_queries as I
from vireo.plans import pixel_queries as PX
from vireo.plans.signal_queries import _SEQUENCE
from vireo.sources import frames as S
from vireo.sources import rawvideo, signals
from vireo.streaming import frames as stream
from vireo.streaming import jobs

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
num = E.num


def _sql(name: str, sql: str, *tables: str, oracle: str | None = None) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        signals.views(spark, sf_dir, *tables)
        return spark.sql(sql)

    QUERIES[name], ORACLES[name] = query, oracle or sql


# Displays ---------------------------------------------------------------------------------------------------------

#: Displays described in each other way that is allowed.
FURTHER = """{"wide": {"resolution": [2560, 1080], "viewing_distance_heights": 3, "diagonal_size_inches": 34, "max_luminance": 350},
"across": {"resolution": [2000, 1500], "fov_horizontal": 90, "max_luminance": 120, "min_luminance": 0.2, "E_ambient": 5},
"upright": {"resolution": [1800, 2000], "fov_vertical": 95, "viewing_distance_meters": 2, "max_luminance": 90, "k_refl": 0.01},
"fixed": {"resolution": [1280, 720], "pixels_per_degree": 40, "max_luminance": 600, "contrast": 5000, "colorspace": "BT.2020-PQ"}}"""
_ROWS = D.preset_rows() + D.display_rows(FURTHER)
_GEOMETRY = ", ".join(f"round({e}, 6) AS {c}" for c, e in (D.GEOMETRY | D.PHOTOMETRY).items())


def display_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Geometry and photometry of every preset and of displays from JSON."""
    return D.display_table(spark, [FURTHER]).selectExpr("display", *_GEOMETRY.split(", round")[:1], *("round" + x for x in _GEOMETRY.split(", round")[1:]))


QUERIES["display_models"], ORACLES["display_models"] = display_models, f"SELECT display, {_GEOMETRY} FROM {D.values_sql(_ROWS)}"


def display_eccentricity(spark: SparkSession, sf_dir: str) -> DataFrame:
    angles = spark.range(0, 60, 10).selectExpr("CAST(id AS DOUBLE) AS angle")
    return D.display_table(spark, [FURTHER]).join(F.broadcast(angles)).selectExpr("display", "angle", f"round({D.ppd_at('angle')}, 6) AS ppd")


QUERIES["display_eccentricity"] = display_eccentricity
ORACLES["display_eccentricity"] = f"SELECT display, angle, round({D.ppd_at('angle')}, 6) AS ppd FROM {D.values_sql(_ROWS)}, (SELECT CAST(unnest(range(0, 60, 10)) AS DOUBLE) AS angle) AS a"
#: Mean light of the pixels of each pair on each encoded display.  Light is linear in the shaped values, so these are averaged first.
_SWEEP = f"SELECT pair, display, round((peak - peak / contrast) * shaped + peak / contrast + ambient / {num(np.pi)} * reflectivity, 4) AS light FROM (SELECT pair, avg({E.srgb_to_linear('t')}) AS shaped FROM ({PX._rows}) AS p GROUP BY pair) AS a CROSS JOIN {{displays}} WHERE colorspace = 'sRGB'"
_SWEEP_SQL = f"SELECT pair, display, round(avg((peak - peak / contrast) * {E.srgb_to_linear('t')} + peak / contrast + ambient / {num(np.pi)} * reflectivity), 4) AS light FROM ({PX._rows}) AS p CROSS JOIN {{displays}} WHERE colorspace = 'sRGB' GROUP BY pair, display"


def display_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    signals.views(spark, sf_dir, "lineitem")
    D.display_table(spark).createOrReplaceTempView("vireo_displays")
    return spark.sql(_SWEEP.format(displays="vireo_displays"))


QUERIES["display_sweep"], ORACLES["display_sweep"] = display_sweep, _SWEEP_SQL.format(displays=D.values_sql(D.preset_rows()))
_PQ, _LINEAR = {"peak": 1500, "contrast": 1e6, "ambient": 10, "eotf": "PQ"}, {"peak": 1500, "contrast": 1e6, "ambient": 10, "eotf": "linear"}
for _target in ("display_encoded_01", "display_encoded_100nit", "display_encoded_dmax"):
    PX._scalar(f"{_target}_by_display", sdr=D.encoded("t", _target, {"peak": 200}), pq=D.encoded("t", _target, _PQ), linear=D.encoded("(t * 900e0)", _target, _LINEAR))

# Further colour and masking functions -----------------------------------------------------------------------------

_LMS = E.matrix(E.folded(E.XYZ_TO_LMS, PX.xyz), PX.light)
PX._scalar("color_log_dkl", **dict(zip(("ay", "rg", "yv"), E.matrix(E.LMS_TO_DKL, [f"log10(greatest({x}, 1e-12))" for x in _LMS]))))
# RGB of BT.2020 to the cone space of ITP, and codes of its cones to intensity and the two chroma axes.
TO_CONES = ((1688 / 4096, 2146 / 4096, 262 / 4096), (683 / 4096, 2951 / 4096, 462 / 4096), (99 / 4096, 309 / 4096, 3688 / 4096))
TO_ITP = ((0.5, 0.5, 0.0), (6610 / 4096, -13613 / 4096, 7003 / 4096), (17933 / 4096, -17390 / 4096, -543 / 4096))
_cones = [E.pq_encode(f"greatest({x}, 0e0)") for x in E.matrix(E.folded(TO_CONES, E.XYZ_TO_RGB2020, PX.xyz), PX.light)]
PX._scalar("color_itp", **dict(zip(("i", "tritan", "protan"), E.matrix(TO_ITP, _cones))))
PX._scalar("rgb_to_ycbcr", **dict(zip(("luma", "cb", "cr"), E.matrix(np.linalg.inv(np.array(E.YCBCR_TO_RGB["bt709"], float)), PX.V))))
PX._scalar("clamp_per_channel", **{f"d{c}": E.clamp_difference("(q * 1000e0)", "soft", 2 + 0.2 * c) for c in range(4)})
_least = "least(1e0 / (1e1 * q + 1e0), 1.99e0)"
_over = lambda gain: f"greatest({E.pow_even(f'((t - {_least}) / (2e0 - {_least}))', 0.7)} * {num(gain)} + 1e0, 0e0)"
PX._scalar("over_constancy", **{f"c{k}": _over(g) for k, g in enumerate((10.0, 14.0, 2.1, 10.0))})
_pooled = lambda cc: "(" + " + ".join(f"{num(2 ** V.CROSS[k][cc])} * {_over(g)}" for k, g in enumerate((10.0, 14.0, 2.1, 10.0))) + ")"
PX._scalar("over_constancy_masked", 4, **{f"d{k}": f"(2e0 * {E.pow_even(_over(g), V.MASK_P)} / (1e0 + pow({_pooled(k)}, {num(V.MASK_Q[k])})))" for k, g in enumerate((10.0, 14.0, 2.1, 10.0))})
PX._scalar("local_contrast", ct="(t / greatest(q, 1e-2))", cr="(r / greatest(q, 1e-2))")
_hat = lambda x, k, knots: "(CASE " + (f"WHEN {x} <= {num(knots[k])} THEN " + ("1e0" if k == 0 else f"greatest(({x} - {num(knots[k - 1])}) / {num(knots[k] - knots[k - 1])}, 0e0)")) + " ELSE " + ("1e0" if k == len(knots) - 1 else f"greatest(({num(knots[k + 1])} - {x}) / {num(knots[k + 1] - knots[k])}, 0e0)") + " END)"
_GRID = [[0.1, 0.3, 0.9], [0.0, 0.4, 0.8], [0.2, 0.5, 1.0]]
PX._scalar("interp3_grid", y="(" + " + ".join(f"{num(np.sin(i + 2 * j + 3 * k))} * {_hat('t', i, _GRID[0])} * {_hat('r', j, _GRID[1])} * {_hat('q', k, _GRID[2])}" for i in range(3) for j in range(3) for k in range(3)) + ")")
_variants = " UNION ALL ".join(f"SELECT '{kind}' AS kind, {fps} AS fps, {k} AS tap, round({num(w)}, 6) AS w" for kind in ("high_pass", "gradient") for fps in (24, 60) for k, w in enumerate(L.temporal_taps(fps, "Ytrans", kind)))
_sql("temporal_taps_variants", _variants)

# Colour frames: 4 x 5 samples of three planes from each vector --------------------------------------------------------

_UNIT = "transform(slice(embedding, {at}, 20), e -> least(greatest(5e-1 + CAST(e AS DOUBLE), 0e0), 1e0))"
_COLOUR = "SELECT vec_id AS clip, 0 AS frame, 4 AS h, 5 AS w, " + ", ".join(f"{_UNIT.format(at=1 + 20 * k)} AS v{k}" for k in range(3)) + " FROM embeddings WHERE size(embedding) >= 60"
_COLOUR_SQL = "SELECT vec_id, CAST(i // 5 AS INTEGER) AS y, CAST(i % 5 AS INTEGER) AS x, " + ", ".join(f"least(greatest(5e-1 + CAST(embedding[i + {1 + 20 * k}] AS DOUBLE), 0e0), 1e0) AS v{k}" for k in range(3)) + " FROM embeddings, range(20) AS g(i) WHERE len(embedding) >= 60"
_PAIR_SQL = f"WITH c AS ({_COLOUR_SQL}), p AS (SELECT a.vec_id, a.y, a.x, {', '.join(f'a.v{k} AS t{k}, b.v{k} AS r{k}' for k in range(3))} FROM c a JOIN c b ON b.vec_id = a.vec_id + 1 AND a.y = b.y AND a.x = b.x)"


def colour_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    signals.views(spark, sf_dir, "embeddings")
    source = S.checked(spark.sql(_COLOUR), S.RGB)
    return S.paired(source, source.withColumn("clip", F.col("clip") - 1), S.RGB)


_NAMES = ["psnr_rgb", "pu_psnr_y", "pu_psnr_rgb2020", "ssim"]
_side = lambda s: [E.display_forward(f"{s}{k}") for k in range(3)]
_rgb2020 = lambda s: E.matrix(E.folded(E.XYZ_TO_RGB2020, PX.xyz), _side(s))
_square = lambda a, b: f"pow({a} - {b}, 2e0)"
_PU100 = num(float(M.pu(np.array(100.0))))
_luma = lambda s: "(" + " + ".join(f"{num(k)} * {s}{c}" for c, k in enumerate(E.LUMA)) + ")"
_W4, _W5 = L.gaussian_weights(4, 1.5, 11), L.gaussian_weights(5, 1.5, 11)
_SIMILAR = "(2e0 * mt * mr + 1e-4) * (2e0 * (tr - mt * mr) + 9e-4) / ((mt * mt + mr * mr + 1e-4) * (tt - mt * mt + rr - mr * mr + 9e-4))"
_METRICS_SQL = f"""{_PAIR_SQL}, e AS (SELECT vec_id, avg(({' + '.join(_square(f't{k}', f'r{k}') for k in range(3))}) / 3e0) AS rgb,
  avg({_square(E.matrix(PX.xyz, _side('t'))[1], E.matrix(PX.xyz, _side('r'))[1])}) AS y, avg(({' + '.join(_square(a, b) for a, b in zip(_rgb2020('t'), _rgb2020('r')))}) / 3e0) AS wide FROM p GROUP BY vec_id),
l AS (SELECT vec_id, y, x, {_luma('t')} AS t, {_luma('r')} AS r FROM p), mo AS (SELECT vec_id, y, x, t AS mt, r AS mr, t * t AS tt, r * r AS rr, t * r AS tr FROM l),
s AS (SELECT vec_id, avg({_SIMILAR}) AS ssim FROM {L.separable_sql('mo', _W4, _W5, values=('mt', 'mr', 'tt', 'rr', 'tr'))} AS z GROUP BY vec_id),
v AS (SELECT vec_id AS clip, 20e0 * log10(1e0 / sqrt(rgb)) AS psnr_rgb, 20e0 * log10({_PU100} / sqrt(y)) AS pu_psnr_y, 20e0 * log10({_PU100} / sqrt(wide)) AS pu_psnr_rgb2020, ssim FROM e JOIN s USING (vec_id))"""


def metric_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All metrics with a published definition over all colour pairs, one column each."""
    made = M.result_table(M.evaluate(colour_pairs(spark, sf_dir), _NAMES), _NAMES)
    return made.select("clip", *(F.round(n, 5).alias(n) for n in _NAMES))


def metric_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table written as CSV and read back."""
    at = f"{stream._folder(spark)}/results"
    M.write_results(M.evaluate(colour_pairs(spark, sf_dir), ["psnr_rgb", "ssim"]), ["psnr_rgb", "ssim"], at)
    back = spark.read.option("header", True).schema("clip long, psnr_rgb double, ssim double").csv(at)
    return back.select("clip", F.round("psnr_rgb", 5).alias("psnr_rgb"), F.round("ssim", 5).alias("ssim"))


QUERIES |= {"metric_table": metric_table, "metric_csv": metric_csv}
ORACLES |= {
    "metric_table": f"{_METRICS_SQL} SELECT clip, {', '.join(f'round({n}, 5) AS {n}' for n in _NAMES)} FROM v",
    "metric_csv": f"{_METRICS_SQL} SELECT clip, round(psnr_rgb, 5) AS psnr_rgb, round(ssim, 5) AS ssim FROM v",
}
QUERIES["metric_lines"] = lambda spark, sf_dir: M.result_lines(M.evaluate(colour_pairs(spark, sf_dir), ["psnr_rgb", "ssim"]))
ORACLES["metric_lines"] = f"{_METRICS_SQL} SELECT clip, printf('psnr_rgb=%.4f [dB]', psnr_rgb) AS line FROM v UNION ALL SELECT clip, printf('ssim=%.4f', ssim) FROM v"


#: Displays of each kind, and what values are multiplied by: linear content is in cd/m2.
KINDS = {"standard_4k": 1, "standard_hdr_pq": 1, "standard_hdr_hlg": 1, "standard_hdr_linear": 900}
_SCORED = ["psnr_rgb", "pu_psnr_y", "visible_difference"]


def scaled_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colour pairs for each kind of display, in the values that it takes."""
    pairs = colour_pairs(spark, sf_dir).select("*", F.inline(F.array(*(F.struct(F.lit(k).alias("display"), F.lit(float(m)).alias("most")) for k, m in KINDS.items()))))
    return pairs.withColumns({f"{s}{k}": F.expr(f"transform({s}{k}, v -> v * most)") for s in "tr" for k in range(3)}).drop("most")


def display_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colour pairs scored on displays with standard, PQ, HLG and linear content; each row's display comes from the table of displays."""
    made = M.result_table(M.evaluate(scaled_pairs(spark, sf_dir), _SCORED), _SCORED)
    return made.select("clip", "display", *(F.round(n, 4).alias(n) for n in _SCORED))


def _display_scores_sql() -> str:
    rows = {r[0]: dict(zip([f.split()[0] for f in D.SCHEMA.split(", ")], r)) for r in D.preset_rows()}
    lit, coded, ppd = [], [], []
    for k, (name, most) in enumerate(KINDS.items()):
        d = rows[name]
        eotf, primaries = D.SPACES[d["colorspace"]]
        photometry = {f: d[f] for f in ("peak", "contrast", "ambient", "reflectivity", "exposure")} | {"eotf": eotf}
        side = lambda s: E.display_colours([f"({s}{c} * {num(most)})" for c in range(3)], **photometry)
        dkl = lambda s: E.matrix(E.folded(E.LMS_TO_DKL, E.XYZ_TO_LMS, primaries), side(s))
        lit.append(f"SELECT vec_id * 4 + {k} AS vec_id, y, x, {', '.join(f'{e} AS {s}{c}' for s in 'tr' for c, e in enumerate(dkl(s)))} FROM p")
        code = lambda v, e: f"({E.pu_encode(e)} / {E.pu_encode('1e2')})" if eotf in ("PQ", "linear") else f"({v} * {num(most)})"
        rgb = " + ".join(_square(*(code(f"{s}{c}", side(s)[c]) for s in "tr")) for c in range(3))
        coded.append(f"SELECT vec_id * 4 + {k} AS vec_id, avg(({rgb}) / 3e0) AS rgb, avg({_square(*(E.matrix(primaries, side(s))[1] for s in 'tr'))}) AS lum FROM p GROUP BY vec_id")
        ppd.append(float(E_PPD[name]))
    held = two_bands_sql(4, 5, 3, *(V.band_frequencies(4, 5, p) for p in ppd))
    return f"""{_PAIR_SQL}, g0 AS ({' UNION ALL '.join(lit)}), codes AS ({' UNION ALL '.join(coded)}), {held},
s AS (SELECT vec_id, q * {num(V.IMAGE)} AS q FROM f), names AS (SELECT * FROM (VALUES {', '.join(f"({k}, '{name}')" for k, name in enumerate(KINDS))}) AS n(k, display))
SELECT vec_id // 4 AS clip, display, round(20e0 * log10(1e0 / sqrt(rgb)), 4) AS psnr_rgb, round(20e0 * log10({_PU100} / sqrt(lum)), 4) AS pu_psnr_y, round({E.jod('q')}, 4) AS visible_difference
FROM s JOIN codes USING (vec_id) JOIN names ON k = vec_id % 4"""


def two_bands_sql(h: int, w: int, channels: int, *rho: list[float]) -> str:
    """g1 to f(vec_id, q): pooled differences from g0(vec_id, y, x, t0.., r0..) of planes that have two bands; with several lists of
    frequencies, that of vec_id modulo their number."""
    planes = tuple(f"{s}{c}" for s in "tr" for c in range(channels))
    sense = lambda c: "(CASE " + " ".join(f"WHEN vec_id % {len(rho)} = {k} AND band = {b} THEN {V.Model().sensitivity.sql('lb', f, c)}" for k, own in enumerate(rho) for b, f in enumerate(own)) + " END)"
    scaled = lambda s, c: f"({s}{c} * s{c} * {num(V.GAIN[c])})"
    masking = lambda cc: "(" + " + ".join(f"{num(2 ** V.CROSS[c][cc])} * {E.safe_pow(f'(least(abs({scaled('t', c)}), abs({scaled('r', c)})) * {num(10**V.MASK_C)})', V.MASK_Q[c])}" for c in range(channels)) + ")"
    differ = lambda c: f"(CASE WHEN band = 1 THEN abs(t{c} - r{c}) * s{c} ELSE {E.clamp_difference(f'({E.safe_pow(f'abs({scaled('t', c)} - {scaled('r', c)})', V.MASK_P)} / (1e0 + {masking(c)}))')} END)"
    pooled = ", ".join(f"{E.safe_pow(f'(sum({E.safe_pow(f'd{c}', 2)}) / count(*))', 0.5)} * {num(V.CHANNEL_WEIGHT[c])} * CASE WHEN band = 1 THEN {num(V.BASEBAND[c])} ELSE 1e0 END AS q{c}" for c in range(channels))
    bands = " + ".join(E.safe_pow(E.safe_pow(f"sum({E.safe_pow(f'q{c}', 4)})", 0.25), 4) for c in range(channels))
    e0 = L.separable_sql("g1", L.expand_weights(-(-h // 2), h), L.expand_weights(-(-w // 2), w), values=planes)
    return f"""g1 AS (SELECT * FROM {L.separable_sql('g0', L.reduce_weights(h), L.reduce_weights(w, bool(h % 2)), values=planes)} AS z), e0 AS (SELECT * FROM {e0} AS z),
mean AS (SELECT vec_id, avg(greatest(t0, 1e-2)) AS mt, avg(greatest(r0, 1e-2)) AS mr FROM g1 GROUP BY vec_id),
con AS (SELECT vec_id, 0 AS band, log10(greatest(e0.r0, 1e-2)) AS lb, {', '.join(f'least((g0.{p} - e0.{p}) / greatest(e0.{p[0]}0, 1e-2), 1e3) AS {p}' for p in planes)} FROM g0 JOIN e0 USING (vec_id, y, x)
  UNION ALL SELECT vec_id, 1, log10(mr), {', '.join(f'least({p} / m{p[0]}, 1e3)' for p in planes)} FROM g1 JOIN mean USING (vec_id)),
sen AS (SELECT *, {', '.join(f'{sense(c)} AS s{c}' for c in range(channels))} FROM con), dif AS (SELECT vec_id, band, {', '.join(f'{differ(c)} AS d{c}' for c in range(channels))} FROM sen),
b AS (SELECT vec_id, band, {pooled} FROM dif GROUP BY vec_id, band), f AS (SELECT vec_id, {E.safe_pow(f'({bands})', 0.25)} AS q FROM b GROUP BY vec_id)"""


#: Pixels a degree of the standard displays, which share their geometry.
E_PPD = dict.fromkeys(KINDS, 75.40244934516303)
QUERIES["display_scores"], ORACLES["display_scores"] = display_scores, _display_scores_sql()


def display_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides as they look on the display, in codes of a PQ display, side by side along the shorter axis."""
    return I._samples(R.previews(colour_pairs(spark, sf_dir), "dm_preview_sbs"), ["red", "green", "blue"], ["clip"], 5)


_codes = lambda s: [E.pq_encode(x) for x in _rgb2020(s)]
QUERIES["display_preview"] = display_preview
ORACLES["display_preview"] = f"{_PAIR_SQL} " + " UNION ALL ".join(f"SELECT vec_id AS clip, y + {4 * k} AS y, x, {', '.join(f'round({e}, 5) AS {n}' for n, e in zip(('red', 'green', 'blue'), _codes(s)))} FROM p" for k, s in enumerate("tr"))

# Raw video: frames of 8 x 8 samples with half as many chroma samples an axis, made of each vector as bytes -----------

_byte = lambda n, low, high: f"unhex(array_join(transform(slice(embedding, 1, {n}), e -> lpad(hex(CAST(floor({low} + least(greatest(5e-1 + CAST(e AS DOUBLE), 0e0), 1e0) * {high}) AS BIGINT)), 2, '0')), ''))"
_RAW = f"SELECT CAST(vec_id AS STRING) AS path, 0 AS frame, 8 AS width, 8 AS height, 8 AS bits, '420' AS chroma, '709' AS space, {_byte(64, '16e0', '219e0')} AS luma, {_byte(16, '16e0', '224e0')} AS u, {_byte(16, '60e0', '150e0')} AS v FROM embeddings WHERE size(embedding) = 64"
_code = lambda i, low, high: f"floor({low} + least(greatest(5e-1 + CAST(embedding[{i} + 1] AS DOUBLE), 0e0), 1e0) * {high})"
_UP = L.bilinear_weights(4, 8)


def yuv_to_rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw planar frames to RGB planes: chroma upsampled, matrix, clipped."""
    signals.views(spark, sf_dir, "embeddings")
    made = S.rgb_frames(spark.sql(_RAW)).withColumn("vec_id", F.col("clip").cast("long"))
    return I._samples(made, S.RGB, ["vec_id"], 5)


QUERIES["yuv_to_rgb"] = yuv_to_rgb
ORACLES["yuv_to_rgb"] = f"""WITH l AS (SELECT vec_id, CAST(i // 8 AS INTEGER) AS y, CAST(i % 8 AS INTEGER) AS x, {E.fixed_luma(_code('i', '16e0', '219e0'))} AS v FROM embeddings, range(64) AS g(i) WHERE len(embedding) = 64),
cb AS (SELECT vec_id, CAST(i // 4 AS INTEGER) AS y, CAST(i % 4 AS INTEGER) AS x, {E.fixed_chroma(_code('i', '16e0', '224e0'))} AS u, {E.fixed_chroma(_code('i', '60e0', '150e0'))} AS w FROM embeddings, range(16) AS g(i) WHERE len(embedding) = 64),
up AS (SELECT * FROM {L.separable_sql('cb', _UP, _UP, values=('u', 'w')).replace('w.w)', 'w.w)')} AS z)
SELECT vec_id, y, x, {', '.join(f'round({E.clamp(e, 0, 1)}, 5) AS v{k}' for k, e in enumerate(E.matrix(E.YCBCR_TO_RGB['bt709'], ('l.v', 'up.u', 'up.w'))))} FROM l JOIN up USING (vec_id, y, x)"""
ORACLES["yuv_to_rgb"] = ORACLES["yuv_to_rgb"].replace("sum(w * w.w) AS w", "sum(s.w * w.w) AS w").replace("sum(u * w.w)", "sum(s.u * w.w)")


def yuv_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    signals.views(spark, sf_dir, "embeddings")
    return rawvideo.plane_samples(spark.sql(_RAW), "u").selectExpr("CAST(path AS BIGINT) AS vec_id", "y", "x", "code")


QUERIES["yuv_samples"] = yuv_samples
ORACLES["yuv_samples"] = f"SELECT vec_id, CAST(i // 4 AS INTEGER) AS y, CAST(i % 4 AS INTEGER) AS x, CAST({_code('i', '16e0', '224e0')} AS INTEGER) AS code FROM embeddings, range(16) AS g(i) WHERE len(embedding) = 64"


def frame_resize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """6 x 7 frames to a width of 14, aspect kept."""
    source = signals.images(spark, sf_dir, 6, 7).selectExpr("vec_id AS clip", "0 AS frame", "h", "w", "v")
    return I._samples(S.resized(source, ["v"], 14).withColumnRenamed("clip", "vec_id"))


QUERIES["frame_resize"] = frame_resize
ORACLES["frame_resize"] = f"WITH img AS ({signals.images_sql(6, 7)}) SELECT vec_id, y, x, round({E.clamp('v', 0, 1)}, 6) AS v FROM {L.separable_sql('img', L.bilinear_weights(6, 12), L.bilinear_weights(7, 14))} AS z"

# Pairing and frame rates ------------------------------------------------------------------------------------------

_FRAMES_OF = "SELECT user_id AS clip, event_id % 2 AS side FROM events"


def pair_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    signals.views(spark, sf_dir, "events")
    rows = spark.sql(_FRAMES_OF)
    return S.lengths(rows.where("side = 0"), rows.where("side = 1"))


QUERIES["pair_lengths"] = pair_lengths
ORACLES["pair_lengths"] = f"SELECT clip, count(*) FILTER (side = 0) AS test, count(*) FILTER (side = 1) AS reference, least(count(*) FILTER (side = 0), count(*) FILTER (side = 1)) AS compared FROM ({_FRAMES_OF}) AS f GROUP BY clip"
_gcd = "aggregate(sequence(1, 40), struct(CAST(a AS BIGINT) AS x, CAST(b AS BIGINT) AS y), (s, i) -> CASE WHEN s.y = 0 THEN s ELSE struct(s.y AS x, s.x % s.y AS y) END, s -> s.x)"
_RATES = "SELECT p_partkey, CAST(CASE WHEN p_size % 7 = 0 THEN 23.976e0 ELSE 10 + p_size END AS DOUBLE) AS a, CAST(24 + p_partkey % 37 AS DOUBLE) AS b FROM part"
_sql("resample_rate", f"SELECT p_partkey, a, b, {T.rate_sql('a', 'b', _gcd)} AS rate FROM ({_RATES}) AS r", "part", oracle=f"SELECT p_partkey, a, b, {T.rate_sql('a', 'b', 'gcd(CAST(a AS BIGINT), CAST(b AS BIGINT))')} AS rate FROM ({_RATES}) AS r")


def temporal_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """24 to 60 frames a second: each frame is repeated where it is due."""
    signals.views(spark, sf_dir, "events")
    return S.resampled(spark.sql(f"WITH {_SEQUENCE} SELECT * FROM seq"), "24e0", "60e0", "n").select("user_id", "i", "v")


def temporal_resample_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    """30 frames a second against 48: both at their common rate of 166."""
    rate = T.resampled_rate(30, 48)
    signals.views(spark, sf_dir, "events")
    return S.resampled(spark.sql(f"WITH {_SEQUENCE} SELECT * FROM seq"), "30e0", num(rate), "n").select("user_id", "i", "v")


_resample_sql = lambda fps, rate: f"WITH {_SEQUENCE}, t AS (SELECT DISTINCT user_id, n FROM seq) SELECT a.user_id, a.i, b.v FROM (SELECT user_id, n, CAST(unnest(range(CAST(floor(n * {rate} / {fps}) AS INT))) AS INT) AS i FROM t) a JOIN seq b ON a.user_id = b.user_id AND b.frame = CAST(floor((a.i + 5e-1) * {fps} / {rate} + 1e-6) AS INT)"
QUERIES |= {"temporal_resample": temporal_resample, "temporal_resample_common": temporal_resample_common}
ORACLES |= {"temporal_resample": _resample_sql("24e0", "60e0"), "temporal_resample_common": _resample_sql("30e0", "166e0")}

# Features between the rate of the clip and 240 a second: linear, both grids over the same time.
_NEXT = "lead(v) OVER (PARTITION BY user_id ORDER BY frame) AS following"


def feature_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each interval between two frames gives the resampled values within it; nothing is joined."""
    signals.views(spark, sf_dir, "events")
    seq = spark.sql(f"WITH {_SEQUENCE} SELECT user_id, frame, n, CAST(ceil(n / 30e0 * 240e0) AS INT) AS m, v, {_NEXT} FROM seq")
    first, last = "CAST(floor((frame * (m - 1) - 1e-9) / greatest(n - 1, 1)) AS INT) + 1", "CAST(floor(((frame + 1) * (m - 1) - 1e-9) / greatest(n - 1, 1)) AS INT)"
    within = seq.where("n > 1 AND following IS NOT NULL").selectExpr("*", f"explode(sequence({first}, CASE WHEN frame = n - 2 THEN m - 1 ELSE {last} END)) AS i")
    made = within.selectExpr("user_id", "i", "v + (following - v) * (i * (n / 30e0) / (m - 1) - frame * (n / 30e0) / (n - 1)) / ((n / 30e0) / (n - 1) + 1e-6) AS v")
    alone = seq.where("n = 1").selectExpr("user_id", "explode(sequence(0, m - 1)) AS i", "v")
    return made.unionByName(alone).select("user_id", "i", F.round("v", 3).alias("v"))


QUERIES["feature_resample"] = feature_resample
ORACLES["feature_resample"] = f"""WITH {_SEQUENCE}, t AS (SELECT user_id, n, m, CAST(unnest(range(m)) AS INT) AS i FROM (SELECT DISTINCT user_id, n, CAST(ceil(n / 30e0 * 240e0) AS INT) AS m FROM seq) AS u),
k AS (SELECT *, CASE WHEN n = 1 THEN 0 ELSE least(CAST(floor((i * (n - 1) + 1e-9) / (m - 1)) AS INT), n - 2) END AS frame FROM t)
SELECT k.user_id, k.i, round(a.v + coalesce((b.v - a.v) * (k.i * (k.n / 30e0) / (k.m - 1) - k.frame * (k.n / 30e0) / (k.n - 1)) / ((k.n / 30e0) / (k.n - 1) + 1e-6), 0e0), 3) AS v
FROM k JOIN seq a ON a.user_id = k.user_id AND a.frame = k.frame LEFT JOIN seq b ON b.user_id = k.user_id AND b.frame = k.frame + 1"""

# Condition tables and jobs ---------------------------------------------------------------------------------------

_LINE = "concat(coalesce(concat('\"set,', p_brand, '/', CAST(p_partkey AS STRING), '.mp4\"'), ''), ',', coalesce(CAST(p_size AS STRING), ''))"


def quality_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditions written as files, the first with settings ahead of its header, read back with a setting on each row and their ids."""
    signals.views(spark, sf_dir, "part")
    at = f"{stream._folder(spark)}/conditions"
    # ranges of keys, so that files are in order and the header's lines, which have no key, are the first in the first of them
    rows = spark.sql(f"SELECT p_partkey, 9 AS place, {_LINE} AS value FROM part")
    head = spark.sql("SELECT CAST(NULL AS BIGINT) AS p_partkey, posexplode(array('# conditions', 'full-range: true', '', 'display: standard_4k', 'test,jod')) AS (place, value)")
    ordered = rows.unionByName(head).repartitionByRange("p_partkey").sortWithinPartitions("p_partkey", "place")
    ordered.select("value").write.text(at)
    held, settings = rawvideo.read_condition_table(spark, at, "test string, jod double")
    display = settings.where("key = 'display'").agg(F.max("value").alias("display"))
    return held.crossJoin(F.broadcast(display)).select(condition_id(F.col("test")).alias("id"), "jod", "display")


QUERIES["quality_table"] = quality_table
ORACLES["quality_table"] = "SELECT 'set,' || p_brand || '_' || p_partkey AS id, CAST(p_size AS DOUBLE) AS jod, 'standard_4k' AS display FROM part"
QUERIES["interactive_jobs"] = jobs.jobs_query
ORACLES["interactive_jobs"] = f"{_PAIR_SQL.replace('b.vec_id = a.vec_id + 1', 'b.vec_id = a.vec_id + 3')}, e AS (SELECT vec_id, avg(({' + '.join(_square(f't{k}', f'r{k}') for k in range(3))}) / 3e0) AS mse FROM p GROUP BY vec_id) SELECT vec_id AS test, vec_id + 3 AS reference, 'psnr_rgb' AS metric, round(20e0 * log10(1e0 / sqrt(mse)), 5) AS value FROM e JOIN nation ON n_nationkey = vec_id"
_sql("name_expand", "SELECT name FROM (SELECT concat('clip', CAST(p_partkey AS VARCHAR(20)), CASE WHEN p_partkey % 2 = 0 THEN '.yuv' ELSE '.png' END) AS name FROM part) AS n WHERE name LIKE 'clip1%.yuv' ORDER BY name", "part")
