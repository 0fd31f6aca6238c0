"""Stencil queries over images: pyramids, contrast, blur, resizing, masking models and the whole image score.

Vectors are read as 8 x 8 planes, or as 6 x 7 planes of mixed parity.  Queries filter plane rows in tasks; their SQL joins weight tables.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vireo.functions import expressions as E
from vireo.operators import linear as L
from vireo.operators import planes as P
from vireo.operators import visibility as V
from vireo.sources import signals

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
num = E.num
KEYS = ["vec_id", "y", "x"]
MODEL = V.Model()
RHO = V.band_frequencies(8, 8, MODEL.ppd)

R8, R4, X4, X2 = L.reduce_weights(8), L.reduce_weights(4), L.expand_weights(4, 8), L.expand_weights(2, 4)


def _samples(df: DataFrame, columns: list[str] = ["v"], keys: list[str] = ["vec_id"], digits: int = 6) -> DataFrame:
    return P.long(df, columns, keys).select(*keys, "y", "x", *(F.round(c, digits).alias(c) for c in columns))


def _stencil(name: str, fn, rows: L.Weights, columns: L.Weights, h: int = 8, w: int = 8) -> None:
    QUERIES[name] = lambda spark, sf_dir: _samples(P.filtered(signals.images(spark, sf_dir, h, w), fn, ["v"], keep=["vec_id"]))
    ORACLES[name] = f"WITH img AS ({signals.images_sql(h, w)}) SELECT vec_id, y, x, round(v, 6) AS v FROM {L.separable_sql('img', rows, columns)} AS z"


_stencil("gauss_reduce", P.reduce, R8, R8)
_stencil("gauss_reduce_mixed", P.reduce, L.reduce_weights(6), L.reduce_weights(7, False), 6, 7)
_stencil("gauss_expand_mixed", lambda x: P.expand(x, 11, 14), L.expand_weights(6, 11), L.expand_weights(7, 14), 6, 7)
_stencil("gaussian_blur", lambda x: P.blur(x, 1.5), L.gaussian_weights(8, 1.5), L.gaussian_weights(8, 1.5))
_stencil("phase_blur", lambda x: P.blur(x, 3, 13), L.gaussian_weights(8, 3, 13), L.gaussian_weights(8, 3, 13))
_stencil("texture_mean", lambda x: P.blur(x, 8, 33), L.gaussian_weights(8, 8, 33), L.gaussian_weights(8, 8, 33))
for _method, _weights in L.RESIZE.items():
    _stencil(f"resize_{_method}", lambda x, m=_method: P.resize(x, 12, 5, m), _weights(8, 12), _weights(8, 5))
_stencil("chroma_upsample_420", lambda x: P.resize(x, 16, 16), L.bilinear_weights(8, 16), L.bilinear_weights(8, 16))
_stencil("chroma_upsample_422", lambda x: P.resize(x, 8, 16), [(i, i, 1.0) for i in range(8)], L.bilinear_weights(8, 16))

LEVELS_SQL = f"g1 AS (SELECT * FROM {L.separable_sql('img', R8, R8)} AS z), g2 AS (SELECT * FROM {L.separable_sql('g1', R4, R4)} AS z), e0 AS (SELECT * FROM {L.separable_sql('g1', X4, X4)} AS z), e1 AS (SELECT * FROM {L.separable_sql('g2', X2, X2)} AS z)"
_IMG = f"WITH img AS ({signals.IMAGES_DUCKDB}), {LEVELS_SQL}"
_BANDS = "SELECT vec_id, 0 AS band, y, x, img.v - e0.v AS v FROM img JOIN e0 USING (vec_id, y, x) UNION ALL SELECT vec_id, 1, y, x, g1.v - e1.v FROM g1 JOIN e1 USING (vec_id, y, x) UNION ALL SELECT vec_id, 2, y, x, v FROM g2"


def _banded(name: str, stencil, sql: str) -> None:
    """A query of all bands that a stencil makes of each image."""
    QUERIES[name] = lambda spark, sf_dir: _samples(P.over_planes(signals.images(spark, sf_dir), stencil, ["v"], keep=["vec_id"]), keys=["vec_id", "band"])
    ORACLES[name] = f"{_IMG} SELECT vec_id, band, y, x, round(v, 6) AS v FROM ({sql}) AS z"


_numbered = lambda bands: enumerate(bands)
_banded("gaussian_pyramid", lambda x: _numbered(P.gaussian(x, 3)), "SELECT vec_id, 0 AS band, y, x, v FROM img UNION ALL SELECT vec_id, 1, y, x, v FROM g1 UNION ALL SELECT vec_id, 2, y, x, v FROM g2")
_banded("laplacian_pyramid", lambda x: _numbered(P.laplacian(x, 3)), _BANDS)
_banded("band_multiplier", lambda x: ((k, b * (2 if k == 1 else 1)) for k, b in enumerate(P.laplacian(x, 3))), f"SELECT vec_id, band, y, x, v * CASE WHEN band = 1 THEN 2 ELSE 1 END AS v FROM ({_BANDS}) AS b")
_banded("band_crop", lambda x: ((k, b[..., : b.shape[-2] // 2, :]) for k, b in enumerate(P.laplacian(x, 3))), f"SELECT * FROM ({_BANDS}) AS b WHERE y < CASE band WHEN 0 THEN 4 WHEN 1 THEN 2 ELSE 1 END")
_stencil("gauss_expand", lambda x: P.expand(P.reduce(x), 8, 8), R8, R8)
ORACLES["gauss_expand"] = f"{_IMG} SELECT vec_id, y, x, round(v, 6) AS v FROM e0"
_stencil("laplacian_band0", lambda x: P.laplacian(x, 2)[0], R8, R8)
ORACLES["laplacian_band0"] = f"{_IMG} SELECT vec_id, y, x, round(img.v - e0.v, 6) AS v FROM img JOIN e0 USING (vec_id, y, x)"


def pyr_reconstruct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decomposes into band rows, gathers a plane's bands again and adds them up; equals the images."""
    bands = P.over_planes(signals.images(spark, sf_dir), lambda x: enumerate(P.laplacian(x, 3)), ["v"], keep=["vec_id"])
    return _samples(P.reconstructed(bands, ["vec_id"], "v"))


QUERIES["pyr_reconstruct"] = pyr_reconstruct
ORACLES["pyr_reconstruct"] = f"WITH img AS ({signals.IMAGES_DUCKDB}) SELECT vec_id, y, x, round(v, 6) AS v FROM img"

# Contrast ---------------------------------------------------------------------------------------------------------


def lit_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, h, w, t, r: an image and the next one, in light of the standard display."""
    lit = signals.images(spark, sf_dir).withColumn("v", F.expr(f"transform(v, e -> {E.display_forward('e')})"))
    return lit.withColumnRenamed("v", "t").join(lit.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("r")), "vec_id")


def _contrast(name: str, mode: str, light: str = "e") -> None:
    """Contrasts of both sides and the log background of the reference."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        pairs = lit_pairs(spark, sf_dir).withColumns({c: F.expr(f"transform({c}, e -> {light})") for c in "tr"})
        stencil = lambda x: ((k, np.concatenate([c, np.broadcast_to(b, (*c.shape[:1], 1, *c.shape[2:]))], 1)) for k, c, b in V.contrast_bands(x, 3, mode))
        return _samples(P.over_planes(pairs, stencil, ["t", "r"], ["t", "r", "background"], ["vec_id"]), ["t", "r", "background"], ["vec_id", "band"])

    QUERIES[name] = query
    ORACLES[name] = f"WITH {contrast_sql(mode, light)} SELECT vec_id, band, y, x, round(t, 6) AS t, round(r, 6) AS r, round(lb, 6) AS background FROM con"


def contrast_sql(mode: str = "weber_g1", light: str = "e") -> str:
    """con(vec_id, band, y, x, t, r, lb) of pairs."""
    values = ("t", "r")
    sep = lambda s, a, b: f"(SELECT * FROM {L.separable_sql(s, a, b, values=values)} AS z)"
    own = light.replace("greatest(e,", f"greatest({E.display_forward('v')},") if light != "e" else E.display_forward("v")
    start = f"""raw AS ({signals.IMAGES_DUCKDB}), lit AS (SELECT vec_id, y, x, {own} AS v FROM raw),
img AS (SELECT a.vec_id, a.y, a.x, a.v AS t, b.v AS r FROM lit a JOIN lit b ON b.vec_id = a.vec_id + 1 AND a.y = b.y AND a.x = b.x),
g1 AS {sep('img', R8, R8)}, g2 AS {sep('g1', R4, R4)}, e0 AS {sep('g1', X4, X4)}, e1 AS {sep('g2', X2, X2)},
m AS (SELECT vec_id, avg(greatest(t, 1e-2)) AS mt, avg(greatest(r, 1e-2)) AS mr FROM g2 GROUP BY vec_id)"""
    parts = []
    for band, (g, e) in enumerate((("img", "e0"), ("g1", "e1"), ("g2", "m"))):
        factor = "2 * " if band == 1 else ""
        if mode == "log":
            shift = num(-np.log10(V.LOG_LMS[0]) + np.log10(V.LOG_LMS[1]) - np.log10(sum(V.LOG_LMS)))
            c = [f"{factor}({g}.{v} - {e}.{v})" if band < 2 else f"g2.{v}" for v in values]
            held = f"5e-1 * ({e if band < 2 else 'g2'}.r + {shift})"
        else:
            side = {"t": "t", "r": "r"} if mode == "weber_g1" else {"t": "r", "r": "r"}
            around = {v: f"greatest({g if mode == 'weber_g0_ref' else e}.{side[v]}, 1e-2)" if band < 2 else f"m.m{v}" if mode == "weber_g1" else "greatest(g2.r, 1e-2)" for v in values}
            c = [f"{factor}least(({g}.{v}{f' - {e}.{v}' if band < 2 else ''}) / {around[v]}, 1e3)" for v in values]
            held = f"log10({around['r']})"
        parts.append(f"SELECT vec_id, {band} AS band, {g}.y, {g}.x, {c[0]} AS t, {c[1]} AS r, {held} AS lb FROM {g} JOIN {e} USING ({'vec_id, y, x' if band < 2 else 'vec_id'})")
    return f"{start},\ncon AS ({' UNION ALL '.join(parts)})"


_contrast("weber_contrast", "weber_g1")
_contrast("weber_contrast_ref", "weber_g1_ref")
_contrast("weber_contrast_g0_ref", "weber_g0_ref")
_contrast("log_contrast", "log", "2e0 * log10(greatest(e, 1e-5))")

# Differences and scores -------------------------------------------------------------------------------------------

SENSE = "(CASE band " + " ".join(f"WHEN {b} THEN {MODEL.sensitivity.sql('lb', rho, 0)}" for b, rho in enumerate(RHO)) + " END)"
OWN = num(2 ** V.CROSS[0][0])
_P, _Q, _MOST = V.MASK_P, V.MASK_Q[0], num(10**V.D_MAX)
_added = lambda v: f"(CAST(sign({v}) AS DOUBLE) * greatest(abs({v}) - 1e0 / s + 1e0, 0e0))"
#: What masks, by name; blurred in the finest band.
SIGNALS = {"m": "least(abs(tt), abs(rr))", "pt": f"{OWN} * {E.safe_pow('abs(tt)', _Q)}", "pr": f"{OWN} * {E.safe_pow('abs(rr)', _Q)}", "ut": f"{OWN} * abs(tt)", "ur": f"{OWN} * abs(rr)"}
_transduced = lambda v, m: f"({_MOST} * {E.pow_even(v, _P)} / (2e-1 + {m}))"
_old = f"({E.safe_pow('abs(tt - rr)', _P)} / (1e0 + {E.safe_pow(f'({OWN} * m)', _Q)}))"
#: Difference models over contrast times sensitivity (or additive gain) tt, rr.
MODELS = {
    "mask_none": ("mult-none", E.clamp_difference("abs(tt - rr)")),
    "mask_mutual": ("mult-mutual", E.clamp_difference(f"({E.safe_pow('abs(tt - rr)', _P)} / (1e0 + {OWN} * {E.safe_pow('m', _Q)}))")),
    "mask_mutual_added": ("add-mutual", E.clamp_difference(f"({E.safe_pow('abs(tt - rr)', _P)} / (1e0 + {OWN} * {E.safe_pow('m', _Q)}))")),
    "mask_mutual_old": ("mult-mutual-old", f"({_MOST} * {_old} / ({_MOST} + {_old}))"),
    "mask_perceptual": ("mult-perceptual", E.clamp_difference(_old)),
    "mask_perceptual_smooth": ("mult-perceptual-smooth", E.clamp_difference(f"(({_MOST} * pow(abs(tt - rr), {num(_P)}) + 1e0) / ({_MOST} + pow(abs(tt - rr), {num(_P)})) / (1e0 + {E.safe_pow(f'({OWN} * m)', _Q)}))")),
    "mask_transducer": ("mult-transducer", f"abs({_transduced('tt', 'pt')} - {_transduced('rr', 'pr')})"),
    "mask_texture_small": ("mult-transducer-texture", f"abs({_transduced('tt', 'pt')} - {_transduced('rr', 'pr')})"),
    "mask_similarity": ("mult-similarity", f"({_MOST} - {_MOST} * (2e0 * abs(tt) * abs(rr) + {_MOST} - 1e0) / (ut * ut + ur * ur + {_MOST} - 1e0))"),
}
PHASE = L.gaussian_weights(8, V.PHASE, 4 * V.PHASE + 1)


def diff_sql(masking: str) -> str:
    """dif(vec_id, band, y, x, t, r, s, tt, rr and the masking signals)."""
    sensed = {"t": "t * s", "r": "r * s"} if masking.startswith("mult") else {"t": _added("t"), "r": _added("r")}
    names = tuple(SIGNALS)
    return f"""{contrast_sql()}, sen AS (SELECT *, {SENSE} AS s FROM con), pr AS (SELECT *, {sensed['t']} AS tt, {sensed['r']} AS rr FROM sen),
sig AS (SELECT *, {', '.join(f'{e} AS {k}' for k, e in SIGNALS.items())} FROM pr), fine AS (SELECT * FROM sig WHERE band = 0),
blur AS (SELECT vec_id, 0 AS band, y, x, {', '.join(f'{k} AS f_{k}' for k in names)} FROM {L.separable_sql('fine', PHASE, PHASE, values=names)} AS z),
dif AS (SELECT vec_id, band, y, x, t, r, s, tt, rr, {', '.join(f'coalesce(f_{k}, {k}) * {num(10**V.MASK_C)} AS {k}' for k in names)} FROM sig LEFT JOIN blur USING (vec_id, band, y, x))"""


def _difference(name: str, masking: str, sql: str) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = P.over_planes(lit_pairs(spark, sf_dir), V.Model(masking=masking).differences, ["t", "r"], ["d"], ["vec_id"])
        return _samples(made, ["d"], ["vec_id", "band"], 4)

    QUERIES[name] = query
    ORACLES[name] = f"WITH {diff_sql(masking)} SELECT vec_id, band, y, x, round(CASE WHEN band = 2 THEN abs(t - r) * s ELSE {sql} END, 4) AS d FROM dif"


for _name, _model in MODELS.items():
    _difference(_name, *_model)


def image_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole chain for image pairs (achromatic channel): light, pyramid, contrast, sensitivity, masking, pooling, score."""
    scores = V.image_scores(lit_pairs(spark, sf_dir), ["t", "r"], ["vec_id"])
    return scores.select("vec_id", F.round("q", 5).alias("q"), F.round("score", 5).alias("score"))


_w = f"(q * CASE WHEN band = 2 THEN {num(V.BASEBAND[0])} ELSE 1e0 END)"
QUERIES["image_score"] = image_score
ORACLES["image_score"] = f"""WITH {diff_sql('mult-mutual')}, b AS (SELECT vec_id, band, {E.safe_pow(f"(sum({E.safe_pow('d', 2)}) / count(*))", 0.5)} AS q FROM (SELECT vec_id, band, CASE WHEN band = 2 THEN abs(t - r) * s ELSE {MODELS['mask_mutual'][1]} END AS d FROM dif) AS z GROUP BY vec_id, band),
p AS (SELECT vec_id, {E.safe_pow(E.safe_pow(f"sum({E.safe_pow(_w, 4)})", 0.25), 4)} AS q4 FROM b GROUP BY vec_id), f AS (SELECT vec_id, {E.safe_pow('q4', 0.25)} * {num(V.IMAGE)} AS q FROM p) SELECT vec_id, round(q, 5) AS q, round({E.jod('q')}, 5) AS score FROM f"""


def _over_images(name: str, sql: str) -> None:
    def query(spark, sf_dir):
        P.long(signals.images(spark, sf_dir), ["v"], ["vec_id"]).createOrReplaceTempView("img")
        return spark.sql(sql)

    QUERIES[name] = query
    ORACLES[name] = f"WITH img AS ({signals.IMAGES_DUCKDB}) {sql}"


_moments = "avg(t) AS mt, avg(r) AS mr, avg(t * t) AS tt, avg(r * r) AS rr, avg(t * r) AS tr"
_SSIM_BLOCKS = f"SELECT vec_id, round(avg((2e0 * mt * mr + 1e-4) * (2e0 * (tr - mt * mr) + 9e-4) / ((mt * mt + mr * mr + 1e-4) * (tt - mt * mt + rr - mr * mr + 9e-4))), 6) AS ssim FROM (SELECT a.vec_id, CAST(floor(a.y / 4e0) AS INT) AS by_, CAST(floor(a.x / 4e0) AS INT) AS bx_, {_moments} FROM (SELECT vec_id, y, x, v AS t FROM img) a JOIN (SELECT vec_id - 1 AS vec_id, y, x, v AS r FROM img) b ON a.vec_id = b.vec_id AND a.y = b.y AND a.x = b.x GROUP BY a.vec_id, CAST(floor(a.y / 4e0) AS INT), CAST(floor(a.x / 4e0) AS INT)) AS s GROUP BY vec_id"


def ssim_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity of blocks of 4 x 4 samples of an image and the next one, averaged over blocks; rows stay planes."""

    def similar(x: np.ndarray) -> np.ndarray:
        t, r = x[:, :1], x[:, 1:]
        mt, mr, tt, rr, tr = (P.window_moments(v, 4)[0] for v in (t, r, t * t, r * r, t * r))
        s = (2 * mt * mr + 1e-4) * (2 * (tr - mt * mr) + 9e-4) / ((mt * mt + mr * mr + 1e-4) * (tt - mt * mt + rr - mr * mr + 9e-4))
        return s.mean((-2, -1), keepdims=True)

    img = signals.images(spark, sf_dir)
    pairs = img.withColumnRenamed("v", "t").join(img.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("r")), "vec_id")
    return P.filtered(pairs, similar, ["t", "r"], ["s"], ["vec_id"]).select("vec_id", F.round(F.col("s")[0], 6).alias("ssim"))


QUERIES["ssim_blocks"], ORACLES["ssim_blocks"] = ssim_blocks, f"WITH img AS ({signals.IMAGES_DUCKDB}) {_SSIM_BLOCKS}"
_over_images("tonemap_hist", "SELECT bin, n, round(sum(p) OVER (ORDER BY bin) / sum(p) OVER (), 6) AS level FROM (SELECT bin, count(*) AS n, pow(CAST(count(*) AS DOUBLE), 1e0 / 3e0) AS p FROM (SELECT CAST(least(floor(v * 64e0), 63e0) AS INT) AS bin FROM img) AS b GROUP BY bin) AS h")
_over_images("heatmap_color", "SELECT vec_id, y, x, round(least(greatest(CASE WHEN v < 5e-1 THEN 2e0 * v ELSE 1e0 END, 0e0), 1e0), 6) AS red, round(1e0 - abs(2e0 * v - 1e0), 6) AS green, round(least(greatest(CASE WHEN v < 5e-1 THEN 1e0 ELSE 2e0 - 2e0 * v END, 0e0), 1e0), 6) AS blue FROM img")
_over_images("log_context", "SELECT vec_id, y, x, round(ln(greatest(v, min(CASE WHEN v > 0 THEN v END) OVER (PARTITION BY vec_id))), 6) AS c FROM img")
