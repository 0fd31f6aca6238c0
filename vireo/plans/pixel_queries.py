"""Pixel-wise queries: transfer functions, colour, perceptual encodings, display geometry, pooling, baselines."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vireo.functions import expressions as E
from vireo.sources import signals

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
num = E.num


def _scalar(name: str, digits: int = 6, **columns: str) -> None:
    """A query of expressions over the pixel view."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        px = signals.pixels(spark, sf_dir)
        return px.select("t", "r", "q", *(F.round(F.expr(e), digits).alias(k) for k, e in columns.items()))

    QUERIES[name] = query
    ORACLES[name] = f"WITH px AS ({signals.PIXELS}) SELECT t, r, q, {', '.join(f'round({e}, {digits}) AS {k}' for k, e in columns.items())} FROM px"


def _constant(name: str, rows: list[str]) -> None:
    """A query of a few computed rows."""
    sql = " UNION ALL ".join(f"SELECT {r}" for r in rows)
    QUERIES[name] = lambda spark, sf_dir: spark.sql(sql)
    ORACLES[name] = sql


def _sql(name: str, sql: str, *tables: str, oracle: str | None = None) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        signals.views(spark, sf_dir, *tables)
        return spark.sql(sql)

    QUERIES[name] = query
    ORACLES[name] = oracle or sql


V = ("t", "r", "q")
light = [E.display_forward(v) for v in V]
xyz = E.RGB_TO_XYZ["sRGB"]
names = lambda keys, values: dict(zip(keys, values))

_scalar("eotf_srgb", lt=E.display_forward("t"), lr=E.display_forward("r"))
_scalar("eotf_gamma22", lt=E.display_forward("t", eotf="2.2"), lr=E.display_forward("r", eotf="2.2"))
_scalar("eotf_linear", lt=E.display_forward("(t * 300e0)", eotf="linear"))
_scalar("eotf_pq", 4, lt=E.display_forward("t", 1500, 1e6, 10, eotf="PQ"), raw=E.pq_decode("t"))
_scalar("eotf_hlg", **names(("hr", "hg", "hb"), E.hlg_to_linear(V, E.hlg_gamma(1500, 10))))
_scalar("exposure_black_level", dim=E.display_forward("t", exposure=0.25), bright=E.display_forward("t", exposure=4))
_scalar("pq_roundtrip", back=E.pq_decode(E.pq_encode("(q * 4000e0)")), coded=E.pq_encode("(q * 4000e0)"))
_scalar("srgb_roundtrip", back=E.linear_to_srgb(E.srgb_to_linear("q")))
for kind in E.PU:
    _scalar(f"pu_encode_{kind}", pu=E.pu_encode("(q * 1000e0)", kind))
_scalar("pu_decode_roundtrip", back=E.pu_decode(E.pu_encode("(q * 1000e0)")))
_scalar("color_xyz", **names(("cx", "cy", "cz"), E.matrix(xyz, light)))
_scalar("color_lms", **names(("l", "m", "s"), E.matrix(E.folded(E.XYZ_TO_LMS, xyz), light)))
_scalar("color_dkl", **names(("ay", "rg", "yv"), E.matrix(E.folded(E.LMS_TO_DKL, E.XYZ_TO_LMS, xyz), light)))
_scalar("color_y", y=E.matrix(xyz, light)[1])
_scalar("color_rgb709", **names(("r7", "g7", "b7"), E.matrix(E.folded(E.XYZ_TO_RGB709, xyz), light)))
_scalar("color_rgb2020pq", **names(("r2", "g2", "b2"), [E.pq_encode(x) for x in E.matrix(E.folded(E.XYZ_TO_RGB2020, xyz), light)]))
_scalar("color_log_lms", **names(("l", "m", "s"), [f"log10(greatest({x}, 1e-12))" for x in E.matrix(E.folded(E.XYZ_TO_LMS, xyz), light)]))
_scalar("ycbcr_to_rgb", 9, **names(("rr", "gg", "bb"), [E.clamp(x, 0, 1) for x in E.matrix(E.YCBCR_TO_RGB["bt709"], (E.fixed_luma("(16e0 + t * 219e0)"), E.fixed_chroma("(16e0 + r * 224e0)"), E.fixed_chroma("(16e0 + q * 224e0)")))]))
_scalar("ycbcr_to_rgb2020_10bit", 9, **names(("rr", "gg", "bb"), [E.clamp(x, 0, 1) for x in E.matrix(E.YCBCR_TO_RGB["bt2020"], (E.fixed_luma("(64e0 + t * 876e0)", 10), E.fixed_chroma("(64e0 + r * 896e0)", 10), E.fixed_chroma("(64e0 + q * 896e0)", 10)))]))
_scalar("display_encoded_100nit", pu=f"({E.pu_encode(E.display_forward('t'))} / {E.pu_encode('100e0')})")
_scalar("safe_pow", a=E.safe_pow("t", 2.264355182647705), b=E.pow_even("(t - r)", 2.4))
_scalar("jod_map", score=E.jod("(q * 5e0)"), loss=f"(10e0 - {E.jod('(q * 5e0)')})")
_scalar("clamp_soft", d=E.clamp_difference("(q * 1000e0)", "soft"))
_scalar("clamp_hard", d=E.clamp_difference("(q * 1000e0)", "hard"))
_scalar("clamp_smooth", d="((1e2 * pow(q, 2e0) + 1e0) / (1e2 + pow(q, 2e0)))")
_scalar("weber_to_log", c="log10(greatest(1e0 + t - r, 1e-12))", s="CAST(sign(t - r) AS DOUBLE)")
_scalar("luma", y="(" + " + ".join(f"{num(k)} * {v}" for k, v in zip(E.LUMA, V)) + ")")
PACKED = "CAST(round(l_discount * 655350e0) AS INTEGER)"
_sql("uint16_unpack", f"SELECT {PACKED} AS packed, ((CASE WHEN {PACKED} >= 32768 THEN {PACKED} - 65536 ELSE {PACKED} END) & 65535) / 65535e0 AS v FROM lineitem", "lineitem")

DISPLAYS = {"standard_4k": (3840, 2160, 0.7472, 30), "standard_fhd": (1920, 1080, 0.6, 24)}
_constant("display_geometry_ppd", [f"'{k}' AS display, " + ", ".join(f"round({e}, 6) AS {c}" for c, e in E.geometry(*d).items()) for k, d in DISPLAYS.items()])
_size = E.geometry(*DISPLAYS["standard_fhd"])["width_m"]
_ecc = f"degrees(atan(({{}}) * {_size} / 1920 / {num(0.6)}))"
_ex, _ey = _ecc.format("(q * 1920e0 + 5e-1) - 960e0"), _ecc.format("(t * 1080e0 + 5e-1) - 540e0")
_scalar("pix_eccentricity", ex=_ex, ey=_ey, ecc=f"sqrt(pow({_ex}, 2e0) + pow({_ey}, 2e0))")
_base = 1 / 37.8425039
_scalar("resolution_magnification", mag=f"((tan(radians(least(q * 89e0, 89.9e0) + {num(_base / 2)})) - tan(radians(least(q * 89e0, 89.9e0) - {num(_base / 2)}))) / {num(2 * math.tan(math.radians(_base / 2)))})")


def _pnorm(source: str, keys: str, p: float, value: str, normalised: bool, out: str) -> str:
    n = "count(*)" if normalised else "1e0"
    return f"SELECT {keys}, {E.safe_pow(f'(sum({E.safe_pow(value, p)}) / {n})', 1 / p)} AS {out} FROM {source} GROUP BY {keys}"


Q1 = _pnorm(f"({signals.QUALITY}) AS a", "pair, vch, frame, band", 2, "d", True, "q1")
WEIGHT_TRANSIENT = 0.8081134557723999
WEIGHT = f"(CASE vch WHEN 'F' THEN 1e0 ELSE {num(WEIGHT_TRANSIENT)} END)"
Q2 = _pnorm(f"({Q1}) AS b", "pair, vch, frame", 4, f"(q1 * {WEIGHT})", False, "q2")
Q3 = _pnorm(f"({Q2}) AS c", "pair, frame", 4, "q2", False, "q3")
Q4 = _pnorm(f"({Q3}) AS d", "pair", 2, "q3", True, "q4")
_sql("pnorm_spatial", f"SELECT pair, vch, frame, band, round(q1, 6) AS q1 FROM ({Q1}) AS x", "lineitem")
_sql("pnorm_bands", f"SELECT pair, vch, frame, round(q2, 6) AS q2 FROM ({Q2}) AS x", "lineitem")
_sql("pnorm_channels", f"SELECT pair, frame, round(q3, 6) AS q3 FROM ({Q3}) AS x", "lineitem")
_sql("pnorm_rollup", f"SELECT pair, round(q4, 6) AS q4, round({E.jod('q4')}, 6) AS score FROM ({Q4}) AS x", "lineitem")
_LEVEL = f"round({E.clamp('(q1 / {top})', 0, 1)}, 6)"
# The largest value comes from an aggregation of its own, a row that is sent to all tasks.
_sql("distogram", f"SELECT pair, vch, frame, band, {_LEVEL.format(top='top')} AS level FROM ({Q1}) AS x CROSS JOIN (SELECT max(q1) AS top FROM ({Q1}) AS y) AS m", "lineitem", oracle=f"SELECT pair, vch, frame, band, {_LEVEL.format(top='max(q1) OVER ()')} AS level FROM ({Q1}) AS x")

_mse = lambda f: "avg(" + " + ".join(f"pow({f(a)} - {f(b)}, 2e0)" for a, b in (("t", "r"),)) + ")"
_rows = "SELECT l_returnflag AS pair, l_discount * 10e0 AS t, l_tax * 12.5e0 AS r, l_quantity / 50e0 AS q FROM lineitem"
_psnr = lambda peak, mse: f"round(20e0 * log10({peak} / sqrt({mse})), 6)"
_sql("psnr_rgb", f"SELECT pair, {_psnr('1e0', _mse(lambda v: v))} AS psnr FROM ({_rows}) AS p GROUP BY pair", "lineitem")
_sql("pu_psnr_y", f"SELECT pair, {_psnr(E.pu_encode('100e0'), _mse(E.display_forward))} AS psnr FROM ({_rows}) AS p GROUP BY pair", "lineitem")
_sql("pu_psnr_y_encoded", f"SELECT pair, {_psnr(E.pu_encode('100e0'), _mse(lambda v: E.pu_encode(E.display_forward(v))))} AS psnr FROM ({_rows}) AS p GROUP BY pair", "lineitem")
_sql("content_minmax", f"SELECT pair, min(t) AS low, max(t) AS high, round(avg(t), 8) AS mean, count(*) AS n FROM ({_rows}) AS p GROUP BY pair", "lineitem")
_sql("validity_stats", f"SELECT pair, sum(CASE WHEN isnan(t) OR isnan(r) THEN 1 ELSE 0 END) AS n_nan, sum(CASE WHEN abs(t) > 1e300 THEN 1 ELSE 0 END) AS n_inf, CAST(avg(t) < 1e-1 AS INT) AS dark FROM ({_rows}) AS p GROUP BY pair", "lineitem", oracle=f"SELECT pair, sum(CASE WHEN isnan(t) OR isnan(r) THEN 1 ELSE 0 END)::BIGINT AS n_nan, sum(CASE WHEN abs(t) > 1e300 THEN 1 ELSE 0 END)::BIGINT AS n_inf, CAST(avg(t) < 1e-1 AS INT) AS dark FROM ({_rows}) AS p GROUP BY pair")
