"""Queries around the core chain: colour maps, further masking models, similarity, numbering, splits, probes, packed samples."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vireo.functions import expressions as E
from vireo.functions.lookup import interp
from vireo.operators import linear as L
from vireo.operators import planes as PL
from vireo.operators.numbering import numbered
from vireo.operators.reports import COLOR_MAPS
from vireo.plans import pixel_queries as P
from vireo.plans import video_queries as V
from vireo.sources import signals

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
num = E.num


def _sql(name: str, sql: str, *tables: str, oracle: str | None = None) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        signals.views(spark, sf_dir, *tables)
        return spark.sql(sql)

    QUERIES[name] = query
    ORACLES[name] = oracle or sql


# Colour maps of differences.
def colored(v: str, kind: str, context: str = "5e-1") -> list[str]:
    """Red, green and blue of a difference: the map's colour over its own luminance, times the context, clipped."""
    top, colors = COLOR_MAPS[kind]
    knots = [top * k / (len(colors) - 1) for k in range(len(colors))]
    hue = np.array(colors) / (np.array(colors) @ np.array(E.LUMA) + 1e-4)[:, None]
    return [E.clamp(f"({interp(E.clamp(v, 0, 1), knots, list(hue[:, c]))} * {context})", 0, 1) for c in range(3)]


for _kind in COLOR_MAPS:
    P._scalar(f"color_map_{_kind}", 4, **dict(zip(("red", "green", "blue"), colored("(q * 4e-1)", _kind))))

# Further pixel functions.
_TO_RGB = np.linalg.inv(E.folded(E.LMS_TO_DKL, E.XYZ_TO_LMS, E.RGB_TO_XYZ["sRGB"]))
_dkl = E.matrix(E.folded(E.LMS_TO_DKL, E.XYZ_TO_LMS, E.RGB_TO_XYZ["sRGB"]), ("t", "r", "q"))
P._scalar("dkl_to_rgb", **dict(zip(("red", "green", "blue"), [E.clamp(v, 0, 1) for v in E.matrix(_TO_RGB, _dkl)])))
P._scalar("quantise", c8="CAST(floor(least(greatest(q, 0e0), 1e0) * 255e0 + 5e-1) AS INT)", c16="CAST(floor(least(greatest(q, 0e0), 1e0) * 65535e0 + 5e-1) AS INT)", up8="CAST(ceil(q * 50e0 / 8e0) * 8 AS INT)")
_gain = lambda v, s, g: f"(CAST(sign({v}) AS DOUBLE) * greatest((abs({v}) - 1e0 / {s}) * {g} + 1e0, 0e0))"
P._scalar("gain_control", **{f"g{c}": _gain("(t - r)", "(3e1 * ln(q + 3e0))", num(1.5 * g)) for c, g in enumerate((1, 1.7, 0.237, 1))})
P._scalar("yxy", x=f"({E.matrix(P.xyz, P.light)[0]} / ({' + '.join(E.matrix(P.xyz, P.light))}))", y=f"({E.matrix(P.xyz, P.light)[1]} / ({' + '.join(E.matrix(P.xyz, P.light))}))")
_SQUARES = " + ".join(f"pow({E.pu_encode(f'greatest({a}, 5e-3)')} - {E.pu_encode(f'greatest({b}, 5e-3)')}, 2e0)" for a, b in zip(E.matrix(E.folded(E.XYZ_TO_RGB2020, P.xyz), P.light), E.matrix(E.folded(E.XYZ_TO_RGB2020, P.xyz), [E.display_forward(v) for v in ("r", "q", "t")])))
_sql("pu_psnr_rgb2020", f"SELECT pair, {P._psnr(E.pu_encode('100e0'), f'(avg({_SQUARES}) / 3e0)')} AS psnr FROM ({P._rows}) AS p GROUP BY pair", "lineitem")
_sql("channel_mask", f"SELECT pair, round({E.jod('q')}, 6) AS score FROM (SELECT pair, {E.safe_pow('sum(' + E.safe_pow('q2', 4) + ')', 0.25)} AS q FROM ({P.Q2}) AS b WHERE vch IN ('F') GROUP BY pair) AS c", "lineitem")
_sql("probe_frames", "SELECT p_partkey, coalesce(CASE WHEN p_size % 3 = 0 THEN p_size END, CASE WHEN p_size % 3 = 1 THEN p_size * 2 END, CAST(floor(p_retailprice * 24e0 / 1e2) AS INT), -1) AS frames FROM part", "part")
_sql("feature_disable", "SELECT o_orderkey, CASE WHEN o_orderstatus IN ('P') THEN 0e0 ELSE o_totalprice END AS v FROM orders", "orders")
_PACK = "SELECT vec_id, {at} FROM embeddings"
_sql("packed_slice", _PACK.format(at="round(CAST(aggregate(slice(embedding, 9, 8), CAST(0 AS DOUBLE), (a, x) -> a + CAST(x AS DOUBLE)) AS DOUBLE), 5) AS second_row, size(slice(embedding, 9, 8)) AS n"), "embeddings", oracle=_PACK.format(at="round(list_sum(list_transform(embedding[9:16], lambda x: CAST(x AS DOUBLE))), 5) AS second_row, CAST(len(embedding[9:16]) AS INTEGER) AS n"))


# Numbering and splits.
def _places(spark: SparkSession, sf_dir: str, table: str, key: str) -> DataFrame:
    return numbered(spark.read.parquet(f"{sf_dir}/{table}.parquet").select(key), key)


def pair_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists paired by place."""
    a, b = _places(spark, sf_dir, "customer", "c_custkey"), _places(spark, sf_dir, "orders", "o_orderkey")
    return a.join(b, "k").select(F.col("k").cast("int").alias("k"), "c_custkey", "o_orderkey")


def worker_stride(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows 2, 6, 10, ... in order of the key."""
    return _places(spark, sf_dir, "orders", "o_orderkey").where("k % 4 = 2").select("o_orderkey")


def train_split(spark: SparkSession, sf_dir: str, percent: int = 80, seed: int = 7) -> DataFrame:
    """Exactly percent of the distinct keys, the first in the order of a seeded hash."""
    keys = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey").where("o_custkey IS NOT NULL").distinct()
    hashed = keys.withColumn("_h", F.expr(f"CAST(conv(substr(md5(concat('{seed}|', CAST(o_custkey AS STRING))), 1, 13), 16, 10) AS BIGINT)"))
    return numbered(hashed, "_h").where(F.col("k") <= F.floor(F.lit(keys.count() * percent / 100))).select("o_custkey")


QUERIES |= {"pair_zip": pair_zip, "worker_stride": worker_stride, "train_split": train_split}
ORACLES |= {
    "pair_zip": "SELECT a.k::INTEGER AS k, a.c_custkey, b.o_orderkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS k FROM customer) a JOIN (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS k FROM orders) b ON a.k = b.k",
    "worker_stride": "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS rn FROM orders) AS r WHERE rn % 4 = 2",
    "train_split": "SELECT o_custkey FROM (SELECT o_custkey, row_number() OVER (ORDER BY md5('7|' || o_custkey)) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_custkey IS NOT NULL)) WHERE k <= floor(n * 80 / 100.0)",
}

# Structural similarity with Gaussian windows, and the channels of a clip laid out as a mosaic.
WINDOW = L.gaussian_weights(8, 1.5, 11)
MOMENTS = {"mt": "t", "mr": "r", "tt": "t * t", "rr": "r * r", "tr": "t * r"}
SIMILAR = "(2e0 * mt * mr + 1e-4) * (2e0 * (tr - mt * mr) + 9e-4) / ((mt * mt + mr * mr + 1e-4) * (tt - mt * mt + rr - mr * mr + 9e-4))"
_PAIRS = "SELECT a.vec_id, a.y, a.x, a.v AS t, b.v AS r FROM {img} a JOIN {img} b ON b.vec_id = a.vec_id + 1 AND b.y = a.y AND b.x = a.x"
_MOMENTS = ", ".join(f"{e} AS {k}" for k, e in MOMENTS.items())


def ssim(x: np.ndarray) -> np.ndarray:
    """Mean similarity of two planes of a stack, as 1 x 1 planes."""
    t, r = x[:, :1], x[:, 1:]
    mt, mr, tt, rr, tr = (PL.blur(v, 1.5, 11) for v in (t, r, t * t, r * r, t * r))
    s = (2 * mt * mr + 1e-4) * (2 * (tr - mt * mr) + 9e-4) / ((mt * mt + mr * mr + 1e-4) * (tt - mt * mt + rr - mr * mr + 9e-4))
    return s.mean((-2, -1), keepdims=True)


def ssim_gaussian(spark: SparkSession, sf_dir: str) -> DataFrame:
    img = signals.images(spark, sf_dir)
    pairs = img.withColumnRenamed("v", "t").join(img.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("r")), "vec_id")
    return PL.filtered(pairs, ssim, ["t", "r"], ["s"], ["vec_id"]).select("vec_id", F.round(F.col("s")[0], 6).alias("ssim"))


_MOSAIC = [f"named_struct('c', {c}, 'v', t{c})" for c in range(4)]
_CODE = "CAST(floor(255e0 * pow(least(greatest(v / 200e0, 0e0), 1e0), 4.54545454545454e-1) + 5e-1) AS INT)"
_AT = "vec_id, CAST(y + 8 * floor(c / 2e0) AS INT) AS y, CAST(x + 8 * (c % 2) AS INT) AS x"


def channel_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Temporal channels of the test side, two by two in one picture, as 8-bit codes."""
    planes = V._of_frames(V.planes(spark, sf_dir))
    wide = PL.long(planes, ["t0", "t1", "t2", "t3"], ["vec_id"]).selectExpr("vec_id", "y", "x", f"inline(array({', '.join(_MOSAIC)}))")
    return wide.selectExpr("vec_id", "CAST(y + 8 * floor(c / 2e0) AS INT) AS y", "CAST(x + 8 * (c % 2) AS INT) AS x", f"{_CODE} AS code")


QUERIES |= {"ssim_gaussian": ssim_gaussian, "channel_dump": channel_dump}
ORACLES |= {
    "ssim_gaussian": f"WITH img AS ({signals.IMAGES_DUCKDB}), mo AS (SELECT vec_id, y, x, {_MOMENTS} FROM ({_PAIRS.format(img='img')}) AS p) SELECT vec_id, round(avg({SIMILAR}), 6) AS ssim FROM {L.separable_sql('mo', WINDOW, WINDOW, values=tuple(MOMENTS))} AS z GROUP BY vec_id",
    "channel_dump": f"WITH {V.PLANES_SQL}, l AS (" + " UNION ALL ".join(f"SELECT vec_id, y, x, {c} AS c, t{c} AS v FROM g0" for c in range(4)) + f") SELECT {_AT}, {_CODE} AS code FROM l",
}
