"""Queries over what a metric reports: features, distograms, tones, coloured heatmaps, dumps, parameters."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vireo.functions import expressions as E
from vireo.functions.lookup import interp
from vireo.operators import planes as P
from vireo.operators import reports as R
from vireo.operators import visibility as V
from vireo.plans import image_queries as I
from vireo.plans import video_queries as Q
from vireo.sources import signals

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
num = E.num


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.band_values(Q.planes(spark, sf_dir), Q.PLANES, ["clip", "frame"])


_WEIGHTED = [f"q{c} * {num(V.CHANNEL_WEIGHT[c])} * {Q._base(c)} AS w{c}" for c in range(4)]
#: Weighted band values, one row a clip, frame, channel and band.
_VALUES_SQL = f"WITH {Q._DIFF_SQL}, p AS (SELECT vec_id, band, {', '.join(Q._POOL)} FROM dif GROUP BY vec_id, band), w AS (SELECT vec_id, band, {', '.join(_WEIGHTED)} FROM p), f AS (" + " UNION ALL ".join(f"SELECT vec_id // 10 AS clip, CAST(vec_id % 10 AS INTEGER) AS frame, {c} AS channel, band, w{c} AS q FROM w" for c in range(4)) + ")"


def feature_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of clips to JSON and back, with all channels and bands found by their keys."""
    return R.read_features(R.features_json(_values(spark, sf_dir))).select("clip", "channel", "band", "frame", F.round("q", 4).alias("q"))


def feature_bands_resampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = _values(spark, sf_dir).select("clip", "frame", F.posexplode("channels").alias("channel", "q"))
    made = each.select("clip", "frame", "channel", F.posexplode(R.resampled_bands(F.col("q"), I.RHO)).alias("at", "q"))
    return made.select("clip", "frame", "channel", "at", F.round("q", 4).alias("q"))


def _bands_sql() -> str:
    knots, parts = [64.0, *I.RHO], []
    for i, at in enumerate(2.0 ** np.arange(6, -2, -1)):
        k = next(j for j in range(len(knots) - 1) if knots[j] >= at >= knots[j + 1])
        share = (knots[k] - at) / (knots[k] - knots[k + 1])
        value = lambda j: "0e0" if j == 0 else f"b{j - 1}"
        parts.append(f"SELECT clip, frame, channel, {i} AS at, round({value(k)} * {num(1 - share)} + {value(k + 1)} * {num(share)}, 4) AS q FROM b")
    parts.append("SELECT clip, frame, channel, 8 AS at, round(b2, 4) AS q FROM b")
    return f"{_VALUES_SQL}, b AS (SELECT clip, frame, channel, {', '.join(f'max(q) FILTER (band = {k}) AS b{k}' for k in range(3))} FROM f GROUP BY clip, frame, channel) " + " UNION ALL ".join(parts)


def distogram_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.distogram(_values(spark, sf_dir)).select("clip", "channel", "band", "frame", F.round("level", 4).alias("level"))


def tone_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images as tones; every third one with a small range."""
    held = signals.images(spark, sf_dir).withColumn("v", F.expr("transform(v, e -> CASE WHEN vec_id % 3 = 0 THEN 6e-1 + e * 1e-1 ELSE e * 9e1 END)"))
    return I._samples(P.filtered(held, lambda x: np.stack([[R.tone_mapped(p) for p in row] for row in x]), ["v"], keep=["vec_id"]))


_TONES_SQL = f"""WITH img AS ({signals.IMAGES_DUCKDB}), s AS (SELECT vec_id, y, x, CASE WHEN vec_id % 3 = 0 THEN 6e-1 + v * 1e-1 ELSE v * 9e1 END AS v FROM img),
c AS (SELECT vec_id, y, x, ln(greatest(v, min(CASE WHEN v > 0 THEN v END) OVER (PARTITION BY vec_id))) AS b FROM s),
m AS (SELECT *, min(b) OVER (PARTITION BY vec_id) AS low, max(b) OVER (PARTITION BY vec_id) AS high FROM c),
h AS (SELECT vec_id, bin, pow(count(*) / 64e0, 1e0 / 3e0) AS p FROM (SELECT vec_id, CAST(least(floor((b - low) / (high - low) * 1024e0), 1023e0) AS INT) AS bin FROM m WHERE high - low >= 6e-1) AS k GROUP BY vec_id, bin),
k AS (SELECT *, greatest(CAST(ceil((b - low) / (high - low) * 1023e0 - 1e-9) AS INT), 1) AS up FROM m),
t AS (SELECT k.vec_id, k.y, k.x, k.b, k.low, k.high, k.up, sum(p) AS whole, sum(CASE WHEN bin <= up - 1 THEN p ELSE 0e0 END) AS below, sum(CASE WHEN bin <= up THEN p ELSE 0e0 END) AS above FROM k JOIN h ON h.vec_id = k.vec_id GROUP BY k.vec_id, k.y, k.x, k.b, k.low, k.high, k.up)
SELECT vec_id, y, x, round((b - low) / (high - low + 1e-3) * 6e-1 + 2e-1, 6) AS v FROM m WHERE high - low < 6e-1
UNION ALL SELECT vec_id, y, x, round((below + greatest((b - (low + (up - 1) * (high - low) / 1023e0)) / ((high - low) / 1023e0 + 1e-6), 0e0) * (above - below)) / whole * 6e-1 + 2e-1, 6) FROM t"""


def heatmap_coloured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heatmaps of clips in colour; the context is left at one tone."""
    heat = Q._of_frames(V.heatmaps(Q.planes(spark, sf_dir), Q.PLANES, ["clip", "frame"]))
    made = P.filtered(heat, lambda x: R.coloured(x[:, 0], None), ["heat"], ["red", "green", "blue"], ["vec_id"])
    return I._samples(made, ["red", "green", "blue"], digits=3)


def _coloured_sql() -> str:
    top, colours = R.COLOR_MAPS["supra_threshold"]
    knots = [top * k / (len(colours) - 1) for k in range(len(colours))]
    hue = np.array(colours) / (np.array(colours) @ np.array(E.LUMA) + 1e-4)[:, None]
    rgb = [f"round({E.clamp(f'({interp(E.clamp('h', 0, 1), knots, list(hue[:, c]))} * 5e-1)', 0, 1)}, 3) AS {n}" for c, n in enumerate(("red", "green", "blue"))]
    inner = Q.ORACLES["heatmap"]
    return f"SELECT vec_id, y, x, {', '.join(rgb)} FROM ({inner.replace('round(1 - ', '(1 - ').replace(' / 10, 4) AS v FROM u0', ' / 10) AS h FROM u0')}) AS z"


def pyramid_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = P.over_planes(Q.planes(spark, sf_dir), lambda x: R.pyramid_dump(x), Q.PLANES, ["red", "green", "blue"], ["clip", "frame"])
    return I._samples(Q._of_frames(made), ["red", "green", "blue"], digits=0)


def difference_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = P.over_planes(Q.planes(spark, sf_dir), lambda x: R.difference_dump(x), Q.PLANES, ["red", "green", "blue"], ["clip", "frame"])
    return I._samples(Q._of_frames(made), ["red"], digits=0)


#: Where the bands of each quadrant lie: band, y, x within the quadrant; a quadrant has 12 x 16 samples.
_PLACES = "(VALUES (0, 0, 0), (1, 0, 9), (2, 5, 9)) AS pl(band, ay, ax)"
_code = lambda e: f"floor(least(greatest(pow(greatest({e}, 0e0), {num(1 / 2.2)}) * 255e0, 0e0), 255e0))"


def _dump_sql(source: str, picture: dict[str, str], values: list[str], empty: str) -> str:
    """Bands laid out on the canvas; samples that no band covers have the empty code."""
    quadrants = " UNION ALL ".join(f"SELECT vec_id, s.band, CAST(y + ay + {12 * (k // 2)} AS INTEGER) AS y, CAST(x + ax + {16 * (k % 2)} AS INTEGER) AS x, {c} AS c, {values[c]} AS v FROM {source} AS s JOIN {_PLACES} ON pl.band = s.band" for k, c in enumerate(R.QUADRANTS))
    canvas = "SELECT vec_id, CAST(i // 32 AS INTEGER) AS y, CAST(i % 32 AS INTEGER) AS x FROM (SELECT DISTINCT vec_id FROM l) AS n, range(768) AS g(i)"
    return f", l AS ({quadrants}) SELECT k.vec_id, k.y, k.x, {', '.join(f'coalesce({e}, {empty}) AS {n}' for n, e in picture.items())} FROM ({canvas}) AS k LEFT JOIN l USING (vec_id, y, x)"


_white = [num(R.WHITE[0] / 2), num(R.WHITE[1]), num(R.WHITE[2])]
_dkl = [f"({_white[k]} + CASE WHEN c IN ({', '.join(map(str, own))}) THEN v ELSE 0e0 END)" for k, own in enumerate(((0, 3), (1,), (2,)))]
_pyramid = {n: f"CASE WHEN v IS NOT NULL THEN {_code(e)} END" for n, e in zip(("red", "green", "blue"), E.matrix(R.TO_RGB709, _dkl))}
QUERIES |= {"feature_bands": feature_bands, "feature_bands_resampled": feature_bands_resampled, "distogram_matrix": distogram_matrix, "tone_mapping": tone_mapping, "heatmap_coloured": heatmap_coloured, "pyramid_dump": pyramid_dump, "difference_dump": difference_dump}
ORACLES |= {
    "feature_bands": f"{_VALUES_SQL} SELECT clip, channel, band, frame, round(q, 4) AS q FROM f",
    "feature_bands_resampled": _bands_sql(),
    "distogram_matrix": f"{_VALUES_SQL}, x AS (SELECT clip, frame, channel, 2 - band AS band, 10 - {E.jod('(q * 4)')} AS lost FROM f) SELECT clip, channel, band, frame, round({E.clamp('(lost / ceil(max(lost) OVER (PARTITION BY clip)))', 0, 1)}, 4) AS level FROM x",
    "tone_mapping": _TONES_SQL,
    "heatmap_coloured": _coloured_sql(),
    "pyramid_dump": f"WITH {Q._DIFF_SQL}{_dump_sql('con', _pyramid, [f't{c}' for c in range(4)], '0e0')}",
    "difference_dump": f"WITH {Q._DIFF_SQL}, wd AS (SELECT vec_id, band, y, x, {', '.join(f'd{c} * {num(V.CHANNEL_WEIGHT[c])} * {Q._base(c)} / 10e0 AS d{c}' for c in range(4))} FROM dif){_dump_sql('wd', {'red': f'CASE WHEN v IS NOT NULL THEN {_code("v")} END'}, Q.D, _code(num(R.EMPTY)))}",
}
