"""Clips of 8 x 8 frames through the whole chain: temporal channels, contrast, cross-channel masking, pooling, heatmaps.

Sides are paired by one aggregation, frames filtered over time by a second shuffle of their blocks, and clips pooled by a third.
A single-plane clip feeds every channel with its luminance.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vireo.functions import expressions as E
from vireo.operators import linear as L
from vireo.operators import planes as P
from vireo.operators import visibility as V
from vireo.operators.temporal import temporal_channels
from vireo.plans import image_queries as I
from vireo.sources import signals

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
num = E.num

CHANNELS = ("Ysust", "RG", "YV", "Ytrans")
FRAMES, FPS = 10, 30
#: Planes of a row: test and reference by channel.
PLANES = [f"{s}{c}" for s in "tr" for c in range(4)]
D, M, S = ([f"{x}{c}" for c in range(4)] for x in "dms")

#: Frames: vectors in order of id, FRAMES a clip; a clip's reference is the next clip.  Frames without a reference count as zeros while others of their clip have one.
CLIPS = f"SELECT a.vec_id, a.y, a.x, a.v AS t, b.v AS r FROM {{img}} a JOIN {{img}} b ON b.vec_id = a.vec_id + {FRAMES} AND b.y = a.y AND b.x = a.x"


def planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """clip, frame, h, w and the filtered planes, in light of the standard display; frames without a reference count as zeros, as in the SQL."""
    lit = signals.images(spark, sf_dir).withColumn("v", F.expr(f"transform(v, e -> {E.display_forward('e')})"))
    clip = F.expr(f"vec_id DIV {FRAMES}")
    sided = lit.select(F.explode(F.array(F.struct(clip.alias("clip"), F.lit("t").alias("side")), F.struct((clip - 1).alias("clip"), F.lit("r").alias("side")))).alias("s"), (F.col("vec_id") % FRAMES).alias("frame"), "h", "w", "v")
    side = lambda s: F.first(F.when(F.col("s.side") == s, F.col("v")), ignorenulls=True).alias(s)
    paired = sided.groupBy(F.col("s.clip").alias("clip"), "frame").agg(F.first("h").alias("h"), F.first("w").alias("w"), side("t"), side("r"))
    return temporal_channels(paired.where("t IS NOT NULL AND r IS NOT NULL"), FPS, ["t", "r"], span=FRAMES)


def _of_frames(df: DataFrame) -> DataFrame:
    return df.withColumn("vec_id", F.col("clip") * FRAMES + F.col("frame"))


def mask_cross_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = P.over_planes(planes(spark, sf_dir), I.MODEL.differences, PLANES, D, ["clip", "frame"])
    return I._samples(_of_frames(made), D, ["vec_id", "band"], 4)


def video_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _of_frames(V.band_values(planes(spark, sf_dir), PLANES, ["clip", "frame"]))
    return held.select("vec_id", *(F.round(V.norm(F.col("channels")[c], 4), 4).alias(f"q{c}") for c in range(4)))


def video_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of each clip: channels, then frames."""
    scores = V.video_scores(planes(spark, sf_dir), PLANES, ["clip"])
    return scores.select("clip", "frames", F.round("q", 4).alias("q"), F.round("score", 4).alias("score"))


def heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences of all channels by band, put together again from coarse to fine, as the share of quality lost."""
    return I._samples(_of_frames(V.heatmaps(planes(spark, sf_dir), PLANES, ["clip", "frame"])).withColumnRenamed("heat", "v"), digits=4)


# The same as SQL -----------------------------------------------------------------------------------------------


def temporal_rows(frames: int = FRAMES, fps: float = FPS) -> list[tuple[int, int, float, float, float, float]]:
    """(o, i, w0..w3): output frame, input frame, weight by channel; the first frame repeats before the clip."""
    out = {}
    for c, name in enumerate(CHANNELS):
        for k, w in enumerate(L.temporal_taps(fps, name)):
            for o in range(frames):
                out.setdefault((o, max(o - k, 0)), [0.0] * 4)[c] += w
    return [(o, i, *w) for (o, i), w in sorted(out.items())]


TAPS_SQL = "(VALUES " + ", ".join(f"({o}, {i}, {', '.join(num(x) for x in w)})" for o, i, *w in temporal_rows()) + ") AS h(o, i, w0, w1, w2, w3)"


def _apart_sql(g: str, e: str, factor: int) -> str:
    return ", ".join(f"{factor} * least(({g}.{p} - {e}.{p}) / greatest({e}.{p[0]}0, 1e-2), 1e3) AS {p}" for p in PLANES)


_sense = lambda c: "(CASE band " + " ".join(f"WHEN {b} THEN {I.MODEL.sensitivity.sql('lb', rho, c)}" for b, rho in enumerate(I.RHO)) + " END)"
_scaled = lambda side, c: f"({side}{c} * s{c} * {num(V.GAIN[c])})"
_MUTUAL = [f"least(abs({_scaled('t', c)}), abs({_scaled('r', c)})) AS m{c}" for c in range(4)]
_masking = lambda cc: "(" + " + ".join(f"{num(2 ** V.CROSS[c][cc])} * {E.safe_pow(f'(m{c} * {num(10**V.MASK_C)})', V.MASK_Q[c])}" for c in range(4)) + ")"
_raw = lambda c: E.safe_pow(f"abs({_scaled('t', c)} - {_scaled('r', c)})", V.MASK_P)
_DIFFERENCE = [f"(CASE WHEN band = 2 THEN abs(t{c} - r{c}) * s{c} ELSE {E.clamp_difference(f'({_raw(c)} / (1e0 + {_masking(c)}))')} END) AS d{c}" for c in range(4)]
_base = lambda c: f"(CASE band WHEN 2 THEN {num(V.BASEBAND[c])} ELSE 1e0 END)"
_POOL = [f"{E.safe_pow(f'(sum({E.safe_pow(f"d{c}", 2)}) / count(*))', 0.5)} AS q{c}" for c in range(4)]
_BANDS = [f"{E.safe_pow(f'sum({E.safe_pow(f"(q{c} * {num(V.CHANNEL_WEIGHT[c])} * {_base(c)})", 4)})', 0.25)} AS q{c}" for c in range(4)]
_OVER = E.safe_pow("(" + " + ".join(E.safe_pow(f"q{c}", 4) for c in range(4)) + ")", 0.25)
_CLIP = E.safe_pow(f"(sum({E.safe_pow('q', 2)}) / count(*))", 0.5)
_HEAT = E.safe_pow("(" + " + ".join(E.safe_pow(f"(d{c} * {num(V.CHANNEL_WEIGHT[c])} * {_base(c)})", 4) for c in range(4)) + ")", 0.25)
_sep = lambda source, rows, columns, values: f"(SELECT * FROM {L.separable_sql(source, rows, columns, values=tuple(values))} AS z)"

PLANES_SQL = f"""img AS ({signals.IMAGES_DUCKDB}), lit AS (SELECT vec_id, y, x, {E.display_forward('t')} AS t, {E.display_forward('r')} AS r FROM ({CLIPS.format(img='img')}) AS c),
g0 AS (SELECT vec_id - vec_id % {FRAMES} + h.o AS vec_id, y, x, {', '.join(f'sum({p[0]} * h.w{p[1]}) AS {p}' for p in PLANES)} FROM lit JOIN {TAPS_SQL} ON vec_id % {FRAMES} = h.i GROUP BY vec_id - vec_id % {FRAMES} + h.o, y, x)"""
_DIFF_SQL = f"""{PLANES_SQL}, g1 AS {_sep('g0', I.R8, I.R8, PLANES)}, g2 AS {_sep('g1', I.R4, I.R4, PLANES)}, e0 AS {_sep('g1', I.X4, I.X4, PLANES)}, e1 AS {_sep('g2', I.X2, I.X2, PLANES)},
mean AS (SELECT vec_id, avg(greatest(t0, 1e-2)) AS mt, avg(greatest(r0, 1e-2)) AS mr FROM g2 GROUP BY vec_id),
con AS (SELECT vec_id, 0 AS band, y, x, log10(greatest(e0.r0, 1e-2)) AS lb, {_apart_sql('g0', 'e0', 1)} FROM g0 JOIN e0 USING (vec_id, y, x)
  UNION ALL SELECT vec_id, 1, y, x, log10(greatest(e1.r0, 1e-2)), {_apart_sql('g1', 'e1', 2)} FROM g1 JOIN e1 USING (vec_id, y, x)
  UNION ALL SELECT vec_id, 2, y, x, log10(mr), {', '.join(f'least({p} / m{p[0]}, 1e3)' for p in PLANES)} FROM g2 JOIN mean USING (vec_id)),
sen AS (SELECT *, {', '.join(f'{_sense(c)} AS s{c}' for c in range(4))} FROM con), mut AS (SELECT *, {', '.join(_MUTUAL)} FROM sen), fine AS (SELECT * FROM mut WHERE band = 0),
blur AS (SELECT vec_id, 0 AS band, y, x, {', '.join(f'{m} AS b{m}' for m in M)} FROM {L.separable_sql('fine', I.PHASE, I.PHASE, values=tuple(M))} AS z),
sig AS (SELECT vec_id, band, y, x, {', '.join(PLANES + S)}, {', '.join(f'coalesce(b{m}, {m}) AS {m}' for m in M)} FROM mut LEFT JOIN blur USING (vec_id, band, y, x)),
dif AS (SELECT vec_id, band, y, x, {', '.join(_DIFFERENCE)} FROM sig)"""
_POOL_SQL = f"{_DIFF_SQL}, p AS (SELECT vec_id, band, {', '.join(_POOL)} FROM dif GROUP BY vec_id, band), s AS (SELECT vec_id, {', '.join(_BANDS)} FROM p GROUP BY vec_id)"

QUERIES |= {"mask_cross_channel": mask_cross_channel, "video_channels": video_channels, "video_score": video_score, "heatmap": heatmap}
ORACLES |= {
    "mask_cross_channel": f"WITH {_DIFF_SQL} SELECT vec_id, band, y, x, {', '.join(f'round({d}, 4) AS {d}' for d in D)} FROM dif",
    "video_channels": f"WITH {_POOL_SQL} SELECT vec_id, {', '.join(f'round(q{c}, 4) AS q{c}' for c in range(4))} FROM s",
    "video_score": f"""WITH {_POOL_SQL}, f AS (SELECT vec_id // {FRAMES} AS clip, {_OVER} AS q FROM s), c AS (SELECT clip, count(*) AS frames, {_CLIP} AS q FROM f GROUP BY clip)
SELECT clip, frames, round(q, 4) AS q, round({E.jod('q')}, 4) AS score FROM c""",
    "heatmap": f"""WITH {_DIFF_SQL}, h AS (SELECT vec_id, band, y, x, {_HEAT} * (CASE band WHEN 1 THEN 5e-1 ELSE 1e0 END) AS v FROM dif),
h0 AS (SELECT * FROM h WHERE band = 0), h1 AS (SELECT * FROM h WHERE band = 1), h2 AS (SELECT * FROM h WHERE band = 2),
u1 AS (SELECT a.vec_id, a.y, a.x, a.v + b.v AS v FROM h1 a JOIN {_sep('h2', I.X2, I.X2, ['v'])} b USING (vec_id, y, x)),
u0 AS (SELECT a.vec_id, a.y, a.x, a.v + b.v AS v FROM h0 a JOIN {_sep('u1', I.X4, I.X4, ['v'])} b USING (vec_id, y, x))
SELECT vec_id, y, x, round(1 - {E.jod('v')} / 10, 4) AS v FROM u0""",
}

# Level counts and centre frequencies of the bands: one row a display, size and band -------------------------------------

_rows = [(d, h, b, f) for d, ppd in (("standard_4k", 75.4024493), ("standard_fhd", 37.8425039)) for h in (8, 64, 1080, 2160) for b, f in enumerate(V.band_frequencies(h, h, ppd))]
_SQL_BANDS = " UNION ALL ".join(f"SELECT '{d}' AS display, {h} AS height, {b} AS band, round({num(f)}, 4) AS rho" for d, h, b, f in _rows)
QUERIES["band_frequencies"] = lambda spark, sf_dir: spark.sql(_SQL_BANDS)
ORACLES["band_frequencies"] = _SQL_BANDS
