"""What a metric reports besides its score: features by channel and band, distograms, coloured heatmaps, dumps of pyramids, parameters."""

from __future__ import annotations

import json
from datetime import date
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vireo.functions import displays as D
from vireo.functions import expressions as E
from vireo.operators import planes as P
from vireo.operators import visibility as V

# Colour maps of differences and the range of the difference that each spans; white in Y, RG, YV.
COLOR_MAPS = {
    "threshold": (0.1, ((0.2, 0.2, 1.0), (0.2, 1.0, 1.0), (0.2, 1.0, 0.2), (1.0, 1.0, 0.2), (1.0, 0.2, 0.2))),
    "supra_threshold": (0.3, ((0.2, 1.0, 1.0), (1.0, 1.0, 1.0), (1.0, 1.0, 0.2))),
    "monochromatic": (1.0, ((1.0, 1.0, 1.0), (1.0, 1.0, 1.0))),
}
WHITE = (1.0, 0.003775328226986, 0.010327227989383)
TO_RGB709 = E.folded(E.XYZ_TO_RGB709, np.linalg.inv(E.folded(E.LMS_TO_DKL, E.XYZ_TO_LMS)))
TONES, EMPTY = 1024, 0.2716


#: What a file of features says of its clip besides the features.
ABOUT = "rho_band array<double>, frames_per_second double, width int, height int, N_frames int"


def features_json(values: DataFrame, by: str = "clip", about: list[str] = []) -> DataFrame:
    """by, features: a JSON object with, for each channel and band, a key (t0_b0, ...) whose value is a list over frames in a list for
    the batch of one, and at the same level N_frames and the columns ``about``.

    values: by, frame, channels (V.band_values; files hold them unweighted) and ``about``, which are equal for all frames of a
    clip.  Frames are gathered by clip, a few numbers each.
    """
    each = values.select(by, "frame", *about, F.posexplode("channels").alias("c", "bands")).select(by, "frame", *about, "c", F.posexplode("bands").alias("b", "q"))
    name = F.format_string("t%d_b%d", "c", "b")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("frame", "q"))), lambda s: s["q"])
    lists = each.groupBy(by, name.alias("k")).agg(ordered.alias("v"), *(F.first(c).alias(c) for c in about))
    gathered = lists.groupBy(by).agg(F.max(F.size("v")).alias("N_frames"), *(F.first(c).alias(c) for c in about), F.map_from_entries(F.collect_list(F.struct("k", F.array("v")))).alias("held"))
    # two objects as one: the first without its closing brace, the second without its opening one
    apart = gathered.select(by, F.to_json(F.struct(*about, "N_frames")).alias("head"), F.to_json("held").alias("lists"))
    return apart.select(by, F.expr("concat(substring(head, 1, length(head) - 1), ',', substring(lists, 2))").alias("features"))


def read_features(rows: DataFrame, by: str = "clip", text: str = "features") -> DataFrame:
    """by, batch, channel, band, frame, q: every list of features whose key names a channel and a band, however many there are."""
    lists = rows.select(by, F.explode(F.from_json(text, "map<string,string>")).alias("k", "v")).where(F.col("k").rlike("^t[0-9]+_b[0-9]+$"))
    frames = lists.select(by, "k", F.posexplode(F.from_json("v", "array<array<double>>")).alias("batch", "v"))
    number = lambda p: F.regexp_extract("k", p, 1).cast("int")
    return frames.select(by, "batch", number("^t([0-9]+)").alias("channel"), number("_b([0-9]+)$").alias("band"), F.posexplode("v").alias("frame", "q"))


def read_about(rows: DataFrame, by: str = "clip", text: str = "features") -> DataFrame:
    """by and what the features say of their clip; what a file leaves out is null."""
    return rows.select(by, F.from_json(text, ABOUT).alias("a")).select(by, "a.*")


def resampled_bands(q: Column, rho: list[float]) -> Column:
    """Band values (an array, base band last) at 64, 32, ... 0.5 cycles a degree, linear between bands and zero at 64, and the base band."""
    knots = ([64.0] if max(rho) < 64 else []) + rho
    value = lambda k: F.lit(0.0) if len(knots) > len(rho) and k == 0 else F.element_at(q, k + 1 - (len(knots) - len(rho)))
    out = []
    for at in 2.0 ** np.arange(6, -2, -1):
        k = next((i for i in range(len(knots) - 1) if knots[i] >= at >= knots[i + 1]), None)
        share = (knots[k] - at) / (knots[k] - knots[k + 1]) if k is not None else None
        out.append(F.lit(None).cast("double") if k is None else value(k) * float(1 - share) + value(k + 1) * float(share))
    return F.array(*out, F.element_at(q, -1))


def distogram(values: DataFrame, by: str = "clip", most: float | None = None) -> DataFrame:
    """by, channel, band (the base band first), frame, level: lost quality over ``most``, or the clip's largest, rounded up.

    values: V.band_values, whose channel and base-band weights are in already.
    """
    each = values.select(by, "frame", F.size("channels").alias("n"), F.posexplode("channels").alias("channel", "bands")).select(by, "frame", "n", "channel", F.size("bands").alias("m"), F.posexplode("bands").alias("b", "q"))
    lost = each.select(by, "frame", "channel", (F.col("m") - 1 - F.col("b")).alias("band"), (10 - F.expr(E.jod("(q * n)"))).alias("lost"))
    if most is not None:
        return lost.withColumn("level", F.least(F.greatest(F.col("lost") / most, F.lit(0.0)), F.lit(1.0))).drop("lost")
    top = lost.groupBy(by).agg(F.ceil(F.max("lost")).alias("top"))
    return lost.join(top, by).withColumn("level", F.least(F.greatest(F.col("lost") / F.col("top"), F.lit(0.0)), F.lit(1.0))).drop("lost", "top")


def _held(x: np.ndarray, knots: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Linear between knots, held below the first, continued above the last."""
    k = np.clip(np.searchsorted(knots, x), 1, len(knots) - 1)
    share = np.maximum((x - knots[k - 1]) / (knots[k] - knots[k - 1] + 1e-6), 0)
    return values[k - 1] + share * (values[k] - values[k - 1])


def tone_mapped(x: np.ndarray, spread: float = 0.6) -> np.ndarray:
    """Log luminance of one picture as tones, ``spread`` wide around 0.5.

    Samples that aren't positive count as the least positive one; a picture without any has the lowest tone throughout.  A range
    of logs below ``spread`` is rescaled; a wider one goes through the cumulated cube roots of its histogram.
    """
    lit, lowest = x > 0, (1 - spread) / 2
    if not lit.any():
        return np.full(x.shape, lowest)
    logs = np.log(np.where(lit, x, x[lit].min()))
    ends = logs.min(), logs.max()
    if np.ptp(ends) < spread:
        return lowest + spread * (logs - ends[0]) / (np.ptp(ends) + 1e-3)
    roots = np.cbrt(np.histogram(logs, TONES, ends)[0])
    return _held(logs, np.linspace(*ends, TONES), lowest + spread * np.cumsum(roots) / roots.sum())


def coloured(heat: np.ndarray, context: np.ndarray | None, kind: str = "supra_threshold") -> np.ndarray:
    """Red, green and blue (rows, 3, h, w) of heat (rows, h, w): the map's colour at unit luminance times the toned context."""
    top, colours = COLOR_MAPS[kind]
    hue = np.array(colours) / (np.array(colours) @ np.array(E.LUMA) + 1e-4)[:, None]
    tones = np.full(heat.shape, 0.5) if context is None else np.stack([tone_mapped(c) for c in context])
    knots = np.arange(len(colours)) * (top / (len(colours) - 1))
    return np.clip(np.stack([_held(np.clip(heat, 0, 1), knots, hue[:, c]) for c in range(3)], 1) * tones[:, None], 0, 1)


def coloured_heatmaps(pairs: DataFrame, columns: list[str], keep: list[str], model: V.Model = V.Model(), kind: str = "supra_threshold") -> DataFrame:
    """keep, h, w, red, green, blue: heatmaps over the reference's luminance."""

    def stencil(x):
        heat = next(model.heat(x))[1][:, 0]
        yield 0, coloured(heat, x[:, x.shape[1] // 2], kind)

    return P.over_planes(pairs, stencil, columns, ["red", "green", "blue"], keep).drop("band")


@lru_cache(64)
def _layout(sizes: tuple[tuple[int, int], ...], quadrants: int) -> tuple[int, int, np.ndarray]:
    """Height and width of a dump of bands of these sizes, and the place of every sample in it by quadrant, band, row and column.

    After an even band the next one lies its width and one sample to the right, after an odd one its height and one sample
    further down.  A quadrant is as tall as the first band and as wide as the first two, each with a sample more, in multiples of four.
    """
    size = np.array(sizes)
    even = np.arange(len(size)) % 2 == 0
    down, right = (np.cumsum(np.where(turn, size[:, k] + 1, 0)) - np.where(turn, size[:, k] + 1, 0) for k, turn in ((0, ~even), (1, even)))
    tall, wide = (4 * -(-int(n) // 4) for n in (size[0, 0] + 1, size[:2, 1].sum() + 1))
    rows, columns = (np.concatenate(v) for v in zip(*((np.repeat(np.arange(h) + y, w), np.tile(np.arange(w) + x, h)) for (h, w), y, x in zip(sizes, down, right))))
    of = np.arange(quadrants)[:, None]
    return 2 * tall, 2 * wide, (rows + of // 2 * tall) * 2 * wide + columns + of % 2 * wide


def _mosaic(bands: list[np.ndarray], fill: float) -> np.ndarray:
    """Bands (rows, channels, 3, h, w) as one picture (rows, 3, H, W): a quadrant a channel, bands placed right and down by turns."""
    n, quadrants = bands[0].shape[:2]
    tall, wide, places = _layout(tuple(b.shape[-2:] for b in bands), quadrants)
    out = np.full((n, 3, tall * wide), fill)
    out[:, :, places] = np.concatenate([b.reshape(n, quadrants, 3, -1) for b in bands], -1).swapaxes(1, 2)
    return out.reshape(n, 3, tall, wide)


def _codes(x: np.ndarray) -> np.ndarray:
    return np.floor(np.clip(np.maximum(x, 0) ** (1 / 2.2) * 255, 0, 255))


#: Channels of a dump by quadrant: Y sustained, Y transient, RG, YV.
QUADRANTS = (0, 3, 1, 2)


def temporal_dump(frames: DataFrame, clip: list[str]) -> DataFrame:
    """clip, frame, h, w, red, green, blue: 8-bit codes of the test side's channels t0..t3 in colour, a quadrant a channel.

    Y sustained is shown as it is, the others over a grey of a quarter; all over the clip's brightest sample of Y sustained, which
    one aggregation finds.
    """
    white = np.array(WHITE)
    sustained = lambda x: _tinted(x[:, :1], 0, white)
    tops = P.filtered(frames, lambda x: sustained(x).max((1, 2, 3))[:, None, None, None], ["t0"], ["top"], clip)
    tops = tops.groupBy(*clip).agg(F.max(F.col("top")[0]).alias("_top"))

    def shown(x, top):
        grey = white * (1 + top / 4)
        parts = [sustained(x), *(_tinted(x[:, q : q + 1] + white[k] * top / 4, k, grey) for q, k in ((3, 0), (1, 1), (2, 2)))]
        rows = [np.concatenate(parts[k : k + 2], -1) for k in (0, 2)]
        return _codes(np.concatenate(rows, -2) / top)

    return P.filtered(frames.join(tops, clip), shown, [f"t{c}" for c in range(4)], ["red", "green", "blue"], [*clip, "frame"], of="_top")


def _tinted(x: np.ndarray, k: int, rest: np.ndarray) -> np.ndarray:
    """Red, green and blue of planes (rows, 1, h, w) as component k of Y, RG, YV, whose other components are ``rest``."""
    dkl = np.broadcast_to(rest[None, :, None, None], (len(x), 3, *x.shape[2:])).copy()
    dkl[:, k] = x[:, 0]
    return np.einsum("nchw,dc->ndhw", dkl, TO_RGB709)


#: Previews of displays: whether colours are linear (of BT.709) or codes (PQ of BT.2020), and whether sides lie in one picture.
PREVIEWS = {"dm_preview": (False, False), "dm_preview_sbs": (False, True), "dm_preview_exr": (True, False), "dm_preview_exr_sbs": (True, True)}


def previews(pairs: DataFrame, kind: str) -> DataFrame:
    """clip, frame (and display, if pairs have one), h, w, red, green, blue of what displays show: with sides in one picture, along the shorter axis,
    test first; else of both, as columns test_red.. and reference_red.."""
    linear, beside = PREVIEWS[kind]
    by = ["clip", "frame", *(["display"] if "display" in pairs.columns else [])]
    pairs = D.with_display(pairs) if "display" in pairs.columns else pairs
    shown = D.SHOWN if "display" in pairs.columns else None

    def light(x, display):
        lit = display.light(x)
        if linear:
            return np.einsum("nchw,dc->ndhw", lit, display.to(E.XYZ_TO_RGB709))
        y = (np.clip(np.einsum("nchw,dc->ndhw", lit, display.to(E.XYZ_TO_RGB2020)), 0, 10000) / 10000) ** E.PQ_N
        return ((E.PQ_C2 * y + E.PQ_C1) / (1 + E.PQ_C3 * y)) ** E.PQ_M

    def stencil(x, *of):
        display = D.Display(*of[0]) if of else D.Display()
        sides = [light(x[:, :3], display), light(x[:, 3:], display)]
        return np.concatenate(sides, (-1 if x.shape[-1] < x.shape[-2] else -2) if beside else 1)

    colours = ["red", "green", "blue"]
    return P.filtered(pairs, stencil, [f"{s}{k}" for s in "tr" for k in range(3)], colours if beside else [f"{s}_{c}" for s in ("test", "reference") for c in colours], by, of=shown)


def pyramid_dump(x: np.ndarray, model: V.Model = V.Model()):
    """Test side's contrast bands as one coloured picture of 8-bit codes."""
    half, made = x.shape[1] // 2, []
    for _, c, _ in V.contrast_bands(x, len(model.bands(x)), model.contrast):
        planes = []
        for q in QUADRANTS[: half if half == 4 else 1]:
            dkl = np.broadcast_to(np.array([WHITE[0] / 2, *WHITE[1:]])[None, :, None, None], (len(c), 3, *c.shape[2:])).copy()
            dkl[:, 0 if q in (0, 3) else q] += c[:, q]
            planes.append(np.einsum("nchw,dc->ndhw", dkl, TO_RGB709))
        made.append(np.stack(planes, 1))
    yield 0, _codes(_mosaic(made, 0.0))


def difference_dump(x: np.ndarray, model: V.Model = V.Model()):
    """Weighted differences by band as one grey picture of 8-bit codes."""
    made, n = [], len(model.bands(x))
    for k, d in model.differences(x):
        d = d * model.weights(d.shape[1], k == n - 1)[:, None, None]
        made.append(np.repeat(d[:, list(QUADRANTS[: d.shape[1] if d.shape[1] == 4 else 1])][:, :, None] / 10, 3, 2))
    yield 0, _codes(_mosaic(made, EMPTY))


def parameters(comment: str = "", stamp: bool = True) -> str:
    """The metric's parameters as JSON."""
    held = {"mask_p": V.MASK_P, "mask_c": V.MASK_C, "mask_q": list(V.MASK_Q), "xcm_weights": [w for row in V.CROSS for w in row], "baseband_weight": list(V.BASEBAND), "ch_trans_w": V.CHANNEL_WEIGHT[3], "d_max": V.D_MAX, "image_int": V.IMAGE, "jod_a": E.JOD_A, "jod_exp": E.JOD_EXP}
    return json.dumps(held | ({"calibration_date": date.today().isoformat()} if stamp else {}) | ({"comment": comment} if comment else {}))
