"""Visible differences of test and reference planes: contrast pyramids, sensitivity, masking, pooling, heatmaps.

Stacks hold a row's planes as (rows, planes, h, w): first the test side by channel (Y sustained, RG, YV, Y transient), then the
reference side; one plane a side stands for Y alone.  Everything up to pooled band values happens in the task that holds the
row, band by band.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vireo.functions import expressions as E
from vireo.functions.lookup import Sensitivity, stand_in
from vireo.operators import planes as P

# Exponents and weights of masking and pooling; rows of CROSS are the masking channels, as log2 weights.
MASK_P, MASK_C = 2.264355182647705, -0.7954971194267273
MASK_Q = (1.302622675895691, 2.8885908126831055, 3.6807713508605957, 3.588787317276001)
GAIN, ADDED_GAIN = (1.0, 1.45, 1.0, 1.0), (1.0, 1.7, 0.237, 1.0)
BASEBAND = (0.0036334486212581396, 1.6627724170684814, 4.11874532699585, 25.25969886779785)
CROSS = (
    (-0.18950104713439941, -5.962151050567627, -4.31834602355957, -1.9321587085723877),
    (2.5655593872070312, 0.34406712651252747, -2.719646453857422, -0.4970424771308899),
    (3.8118371963500977, -1.0051705837249756, -0.5193376541137695, -0.5653647780418396),
    (-7.054771423339844, -5.527150630950928, -3.5106418132781982, -2.08804988861084),
)
CHANNEL_WEIGHT = (1.0, 1.0, 1.0, 0.8081134557723999)
IMAGE, D_MAX, PHASE, TEXTURE = 0.577918291091919, E.D_MAX, 3, 8
LOG_SLOPE, LOG_LMS = 0.5, (0.7347, 0.3163)

CONTRASTS = ("weber_g1", "weber_g1_ref", "weber_g0_ref", "log")
MODELS = ("none", "transducer", "transducer-texture", "mutual", "mutual-old", "similarity", "perceptual", "perceptual-smooth", "perceptual-gain")


def band_frequencies(height: int, width: int, ppd: float, least: float = 0.2, base: float = 0.1) -> list[float]:
    """Cycles a degree by band, the base band last.

    The finest band lies at half the pixels a degree, the k-th after it at 0.3228 * 2^(1 - k) of that.  Bands go on until one is
    at or below ``least``, but not further than the shorter side halves to two samples.
    """
    top = ppd / 2
    until = 0 if top <= least else max(1, 1 + math.ceil(math.log2(0.3228 * top / least)))
    n = max(0, min(until + 1, int(math.log2(min(height, width))) - 1))
    return [top * (1.0 if k == 0 else 0.3228 * 2.0 ** (1 - k)) for k in range(n)] + [base]


def safe_pow(x: np.ndarray, p) -> np.ndarray:
    return (x + E.EPSILON) ** p - E.EPSILON**p


def pow_even(x: np.ndarray, p: float) -> np.ndarray:
    return np.maximum(x, E.EPSILON) ** p + np.maximum(-x, E.EPSILON) ** p - E.EPSILON**p


def contrast_of(layer: np.ndarray, around: np.ndarray | None, mode: str) -> tuple[np.ndarray, np.ndarray]:
    """Contrasts of a level of a pyramid and the log10 background of its reference side; around: the next level, expanded, none for the base."""
    if mode not in CONTRASTS:
        raise ValueError(f"no contrast named {mode}")
    base, half = around is None, layer.shape[1] // 2
    around = layer if base else around
    c = layer if base else layer - around
    if mode == "log":
        return c, LOG_SLOPE * (around[:, half : half + 1] - math.log10(LOG_LMS[0]) + math.log10(LOG_LMS[1]) - math.log10(sum(LOG_LMS)))
    sides = np.maximum((layer if mode == "weber_g0_ref" else around)[:, ::half], 0.01)  # Y of test and reference
    if mode.endswith("ref"):
        sides = np.repeat(sides[:, 1:], 2, 1)
    elif base:
        sides = sides.mean((-2, -1), keepdims=True)
    return np.minimum(c / np.repeat(sides, half, 1), 1000.0), np.log10(sides[:, 1:])


def contrast_bands(x: np.ndarray, bands: int, mode: str = "weber_g1", first: int = 0) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(band, contrasts of all planes, log10 background of the reference side), finest first; middle bands count twice.

    With ``first``, x is level ``first`` of the pyramid, and its bands are those from there on.
    """
    g = P.gaussian(x, bands - first)
    for k, layer in enumerate(g, first):
        base = k == bands - 1
        c, held = contrast_of(layer, None if base else P.expand(g[k + 1 - first], *layer.shape[-2:]), mode)
        yield k, c if base or k == 0 else 2 * c, held


@dataclass(frozen=True)
class Model:
    """How differences are seen: contrast, sensitivity, masking and clamping."""

    ppd: float = 75.4024493
    contrast: str = "weber_g1"
    masking: str = "mult-mutual"
    clamp: str = "soft"
    cross: bool = True
    added_gain: float = 1.0
    #: Whether pooled band values have the weights of channels and base bands.
    weighted: bool = True
    sensitivity: Sensitivity = field(default_factory=stand_in, compare=False)

    def bands(self, x: np.ndarray) -> list[float]:
        return band_frequencies(*x.shape[-2:], self.ppd)

    def sensed(self, log_l: np.ndarray, rho: float, channels: int) -> np.ndarray:
        return np.concatenate([self.sensitivity.of(log_l, rho, c) for c in range(channels)], 1)

    def spread(self, m: np.ndarray) -> np.ndarray:
        """Phase uncertainty: blurred where the plane is large enough."""
        return (P.blur(m, PHASE, 4 * PHASE + 1) if min(m.shape[-2:]) > 2 * PHASE else m) * 10**MASK_C

    def across(self, m: np.ndarray) -> np.ndarray:
        """Each channel's masking by all channels, or by itself alone."""
        n = m.shape[1]
        weight = 2.0 ** np.array(CROSS)[:n, :n]
        return np.einsum("nchw,cd->ndhw", m, weight if self.cross else np.diag(np.diag(weight)))

    def clamped(self, d: np.ndarray) -> np.ndarray:
        most = 10**D_MAX
        return {"none": lambda: d, "hard": lambda: np.minimum(d, most), "soft": lambda: most * d / (most + d)}[self.clamp]()

    def masked(self, t: np.ndarray, r: np.ndarray, s: np.ndarray) -> np.ndarray:
        """Difference of contrasts t and r under the masking model."""
        kind, name = self.masking.split("-", 1)
        if kind not in ("add", "mult") or name not in MODELS:
            raise ValueError(f"no masking model named {self.masking}")
        by_channel = lambda v: np.array(v[: t.shape[1]])[:, None, None]
        q = by_channel(MASK_Q)
        if kind == "add":
            t, r = (np.sign(v) * np.maximum((np.abs(v) - 1 / s) * self.added_gain * by_channel(ADDED_GAIN) + 1, 0) for v in (t, r))
        else:
            t, r = (v * s * (1 if name in ("mutual-old", "perceptual", "perceptual-smooth") else by_channel(GAIN)) for v in (t, r))
        if name == "none":
            return self.clamped(np.abs(t - r))
        if name.startswith("transducer"):
            t, r = (10**D_MAX * pow_even(v, MASK_P) / (0.2 + self.spread(self.across(safe_pow(np.abs(v), q)))) for v in (t, r))
            if name == "transducer" or min(t.shape[-2:]) <= 2 * TEXTURE:
                return np.abs(t - r)
            smooth = lambda v: P.blur(v, TEXTURE, 4 * TEXTURE + 1)
            deviation = lambda v: np.sqrt(np.maximum(smooth(v * v) - smooth(v) ** 2, 0))
            return np.abs(smooth(t) - smooth(r)) + np.abs(deviation(t) - deviation(r))
        if name == "similarity":
            most, (mt, mr) = 10**D_MAX, (self.spread(self.across(np.abs(v))) for v in (t, r))
            return most - most * (2 * np.abs(t) * np.abs(r) + most - 1) / (mt * mt + mr * mr + most - 1)
        m = self.spread(np.minimum(np.abs(t), np.abs(r)))
        d = safe_pow(np.abs(t - r), MASK_P)
        if name == "mutual-old":
            d /= 1 + safe_pow(self.across(m), q)
            return 10**D_MAX * d / (10**D_MAX + d)
        if name.startswith("perceptual"):
            if name == "perceptual-smooth":
                most, d = 10**D_MAX, np.abs(t - r) ** MASK_P
                d = (most * d + 1) / (most + d)
            return self.clamped(d / (1 + safe_pow(self.across(m), q)))
        return self.clamped(d / (1 + self.across(safe_pow(m, q))))

    def differences(self, x: np.ndarray, rho: list[float] | None = None, first: int = 0) -> Iterator[tuple[int, np.ndarray]]:
        """(band, differences by channel) of a stack; with ``first``, of level ``first`` of a pyramid with bands at ``rho``."""
        rho = rho or self.bands(x)
        for k, c, log_l in contrast_bands(x, len(rho), self.contrast, first):
            yield k, self.difference(c, log_l, rho[k], k == len(rho) - 1)

    def difference(self, c: np.ndarray, log_l: np.ndarray, rho: float, base: bool) -> np.ndarray:
        """Differences by channel of a band's contrasts; the base band isn't masked."""
        half = c.shape[1] // 2
        t, r, s = c[:, :half], c[:, half:], self.sensed(log_l, rho, half)
        return np.abs(t - r) * s if base else self.masked(t, r, s)

    def weights(self, channels: int, base: bool) -> np.ndarray:
        return np.array(CHANNEL_WEIGHT[:channels]) * (np.array(BASEBAND[:channels]) if base else 1) if self.weighted else np.ones(channels)

    def pooled(self, x: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """One 1 x channels plane a band, bands side by side: weighted spatial norms of the differences."""
        n, q = len(self.bands(x)), []
        for k, d in self.differences(x):
            q.append(safe_pow(safe_pow(d, 2).mean((-2, -1)), 0.5) * self.weights(d.shape[1], k == n - 1))
        yield 0, np.stack(q, -1)[:, None]  # rows of the plane are channels, columns bands

    def patches(self, x: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(band, planes): for each channel mean and variance of the test side's contrast times sensitivity, of the reference side's, and
        of the difference, over windows as many samples wide as a degree of the finest band has, cut off at the far edges."""
        rho, half, width = self.bands(x), x.shape[1] // 2, math.ceil(self.ppd)
        for k, c, log_l in contrast_bands(x, len(rho), self.contrast):
            t, r, s = c[:, :half], c[:, half:], self.sensed(log_l, rho[k], half)
            d = np.abs(t - r) * s if k == len(rho) - 1 else self.masked(t, r, s)
            moments = np.stack([m for v in (np.abs(t) * s, np.abs(r) * s, d) for m in P.window_moments(v, width)], 2)
            yield k, moments.reshape(len(x), 6 * half, *moments.shape[-2:])

    def heat(self, x: np.ndarray, scale: float = 1.0) -> Iterator[tuple[int, np.ndarray]]:
        """Share of quality lost by sample: channels pooled in each band, bands put together again."""
        n, bands = len(self.bands(x)), []
        for k, d in self.differences(x):
            v = safe_pow(safe_pow(d * scale * self.weights(d.shape[1], k == n - 1)[:, None, None], 4).sum(1, keepdims=True), 0.25)
            bands.append(v if k in (0, n - 1) else v / 2)
        q = P.reconstruct(bands)
        yield 0, 1 - np.where(q <= E.JOD_KNEE, 10 - E.JOD_A * E.JOD_KNEE ** (E.JOD_EXP - 1) * q, 10 - E.JOD_A * np.maximum(q, E.JOD_KNEE) ** E.JOD_EXP) / 10


def norm(values: Column, p: float, mean: bool = False) -> Column:
    """p-norm of an array, in the JVM."""
    e = float(E.EPSILON)
    power = lambda v, k: F.pow(v + e, F.lit(float(k))) - float(e**k)
    total = F.aggregate(values, F.lit(0.0), lambda a, v: a + power(v, p))
    return power(total / F.size(values) if mean else total, 1 / p)


def shown_on(model: Model, numbers: tuple) -> Model:
    """The model for a display (the values of its struct): bands lie at its frequencies."""
    return replace(model, ppd=numbers[-1])


def band_values(pairs: DataFrame, columns: list[str], keep: list[str], model: Model = Model(), display: str | None = None) -> DataFrame:
    """keep, channels: for each channel an array of its weighted band values; one row a pair of frames, no shuffle.

    ``display`` names the column of the row's display, if rows differ in theirs.
    """
    stencil = (lambda x, numbers: shown_on(model, numbers).pooled(x)) if display else model.pooled
    made = P.over_planes(pairs, stencil, columns, ["q"], keep, display)
    return made.select(*keep, F.transform(F.sequence(F.lit(0), F.col("h") - 1), lambda c: F.slice("q", c * F.col("w") + 1, F.col("w"))).alias("channels"))


def frame_values(pairs: DataFrame, columns: list[str], keep: list[str], model: Model = Model(), display: str | None = None) -> DataFrame:
    """keep, q: pooled over bands, then channels."""
    return band_values(pairs, columns, keep, model, display).select(*keep, norm(F.transform("channels", lambda b: norm(b, 4)), 4).alias("q"))


def image_scores(pairs: DataFrame, columns: list[str], keep: list[str], model: Model = Model(), display: str | None = None) -> DataFrame:
    """keep, q and score of image pairs; 10 means identical."""
    q = frame_values(pairs, columns, keep, model, display).withColumn("q", F.col("q") * IMAGE)
    return q.withColumn("score", F.expr(E.jod("q")))


def video_scores(pairs: DataFrame, columns: list[str], clip: list[str], model: Model = Model(), display: str | None = None) -> DataFrame:
    """clip, frames, q and score; frames are pooled by one aggregation."""
    q = frame_values(pairs, columns, clip, model, display).groupBy(*clip)
    pooled = q.agg(F.count(F.lit(1)).alias("frames"), F.expr(E.safe_pow(f"(sum({E.safe_pow('q', 2)}) / count(*))", 0.5)).alias("q"))
    return pooled.withColumn("score", F.expr(E.jod("q")))


def heatmaps(pairs: DataFrame, columns: list[str], keep: list[str], model: Model = Model(), image: bool = False) -> DataFrame:
    """keep, h, w and the plane ``heat``."""
    return P.over_planes(pairs, lambda x: model.heat(x, IMAGE if image else 1.0), columns, ["heat"], keep).drop("band")
