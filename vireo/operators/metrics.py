"""Metrics by name, evaluated over pairs of frames, and their results as a table.

A metric over frames is a function from stacks of test and reference planes (rows, colours, h, w) and the display to a number a
row, whose mean over a clip's frames gives the value.  All such metrics are evaluated in one pass over the pairs and one aggregation.
A metric with a plan of its own is a function from pairs and options to results by clip.

Pairs (clip, frame, h, w, t0.., r0..) may name their display in a column ``display``; clips then come out by display.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vireo.functions import displays as D
from vireo.functions import expressions as E
from vireo.operators import planes as P
from vireo.operators import visibility as V
from vireo.operators.temporal import temporal_channels


@dataclass(frozen=True)
class Metric:
    unit: str
    #: (t, r, display, options) to a number a row, and the value from its mean; or (pairs, options) to rows (by, value).
    kernel: Callable[..., np.ndarray] | None = None
    value: Callable[[Column], Column] | None = None
    plan: Callable[..., DataFrame] | None = None

    @property
    def options(self) -> set[str]:
        fns = [f for f in (self.kernel, self.plan) if f]
        return set().union(*({k for k, p in inspect.signature(f).parameters.items() if p.default is not p.empty} for f in fns))


METRICS: dict[str, Metric] = {}


def metric(name: str, unit: str):
    """Registers a plan under a name; users add their own the same way."""

    def put(fn):
        METRICS[name] = Metric(unit, plan=fn)
        return fn

    return put


def frame_metric(name: str, unit: str, value: Callable[[Column], Column] = lambda mean: mean):
    """Registers a function over frames under a name."""

    def put(fn):
        METRICS[name] = Metric(unit, kernel=fn, value=value)
        return fn

    return put


def _planes(pairs: DataFrame, side: str) -> list[str]:
    return [c for c in (f"{side}0", f"{side}1", f"{side}2") if c in pairs.columns]


def _by(pairs: DataFrame) -> list[str]:
    return ["clip", "display"] if "display" in pairs.columns else ["clip"]


def _decibels(peak: float) -> Callable[[Column], Column]:
    """Identical sides have an infinite ratio."""
    return lambda mse: F.when(mse > 0, 20 * F.log10(F.lit(float(peak)) / F.sqrt(mse))).otherwise(float("inf"))


def mixed(x: np.ndarray, matrix) -> np.ndarray:
    """Colour planes (axis 1) through a matrix; a single plane stands for all."""
    m = np.asarray(matrix, float)
    return np.einsum("nchw,dc->ndhw", x, m) if x.shape[1] == 3 else np.repeat(x, len(m), 1)


def pu(x: np.ndarray, kind: str = "banding_glare") -> np.ndarray:
    p = E.PU[kind]
    y = np.clip(x, 0.005, 10000) ** p[3]
    return p[6] * (((p[0] + p[1] * y) / (1 + p[2] * y)) ** p[4] - p[5])


WHITE = float(pu(np.array(100.0)))


def encoded(x: np.ndarray, display: D.Display) -> np.ndarray:
    """Codes of the display as they are; where its content is linear or PQ, perceptual codes of its light over that of 100 cd/m2."""
    return pu(display.light(x)) / WHITE if display.eotf in ("linear", "PQ") else x


def _mse(t: np.ndarray, r: np.ndarray) -> np.ndarray:
    return ((t - r) ** 2).mean((1, 2, 3))


@frame_metric("psnr_rgb", "dB", _decibels(1))
def psnr_rgb(t, r, display):
    return _mse(encoded(t, display), encoded(r, display))


@frame_metric("pu_psnr_y", "dB", _decibels(WHITE))
def pu_psnr_y(t, r, display, encoded: bool = False):
    """Over the code of 100 cd/m2.  The published scores compare luminance as it is; ``encoded`` compares its codes."""
    t, r = (mixed(display.light(x), [display.to()[1]]) if x.shape[1] == 3 else display.light(x) for x in (t, r))
    return _mse(pu(t), pu(r)) if encoded else _mse(t, r)


@frame_metric("pu_psnr_rgb2020", "dB", _decibels(WHITE))
def pu_psnr_rgb2020(t, r, display, encoded: bool = False):
    t, r = (mixed(display.light(x), display.to(E.XYZ_TO_RGB2020)) if x.shape[1] == 3 else display.light(x) for x in (t, r))
    return _mse(pu(t), pu(r)) if encoded else _mse(t, r)


@frame_metric("ssim", "")
def ssim(t, r, display):
    """Structural similarity of luma with Gaussian windows, averaged over frames."""
    t, r = (mixed(s, [E.LUMA]) if s.shape[1] == 3 else s for s in (encoded(t, display), encoded(r, display)))
    mt, mr, tt, rr, tr = (P.blur(v, 1.5, 11) for v in (t, r, t * t, r * r, t * r))
    s = (2 * mt * mr + 1e-4) * (2 * (tr - mt * mr) + 9e-4) / ((mt * mt + mr * mr + 1e-4) * (tt - mt * mt + rr - mr * mr + 9e-4))
    return s.mean((1, 2, 3))


def opponent(x: np.ndarray, display: D.Display) -> np.ndarray:
    """Light of the display as Y, RG, YV; single planes stay single, as light."""
    return mixed(display.light(x), display.to(E.LMS_TO_DKL, E.XYZ_TO_LMS)) if x.shape[1] == 3 else display.light(x)


def seen(t, r, display, ppd: float | None = None, masking: str = "mult-mutual", contrast: str = "weber_g1"):
    """Pooled difference of images that is visible; a single plane feeds every channel."""
    display = _display((display,), ppd)
    sides = [np.repeat(s, 3, 1) if s.shape[1] == 1 else s for s in (opponent(t, display), opponent(r, display))]
    _, q = next(V.Model(ppd=display.ppd, masking=masking, contrast=contrast).pooled(np.concatenate(sides, 1)))
    over = lambda v: V.safe_pow(V.safe_pow(v, 4).sum(-1), 0.25)
    return over(over(q[:, 0]))


def _jod(q: Column) -> Column:
    q = q * V.IMAGE
    return F.when(q <= E.JOD_KNEE, 10 - E.JOD_A * E.JOD_KNEE ** (E.JOD_EXP - 1) * q).otherwise(10 - E.JOD_A * F.pow(q, F.lit(E.JOD_EXP)))


#: The visible difference of images, where no filter over time is needed.
IMAGES = Metric("JOD", kernel=seen, value=_jod)


@metric("visible_difference", "JOD")
def visible_difference(pairs: DataFrame, fps: float = 0, ppd: float | None = None, padding: str = "replicate", masking: str = "mult-mutual", contrast: str = "weber_g1") -> DataFrame:
    """Uncalibrated score of images (fps 0) or clips; 10 means identical.  ``ppd`` overrides that of the display."""
    if not fps:
        return _framed(pairs, {"visible_difference": IMAGES}, {"ppd": ppd, "masking": masking, "contrast": contrast}).drop("metric")
    planes, by, shown = [*_planes(pairs, "t"), *_planes(pairs, "r")], _by(pairs), D.SHOWN if D.SHOWN in pairs.columns else None
    half, model = len(planes) // 2, V.Model(ppd=ppd or D.Display().ppd, masking=masking, contrast=contrast)
    lit = P.filtered(pairs, lambda x, *of: np.concatenate([opponent(s, _display(of, ppd)) for s in (x[:, :half], x[:, half:])], 1), planes, keep=[*by, "frame", *([shown] if shown else [])], of=shown)
    # the display goes with its clip through the blocks of frames
    whole = lit.withColumn("clip", F.struct(*by, *([shown] if shown else [])))
    filtered = temporal_channels(whole, fps, planes, padding=padding).select("clip.*", *(f"{s}{c}" for s in "tr" for c in range(4)), "h", "w")
    if shown and ppd:
        filtered = filtered.withColumn(shown, F.col(shown).withField("ppd", F.lit(float(ppd))))
    return V.video_scores(filtered, [f"{s}{c}" for s in "tr" for c in range(4)], by, model, shown).select(*by, F.col("score").alias("value"))


def _display(of: tuple, ppd: float | None = None) -> D.Display:
    """From the values of a row's display, or a display; the default without any."""
    held = (of[0] if isinstance(of[0], D.Display) else D.Display(*of[0])) if of else D.Display()
    return D.Display(**(vars(held) | {"ppd": ppd})) if ppd else held


def _framed(pairs: DataFrame, metrics: dict[str, Metric], options: dict) -> DataFrame:
    """by, metric, value of metrics over frames: one pass over the pairs, one aggregation by clip."""
    planes, by, shown = [*_planes(pairs, "t"), *_planes(pairs, "r")], _by(pairs), D.SHOWN if D.SHOWN in pairs.columns else None
    half = len(planes) // 2
    calls = [(m.kernel, {k: v for k, v in options.items() if k in m.options}) for m in metrics.values()]

    def stencil(x, *of):
        display = _display(of)
        return np.stack([np.asarray(fn(x[:, :half], x[:, half:], display, **own)) for fn, own in calls], 1)[:, :, None, None]

    names = [f"m{k}" for k in range(len(metrics))]
    per = P.filtered(pairs, stencil, planes, names, by, of=shown)
    means = per.groupBy(*by).agg(*(F.avg(F.col(n)[0]).alias(n) for n in names))
    return means.select(*by, F.inline(F.array(*(F.struct(F.lit(name).alias("metric"), m.value(F.col(n)).alias("value")) for n, (name, m) in zip(names, metrics.items())))))


def evaluate(pairs: DataFrame, names: list[str], display: str | None = None, displays: DataFrame | None = None, spaces: dict | None = None, **options) -> DataFrame:
    """clip (and display, if pairs have that column), metric, value: all named metrics over all pairs.

    ``display`` names the display of all pairs; without it that of a pair's column counts, else the standard 4K display.
    ``displays`` and ``spaces`` are tables of displays and colour spaces besides the presets.  Each metric takes the options that it
    knows; an option or a name that none knows is an error.
    """
    unknown = [n for n in names if n not in METRICS]
    if unknown:
        raise ValueError(f"no metric named {', '.join(unknown)}")
    known = set().union(*(METRICS[n].options for n in names))
    if set(options) - known:
        raise TypeError(f"{', '.join(names)} have no options {', '.join(sorted(set(options) - known))}")
    by = _by(pairs)
    if display is not None:
        pairs = pairs.withColumn("display", F.lit(display))
    if "display" in pairs.columns:
        pairs = D.with_display(pairs, displays, spaces or D.SPACES)
    elif displays is not None or spaces is not None:
        raise ValueError("a table of displays needs a display's name")
    framed = {n: METRICS[n] for n in names if METRICS[n].kernel}
    if "visible_difference" in names and not options.get("fps"):
        framed["visible_difference"] = IMAGES
    parts = [_framed(pairs, framed, options)] if framed else []
    for name in names:
        if name not in framed:
            m = METRICS[name]
            parts.append(m.plan(pairs, **{k: v for k, v in options.items() if k in m.options}).select(*_by(pairs), F.lit(name).alias("metric"), "value"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(*by, "metric", "value")


def result_table(results: DataFrame, names: list[str]) -> DataFrame:
    """clip (and display) and one column a metric."""
    return results.groupBy(*_by(results)).pivot("metric", names).agg(F.first("value"))


def result_lines(results: DataFrame) -> DataFrame:
    """clip, line: name=value [unit] for each result."""
    units = F.create_map(*(F.lit(x) for k, m in METRICS.items() for x in (k, m.unit)))
    unit = units[F.col("metric")]
    return results.select(*_by(results), F.format_string("%s=%.4f%s", "metric", "value", F.when(unit == "", "").otherwise(F.concat(F.lit(" ["), unit, F.lit("]")))).alias("line"))


def write_results(results: DataFrame, names: list[str], folder: str) -> None:
    """The table as CSV with a header; a part file a task."""
    result_table(results, names).write.option("header", True).csv(folder)
