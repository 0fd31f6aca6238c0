"""Fitting the weights of pooling and the score's curve to quality that people gave.

Features are unweighted band values by condition and frame.  A step sums, by condition, the pooled values of its frames and their
derivatives, and then the normal equations of all conditions: two aggregations, both with partial sums in the tasks, and one row of
a few numbers for the driver.  Steps are damped Gauss-Newton ones; the derivatives of the norms are written out.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, fields, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vireo.functions import expressions as E
from vireo.operators import visibility as V

EPS = E.EPSILON


@dataclass(frozen=True)
class Parameters:
    """What is fitted: weights of the chromatic and transient channels, of the base band by channel, and the score's curve."""

    chromatic: float = V.CHANNEL_WEIGHT[1]
    transient: float = V.CHANNEL_WEIGHT[3]
    base0: float = V.BASEBAND[0]
    base1: float = V.BASEBAND[1]
    base2: float = V.BASEBAND[2]
    base3: float = V.BASEBAND[3]
    jod_a: float = E.JOD_A
    jod_exp: float = E.JOD_EXP

    def array(self) -> np.ndarray:
        return np.array([getattr(self, f.name) for f in fields(self)])

    def json(self) -> str:
        """In the layout of parameter files."""
        return json.dumps({"ch_chrom_w": self.chromatic, "ch_trans_w": self.transient, "baseband_weight": [self.base0, self.base1, self.base2, self.base3], "jod_a": self.jod_a, "jod_exp": self.jod_exp})


NAMES = [f.name for f in fields(Parameters)]
#: Parameters that act before frames are pooled.
WEIGHTS = 6


def _norm4(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The norm of the last axis with exponent 4, and its derivatives."""
    total = V.safe_pow(x, 4).sum(-1)
    return V.safe_pow(total, 0.25), ((total + EPS) ** -0.75)[..., None] * (x + EPS) ** 3


def pooled(q: np.ndarray, p: Parameters) -> tuple[np.ndarray, np.ndarray]:
    """Band values (frames, channels, bands) pooled over bands and channels: values by frame, derivatives by frame and weight."""
    n, channels, _ = q.shape
    kind = [0, 1, 1, 2][:channels]
    weight = np.array([1.0, p.chromatic, p.transient])[kind]
    base = np.array([p.base0, p.base1, p.base2, p.base3])[:channels]
    scaled = q.copy()
    scaled[:, :, -1] *= base
    bands, d_bands = _norm4(scaled * weight[:, None])
    value, d_channels = _norm4(bands)
    by_channel = d_channels * (d_bands * scaled).sum(-1)  # times the derivative of the channel's weight
    out = np.zeros((n, WEIGHTS))
    for c, k in enumerate(kind):
        if k:
            out[:, k - 1] += by_channel[:, c]
        out[:, 2 + c] += d_channels[:, c] * d_bands[:, c, -1] * q[:, c, -1] * weight[c]
    return value, out


def _sums(p: Parameters, by: str):
    """Frames (by, channels) to sums over a batch's frames: number, value, squared value, and the derivatives of both."""

    def run(batches):
        for b in batches:
            held = b.column(1).to_pylist()
            shapes: dict[tuple[int, int], list[int]] = {}
            for k, channels in enumerate(held):
                shapes.setdefault((len(channels), len(channels[0])), []).append(k)
            for own in shapes.values():
                value, d = pooled(np.array([held[k] for k in own], float), p)
                columns = [pa.array(v) for v in (value, V.safe_pow(value, 2), *d.T, *(2 * (value + EPS) * v for v in d.T))]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(own)), *columns], [by, "t", "s", *(f"dt{k}" for k in range(WEIGHTS)), *(f"ds{k}" for k in range(WEIGHTS))])

    return run


def conditions(features: DataFrame, p: Parameters, by: str = "id") -> DataFrame:
    """by, q (pooled over frames) and d (its derivatives by weight): frames summed by condition; a single frame counts as an image."""
    kind = features.schema[by].dataType.simpleString()
    sums = ["t", "s", *(f"dt{k}" for k in range(WEIGHTS)), *(f"ds{k}" for k in range(WEIGHTS))]
    each = features.select(by, "channels").mapInArrow(_sums(p, by), f"`{by}` {kind}, " + ", ".join(f"{s} double" for s in sums))
    total = each.groupBy(by).agg(F.count(F.lit(1)).alias("n"), *(F.sum(s).alias(s) for s in sums))
    mean, one = F.col("s") / F.col("n") + EPS, F.col("n") == 1
    q = F.when(one, F.col("t") * V.IMAGE).otherwise(F.sqrt(mean) - math.sqrt(EPS))
    d = F.array(*(F.when(one, F.col(f"dt{k}") * V.IMAGE).otherwise(F.col(f"ds{k}") / F.col("n") / 2 / F.sqrt(mean)) for k in range(WEIGHTS)))
    return total.select(by, q.alias("q"), d.alias("d"))


def predicted(q: Column, p: Parameters) -> tuple[Column, list[Column]]:
    """The score of a pooled difference, and its derivatives by q, jod_a and jod_exp."""
    a, e, knee = p.jod_a, p.jod_exp, E.JOD_KNEE
    low, slope = q <= knee, knee ** (e - 1)
    over = F.pow(F.greatest(q, F.lit(knee)), F.lit(e))
    lost = F.when(low, q * slope).otherwise(over)
    by_q = F.when(low, F.lit(-a * slope)).otherwise(over / q * (-a * e))
    by_e = F.when(low, q * (slope * math.log(knee))).otherwise(over * F.log(F.greatest(q, F.lit(knee))))
    return 10 - a * lost, [by_q, -lost, -a * by_e]


def parameter_files(rows: DataFrame, keep: list[str], comment: str = "", stamp: bool = True) -> DataFrame:
    """keep and ``text``: parameters (columns named as those of Parameters) in the layout of parameter files, a row a set."""
    held = [F.col("chromatic").alias("ch_chrom_w"), F.col("transient").alias("ch_trans_w"), F.array(*(f"base{c}" for c in range(4))).alias("baseband_weight"), "jod_a", "jod_exp"]
    stamps = ([F.date_format(F.current_date(), "yyyy-MM-dd").alias("calibration_date")] if stamp else []) + ([F.lit(comment).alias("comment")] if comment else [])
    return rows.select(*keep, F.to_json(F.struct(*held, *stamps)).alias("text"))


def read_parameter_files(rows: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """keep and the columns of Parameters; what a file leaves out has its usual value."""
    d = Parameters()
    f = F.from_json(text, "ch_chrom_w double, ch_trans_w double, baseband_weight array<double>, jod_a double, jod_exp double")
    each = {"chromatic": f["ch_chrom_w"], "transient": f["ch_trans_w"], **{f"base{c}": F.get(f["baseband_weight"], c) for c in range(4)}, "jod_a": f["jod_a"], "jod_exp": f["jod_exp"]}
    return rows.select(*keep, *(F.coalesce(v, F.lit(getattr(d, k))).alias(k) for k, v in each.items()))


def scores(features: DataFrame, p: Parameters = Parameters(), by: str = "id") -> DataFrame:
    """by and the score under the parameters."""
    return conditions(features, p, by).select(by, predicted(F.col("q"), p)[0].alias("score"))


def scored(rows: DataFrame, quality: DataFrame, by: str = "id", how: str = "inner") -> DataFrame:
    """Rows joined with their conditions' quality; neither side passes through the driver, though one may be small."""
    return rows.join(quality.hint("merge"), by, how)


def equations(features: DataFrame, quality: DataFrame, p: Parameters, by: str = "id", score: str = "jod") -> tuple[int, float, np.ndarray, np.ndarray]:
    """Number of conditions, their squared error, and the normal equations' matrix and right side: one row for the driver."""
    joined = scored(conditions(features, p, by), quality.select(by, F.col(score).cast("double").alias("_jod")).where("_jod IS NOT NULL"), by)
    made, (by_q, by_a, by_e) = predicted(F.col("q"), p)
    rows = joined.select((F.col("_jod") - made).alias("e"), F.array(*(F.col("d")[k] * by_q for k in range(WEIGHTS)), by_a, by_e).alias("j"))
    m = len(NAMES)
    pairs = [(a, b) for a in range(m) for b in range(a, m)]
    got = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("e") * F.col("e")).alias("sse"), *(F.sum(F.col("j")[a] * F.col("j")[b]).alias(f"m{a}_{b}") for a, b in pairs), *(F.sum(F.col("j")[a] * F.col("e")).alias(f"v{a}") for a in range(m))).first()
    if not got.n:
        raise ValueError("no condition has both features and a score")
    matrix = np.zeros((m, m))
    for a, b in pairs:
        matrix[a, b] = matrix[b, a] = got[f"m{a}_{b}"]
    return got.n, got.sse, matrix, np.array([got[f"v{a}"] for a in range(m)])


def damped(matrix: np.ndarray, right: np.ndarray, at: np.ndarray, free: np.ndarray, damping: float) -> np.ndarray:
    """The parameters after a step of the logarithms of the free ones, each within a factor of 4; those that next to nothing depends on stay."""
    effect = np.diag(matrix) * at * at
    own = free & (effect > 1e-12 * effect.max())
    by_log = np.diag(at[own])
    held = by_log @ matrix[np.ix_(own, own)] @ by_log
    step = np.zeros(len(right))
    step[own] = np.linalg.solve(held + damping * np.diag(np.diag(held)), by_log @ right[own])
    return at * np.exp(np.clip(step, -np.log(4), np.log(4)))


def fit(features: DataFrame, quality: DataFrame, start: Parameters = Parameters(), free: tuple[str, ...] = tuple(NAMES), steps: int = 20, tolerance: float = 1e-9, by: str = "id", score: str = "jod") -> tuple[Parameters, list[float]]:
    """The parameters with the least squared error of the scores, and the mean squared error after each step that lowered it.

    features: by, channels (unweighted, V.Model(weighted=False)), a row a frame; read once a step, so best a written table.
    quality: by and a score.  Conditions without either are left out.  Parameters stay positive.
    """
    chosen = np.array([n in free for n in NAMES])
    n, sse, matrix, right = equations(features, quality, start, by, score)
    p, errors, damping = start, [sse / n], 1e-3
    for _ in range(steps):
        moved = replace(p, **dict(zip(NAMES, damped(matrix, right, p.array(), chosen, damping).tolist())))
        n, after, *made = equations(features, quality, moved, by, score)
        if after < sse:
            done = sse - after <= tolerance * sse
            p, sse, (matrix, right), damping = moved, after, made, max(damping / 10, 1e-12)
            errors.append(sse / n)
            if done:
                break
        else:
            damping *= 10
            if damping > 1e9:
                break
    return p, errors


def condition_id(test: Column) -> Column:
    """Id of a condition: the test's name without its ending, with _ for /."""
    return F.regexp_replace(F.regexp_replace(test, "[.][^./]*$", ""), "/", "_")


def agreement(features: DataFrame, quality: DataFrame, p: Parameters = Parameters(), by: str = "id", score: str = "jod") -> DataFrame:
    """One row: conditions, rmse, pearson and spearman of predicted and given scores (average ranks)."""
    from vireo.operators.numbering import ranked

    both = scores(features, p, by).join(quality.select(by, F.col(score).cast("double").alias("jod")), by).select("score", "jod")
    ranks = ranked(ranked(both, "score", "rs"), "jod", "rj")
    return ranks.agg(F.count(F.lit(1)).alias("conditions"), F.sqrt(F.avg((F.col("score") - F.col("jod")) ** 2)).alias("rmse"), F.corr("score", "jod").alias("pearson"), F.corr("rs", "rj").alias("spearman"))
