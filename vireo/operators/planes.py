"""Plane rows: one row a plane, of any size, with its samples as arrays of doubles by rows.

Columns ``h`` and ``w`` give the size of all planes of a row.  Filters run inside the tasks that hold the rows, so a chain of filters
costs no shuffle; only pairing, filtering over time and pooling over frames shuffle.  A task holds the planes of one row
at a time where they are large, and stacks rows of one size up to STACKED samples where they are small.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vireo.operators import linear as L

#: Samples, over all planes, of the rows that are filtered at once, unless a single row has more.
STACKED = 1 << 17
#: A function over a stack (rows, planes, h, w): labelled results of the same form.
Stencil = Callable[[np.ndarray], Iterator[tuple[int, np.ndarray]]]


def _samples(column: pa.Array, rows: np.ndarray, size: int) -> np.ndarray:
    taken = column.take(pa.array(rows))
    if taken.null_count or (np.diff(taken.offsets.to_numpy()) != size).any():
        raise ValueError("a plane must hold h * w samples")
    return taken.flatten().to_numpy(zero_copy_only=False)


def _fields(df: DataFrame, names: list[str]) -> list[str]:
    return [f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names]


def _frozen(value):
    """A value of a row as one that can be a key: structs and arrays as tuples."""
    return tuple(map(_frozen, value.values() if isinstance(value, dict) else value)) if isinstance(value, (dict, list)) else value


def over_planes(df: DataFrame, stencil: Stencil, columns: list[str], out: list[str] | None = None, keep: list[str] = [], of: str | None = None) -> DataFrame:
    """Columns ``keep``, band, h, w and the planes ``out`` (``columns`` by default) of each labelled result of each row of df.

    With ``of``, rows are also stacked by that column's value, and the stencil gets it (structs and arrays as tuples) after the stack.
    A plane that is null or whose samples don't fill h * w is an error; null samples are NaN; an empty table gives no rows.
    """
    out = out or columns
    rows = df.select(*keep, "h", "w", *columns, *([F.col(of).alias("_of")] if of else []))

    def run(batches):
        for b in batches:
            values = map(_frozen, b.column("_of").to_pylist()) if of else [None] * b.num_rows
            stacks: dict[tuple, list[int]] = {}
            for k, key in enumerate(zip(b.column("h").to_pylist(), b.column("w").to_pylist(), values)):
                stacks.setdefault(key, []).append(k)
            for (h, w, value), own in stacks.items():
                of_size, more = np.array(own), (value,) if of else ()
                step = max(1, STACKED // (h * w * len(columns)))
                for at in range(0, len(of_size), step):
                    part = of_size[at : at + step]
                    stack = np.stack([_samples(b.column(c), part, h * w).reshape(len(part), h, w) for c in columns], 1)
                    kept = [b.column(k).take(pa.array(part)) for k in keep]
                    for band, made in stencil(stack, *more):
                        n, _, oh, ow = made.shape
                        ends = pa.array(np.arange(n + 1, dtype=np.int32) * np.int32(oh * ow))
                        planes = [pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(made[:, k], float).ravel())) for k in range(made.shape[1])]
                        sizes = [pa.array(np.full(n, x, np.int32)) for x in (band, oh, ow)]
                        yield pa.RecordBatch.from_arrays([*kept, *sizes, *planes], [*keep, "band", "h", "w", *out])

    return rows.mapInArrow(run, ", ".join([*_fields(rows, keep), "band int, h int, w int", *(f"`{c}` array<double>" for c in out)]))


def filtered(df: DataFrame, fn: Callable[..., np.ndarray], columns: list[str], out: list[str] | None = None, keep: list[str] = [], of: str | None = None) -> DataFrame:
    """One result a row: columns ``keep``, h, w and planes."""
    return over_planes(df, lambda *x: iter([(0, fn(*x))]), columns, out, keep, of).drop("band")


def long(df: DataFrame, columns: list[str], keep: list[str]) -> DataFrame:
    """Columns ``keep``, y, x and the samples of the planes: one row a sample."""
    zipped = F.arrays_zip(*(F.col(c) for c in columns)) if len(columns) > 1 else F.transform(F.col(columns[0]), lambda v: F.struct(v.alias(columns[0])))
    rows = df.select(*keep, "w", F.posexplode(zipped).alias("pos", "s"))
    return rows.select(*keep, F.expr("CAST(pos DIV w AS INT)").alias("y"), F.expr("CAST(pos % w AS INT)").alias("x"), "s.*")


def planes_of(samples: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    """keys, h, w and the plane ``value`` from one row a sample (keys, y, x, value); one shuffle, a plane a group."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("y", "x", F.col(value).cast("double").alias("s")))), lambda s: s["s"])
    return samples.groupBy(*keys).agg((F.max("y") + 1).cast("int").alias("h"), (F.max("x") + 1).cast("int").alias("w"), ordered.alias(value))


# Filters in numpy, over the last two axes -------------------------------------------------------------------------


@lru_cache(512)
def _gathered(make: Callable, *args) -> tuple[np.ndarray, np.ndarray]:
    """A weight table as inputs and weights of each tap of each output."""
    table = make(*args)
    size = 1 + max(o for o, _, _ in table)
    taps = [[] for _ in range(size)]
    for o, i, w in table:
        taps[o].append((i, w))
    most = max(map(len, taps))
    index, weight = np.zeros((most, size), np.int64), np.zeros((most, size))
    for o, own in enumerate(taps):
        for t, (i, w) in enumerate(own):
            index[t, o], weight[t, o] = i, w
    return index, weight


def along(x: np.ndarray, axis: int, make: Callable, *args) -> np.ndarray:
    """x filtered along axis -2 or -1 with the weight table make(*args)."""
    index, weight = _gathered(make, *args)
    shape = (-1, 1) if axis == -2 else (-1,)
    out = x.take(index[0], axis) * weight[0].reshape(shape)
    for i, w in zip(index[1:], weight[1:]):
        out += x.take(i, axis) * w.reshape(shape)
    return out


def reduce(x: np.ndarray) -> np.ndarray:
    h, w = x.shape[-2:]
    return along(along(x, -2, L.reduce_weights, h), -1, L.reduce_weights, w, bool(h % 2))


def expand(x: np.ndarray, h: int, w: int) -> np.ndarray:
    return along(along(x, -2, L.expand_weights, x.shape[-2], h), -1, L.expand_weights, x.shape[-1], w)


def blur(x: np.ndarray, sigma: float, taps: int | None = None) -> np.ndarray:
    return along(along(x, -2, L.gaussian_weights, x.shape[-2], sigma, taps), -1, L.gaussian_weights, x.shape[-1], sigma, taps)


def resize(x: np.ndarray, h: int, w: int, method: str = "bilinear") -> np.ndarray:
    return along(along(x, -2, L.RESIZE[method], x.shape[-2], h), -1, L.RESIZE[method], x.shape[-1], w)


def _cut_sums(x: np.ndarray, width: int) -> np.ndarray:
    """Sums over width x width windows side by side, cut off at the far edges, from a summed area: four look-ups a window."""
    area = np.zeros((*x.shape[:-2], x.shape[-2] + 1, x.shape[-1] + 1))
    np.cumsum(x, -2, out=area[..., 1:, 1:])
    np.cumsum(area[..., 1:, 1:], -1, out=area[..., 1:, 1:])
    y, x_ = (np.append(np.arange(0, n, width), n) for n in x.shape[-2:])
    return np.diff(np.diff(area[..., y, :][..., x_], axis=-1), axis=-2)


def window_moments(x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and variance of the samples of each width x width window; those at the far edges are of the samples that are there.

    Samples are taken from the plane's mean, so that large sums don't drown small variances.
    """
    if width < 1:
        raise ValueError("a window has a sample at least")
    middle = x.mean((-2, -1), keepdims=True)
    apart = x - middle
    n = _cut_sums(np.ones(x.shape[-2:]), width)
    mean = _cut_sums(apart, width) / n
    return mean + middle, np.maximum(_cut_sums(apart * apart, width) / n - mean * mean, 0)


def gaussian(x: np.ndarray, levels: int) -> list[np.ndarray]:
    """The Gaussian pyramid, finest level first; at most log2 of the shorter side levels."""
    if levels > int(np.log2(min(x.shape[-2:]))):
        raise ValueError(f"{levels} levels are too many for planes of {x.shape[-2]} x {x.shape[-1]}")
    out = [x]
    while len(out) < levels:
        out.append(reduce(out[-1]))
    return out


def laplacian(x: np.ndarray, levels: int) -> list[np.ndarray]:
    g = gaussian(x, levels)
    return [a - expand(b, *a.shape[-2:]) for a, b in zip(g, g[1:])] + [g[-1]]


def reconstruct(bands: list[np.ndarray]) -> np.ndarray:
    out = bands[-1]
    for b in bands[-2::-1]:
        out = b + expand(out, *b.shape[-2:])
    return out


def reconstructed(bands: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, h, w and the plane that band rows (keys, band, h, w, value) add up to; one shuffle, the bands of a plane a group.

    A plane has a few bands at most, and all of them together a third more samples than the plane.
    """
    held = bands.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("band", "h", "w", F.col(value).alias("v")))).alias("bands"))

    def run(batches):
        for b in batches:
            for k, own in enumerate(b.column("bands").to_pylist()):
                made = reconstruct([np.array(x["v"], float).reshape(x["h"], x["w"]) for x in own])
                ends = pa.array([0, made.size], pa.int32())
                yield pa.RecordBatch.from_arrays([*(b.column(n).slice(k, 1) for n in keys), *(pa.array([s], pa.int32()) for s in made.shape), pa.ListArray.from_arrays(ends, pa.array(made.ravel()))], [*keys, "h", "w", value])

    return held.mapInArrow(run, ", ".join([*_fields(held, keys), "h int, w int", f"`{value}` array<double>"]))
