"""Frames that don't fit a task: overlapping tiles for the fine bands, the coarse level gathered for the others.

A tile holds its core and as much around it as the bands that are made of it reach; bands of the core are the same as those of the whole
frame.  Differences leave a tile as sums and counts by band and channel, which add up over tiles, and its part of the level below
its last band as a plane.  These parts are put together by frame, a 4 ** levels-th of its samples, and give the other bands.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vireo.operators import linear as L
from vireo.operators import planes as P
from vireo.operators import visibility as V

#: Samples of a core's side, and bands that are made of tiles.
SIZE, LEVELS = 1024, 3
#: Reach of a band's masking and of the next level's expansion, in samples of the band.
REACH = 12


def halo(levels: int) -> int:
    """Samples around a core that ``levels`` bands of it reach, a multiple of the step of the level below them."""
    reach = REACH
    for _ in range(levels - 1):
        reach = 2 * reach + 2
    return -(-reach // 2**levels) * 2**levels


#: Where a tile lies: the frame's size, the core's first sample and the side of cores.
PLACE = ["frame_h", "frame_w", "y", "x", "size", "levels"]


def cut_tiles(frames: DataFrame, columns: list[str], keep: list[str], size: int = SIZE, levels: int = LEVELS) -> DataFrame:
    """keep, tile (struct of PLACE), h, w and planes of overlapping tiles of plane rows (keep, h, w, columns)."""
    if size % 2**levels or not levels:
        raise ValueError(f"tiles of {size} samples can't be halved {levels} times")
    around = halo(levels)
    rows = frames.select(*keep, "h", "w", *columns)
    names = [*keep, "tile", "h", "w", *columns]

    def run(batches):
        for b in batches:
            for k, (h, w) in enumerate(zip(b.column("h").to_pylist(), b.column("w").to_pylist())):
                planes = [P._samples(b.column(c), np.array([k]), h * w).reshape(h, w) for c in columns]
                for y in range(0, h, size):
                    for x in range(0, w, size):
                        part = (slice(max(0, y - around), min(h, y + size + around)), slice(max(0, x - around), min(w, x + size + around)))
                        held = [np.ascontiguousarray(p[part]) for p in planes]
                        tall, wide = held[0].shape
                        ends = pa.array([0, tall * wide], pa.int32())
                        tile = pa.StructArray.from_arrays([pa.array([v], pa.int32()) for v in (h, w, y, x, size, levels)], PLACE)
                        yield pa.RecordBatch.from_arrays([*(b.column(c).slice(k, 1) for c in keep), tile, *(pa.array([v], pa.int32()) for v in (tall, wide)), *(pa.ListArray.from_arrays(ends, pa.array(p.ravel())) for p in held)], names)

    tile = "tile struct<" + ", ".join(f"{p}: int" for p in PLACE) + ">"
    return rows.mapInArrow(run, ", ".join([*P._fields(rows, keep), tile, "h int, w int", *(f"`{c}` array<double>" for c in columns)]))


def _core(start: int, first: int, size: int, whole: int, level: int) -> slice:
    """The core's samples of a tile that begins at ``start``, at a level."""
    return slice((first - start) >> level, -(-min(first + size, whole) // 2**level) - (start >> level))


def _sums(d: np.ndarray, planes: int) -> np.ndarray:
    """(rows, planes, 1, 2): sum of squares and number of samples by channel; planes beyond the channels are zero."""
    out = np.zeros((len(d), planes, 1, 2))
    out[:, : d.shape[1], 0, 0] = V.safe_pow(d, 2).sum((-2, -1))
    out[:, : d.shape[1], 0, 1] = d.shape[-2] * d.shape[-1]
    return out


def _fine(model: V.Model):
    """Stencil of a tile: sums of its core's bands, then, labelled -1 - level, the core's part of the level below them."""

    def stencil(x: np.ndarray, place: tuple):
        h, w, y, x0, size, levels = place
        rho = V.band_frequencies(h, w, model.ppd)
        levels = min(levels, len(rho) - 1)
        around = halo(place[5])
        tops = max(0, y - around), max(0, x0 - around)
        for k in range(levels):
            # columns are mirrored by the parity of the frame's rows
            down = P.along(x, -2, L.reduce_weights, x.shape[-2])
            below = P.along(down, -1, L.reduce_weights, x.shape[-1], bool(-(-h // 2**k) % 2))
            c, log_l = V.contrast_of(x, P.expand(below, *x.shape[-2:]), model.contrast)
            d = model.difference(c if k == 0 else 2 * c, log_l, rho[k], False)
            yield k, _sums(d[..., _core(tops[0], y, size, h, k), _core(tops[1], x0, size, w, k)], x.shape[1])
            x = below
        yield -1 - levels, x[..., _core(tops[0], y, size, h, levels), _core(tops[1], x0, size, w, levels)]

    return stencil


def _gathered(parts: DataFrame, keep: list[str], columns: list[str]) -> DataFrame:
    """keep, tile, h, w and planes put together from the tiles' parts; a frame's parts are a group."""
    held = parts.groupBy(*keep).agg(F.collect_list(F.struct("tile", "band", "h", "w", *columns)).alias("parts"))

    def run(batches):
        for b in batches:
            for k, own in enumerate(b.column("parts").to_pylist()):
                place, level = own[0]["tile"], -1 - own[0]["band"]
                shape = [-(-place[c] // 2**level) for c in ("frame_h", "frame_w")]
                whole = np.full((len(columns), *shape), np.nan)
                for p in own:
                    y, x = p["tile"]["y"] >> level, p["tile"]["x"] >> level
                    whole[:, y : y + p["h"], x : x + p["w"]] = [np.reshape(p[c], (p["h"], p["w"])) for c in columns]
                if np.isnan(whole).any():
                    raise ValueError("a frame's tiles don't cover it")
                ends = pa.array([0, shape[0] * shape[1]], pa.int32())
                tile = pa.StructArray.from_arrays([pa.array([place[c]], pa.int32()) for c in PLACE], PLACE)
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(k, 1) for c in keep), tile, *(pa.array([v], pa.int32()) for v in shape), *(pa.ListArray.from_arrays(ends, pa.array(p.ravel())) for p in whole)], [*keep, "tile", "h", "w", *columns])

    tile = "tile struct<" + ", ".join(f"{p}: int" for p in PLACE) + ">"
    return held.mapInArrow(run, ", ".join([*P._fields(held, keep), tile, "h int, w int", *(f"`{c}` array<double>" for c in columns)]))


def frame_values(tiles: DataFrame, columns: list[str], keep: list[str], model: V.Model = V.Model()) -> DataFrame:
    """keep, q of frames that come as tiles (cut_tiles); the same as visibility.frame_values of the whole frames.

    keep tells frames apart.  Models that blur textures reach further than a tile's surroundings and are an error.
    """
    if model.masking.endswith("texture"):
        raise ValueError("textures aren't masked on tiles")
    half = len(columns) // 2
    made = P.over_planes(tiles, _fine(model), columns, columns, [*keep, "tile"], of="tile")
    fine, parts = made.where("band >= 0"), made.where("band < 0")
    whole = _gathered(parts, keep, columns)

    def coarse(x: np.ndarray, place: tuple):
        rho = V.band_frequencies(place[0], place[1], model.ppd)
        for k, d in model.differences(x, rho, min(place[5], len(rho) - 1)):
            yield k, _sums(d, len(columns))

    sums = P.over_planes(whole, coarse, columns, columns, [*keep, "tile"], of="tile")
    each = fine.select(*keep, "band", *columns[:half]).unionByName(sums.select(*keep, "band", *columns[:half]))
    total = each.groupBy(*keep, "band").agg(*(F.sum(F.col(c)[k]).alias(f"_{n}{i}") for i, c in enumerate(columns[:half]) for k, n in enumerate("sn")))
    e = float(V.E.EPSILON)
    norm = lambda i: F.sqrt(F.col(f"_s{i}") / F.col(f"_n{i}") + e) - math.sqrt(e)
    bands = total.groupBy(*keep).agg(F.array_sort(F.collect_list(F.struct("band", *(norm(i).alias(f"q{i}") for i in range(half))))).alias("b"))
    inner, base = (model.weights(half, last).tolist() for last in (False, True))

    def weighted(i: int):
        return F.transform("b", lambda b, k: b[f"q{i}"] * F.when(k == F.size("b") - 1, base[i]).otherwise(inner[i]))

    return bands.select(*keep, V.norm(F.array(*(V.norm(weighted(i), 4) for i in range(half))), 4).alias("q"))
