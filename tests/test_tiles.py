"""Tiles against whole frames, for sizes of either parity."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vireo.operators import tiles as T
from vireo.operators import visibility as V

COLUMNS = [f"{s}{c}" for s in "tr" for c in range(4)]


def stacks(shape, n=2, seed=1):
    rng = np.random.default_rng(seed)
    base = rng.random((n, 4, *shape)) * 40 + 20
    base[:, 1:] -= 40
    return np.concatenate([base + rng.standard_normal(base.shape) * 3, base], 1)


@pytest.mark.parametrize("shape", [(150, 203), (97, 64), (64, 131), (65, 66), (40, 45), (129, 257)])
def test_bands_of_tiles_are_those_of_frames(shape):
    """Sums by band over all tiles, for each model, and the level handed on."""
    x = stacks(shape)
    for model, (size, levels) in ((V.Model(), (64, 3)), (V.Model(masking="add-mutual", contrast="weber_g0_ref"), (32, 2)), (V.Model(masking="mult-transducer", contrast="log"), (16, 1))):
        rho, around = model.bands(x), T.halo(levels)
        sums: dict = {}
        level, coarse = None, None
        for y in range(0, shape[0], size):
            for z in range(0, shape[1], size):
                part = x[..., max(0, y - around) : y + size + around, max(0, z - around) : z + size + around]
                for band, made in T._fine(model)(part, (*shape, y, z, size, levels)):
                    if band >= 0:
                        sums[band] = sums.get(band, 0) + made[:, :4, 0]
                    else:
                        level = -1 - band
                        coarse = np.full((*x.shape[:2], *(-(-n // 2**level) for n in shape)), np.nan) if coarse is None else coarse
                        coarse[..., y >> level : (y >> level) + made.shape[-2], z >> level : (z >> level) + made.shape[-1]] = made
        assert np.allclose(coarse, V.P.gaussian(x, level + 1)[level])
        for k, d in model.differences(x):
            if k < level:
                assert np.allclose(sums[k][..., 0], V.safe_pow(d, 2).sum((-2, -1))) and (sums[k][..., 1] == d.shape[-2] * d.shape[-1]).all(), (k, model.masking)
        for k, d in model.differences(coarse, rho, level):
            assert np.allclose(d, dict(model.differences(x))[k])


def test_frames_as_tiles(spark):
    shapes = {1: (150, 203), 2: (97, 140), 3: (40, 45)}
    rows = [(k, f, *s, *(p.ravel().tolist() for p in stacks(s, 1, k + f)[0])) for k, s in shapes.items() for f in range(2)]
    df = spark.createDataFrame(rows, "clip long, frame int, h int, w int, " + ", ".join(f"{c} array<double>" for c in COLUMNS)).repartition(3)
    want = {(r.clip, r.frame): r.q for r in V.frame_values(df, COLUMNS, ["clip", "frame"]).collect()}
    for size, levels in ((64, 2), (32, 1)):
        cut = T.cut_tiles(df, COLUMNS, ["clip", "frame"], size, levels)
        got = {(r.clip, r.frame): r.q for r in T.frame_values(cut, COLUMNS, ["clip", "frame"]).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(v) for k, v in want.items())
    with pytest.raises(ValueError):
        T.frame_values(cut, COLUMNS, ["clip", "frame"], V.Model(masking="mult-transducer-texture"))
    with pytest.raises(ValueError):
        T.cut_tiles(df, COLUMNS, ["clip", "frame"], 100, 3)
    with pytest.raises(Exception, match="don't cover"):
        T.frame_values(cut.where("tile.x > 0"), COLUMNS, ["clip", "frame"]).count()


def test_what_a_task_holds_of_a_large_frame(spark):
    """2160 x 3840 samples: no tile has more than a core and its surroundings, and what is gathered is a sixty-fourth."""
    df = spark.range(1).select(F.lit(1).alias("clip"), F.lit(2160).alias("h"), F.lit(3840).alias("w"), F.array_repeat(F.lit(1.0), 2160 * 3840).alias("t"))
    sizes = T.cut_tiles(df, ["t"], ["clip"]).select("h", "w", F.size("t").alias("n"), "tile").collect()
    side = T.SIZE + 2 * T.halo(T.LEVELS)
    assert len(sizes) == 12 and max(r.n for r in sizes) <= side * side and all(r.n == r.h * r.w for r in sizes)
    assert T.halo(1) == 12 and T.halo(2) == 28 and T.halo(3) == 56
