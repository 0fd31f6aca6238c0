"""Linear filters as sparse weight tables: (o, i, w) rows; the sample o of the result is the sum of w times the samples i.

Planes are filtered with these tables in tasks (vireo.operators.planes); SQL joins them as VALUES.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

KERNEL = (0.05, 0.25, 0.4, 0.25, 0.05)
Weights = list[tuple[int, int, float]]


def _summed(rows) -> Weights:
    out: dict[tuple[int, int], float] = {}
    for o, i, w in rows:
        out[o, i] = out.get((o, i), 0.0) + w
    return [(o, i, w) for (o, i), w in sorted(out.items()) if w]


def mirrored(i: int, n: int) -> int:
    """Half-sample symmetric index: -1 is 0, n is n - 1."""
    i %= 2 * n
    return i if i < n else 2 * n - 1 - i


def reflected(i: int, n: int) -> int:
    """Whole-sample symmetric index: -1 is 1."""
    if n == 1:
        return 0
    i %= 2 * n - 2
    return i if i < n else 2 * n - 2 - i


@lru_cache(512)
def reduce_weights(n: int, odd: bool | None = None) -> Weights:
    """Every second sample of the smoothed axis, mirrored at its ends.

    ``odd`` says for which parity the far end is mirrored, by default the axis's own.  Pyramids mirror columns by the parity of
    the rows, as the scores to match do: where the two differ, the last column isn't normalised.
    """
    if odd is None or odd == bool(n % 2):
        return _summed((o, mirrored(2 * o + k - 2, n), w) for o in range(-(-n // 2)) for k, w in enumerate(KERNEL))
    rows = [(o, mirrored(2 * o + k - 2, n), w) for o in range(-(-n // 2)) for k, w in enumerate(KERNEL) if 2 * o + k - 2 < n]
    return _summed(rows + [(-(-n // 2) - 1, n - 1 - j, w) for j, w in enumerate(KERNEL[3:] if odd else KERNEL[4:])])


@lru_cache(512)
def expand_weights(n: int, size: int) -> Weights:
    """Zeros between samples, edge samples repeated, twice the kernel."""
    place = {2 + 2 * i: i for i in range(n) if 2 + 2 * i < size + 2} | {0: 0, size + 2 + size % 2: n - 1}
    return _summed((o, place[o + k], 2 * w) for o in range(size) for k, w in enumerate(KERNEL) if o + k in place)


@lru_cache(512)
def gaussian_weights(n: int, sigma: float, taps: int | None = None) -> Weights:
    half = (taps or 2 * math.ceil(2 * sigma) + 1) // 2
    k = np.exp(-(np.arange(-half, half + 1) ** 2) / (2 * sigma**2))
    k /= k.sum()
    return _summed((o, reflected(o + d - half, n), float(w)) for o in range(n) for d, w in enumerate(k))


@lru_cache(512)
def bilinear_weights(n: int, size: int) -> Weights:
    """Resizing with pixel centres aligned and edges held."""
    rows = []
    for o in range(size):
        at = max((o + 0.5) * n / size - 0.5, 0.0)
        i, f = int(at), at - int(at)
        rows += [(o, min(i, n - 1), 1 - f), (o, min(i + 1, n - 1), f)]
    return _summed(rows)


def cubic_weights(n: int, size: int, a: float = -0.75) -> Weights:
    """Resizing by cubic convolution, pixel centres aligned, edge samples repeated."""
    near = lambda d: ((a + 2) * d - (a + 3)) * d * d + 1
    far = lambda d: ((a * d - 5 * a) * d + 8 * a) * d - 4 * a
    rows = []
    for o in range(size):
        at = (o + 0.5) * n / size - 0.5
        i = math.floor(at)
        f = at - i
        rows += [(o, min(max(i + j, 0), n - 1), w) for j, w in ((-1, far(1 + f)), (0, near(f)), (1, near(1 - f)), (2, far(2 - f)))]
    return _summed(rows)


def nearest_weights(n: int, size: int) -> Weights:
    return [(o, min(o * n // size, n - 1), 1.0) for o in range(size)]


def area_weights(n: int, size: int) -> Weights:
    """Mean over the samples that an output sample covers, whole samples counted alike."""
    rows = []
    for o in range(size):
        first, last = o * n // size, -(-(o + 1) * n // size)
        rows += [(o, i, 1 / (last - first)) for i in range(first, last)]
    return rows


#: Resizing by name of the method.
RESIZE = {"bilinear": bilinear_weights, "bicubic": cubic_weights, "nearest": nearest_weights, "area": area_weights}


def sql_values(weights: Weights) -> str:
    return "(VALUES " + ", ".join(f"({o}, {i}, {w!r}e0)" if "e" not in repr(w) else f"({o}, {i}, {w!r})" for o, i, w in weights) + ") AS w(o, i, w)"


def separable_sql(source: str, rows: Weights, columns: Weights, key: str = "vec_id", values: tuple[str, ...] = ("v",)) -> str:
    """Both axes filtered, as SQL over a relation (key, y, x, values)."""
    total = ", ".join(f"sum({v} * w.w) AS {v}" for v in values)
    down = f"(SELECT {key}, w.o AS y, x, {total} FROM {source} AS s JOIN {sql_values(rows)} ON s.y = w.i GROUP BY {key}, w.o, x)"
    return f"(SELECT {key}, y, w.o AS x, {total} FROM {down} AS s JOIN {sql_values(columns)} ON s.x = w.i GROUP BY {key}, y, w.o)"


# Temporal filters -----------------------------------------------------------------------------------------------

# Widths and exponents of the sustained (Y, RG, YV) and transient (Y) responses.
SIGMA = {"Ysust": 5.79336, "RG": 14.1255, "YV": 6.63661, "Ytrans": 0.12314}
BETA = {"Ysust": 1.3314, "RG": 1.1196, "YV": 0.947901, "Ytrans": 0.1898}


def response(channel: str, hertz: float, transient: str = "band_pass") -> float:
    """Share of a temporal frequency that a channel passes; the transient channel peaks at 5 Hz or passes what Y sustained doesn't."""
    if channel == "Ytrans" and transient == "high_pass":
        return 1 - response("Ysust", hertz)
    apart = hertz ** BETA[channel]
    if channel == "Ytrans":
        apart = (apart - 5 ** BETA[channel]) ** 2
    return math.exp(-apart / SIGMA[channel])


@lru_cache(64)
def temporal_taps(fps: float, channel: str, transient: str = "band_pass") -> list[float]:
    """Impulse response of a channel over about 0.25 s, an odd number of frames, the middle one at its centre.

    The response is even, so its transform is a sum of cosines over the frequencies k fps / 2 / half for k = 0 .. half.  With
    ``transient`` = "gradient" the transient channel is the difference of a frame and the one before the last.
    """
    half = math.ceil(0.25 * fps / 2)
    n = 2 * half + 1
    if channel == "Ytrans" and transient == "gradient":
        return [1.0, 0.0, -1.0, *[0.0] * (n - 3)]
    shares = [response(channel, k * fps / 2 / half, transient) for k in range(half + 1)]
    return [(shares[0] + 2 * sum(r * math.cos(2 * math.pi * k * d / n) for k, r in enumerate(shares) if k)) / n for d in range(-half, half + 1)]
