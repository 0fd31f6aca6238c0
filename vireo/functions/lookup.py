"""Look-up tables: interpolation as SQL expressions and in numpy, and the contrast-sensitivity table over frequency and luminance."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np

from vireo.functions.expressions import num


def interp(x: str, knots: list[float], values: list[float], extrapolate_above: bool = True) -> str:
    """Linear; held below the first knot, continued above the last one or held there.  Knots are literals, so no join is needed."""
    parts = []
    for k in range(len(knots) - 1):
        slope = f"{num(values[k])} + ({x} - {num(knots[k])}) * {num((values[k + 1] - values[k]) / (knots[k + 1] - knots[k] + 1e-6))}"
        parts.append(f"WHEN {x} <= {num(knots[k + 1])} THEN {slope}")
    last = slope if extrapolate_above else num(values[-1])
    return f"(CASE WHEN {x} <= {num(knots[0])} THEN {num(values[0])} {' '.join(parts)} ELSE {last} END)"


def interp_uniform(x: str, first: float, spacing: float, values: list[float]) -> str:
    """Linear on a uniform grid by index arithmetic, held at both ends."""
    at = f"least(greatest(({x} - {num(first)}) / {num(spacing)}, 0e0), {num(len(values) - 1)})"
    pick = lambda shift: f"(CASE least(CAST(floor({at}) AS INT) + {shift}, {len(values) - 1}) " + " ".join(f"WHEN {k} THEN {num(v)}" for k, v in enumerate(values)) + " END)"
    return f"({pick(0)} + ({at} - floor({at})) * ({pick(1)} - {pick(0)}))"


def interp_rows(x: float, knots: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Each row of values over the same knots at x, linear, continued at both ends."""
    k = int(np.clip(np.searchsorted(knots, x) - 1, 0, len(knots) - 2))
    return rows[:, k] + (x - knots[k]) * (rows[:, k + 1] - rows[:, k]) / (knots[k + 1] - knots[k])


@dataclass(frozen=True)
class Sensitivity:
    """log10 sensitivities over a uniform grid of log10 luminance and any grid of log10 frequency, by temporal kind (0 sustained,
    1 transient) and channel."""

    log_l: np.ndarray
    log_rho: np.ndarray
    tables: dict[tuple[int, int], np.ndarray]
    correction: float = -0.2797423303127289  # dB, fixed value
    #: Rows of the tables by frequency and channel; a display has a few frequencies.
    _rows: dict = field(default_factory=dict, compare=False, repr=False)

    def at(self, rho: float, channel: int) -> list[float]:
        """Over the luminance grid, with the correction; channel 3 is the transient one."""
        if (rho, channel) not in self._rows:
            table = self.tables[(0, channel) if channel < 3 else (1, 0)]
            self._rows[rho, channel] = (interp_rows(float(np.log10(rho)), self.log_rho, table) + self.correction / 20).tolist()
        return self._rows[rho, channel]

    def sql(self, log_l: str, rho: float, channel: int) -> str:
        return f"pow(1e1, {interp_uniform(log_l, float(self.log_l[0]), float(self.log_l[1] - self.log_l[0]), self.at(rho, channel))})"

    def of(self, log_l: np.ndarray, rho: float, channel: int) -> np.ndarray:
        values = np.array(self.at(rho, channel))
        at = np.clip((log_l - self.log_l[0]) / (self.log_l[1] - self.log_l[0]), 0, len(values) - 1)
        low = np.floor(at)
        k = low.astype(np.int64)
        return 10 ** (values[k] + (at - low) * (values[np.minimum(k + 1, len(values) - 1)] - values[k]))


def sensitivity_of(text: str) -> Sensitivity:
    """From JSON: L_bkg, rho, omega (two values) and a table ``o{omega}_c{channel}`` of L_bkg by rho for each channel."""
    held = json.loads(text)
    tables = {(o, c): np.array(held[f"o{omega}_c{c + 1}"], float) for o, omega in enumerate(held["omega"]) for c in range(1 if o else 3)}
    return Sensitivity(np.log10(held["L_bkg"]), np.log10(held["rho"]), tables)


def stand_in() -> Sensitivity:
    """A smooth, uncalibrated surface in place of the measured table, which isn't public: a log-parabola over frequency that falls off
    in dim light, with a fixed share for each channel."""
    log_l, rho = np.arange(-2.0, 5.0), 2.0 ** np.arange(-4.0, 7.0)
    bell = 2.2 - 0.35 * (np.log10(rho) - 0.5) ** 2
    over = bell[None, :] - 0.05 * (log_l[:, None] - 2) ** 2
    shares = {(0, 0): 1.0, (0, 1): 0.6, (0, 2): 0.4, (1, 0): 0.8}
    return Sensitivity(log_l, np.log10(rho), {k: over + np.log10(s) for k, s in shares.items()})
