"""Scalar pixel functions as SQL expressions, so that they stay inside whole-stage code generation.

Each takes SQL operands and returns SQL that Spark and other engines read alike; literals carry an exponent to be doubles.
"""

from __future__ import annotations

import math

import numpy as np

# Fixed values of the published standards and colour spaces.
PQ_N, PQ_M, PQ_C1, PQ_C2, PQ_C3 = 0.1593017578125, 78.84375, 0.8359375, 18.8515625, 18.6875
HLG_A, HLG_WEIGHTS = 0.17883277, (0.2627, 0.6780, 0.0593)
LUMA = (0.212656, 0.715158, 0.072186)
RGB_TO_XYZ = {
    "sRGB": ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.072175), (0.0193339, 0.119192, 0.9503041)),
    "BT.2020": ((0.637, 0.1446, 0.1689), (0.2627, 0.678, 0.0593), (0.0, 0.0281, 1.061)),
}
XYZ_TO_LMS = ((0.187596268556126, 0.585168649077728, -0.026384263306304), (-0.133397430663221, 0.405505777260049, 0.034502127690364), (0.000244379021663, -0.000542995890619, 0.019406849066323))
LMS_TO_DKL = ((1.0, 1.0, 0.0), (1.0, -2.311130179947035, 0.0), (-1.0, -1.0, 50.977571328718781))
XYZ_TO_RGB2020 = ((1.716502508360628, -0.355584689096764, -0.253375213570850), (-0.666625609145029, 1.616446566522207, 0.015775479726511), (0.017655211703087, -0.042810696059636, 0.942089263920533))
XYZ_TO_RGB709 = ((3.2406, -1.5372, -0.4986), (-0.9689, 1.8758, 0.0415), (0.0557, -0.2040, 1.0570))
YCBCR_TO_RGB = {"bt709": ((1, 0, 1.5748), (1, -0.1873, -0.4681), (1, 1.8556, 0)), "bt2020": ((1, 0, 1.47460), (1, -0.16455, -0.57135), (1, 1.88140, 0))}
PU = {
    "banding": (1.070275272, 0.4088273932, 0.153224308, 0.2520326168, 1.063512885, 1.14115047, 521.4527484),
    "banding_glare": (0.353487901, 0.3734658629, 8.277049286e-05, 0.9062562627, 0.09150303166, 0.9099517204, 596.3148142),
    "peaks": (1.043882782, 0.6459495343, 0.3194584211, 0.374025247, 1.114783422, 1.095360363, 384.9217577),
    "peaks_glare": (816.885024, 1479.463946, 0.001253215609, 0.9329636822, 0.06746643971, 1.573435413, 419.6006374),
}


def num(x: float) -> str:
    text = repr(float(x))
    return f"({text if 'e' in text else text + 'e0'})"


def clamp(v: str, low: float, high: float) -> str:
    return f"least(greatest({v}, {num(low)}), {num(high)})"


def srgb_to_linear(v: str) -> str:
    return f"(CASE WHEN {v} > {num(0.04045)} THEN pow(({v} + {num(0.055)}) / {num(1.055)}, {num(2.4)}) ELSE {v} / {num(12.92)} END)"


def linear_to_srgb(v: str) -> str:
    c = clamp(v, 0, 1)
    return f"(CASE WHEN {c} > {num(0.0031308)} THEN {num(1.055)} * pow({c}, {num(1 / 2.4)}) - {num(0.055)} ELSE {num(12.92)} * {c} END)"


def pq_encode(v: str) -> str:
    t = f"pow({clamp(v, 0, 10000)} / {num(10000)}, {num(PQ_N)})"
    return f"pow(({num(PQ_C2)} * {t} + {num(PQ_C1)}) / ({num(1)} + {num(PQ_C3)} * {t}), {num(PQ_M)})"


def pq_decode(v: str) -> str:
    t = f"pow({v}, {num(1 / PQ_M)})"
    return f"({num(10000)} * pow(greatest({t} - {num(PQ_C1)}, {num(0)}) / ({num(PQ_C2)} - {num(PQ_C3)} * {t}), {num(1 / PQ_N)}))"


def hlg_inverse(v: str) -> str:
    b, c = 1 - 4 * HLG_A, 0.5 - HLG_A * math.log(4 * HLG_A)
    return f"(CASE WHEN {v} <= {num(0.5)} THEN {v} * {v} / {num(3)} ELSE (exp(({v} - {num(c)}) / {num(HLG_A)}) + {num(b)}) / {num(12)} END)"


def hlg_to_linear(rgb: tuple[str, str, str], gamma: float) -> list[str]:
    """Scene-linear components times the luminance gain of the display's system gamma."""
    scene = [hlg_inverse(v) for v in rgb]
    y = " + ".join(f"{num(k)} * {s}" for k, s in zip(HLG_WEIGHTS, scene))
    return [f"(pow({y}, {num(gamma - 1)}) * {s})" for s in scene]


def hlg_gamma(peak: float, ambient: float) -> float:
    if peak <= 1000:
        return 1.2
    if ambient <= 0:
        raise ValueError("the system gamma above 1000 cd/m2 needs ambient light")
    return 1.2 + 0.42 * math.log10(peak / 1000) - 0.07623 * math.log10(ambient / 5)


def display_forward(v: str, peak: float = 200, contrast: float = 1000, ambient: float = 250, reflectivity: float = 0.005, eotf: str = "sRGB", exposure: float = 1) -> str:
    """Light of a display in cd/m2 from encoded values; black level and reflected ambient light are added."""
    black, reflected = peak / contrast, ambient / math.pi * reflectivity
    if eotf == "PQ":
        return f"({clamp(f'({pq_decode(clamp(v, 0, 1))} * {num(exposure)})', 0.005, peak)} + {num(black + reflected)})"
    if eotf == "linear":
        return f"({clamp(f'({v} * {num(exposure)})', max(0.005, black), peak)} + {num(reflected)})"
    shaped = srgb_to_linear(clamp(v, 0, 1)) if eotf == "sRGB" else f"pow({clamp(v, 0, 1)}, {num(float(eotf))})"
    return _lit(shaped, peak, black, reflected, exposure)


def _lit(shaped: str, peak: float, black: float, reflected: float, exposure: float) -> str:
    return f"({num(peak - black)} * {clamp(f'({shaped} * {num(exposure)})', 0, 1)} + {num(black + reflected)})"


def display_colours(rgb: tuple[str, str, str], peak: float = 200, contrast: float = 1000, ambient: float = 250, reflectivity: float = 0.005, eotf: str = "sRGB", exposure: float = 1) -> list[str]:
    """The same for the three components of a colour, which HLG needs together."""
    if eotf != "HLG":
        return [display_forward(v, peak, contrast, ambient, reflectivity, eotf, exposure) for v in rgb]
    shaped = hlg_to_linear(tuple(clamp(v, 0, 1) for v in rgb), hlg_gamma(peak, ambient))
    return [_lit(v, peak, peak / contrast, ambient / math.pi * reflectivity, exposure) for v in shaped]


def matrix(m, v: tuple[str, str, str]) -> list[str]:
    return [f"({' + '.join(f'{num(k)} * {x}' for k, x in zip(row, v))})" for row in np.asarray(m, float).tolist()]


def folded(*matrices) -> np.ndarray:
    """Product of matrices, the last applied first: one linear combination instead of several."""
    out = np.eye(3)
    for m in matrices:
        out = out @ np.asarray(m, float)
    return out


def pu_encode(v: str, kind: str = "banding_glare") -> str:
    p = PU[kind]
    y = f"pow({clamp(v, 0.005, 10000)}, {num(p[3])})"
    return f"({num(p[6])} * (pow(({num(p[0])} + {num(p[1])} * {y}) / ({num(1)} + {num(p[2])} * {y}), {num(p[4])}) - {num(p[5])}))"


def pu_decode(v: str, kind: str = "banding_glare") -> str:
    p = PU[kind]
    x = f"pow(greatest({v} / {num(p[6])} + {num(p[5])}, {num(0)}), {num(1 / p[4])})"
    return f"pow(greatest({x} - {num(p[0])}, {num(0)}) / ({num(p[1])} - {num(p[2])} * {x}), {num(1 / p[3])})"


def fixed_luma(v: str, bits: int = 8) -> str:
    return clamp(f"({v} / {num(2 ** (bits - 8) * 219)} - {num(16 / 219)})", 0, 1)


def fixed_chroma(v: str, bits: int = 8) -> str:
    return clamp(f"({v} / {num(2 ** (bits - 8) * 224)} - {num(128 / 224)})", -0.5, 0.5)


EPSILON = 1e-5


def safe_pow(x: str, p: float | str) -> str:
    p = p if isinstance(p, str) else num(p)
    return f"(pow({x} + {num(EPSILON)}, {p}) - pow({num(EPSILON)}, {p}))"


def pow_even(x: str, p: float) -> str:
    return f"(pow(greatest({x}, {num(EPSILON)}), {num(p)}) + pow(greatest(-({x}), {num(EPSILON)}), {num(p)}) - {num(EPSILON**p)})"


JOD_A, JOD_EXP, JOD_KNEE = 0.0439569391310215, 0.9302042722702026, 0.1


def jod(q: str) -> str:
    """Quality score from the pooled difference, linear below the knee; 10 means identical."""
    return f"(CASE WHEN {q} <= {num(JOD_KNEE)} THEN {num(10)} - {num(JOD_A * JOD_KNEE ** (JOD_EXP - 1))} * {q} ELSE {num(10)} - {num(JOD_A)} * pow({q}, {num(JOD_EXP)}) END)"


D_MAX = 2.5642454624176025


def clamp_difference(d: str, mode: str = "soft", limit: float = D_MAX) -> str:
    most = num(10**limit)
    return {"none": d, "hard": f"least({d}, {most})", "soft": f"({most} * {d} / ({most} + {d}))"}[mode]


def geometry(width: int, height: int, distance: float, diagonal_inches: float) -> dict[str, str]:
    """Physical size, field of view and pixels per degree of a display."""
    aspect = width / height
    size = f"({num(diagonal_inches * 0.0254)} / sqrt({num(1 + aspect**-2)}))"
    pixel = f"(2 * degrees(atan({size} / {num(2 * width)} / {num(distance)})))"
    return {"width_m": size, "fov_h_deg": f"(2 * degrees(atan({size} / {num(2 * distance)})))", "ppd": f"(1 / {pixel})"}
