"""Displays as tables: presets, JSON files of further ones, geometry and photometry as SQL over their columns."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vireo.functions import expressions as E

num = E.num

# Width and height in pixels; distance in metres or inches; diagonal in inches or diagonal field of view in degrees;
# peak and black level in cd/m2, or the contrast; ambient light in lux; colour space.
PRESETS = {
    "standard_4k": {"resolution": (3840, 2160), "metres": 0.7472, "diagonal": 30, "peak": 200, "contrast": 1000, "ambient": 250, "space": "sRGB"},
    "standard_hdr_pq": {"resolution": (3840, 2160), "metres": 0.7472, "diagonal": 30, "peak": 1500, "contrast": 1000000, "ambient": 10, "space": "BT.2020-PQ"},
    "standard_hdr_hlg": {"resolution": (3840, 2160), "metres": 0.7472, "diagonal": 30, "peak": 1500, "contrast": 1000000, "ambient": 10, "space": "BT.2020-HLG"},
    "standard_hdr_linear": {"resolution": (3840, 2160), "metres": 0.7472, "diagonal": 30, "peak": 1500, "contrast": 1000000, "ambient": 10, "space": "BT.709-linear"},
    "standard_hdr_linear_dark": {"resolution": (3840, 2160), "metres": 0.7472, "diagonal": 30, "peak": 1500, "contrast": 1000000, "ambient": 0, "space": "BT.709-linear"},
    "standard_hdr_linear_zoom": {"resolution": (3840, 2160), "metres": 0.25, "diagonal": 30, "peak": 10000, "contrast": 1000000, "ambient": 10, "space": "BT.709-linear"},
    "standard_fhd": {"resolution": (1920, 1080), "metres": 0.6, "diagonal": 24, "peak": 200, "contrast": 1000, "ambient": 250, "space": "sRGB"},
    "standard_hmd": {"resolution": (1440, 1600), "metres": 3, "fov": 110.0, "peak": 100, "black": 0.1, "ambient": 0, "space": "sRGB"},
    "standard_phone": {"resolution": (2400, 1080), "metres": 0.4, "diagonal": 6, "peak": 500, "black": 0.05, "ambient": 250, "space": "sRGB"},
    "sdr_4k_30": {"resolution": (3840, 2160), "metres": 0.6, "diagonal": 30, "peak": 100, "contrast": 1000, "ambient": 250, "space": "sRGB"},
    "sdr_fhd_24": {"resolution": (1920, 1080), "metres": 0.6, "diagonal": 24, "peak": 100, "contrast": 1000, "ambient": 250, "space": "sRGB"},
    "htc_vive_pro": {"resolution": (1440, 1600), "metres": 3, "fov": 110.0, "peak": 133.3, "black": 0.1, "ambient": 0, "space": "sRGB"},
    "iphone_12_pro": {"resolution": (2532, 1170), "inches_away": 20, "diagonal": 6.1, "peak": 825, "black": 0.0004, "ambient": 250, "space": "sRGB"},
    "iphone_14_pro": {"resolution": (2532, 1170), "inches_away": 20, "diagonal": 6.1, "peak": 1025, "black": 0.0004, "ambient": 250, "space": "sRGB"},
    "iphone_14_pro_vert": {"resolution": (1170, 2532), "inches_away": 20, "diagonal": 6.1, "peak": 1025, "black": 0.0004, "ambient": 250, "space": "sRGB"},
    "iphone_14_pro_hdr": {"resolution": (2532, 1170), "inches_away": 20, "diagonal": 6.1, "peak": 1590, "black": 0.0004, "ambient": 10, "space": "BT.2020-HLG"},
    "iphone_14_pro_hdr_vert": {"resolution": (1170, 2532), "inches_away": 20, "diagonal": 6.1, "peak": 1590, "black": 0.0004, "ambient": 10, "space": "BT.2020-HLG"},
    "ipad_pro_12_9": {"resolution": (2732, 2048), "inches_away": 20, "diagonal": 12.9, "peak": 600, "black": 0.37, "ambient": 250, "space": "sRGB"},
    "macbook_pro_16": {"resolution": (3072, 1920), "inches_away": 25, "diagonal": 16, "peak": 500, "black": 0.37, "ambient": 250, "space": "sRGB"},
    "lg_oled_2017_sdr": {"resolution": (3840, 2160), "inches_away": 101, "diagonal": 64.5, "peak": 272, "black": 0.014, "ambient": 100, "space": "sRGB"},
    "lg_oled_2017_hdr": {"resolution": (3840, 2160), "inches_away": 101, "diagonal": 64.5, "peak": 754, "black": 0.038, "ambient": 100, "space": "sRGB"},
    "eizo_CG3146": {"resolution": (4096, 2160), "metres": 0.73406, "diagonal": 31.063, "peak": 300, "contrast": 3000, "ambient": 0, "space": "sRGB"},
}
# Transfer function and primaries (RGB to XYZ) of the colour spaces that presets and common files name.
SPACES = {
    "sRGB": ("sRGB", E.RGB_TO_XYZ["sRGB"]),
    "BT.709": ("sRGB", E.RGB_TO_XYZ["sRGB"]),
    "BT.709-linear": ("linear", E.RGB_TO_XYZ["sRGB"]),
    "BT.2020-PQ": ("PQ", E.RGB_TO_XYZ["BT.2020"]),
    "BT.2020-HLG": ("HLG", E.RGB_TO_XYZ["BT.2020"]),
    "BT.2020-linear": ("linear", E.RGB_TO_XYZ["BT.2020"]),
    "luminance": ("linear", None),
}
REFLECTIVITY, HEADSET_DISTANCE, INCH = 0.005, 3.0, 0.0254
#: Columns of a table of displays; what is null isn't given.
SCHEMA = "display string, width int, height int, distance_m double, distance_heights double, diagonal_inches double, fov_horizontal double, fov_vertical double, fov_diagonal double, fixed_ppd double, peak double, contrast double, ambient double, reflectivity double, exposure double, colorspace string"


def preset_rows() -> list[tuple]:
    rows = []
    for name, d in PRESETS.items():
        metres = d["metres"] if "metres" in d else d["inches_away"] * INCH
        contrast = d["contrast"] if "contrast" in d else d["peak"] / d["black"]
        number = lambda k: float(d[k]) if k in d else None
        rows.append((name, *d["resolution"], float(metres), None, number("diagonal"), None, None, number("fov"), None, float(d["peak"]), float(contrast), float(d["ambient"]), REFLECTIVITY, 1.0, d["space"]))
    return rows


def display_rows(text: str) -> list[tuple]:
    """The same from JSON: an object of displays by name, with the usual fields; a contrast, a least luminance or neither (500)."""
    rows = []
    for name, d in json.loads(text).items():
        if "max_luminance" not in d or ("resolution" not in d and "pixels_per_degree" not in d):
            raise ValueError(f"display {name} needs max_luminance and resolution")
        if sum(k in d for k in ("fov_horizontal", "fov_vertical", "fov_diagonal")) > 1:
            raise ValueError(f"display {name} has several fields of view")
        number = lambda k: float(d[k]) if k in d else None
        peak, black = float(d["max_luminance"]), number("min_luminance")
        metres = number("viewing_distance_meters") if "viewing_distance_meters" in d else d["viewing_distance_inches"] * INCH if "viewing_distance_inches" in d else None
        w, h = d.get("resolution", (None, None))
        rows.append((name, w, h, metres, number("viewing_distance_heights"), number("diagonal_size_inches"), number("fov_horizontal"), number("fov_vertical"), number("fov_diagonal"), number("pixels_per_degree"), peak, number("contrast") or (peak / black if black else 500.0), number("E_ambient") or 0.0, float(d.get("k_refl", REFLECTIVITY)), float(d.get("exposure", 1)), d.get("colorspace", "sRGB")))
    return rows


def display_table(spark: SparkSession, texts: list[str] = ()) -> DataFrame:
    """Presets and the displays of JSON texts, which come first where names are equal; a small local table."""
    rows = {r[0]: r for r in preset_rows()}
    for text in reversed(texts):
        rows |= {r[0]: r for r in display_rows(text)}
    return spark.createDataFrame(list(rows.values()), SCHEMA)


def values_sql(rows: list[tuple]) -> str:
    """A table of displays as SQL VALUES."""
    lit = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v) if isinstance(v, int) else num(v)
    return f"(VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) AS d({', '.join(f.split()[0] for f in SCHEMA.split(', '))})"


_ASPECT = "(CAST(width AS DOUBLE) / height)"
_DIAGONAL = f"(diagonal_inches * {num(INCH)} / sqrt(1e0 + {_ASPECT} * {_ASPECT}))"
_DISTANCE = f"coalesce(distance_m, distance_heights * {_DIAGONAL}, {num(HEADSET_DISTANCE)})"
#: The display's height in metres: from its vertical, horizontal or diagonal field of view, else from its diagonal.
_PIXELS_AWAY = "(sqrt(CAST(width AS DOUBLE) * width + CAST(height AS DOUBLE) * height) / (2e0 * tan(radians(fov_diagonal / 2e0))))"
_HEIGHT = f"coalesce(2e0 * tan(radians(fov_vertical / 2e0)) * {_DISTANCE}, 2e0 * tan(radians(fov_horizontal / 2e0)) * {_DISTANCE} / {_ASPECT}, height / {_PIXELS_AWAY} * {_DISTANCE}, {_DIAGONAL})"
_PIXEL = f"(2e0 * degrees(atan(5e-1 * {_HEIGHT} * {_ASPECT} / width / {_DISTANCE})))"
#: Geometry of a row of displays; a fixed ppd overrides the rest.
GEOMETRY = {
    "distance": f"CASE WHEN fixed_ppd IS NULL THEN {_DISTANCE} END",
    "width_m": f"CASE WHEN fixed_ppd IS NULL THEN {_HEIGHT} * {_ASPECT} END",
    "height_m": f"CASE WHEN fixed_ppd IS NULL THEN {_HEIGHT} END",
    "width_deg": f"CASE WHEN fixed_ppd IS NULL THEN 2e0 * degrees(atan({_HEIGHT} * {_ASPECT} / (2e0 * {_DISTANCE}))) END",
    "height_deg": f"CASE WHEN fixed_ppd IS NULL THEN 2e0 * degrees(atan({_HEIGHT} / (2e0 * {_DISTANCE}))) END",
    "ppd": f"coalesce(fixed_ppd, 1e0 / {_PIXEL})",
}
PHOTOMETRY = {"black": "peak / contrast", "reflected": f"ambient / {num(3.141592653589793)} * reflectivity"}


def ppd_at(eccentricity: str) -> str:
    """Pixels a degree at an angle from the centre."""
    return f"coalesce(fixed_ppd, 1e0 / {_PIXEL} * (tan(radians({eccentricity} + {_PIXEL} / 2e0)) - tan(radians({eccentricity}))) / tan(radians({_PIXEL} / 2e0)))"


def colour_spaces(text: str) -> dict[str, tuple[str, tuple | None]]:
    """Transfer function and RGB-to-XYZ rows by colour space, from JSON; spaces of luminance alone have no rows."""
    return {k: (d["EOTF"], tuple(tuple(d[f"RGB2{r}"]) for r in "XYZ") if "RGB2X" in d else None) for k, d in json.loads(text).items()}


def find_file(name: str, explicit: list[str] = (), variable: str = "VIREO_CONFIG", folder: str | None = None) -> str:
    """Path of a configuration file: one of the explicit files whose name begins and ends alike, then explicit folders, the folder a
    variable of the environment names, and ``folder``."""
    base, extension = os.path.splitext(name)
    for path in explicit:
        file = os.path.basename(path)
        if file.startswith(base) and file.endswith(extension) and os.path.isfile(path):
            return path
    for place in [*explicit, os.environ.get(variable), folder]:
        if place and os.path.isfile(os.path.join(place, name)):
            return os.path.join(place, name)
    raise FileNotFoundError(name)


def encoded(v: str, target: str, display: dict) -> str:
    """Values for metrics on display-encoded content: as they are, or perceptually encoded light over the code of the target's white
    where the input is linear or PQ."""
    white = {"display_encoded_01": "1e4", "display_encoded_100nit": "1e2", "display_encoded_dmax": num(display["peak"])}[target]
    if display.get("eotf", "sRGB") not in ("linear", "PQ"):
        return v
    return f"({E.pu_encode(E.display_forward(v, **display))} / {E.pu_encode(white)})"


# Displays of rows of pictures ---------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Display:
    """How a display turns values into light, and its pixels a degree; the default is the standard 4K display."""

    peak: float = 200.0
    contrast: float = 1000.0
    ambient: float = 250.0
    reflectivity: float = REFLECTIVITY
    exposure: float = 1.0
    eotf: str = "sRGB"
    primaries: tuple | None = sum(E.RGB_TO_XYZ["sRGB"], ())
    ppd: float = 75.4024493

    def light(self, x: np.ndarray) -> np.ndarray:
        """cd/m2 of planes (rows, colours, h, w); one plane stands for equal colours."""
        black, reflected = self.peak / self.contrast, self.ambient / np.pi * self.reflectivity
        if self.eotf == "linear":
            return np.clip(x * self.exposure, max(0.005, black), self.peak) + reflected
        x = np.clip(x, 0, 1)
        if self.eotf == "PQ":
            root = x ** (1 / E.PQ_M)
            absolute = 10000 * (np.maximum(root - E.PQ_C1, 0) / (E.PQ_C2 - E.PQ_C3 * root)) ** (1 / E.PQ_N)
            return np.clip(absolute * self.exposure, 0.005, self.peak) + black + reflected
        if self.eotf == "sRGB":
            shaped = np.where(x > 0.04045, ((x + 0.055) / 1.055) ** 2.4, x / 12.92)
        elif self.eotf == "HLG":
            b, c = 1 - 4 * E.HLG_A, 0.5 - E.HLG_A * np.log(4 * E.HLG_A)
            scene = np.where(x <= 0.5, x * x / 3, (np.exp((x - c) / E.HLG_A) + b) / 12)
            weights = np.array(E.HLG_WEIGHTS)[:, None, None] if x.shape[1] == 3 else 1.0
            shaped = (scene * weights).sum(1, keepdims=True) ** (E.hlg_gamma(self.peak, self.ambient) - 1) * scene
        else:
            shaped = x ** float(self.eotf)
        return (self.peak - black) * np.clip(shaped * self.exposure, 0, 1) + black + reflected

    def to(self, *matrices) -> np.ndarray:
        """The display's colours through matrices from XYZ, the last applied first."""
        if self.primaries is None:
            raise ValueError("a display of luminance alone shows no colours")
        return E.folded(*matrices, np.reshape(self.primaries, (3, 3)))


#: Column of the display's numbers; its fields are those of Display.
SHOWN = "_display"
_NUMBERS = ("peak", "contrast", "ambient", "reflectivity", "exposure")


def described(displays: DataFrame, spaces: dict[str, tuple[str, tuple | None]] = SPACES) -> DataFrame:
    """display and its numbers as a struct, from rows of SCHEMA; a colour space that isn't among ``spaces`` is an error."""
    rows = [(k, eotf, None if m is None else [float(v) for row in m for v in row]) for k, (eotf, m) in spaces.items()]
    known = displays.sparkSession.createDataFrame(rows, "colorspace string, eotf string, primaries array<double>")
    joined = displays.join(known, "colorspace", "left")
    joined = joined.where(F.assert_true(F.col("eotf").isNotNull(), F.concat(F.lit("no colour space named "), F.coalesce("colorspace", F.lit("null")))).isNull())
    return joined.select("display", F.struct(*_NUMBERS, "eotf", "primaries", F.expr(GEOMETRY["ppd"]).alias("ppd")).alias(SHOWN))


def with_display(rows: DataFrame, displays: DataFrame | None = None, spaces: dict[str, tuple[str, tuple | None]] = SPACES) -> DataFrame:
    """rows with the numbers of the display that their column ``display`` names; a name that isn't in the table is an error.

    The table of displays (presets by default) is small, and Spark broadcasts it by its size.
    """
    held = described(display_table(rows.sparkSession) if displays is None else displays, spaces)
    joined = rows.join(held, "display", "left")
    return joined.where(F.assert_true(F.col(SHOWN).isNotNull(), F.concat(F.lit("no display named "), F.coalesce(F.col("display").cast("string"), F.lit("null")))).isNull())
