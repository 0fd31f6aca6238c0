"""Frame sources: a source is a DataFrame of plane rows (clip, frame, h, w, planes as arrays of doubles), whatever it is read from.

Steps on sources are functions from such a DataFrame to another, so sources are wrapped with ``DataFrame.transform``.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vireo.functions import expressions as E
from vireo.operators import planes as P
from vireo.sources import pictures, rawsource, rawvideo

RGB = ["v0", "v1", "v2"]


def checked(source: DataFrame, planes: list[str]) -> DataFrame:
    """source; a row whose planes don't hold h * w samples, or without clip or frame, is an error when it is read."""
    fits = F.lit(True)
    for p in planes:
        fits &= F.coalesce(F.size(p) == F.col("h") * F.col("w"), F.lit(False))
    ok = F.col("frame").isNotNull() & F.col("clip").isNotNull() & (F.col("frame") >= 0) & fits
    return source.where(F.assert_true(ok, F.lit("not a source of frames: clip, frame and planes of h * w samples")).isNull())


def as_unit(values: np.ndarray) -> np.ndarray:
    """Samples of any supported type as doubles: whole numbers over their largest value, 16-bit ones also where they are packed signed."""
    if values.dtype == np.uint8:
        return values / 255.0
    if values.dtype in (np.uint16, np.int16):
        return values.view(np.uint16) / 65535.0
    if values.dtype.kind == "f":
        return values.astype(float)
    raise TypeError(f"samples of type {values.dtype} aren't supported")


def unit_samples(rows: DataFrame, samples: str, kind: str) -> DataFrame:
    """rows whose bytes ``samples``, of the little-endian type that the column ``kind`` names (uint8, uint16, int16, float32, ...), are arrays
    of doubles.  Null bytes stay null; a type that isn't supported, or bytes that don't fill it, is an error."""
    at = rows.columns.index(samples)

    def run(batches):
        for b in batches:
            made = [None if x is None else as_unit(np.frombuffer(x, np.dtype(k).newbyteorder("<"))) for x, k in zip(b.column(at).to_pylist(), b.column(kind).to_pylist())]
            columns = list(b.columns)
            columns[at] = pa.array(made, pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays(columns, b.schema.names)

    return rows.mapInArrow(run, ", ".join(f"`{f.name}` {'array<double>' if f.name == samples else f.dataType.simpleString()}" for f in rows.schema.fields))


#: Values ahead of packed frames: frames, height, width, bits, chroma, and the height and width to show.
HEADER = 7


def unpacked(rows: DataFrame, packed: str, keep: list[str], yuv: bool = False, space: str = "709") -> DataFrame:
    """keep, frame, h, w, v0, v1, v2 of frames packed into an array of numbers behind a header: interleaved red, green, blue as shares of
    the largest value of their bits, or with ``yuv`` planes of luma and chroma, resized as the header says.

    An array that is shorter than its header says is an error.
    """
    names = [*keep, "frame", "h", "w", *RGB]

    def run(batches):
        for b in batches:
            for k, x in enumerate(b.column(packed).to_pylist()):
                x = np.array(x, float)
                n, h, w, bits, chroma, tall, wide = map(int, x[:HEADER])
                dx, dy = rawvideo.CHROMA[str(chroma)] if yuv else (1, 1)
                luma, other = (h * w, h // dy * (w // dx)) if yuv else (tall * wide, tall * wide)
                if len(x) < HEADER + n * (luma + 2 * other):
                    raise ValueError(f"packed frames hold {len(x) - HEADER} values, their header says {n * (luma + 2 * other)}")
                for f in range(n):
                    at = HEADER + f * (luma + 2 * other)
                    if yuv:
                        y, u, v = (x[i : i + size].reshape(shape) for i, size, shape in ((at, luma, (h, w)), (at + luma, other, (h // dy, w // dx)), (at + luma + other, other, (h // dy, w // dx))))
                        rgb = P.resize(_rgb(y, u, v, bits, space), tall, wide) if (tall, wide) != (h, w) else _rgb(y, u, v, bits, space)
                    else:
                        rgb = x[at : at + 3 * luma].reshape(tall, wide, 3).transpose(2, 0, 1) / (2**bits - 1)
                    ends = pa.array([0, tall * wide], pa.int32())
                    yield pa.RecordBatch.from_arrays([*(b.column(c).slice(k, 1) for c in keep), *(pa.array([v], pa.int32()) for v in (f, tall, wide)), *(pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(p).ravel())) for p in rgb)], names)

    held = rows.where(F.col(packed).isNotNull()).select(*keep, packed)
    return held.mapInArrow(run, ", ".join([*P._fields(held, keep), "frame int, h int, w int", *(f"{v} array<double>" for v in RGB)]))


def _rgb(y: np.ndarray, u: np.ndarray, v: np.ndarray, bits: int, space: str) -> np.ndarray:
    """(3, h, w) from codes of luma and chroma planes, clipped to 0..1."""
    y = np.clip(y / (2 ** (bits - 8) * 219) - 16 / 219, 0, 1)
    u, v = (P.resize(np.clip(p / (2 ** (bits - 8) * 224) - 128 / 224, -0.5, 0.5), *y.shape) for p in (u, v))
    return np.stack([np.clip(sum(k * x for k, x in zip(row, (y, u, v))), 0, 1) for row in E.YCBCR_TO_RGB["bt2020" if space == "2020" else "bt709"]])


def ordered(array: np.ndarray, order: str) -> np.ndarray:
    """An array with its axes named by a string such as HWC, FCHW or BHW, laid out as batch, channel, frame, height, width."""
    order = order.upper()
    if len(order) != array.ndim or len(set(order)) != len(order) or set(order) - set("BCFHW") or not {"H", "W"} <= set(order):
        raise ValueError(f"{order} doesn't name the axes of {array.shape}")
    missing = [a for a in "BCFHW" if a not in order]
    held = array.reshape(array.shape + (1,) * len(missing))
    return held.transpose([(order + "".join(missing)).index(a) for a in "BCFHW"])


def array_source(spark: SparkSession, test: np.ndarray, reference: np.ndarray, order: str, fps: float = 0) -> DataFrame:
    """clip (place in the batch), frame, h, w, t0.., r0..: arrays in memory as a source; a batch of one reference serves all tests."""
    t, r = (ordered(x, order) for x in (test, reference))
    if t.shape[1:] != r.shape[1:] or r.shape[0] not in (1, t.shape[0]):
        raise ValueError(f"test {t.shape} and reference {r.shape} differ in shape")
    if t.shape[1] not in (1, 3):
        raise ValueError("frames have one or three channels")
    if t.shape[2] > 1 and not fps:
        raise ValueError("several frames need a frame rate")
    b, c, f, h, w = t.shape
    side = lambda x, k, n: [as_unit(np.ascontiguousarray(x[k if x.shape[0] > 1 else 0, m, n])).ravel().tolist() for m in range(c)]
    rows = [(k, n, h, w, *side(t, k, n), *side(r, k, n)) for k in range(b) for n in range(f)]
    names = ", ".join(f"{s}{m} array<double>" for s in "tr" for m in range(c))
    return spark.createDataFrame(rows, f"clip long, frame int, h int, w int, {names}")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """clip (path), frame 0, h, w, v0, v1, v2: red, green and blue of 8-bit images in 0..1; alpha is dropped, grey is repeated.

    Spark's own image source decodes png, jpeg, gif and bmp; files that it can't decode are an error.
    """
    files = spark.read.format("image").option("dropInvalid", False).load(path).select("image.*")

    def run(batches):
        for b in batches:
            for origin, h, w, n, data in zip(*(b.column(c).to_pylist() for c in ("origin", "height", "width", "nChannels", "data"))):
                if h <= 0:
                    raise ValueError(f"{origin} isn't an image that can be read")
                x = np.frombuffer(data, np.uint8).reshape(h, w, n) / 255.0
                planes = [x[:, :, 2 - k if n >= 3 else 0].ravel() for k in range(3)]  # stored as blue, green, red
                ends = pa.array([0, h * w], pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array([origin]), *(pa.array([v], pa.int32()) for v in (0, h, w)), *(pa.ListArray.from_arrays(ends, pa.array(p)) for p in planes)], ["clip", "frame", "h", "w", *RGB])

    return files.mapInArrow(run, "clip string, frame int, h int, w int, " + ", ".join(f"{v} array<double>" for v in RGB))


def rgb_frames(frames: DataFrame) -> DataFrame:
    """clip (path), frame, h, w, v0, v1, v2 from raw planar video (read_raw_video): samples to floats, chroma brought to the luma's size,
    YCbCr to RGB by the clip's colour space, clipped to 0..1."""

    def run(batches):
        for b in batches:
            for path, frame, h, w, bits, chroma, space, *planes in zip(*(b.column(c).to_pylist() for c in ("path", "frame", "height", "width", "bits", "chroma", "space", "luma", "u", "v"))):
                kind, dx, dy = "<u2" if bits > 8 else "u1", *rawvideo.CHROMA[chroma]
                y, u, v = (np.frombuffer(p, kind).reshape(shape) for p, shape in zip(planes, ((h, w), (h // dy, w // dx), (h // dy, w // dx))))
                rgb = [x.ravel() for x in _rgb(y, u, v, bits, space)]
                ends = pa.array([0, h * w], pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array([path]), *(pa.array([x], pa.int32()) for x in (frame, h, w)), *(pa.ListArray.from_arrays(ends, pa.array(x)) for x in rgb)], ["clip", "frame", "h", "w", *RGB])

    columns = frames.select("path", "frame", "height", "width", "bits", "chroma", "space", "luma", "u", "v")
    return columns.mapInArrow(run, "clip string, frame int, h int, w int, " + ", ".join(f"{v} array<double>" for v in RGB))


def read_sequence(spark: SparkSession, pattern: str, start: int = 0, step: int = 1, last: int | None = None) -> DataFrame:
    """clip (the pattern), frame, h, w, v0, v1, v2 of numbered images, up to the first gap; frames are numbered from 0 on."""
    folder, name = os.path.split(pattern)
    files = f"{folder}/{re.sub('%0?[0-9]*d', '*', name)}"
    base = lambda c: F.regexp_extract(c, "([^/]*)$", 1)
    names = spark.read.format("binaryFile").load(files).select(base("path").alias("name"))  # names alone, contents aren't read
    found = rawvideo.sequence_frames(names, name, start=start, step=step, last=last)
    read = pictures.read_pictures if name.lower().endswith(tuple(pictures.DECODERS)) else read_images
    held = read(spark, files).withColumn("name", base("clip")).drop("frame").join(found, "name").withColumn("frame", ((F.col("frame") - start) / step).cast("int"))
    return held.select(F.lit(pattern).alias("clip"), "frame", "h", "w", *RGB)


def read_frames(spark: SparkSession, path: str, keep: bool = False, **options) -> DataFrame:
    """The source for a path by its form: a numbered pattern, raw video, or images.  ``keep`` persists the frames for random access."""
    if "%" in path:
        source = read_sequence(spark, path, **options)
    elif path.lower().endswith(".yuv"):
        source = rgb_frames(rawsource.read_video(spark, path, **options))
    elif path.lower().endswith((".png", ".pfm", ".hdr")):
        source = pictures.read_pictures(spark, path)
    elif path.lower().endswith((".jpg", ".jpeg", ".gif", ".bmp")):
        source = read_images(spark, path)
    else:
        raise ValueError(f"no source reads {path}")
    return source.persist() if keep else source


def frame_range(source: DataFrame, first: int = 0, step: int = 1, last: int | None = None, frames: int | None = None) -> DataFrame:
    """Frames first, first + step, ... last, at most ``frames`` of them, numbered from 0 on."""
    until = [x for x in (last, None if frames is None else first + step * (frames - 1)) if x is not None]
    kept = source.where((F.col("frame") >= first) & ((F.col("frame") - first) % step == 0) & (F.col("frame") <= min(until) if until else F.lit(True)))
    return kept.withColumn("frame", ((F.col("frame") - first) / step).cast("int"))


def resized(source: DataFrame, planes: list[str], w: int, h: int | None = None, method: str = "bilinear") -> DataFrame:
    """Planes at another size; without a height the aspect is kept (all rows of one size then share it)."""

    def scaled(x: np.ndarray) -> np.ndarray:
        return np.clip(P.resize(x, h or round(x.shape[-2] * w / x.shape[-1]), w, method), 0, 1)

    return P.filtered(source, scaled, planes, keep=["clip", "frame"])


def paired(test: DataFrame, reference: DataFrame, planes: list[str], by: list[str] = ["clip"]) -> DataFrame:
    """by, frame, h, w, t0.., r0..: frames that both sides have; a difference in size or frame rate (column fps, if there) is an error."""
    side = lambda df, s: df.select(*by, "frame", *(F.col(c).alias(f"{s}_{c}") for c in ("h", "w", *(["fps"] if "fps" in df.columns else []))), *(F.col(p).alias(f"{s}{k}") for k, p in enumerate(planes)))
    both = side(test, "t").join(side(reference, "r"), [*by, "frame"])
    same = (F.col("t_h") == F.col("r_h")) & (F.col("t_w") == F.col("r_w"))
    if {"t_fps", "r_fps"} <= set(both.columns):
        same &= F.col("t_fps") == F.col("r_fps")
    held = both.where(F.assert_true(same, F.lit("test and reference differ in size or frame rate")).isNull())
    return held.select(*by, "frame", F.col("t_h").alias("h"), F.col("t_w").alias("w"), *(f"{s}{k}" for s in "tr" for k in range(len(planes))))


def clip_pairs(test: DataFrame, reference: DataFrame, planes: list[str], offset: int = 0, frames: int | None = None, width: int | None = None, by: list[str] = ["clip"]) -> DataFrame:
    """Pairs of ``frames`` frames (all by default) from frame ``offset`` on, numbered from 0, at another width if one is given, aspect kept."""
    sides = [frame_range(df, offset, 1, None, frames) for df in (test, reference)]
    if width:
        sides = [resized(df, planes, width) for df in sides]
    return paired(*sides, planes, by)


def lengths(test: DataFrame, reference: DataFrame, by: list[str] = ["clip"]) -> DataFrame:
    """by, test, reference, compared: frames of each side and of both; clips whose sides differ can be told by it."""
    count = lambda df, name: df.groupBy(*by).agg(F.count(F.lit(1)).alias(name))
    both = count(test, "test").join(count(reference, "reference"), by, "full_outer").na.fill(0, ["test", "reference"])
    return both.withColumn("compared", F.least("test", "reference"))


def resampled(source: DataFrame, fps: str, rate: str, frames: str) -> DataFrame:
    """Frames at another rate: frame i of the result is the source's frame floor((i + 1/2) fps / rate), up to its ``frames`` * rate / fps.

    Each source frame is repeated where it is due, so nothing is joined.  Whole numbers that rounding just misses count.
    """
    due = f"sequence(CAST(greatest(ceil(frame * {rate} / {fps} - 5e-1 - 1e-6 * {rate} / {fps}), 0) AS INT), CAST(ceil((frame + 1) * {rate} / {fps} - 5e-1 - 1e-6 * {rate} / {fps}) AS INT) - 1)"
    some = f"ceil((frame + 1) * {rate} / {fps} - 5e-1 - 1e-6 * {rate} / {fps}) > greatest(ceil(frame * {rate} / {fps} - 5e-1 - 1e-6 * {rate} / {fps}), 0)"
    return source.where(some).withColumn("i", F.explode(F.expr(due))).where(F.expr(f"i < CAST(floor({frames} * {rate} / {fps}) AS INT)"))
