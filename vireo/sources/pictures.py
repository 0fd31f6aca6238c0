"""Pictures of up to 16 bits a sample or of floats: PNG, PFM and Radiance files to plane rows and back.

Files are read by Spark's binary source, a picture a row, and decoded in tasks with numpy.  Whole numbers come out over their largest
value, floats as they are.  A file that is damaged is an error that names it.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from vireo.sources.rawsource import _mounted

RGB = ["v0", "v1", "v2"]
# Fixed values of the formats.
PNG, SAMPLES_OF = b"\x89PNG\r\n\x1a\n", {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
#: Start and step by row and column of the passes of an interlaced picture.
PASSES = ((0, 0, 8, 8), (0, 4, 8, 8), (4, 0, 8, 4), (0, 2, 4, 4), (2, 0, 4, 2), (0, 1, 2, 2), (1, 0, 2, 1))


def _unpredicted(kinds: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Bytes (rows, units, bytes a unit) from differences to what each row's predictor says: 0 none, 1 left, 2 up, 3 their mean, 4 the
    one nearest to left + up - up left.

    A unit needs its left, upper and upper left ones, so the units of an anti-diagonal are found together.
    """
    h, w, unit = data.shape
    if not h or not w:
        return data
    if kinds.max() > 4:
        raise ValueError("no such predictor")
    if h and (kinds == kinds[0]).all() and kinds[0] < 3:  # one simple predictor throughout: sums along an axis
        return data if kinds[0] == 0 else np.cumsum(data, 2 - int(kinds[0]), dtype=np.uint8)
    rows = np.arange(h)
    # slanted[d + 2, y + 1] is unit d - y of row y; what lies outside is 0
    slanted = np.zeros((h + w + 1, h + 1, unit), np.int16)
    for d in range(h + w - 1):
        first, last = max(0, d - w + 1), min(h, d + 1)
        own, kind = rows[first:last], kinds[first:last, None]
        left, up, corner = slanted[d + 1, first + 1 : last + 1], slanted[d + 1, first:last], slanted[d, first:last]
        about = left + up - corner
        apart = [np.abs(about - v) for v in (left, up, corner)]
        nearest = np.where((apart[0] <= apart[1]) & (apart[0] <= apart[2]), left, np.where(apart[1] <= apart[2], up, corner))
        said = np.select([kind == 1, kind == 2, kind == 3, kind == 4], [left, up, (left + up) >> 1, nearest], 0)
        slanted[d + 2, first + 1 : last + 1] = (data[own, d - own] + said) & 255
    at = rows[:, None]
    return slanted[at + np.arange(w) + 2, at + 1].astype(np.uint8)


def _chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = len(PNG)
    while at < len(data):
        if at + 12 > len(data):
            raise ValueError("the file ends within a chunk")
        size, name = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if len(body) < size or struct.unpack(">I", data[at + 8 + size : at + 12 + size] or bytes(4))[0] != zlib.crc32(name + body):
            raise ValueError(f"chunk {name.decode('latin-1')} doesn't have its checksum")
        yield name, body
        at += 12 + size


def _whole_numbers(rows: np.ndarray, width: int, depth: int, samples: int) -> np.ndarray:
    """(h, w, samples) from bytes by row."""
    h = len(rows)
    if depth == 16:
        return rows.reshape(h, width, samples, 2).astype(np.uint16) @ np.array([256, 1], np.uint16)
    if depth == 8:
        return rows.reshape(h, width, samples)
    bits = np.unpackbits(rows, axis=1)[:, : width * samples * depth].reshape(h, width, samples, depth)
    return bits @ (1 << np.arange(depth)[::-1]).astype(np.uint8)


def decode_png(data: bytes) -> np.ndarray:
    """(h, w, samples) in 0..1; colours of palettes are looked up."""
    if data[: len(PNG)] != PNG:
        raise ValueError("not a PNG file")
    held: dict[bytes, bytes] = {}
    for name, body in _chunks(data):
        held[name] = held.get(name, b"") + body if name == b"IDAT" else body
    if not {b"IHDR", b"IDAT", b"IEND"} <= set(held):
        raise ValueError("the file isn't complete")
    w, h, depth, kind, _, _, interlaced = struct.unpack(">IIBBBBB", held[b"IHDR"])
    if kind not in SAMPLES_OF or depth not in (1, 2, 4, 8, 16):
        raise ValueError("no such kind of picture")
    samples, out = SAMPLES_OF[kind], None
    bytes_of = np.frombuffer(zlib.decompress(held[b"IDAT"]), np.uint8)
    out, at = np.zeros((h, w, samples), np.uint16), 0
    for y, x, down, right in PASSES if interlaced else ((0, 0, 1, 1),):
        ph, pw = -(-(h - y) // down), -(-(w - x) // right)
        if ph <= 0 or pw <= 0:
            continue
        line, unit = -(-pw * samples * depth // 8), max(1, samples * depth // 8)
        part = bytes_of[at : at + ph * (line + 1)]
        if len(part) < ph * (line + 1):
            raise ValueError("the file has too few samples")
        part = part.reshape(ph, line + 1)
        rows = _unpredicted(part[:, 0], part[:, 1:].reshape(ph, -1, unit)).reshape(ph, line)
        out[y::down, x::right] = _whole_numbers(rows, pw, depth, samples)
        at += ph * (line + 1)
    if kind == 3:
        return np.frombuffer(held[b"PLTE"], np.uint8).reshape(-1, 3)[out[:, :, 0]] / 255.0
    return out / float(2**depth - 1)


def encode_png(x: np.ndarray, bits: int = 16) -> bytes:
    """(h, w) or (h, w, 3) in 0..1 as samples of 8 or 16 bits, rounded to the nearest."""
    x = x[:, :, None] if x.ndim == 2 else x
    h, w, samples = x.shape
    codes = np.floor(np.clip(x, 0, 1) * (2**bits - 1) + 0.5).astype(">u2" if bits == 16 else np.uint8)
    rows = np.frombuffer(codes.tobytes(), np.uint8).reshape(h, -1)
    up = np.diff(rows, axis=0, prepend=np.zeros((1, rows.shape[1]), np.uint8))
    body = zlib.compress(np.concatenate([np.full((h, 1), 2, np.uint8), up], 1).tobytes(), 6)
    chunk = lambda name, b: struct.pack(">I", len(b)) + name + b + struct.pack(">I", zlib.crc32(name + b))
    return PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, bits, {1: 0, 3: 2}[samples], 0, 0, 0)) + chunk(b"IDAT", body) + chunk(b"IEND", b"")


def decode_pfm(data: bytes) -> np.ndarray:
    m = re.match(rb"(PF|Pf)\s+(\d+)\s+(\d+)\s+(-?[0-9.eE+-]+)[ \t\r]*\n", data)
    if not m:
        raise ValueError("not a PFM file")
    w, h, samples, scale = int(m[2]), int(m[3]), 3 if m[1] == b"PF" else 1, float(m[4])
    body = data[m.end() :]
    if len(body) != 4 * w * h * samples:
        raise ValueError(f"the file holds {len(body)} bytes of samples instead of {4 * w * h * samples}")
    return np.frombuffer(body, "<f4" if scale < 0 else ">f4").reshape(h, w, samples)[::-1].astype(float)


def encode_pfm(x: np.ndarray) -> bytes:
    x = x[:, :, None] if x.ndim == 2 else x
    return f"{'PF' if x.shape[2] == 3 else 'Pf'}\n{x.shape[1]} {x.shape[0]}\n-1.0\n".encode() + np.ascontiguousarray(x[::-1], "<f4").tobytes()


def decode_radiance(data: bytes) -> np.ndarray:
    """Shared-exponent samples, rows plain or in runs by component; the exposure and the primaries of the header don't count."""
    head, found, rest = data.partition(b"\n\n")
    size, _, body = rest.partition(b"\n")
    m = re.fullmatch(rb"-Y (\d+) \+X (\d+)", size.strip())
    if not head.startswith(b"#?") or not found or not m or b"32-bit_rle_rgbe" not in head:
        raise ValueError("not a Radiance file that can be read")
    h, w, at = int(m[1]), int(m[2]), 0
    out = np.zeros((h, w, 4), np.uint8)
    for y in range(h):
        if body[at : at + 4] != bytes([2, 2, w >> 8, w & 255]):
            row = np.frombuffer(body, np.uint8, 4 * w, at).reshape(w, 4)
            if len(row) > 1 and (row[:, :3] == 1).all(1).any():
                raise ValueError("runs of whole samples aren't read")
            out[y], at = row, at + 4 * w
            continue
        at += 4
        for c in range(4):
            x = 0
            while x < w:
                n = body[at]
                run = n - 128 if n > 128 else n
                if not n or x + run > w or at + (2 if n > 128 else run + 1) > len(body):
                    raise ValueError("a row of runs isn't complete")
                out[y, x : x + run, c] = body[at + 1] if n > 128 else np.frombuffer(body, np.uint8, run, at + 1)
                at += 2 if n > 128 else run + 1
                x += run
    return np.where(out[:, :, 3:] > 0, np.ldexp(1.0, out[:, :, 3:].astype(int) - 136) * (out[:, :, :3] + 0.5), 0.0)


DECODERS = {".png": decode_png, ".pfm": decode_pfm, ".hdr": decode_radiance}


def read_pictures(spark: SparkSession, path: str) -> DataFrame:
    """clip (path), frame 0, h, w, v0, v1, v2 of .png, .pfm and .hdr files; alpha is dropped, grey is repeated.

    Many files are best read by their folder, which Spark lists once; each file that a pattern matches is listed by itself.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches):
        for b in batches:
            for at, data in zip(b.column(0).to_pylist(), b.column(1)):
                try:
                    x = DECODERS[os.path.splitext(at)[1].lower()](data.as_py())
                except (KeyError, ValueError, IndexError, zlib.error, struct.error) as e:
                    raise ValueError(f"{at} isn't a picture that can be read: {e}") from e
                h, w, n = x.shape
                ends = pa.array([0, h * w], pa.int32())
                planes = [pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(x[:, :, k if n >= 3 else 0], float).ravel())) for k in range(3)]
                yield pa.RecordBatch.from_arrays([pa.array([at]), *(pa.array([v], pa.int32()) for v in (0, h, w)), *planes], ["clip", "frame", "h", "w", *RGB])

    return files.mapInArrow(run, "clip string, frame int, h int, w int, " + ", ".join(f"{v} array<double>" for v in RGB))


SCHEMA = "name string, h int, w int, planes array<array<double>>"


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class PictureWriter(DataSourceWriter):
    """A file a row, written beside its final name, which commit gives it; a job that fails leaves nothing."""

    def __init__(self, options: dict):
        self.folder, self.bits, self.mark = _mounted(options["path"]), int(options.get("bits", 16)), f".writing-{uuid.uuid4().hex}"
        os.makedirs(self.folder, exist_ok=True)

    def write(self, rows: Iterator) -> Written:
        names = []
        for r in rows:
            x = np.stack([np.reshape(p, (r.h, r.w)) for p in r.planes], -1)
            data = {".png": lambda: encode_png(x, self.bits), ".pfm": lambda: encode_pfm(x)}[os.path.splitext(r.name)[1].lower()]()  # noqa: B023
            # a task that runs again or twice writes whole files and renames them, so that none is ever half written
            at = os.path.join(self.folder, os.path.basename(r.name) + self.mark)
            with open(f"{at}-{uuid.uuid4().hex}", "wb") as f:
                f.write(data)
            os.replace(f.name, at)
            names.append(os.path.basename(r.name))
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        names = [n for m in messages if m for n in m.names]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("several pictures have one name")
        for n in names:
            os.replace(os.path.join(self.folder, n + self.mark), os.path.join(self.folder, n))

    def abort(self, messages: list[Written | None]) -> None:
        for n in os.listdir(self.folder):
            if self.mark in n:
                os.remove(os.path.join(self.folder, n))


class Pictures(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pictures"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> PictureWriter:
        return PictureWriter(self.options)


def write_pictures(rows: DataFrame, folder: str, planes: list[str], name: str = "name", bits: int = 16) -> None:
    """Rows (name, h, w and one or three planes) as .png files of 8 or 16 bits, or .pfm files, by the names' endings."""
    rows.sparkSession.dataSource.register(Pictures)
    made = rows.selectExpr(f"`{name}` AS name", "h", "w", f"array({', '.join(f'`{p}`' for p in planes)}) AS planes")
    made.write.format("pictures").option("bits", bits).mode("append").save(folder)
