"""Raw planar video as a data source: frames are read by offset, ranges of frames are planned as partitions, filters are pushed down.

``register(spark)`` makes the format ``rawvideo`` known.  Files are named by their format (see ``rawvideo.with_video_format``), of any
size; a partition reads only the bytes of its frames.  Paths may be local, mounted, or of any store that pyarrow's file systems know;
the writer needs a folder that all executors mount.
"""

from __future__ import annotations

import math
import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from vireo.sources.rawvideo import CHROMA

SCHEMA = "path string, frame long, width int, height int, bits int, chroma string, space string, fps double, luma binary, u binary, v binary"
#: Bytes of frames that a partition reads, about, and of a batch of rows.
PARTITION, BATCH = 64 << 20, 8 << 20


@dataclass(frozen=True)
class Format:
    """How a file's frames are laid out."""

    width: int = 1920
    height: int = 1080
    bits: int = 8
    chroma: str = "420"
    space: str = "709"
    fps: float = 24.0

    @property
    def planes(self) -> tuple[int, int]:
        """Bytes of the luma plane and of each chroma plane."""
        across, down = CHROMA[self.chroma]
        each = 2 if self.bits > 8 else 1
        return self.width * self.height * each, (self.width // across) * (self.height // down) * each

    @property
    def frame(self) -> int:
        luma, chroma = self.planes
        return luma + 2 * chroma


def format_of(path: str) -> Format:
    """From the parts of a file's name between underscores; the last part that speaks of a property counts."""
    held: dict = {}
    for part in re.sub(r"[.][^.]*$", "", path.rsplit("/", 1)[-1]).split("_"):
        if m := re.match(r"(\d+)x(\d+)(?:p(\d+))?", part):
            held |= {"width": int(m[1]), "height": int(m[2])} | ({"fps": float(m[3])} if m[3] else {})
        elif m := re.fullmatch(r"([0-9.]+)fps", part):
            held["fps"] = float(m[1])
        elif m := re.fullmatch(r"(8|10)(?:b|bit)?", part):
            held["bits"] = int(m[1])
        elif part in CHROMA:
            held["chroma"] = part
        elif part in ("2020", "ct2020", "pq2020", "hdr", "709", "bt709", "sdr"):
            held["space"] = "709" if part in ("709", "bt709", "sdr") else "2020"
    return Format(**held)


def name_of(base: str, form: Format) -> str:
    """A file's name that says its format; the frame rate has three decimals at most, none where it is whole."""
    fps = f"{form.fps:.3f}".rstrip("0").rstrip(".")
    return f"{base}_{form.width}x{form.height}_{form.bits}b_{form.chroma}_{form.space}_{fps}fps.yuv"


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def listed(path: str) -> list[tuple[str, int]]:
    """Paths and sizes of the .yuv files of a folder or of a path with * in its name; names and sizes alone are read."""
    folder, pattern = (path.rsplit("/", 1) if "*" in path else (path, None))
    system, at = _opened(folder)
    info = system.get_file_info(at)
    if info.type == pafs.FileType.File:
        return [(path, info.size)]
    fits = re.compile(".*".join(map(re.escape, pattern.split("*"))) if pattern else r".*[.]yuv")
    found = [f for f in system.get_file_info(pafs.FileSelector(at)) if f.type == pafs.FileType.File and fits.fullmatch(f.base_name)]
    return sorted((f"{folder.rstrip('/')}/{f.base_name}", f.size) for f in found)


@dataclass
class Frames(InputPartition):
    """Frames first, first + 1, ... of a file, up to ``end`` (excluded)."""

    path: str
    first: int
    end: int


class RawReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.strict = options["path"], options.get("strict", "false").lower() == "true"
        self.partition = int(options.get("partitionbytes", PARTITION))
        self.low, self.high, self.paths = 0, math.inf, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Ranges of ``frame`` and values of ``path`` are met exactly by the plan of partitions; the others are left to Spark."""
        for f in filters:
            match f:
                case EqualTo(("frame",), int(n)):
                    self.low, self.high = max(self.low, n), min(self.high, n)
                case GreaterThan(("frame",), int(n)):
                    self.low = max(self.low, n + 1)
                case GreaterThanOrEqual(("frame",), int(n)):
                    self.low = max(self.low, n)
                case LessThan(("frame",), int(n)):
                    self.high = min(self.high, n - 1)
                case LessThanOrEqual(("frame",), int(n)):
                    self.high = min(self.high, n)
                case EqualTo(("path",), str(p)):
                    self.paths = {p} & (self.paths or {p})
                case In(("path",), values):
                    self.paths = set(values) & (self.paths or set(values))
                case _:
                    yield f

    def partitions(self) -> list[Frames]:
        out = []
        for path, size in listed(self.path):
            if self.paths is not None and path not in self.paths:
                continue
            each = format_of(path).frame
            if self.strict and size % each:
                raise ValueError(f"{path} ends within a frame")
            end, step = min(size // each, self.high + 1), max(1, self.partition // each)
            out += [Frames(path, at, int(min(at + step, end))) for at in range(self.low, int(end), step)]
        return out

    def read(self, partition: Frames | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # what Spark plans where there are no partitions
            return
        form = format_of(partition.path)
        luma, chroma = form.planes
        system, at = _opened(partition.path)
        step = max(1, BATCH // form.frame)
        with system.open_input_file(at) as file:
            for first in range(partition.first, partition.end, step):
                numbers = list(range(first, min(first + step, partition.end)))
                data = file.read_at(len(numbers) * form.frame, first * form.frame)
                if len(data) < len(numbers) * form.frame:
                    raise EOFError(f"{partition.path} ends within frames {numbers[0]} to {numbers[-1]}")
                cut = [data[k * form.frame : (k + 1) * form.frame] for k in range(len(numbers))]
                planes = [[c[:luma] for c in cut], [c[luma : luma + chroma] for c in cut], [c[luma + chroma :] for c in cut]]
                fixed = [pa.array([v] * len(numbers), t) for v, t in ((form.width, pa.int32()), (form.height, pa.int32()), (form.bits, pa.int32()), (form.chroma, pa.string()), (form.space, pa.string()), (form.fps, pa.float64()))]
                yield pa.RecordBatch.from_arrays([pa.array([partition.path] * len(numbers)), pa.array(numbers, pa.int64()), *fixed, *(pa.array(p, pa.binary()) for p in planes)], [f.split()[0] for f in SCHEMA.split(", ")])


@dataclass
class Written(WriterCommitMessage):
    """Files that a task has put frames in, with how many, and the end of the last."""

    files: dict[str, tuple[int, int]]


class RawWriter(DataSourceWriter):
    """Each task puts its frames at their places in a file beside the final one; commit gives files their names, abort removes them.

    A task that runs again writes the same bytes at the same places.  A file with a gap isn't committed.
    """

    def __init__(self, options: dict, overwrite: bool):
        self.folder, self.overwrite, self.mark = _mounted(options["path"]), overwrite, f".writing-{uuid.uuid4().hex}"
        os.makedirs(self.folder, exist_ok=True)

    def write(self, rows: Iterator) -> Written:
        """Rows of SCHEMA; only the last part of a path counts, as the file's name."""
        files: dict[str, tuple[int, int]] = {}
        name, file = None, None
        try:
            for r in rows:
                own = r.path.rsplit("/", 1)[-1]
                form = format_of(own)
                frame = bytes(r.luma) + bytes(r.u) + bytes(r.v)
                if len(frame) != form.frame:
                    raise ValueError(f"a frame of {own} must have {form.frame} bytes, not {len(frame)}")
                if own != name:
                    if file is not None:
                        os.close(file)
                    name, file = own, os.open(os.path.join(self.folder, own + self.mark), os.O_WRONLY | os.O_CREAT, 0o644)
                written, at = 0, r.frame * form.frame
                while written < len(frame):
                    written += os.pwrite(file, frame[written:], at + written)
                n, end = files.get(own, (0, 0))
                files[own] = n + 1, max(end, r.frame + 1)
        finally:
            if file is not None:
                os.close(file)
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        files: dict[str, tuple[int, int]] = {}
        for m in messages:
            for name, (n, end) in (m.files if m else {}).items():
                before = files.get(name, (0, 0))
                files[name] = before[0] + n, max(before[1], end)
        gaps = [name for name, (n, end) in files.items() if n != end]
        there = [name for name in files if not self.overwrite and os.path.exists(os.path.join(self.folder, name))]
        if gaps or there:
            self.abort(messages)
            raise ValueError(f"frames are missing or there twice in {', '.join(sorted(gaps))}" if gaps else f"{', '.join(sorted(there))} exists")
        for name in files:
            os.replace(os.path.join(self.folder, name + self.mark), os.path.join(self.folder, name))

    def abort(self, messages: list[Written | None]) -> None:
        for name in os.listdir(self.folder):
            if name.endswith(self.mark):
                os.remove(os.path.join(self.folder, name))


def _mounted(path: str) -> str:
    url = urlparse(path)
    if url.scheme not in ("", "file"):
        raise ValueError(f"{path} isn't in a folder that executors mount")
    return unquote(url.path) if url.scheme else path


class RawVideo(DataSource):
    @classmethod
    def name(cls) -> str:
        return "rawvideo"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RawReader:
        return RawReader(self.options)

    def writer(self, schema, overwrite: bool) -> RawWriter:
        return RawWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RawVideo)


def read_video(spark: SparkSession, path: str, **options) -> DataFrame:
    """Rows of SCHEMA, one a frame: those of a file, of the .yuv files of a folder, or of a path with * in its name.

    A file's trailing part of a frame is left out, or with ``strict`` an error.
    """
    register(spark)
    return spark.read.format("rawvideo").options(**options).load(path)


def write_video(frames: DataFrame, folder: str, overwrite: bool = False) -> None:
    """Frames as files named by their paths' last parts, whose parts say the format (``name_of``); frames are numbered from 0 without gaps.

    Tasks write anywhere in a file, so a long clip is many tasks' work; rows are dealt by clip and blocks of frames.
    """
    register(frames.sparkSession)
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    rows = frames.selectExpr(*(n if n in frames.columns else f"CAST(NULL AS {dict(f.split() for f in SCHEMA.split(', '))[n]}) AS {n}" for n in names)).selectExpr("*", "frame DIV 64 AS _block")
    rows = rows.repartition("path", "_block").sortWithinPartitions("path", "frame").drop("_block")
    rows.write.format("rawvideo").mode("overwrite" if overwrite else "append").save(folder)
