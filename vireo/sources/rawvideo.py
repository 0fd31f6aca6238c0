"""File sources: raw planar video, numbered image sequences, condition tables with settings ahead of the header."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FORMAT = "width int, height int, bits int, chroma string, space string, fps double"


def with_video_format(files: DataFrame, path: str = "path") -> DataFrame:
    """files with width, height, bits, chroma, space and fps read from the parts of the file's name between underscores.

    Parts that say nothing of a property leave it at 1920 x 1080, 8 bits, 420, 709 and 24 frames a second; the last part that
    speaks of a property counts.  A null path gives the defaults.
    """
    base = F.coalesce(F.regexp_replace(F.regexp_extract(path, "([^/]*)$", 1), "[.][^.]*$", ""), F.lit(""))
    parts = F.split(base, "_")
    last = lambda *options: F.get(F.reverse(F.filter(parts, lambda p: p.rlike("|".join(options)))), 0)
    number = lambda text, pattern: F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).cast("double")
    size, rate = last("^[0-9]+x[0-9]+"), last("^[0-9]+x[0-9]+p[0-9]+", "^[0-9.]+fps$")
    fps = F.coalesce(number(rate, "^([0-9.]+)fps$"), number(rate, "^[0-9]+x[0-9]+p([0-9]+)"))
    space = last("^(2020|ct2020|pq2020|hdr|709|bt709|sdr)$")
    columns = {
        "width": F.coalesce(number(size, "^([0-9]+)x"), F.lit(1920.0)).cast("int"),
        "height": F.coalesce(number(size, "^[0-9]+x([0-9]+)"), F.lit(1080.0)).cast("int"),
        "bits": F.coalesce(number(last("^(8|10)(b|bit)?$"), "^([0-9]+)"), F.lit(8.0)).cast("int"),
        "chroma": F.coalesce(last("^(444|422|420)$"), F.lit("420")),
        "space": F.when(space.isin("2020", "ct2020", "pq2020", "hdr"), F.lit("2020")).otherwise(F.lit("709")),
        "fps": F.coalesce(fps, F.lit(24.0)),
    }
    return files.withColumns(columns)


def video_name(base: str = "base") -> Column:
    """A file's name that says its format, from columns base, width, height, bits, chroma, space and fps: the rate has three decimals at
    most, none where it is whole."""
    fps = F.regexp_replace(F.regexp_replace(F.format_string("%.3f", "fps"), "[.]0+$", ""), "([.][0-9]*[1-9])0+$", "$1")
    return F.concat(base, F.format_string("_%dx%d_%db_%s_%s_", "width", "height", "bits", "chroma", "space"), fps, F.lit("fps.yuv"))


def probed(spark: SparkSession, path: str, pattern: str = "*.yuv") -> DataFrame:
    """path, frames, width, height, bits, chroma, space, fps and cut (whether a file ends within a frame) from files' names and sizes alone."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "length")
    sized = with_video_format(files).withColumn("_n", F.expr(frame_bytes()))
    return sized.select("path", F.expr("length DIV _n").alias("frames"), "width", "height", "bits", "chroma", "space", "fps", (F.col("length") % F.col("_n") > 0).alias("cut"))


#: Divisors of the chroma planes' width and height.
CHROMA = {"444": (1, 1), "422": (2, 1), "420": (2, 2)}


def frame_bytes() -> str:
    return "CAST((width * height + 2 * (width DIV CASE chroma WHEN '444' THEN 1 ELSE 2 END) * (height DIV CASE chroma WHEN '420' THEN 2 ELSE 1 END)) * CASE WHEN bits > 8 THEN 2 ELSE 1 END AS BIGINT)"


def read_raw_video(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """path, frame, bits, chroma, space, fps and planes ``luma``, ``u``, ``v`` as binary, one row a frame.

    A file's trailing part of a frame is left out, or with ``strict`` an error.  Files are read whole by Spark's binary source, so the reader suits clips of
    up to its 2 GB; the planes are cut out in the JVM.
    """
    files = with_video_format(spark.read.format("binaryFile").load(path).select("path", "length", "content"))
    files = files.withColumn("_n", F.expr(frame_bytes())).withColumn("_wide", F.expr("CASE WHEN bits > 8 THEN 2 ELSE 1 END"))
    files = files.withColumn("_y", F.expr("width * height * _wide")).withColumn("_c", F.expr("CAST((_n - _y) DIV 2 AS INT)"))
    if strict:
        files = files.where(F.assert_true(F.expr("length % _n = 0"), F.lit("a file ends within a frame")).isNull())
    frames = files.where("length >= _n").selectExpr("*", "explode(sequence(0, CAST(length DIV _n AS INT) - 1)) AS frame")
    at = "CAST(frame * _n AS INT)"
    return frames.selectExpr("path", "frame", "width", "height", "bits", "chroma", "space", "fps", f"substring(content, {at} + 1, _y) AS luma", f"substring(content, {at} + _y + 1, _c) AS u", f"substring(content, {at} + _y + _c + 1, _c) AS v")


def plane_samples(frames: DataFrame, plane: str = "luma") -> DataFrame:
    """path, frame, y, x, code: the samples of a plane as integers; 16-bit samples are little-endian."""
    across, down = ("1", "1") if plane == "luma" else ("CASE chroma WHEN '444' THEN 1 ELSE 2 END", "CASE chroma WHEN '420' THEN 2 ELSE 1 END")
    sized = frames.selectExpr("path", "frame", f"width DIV {across} AS w", f"height DIV {down} AS h", "CASE WHEN bits > 8 THEN 2 ELSE 1 END AS bytes", f"`{plane}` AS plane")
    each = sized.selectExpr("path", "frame", "w", "bytes", "plane", "explode(sequence(0, CAST(h * w AS INT) - 1)) AS i")
    low, high = (f"conv(hex(substring(plane, i * bytes + {k}, 1)), 16, 10)" for k in (1, 2))
    return each.selectExpr("path", "frame", "CAST(i DIV w AS INT) AS y", "CAST(i % w AS INT) AS x", f"CAST({low} AS INT) + CASE bytes WHEN 2 THEN 256 * CAST({high} AS INT) ELSE 0 END AS code")


def write_raw_video(frames: DataFrame, folder: str) -> None:
    """Frames as Parquet rows (path, frame, content): Spark has no sink of bare bytes, and a clip need not fit a row.

    frames: path, frame, luma, u, v.  Within a file rows are in order of clip and frame, so files can be joined as they are.
    """
    rows = frames.select("path", "frame", F.concat("luma", "u", "v").alias("content"))
    rows.repartitionByRange("path", "frame").sortWithinPartitions("path", "frame").write.parquet(folder)


def sequence_frames(names: DataFrame, pattern: str, name: str = "name", start: int = 0, step: int = 1, last: int | None = None) -> DataFrame:
    """name, frame of the files that a C pattern such as ``img_%04d.png`` matches: start, start + step, ... up to the first gap.

    Names beyond the gap and others are left out; a name that is there twice counts once; without the first frame there are none.
    """
    m = re.search(r"%(0?)(\d*)d", pattern)
    digits = int(m[2] or 1)
    before, after = re.escape(pattern[: m.start()]), re.escape(pattern[m.end() :])
    body = f"[0-9]{{{digits},}}" if m[1] else "[0-9]+"
    found = names.select(F.col(name).alias("name"), F.regexp_extract(name, f"^{before}({body}){after}$", 1).alias("_d")).where("_d <> ''")
    numbered = found.withColumn("frame", F.col("_d").cast("int")).where(f"frame >= {start} AND (frame - {start}) % {step} = 0" + ("" if last is None else f" AND frame <= {last}")).select("name", "frame").distinct()
    # The first gap: the least frame that is there while its successor isn't.
    there = numbered.select(F.col("frame").alias("_f"))
    ends = numbered.join(there, F.col("frame") + step == F.col("_f"), "left_anti").agg(F.min("frame").alias("_end"))
    begins = numbered.where(F.col("frame") == start).agg(F.count(F.lit(1)).alias("_has"))
    return numbered.crossJoin(F.broadcast(ends)).crossJoin(F.broadcast(begins)).where("_has > 0 AND frame <= _end").select("name", "frame")


def read_condition_table(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows of a file of comma-separated values, or of a folder of its parts in order of their names, and the settings (key, value)
    that stand ahead of its header.

    Blank lines and lines that start with # count for nothing.  The first other line without a colon is the header; lines
    before it are ``key: value`` settings, with - in keys turned to _, and all lines after it are rows.  Everything is read in tasks.
    """
    # tasks take parts by size, so a line's place is by its part first, then by where its split begins
    at = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id().alias("line"))
    lines = spark.read.text(path).select(at.alias("at"), "value").where(~F.col("value").rlike("^[ \\t]*(#|$)"))
    header = lines.where(~F.col("value").contains(":")).agg(F.min("at").alias("header"))
    placed = lines.crossJoin(F.broadcast(header))  # one row
    key, value = (F.regexp_extract("value", "^[ \\t]*([^:]*?)[ \\t]*:[ \\t]*(.*?)[ \\t]*$", k) for k in (1, 2))
    settings = placed.where("header IS NULL OR at < header").select(F.replace(key, F.lit("-"), F.lit("_")).alias("key"), value.alias("value"))
    return placed.where("at > header").select(F.from_csv("value", schema).alias("r")).select("r.*"), settings
