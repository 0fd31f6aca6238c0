"""Two clips of unequal frame rates on one clock, paired by the stretches of time that their frames share.

A frame stands for a half-open stretch of output frames.  Both sides are cut at the same blocks of time, met by clip and block, and
each pair of frames whose stretches overlap is sent out once, with the output frames that it stands for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Output frames of a block, about; a frame of a slow clip may lie in several.
BLOCK = 64


def due(frame: Column, fps: Column, rate: Column) -> tuple[Column, Column]:
    """First output frame of a source frame, and the first after it: output frame i shows the source's floor((i + 1/2) fps / rate).

    Whole numbers that rounding just misses count.
    """
    first = lambda f: F.ceil(f * rate / fps - 0.5 - 1e-6 * rate / fps).cast("long")
    return F.greatest(first(frame), F.lit(0)), first(frame + 1)


def common_rate(test: Column, reference: Column, most: float = 166.0) -> Column:
    """The least common multiple of whole rates, if it isn't above ``most``; else ``most``."""
    a, b = test.cast("long"), reference.cast("long")
    step = lambda s: F.when(s["y"] == 0, s).otherwise(F.struct(s["y"].alias("x"), (s["x"] % F.greatest(s["y"], F.lit(1))).alias("y")))
    gcd = F.aggregate(F.sequence(F.lit(1), F.lit(40)), F.struct(a.alias("x"), b.alias("y")), lambda s, _: step(s), lambda s: s["x"])
    whole = (test % 1 == 0) & (reference % 1 == 0)
    return F.when(whole, F.least(test * reference / gcd, F.lit(most))).otherwise(F.lit(most))


def on_one_clock(test: DataFrame, reference: DataFrame, planes: list[str], by: list[str] = ["clip"], most: float = 166.0) -> DataFrame:
    """by, frame (of the common rate, from 0), rate, test_frame, reference_frame, t0.., r0..: up to the end of the shorter side.

    Sides: by, frame (from 0), fps and ``planes`` with any columns besides; fps is one number a clip.  A rate above ``most`` is an
    error; clips that one side lacks give no rows, nor do output frames for which a side's frame is missing.
    """
    lengths = lambda df, s: df.groupBy(*by).agg(F.max("fps").cast("double").alias(f"_{s}fps"), (F.max("frame") + 1).alias(f"_{s}n"))
    clips = lengths(test, "t").join(lengths(reference, "r"), by)
    ok = F.greatest("_tfps", "_rfps") <= most
    clips = clips.where(F.assert_true(ok, F.lit(f"clips of more than {most:g} frames a second can't be resampled")).isNull())
    clips = clips.withColumn("rate", common_rate(F.col("_tfps"), F.col("_rfps"), most))
    ends = [F.floor(F.col(f"_{s}n") * F.col("rate") / F.col(f"_{s}fps") + 1e-6) for s in "tr"]
    clips = clips.withColumn("_n", F.least(*ends).cast("long"))

    def side(df: DataFrame, s: str) -> DataFrame:
        own = df.select(*by, F.col("frame").alias(f"_{s}frame"), *(F.col(p).alias(f"{s}{k}") for k, p in enumerate(planes))).join(clips.select(*by, "rate", f"_{s}fps", "_n"), by)
        first, end = due(F.col(f"_{s}frame"), F.col(f"_{s}fps"), F.col("rate"))
        own = own.withColumns({f"_{s}a": first, f"_{s}b": F.least(end, F.col("_n"))}).where(f"_{s}a < _{s}b")
        blocks = F.sequence(F.expr(f"_{s}a DIV {BLOCK}"), F.expr(f"(_{s}b - 1) DIV {BLOCK}"))
        return own.withColumn("_block", F.explode(blocks)).drop("_n", f"_{s}fps", *(["rate"] if s == "r" else []))

    both = side(test, "t").join(side(reference, "r"), [*by, "_block"]).where("_ta < _rb AND _ra < _tb")
    first, last = F.greatest("_ta", "_ra", F.col("_block") * BLOCK), F.least("_tb", "_rb", (F.col("_block") + 1) * BLOCK) - 1
    met = both.withColumns({"_first": first, "_last": last}).where("_first <= _last")
    return met.select(*by, F.explode(F.sequence("_first", "_last")).alias("frame"), "rate", F.col("_tframe").alias("test_frame"), F.col("_rframe").alias("reference_frame"), *(f"{s}{k}" for s in "tr" for k in range(len(planes))))
