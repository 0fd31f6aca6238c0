"""Streams of frames: a temporal filter with carried state, and event-time windows.

The filter keeps the last frames of each sequence as state and must give the same values however the stream is cut.  Its state is
bounded: by the filter's length, and by the frames that may wait for one that hasn't come.
"""

from __future__ import annotations

import re
import tempfile
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vireo.operators.linear import temporal_taps
from vireo.sources import signals


def _folder(spark: SparkSession) -> str:
    """A new folder in the one that the cluster shares; a temporary one only where none is set and all runs in one process (tests)."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="spark-vireo-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return f"{shared.rstrip('/')}/stream-{uuid.uuid4().hex}"


#: Frames of a sequence that may wait for one before them.
WAITING = 4096


def fir(frames: DataFrame, taps: list[float], waiting: int = WAITING) -> DataFrame:
    """(user_id, frame, v) rows, streamed in any cut, to filtered frames; the first frame repeats before the clip.

    Frames that arrive before their predecessors wait in the state.  Once more than ``waiting`` of them do, the frames missing before
    the first that waits count as lost: they come out with a null, the filter takes the frame before them again, and those
    that waited follow.  A frame that comes again or after it was lost is left out.  (Time limits by the clock would keep a stream that
    is run until its input ends from ending.)
    """

    def step(key, batches, state):
        following, past, numbers, values = state.get if state.exists else (0, [], [], [])
        held, past, out = dict(zip(numbers, values)), list(past), []
        for b in batches:
            held.update((f, v) for f, v in zip(b.frame.tolist(), b.v.tolist()) if f >= following)

        def on(v: float) -> None:
            past[:] = [v] * len(taps) if not past else [*past[1:], v]

        while held and (following in held or len(held) > waiting):
            if following in held:
                on(held.pop(following))
                out.append((key[0], following, sum(w * x for w, x in zip(taps, reversed(past)))))
                following += 1
                continue
            first = min(held)
            out.extend((key[0], f, None) for f in range(following, first))
            for _ in range(min(first - following, len(taps)) if past else 0):
                on(past[-1])
            following = first
        state.update((following, past, list(held), list(held.values())))
        yield pd.DataFrame(out, columns=["user_id", "frame", "v"]).astype({"v": float})

    return frames.groupBy("user_id").applyInPandasWithState(step, "user_id long, frame long, v double", "following long, past array<double>, numbers array<long>, values array<double>", "append", "NoTimeout")


def _run(stream: DataFrame, mode: str = "append") -> DataFrame:
    spark, at = stream.sparkSession, _folder(stream.sparkSession)
    stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/log").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


def fir_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sustained filter over users' frames, read as a stream of files."""
    signals.views(spark, sf_dir, "events")
    at = _folder(spark)
    frames = spark.sql(f"SELECT user_id, CAST(frame AS BIGINT) AS frame, v FROM ({signals.FRAMES}) AS s")
    frames.repartition(4, "frame").write.parquet(f"{at}/in")
    stream = spark.readStream.schema(frames.schema).option("maxFilesPerTrigger", 2).parquet(f"{at}/in")
    return _run(fir(stream, temporal_taps(30, "Ysust"))).select("user_id", F.col("frame").cast("int").alias("frame"), F.round("v", 4).alias("v"))


def tumbling_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts and sums by type in event time, late data up to two days; a closing row moves the watermark to the end."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    at = _folder(spark)
    events.write.parquet(f"{at}/in/part=0")
    last = events.agg(F.max("ts").alias("ts")).select((F.col("ts") + F.expr("INTERVAL 30 DAYS")).alias("ts"), F.lit(None).cast("string").alias("event_type"), F.lit(0.0).alias("value"))
    last.write.parquet(f"{at}/in/part=1")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1000).parquet(f"{at}/in/part=*")
    daily = stream.withWatermark("ts", "2 days").groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    out = _run(daily.select("event_type", F.col("w.start").alias("day"), "n", "total"))
    return out.where("event_type IS NOT NULL").select("event_type", F.col("day").cast("timestamp_ntz").alias("day"), "n", F.round("total", 4).alias("total"))
