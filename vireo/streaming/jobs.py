"""Interactive jobs: each line of a stream names a pair and a metric and is evaluated on its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vireo.operators import metrics
from vireo.sources import signals
from vireo.streaming.frames import _folder

LINE = r"--test +(\S+) +--reference +(\S+) +--metric +(\S+)"


def parsed(lines: DataFrame) -> DataFrame:
    """job (the line), test, reference, metric; lines that don't say all three are left out."""
    part = lambda k: F.regexp_extract("value", LINE, k)
    return lines.where(F.col("value").rlike(LINE)).select(F.col("value").alias("job"), part(1).alias("test"), part(2).alias("reference"), part(3).alias("metric"))


def run_jobs(lines: DataFrame, frames: DataFrame, planes: list[str], folder: str) -> None:
    """Evaluates the jobs of a stream of lines against frames (clip, frame, h, w, planes); results go to ``folder`` as Parquet, one
    folder a micro-batch, so a batch that runs again replaces its own results.

    A job (clip) has its value, or what is wrong with it as ``error``: a metric that isn't known, a clip that isn't there.  The
    frames of a batch's clips are joined once for all its metrics.
    """

    def batch(df: DataFrame, number: int) -> None:
        asked = parsed(df).distinct().persist()
        names = [r.metric for r in asked.select("metric").distinct().where(F.col("metric").isin(list(metrics.METRICS))).collect()]  # registered names, a few
        out = asked.where(~F.col("metric").isin(names)).select(F.col("job").alias("clip"), "metric", F.lit(None).cast("double").alias("value"), F.concat(F.lit("no metric named "), "metric").alias("error"))
        if names:
            known = asked.where(F.col("metric").isin(names))
            side = lambda s, key: frames.select(F.col("clip").cast("string").alias(key), "frame", "h", "w", *(F.col(p).alias(f"{s}{k}") for k, p in enumerate(planes)))
            pairs = known.select("test", "reference").distinct().join(side("t", "test"), "test").join(side("r", "reference").drop("h", "w"), ["reference", "frame"])
            made = metrics.evaluate(pairs.withColumn("clip", F.struct("test", "reference")), names).select("clip.*", "metric", "value")
            told = known.join(made, ["test", "reference", "metric"], "left")
            out = out.unionByName(told.select(F.col("job").alias("clip"), "metric", "value", F.when(F.col("value").isNull(), F.lit("no frames of both clips")).alias("error")))
        out.write.mode("overwrite").parquet(f"{folder}/batch={number}")
        asked.unpersist()

    lines.writeStream.foreachBatch(batch).option("checkpointLocation", f"{folder}-log").trigger(availableNow=True).start().awaitTermination()


def jobs_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line for each nation: its key as the test picture, the third after it as the reference."""
    from vireo.plans.source_queries import _COLOUR

    signals.views(spark, sf_dir, "nation", "embeddings")
    at = _folder(spark)
    lines = spark.sql("SELECT concat('--test ', CAST(n_nationkey AS STRING), ' --reference ', CAST(n_nationkey + 3 AS STRING), ' --metric psnr_rgb') AS value FROM nation")
    lines.unionByName(spark.createDataFrame([("nonsense",), ("--test 1 --reference 2 --metric unknown",)], "value string")).repartition(3).write.text(f"{at}/in")
    run_jobs(spark.readStream.option("maxFilesPerTrigger", 2).text(f"{at}/in"), spark.sql(_COLOUR), ["v0", "v1", "v2"], f"{at}/out")
    made = spark.read.schema("clip string, metric string, value double, error string").parquet(f"{at}/out/*").where("error IS NULL")
    part = lambda k: F.regexp_extract("clip", LINE, k).cast("long")
    return made.select(part(1).alias("test"), part(2).alias("reference"), "metric", F.round("value", 5).alias("value"))
