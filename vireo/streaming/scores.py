"""The score of a stream of pairs: the p-norm over frames as a sum and a count for each clip, which Spark keeps and merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vireo.functions import expressions as E
from vireo.operators import visibility as V
from vireo.streaming.frames import _folder


def running_scores(pairs: DataFrame, columns: list[str], clip: list[str], folder: str, model: V.Model = V.Model()) -> None:
    """Scores of clips after each micro-batch of a stream of frame pairs (clip, h, w, ``columns``: filtered planes), as Parquet, a folder a
    batch; a batch that runs again replaces its own.  State is two numbers a clip."""
    sums = V.frame_values(pairs, columns, clip, model).groupBy(*clip).agg(F.count(F.lit(1)).alias("frames"), F.expr(f"sum({E.safe_pow('q', 2)})").alias("s"))
    q = sums.select(*clip, "frames", F.expr(E.safe_pow("(s / frames)", 0.5)).alias("q"))

    def batch(df: DataFrame, number: int) -> None:
        df.withColumn("score", F.expr(E.jod("q"))).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    q.writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", f"{folder}-log").trigger(availableNow=True).start().awaitTermination()


def latest(spark: SparkSession, folder: str, clip: list[str]) -> DataFrame:
    """The last score of each clip."""
    held = spark.read.parquet(folder)
    return held.groupBy(*clip).agg(F.max_by(F.struct("frames", "q", "score"), "batch").alias("s")).select(*clip, "s.*")


def scores_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips whose frames come as a stream of files, a third of the files at a time; a clip's frames lie in three files."""
    from vireo.plans import video_queries as Q

    at = _folder(spark)
    held = Q.planes(spark, sf_dir)
    # each task that filtered clips writes them, so files grow in number, not in size
    held.withColumn("turn", F.col("frame") % 3).write.partitionBy("turn").parquet(f"{at}/in")
    files = len(spark.read.schema(held.schema).parquet(f"{at}/in").inputFiles())
    stream = spark.readStream.schema(held.schema).option("maxFilesPerTrigger", max(1, -(-files // 3))).parquet(f"{at}/in/turn=*")
    running_scores(stream, Q.PLANES, ["clip"], f"{at}/out")
    return latest(spark, f"{at}/out", ["clip"]).select("clip", "frames", F.round("q", 4).alias("q"), F.round("score", 4).alias("score"))
