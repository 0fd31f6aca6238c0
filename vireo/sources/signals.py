"""Signal views: the tables read as aligned test and reference signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: One pixel a row: test, reference and a third plane.
PIXELS = "SELECT l_discount * 10e0 AS t, l_tax * 12.5e0 AS r, l_quantity / 50e0 AS q FROM lineitem"
QUALITY = "SELECT l_returnflag AS pair, l_linestatus AS vch, CAST(year(l_shipdate) AS INT) AS frame, CAST(month(l_shipdate) AS INT) AS band, abs(l_discount * 10e0 - l_tax * 12.5e0) AS d FROM lineitem"
#: Frames by user: the place of an event in the user's sequence, and its value.
FRAMES = "SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, value AS v FROM events"
#: 8 x 8 planes; the test image of a pair is the vector, the reference the next one.
PLANES = "SELECT vec_id, {h} AS h, {w} AS w, transform(slice(embedding, 1, {n}), e -> least(greatest(5e-1 + CAST(e AS DOUBLE), 0e0), 1e0)) AS v FROM embeddings WHERE size(embedding) >= {n}"


def images_sql(h: int = 8, w: int = 8) -> str:
    """The same as DuckDB SQL, one row a sample."""
    return f"SELECT vec_id, CAST(i // {w} AS INTEGER) AS y, CAST(i % {w} AS INTEGER) AS x, least(greatest(5e-1 + CAST(embedding[i + 1] AS DOUBLE), 0e0), 1e0) AS v FROM embeddings, range({h * w}) AS g(i) WHERE len(embedding) >= {h * w}"


IMAGES_DUCKDB = images_sql()


def views(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for name in names:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def images(spark: SparkSession, sf_dir: str, h: int = 8, w: int = 8) -> DataFrame:
    """vec_id, h, w and the plane v of h x w samples from the vectors; no shuffle."""
    views(spark, sf_dir, "embeddings")
    return spark.sql(PLANES.format(h=h, w=w, n=h * w))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir, "lineitem")
    return spark.sql(PIXELS)
