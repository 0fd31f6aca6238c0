"""Queries over frame sequences and condition tables: temporal filters, resampling, look-ups, pairing, splits, names, streams."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vireo.functions import expressions as E
from vireo.functions.lookup import interp, interp_uniform, stand_in
from vireo.operators import linear as L
from vireo.operators.numbering import ranked
from vireo.plans import pixel_queries as P
from vireo.sources import signals
from vireo.streaming import frames as stream

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
num = E.num


def _sql(name: str, sql: str, *tables: str, oracle: str | None = None) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        signals.views(spark, sf_dir, *tables)
        return spark.sql(sql)

    QUERIES[name] = query
    ORACLES[name] = oracle or sql


def _taps_table(channel: str) -> str:
    return "(VALUES " + ", ".join(f"({k}, {w!r}{'' if 'e' in repr(w) else 'e0'})" for k, w in enumerate(L.temporal_taps(30, channel))) + ") AS h(tap, w)"


_taps = " UNION ALL ".join(f"SELECT '{c}' AS channel, {k} AS tap, round({num(w)}, 6) AS w" for c in L.SIGMA for k, w in enumerate(L.temporal_taps(30, c)))
_sql("temporal_taps", _taps)
# Frame before the first: the first again, or the clip back and forth.
_SEQUENCE = f"seq AS (SELECT *, max(frame) OVER (PARTITION BY user_id) + 1 AS n FROM ({signals.FRAMES}) AS s)"
_PADDING = {
    "replicate": "greatest(a.frame - h.tap, 0)",
    "symmetric": "(CASE WHEN a.n = 1 THEN 0 ELSE least(abs(a.frame - h.tap) % (2 * a.n - 2 + CAST(a.n = 1 AS INT)), (2 * a.n - 2) - abs(a.frame - h.tap) % (2 * a.n - 2 + CAST(a.n = 1 AS INT))) END)",
}


def _fir(channel: str, pad: str):
    """A filter as lags over a window of frames: one sort, no join.  Frames before the first come from the other end of the window."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        signals.views(spark, sf_dir, "events")
        over = "OVER (PARTITION BY user_id ORDER BY frame)"
        whole = "OVER (PARTITION BY user_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
        taps = L.temporal_taps(30, channel)
        # the clip back and forth: its first frames, a filter's length of them at most, by index
        back = lambda k: f"element_at(head, CAST({_BACK.format(at=f'(frame - {k})')} AS INT) + 1)"
        early = {"replicate": lambda k: f"first_value(v) {over}", "symmetric": back}[pad]
        v = " + ".join(f"{num(w)} * coalesce(lag(v, {k}) {over}, {early(k)})" for k, w in enumerate(taps))
        rows = f"SELECT user_id, frame, v, count(*) OVER (PARTITION BY user_id) AS n FROM ({signals.FRAMES}) AS s"
        if pad == "symmetric":
            rows = f"SELECT *, transform(array_sort(collect_list(CASE WHEN frame < {len(taps)} THEN struct(frame, v) END) {whole}), s -> s.v) AS head FROM ({rows}) AS c"
        return spark.sql(f"SELECT user_id, CAST(frame AS INT) AS frame, round({v}, 4) AS v FROM ({rows}) AS s")

    return query


#: Place of a frame before the first when the clip runs back and forth.
_BACK = "(CASE WHEN n = 1 THEN 0 ELSE least(abs{at} % greatest(2 * n - 2, 1), (2 * n - 2) - abs{at} % greatest(2 * n - 2, 1)) END)"
for _name, _channel, _pad in (("temporal_fir_replicate", "Ysust", "replicate"), ("temporal_fir_symmetric", "Ysust", "symmetric"), ("temporal_fir_rg", "RG", "replicate"), ("temporal_transient", "Ytrans", "replicate")):
    QUERIES[_name] = _fir(_channel, _pad)
    ORACLES[_name] = f"WITH {_SEQUENCE} SELECT a.user_id, CAST(a.frame AS INT) AS frame, round(sum(b.v * h.w), 4) AS v FROM seq a CROSS JOIN {_taps_table(_channel)} JOIN seq b ON b.user_id = a.user_id AND b.frame = {_PADDING[_pad]} GROUP BY a.user_id, a.frame"
temporal_fir_window = _fir("Ysust", "replicate")
QUERIES["temporal_fir_window"], ORACLES["temporal_fir_window"] = temporal_fir_window, ORACLES["temporal_fir_replicate"]
_sql("frame_range_filter", f"WITH {_SEQUENCE} SELECT user_id, CAST(frame AS INT) AS frame, v FROM seq WHERE frame BETWEEN 2 AND 20 AND (frame - 2) % 3 = 0", "events")
_sql("frame_limit", f"WITH {_SEQUENCE} SELECT user_id, count(*) AS frames, round(avg(v), 6) AS mean FROM seq WHERE frame < 10 GROUP BY user_id", "events")
_sql("frame_rolling_mean", f"WITH {_SEQUENCE} SELECT user_id, CAST(frame AS INT) AS frame, round(avg(v) OVER (PARTITION BY user_id ORDER BY frame ROWS BETWEEN 8 PRECEDING AND CURRENT ROW), 6) AS m FROM seq", "events")


# Look-ups.
_K, _VALS = [0.0, 0.1, 0.35, 0.7], [0.2, 1.0, 0.4, 2.0]
P._scalar("interp1", y=interp("t", _K, _VALS))
P._scalar("interp1_held", y=interp("t", _K, _VALS, False))
P._scalar("interp_uniform", y=interp_uniform("q", 0.1, 0.2, [0.3, 1.1, 0.7, 1.9]))
_corner = lambda i, j, k: num(np.sin(i + 2 * j + 3 * k))
P._scalar("interp3", y="(" + " + ".join(f"{_corner(i, j, k)} * {('t' if i else '(1e0 - t)')} * {('r' if j else '(1e0 - r)')} * {('q' if k else '(1e0 - q)')}" for i in (0, 1) for j in (0, 1) for k in (0, 1)) + ")")
_csf, _log_l = stand_in(), "log10(greatest(q * 200e0, 1e-3))"
P._scalar("csf_sensitivity", **{f"s{c}_{k}": _csf.sql(_log_l, rho, c) for c in range(4) for k, rho in enumerate((0.1, 3.0, 37.7))})
P._scalar("bucketize", b="CAST(" + " + ".join(f"CAST(t > {num(k)} AS INT)" for k in _K) + " AS INT)")

# Pairing, splits and condition tables.
_sql("pair_broadcast", "SELECT n_name, r_name FROM nation CROSS JOIN region WHERE r_regionkey = 0", "nation", "region")
_sql("metric_cross", "SELECT n_nationkey, m.metric FROM nation CROSS JOIN (VALUES ('psnr'), ('score')) AS m(metric)", "nation")
_sql("display_per_row", "SELECT s_suppkey, n_name AS display FROM supplier JOIN nation ON s_nationkey = n_nationkey", "supplier", "nation")
_sql("split_semi", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')", "orders", "customer")
# Done are the conditions that have an urgent order; the test split are the rows that aren't in the training split, nor twice in the table.
_sql("resume_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')", "customer", "orders")
_SPLIT = "o_custkey, o_orderpriority, o_orderstatus"
_sql("split_diff", f"SELECT {_SPLIT} FROM (SELECT {_SPLIT} FROM orders UNION ALL SELECT {_SPLIT} FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING')) AS u GROUP BY {_SPLIT} HAVING count(*) = 1", "orders", "customer")
_sql("split_counts", "SELECT o_orderpriority, count(DISTINCT o_custkey) AS keys, count(*) AS n FROM orders GROUP BY o_orderpriority", "orders")
_sql("best_epoch", "SELECT o_orderpriority, o_orderkey FROM (SELECT o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) AS r WHERE k = 1", "orders")
_rank = lambda v: f"(SELECT v, sum(n) OVER (ORDER BY v) - n + (n + 1) / 2e0 AS rank FROM (SELECT {v} AS v, count(*) AS n FROM lineitem GROUP BY {v}) AS c)"
_ranks = f"SELECT l_discount * 10e0 AS a, l_quantity / 50e0 AS b, x.rank AS ra, y.rank AS rb FROM lineitem JOIN {_rank('l_discount')} AS x ON l_discount = x.v JOIN {_rank('l_quantity')} AS y ON l_quantity = y.v"
_AGREE = ["round(sqrt(avg(pow(a - b, 2e0))), 8) AS rmse", "round(avg(pow(a - b, 2e0)), 8) AS mse", "round(corr(a, b), 8) AS pearson", "round(corr(ra, rb), 8) AS spearman"]


def calib_rmse_pearson_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of two scores; ranks are found by ranges of values."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("l_discount * 10e0 AS a", "l_quantity / 50e0 AS b")
    return ranked(ranked(rows, "a", "ra"), "b", "rb").selectExpr(*_AGREE)


QUERIES["calib_rmse_pearson_spearman"] = calib_rmse_pearson_spearman
ORACLES["calib_rmse_pearson_spearman"] = f"SELECT {', '.join(_AGREE)} FROM ({_ranks}) AS r"
_wide = "SELECT o_orderpriority AS test, round(avg(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END), 4) AS f, round(avg(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END), 4) AS o FROM orders GROUP BY o_orderpriority"


def result_csv_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("test", F.col("o_orderpriority"))
    wide = orders.groupBy("test").pivot("o_orderstatus", ["F", "O"]).agg(F.round(F.avg("o_totalprice"), 4))
    return wide.toDF("test", "f", "o")


QUERIES["result_csv_pivot"], ORACLES["result_csv_pivot"] = result_csv_pivot, _wide
_sql("result_stdout", "SELECT p_partkey, format_string('%s=%.4f [%s]', p_brand, p_retailprice, 'score') AS line FROM part", "part", oracle="SELECT p_partkey, printf('%s=%.4f [%s]', p_brand, p_retailprice, 'score') AS line FROM part")

_sql("condition_id", "SELECT p_partkey, replace(regexp_replace(concat('set/', p_brand, '/', CAST(p_partkey AS VARCHAR(20)), '.mp4'), '[.][a-z0-9]+$', ''), '/', '_') AS id FROM part", "part")
_sql("feature_json", "SELECT o_custkey, get_json_object(j, '$.t0_b1') AS t0_b1, get_json_object(j, '$.n') AS n FROM (SELECT o_custkey, to_json(named_struct('t0_b1', CAST(count(*) AS STRING), 'n', CAST(max(o_orderkey) AS STRING))) AS j FROM orders GROUP BY o_custkey) AS f", "orders", oracle="SELECT o_custkey, CAST(count(*) AS VARCHAR) AS t0_b1, CAST(max(o_orderkey) AS VARCHAR) AS n FROM orders GROUP BY o_custkey")
_sql("feature_band_resample", f"SELECT l_tax AS b, round({interp('(log2(greatest(l_tax * 100e0, 1e-3)))', [-1.0, 1.0, 2.0, 6.0], [0.1, 0.5, 0.9, 0.2])}, 6) AS f FROM lineitem", "lineitem")

QUERIES |= {"stream_fir_state": stream.fir_query, "stream_tumbling": stream.tumbling_query}
ORACLES |= {
    "stream_fir_state": ORACLES["temporal_fir_replicate"],
    "stream_tumbling": "SELECT event_type, date_trunc('day', ts) AS day, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
}
