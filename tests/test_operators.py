"""Properties of filters and scalar functions."""

import math

import numpy as np
import pytest

from vireo.functions import expressions as E
from vireo.operators import linear as L


def dense(weights, n, size):
    m = np.zeros((size, n))
    for o, i, w in weights:
        m[o, i] = w
    return m


@pytest.mark.parametrize("n", range(3, 40))
def test_constant_stays_constant(n):
    assert np.allclose(dense(L.reduce_weights(n), n, -(-n // 2)).sum(1), 1)
    half = -(-n // 2)
    assert np.allclose(dense(L.expand_weights(half, n), half, n).sum(1), 1)
    assert np.allclose(dense(L.gaussian_weights(n, 3, 13), n, n).sum(1), 1)
    assert np.allclose(dense(L.bilinear_weights(n, 7), n, 7).sum(1), 1)


def test_taps():
    for channel, first, total in (("Ysust", [0.046771, 0.064189, 0.107367, 0.174809, 0.213727], 1), ("RG", [0.015257, 0.024257, 0.034, 0.16903, 0.514909], 1), ("Ytrans", [-0.101657, -0.110338, -0.150023, 0.031386, 0.661264], 0)):
        taps = L.temporal_taps(30, channel)
        assert np.allclose(taps[:5], first, atol=1e-6) and math.isclose(sum(taps), total, abs_tol=1e-5)
    assert [len(L.temporal_taps(f, "RG")) for f in (24, 30, 60)] == [7, 9, 17]


def test_round_trips_and_identity(spark):
    row = spark.sql(f"SELECT {E.pq_decode(E.pq_encode('1e2'))} AS pq, {E.pu_decode(E.pu_encode('1e2'))} AS pu, {E.pu_encode('1e2')} AS v, {E.linear_to_srgb(E.srgb_to_linear('3e-1'))} AS s, {E.jod('0e0')} AS same, {E.safe_pow('0e0', 2)} AS zero, {E.geometry(3840, 2160, 0.7472, 30)['ppd']} AS ppd").first()
    assert math.isclose(row.pq, 100, rel_tol=1e-9) and math.isclose(row.pu, 100, rel_tol=1e-9) and math.isclose(row.s, 0.3, rel_tol=1e-9)
    assert row.same == 10 and row.zero == 0 and math.isclose(row.v, 256.3838973, rel_tol=1e-8) and math.isclose(row.ppd, 75.4024493, rel_tol=1e-8)


def test_stream_cut_does_not_matter(spark, tmp_path):
    from vireo.streaming import frames as S

    rows = [(u, f, float((f * 7 + u) % 11)) for u in (1, 2) for f in range(20)]
    df, taps, out = spark.createDataFrame(rows, "user_id long, frame long, v double"), L.temporal_taps(30, "Ysust"), []
    for n in (1, 5):
        at = f"file://{tmp_path}/in{n}"
        df.repartition(n, "frame").write.parquet(at)
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(at)
        out.append(sorted(map(tuple, S._run(S.fir(stream, taps)).collect())))
    assert len(out[0]) == 40 and np.allclose(out[0], out[1])
    assert math.isclose(dict(((u, f), v) for u, f, v in out[0])[1, 0], rows[0][2], abs_tol=1e-9)


def test_lost_frames_in_a_stream(spark, tmp_path):
    """A frame that never comes: those after it wait, up to a bound, then it counts as lost; what comes again is left out."""
    from vireo.streaming import frames as S

    taps = L.temporal_taps(30, "Ysust")
    for n, rows in enumerate([[(1, 0, 1.0), (1, 1, 2.0), (2, 0, 5.0)], [(1, f, float(f)) for f in range(3, 8)] + [(1, 1, 9.0)], [(1, f, float(f)) for f in range(8, 12)], [(1, 2, 7.0), (2, 1, 6.0)]]):
        spark.createDataFrame(rows, "user_id long, frame long, v double").coalesce(1).write.parquet(f"file://{tmp_path}/in/{n}")
        stream = spark.readStream.schema("user_id long, frame long, v double").option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in/*")
        query = S.fir(stream, taps, waiting=6).writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/log").trigger(availableNow=True).start()
        query.awaitTermination()
    got = {(r.user_id, r.frame): r.v for r in spark.read.parquet(f"file://{tmp_path}/out").collect()}
    assert set(got) == {(1, f) for f in range(12)} | {(2, 0), (2, 1)} and got[1, 2] is None
    clip = [1.0, 2.0, 2.0, *map(float, range(3, 12))]  # the lost frame is the one before it
    for f in (1, 3, 7, 11):
        assert math.isclose(got[1, f], sum(w * clip[max(f - k, 0)] for k, w in enumerate(taps)), abs_tol=1e-9)


def test_jobs_that_cannot_run(spark, tmp_path):
    from vireo.streaming import jobs

    frames = spark.createDataFrame([(k, 0, 2, 2, [0.1 * k] * 4) for k in (1, 2)], "clip long, frame int, h int, w int, v0 array<double>")
    lines = ["--test 1 --reference 2 --metric psnr_rgb", "--test 1 --reference 9 --metric psnr_rgb", "--test 1 --reference 2 --metric other", "nonsense"]
    spark.createDataFrame([(x,) for x in lines], "value string").write.text(f"file://{tmp_path}/in")
    jobs.run_jobs(spark.readStream.text(f"file://{tmp_path}/in"), frames, ["v0"], f"file://{tmp_path}/out")
    got = {r.clip: (r.value, r.error) for r in spark.read.parquet(f"file://{tmp_path}/out/*").collect()}
    assert set(got) == set(lines[:3]) and math.isclose(got[lines[0]][0], 20, rel_tol=1e-9) and got[lines[0]][1] is None
    assert got[lines[1]] == (None, "no frames of both clips") and got[lines[2]] == (None, "no metric named other")
