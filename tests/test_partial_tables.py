"""Queries against their SQL on tables that don't come out even: clips with frames missing, keys that repeat, more rows than keys."""

import duckdb
import numpy as np
import pytest

from vireo.operators import brackets, calibration
from vireo.operators import planes as P
from vireo.operators import temporal as T
from vireo.plans import catalog
from vireo.sources import pictures, rawvideo
from vireo.streaming import scores

SF = "/root/testdata/sf0.001"


def against_sql(spark, folder, name, views):
    """Rows and columns of a query and of its SQL over the tables of a folder."""
    con = duckdb.connect()
    for t in views:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    got, want = catalog.QUERIES[name](spark, str(folder)).toPandas(), con.execute(catalog.ORACLES[name]).df()
    columns = sorted(want)
    assert sorted(got) == columns and len(got) == len(want)
    got, want = (x[columns].sort_values([c for c in columns if x[c].dtype.kind != "f"] or columns).reset_index(drop=True) for x in (got, want))
    for c in columns:
        same = np.allclose(got[c].astype(float), want[c].astype(float), rtol=0, atol=2e-4, equal_nan=True) if want[c].dtype.kind == "f" else (got[c].astype(str) == want[c].astype(str)).all()
        assert same, c
    return want


@pytest.fixture(scope="module")
def cut_clips(tmp_path_factory):
    """Three clips and a half with a reference: one lacks a frame, one its first frames, the last its last four."""
    at = tmp_path_factory.mktemp("cut")
    duckdb.connect().execute(f"COPY (SELECT * FROM read_parquet('{SF}/embeddings.parquet') WHERE vec_id < 46 AND vec_id NOT IN (4, 20, 21)) TO '{at}/embeddings.parquet' (FORMAT parquet)")
    return at


@pytest.mark.parametrize("name", ["channel_dump", "temporal_dump", "video_score", "distogram_matrix", "stream_video_score"])
def test_clips_with_frames_missing(spark, cut_clips, name):
    assert len(against_sql(spark, cut_clips, name, ["embeddings"]))


def test_span_of_a_clip(spark):
    frames = spark.createDataFrame([(1, f, 1, 1, [1.0], [2.0]) for f in (0, 1, 5)] + [(2, 30, 1, 1, [1.0], [2.0])], "clip long, frame int, h int, w int, t array<double>, r array<double>")
    taps = T.L.temporal_taps(30, "Ysust")
    got = {(r.clip, r.frame): r.t0[0] for r in T.temporal_channels(frames, 30, ["t", "r"], span=40).collect()}
    assert set(got) == {(1, f) for f in range(5 + len(taps))} | {(2, f) for f in range(30, 30 + len(taps)) if f < 40}
    assert all(got[1, f] == pytest.approx(sum(w for k, w in enumerate(taps) if max(f - k, 0) in (0, 1, 5))) for f in range(5 + len(taps)))
    with pytest.raises(ValueError, match="a span has"):
        T.temporal_channels(frames, 30, ["t", "r"], span=65)
    with pytest.raises(Exception, match="missing or there twice"):
        T.temporal_channels(frames, 30, ["t", "r"], span=5).count()


def test_condition_table_in_parts(spark, tmp_path):
    """The part with the header is the smallest, so that tasks take it last."""
    (tmp_path / "part-00000.txt").write_text("display: standard_4k\ntest,jod\na,1\n")
    (tmp_path / "part-00001.txt").write_text("".join(f"b{k},2\n" for k in range(1000)))
    (tmp_path / "part-00002.txt").write_text("".join(f"c{k},3\n" for k in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        rows, settings = rawvideo.read_condition_table(spark, str(tmp_path), "test string, jod double")
        assert rows.count() == 6001 and [tuple(r) for r in settings.collect()] == [("display", "standard_4k")]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_conditions_of_odd_parts(spark, tmp_path):
    """Keys that repeat, the least one too, or are null, and sizes that are null."""
    odd = "CASE WHEN p_partkey < 3 THEN 1 WHEN p_partkey = 7 THEN NULL ELSE p_partkey END AS p_partkey, CASE WHEN p_partkey = 9 THEN NULL ELSE p_size END AS p_size"
    duckdb.connect().execute(f"COPY (SELECT * REPLACE ({odd}) FROM read_parquet('{SF}/part.parquet')) TO '{tmp_path}/part.parquet' (FORMAT parquet)")
    got = catalog.QUERIES["quality_table"](spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM read_parquet('{tmp_path}/part.parquet')")
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, con.execute(catalog.ORACLES["quality_table"]).fetchall()))


@pytest.mark.parametrize("knots,rows", [("p_partkey % 7 IN (2, 3)", None), ("false", 0)])
def test_curves_without_knots(spark, tmp_path, knots, rows):
    duckdb.connect().execute(f"COPY (SELECT * FROM read_parquet('{SF}/part.parquet') WHERE {knots}) TO '{tmp_path}/part.parquet' (FORMAT parquet)")
    duckdb.connect().execute(f"COPY (SELECT * FROM read_parquet('{SF}/orders.parquet')) TO '{tmp_path}/orders.parquet' (FORMAT parquet)")
    want = against_sql(spark, tmp_path, "interp_table", ["part", "orders"])
    assert len(want) == rows if rows is not None else 0 < len(want) < 1500


def test_all_parts_are_knots(spark, tmp_path):
    """Parts that share a place of a curve, as in larger tables, and parts of every key."""
    con = duckdb.connect()
    con.execute(f"COPY (SELECT p.* REPLACE (p_partkey + i * 21000 AS p_partkey, (p_size + i * 29) % 50 AS p_size) FROM read_parquet('{SF}/part.parquet') AS p, range(3) AS g(i)) TO '{tmp_path}/part.parquet' (FORMAT parquet)")
    con.execute(f"COPY (SELECT * FROM read_parquet('{SF}/orders.parquet')) TO '{tmp_path}/orders.parquet' (FORMAT parquet)")
    want = against_sql(spark, tmp_path, "interp_table", ["part", "orders"])
    curves = {}
    for key, size in con.execute(f"SELECT p_partkey, p_size FROM read_parquet('{tmp_path}/part.parquet')").fetchall():
        places = curves.setdefault(key % 7, {})
        places[key * 37 % 1000 * 250] = max(size, places.get(key * 37 % 1000 * 250, 0))

    def plain(curve, v):
        places = sorted(curves[curve])
        up = next((i for i, p in enumerate(places) if p >= v), len(places) - 1)
        at, before = places[up], places[max(up - 1, 0)]
        return curves[curve][before] + (v - before) * (curves[curve][at] - curves[curve][before]) / (at - before + 1e-6) if up else curves[curve][at]

    assert sum(map(len, curves.values())) == 200
    made = {k: plain(c % 7, v) for k, c, v in con.execute(f"SELECT o_orderkey, o_custkey, o_totalprice FROM read_parquet('{tmp_path}/orders.parquet')").fetchall()}
    assert len(want) == len(made) == 1500 and all(made[k] == pytest.approx(level, abs=2e-5) for k, level in zip(want["k"], want["level"]))


@pytest.mark.parametrize("knots", ["true", "p_partkey < 5"])
def test_prices_missing(spark, tmp_path, knots):
    """Prices and customers that are null, over curves of several knots, of one and of none."""
    con = duckdb.connect()
    con.execute(f"COPY (SELECT * FROM read_parquet('{SF}/part.parquet') WHERE {knots}) TO '{tmp_path}/part.parquet' (FORMAT parquet)")
    con.execute(f"COPY (SELECT * REPLACE (CASE WHEN o_orderkey % 5 > 0 THEN o_totalprice END AS o_totalprice, CASE WHEN o_orderkey % 11 > 0 THEN o_custkey END AS o_custkey) FROM read_parquet('{SF}/orders.parquet')) TO '{tmp_path}/orders.parquet' (FORMAT parquet)")
    want = against_sql(spark, tmp_path, "interp_table", ["part", "orders"])
    assert want["level"].isna().any() == (knots == "true") and want["level"].notna().any()


def test_no_row_is_left_out_by_knots(spark):
    rows = spark.createDataFrame([(1, 1, 2.5), (2, None, 2.5), (3, 2, None), (4, 3, 1.0), (5, 1, None)], "i int, c int, x double")
    knots = spark.createDataFrame([(1, 2.0, 5.0, None), (1, 2.0, 7.0, 1.0), (1, 2.0, None, 0.5), (1, 3.0, 8.0, 2.0), (1, 3.0, 9.0, 0.0), (2, 4.0, 6.0, 3.0), (None, 2.0, 4.0, 4.0), (1, None, 99.0, 99.0)], "c int, k double, a double, b double")
    got = {r.i: (r.a, r.b) for r in brackets.looked_up(rows, knots, "x", "k", ["a", "b"], ["c"]).collect()}
    assert got == {1: pytest.approx((8.0, 1.5), abs=1e-5), 2: (None, None), 3: (6.0, 3.0), 4: (None, None), 5: (None, None)}


def test_stacks_stay_small(spark):
    """However many rows a task has, a stack holds a megabyte at most, so that memory doesn't grow with the table."""
    rows = spark.range(6000, numPartitions=1).selectExpr("id", "8 AS h", "8 AS w", "array_repeat(CAST(id AS DOUBLE), 64) AS v")
    seen = P.filtered(rows, lambda x: np.full((len(x), 1, 1, 1), float(x.nbytes)), ["v"], ["n"], ["id"]).selectExpr("id", "n[0] AS n").collect()
    assert len({r.id for r in seen}) == 6000 and max(r.n for r in seen) <= 1 << 20


def test_streamed_frames_lie_in_as_many_files_as_tasks_wrote(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(scores, "_folder", lambda _: str(tmp_path))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "9")
        made = scores.scores_query(spark, SF).collect()
        assert len(list((tmp_path / "in").rglob("part-*.parquet"))) == 27 and len(list((tmp_path / "out").glob("batch=*"))) == 3
        assert len(made) == 49
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_pictures_are_listed_by_folder(spark, monkeypatch):
    """A pattern would list each file by itself."""
    read, asked = pictures.read_pictures, []
    monkeypatch.setattr(pictures, "read_pictures", lambda session, path: asked.append(path) or read(session, path))
    assert catalog.QUERIES["picture_files"](spark, SF).count() == 500 * 42
    assert len(asked) == 1 and not set("*?[{") & set(asked[0])


@pytest.mark.parametrize("kind", [0, 1, 2])
def test_one_predictor_throughout(kind):
    data = np.random.default_rng(kind).integers(0, 256, (5, 7, 2), dtype=np.uint8)
    want = np.zeros((5, 7, 2), int)
    for y in range(5):
        for x in range(7):
            before = {0: 0, 1: want[y, x - 1] if x else 0, 2: want[y - 1, x] if y else 0}[kind]
            want[y, x] = (data[y, x].astype(int) + before) % 256
    assert (pictures._unpredicted(np.full(5, kind, np.uint8), data) == want).all()


def test_scores_do_not_pass_through_the_driver(spark):
    features = spark.createDataFrame([("a", [[1.0, 2.0]] * 4), ("b", [[2.0, 1.0]] * 4)], "id string, channels array<array<double>>")
    quality = spark.createDataFrame([("a", 8.0), ("b", 7.0), ("c", 6.0)], "id string, jod double")
    joined = calibration.scored(calibration.conditions(features, calibration.Parameters()), quality)
    assert joined.count() == 2 and "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()
