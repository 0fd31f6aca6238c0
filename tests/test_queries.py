"""Every query of the engine against its SQL in DuckDB, on the smallest tables."""

import duckdb
import numpy as np
import pytest

from vireo.operators import visibility as V
from vireo.plans import catalog, library_queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events embeddings".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_against_sql(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), duck.execute(catalog.ORACLES[name]).df()
    assert sorted(got) == sorted(want)
    columns = sorted(got)
    got, want = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got, want))
    assert len(got) == len(want)
    for c in columns:
        if got[c].dtype.kind == "f":
            assert np.allclose(got[c].astype(float), want[c].astype(float), rtol=0, atol=2e-4, equal_nan=True), c
        else:
            assert (got[c].astype(str) == want[c].astype(str)).all(), c


def test_queries_without_sql(spark):
    assert set(catalog.QUERIES) - set(catalog.ORACLES) == {"calibration_fit", "tiled_score"}
    fitted = catalog.QUERIES["calibration_fit"](spark, SF).collect()
    assert len(fitted) == 8 and all(r.rmse_after < r.rmse_before for r in fitted)
    tiled = {r.vec_id: r.q for r in catalog.QUERIES["tiled_score"](spark, SF).collect()}
    whole = library_queries.wide_pairs(spark, SF)
    want = {r.vec_id: r.q for r in V.frame_values(whole, ["t", "r"], ["vec_id"]).collect()}
    assert tiled.keys() == want.keys() and all(abs(tiled[k] - want[k]) < 1e-4 for k in want)
