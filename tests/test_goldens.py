"""Weight tables, parameters and constants pinned by literal values, since queries and their SQL take them from the same place."""

import math

import numpy as np
import pytest

from vireo.functions import displays as D
from vireo.functions import expressions as E
from vireo.operators import calibration as C
from vireo.operators import linear as L
from vireo.operators import metrics as M
from vireo.operators import visibility as V


def table(weights):
    return {(o, i): round(w, 6) for o, i, w in weights}


def test_weight_tables():
    assert table(L.reduce_weights(4)) == {(0, 0): 0.65, (0, 1): 0.3, (0, 2): 0.05, (1, 0): 0.05, (1, 1): 0.25, (1, 2): 0.4, (1, 3): 0.3}
    assert table(L.reduce_weights(3)) == {(0, 0): 0.65, (0, 1): 0.3, (0, 2): 0.05, (1, 0): 0.05, (1, 1): 0.3, (1, 2): 0.65}
    assert table(L.expand_weights(2, 4)) == {(0, 0): 0.9, (0, 1): 0.1, (1, 0): 0.5, (1, 1): 0.5, (2, 0): 0.1, (2, 1): 0.9, (3, 1): 1.0}
    assert table(L.bilinear_weights(2, 4)) == {(0, 0): 1.0, (1, 0): 0.75, (1, 1): 0.25, (2, 0): 0.25, (2, 1): 0.75, (3, 1): 1.0}
    blur = dict(((o, i), w) for o, i, w in L.gaussian_weights(21, 3, 13))
    assert [round(blur[10, 10 + k], 6) for k in range(7)] == [0.137023, 0.129618, 0.109719, 0.083109, 0.056332, 0.034167, 0.018544]
    narrow = dict(((o, i), w) for o, i, w in L.gaussian_weights(21, 1.5, 11))
    assert [round(narrow[10, 10 + k], 6) for k in range(6)] == [0.266012, 0.213006, 0.109361, 0.036001, 0.007599, 0.001028]
    assert [L.reflected(-k, 3) for k in range(1, 10)] == [1, 2, 1, 0, 1, 2, 1, 0, 1] and [L.reflected(-k, 5) for k in range(1, 12)] == [1, 2, 3, 4, 3, 2, 1, 0, 1, 2, 3]


def test_parameters():
    assert (V.MASK_P, V.MASK_C, V.PHASE, V.TEXTURE, V.IMAGE) == (2.264355182647705, -0.7954971194267273, 3, 8, 0.577918291091919)
    assert V.MASK_Q == (1.302622675895691, 2.8885908126831055, 3.6807713508605957, 3.588787317276001)
    assert V.BASEBAND == (0.0036334486212581396, 1.6627724170684814, 4.11874532699585, 25.25969886779785)
    assert V.CHANNEL_WEIGHT == (1.0, 1.0, 1.0, 0.8081134557723999) and V.GAIN == (1.0, 1.45, 1.0, 1.0) and V.ADDED_GAIN == (1.0, 1.7, 0.237, 1.0)
    assert (E.JOD_A, E.JOD_EXP, E.JOD_KNEE, E.D_MAX, E.EPSILON) == (0.0439569391310215, 0.9302042722702026, 0.1, 2.5642454624176025, 1e-5)
    assert np.array(V.CROSS).shape == (4, 4) and (V.CROSS[0][0], V.CROSS[1][0], V.CROSS[3][3]) == (-0.18950104713439941, 2.5655593872070312, -2.08804988861084)
    assert C.Parameters().array().tolist() == [1.0, V.CHANNEL_WEIGHT[3], *V.BASEBAND, E.JOD_A, E.JOD_EXP]
    assert L.SIGMA == {"Ysust": 5.79336, "RG": 14.1255, "YV": 6.63661, "Ytrans": 0.12314} and L.BETA == {"Ysust": 1.3314, "RG": 1.1196, "YV": 0.947901, "Ytrans": 0.1898}


def test_taps_of_all_channels():
    first = {"Ysust": [0.046771, 0.064189, 0.107367, 0.174809, 0.213727], "RG": [0.015257, 0.024257, 0.034, 0.16903, 0.514909], "YV": [0.029911, 0.039636, 0.057371, 0.171251, 0.403663], "Ytrans": [-0.101657, -0.110338, -0.150023, 0.031386, 0.661264]}
    for channel, values in first.items():
        assert np.allclose(L.temporal_taps(30, channel)[:5], values, atol=1e-6)


def test_light_and_codes(spark):
    d = D.Display()
    assert d.light(np.zeros((1, 1, 1, 1))).item() == pytest.approx(0.5978874, abs=1e-7) and d.light(np.ones((1, 1, 1, 1))).item() == pytest.approx(200 + 250 / math.pi * 0.005)
    assert M.pu(np.array(100.0)) == pytest.approx(256.3838973) and M.pu(np.array(10000.0)) == pytest.approx(595.39392)
    ppd = {r.display: r.ppd for r in D.display_table(spark).selectExpr("display", f"{D.GEOMETRY['ppd']} AS ppd").collect()}
    assert ppd["standard_4k"] == pytest.approx(75.4024493) and ppd["standard_fhd"] == pytest.approx(37.8425039) and len(ppd) == 22
    hlg = D.Display(eotf="HLG", peak=1000, contrast=1e6, ambient=10)
    assert hlg.light(np.full((1, 3, 1, 1), 0.5))[0, 0, 0, 0] == pytest.approx(1000 * (1 / 12) ** 1.2, rel=1e-3)
    pq = D.Display(eotf="PQ", peak=10000, contrast=1e9, ambient=0)
    assert pq.light(np.full((1, 1, 1, 1), 0.508078421517399)).item() == pytest.approx(100, rel=1e-6)
    named = D.preset_rows()
    phone = next(r for r in named if r[0] == "standard_phone")
    tablet = next(r for r in named if r[0] == "ipad_pro_12_9")
    assert phone[1:4] == (2400, 1080, 0.4) and phone[11] == pytest.approx(500 / 0.05) and tablet[3] == pytest.approx(20 * 0.0254)


def test_bands_and_identity():
    assert np.allclose(V.band_frequencies(2160, 3840, 75.4024493), [37.7012, 12.17, 6.085, 3.0425, 1.5212, 0.7606, 0.3803, 0.1902, 0.1], atol=1e-3)
    x = np.random.default_rng(1).random((1, 3, 32, 40)) * 50 + 10
    assert next(V.Model().pooled(np.concatenate([x, x], 1)))[1].max() == pytest.approx(0, abs=1e-12)
