"""The fit against a plain one in numpy, and its derivatives against differences."""

from dataclasses import replace

import numpy as np
import pytest

from vireo.operators import calibration as C
from vireo.operators import visibility as V
from vireo.operators.numbering import ranked


def plain_score(q, p):
    """Score of one condition (frames, channels, bands) by the definition."""
    w = np.array([1, p.chromatic, p.chromatic, p.transient])[: q.shape[1]]
    u = q * w[:, None]
    u[:, :, -1] *= np.array([p.base0, p.base1, p.base2, p.base3])[: q.shape[1]]
    over = lambda x, axis: V.safe_pow(V.safe_pow(x, 4).sum(axis), 0.25)
    t = over(over(u, 2), 1)
    held = t[0] * V.IMAGE if len(t) == 1 else V.safe_pow(V.safe_pow(t, 2).mean(), 0.5)
    a, e = p.jod_a, p.jod_exp
    return 10 - (a * 0.1 ** (e - 1) * held if held <= 0.1 else a * held**e)


def fixture(seed=3, n=40):
    rng = np.random.default_rng(seed)
    held = {k: rng.gamma(1.0, 1.0 + k % 7, (1 if k % 5 == 0 else rng.integers(2, 9), 3 if k % 5 == 0 else 4, 5)) for k in range(n)}
    held[1] *= 1e-3  # below the curve's knee
    truth = C.Parameters(1.4, 0.5, 0.02, 2.5, 3.0, 12.0, 0.06, 0.8)
    return held, {k: plain_score(q, truth) + rng.normal(0, 0.02) for k, q in held.items()}


def tables(spark, held, jod):
    rows = [(k, f, x.tolist()) for k, q in held.items() for f, x in enumerate(q)]
    return spark.createDataFrame(rows, "id long, frame int, channels array<array<double>>").repartition(3), spark.createDataFrame([(k, float(v)) for k, v in jod.items()] + [(999, 5.0), (0, None)], "id long, jod double")


def test_scores_and_derivatives(spark):
    held, jod = fixture()
    features, quality = tables(spark, held, jod)
    p = C.Parameters()
    got = {r.id: r.score for r in C.scores(features, p).collect()}
    assert all(got[k] == pytest.approx(plain_score(q, p), abs=1e-9) for k, q in held.items()) and len(got) == len(held)
    n, sse, matrix, right = C.equations(features, quality, p)
    keys, base = [k for k in held], p.array()
    e = np.array([jod[k] - plain_score(held[k], p) for k in keys])
    j = np.zeros((len(keys), len(base)))
    for m in range(len(base)):
        h = 1e-6 * max(1.0, base[m])
        moved = [replace(p, **{C.NAMES[m]: base[m] + s}) for s in (h, -h)]
        j[:, m] = [(plain_score(held[k], moved[0]) - plain_score(held[k], moved[1])) / (2 * h) for k in keys]
    assert n == len(keys) and sse == pytest.approx((e**2).sum()) and np.allclose(matrix, j.T @ j, rtol=1e-4, atol=1e-6) and np.allclose(right, j.T @ e, rtol=1e-4, atol=1e-6)


def plain_fit(held, jod, steps):
    """The same damped steps with derivatives by differences."""
    p, keys, damping = C.Parameters(), list(held), 1e-3
    error = lambda p: np.array([jod[k] - plain_score(held[k], p) for k in keys])
    errors = [(error(p) ** 2).mean()]
    for _ in range(steps):
        base, e = p.array(), error(p)
        j = np.stack([(error(replace(p, **{n: base[m] * (1 - 1e-4)})) - error(replace(p, **{n: base[m] * (1 + 1e-4)}))) / (2e-4 * base[m]) for m, n in enumerate(C.NAMES)], 1)
        j = j * base  # by logarithms
        a = j.T @ j
        own, step = np.diag(a) > 1e-12 * np.diag(a).max(), np.zeros(len(base))
        step[own] = np.linalg.solve((a + damping * np.diag(np.diag(a)))[np.ix_(own, own)], (j.T @ e)[own])
        moved = replace(p, **dict(zip(C.NAMES, (base * np.exp(np.clip(step, -np.log(4), np.log(4)))).tolist())))
        after = (error(moved) ** 2).mean()
        if after < errors[-1]:
            p, damping = moved, damping / 10
            errors.append(after)
        else:
            damping *= 10
    return p, errors


def test_fit_as_plain(spark):
    held, jod = fixture()
    features, quality = tables(spark, held, jod)
    p, errors = C.fit(features.cache(), quality, steps=10)
    _, want = plain_fit(held, jod, 10)
    assert len(errors) > 3 and all(a > b for a, b in zip(errors, errors[1:])) and errors[-1] < errors[0] / 10
    assert np.allclose(errors[: len(want)], want[: len(errors)], rtol=1e-3, atol=1e-6)
    some, _ = C.fit(features, quality, free=("jod_a", "jod_exp"), steps=3)
    assert some.chromatic == C.Parameters().chromatic and some.jod_a != C.Parameters().jod_a
    got = C.agreement(features, quality, p).first()
    assert got.conditions == len(held) - 1 + 1 and got.rmse == pytest.approx(errors[-1] ** 0.5) and got.spearman > 0.9
    assert set(__import__("json").loads(p.json())) == {"ch_chrom_w", "ch_trans_w", "baseband_weight", "jod_a", "jod_exp"}
    with pytest.raises(ValueError):
        C.fit(features, quality.where("id = 999"))


def test_ranks(spark):
    values = [3.0, 1.0, 3.0, None, 2.0, 3.0, -1.0, 2.0]
    got = {(r.i, r.k) for r in ranked(spark.createDataFrame(list(enumerate(values)), "i int, v double"), "v", "k").collect()}
    assert got == {(6, 1.0), (1, 2.0), (4, 3.5), (7, 3.5), (0, 6.0), (2, 6.0), (5, 6.0)}
