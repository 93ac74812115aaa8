"""Rates of soft memberships: totals are met, also by the copies, or the miss is reported."""

import numpy as np
import pytest

from clientele.llm import mixing


def members_of(spark, p, tokens):
    return spark.createDataFrame([(i, int(t), [float(v) for v in q]) for i, (t, q) in enumerate(zip(tokens, p))],
                                 "doc_id long, n_tokens long, p array<double>").coalesce(2).cache()


def totals(members, column):
    rows = members.withColumn("r", column).collect()
    return sum(r["r"] * r["n_tokens"] * np.array(r["p"]) for r in rows)


def test_soft_memberships_meet_the_target(spark):
    members = members_of(spark, [[0.6, 0.4], [0.4, 0.6]], [1000, 1000])
    rate = mixing.fit_rates(members, ["x", "y"], {"x": 0.55, "y": 0.45}, total=2000)
    assert np.allclose(totals(members, rate), [1100, 900], rtol=1e-3)


def test_copies_meet_the_target(spark):
    """Many rows have a fitted rate from 0.5 to 1, which are kept once."""
    rng = np.random.default_rng(5)
    p, tokens = rng.dirichlet([1.0] * 3, 6000), rng.integers(1, 300, 6000)
    members = members_of(spark, p, tokens)
    found = mixing.solve(members, ["x", "y", "z"], {"x": 0.5, "y": 0.3, "z": 0.2}, total=float(tokens.sum()), keep_from=0.5)
    want = tokens.sum() * np.array([0.5, 0.3, 0.2])
    assert max(abs(m) for m in found.miss.values()) < 2e-3
    assert np.allclose(totals(members, found.rate), want, rtol=2e-3)
    assert np.allclose(totals(members, mixing.copies(found.rate)), want, rtol=0.03)
    assert members.where((found.rate >= 0.5) & (found.rate < 1)).count() == 0


def test_a_target_out_of_reach_is_reported(spark):
    """No rates give 90 % of x: all that can be done is to drop the second row."""
    members = members_of(spark, [[0.6, 0.4], [0.4, 0.6]], [1000, 1000])
    with pytest.warns(UserWarning, match="cannot be met"):
        found = mixing.solve(members, ["x", "y"], {"x": 0.9, "y": 0.1}, total=2000)
    rate = 1 / (0.6 ** 2 + 0.4 ** 2) * (0.6 * 1800 + 0.4 * 200) / 1000
    assert np.allclose(found.reached, [600 * rate, 400 * rate], rtol=1e-3)
