"""The mixing fit ends after few steps where targets cannot be met."""

import numpy as np
import pytest

from tabwright.llm import mixing
from test_learnt import coordinate_descent, members_of, rates_of


def test_few_steps_to_an_optimum_off_the_targets(spark):
    rng = np.random.default_rng(2)
    posteriors = rng.dirichlet([0.05, 0.05, 1], 400)
    tokens = rng.integers(1, 500, len(posteriors))
    members, floor = members_of(spark, posteriors, tokens), mixing.least_rate(True)
    fit = mixing.fit_rates(members, mixing.TARGETS, 1.1, floor)
    rate = rates_of(members, fit, floor)
    floors = (posteriors.argmax(axis=1) == 0) * 1.0
    assert (rate >= floors).all() and fit.gap > 0.01 and len(fit.steps) < 200
    assert (rate * tokens) @ posteriors == pytest.approx(fit.totals, rel=1e-9)
    wanted = fit.wanted / tokens.sum()
    _, objective = coordinate_descent(posteriors, tokens, wanted, floors)
    miss = fit.totals / fit.wanted - 1
    assert 0.5 * miss @ miss == pytest.approx(objective, rel=1e-4)
