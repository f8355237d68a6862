"""The non-negative risk, its gradient and the class prior against plain computations."""

import math

import numpy as np
import pytest

from weftline.llm import quality


def plain_risk(w, pos, unl, prior):
    loss = lambda z: math.log1p(math.exp(-z))
    g = lambda x: sum(a * b for a, b in zip(x, w)) + w[-1]
    first = prior * sum(loss(g(x)) for x in pos) / len(pos)
    rest = sum(loss(-g(x)) for x in unl) / len(unl) - prior * sum(loss(-g(x)) for x in pos) / len(pos)
    return first, rest


@pytest.mark.parametrize("shift", [0.0, -3.0, 3.0])
def test_risk_and_direction(shift):
    rng = np.random.default_rng(3)
    pos, unl = rng.normal(1, 1, (13, 4)), rng.normal(shift, 1, (17, 4))
    w = np.append(rng.normal(0, 1, 4), 0.3)
    first, rest = plain_risk(w, pos, unl, 0.7)
    risk, direction = quality.pu_risk(w, pos, unl, 0.7)
    assert risk == pytest.approx(first + max(0.0, rest))
    goal = (lambda x: sum(plain_risk(x, pos, unl, 0.7))) if rest >= 0 else (lambda x: -plain_risk(x, pos, unl, 0.7)[1])
    for k in range(5):
        step = np.eye(5)[k] * 1e-6
        assert direction[k] == pytest.approx((goal(w + step) - goal(w - step)) / 2e-6, abs=1e-5)


def test_both_signs_of_the_second_term_occur():
    x = np.ones((3, 1))
    assert plain_risk(np.array([2.0, 0.0]), x, -x, 0.7)[1] < 0 < plain_risk(np.array([2.0, 0.0]), x, x, 0.7)[1]
    risk, direction = quality.pu_risk(np.array([2.0, 0.0]), x, -x, 0.7)
    assert risk == pytest.approx(0.7 * math.log1p(math.exp(-2.0))) and direction[0] > 0


@pytest.mark.parametrize("share", [0.2, 0.5, 0.9])
def test_prior_is_estimated(share):
    rng = np.random.default_rng(5)
    good = lambda n: rng.normal(1.5, 1, (n, 6)).astype(np.float32)
    n = int(4000 * share)
    mixed = np.concatenate([good(n), rng.normal(-1.5, 1, (4000 - n, 6)).astype(np.float32)])
    assert abs(quality.class_prior(good(2000), rng.permutation(mixed)) - share) < 0.08


def test_prior_of_too_few_rows():
    one = np.ones((1, 3), np.float32)
    assert quality.class_prior(one, one) == 0.5
    assert 0.02 <= quality.class_prior(np.repeat(one, 2, 0), np.repeat(one, 2, 0)) <= 0.98
