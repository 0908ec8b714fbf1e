"""What the classifiers learn, against direct computations."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from aftershock.llm import toxicity, url_boost
from aftershock.llm.url_boost import BINS, FEATURES


def risks(weights, bias, x, confirmed, prior):
    """The positive and the negative part of the non-negative risk with a sigmoid loss."""
    chance = 1 / (1 + np.exp(-(x @ weights + bias)))
    negative = chance[~confirmed].mean() - prior * chance[confirmed].mean()
    return prior * (1 - chance[confirmed]).mean(), negative


def reference_fit(x, confirmed, prior, rounds):
    """Adam on gradients taken by differences."""
    theta = np.zeros(x.shape[1] + 1)
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):

        def goal(t):
            positive, negative = risks(t[:-1], t[-1], x, confirmed, prior)
            return positive + negative if overfit else -negative

        overfit = risks(theta[:-1], theta[-1], x, confirmed, prior)[1] >= 0
        gradient = np.array([(goal(theta + e) - goal(theta - e)) / 2e-5 for e in np.eye(len(theta)) * 1e-5])
        gradient[:-1] += 1e-6 * theta[:-1]
        mean, square = 0.9 * mean + 0.1 * gradient, 0.99 * square + 0.01 * gradient**2
        theta = theta - 0.05 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-7)
        theta[:-1] = np.maximum(theta[:-1], 0.0)
    return theta[:-1], theta[-1]


@pytest.mark.parametrize(("seed", "prior"), [(1, 0.1), (2, 0.4), (3, 0.9)])
def test_fit_follows_the_gradient_of_the_risk(seed, prior):
    rng = np.random.default_rng(seed)
    confirmed = np.arange(60) < 20
    x = (rng.random((60, 7)) < np.where(confirmed[:, None], 0.5, 0.2)).astype(float)
    rows, columns = np.nonzero(x)
    for rounds in (1, 10, 60):
        weights, bias = toxicity.fit(rows, columns, confirmed, 7, prior, rounds)
        want, want_bias = reference_fit(x, confirmed, prior, rounds)
        assert np.allclose(weights, want, atol=2e-3) and abs(bias - want_bias) < 2e-3


def reference_trees(rows, rounds, depth, rate, ridge=1.0):
    """Rows (bins, n, ones): boosted trees by trying every split of every node."""
    total, ones = sum(n for _, n, _ in rows), sum(o for *_, o in rows)
    margins = [math.log((ones + 1) / (total - ones + 1))] * len(rows)
    for _ in range(rounds):
        graded = []
        for (bins, n, own), m in zip(rows, margins):
            p = 1 / (1 + math.exp(-m))
            graded.append((bins, round((own - p * n) * url_boost.SCALE) / url_boost.SCALE, round(p * (1 - p) * n * url_boost.SCALE) / url_boost.SCALE))

        def grow(members, level):
            g, h = sum(graded[i][1] for i in members), sum(graded[i][2] for i in members)
            best, gain = None, 1e-3
            for f in range(len(FEATURES)):
                values = sorted({graded[i][0][f] for i in members})
                for below in values[1:]:
                    left = [i for i in members if graded[i][0][f] < below]
                    lg, lh = sum(graded[i][1] for i in left), sum(graded[i][2] for i in left)
                    won = lg**2 / (lh + ridge) + (g - lg) ** 2 / (h - lh + ridge) - g**2 / (h + ridge)
                    if won > gain + 1e-9:
                        best, gain = (f, below), won
            if level == depth or best is None:
                return {i: rate * g / (h + ridge) for i in members}
            parts = [[], []]
            for i in members:
                parts[graded[i][0][best[0]] >= best[1]].append(i)
            return grow(parts[0], level + 1) | grow(parts[1], level + 1)

        gained = grow(list(range(len(rows))), 0)
        margins = [m + gained[i] for i, m in enumerate(margins)]
    return margins


@pytest.mark.parametrize(("seed", "rounds", "depth"), [(1, 1, 1), (2, 3, 2), (3, 5, 3)])
def test_trees_take_the_best_splits(spark, seed, rounds, depth):
    rng = random.Random(seed)
    rows = {}
    for _ in range(80):
        bins = tuple(rng.randrange(0, BINS, 7) if f % 2 else rng.randrange(4) for f in range(len(FEATURES)))
        n = rng.randrange(1, 9)
        p = 0.9 if bins[0] + bins[1] / 7 > 4 else 0.2
        rows[bins] = (n, sum(rng.random() < p for _ in range(n)))
    rows = [(b, n, o) for b, (n, o) in rows.items()]
    schema = ", ".join([*(f"{f} int" for f in FEATURES), "n long", "ones long"])
    labelled = spark.createDataFrame([(*b, n, o) for b, n, o in rows], schema)
    trees = url_boost.train(labelled, rounds=rounds, depth=depth, rate=0.4)
    got = {tuple(r[:-1]): r[-1] for r in labelled.select(*FEATURES, trees.margin().alias("margin")).collect()}
    for (bins, *_), want in zip(rows, reference_trees(rows, rounds, depth, 0.4)):
        assert abs(got[bins] - want) < 1e-6
