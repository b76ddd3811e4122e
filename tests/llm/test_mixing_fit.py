"""The rates of the mixture against a solution found row by row, and the targets they reach."""

import warnings

import numpy as np
import pytest

from gridlake.llm import mixing

DOMAINS = ["a", "b", "c"]


def soft_rows(spark, n=200, seed=3):
    r = np.random.default_rng(seed)
    p = r.dirichlet([0.4, 0.3, 0.2], n)
    tokens = r.integers(0, 400, n)
    rows = [(i, int(t), [float(x) for x in q]) for i, (t, q) in enumerate(zip(tokens, p))]
    return p, tokens.astype(float), spark.createDataFrame(rows, "doc_id long, __tokens long, __p array<double>").repartition(3).cache()


def rates(p, fit):
    return np.maximum(0, 1 + p @ fit.pull)


def test_rates_equal_a_solution_found_row_by_row(spark, monkeypatch):
    monkeypatch.setattr(mixing, "GIVE", 0.05)
    p, t, rows = soft_rows(spark)
    fit = mixing.fit_rates(rows, DOMAINS, {"a": 0.7, "b": 0.3, "c": 0.0}, "a", 0.05, 40)
    have = t @ p
    goal = np.array([0.7, 0.3, 0.0]) * 1.05 * have[0] / 0.7
    give = 0.05 * have
    x, got = np.ones(len(t)), have.copy()
    for _ in range(800):
        for i in np.flatnonzero(t):
            # Best rate of one row while the others stand.
            slope = (x[i] - 1) + p[i] @ ((got - goal) / give)
            new = max(0.0, x[i] - slope / (1 + t[i] * (p[i] * p[i] / give).sum()))
            got += t[i] * (new - x[i]) * p[i]
            x[i] = new
    assert fit.settled and fit.passes <= 12
    assert np.abs(rates(p, fit) - x)[t > 0].max() < 1e-3
    assert np.abs(fit.got - got).max() < 1e-3 * t.sum()


@pytest.mark.parametrize("targets", [{"a": 0.6, "b": 0.3, "c": 0.1}, {"a": 0.8, "b": 0.15, "c": 0.05}, {"a": 0.2, "b": 0.2, "c": 0.6}])
def test_targets_within_reach_are_met(spark, targets):
    p, t, rows = soft_rows(spark, 500, 5)
    with warnings.catch_warnings():
        warnings.simplefilter("error", UserWarning)
        fit = mixing.fit_rates(rows, DOMAINS, targets, "a", 0.05, 40)
    got = (t * rates(p, fit)) @ p
    for d, x in zip(DOMAINS, got / got.sum()):
        assert x == pytest.approx(targets[d], rel=0.01)
    assert np.allclose(got, fit.got) and all(abs(x) < 0.01 for x in fit.residual().values())


def test_missing_domains_and_missing_rows(spark):
    rows = spark.createDataFrame([(1, 10, [1.0, 0.0, 0.0]), (2, 0, [0.2, 0.4, 0.4])], "doc_id long, __tokens long, __p array<double>")
    fit = mixing.fit_rates(rows, DOMAINS, {"a": 0.5, "b": 0.5}, "a", 0.05, 40)
    assert fit.pull[1] == fit.pull[2] == 0 and rates(np.array([[1.0, 0, 0]]), fit)[0] == pytest.approx(1.05, rel=1e-3)
    assert mixing.fit_rates(rows.limit(0), DOMAINS, {"a": 1.0}, "a", 0.05, 40).pull.tolist() == [0, 0, 0]
