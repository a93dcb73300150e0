"""Exact permutation tests by halves against all splits."""

import itertools
import math

import numpy as np
import pytest

from auditspark.columns import DEFAULT
from auditspark.operators import stat_tests

SCHEMA = f"`{DEFAULT.model}` string, `{DEFAULT.cohort}` string, uplift double"


def _units(spark, values, n_second):
    rows = [(f"m{i:02d}", "closed" if i < n_second else "open", float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, SCHEMA)


def test_equal_to_every_split_at_twenty_units(spark):
    values = np.random.default_rng(3).normal(size=20)
    got = stat_tests.exact_split_test(_units(spark, values, 8)).first()
    picks = np.array(list(itertools.combinations(range(20), 8)))
    s = values[picks].sum(axis=1)
    diff = s / 8 - (values.sum() - s) / 12
    observed = values[:8].mean() - values[8:].mean()
    assert got["n_permutations"] == len(diff) == math.comb(20, 8)
    assert got["observed_diff"] == pytest.approx(observed)
    assert got["p_value"] == (np.abs(diff) >= abs(observed) - 1e-12).mean()
    assert (got["null_low"], got["null_high"]) == pytest.approx(tuple(np.quantile(diff, [0.025, 0.975])), abs=1e-9)


def test_ties_and_equal_values(spark):
    got = stat_tests.exact_split_test(_units(spark, [1.0] * 7, 3)).first()
    assert (got["n_permutations"], got["p_value"]) == (35, 1.0)
    assert got["null_low"] == pytest.approx(0, abs=1e-9)
    got = stat_tests.exact_split_test(_units(spark, [1.0, 1.0, 0.0, 0.0, 0.0], 2)).first()
    assert got["p_value"] == pytest.approx(0.1)  # one of ten splits is as far out


def test_forty_units_are_exact(spark):
    """Values 0..39: the number of splits by sum is known from a recurrence on integers."""
    ways = [[0] * 781 for _ in range(21)]
    ways[0][0] = 1
    for v in range(40):
        for k in range(19, -1, -1):
            for s in range(780 - v, -1, -1):
                if ways[k][s]:
                    ways[k + 1][s + v] += ways[k][s]
    values = [float((7 * i) % 40) for i in range(40)]
    got = stat_tests.exact_split_test(_units(spark, values, 20)).first()
    s2 = int(sum(values[:20]))
    extreme = sum(w for s, w in enumerate(ways[20]) if abs(2 * s - 780) >= abs(2 * s2 - 780))
    assert got["n_permutations"] == sum(ways[20]) == math.comb(40, 20)
    assert got["p_value"] == pytest.approx(extreme / math.comb(40, 20), rel=1e-12)


def test_refusals(spark):
    with pytest.raises(ValueError, match="both cohorts"):
        stat_tests.exact_split_test(_units(spark, [1.0, 2.0], 0))
    with pytest.raises(ValueError, match="at most 4"):
        stat_tests.exact_split_test(_units(spark, range(5), 2), max_units=4)
