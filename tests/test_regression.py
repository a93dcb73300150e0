"""HC3 through design cells against a dense computation."""

import numpy as np
import pytest

from auditspark.operators import regression


def _rows(n=400, seed=5):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        soc, state, ft = f"s{rng.integers(12)}", f"t{rng.integers(5)}", "Y" if rng.random() < 0.7 else "N"
        label = bool(rng.random() < 0.4)
        pos = int(rng.integers(1, 6))
        y = 3 * label + 2 * pos + rng.normal() * (1 + 2 * label) + hash(soc) % 7
        rows.append(("m", y, label, soc, state, ft, float(np.log1p(pos))))
    rows.append(("m", 50.0, True, "alone", "t1", "Y", 1.0))  # a level met once
    rows.append(("m", None, True, "s1", "t1", "Y", 1.0))
    rows.append(("m", 4.0, True, None, "t1", None, 1.0))
    return rows


def _dense(rows):
    rows = [r for r in rows if r[1] is not None]
    y = np.array([r[1] for r in rows])
    columns = [np.ones(len(rows)), np.array([float(r[2]) for r in rows]), np.array([r[6] for r in rows])]
    for at in (3, 4, 5):
        levels = sorted({r[at] or "" for r in rows})
        columns += [np.array([float((r[at] or "") == level) for r in rows]) for level in levels[1:]]
    x = np.column_stack(columns)
    pinv = np.linalg.pinv(x)
    beta = pinv @ y
    resid = y - x @ beta
    lev = np.einsum("ij,ji->i", x, pinv)
    a = pinv[1]
    usual = lev < 1 - 1e-9
    var = (a[usual] ** 2 * resid[usual] ** 2 / (1 - lev[usual]) ** 2).sum()
    r2 = 1 - (resid**2).sum() / ((y - y.mean()) ** 2).sum()
    return beta[1], np.sqrt(var), r2, len(rows), int((~usual).sum())


def test_controls_equal_dense(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, "k string, y double, label boolean, soc string, state string, ft string, lp double")
    got = regression.ols_hc3(df, "k", "y", "label", "soc", ["state", "ft"], ["lp"]).first()
    beta, se, r2, n, ones = _dense(rows)
    assert got["n"] == n and got["status"] == "ok" and got["n_leverage_one"] == ones
    assert got["label_coef"] == pytest.approx(beta, rel=1e-8)
    assert got["label_se"] == pytest.approx(se, rel=1e-8)
    assert got["r2"] == pytest.approx(r2, rel=1e-8)
    assert got["ci_low"] == pytest.approx(beta - 1.959963984540054 * se, rel=1e-8)


def test_many_levels_in_tiles(spark):
    """2 000 levels beside the absorbed factor: 16 blocks of pivots, against a dense inverse."""
    rng = np.random.default_rng(11)
    n, n_levels, n_absorbed = 7000, 2000, 6
    level, absorbed = np.r_[np.arange(n_levels), rng.integers(n_levels, size=n - n_levels)], rng.integers(n_absorbed, size=n)
    label, y = rng.random(n) < 0.4, rng.normal(size=n)
    rows = [("m", float(y[i]), bool(label[i]), f"a{absorbed[i]}", f"l{level[i]}") for i in range(n)]
    df = spark.createDataFrame(rows, "key string, y double, label boolean, a string, l string")
    got = regression.ols_hc3(df, "key", "y", "label", "a", ["l"], []).first()

    x = np.zeros((n, 1 + n_absorbed + n_levels))
    x[:, 0] = label
    x[np.arange(n), 1 + absorbed] = 1
    x[np.arange(n), 1 + n_absorbed + level] = 1
    inverse = np.linalg.pinv(x.T @ x, rcond=1e-10, hermitian=True)
    beta = inverse @ (x.T @ y)
    resid, lev, a = y - x @ beta, np.einsum("ij,ij->i", x @ inverse, x), x @ inverse[0]
    usual = lev < 1 - 1e-9
    se = np.sqrt((a[usual] ** 2 * resid[usual] ** 2 / (1 - lev[usual]) ** 2).sum())
    assert got["n"] == n and got["status"] == "ok" and got["n_leverage_one"] == int((~usual).sum()) > 0
    assert got["label_coef"] == pytest.approx(beta[0], rel=1e-7)
    assert got["label_se"] == pytest.approx(se, rel=1e-7)


def test_small_tiles_and_keys_of_unequal_width(spark):
    wide = [("wide", *row[1:]) for row in _rows()]
    narrow = [("narrow", *row[1:4], "t1", "Y", row[6]) for row in _rows(seed=8)]
    df = spark.createDataFrame(wide + narrow, "k string, y double, label boolean, soc string, state string, ft string, lp double")
    small, large = (
        {r["k"]: r.asDict() for r in regression.ols_hc3(df, "k", "y", "label", "soc", ["state", "ft"], ["lp"], block=b).collect()}
        for b in (3, 128)
    )
    assert small.keys() == large.keys() == {"wide", "narrow"}
    for key, row in small.items():
        assert row["status"] == large[key]["status"] == "ok"
        for name in ("n", "n_leverage_one", "label_coef", "label_se", "r2"):
            assert row[name] == pytest.approx(large[key][name], rel=1e-8)


def test_statuses(spark):
    schema = "k string, y double, label boolean, soc string, state string"
    few = [("few", float(i), i % 2 == 0, "a", "x") for i in range(6)]
    fixed = [("fixed", float(i), i < 10, "a" if i < 10 else "b", "x") for i in range(20)]  # label = level
    lone = [("lone", float(i), i == 0, "a", "x") for i in range(20)]  # one labelled row
    df = spark.createDataFrame(few + fixed + lone, schema)
    got = {r["k"]: r["status"] for r in regression.ols_hc3(df, "k", "y", "label", "soc", ["state"], []).collect()}
    assert got == {"few": "too_few_rows", "fixed": "not_estimable", "lone": "leverage_one"}


def test_closed_form_equals_general(spark):
    df = spark.createDataFrame(_rows(), "k string, y double, label boolean, soc string, state string, ft string, lp double")
    short = regression.absorbed_hc3(df, "k", "y", "label", "soc").first()
    full = regression.ols_hc3(df, "k", "y", "label", "soc", [], []).first()
    for name in ("label_coef", "label_se", "label_p"):
        assert short[name] == pytest.approx(full[name], rel=1e-7)
