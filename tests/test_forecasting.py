"""Models by key against plain loops; what the backtest must choose."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from orderlens.operators import analytics as an, forecasting as fc
from orderlens.plans.canon import Canon

D0 = dt.date(2000, 1, 1)


def loop_holt_winters(y, h):
    best = None
    for a in (0.1, 0.3, 0.6):
        for b in (0.0, 0.05):
            for c in (0.1, 0.3):
                level = sum(y[:7]) / 7
                season = [v - level for v in y[:7]]
                slope, error = 0.0, 0.0
                for t in range(7, len(y)):
                    guess = level + slope + season[t % 7]
                    error += (y[t] - guess) ** 2
                    last = level
                    level = a * (y[t] - season[t % 7]) + (1 - a) * (level + slope)
                    slope = b * (level - last) + (1 - b) * slope
                    season[t % 7] = c * (y[t] - level) + (1 - c) * season[t % 7]
                error /= len(y) - 7
                if best is None or error < best[0]:
                    best = error, [level + slope * k + season[(len(y) - 1 + k) % 7] for k in range(1, h + 1)]
    return best[1], math.sqrt(best[0])


def loop_effects(first, y, h):
    """Normal equations by hand, solved by elimination."""

    def row(i):
        d = first + dt.timedelta(i)
        return [1.0, i / 365.25] + [float(d.weekday() == k) for k in range(7)] + [float(d.month == k) for k in range(1, 13)]

    m = [[0.0] * 22 for _ in range(21)]
    for i, v in enumerate(y):
        r = row(i)
        for j in range(21):
            if r[j]:
                for k in range(21):
                    m[j][k] += r[j] * r[k]
                m[j][21] += r[j] * v
    for j in range(21):
        m[j][j] += 1e-9 + (1e-3 * len(y) if j > 1 else 0)
    for j in range(21):
        p = max(range(j, 21), key=lambda k: abs(m[k][j]))
        m[j], m[p] = m[p], m[j]
        for k in range(21):
            if k != j and m[k][j]:
                f = m[k][j] / m[j][j]
                m[k] = [x - f * z for x, z in zip(m[k], m[j])]
    b = [m[j][21] / m[j][j] for j in range(21)]
    fit = [sum(x * z for x, z in zip(row(i), b)) for i in range(len(y) + h)]
    left = [v - f for v, f in zip(y, fit)]
    mean = sum(left) / len(left)
    return fit[len(y) :], math.sqrt(sum((x - mean) ** 2 for x in left) / len(left))


def days_of(first, n):
    return (first - dt.date(1970, 1, 1)).days + np.arange(n)


def test_models_equal_plain_loops():
    rng = np.random.default_rng(5)
    for n in (40, 430):
        y = 100 + np.arange(n) * 0.2 + np.tile([0, 5, 9, 3, 1, 20, 30], n)[:n] + rng.normal(0, 4, n)
        day = days_of(D0, n)
        ahead = day[-1] + 1 + np.arange(20)
        for model, (want, spread) in ((fc.holt_winters, loop_holt_winters(list(y), 20)), (fc.trend_and_effects, loop_effects(D0, list(y), 20))):
            got, s = model(day, y, ahead)
            assert got == pytest.approx(want, rel=1e-6) and s == pytest.approx(spread, rel=1e-6)
    assert fc.repeat_season(day, y, ahead)[0].tolist() == [y[-7 + k % 7] for k in range(20)]
    short = fc.holt_winters(day[:5], y[:5], ahead)
    assert np.isfinite(short[0]).all() and len(short[0]) == 20


def test_the_backtest_chooses_by_key(spark):
    rows = []
    for i in range(1100):
        d = D0 + dt.timedelta(i)
        rows += [("steady", d, float(100 + 10 * d.weekday())), ("months", d, float(50 + 40 * (d.month in (6, 7, 8)) + (i * 7919) % 13)), ("drift", d, float(1000 + 60 * math.sin(i / 90) * i / 100 + 5 * d.weekday()))]
    rows += [("new", D0, 1.0), ("new", D0 + dt.timedelta(3), 2.0), (None, D0, 5.0)]
    series = spark.createDataFrame(rows, "k string, ds date, y double")
    got = fc.backtest(series, ["k"], 30, 3).collect()
    assert len(got) == 15 and {k: sum(r.chosen for r in got if r.k == k) for k in {r.k for r in got}} == dict.fromkeys(["steady", "months", "drift", "new", None], 1)
    chosen = {r.k: r.model for r in got if r.chosen}
    assert chosen["steady"] == "season" and chosen["months"] == "effects" and chosen["drift"] != "effects"
    assert all(r.mae is None for r in got if r.k in ("new", None))
    out = fc.forecast(series, ["k"], 90).collect()
    assert len(out) == 5 * 90 and {(r.k, r.model) for r in out} == set(chosen.items()) and all(r.yhat_lower <= r.yhat <= r.yhat_upper for r in out)
    assert min(r.ds for r in out if r.k == "new") == D0 + dt.timedelta(4)
    assert fc.forecast(series.limit(0), ["k"]).count() == fc.backtest(series.limit(0), ["k"]).count() == 0


def test_given_table_by_region(spark):
    """Errors and forecasts of the query, by the plain loops."""
    series = an.daily_series(Canon(spark, "/root/testdata/sf0.001").sold.where(F.col("region").isin("ASIA", "EUROPE")), ["region"]).where("ds < date '1996-06-01'")
    rows = {}
    for r in series.orderBy("ds").collect():
        rows.setdefault(r.region, []).append((r.ds, r.y))
    got = {(r.region, r.model): r for r in fc.backtest(series, ["region"]).collect()}
    ahead = {}
    for r in fc.forecast(series, ["region"]).orderBy("ds").collect():
        ahead.setdefault(r.region, []).append(r)
    for region, own in rows.items():
        y, n = [v for _, v in own], len(own)
        models = {"season": lambda past, h: [past[-7 + k % 7] for k in range(h)], "effects": lambda past, h: loop_effects(own[0][0], past, h)[0], "holt_winters": lambda past, h: loop_holt_winters(past, h)[0]}
        maes = {}
        for name, model in models.items():
            errors = [sum(abs(a - b) for a, b in zip(model(y[:at], 30), y[at : at + 30])) / 30 for at in (n - 90, n - 60, n - 30)]
            maes[name] = sum(errors) / 3
            assert got[region, name].mae == pytest.approx(maes[name], rel=1e-6)
        best = min(maes, key=maes.get)
        assert got[region, best].chosen and [r.yhat for r in ahead[region]] == pytest.approx(models[best](y, 90), abs=1e-3)
