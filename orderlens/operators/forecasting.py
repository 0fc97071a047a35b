"""Forecasts by key from models that are chosen by a backtest: a season repeated, trend with weekday and month effects, Holt-Winters.

Spark sums a key's orders to a value a day; a key's days, a few thousand rows however many orders there are, go to one task, where
the models are fitted in numpy.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

SEASON = 7
#: Grid of smoothing weights for level, trend and season.
LEVELS, TRENDS, SEASONS = (0.1, 0.3, 0.6), (0.0, 0.05), (0.1, 0.3)
#: What keeps effects of rare months finite.
RIDGE = 1e-3


def repeat_season(day: np.ndarray, y: np.ndarray, ahead: np.ndarray) -> tuple[np.ndarray, float]:
    """(forecast, spread): the last full season over again."""
    last = y[-SEASON:] if len(y) >= SEASON else np.resize(y, SEASON)
    fit = y[SEASON:] - y[:-SEASON]
    return last[np.arange(len(ahead)) % SEASON], float(np.sqrt(np.mean(fit**2))) if len(fit) else 0.0


def effects(day: np.ndarray) -> np.ndarray:
    """A row a day (days since 1970): trend, weekday and month."""
    months = day.astype("datetime64[D]").astype("datetime64[M]").astype(int) % 12
    return np.column_stack([np.ones(len(day)), day / 365.25, np.eye(7)[(day + 3) % 7], np.eye(12)[months]])


def trend_and_effects(day: np.ndarray, y: np.ndarray, ahead: np.ndarray) -> tuple[np.ndarray, float]:
    """Least squares on trend, weekday and month effects, these kept small by a ridge."""
    start = day[0]
    x, to = effects(day), effects(ahead)
    x[:, 1] -= start / 365.25
    to[:, 1] -= start / 365.25
    weight = np.diag([0.0, 0.0, *[RIDGE * len(day)] * 19])
    b = np.linalg.solve(x.T @ x + weight + 1e-9 * np.eye(21), x.T @ y)
    return to @ b, float(np.std(y - x @ b))


def smooth(y: np.ndarray, level: float, trend: float, season: float) -> tuple[np.ndarray, float, float, np.ndarray]:
    """Additive Holt-Winters: (one-step forecasts after the first season, last level, last trend, last season)."""
    s = list(y[:SEASON] - y[:SEASON].mean())
    now, slope, one = float(y[:SEASON].mean()), 0.0, []
    for t in range(SEASON, len(y)):
        k = t % SEASON
        one.append(now + slope + s[k])
        last, now = now, level * (y[t] - s[k]) + (1 - level) * (now + slope)
        slope = trend * (now - last) + (1 - trend) * slope
        s[k] = season * (y[t] - now) + (1 - season) * s[k]
    return np.array(one), now, slope, np.array(s)


def holt_winters(day: np.ndarray, y: np.ndarray, ahead: np.ndarray) -> tuple[np.ndarray, float]:
    """The smoothing weights of the grid with the smallest one-step error; the first of equal ones."""
    if len(y) < 2 * SEASON:
        return repeat_season(day, y, ahead)
    best = None
    for a in LEVELS:
        for b in TRENDS:
            for c in SEASONS:
                one, now, slope, s = smooth(y, a, b, c)
                error = float(np.mean((y[SEASON:] - one) ** 2))
                if best is None or error < best[0]:
                    best = error, now, slope, s
    error, now, slope, s = best
    h = np.arange(1, len(ahead) + 1)
    return now + slope * h + s[(len(y) - 1 + h) % SEASON], float(np.sqrt(error))


MODELS: dict[str, Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, float]]] = {"season": repeat_season, "effects": trend_and_effects, "holt_winters": holt_winters}


def errors(day: np.ndarray, y: np.ndarray, horizon: int, origins: int) -> dict[str, float]:
    """The mean absolute error of each model over `horizon` days after each of the last `origins` origins, a horizon apart. A series
    without two seasons before an origin has none there; without any origin all errors are infinite."""
    cuts = [n for n in (len(y) - horizon * k for k in range(origins, 0, -1)) if n >= 2 * SEASON]
    return {name: float(np.mean([np.abs(model(day[:n], y[:n], day[n : n + horizon])[0] - y[n : n + horizon]).mean() for n in cuts])) if cuts else np.inf for name, model in MODELS.items()}


def _series(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """All days from the first to the last, those without a row as 0."""
    day = rows.ds.to_numpy().astype("datetime64[D]").astype(np.int64)
    every = np.arange(day.min(), day.max() + 1)
    y = np.zeros(len(every))
    np.add.at(y, day - every[0], rows.y.to_numpy(float))
    return every, y


def _typed(series: DataFrame, keys: Sequence[str]) -> str:
    kinds = dict(series.dtypes)
    return "".join(f"{k} {kinds[k]}, " for k in keys)


def backtest(series: DataFrame, keys: Sequence[str], horizon: int = 30, origins: int = 3) -> DataFrame:
    """(keys, model, mae, chosen) for each key of series (keys, ds, y: one row a day and key): errors after rolling origins, and the
    model with the smallest, the first of MODELS at a tie. A null key is a key; a key without rows has none; too few days: mae null."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        found = errors(*_series(rows), horizon, origins)
        best = min(found, key=found.get)
        out = pd.DataFrame({"model": list(found), "mae": [round(x, 6) if np.isfinite(x) else None for x in found.values()], "chosen": [m == best for m in found]})
        for i, (k, value) in enumerate(zip(keys, key)):
            out.insert(i, k, value)
        return out

    return series.groupBy(*keys).applyInPandas(run, _typed(series, keys) + "model string, mae double, chosen boolean")


def forecast(series: DataFrame, keys: Sequence[str], horizon: int = 90, tested: int = 30, origins: int = 3, z: float = 1.96) -> DataFrame:
    """(keys, ds, model, yhat, yhat_lower, yhat_upper) of `horizon` days after each key's last, by the model that backtest chooses.
    Bands are z spreads of the model's errors on what it was fitted on."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        day, y = _series(rows)
        found = errors(day, y, tested, origins)
        name = min(found, key=found.get)
        ahead = day[-1] + 1 + np.arange(horizon)
        yhat, spread = MODELS[name](day, y, ahead)
        out = pd.DataFrame({"ds": pd.to_datetime(ahead, unit="D").date, "model": name, "yhat": yhat.round(4), "yhat_lower": (yhat - z * spread).round(4), "yhat_upper": (yhat + z * spread).round(4)})
        for i, (k, value) in enumerate(zip(keys, key)):
            out.insert(i, k, value)
        return out

    return series.groupBy(*keys).applyInPandas(run, _typed(series, keys) + "ds date, model string, yhat double, yhat_lower double, yhat_upper double")
