"""Models without a Spark ML form: BG/NBD customer value and the isolation forest."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F


# -- customer lifetime value by BG/NBD (Fader, Hardie, Lee 2005) ----------------------------------------------------------------
def rft(orders: DataFrame, as_of: str) -> DataFrame:
    """(customer_id, x repeat orders, t_x and t in weeks, mean order value)."""
    days = orders.groupBy("customer_id").agg(F.countDistinct("order_date").alias("_d"), F.min("order_date").alias("_a"), F.max("order_date").alias("_b"), F.avg(F.col("net").cast("double")).alias("mean_value"))
    return days.select("customer_id", (F.col("_d") - 1).cast("int").alias("x"), F.floor(F.datediff("_b", "_a") / 7).cast("int").alias("t_x"), F.floor(F.datediff(F.lit(as_of).cast("date"), F.col("_a")) / 7).cast("int").alias("t"), F.round("mean_value", 4).alias("mean_value"))


def rft_counts(rows: DataFrame) -> DataFrame:
    """Customers by (x, t_x, t): all that the likelihood needs, in whole weeks."""
    return rows.groupBy("x", "t_x", "t").agg(F.count(F.lit(1)).alias("n"))


_G = np.array([676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7])  # Lanczos, fixed values


def lgamma(z: np.ndarray | float) -> np.ndarray:
    z = np.asarray(z, float) - 1
    s = 0.99999999999980993 + sum(g / (z + i + 1) for i, g in enumerate(_G))
    t = z + len(_G) - 0.5
    return 0.5 * np.log(2 * np.pi) + (z + 0.5) * np.log(t) - t + np.log(s)


def log_likelihood(params: np.ndarray, x, t_x, t, n) -> float:
    r, alpha, a, b = np.exp(params)
    first = lgamma(r + x) - lgamma(r) + r * np.log(alpha)
    stay = lgamma(a + b) + lgamma(b + x) - lgamma(b) - lgamma(a + b + x)
    alive = -(r + x) * np.log(alpha + t)
    last = np.where(x > 0, np.log(a) - np.log(b + np.maximum(x, 1) - 1) - (r + x) * np.log(alpha + t_x), -np.inf)
    return float((n * (first + stay + np.logaddexp(alive, last))).sum())


def nelder_mead(f, start: np.ndarray, rounds: int = 400, size: float = 0.5) -> np.ndarray:
    points = [np.array(start, float)] + [np.array(start, float) + size * np.eye(len(start))[i] for i in range(len(start))]
    values = [f(p) for p in points]
    for _ in range(rounds):
        order = np.argsort(values)
        points, values = [points[i] for i in order], [values[i] for i in order]
        if abs(values[-1] - values[0]) < 1e-8 * (abs(values[0]) + 1):
            break
        centre = np.mean(points[:-1], axis=0)
        tries = [centre + k * (centre - points[-1]) for k in (1.0, 2.0, -0.5)]
        reflected = f(tries[0])
        if reflected < values[0]:
            expanded = f(tries[1])
            points[-1], values[-1] = (tries[1], expanded) if expanded < reflected else (tries[0], reflected)
        elif reflected < values[-2]:
            points[-1], values[-1] = tries[0], reflected
        else:
            inner = f(tries[2])
            if inner < values[-1]:
                points[-1], values[-1] = tries[2], inner
            else:
                points = [points[0]] + [points[0] + 0.5 * (p - points[0]) for p in points[1:]]
                values = [values[0]] + [f(p) for p in points[1:]]
    return points[int(np.argmin(values))]


def hyp2f1(a, b, c, z, terms: int = 200):
    out = np.ones_like(z)
    term = np.ones_like(z)
    for k in range(terms):
        term = term * (a + k) * (b + k) / (c + k) / (k + 1) * z
        out = out + term
    return out


def expected_orders(params: np.ndarray, x, t_x, t, weeks: float) -> np.ndarray:
    """Expected orders of a customer in the next `weeks` weeks."""
    r, alpha, a, b = np.exp(params)
    z = weeks / (alpha + t + weeks)
    ratio = ((alpha + t) / (alpha + t + weeks)) ** (r + x) * hyp2f1(r + x, b + x, a + b + x - 1, z)
    top = (a + b + x - 1) / (a - 1) * (1 - ratio)
    bottom = 1 + (x > 0) * a / (b + np.maximum(x, 1) - 1) * ((alpha + t) / (alpha + t_x)) ** (r + x)
    return top / bottom


def clv(orders: DataFrame, as_of: str, horizon_days: int = 90) -> DataFrame:
    """(customer_id, expected_orders, clv_predicted). The model is fitted on counts by whole weeks: at most as many rows as there
    are week triples that occur, however many customers there are."""
    rows = rft(orders, as_of)
    counts = rft_counts(rows).toPandas()
    if not len(counts):
        return rows.select("customer_id", F.lit(0.0).alias("expected_orders"), F.lit(0.0).alias("clv_predicted"))
    x, t_x, t, n = (counts[c].to_numpy(float) for c in ("x", "t_x", "t", "n"))

    def loss(p):
        return 1e12 if np.abs(p).max() > 12 else -log_likelihood(p, x, t_x, t, n) + 1e-3 * float((p**2).sum())

    params = nelder_mead(loss, np.log([1.0, 10.0, 1.5, 3.0]))

    @F.pandas_udf("double")
    def expect(x: pd.Series, t_x: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series(expected_orders(params, x.to_numpy(float), t_x.to_numpy(float), t.to_numpy(float), horizon_days / 7))

    out = rows.withColumn("expected_orders", F.round(expect("x", "t_x", "t"), 6))
    return out.select("customer_id", "expected_orders", F.round(F.col("expected_orders") * F.col("mean_value"), 2).alias("clv_predicted"))


# -- isolation forest (Liu, Ting, Zhou 2008) ------------------------------------------------------------------------------------
def _tree(rows: np.ndarray, rng: np.random.Generator, depth: int) -> tuple:
    spread = np.flatnonzero(rows.max(axis=0) > rows.min(axis=0)) if len(rows) > 1 else []
    if depth == 0 or len(spread) == 0:
        return (len(rows),)
    f = int(rng.choice(spread))
    cut = rng.uniform(rows[:, f].min(), rows[:, f].max())
    left = rows[:, f] < cut
    return f, cut, _tree(rows[left], rng, depth - 1), _tree(rows[~left], rng, depth - 1)


def _mean_path(n) -> np.ndarray:
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def _paths(tree: tuple, rows: np.ndarray, at: np.ndarray, depth: int, out: np.ndarray) -> None:
    if len(tree) == 1:
        out[at] += depth + _mean_path(tree[0])
        return
    left = rows[at, tree[0]] < tree[1]
    _paths(tree[2], rows, at[left], depth + 1, out)
    _paths(tree[3], rows, at[~left], depth + 1, out)


def isolation_forest(df: DataFrame, columns: list[str], key: str, trees: int = 100, sample: int = 256, share: float = 0.01, seed: int = 11) -> DataFrame:
    """(key, score, is_anomaly): trees are grown on sub-samples of `sample` rows, as the published method has it, the rows chosen by
    a hash of the key; scoring is distributed. Anomalies are the top `share` of scores."""
    pool = df.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(sample * 8).select(*columns).toPandas().to_numpy(float)
    rng = np.random.default_rng(seed)
    m = min(sample, len(pool))
    forest = [_tree(pool[rng.choice(len(pool), m, replace=False)], rng, int(np.ceil(np.log2(max(m, 2))))) for _ in range(trees)] if m else []

    @F.pandas_udf("double")
    def score(*series: pd.Series) -> pd.Series:
        rows = np.stack([s.to_numpy(float) for s in series], 1)
        total = np.zeros(len(rows))
        for tree in forest:
            _paths(tree, rows, np.arange(len(rows)), 0, total)
        return pd.Series(2 ** -(total / len(forest) / max(float(_mean_path(m)), 1e-9)))

    scored = df.select(key, F.round(score(*columns), 6).alias("score"))
    limit = F.broadcast(scored.agg(F.percentile_approx("score", 1 - share, 100000).alias("_limit")))
    return scored.join(limit).select(key, "score", (F.col("score") > F.col("_limit")).alias("is_anomaly"))
