"""The models against plain numpy versions or exact values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from orderlens.operators import analytics as an, models, views
from orderlens.plans.canon import AS_OF, Canon

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sold(spark):
    return Canon(spark, SF).sold.select("order_id", "customer_id", "order_date", "net").cache()


def test_churn_risk_by_newton_steps(sold):
    features = an.churn_features(sold, AS_OF)
    rows = features.orderBy("customer_id").toPandas()
    x = rows[["recency", "frequency", "monetary", "mean_gap", "tenure"]].to_numpy(float)
    y = rows.churned.to_numpy(float)
    assert 0 < y.mean() < 1
    x = np.column_stack([np.ones(len(x)), (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)])
    w, penalty = np.zeros(6), np.diag([0.0] + [0.01] * 5)
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve((x.T * (p * (1 - p))) @ x / len(x) + penalty + 1e-12 * np.eye(6), x.T @ (p - y) / len(x) + penalty @ w)
    got = an.churn_risk(features).orderBy("customer_id").toPandas()
    assert (got.customer_id == rows.customer_id).all() and np.abs(got.churn_risk_score - 1 / (1 + np.exp(-x @ w))).max() <= 0.0051


def loss(p, rows):
    r, alpha, a, b = np.exp(p)
    total = 0.0
    for x, t_x, t, n in rows:
        beta = lambda u, v: math.lgamma(u) + math.lgamma(v) - math.lgamma(u + v)
        one = beta(a, b + x) - beta(a, b) + math.lgamma(r + x) - math.lgamma(r) + r * math.log(alpha)
        alive = one - (r + x) * math.log(alpha + t)
        gone = beta(a + 1, b + x - 1) - beta(a, b) + math.lgamma(r + x) - math.lgamma(r) + r * math.log(alpha) - (r + x) * math.log(alpha + t_x) if x else -math.inf
        top = max(alive, gone)
        total -= n * (top + math.log(math.exp(alive - top) + (math.exp(gone - top) if x else 0)))
    return total + 1e-3 * float((p**2).sum())


def test_value_likelihood_and_optimum(spark, sold, monkeypatch):
    rows = [tuple(r) for r in models.rft_counts(models.rft(sold, AS_OF)).collect()]
    x, t_x, t, n = (np.array(c, float) for c in zip(*rows))
    for p in (np.zeros(4), np.log([0.7, 12.0, 2.0, 5.0])):
        assert -models.log_likelihood(p, x, t_x, t, n) + 1e-3 * float((p**2).sum()) == pytest.approx(loss(p, rows), rel=1e-9)
    seen = {}
    search = models.nelder_mead
    monkeypatch.setattr(models, "nelder_mead", lambda f, start: seen.setdefault("p", search(f, start)))
    got = {r.customer_id: r for r in models.clv(sold, AS_OF).collect()}
    best, step = loss(seen["p"], rows), 0.5
    p = seen["p"].copy()
    for _ in range(12):  # a pattern search from there finds nothing that is clearly better
        for i in range(4):
            for s in (step, -step):
                q = p.copy()
                q[i] += s
                if loss(q, rows) < loss(p, rows):
                    p = q
        step /= 2
    assert loss(p, rows) >= best - 1e-3 * abs(best)
    assert len(got) == sold.select("customer_id").distinct().count() and all(math.isfinite(r.expected_orders) and r.expected_orders >= 0 for r in got.values())


def test_expected_orders_by_integration():
    """The formula against the mean over a grid of rates and drop-out chances."""
    r, alpha, a, b, weeks = 1.3, 9.0, 2.2, 3.1, 13.0
    lam, p = np.linspace(1e-5, 4, 3000)[:, None], np.linspace(1e-5, 1 - 1e-5, 1500)[None, :]
    prior = lam ** (r - 1) * np.exp(-alpha * lam) * p ** (a - 1) * (1 - p) ** (b - 1)
    for x, t_x, t in ((0, 0.0, 30.0), (2, 12.0, 30.0), (7, 29.0, 31.0)):
        alive = (1 - p) ** x * lam**x * np.exp(-lam * t) * prior
        gone = (p * (1 - p) ** (x - 1) * lam**x * np.exp(-lam * t_x) if x else 0) * prior
        want = (alive * (1 - np.exp(-lam * p * weeks)) / p).sum() / (alive + gone).sum()
        got = models.expected_orders(np.log([r, alpha, a, b]), np.array([x]), np.array([t_x]), np.array([t]), weeks)[0]
        assert got == pytest.approx(want, rel=5e-3)


def exact_depth(x, points, depth):
    """The expected path length of x in an isolation tree over points on a line."""
    if depth == 0 or len(points) == 1:
        return float(models._mean_path(len(points)))
    span = points[-1] - points[0]
    total = 0.0
    for k in range(1, len(points)):
        side = points[:k] if x in points[:k] else points[k:]
        total += (points[k] - points[k - 1]) / span * exact_depth(x, side, depth - 1)
    return 1 + total


def test_forest_against_exact_path_lengths(spark):
    points = [0.0, 1.0, 1.5, 4.0, 11.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(points)], "id long, v double")
    got = {r.id: r.score for r in models.isolation_forest(df, ["v"], "id", trees=4000).collect()}
    want = {i: 2 ** -(exact_depth(v, points, math.ceil(math.log2(5))) / float(models._mean_path(5))) for i, v in enumerate(points)}
    assert got == pytest.approx(want, rel=0.02) and max(got, key=got.get) == 4


@pytest.mark.parametrize("engaged", [False, True])
def test_segments_are_nearest_to_their_own_mean(spark, sold, engaged):
    profile = an.customer_profile(sold, AS_OF).withColumn("recency", ((F.col("customer_id") * 7) % 120).cast("int"))  # some within 90 days
    axis = "total_orders"
    if engaged:
        events = spark.read.parquet(f"{SF}/events.parquet")
        profile, axis = profile.join(views.engagement_with_activity(profile, events).select("customer_id", "engagement_score"), "customer_id"), "engagement_score"
    rows = profile.join(an.segmentation(profile), "customer_id").toPandas()
    assert set(rows[rows.recency > 90].ai_segment) == {"at_risk"}
    own = rows[rows.ai_segment.isin(["new_potential", "loyalist", "vip_champion"])].reset_index(drop=True)
    x = np.column_stack([own.lifetime_value.astype(float), own[axis].astype(float), own.recency.astype(float)])
    x = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    names = sorted(own.ai_segment.unique())
    means = np.array([x[own.ai_segment == s].mean(axis=0) for s in names])
    nearest = np.array(names)[((x[:, None] - means[None]) ** 2).sum(axis=2).argmin(axis=1)]
    assert len(names) == 3 and (nearest == own.ai_segment).mean() >= 0.99
    value = own.groupby("ai_segment").lifetime_value.apply(lambda v: v.astype(float).mean())
    assert value["new_potential"] < value["loyalist"] < value["vip_champion"]
