"""Row-level derived columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def net_amount(total: Column, discount: Column) -> Column:
    return total - discount


def line_total(quantity: Column, unit_price: Column) -> Column:
    return quantity * unit_price


def gross_margin(net: Column, cost: Column) -> Column:
    """Null without a cost."""
    return net - cost


def gross_margin_pct(price: Column, cost: Column) -> Column:
    """Null without a cost or at price 0."""
    return F.when(price != 0, (price - cost).cast("double") / price.cast("double") * 100)


def is_low_stock(stock: Column, threshold: Column) -> Column:
    return stock < threshold


def stock_band(stock: Column, threshold: Column) -> Column:
    """Red below the product's threshold, orange below twice that, else green."""
    return F.when(stock < threshold, "red").when(stock < 2 * threshold, "orange").otherwise("green")


def cohort_month(first_purchase: Column) -> Column:
    return F.trunc(first_purchase, "MM")


def at_risk(last_order: Column, as_of: str, days: int = 90) -> Column:
    return F.datediff(F.lit(as_of).cast("date"), last_order) > days
