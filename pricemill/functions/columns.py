"""Column functions of prices, margins and demand. A ratio by zero or by null is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0).cast("double"))


def money(x: Column) -> Column:
    """Cents, halves up; written out so that every engine rounds alike."""
    return F.floor(x * 100 + 0.5) / 100.0


def r6(x: Column) -> Column:
    return F.round(x.cast("double"), 6)


def unit_price(price: Column, qty: Column) -> Column:
    return price / F.when(qty > 0, qty)


def gross_margin_rate(price: Column, cost: Column) -> Column:
    return ratio(price - cost, price)


def gross_profit(price: Column, cost: Column, units: Column) -> Column:
    return (price - cost) * units


def price_change(new: Column, old: Column) -> Column:
    return ratio(new, old) - 1


def arc_elasticity(p1: Column, q1: Column, p2: Column, q2: Column, least_change: float = 1e-4) -> Column:
    """Midpoint elasticity; null where a midpoint is not positive, units are negative, or prices barely differ."""
    p, q = (p1 + p2) / 2, (q1 + q2) / 2
    change = (p2 - p1) / F.when(p > 0, p)
    valid = (p > 0) & (q > 0) & (q1 >= 0) & (q2 >= 0) & (F.abs(change) >= least_change)
    return F.when(valid, ((q2 - q1) / F.when(q > 0, q)) / F.nullif(change, F.lit(0.0)))


def package_ounces(size: Column) -> Column:
    """First number of the size text, times 16 where it speaks of pounds."""
    number = F.nullif(F.regexp_extract(F.upper(size), r"([0-9]+(?:\.[0-9]+)?)", 1), F.lit("")).cast("double")
    return F.when(F.upper(size).contains("LB"), number * 16).otherwise(number)


def demand(base: Column, price: Column, reference: Column, elasticity: Column, cap: Column | None = None) -> Column:
    """base * (price / reference) ** elasticity, between 0 and the cap if there is one."""
    units = F.greatest(base * F.pow(price / reference, elasticity), F.lit(0.0))
    return units if cap is None else F.least(units, cap)


def best_price(cost: Column, elasticity: Column) -> Column:
    """Profit-maximal price under constant elasticity; infinite at -1 and above."""
    return F.when(elasticity < -1, cost * elasticity / (1 + elasticity)).when(elasticity >= -1, F.lit(float("inf")))


def price_index(price: Column, reference: Column) -> Column:
    return ratio(price, reference)


def linear_revenue_price(a: Column, b: Column) -> Column:
    return a / (2 * b)


def linear_profit_price(a: Column, b: Column, cost: Column) -> Column:
    return (a + b * cost) / (2 * b)


def objective(name: str, price: Column, units: Column, cost: Column) -> Column:
    if name == "revenue":
        return price * units
    if name == "gross_profit":
        return (price - cost) * units
    raise ValueError(f"no objective {name}")


def extrapolation(price: Column, low: Column, high: Column) -> Column:
    """Relative distance of a price outside [low, high], 0 inside, null without support."""
    below = F.when(low > 0, (low - price) / low)
    above = F.when(high > 0, (price - high) / high)
    return F.when(low.isNull() | high.isNull(), None).when(price < low, below).when(price > high, above).otherwise(F.lit(0.0))


def charm(price: Column) -> Column:
    return F.floor(price * 10) / 10.0 + 0.09


def to_increment(price: Column, increment: float) -> Column:
    """Nearest multiple of the increment, halves to even."""
    return F.bround(price / increment, 0) * increment


def price_grid(low: Column, high: Column, current: Column, step: float, rounding: float, charm_prices: bool = False) -> Column:
    """Rising candidate prices from low by step, with the current price, inside the rounded bounds; null
    for an empty interval."""
    last = F.floor((high - low) / step).cast("int")
    raw = F.transform(F.sequence(F.lit(0), F.when(high >= low, last)), lambda i: low + step * i)
    prices = F.transform(F.concat(raw, F.array(current)), lambda p: to_increment(p, rounding))
    if charm_prices:
        prices = F.concat(F.transform(prices, charm), F.array(to_increment(current, rounding)))
    inside = lambda p: (p >= to_increment(low, rounding) - 1e-9) & (p <= to_increment(high, rounding) + 1e-9) & (p > 0)
    feasible = lambda p: inside(p) & (p >= low - 1e-9) & (p <= high + 1e-9)
    return F.when(high >= low, F.array_sort(F.array_distinct(F.filter(prices, feasible))))
