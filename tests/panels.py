"""A small raw panel for tests, with the elasticities that made it."""

import numpy as np

KIND = "store int, upc long, week int, move double, qty double, price double, sale string, profit double, ok int"


def elasticity_of(upc):
    """-1.25 to -3.0: all elastic, each product another."""
    return -(1.25 + 0.25 * (upc % 8))


def movement(spark, upcs=5, stores=4, weeks=90, seed=1):
    """Raw rows: prices that are tried up to a tenth up or down in one week of five and up to three tenths off in one of eight (recorded
    as a sale), costs that creep up, units of the product's elasticity with a season and a noise of a seventh. Large
    units, so that rounding them matters little."""
    rng, rows = np.random.default_rng(seed), []
    for upc in range(1, upcs + 1):
        for store in range(stores):
            level = 6 + rng.normal(0, 0.2)
            for week in range(1, weeks + 1):
                usual = 1.5 + 0.5 * upc
                promoted = rng.random() < 1 / 8
                price = round(float(usual * (rng.uniform(0.7, 0.9) if promoted else rng.uniform(0.9, 1.1) if rng.random() < 0.2 else 1.0)), 2)
                cost = usual * 0.6 * 1.002**week
                units = np.exp(level + 0.1 * np.sin(2 * np.pi * week / 52) + elasticity_of(upc) * np.log(price / usual) + rng.normal(0, 0.15))
                rows.append((store, upc, week, float(round(units)), 1.0, price, str(rng.choice(["B", "S"])) if promoted else None, round(100 * (1 - cost / price), 4), 1))
    return spark.createDataFrame(rows, KIND)


def products(spark, upcs=5):
    rows = [(1, u, f"PRODUCT {u}", f"{10 + u} OZ", 12, u) for u in range(1, upcs + 1)]
    return spark.createDataFrame(rows, "com_code int, upc long, descrip string, size string, case int, nitem long")
