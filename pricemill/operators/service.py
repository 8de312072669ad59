"""What a service asks of the panel: the serving slice, product search, single decisions, summaries, and a
check that the numbers in an answer stand in the facts it was given."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricemill.config import Config
from pricemill.functions.columns import demand

from . import decisions
from .elasticity import ElasticityTable

#: Prices that one request may simulate.
MOST_PRICES = 500

EXPLANATIONS = {
    "INSUFFICIENT_HISTORY": "the series has too few weeks",
    "INSUFFICIENT_PRICE_VARIATION": "the price has hardly moved, so its effect is unknown",
    "COST_UNAVAILABLE": "no unit cost is known at the time of the decision",
    "KEEP_CURRENT_OPTIMAL": "the current price stays",
    "HIGH_RISK_KEEP_CURRENT": "the risk is high and the profile keeps the price then",
    "HIGH_RISK_REVIEW_REQUIRED": "the risk is high and a person has to look at it",
    "LOW_CONFIDENCE": "the estimate rests on thin evidence",
    "MEDIUM_RISK_CONSERVATIVE": "the risk is medium, so the change is limited further",
    "POOLED_ELASTICITY_FALLBACK": "the product has no usable elasticity of its own",
    "NO_FEASIBLE_PRICE": "the guardrails leave no price",
    "NON_MATERIAL_UPLIFT": "the gain is too small to act on",
    "PROFIT_UPLIFT_POSITIVE": "the model expects more profit",
    "REVENUE_UPLIFT_POSITIVE": "the model expects more revenue",
    "DEMAND_CURVE_NOT_DECREASING": "predicted demand rises with the price somewhere",
    "PRICE_CHANGE_LIMIT": "the largest allowed change binds",
    "OUTSIDE_EXTRAPOLATION_RANGE": "the range of prices seen so far binds",
    "MARGIN_CONSTRAINT": "the unit cost or the least margin binds",
    "ABSOLUTE_PRICE_FLOOR": "the lowest price binds",
    "ABSOLUTE_PRICE_CEILING": "the highest price binds",
}


class NotFound(LookupError):
    """No row for the product and store asked for."""


class BadRequest(ValueError):
    """A request that cannot be answered."""


def serving_slice(rows: DataFrame, weeks: int = 8) -> DataFrame:
    """Rows of the last weeks that have a history."""
    last = rows.agg(F.max("week").alias("__last"))
    return rows.join(F.broadcast(last), F.col("week") > F.col("__last") - weeks).where("lag_move_1 is not null and lag_price_1 is not null").select(*rows.columns)


def search_products(products: DataFrame, text: str) -> DataFrame:
    """Products whose description contains the text, in any case; the text is taken literally."""
    return products.where(F.contains(F.lower("descrip"), F.lower(F.lit(text))))


def _context(contexts: DataFrame, upc: int, store: int, week: int | None) -> DataFrame:
    rows = contexts.where((F.col("upc") == upc) & (F.col("store") == store))
    rows = rows if week is None else rows.where(F.col("week") == week)
    newest = Window.partitionBy("upc", "store").orderBy(F.desc("week"))
    row = rows.withColumn("__n", F.row_number().over(newest)).where("__n = 1").drop("__n")
    if row.isEmpty():
        raise NotFound(f"no context of product {upc} in store {store}")
    return row


def recommend_price(contexts: DataFrame, upc: int, store: int, week: int | None = None, profile: str = "standard", config: Config | None = None) -> DataFrame:
    """The decision of one context, the newest if no week is named."""
    return decisions.recommend(_context(contexts, upc, store, week), profile, config)


def simulate_prices(contexts: DataFrame, upc: int, store: int, prices: list[float], week: int | None = None) -> DataFrame:
    """Units, revenue and profit of one context at each price."""
    if not 0 < len(prices) <= MOST_PRICES or any(not p > 0 for p in prices):
        raise BadRequest(f"between one and {MOST_PRICES} positive prices are needed")
    row = _context(contexts, upc, store, week).withColumn("price", F.explode(F.array(*map(F.lit, sorted({float(p) for p in prices})))))
    row = row.withColumn("units", demand(F.col("base_units"), F.col("price"), F.col("current_price"), F.col("elasticity")))
    return row.select("upc", "store", "week", "price", "units", (F.col("price") * F.col("units")).alias("revenue"), ((F.col("price") - F.col("unit_cost")) * F.col("units")).alias("profit"))


def predict_demand(contexts: DataFrame, upc: int, store: int, price: float, week: int | None = None) -> DataFrame:
    return simulate_prices(contexts, upc, store, [price], week).select("upc", "store", "week", "price", "units")


def resolved(requests: DataFrame, served: DataFrame) -> DataFrame:
    """requests (store, upc, product, and whatever else they carry) with resolved_upc and problem.

    A code is taken if the store serves it (served: store, upc, descrip); otherwise the name decides, by the one product of
    the store whose description contains it in any case. Nothing is guessed: problem is STORE_NOT_SERVED, NO_CODE_OR_NAME,
    NO_MATCH or SEVERAL_MATCHES where there is no product, else null. A null store is not served; repeated requests each get
    their row, and products that are served twice count once.
    """
    keep = requests.columns
    one = served.select(F.col("store").alias("__store"), F.col("upc").alias("__upc"), F.lower(F.coalesce("descrip", F.lit(""))).alias("__text"))
    rows = requests.withColumn("__name", F.when(F.length(F.trim("product")) > 0, F.lower(F.trim("product"))))
    stores = one.select("__store").distinct().withColumn("__served", F.lit(True))
    codes = one.select("__store", F.col("__upc").alias("__coded")).distinct()
    rows = rows.join(stores, F.col("store") == F.col("__store"), "left").drop("__store")
    rows = rows.join(codes, (F.col("store") == F.col("__store")) & (F.col("upc") == F.col("__coded")), "left").drop("__store")
    # each name that a store is asked for is searched once, and only what it matches leaves the join
    asked = rows.where("__coded is null and __name is not null").select(F.col("store").alias("__s"), F.col("__name").alias("__n")).distinct()
    found = asked.join(one, (F.col("__s") == F.col("__store")) & F.contains("__text", "__n")).groupBy("__s", "__n").agg(F.min("__upc").alias("__low"), F.max("__upc").alias("__high"))
    rows = rows.join(found, (F.col("store") == F.col("__s")) & (F.col("__name") == F.col("__n")), "left")
    by_name = F.when(F.col("__low") == F.col("__high"), F.col("__low"))
    problem = (
        F.when(F.col("__served").isNull(), "STORE_NOT_SERVED").when(F.col("__coded").isNotNull(), None).when(F.col("__name").isNull() & F.col("upc").isNull(), "NO_CODE_OR_NAME")
        .when(F.col("__low").isNull(), "NO_MATCH").when(F.col("__low") < F.col("__high"), "SEVERAL_MATCHES")
    )
    return rows.select(*keep, F.coalesce(F.col("__coded"), by_name).alias("resolved_upc"), problem.alias("problem"))


def compare_policies(contexts: DataFrame, config: Config | None = None, profiles: tuple[str, ...] | None = None) -> DataFrame:
    """Each context under each profile (all of the settings, if none are named), in one pass: policy_profile, decision,
    prices, the change and the model's own uplift in per cent, risk and reason codes."""
    config = config or Config()
    names = tuple(config["policy_profiles"]) if profiles is None else profiles
    for name in names:
        config.policy(name)  # an error for a profile that there isn't
    rows = contexts.withColumn("policy_profile", F.explode(F.array(*map(F.lit, names))))
    found = decisions.recommend(rows, F.col("policy_profile"), config)
    return found.select(
        "upc", "store", "week", "policy_profile", "current_price", "decision", "recommended_price", (100 * (F.col("recommended_price") / F.col("current_price") - 1)).alias("price_change_percent"),
        "risk_level", (100 * F.col("model_internal_estimated_uplift")).alias("uplift_percent"), "reason_codes",
    )


def model_info(contexts: DataFrame, method: str, model_version: str, table: ElasticityTable | None = None) -> DataFrame:
    """One row on what is served: method and version, the pooled elasticity (null without a table), weeks, products, stores
    and contexts; an empty table serves nothing and has no weeks."""
    pooled = F.lit(None if table is None else float(table.pooled)).cast("double")
    return contexts.agg(
        F.lit(method).alias("price_response_method"), F.lit(model_version).alias("model_version"), F.round(pooled, 2).alias("pooled_elasticity"), F.min("week").alias("first_week"), F.max("week").alias("last_week"),
        F.countDistinct("upc").alias("n_products"), F.countDistinct("store").alias("n_stores"), F.count("*").alias("n_contexts"),
    )


def register_views(contexts: DataFrame, method: str, model_version: str, table: ElasticityTable | None = None, config: Config | None = None) -> None:
    """compare_policies, model_info and reason_code_glossary as temporary views, for SQL."""
    compare_policies(contexts, config).createOrReplaceTempView("compare_policies")
    model_info(contexts, method, model_version, table).createOrReplaceTempView("model_info")
    contexts.sparkSession.createDataFrame(list(EXPLANATIONS.items()), "code string, explanation string").createOrReplaceTempView("reason_code_glossary")


def explained(recommendations: DataFrame) -> DataFrame:
    """(upc, store, week, code, explanation): one row a reason code, in the order of the decision."""
    known = F.create_map(*(F.lit(x) for pair in EXPLANATIONS.items() for x in pair))
    rows = recommendations.select("upc", "store", "week", F.posexplode("reason_codes").alias("position", "code"))
    return rows.withColumn("explanation", F.try_element_at(known, F.col("code")))


def portfolio(recommendations: DataFrame) -> DataFrame:
    """One row: decisions by kind and the model's own estimate of what the actionable ones would bring."""
    kind = lambda k: F.count_if(F.col("decision") == k)
    act = F.col("decision") == "RECOMMEND_CHANGE"
    return recommendations.agg(
        F.count("*").alias("n_contexts"), kind("RECOMMEND_CHANGE").alias("n_change"), kind("REVIEW_REQUIRED").alias("n_review"), kind("KEEP_CURRENT").alias("n_keep"),
        F.coalesce(F.sum(F.when(act, F.col("profit_proposed") - F.col("profit_current"))), F.lit(0.0)).alias("model_internal_gain"), F.avg(F.when(act, F.col("recommended_price") / F.col("current_price") - 1)).alias("mean_change"),
    )


def numbers(text: Column) -> Column:
    """The numbers of a text as written, without thousands separators."""
    found = F.regexp_extract_all(text, F.lit(r"(?<![A-Za-z0-9_.])-?[0-9][0-9,]*(?:\.[0-9]+)?"), F.lit(0))
    return F.transform(found, lambda x: F.regexp_replace(x, ",", ""))


def ungrounded(answer: Column, facts: Column, list_up_to: float = 12) -> Column:
    """Numbers of the answer whose magnitude no fact (array of double) has to the decimals they are written
    with. Markers of lists (a number and a full stop or bracket at the beginning of a line) are not
    looked at, nor are whole numbers up to list_up_to, which count or order things."""
    text = F.regexp_replace(answer, r"(?m)^[ \t]*[0-9]+[.)][ \t]", " ")
    decimals = lambda x: F.length(F.regexp_extract(x, r"\.([0-9]+)$", 1))
    near = lambda x, f: F.abs(F.abs(x.cast("double")) - F.abs(f)) <= F.pow(F.lit(10.0), -decimals(x)) / 2 + 1e-9
    small = lambda x: (decimals(x) == 0) & (F.abs(x.cast("double")) <= list_up_to)
    return F.filter(numbers(text), lambda x: ~small(x) & ~F.exists(facts, lambda f: near(x, f)))


def phrase_faults(answer: Column, forbidden: list[str], required: list[str]) -> Column:
    """Forbidden phrases that the answer has, and required ones that it lacks, in any case of letters."""
    low = F.lower(answer)
    wrong = [F.when(F.contains(low, F.lit(x.lower())), F.lit(f"forbidden: {x}")) for x in forbidden]
    lacking = [F.when(~F.contains(low, F.lit(x.lower())), F.lit(f"missing: {x}")) for x in required]
    return F.array_compact(F.array(*wrong, *lacking))
