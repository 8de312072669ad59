"""Requests for single decisions, and the checks around them."""

import pytest
from pyspark.sql import functions as F

from pricemill.config import Config
from pricemill.operators import decisions, elasticity, service
from pricemill.plans.queries import contexts


@pytest.fixture(scope="module")
def some(spark, sf_dir):
    return contexts(spark, sf_dir).cache()


def test_one_decision_equals_its_row_of_the_batch(some):
    row = decisions.recommend(some).where("n_candidates > 0").orderBy("upc", "store").first()
    assert service.recommend_price(some, row["upc"], row["store"]).first() == row
    grid = service.simulate_prices(some, row["upc"], row["store"], [1.0, 2.0, 2.0, row["current_price"]]).orderBy("price").collect()
    assert len(grid) == 3 and [r["units"] for r in grid] == sorted((r["units"] for r in grid), reverse=True)
    assert service.predict_demand(some, row["upc"], row["store"], row["current_price"]).first()["units"] == pytest.approx(row["base_units"])


def test_bad_requests(some):
    with pytest.raises(service.NotFound):
        service.recommend_price(some, -1, 1)
    for prices in ([], [0.0], [1.0] * 501):
        with pytest.raises(service.BadRequest):
            service.simulate_prices(some, 11, 1, prices)


def test_every_code_has_an_explanation(some):
    found = service.explained(decisions.recommend(some))
    assert found.where("explanation is null").isEmpty() and not found.isEmpty()
    total = service.portfolio(decisions.recommend(some)).first()
    assert total["n_contexts"] == total["n_change"] + total["n_review"] + total["n_keep"] == some.count()


def test_search_is_literal(spark):
    products = spark.createDataFrame([(1, "Oat 100% Rings"), (2, "OAT RINGS"), (3, None)], "upc long, descrip string")
    assert [r["upc"] for r in service.search_products(products, "100%").collect()] == [1]
    assert service.search_products(products, "oat").count() == 2 and service.search_products(products, ".").count() == 0


def test_numbers_must_stand_in_the_facts(spark):
    df = spark.createDataFrame([("The price is 2.50 and 1,200 units, up 12.3 per cent in W4", [2.5, 1200.0, 12.34])], "answer string, facts array<double>")
    assert df.select(service.ungrounded(F.col("answer"), F.col("facts")).alias("x")).first()["x"] == []
    assert df.select(service.ungrounded(F.lit("2.51 or 12"), F.col("facts")).alias("x")).first()["x"] == ["2.51"]


def test_profiles_as_rows_equal_one_profile_at_a_time(some):
    config = Config({"policy_profiles": {"standard": {"abs_max_price": 0.9, "abs_min_price": 0.05}, "aggressive": {"allow_below_cost": True, "min_gross_margin_rate": 0.0}}})
    rows = some.withColumn("profile", F.explode(F.array(F.lit("conservative"), F.lit("standard"), F.lit("aggressive"))))
    got = decisions.recommend(rows, F.col("profile"), config)
    for name in ("conservative", "standard", "aggressive"):
        alone = decisions.recommend(some, name, config)
        own = got.where(F.col("profile") == name).select(alone.columns)
        assert sorted(own.collect(), key=str) == sorted(alone.collect(), key=str)
    assert got.where("profile = 'standard'").agg(F.max("high")).first()[0] <= 0.9


def test_policies_compared_and_sql_views(spark, some):
    found = service.compare_policies(some)
    assert found.count() == 3 * some.count()
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("InMemoryRelation [") == 1  # one pass over the contexts
    kept = found.where("decision = 'KEEP_CURRENT'")
    assert kept.where("price_change_percent <> 0").isEmpty()
    with pytest.raises(KeyError):
        service.compare_policies(some, profiles=("standard", "no such"))
    assert service.compare_policies(some.limit(0)).isEmpty()
    service.register_views(some, "fixed", "7", elasticity.fixed(-2.0))
    row = some.first()
    sql = spark.sql(f"SELECT policy_profile, decision FROM compare_policies WHERE upc = {row['upc']} AND store = {row['store']}")
    assert {r["policy_profile"] for r in sql.collect()} == {"conservative", "standard", "aggressive"}
    info = spark.sql("SELECT * FROM model_info").first()
    assert (info["model_version"], info["pooled_elasticity"], info["n_contexts"]) == ("7", -2.0, some.count())
    assert spark.table("reason_code_glossary").count() == len(service.EXPLANATIONS)
    empty = service.model_info(some.limit(0), "shrunk", "1").first()
    assert (empty["n_contexts"], empty["first_week"], empty["pooled_elasticity"]) == (0, None, None)


def test_products_are_resolved_without_guessing(spark):
    served = spark.createDataFrame(
        [(1, 10, "Oat Rings 100%"), (1, 11, "OAT FLAKES"), (1, 12, None), (1, 10, "Oat Rings 100%"), (2, 11, "OAT FLAKES")], "store int, upc long, descrip string"
    )
    asked = [
        (1, 1, 10, "flakes"), (2, 1, 99, "rings"), (3, 1, None, "oat"), (4, 1, None, " FLAKES "), (5, 9, 10, None), (6, 1, None, " "), (7, 1, 99, None), (8, 2, 10, "oat"),
        (9, 1, None, "0%"), (10, 1, None, "."), (11, None, 10, "oat"), (4, 1, None, " FLAKES "), (12, 1, 12, None),
    ]
    got = service.resolved(spark.createDataFrame(asked, "k int, store int, upc long, product string"), served)
    assert got.columns == ["k", "store", "upc", "product", "resolved_upc", "problem"]
    assert sorted((r["k"], r["resolved_upc"], r["problem"]) for r in got.collect()) == [
        (1, 10, None), (2, 10, None), (3, None, "SEVERAL_MATCHES"), (4, 11, None), (4, 11, None), (5, None, "STORE_NOT_SERVED"), (6, None, "NO_CODE_OR_NAME"), (7, None, "NO_MATCH"),
        (8, 11, None), (9, 10, None), (10, None, "NO_MATCH"), (11, None, "STORE_NOT_SERVED"), (12, 12, None),
    ]
    assert {r["problem"] for r in service.resolved(got.drop("resolved_upc", "problem"), served.limit(0)).collect()} == {"STORE_NOT_SERVED"}


def test_provenance_tells_settings_apart(some):
    found = decisions.recommend(some, "standard")
    a, b = (decisions.with_provenance(found, "shrunk", "3", Config(c)).select("config_sha256", "policy_profile", "objective").distinct().collect() for c in ({}, {"risk": {"low_risk": {"min_observations": 151}}}))
    assert len(a) == len(b) == 1 and a[0]["config_sha256"] != b[0]["config_sha256"]
    assert (a[0]["policy_profile"], a[0]["objective"]) == ("standard", "gross_profit")
