"""Year values, ratios, trends and flags on worked examples."""

import pytest

from spreadloom.operators import spread, trust
from spreadloom.plans import template as T
from spreadloom.plans.run import relations

LAKH = 100_000
BUCKETS = {
    "sales_other_income": 500, "purchases": 200, "transport_admin": 120, "employee_costs": 40, "other_expenses": 10, "interest_finance": 30, "depreciation": 50, "provision_tax": 12,
    "provision_deferred_tax": 3, "equity_capital": 200, "reserves": 50, "secured_loan_asset_financed": 300, "secured_loan_ccod": 40, "unsecured_loans": 20, "sundry_creditors": 60,
    "current_liabilities": 25, "fixed_assets": 450, "debtors": 90, "current_assets": 155,
}


def buckets(spark, rows):
    return spark.createDataFrame([(e, y, k, v) for e, y, values in rows for k, v in values.items()], "entity string, year int, key string, amount long")


def over(spark, rows, *steps):
    return relations({"buckets": buckets(spark, rows)}, spread.derived, *steps).collect()


def lakhs(values):
    return {k: v * LAKH for k, v in values.items()}


def test_derived_rows(spark):
    v = over(spark, [("a", 2024, lakhs(BUCKETS))])[0]
    assert (v["profit_before_tax"], v["profit_after_tax"], v["cash_profit"]) == (50 * LAKH, 35 * LAKH, 85 * LAKH)
    assert v["total_liabilities"] == v["total_assets"] == 695 * LAKH
    assert v["preference_shares"] == 0


def test_an_unread_statement_is_null(spark):
    v = over(spark, [("a", 2024, {k: x for k, x in BUCKETS.items() if k in T.PL_INPUTS})])[0]
    assert v["gross_receipts"] == 500 and v["extraordinary"] == 0
    assert all(v[k] is None for k in T.BS_KEYS)


def test_ratios(spark):
    r = over(spark, [("a", 2024, lakhs(BUCKETS))], spread.ratios)[0]
    assert r["current_ratio"] == pytest.approx(245 / 125)
    assert r["debtor_days"] == pytest.approx(90 / 500 * 365)
    assert r["ltd_equity"] == pytest.approx(300 / 270)
    assert r["interest_cover"] == pytest.approx(130 / 30)
    r = over(spark, [("a", 2024, {"equity_capital": 26924, "secured_loan_asset_financed": 30474, "unsecured_loans": 300, "current_liabilities": 8849, "sales_other_income": 8741, "interest_finance": 3269})], spread.ratios)[0]
    assert r["ltd_equity"] == pytest.approx(1.1194, abs=1e-4) and r["tol_tnw"] == pytest.approx(1.4444, abs=1e-4)
    assert r["creditor_days"] == 0


def test_a_zero_denominator_gives_null(spark):
    r = over(spark, [("a", 2024, {"sales_other_income": 10})], spread.ratios)[0]
    assert r["interest_cover"] is None and r["roe"] is None and r["pat_income"] == 1


def flags(spark, rows, **more):
    return {(r["year"], r["flag"], r["severity"]) for r in over(spark, rows, spread.ratios, lambda d: spread.flags(d, **more))}


def test_flags(spark):
    worse = lakhs(BUCKETS | {"sales_other_income": 300})
    found = flags(spark, [("a", 2024, lakhs(BUCKETS)), ("a", 2025, worse)])
    assert {f for f in found if f[0] == 2024} == set()
    assert {(2025, "Loss-making", "red"), (2025, "Turnover falling sharply", "red"), (2025, "Thin interest cover", "red"), (2025, "Margin compressing", "amber")} <= found


def test_flags_need_the_year_before(spark):
    found = flags(spark, [("a", 2022, lakhs(BUCKETS)), ("a", 2025, lakhs(BUCKETS | {"sales_other_income": 460}))])
    assert not any("Turnover" in f for _, f, _ in found)


def test_an_unassessable_year_has_one_flag(spark):
    assert flags(spark, [("a", 2024, lakhs(BUCKETS | {"sales_other_income": 1}))], assessed="FALSE") == {(2024, "Not assessable", "amber")}


def test_trends_and_cagr(spark):
    rows = [("a", 2023, {"sales_other_income": 100}), ("a", 2025, {"sales_other_income": 121})]
    assert [r["sales_other_income"] for r in over(spark, rows, spread.growth)] == [None, None]
    assert over(spark, rows, spread.cagr)[0]["cagr"] == pytest.approx(0.10)


def test_conservation_and_stock(spark):
    lines = [("a", 2024, 1, "Share Capital", 100000), ("a", 2024, 2, "Trade Payables", 50000), ("a", 2024, 3, "Total", 150000), ("a", 2024, 4, "Mystery Item", 7000)]
    df = spark.createDataFrame(lines, "entity string, year int, seq long, label string, amount long")
    r = relations({"lines": df}, spread.mapped, spread.conservation).first()
    assert (r["bucketed"], r["unmapped"], r["ignored"], r["conserved"]) == (150000, 7000, 150000, True)
    lines = [("a", 2024, 1, "[EXP] opening stock", 4415506), ("a", 2024, 2, "[EXP] purchases", 196009252), ("a", 2024, 3, "[EXP] gross prfit trf", 4577061), ("a", 2024, 4, "[INC] sales", 203099742), ("a", 2024, 5, "[INC] closing stock", 1902077)]
    df = spark.createDataFrame(lines, "entity string, year int, seq long, label string, amount long")
    got = {r["key"]: r["amount"] for r in relations({"lines": df}, spread.buckets).collect()}
    assert got == {"purchases": 4415506 + 196009252 - 1902077, "sales_other_income": 203099742}


def test_stated_loss(spark):
    rows = [("a", 2024, 1, "[EXP] To Net Profit", 5), ("b", 2024, 1, "[INC] By Net Loss", 5), ("c", 2024, 1, "Net Profit/(Loss)", -5), ("d", 2024, 1, "Net Profit/(Loss)", 5)]
    df = spark.createDataFrame(rows, "entity string, year int, seq long, label string, amount long")
    got = {r["entity"]: r["is_loss"] for r in relations({"lines": df}, spread.mapped, spread.stated).collect()}
    assert got == {"a": False, "b": True, "c": True, "d": None}


def test_balance_check(spark):
    rows = [("a", 2024, BUCKETS), ("b", 2024, BUCKETS | {"fixed_assets": 5000}), ("c", 2024, {"sales_other_income": 1})]
    got = {r["entity"]: r["status"] for r in over(spark, rows, trust.balance)}
    assert got == {"a": "pass", "b": "fail", "c": "skip"}
