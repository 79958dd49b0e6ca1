"""Every relational query on Spark against DuckDB, and what the rules make of real wording."""

import duckdb
import pytest

from spreadloom.functions import scalars
from spreadloom.plans import catalog, fixtures, rules
from spreadloom.plans.dialect import SPARK

SF = "/root/testdata/sf0.001"
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}
#: Too few rows at this size for a match.
SPARSE = {"joint_subset", "pages_retried", "comparative_recovery"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in catalog.TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def comparable(rows):
    return sorted(tuple((v is None, f"{v:.9g}" if isinstance(v, float) else str(v)) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_parity(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, SF), duck.cursor().sql(catalog.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    types = dict(zip(want.columns, map(str, want.types), strict=True))
    assert {c: TYPES[t] for c, t in got.dtypes} == types
    rows = got.select(*want.columns).collect()
    assert rows or name in SPARSE
    assert comparable(rows) == comparable(want.fetchall())


def one(spark, function, text):
    df = spark.createDataFrame([(text,)], "s string")
    return df.select(scalars.columns(function, "s")).first()[0]


@pytest.mark.parametrize(
    ("text", "want"),
    [("12,34,567", 1234567), ("12,34,567.00", 1234567), ("₹ 1,000", 1000), ("Rs. 1,000", 1000), ("(1,234)", -1234), ("1 23 456", 123456), ("0", 0), ("", None), ("-", None), (None, None), ("NA", None)],
)
def test_to_int(spark, text, want):
    assert one(spark, scalars.to_int, text) == want


def test_clean_amount(spark):
    assert one(spark, scalars.clean_amount, "1,35,24,153.00") == 13524153
    assert one(spark, scalars.clean_amount, "6,029.41") == 6029.41


@pytest.mark.parametrize(
    ("text", "label", "amount"),
    [("TO NET PROFIT -4,391,651", "TO NET PROFIT", -4391651), ("Short - Term Borrowings 50,000", "Short - Term Borrowings", 50000), ("24,18,44,856 12,32,46,427", None, None), ("Total outstanding dues of creditors 4,32,248", "Total outstanding dues of creditors", 432248)],
)
def test_lines(spark, text, label, amount):
    assert one(spark, scalars.line_label, text) == label
    assert one(spark, scalars.line_amount, text) == amount


@pytest.mark.parametrize(("label", "want"), fixtures.LABELS)
def test_labels(duck, label, want):
    """The same expressions as on Spark, which parity holds them to."""
    from spreadloom.plans.dialect import DUCK

    assert duck.cursor().execute(f"SELECT {rules.map_label(DUCK, 'l')} FROM (SELECT ? AS l)", [label]).fetchone()[0] == want


def test_closing_stock_is_deducted(spark):
    df = spark.createDataFrame([("[INC] Closing stock", 100), ("[EXP] Opening stock", 100), ("closing stock", 100)], "label string, amount long")
    assert [r[0] for r in df.selectExpr(rules.mapped_amount(SPARK, "label", "amount")).collect()] == [-100, 100, 100]


def test_periods_and_units(spark):
    assert one(spark, scalars.period_year, "BALANCE SHEET AS ON 31 ST MARCH 2026") == 2026
    assert one(spark, scalars.period_year, "as on 31.03.98") == 1998
    assert one(spark, scalars.period_year, "for the year ended 31-03-24") == 2024
    assert one(spark, scalars.unit_scale, "(in Rs. lakhs)") == 100_000
    assert one(spark, scalars.is_title, "Balance sheet total 1,00,000") is False
    assert one(spark, scalars.is_title, "Profit & Loss A/c") is True
    assert one(spark, scalars.is_title, "Net profit carried to balance sheet") is False


def test_rules_run_once_for_each_label(spark):
    """The filter on keys stays above the grouping by label."""
    plan = catalog.QUERIES["buckets"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    lowest = min(k for k, line in enumerate(plan.split("\n")) if "Aggregate [label" in line)
    assert not any("RLIKE" in line and "Filter" in line for line in plan.split("\n")[lowest + 1 :])


def test_filters_and_columns_reach_the_scan(spark):
    plan = catalog.QUERIES["check_block"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "l_comment" not in plan and plan.count("ReadSchema") >= 2


def result(duck, name):
    return sorted(duck.cursor().execute(catalog.ORACLES[name]).fetchall(), key=str)


def test_reading_of_pages(duck):
    assert result(duck, "book_profit") == [("a", 1, -1532419), ("b", 0, 1234567)]
    [figures] = result(duck, "return_figures")
    assert figures == ("a", 0, 4825888, None, 0, None, 319862, -319860)
    assert [r[4] for r in result(duck, "classify_statement")] == ["balance_sheet", "profit_loss", "capital_account", "profit_loss", "profit_loss", "capital_account", "other", "balance_sheet"]
    assert [r[3] for r in result(duck, "continuations")] == [1, 1, 2, 1, 2]
    assert result(duck, "restated_parents")[0] == (1, 1, 1, 500, True)
    assert [r[2] for r in result(duck, "vision_adoption")] == [False, True, True, False]
    assert ("a", 1, "statement") in result(duck, "relevance_select") and not any(r[2] == "audit" for r in result(duck, "relevance_select"))
    assert {r[1]: r[3] for r in result(duck, "relevance_page_kinds") if r[0] == "a"} == {0: "acknowledgement", 1: "statement", 2: "noise", 3: "audit", 4: "noise"}
    assert result(duck, "owner_loan_notes") == [("c", 2, "Loans from directors & relatives (Unsecured) 5291900")]
    assert dict(result(duck, "separator_repair"))[99] == "2,35,51,356.00 and 31.03.2024 12.345 1,23,456"
