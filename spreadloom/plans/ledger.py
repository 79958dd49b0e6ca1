"""The driver's tables as statement lines, so that every relational operator runs on real volumes.

A line is a lineitem: its entity is the customer's nation (or the customer), its year the financial year of shipping (by
the calendar year it ends in), its label one of a fixed list, its amount the price in whole rupees.
"""

from __future__ import annotations

from spreadloom.plans.dialect import Spark

#: Labels of all template keys, some subtotals and some that nothing claims.
LABELS = (
    "[INC] Revenue from operations", "[INC] Other income", "[EXP] Purchase of material", "[EXP] Diesel and transport", "[EXP] Salaries and wages",
    "[EXP] Office expenses", "Finance Costs", "Depreciation and amortisation", "Exceptional item", "Current tax", "Deferred tax expense", "Preference dividend",
    "(a) Share Capital", "Preference share capital", "(b) Reserves and Surplus", "Term loan from bank", "Current maturities of debt", "Cash credit",
    "Long term provision", "Unsecured Loans", "Deferred Tax Liabilities (Net)", "[CL] Sundry Creditors", "(a) Short - Term Borrowings", "[FA] Mh-12-1615",
    "Intangible assets", "Investment in shares", "Deferred tax asset", "Sundry Debtors & Other Receivable", "Cash and bank balance", "Long term loans and advances",
    "Other non current assets", "Total", "[EXP] Net Profit for the year", "III Total Revenue (I + II)", "Suspense account", "Branch adjustment",
    "[INC] Sales", "[INC] Transport Movement Charges", "[EXP] Opening stock", "[INC] Closing stock", "[EXP] Wages", "Interest on vehicle loan",
    "Loans from directors", "Long Term Borrowings", "Trade payables", "Trade receivables", "Furniture", "[EQ] Profit for the Year", "[INC] Sale of services",
)


def lines(d: Spark, entity: str = "n_name") -> str:
    n = len(LABELS)
    label = d.pick(d.list([d.text(x) for x in LABELS]), f"{d.mod('l_partkey * 7 + l_linenumber', n)} + 1")
    return f"""SELECT {entity} AS entity, CAST(year(l_shipdate) + CASE WHEN month(l_shipdate) >= 4 THEN 1 ELSE 0 END AS INT) AS year,
        l_orderkey * 10 + l_linenumber AS seq, {label} AS label, {d.half_even('l_extendedprice')} AS amount, l_returnflag AS printing
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"""


def values(d: Spark, rows: list[tuple], names: str) -> str:
    """A literal table, the same in both engines."""

    def cell(x) -> str:
        return "NULL" if x is None else str(x).upper() if isinstance(x, bool) else d.text(x) if isinstance(x, str) else str(x)

    body = ", ".join(f"({', '.join(map(cell, r))})" for r in rows)
    return f"SELECT * FROM (VALUES {body}) AS t({names})"
