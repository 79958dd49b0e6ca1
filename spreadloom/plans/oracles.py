"""DuckDB answers written by hand from the rules, for the queries that decide figures.

Nothing here comes from the relations that the engine runs: the statements are spelt out on the tables, with the label keys as a
list that was read off the rules, so that a rule that is wrong in the engine differs here. The other queries are held to the
engine's own plan rendered for DuckDB, which shows that both engines agree on it and no more.
"""

from __future__ import annotations

#: Label, its row of the template (NULL: nobody's, '__ignored__': a subtotal), the convention it follows.
LABELS = (
    ("[INC] Revenue from operations", "sales_other_income", None), ("[INC] Other income", "sales_other_income", None),
    ("[EXP] Purchase of material", "purchases", None), ("[EXP] Diesel and transport", "transport_admin", None),
    ("[EXP] Salaries and wages", "employee_costs", None), ("[EXP] Office expenses", "other_expenses", None),
    ("Finance Costs", "interest_finance", None), ("Depreciation and amortisation", "depreciation", None),
    ("Exceptional item", "extraordinary", None), ("Current tax", "provision_tax", None),
    ("Deferred tax expense", "provision_deferred_tax", None), ("Preference dividend", "preference_dividend", None),
    ("(a) Share Capital", "equity_capital", None), ("Preference share capital", "equity_capital", None),
    ("(b) Reserves and Surplus", "reserves", None), ("Term loan from bank", "secured_loan_asset_financed", None),
    ("Current maturities of debt", "secured_loan_maturity_1yr", None), ("Cash credit", "secured_loan_ccod", None),
    ("Long term provision", "other_lt_liabilities", None), ("Unsecured Loans", "unsecured_loans", None),
    ("Deferred Tax Liabilities (Net)", "deferred_tax_liability", None),
    ("[CL] Sundry Creditors", "sundry_creditors", "current liability by its section"),
    ("(a) Short - Term Borrowings", "current_liabilities", None), ("[FA] Mh-12-1615", "fixed_assets", None),
    ("Intangible assets", "intangible_assets", None), ("Investment in shares", "investments", None),
    ("Deferred tax asset", "deferred_tax_assets", None), ("Sundry Debtors & Other Receivable", "debtors", None),
    ("Cash and bank balance", "current_assets", None), ("Long term loans and advances", "lt_loans_advances", None),
    ("Other non current assets", "other_non_current_assets", None), ("Total", "__ignored__", None),
    ("[EXP] Net Profit for the year", "__ignored__", None), ("III Total Revenue (I + II)", "__ignored__", None),
    ("Suspense account", None, None), ("Branch adjustment", None, None), ("[INC] Sales", "sales_other_income", None),
    ("[INC] Transport Movement Charges", "sales_other_income", None),
    ("[EXP] Opening stock", "purchases", "opening stock added to purchases"),
    ("[INC] Closing stock", "purchases", "closing stock deducted from purchases"), ("[EXP] Wages", "employee_costs", None),
    ("Interest on vehicle loan", "interest_finance", None), ("Loans from directors", "unsecured_loans", None),
    ("Long Term Borrowings", "secured_loan_asset_financed", None), ("Trade payables", "sundry_creditors", None),
    ("Trade receivables", "debtors", None), ("Furniture", "fixed_assets", None), ("[EQ] Profit for the Year", "equity_capital", None),
    ("[INC] Sale of services", "sales_other_income", None),
)
SALES = ("sales_other_income",)
COSTS = ("purchases", "transport_admin", "employee_costs", "other_expenses", "interest_finance", "depreciation", "extraordinary")
TAXES = ("provision_tax", "provision_deferred_tax", "preference_dividend")
OWED = (
    "equity_capital", "preference_shares", "reserves", "secured_loan_asset_financed", "secured_loan_maturity_1yr", "secured_loan_ccod",
    "other_lt_liabilities", "unsecured_loans", "deferred_tax_liability", "sundry_creditors", "current_liabilities",
)
OWNED = ("fixed_assets", "intangible_assets", "investments", "deferred_tax_assets", "debtors", "current_assets", "lt_loans_advances", "other_non_current_assets")
RESULT_ROWS = (*SALES, *COSTS, *TAXES)
SHEET_ROWS = (*OWED, *OWNED)


def q(x: str | None) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'"


DICTIONARY = "SELECT * FROM (VALUES " + ", ".join(f"({k}, {q(a)}, {q(b)}, {q(c)})" for k, (a, b, c) in enumerate(LABELS)) + ") AS v(no, label, key, note)"


def ledger(entity: str = "n_name") -> str:
    """line: every lineitem of an entity's financial year with its label's key, and by label: amounts with closing stock turned."""
    return f"""dictionary AS ({DICTIONARY}),
line AS (SELECT {entity} AS entity, (year(l_shipdate) + (month(l_shipdate) > 3)::INT)::INT AS year, l_orderkey * 10 + l_linenumber AS seq, label, key, note, l_returnflag AS flag,
                round_even(l_extendedprice, 0)::BIGINT AS amount
         FROM lineitem, orders, customer, nation, dictionary
         WHERE l_orderkey = o_orderkey AND o_custkey = c_custkey AND c_nationkey = n_nationkey AND no = (l_partkey * 7 + l_linenumber) % {len(LABELS)}),
bylabel AS (SELECT entity, year, label, key, note, sum(amount)::BIGINT AS amount, count(*) AS n, CASE WHEN label = '[INC] Closing stock' THEN -sum(abs(amount)) ELSE sum(amount) END::BIGINT AS counted
            FROM line GROUP BY entity, year, label, key, note)"""


#: A year's rows, NULL where its statement was not read.
def year_rows(entity: str = "n_name") -> str:
    inputs = ", ".join(f"coalesce(sum(counted) FILTER (key = '{k}'), 0)::BIGINT AS {k}" for k in (*RESULT_ROWS, *SHEET_ROWS))
    plus = " + ".join
    gated = lambda flag, names: ", ".join(f"if({flag}, {n}, NULL) AS {n}" for n in names)
    return f"""{ledger(entity)},
totals AS (SELECT entity, year, bool_or(key IN {RESULT_ROWS}) AS have_pl, bool_or(key IN {SHEET_ROWS}) AS have_bs, {inputs}
           FROM bylabel WHERE key IS NOT NULL AND key <> '__ignored__' GROUP BY entity, year),
step1 AS (SELECT *, {plus(SALES)} AS gross_receipts, {plus(COSTS)} AS gross_expenses FROM totals),
step2 AS (SELECT *, gross_receipts - gross_expenses AS profit_before_tax FROM step1),
step3 AS (SELECT *, profit_before_tax - provision_tax - provision_deferred_tax AS profit_after_tax FROM step2),
step4 AS (SELECT *, profit_after_tax - preference_dividend AS profit_available, profit_after_tax + depreciation AS cash_profit, {plus(OWED)} AS total_liabilities, {plus(OWNED)} AS total_assets,
                 equity_capital + preference_shares + reserves AS networth, sundry_creditors + current_liabilities AS total_current_liabilities, debtors + current_assets AS total_current_assets FROM step3),
vals AS (SELECT entity, year, have_pl, have_bs, {gated("have_pl", (*RESULT_ROWS, "gross_receipts", "gross_expenses", "profit_before_tax", "profit_after_tax", "profit_available", "cash_profit"))},
                {gated("have_bs", (*SHEET_ROWS, "total_liabilities", "total_assets", "networth", "total_current_liabilities", "total_current_assets"))} FROM step4)"""


OWN = "equity_capital + reserves + preference_shares"
DIVISIONS = {
    "roce": ("profit_after_tax + interest_finance", f"{OWN} + secured_loan_asset_financed + unsecured_loans"),
    "roe": ("profit_after_tax", OWN),
    "pat_income": ("profit_after_tax", "sales_other_income"),
    "pat_assets": ("profit_after_tax", "total_assets"),
    "ltd_equity": ("secured_loan_asset_financed + secured_loan_maturity_1yr", f"{OWN} + unsecured_loans"),
    "tol_tnw": ("secured_loan_asset_financed + secured_loan_maturity_1yr + secured_loan_ccod + other_lt_liabilities + deferred_tax_liability + sundry_creditors + current_liabilities", f"{OWN} + unsecured_loans"),
    "interest_cover": ("profit_before_tax + interest_finance + depreciation", "interest_finance"),
    "current_ratio": ("debtors + current_assets", "sundry_creditors + current_liabilities + secured_loan_ccod + secured_loan_maturity_1yr"),
    "dscr": ("profit_after_tax + depreciation + interest_finance", "interest_finance + secured_loan_asset_financed / 4"),
    "debtor_days": ("365 * debtors", "sales_other_income"),
    "creditor_days": ("365 * sundry_creditors", "sales_other_income"),
}


def divided(entity: str = "n_name") -> str:
    """filled: unread rows as 0; shares: the ratios, NULL over nothing."""
    zero = ", ".join(f"coalesce({c}, 0) AS {c}" for c in (*RESULT_ROWS, *SHEET_ROWS, "profit_before_tax", "profit_after_tax", "total_assets"))
    return f"""{year_rows(entity)},
filled AS (SELECT entity, year, {zero} FROM vals),
shares AS (SELECT entity, year, {", ".join(f"if({b} = 0, NULL, ({a}) / ({b})) AS {n}" for n, (a, b) in DIVISIONS.items())} FROM filled)"""


def flagged(entity: str = "n_name") -> str:
    rel = lambda a, b: f"if({b} = 0, NULL, ({a} - {b}) / abs({b}))"
    return f"""{divided(entity)},
now AS (SELECT vals.*, shares.* EXCLUDE (entity, year), coalesce(total_liabilities, 0) - coalesce(networth, 0) AS debt, vals.year % 7 <> 1 AS assessed,
               CASE vals.year % 3 WHEN 0 THEN profit_before_tax WHEN 1 THEN -profit_before_tax END AS book FROM vals JOIN shares USING (entity, year)),
prev AS (SELECT entity, year + 1 AS year, sales_other_income AS s0, nullif(debt, 0) AS d0, total_current_liabilities AS c0, pat_income AS m0 FROM now),
signs AS (SELECT now.*, prev.year IS NOT NULL AS follows, m0, {rel("sales_other_income", "s0")} AS g, {rel("nullif(debt, 0)", "d0")} AS gd, {rel("total_current_liabilities", "c0")} AS gc
          FROM now LEFT JOIN prev ON now.entity = prev.entity AND now.year = prev.year),
raised AS (
  SELECT entity, year, 1 AS seq, 'amber' AS severity, 'Not assessable' AS flag FROM signs WHERE NOT assessed
  UNION ALL SELECT entity, year, 2, 'red', 'Loss-making' FROM signs WHERE assessed AND profit_before_tax < 0
  UNION ALL SELECT entity, year, 3, 'red', 'Net worth eroded' FROM signs WHERE assessed AND networth <= 0 AND total_assets <> 0
  UNION ALL SELECT entity, year, 4, 'red', 'High leverage' FROM signs WHERE assessed AND tol_tnw > 3 AND networth > 0
  UNION ALL SELECT entity, year, 5, 'amber', 'Weak liquidity' FROM signs WHERE assessed AND current_ratio < 1
  UNION ALL SELECT entity, year, 6, if(interest_cover < 1, 'red', 'amber'), 'Thin interest cover' FROM signs WHERE assessed AND interest_cover < 1.5 AND interest_finance <> 0
  UNION ALL SELECT entity, year, 7, 'red', 'Profit contradicts tax computation' FROM signs WHERE assessed AND abs(profit_before_tax) > 1000 AND ((book < 0 AND profit_before_tax >= 0) OR (book >= 0 AND profit_before_tax < 0))
  UNION ALL SELECT entity, year, 8, 'red', 'Turnover falling sharply' FROM signs WHERE assessed AND follows AND g <= -0.25
  UNION ALL SELECT entity, year, 9, 'amber', 'Turnover falling' FROM signs WHERE assessed AND follows AND g <= -0.10 AND NOT g <= -0.25
  UNION ALL SELECT entity, year, 10, 'amber', 'Margin compressing' FROM signs WHERE assessed AND follows AND m0 - pat_income >= 0.03
  UNION ALL SELECT entity, year, 11, 'amber', 'Debt outpacing turnover' FROM signs WHERE assessed AND follows AND gd > 0.25 AND gd - g > 0.25
  UNION ALL SELECT entity, year, 12, 'amber', 'Payables stretching' FROM signs WHERE assessed AND follows AND gc > 0.5 AND gc - g > 0.4)"""


UPDOWN = "if(g >= 0, 'up', 'down') || format(' {:,.0f}%', abs(g) * 100)"
#: What each flag says.
TOLD = f"""CASE seq WHEN 1 THEN 'No reconciled statement for this year' WHEN 2 THEN format('Profit before tax is {{:,.2f}} L', profit_before_tax / 100000)
  WHEN 3 THEN format('Net worth is {{:,.2f}} L - liabilities exceed assets', networth / 100000) WHEN 4 THEN format('TOL/TNW {{:,.2f}} is above 3.0', tol_tnw)
  WHEN 5 THEN format('Current ratio {{:,.2f}} is below 1.0 - current liabilities exceed current assets', current_ratio) WHEN 6 THEN format('Interest coverage {{:,.2f}}x is below 1.5x', interest_cover)
  WHEN 7 THEN format('Statement gives {{:,.2f}} L but the computation of income restates {{:,.2f}} L', profit_before_tax / 100000, book / 100000)
  WHEN 8 THEN format('Revenue down {{:,.0f}}% year on year', abs(g) * 100) WHEN 9 THEN format('Revenue down {{:,.0f}}% year on year', abs(g) * 100)
  WHEN 10 THEN format('PAT margin {{:,.1f}}% -> {{:,.1f}}%', m0 * 100, pat_income * 100) WHEN 11 THEN format('Outside liabilities up {{:,.0f}}% against revenue ', gd * 100) || {UPDOWN}
  WHEN 12 THEN format('Current liabilities up {{:,.0f}}% against revenue ', gc * 100) || {UPDOWN} || ' - possible working-capital squeeze' END"""


def growths(names: tuple[str, ...], consecutive: bool) -> str:
    """Change against an entity's column before; with ``consecutive`` only where that is the year before."""
    table = "(SELECT *, row_number() OVER (PARTITION BY entity ORDER BY year) AS k FROM vals)"
    test = "p.year = c.year - 1 AND " if consecutive else ""
    return f"SELECT c.entity, c.year, {', '.join(f'CASE WHEN {test}p.{n} <> 0 THEN (c.{n} - p.{n}) / abs(p.{n}) END AS {n}' for n in names)} FROM {table} c LEFT JOIN {table} p ON c.entity = p.entity AND c.k = p.k + 1"


SQL: dict[str, str] = {
    "map_labels": f"WITH {ledger()} SELECT entity, year, label, key, counted FROM bylabel",
    "buckets": f"WITH {ledger()} SELECT entity, year, key, sum(counted)::BIGINT AS amount FROM bylabel WHERE key IS NOT NULL AND key <> '__ignored__' GROUP BY ALL",
    "mapping_conservation": f"""WITH {ledger()} SELECT entity, year, sum(amount)::BIGINT AS harvested, coalesce(sum(amount) FILTER (key <> '__ignored__'), 0)::BIGINT AS bucketed, coalesce(sum(amount) FILTER (key IS NULL), 0)::BIGINT AS unmapped,
      coalesce(sum(amount) FILTER (key = '__ignored__'), 0)::BIGINT AS ignored, TRUE AS conserved FROM line GROUP BY entity, year""",
    "assumptions": f"WITH {ledger()} SELECT entity, year, label, key, amount, note FROM bylabel WHERE note IS NOT NULL",
    "stated_result": f"""WITH {ledger()} SELECT entity, year, label, amount, amount < 0 AS is_loss FROM line WHERE label = '[EXP] Net Profit for the year' QUALIFY row_number() OVER (PARTITION BY entity, year ORDER BY seq, amount) = 1""",
    "source_lineage": f"""WITH {ledger()}, used AS (SELECT *, row_number() OVER (PARTITION BY entity, year, key ORDER BY abs(counted) DESC, label) AS place FROM bylabel WHERE key <> '__ignored__')
      SELECT entity, year, key, place::INT AS k, label, counted AS amount, TRUE AS complete FROM used WHERE place <= 25""",
    "derived_rows": f"WITH {year_rows()} SELECT * FROM vals",
    "ratios": f"WITH {divided()} SELECT * FROM shares",
    "growth": f"WITH {year_rows()} " + growths(("sales_other_income", "gross_expenses", "profit_before_tax", "profit_after_tax", "cash_profit", "total_assets", "total_liabilities"), False),
    "trends": f"WITH {year_rows()} " + growths(("sales_other_income", "gross_expenses", "profit_before_tax", "profit_after_tax", "cash_profit", "networth", "total_assets", "total_current_liabilities"), True),
    "trends_customers": f"WITH {year_rows('o_custkey')} " + growths(("sales_other_income", "gross_expenses", "profit_before_tax", "profit_after_tax", "cash_profit", "networth", "total_assets", "total_current_liabilities"), True),
    "cagr": f"""WITH {year_rows()}, sold AS (SELECT entity, min_by(year, year) AS y0, min_by(sales_other_income, year) AS v0, max_by(year, year) AS y1, max_by(sales_other_income, year) AS v1 FROM vals WHERE sales_other_income <> 0 GROUP BY entity)
      SELECT entity, CASE WHEN y1 > y0 AND v0 > 0 AND v1 > 0 THEN round((v1 / v0) ** (1.0 / (y1 - y0)) - 1, 10) END AS cagr FROM sold""",
    "flags": f"WITH {flagged()} SELECT raised.*, {TOLD} AS detail FROM raised JOIN signs USING (entity, year)",
    "flags_customers": f"WITH {flagged('o_custkey')} SELECT raised.*, {TOLD} AS detail FROM raised JOIN signs USING (entity, year)",
}

# ---- verification: the same statements as the catalogue makes of orders, from the tables


def sheets(price: str = "l_extendedprice") -> str:
    """item: every printed line; sect: a section's name, lines, sum and printed total; sheet: what a block is."""
    listed = ", ".join(q(label) for label, *_ in LABELS)
    return f"""src AS (SELECT lineitem.*, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS place FROM lineitem),
half AS (SELECT l_orderkey AS block, place AS seq, if(l_orderkey % 4 = 0, 1, (place + 2) // 3)::INT AS section, l_partkey, l_linenumber, round_even({price}, 0)::BIGINT AS amount FROM src
         UNION ALL SELECT l_orderkey, 100 + place, 2, l_partkey, l_linenumber, round_even({price}, 0)::BIGINT FROM src WHERE l_orderkey % 4 = 0),
item AS (SELECT half.*, if(o_orderkey % 3 <> 0 AND l_linenumber % 2 = 0, 'right', 'left') AS side, ([{listed}])[(l_partkey * 7 + l_linenumber) % {len(LABELS)} + 1] AS label, [1.0, 1.0, 1.004, 1.006, NULL][o_orderkey % 5 + 1] AS off FROM half JOIN orders ON block = o_orderkey),
sheet AS (SELECT o_orderkey AS block, o_custkey AS doc, if(o_orderkey % 2 = 0, 'balance_sheet', 'profit_loss') AS kind, CASE WHEN o_orderkey % 7 = 0 THEN 1000 WHEN o_orderkey % 11 = 0 THEN 100000 ELSE 1 END AS scale,
                 round_even((SELECT sum(amount) FROM half WHERE block = o_orderkey)::DOUBLE * [1.0, 1.0, 1.004, 1.006, NULL][o_orderkey % 5 + 1], 0)::BIGINT AS printed FROM orders),
sect AS (SELECT item.block, section, kind, scale, CASE WHEN item.block % 9 = 5 THEN 'none' WHEN kind = 'balance_sheet' THEN CASE section WHEN 1 THEN 'liabilities' WHEN 2 THEN 'assets' ELSE 'none' END
                 WHEN section = 1 AND item.block % 13 <> 1 THEN 'revenue' WHEN section = 2 THEN 'expense' ELSE 'none' END AS says, count(*) AS n, sum(amount)::BIGINT AS items, round_even(sum(amount)::DOUBLE * any_value(off), 0)::BIGINT AS total
         FROM item JOIN sheet ON item.block = sheet.block GROUP BY ALL)"""


def slack(scale: str, n: str) -> str:
    return f"if({scale} <= 1, 2.0, 2 + if({scale} <= 1000, {scale} / 2.0, {scale} / 200.0) * greatest({n}, 1))"


SECTIONS = f"""{sheets()},
judged AS (SELECT *, total - items AS gap, CASE WHEN total IS NULL OR n = 1 THEN 'none' WHEN abs(total - items) > {slack("scale", "n + 1")} THEN 'fail' ELSE 'pass' END AS result FROM sect),
closed AS (SELECT *, if(result = 'fail', items, total) AS shut FROM judged),
totals AS (SELECT block, any_value(kind) AS kind, any_value({slack("scale", "2")}) AS room, list(shut ORDER BY shut DESC) FILTER (shut IS NOT NULL) AS down,
                  {", ".join(f"arg_min(shut, section) FILTER (says = '{k}' AND shut IS NOT NULL) AS {k}" for k in ("liabilities", "assets", "revenue", "expense"))} FROM closed GROUP BY block),
sound AS (SELECT block, CASE kind WHEN 'balance_sheet' THEN CASE WHEN assets IS NOT NULL AND liabilities IS NOT NULL THEN if(abs(assets - liabilities) <= room, 'sound', 'grand totals differ')
                     WHEN len(list_filter(range(1, coalesce(len(down), 0)), lambda i: down[i] - down[i + 1] <= room)) > 0 THEN 'sound' ELSE 'no grand total' END
                   ELSE if(revenue IS NULL OR expense IS NULL, 'one side', 'sound') END AS structure FROM totals),
verdict AS (SELECT block, count(*) FILTER (result = 'pass') AS passed, count(*) FILTER (result = 'fail') AS failed, any_value(structure) AS structure,
                   CASE WHEN bool_or(result = 'fail') THEN 'failed' WHEN NOT bool_or(result = 'pass') THEN 'unverified' WHEN any_value(structure) = 'sound' THEN 'verified' WHEN any_value(structure) = 'no grand total' THEN 'unverified' ELSE 'failed' END AS status,
                   bool_or(result = 'fail') AND any_value(structure) = 'sound' AND bool_and(result <> 'fail' OR abs(gap) <= 0.005 * if(total = 0, greatest(abs(items), 1), abs(total))) AS salvageable
            FROM judged JOIN sound USING (block) GROUP BY block)"""

SQL |= {
    "check_sections": f"WITH {SECTIONS} SELECT * FROM verdict",
    "section_results": f"""WITH {SECTIONS} SELECT block, section, n, items, total, gap, result, scale, kind, CASE WHEN block % 9 = 5 THEN 'Total' ELSE CASE says WHEN 'liabilities' THEN 'Total Equity and Liabilities' WHEN 'assets' THEN 'TOTAL ASSETS'
      WHEN 'revenue' THEN 'III Total Revenue (I + II)' WHEN 'expense' THEN 'IV EXPENSES :' ELSE CASE WHEN kind = 'balance_sheet' THEN 'Total current assets' WHEN section = 1 THEN 'Revenue from operations' ELSE 'Total comprehensive income' END END END AS name FROM judged""",
    "item_trust": f"""WITH {SECTIONS} SELECT item.block, seq, amount, CASE WHEN result = 'fail' THEN 'doubtful' WHEN result = 'none' OR status = 'unverified' THEN 'consistent' ELSE 'proven' END AS trust
      FROM item JOIN judged ON item.block = judged.block AND item.section = judged.section JOIN verdict ON item.block = verdict.block""",
    "check_block": f"""WITH {sheets()}, weigh AS (SELECT block, count(*) AS n, sum(amount) FILTER (side = 'left') AS l, sum(amount) FILTER (side = 'right') AS r, bool_or(regexp_matches(label, '(?i)^\\[INC\\]|revenue|\\bsales?\\b|turnover|receipts?\\b|\\bincome\\b|\\bfare\\b|freight\\s+(received|income)|commission\\s+received')) AS earns FROM item GROUP BY block),
      told AS (SELECT sheet.block, kind, n, if(n > 0, coalesce(l, 0), NULL)::BIGINT AS left_total, if(n > 0, coalesce(r, 0), NULL)::BIGINT AS right_total, printed, r IS NULL AS single, earns, {slack("scale", "coalesce(n, 0)")} AS room FROM sheet LEFT JOIN weigh USING (block)),
      why AS (SELECT *, CASE WHEN n IS NULL THEN 'no items' WHEN single THEN CASE WHEN printed IS NULL THEN 'nothing to check' WHEN kind = 'profit_loss' AND NOT earns THEN 'one-sided' WHEN abs(printed - left_total) > room THEN 'total differs' END
        WHEN abs(left_total - right_total) > room THEN 'sides differ' WHEN abs(left_total - printed) > room THEN 'total differs' END AS reason FROM told)
      SELECT block, left_total, right_total, printed, if(n IS NOT NULL AND single, coalesce(printed, left_total) - left_total, right_total - left_total) AS shortfall, reason, CASE WHEN reason IS NULL THEN 'verified' WHEN reason = 'nothing to check' THEN 'unverified' ELSE 'failed' END AS status FROM why""",
    "tolerance_units": f"WITH {sheets()} SELECT block, {slack('scale', '5')}::DOUBLE AS tol FROM sheet",
    "grand_totals": f"""WITH {sheets()}, d AS (SELECT block, any_value({slack("scale", "2")}) AS room, list(total ORDER BY total DESC) AS down FROM sect WHERE total IS NOT NULL GROUP BY block),
      e AS (SELECT *, list_filter(range(1, len(down)), lambda i: down[i] - down[i + 1] <= room) AS pos FROM d) SELECT block, len(down) AS totals, len(pos) > 0 AS agree, if(len(pos) > 0, down[pos[1]], NULL)::BIGINT AS grand_total FROM e""",
    "printed_total": f"""WITH {sheets()}, ends AS (SELECT block, section, list(amount ORDER BY seq) AS f, bool_or(label ILIKE 'total' OR label ILIKE 'total %') AS named FROM item WHERE amount <> 0 GROUP BY ALL),
      hit AS (SELECT *, len(f) > 1 AND abs(f[1] - f[-1]) <= 2 AS twice FROM ends) SELECT block, section, if(twice, f[1], list_max(f)) AS printed_total FROM hit WHERE twice OR named QUALIFY section = max(section) OVER (PARTITION BY block)""",
    "subtotal_rows": f"""WITH {sheets("l_quantity")}, ends AS (SELECT block, section, list(amount ORDER BY seq) AS f FROM item WHERE amount <> 0 GROUP BY ALL) SELECT block, section, f[1] AS amount FROM ends WHERE len(f) > 1 AND abs(f[1] - f[-1]) <= 2""",
    "subset_columns": f"""WITH RECURSIVE {sheets()}, col AS (SELECT sect.block, printed, items, row_number() OVER (PARTITION BY sect.block ORDER BY section) AS i FROM sect JOIN sheet USING (block) WHERE printed IS NOT NULL),
      sub AS (SELECT block, i, 1::BIGINT << (i - 1) AS mask, items AS total, 1 AS n, i AS last, printed FROM col UNION ALL SELECT sub.block, col.i, sub.mask + (1::BIGINT << (col.i - 1)), sub.total + col.items, sub.n + 1, col.i, col.printed FROM sub JOIN col ON sub.block = col.block AND col.i > sub.last)
      SELECT block, mask::INT AS mask, abs(total - printed)::BIGINT AS off, n::BIGINT AS n FROM sub QUALIFY row_number() OVER (PARTITION BY block ORDER BY abs(total - printed), n, last DESC, mask) = 1""",
    "joint_subset": f"""WITH RECURSIVE {sheets("l_quantity")}, col AS (SELECT block, side, section, sum(amount)::BIGINT AS v, row_number() OVER (PARTITION BY block, side ORDER BY section) AS i, count(*) OVER (PARTITION BY block, side) AS k FROM item GROUP BY block, side, section),
      sub AS (SELECT block, side, 1::BIGINT << (i - 1) AS mask, v AS total, 1 AS n, i AS last, section AS reach FROM col WHERE k <= 8 UNION ALL SELECT sub.block, sub.side, mask + (1::BIGINT << (col.i - 1)), total + v, n + 1, col.i, col.section FROM sub JOIN col ON sub.block = col.block AND sub.side = col.side AND col.i > last)
      SELECT l.block, l.mask::INT AS left_mask, r.mask::INT AS right_mask, l.total, (l.n + r.n)::BIGINT AS n FROM sub l JOIN sub r ON l.block = r.block AND l.side = 'left' AND r.side = 'right' AND abs(l.total - r.total) <= 2
      QUALIFY row_number() OVER (PARTITION BY l.block ORDER BY l.n + r.n, l.reach + r.reach DESC, l.mask, r.mask) = 1""",
    "group_expand_prefix_sum": f"""WITH {sheets("l_quantity")}, p AS (SELECT block, side, seq, amount, row_number() OVER w AS i, coalesce(lead(amount, 1) OVER w, 0) + coalesce(lead(amount, 2) OVER w, 0) AS b FROM item WINDOW w AS (PARTITION BY block, side ORDER BY seq)),
      e AS (SELECT block, side, seq, i, i % 3 = 1 AS chosen, if(i % 3 = 1 AND block % 4 <> 3, b, amount) AS amount FROM p),
      t AS (SELECT a.block, a.side, a.i, a.amount, min(j) AS taken FROM e a LEFT JOIN (SELECT c.block, c.side, c.i, j, sum(k.amount) AS run FROM e c, (VALUES (1), (2)) v(j), e k WHERE c.chosen AND k.block = c.block AND k.side = c.side AND k.i BETWEEN c.i + 1 AND c.i + j GROUP BY ALL HAVING count(*) = j) r ON a.block = r.block AND a.side = r.side AND a.i = r.i AND abs(run - a.amount) <= 2 WHERE a.chosen GROUP BY ALL)
      SELECT e.block, e.side, e.seq::BIGINT AS seq, e.amount, NOT e.chosen AS of_group FROM e JOIN t ON e.block = t.block AND e.side = t.side AND t.i = e.i - (e.i - 1) % 3 WHERE if(e.chosen, taken IS NULL, e.i <= t.i + taken)""",
}

SQL |= {
    "schedule_match": f"""WITH RECURSIVE {sheets("l_quantity")}, face AS (SELECT item.block, doc, scale, seq, amount, if(seq % 3 = 0, 'indirect', 'selling') AS word FROM item JOIN sheet ON item.block = sheet.block WHERE seq % 3 < 2),
      sched AS (SELECT doc, sect.block AS sb, section, sect.scale, [['indirect'], ['selling'], [], ['indirect', 'selling']][sect.block % 4 + 1] AS words, total FROM sect JOIN sheet ON sect.block = sheet.block WHERE total IS NOT NULL AND abs(items - total) <= greatest(2, n) * sheet.scale),
      want AS (SELECT face.block, seq, list(sb || ':' || section ORDER BY sb, section) AS offers FROM face JOIN sched ON face.doc = sched.doc AND block <> sb AND list_contains(words, word) AND abs(total - amount) <= greatest(2, face.scale, sched.scale) GROUP BY face.block, seq),
      turn AS (SELECT *, row_number() OVER (PARTITION BY block ORDER BY seq) AS i FROM want),
      step AS (SELECT block, i, seq, offers[1] AS offer, [offers[1]] AS taken FROM turn WHERE i = 1
        UNION ALL SELECT t.block, t.i, t.seq, list_filter(t.offers, lambda o: NOT list_contains(s.taken, o))[1], s.taken || list_filter(t.offers, lambda o: NOT list_contains(s.taken, o))[1:1] FROM step s JOIN turn t ON s.block = t.block AND t.i = s.i + 1)
      SELECT block, seq, offer FROM step WHERE offer IS NOT NULL""",
}

# ---- pooling: files, printings and years

FILES = """file AS (SELECT c_custkey AS doc, c_custkey // 3 AS case_id, if(c_custkey % 5 = 0, NULL, 1995 + c_custkey % 7)::INT AS ay, if(c_custkey % 2 = 0, 'Messrs ' || c_name, c_name) AS name FROM customer
         UNION ALL SELECT s_suppkey + 1000000000, (s_suppkey + 1000000000) // 3, if((s_suppkey + 1000000000) % 5 = 0, NULL, 1995 + (s_suppkey + 1000000000) % 7)::INT, s_name FROM supplier),
printing AS (SELECT o_orderkey AS okey, o_orderkey AS block, o_custkey AS doc, o_orderdate, o_orderstatus FROM orders
             UNION ALL SELECT o_orderkey, 1000000000 + o_orderkey, o_custkey + (o_orderkey % 16 = 11 AND o_custkey % 3 < 2)::INT, o_orderdate, 'O' FROM orders WHERE o_orderkey % 8 = 3),
figure AS (SELECT block, round_even(l_quantity, 0)::BIGINT * 100 + l_partkey % 20 AS amount FROM printing JOIN lineitem ON okey = l_orderkey WHERE block = okey OR l_partkey % 4 <> 1),
stmt AS (SELECT block, doc, doc // 3 AS case_id, CASE WHEN okey % 7 = 5 THEN 'capital_account' WHEN okey % 2 = 0 THEN 'balance_sheet' ELSE 'profit_loss' END AS kind,
                CASE WHEN okey % 32 = 5 THEN NULL WHEN okey % 16 = 1 THEN 'Note 35 : Lease related disclosures' WHEN okey % 8 = 1 THEN 'SHREE TRADERS, ' || (doc // 3) ELSE 'Shree Traders ' || (doc // 3) END AS entity,
                if(okey % 32 = 5, '', if(okey % 16 = 1, 'note35leaserelateddisclosures', 'shreetraders' || (doc // 3))) AS e, okey % 32 <> 5 AND okey % 16 <> 1 AS plausible,
                if(okey % 6 = 0, NULL, year(o_orderdate))::INT AS year, (okey % 23)::INT AS page, CASE o_orderstatus WHEN 'F' THEN 'verified' WHEN 'O' THEN 'unverified' ELSE 'failed' END AS status,
                okey % 3 = 0 AS salvageable, okey % 4 = 0 AS comparative, (SELECT count(*) FROM figure f WHERE f.block = printing.block) AS n_items FROM printing),
modes AS (SELECT doc, year, count(*) AS n FROM stmt WHERE year IS NOT NULL GROUP BY doc, year),
filed AS (SELECT file.doc, coalesce(arg_min(modes.year, (-n, (modes.year <> ay OR ay IS NULL)::INT, modes.year)), any_value(ay)) AS fy FROM file LEFT JOIN modes ON file.doc = modes.doc GROUP BY file.doc)"""

PLACED = f"""{FILES},
own AS (SELECT stmt.*, coalesce(year, fy) AS y, fy, list_distinct((SELECT list(amount) FROM figure f WHERE f.block = stmt.block AND amount <> 0)) AS amounts FROM stmt JOIN filed USING (doc)),
about AS (SELECT * FROM own WHERE NOT comparative AND kind <> 'capital_account' AND y = fy),
rival AS (SELECT m.block, bool_or(len(list_intersect(m.amounts, a.amounts)) > 0.5 * len(m.amounts)) AS reprint FROM own m JOIN about a ON m.case_id = a.case_id AND m.e = a.e AND m.kind = a.kind AND m.y = a.y WHERE NOT m.comparative AND m.y <> m.fy GROUP BY m.block),
settled AS (SELECT own.* EXCLUDE (year), coalesce(NOT coalesce(reprint, FALSE) AND rival.block IS NOT NULL, FALSE) AS misdated, if(rival.block IS NOT NULL AND NOT coalesce(reprint, FALSE), fy, y) AS year FROM own LEFT JOIN rival ON own.block = rival.block),
covered AS (SELECT a.block, a.doc, a.kind, a.year, EXISTS (SELECT 1 FROM settled o WHERE o.case_id = a.case_id AND o.year IS NOT DISTINCT FROM a.year AND o.kind = a.kind AND o.kind <> 'capital_account' AND NOT o.comparative AND (o.status <> 'failed' OR o.salvageable)) AS held FROM settled a WHERE comparative)"""

OVERLAP = f"""{FILES},
setof AS (SELECT stmt.*, list_distinct((SELECT list(amount) FROM figure f WHERE f.block = stmt.block AND amount <> 0)) AS amounts FROM stmt WHERE year IS NOT NULL),
pair AS (SELECT a.block, b.block AS rival, len(list_intersect(a.amounts, b.amounts)) AS shared, len(a.amounts) AS of, a.status = 'verified' AS mine, b.status = 'verified' AS theirs, a.n_items AS mine_n, b.n_items AS their_n
         FROM setof a JOIN setof b ON a.doc = b.doc AND a.e = b.e AND a.kind = b.kind AND a.year = b.year AND a.block <> b.block WHERE len(list_intersect(a.amounts, b.amounts)) > 0.5 * len(a.amounts))"""

SQL |= {
    "file_year_mode": f"WITH {FILES} SELECT doc, fy AS year FROM filed",
    "nearest_dated": f"""WITH {FILES}, d AS (SELECT u.block, s.year, s.page, abs(s.page - u.page) AS gap, s.e <> u.e AS other, (s.page > u.page OR (s.page = u.page AND s.block > u.block)) AS ahead, s.block AS sb FROM stmt u JOIN stmt s ON u.doc = s.doc WHERE u.year IS NULL AND s.year IS NOT NULL),
      f AS (SELECT block, arg_min(year, (other, gap, ahead, if(ahead, sb, -sb))) AS year, arg_min(gap, (other, gap, ahead, if(ahead, sb, -sb))) AS gap FROM d GROUP BY block) SELECT stmt.block, if(gap <= 2, f.year, NULL) AS year FROM stmt LEFT JOIN f ON stmt.block = f.block WHERE stmt.year IS NULL""",
    "main_entity": f"""WITH {FILES}, t AS (SELECT doc, entity, count(*) FILTER (status = 'verified') AS v, count(*) AS n, min(block) AS b FROM stmt WHERE plausible GROUP BY doc, entity)
      SELECT file.doc, coalesce((SELECT arg_max(entity, (v, n, -b)) FROM t WHERE t.doc = file.doc), if(name LIKE 'Messrs %', name, NULL)) AS entity FROM file""",
    "dedupe_overlap": f"WITH {OVERLAP} SELECT block, rival, shared, of FROM pair",
    "dedupe_blocks": f"WITH {OVERLAP} SELECT block, doc, kind, year FROM stmt WHERE block NOT IN (SELECT block FROM pair WHERE (theirs::INT, their_n, -rival) > (mine::INT, mine_n, -block))",
    "year_placement": f"WITH {PLACED} SELECT block, case_id, doc, kind, comparative, year, misdated FROM settled",
    "alternates_semi": f"WITH {PLACED} SELECT block, doc, kind, year FROM covered WHERE held",
    "alternates_anti": f"WITH {PLACED} SELECT block, doc, kind, year FROM covered WHERE NOT held",
    "docs_without_blocks": f"WITH {FILES} SELECT doc, ay FROM file WHERE doc NOT IN (SELECT doc FROM stmt)",
    "case_years": f"""WITH {PLACED}, g AS (SELECT case_id, year, count(*) AS n_blocks, 'statements' AS what FROM settled GROUP BY case_id, year HAVING year IS NOT NULL OR bool_or(kind <> 'capital_account' AND status <> 'failed')
      UNION ALL SELECT DISTINCT case_id, ay, 0, 'no statements' FROM file WHERE ay IS NOT NULL AND doc NOT IN (SELECT doc FROM stmt) AND NOT EXISTS (SELECT 1 FROM settled s WHERE s.case_id = file.case_id AND s.year = ay))
      SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY year NULLS LAST)::INT AS k FROM g""",
    "files_not_used": f"""WITH {PLACED} SELECT doc, 'no financial statements found in it' AS note FROM file WHERE ay IS NULL AND doc NOT IN (SELECT doc FROM stmt)
      UNION ALL SELECT DISTINCT s.doc, 'its statements could not be read or dated' FROM settled s WHERE s.year IS NULL AND NOT EXISTS (SELECT 1 FROM settled o WHERE o.case_id = s.case_id AND o.year IS NULL AND o.kind <> 'capital_account' AND o.status <> 'failed')""",
    "vision_topk": f"WITH {FILES} SELECT doc, block, page, row_number() OVER w::INT AS k FROM stmt WHERE status <> 'verified' WINDOW w AS (PARTITION BY doc ORDER BY status <> 'failed', n_items DESC, block) QUALIFY row_number() OVER w <= 6",
    "nil_detection": f"WITH {FILES} SELECT block, max(abs(amount)) AS biggest, max(abs(amount)) < 100000 AS nil FROM figure GROUP BY block",
    "cache_prune_lru": """WITH e AS (SELECT event_id AS id, event_id % 97 + 1 AS bytes, ts, ts < TIMESTAMP '2024-01-05' AS old FROM events)
      SELECT id, CASE WHEN old THEN 'expired' WHEN sum(bytes) FILTER (NOT old) OVER (ORDER BY ts DESC, id ROWS UNBOUNDED PRECEDING) > 40000 THEN 'over the cap' ELSE 'kept' END AS fate FROM e""",
    "comparative_recovery": f"""WITH {year_rows()}, c AS (SELECT entity, year, if(year % 3 = 0, NULL, total_assets) AS own, lag(total_assets) OVER (PARTITION BY entity ORDER BY year) AS printed, year % 2 = 0 OR year % 5 = 0 AS ok FROM vals)
      SELECT c.entity, c.year, c.own IS NULL AND coalesce(n.ok, FALSE) AS filled, coalesce(c.own, if(n.ok, n.printed, NULL)) AS total_assets FROM c LEFT JOIN c n ON n.entity = c.entity AND n.year = c.year + 1""",
}
#: Rows of the template that the two sides of an order's page go to.
LEFT_ROWS = ("sundry_creditors", "unsecured_loans", "secured_loan_ccod", "reserves", "deferred_tax_liability")
RIGHT_ROWS = ("debtors", "fixed_assets", "intangible_assets", "investments", "other_non_current_assets")
CASES = f"""WITH item AS (SELECT l_orderkey AS block, o_custkey AS doc, o_custkey // 3 AS case_id, year(o_orderdate)::INT AS year, ({[*LEFT_ROWS]})[l_partkey % 5 + 1] AS l, ({[*RIGHT_ROWS]})[l_suppkey % 5 + 1] AS r, round_even(l_extendedprice, 0)::BIGINT AS amount FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
page AS (SELECT block, any_value(doc) AS doc, any_value(case_id) AS case_id, any_value(year) AS year, list_distinct(list(amount)) AS amounts FROM item GROUP BY block),
fy AS (SELECT doc, arg_min(year, (-n, year)) AS fy FROM (SELECT doc, year, count(*) AS n FROM page GROUP BY doc, year) GROUP BY doc),
own AS (SELECT page.*, fy FROM page JOIN fy USING (doc)),
rival AS (SELECT m.block, bool_or(2 * len(list_intersect(m.amounts, a.amounts)) > len(m.amounts)) AS reprint FROM own m JOIN own a ON m.case_id = a.case_id AND m.year = a.year AND a.year = a.fy WHERE m.year <> m.fy GROUP BY m.block),
stays AS (SELECT own.block, own.case_id, if(reprint IS NOT NULL AND NOT reprint, fy, year) AS y FROM own LEFT JOIN rival ON own.block = rival.block),
each_line AS (SELECT stays.case_id, y, item.* EXCLUDE (case_id, year), count(*) OVER (PARTITION BY stays.block) AS n FROM stays JOIN item ON stays.block = item.block),
restated AS (SELECT e.block FROM each_line e LEFT JOIN (SELECT case_id, y, amount, max(n) AS most FROM each_line GROUP BY ALL) o ON e.case_id = o.case_id AND e.y = o.y AND e.amount = o.amount GROUP BY e.block HAVING 2 * count(*) FILTER (o.most > e.n) > count(*)),
whole AS (SELECT * FROM each_line WHERE block NOT IN (SELECT block FROM restated))
"""
SQL["case_spread"] = CASES + f"""SELECT case_id, y AS year, {", ".join(f"sum(if(l = '{k}', amount, 0))::BIGINT AS {k}" for k in LEFT_ROWS)}, {", ".join(f"sum(if(r = '{k}', amount, 0))::BIGINT AS {k}" for k in RIGHT_ROWS)},
  sum(amount)::BIGINT AS total_liabilities, sum(amount)::BIGINT AS total_assets FROM whole GROUP BY case_id, y"""

# ---- trust and checks of a year

NEAR = "greatest(1000, 0.001 * abs({0}))"
TRUST = f"""{year_rows()},
lined AS (SELECT entity, year, key, min(1 + seq % 3) AS worst FROM line WHERE key IS NOT NULL GROUP BY ALL),
grid AS (SELECT entity, year, key, CASE WHEN NOT if(key IN {RESULT_ROWS}, have_pl, have_bs) THEN 0 ELSE coalesce(worst, 2) END AS rank FROM vals CROSS JOIN (SELECT unnest({[*RESULT_ROWS, *SHEET_ROWS]}) AS key) LEFT JOIN lined USING (entity, year, key))"""
BELOW = {
    "gross_receipts": SALES, "gross_expenses": COSTS, "profit_before_tax": SALES + COSTS, "profit_after_tax": SALES + COSTS + TAXES[:2], "profit_available": SALES + COSTS + TAXES,
    "cash_profit": SALES + COSTS + TAXES, "total_liabilities": OWED, "total_assets": OWNED, "networth": OWED[:3], "total_current_liabilities": ("sundry_creditors", "current_liabilities"), "total_current_assets": ("debtors", "current_assets"),
}
LEVEL = "(['unread', 'doubtful', 'consistent', 'proven'])[{0} + 1]"


def against(name: str, gap: str, skip: str, room: str, source: str = "vals") -> str:
    return f"SELECT vals.entity, vals.year, '{name}' AS name, {gap} AS gap, CASE WHEN {skip} THEN 'skip' WHEN abs({gap}) <= {room} THEN 'pass' ELSE 'fail' END AS status FROM {source}"


SQL |= {
    "base_trust": f"WITH {TRUST} SELECT entity, year, key, {LEVEL.format('rank')} AS level FROM grid",
    "derived_trust": f"WITH {TRUST} " + " UNION ALL ".join(f"SELECT entity, year, '{k}' AS key, {LEVEL.format('min(rank)')} AS level, count(*) FILTER (rank = 1) AS doubtful FROM grid WHERE key IN {tuple(v) if len(v) > 1 else f'({q(v[0])})'} GROUP BY entity, year" for k, v in BELOW.items()),
    "chk_sheet_balances": f"WITH {year_rows()} " + against("sheet balances", "total_liabilities - total_assets", "total_liabilities IS NULL OR total_assets IS NULL OR greatest(abs(total_liabilities), abs(total_assets)) = 0", NEAR.format("greatest(abs(total_liabilities), abs(total_assets))")),
    "chk_profit_statement": f"""WITH {year_rows()}, said AS (SELECT entity, year, arg_min(amount, (seq, amount)) AS p FROM line WHERE label = '[EXP] Net Profit for the year' GROUP BY ALL)
      SELECT vals.entity, vals.year, 'profit as printed' AS name, abs(p) - abs(profit_before_tax) AS gap, CASE WHEN p IS NULL OR profit_before_tax IS NULL THEN 'skip' WHEN abs(abs(p) - abs(profit_before_tax)) <= 500 AND (p < 0) = (profit_before_tax < 0) THEN 'pass' ELSE 'fail' END AS status FROM vals LEFT JOIN said USING (entity, year)""",
    "chk_profit_computation": f"""WITH {year_rows()} SELECT entity, year, 'profit as computed for tax' AS name, CASE WHEN year % 3 = 0 THEN NULL WHEN year % 2 = 0 THEN 500 ELSE 5000 END + 0 * profit_before_tax AS gap, CASE WHEN year % 3 = 0 OR profit_before_tax IS NULL THEN 'skip' WHEN year % 2 = 0 THEN 'pass' ELSE 'fail' END AS status FROM vals""",
    "chk_section_totals": f"""WITH {year_rows()}, m AS (SELECT entity, year, sum(if(year % 4 = 0 AND n % 3 = 0, n, 0)) AS gap, bool_or(year % 4 = 0 AND n % 3 = 0) AS off FROM bylabel WHERE year % 5 <> 0 GROUP BY ALL)
      SELECT entity, year, 'section totals' AS name, gap::BIGINT AS gap, CASE WHEN off IS NULL THEN 'skip' WHEN off THEN 'fail' ELSE 'pass' END AS status FROM vals LEFT JOIN m USING (entity, year)""",
    "chk_profit_into_capital": f"""WITH {year_rows('o_custkey')}, paid AS (SELECT entity, year, count(*) AS n, max(amount) AS p FROM line WHERE label = '[EQ] Profit for the Year' AND flag <> 'R' GROUP BY ALL) """
    + against("profit into capital", "abs(p) - abs(profit_after_tax)", "n IS NULL OR n > 1 OR profit_after_tax IS NULL", NEAR.format("profit_after_tax"), "vals LEFT JOIN paid USING (entity, year)"),
}

MAIN, OTHER = "flag = 'N'", "flag <> 'N'"
NAMED_RESULT = "label = '[EXP] Net Profit for the year'"
OFF = " + ".join(f"(abs(m.{t} - o.{t}) > {NEAR.format(f'o.{t}')})::INT" for t in ("gr", "ge", "tl", "ta"))


def printing(test: str) -> str:
    total = lambda names: f"sum(if(key IN {names if len(names) > 1 else f'({q(names[0])})'}, amount, 0))"
    return f"SELECT entity, year, {total(SALES)} AS gr, {total(COSTS)} AS ge, {total(OWED)} AS tl, {total(OWNED)} AS ta FROM line WHERE {test} GROUP BY ALL"


CHECKS = f"""{TRUST}, mp AS ({printing("flag = 'N'")}), op AS ({printing("flag <> 'N'")}),
said AS (SELECT entity, year, arg_min(amount, (seq, amount)) AS p FROM line WHERE {NAMED_RESULT} GROUP BY ALL),
paid AS (SELECT entity, year, count(*) AS n, max(amount) AS p FROM line WHERE label = '[EQ] Profit for the Year' AND flag <> 'R' GROUP BY ALL),
missed AS (SELECT entity, year, sum(if(year % 4 = 0 AND n % 3 = 0, n, 0)) AS gap, bool_or(year % 4 = 0 AND n % 3 = 0) AS off FROM bylabel WHERE year % 5 <> 0 GROUP BY ALL),
tests AS (
  SELECT entity, year, 'section totals' AS name, gap::BIGINT AS gap, CASE WHEN off IS NULL THEN 'skip' WHEN off THEN 'fail' ELSE 'pass' END AS status FROM vals LEFT JOIN missed USING (entity, year)
  UNION ALL {against("sheet balances", "total_liabilities - total_assets", "total_liabilities IS NULL OR total_assets IS NULL OR greatest(abs(total_liabilities), abs(total_assets)) = 0", NEAR.format("greatest(abs(total_liabilities), abs(total_assets))"))}
  UNION ALL SELECT entity, year, 'profit as printed', abs(p) - abs(profit_before_tax), CASE WHEN p IS NULL OR profit_before_tax IS NULL THEN 'skip' WHEN abs(abs(p) - abs(profit_before_tax)) <= 500 AND (p < 0) = (profit_before_tax < 0) THEN 'pass' ELSE 'fail' END FROM vals LEFT JOIN said USING (entity, year)
  UNION ALL SELECT entity, year, 'profit as computed for tax', CASE WHEN year % 3 = 0 THEN NULL WHEN year % 2 = 0 THEN 500 ELSE 5000 END + 0 * profit_before_tax, CASE WHEN year % 3 = 0 OR profit_before_tax IS NULL THEN 'skip' WHEN year % 2 = 0 THEN 'pass' ELSE 'fail' END FROM vals
  UNION ALL {against("profit into capital", "abs(p) - abs(profit_after_tax)", "n IS NULL OR n > 1 OR profit_after_tax IS NULL", NEAR.format("profit_after_tax"), "vals LEFT JOIN paid USING (entity, year)")}
  UNION ALL SELECT m.entity, m.year, 'same year printed twice', {OFF}, if({OFF} = 0, 'pass', 'fail') FROM mp m JOIN op o ON m.entity = o.entity AND m.year = o.year)"""
PAIRS = [(k, k) for k in (*RESULT_ROWS, *SHEET_ROWS)] + [(k, x) for k, v in BELOW.items() for x in v]
SQL |= {
    "chk_same_year_twice": f"WITH {ledger()}, mp AS ({printing(MAIN)}), op AS ({printing(OTHER)}) SELECT m.entity, m.year, 'same year printed twice' AS name, ({OFF})::BIGINT AS gap, if({OFF} = 0, 'pass', 'fail') AS status FROM mp m JOIN op o ON m.entity = o.entity AND m.year = o.year",
    "all_checks": f"WITH {CHECKS} SELECT tests.entity, tests.year, name, status, gap::BIGINT AS gap, (SELECT count(*) FROM grid WHERE status = 'fail' AND grid.entity = tests.entity AND grid.year = tests.year AND rank IN (1, 2)) AS disputed FROM tests",
    "checked_trust": f"""WITH {CHECKS}, amounts AS (UNPIVOT (SELECT entity, year, {", ".join((*RESULT_ROWS, *SHEET_ROWS))} FROM vals) ON COLUMNS(* EXCLUDE (entity, year)) INTO NAME key VALUE amount),
      doubt AS (SELECT grid.entity, grid.year, grid.key, name FROM grid JOIN amounts USING (entity, year, key) JOIN tests ON grid.entity = tests.entity AND grid.year = tests.year WHERE status = 'fail' AND rank IN (1, 2) AND amount <> 0
        AND CASE name WHEN 'sheet balances' THEN key IN {SHEET_ROWS} WHEN 'section totals' THEN rank = 1 WHEN 'same year printed twice' THEN TRUE ELSE key IN {RESULT_ROWS} END),
      now AS (SELECT grid.entity, grid.year, grid.key, if(count(name) > 0, 1, any_value(rank)) AS rank, list(name) FILTER (name IS NOT NULL) AS names FROM grid LEFT JOIN doubt ON grid.entity = doubt.entity AND grid.year = doubt.year AND grid.key = doubt.key GROUP BY ALL),
      below AS (SELECT * FROM (VALUES {", ".join(f"('{a}', '{b}')" for a, b in PAIRS)}) v(up, down))
      SELECT entity, year, up AS key, {LEVEL.format('min(rank)')} AS level, if(min(rank) = 1, coalesce(array_to_string(list_sort(list_distinct(flatten(list(names) FILTER (rank = 1 AND names IS NOT NULL)))), '; '), ''), '') AS reasons FROM now JOIN below ON key = down GROUP BY entity, year, up""",
}

# ---- relevance

SHEET_WORDS, RESULT_WORDS = r"\bbalance\s*sheet\b", r"\bprof[il]t\s*(&|and)\s*loss\b|\bincome\s*(&|and)\s*expenditure\b|\btrading\s*(&|and)\s*prof[il]t\b|\breceipts?\s*(&|and)\s*payments?\b|\bstatement\s+of\s+prof[il]t\b"
TURNS = "turn_page AS (SELECT conv_id AS doc, turn AS page, if(conv_id % 5 = 3 AND turn % 3 = 0, if(turn % 2 = 0, 'BALANCE SHEET AS ON 31.03.2024', 'Profit & Loss Account') || chr(10) || '1,000.00 2,000.00 3,000.00 ' || text, text) AS text FROM conversations)"
SQL |= {
    "relevance_both_kinds_documents": f"""WITH {TURNS}, head AS (SELECT doc, trim(unnest(string_split(text, chr(10))[1:5]), ' ' || chr(9)) AS h FROM turn_page),
      seen AS (SELECT doc, bool_or(length(h) <= 80 AND regexp_matches(h, '(?i)^.{{0,10}}({SHEET_WORDS})')) AS a, bool_or(length(h) <= 80 AND regexp_matches(h, '(?i)^.{{0,10}}({RESULT_WORDS})')) AS b FROM head GROUP BY doc)
      SELECT DISTINCT turn_page.doc, coalesce(a, FALSE) AND coalesce(b, FALSE) AS has_both FROM turn_page LEFT JOIN seen ON turn_page.doc = seen.doc""",
}

# ---- harvests, geometry and sources

PLACED_LINES = "src AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS place, round_even(l_extendedprice, 0)::BIGINT AS amount FROM lineitem)"
BOX = "box AS (SELECT day(ts) AS page, user_id % 50 AS row_no, (event_id * 37 % 1000)::DOUBLE AS x0, (event_id * 37 % 1000 + 12)::DOUBLE AS x1, event_type AS text, round_even(value, 0)::BIGINT AS amount FROM events)"
INDIAN = "regexp_replace(regexp_replace(({0})::VARCHAR, '(\\d)(\\d{{3}})$', '\\1,\\2'), '(\\d)(\\d{{2}}),', '\\1,\\2,', 'g')"
SQL |= {
    "t_account_harvest": f"""WITH {PLACED_LINES}, t AS (SELECT l_orderkey, sum(amount)::BIGINT AS total FROM src GROUP BY l_orderkey)
      SELECT src.l_orderkey AS page, side, (place - 1)::INT AS seq, if(side = 'left', 'Item ' || l_partkey, 'Asset ' || l_suppkey) || ' units' AS label, amount, total AS printed, 'verified' AS status FROM src JOIN t ON src.l_orderkey = t.l_orderkey, (VALUES ('left'), ('right')) v(side)""",
    "vertical_harvest": f"""WITH {PLACED_LINES} SELECT l_orderkey AS page, 0::INT AS section, '' AS name, (place - 1)::INT AS seq, 'Item ' || l_partkey || ' units' AS label, amount, sum(amount) OVER (PARTITION BY l_orderkey)::BIGINT AS total, if(count(*) OVER (PARTITION BY l_orderkey) > 1, TRUE, NULL) AS passed FROM src""",
    "overlapping_boxes": f"""WITH {BOX}, f AS (SELECT *, lag(x0) OVER w AS p0, lag(x1) OVER w AS p1 FROM box WINDOW w AS (PARTITION BY page, row_no ORDER BY x0, x1, text)) SELECT page, row_no, x0, x1, p0, p1, p1 - x0 > 0.3 * 12 AS overlap FROM f WHERE p0 IS NOT NULL""",
    "period_right_edge": f"""WITH {BOX}, near AS (SELECT page, row_no, arg_min(x1, (abs(x0 + x1 - 1060), x1)) AS e FROM box WHERE x0 >= 760 OR x1 <= 700 GROUP BY page, row_no), l AS (SELECT page, list(e ORDER BY e) AS es FROM near GROUP BY page) SELECT page, es[len(es) // 2 + 1] AS edge FROM l""",
    "side_tags": f"""WITH {sheets()} SELECT item.block, seq::BIGINT AS seq, side, if(kind = 'profit_loss' AND label NOT LIKE '[%', if(side = 'left', '[EXP] ', '[INC] ') || label, label) AS label, amount FROM item JOIN sheet ON item.block = sheet.block""",
    "split_cells": f"""WITH src AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey, l_linenumber, {INDIAN.format("round_even(l_extendedprice, 0)::BIGINT")} AS a, {INDIAN.format("round_even(l_quantity * 1000, 0)::BIGINT")} AS b, round_even(l_extendedprice, 0)::BIGINT AS p, round_even(l_quantity * 100, 0)::BIGINT AS q FROM lineitem),
      part AS (SELECT id, l_partkey % 7 AS m, CASE l_partkey % 7 WHEN 0 THEN [a || '.00', b] WHEN 1 THEN [a || '.00', 'Furniture & Fixtures'] WHEN 2 THEN ['(' || a || ')'] WHEN 3 THEN ['Mh-12-' || (1000 + l_partkey % 9000)] WHEN 4 THEN [(1995 + l_partkey % 20)::VARCHAR] WHEN 5 THEN [p || '', q || '.50'] ELSE ['Note ' || l_linenumber] END AS ts,
                      CASE l_partkey % 7 WHEN 0 THEN [p, round_even(replace(b, ',', '')::DOUBLE, 0)] WHEN 1 THEN [p, NULL] WHEN 2 THEN [-p] WHEN 5 THEN [if(p BETWEEN 1900 AND 2100, NULL, p), q + 0.5] ELSE [NULL] END::DOUBLE[] AS vs FROM src),
      one AS (SELECT id, m, ts, vs, unnest(range(1, len(ts) + 1)) AS i FROM part), wide AS (SELECT *, CASE WHEN len(ts) = 1 THEN 1.0 ELSE (length(ts[1]) + (m <> 1)::INT)::DOUBLE / (length(ts[1]) + (m <> 1)::INT + length(ts[2])) END AS cut FROM one)
      SELECT id, if(m = 1, 1, i)::BIGINT AS k, if(m = 1, i, 1)::INT AS half, round(if(i = 1, 100, 100 + 200 * cut), 6)::DOUBLE AS x0, round(if(i = len(ts), 300, 100 + 200 * cut), 6)::DOUBLE AS x1, ts[i] AS text, vs[i] AS amount, m = 3 OR m = 6 OR (m = 1 AND i = 2) AS labelled FROM wide""",
    "ocr_words": """SELECT user_id AS page, event_id % 500 AS x0, event_id % 300 AS y0, event_id % 500 + 40 AS x1, event_id % 300 + 12 AS y1, event_type AS text FROM events WHERE event_id % 11 <> 0 AND event_id % 13 <> 0 AND event_id % 17 <> 0 AND event_id % 100 >= 30""",
    "polygon_words": """SELECT user_id AS page, (event_id % 500)::DOUBLE AS x0, (event_id % 300)::DOUBLE AS y0, (event_id % 500 + 40)::DOUBLE AS x1, (event_id % 300 + 14)::DOUBLE AS y1, event_type AS text FROM events WHERE event_id % 100 >= 50""",
    "best_rotation": """WITH t AS (SELECT conv_id AS page, turn % 4 * 90 AS angle, if(conv_id % 3 = 0 AND turn % 4 = 1, repeat('balance sheet total year ended march tax income ', 2), '') || text AS text FROM conversations WHERE text IS NOT NULL),
      s AS (SELECT page, angle, len(list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda w: w IN ('balance', 'sheet', 'profit', 'loss', 'account', 'capital', 'assets', 'liabilities', 'income', 'tax', 'total', 'year', 'ended', 'march', 'loans', 'expenses'))) AS n FROM t)
      SELECT page, if(max(n) >= 8 AND max(n) >= 3 * coalesce(max(n) FILTER (angle = 0), 0), arg_max(angle, (n, -angle)), 0)::INT AS angle FROM s GROUP BY page""",
    "learned_labels": f"""WITH {ledger()} SELECT DISTINCT label, ['sundry_creditors', NULL, 'purchases', 'debtors', 'debtors'][seq % 5 + 1] AS key FROM line WHERE seq % 5 <> 1 AND NOT regexp_matches(label, '\\d{{4}}') AND NOT ((label LIKE '[INC]%' OR label LIKE '[EXP]%') AND seq % 5 <> 2)""",
    "source_files": "SELECT sha256(encode(html)) AS doc_id, string_split(url, '/')[-1] AS source_name FROM pages WHERE html IS NOT NULL AND url IS NOT NULL",
    "sheet_formulas": f"""WITH {year_rows()}, c AS (SELECT entity, year, chr((65 + row_number() OVER (PARTITION BY entity ORDER BY year))::INT) AS c FROM vals)
      SELECT entity, year, unnest(['gross_receipts', 'gross_expenses', 'profit_before_tax', 'profit_after_tax', 'profit_available', 'cash_profit', 'total_liabilities', 'total_assets']) AS key, unnest(['IFERROR(SUM(' || c || '6:' || c || '6),0)', 'IFERROR(SUM(' || c || '8:' || c || '14),0)',
        'IFERROR(' || c || '7-' || c || '15,0)', c || '16-' || c || '17-' || c || '18', c || '19+' || c || '20', 'IFERROR(' || c || '21+' || c || '13,0)', 'SUM(' || c || '24:' || c || '34)', 'SUM(' || c || '37:' || c || '44)']) AS formula FROM c""",
}

GROUPED = INDIAN.replace("{0}", "{0}::BIGINT")
SQL |= {
    "book_profit_turns": "SELECT conv_id AS doc, min(turn)::BIGINT AS page, (conv_id * 113 + 5000) * if(conv_id % 2 = 0, -1, 1) AS profit FROM conversations WHERE turn % 4 = 1 AND text IS NOT NULL GROUP BY conv_id",
    "return_figures_turns": """SELECT conv_id AS doc, min(turn)::BIGINT AS page, conv_id * 7919 + 1000 AS current_year_business_loss, NULL::BIGINT AS gross_total_income, NULL::BIGINT AS total_income, NULL::BIGINT AS net_tax_payable, conv_id * 31 + 1000 AS taxes_paid,
      NULL::BIGINT AS tax_payable_or_refund FROM conversations WHERE turn % 4 = 0 AND text IS NOT NULL GROUP BY conv_id""",
    "owner_loans_turns": f"SELECT conv_id AS doc, turn::BIGINT AS page, 'Loans from directors (Unsecured) ' || {GROUPED.format('conv_id * 17 + 9000')} AS line FROM conversations WHERE turn % 4 = 2 AND text IS NOT NULL",
}
SQL |= {
    "comparative_totals": f"""WITH {sheets()}, named AS (SELECT block, section, says, CASE WHEN block % 9 <> 5 THEN CASE says WHEN 'revenue' THEN 'total_revenue' WHEN 'assets' THEN 'total_assets' WHEN 'liabilities' THEN 'total_equity_liabilities' END END AS anchor, total FROM sect WHERE block % 6 <> 5 AND total IS NOT NULL)
      SELECT block, {", ".join(f"max(total) FILTER (anchor = '{k}') AS {k}" for k in ("total_revenue", "total_expenses", "total_assets", "total_equity_liabilities"))} FROM named WHERE anchor IS NOT NULL GROUP BY block""",
    "divider_candidates": f"""WITH RECURSIVE {BOX}, mark AS (SELECT DISTINCT page, x0 AS x FROM box WHERE x0 BETWEEN 300 AND 700), gap AS (SELECT page, x, lead(x) OVER (PARTITION BY page ORDER BY x) AS y FROM mark),
      mid AS (SELECT page, (x + y) / 2 AS m, row_number() OVER (PARTITION BY page ORDER BY y - x DESC, (x + y) / 2) AS i FROM gap WHERE y IS NOT NULL),
      fold AS (SELECT page, 0::BIGINT AS i, [500.0::DOUBLE] AS ds FROM (SELECT DISTINCT page FROM mid) UNION ALL SELECT fold.page, mid.i, if(len(ds) < 8 AND len(list_filter(ds, lambda o: abs(m - o) < 20)) = 0, ds || [m], ds) FROM fold JOIN mid ON fold.page = mid.page AND mid.i = fold.i + 1),
      whole AS (SELECT page, arg_max(ds, i) AS ds FROM fold GROUP BY page) SELECT page, unnest(range(1, len(ds) + 1))::INT AS k, unnest(ds) AS middle FROM whole""",
}
SQL["entity_above"] = """SELECT o_orderkey AS doc, 3 AS row_no, CASE WHEN o_orderkey % 5 <> 0 THEN if(o_orderkey % 3 = 0, 'Shree Traders Pune', 'Shree Traders Road Carriers')
  WHEN o_orderkey % 4 <> 1 THEN '(Proprietor : R ' || if(o_orderkey % 2 = 0, 'Rao', 'Shah') || ')' ELSE '' END AS entity FROM orders"""
