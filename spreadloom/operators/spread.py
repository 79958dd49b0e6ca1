"""Lines -> mapped lines -> buckets -> values -> ratios -> growth -> flags, as named relations.

Each function gives the SQL of one relation over relations named before it. Labels are mapped once each and joined back;
lines are summed by label first, on the map side too; labels are taken from those sums, so the tables are scanned once.
"""

from __future__ import annotations

from spreadloom.plans import rules
from spreadloom.plans import template as T
from spreadloom.plans.dialect import Spark

Relations = list[tuple[str, str]]


def mapped(d: Spark, lines: str = "lines") -> Relations:
    return [
        ("by_label", f"SELECT entity, year, label, CAST(sum(amount) AS BIGINT) AS amount, CAST(sum(abs(amount)) AS BIGINT) AS size, count(*) AS n FROM {lines} GROUP BY entity, year, label"),
        # the count keeps the rules above the grouping: a filter on the key would otherwise run them on every line
        ("label_keys", f"SELECT label, CASE WHEN uses > 0 THEN {rules.map_label(d, 'label')} END AS key FROM (SELECT label, count(*) AS uses FROM by_label GROUP BY label) AS s"),
        ("mapped", f"SELECT entity, year, by_label.label, key, amount, n, CASE WHEN {d.match('by_label.label', rules.CLOSING_STOCK)} THEN -size ELSE amount END AS counted FROM by_label JOIN label_keys ON by_label.label = label_keys.label"),
    ]


def buckets(d: Spark) -> Relations:
    return [*mapped(d), ("buckets", f"SELECT entity, year, key, CAST(sum(counted) AS BIGINT) AS amount FROM mapped WHERE key IS NOT NULL AND key <> '{rules.IGNORED}' GROUP BY entity, year, key")]


def kind_of(key: str) -> str:
    return f"{key} IN ({', '.join(repr(k) for k in T.PL_INPUTS)})"


def derived(d: Spark) -> Relations:
    sums = ", ".join(f"CAST(sum(CASE WHEN key = '{k}' THEN amount END) AS BIGINT) AS b_{k}" for k in T.INPUTS)
    g = lambda keys: " + ".join(f"coalesce(b_{k}, 0)" for k in keys)
    formulas = {
        "gross_receipts": g(T.INCOME),
        "gross_expenses": g(T.EXPENSE),
        "profit_before_tax": f"{g(T.INCOME)} - ({g(T.EXPENSE)})",
        "profit_after_tax": f"{g(T.INCOME)} - ({g(T.EXPENSE)}) - ({g(T.TAX[:2])})",
        "profit_available": f"{g(T.INCOME)} - ({g(T.EXPENSE)}) - ({g(T.TAX)})",
        "cash_profit": f"{g(T.INCOME)} - ({g(T.EXPENSE)}) - ({g(T.TAX[:2])}) + {g(['depreciation'])}",
        "total_liabilities": g(T.LIABILITY),
        "total_assets": g(T.ASSET),
        "networth": g(["equity_capital", "preference_shares", "reserves"]),
        "total_current_liabilities": g(["sundry_creditors", "current_liabilities"]),
        "total_current_assets": g(["debtors", "current_assets"]),
    }
    # an unread statement gives NULL, an absent line of a read one 0
    rows = [f"CASE WHEN {'have_pl' if k in T.PL_KEYS else 'have_bs'} THEN {formulas.get(k) or f'coalesce(b_{k}, 0)'} END AS {k}" for k in T.KEYS]
    return [
        ("sums", f"SELECT entity, year, coalesce(max(CASE WHEN {kind_of('key')} THEN 1 END), 0) = 1 AS have_pl, coalesce(max(CASE WHEN NOT ({kind_of('key')}) THEN 1 END), 0) = 1 AS have_bs, {sums} FROM buckets GROUP BY entity, year"),
        ("vals", f"SELECT entity, year, have_pl, have_bs, {', '.join(rows)} FROM sums"),
    ]


def read(expression: str) -> str:
    """The expression with NULL read as 0, as ratios do."""
    import re

    return re.sub(r"\b([a-z][a-z_0-9]+)\b", r"coalesce(\1, 0)", expression)


def ratios(d: Spark) -> Relations:
    columns = ", ".join(f"{d.div(f'({read(top)})', f'({read(below)})')}{factor} AS {name}" for name, _, top, below, factor in T.RATIOS)
    return [("ratios", f"SELECT entity, year, {columns} FROM vals")]


def snap(d: Spark) -> Relations:
    return [("snap", "SELECT entity, year, " + ", ".join(f"{read(e)} AS {n}" for n, e in T.SNAP) + " FROM vals")]


def change(d: Spark, now: str, before: str) -> str:
    return d.div(f"({now} - {before})", f"abs({before})")


def growth(d: Spark) -> Relations:
    """Against the column before, whatever its year, as the sheet does; the analysis' trends need the year before."""
    w = "OVER (PARTITION BY entity ORDER BY year)"
    return [
        ("lagged", f"SELECT entity, year, year - lag(year) {w} = 1 AS next, " + ", ".join(f"{k}, lag({k}) {w} AS p_{k}" for k in dict.fromkeys(T.GROWTH + T.TRENDS)) + " FROM vals"),
        ("growth", "SELECT entity, year, " + ", ".join(f"{change(d, k, f'p_{k}')} AS {k}" for k in T.GROWTH) + " FROM lagged"),
        ("trends", "SELECT entity, year, " + ", ".join(f"CASE WHEN next THEN {change(d, k, f'p_{k}')} END AS {k}" for k in T.TRENDS) + " FROM lagged"),
    ]


def cagr(d: Spark, key: str = "sales_other_income") -> Relations:
    return [
        ("points", f"SELECT entity, year, {key} AS v, row_number() OVER (PARTITION BY entity ORDER BY year) AS k, row_number() OVER (PARTITION BY entity ORDER BY year DESC) AS r FROM vals WHERE {key} <> 0"),
        ("ends", "SELECT entity, max(CASE WHEN k = 1 THEN year END) AS y0, max(CASE WHEN k = 1 THEN v END) AS v0, max(CASE WHEN r = 1 THEN year END) AS y1, max(CASE WHEN r = 1 THEN v END) AS v1 FROM points GROUP BY entity"),
        ("cagr", "SELECT entity, CASE WHEN y1 > y0 AND v0 > 0 AND v1 > 0 THEN round(power(v1 / CAST(v0 AS DOUBLE), 1.0 / (y1 - y0)) - 1, 10) END AS cagr FROM ends"),
    ]


#: Thresholds of the flags.
TOL_TNW, CURRENT_RATIO, COVER, DROP_AMBER, DROP_RED, MARGIN, CONTRADICTION = 3.0, 1.0, 1.5, -0.10, -0.25, 0.03, 1000


def flags(d: Spark, assessed: str = "TRUE", book_profit: str = "CAST(NULL AS BIGINT)") -> Relations:
    """One row for each flag, with what it says. ``assessed`` says whether a statement was used, ``book_profit`` is the computation's profit.

    The rules are a list of conditions over one windowed pass; every row meets a constant list of rule numbers.
    """
    w = "OVER (PARTITION BY entity ORDER BY year)"
    needed = ("profit_before_tax", "profit_after_tax", "networth", "total_assets", "interest_finance")
    debt = "nullif(coalesce(total_liabilities, 0) - coalesce(networth, 0), 0)"
    rows = f"""SELECT vals.entity, vals.year, {assessed} AS assessed, {book_profit} AS book_profit, {', '.join(needed)},
        tol_tnw, current_ratio, interest_cover, pat_income, year - lag(year) {w} = 1 AS next, lag(pat_income) {w} AS p_margin,
        {change(d, 'sales_other_income', f'lag(sales_other_income) {w}')} AS g, {change(d, debt, f'lag({debt}) {w}')} AS gd,
        {change(d, 'total_current_liabilities', f'lag(total_current_liabilities) {w}')} AS gcl FROM joined AS vals"""
    lakh = lambda x: f"concat({d.fixed(f'{x} / CAST(100000 AS DOUBLE)', 2)}, ' L')"
    share = lambda x, places=0: f"concat({d.fixed(f'({x}) * 100', places)}, '%')"
    turn = f"CASE WHEN g >= 0 THEN 'up ' ELSE 'down ' END, {share('abs(g)')}"
    details = (
        "'No reconciled statement for this year'",
        f"concat('Profit before tax is ', {lakh('profit_before_tax')})",
        f"concat('Net worth is ', {lakh('networth')}, ' - liabilities exceed assets')",
        f"concat('TOL/TNW ', {d.fixed('tol_tnw', 2)}, ' is above {TOL_TNW}')",
        f"concat('Current ratio ', {d.fixed('current_ratio', 2)}, ' is below {CURRENT_RATIO} - current liabilities exceed current assets')",
        f"concat('Interest coverage ', {d.fixed('interest_cover', 2)}, 'x is below {COVER}x')",
        f"concat('Statement gives ', {lakh('profit_before_tax')}, ' but the computation of income restates ', {lakh('book_profit')})",
        f"concat('Revenue down ', {share('abs(g)')}, ' year on year')",
        f"concat('Revenue down ', {share('abs(g)')}, ' year on year')",
        f"concat('PAT margin ', {share('p_margin', 1)}, ' -> ', {share('pat_income', 1)})",
        f"concat('Outside liabilities up ', {share('gd')}, ' against revenue ', {turn})",
        f"concat('Current liabilities up ', {share('gcl')}, ' against revenue ', {turn}, ' - possible working-capital squeeze')",
    )
    table = (
        ("Not assessable", "amber", "NOT assessed"),
        ("Loss-making", "red", "assessed AND profit_before_tax < 0"),
        ("Net worth eroded", "red", "assessed AND networth <= 0 AND total_assets <> 0"),
        ("High leverage", "red", f"assessed AND tol_tnw > {TOL_TNW} AND networth > 0"),
        ("Weak liquidity", "amber", f"assessed AND current_ratio < {CURRENT_RATIO}"),
        ("Thin interest cover", "CASE WHEN interest_cover < 1 THEN 'red' ELSE 'amber' END", f"assessed AND interest_cover < {COVER} AND interest_finance <> 0"),
        ("Profit contradicts tax computation", "red", f"assessed AND (book_profit < 0) <> (profit_before_tax < 0) AND abs(profit_before_tax) > {CONTRADICTION}"),
        ("Turnover falling sharply", "red", f"assessed AND next AND g <= {DROP_RED}"),
        ("Turnover falling", "amber", f"assessed AND next AND g > {DROP_RED} AND g <= {DROP_AMBER}"),
        ("Margin compressing", "amber", f"assessed AND next AND p_margin - pat_income >= {MARGIN}"),
        ("Debt outpacing turnover", "amber", "assessed AND next AND gd - g > 0.25 AND gd > 0.25"),
        ("Payables stretching", "amber", "assessed AND next AND gcl > 0.5 AND gcl - g > 0.4"),
    )
    fired = " ".join(f"WHEN {k} THEN {c}" for k, (_, _, c) in enumerate(table, 1))
    names = " ".join(f"WHEN {k} THEN '{n}'" for k, (n, _, _) in enumerate(table, 1))
    told = " ".join(f"WHEN {k} THEN {x}" for k, x in enumerate(details, 1))
    colours = " ".join(f"WHEN {k} THEN {s if s.startswith('CASE') else repr(s)}" for k, (_, s, _) in enumerate(table, 1))
    return [
        ("joined", f"SELECT vals.*, {', '.join(n for n, *_ in T.RATIOS)} FROM vals JOIN ratios ON vals.entity = ratios.entity AND vals.year = ratios.year"),
        ("signals", rows),
        ("numbered", f"SELECT *, {d.each(d.series('1', str(len(table))))} AS rule FROM signals"),
        ("flags", f"SELECT entity, year, CAST(rule AS INT) AS seq, CASE rule {colours} END AS severity, CASE rule {names} END AS flag, CASE rule {told} END AS detail FROM numbered WHERE CASE rule {fired} END"),
    ]


def conservation(d: Spark) -> Relations:
    """Bucketed + unmapped + ignored = harvested, for every entity and year (tolerance 2)."""
    return [
        (
            "conservation",
            f"""SELECT entity, year, CAST(sum(amount) AS BIGINT) AS harvested, CAST(coalesce(sum(CASE WHEN key IS NOT NULL AND key <> '{rules.IGNORED}' THEN amount END), 0) AS BIGINT) AS bucketed,
          CAST(coalesce(sum(CASE WHEN key IS NULL THEN amount END), 0) AS BIGINT) AS unmapped, CAST(coalesce(sum(CASE WHEN key = '{rules.IGNORED}' THEN amount END), 0) AS BIGINT) AS ignored FROM mapped GROUP BY entity, year""",
        ),
        ("checked", "SELECT *, abs(harvested - bucketed - unmapped - ignored) <= 2 AS conserved FROM conservation"),
    ]


def stated(d: Spark, lines: str = "lines") -> Relations:
    """The first line of each entity and year that names the statement's own result, and whether it names a loss."""
    low = "lower(lines.label)"
    return [
        ("named", f"SELECT lines.entity, lines.year, seq, lines.label, amount, row_number() OVER (PARTITION BY entity, year ORDER BY seq) AS k FROM {lines} AS lines JOIN label_keys ON lines.label = label_keys.label WHERE key = '{rules.IGNORED}' AND {d.match('lines.label', rules.RESULT)}"),
        (
            "stated",
            f"""SELECT entity, year, label, amount, CASE WHEN {low} LIKE '%profit%' AND {d.match('label', r'\bloss\b')} THEN CASE WHEN amount < 0 THEN TRUE END
          WHEN {d.match('label', r'\bloss\b')} THEN TRUE WHEN {low} LIKE '%profit%' THEN amount < 0 END AS is_loss FROM named AS lines WHERE k = 1""",
        ),
    ]


def assumed(d: Spark) -> Relations:
    note = rules.first_of(d, "label", rules.CONVENTIONS)
    return [("assumed", f"SELECT entity, year, label, key, amount, {note} AS note FROM mapped WHERE key IS NOT NULL AND key <> '{rules.IGNORED}' AND {note} IS NOT NULL")]


def lineage(d: Spark, most: int = 25) -> Relations:
    """Up to ``most`` source lines of each figure, largest first, and whether all of them total to it within a rupee."""
    return [
        ("parts", f"SELECT mapped.entity, mapped.year, mapped.key, label, counted, row_number() OVER (PARTITION BY mapped.entity, mapped.year, mapped.key ORDER BY abs(counted) DESC, label) AS k, sum(counted) OVER (PARTITION BY mapped.entity, mapped.year, mapped.key) AS total, buckets.amount FROM mapped JOIN buckets ON mapped.entity = buckets.entity AND mapped.year = buckets.year AND mapped.key = buckets.key"),
        ("lineage", f"SELECT entity, year, key, CAST(k AS INT) AS k, label, counted AS amount, abs(total - amount) <= 1 AS complete FROM parts WHERE k <= {most}"),
    ]


#: An untagged line that is a tax, an owner's capital account.
TAX_LINE = r"^\s*(?:\(\d\)\s*)?(current\s+(?:tax|year)|deferred\s+tax|tax\s+expenses?|income\s+tax)\s*$"
CAPITAL_LINE = r"\bcapital\s+a/?c(?:count)?\b|(?:proprietor|partners?|owner)'?s?\s+capital"


def tax_recovery(d: Spark) -> Relations:
    """Untagged tax lines of a year without a tax bucket count when they are positive and below the profit; the rows below follow."""
    return [
        ("taxless", "SELECT entity, year, profit_before_tax, preference_dividend, depreciation FROM vals WHERE have_pl AND coalesce(provision_tax, 0) = 0 AND coalesce(provision_deferred_tax, 0) = 0"),
        ("found_tax", f"SELECT l.entity, l.year, CASE WHEN lower(label) LIKE '%deferred%' THEN amount END AS deferred, CASE WHEN lower(label) NOT LIKE '%deferred%' THEN amount END AS own FROM untagged AS l JOIN taxless ON l.entity = taxless.entity AND l.year = taxless.year WHERE {d.match('label', TAX_LINE)} AND amount > 0 AND amount < profit_before_tax"),
        ("taxes", "SELECT entity, year, CAST(coalesce(sum(own), 0) AS BIGINT) AS provision_tax, CAST(coalesce(sum(deferred), 0) AS BIGINT) AS provision_deferred_tax FROM found_tax GROUP BY entity, year"),
        ("recovered", "SELECT taxes.*, profit_before_tax, profit_before_tax - provision_tax - provision_deferred_tax AS profit_after_tax, profit_before_tax - provision_tax - provision_deferred_tax - preference_dividend AS profit_available, profit_before_tax - provision_tax - provision_deferred_tax + depreciation AS cash_profit FROM taxes JOIN taxless ON taxes.entity = taxless.entity AND taxes.year = taxless.year"),
    ]


def untaxed(d: Spark, status: str) -> Relations:
    """A profit-making taxed entity without a tax line has no profit after tax worth stating."""
    nulls = ", ".join(f"CASE WHEN untaxed THEN NULL ELSE {k} END AS {k}" for k in ("profit_after_tax", "profit_available", "cash_profit"))
    return [
        ("marked", f"SELECT *, have_pl AND profit_before_tax > 0 AND coalesce(provision_tax, 0) = 0 AND coalesce(provision_deferred_tax, 0) = 0 AND lower({status}) IN ('company', 'firm', 'llp', 'aop', 'boi') AS untaxed FROM vals"),
        ("untaxed", f"SELECT entity, year, untaxed, profit_before_tax, {nulls} FROM marked"),
    ]


def debit_capital(d: Spark) -> Relations:
    """A capital line on the assets side of a two-sided balance sheet is negative equity; sections and other kinds stay."""
    moved = f"kind = 'balance_sheet' AND section IS NULL AND side = 'right' AND {d.match('label', CAPITAL_LINE)}"
    return [("moved", f"SELECT entity, year, seq, CASE WHEN {moved} THEN concat('[EQ] ', label, ' (debit balance)') ELSE label END AS label, CASE WHEN {moved} THEN -amount ELSE amount END AS amount FROM sided")]


def reclassed(d: Spark) -> Relations:
    """Generic long-term borrowings move to unsecured loans where an owners' note prints the amount.

    ``notes`` (entity, line) are lines about owners' loans. A number of a line is the amount in rupees, thousands or lakhs,
    of four digits at least, or that with two zeros of paise after it.
    """
    generic = d.match("label", r"^\s*long[\s-]*term\s+borrowings?\s*$")
    text = "STRING" if d.name == "spark" else "VARCHAR"
    units = d.list(["1", "1000", "100000"])
    return [
        ("generic", f"SELECT entity, year, CAST(sum(amount) AS BIGINT) AS amount FROM by_label WHERE {generic} GROUP BY entity, year"),
        ("in_units", f"SELECT *, {d.each(units)} AS unit FROM generic WHERE amount <> 0"),
        ("forms", f"SELECT entity, year, amount, CAST(CAST(floor(abs(amount) / unit) AS BIGINT) AS {text}) AS form FROM in_units WHERE abs(amount) % unit = 0 AND abs(amount) / unit >= 1000"),
        ("tokens", f"SELECT entity, {d.each(d.hits('line', r'\d[\d,]*'))} AS token FROM notes"),
        ("numbers", "SELECT DISTINCT entity, replace(token, ',', '') AS digits FROM tokens"),
        ("confirmed", "SELECT DISTINCT forms.entity, year, amount FROM forms JOIN numbers ON forms.entity = numbers.entity WHERE digits = form OR digits LIKE concat(form, '00%')"),
        ("moves", "SELECT entity, year, 'secured_loan_asset_financed' AS key, -amount AS amount FROM confirmed UNION ALL SELECT entity, year, 'unsecured_loans' AS key, amount FROM confirmed"),
        ("reclassed", "SELECT entity, year, key, CAST(sum(amount) AS BIGINT) AS amount FROM (SELECT entity, year, key, amount FROM buckets UNION ALL SELECT entity, year, key, amount FROM moves) AS s GROUP BY entity, year, key"),
    ]
