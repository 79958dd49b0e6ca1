"""Trust of rows and the consistency checks of a year, over ``vals``, ``mapped`` and ``line_trust``."""

from __future__ import annotations

from spreadloom.plans import rules
from spreadloom.plans import template as T
from spreadloom.plans.dialect import Spark

LEVELS = ("unread", "doubtful", "consistent", "proven")
LEAVES = {
    "gross_receipts": T.INCOME,
    "gross_expenses": T.EXPENSE,
    "profit_before_tax": T.INCOME + T.EXPENSE,
    "profit_after_tax": T.INCOME + T.EXPENSE + T.TAX[:2],
    "profit_available": T.INCOME + T.EXPENSE + T.TAX,
    "cash_profit": T.INCOME + T.EXPENSE + T.TAX,
    "total_liabilities": T.LIABILITY,
    "total_assets": T.ASSET,
    "networth": ("equity_capital", "preference_shares", "reserves"),
    "total_current_liabilities": ("sundry_creditors", "current_liabilities"),
    "total_current_assets": ("debtors", "current_assets"),
}
TOLERANCE = "greatest(1000, 0.001 * abs({0}))"


def name(rank: str) -> str:
    return "CASE " + rank + " " + " ".join(f"WHEN {k} THEN '{level}'" for k, level in enumerate(LEVELS)) + " END"


def base(d: Spark):
    """The lowest trust of a row's lines; a row without lines in a read statement is consistent."""
    keys = d.list([repr(k) for k in T.INPUTS])
    return [
        ("lowest", "SELECT entity, year, key, min(rank) AS rank FROM line_trust WHERE key IS NOT NULL GROUP BY entity, year, key"),
        ("read_years", f"SELECT entity, year, have_pl, have_bs, {d.each(keys)} AS key FROM vals"),
        ("rows_of", f"SELECT entity, year, key, CASE WHEN key IN ({', '.join(map(repr, T.PL_INPUTS))}) THEN have_pl ELSE have_bs END AS have FROM read_years"),
        ("ranks", "SELECT rows_of.entity, rows_of.year, rows_of.key, CASE WHEN NOT have THEN 0 ELSE coalesce(rank, 2) END AS rank FROM rows_of LEFT JOIN lowest ON rows_of.entity = lowest.entity AND rows_of.year = lowest.year AND rows_of.key = lowest.key"),
        ("base_trust", f"SELECT entity, year, key, {name('rank')} AS level FROM ranks"),
    ]


def derived(d: Spark):
    """A derived row is as good as the worst row below it. The dependencies are fixed, so they are flattened beforehand."""
    edges = " UNION ALL ".join(f"SELECT '{k}' AS derived, '{leaf}' AS leaf" for k, leaves in LEAVES.items() for leaf in leaves)
    return [*base(d), ("edges", edges), ("derived_trust", f"SELECT entity, year, derived AS key, {name('min(rank)')} AS level, count(CASE WHEN rank = 1 THEN 1 END) AS doubtful FROM ranks JOIN edges ON ranks.key = edges.leaf GROUP BY entity, year, derived")]


def result(gap: str, allowed: str, skip: str) -> str:
    return f"CASE WHEN {skip} THEN 'skip' WHEN abs({gap}) <= {allowed} THEN 'pass' ELSE 'fail' END"


def balance(d: Spark):
    gap = "(total_liabilities - total_assets)"
    return [("balance", f"SELECT entity, year, 'sheet balances' AS name, {gap} AS gap, {result(gap, TOLERANCE.format('greatest(abs(total_liabilities), abs(total_assets))'), 'total_liabilities IS NULL OR total_assets IS NULL OR (total_liabilities = 0 AND total_assets = 0)')} AS status FROM vals")]


def against_statement(d: Spark, allowed: int = 500):
    """The profit that the statement prints, by size; its wording decides a contradiction in sign."""
    gap = "(abs(amount) - abs(profit_before_tax))"
    return [("against_statement", f"SELECT vals.entity, vals.year, 'profit as printed' AS name, {gap} AS gap, CASE WHEN amount IS NULL OR profit_before_tax IS NULL THEN 'skip' WHEN abs{gap} <= {allowed} AND NOT coalesce(is_loss <> (profit_before_tax < 0), FALSE) THEN 'pass' ELSE 'fail' END AS status FROM vals LEFT JOIN stated ON vals.entity = stated.entity AND vals.year = stated.year")]


def against_computation(d: Spark, allowed: int = 1000):
    gap = "(book_profit - profit_before_tax)"
    return [("against_computation", f"SELECT vals.entity, vals.year, 'profit as computed for tax' AS name, {gap} AS gap, {result(gap, str(allowed), 'book_profit IS NULL OR profit_before_tax IS NULL')} AS status FROM vals LEFT JOIN computed ON vals.entity = computed.entity AND vals.year = computed.year")]


PROFIT_LINE = r"\bprofit\b|\bsurplus\b|\bexcess\s+of\s+income\b"


def into_capital(d: Spark):
    """The one profit line that verified capital accounts credit must be the year's profit after tax, by size.

    ``capital_lines`` (entity, year, status, label, amount) are the lines of capital accounts.
    """
    gap = "(abs(credited) - abs(profit_after_tax))"
    return [
        ("credits", f"SELECT entity, year, count(*) AS n, max(amount) AS credited FROM capital_lines WHERE status = 'verified' AND {d.match('label', PROFIT_LINE)} GROUP BY entity, year"),
        ("into_capital", f"SELECT vals.entity, vals.year, 'profit into capital' AS name, {gap} AS gap, {result(gap, TOLERANCE.format('profit_after_tax'), 'n IS NULL OR n <> 1 OR profit_after_tax IS NULL')} AS status FROM vals LEFT JOIN credits ON vals.entity = credits.entity AND vals.year = credits.year"),
    ]


def section_totals(d: Spark):
    """The sections by which salvaged statements of a year miss their own printed totals.

    ``year_sections`` (entity, year, salvaged, result, gap) are the sections of the statements that a year uses.
    """
    return [
        ("missed", "SELECT entity, year, CAST(coalesce(sum(CASE WHEN salvaged AND result = 'fail' THEN abs(gap) END), 0) AS BIGINT) AS gap, count(CASE WHEN salvaged AND result = 'fail' THEN 1 END) AS parts FROM year_sections GROUP BY entity, year"),
        ("section_totals", "SELECT vals.entity, vals.year, 'section totals' AS name, gap, CASE WHEN parts IS NULL THEN 'skip' WHEN parts = 0 THEN 'pass' ELSE 'fail' END AS status FROM vals LEFT JOIN missed ON vals.entity = missed.entity AND vals.year = missed.year"),
    ]


def printed_twice(d: Spark):
    """The grand totals of two printings of a year."""
    totals = ("gross_receipts", "gross_expenses", "total_liabilities", "total_assets")
    side = lambda flag, to: (to, f"SELECT lines.entity, lines.year, {', '.join(f'CAST(sum(CASE WHEN key IN ({", ".join(map(repr, LEAVES[t]))}) THEN amount ELSE 0 END) AS BIGINT) AS {t}' for t in totals)} FROM lines JOIN label_keys ON lines.label = label_keys.label WHERE printing {flag} 'N' GROUP BY lines.entity, lines.year")
    off = " + ".join(f"CASE WHEN abs(m.{t} - o.{t}) <= {TOLERANCE.format(f'o.{t}')} THEN 0 ELSE 1 END" for t in totals)
    return [side("=", "main_printing"), side("<>", "other_printing"), ("printed_twice", f"SELECT m.entity, m.year, 'same year printed twice' AS name, CAST({off} AS BIGINT) AS gap, CASE WHEN {off} = 0 THEN 'pass' ELSE 'fail' END AS status FROM main_printing AS m JOIN other_printing AS o ON m.entity = o.entity AND m.year = o.year")]


#: Checks in the order in which reasons are listed, and the rows that each may blame.
BLAMED = {
    "profit as computed for tax": "pl", "profit as printed": "pl", "profit into capital": "pl", "same year printed twice": "TRUE", "section totals": "rank = 1", "sheet balances": "NOT pl",
}


def checked(d: Spark):
    """The trust of every row after the checks, over ``ranks`` and ``all_checks``, with why it is doubted.

    A failing check makes the rows that it may blame doubtful (read, not zero and not proven ones); a derived row is as good
    as the worst row below it, and is doubted for the reasons of the doubtful ones. A year's failures are one row, and base
    rows depend on themselves, so that every relation is read once.
    """
    amounts = "CASE key " + " ".join(f"WHEN '{k}' THEN {k}" for k in T.INPUTS) + " END"
    failures = ", ".join(f"max(CASE WHEN name = '{n}' AND status = 'fail' THEN 1 ELSE 0 END) AS f{k}" for k, n in enumerate(BLAMED))
    hits = ", ".join(f"CASE WHEN coalesce(f{k}, 0) = 1 AND open AND ({who}) THEN 1 ELSE 0 END AS h{k}" for k, who in enumerate(BLAMED.values()))
    some = " + ".join(f"h{k}" for k in range(len(BLAMED)))
    pairs = [(k, k) for k in T.INPUTS] + [(k, leaf) for k, leaves in LEAVES.items() for leaf in leaves]
    edges = d.list([f"'{k}>{leaf}'" for k, leaf in pairs])
    reasons = d.joined(d.kept(d.list([f"CASE WHEN max(CASE WHEN rank = 1 THEN h{k} ELSE 0 END) = 1 THEN '{n}' ELSE '' END" for k, n in enumerate(BLAMED)]), "e <> ''"), "; ")
    return [
        ("year_failures", f"SELECT entity, year, {failures} FROM all_checks GROUP BY entity, year"),
        ("long_keys", f"SELECT *, {d.each(d.list([repr(k) for k in T.INPUTS]))} AS key FROM vals"),
        ("long_vals", f"SELECT entity, year, key, {amounts} AS amount FROM long_keys"),
        ("open_rows", f"SELECT ranks.entity, ranks.year, ranks.key, rank, rank IN (1, 2) AND coalesce(amount, 0) <> 0 AS open, ranks.key IN ({', '.join(map(repr, T.PL_INPUTS))}) AS pl FROM ranks JOIN long_vals ON ranks.entity = long_vals.entity AND ranks.year = long_vals.year AND ranks.key = long_vals.key"),
        ("hit_rows", f"SELECT open_rows.entity, open_rows.year, key, rank, {hits} FROM open_rows LEFT JOIN year_failures ON open_rows.entity = year_failures.entity AND open_rows.year = year_failures.year"),
        ("settled_ranks", f"SELECT entity, year, key, CASE WHEN {some} > 0 THEN 1 ELSE rank END AS rank, {', '.join(f'h{k}' for k in range(len(BLAMED)))} FROM hit_rows"),
        ("dependencies", f"SELECT {d.extract('e', '^(.*)>', 1)} AS derived, {d.extract('e', '>(.*)$', 1)} AS leaf FROM (SELECT {d.each(edges)} AS e) AS x"),
        ("checked", f"SELECT entity, year, derived AS key, {name('min(rank)')} AS level, CASE WHEN min(rank) = 1 THEN {reasons} ELSE '' END AS reasons FROM settled_ranks JOIN dependencies ON key = leaf GROUP BY entity, year, derived"),
    ]
