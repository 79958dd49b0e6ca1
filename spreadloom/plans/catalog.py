"""Registered queries of the statement engine and their DuckDB counterparts."""

from __future__ import annotations

import re
from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from spreadloom import sinks
from spreadloom.functions import scalars
from spreadloom.operators import grouped, layout, pooling, relevance, spread, trust, verification
from spreadloom.operators import statements as reading
from spreadloom.plans import fixtures, ledger, oracles, pipeline, rules
from spreadloom.plans.dialect import DUCK, SPARK, Spark
from spreadloom.sources import cache, documents

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations")
Plan = Callable[[Spark], list[tuple[str, str]]]


def statement(plan: Plan, d: Spark) -> str:
    """The plan's relations as one statement; the last one is the result."""
    relations = plan(d)
    return "WITH " + ",\n".join(f"{name} AS ({sql})" for name, sql in relations) + f"\nSELECT * FROM {relations[-1][0]}"


def runner(plan: Plan) -> Callable[[SparkSession, str], DataFrame]:
    text = statement(plan, SPARK).removeprefix("WITH ")
    used = [t for t in TABLES if re.search(rf"\b(FROM|JOIN) {t}\b", text)]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        # views of names of their own, so that a caller's views of these names stay
        tag, views = uuid4().hex[:12], []
        for table in used:
            spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(f"v_{table}_{tag}")
            views.append(f"{table} AS (SELECT * FROM v_{table}_{tag})")
        return spark.sql("WITH " + ", ".join([*views, text]))

    return run


def lines(d: Spark, entity: str = "n_name"):
    return [("lines", ledger.lines(d, entity))]


def upto(*steps, entity: str = "n_name") -> Plan:
    return lambda d: lines(d, entity) + [r for step in steps for r in step(d)]


def only(plan: Plan, columns: str) -> Plan:
    """Columns of the plan's last relation."""

    def run(d: Spark):
        relations = plan(d)
        return [*relations, ("result", f"SELECT {columns} FROM {relations[-1][0]}")]

    return run


#: Lines of an order, in an order of their own.
NUMBERED = ("numbered", "SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS place FROM lineitem")
BASE = (spread.buckets, spread.derived)
#: Some years used no statement; the computation's profit is theirs or its opposite, or missing.
ASSESSED = ("vals.year % 7 <> 1", "CASE vals.year % 3 WHEN 0 THEN profit_before_tax WHEN 1 THEN -profit_before_tax END")
PLANS: dict[str, Plan] = {
    "ledger_lines": upto(),
    "map_labels": only(upto(spread.mapped), "entity, year, label, key, counted"),
    "buckets": upto(spread.buckets),
    "mapping_conservation": upto(spread.mapped, spread.conservation),
    "stated_result": upto(spread.mapped, spread.stated),
    "assumptions": upto(spread.mapped, spread.assumed),
    "source_lineage": upto(spread.buckets, spread.lineage),
    "derived_rows": upto(*BASE),
    "ratios": upto(*BASE, spread.ratios),
    "snap": upto(*BASE, spread.snap),
    "growth": only(upto(*BASE, lambda d: spread.growth(d)[:2]), "*"),
    "trends": upto(*BASE, spread.growth),
    "trends_customers": upto(*BASE, spread.growth, entity="o_custkey"),
    "cagr": upto(*BASE, spread.cagr),
    "flags": upto(*BASE, spread.ratios, lambda d: spread.flags(d, *ASSESSED)),
    "flags_customers": upto(*BASE, spread.ratios, lambda d: spread.flags(d, *ASSESSED), entity="o_custkey"),
    "flag_summary": only(upto(*BASE, spread.ratios, spread.flags, spread.cagr, lambda d: [("summary", "SELECT cagr.entity, max(cagr) AS revenue_cagr, count(CASE WHEN severity = 'red' THEN 1 END) AS red, count(CASE WHEN severity = 'amber' THEN 1 END) AS amber FROM cagr LEFT JOIN flags ON cagr.entity = flags.entity GROUP BY cagr.entity")]), "*"),
    "tax_recovery": upto(lambda d: [("untagged", "SELECT entity, year, 'Income tax' AS label, CAST(floor(amount / 10) AS BIGINT) AS amount FROM lines WHERE label = 'Suspense account' UNION ALL SELECT entity, year, 'Deferred Tax', CAST(floor(amount / 20) AS BIGINT) FROM lines WHERE label = 'Branch adjustment'")], *BASE, spread.tax_recovery, entity="o_custkey"),
    "untaxed_null": upto(*BASE, lambda d: spread.untaxed(d, "CASE WHEN year % 2 = 0 THEN 'Company' ELSE 'Individual' END"), entity="o_custkey"),
    "capital_debit_balance": upto(lambda d: [("sided", "SELECT entity, year, seq, CASE WHEN label = 'Furniture' THEN 'Partners Capital A/c' ELSE label END AS label, amount, CASE WHEN seq % 3 = 0 THEN 'right' ELSE 'left' END AS side, CASE WHEN seq % 4 < 2 THEN 'balance_sheet' ELSE 'profit_loss' END AS kind, CASE WHEN seq % 5 = 4 THEN 1 END AS section FROM lines")], spread.debit_capital),
    "borrowings_reclass": upto(spread.buckets, lambda d: [("notes", f"SELECT entity, concat('Loans from directors (unsecured) note 12 ', CAST(amount AS {'STRING' if d.name == 'spark' else 'VARCHAR'}), CASE WHEN year % 2 = 0 THEN '00' ELSE '' END, ' and 4,321') AS line FROM by_label WHERE label = 'Long Term Borrowings' AND year % 3 <> 1")], spread.reclassed),
}


def literal(rows: list[tuple], names: str, select: Callable[[Spark], dict[str, str] | str], name: str = "given") -> Plan:
    def plan(d: Spark):
        chosen = select(d)
        text = chosen if isinstance(chosen, str) else ", ".join(f"{e} AS {n}" for n, e in chosen.items())
        return [(name, ledger.values(d, rows, names)), ("result", f"SELECT {text} FROM {name}")]

    return plan


def pages(step: Callable) -> Plan:
    return lambda d: [("pages_in", ledger.values(d, fixtures.PAGES, "doc, page, text")), *step(d)]


def documents_as_pages(step: Callable) -> Plan:
    """Conversations as documents, their turns as pages; a turn of every fifth is headed as a statement with figures."""
    return lambda d: [("pages_in", f"SELECT conv_id AS doc, CAST(turn AS BIGINT) AS page, CASE WHEN conv_id % 5 = 3 AND turn % 3 = 0 THEN concat(CASE WHEN turn % 2 = 0 THEN 'BALANCE SHEET AS ON 31.03.2024' ELSE 'Profit & Loss Account' END, {d.newline}, '1,000.00 2,000.00 3,000.00 ', text) ELSE text END AS text FROM conversations"), *step(d)]


def text_lines(d: Spark):
    return f"(SELECT doc, page, {d.each(d.lines('text'))} AS line FROM given)"


PLANS |= {
    "parse_indian_int": literal(fixtures.NUMBERS, "k, s", lambda d: {"k": "k", "n": scalars.to_int(d, "s")}),
    "clean_amount": literal(fixtures.NUMBERS, "k, s", lambda d: {"k": "k", "n": scalars.clean_amount(d, "s")}),
    "parse_line": literal(fixtures.LINES, "k, s", lambda d: {"k": "k", "label": scalars.line_label(d, "s"), "amount": scalars.line_amount(d, "s"), "kind": scalars.row_kind(d, "s")}),
    "map_labels_wording": literal(fixtures.LABELS, "label, expected", lambda d: {"label": "label", "expected": "expected", "key": rules.map_label(d, "label"), "norm": rules.normal_label(d, "label"), "note": rules.first_of(d, "label", rules.CONVENTIONS)}),
    "headings": literal(fixtures.HEADINGS, "k, s", lambda d: {"k": "k", "title": scalars.is_title(d, "s"), "address": scalars.is_address(d, "s"), "business": scalars.is_business(d, "s"), "section": rules.first_of(d, "s", rules.SECTIONS)}),
    "fy_end_year": literal(fixtures.HEADINGS, "k, s", lambda d: {"k": "k", "year": scalars.period_year(d, "s")}),
    "unit_scale": literal(fixtures.HEADINGS, "k, s", lambda d: {"k": "k", "scale": scalars.unit_scale(d, "s")}),
    "norm_entity": literal(fixtures.HEADINGS, "k, s", lambda d: {"k": "k", "entity": scalars.norm_entity(d, "s"), "plain": scalars.normal_text(d, "s"), "repaired": scalars.repaired(d, "s")}),
    "identity_fields": literal(fixtures.PAGES, "doc, page, text", lambda d: {"doc": "doc", "page": "page"} | scalars.identity(d, "text")),
    "owner_loan_notes": lambda d: [("given", ledger.values(d, fixtures.PAGES, "doc, page, text")), ("result", f"SELECT doc, page, trim(line) AS line FROM {text_lines(d)} AS s WHERE {scalars.owner_loan(d, 'line')}")],
    "relevance_page_kinds": pages(relevance.kinds),
    "relevance_select": pages(relevance.selected),
    "relevance_both_kinds": pages(relevance.both_kinds),
    "read_paths": pages(relevance.read_paths),
    "relevance_documents": documents_as_pages(relevance.selected),
    "relevance_summary": documents_as_pages(relevance.summary),
    "relevance_both_kinds_documents": documents_as_pages(relevance.both_kinds),
    "pages_widened": documents_as_pages(relevance.widened),
    "pages_retried": documents_as_pages(lambda d: [("usable", "SELECT DISTINCT doc FROM pages_in WHERE doc % 3 = 0"), *relevance.retried(d)]),
    "read_paths_documents": documents_as_pages(relevance.read_paths),
    "vocab_score": lambda d: [("result", f"SELECT doc_id, {scalars.word_score(d, 'text', ['the', 'and', 'of', 'de', 'la', 'der', 'die'])} AS score, {scalars.garbled(d, 'text')} AS garbled FROM documents")],
    "label_normal_documents": lambda d: [("heads", f"SELECT doc_id, {d.each(d.lines('text'))} AS line FROM documents"), ("result", f"SELECT doc_id, {rules.normal_label(d, 'line')} AS norm, {scalars.norm_entity(d, 'line')} AS entity, {scalars.is_business(d, 'line')} AS business FROM heads")],
}


def statements(d: Spark, price: str = "l_extendedprice"):
    """Orders as statements: two sides, sections of three lines, printed totals that are off by set shares.

    Every fourth order prints its lines twice, as the two halves of a sheet that balances. Names of sections say totals of
    both halves, of one, or of none.
    """
    off = "CASE o_orderkey % 5 WHEN 0 THEN 1.0 WHEN 1 THEN 1.0 WHEN 2 THEN 1.004 WHEN 3 THEN 1.006 END"
    amount = f"l_partkey, {d.half_even(price)} AS amount FROM numbered"
    label = d.pick(d.list([d.text(x) for x in ledger.LABELS]), f"{d.mod('l_partkey * 7 + l_linenumber', len(ledger.LABELS))} + 1")
    named = """CASE WHEN o_orderkey % 9 = 5 THEN 'Total' WHEN o_orderkey % 2 = 0 THEN CASE section WHEN 1 THEN 'Total Equity and Liabilities' WHEN 2 THEN 'TOTAL ASSETS' ELSE 'Total current assets' END
          ELSE CASE section WHEN 1 THEN CASE WHEN o_orderkey % 13 = 1 THEN 'Revenue from operations' ELSE 'III Total Revenue (I + II)' END WHEN 2 THEN 'IV EXPENSES :' ELSE 'Total comprehensive income' END END"""
    return [
        NUMBERED,
        (
            "amounts_of",
            f"""SELECT l_orderkey, l_linenumber, CAST(place AS BIGINT) AS seq, CAST(ceil(place / 3.0) AS INT) AS section, {amount} WHERE l_orderkey % 4 <> 0
          UNION ALL SELECT l_orderkey, l_linenumber, CAST(place AS BIGINT), 1, {amount} WHERE l_orderkey % 4 = 0 UNION ALL SELECT l_orderkey, l_linenumber, CAST(100 + place AS BIGINT), 2, {amount} WHERE l_orderkey % 4 = 0""",
        ),
        (
            "lines_in",
            f"""SELECT l_orderkey AS block, seq, CASE WHEN o_orderkey % 3 = 0 THEN 'left' WHEN l_linenumber % 2 = 0 THEN 'right' ELSE 'left' END AS side, section, {named} AS name, {label} AS label, amount,
          {d.half_even(f'CAST(sum(amount) OVER (PARTITION BY l_orderkey, section) AS DOUBLE) * ({off})')} AS total FROM amounts_of JOIN orders ON l_orderkey = o_orderkey""",
        ),
        ("order_totals", "SELECT l_orderkey, sum(amount) AS amount FROM amounts_of GROUP BY l_orderkey"),
        ("blocks_in", f"SELECT o_orderkey AS block, o_custkey AS doc, CASE WHEN o_orderkey % 2 = 0 THEN 'balance_sheet' ELSE 'profit_loss' END AS kind, CASE WHEN o_orderkey % 7 = 0 THEN 1000 WHEN o_orderkey % 11 = 0 THEN 100000 ELSE 1 END AS scale, {d.half_even(f'CAST(amount AS DOUBLE) * ({off})')} AS printed FROM orders LEFT JOIN order_totals ON o_orderkey = l_orderkey"),
    ]


def entries(d: Spark):
    """Each side of an order as a harvest in which every third line is a group's total of the lines after it."""
    return [
        *statements(d, "l_quantity"),
        ("sided_lines", "SELECT block, side, seq, amount, row_number() OVER (PARTITION BY block, side ORDER BY seq) AS place, coalesce(lead(amount, 1) OVER (PARTITION BY block, side ORDER BY seq), 0) + coalesce(lead(amount, 2) OVER (PARTITION BY block, side ORDER BY seq), 0) AS below FROM lines_in"),
        ("entries", "SELECT block, side, seq, CASE WHEN place % 3 = 1 AND block % 4 <> 3 THEN below ELSE amount END AS amount, place % 3 = 1 AS chosen FROM sided_lines"),
    ]


def face_lines(d: Spark):
    """Face lines of orders beside the schedules of their customer's other orders, which a word of their names may tell apart."""
    return [
        *statements(d, "l_quantity"),
        *verification.schedules(d),
        ("faces", "SELECT lines_in.block, doc, scale, seq, CASE l.seq % 3 WHEN 0 THEN '[EXP] Indirect Expenses' WHEN 1 THEN 'Selling and distribution exp' ELSE l.label END AS label, amount FROM lines_in AS l JOIN blocks_in ON l.block = blocks_in.block".replace("lines_in.block", "l.block")),
        ("offered", "SELECT doc, s.block AS sched_block, section, scale, CASE s.block % 4 WHEN 0 THEN 'Sch 09 Indirect Expenses' WHEN 1 THEN 'Selling expenses' WHEN 2 THEN 'Other expenses' ELSE 'Indirect and selling charges' END AS name, total FROM schedules AS s JOIN blocks_in ON s.block = blocks_in.block WHERE verified"),
    ]


def files(d: Spark):
    """Customers as files, three to a case, their orders as blocks of three kinds, some undated, misdated or unnamed."""
    text = "STRING" if d.name == "spark" else "VARCHAR"
    whole = lambda x: f"CAST(CAST(floor({x}) AS BIGINT) AS {text})"
    file = lambda key, name: f"CAST({key} AS BIGINT) AS doc, CAST(floor({key} / 3) AS BIGINT) AS case_id, CASE WHEN {key} % 5 <> 0 THEN CAST(1995 + {d.mod(key, 7)} AS INT) END AS ay, {name} AS name"
    return [
        ("docs", f"SELECT {file('c_custkey', 'CASE WHEN c_custkey % 2 = 0 THEN concat(' + chr(39) + 'Messrs ' + chr(39) + ', c_name) ELSE c_name END')} FROM customer UNION ALL SELECT {file('(s_suppkey + 1000000000)', 's_name')} FROM supplier"),
        # every eighth order is printed again, mostly in its own file, with most of its lines
        ("printings", "SELECT o_orderkey, o_orderkey AS block, o_custkey AS doc, o_orderdate, o_orderstatus FROM orders UNION ALL SELECT o_orderkey, o_orderkey + 1000000000, CASE WHEN o_orderkey % 16 = 11 AND o_custkey % 3 < 2 THEN o_custkey + 1 ELSE o_custkey END, o_orderdate, 'O' FROM orders WHERE o_orderkey % 8 = 3"),
        ("amounts", f"SELECT block, {d.half_even('l_quantity')} * 100 + l_partkey % 20 AS amount FROM lineitem JOIN printings ON l_orderkey = o_orderkey WHERE block < 1000000000 OR l_partkey % 4 <> 1"),
        ("item_counts", "SELECT block, count(*) AS n_items FROM amounts GROUP BY block"),
        (
            "blocks",
            f"""SELECT printings.block, doc, CAST(floor(doc / 3) AS BIGINT) AS case_id, CASE WHEN o_orderkey % 7 = 5 THEN 'capital_account' WHEN o_orderkey % 2 = 0 THEN 'balance_sheet' ELSE 'profit_loss' END AS kind,
          CASE WHEN o_orderkey % 32 = 5 THEN NULL WHEN o_orderkey % 16 = 1 THEN 'Note 35 : Lease related disclosures' WHEN o_orderkey % 8 = 1 THEN concat('SHREE TRADERS, ', {whole('doc / 3')}) ELSE concat('Shree Traders ', {whole('doc / 3')}) END AS entity,
          CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE CAST(year(o_orderdate) AS INT) END AS year, CAST(o_orderkey % 23 AS INT) AS page, CASE o_orderstatus WHEN 'F' THEN 'verified' WHEN 'O' THEN 'unverified' ELSE 'failed' END AS status,
          o_orderkey % 3 = 0 AS salvageable, coalesce(n_items, 0) AS n_items, o_orderkey % 4 = 0 AS comparative FROM printings LEFT JOIN item_counts ON printings.block = item_counts.block""",
        ),
    ]


def indian(d: Spark, x: str) -> str:
    """Rupees with separators after the last three digits and every two before."""
    return d.replace(d.replace(f"CAST({x} AS STRING)", r"(\d)(\d{3})$", "$1,$2"), r"(\d)(\d{2}),", "$1,$2,")


def boxes(d: Spark):
    """Events as word boxes: a day and user make a row."""
    day = "CAST(date_format(ts, 'd') AS BIGINT)" if d.name == "spark" else "day(ts)"
    return [("boxes", f"SELECT {day} AS page, 1000.0 AS width, CAST(user_id % 50 AS BIGINT) AS row_no, CAST(event_id * 37 % 1000 AS DOUBLE) AS x0, CAST(event_id * 37 % 1000 + 12 AS DOUBLE) AS x1, event_type AS text, {d.half_even('value')} AS amount FROM events".replace("1000.0 AS width", "CAST(1000 AS DOUBLE) AS width"))]


def raw_cells(d: Spark):
    """Cells of one figure, of two fused ones, of a figure welded to a label, of a registration, a year or a note."""
    a, b = indian(d, d.half_even("l_extendedprice")), indian(d, d.half_even("l_quantity * 1000"))
    text = "STRING" if d.name == "spark" else "VARCHAR"
    whole = lambda x: f"CAST({d.half_even(x)} AS {text})"
    return [("raw_cells", f"""SELECT l_orderkey * 10 + l_linenumber AS id, CAST(100 AS DOUBLE) AS x0, CAST(300 AS DOUBLE) AS x1, CASE l_partkey % 7 WHEN 0 THEN concat({a}, '.00 ', {b}) WHEN 1 THEN concat({a}, '.00Furniture & Fixtures') WHEN 2 THEN concat('(', {a}, ')')
      WHEN 3 THEN concat('Mh-12-', CAST(1000 + l_partkey % 9000 AS {text})) WHEN 4 THEN CAST(1995 + l_partkey % 20 AS {text}) WHEN 5 THEN concat({whole('l_extendedprice')}, ' ', {whole('l_quantity * 100')}, '.50') ELSE concat('Note ', CAST(l_linenumber AS {text})) END AS text FROM lineitem""")]


def rows(d: Spark):
    title = "CASE WHEN event_type = 'purchase' AND event_id % 4 = 0 THEN 'title' WHEN event_id % 29 = 0 THEN 'footer' ELSE 'line' END"
    return [("rows_in", f"SELECT user_id AS doc, user_id AS page, event_id AS row_no, event_type AS label, {title} AS what, CASE WHEN event_id % 5 = 0 THEN upper(substr(event_type, 1, 2)) END AS tag FROM events")]


def after(base: Callable, *steps: Callable) -> Plan:
    return lambda d: base(d) + [r for step in steps for r in step(d)]


def line_trust(d: Spark):
    return [("line_trust", "SELECT lines.entity, lines.year, key, CAST(1 + seq % 3 AS INT) AS rank FROM lines JOIN label_keys ON lines.label = label_keys.label")]


def capital_lines(d: Spark):
    """Two printings of an entity's capital account, of which one is verified."""
    return [("capital_lines", "SELECT entity, year, CASE WHEN printing = 'R' THEN 'failed' ELSE 'verified' END AS status, CASE WHEN label = '[EQ] Profit for the Year' THEN 'Add: Net Profit' WHEN label = 'Furniture' THEN 'Drawings' ELSE 'Agri income' END AS label, amount FROM lines WHERE label IN ('[EQ] Profit for the Year', 'Furniture', 'Intangible assets')")]


def year_sections(d: Spark):
    """The labels of a year as sections of salvaged and whole statements."""
    return [("year_sections", "SELECT entity, year, year % 4 = 0 AS salvaged, CASE WHEN n % 3 = 0 THEN 'fail' ELSE 'pass' END AS result, n AS gap FROM by_label WHERE year % 5 <> 0")]


def computed(d: Spark):
    return [("computed", "SELECT entity, year, profit_before_tax + CASE WHEN year % 2 = 0 THEN 500 ELSE 5000 END AS book_profit FROM vals WHERE year % 3 <> 0")]


def year_columns(d: Spark):
    return [("columns_in", "SELECT entity, year, CASE WHEN year % 3 = 0 THEN NULL ELSE total_assets END AS total_assets, lag(total_assets) OVER (PARTITION BY entity ORDER BY year) AS p_assets, year % 2 = 0 OR year % 5 = 0 AS verified FROM vals")]


PLANS |= {
    "check_block": after(statements, verification.account_checks),
    "check_sections": after(statements, verification.section_checks),
    "section_results": only(after(statements, lambda d: verification.section_checks(d)[:2]), "*"),
    "item_trust": after(statements, verification.item_trust),
    "grand_totals": after(statements, verification.grand_totals),
    "printed_total": after(statements, verification.printed_total),
    "tolerance_units": after(statements, lambda d: [("result", f"SELECT block, CAST({verification.tolerance('scale', '5')} AS DOUBLE) AS tol FROM blocks_in")]),
    "subset_columns": after(statements, verification.subset_columns),
    "joint_subset": after(lambda d: statements(d, "l_quantity"), verification.joint_subset),
    "group_expand_prefix_sum": after(entries, verification.group_expand),
    "block_segments": after(rows, verification.segments),
    "schedule_groups": after(statements, verification.schedules),
    "schedule_match": after(face_lines, reading.expansions),
    "base_trust": upto(*BASE, line_trust, trust.base),
    "derived_trust": upto(*BASE, line_trust, trust.derived),
    "chk_sheet_balances": upto(*BASE, trust.balance),
    "chk_profit_statement": upto(*BASE, spread.stated, trust.against_statement),
    "chk_profit_computation": upto(*BASE, computed, trust.against_computation),
    "chk_profit_into_capital": upto(*BASE, capital_lines, trust.into_capital, entity="o_custkey"),
    "chk_section_totals": upto(*BASE, year_sections, trust.section_totals),
    "chk_same_year_twice": upto(spread.mapped, trust.printed_twice),
    "file_year_mode": after(files, pooling.file_year),
    "nearest_dated": after(files, pooling.nearest_dated),
    "main_entity": after(files, pooling.main_entity),
    "dedupe_overlap": after(files, pooling.overlaps),
    "dedupe_blocks": after(files, pooling.deduped),
    "year_placement": after(files, pooling.placed),
    "alternates_semi": after(files, lambda d: pooling.alternates(d, "semi")),
    "alternates_anti": after(files, lambda d: pooling.alternates(d, "anti")),
    "docs_without_blocks": after(files, pooling.without_blocks),
    "case_years": after(files, pooling.years),
    "files_not_used": after(files, pooling.notes),
    "vision_topk": after(files, pooling.vision_pages),
    "comparative_recovery": upto(*BASE, year_columns, pooling.recovered),
    "nil_detection": after(files, pooling.nil),
    "cache_prune_lru": lambda d: [("entries", "SELECT event_id AS id, event_id % 97 + 1 AS bytes, ts AS used FROM events"), *pooling.pruned(d, 40_000, "timestamp '2024-01-05 00:00:00'")],
    "cell_islands": after(boxes, layout.cells),
    "column_clusters": after(boxes, layout.columns),
    "period_right_edge": after(boxes, lambda d: [("ranges", "SELECT DISTINCT page, CAST(500 AS DOUBLE) AS low, CAST(560 AS DOUBLE) AS high, CAST(700 AS DOUBLE) AS other_low, CAST(760 AS DOUBLE) AS other_high FROM boxes")], layout.right_edge),
    "inferred_columns": after(boxes, layout.inferred),
    "overlapping_boxes": after(boxes, layout.overlapping),
    "split_cells": after(raw_cells, layout.split_cells),
    "side_tags": after(statements, reading.side_tags),
    "sheet_formulas": upto(*BASE, sinks.formulas),
    "divider_candidates": after(boxes, layout.divider_gaps),
    "section_tags_filled": after(rows, layout.filled_tags),
    "sheet_cells": upto(*BASE, sinks.cells),
    "audit_rows": upto(spread.mapped, sinks.audit),
    "sheet_blocks": upto(*BASE, spread.ratios, spread.snap, lambda d: spread.growth(d)[:2], sinks.blocks),
    "analysis_sheet": upto(*BASE, spread.ratios, spread.growth, spread.cagr, lambda d: spread.flags(d, *ASSESSED), sinks.analysis),
}


def given(step: Callable, **tables: tuple[list[tuple], str]) -> Plan:
    return lambda d: [*((name, ledger.values(d, rows, names)) for name, (rows, names) in tables.items()), *step(d)]


ALL_CHECKS = (*BASE, line_trust, lambda d: trust.base(d)[:-1], spread.stated, computed, capital_lines, year_sections, *reading.CHECKS, reading.all_checks)


def subtotalled(d: Spark):
    return [*statements(d), ("sub_lines", "SELECT block, seq, side, amount, CASE WHEN seq % 2 = 0 THEN 1 ELSE 0 END AS subtotal FROM lines_in")]


def heading_rows(d: Spark):
    """Each order as four lines: a business, a proprietor, an address or figures, and a heading, some of them missing."""
    text = "STRING" if d.name == "spark" else "VARCHAR"
    key = f"CAST(o_orderkey AS {text})"
    return [(
        "heading_rows",
        f"""SELECT o_orderkey AS doc, 0 AS row_no, CASE WHEN o_orderkey % 5 = 0 THEN 'To' ELSE concat('Shree  Traders ', CASE o_orderkey % 3 WHEN 0 THEN 'Pune' ELSE 'Road Carriers' END, ' :-') END AS text, FALSE AS title FROM orders
          UNION ALL SELECT o_orderkey, 1, concat('(Proprietor : R ', CASE WHEN o_orderkey % 2 = 0 THEN 'Rao' ELSE 'Shah' END, ')'), FALSE FROM orders WHERE o_orderkey % 4 <> 1
          UNION ALL SELECT o_orderkey, 2, CASE o_orderkey % 3 WHEN 0 THEN 'Plot 12, MIDC, Pune 411001' WHEN 1 THEN concat('No ', {key}, '00000') ELSE 'Balance Sheet total' END, FALSE FROM orders UNION ALL SELECT o_orderkey, 3, 'Balance Sheet as on 31.03.2024', TRUE FROM orders""",
    )]


def prior_rows(d: Spark):
    """Totals of sections as lines of a comparative column."""
    return [*statements(d), ("prior_rows", "SELECT block, CAST(section AS BIGINT) AS seq, max(name) AS label, CASE WHEN block % 6 <> 5 THEN max(total) END AS prior FROM lines_in GROUP BY block, section")]


def year_headers(d: Spark):
    return [
        ("own_years", "SELECT o_orderkey AS own_block, CAST(year(o_orderdate) AS INT) AS year FROM orders"),
        ("headers", "SELECT l_orderkey AS block, CAST(year(l_shipdate) AS INT) - CAST(l_linenumber % 3 AS INT) AS header_year FROM lineitem"),
    ]


PLANS |= {
    "book_profit": given(reading.book_profit, pages_in=(fixtures.RETURNS, "doc, page, text")),
    "return_figures": given(reading.return_figures, pages_in=(fixtures.RETURNS, "doc, page, text")),
    "classify_statement": given(reading.classified, headed=(fixtures.HEADED, "block, heading, labels")),
    "classify_documents": lambda d: [("headed", f"SELECT doc_id AS block, {d.pick(d.lines('text'), '1')} AS heading, text AS labels FROM documents"), *reading.classified(d)],
    "continuations": given(reading.continued, page_ends=(fixtures.PAGE_ENDS, "doc, page, first_line, last_line")),
    "header_years": given(reading.header_years, page_rows=(fixtures.PAGE_ROWS, "page, row_no, text")),
    "comparative_statements": after(year_headers, reading.comparative),
    "entity_above": after(heading_rows, reading.entities),
    "comparative_totals": after(prior_rows, reading.comparative_totals),
    "segmented_accounts": after(subtotalled, reading.segmented),
    "restated_parents": given(reading.restated_parents, lines_in=(fixtures.RESTATED, "block, section, seq, amount, total")),
    "vision_adoption": given(reading.adopted, first_reading=(fixtures.FIRST, "block, l0, r0"), second_reading=(fixtures.SECOND, "block, l1, r1")),
    "separator_repair": given(reading.repaired_separators, given=([*fixtures.HEADINGS, (99, "2.35.51,356.00 and 31.03.2024 12.345 1,23.456")], "k, s")),
    "subtotal_rows": after(lambda d: statements(d, "l_quantity"), reading.subtotal_rows),
    "combined_transfers": given(reading.transfers, account_lines=(fixtures.ACCOUNT_LINES, "block, seq, side, label, amount")),
    "name_words": given(reading.name_words, captions=(fixtures.CAPTIONS, "label")),
    "label_overrides": upto(spread.mapped, lambda d: [("overrides", ledger.values(d, fixtures.OVERRIDES, "given_label, given_key"))], reading.overridden),
    "cell_notes": upto(*BASE, line_trust, lambda d: trust.base(d)[:-1], reading.cell_notes),
    "borrower_name": after(files, reading.borrower),
    "all_checks": upto(*ALL_CHECKS),
    "audit_sheet": upto(*ALL_CHECKS, spread.assumed, sinks.audit_rows),
    "checked_trust": upto(*ALL_CHECKS, trust.checked),
    "combined_accounts": given(reading.combined, account_lines=(fixtures.ACCOUNT_LINES, "block, seq, side, label, amount")),
}


def return_pages(step: Callable) -> Plan:
    """Conversations as returns: an acknowledgement, a computation and a note of owners' loans among other turns."""

    def plan(d: Spark):
        text = "STRING" if d.name == "spark" else "VARCHAR"
        lines = lambda *parts: f"concat({f', {d.newline}, '.join(parts)}, {d.newline}, text)"
        pan = f"concat('Assessment Year 2023-24 PAN ABCDE', CAST(1000 + conv_id % 9000 AS {text}), 'F ITR-3')"
        loss = f"concat('Current Year business loss, if any 1 ', {indian(d, 'conv_id * 7919 + 1000')})"
        paid = f"concat('Taxes Paid 7 ', {indian(d, 'conv_id * 31 + 1000')})"
        profit = f"concat('Net profit as per P & L A/c : ', CASE WHEN conv_id % 2 = 0 THEN '(' ELSE '' END, {indian(d, 'conv_id * 113 + 5000')}, CASE WHEN conv_id % 2 = 0 THEN ')' ELSE '' END)"
        loan = f"concat('Loans from directors (Unsecured) ', {indian(d, 'conv_id * 17 + 9000')})"
        body = f"CASE turn % 4 WHEN 0 THEN {lines(chr(39) + 'INDIAN INCOME TAX RETURN ACKNOWLEDGEMENT' + chr(39), pan, loss, paid)} WHEN 1 THEN {lines(chr(39) + 'COMPUTATION OF INCOME' + chr(39), profit)} WHEN 2 THEN {lines(loan)} ELSE text END"
        return [("pages_in", f"SELECT conv_id AS doc, CAST(turn AS BIGINT) AS page, {body} AS text FROM conversations WHERE text IS NOT NULL"), *step(d)]

    return plan


def owner_loans(d: Spark):
    return [("page_lines", f"SELECT doc, page, {d.each(d.lines('text'))} AS line FROM pages_in"), ("result", f"SELECT doc, page, trim(line) AS line FROM page_lines WHERE {scalars.owner_loan(d, 'line')}")]


def parsed_lines(d: Spark):
    """Every line of every document through the readers of lines, headings, periods and units.

    Accented letters are made plain first: the engines differ in whether one is part of a word.
    """
    parts = {
        "label": scalars.line_label(d, "line"), "amount": scalars.line_amount(d, "line"), "row": scalars.row_kind(d, "line"), "title": scalars.is_title(d, "line"), "address": scalars.is_address(d, "line"),
        "year": scalars.period_year(d, "line"), "scale": scalars.unit_scale(d, "line"), "number": scalars.to_int(d, "line"), "repaired": scalars.repaired(d, "line"), "section": rules.first_of(d, "line", rules.SECTIONS),
    }
    return [("raw_lines", f"SELECT doc_id, {d.each(d.lines('text'))} AS raw FROM documents"), ("text_lines", f"SELECT doc_id, {d.replace('raw', r'[^\x00-\x7F]', 'e', True)} AS line FROM raw_lines"), ("result", f"SELECT doc_id, {', '.join(f'{e} AS {n}' for n, e in parts.items())} FROM text_lines WHERE line <> ''")]


PLANS |= {
    "book_profit_turns": return_pages(reading.book_profit),
    "return_figures_turns": return_pages(reading.return_figures),
    "identity_turns": return_pages(lambda d: [("result", f"SELECT doc, page, {', '.join(f'{e} AS {n}' for n, e in scalars.identity(d, 'text').items())} FROM pages_in")]),
    "owner_loans_turns": return_pages(owner_loans),
    "parse_lines_documents": parsed_lines,
}
QUERIES = {name: runner(plan) for name, plan in PLANS.items()}
#: Answers written by hand where there are any, else the same plan for the other engine.
ORACLES = {name: statement(plan, DUCK) for name, plan in PLANS.items()} | oracles.SQL


def account_cells(d: Spark):
    """Each order as a page of a two-sided account, with the same figures on both sides and the total under them."""
    line = "l_orderkey AS page, place AS row_no"
    left, right = "concat('Item ', l_partkey, ' units')", "concat('Asset ', l_suppkey, ' units')"
    return [
        NUMBERED,
        ("sums", f"SELECT l_orderkey, max(place) + 1 AS n, sum({d.half_even('l_extendedprice')}) AS total FROM numbered GROUP BY l_orderkey"),
        (
            "cells",
            f"""SELECT {line}, CAST(10 AS DOUBLE) AS x0, CAST(200 AS DOUBLE) AS x1, {left} AS text FROM numbered UNION ALL SELECT {line}, 350, 430, {indian(d, d.half_even('l_extendedprice'))} FROM numbered
          UNION ALL SELECT {line}, 520, 700, {right} FROM numbered UNION ALL SELECT {line}, 850, 930, {indian(d, d.half_even('l_extendedprice'))} FROM numbered
          UNION ALL SELECT l_orderkey, n, 350, 430, {indian(d, 'total')} FROM sums UNION ALL SELECT l_orderkey, n, 850, 930, {indian(d, 'total')} FROM sums""",
        ),
    ]


def words(d: Spark):
    return [("words", "SELECT CAST(user_id AS BIGINT) AS page, CAST(1000 AS DOUBLE) AS width, CAST(event_id * 37 % 900 AS DOUBLE) AS x0, CAST(event_id % 60 * 5 AS DOUBLE) AS y0, CAST(event_id * 37 % 900 + 40 AS DOUBLE) AS x1, CAST(event_id % 60 * 5 + 12 AS DOUBLE) AS y1, event_type AS text FROM events")]


def column_cells(d: Spark):
    """Each order as a one-column statement with this and last year's figures and a total."""
    both = f"concat({indian(d, d.half_even('l_extendedprice'))}, ' ', {indian(d, d.half_even('l_extendedprice * 0.9'))})"
    return [
        NUMBERED,
        ("sums", f"SELECT l_orderkey, max(place) + 1 AS n, sum({d.half_even('l_extendedprice')}) AS total FROM numbered GROUP BY l_orderkey"),
        ("cells", f"SELECT l_orderkey AS page, place AS row_no, CAST(10 AS DOUBLE) AS x0, CAST(200 AS DOUBLE) AS x1, concat('Item ', l_partkey, ' units') AS text, CAST(560 AS DOUBLE) AS edge FROM numbered UNION ALL SELECT l_orderkey, place, 480, 640, {both}, 560 FROM numbered UNION ALL SELECT l_orderkey, n, 10, 60, 'Total', 560 FROM sums UNION ALL SELECT l_orderkey, n, 480, 560, {indian(d, 'total')}, 560 FROM sums"),
    ]


def printings(d: Spark):
    """Two printings of each year side by side, with the trust of every row."""
    return [
        ("two", "SELECT entity, year, key, sum(CASE WHEN seq % 13 = 0 THEN 0 ELSE amount END) AS mine, sum(amount) AS theirs FROM lines JOIN label_keys ON lines.label = label_keys.label WHERE key IS NOT NULL AND key <> '__ignored__' GROUP BY entity, year, key"),
        ("grouped", "SELECT *, CASE " + " ".join(f"WHEN key = '{k}' THEN '{t}'" for k, (t, _) in grouped.TOTAL_OF.items()) + " END AS total_key FROM two"),
        ("printings", "SELECT entity, year, key, mine, theirs, CASE WHEN mine = theirs THEN 'proven' ELSE 'doubtful' END AS trust, 'proven' AS other, sum(mine) OVER (PARTITION BY entity, year, total_key) AS mine_total, sum(theirs) OVER (PARTITION BY entity, year, total_key) AS their_total FROM grouped"),
    ]


def dedupe_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    admitted = f"(salvageable AND status = 'failed') OR coalesce({scalars.is_business(SPARK, 'entity')}, FALSE)"
    base = runner(lambda d: [*files(d), ("statements_of", f"SELECT doc, year, block, entity, kind, status = 'verified' AS verified, n_items, {admitted} AS admitted FROM blocks WHERE year IS NOT NULL AND n_items > 0")])(spark, sf_dir)
    amounts = runner(lambda d: [*files(d), ("lists", "SELECT block, sort_array(collect_list(amount)) AS amounts FROM amounts GROUP BY block")])(spark, sf_dir)
    return grouped.dedupe(base, amounts)


#: Labels of the two sides of the pages that orders make.
OWED_LABELS = ("Trade payables", "Unsecured Loans", "Cash credit", "(b) Reserves and Surplus", "Deferred Tax Liabilities (Net)")
OWNED_LABELS = ("Trade receivables", "Furniture", "Intangible assets", "Investment in shares", "Other non current assets")


def case_pages(d: Spark):
    """Each order as a page of its customer's file: a name, a dated heading, lines of two sides and their total."""
    money = indian(d, d.half_even("l_extendedprice"))
    pick = lambda labels, key: d.pick(d.list([d.text(x) for x in labels]), f"{d.mod(key, len(labels))} + 1")
    box = lambda x0, x1, text, row="place + 2", table="printed": f"SELECT l_orderkey, {row} AS row_no, {x0} AS x0, {x1} AS x1, {text} AS text FROM {table}"
    name = "concat('Shree Traders ', CAST(CAST(floor(o_custkey / 3) AS BIGINT) AS STRING))"
    title = "concat('Balance Sheet as at 31.03.', CAST(year(o_orderdate) AS STRING))"
    head = lambda text, row: f"SELECT o_orderkey AS l_orderkey, {row} AS row_no, 100 AS x0, 400 AS x1, {text} AS text FROM orders"
    return [
        ("printed", "SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS place FROM lineitem"),
        ("totals", f"SELECT l_orderkey, max(place) + 3 AS row_no, sum({d.half_even('l_extendedprice')}) AS total FROM printed GROUP BY l_orderkey"),
        (
            "boxes",
            " UNION ALL ".join(
                [
                    head(name, 0), head(title, 1), box(10, 200, pick(OWED_LABELS, "l_partkey")), box(350, 430, money), box(520, 700, pick(OWNED_LABELS, "l_suppkey")), box(850, 930, money),
                    f"SELECT l_orderkey, row_no, 350, 430, {indian(d, 'total')} FROM totals", f"SELECT l_orderkey, row_no, 850, 930, {indian(d, 'total')} FROM totals",
                ]
            ),
        ),
        ("words", "SELECT o_custkey AS doc, CAST(o_orderkey AS INT) AS page, CAST(1000 AS DOUBLE) AS width, CAST(x0 AS DOUBLE) AS x0, CAST(row_no * 20 AS DOUBLE) AS y0, CAST(x1 AS DOUBLE) AS x1, CAST(row_no * 20 + 12 AS DOUBLE) AS y1, text FROM boxes JOIN orders ON l_orderkey = o_orderkey"),
    ]


def case_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of words to the balance sheet of every case and year, through every step of the way."""
    docs = runner(lambda d: [("docs", "SELECT CAST(c_custkey AS BIGINT) AS doc, CAST(floor(c_custkey / 3) AS BIGINT) AS case_id, CAST(NULL AS INT) AS ay, c_name AS name FROM customer")])(spark, sf_dir)
    made = pipeline.spread_cases(runner(case_pages)(spark, sf_dir), docs)
    return made.values.selectExpr("entity AS case_id", "year", *(k for k in CASE_ROWS))


CASE_ROWS = ("sundry_creditors", "unsecured_loans", "secured_loan_ccod", "reserves", "deferred_tax_liability", "debtors", "fixed_assets", "intangible_assets", "investments", "other_non_current_assets", "total_liabilities", "total_assets")

def ocr_table(d: Spark):
    text = "STRING" if d.name == "spark" else "VARCHAR"
    return [("ocr", f"SELECT user_id AS page, event_id % 500 AS left, event_id % 300 AS top, 40 AS width, 12 AS height, CASE WHEN event_id % 11 = 0 THEN ' ' ELSE event_type END AS text, CASE WHEN event_id % 13 = 0 THEN '-1' WHEN event_id % 17 = 0 THEN 'x' ELSE CAST(event_id % 100 AS {text}) END AS conf FROM events")]


def polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    corner = lambda x, y: f"named_struct('x', CAST(event_id % 500 + {x} AS DOUBLE), 'y', CAST(event_id % 300 + {y} AS DOUBLE))"
    box = f"array({corner(3, 0)}, {corner(40, 2)}, {corner(38, 14)}, {corner(0, 12)})"
    return documents.polygon_words(runner(lambda d: [("polygons", f"SELECT user_id AS page, {box} AS box, event_type AS text, CAST(event_id % 100 AS DOUBLE) / 100 AS score FROM events")])(spark, sf_dir))


def rotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as pages, read at the angle of each turn; every third has a page's words in one of them."""
    words = "repeat('balance sheet total year ended march tax income ', 2)"
    return documents.best_rotation(runner(lambda d: [("turned", f"SELECT conv_id AS page, CAST(turn % 4 * 90 AS INT) AS angle, CASE WHEN conv_id % 3 = 0 AND turn % 4 = 1 THEN concat({words}, text) ELSE text END AS text FROM conversations")])(spark, sf_dir))


def learned_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = "SELECT DISTINCT label, CASE seq % 5 WHEN 0 THEN 'sundry_creditors' WHEN 1 THEN 'no such row' WHEN 2 THEN 'purchases' ELSE 'debtors' END AS key FROM lines"
    return cache.cacheable(runner(upto(lambda d: [("pairs", pairs)]))(spark, sf_dir))


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.identified(runner(lambda d: [("contents", "SELECT url AS path, CAST(html AS BINARY) AS content FROM pages WHERE html IS NOT NULL AND url IS NOT NULL")])(spark, sf_dir)).select("doc_id", "source_name")


#: Operators of the sources, on tables made of the driver's.
QUERIES |= {
    "ocr_words": lambda spark, sf: documents.tesseract_words(runner(ocr_table)(spark, sf)),
    "polygon_words": polygons,
    "best_rotation": rotations,
    "learned_labels": learned_labels,
    "source_files": source_files,
}
#: Sequential operators, and the whole way of a case.
QUERIES |= {
    "case_spread": case_spread,
    "row_assembly": lambda spark, sf: grouped.row_assembly(runner(words)(spark, sf)),
    "t_account_harvest": lambda spark, sf: grouped.t_account_harvest(runner(account_cells)(spark, sf)),
    "vertical_harvest": lambda spark, sf: grouped.vertical_harvest(runner(column_cells)(spark, sf)),
    "dedupe_greedy": dedupe_greedy,
    "fill_other_printing": lambda spark, sf: grouped.fill_other_printing(runner(upto(spread.mapped, printings))(spark, sf)),
}
