"""Sheets: cells with values, formulas and notes as rows, and a writer of the workbook from the standard library."""

from __future__ import annotations

import io
import re
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame

from spreadloom.plans import template as T
from spreadloom.plans.dialect import Spark

FIRST_ROW = 5


def row_map() -> dict[str, int]:
    return {key: FIRST_ROW + k for k, (_, key, _) in enumerate(T.SHEET) if key}


def letters(k: int) -> str:
    out = ""
    while k:
        k, rest = divmod(k - 1, 26)
        out = chr(65 + rest) + out
    return out


def formula(key: str, column: str) -> str:
    """The live formula of a derived row in a sheet column."""
    rows = row_map()
    return re.sub(r"\{(\w+)\}", lambda m: f"{column}{rows[m[1]]}", T.FORMULAS[key])


def cells(d: Spark):
    """One row for each figure of the sheet, in lakhs; NULL figures are written as 0 and marked unread."""
    rows = row_map()
    shown = [key for _, key, _ in T.SHEET if key]
    branches = d.list([f"'{k}'" for k in shown])
    value = "CASE key " + " ".join(f"WHEN '{k}' THEN {k}" for k in shown) + " END"
    at = "CASE key " + " ".join(f"WHEN '{k}' THEN {rows[k]}" for k in shown) + " END"
    kind = f"CASE WHEN key IN ({', '.join(repr(k) for k in T.FORMULAS)}) THEN 'formula' ELSE 'value' END"
    return [
        ("keyed", f"SELECT *, {d.each(branches)} AS key FROM vals"),
        ("numbered", "SELECT entity, year, row_number() OVER (PARTITION BY entity ORDER BY year) AS c FROM vals"),
        ("sheet", f"SELECT keyed.entity, keyed.year, key, CAST({at} AS INT) AS row_no, CAST(c + 1 AS INT) AS col_no, {kind} AS kind, coalesce({value}, 0) / 100000.0D AS lakhs, {value} IS NULL AS unread FROM keyed JOIN numbered ON keyed.entity = numbered.entity AND keyed.year = numbered.year".replace("100000.0D", "CAST(100000 AS DOUBLE)")),
    ]


def audit(d: Spark):
    """The audit trail: source, unmapped and ignored lines as one typed list."""
    return [("audit", "SELECT entity, year, CASE WHEN key IS NULL THEN 'unmapped' WHEN key = '__ignored__' THEN 'ignored' ELSE 'source' END AS kind, label, key, amount, n FROM mapped")]


def formulas(d: Spark):
    """The live formulas of the sheet's derived rows, in the column of each year."""
    rows = row_map()
    spelt = {k: re.sub(r"\{(\w+)\}", lambda m: f"#{rows[m[1]]}", f) for k, f in T.FORMULAS.items()}
    told = "CASE key " + " ".join(f"WHEN '{k}' THEN {d.text(f)}" for k, f in spelt.items()) + " END"
    return [
        ("sheet_years", "SELECT entity, year, row_number() OVER (PARTITION BY entity ORDER BY year) + 1 AS c FROM vals"),
        ("formula_keys", f"SELECT entity, year, c, {d.each(d.list([repr(k) for k in spelt]))} AS key FROM sheet_years"),
        ("formulas", f"SELECT entity, year, key, replace({told}, '#', chr(CAST(64 + c AS INT))) AS formula FROM formula_keys"),
    ]


def blocks(d: Spark):
    """The blocks under the sheet: snap, ratios and growth, each figure with its formula in the sheet's cells.

    ``block_row`` counts within a block; the columns are those of the sheet, and growth stands against the column before.
    """
    rows = row_map()
    cell = lambda key, at="{c}": f"{at}{rows[key]}"

    def spelt(expression: str) -> str:
        return re.sub(r"\b([a-z][a-z_0-9]+)\b", lambda m: cell(m[1]), expression)

    text = "STRING" if d.name == "spark" else "VARCHAR"
    made = []
    for k, (name, expression) in enumerate(T.SNAP, 1):
        made.append(("snap", k, name, f"={spelt(expression)}", f"s.{name}"))
    for k, (name, _, top, below, factor) in enumerate(T.RATIOS, 1):
        made.append(("ratio", k, name, f"=IFERROR(({spelt(top)})/({spelt(below)}){factor.replace(' ', '')},0)", f"r.{name}"))
    for k, name in enumerate(T.GROWTH, 1):
        made.append(("growth", k, name, f"=({cell(name)}-{cell(name, '{p}')})/ABS({cell(name, '{p}')})", f"g.{name}"))
    items = d.list([d.text(f"{kind}|{k}|{name}|{f}") for kind, k, name, f, _ in made])
    value = "CASE name " + " ".join(f"WHEN '{name}' THEN {v}" for kind, _, name, _, v in made if kind == "ratio") + " END"
    snap = "CASE name " + " ".join(f"WHEN '{name}' THEN CAST({v} AS DOUBLE) / CAST(100000 AS DOUBLE)" for kind, _, name, _, v in made if kind == "snap") + " END"
    growth = "CASE name " + " ".join(f"WHEN '{name}' THEN {v}" for kind, _, name, _, v in made if kind == "growth") + " END"
    letter = lambda n: f"chr(CAST(64 + {n} AS INT))"
    part = lambda k: d.extract("item", rf"^([^|]*)\|([^|]*)\|([^|]*)\|(.*)$", k)
    return [
        ("placed_years", "SELECT entity, year, row_number() OVER (PARTITION BY entity ORDER BY year) + 1 AS c FROM vals"),
        ("items", f"SELECT entity, year, c, {d.each(items)} AS item FROM placed_years"),
        ("named_items", f"SELECT entity, year, c, {part(1)} AS block, CAST({part(2)} AS INT) AS block_row, {part(3)} AS name, replace(replace({part(4)}, '{{c}}', {letter('c')}), '{{p}}', {letter('c - 1')}) AS formula FROM items"),
        (
            "blocks",
            f"""SELECT n.entity, n.year, block, block_row, name, CAST(c AS INT) AS col_no, CASE WHEN block = 'growth' AND c = 2 THEN CAST(NULL AS {text}) ELSE formula END AS formula,
          CASE block WHEN 'snap' THEN {snap} WHEN 'ratio' THEN {value} ELSE {growth} END AS value FROM named_items AS n JOIN snap AS s ON n.entity = s.entity AND n.year = s.year
          JOIN ratios AS r ON n.entity = r.entity AND n.year = r.year JOIN growth AS g ON n.entity = g.entity AND n.year = g.year""",
        ),
    ]


def analysis(d: Spark):
    """The rows of the analysis sheet: trends of every year, the compound growth, then the flags in order."""
    trends = d.list([f"'{k}'" for k in T.TRENDS])
    value = "CASE key " + " ".join(f"WHEN '{k}' THEN {k}" for k in T.TRENDS) + " END"
    order = "CASE key " + " ".join(f"WHEN '{k}' THEN {n}" for n, k in enumerate(T.TRENDS, 1)) + " END"
    text = "STRING" if d.name == "spark" else "VARCHAR"
    return [
        ("trend_keys", f"SELECT *, {d.each(trends)} AS key FROM trends"),
        (
            "analysis",
            f"""SELECT entity, 'trend' AS part, CAST({order} AS INT) AS place, year, key AS name, {value} AS value, CAST(NULL AS {text}) AS detail FROM trend_keys
          UNION ALL SELECT entity, 'cagr', 1, CAST(NULL AS INT), 'sales_other_income', cagr, CAST(NULL AS {text}) FROM cagr
          UNION ALL SELECT entity, 'flag', seq, year, concat(upper(severity), ' - ', flag), CAST(NULL AS DOUBLE), detail FROM flags""",
        ),
    ]


def audit_rows(d: Spark):
    """The audit sheet as typed rows in order: statements used, checks, assumptions, sources, unmapped and ignored lines."""
    text = "STRING" if d.name == "spark" else "VARCHAR"
    empty = f"CAST(NULL AS {text})"
    return [
        (
            "audit_parts",
            f"""SELECT entity, year, 1 AS part, 'check' AS kind, name AS label, status AS key, CAST(gap AS BIGINT) AS amount, {empty} AS note FROM all_checks
          UNION ALL SELECT entity, year, 2, 'assumption', label, key, amount, note FROM assumed
          UNION ALL SELECT entity, year, 3, CASE WHEN key IS NULL THEN 'unmapped' WHEN key = '__ignored__' THEN 'ignored' ELSE 'source' END, label, key, counted, {empty} FROM mapped""",
        ),
        ("audit_rows", "SELECT *, CAST(row_number() OVER (PARTITION BY entity, year ORDER BY part, kind, key, abs(amount) DESC, label) AS INT) AS place FROM audit_parts"),
    ]


Row = list[tuple[str, object]]


def sheet_xml(rows: list[Row], main: str) -> str:
    """Rows of (reference, value) as a worksheet; a value is a text, a number, a formula with its value, or nothing."""
    out = []
    for cells in rows:
        body, number = "", 0
        for ref, value in cells:
            number = int(re.sub(r"\D", "", ref))
            if isinstance(value, tuple):
                body += f'<c r="{ref}"><f>{escape(value[0].removeprefix("="))}</f><v>{value[1]}</v></c>'
            elif isinstance(value, str):
                body += f'<c r="{ref}" t="inlineStr"><is><t>{escape(value)}</t></is></c>'
            elif value is not None:
                body += f'<c r="{ref}"><v>{value}</v></c>'
        if body:
            out.append(f'<row r="{number}">{body}</row>')
    return f'<worksheet xmlns="{main}"><sheetData>{"".join(out)}</sheetData></worksheet>'


def workbook(sheet: DataFrame, notes: DataFrame | None = None, analysis: DataFrame | None = None, audit: DataFrame | None = None, under: DataFrame | None = None) -> bytes:
    """An xlsx of one entity: the sheet with its blocks, the analysis and the audit trail.

    ``sheet`` is the relation ``cells`` of a single entity, 38 rows for each year; ``notes`` are ``cell_notes``, whose formulas
    are written in place of figures; ``under`` are ``blocks``. All are collected: they are bounded by one entity's years and
    its different labels.
    """
    found = {(r["row_no"], r["col_no"]): r for r in sheet.collect()}
    years = sorted({(r["year"], c) for (_, c), r in found.items()})
    summed = {(r["key"], r["year"]): r["formula"] for r in notes.collect() if r["formula"]} if notes is not None else {}
    first = [[(f"A{FIRST_ROW - 1}", "Particulars"), *((f"{letters(c)}{FIRST_ROW - 1}", f"31-03-{y}") for y, c in years)]]
    for k, (_, key, caption) in enumerate(T.SHEET):
        row: Row = [(f"A{FIRST_ROW + k}", caption)]
        for y, c in years if key else []:
            r = found[FIRST_ROW + k, c]
            live = formula(key, letters(c)) if r["kind"] == "formula" else summed.get((key, y))
            row.append((f"{letters(c)}{FIRST_ROW + k}", (live, r["lakhs"]) if live else r["lakhs"]))
        first.append(row)
    at = FIRST_ROW + len(T.SHEET) + 1
    lines: dict[tuple, list] = {}
    for r in under.collect() if under is not None else []:
        lines.setdefault((("snap", "ratio", "growth").index(r["block"]), r["block_row"], r["name"]), []).append(r)
    for k, ((_, _, name), cells) in enumerate(sorted(lines.items(), key=lambda x: x[0])):
        first.append([(f"A{at + k}", name), *((f"{letters(r['col_no'])}{at + k}", (r["formula"], r["value"] or 0) if r["formula"] else None) for r in sorted(cells, key=lambda r: r["col_no"]))])
    column = {y: letters(c) for y, c in years}
    second: list[Row] = [[("A1", "Year-on-year growth"), *((f"{c}1", f"31-03-{y}") for y, c in column.items())]]
    rows = analysis.collect() if analysis is not None else []
    for k, name in enumerate(dict.fromkeys(r["name"] for r in sorted((r for r in rows if r["part"] == "trend"), key=lambda r: r["place"])), 2):
        second.append([(f"A{k}", name), *((f"{column[r['year']]}{k}", r["value"]) for r in rows if r["part"] == "trend" and r["name"] == name)])
    for r in (r for r in rows if r["part"] == "cagr"):
        second.append([(f"A{len(second) + 1}", "Revenue CAGR (first to last readable year)"), (f"B{len(second) + 1}", r["value"])])
    for r in sorted((r for r in rows if r["part"] == "flag"), key=lambda r: (r["year"], r["place"])):
        second.append([(f"A{len(second) + 1}", f"{r['year']} - {r['name']}"), (f"B{len(second) + 1}", r["detail"])])
    third: list[Row] = [[("A1", "Year"), ("B1", "Kind"), ("C1", "Line"), ("D1", "Row"), ("E1", "Amount"), ("F1", "Note")]]
    for k, r in enumerate(sorted(audit.collect(), key=lambda r: (r["year"], r["place"])) if audit is not None else [], 2):
        third.append([(f"A{k}", r["year"]), (f"B{k}", r["kind"]), (f"C{k}", r["label"]), (f"D{k}", r["key"]), (f"E{k}", r["amount"]), (f"F{k}", r["note"])])
    return packed({"ITR Validation": first, "Analysis": second, "Audit Trail": third})


def packed(sheets: dict[str, list[Row]]) -> bytes:
    """Worksheets by name as the bytes of an xlsx file."""
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    links = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    packages = "http://schemas.openxmlformats.org/package/2006"
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    parts = list(enumerate(sheets.items(), 1))
    overrides = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="{kind}.worksheet+xml"/>' for k, _ in parts)
    files = {
        "[Content_Types].xml": f'<Types xmlns="{packages}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>{overrides}</Types>',
        "_rels/.rels": f'<Relationships xmlns="{packages}/relationships"><Relationship Id="r1" Type="{links}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{links}"><sheets>' + "".join(f'<sheet name="{name}" sheetId="{k}" r:id="r{k}"/>' for k, (name, _) in parts) + "</sheets></workbook>",
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{packages}/relationships">' + "".join(f'<Relationship Id="r{k}" Type="{links}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k, _ in parts) + "</Relationships>",
    }
    files |= {f"xl/worksheets/sheet{k}.xml": sheet_xml(rows, main) for k, (_, rows) in parts}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in files.items():
            z.writestr(name, '<?xml version="1.0" encoding="UTF-8"?>' + body)
    return out.getvalue()
