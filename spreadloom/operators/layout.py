"""Geometry as gaps and islands: words of a row into cells, amounts into columns. Relations over ``boxes``.

boxes: page, width, row_no, x0, x1, text.
"""

from __future__ import annotations

from spreadloom.plans.dialect import Spark

#: The gap between cells and between columns, as shares.
CELL_GAP, COLUMN_GAP, NOTE_MOST = 0.035, 0.06, 99


def cells(d: Spark):
    """A word opens a cell where the gap before it is a column's width."""
    row = "PARTITION BY page, row_no ORDER BY x0, x1, text"
    return [
        ("gapped", f"SELECT *, CASE WHEN x0 - lag(x1) OVER ({row}) < {CELL_GAP} * width THEN 0 ELSE 1 END AS opens FROM boxes"),
        ("celled", f"SELECT *, sum(opens) OVER ({row} ROWS UNBOUNDED PRECEDING) AS cell FROM gapped"),
        ("cells", f"SELECT page, row_no, CAST(cell AS BIGINT) AS cell, min(x0) AS x0, max(x1) AS x1, {d.gathered('text', ' ', 'x0, x1, text')} AS text, count(*) AS words FROM celled GROUP BY page, row_no, cell"),
    ]


def columns(d: Spark):
    """Columns of amounts: single-link clusters on the position within 6 % of the span, one more."""
    return [
        ("spanned", f"SELECT page, x1 AS x, amount, greatest(max(x1) OVER (PARTITION BY page) - min(x1) OVER (PARTITION BY page), 1) * {COLUMN_GAP} + 1 AS tol FROM boxes"),
        ("split", "SELECT *, CASE WHEN x - lag(x) OVER (PARTITION BY page ORDER BY x, amount) <= tol THEN 0 ELSE 1 END AS opens FROM spanned"),
        ("clustered", "SELECT *, sum(opens) OVER (PARTITION BY page ORDER BY x, amount ROWS UNBOUNDED PRECEDING) AS col FROM split"),
        ("columns", f"SELECT page, CAST(col AS BIGINT) AS col, count(*) AS n, min(x) AS x_low, max(x) AS x_high, CAST(sum(amount) AS BIGINT) AS total, max(CASE WHEN amount > {NOTE_MOST} THEN 1 ELSE 0 END) = 0 AS notes FROM clustered GROUP BY page, col"),
        ("periods", "SELECT page, col, n, x_low, x_high, total FROM columns WHERE n >= 2 AND NOT notes"),
    ]


def inferred(d: Spark):
    """Columns where no header names them: figures that end within 2 % of the page's width of each other, two at least, not all notes."""
    row = "PARTITION BY page ORDER BY x1, amount"
    return [
        ("near", f"SELECT page, x0, x1, amount, CASE WHEN x1 - lag(x1) OVER ({row}) <= 0.02 * width THEN 0 ELSE 1 END AS opens FROM boxes"),
        ("grouped_edges", f"SELECT *, sum(opens) OVER ({row} ROWS UNBOUNDED PRECEDING) AS col FROM near"),
        ("inferred", f"SELECT page, CAST(col AS BIGINT) AS col, count(*) AS n, min(x0) AS x_low, max(x1) AS x_high FROM grouped_edges GROUP BY page, col HAVING count(*) >= 2 AND max(abs(amount)) > {NOTE_MOST}"),
    ]


def right_edge(d: Spark):
    """Where the figures of the current column end: the upper median of each row's nearest figure that touches no other column.

    ``ranges`` (page, low, high, other_low, other_high) are the current column and the one beside it.
    """
    return [
        ("free", "SELECT boxes.page, row_no, x1, row_number() OVER (PARTITION BY boxes.page, row_no ORDER BY abs(x0 + x1 - low - high), x1) AS near FROM boxes JOIN ranges ON boxes.page = ranges.page WHERE NOT (x0 < other_high AND x1 > other_low)"),
        ("edges", "SELECT page, x1, row_number() OVER (PARTITION BY page ORDER BY x1) AS k, count(*) OVER (PARTITION BY page) AS n FROM free WHERE near = 1"),
        ("edge", "SELECT page, max(CASE WHEN k = floor(n / 2) + 1 THEN x1 END) AS edge FROM edges GROUP BY page"),
    ]


#: A figure of a fused cell, a figure welded to the text after it, a vehicle's registration.
TOKEN = r"\(?-?\s*(?:\d{1,3}(?:,\d{2,3})+|\d{3,})(?:\.\d{1,3})?\s*\)?"
WELDED = r"^(\(?\s*[\d,\s]+(?:[.,]\d{1,3})?\s*\)?)\s*(.+)$"
VEHICLE = r"\b[A-Za-z]{2}[\s-]*\d{1,2}[\s-]*(?:[A-Za-z]{1,3}[\s-]*)?\d{3,4}\b"


def labelled(d: Spark, x: str) -> str:
    return f"({d.match(x, '[A-Za-z]{3}')} OR {d.match(x, VEHICLE)})"


def cell_amount(d: Spark, x: str) -> str:
    """The figure that fills a cell: grouped or with decimals, or a bare number of four digits and more that is no year."""
    bare = f"try_cast({d.replace(x, '[^0-9]')} AS BIGINT)"
    digits = d.replace(d.replace(x, r"[.,]\s?00\s*\)?\s*$"), r"[^0-9.]")
    sign = f"CASE WHEN {x} LIKE '%(%)%' OR trim({x}) LIKE '-%' THEN -1 ELSE 1 END"
    return f"CASE WHEN {d.match(x, r'^\s*-?\d{4,}\s*$')} THEN CASE WHEN NOT {bare} BETWEEN 1900 AND 2100 THEN CAST({bare} AS DOUBLE) * {sign} END WHEN {d.match(x, r'^\s*\(?\s*-?\s*(\d{1,3}(,\d{2,3})+(\.\d{1,3})?|\d+\.\d{1,3}|\d{3})\s*\)?\s*$')} THEN {d.number(digits)} * {sign} END"


def split_cells(d: Spark):
    """``raw_cells`` (id, x0, x1, text): fused figures as a cell each, a figure welded to a label as two, widths by length.

    Each part says its figure and whether it carries a label.
    """
    tokens = d.hits("trim(text)", TOKEN)
    run = d.match("trim(text)", rf"^{TOKEN}(?:\s+{TOKEN})+$")
    head, rest = d.extract("trim(text)", WELDED, 1), d.extract("trim(text)", WELDED, 2)
    welded = f"{d.match('trim(text)', WELDED)} AND {labelled(d, rest)}"
    lengths = lambda k: f"length({d.joined(d.sliced('parts', k), '')})"
    return [
        ("parted", f"SELECT id, x0, x1, CASE WHEN {run} THEN {tokens} ELSE {d.list(['text'])} END AS parts FROM raw_cells"),
        ("numbered_parts", f"SELECT *, {d.each(d.series('1', d.size('parts')))} AS k FROM parted"),
        ("runs", f"SELECT id, k, x0 + (x1 - x0) * {lengths('k - 1')} / greatest({lengths(d.size('parts'))}, 1) AS x0, x0 + (x1 - x0) * {lengths('k')} / greatest({lengths(d.size('parts'))}, 1) AS x1, trim({d.pick('parts', 'k')}) AS text FROM numbered_parts"),
        ("cut", f"SELECT id, k, x0, x1, text, {welded} AS welded, x0 + (x1 - x0) * length({head}) / greatest(length(trim(text)), 1) AS middle, trim({head}) AS head, trim({rest}) AS rest FROM runs"),
        ("halves", "SELECT id, k, 1 AS half, x0, CASE WHEN welded THEN middle ELSE x1 END AS x1, CASE WHEN welded THEN head ELSE text END AS text FROM cut UNION ALL SELECT id, k, 2, middle, x1, rest FROM cut WHERE welded"),
        ("split_cells", f"SELECT id, CAST(k AS BIGINT) AS k, half, round(x0, 6) AS x0, round(x1, 6) AS x1, text, {cell_amount(d, 'text')} AS amount, {labelled(d, 'text')} AS labelled FROM halves"),
    ]


def overlapping(d: Spark, share: float = 0.3):
    """Boxes one after the other in a row that overlap by more than ``share`` of the narrower one."""
    row = "PARTITION BY page, row_no ORDER BY x0, x1, text"
    common = "least(x1, p1) - greatest(x0, p0)"
    return [
        ("followed", f"SELECT page, row_no, x0, x1, lag(x0) OVER ({row}) AS p0, lag(x1) OVER ({row}) AS p1 FROM boxes"),
        ("overlapping", f"SELECT page, row_no, x0, x1, p0, p1, {common} > {share} * greatest(least(x1 - x0, p1 - p0), 1) AS overlap FROM followed WHERE p0 IS NOT NULL"),
    ]


def filled_tags(d: Spark):
    """A section's tag holds for the lines below it until the next."""
    return [("tagged", f"SELECT page, row_no, label, {d.last('tag', 'PARTITION BY page ORDER BY row_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW')} AS tag FROM rows_in")]


def divider_gaps(d: Spark, most: int = 8):
    """Where a two-sided page may be divided: its centre, then the middles of the widest gaps in the band between 30 % and 70 % of its width.

    A middle within 2 % of the width of one before it is passed over; ``most`` are kept, in order.
    """
    steps = [
        ("marks", "SELECT DISTINCT page, width, x0 AS x FROM boxes WHERE x0 BETWEEN 0.3 * width AND 0.7 * width"),
        ("gaps", "SELECT page, width, (x + lead(x) OVER (PARTITION BY page ORDER BY x)) / 2 AS middle, lead(x) OVER (PARTITION BY page ORDER BY x) - x AS gap FROM marks"),
        ("middles", f"SELECT page, max(width) AS width, {d.in_order('middle', 'struct(-gap, middle)' if d.name == 'spark' else '-gap, middle')} AS middles FROM gaps WHERE gap IS NOT NULL GROUP BY page"),
    ]
    if d.name != "spark":
        return steps
    return [
        *steps,
        ("kept", f"SELECT page, aggregate(middles, array(width / 2), (acc, m) -> CASE WHEN size(acc) < {most} AND forall(acc, o -> abs(m - o) >= 0.02 * width) THEN array_append(acc, m) ELSE acc END) AS dividers FROM middles"),
        ("dividers", "SELECT page, CAST(pos + 1 AS INT) AS k, col AS middle FROM kept LATERAL VIEW posexplode(dividers) AS pos, col"),
    ]
