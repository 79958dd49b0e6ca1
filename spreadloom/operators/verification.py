"""Does a statement reproduce its own printed totals? Relations over ``blocks_in`` and ``lines_in``.

blocks_in: block, doc, kind, entity, year, scale, printed. lines_in: block, seq, side, section, name (of the section),
label, amount, total (the section's printed total).
"""

from __future__ import annotations

from spreadloom.plans.dialect import Spark

#: Rupees that a sum may miss, the share a salvaged section may miss, words of an income line.
TOLERANCE, SALVAGE = 2, 0.005
ASSETS_TOTAL = r"total\s+assets\b"
LIABILITIES_TOTAL = r"total\s+equity\s+(?:and|&)\s+liabilit|total\s+liabilit\w*\s+(?:and|&)\s+equity"
REVENUE_TOTAL = r"total\s+revenue|total\s+income\b|^\s*(?:[A-Z]{1,4}\s*[\].):]\s*|[IVX]{1,4}\s+)?(?:income|revenue)\s*[:\-\s]*$"
EXPENSE_TOTAL = r"total\s+expen(?:ses?|diture)\b|^\s*(?:[A-Z]{1,4}\s*[\].):]\s*|[IVX]{1,4}\s+)?expen(?:ses?|diture)\s*[:\-\s]*$"
INCOME_LINE = r"^\[INC\]|revenue|\bsales?\b|turnover|receipts?\b|\bincome\b|\bfare\b|freight\s+(received|income)|commission\s+received"


def tolerance(scale: str, n: str) -> str:
    """Half a printed unit for each line of a statement that is not in rupees."""
    return f"CASE WHEN {scale} <= 1 THEN {float(TOLERANCE)} ELSE {TOLERANCE} + (CASE WHEN {scale} <= 1000 THEN {scale} / 2.0 ELSE {scale} / 200.0 END) * greatest({n}, 1) END"


def account_checks(d: Spark):
    """Two-sided accounts: left against right against the printed total; a one-sided P&L needs an income line."""
    tol = f"CAST({tolerance('scale', 'n')} AS DOUBLE)"
    return [
        ("sides", f"SELECT block, count(*) AS n, CAST(sum(CASE WHEN side = 'left' THEN amount ELSE 0 END) AS BIGINT) AS l, CAST(sum(CASE WHEN side = 'right' THEN amount ELSE 0 END) AS BIGINT) AS r, count(CASE WHEN side = 'right' THEN 1 END) AS right_n, max(CASE WHEN {d.match('label', INCOME_LINE)} THEN 1 ELSE 0 END) AS income FROM lines_in GROUP BY block"),
        ("weighed", f"SELECT blocks_in.block, kind, coalesce(n, 0) AS n, l, r, right_n, income, printed, {tol.replace('n, 1', 'coalesce(n, 0), 1')} AS tol FROM blocks_in LEFT JOIN sides ON blocks_in.block = sides.block"),
        (
            "reasons",
            """SELECT *, CASE WHEN n = 0 THEN 'no items' WHEN right_n = 0 AND printed IS NULL THEN 'nothing to check' WHEN right_n = 0 AND kind = 'profit_loss' AND income = 0 THEN 'one-sided'
          WHEN right_n = 0 AND abs(printed - l) > tol THEN 'total differs' WHEN right_n > 0 AND abs(l - r) > tol THEN 'sides differ' WHEN right_n > 0 AND abs(l - printed) > tol THEN 'total differs' END AS reason FROM weighed""",
        ),
        ("checks", "SELECT block, l AS left_total, r AS right_total, printed, CASE WHEN right_n = 0 THEN coalesce(printed, l) - l ELSE r - l END AS shortfall, reason, CASE WHEN reason IS NULL THEN 'verified' WHEN reason = 'nothing to check' THEN 'unverified' ELSE 'failed' END AS status FROM reasons"),
    ]


def section_checks(d: Spark):
    """Vertical statements: each printed section total against its items, then what a block's sections say together.

    A balance sheet is verified by its two named grand totals, else by two printed totals that agree; a profit and loss
    account needs a named total of both sides. A failed block can be salvaged when every failing section is off by at most
    the share ``SALVAGE`` of its total, and the block is sound once these sections' totals are set to their items' sum.
    """
    tol = f"CAST({tolerance('scale', '(n + 1)')} AS DOUBLE)"
    pair = f"CAST({tolerance('scale', '2')} AS DOUBLE)"
    named = {"assets": ASSETS_TOTAL, "liabilities": LIABILITIES_TOTAL, "revenue": REVENUE_TOTAL, "expense": EXPENSE_TOTAL}
    first = ", ".join(f"min(CASE WHEN closed IS NOT NULL AND {d.match("coalesce(name, '')", p)} THEN section END) AS {k}_at" for k, p in named.items())
    values = ", ".join(f"max(CASE WHEN section = {k}_at THEN closed END) AS {k}" for k in named)
    return [
        ("totals", "SELECT lines_in.block, section, max(name) AS name, max(scale) AS scale, max(kind) AS kind, count(*) AS n, CAST(sum(amount) AS BIGINT) AS items, max(total) AS total FROM lines_in JOIN blocks_in ON lines_in.block = blocks_in.block GROUP BY lines_in.block, section"),
        ("sections", f"SELECT block, section, n, items, total, total - items AS gap, CASE WHEN total IS NULL OR n < 2 THEN 'none' WHEN abs(total - items) <= {tol} THEN 'pass' ELSE 'fail' END AS result, name, scale, kind FROM totals"),
        ("closed_sections", f"SELECT *, CASE WHEN result = 'fail' THEN items ELSE total END AS closed, {pair} AS pair_tol FROM sections"),
        ("placed_names", f"SELECT block, {first} FROM closed_sections GROUP BY block"),
        ("named_totals", f"SELECT c.block, max(kind) AS kind, max(pair_tol) AS pair_tol, {values} FROM closed_sections AS c JOIN placed_names AS p ON c.block = p.block GROUP BY c.block"),
        ("falling", "SELECT block, closed, pair_tol, lead(closed) OVER (PARTITION BY block ORDER BY closed DESC, section) AS following FROM closed_sections WHERE closed IS NOT NULL"),
        ("paired", "SELECT block, max(CASE WHEN closed - following <= pair_tol THEN 1 ELSE 0 END) AS paired FROM falling GROUP BY block"),
        (
            "structure",
            """SELECT t.block, CASE WHEN kind = 'balance_sheet' AND assets IS NOT NULL AND liabilities IS NOT NULL THEN CASE WHEN abs(assets - liabilities) <= pair_tol THEN 'sound' ELSE 'grand totals differ' END
          WHEN kind = 'balance_sheet' THEN CASE WHEN coalesce(paired, 0) = 1 THEN 'sound' ELSE 'no grand total' END
          WHEN kind = 'profit_loss' AND (revenue IS NULL OR expense IS NULL) THEN 'one side' ELSE 'sound' END AS structure FROM named_totals AS t LEFT JOIN paired ON t.block = paired.block""",
        ),
        (
            "tallied",
            f"""SELECT block, count(CASE WHEN result = 'pass' THEN 1 END) AS passed, count(CASE WHEN result = 'fail' THEN 1 END) AS failed,
          max(CASE WHEN result = 'fail' AND abs(gap) > {SALVAGE} * CASE WHEN total <> 0 THEN abs(total) ELSE greatest(abs(items), 1) END THEN 1 ELSE 0 END) AS far FROM sections GROUP BY block""",
        ),
        (
            "verdicts",
            """SELECT tallied.block, passed, failed, structure, CASE WHEN passed + failed = 0 THEN 'unverified' WHEN failed > 0 THEN 'failed' WHEN structure = 'sound' THEN 'verified' WHEN structure = 'no grand total' THEN 'unverified' ELSE 'failed' END AS status,
          failed > 0 AND far = 0 AND structure = 'sound' AS salvageable FROM tallied JOIN structure ON tallied.block = structure.block""",
        ),
    ]


def item_trust(d: Spark):
    """proven, consistent or doubtful for each line; an unverified block proves nothing."""
    return [*section_checks(d), ("item_trust", "SELECT lines_in.block, seq, amount, CASE WHEN result = 'fail' THEN 'doubtful' WHEN result = 'pass' AND status <> 'unverified' THEN 'proven' ELSE 'consistent' END AS trust FROM lines_in JOIN sections ON lines_in.block = sections.block AND lines_in.section = sections.section JOIN verdicts ON lines_in.block = verdicts.block")]


def grand_totals(d: Spark):
    """Printed totals of a block that agree within the tolerance of two figures (adjacent in falling order)."""
    tol = f"CAST({tolerance('scale', '2')} AS DOUBLE)"
    return [
        ("ranked", f"SELECT t.block, section, total, {tol} AS tol, lead(total) OVER (PARTITION BY t.block ORDER BY total DESC, section) AS following FROM (SELECT block, section, max(total) AS total FROM lines_in GROUP BY block, section) AS t JOIN blocks_in ON t.block = blocks_in.block WHERE total IS NOT NULL"),
        ("agreed", "SELECT block, count(*) AS totals, max(CASE WHEN total - following <= tol THEN 1 ELSE 0 END) = 1 AS agree, CAST(max(CASE WHEN total - following <= tol THEN total END) AS BIGINT) AS grand_total FROM ranked GROUP BY block"),
    ]


def row_ends(d: Spark) -> tuple[str, str]:
    """Rows (sections of ``lines_in``) with their first and last figure; zeros are no figures."""
    return ("row_ends", f"SELECT block, section, count(*) AS n, min_by(amount, seq) AS first_figure, max_by(amount, seq) AS last_figure, max(amount) AS most, max(CASE WHEN {d.match('label', r'^\s*total\b')} THEN 1 ELSE 0 END) AS named FROM lines_in WHERE amount <> 0 GROUP BY block, section")


def printed_total(d: Spark):
    """From the bottom: the first row whose first and last figures are equal, or whose words say total."""
    return [
        row_ends(d),
        ("found", "SELECT *, row_number() OVER (PARTITION BY block ORDER BY section DESC) AS k FROM row_ends WHERE (n >= 2 AND abs(first_figure - last_figure) <= 2) OR named = 1"),
        ("printed", "SELECT block, section, CASE WHEN n >= 2 AND abs(first_figure - last_figure) <= 2 THEN first_figure ELSE most END AS printed_total FROM found WHERE k = 1"),
    ]


def subset_columns(d: Spark):
    """The non-empty subset of columns (sections) whose sum is nearest to the printed total: fewest, then rightmost.

    All subsets of all columns are tried, two to the power of their number; masks are made and summed within a block's row.
    """
    subset = f"aggregate(transform(amounts, (a, i) -> {d.bit('mask', 'i')} * a), CAST(0 AS BIGINT), (s, a) -> s + a)" if d.name == "spark" else f"list_sum([{d.bit('mask', 'i - 1')} * amounts[i] for i in range(1, len(amounts) + 1)])"
    return [
        ("columns_of", "SELECT lines_in.block, section, CAST(sum(amount) AS BIGINT) AS amount, max(printed) AS printed FROM lines_in JOIN blocks_in ON lines_in.block = blocks_in.block WHERE printed IS NOT NULL GROUP BY lines_in.block, section"),
        ("gathered", f"SELECT block, max(printed) AS printed, count(*) AS k, {d.in_order('amount', 'section')} AS amounts FROM columns_of GROUP BY block"),
        ("masks", f"SELECT *, {d.each(d.series('1', f'{d.shift("k")} - 1'))} AS mask FROM gathered"),
        ("subsets", f"SELECT block, mask, CAST(abs({subset} - printed) AS BIGINT) AS off, bit_count(mask) AS n FROM masks"),
        # the highest bit is the rightmost column
        ("picked", "SELECT block, CAST(mask AS INT) AS mask, off, CAST(n AS BIGINT) AS n FROM (SELECT *, row_number() OVER (PARTITION BY block ORDER BY off, n, length(bin(mask)) DESC, mask) AS k FROM subsets) AS s WHERE k = 1"),
    ]


#: Columns of a side up to which both sides are solved together.
JOINT = 8


def joint_subset(d: Spark, most: int = JOINT, accept: str = "TRUE"):
    """Both sides' columns chosen so that their sums agree within the tolerance: fewest columns, then the rightmost.

    A block with a side of no or of more than ``most`` columns has no answer. ``accept`` is a condition over the lines of
    a reading on each side, ``l.lines`` and ``r.lines``. Readings are met on their sums, rounded to the tolerance.
    """
    both = []
    for side in ("left", "right"):
        both += [
            (f"{side}_columns", f"SELECT block, section, CAST(sum(amount) AS BIGINT) AS amount, count(*) AS lines, row_number() OVER (PARTITION BY block ORDER BY section) - 1 AS place, count(*) OVER (PARTITION BY block) AS k FROM lines_in WHERE side = '{side}' GROUP BY block, section"),
            (f"{side}_masks", f"SELECT block, {d.each(d.series('1', f'{d.shift("k")} - 1'))} AS mask FROM (SELECT block, max(k) AS k FROM {side}_columns GROUP BY block) AS m WHERE k <= {most}"),
            (f"{side}_sums", f"SELECT m.block, mask, CAST(sum(amount) AS BIGINT) AS total, count(*) AS n, max(section) AS reach, sum(lines) AS lines FROM {side}_masks AS m JOIN {side}_columns AS c ON m.block = c.block AND {d.bit('mask', 'place')} = 1 GROUP BY m.block, mask"),
        ]
    cell = TOLERANCE + 1
    return [
        *both,
        ("right_cells", f"SELECT *, floor(total / CAST({cell} AS DOUBLE)) + near AS cell FROM (SELECT *, {d.each(d.series('-1', '1'))} AS near FROM right_sums) AS s"),
        ("pairs", f"SELECT l.block, l.mask AS left_mask, r.mask AS right_mask, l.total, l.n + r.n AS n, row_number() OVER (PARTITION BY l.block ORDER BY l.n + r.n, l.reach + r.reach DESC, l.mask, r.mask) AS k FROM left_sums AS l JOIN right_cells AS r ON l.block = r.block AND floor(l.total / CAST({cell} AS DOUBLE)) = r.cell AND abs(l.total - r.total) <= {TOLERANCE} WHERE {accept}"),
        ("joint", "SELECT block, CAST(left_mask AS INT) AS left_mask, CAST(right_mask AS INT) AS right_mask, total, n FROM pairs WHERE k = 1"),
    ]


def group_expand(d: Spark):
    """A chosen line gives way to the shortest run of unchosen lines right after it that sums to it (prefix sums).

    ``entries``: block, side, seq, amount, chosen. The rows are the lines that stand: chosen ones without such a run, and
    the runs of the others.
    """
    return [
        ("heads", "SELECT *, sum(CASE WHEN chosen THEN 1 ELSE 0 END) OVER (PARTITION BY block, side ORDER BY seq ROWS UNBOUNDED PRECEDING) AS head FROM entries"),
        ("runs", "SELECT *, sum(CASE WHEN chosen THEN amount END) OVER (PARTITION BY block, side, head) AS target, sum(CASE WHEN chosen THEN 0 ELSE amount END) OVER (PARTITION BY block, side, head ORDER BY seq ROWS UNBOUNDED PRECEDING) AS run FROM heads WHERE head > 0"),
        ("ends", f"SELECT *, min(CASE WHEN NOT chosen AND abs(run - target) <= {TOLERANCE} THEN seq END) OVER (PARTITION BY block, side, head) AS until FROM runs"),
        ("expanded", "SELECT block, side, seq, amount, NOT chosen AS of_group FROM ends WHERE CASE WHEN chosen THEN until IS NULL ELSE seq <= until END"),
    ]


def segments(d: Spark):
    """Blocks from rows: every title opens one, a footer ends it."""
    return [
        ("opened", "SELECT doc, row_no, what, sum(CASE WHEN what = 'title' THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY row_no ROWS UNBOUNDED PRECEDING) AS block FROM rows_in"),
        ("footed", "SELECT *, max(CASE WHEN what = 'footer' THEN 1 ELSE 0 END) OVER (PARTITION BY doc, block ORDER BY row_no ROWS UNBOUNDED PRECEDING) AS past FROM opened"),
        ("segments", "SELECT doc, CAST(block AS BIGINT) AS block, min(row_no) AS first_row, max(row_no) AS last_row, count(*) AS n FROM footed WHERE block > 0 AND past = 0 GROUP BY doc, block"),
    ]


def schedules(d: Spark):
    """Groups between a heading and their own total; verified when the items add up to it within max(2, n) units."""
    return [("groups", "SELECT block, section, count(*) AS n, CAST(sum(amount) AS BIGINT) AS items, max(total) AS total FROM lines_in GROUP BY block, section"), ("schedules", "SELECT groups.block, section, n, items, total, coalesce(abs(items - total) <= greatest(2, n) * scale, FALSE) AS verified FROM groups JOIN blocks_in ON groups.block = blocks_in.block")]
