"""Statements of several files as years: placing, duplicates, alternates, recovery. Relations over ``blocks``.

docs: doc, case_id (the borrower whose upload it is), ay, name; blocks: block, doc, case_id, kind, entity, year (NULL when
undated), page, status, salvageable, n_items, comparative; amounts: block, amount. Blocks of two cases never meet.
"""

from __future__ import annotations

from spreadloom.functions import scalars
from spreadloom.plans.dialect import Spark

SHARE = 0.5
#: Kinds that make a spread.
SPREAD = "kind IN ('balance_sheet', 'profit_loss')"


def semi(d: Spark, keep: str = "semi") -> str:
    return f"LEFT {keep.upper()} JOIN" if d.name == "spark" else f"{keep.upper()} JOIN"


def entity_key(d: Spark) -> str:
    """Letters and digits of an entity; a block without one has none of them."""
    return scalars.norm_entity(d, "coalesce(entity, '')")


def file_year(d: Spark):
    """The commonest year of a file's blocks; of equal ones the assessment's, else the earliest."""
    return [
        ("counted", "SELECT doc, year, count(*) AS n FROM blocks WHERE year IS NOT NULL GROUP BY doc, year"),
        ("ordered", "SELECT counted.doc, year, n, row_number() OVER (PARTITION BY counted.doc ORDER BY n DESC, CASE WHEN year = ay THEN 0 ELSE 1 END, year) AS k FROM counted JOIN docs ON counted.doc = docs.doc"),
        ("file_year", "SELECT docs.doc, coalesce(year, ay) AS year FROM docs LEFT JOIN (SELECT doc, year FROM ordered WHERE k = 1) AS o ON docs.doc = o.doc"),
    ]


def nearest_dated(d: Spark, most: int = 2):
    """An undated block takes the nearest dated one's year, the same entity's first, if it is at most ``most`` pages off.

    The nearest before and after, of any and of the same entity, come from two ordered passes; no pairs are formed.
    """
    back = "ORDER BY page, block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    ahead = "ORDER BY page, block ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING"
    picks = []
    for group, by in (("own", "PARTITION BY doc, e"), ("all", "PARTITION BY doc")):
        picks += [f"{d.last(f'CASE WHEN year IS NOT NULL THEN {c} END', f'{by} {back}')} AS {group}_{c}_b, {d.first(f'CASE WHEN year IS NOT NULL THEN {c} END', f'{by} {ahead}')} AS {group}_{c}_a" for c in ("year", "page")]
    choice = lambda g, c: f"CASE WHEN {g}_page_b IS NOT NULL AND ({g}_page_a IS NULL OR page - {g}_page_b <= {g}_page_a - page) THEN {g}_{c}_b ELSE {g}_{c}_a END"
    return [
        ("keyed", f"SELECT *, {entity_key(d)} AS e FROM blocks"),
        ("around", f"SELECT block, doc, entity, page, year, {', '.join(picks)} FROM keyed"),
        ("nearest", f"SELECT block, doc, page, coalesce({choice('own', 'year')}, {choice('all', 'year')}) AS near_year, coalesce({choice('own', 'page')}, {choice('all', 'page')}) AS near_page FROM around WHERE year IS NULL"),
        ("inferred", f"SELECT block, CASE WHEN abs(page - near_page) <= {most} THEN near_year END AS year FROM nearest"),
    ]


def main_entity(d: Spark):
    """The commonest plausible entity of verified blocks, else of all, else the return's own name; ties go to the earliest block."""
    return [
        ("tallies", f"SELECT doc, entity, count(CASE WHEN status = 'verified' THEN 1 END) AS v, count(*) AS n, min(block) AS first_block FROM blocks WHERE entity IS NOT NULL AND {scalars.is_business(d, 'entity')} GROUP BY doc, entity"),
        ("foremost", "SELECT doc, entity FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY v DESC, n DESC, first_block) AS k FROM tallies) AS t WHERE k = 1"),
        ("main_entity", f"SELECT docs.doc, coalesce(entity, CASE WHEN {scalars.is_business(d, 'name')} THEN name END) AS entity FROM docs LEFT JOIN foremost ON docs.doc = foremost.doc"),
    ]


def overlaps(d: Spark):
    """Pairs of blocks of one entity, kind and year that share more than half of the first one's amounts.

    A block meets others on its rarest amounts alone: of n amounts, more than half are shared, so at least one of any
    n - floor(n / 2) is. Amounts that many blocks share meet only where a block has no rarer ones; pairs that met are then
    counted on all amounts.
    """
    return [
        ("own", f"SELECT DISTINCT blocks.block, doc, {entity_key(d)} AS e, kind, year, n_items, status, amount FROM blocks JOIN amounts ON blocks.block = amounts.block WHERE amount <> 0 AND year IS NOT NULL"),
        ("uses", "SELECT doc, e, kind, year, amount, count(*) AS uses FROM own GROUP BY doc, e, kind, year, amount"),
        ("ranked", "SELECT own.*, row_number() OVER (PARTITION BY block ORDER BY uses, own.amount) AS k, count(*) OVER (PARTITION BY block) AS n FROM own JOIN uses ON own.doc = uses.doc AND own.e = uses.e AND own.kind = uses.kind AND own.year = uses.year AND own.amount = uses.amount"),
        ("met", "SELECT DISTINCT a.block, b.block AS rival FROM ranked AS a JOIN own AS b ON a.doc = b.doc AND a.e = b.e AND a.kind = b.kind AND a.year = b.year AND a.amount = b.amount AND a.block <> b.block WHERE a.k <= a.n - floor(a.n / 2)"),
        ("shared", "SELECT met.block, rival, count(*) AS n, max(a.n) AS of FROM met JOIN ranked AS a ON met.block = a.block JOIN own AS b ON rival = b.block AND a.amount = b.amount GROUP BY met.block, rival"),
        ("overlapping", f"SELECT block, rival, n AS shared, of FROM shared WHERE n > {SHARE} * of"),
    ]


def deduped(d: Spark):
    """Blocks without a rival that holds most of their amounts and ranks higher (verified, more items, earlier)."""
    rank = "CASE WHEN {0}.status = 'verified' THEN 1 ELSE 0 END"
    mine, theirs = rank.format("m"), rank.format("t")
    return [
        *overlaps(d),
        ("beaten", f"SELECT DISTINCT overlapping.block FROM overlapping JOIN blocks AS m ON overlapping.block = m.block JOIN blocks AS t ON overlapping.rival = t.block WHERE {theirs} > {mine} OR ({theirs} = {mine} AND (t.n_items > m.n_items OR (t.n_items = m.n_items AND t.block < m.block)))"),
        ("deduped", f"SELECT blocks.block, doc, kind, year FROM blocks {semi(d, 'anti')} beaten ON blocks.block = beaten.block"),
    ]


def placed(d: Spark):
    """The year of every block: its own, else its file's; but a misread date stays with its file.

    A block of a spread kind dated otherwise than its file moves, unless the case's files about that year hold the same
    entity's statement of the kind with other figures. With more than half of its figures in one of them it is a reprint
    and moves. A comparative column is never moved and claims nothing.
    """
    key = "m.case_id = c.case_id AND m.e = c.e AND m.kind = c.kind AND m.y = c.y"
    return [
        *file_year(d),
        ("dated", f"SELECT blocks.block, blocks.doc, blocks.case_id, {entity_key(d)} AS e, kind, coalesce(blocks.year, file_year.year) AS y, file_year.year AS fy, comparative FROM blocks JOIN file_year ON blocks.doc = file_year.doc"),
        ("claims", f"SELECT * FROM dated WHERE NOT comparative AND {SPREAD} AND y = fy"),
        ("moving", f"SELECT * FROM dated WHERE NOT comparative AND {SPREAD} AND y <> fy"),
        ("figures", "SELECT DISTINCT block, amount FROM amounts WHERE amount <> 0"),
        ("claimed_figures", "SELECT c.*, amount FROM claims AS c JOIN figures ON c.block = figures.block"),
        ("moving_figures", "SELECT m.*, amount, count(*) OVER (PARTITION BY m.block) AS n FROM moving AS m JOIN figures ON m.block = figures.block"),
        ("repeats", f"SELECT m.block, c.block AS rival, count(*) AS shared, max(m.n) AS n FROM moving_figures AS m JOIN claimed_figures AS c ON {key} AND m.amount = c.amount GROUP BY m.block, c.block"),
        ("reprints", f"SELECT DISTINCT block FROM repeats WHERE shared > {SHARE} * n"),
        ("contested", f"SELECT m.block FROM moving AS m {semi(d)} claims AS c ON {key}"),
        ("misdated", f"SELECT contested.block FROM contested {semi(d, 'anti')} reprints ON contested.block = reprints.block"),
        ("placed", "SELECT dated.block, case_id, doc, kind, comparative, CASE WHEN misdated.block IS NULL THEN y ELSE fy END AS year, misdated.block IS NOT NULL AS misdated FROM dated LEFT JOIN misdated ON dated.block = misdated.block"),
    ]


def alternates(d: Spark, keep: str):
    """Comparative blocks of a case's year and kind that an own, readable statement covers (semi), or that nothing covers (anti).

    Years are those of ``placed``; a failed statement that can be salvaged is readable.
    """
    return [
        *placed(d),
        ("owned", f"SELECT DISTINCT placed.case_id, coalesce(placed.year, -1) AS y, placed.kind AS k FROM placed JOIN blocks ON placed.block = blocks.block WHERE NOT placed.comparative AND blocks.{SPREAD} AND (status <> 'failed' OR salvageable)"),
        ("printed", "SELECT block, doc, case_id, kind, year FROM placed WHERE comparative"),
        ("found", f"SELECT block, doc, kind, year FROM printed {semi(d, keep)} owned ON printed.case_id = owned.case_id AND coalesce(year, -1) = y AND kind = k"),
    ]


def years(d: Spark):
    """The columns of a case: its placed years, then those of files without statements; an undated group only if it is usable.

    ``k`` is the order of a case's columns, the undated last; ``what`` says why a column stands.
    """
    return [
        *placed(d),
        ("held", f"SELECT placed.case_id, placed.year, count(*) AS n_blocks, count(DISTINCT placed.doc) AS n_docs, max(CASE WHEN blocks.{SPREAD} AND status <> 'failed' THEN 1 ELSE 0 END) AS usable FROM placed JOIN blocks ON placed.block = blocks.block GROUP BY placed.case_id, placed.year"),
        ("empties", f"SELECT DISTINCT case_id, ay AS year FROM docs {semi(d, 'anti')} blocks ON docs.doc = blocks.doc WHERE ay IS NOT NULL"),
        ("bare", f"SELECT empties.case_id, empties.year FROM empties {semi(d, 'anti')} held ON empties.case_id = held.case_id AND empties.year = held.year"),
        ("all_years", "SELECT case_id, year, n_blocks, 'statements' AS what FROM held WHERE year IS NOT NULL OR usable = 1 UNION ALL SELECT case_id, year, CAST(0 AS BIGINT), 'no statements' FROM bare"),
        ("years", "SELECT *, CAST(row_number() OVER (PARTITION BY case_id ORDER BY CASE WHEN year IS NULL THEN 1 ELSE 0 END, year) AS INT) AS k FROM all_years"),
    ]


def notes(d: Spark):
    """Files that give no column: without statements and a year, or with undated ones that could not be used."""
    return [
        *years(d),
        ("unusable", "SELECT case_id FROM held WHERE year IS NULL AND usable = 0"),
        ("notes", f"""SELECT doc, 'no financial statements found in it' AS note FROM docs {semi(d, 'anti')} blocks ON docs.doc = blocks.doc WHERE ay IS NULL
          UNION ALL SELECT DISTINCT doc, 'its statements could not be read or dated' AS note FROM placed {semi(d)} unusable ON placed.case_id = unusable.case_id WHERE year IS NULL"""),
    ]


def without_blocks(d: Spark):
    return [("without", f"SELECT docs.doc, ay FROM docs {semi(d, 'anti')} blocks ON docs.doc = blocks.doc")]


def vision_pages(d: Spark, most: int = 6):
    """The pages of a file worth reading again: failed before others, larger first."""
    return [("ranked", "SELECT doc, block, page, status, n_items, row_number() OVER (PARTITION BY doc ORDER BY CASE WHEN status = 'failed' THEN 0 ELSE 1 END, n_items DESC, block) AS k FROM blocks WHERE status <> 'verified'"), ("vision_pages", f"SELECT doc, block, page, CAST(k AS INT) AS k FROM ranked WHERE k <= {most}")]


def recovered(d: Spark):
    """A total that a year lacks, from the next year's verified comparative of the year before."""
    w = "OVER (PARTITION BY entity ORDER BY year)"
    return [
        ("following", f"SELECT entity, year, total_assets, lead(year) {w} AS next_year, lead(p_assets) {w} AS next_p, lead(verified) {w} AS next_verified FROM columns_in"),
        ("recovered", "SELECT entity, year, total_assets IS NULL AND next_year = year + 1 AND next_verified AS filled, CASE WHEN total_assets IS NULL AND next_year = year + 1 AND next_verified THEN next_p ELSE total_assets END AS total_assets FROM following"),
    ]


def nil(d: Spark, least: int = 100_000):
    return [("biggest", "SELECT block, max(abs(amount)) AS biggest FROM amounts GROUP BY block"), ("nil", f"SELECT block, biggest, biggest < {least} AS nil FROM biggest")]


def pruned(d: Spark, cap: int, oldest: str):
    """Cache entries to drop: out of date, then the least recent beyond the size cap.

    Sizes are summed by day first; only the day in which the cap is crossed is ordered entry by entry.
    """
    day = "date_trunc('day', used)"
    return [
        ("aged", f"SELECT id, bytes, used, {day} AS day, used < {oldest} AS expired FROM entries"),
        ("days", "SELECT day, sum(bytes) AS own FROM aged WHERE NOT expired GROUP BY day"),
        ("later", "SELECT day, own, sum(own) OVER (ORDER BY day DESC ROWS UNBOUNDED PRECEDING) - own AS before FROM days"),
        ("crossed", f"SELECT day, before FROM later WHERE before <= {cap} AND before + own > {cap}"),
        ("within", "SELECT id, before + sum(bytes) OVER (PARTITION BY aged.day ORDER BY used DESC, id ROWS UNBOUNDED PRECEDING) AS held FROM aged JOIN crossed ON aged.day = crossed.day WHERE NOT expired"),
        ("pruned", f"SELECT aged.id, CASE WHEN expired THEN 'expired' WHEN later.before > {cap} OR coalesce(held, 0) > {cap} THEN 'over the cap' ELSE 'kept' END AS fate FROM aged LEFT JOIN later ON aged.day = later.day LEFT JOIN within ON aged.id = within.id"),
    ]
