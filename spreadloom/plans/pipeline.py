"""From page words to year columns: the main path, as tables keyed by document, block and year.

words -> cells (grouped) -> rows -> blocks (windows) -> lines (grouped) -> labels, buckets, values, ratios, flags (relations).
Text-only stages never carry cells, and irrelevant rows are dropped before the grouped harvest.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spreadloom.functions import scalars
from spreadloom.operators import grouped, pooling, spread, trust
from spreadloom.operators import statements as reading
from spreadloom.plans import rules
from spreadloom.plans.dialect import SPARK
from spreadloom.plans.run import relations, written


@dataclass
class Spread:
    """The tables of a run; each is lazy."""

    cells: DataFrame
    blocks: DataFrame
    lines: DataFrame
    values: DataFrame
    ratios: DataFrame
    trends: DataFrame
    flags: DataFrame
    mapped: DataFrame


def rows_of(cells: DataFrame) -> DataFrame:
    """One row for each visual row: its text with cells joined by a tab."""
    ordered = F.sort_array(F.collect_list(F.struct("cell_no", "text")))
    # dealt by page once, for the rows and for the windows over a page's rows
    return cells.repartition("page").groupBy("page", "row_no").agg(F.array_join(F.transform(ordered, lambda c: c["text"]), "\t").alias("text"))


def blocks_of(rows: DataFrame) -> DataFrame:
    """(page, block, row_no, text, kind, year, entity, scale): rows of statements with what their headings say.

    Titles open blocks, a footer ends one; the period is read on the heading and three rows below, the unit from four
    rows above to seven below, the entity on the nearest of three rows above that names something, a proprietor's row only if no other does.
    """
    w = Window.partitionBy("page").orderBy("row_no")
    # patterns of many parts are tried where a short one of theirs matches, and where their finding is used
    text = rows.withColumns({
        "title": F.col("text").rlike(f"(?i){scalars.TITLE_WORDS}") & scalars.columns(scalars.is_title, "text"),
        "footer": F.expr(SPARK.match("text", scalars.FOOTER)),
        "period": F.when(F.col("text").rlike(f"(?i){scalars.PERIOD_WORDS}"), scalars.columns(scalars.period_year, "text")),
    })
    text = text.withColumn("above", F.coalesce(*[F.when(F.lead("title", k).over(w), True) for k in (1, 2, 3)]))
    text = text.withColumn("found", F.when(F.col("above"), scalars.columns(scalars.name_line, "text")))
    owner = F.col("found").rlike(f"(?i){scalars.PROPRIETOR}")
    text = text.withColumns({"name": F.when(~owner, F.col("found")), "owner": F.when(owner, F.col("found"))})
    band = F.concat_ws(" ", *[F.lead("text", k).over(w) for k in range(-4, 8)])
    text = text.withColumns(
        {
            "year": F.coalesce("period", *[F.lead("period", k).over(w) for k in (1, 2, 3)]),
            "entity": F.coalesce(*[F.lag(c, k).over(w) for c in ("name", "owner") for k in (1, 2, 3)]),
            "band": band,
            "block": F.sum(F.col("title").cast("int")).over(w),
        }
    )
    own = Window.partitionBy("page", "block").orderBy("row_no")
    head = lambda c: F.first(F.when(F.col("title"), F.col(c)), ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    kind = F.when(F.col("text").rlike("(?i)balance\\s*sheet|capital"), "balance_sheet").otherwise("profit_loss")
    text = text.withColumns({"kind_at": kind, "scale_at": F.when(F.col("title"), scalars.columns(scalars.unit_scale, "band"))})
    out = text.withColumns({"kind": head("kind_at"), "year": head("year"), "entity": head("entity"), "scale": head("scale_at"), "heading": head("text"), "past": F.max(F.col("footer").cast("int")).over(own)})
    return out.where("block > 0 AND past = 0 AND NOT title").select("page", "block", "row_no", "text", "kind", "year", "entity", "scale", "heading")


def harvest(cells: DataFrame, blocks: DataFrame, alone: bool = True) -> DataFrame:
    """Lines (page, block, entity, year, seq, label, amount, status, comparative) in rupees; sides of a P&L and sections give the tags.

    A comparative column gives lines of the year before; with ``alone`` only where that year has no statement of its own of
    the same entity and kind.
    """
    meta = ["page", "block", "kind", "entity", "scale"]
    placed = cells.join(blocks.select("row_no", "year", *meta), ["page", "row_no"])
    read = grouped.per_group(placed, ["page", "block"], ["row_no", "x0"], ["x1", "text", "year"], _read, "page long, block long, year int, side string, seq int, label string, amount double, status string, comparative boolean")
    lines = read.join(blocks.select(*meta).distinct(), ["page", "block"])
    tagged = F.when((F.col("kind") == "profit_loss") & (F.col("side") == "left") & ~F.col("label").startswith("["), F.concat(F.lit("[EXP] "), "label"))
    tagged = tagged.when((F.col("kind") == "profit_loss") & (F.col("side") == "right") & ~F.col("label").startswith("["), F.concat(F.lit("[INC] "), "label")).otherwise(F.col("label"))
    lines = lines.select("page", "block", F.coalesce("entity", F.lit("")).alias("entity"), "year", "kind", "seq", tagged.alias("label"), F.bround(F.col("amount") * F.col("scale")).cast("long").alias("amount"), "status", "comparative")
    if not alone:
        return lines
    own = F.min("comparative").over(Window.partitionBy("entity", "kind", "year"))
    return lines.withColumn("alone", own).where("NOT comparative OR alone").drop("alone")


def _read(key: tuple, group: list[tuple]) -> list[tuple]:
    """The reading of a block that verifies, first the one that its layout tells; else that one, but two full sides come before
    sections without a total to hold them against."""
    rows = grouped.rows_of(group)
    sides, _, status = grouped.account(rows)
    two, upright, one = all(sides.values()), grouped.upright(rows), False
    # a verified account that is not upright stays one, however its columns would read
    if upright or status != "verified":
        readings = grouped.periods(rows)
        proofs = [[abs(total - sum(v for _, v in items)) <= grouped.TOLERANCE for _, items, total in r if total is not None and len(items) > 1] for r in readings]
        proven = bool(proofs[0]) and all(proofs[0])
        if any(items for _, items, _ in readings[0]):
            one = upright or status != "verified" if proven else status != "verified" and (not two or (upright and bool(proofs[0])))
    year = group[0][4]
    named = grouped.header_years(rows) if one or year is None else []
    year = max(named, default=None) if year is None else year
    if not one:
        found = [(side, text, v) for side in ("left", "right") for _, text, v in sides[side]]
        return [(*key, year, side, k, text, v, status, False) for k, (side, text, v) in enumerate(found)]
    prior = None if year is None else max((y for y in named if y < year), default=year - 1)
    out: list[tuple] = []
    for at, (reading, proof) in enumerate(zip(readings, proofs, strict=True)):
        out += [(*key, (year, prior)[at], None, text, v, "verified" if proof and all(proof) else "unverified", at == 1) for _, items, _ in reading for text, v in items]
    return [(*r[:4], k, *r[4:]) for k, r in enumerate(out)]


def spread_words(words: DataFrame) -> Spread:
    """words (page, width, x0, y0, x1, y1, text) -> every table of the spread."""
    cells = grouped.row_assembly(words.withColumn("text", scalars.columns(scalars.normal_text, "text")))
    blocks = blocks_of(rows_of(cells))
    lines = harvest(cells, blocks).where("year is not null")
    over = lambda *steps, result=None: relations({"lines": lines}, *steps, result=result)
    base = (spread.buckets, spread.derived)
    return Spread(cells, blocks, lines, over(*base), over(*base, spread.ratios), over(*base, spread.growth), over(*base, spread.ratios, spread.flags), over(*base, result="mapped"))


@dataclass
class Cases:
    """The tables of several files' cases; ``entity`` of the last seven is the case."""

    blocks: DataFrame
    placed: DataFrame
    alternates: DataFrame
    kept: DataFrame
    lines: DataFrame
    mapped: DataFrame
    values: DataFrame
    ratios: DataFrame
    trends: DataFrame
    flags: DataFrame
    trust: DataFrame


def classified(blocks: DataFrame) -> DataFrame:
    """The rows of ``blocks_of`` with the kind that the heading and the words of a statement tell."""
    texts = blocks.groupBy("page", "block").agg(F.max("heading").alias("heading"), F.array_join(F.collect_list("text"), " ; ").alias("labels"))
    named = texts.select(F.struct("page", "block").alias("block"), F.coalesce("heading", F.lit("")).alias("heading"), "labels")
    kinds = relations({"headed": named}, reading.classified).select("block.page", "block.block", F.col("kind").alias("told"))
    joined = blocks.join(kinds, ["page", "block"])
    return joined.withColumn("kind", F.when(F.col("told") == "other", F.col("kind")).otherwise(F.col("told"))).drop("told")


def spread_cases(words: DataFrame, docs: DataFrame) -> Cases:
    """Several files of several borrowers as one column for each case and year.

    words (doc, page, width, x0, y0, x1, y1, text), docs (doc, case_id, ay, name). Pages are read one by one; their statements
    are classified, dated by their own period or their file's, placed among the case's files, and comparative columns of years
    that a statement of their own covers are set apart. What repeats a better statement's figures, what failed and what
    neither proved itself nor names a business is left out. The rest is spread by case and year. A row's trust is the
    lowest of its lines: proven in a verified statement, else consistent.

    The harvest is written once; what follows is relational but for the greedy removal of duplicates of a case's year.
    """
    pages = words.select("doc", "page", F.xxhash64("doc", "page").alias("leaf")).distinct()
    boxes = words.select(F.xxhash64("doc", "page").alias("page"), "width", "x0", "y0", "x1", "y1", scalars.columns(scalars.normal_text, "text").alias("text"))
    cells = written(grouped.row_assembly(boxes), "cells")
    found = written(classified(written(blocks_of(rows_of(cells)), "rows")), "blocks")
    lines = harvest(cells, found, alone=False).withColumnRenamed("page", "leaf").join(pages, "leaf").join(docs.select("doc", "case_id"), "doc")
    lines = written(lines.withColumn("id", F.xxhash64("leaf", "block", "comparative")), "lines")
    first = lambda c: F.first(c).alias(c)
    blocks = lines.groupBy(F.col("id").alias("block")).agg(*map(first, ("doc", "case_id", "kind", "entity", "year", "page", "status", "comparative")), F.count("*").alias("n_items"))
    blocks = written(blocks.withColumn("salvageable", F.lit(False)).withColumn("page", F.col("page").cast("int")), "statements")
    amounts = lines.select(F.col("id").alias("block"), "amount")
    inputs = {"docs": docs, "blocks": blocks, "amounts": amounts}
    placed = written(relations(inputs, pooling.placed), "placed")
    apart = relations(inputs, lambda d: pooling.alternates(d, "semi"))
    usable = blocks.drop("year").join(placed.select("block", "year"), "block").join(apart.select("block"), "block", "left_anti").where("year IS NOT NULL")
    admitted = F.expr(scalars.is_business(SPARK, "entity"))
    ranked = usable.where("status <> 'failed'").select(F.col("case_id").alias("doc"), "year", "block", "entity", "kind", (F.col("status") == "verified").alias("verified"), "n_items", F.coalesce(admitted, F.lit(False)).alias("admitted"))
    lists = amounts.groupBy("block").agg(F.collect_list("amount").alias("amounts"))
    kept = written(grouped.dedupe(ranked, lists).withColumnRenamed("doc", "case_id"), "kept")
    own = lines.drop("year", "case_id", "block").withColumnRenamed("id", "block").join(kept, "block")
    used = written(own.select(F.col("case_id").alias("entity"), "year", "kind", F.col("seq").cast("long").alias("seq"), "label", "amount", "status", "doc", "page"), "used")
    base = (spread.buckets, spread.derived)
    over = lambda *steps, result=None: relations({"lines": used}, *steps, result=result)
    line_trust = lambda d: [("line_trust", "SELECT lines.entity, lines.year, key, CASE WHEN status = 'verified' THEN 3 ELSE 2 END AS rank FROM lines JOIN label_keys ON lines.label = label_keys.label")]
    return Cases(
        blocks, placed, apart, kept, used, over(*base, result="mapped"), over(*base), over(*base, spread.ratios), over(*base, spread.growth),
        over(*base, spread.ratios, spread.flags), over(*base, line_trust, trust.derived, lambda d: [("all_trust", "SELECT entity, year, key, level FROM base_trust UNION ALL SELECT entity, year, key, level FROM derived_trust")]),
    )


def unmapped(spread_: Spread) -> DataFrame:
    return spread_.mapped.where("key IS NULL")


def ignored(spread_: Spread) -> DataFrame:
    return spread_.mapped.where(F.col("key") == rules.IGNORED)
