"""Where words come from: files by content, OCR results as tables, an injected page reader.

No PDF or OCR library is needed here: whatever reads pages is passed in and runs in the tasks, one file at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spreadloom.functions import scalars
from spreadloom.operators import grouped
from spreadloom.plans.dialect import SPARK

WORDS = "doc_id string, page_no int, width double, x0 double, y0 double, x1 double, y1 double, text string, conf double, error string"


def files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, source_name, content): a file is known by the hash of its bytes."""
    return identified(spark.read.format("binaryFile").load(path))


def identified(contents: DataFrame) -> DataFrame:
    """(path, content) -> (doc_id, source_name, content)."""
    return contents.select(F.sha2("content", 256).alias("doc_id"), F.element_at(F.split("path", "/"), -1).alias("source_name"), "content")


def with_pages(reader: Callable[[bytes, list[int]], list[tuple]], pages: list[int]) -> Callable[[bytes], list[tuple]]:
    """A reader of some pages of a file alone, where the engine can be told which."""
    return lambda content: reader(content, pages)


def engine(engines: dict[str, Callable[[bytes], list[tuple]] | None], wanted: str | None = None) -> Callable[[bytes], list[tuple]]:
    """The reader to use: the one that is asked for, else the first that is there (None: its library is missing)."""
    there = {k: f for k, f in engines.items() if f is not None}
    if wanted and wanted in there:
        return there[wanted]
    if not there:
        raise LookupError("no engine to read pages with")
    return next(iter(there.values()))


def unreadable(words: DataFrame, least: int = 100) -> DataFrame:
    """Files whose pages gave fewer than ``least`` characters in all, or an error: nothing can be spread from them."""
    sizes = words.groupBy("doc_id").agg(F.sum(F.coalesce(F.length(F.trim("text")), F.lit(0))).alias("characters"), F.max("error").alias("error"))
    return sizes.where((F.col("characters") < least) | F.col("error").isNotNull())


def page_texts(words: DataFrame) -> DataFrame:
    """(doc_id, page_no, text, confidence) of every page: words of a line by position, cells of a line by tabs, lines by rows.

    Rows and cells are those of ``grouped.row_assembly``; the confidence is the mean of the words', 1 where there is none.
    """
    read = words.where("text IS NOT NULL")
    leaves = read.select("doc_id", "page_no", F.xxhash64("doc_id", "page_no").alias("page")).distinct()
    cells = grouped.row_assembly(read.select(F.xxhash64("doc_id", "page_no").alias("page"), "width", "x0", "y0", "x1", "y1", "text"))
    rows = cells.groupBy("page", "row_no").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("cell_no", "text"))), lambda c: c["text"]), "\t").alias("text"))
    texts = rows.groupBy("page").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("row_no", "text"))), lambda r: r["text"]), "\n").alias("text"))
    sure = read.groupBy("doc_id", "page_no").agg(F.coalesce(F.avg("conf"), F.lit(1.0)).alias("confidence"))
    return leaves.join(texts, "page").join(sure, ["doc_id", "page_no"]).select("doc_id", "page_no", "text", "confidence")


def read_words(sources: DataFrame, reader: Callable[[bytes], list[tuple]], pages: list[int] | None = None) -> DataFrame:
    """``reader(content)`` gives (page_no, width, x0, y0, x1, y1, text, conf); a file that it fails on becomes a row with the error.

    With ``pages`` the reader is ``reader(content, pages)``. Spark's tasks are the bound of what is read at once.
    """
    reader = reader if pages is None else with_pages(reader, pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in WORDS.split(", ")]
        kinds = [{"string": pa.string(), "int": pa.int32(), "double": pa.float64()}[c.split()[1]] for c in WORDS.split(", ")]
        for batch in batches:
            for doc, content in zip(batch.column("doc_id").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    rows = [(doc, *w, None) for w in reader(content)]
                except Exception as e:  # one bad file must not end the others
                    rows = [(doc, *[None] * 8, f"{type(e).__name__}: {e}")]
                columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return sources.select("doc_id", "content").mapInArrow(run, WORDS)


def tesseract_words(table: DataFrame, least: float = 30) -> DataFrame:
    """(page, left, top, width, height, text, conf as text) -> boxes of words that are sure enough and not blank."""
    sure = F.expr("try_cast(conf AS double)") >= least
    return table.where(sure & (F.trim("text") != "")).select("page", F.col("left").alias("x0"), F.col("top").alias("y0"), (F.col("left") + F.col("width")).alias("x1"), (F.col("top") + F.col("height")).alias("y1"), repaired("text").alias("text"))


def polygon_words(table: DataFrame, least: float = 0.5) -> DataFrame:
    """(page, box array<struct<x,y>>, text, score) -> upright boxes."""
    edge = lambda f, c: f(F.transform("box", lambda p: p[c]))
    return table.where(F.col("score") >= least).select("page", edge(F.array_min, "x").alias("x0"), edge(F.array_min, "y").alias("y0"), edge(F.array_max, "x").alias("x1"), edge(F.array_max, "y").alias("y1"), repaired("text").alias("text"))


def repaired(column: str) -> Column:
    return F.expr(scalars.repaired(SPARK, column))


def best_rotation(texts: DataFrame, least: int = 8, factor: int = 3) -> DataFrame:
    """(page, angle, text) -> the angle with the most vocabulary, where it has enough and far more than upright."""
    scored = texts.withColumn("score", F.expr(scalars.word_score(SPARK, "text")))
    best = scored.groupBy("page").agg(F.max_by("angle", F.struct("score", -F.col("angle"))).alias("angle"), F.max("score").alias("score"), F.max(F.when(F.col("angle") == 0, F.col("score"))).alias("upright"))
    turn = (F.col("score") >= least) & (F.col("score") >= factor * F.coalesce("upright", F.lit(0)))
    return best.select("page", F.when(turn, F.col("angle")).otherwise(0).alias("angle"))
