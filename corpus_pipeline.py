"""The corpus pipeline: quality rules, toxicity, near-duplicate removal, redaction of secrets, packing.

Each stage takes (spark, docs, sf_dir), is written as Parquet and read again as the next one's ``docs``. All but the last
return the columns of ``documents``: doc_id, text, lang, source, n_chars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spreadloom.llm import common, neardup, packing, quality, secrets, toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, rows independent of each other: repeated rows stay or go alike, so do ties.

    Null, empty and shorter texts than 50 words go, as the base rule says; null ids and other null columns do not matter.
    """
    return quality.keep(docs.select(*COLUMNS)).select(*COLUMNS)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted to be toxic, by a model learned from the labelled ones among them.

    Rows are independent once the model is learned, so repeated rows get one answer. A null or empty text has the bias
    alone, and stays unless the bias itself is toxic; a null id has no label and is scored. Without a label all stay.
    """
    weights = toxicity.train(docs, common.documents(spark, sf_dir, "labels"))
    return toxicity.score(docs.select(*COLUMNS), weights, COLUMNS).where("predicted = 0").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near duplicates, that with the smallest doc_id; null ids come last.

    Rows are told by a number of their own, so that rows of one doc_id and rows without one are single rows here: of
    equal texts one stays, and a row with another text does not go with them. A text without shingles always stays.
    """
    rows = common.materialise(docs.select(*COLUMNS).withColumn("_row", F.monotonically_increasing_id()), "numbered")
    found = neardup.near_duplicates(rows.select(F.col("_row").alias("doc_id"), "text"))
    grouped = common.materialise(found.select(F.col("doc_id").alias("_row"), F.col("component_id").alias("_part")), "components")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "_row")
    first = grouped.join(rows.select("_row", "doc_id"), "_row").groupBy("_part").agg(F.min_by("_row", order).alias("_row"))
    return rows.join(first.select("_row"), "_row", "left_semi").select(*COLUMNS)


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret replaced by a mark; n_chars follows the text where one was.

    Null and empty texts have none and stay as they are; rows are independent, repeated ones stay and are equal.
    """
    clean = secrets.redact(secrets.scan(docs.select(*COLUMNS)))
    length = F.when(F.size("secret_spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return clean.select("doc_id", "text", "lang", "source", length.alias("n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with their token ids, in sequences of at most 4096 tokens.

    A document's ids end with id 2; one with a null or empty text is that id alone. Equal rows are packed as often as they
    come, ties in length go by doc_id, start and number of the row, and a null doc_id is kept.
    """
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", toxicity_filter),
    ("near_dedup", near_dedup),
    ("secret_scans", secret_redaction),
    ("packing", pack),
]

#: Learned weights and token ids have no SQL form; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = common.materialise(stage(spark, docs, sf_dir), name)
    return docs
