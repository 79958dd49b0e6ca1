"""Cases that a reviewer's rounds found."""

import subprocess
import sys
import zlib

import numpy as np

from pyspark.sql import functions as F

from spreadloom.functions import scalars
from spreadloom.llm import common, neardup, toxicity
from spreadloom.operators import grouped
from spreadloom.plans import pipeline


def test_figures_beyond_a_bigint_are_no_error(spark):
    texts = ["75367841278130500000000000000000", "(9,223,372,036,854,775,808)", "(-9223372036854775808)", "(1,234)", "12,34,567.50"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, s string").select("k", scalars.columns(scalars.to_int, "s").alias("n")).orderBy("k").collect()
    assert [r["n"] for r in rows] == [None, None, None, -1234, 1234568]


def test_a_link_of_one_band_does_not_depend_on_the_size_of_its_bucket(spark, monkeypatch):
    """Rows that share one band alone meet in a large bucket as in a small one, whatever lies outside its largest component."""
    monkeypatch.setattr(neardup, "BLOCK", 8)
    monkeypatch.setattr(neardup, "LEADERS", 1)
    pairs, rng = 60, np.random.default_rng(1)
    signs = [rng.integers(0, 256, 2 * neardup.PERMUTATIONS, dtype=np.uint8).tobytes() for _ in range(pairs)]
    reps = [(k, 100, [7, *range(10_000 + k * 100, 10_000 + k * 100 + neardup.BANDS - 1)], signs[k % pairs]) for k in range(2 * pairs)]
    found = neardup.candidates(common.materialise(spark.createDataFrame(reps, "id long, n long, bands array<long>, sig binary"), "reps"))
    assert {(r["node"], r["component"]) for r in found.collect()} == {(k, k % pairs) for k in range(2 * pairs)}


def test_figures_across_the_edge_are_no_other_column():
    """Two rows whose figures share a cell five to three end 27 behind the edge, at the same place."""
    lines = [("Stock", "1,041 937", 1041), ("Cash", "1,050 945", 1050), ("Plant", "24,350 21,915", 24350), ("Land", "69,731 62,758", 69731)]
    rows = [[(10.0, 200.0, name), (480.0, 640.0, both)] for name, both, _ in lines] + [[(10.0, 60.0, "Total"), (480.0, 560.0, "96,172")]]
    assert grouped.vertical(rows, 560.0, 640.0) == [("", [(name, float(v)) for name, _, v in lines], 96172.0)]


def test_cells_that_come_dealt_by_page_are_sorted_in_tasks_of_their_own(spark, monkeypatch):
    """However few tasks number the lines of a page, its cells are dealt anew, to as many as their size asks for."""
    monkeypatch.setattr(grouped, "SHARE", 1 << 20)
    path = common.materialise(spark.range(400_000).selectExpr("id DIV 4 AS page", "id % 4 AS place", "CAST(xxhash64(id) AS STRING) AS text"), "lines").shared_path
    lines = spark.read.parquet(path).selectExpr("page", "row_number() OVER (PARTITION BY page ORDER BY place, text) AS row_no", "text")
    cells = lines.selectExpr("page", "row_no", "CAST(10 AS DOUBLE) AS x0", "CAST(200 AS DOUBLE) AS x1", "text")
    for _ in range(4):
        cells = cells.unionByName(lines.selectExpr("page", "row_no", "CAST(350 AS DOUBLE) AS x0", "CAST(430 AS DOUBLE) AS x1", "text"))
    made = grouped.per_group(cells, ["page"], ["row_no", "x0"], ["x1", "text"], lambda key, rows: [(*key, len(rows))], "page long, n long")
    assert made.rdd.getNumPartitions() > int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert made.groupBy("n").count().collect() == [(20, 100_000)]


def test_tasks_over_joined_rows_follow_the_tables_and_not_their_product(spark):
    """Two tables of some 100 KB are no work for hundreds of tasks, though Spark takes their join for their product."""
    left, right = (spark.read.parquet(common.materialise(spark.range(20_000).selectExpr("id AS page", f"CAST(xxhash64(id, {k}) AS STRING) AS {name}"), name).shared_path) for k, name in enumerate(("text", "other")))
    joined = left.join(right, "page").selectExpr("page", "CAST(0 AS INT) AS row_no", "concat(text, other) AS text")
    assert int(str(joined._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > 1000 * grouped.SHARE
    made = grouped.per_group(joined, ["page"], ["row_no"], ["text"], lambda key, rows: [(*key, len(rows))], "page long, n long")
    assert made.rdd.getNumPartitions() <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert made.count() == 20_000


def test_a_long_text_of_a_wide_table_counts_with_all_its_bytes(spark, monkeypatch):
    """Spark takes a text for 20 bytes, so it thinks little of the one column of a table that has all of its bytes."""
    numbers = [f"CAST({k} AS DOUBLE) AS n{k}" for k in range(20)]
    wide = spark.range(4_000).selectExpr("id AS page", "CAST(0 AS INT) AS row_no", "array_join(transform(sequence(1, 40), k -> CAST(xxhash64(id, k) AS STRING)), '') AS text", *numbers)
    read = spark.read.parquet(common.materialise(wide, "wide").shared_path)
    narrow = read.select("page", "row_no", "text")
    plain, size = int(spark.conf.get("spark.sql.shuffle.partitions")), int(str(read._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    monkeypatch.setattr(grouped, "SHARE", size // (2 * plain))
    assert int(str(narrow._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < plain * grouped.SHARE
    made = grouped.per_group(narrow, ["page"], ["row_no"], ["text"], lambda key, rows: [(*key, len(rows))], "page long, n long")
    assert made.rdd.getNumPartitions() >= 2 * plain and made.count() == 4_000


def test_cells_without_two_figures_are_not_searched_for_them(monkeypatch):
    """A label or a lone figure is neither split nor held against the patterns of several figures."""
    monkeypatch.setattr(grouped, "_RUN", None)
    monkeypatch.setattr(grouped, "_WELDED", None)
    cells = [(10.0, 200.0, "Item 21 of 3 units"), (350.0, 430.0, " 73,057 "), (500.0, 500.0, "")]
    assert grouped.unwelded(grouped.spread_runs(cells)) == [(10.0, 200.0, "Item 21 of 3 units"), (350.0, 430.0, "73,057"), (500.0, 500.0, "")]
    monkeypatch.undo()
    assert [t for *_, t in grouped.unwelded(grouped.spread_runs([(0.0, 90.0, "1,000 (2,000)"), (90.0, 180.0, "3,000 Stock")]))] == ["1,000", "(2,000)", "3,000", "Stock"]


def test_the_search_for_a_divider_ends_with_the_first_that_misses_nothing(monkeypatch):
    tried = []
    monkeypatch.setattr(grouped, "divided", lambda *args, f=grouped.divided: tried.append(args[1]) or f(*args))
    rows = [[(10, 200, "Capital"), (350, 430, "1,000"), (520, 700, "Stock"), (850, 930, "1,000")], [(10, 200, "Creditors"), (350, 430, "2,000"), (520, 700, "Cash"), (850, 930, "2,000")], [(350, 430, "3,000"), (850, 930, "3,000")]]
    assert grouped.account(rows)[2] == "verified" and len(tried) == 1 < len(grouped.dividers(rows))


def test_a_verified_account_is_not_read_by_periods(monkeypatch):
    """Two sides with labels beside their figures that prove themselves; their columns need no reading."""
    monkeypatch.setattr(grouped, "periods", None)
    texts = [("Capital", "1,000", "Stock", "1,000"), ("Creditors", "2,000", "Cash", "2,000"), (None, "3,000", None, "3,000")]
    group = [(k, float(a), float(b), t, 2024) for k, row in enumerate(texts) for (a, b), t in zip(((10, 200), (350, 430), (520, 700), (850, 930)), row, strict=True) if t]
    assert [r[3:7] for r in pipeline._read((1, 1), group)] == [("left", 0, "Capital", 1000.0), ("left", 1, "Creditors", 2000.0), ("right", 2, "Stock", 1000.0), ("right", 3, "Cash", 2000.0)]


def test_every_labelled_row_is_learned_from(spark):
    """Small shares find what one finds, and no row is left out of them: a changed label of any changes the weights."""
    rows = [(k, f"plain words {k % 50} of row {k}" + (" scum" if k % 3 == 0 else "")) for k in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k, _ in rows], "doc_id long, toxic int")
    seen = []
    for sample in (100, 400, 6000):
        weights = toxicity.train(docs, labels, sample)
        assert weights == toxicity.train(docs.orderBy(F.desc("text")), labels, sample)
        seen.append({r["doc_id"] for r in toxicity.score(docs, weights).where("predicted = 1").collect()})
    assert seen == [{k for k in range(0, 1500, 3)}] * 3
    learned = [k for k, _ in rows if zlib.crc32(str(k).encode()) % 3 != 1]
    moved = {tuple(sorted(toxicity.train(docs, labels.withColumn("toxic", F.when(F.col("doc_id") == k, 1 - F.col("toxic")).otherwise(F.col("toxic"))), 100).items())) for k in (learned[0], learned[len(learned) // 2], learned[-1])}
    assert tuple(sorted(toxicity.train(docs, labels, 100).items())) not in moved


HELD = """
import random, sys
import pyarrow as pa
import public_tokenizers
from spreadloom.llm import common, packing

class Rows:
    def select(self, *names):
        return self
    def mapInArrow(self, run, schema):
        return run

def held():
    lines = open("/proc/self/smaps_rollup").read().split("\\n")
    return sum(int(x.split()[1]) for x in lines if x.startswith("Pss_Anon:")) // 1024

path = public_tokenizers.path("word_bpe_49k.json")
common.tokenizer(path)
deal = random.Random(3)
texts = [" ".join(f"{deal.randrange(1 << 40):x}" for _ in range(1000)) for _ in range(300)]
before, ids, most = held(), 0, 0
for out in packing.pieces(Rows(), path, 2)(iter([pa.RecordBatch.from_pydict({"doc_id": list(range(300)), "text": texts})])):
    ids, most = ids + out.num_rows, max(most, held())
del out
print(ids, most - before, held() - before)
"""


def test_a_task_leaves_its_process_without_the_memory_of_its_tables():
    """Processes of ended tasks wait beside the JVM, so what a task's tables took goes back to the system with it."""
    said = subprocess.run([sys.executable, "-c", HELD], capture_output=True, text=True, check=True).stdout
    pieces, most, left = map(int, said.split())
    assert pieces >= 300 and most > 60 and left < most // 3


def test_the_stages_of_the_pipeline_give_memory_back(spark, monkeypatch):
    """Every function that runs in a worker's process there ends with it."""
    import corpus_pipeline

    ran = []
    monkeypatch.setattr(type(spark.range(0)), "mapInArrow", lambda self, f, *a, g=type(spark.range(0)).mapInArrow, **b: ran.append(f) or g(self, f, *a, **b))
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0
    assert len(ran) >= 8 and all(f.__code__ is common.released(f).__code__ for f in ran)
