"""Several files of several borrowers through the whole way, the command line, the workbook, sources and the cache."""

import io
import zipfile

import pytest

from spreadloom import __main__ as command
from spreadloom import sinks
from spreadloom.operators import spread
from spreadloom.plans import pipeline
from spreadloom.plans.run import relations
from spreadloom.sources import cache, documents, vision

WORDS = "doc long, page int, width double, x0 double, y0 double, x1 double, y1 double, text string"


def sheet(doc, page, heading, pairs, name="SHREE GANESH TRADERS"):
    """A two-sided page: (left label, amount, right label, amount) and the totals under them."""
    rows = [[(100, 400, name)], [(100, 400, heading)]]
    rows += [[(10, 200, a), (350, 430, f"{x:,}"), (520, 700, b), (850, 930, f"{y:,}")] for a, x, b, y in pairs]
    rows.append([(350, 430, f"{sum(p[1] for p in pairs):,}"), (850, 930, f"{sum(p[3] for p in pairs):,}")])
    return [(doc, page, 1000.0, float(a), 20.0 * k, float(b), 20.0 * k + 12, t) for k, cells in enumerate(rows) for a, b, t in cells]


@pytest.fixture(scope="module")
def cases(spark):
    now, before = "Balance Sheet as at 31.03.2025", "Balance Sheet as at 31.03.2024"
    this = [("Trade payables", 120_000, "Furniture", 400_000), ("Capital Account", 500_000, "Trade receivables", 220_000)]
    last = [("Trade payables", 90_500, "Furniture", 310_000), ("Capital Account", 400_000, "Trade receivables", 180_500)]
    words = sheet(1, 0, now, this) + sheet(1, 1, before, last) + sheet(2, 0, before, last)
    # a page of a file about 2025 whose date was misread: the figures are others than those of the file about 2024
    words += sheet(1, 2, now, [("Unsecured Loans", 77_001, "Investment in shares", 77_001)])
    words += sheet(3, 0, now, [("Trade payables", 5_000, "Furniture", 5_000)], "OTHER BORROWER LTD")
    docs = [(1, 10, None, None), (2, 10, None, None), (3, 20, None, None)]
    return spark.createDataFrame(words, WORDS), spark.createDataFrame(docs, "doc long, case_id long, ay int, name string")


@pytest.fixture(scope="module")
def made(cases):
    return pipeline.spread_cases(*cases)


def test_two_files_make_two_years_without_counting_a_reprint_twice(made):
    rows = {(r["entity"], r["year"]): r for r in made.values.collect()}
    assert set(rows) == {(10, 2025), (10, 2024), (20, 2025)}
    assert (rows[10, 2024]["sundry_creditors"], rows[10, 2024]["debtors"], rows[10, 2024]["total_assets"]) == (90_500, 180_500, 490_500)
    assert (rows[10, 2025]["sundry_creditors"], rows[10, 2025]["unsecured_loans"], rows[10, 2025]["total_assets"]) == (120_000, 77_001, 697_001)
    assert rows[20, 2025]["total_assets"] == 5_000
    assert made.kept.count() == 4 and made.blocks.count() == 5


def test_trust_of_verified_statements(made):
    levels = {(r["entity"], r["year"], r["key"]): r["level"] for r in made.trust.collect()}
    assert levels[10, 2025, "sundry_creditors"] == "proven" and levels[10, 2025, "purchases"] == "unread"
    assert levels[10, 2025, "total_assets"] == "consistent"


def test_command_line(cases, tmp_path, capsys, monkeypatch, spark):
    for name, table in zip(("w", "d"), cases, strict=True):
        table.write.parquet(str(tmp_path / name))
    assert command.main([]) == 1
    monkeypatch.setattr(command.SparkSession.builder.__class__, "getOrCreate", lambda self: spark)
    assert command.main([str(tmp_path / "w"), str(tmp_path / "d")]) == 0
    out = capsys.readouterr().out
    assert "case 10  year 2024" in out and "(not used)" in out and "networth" in out


def test_workbook_of_three_sheets(made):
    one = made.lines.where("entity = 10")
    base = (spread.buckets, spread.derived)
    over = lambda *steps, result=None: relations({"lines": one.drop("kind")}, *steps, result=result)
    blocks = over(*base, spread.ratios, spread.snap, lambda d: spread.growth(d)[:2], sinks.blocks)
    analysis = over(*base, spread.ratios, spread.growth, spread.cagr, spread.flags, sinks.analysis)
    notes = over(*base).select("entity", "year").limit(0).selectExpr("'debtors' AS key", "year", "'=1+2' AS formula")
    book = zipfile.ZipFile(io.BytesIO(sinks.workbook(over(*base, sinks.cells), notes, analysis, None, blocks)))
    assert len([n for n in book.namelist() if n.startswith("xl/worksheets")]) == 3
    first = book.read("xl/worksheets/sheet1.xml").decode()
    assert "<f>SUM(B24:B34)</f>" in first and "IFERROR((" in first and "creditor_days" in first
    assert "Year-on-year growth" in book.read("xl/worksheets/sheet2.xml").decode()


def test_summed_cells_and_notes(spark):
    from spreadloom.operators import statements, trust

    rows = [("a", 2024, 1, "Trade payables", 100_000), ("a", 2024, 2, "Sundry Creditors", 50_000), ("a", 2024, 3, "Furniture", 12_345)]
    lines = spark.createDataFrame(rows, "entity string, year int, seq long, label string, amount long")
    line_trust = lambda d: [("line_trust", "SELECT lines.entity, lines.year, key, 1 AS rank FROM lines JOIN label_keys ON lines.label = label_keys.label")]
    notes = {r["key"]: r for r in relations({"lines": lines}, spread.buckets, spread.derived, line_trust, lambda d: trust.base(d)[:-1], statements.cell_notes).collect()}
    assert notes["sundry_creditors"]["formula"] == "=1+0.5" and notes["sundry_creditors"]["fill"] == "amber"
    assert notes["fixed_assets"]["formula"] is None and notes["purchases"]["fill"] == "red"


def test_cache_by_age_and_version(spark, tmp_path):
    path = str(tmp_path / "cache")
    table = spark.createDataFrame([("a", 1), ("b", 2)], "doc_id string, n int")
    cache.put(table, path, "v1")
    cache.put(table.limit(1), path, "v2")
    assert cache.get(spark, path, "v1").count() == 2 and cache.get(spark, path, "v1", days=0).count() == 0
    assert {(r["version"], r["readings"]) for r in cache.stats(spark, path).collect()} == {("v1", 2), ("v2", 1)}
    assert cache.clear(spark, path, "v2") and not cache.clear(spark, path, "v3")
    assert cache.get(spark, path, "v1").count() == 2


def test_engines_pages_and_unreadable_files(spark):
    some = lambda content: [(0, 100.0, 0.0, 0.0, 9.0, 10.0, "x" * 120, 0.5)]
    assert documents.engine({"first": None, "second": some}) is some
    with pytest.raises(LookupError):
        documents.engine({"first": None})
    files = spark.createDataFrame([("a", b"1"), ("b", b"2")], "doc_id string, content binary")
    words = documents.read_words(files, lambda content, pages: [(p, 100.0, 0.0, 0.0, 9.0, 10.0, "x" * 60, 0.5) for p in pages] if content == b"1" else [], [3, 5])
    assert sorted(r["page_no"] for r in words.collect()) == [3, 5]
    texts = documents.page_texts(words).orderBy("page_no").collect()
    assert [(r["page_no"], len(r["text"]), r["confidence"]) for r in texts] == [(3, 60, 0.5), (5, 60, 0.5)]
    assert documents.unreadable(words).count() == 0
    assert [r["doc_id"] for r in documents.unreadable(documents.read_words(files.limit(1), lambda content: [(0, 1.0, 0.0, 0.0, 1.0, 1.0, "short", 1.0)])).collect()] == ["a"]


def test_cascade_of_models():
    asked = []

    def ask(model, prompt):
        asked.append(model)
        if model == "gone":
            raise vision.Missing
        if model == "slow" and asked.count("slow") < 3:
            raise vision.Busy
        return model

    assert vision.cascade(["gone", "slow", "last"], ask, "p", sleep=lambda s: None) == "slow"
    assert asked == ["gone", "slow", "slow", "slow"]
    assert vision.cascade(["gone"], ask, "p", sleep=lambda s: None) is None
