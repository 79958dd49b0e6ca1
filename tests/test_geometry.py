"""Words to rows to statements, on the shapes that pages really have."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from spreadloom import sinks
from spreadloom.operators import grouped
from spreadloom.plans import pipeline
from spreadloom.sources import cache, documents
from spreadloom.streaming import buckets


def texts(words, width):
    return [[t for *_, t in cells] for _, cells in grouped.assemble(words, width)]


def test_a_wide_gap_opens_a_cell():
    assert texts([(10, 0, 60, 10, "Salary"), (62, 0, 90, 10, "Paid"), (300, 0, 350, 10, "72,000")], 600) == [["Salary Paid", "72,000"]]


def test_stacked_figures_are_two_rows():
    words = [(100, 0, 300, 34, "By Gross profit"), (700, 0, 820, 34, "45,77,061.00"), (100, 20, 300, 54, "Rent received"), (705, 20, 810, 54, "96,250.00")]
    assert texts(words, 1000) == [["By Gross profit", "45,77,061.00"], ["Rent received", "96,250.00"]]


def test_side_by_side_words_are_one_row():
    assert len(texts([(100, 0, 200, 34, "Sundry"), (210, 1, 330, 35, "Creditors"), (700, 0, 800, 34, "16,950")], 1000)) == 1


T_ACCOUNT = [
    [(10, 100, "Capital"), (200, 260, "1,00,000"), (320, 420, "Fixed Assets"), (520, 580, "60,000")],
    [(10, 100, "Creditors"), (200, 260, "50,000"), (320, 420, "Cash"), (520, 580, "90,000")],
    [(200, 260, "1,50,000"), (520, 580, "1,50,000")],
]


def test_account_balances():
    sides, total, status = grouped.account(T_ACCOUNT)
    assert (sum(e[2] for e in sides["left"]), sum(e[2] for e in sides["right"]), total, status) == (150000, 150000, 150000, "verified")


def test_a_dropped_line_fails():
    rows = [T_ACCOUNT[0], [*T_ACCOUNT[1][2:]], T_ACCOUNT[2]]
    assert grouped.account(rows)[2] == "failed"


def test_printed_totals():
    assert grouped.printed([[(0, 9, "Cash"), (20, 30, "5,000")], [(0, 9, "TOTAL"), (20, 30, "168012440"), (40, 49, "TOTAL"), (60, 70, "168012440")]]) == (168012440, 1)
    assert grouped.printed([[(20, 30, "2025"), (60, 70, "2024")]]) == (None, None)


def test_working_columns_lose_to_the_total():
    columns = grouped.clustered([(100, "a", 65980), (100, "b", 6598), (300, "c", 59382), (300, "d", 40618)])
    assert sorted(e[2] for e in grouped.picked(columns, 100000)) == [40618, 59382]


def test_vertical_sections_take_this_years_column():
    rows = [
        [(10, 200, "Current liabilities")],
        [(10, 200, "(a) Trade payables"), (300, 320, "7"), (500, 560, "43,224,860"), (700, 760, "1,000")],
        [(10, 200, "(b) Other"), (500, 560, "6,675,420"), (700, 760, "2,000")],
        [(10, 60, "Total"), (500, 560, "49,900,280"), (700, 760, "3,000")],
    ]
    [(name, items, total)] = grouped.vertical(rows, 560, 900)
    assert name == "Current liabilities" and total == 49900280
    assert items == [("[CL] (a) Trade payables", 43224860), ("[CL] (b) Other", 6675420)]


def test_greedy_dedupe_keeps_the_better_printing():
    blocks = [(1, "A", "bs", False, 3, [10, 20, 30], True), (2, "A ", "bs", True, 3, [10, 20, 30], True), (3, "A", "bs", True, 2, [77, 78], False), (4, "B", "bs", False, 2, [10, 20], True), (5, "Note 3", "bs", False, 2, [91, 92], False)]
    assert sorted(grouped.survivors(blocks)) == [2, 3]


def test_fill_closes_a_gap_and_never_replaces_proof():
    mine, theirs = {"interest_finance": 0, "purchases": 5}, {"interest_finance": 62, "purchases": 9}
    totals, theirs_total = {"gross_expenses": 125754699}, {"gross_expenses": 125754761}
    proven = {"interest_finance": "proven", "purchases": "proven"}
    assert grouped.filled(mine, theirs, {"interest_finance": "doubtful", "purchases": "proven"}, proven, totals, theirs_total) == {"interest_finance": (62, "consistent")}
    assert grouped.filled(mine, theirs, {"interest_finance": "proven", "purchases": "proven"}, proven, totals, theirs_total) == {}
    assert grouped.filled({"debtors": 5}, {"debtors": 5.5}, {"debtors": "doubtful"}, {"debtors": "proven"}, {}, {}) == {"debtors": (5, "consistent")}


def page(rows, width=600):
    return [(1, float(width), float(a), 20.0 * k, float(b), 20.0 * k + 10, w) for k, cells in enumerate(rows) for a, b, w in cells]


@pytest.fixture(scope="module")
def spread(spark):
    rows = [[(10, 300, "SHREE GANESH TRADERS")], [(10, 300, "BALANCE SHEET AS ON 31st March 2024")], *T_ACCOUNT, [(10, 200, "Chartered Accountants")]]
    return pipeline.spread_words(spark.createDataFrame(page(rows), "page long, width double, x0 double, y0 double, x1 double, y1 double, text string"))


def test_words_become_values(spread):
    assert {(r["label"], r["amount"], r["status"]) for r in spread.lines.collect()} >= {("Capital", 100000, "verified"), ("Creditors", 50000, "verified")}
    v = spread.values.first()
    assert (v["entity"], v["year"], v["sundry_creditors"], v["total_assets"], v["gross_receipts"]) == ("SHREE GANESH TRADERS", 2024, 50000, 150000, None)
    assert spread.flags.count() >= 0 and spread.ratios.count() == 1


def test_workbook(spread, spark):
    from spreadloom.plans.run import relations

    cells = relations({"vals": spread.values}, sinks.cells)
    book = zipfile.ZipFile(io.BytesIO(sinks.workbook(cells)))
    sheet = book.read("xl/worksheets/sheet1.xml").decode()
    assert "<f>SUM(B24:B34)</f>" in sheet and "Sundry Creditors" in sheet
    unread = {r["key"] for r in cells.where("unread").collect()}
    assert "purchases" in unread and "debtors" not in unread


def test_sources(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"one two")
    (tmp_path / "b.bin").write_bytes(b"bad")
    files = documents.files(spark, str(tmp_path))

    def reader(content):
        if content == b"bad":
            raise ValueError("unreadable")
        return [(0, 100.0, 10.0 * k, 0.0, 10.0 * k + 9, 10.0, w, 1.0) for k, w in enumerate(content.decode().split())]

    rows = documents.read_words(files, reader).collect()
    assert sorted(r["text"] for r in rows if r["text"]) == ["one", "two"]
    assert [r["error"] for r in rows if r["error"]] == ["ValueError: unreadable"]
    cache.put(files.limit(1).select("doc_id"), str(tmp_path / "cache"), "v1")
    cached = spark.read.parquet(str(tmp_path / "cache"))
    assert cache.unread(files, cached, "v1").count() == 1 and cache.unread(files, cached, "v2").count() == 2


def test_learned_labels_come_before_synonyms(spark, tmp_path):
    (tmp_path / "learned.json").write_text('{"label": "Mystery Item!", "key": "other_expenses"}\n{"label": "x 12345", "key": "debtors"}\n{"label": "y", "key": "nonsense"}\n')
    learned = cache.load_learned(spark, str(tmp_path / "learned.json"))
    lines = spark.createDataFrame([("mystery item",), ("Total",), ("Trade payables",)], "label string")
    assert {r["label"]: r["key"] for r in cache.map_with(lines, learned).collect()} == {"mystery item": "other_expenses", "Total": "__ignored__", "Trade payables": "sundry_creditors"}


def test_ocr_tables(spark):
    t = spark.createDataFrame([(1, 1.0, 2.0, 3.0, 4.0, "proflt", "91.5"), (1, 0.0, 0.0, 1.0, 1.0, "dim", "12"), (1, 0.0, 0.0, 1.0, 1.0, "x", "NA")], "page int, left double, top double, width double, height double, text string, conf string")
    assert [tuple(r) for r in documents.tesseract_words(t).collect()] == [(1, 1.0, 2.0, 4.0, 6.0, "Profit")]
    turned = spark.createDataFrame([(1, 0, "xq zz"), (1, 90, "balance sheet profit loss account capital assets liabilities"), (2, 0, "balance sheet total"), (2, 90, "balance")], "page int, angle int, text string")
    assert {r["page"]: r["angle"] for r in documents.best_rotation(turned).collect()} == {1: 90, 2: 0}


def test_streaming_buckets(spark, tmp_path):
    schema = "entity string, year int, label string, amount long"
    spark.createDataFrame([("a", 2024, "Sales", 5), ("a", 2024, "Total", 5), ("a", 2024, "Sales", 7)], schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    buckets.start(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).select("key", F.col("amount").cast("long")).collect()
    assert [tuple(r) for r in got] == [("sales_other_income", 12)]


def test_welded_figures_and_replies(spark):
    assert grouped.unwelded([(0, 100, "45,000 Rent paid"), (0, 9, "Cash 5,000")]) == [(0, 37.5, "45,000"), (37.5, 100, "Rent paid"), (0, 9, "Cash 5,000")]
    from spreadloom.sources import vision

    rows = [("d", 1, '```json\n{"kind": "balance_sheet", "year": 2024, "left": [{"label": "Capital", "amount": 10.5}], "right": null}\n```'), ("d", 2, "no reply")]
    got = vision.lines(spark.createDataFrame(rows, "doc_id string, page_no int, json string")).collect()
    assert [(r["page_no"], r["side"], r["seq"], r["label"], r["amount"]) for r in got] == [(1, "left", 0, "Capital", 10)]


TWO_YEARS = [
    [(10, 300, "SHREE GANESH TRADERS LTD")],
    [(10, 300, "BALANCE SHEET")],
    [(10, 100, "Particulars"), (300, 330, "Note"), (440, 580, "As at March 31, 2024"), (640, 780, "As at March 31, 2023")],
    [(10, 200, "Current liabilities")],
    [(10, 200, "(a) Trade payables"), (300, 320, "7"), (500, 560, "43,224,860"), (700, 760, "1,000")],
    [(10, 200, "(b) Provisions"), (540, 550, "-"), (700, 760, "5,000")],
    [(10, 200, "(c) Other"), (545, 560, "63"), (700, 760, "2,000")],
    [(10, 60, "Total"), (500, 560, "43,224,923"), (700, 760, "8,000")],
]


def test_period_columns_and_their_edges():
    rows = TWO_YEARS[2:]
    assert grouped.period_columns(rows) == [(440, 580), (640, 780)] and grouped.upright(rows) and not grouped.upright(T_ACCOUNT)
    assert grouped.right_edge(rows, (440, 580), [(640, 780)]) == 560
    own, prior = grouped.periods(rows)
    assert own == [("Current liabilities", [("[CL] (a) Trade payables", 43224860), ("[CL] (c) Other", 63)], 43224923)]
    assert prior == [("Current liabilities", [("[CL] (a) Trade payables", 1000), ("[CL] (b) Provisions", 5000), ("[CL] (c) Other", 2000)], 8000)]


def test_columns_without_headers():
    own, prior = grouped.periods(TWO_YEARS[3:])
    assert [v for _, items, _ in own for _, v in items] == [43224860, 63] and [v for _, items, _ in prior for _, v in items] == [1000, 5000, 2000]


def test_a_line_that_is_nil_this_year_is_not_last_years():
    rows = [[(10, 200, "A"), (480, 560, "70,000"), (570, 640, "60,000")], [(10, 200, "Provisions"), (570, 640, "5,000")], [(10, 200, "Cash"), (480, 560, "30,000"), (570, 640, "1,000")], [(10, 60, "Total"), (480, 560, "1,00,000"), (570, 640, "66,000")]]
    assert [v for _, items, _ in grouped.vertical(rows, 560, 640) for _, v in items] == [70000, 30000]


def test_two_year_pages_give_each_year_its_own_figures(spark):
    later = [[(a, b, w.replace("2024", "2025").replace("2023", "2024")) for a, b, w in cells] for cells in TWO_YEARS]
    schema = "page long, width double, x0 double, y0 double, x1 double, y1 double, text string"
    rows = lambda words: {(r["year"], r["label"], r["amount"], r["status"], r["comparative"]) for r in pipeline.spread_words(spark.createDataFrame(words, schema)).lines.collect()}
    first = rows(page(TWO_YEARS, 800))
    own = {(2024, "[CL] (a) Trade payables", 43224860, "verified", False), (2024, "[CL] (c) Other", 63, "verified", False)}
    assert first == own | {(2023, "[CL] (a) Trade payables", 1000, "verified", True), (2023, "[CL] (b) Provisions", 5000, "verified", True), (2023, "[CL] (c) Other", 2000, "verified", True)}
    both = rows(page(TWO_YEARS, 800) + [(2, *w[1:]) for w in page(later, 800)])
    assert {r for r in both if r[0] == 2024} == own and {r[0] for r in both} == {2023, 2024, 2025}


def test_many_columns_are_solved_too():
    columns = [[(100 * k, str(k), 3**k)] for k in range(14)]
    assert [e[1] for e in grouped.picked(columns, 3**2 + 3**9 + 3**13)] == ["2", "9", "13"]
