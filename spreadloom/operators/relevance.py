"""Which pages matter: kinds, selection with the page after a statement, read paths."""

from __future__ import annotations

from spreadloom.functions import scalars
from spreadloom.plans.dialect import Spark

#: The vocabulary of page kinds, in order.
BALANCE = r"\bbalance\s*sheet\b"
PROFIT = r"\bprof[il]t\s*(&|and)\s*loss\b|\bincome\s*(&|and)\s*expenditure\b|\btrading\s*(&|and)\s*prof[il]t\b|\breceipts?\s*(&|and)\s*payments?\b|\bstatement\s+of\s+prof[il]t\b"
KINDS = (
    ("statement", f"{BALANCE}|{PROFIT}"),
    ("computation", r"\bcomputation\s+of\s+(total\s+)?income\b|\bgross\s+total\s+income\b|\bincome\s+chargeable\s+under\s+the\s+head\b|\bdeductions?\s+under\s+chapter\s+VI"),
    ("acknowledgement", r"\bindian\s+income\s+tax\s+return\s+acknowledge?ment\b|\bITR\s*-?\s*V\b"),
    ("schedule", r"^\s*SCH\.?\s*[-A-Z]|\bschedule\s+[A-Z]\b|\bsundry\s+(creditor|debtor)s?\b|\bloans?\s*&\s*advances?\b|\bfixed\s+assets?\s+(schedule|chart)\b|\bdepreciation\s+chart\b"),
    ("audit", r"\bform\s+no\.?\s*3C[ABD]\b|\bunder\s+section\s+44AB\b|\bstatement\s+of\s+particulars\b|\bclause\s+\d+\b|\baudit\s+report\b|\bUDIN\b"),
)
LEAST_MONEY = 3


def heading(d: Spark, x: str, pattern: str = f"{BALANCE}|{PROFIT}") -> str:
    """A statement named within the first ten characters of one of the first five lines, which is 80 long at most."""
    lines = d.mapped(d.head(d.lines(x), 5), d.replace("e", r"^\s+|\s+$"))
    return f"{d.size(d.kept(lines, f'length(e) <= 80 AND {d.match('e', rf'^.{{0,10}}({pattern})')}'))} > 0"


def kind(d: Spark, x: str, money: str) -> str:
    arms = [f"WHEN {x} IS NULL OR trim({x}) = '' THEN 'noise'"]
    for name, pattern in KINDS:
        if name in ("statement", "schedule", "computation"):
            other = f"CASE WHEN {heading(d, x)} THEN 'statement' ELSE 'noise' END" if name == "statement" else "'noise'"
            arms.append(f"WHEN {d.match(x, pattern)} THEN CASE WHEN {money} >= {LEAST_MONEY} THEN '{name}' ELSE {other} END")
        else:
            arms.append(f"WHEN {d.match(x, pattern)} THEN '{name}'")
    return "CASE " + " ".join(arms) + " ELSE 'noise' END"


def kinds(d: Spark):
    return [
        ("counted", f"SELECT doc, page, text, {d.size(d.hits('text', scalars.MONEY))} AS money FROM pages_in"),
        ("kinds", f"SELECT doc, page, money, {kind(d, 'text', 'money')} AS kind FROM counted"),
    ]


def selected(d: Spark):
    """Kept kinds and the noise page right after a statement; everything where nothing is kept."""
    return [
        *kinds(d),
        ("after", "SELECT *, lag(kind) OVER (PARTITION BY doc ORDER BY page) AS before FROM kinds"),
        ("chosen", "SELECT doc, page, kind, kind IN ('statement', 'computation', 'acknowledgement', 'schedule') OR (kind = 'noise' AND coalesce(before = 'statement', FALSE)) AS own FROM after"),
        ("selected", "SELECT doc, page, kind FROM (SELECT *, max(CASE WHEN own THEN 1 ELSE 0 END) OVER (PARTITION BY doc) AS any_own FROM chosen) AS s WHERE own OR any_own = 0"),
    ]


def summary(d: Spark):
    return [*kinds(d), ("summary", "SELECT doc, kind, count(*) AS n FROM kinds GROUP BY doc, kind")]


def both_kinds(d: Spark):
    """Documents with a page headed as a balance sheet and one headed as a profit and loss account; a mention is no heading."""
    some = lambda pattern: f"max(CASE WHEN {heading(d, 'text', pattern)} THEN 1 ELSE 0 END) = 1"
    return [("both_kinds", f"SELECT doc, {some(BALANCE)} AND {some(PROFIT)} AS has_both FROM pages_in GROUP BY doc")]


def widened(d: Spark):
    """The pages to read again in full: those that a cheap reading selects, all where it lacks either statement's heading."""
    return [
        *selected(d),
        *both_kinds(d),
        ("widened", "SELECT pages_in.doc, pages_in.page, has_both, selected.page IS NOT NULL AS own FROM pages_in JOIN both_kinds ON pages_in.doc = both_kinds.doc LEFT JOIN selected ON pages_in.doc = selected.doc AND pages_in.page = selected.page WHERE selected.page IS NOT NULL OR NOT has_both"),
    ]


def retried(d: Spark):
    """Documents whose selected pages gave no usable block: every page that was not read yet is read too.

    ``usable`` (doc) names the documents with a block that was not failed.
    """
    anti = "LEFT ANTI JOIN" if d.name == "spark" else "ANTI JOIN"
    return [
        *selected(d),
        ("unread", f"SELECT doc, page FROM pages_in {anti} selected USING (doc, page)"),
        ("retried", f"SELECT doc, page FROM unread {anti} usable USING (doc)"),
    ]


def read_paths(d: Spark):
    """A document under 100 characters is scanned; in others, blank pages are read by OCR."""
    return [
        ("sized", f"SELECT doc, page, length(trim(coalesce(text, ''))) AS n, {scalars.garbled(d, 'coalesce(text, ' + chr(39) * 2 + ')')} AS garbled, sum(length(trim(coalesce(text, '')))) OVER (PARTITION BY doc) AS total FROM pages_in"),
        ("paths", "SELECT doc, page, CASE WHEN total < 100 THEN 'scanned' WHEN n < 20 THEN 'ocr' WHEN garbled THEN 'garbled' ELSE 'digital' END AS path FROM sized"),
    ]
