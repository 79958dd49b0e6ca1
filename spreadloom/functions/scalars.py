"""Scalar parsing as expressions of both engines: numbers, lines, headings, periods, identity.

Each function takes the dialect and an SQL expression of a text and gives an SQL expression. ``columns`` makes a Spark
column of one, for use in DataFrame code: ``df.select(columns(to_int, "text"))``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from spreadloom.plans.dialect import SPARK, Spark

#: The patterns of rows, headings and words.
SKIP = r"^\s*((proprietors?|partners?|directors?|to|by)\s*$|(particulars?|paticulars?|liabilities|assets|sch\.?|schedule|amount|total|as\s+per\s+our\s+report|place|date|udin|for[,\s]|chartered\s+account|signature)\b)"
OUTSTANDING = r"^\s*total\s+outstanding\s+dues"
GROUPED = r"\d{1,3}([,\s]\d{2,3})+([.,]\d{1,3})?|\d+[.,]\d{1,3}"
FOOTER = r"^\s*((directors?|proprietors?|partners?)\s*$|as\s+per\s+(my|our)\s+report|chartered\s+account|significant\s+accounting|notes?\s+(to|forming)|m\.?\s*no\.?\s*[:.]?\s*\d|frn\b|udin\b|place\s*:|date\s*:|\(?din\b)"
DERIVED = r"(nett?\s+)?profit\s+(before|after|for\s+the)|carried\s+(over\s+)?to\s+(the\s+)?balance\s+sheet|loss\s+for\s+the|(total|other)\s+comprehensive|earnings?\s+per|basic\s*\(|diluted\s*\("
MONEY = r"\d[\d\s]*[.,]\d{2}\b|\d{1,3}([,\s]\d{2,3})+"
UNITS = ((10_000_000, r"\bin\s+(rs\.?|inr|₹)?\s*crores?\b"), (1_000_000, r"\bin\s+(rs\.?|inr|₹)?\s*(millions?|mn)\b"), (100_000, r"\bin\s+(rs\.?|inr|₹)?\s*(lakhs?|lacs?)\b"), (1000, r"\bin\s+(rs\.?|inr|₹)?\s*(thousands?|'000|000s)\b"))
PERIOD = r"(as\s*on|for\s*the\s*(year|period)\s*end\w*(\s*on)?|as\s*at)\D{0,20}?((\d{1,2})\s*(st|nd|rd|th)?[\s,]*[-/.]?[\s,]*([A-Za-z]{3,9})\.?[,\s]*|[A-Za-z]{3,9}\.?\s+\d{1,2}(st|nd|rd|th)?\s*,?\s*|\d{1,2}\s*[./-]\s*\d{1,2}\s*[./-]\s*)?(\d{4})"
TITLES = r"\bbalance\s*sheet\b|\bprof[il]t\s*(&|and)\s*loss\b|\bincome\s*(&|and)\s*expenditure\b|\btrading\s*(&|and)\s*profit\b|\breceipts?\s*(&|and)\s*payments?\b|\baccount\b.{0,30}\byear\s*end"
#: What every title and every period holds.
TITLE_WORDS, PERIOD_WORDS = r"balance|prof[il]t|income|receipt|account", r"as\s*(on|at)|for\s*the\s*(year|period)\s*end"
CARRIED = r"\b(carried|transferred|trf|shown|taken)\b.{0,20}\bto\b.{0,10}\bbalance\s*sheet\b"
ADDRESS = r"\b(road|nagar|marg|street|chowk|complex|shop\s*no|near|dist|pin|opp\.?|building|plot|floor|house|sector|wing|tower|lane|colony|society|premises|midc|industrial\s+area|taluka|flat)\b"
PROSE = r"^\s*(note\s*\d|schedule\b|annexure\b|as\s+at\b|as\s+on\b|based\s+on|present\s+value|additional\s+regulatory|in\s+terms\s+of|the\s+\w+|this\s+\w+|have\s+\w+|period\s+to|\(?amount\b|particulars\b)"
OWNER_LOAN = r"\b(loans?|borrowings?|advances?|deposits?)\s+(taken\s+|received\s+)?from\s+(the\s+)?(directors?|promoters?|shareholders?|partners?|proprietor|relatives?|related\s+part\w*|members?)"
VOCABULARY = "balance sheet profit loss account capital assets liabilities income tax total year ended march loans expenses".split()


def columns(function: Callable[..., str], text: str, *args) -> Column:
    return F.expr(function(SPARK, text, *args))


def normal_text(d: Spark, x: str) -> str:
    """No-break spaces and dashes made plain."""
    return f"replace(replace(replace({x}, ' ', ' '), '–', '-'), '—', '-')"


def stripped(d: Spark, x: str, chars: str = r" .:|-") -> str:
    return d.replace(x, f"^[{chars}]+|[{chars}]+$")


def to_int(d: Spark, x: str) -> str:
    """Indian-format number -> whole rupees, NULL where there is none or no BIGINT holds it."""
    digits = d.extract(d.replace(x, "[ ,]"), r"-?\d+(\.\d+)?", 0)
    return f"CASE WHEN {digits} <> '' THEN {d.whole(d.number(digits), f"(CASE WHEN trim({x}) LIKE '(%' AND trim({x}) LIKE '%)' THEN -1 ELSE 1 END)")} END"


def clean_amount(d: Spark, x: str) -> str:
    """Amount without paise and separators; other decimals stay, for statements in lakhs."""
    plain = d.replace(d.replace(f"trim({x})", r"(\d)[.,]\s?00\s*$", "$1"), r"[,\s]")
    return d.number(f"nullif({d.extract(plain, r'-?\d+(\.\d+)?', 0)}, '')")


def amount_parts(d: Spark, x: str) -> tuple[str, str]:
    """(text before, figure) of the amount that ends a cell; the figure is '' without one."""
    lead, tail = r"\(?\s*(Rs\.?|₹)?\s*", r"\s*\)?\s*$"
    grouped, three = rf"^(.*?){lead}({GROUPED}){tail}", rf"^(|.*?\D){lead}(\d{{3}}){tail}"
    part = lambda k: f"CASE WHEN {d.match(x, grouped, True)} THEN {d.extract(x, grouped, k, True)} ELSE {d.extract(x, three, k, True)} END"
    return part(1), part(3)


def line_label(d: Spark, x: str) -> str:
    before, figure = amount_parts(d, f"trim({x})")
    label = stripped(d, d.replace(stripped(d, before), r"\s+[A-Z]{1,2}$", "", True))
    skipped = f"({d.match(x, SKIP)} AND NOT {d.match(x, OUTSTANDING)})"
    return f"CASE WHEN NOT {skipped} AND {figure} <> '' AND length({label}) >= 3 AND {d.match(label, '[a-z]')} THEN {label} END"


def line_amount(d: Spark, x: str) -> str:
    """The amount of a line that has a label; brackets or a minus before it make it negative."""
    before, figure = amount_parts(d, f"trim({x})")
    negative = f"({x} LIKE '%(%' AND {x} LIKE '%)%') OR {d.match(before, r'-\s*$')}"
    return f"CASE WHEN {line_label(d, x)} IS NOT NULL THEN {clean_amount(d, figure)} * (CASE WHEN {negative} THEN -1 ELSE 1 END) END"


def row_kind(d: Spark, x: str) -> str:
    arms = ((FOOTER, "footer"), (r"^less\s*:?\s*dep", "less depreciation"), (OUTSTANDING, "line"), (r"^\s*total\b", "total"), (DERIVED, "derived"), (SKIP, "skip"))
    return "CASE " + " ".join(f"WHEN {d.match(x, p)} THEN '{k}'" for p, k in arms) + " ELSE 'line' END"


def unit_scale(d: Spark, x: str) -> str:
    return "CASE " + " ".join(f"WHEN {d.match(x, p)} THEN {n}" for n, p in UNITS) + " ELSE 1 END"


def widened(d: Spark, x: str) -> str:
    """Two-digit years of complete dates as four digits, 70 and later in the last century."""
    for pattern in (r"(^|[^\d])(\d{1,2}\s*[./-]\s*\d{1,2}\s*[./-]\s*)", r"(^|[^\d])(\d{1,2}\s*[-/.\s]\s*[A-Za-z]{3,9}\.?\s*[-/.,\s]\s*)"):
        x = d.replace(d.replace(x, pattern + r"([7-9]\d)([^\d]|$)", "$1${2}19$3$4" if d.name == "spark" else "$1$219$3$4"), pattern + r"([0-6]\d)([^\d]|$)", "$1${2}20$3$4" if d.name == "spark" else "$1$220$3$4")
    return x


def period_year(d: Spark, x: str) -> str:
    """The calendar year in which the period that a line names ends."""
    return f"CAST(nullif({d.extract(widened(d, x), PERIOD, 9)}, '') AS INT)"


def is_title(d: Spark, x: str) -> str:
    flat = f"trim({d.replace(x, r'\s+', ' ')})"
    undated = d.replace(flat, r"\b\d{1,2}[./-]\d{1,2}[./-]\d{2,4}\b", " ")
    figures = d.size(d.kept(d.hits(undated, r"\b\d{3,}\b"), "length(e) <> 4 OR (substr(e, 1, 2) <> '19' AND substr(e, 1, 2) <> '20')"))
    return f"length({flat}) <= 80 AND NOT {d.match(undated, MONEY)} AND NOT {d.match(undated, CARRIED)} AND {figures} = 0 AND {d.match(flat, TITLES)}"


def is_address(d: Spark, x: str) -> str:
    return f"({d.match(x, r'(^|\D)\d{6}(\D|$)')} OR length({x}) - length(replace({x}, ',', '')) >= 3 OR ({d.match(x, ADDRESS)} AND {d.match(x, r'\d|,')}))"


def is_business(d: Spark, x: str) -> str:
    """Reads like the heading of a business's own statement."""
    words = d.kept(d.split(f"trim({x})", r"[\s,]+"), "e <> ''")
    strong = d.size(d.kept(words, "substr(e, 1, 1) <> lower(substr(e, 1, 1))"))
    return f"length(trim({x})) BETWEEN 4 AND 70 AND NOT {d.match(x, PROSE)} AND {d.size(words)} BETWEEN 1 AND 9 AND {strong} >= greatest(2, floor({d.size(words)} / 2))"


PROPRIETOR = r"^\(?\s*(?:proprietors?|prop|partners?|owners?)\s*[:.]"


def name_line(d: Spark, x: str) -> str:
    """What a line above a heading says of whose it is: the line, cleaned, or NULL for an address, a heading, a skipped line or figures."""
    clean = stripped(d, d.replace(x, r"\s+", " "), r" .:|=\t-")
    digits = f"(length({clean}) - length({d.replace(clean, '[0-9]', '', True)}))"
    return f"CASE WHEN length({clean}) >= 4 AND NOT {is_address(d, clean)} AND NOT {d.match(clean, SKIP)} AND NOT {d.match(clean, TITLES)} AND {digits} <= 0.3 * length({clean}) THEN {clean} END"


def norm_entity(d: Spark, x: str) -> str:
    return d.replace(f"lower({x})", "[^a-z0-9]", "", True)


def garbled(d: Spark, x: str) -> str:
    """Two or more grouped figures that hold look-alike letters or doubled commas."""
    figures = d.kept(d.hits(x, r"\b[\dlIOoSgB]{1,3}(,+[\dlIOoSgB]{2,3})+\b", True), f"{d.match('e', '[lIOoSgB]', True)} OR e LIKE '%,,%'")
    return f"{d.size(figures)} >= 2"


def word_score(d: Spark, x: str, words: list[str] = VOCABULARY) -> str:
    """Vocabulary hits of a text, by which the upright rotation is told."""
    return d.size(d.kept(d.split(f"lower({x})", "[^a-z]+"), f"e IN ({', '.join(repr(w) for w in words)})"))


def repaired(d: Spark, x: str) -> str:
    """OCR slips: a misread word, and a decimal printed as a comma."""
    return d.replace(d.replace(x, r"\bproflt\b", "Profit"), r"(^|[^\d.,])(\d{1,3}(,\d{3})*,\d{3}),(\d{2})($|[^\d.,])", "$1$2.$4$5")


def identity(d: Spark, x: str) -> dict[str, str]:
    """Fields of a return's identity; NULL where not found."""
    some = lambda e: f"nullif({e}, '')"
    labelled = r"(assessment\s*year|\ba\.?\s*y\.?)\D{0,12}(20\d{2})\s*[-–/]\s*(\d{2})"
    bare = r"\b(20\d{2})\s*[-–]\s*(\d{2})\b"
    return {
        "name": some(stripped(d, d.extract(x, r"(?:^|\n)\s*(?:name(?:\s*of\s*(?:the\s*)?(?:assessee|taxpayer))?)\s*[:\-]?\s*([A-Z][A-Za-z&.'\- ]{2,60}?)\s*(?:\n|$)"), " .-")),
        "pan": some(d.extract(f"upper({x})", r"\b([A-Z]{5}\d{4}[A-Z])\b", 1, True)),
        "ay": f"CASE WHEN {d.match(x, labelled)} THEN concat({d.extract(x, labelled, 2)}, '-', {d.extract(x, labelled, 3)}) WHEN {d.match(x, bare)} THEN concat({d.extract(x, bare, 1)}, '-', {d.extract(x, bare, 2)}) END",
        "form": some(f"{d.extract(x, r'\bitr\s*[-–]?\s*([1-7])\b')}"),
        "ack_no": some(d.extract(x, r"acknowledgement\s*(number|no\.?)\D{0,10}(\d{9,20})", 2)),
        "filing_date": f"replace({some(d.extract(x, r'\b(\d{2}[-/]\d{2}[-/]\d{4})\b'))}, '/', '-')",
        "status": some(f"lower({d.extract(x, r'\b(individual|huf|firm|company|aop|boi|llp|trust|society|partnership\s*firm|private\s*limited)\b')})"),
        "regime": f"CASE WHEN {d.match(x, r'115bac|new\s+tax\s+regime')} THEN 'New' WHEN {d.match(x, r'old\s+tax\s+regime|opting\s+out')} THEN 'Old' END",
    }


def owner_loan(d: Spark, x: str) -> str:
    return f"{d.match(x, OWNER_LOAN)} AND {d.match(x, r'\bunsecured\b')}"
