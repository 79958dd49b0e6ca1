"""What kind of statement a block is, how its pages join, and which reading of it is taken. Named relations of both engines."""

from __future__ import annotations

from spreadloom.operators import trust, verification
from spreadloom.plans.dialect import Spark

#: The vocabulary of each kind.
BALANCE_WORDS = r"\b(sundry\s+creditor|sundry\s+debtor|fixed\s+asset|current\s+asset|unsecured\s+loan|secured\s+loan|closing\s+stock|cash\s+(in\s+hand|&|and)|investment|capital\s+account|loans?\s*&\s*advance)\b"
PROFIT_WORDS = r"\b(gross\s+(receipt|profit|turnover)|sales?\b|net\s+(profit|income)|depreciation|salar(y|ies)|wages|rent\b|electricity|expenses?\b|purchases?|freight|interest\s+(paid|&\s*bank))\b"
CAPITAL_WORDS = r"\b(drawings?|opening\s+capital|closing\s+capital|capital\s+introduced)\b"
BOOK_PROFIT = r"net\s+profit\s*(/\s*)?(\(\s*loss\s*\))?\s*(before\s+tax\s*)?(as\s+per\s+(p\s*&\s*l|profit\s*(&|and)\s*loss)\s*(a/?c|account)?\.?)?\s*:?\s*(\(?-?\s*\d[\d,]{2,}(\.\d+)?\)?)"
COMPUTATION_PAGE = r"computation|profits?\s+and\s+gains\s+of\s+business|income\s+from\s+business"
ACK_PAGE = r"income\s+tax\s+return\s+acknowledge?ment|\bITR\s*-?\s*V\b"
ACK_FIELDS = (
    ("current_year_business_loss", r"current\s+year\s+business\s+loss(\s*,\s*if\s+any)?"),
    ("gross_total_income", r"gross\s+total\s+income"),
    ("total_income", r"(^|[^s]|[^s]s)\s+total\s+income"),
    ("net_tax_payable", r"net\s+tax\s+payable"),
    ("taxes_paid", r"taxes\s+paid"),
    ("tax_payable_or_refund", r"\(\+\)\s*tax\s+payable\s*/\s*\(-\)\s*refundable\s*\(\s*\d+\s*-\s*\d+\s*\)"),
)
#: Groups within each label above, which come before those of the value.
_GROUPS = {"current_year_business_loss": 1, "total_income": 1}
ACK_VALUE = r"\s+\d{1,2}[A-Za-z]?\s+(\(-\)\s*|-\s*)?(\d[\d,]*)"


def classified(d: Spark):
    """(block, heading, labels) -> its kind: a clear heading decides, then two capital words, then the fuller vocabulary."""
    heading = lambda p: d.match("heading", p)
    whole = "concat(heading, ' ; ', labels)"
    b, p, c = d.size(d.hits(whole, BALANCE_WORDS)), d.size(d.hits(whole, PROFIT_WORDS)), d.size(d.unique(d.hits("lower(labels)", CAPITAL_WORDS)))
    return [
        ("scored", f"SELECT *, {b} AS b, {p} AS p, {c} AS c FROM headed"),
        (
            "classified",
            f"""SELECT block, b, p, c, CASE WHEN {heading(r'\bbalance\s*sheet\b')} THEN 'balance_sheet' WHEN {heading(r'\b(prof[il]t\s*(&|and)\s*loss|income\s*(&|and)\s*expenditure|trading)\b')} THEN 'profit_loss'
          WHEN {heading(r'\bcapital\s+a/?c(count)?\b')} AND NOT {heading(r'\basset')} THEN 'capital_account' WHEN c >= 2 THEN 'capital_account' WHEN b >= p AND b > 0 THEN 'balance_sheet' WHEN p > 0 THEN 'profit_loss' ELSE 'other' END AS kind FROM scored""",
        ),
    ]


def entities(d: Spark, most: int = 3):
    """The name above each heading: of the three lines before it the nearest that names something, a proprietor's only if none else does.

    ``heading_rows`` (doc, row_no, text, title) are the lines of pages.
    """
    from spreadloom.functions import scalars

    own = f"CASE WHEN NOT {d.match('found', scalars.PROPRIETOR)} THEN found END"
    owner = f"CASE WHEN {d.match('found', scalars.PROPRIETOR)} THEN found END"
    above = lambda c: ", ".join(f"lag({c}, {k}) OVER (PARTITION BY doc ORDER BY row_no)" for k in range(1, most + 1))
    return [
        ("named_lines", f"SELECT *, {scalars.name_line(d, 'text')} AS found FROM heading_rows"),
        ("told_lines", f"SELECT *, {own} AS own, {owner} AS owner FROM named_lines"),
        ("above", f"SELECT doc, row_no, title, coalesce({above('own')}, {above('owner')}, '') AS entity FROM told_lines"),
        ("entities", "SELECT doc, row_no, entity FROM above WHERE title"),
    ]


def continued(d: Spark):
    """Pages (doc, page, first_line, last_line) -> the page each belongs to: carried over at its end, brought forward on the next."""
    return [
        ("bridged", f"SELECT doc, page, {d.match('first_line', r'^\s*brought\s*(forward|over|fwd)\b|^\s*b/?f\b')} AND coalesce({d.match('lag(last_line) OVER (PARTITION BY doc ORDER BY page)', r'^\s*carried\s*(over|forward|fwd)\b')}, FALSE) AS joins FROM page_ends"),
        ("continued", "SELECT doc, page, joins, CAST(sum(CASE WHEN joins THEN 0 ELSE 1 END) OVER (PARTITION BY doc ORDER BY page ROWS UNBOUNDED PRECEDING) AS BIGINT) AS statement FROM bridged"),
    ]


def book_profit(d: Spark):
    """The profit that the first computation page of a document restates; brackets or a minus make a loss."""
    flat = d.replace("text", r"\s+", " ")
    raw = d.replace(d.extract("flat", BOOK_PROFIT, 8), " ")
    digits = d.half_even(d.number(d.replace("raw", r"[^0-9.]")))
    return [
        ("flattened", f"SELECT doc, page, {flat} AS flat FROM pages_in"),
        ("restated", f"SELECT doc, page, {raw} AS raw FROM flattened WHERE {d.match('flat', COMPUTATION_PAGE)} AND {d.match('flat', BOOK_PROFIT)}"),
        ("book_profit", f"SELECT doc, page, {digits} * (CASE WHEN raw LIKE '(%' OR raw LIKE '-%' THEN -1 ELSE 1 END) AS profit FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY page) AS k FROM restated) AS r WHERE k = 1"),
    ]


def return_figures(d: Spark):
    """The figures of the first acknowledgement page; a refund is negative."""
    fields = []
    for name, label in ACK_FIELDS:
        at = _GROUPS.get(name, 0)
        value = d.half_even(d.number(f"nullif(replace({d.extract('flat', label + ACK_VALUE, at + 2)}, ',', ''), '')"))
        fields.append(f"{value} * (CASE WHEN {d.extract('flat', label + ACK_VALUE, at + 1)} <> '' THEN -1 ELSE 1 END) AS {name}")
    return [
        ("flattened", f"SELECT doc, page, {d.replace('text', r'\s+', ' ')} AS flat FROM pages_in"),
        ("acknowledged", f"SELECT *, row_number() OVER (PARTITION BY doc ORDER BY page) AS k FROM flattened WHERE {d.match('flat', ACK_PAGE)}"),
        ("return_figures", f"SELECT doc, page, {', '.join(fields)} FROM acknowledged WHERE k = 1"),
    ]


def header_years(d: Spark):
    """Years printed in the first six rows of a page, above its first figure, in order; of a range only the end counts."""
    year = r"20\d{2}"
    return [
        ("topped", f"SELECT page, row_no, {d.replace('text', r'(20\d{2})\s*[-–]\s*(20\d{2})', '$2')} AS text, min(CASE WHEN {d.match('text', r'\d{1,3}(,\d{2,3})+')} THEN row_no END) OVER (PARTITION BY page) AS figures FROM page_rows"),
        ("years_of", f"SELECT page, row_no, {d.joined(d.hits('text', year), ' ')} AS years FROM topped WHERE row_no < 6 AND (figures IS NULL OR row_no < figures) AND {d.match('text', year)}"),
        ("header_years", f"SELECT page, {d.gathered('years', ' ', 'row_no')} AS years FROM years_of GROUP BY page"),
    ]


def comparative(d: Spark):
    """The prior-year statement that a two-column block also prints: the latest header year before its own, else one less."""
    return [
        ("priors", "SELECT block, max(CASE WHEN header_year < year THEN header_year END) AS prior FROM headers JOIN own_years ON block = own_block GROUP BY block"),
        ("comparative", "SELECT own_block AS block, coalesce(prior, year - 1) AS year, TRUE AS from_comparative FROM own_years LEFT JOIN priors ON own_block = block"),
    ]


#: The grand totals worth reading from a comparative column.
ANCHORS = (
    ("total_revenue", r"total\s+revenue|total\s+income\b"),
    ("total_expenses", r"total\s+expenses?\b"),
    ("total_assets", r"total\s+assets\b"),
    ("total_equity_liabilities", r"total\s+equity\s+(?:and|&)\s+liabilit|total\s+liabilit\w*\s+(?:and|&)\s+equity"),
)


def comparative_totals(d: Spark):
    """The named grand totals of a statement's comparative column; ``prior_rows`` (block, seq, label, prior), the last of a name counts."""
    anchor = "CASE " + " ".join(f"WHEN {d.match('label', p)} THEN '{k}'" for k, p in ANCHORS) + " END"
    return [
        ("anchored", f"SELECT block, seq, prior, {anchor} AS anchor FROM prior_rows WHERE prior IS NOT NULL"),
        ("comparative_totals", "SELECT block, " + ", ".join(f"max_by(CASE WHEN anchor = '{k}' THEN prior END, CASE WHEN anchor = '{k}' THEN seq END) AS {k}" for k, _ in ANCHORS) + " FROM anchored WHERE anchor IS NOT NULL GROUP BY block"),
    ]


def segmented(d: Spark):
    """Parts of an account between its subtotals; taken only when every part's two sides agree, and then the parts add up."""
    return [
        ("parted", "SELECT block, seq, side, amount, coalesce(sum(subtotal) OVER (PARTITION BY block ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part FROM sub_lines"),
        ("part_sums", "SELECT block, part, CAST(sum(CASE WHEN side = 'left' THEN amount ELSE 0 END) AS BIGINT) AS l, CAST(sum(CASE WHEN side = 'right' THEN amount ELSE 0 END) AS BIGINT) AS r FROM parted GROUP BY block, part"),
        ("segmented", "SELECT block, count(*) AS parts, min(CASE WHEN abs(l - r) <= 2 THEN 1 ELSE 0 END) = 1 AS verified, CAST(sum(l) AS BIGINT) AS total FROM part_sums GROUP BY block"),
    ]


def restated_parents(d: Spark):
    """A section that is over by exactly one line whose following lines add up to that line: the parent is dropped."""
    return [
        ("excess", "SELECT block, section, max(total) AS total, CAST(sum(amount) AS BIGINT) AS items FROM lines_in GROUP BY block, section"),
        ("parents", "SELECT l.block, l.section, seq, amount FROM lines_in AS l JOIN excess AS e ON l.block = e.block AND l.section = e.section WHERE e.items - e.total = amount"),
        ("below", "SELECT p.block, p.section, p.seq, p.amount, sum(l.amount) OVER (PARTITION BY p.block, p.section, p.seq ORDER BY l.seq ROWS UNBOUNDED PRECEDING) AS run FROM parents AS p JOIN lines_in AS l ON p.block = l.block AND p.section = l.section AND l.seq > p.seq"),
        ("restated_parents", "SELECT block, section, seq, amount, max(CASE WHEN abs(run - amount) <= 2 THEN 1 ELSE 0 END) = 1 AS dropped FROM below GROUP BY block, section, seq, amount"),
    ]


def adopted(d: Spark, share: float = 0.2):
    """A second reading of a failed block is taken only if it balances and lies within a fifth of the larger side first read."""
    return [
        ("compared", f"SELECT first_reading.block, greatest(l0, r0) AS reference, abs(l1 - r1) <= 2 AS balances, greatest(l0, r0) > 0 AND abs(greatest(l1, r1) - greatest(l0, r0)) > {share} * greatest(l0, r0) AS disagrees FROM first_reading JOIN second_reading ON first_reading.block = second_reading.block"),
        ("adopted", "SELECT block, reference, balances AND NOT disagrees AS taken FROM compared"),
    ]


def repaired_separators(d: Spark):
    """Group separators read as points are commas again; a last group of two after one of three is paise."""
    mixed = r"^\d{1,3}([.,]\d{2})+[.,]\d{3}([.,]\d{2})?$"
    fixed = f"CASE WHEN {d.match('e', mixed)} THEN CASE WHEN {d.match('e', r'[.,]\d{3}[.,]\d{2}$')} THEN concat(replace(substr(e, 1, length(e) - 3), '.', ','), '.', substr(e, length(e) - 1, 2)) ELSE replace(e, '.', ',') END ELSE e END"
    return [("repaired", f"SELECT k, {d.joined(d.mapped(d.split('s', ' '), fixed), ' ')} AS s FROM given")]


def all_checks(d: Spark):
    """Every check of a year, and what the failed ones dispute: rows that are read, not zero and not proven."""
    names = ("section_totals", "balance", "against_statement", "against_computation", "into_capital", "printed_twice")
    return [
        ("all_checks", " UNION ALL ".join(f"SELECT entity, year, name, gap, status FROM {n}" for n in names)),
        ("disputes", f"SELECT all_checks.entity, all_checks.year, name, status, CAST(gap AS BIGINT) AS gap, count(CASE WHEN rank IN (1, 2) THEN 1 END) AS disputed FROM all_checks LEFT JOIN ranks ON all_checks.entity = ranks.entity AND all_checks.year = ranks.year AND status = 'fail' GROUP BY all_checks.entity, all_checks.year, name, status, gap"),
    ]


CHECKS = (trust.section_totals, trust.balance, trust.against_statement, trust.against_computation, trust.into_capital, trust.printed_twice)


def subtotal_rows(d: Spark):
    """Rows whose first and last figures are equal."""
    return [verification.row_ends(d), ("subtotal_rows", "SELECT block, section, first_figure AS amount FROM row_ends WHERE n >= 2 AND abs(first_figure - last_figure) <= 2")]


def side_tags(d: Spark):
    """Lines of a two-sided profit and loss account by their side: the left are expenses, the right income; tagged ones stay."""
    tagged = d.match("label", r"^\[[A-Z]+\]")
    return [("side_tags", f"SELECT lines_in.block, seq, side, CASE WHEN kind = 'profit_loss' AND NOT {tagged} THEN concat(CASE WHEN side = 'left' THEN '[EXP] ' ELSE '[INC] ' END, label) ELSE label END AS label, amount FROM lines_in JOIN blocks_in ON lines_in.block = blocks_in.block")]


TRANSFER = r"gross\s+(?:pr\w{1,4}t|loss)|\b[cb]\s*/\s*[ofd]\b|\btrf\b"


def transfers(d: Spark):
    """Trading and profit accounts printed as one: the gross result carried down on one side and brought down on the other.

    The account is split there: rows up to the carried line are the trading half, those after it the profit half, and the
    halves balance without the pair, which stands once on each side.
    """
    return [
        ("carried", f"SELECT block, seq, side, amount FROM account_lines WHERE {d.match('label', TRANSFER)}"),
        ("transfers", "SELECT a.block, min(a.seq) AS from_seq, min(b.seq) AS to_seq, a.amount FROM carried AS a JOIN carried AS b ON a.block = b.block AND a.amount = b.amount AND a.side = 'left' AND b.side = 'right' GROUP BY a.block, a.amount"),
    ]


def combined(d: Spark):
    """Combined accounts whose two sides agree across the whole, with a pair of transfers: the agreed sum is their total."""
    return [
        *transfers(d),
        ("both_sums", "SELECT block, CAST(sum(CASE WHEN side = 'left' THEN amount ELSE 0 END) AS BIGINT) AS l, CAST(sum(CASE WHEN side = 'right' THEN amount ELSE 0 END) AS BIGINT) AS r FROM account_lines GROUP BY block"),
        ("paired_blocks", "SELECT DISTINCT block FROM transfers"),
        ("combined", "SELECT both_sums.block, l AS total, abs(l - r) <= 2 AND l <> 0 AS agreed FROM both_sums JOIN paired_blocks ON both_sums.block = paired_blocks.block"),
    ]


#: Words that name no schedule in particular, and the group lines that a schedule may stand for.
NAME_STOP = ("expenses", "expense", "xpenses", "account", "charges", "other", "particulars", "amount", "total")
EXPANDABLE = r"\b(?:direct|indirect|operating|operational|operation|administrative|admin|establishment|general|selling|manufacturing)\b.*\bexp"


def known_words(d: Spark, x: str) -> str:
    plain = d.replace(f"coalesce({x}, '')", r"^\[[A-Z]+\]\s*")
    return d.unique(d.kept(d.hits(f"lower({plain})", r"[a-z]{4,}"), f"e NOT IN ({', '.join(map(repr, NAME_STOP))})"))


def name_words(d: Spark):
    """The words by which a schedule is known: four letters or more, each once, without its tag and the common ones."""
    words = known_words(d, "label")
    return [("name_words", f"SELECT label, {d.joined(f'{d.ordered(words)}', ' ')} AS words, {d.size(words)} AS n FROM captions")]


def expansions(d: Spark):
    """Group lines of a P&L that a schedule may stand for, and which.

    ``faces`` (block, doc, scale, seq, label, amount) and ``offered`` (doc, sched_block, section, scale, name, total), verified
    schedules of other pages. A schedule totals to the line within a printed unit and shares a word of its name.
    ``offers`` has a line's schedules in order; ``expanded`` gives each line of a block, in order, the first one that no line
    before took.
    """
    offered = "concat(CAST(sched_block AS STRING), ':', CAST(section AS STRING))".replace("STRING", "STRING" if d.name == "spark" else "VARCHAR")
    steps = [
        ("face_words", f"SELECT *, {known_words(d, 'label')} AS words FROM faces WHERE {d.match('label', EXPANDABLE)}"),
        ("offer_words", f"SELECT *, {known_words(d, 'name')} AS names FROM offered"),
        ("matches", f"SELECT f.block, f.seq, sched_block, section, {offered} AS offer FROM face_words AS f JOIN offer_words AS o ON f.doc = o.doc AND f.block <> o.sched_block AND abs(o.total - f.amount) <= greatest(2, f.scale, o.scale) WHERE {d.size(d.common('words', 'names'))} > 0"),
        ("offers", f"SELECT block, seq, {d.in_order('offer', 'struct(sched_block, section)' if d.name == 'spark' else 'sched_block, section')} AS offers FROM matches GROUP BY block, seq"),
    ]
    if d.name != "spark":
        return steps
    return [
        *steps,
        ("ordered", "SELECT block, sort_array(collect_list(struct(seq, offers))) AS wanted FROM offers GROUP BY block"),
        (
            "folded",
            """SELECT block, aggregate(wanted, CAST(array() AS ARRAY<STRUCT<seq: BIGINT, offer: STRING>>),
          (acc, w) -> array_append(acc, named_struct('seq', w.seq, 'offer', get(filter(w.offers, o -> NOT exists(acc, t -> coalesce(t.offer = o, FALSE))), 0)))) AS given FROM ordered""",
        ),
        ("expanded", "SELECT block, t.seq, t.offer FROM folded LATERAL VIEW explode(given) AS t WHERE t.offer IS NOT NULL"),
    ]


def overridden(d: Spark):
    """Keys that were given for labels from outside come after the rules and count only if they are template rows."""
    from spreadloom.plans.template import INPUTS

    return [("overridden", f"SELECT label_keys.label, coalesce(key, CASE WHEN given_key IN ({', '.join(map(repr, INPUTS))}) THEN given_key END) AS key FROM label_keys LEFT JOIN overrides ON label_keys.label = overrides.given_label")]


def cell_notes(d: Spark, most: int = 25):
    """Notes of input cells: what is unread or doubtful, with up to ``most`` source lines, largest first, and how many more.

    ``formula`` is the figure as the sum of its lines, in lakhs, where several add up to it within a rupee.
    """
    lakhs = d.replace(d.replace(d.fixed("counted / CAST(100000 AS DOUBLE)", 5), ","), r"\.?0+$")
    return [
        ("sources_of", f"SELECT mapped.entity, mapped.year, mapped.key, label, counted, {lakhs} AS term, row_number() OVER (PARTITION BY mapped.entity, mapped.year, mapped.key ORDER BY abs(counted) DESC, label) AS k FROM mapped WHERE key IS NOT NULL AND key <> '__ignored__'"),
        ("sums_of", f"SELECT entity, year, key, count(*) AS n, CAST(sum(counted) AS BIGINT) AS total, {d.gathered('term', '+', 'k')} AS terms FROM sources_of GROUP BY entity, year, key"),
        ("noted", f"SELECT entity, year, key, {d.gathered('label', ' + ', 'k')} AS note FROM sources_of WHERE k <= {most} GROUP BY entity, year, key"),
        (
            "cell_notes",
            f"""SELECT ranks.entity, ranks.year, ranks.key, {trust.name('rank')} AS level, CASE WHEN rank = 0 THEN 'red' WHEN rank = 1 THEN 'amber' END AS fill, CASE WHEN n > {most} THEN concat(note, ' + more') ELSE note END AS note, n,
          CASE WHEN n > 1 AND abs(total - amount) <= 1 THEN concat('=', replace(terms, '+-', '-')) END AS formula FROM ranks
          LEFT JOIN noted ON ranks.entity = noted.entity AND ranks.year = noted.year AND ranks.key = noted.key LEFT JOIN sums_of ON ranks.entity = sums_of.entity AND ranks.year = sums_of.year AND ranks.key = sums_of.key
          LEFT JOIN buckets ON ranks.entity = buckets.entity AND ranks.year = buckets.year AND ranks.key = buckets.key""",
        ),
    ]


def borrower(d: Spark):
    """The first plausible entity of a case and the name of its file."""
    from spreadloom.functions import scalars

    return [
        ("plausible", f"SELECT doc, block, entity, row_number() OVER (PARTITION BY doc ORDER BY block) AS k FROM blocks WHERE {scalars.is_business(d, 'entity')}"),
        ("borrower", f"SELECT doc, entity, concat({d.replace('entity', r'[^A-Za-z0-9]+', '_')}, '_spread.xlsx') AS file_name FROM plausible WHERE k = 1"),
    ]
