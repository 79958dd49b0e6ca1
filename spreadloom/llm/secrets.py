"""Secret scans with DataFrame functions only: pattern kinds plus sliding-window Shannon entropy.

Base kinds, leftmost and non-overlapping within a kind: ``assign`` (a keyword, a separator and a value of eight or more
characters), ``access`` (an access key id) and ``hex`` (a long lower-case hex run). The method adds ``entropy`` spans:

* candidates are runs of ``[A-Za-z0-9+/_=-]`` of at least ``WINDOW`` characters that hold a digit;
* a candidate belongs to the hex class (only hex digits and hyphens) or to the base-64 class, each with its own bound;
* a window of ``WINDOW`` characters slides over the candidate; the counts of its characters, and with them the sum of
  ``c * log2(c)``, are updated by the one character that enters and the one that leaves. The window's entropy is
  ``log2(WINDOW) - sum / WINDOW``; sums are whole millionths, so that every engine decides alike;
* windows at or above the bound are merged where they overlap or touch; merged windows are the spans;
* candidates on the allow-list (UUIDs, digits and hyphens only, anything naming an example) are suppressed. The
  allow-list never touches base spans.

Positions are code points, end exclusive. Defined cases: a null or empty text has no spans; rows are independent, so
ties and repeated rows get equal answers; extra columns pass through ``scan``; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spreadloom.llm.common import documents

#: The base patterns. Letters of the keywords stand in either case, spelt out so that no engine folds others.
KEYWORDS = "password|passwd|secret|token|api_?key"
ASSIGN = "(" + "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in KEYWORDS) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "entropy")

WINDOW = 20
CANDIDATE = rf"[A-Za-z0-9+/_=-]{{{WINDOW},}}"
#: Windows of a piece of a long candidate.
PIECE = 1024
SPAN, HIT = "struct<lo:int,hi:int>", "struct<lo:int,hi:int,hit:string>"
HEX_CLASS = "^[0-9a-fA-F-]+$"
#: Least entropy in bits per character, by class.
HEX_BITS, BASE64_BITS = 2.9, 3.6
ALLOW = "^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$|^[0-9-]+$|[Ee][Xx][Aa][Mm][Pp][Ll][Ee]"
#: Millionths of c * log2(c); a window holds one character more between entering and leaving.
WEIGHTS = tuple(round(c * math.log2(c) * 1e6) if c else 0 for c in range(WINDOW + 2))


def bound(bits: float) -> int:
    """The largest sum of weights of a window whose entropy is at least ``bits``."""
    return math.floor(WINDOW * (math.log2(WINDOW) - bits) * 1e6)


HEX_SUM, BASE64_SUM = bound(HEX_BITS), bound(BASE64_BITS)


def bound_to(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value computed once, however often it is used: lambda variables are the only such names."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def running(lengths: Column) -> Column:
    """Running sums of an array: each of log2(n) passes adds the value 1, 2, 4, ... places before."""
    passes = F.when(F.size(lengths) > 1, F.sequence(F.lit(0), F.ceil(F.log2(F.size(lengths))).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    step = lambda acc, k: F.transform(acc, lambda x, i: x + F.coalesce(F.get(acc, i - F.call_function("shiftleft", F.lit(1), k)), F.lit(0)))
    return F.aggregate(passes, lengths, step)


def located(text: Column, pattern: str) -> Column:
    """Array of (lo, hi, hit) of all matches, in time that grows with their number (and its logarithm).

    The segments between matches give the positions, which Spark has no function for.
    """
    empty = F.array().cast(f"array<{HIT}>")

    def placed(hits: Column) -> Column:
        both = F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits)), hits, lambda gap, hit: F.length(gap) + F.length(hit))
        return F.zip_with(running(both), hits, lambda end, hit: F.struct((end - F.length(hit)).alias("lo"), end.alias("hi"), hit.alias("hit")))

    return bound_to(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda hits: F.when(F.size(hits) > 0, placed(hits)).otherwise(empty))


def slid(hit: Column, most: Column) -> Column:
    """Array of (lo, hi): the merged windows of high entropy of a piece of at most ``PIECE`` windows, by incremental counts."""
    weights = F.array(*[F.lit(w).cast("long") for w in WEIGHTS])

    def fold(known: Column) -> Column:
        chars, alphabet = known["chars"], known["alphabet"]

        def slide(acc: Column, k: Column) -> Column:
            at = F.get(known["places"], k)
            entered = F.transform(acc["counts"], lambda c, j: F.when(j == at, c + 1).otherwise(c))
            old = F.get(acc["counts"], at)
            total = acc["total"] + F.get(known["weights"], old + 1) - F.get(known["weights"], old)
            gone = F.when(k >= WINDOW, F.get(known["places"], k - WINDOW)).otherwise(F.lit(-1))
            # the character that leaves is counted after the one that enters
            held = F.get(acc["counts"], gone) + F.when(gone == at, 1).otherwise(0)
            total = total + F.when(gone >= 0, F.get(known["weights"], held - 1) - F.get(known["weights"], held)).otherwise(F.lit(0).cast("long"))
            after = F.transform(entered, lambda c, j: F.when(j == gone, c - 1).otherwise(c))
            high = (k >= WINDOW - 1) & (total <= known["most"])
            last = F.get(acc["out"], F.size(acc["out"]) - 1)
            joined = F.coalesce(last["hi"] >= k - (WINDOW - 1), F.lit(False))
            grown = F.array_append(
                F.when(joined, F.slice(acc["out"], F.lit(1), F.size(acc["out"]) - 1)).otherwise(acc["out"]),
                F.struct(F.when(joined, last["lo"]).otherwise(k - (WINDOW - 1)).alias("lo"), (k + 1).alias("hi")),
            )
            return F.struct(after.alias("counts"), total.alias("total"), F.when(high, grown).otherwise(acc["out"]).alias("out"))

        start = F.struct(F.array_repeat(F.lit(0), F.size(alphabet)).alias("counts"), F.lit(0).cast("long").alias("total"), F.array().cast(f"array<{SPAN}>").alias("out"))
        return F.aggregate(F.sequence(F.lit(0), F.size(chars) - 1), start, slide, lambda acc: acc["out"])

    def places(known: Column) -> Column:
        where = F.transform(known["chars"], lambda c: F.array_position(known["alphabet"], c).cast("int") - 1)
        return bound_to(F.struct(known["chars"], known["alphabet"], where.alias("places"), weights.alias("weights"), most.alias("most")), fold)

    return bound_to(F.split(hit, ""), lambda chars: bound_to(F.struct(chars.alias("chars"), F.array_distinct(chars).alias("alphabet")), places))


def windows(hit: Column) -> Column:
    """Array of (lo, hi), relative to the candidate: its merged windows of high entropy.

    A long candidate is taken in pieces of ``PIECE`` windows, and spans that touch over a cut are joined, so that the time
    grows with its length.
    """
    most = F.when(hit.rlike(HEX_CLASS), F.lit(HEX_SUM)).otherwise(F.lit(BASE64_SUM)).cast("long")
    cuts = F.sequence(F.lit(0), F.length(hit) - WINDOW, F.lit(PIECE))
    shifted = lambda at, most: F.transform(slid(F.substring(hit, at + 1, F.lit(PIECE + WINDOW - 1)), most), lambda w: F.struct((w["lo"] + at).alias("lo"), (w["hi"] + at).alias("hi")))

    def merged(spans: Column) -> Column:
        last = F.size(spans) - 1
        firsts = F.filter(spans, lambda s, i: (i == 0) | (F.get(spans, i - 1)["hi"] < s["lo"]))
        lasts = F.filter(spans, lambda s, i: (i == last) | (F.get(spans, i + 1)["lo"] > s["hi"]))
        return F.zip_with(firsts, lasts, lambda a, b: F.struct(a["lo"].alias("lo"), b["hi"].alias("hi")))

    pieces = lambda most: F.flatten(F.transform(cuts, lambda at: shifted(at, most)))
    return F.when(F.length(hit) < PIECE + WINDOW, slid(hit, most)).otherwise(bound_to(bound_to(most, pieces), merged))


def scan(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``secret_spans``, an array of (lo, rank, hi, kind) by start and kind, to every row; nothing is moved.

    ``rank`` is the place of the kind in ``KINDS``.
    """
    body = F.coalesce(F.col(text), F.lit(""))

    def kind(rank: int, spans: Column) -> Column:
        return F.transform(spans, lambda s: F.struct(s["lo"].alias("lo"), F.lit(rank).alias("rank"), s["hi"].alias("hi"), F.lit(KINDS[rank]).alias("kind")))

    out = df.withColumns({"_assign": located(body, ASSIGN), "_access": located(body, ACCESS), "_hex": located(body, HEX), "_runs": located(body, CANDIDATE)})
    valued = F.filter("_assign", lambda s: F.length(F.regexp_extract(s["hit"], ASSIGN, 2)) >= 8)
    runs = F.filter("_runs", lambda s: s["hit"].rlike("[0-9]") & ~s["hit"].rlike(ALLOW))
    spread = F.flatten(F.transform(runs, lambda s: F.transform(windows(s["hit"]), lambda w: F.struct((s["lo"] + w["lo"]).alias("lo"), (s["lo"] + w["hi"]).alias("hi")))))
    spans = F.concat(kind(0, valued), kind(1, F.col("_access")), kind(2, F.col("_hex")), kind(3, spread))
    return out.withColumn("secret_spans", F.sort_array(spans)).drop("_assign", "_access", "_hex", "_runs")


def redact(df: DataFrame, text: str = "text", spans: str = "secret_spans", mark: str = "[SECRET]") -> DataFrame:
    """Replace every span in ``text`` (overlapping and touching ones as one) by ``mark``; texts without spans stay as they are."""

    def marked(found: Column) -> Column:
        # a span opens a mark unless one before reaches beyond its start; spans come by start
        reach = F.transform(found, lambda s, i: F.struct(s["lo"].alias("lo"), s["hi"].alias("hi"), i.alias("i")))
        return bound_to(reach, lambda r: bound_to(furthest(r), lambda far: cut(r, far)))

    def furthest(r: Column) -> Column:
        """The largest end of a span and all before it, by doubling steps."""
        passes = F.when(F.size(r) > 1, F.sequence(F.lit(0), F.ceil(F.log2(F.size(r))).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
        step = lambda acc, k: F.transform(acc, lambda x, i: F.greatest(x, F.coalesce(F.get(acc, i - F.call_function("shiftleft", F.lit(1), k)), x)))
        return F.aggregate(passes, F.transform(r, lambda s: s["hi"]), step)

    def cut(r: Column, far: Column) -> Column:
        opens = F.filter(r, lambda s: (s["i"] == 0) | (F.get(far, s["i"] - 1) < s["lo"]))
        closes = F.filter(far, lambda end, i: (i == F.size(far) - 1) | (F.get(r, i + 1)["lo"] > end))
        pieces = bound_to(F.struct(opens.alias("a"), closes.alias("b")), lambda g: F.transform(g["a"], lambda s, i: F.substring(F.col(text), F.coalesce(F.get(g["b"], i - 1), F.lit(0)) + 1, s["lo"] - F.coalesce(F.get(g["b"], i - 1), F.lit(0)))))
        tail = F.substring(F.col(text), F.element_at(closes, -1) + 1, F.length(F.col(text)))
        return F.concat(F.array_join(pieces, mark), F.lit(mark), tail)

    return df.withColumn(text, F.when(F.size(spans) > 0, marked(F.col(spans))).otherwise(F.col(text)))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["lo"], s["hi"])), ",")


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(documents(spark, sf_dir).select("doc_id", "text"))
    n = lambda kind: F.size(F.filter("secret_spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("secret_spans", lambda s: s["kind"] != "entropy")
    return found.select(
        "doc_id", n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"),
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secret_spans")).alias("spans"),
    )


def _located_sql(kind: str, pattern: str) -> str:
    quoted = pattern.replace("'", "''")
    return f"""(SELECT doc_id, '{kind}' AS kind, hits[k] AS hit,
        list_sum(list_transform(gaps[1:k], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(hits[1:k - 1], lambda x: length(x))), 0)::BIGINT AS lo
      FROM (SELECT doc_id, hits, gaps, unnest(range(1, len(hits) + 1)) AS k
            FROM (SELECT doc_id, regexp_extract_all(text, '{quoted}') AS hits, string_split_regex(text, '{quoted}') AS gaps FROM d)))"""


OP3_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
m AS ({_located_sql("assign", ASSIGN)} UNION ALL {_located_sql("access", ACCESS)} UNION ALL {_located_sql("hex", HEX)} UNION ALL {_located_sql("run", CANDIDATE)}),
base AS (SELECT doc_id, kind, CASE kind WHEN 'assign' THEN 0 WHEN 'access' THEN 1 ELSE 2 END AS rank, lo, lo + length(hit) AS hi FROM m
         WHERE kind <> 'run' AND (kind <> 'assign' OR length(regexp_extract(hit, '{ASSIGN.replace("'", "''")}', 2)) >= 8)),
c AS (SELECT doc_id, lo, hit, CASE WHEN regexp_matches(hit, '{HEX_CLASS}') THEN {HEX_SUM} ELSE {BASE64_SUM} END AS most
      FROM m WHERE kind = 'run' AND regexp_matches(hit, '[0-9]') AND NOT regexp_matches(hit, '{ALLOW}')),
w AS (SELECT doc_id, lo, most, k, substr(hit, k, {WINDOW}) AS piece FROM (SELECT *, unnest(range(1, length(hit) - {WINDOW} + 2)) AS k FROM c)),
ch AS (SELECT doc_id, lo, most, k, unnest(string_split(piece, '')) AS x FROM w),
n AS (SELECT doc_id, lo, most, k, x, count(*) AS c FROM ch GROUP BY ALL),
h AS (SELECT doc_id, lo, k FROM (SELECT doc_id, lo, most, k, sum(({list(WEIGHTS)})[c + 1]) AS s FROM n GROUP BY ALL) WHERE s <= most),
i AS (SELECT *, CASE WHEN k - lag(k) OVER (PARTITION BY doc_id, lo ORDER BY k) <= {WINDOW} THEN 0 ELSE 1 END AS fresh FROM h),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, lo ORDER BY k) AS island FROM i),
e AS (SELECT doc_id, 'entropy' AS kind, 3 AS rank, lo + min(k) - 1 AS lo, lo + max(k) - 1 + {WINDOW} AS hi FROM g GROUP BY doc_id, g.lo, island),
s AS (SELECT * FROM base UNION ALL SELECT * FROM e),
a AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
             string_agg(kind || ':' || lo || ':' || hi, ',' ORDER BY lo, rank) FILTER (rank < 3) AS b, string_agg(kind || ':' || lo || ':' || hi, ',' ORDER BY lo, rank) AS spans
      FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a ON a.doc_id = d.doc_id
"""
