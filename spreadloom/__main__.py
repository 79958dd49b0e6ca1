"""``python -m spreadloom WORDS DOCS``: what was read of each case, year by year.

WORDS is a Parquet table (doc, page, width, x0, y0, x1, y1, text), DOCS one of (doc, case_id, ay, name).
"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from spreadloom.plans.pipeline import spread_cases

SHOWN = ("sales_other_income", "profit_after_tax", "total_assets", "networth")


def summary(words, docs) -> list[str]:
    """A line for each statement, each year and each of its main rows, one for each flag. The cases are as many as the caller asks for."""
    made, out = spread_cases(words, docs), []
    for b in made.blocks.join(made.kept.select("block", F.lit(True).alias("used")), "block", "left").orderBy("case_id", "doc", "page", "kind").toLocalIterator():
        out.append(f"case {b['case_id']}  file {b['doc']}  [{b['status']:<10}] {b['kind']:<14} {b['year'] or 'undated'}  {b['entity'] or 'unnamed'}{'' if b['used'] else '  (not used)'}")
    for v in made.values.orderBy("entity", "year").toLocalIterator():
        out.append(f"case {v['entity']}  year {v['year']}")
        out += [f"  {k:<24} {'not read' if v[k] is None else format(v[k], ',')}" for k in SHOWN]
    for f in made.flags.orderBy("entity", "year", "seq").toLocalIterator():
        out.append(f"case {f['entity']}  year {f['year']}  {f['severity']}: {f['flag']} - {f['detail']}")
    return out


def main(arguments: list[str]) -> int:
    if len(arguments) != 2:
        print(__doc__, file=sys.stderr)
        return 1
    spark = SparkSession.builder.appName("spreadloom").getOrCreate()
    print("\n".join(summary(*(spark.read.parquet(a) for a in arguments))))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
