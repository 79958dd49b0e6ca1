"""Second readings of pages, made elsewhere, as a table of JSON replies."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIDE = "array<struct<label:string,amount:double>>"
REPLY = f"struct<kind:string,year:int,left:{SIDE},right:{SIDE}>"


def lines(replies: DataFrame) -> DataFrame:
    """(doc_id, page_no, json) -> (doc_id, page_no, kind, year, side, seq, label, amount); fences around a reply are dropped, a reply that is no JSON gives nothing."""
    body = F.regexp_replace("json", "(?s)^\\s*```(json)?|```\\s*$", "")
    read = replies.withColumn("r", F.from_json(body, REPLY))
    def side(name: str):
        line = lambda x, k: F.struct(F.lit(name).alias("side"), k.alias("seq"), x["label"].alias("label"), x["amount"].alias("amount"))
        return F.coalesce(F.transform(F.col("r")[name], line), F.array().cast("array<struct<side:string,seq:int,label:string,amount:double>>"))

    sides = F.concat(side("left"), side("right"))
    out = read.select("doc_id", "page_no", F.col("r.kind").alias("kind"), F.col("r.year").alias("year"), F.inline(sides))
    return out.withColumn("amount", F.bround("amount").cast("long")).where(F.col("label").isNotNull() & F.col("amount").isNotNull())


#: Seconds to wait before each try of a model.
WAITS = (0.0, 1.5, 3.0)


class Missing(Exception):
    """A model that is not there; the next one is asked at once."""


class Busy(Exception):
    """A failure that may pass; the same model is asked again."""


def cascade(models: list[str], ask: Callable[[str, str], str], prompt: str, waits: tuple[float, ...] = WAITS, sleep: Callable[[float], None] = time.sleep) -> str | None:
    """The first reply of the models in order. ``ask(model, prompt)`` is the caller's; NULL where all fail.

    A busy model is asked again after each wait, a missing one is passed over, and any other failure ends its turn.
    """
    for model in models:
        for wait in waits:
            sleep(wait)
            try:
                return ask(model, prompt)
            except Busy:
                continue
            except Exception:  # a missing model, or one that fails for good, gives way to the next
                break
    return None
