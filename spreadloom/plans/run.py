"""Running relations over DataFrames: the library's way into the plans."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame

from spreadloom.plans.dialect import SPARK

Step = Callable[..., list[tuple[str, str]]]


def relations(inputs: dict[str, DataFrame], *steps: Step, result: str | None = None) -> DataFrame:
    """The last relation (or ``result``) of the steps over named DataFrames.

    >>> relations({"lines": lines}, spread.buckets, spread.derived, spread.ratios)
    """
    spark = next(iter(inputs.values())).sparkSession
    tag, views = uuid4().hex[:12], []
    for name, df in inputs.items():
        df.createOrReplaceTempView(f"v_{name}_{tag}")
        views.append((name, f"SELECT * FROM v_{name}_{tag}"))
    made = views + [r for step in steps for r in step(SPARK)]
    text = "WITH " + ", ".join(f"{name} AS ({sql})" for name, sql in made) + f" SELECT * FROM {result or made[-1][0]}"
    return spark.sql(text)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table below ``spark.checkpoint.dir``, so that what reads it several times computes it once.

    Where that is unset a temporary folder serves a local master; a cluster's machines share none.
    """
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "local")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        local = tempfile.mkdtemp(prefix="spreadloom-")
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        base = f"file://{local}"
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{name}-{uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
