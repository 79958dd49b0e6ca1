"""Connected components of a table of links, by alternating star contraction, without collecting links anywhere.

Every round points each node at the smallest node it knows of, first among larger neighbours, then among smaller ones,
and writes the links to the shared folder. Rounds are logarithmic in the number of links of a component. A node with
more than one in ``HOT`` of all links is a hub; what hubs point at, ``2 * HOT`` rows at most, goes to all tasks, so the
links of a hub never meet in one of them. Up to ``HANDED`` rows, what every node points at does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spreadloom.llm.common import HANDED, HOT, discard, handed, join_frequent, materialise

def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of ``links`` (a, b), two-way or not; the component is its smallest node."""
    edges = materialise(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    rows = edges.count()
    pointed = lambda table, least: table.join(handed(least.drop("n"), 2 * rows), "u") if 2 * rows <= HANDED else join_frequent(table, least, ["u"], 1 + rows // HOT)
    for _ in range(most_rounds):
        # large star: larger neighbours of a node go to the smallest of the node and its neighbours
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = materialise(pointed(both, least).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v"), "links")
        discard(edges)
        # small star: a node and its smaller neighbours go to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = pointed(large, least).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialise(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        discard(large)
        # done when every node points at one other, and no node that is pointed at points on
        ends = edges.select("u", F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(edges.select(F.col("v").alias("u"), F.lit(0).alias("out"), F.lit(1).alias("into")))
        state = ends.groupBy("u").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out > 1 OR (out > 0 AND into > 0)")
        if state.isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
