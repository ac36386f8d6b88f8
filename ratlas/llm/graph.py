"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratlas.llm.common import Scratch


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> (id, component): the smallest id reachable, for every id that occurs in an edge to another.

    Every step replaces edges by edges to smaller ids and keeps what is connected; it ends when nothing changes, as
    stars around the smallest ids. Minima are summed before they are shuffled, and the join that hands them out has
    one row an id on one side, so the centre of a star that holds a third of all ids is split like any skewed join.
    Each step is a table in the shared folder. Loops and repeated edges are ignored; no edges give no rows.
    """
    scratch = Scratch(edges.sparkSession, "components")
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct()
    e = scratch.save(e, "edges-0")
    mark, step = None, 0
    while True:
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == mark or not now[0]:
            break
        mark, step = now, step + 1
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = e.select(F.col("v").alias("u"), F.col("u").alias("w")).join(least, "u").select(F.col("w").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.save(large, f"large-{step}")
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(small, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = scratch.save(hung.union(small.select("u", F.col("m").alias("v"))).distinct(), f"edges-{step}")
        scratch.drop(f"edges-{step - 1}", f"large-{step}")
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
