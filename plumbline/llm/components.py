"""Connected components of a large graph, without collecting a node's neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.scratch import written


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges(a, b)``; root is the component's smallest node.

    Alternates two steps until every component is a star, that is until no node
    with a parent is a parent and none has two: each node hands its larger
    neighbours to its smallest one, then each node hands its smaller neighbours
    to the smallest of them. Only minima are grouped by node, so a
    hub costs a row per task; its edges meet the minimum in a join that
    adaptive execution may split. Every round is a written table.
    """
    e = written(edges.select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")).where("x <> y").distinct(), "edges")
    while True:
        both = e.unionByName(e.select(F.col("y").alias("x"), F.col("x").alias("y")))
        low = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.join(low, "x").where("y > x").select(F.col("y").alias("x"), F.col("m").alias("y"))
        low = large.groupBy("x").agg(F.min("y").alias("m"))
        met = large.join(low, "x")
        small = met.select("x", F.col("m").alias("y")).unionByName(met.where("y <> m").select(F.col("y").alias("x"), F.col("m").alias("y")))
        e = written(small.distinct(), "edges")
        parents = e.select(F.col("y").alias("x")).distinct()
        torn = e.groupBy("x").agg(F.count(F.lit(1)).alias("n")).where("n > 1")  # two parents: their halves are not joined yet
        if not e.join(parents, "x", "left_semi").head(1) and not torn.head(1):
            break
    return e.select(F.col("x").alias("node"), F.col("y").alias("root")).unionByName(e.select(F.col("y").alias("node"), F.col("y").alias("root")).distinct())
