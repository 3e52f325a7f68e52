"""Connected components of an edge list, by joins alone."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velobus.llm.shared import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): the smallest node it can reach.

    Alternating star contraction: large stars move a node's larger neighbours to the smallest of
    its neighbourhood, small stars the smaller ones. No step gathers a neighbourhood; a node with
    many neighbours is one skewed join key. Loops and repeated edges change nothing; no edges, no
    rows.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    pairs = stored(pairs.distinct())
    before = None
    while True:
        state = pairs.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == before:
            break
        before = state
        both = pairs.union(pairs.select("v", "u")).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Now v < u in every row: the small star links all smaller neighbours to the smallest.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        pairs = stored(small.select("e.u", "e.v").where("u <> v").distinct())
    roots = pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
