"""Connected components of a distributed edge list, by alternating large-star and small-star steps.

Every step is a join and an aggregation on Spark: no node's neighbours are gathered in one row or task, and a
node with very many neighbours is one key of a skewed join, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonoframe.llm.common import drop, scratch


def kept(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of ``edges`` (a, b): component is the least node that links reach.

    Edges may repeat, run either way or join a node to itself; nulls link nothing. No edges give no rows.
    """
    spark = edges.sparkSession
    now, path = kept(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = None
    while True:
        # large star: a node's larger neighbours go to the least of its neighbourhood
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least, least_path = kept(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large, large_path = kept(both.where("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large")
        # small star: a node and its smaller neighbours go to the least of those
        least2, least2_path = kept(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least2.hint("merge"), "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        after, after_path = kept(small, "edges")
        for done in (path, least_path, large_path, least2_path):
            drop(spark, done)
        now, path = after, after_path
        seen = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if seen == mark or seen[0] == 0:
            break
        mark = seen
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
