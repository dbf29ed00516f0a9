"""Connected components of an edge table by alternating large-star and small-star steps, all as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import materialize, remove, scratch_path


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id in `edges` (a long, b long): the smallest id that it reaches.

    Rows with a null end and loops link nothing. Each step hangs every id's neighbours on its smallest one; the rows
    are stars when two steps change nothing. Ids with very many neighbours cost a join on their key, which adaptive
    execution splits; nothing is gathered in one task.
    """
    spark = edges.sparkSession
    at = scratch_path(spark, "edges")
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges", at)
    seen = _digest(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large_at, last = scratch_path(spark, "large-star"), at
        large = materialize(large, "large-star", large_at)
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*")
        at = scratch_path(spark, "small-star")
        now = materialize(small.where("a <> b").distinct(), "small-star", at)
        before, seen = seen, _digest(now)
        remove(spark, large_at)
        remove(spark, last)
        if before == seen:
            break
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
