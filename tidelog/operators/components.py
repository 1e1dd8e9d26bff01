"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import drop_path, new_path


def _kept(edges: DataFrame, old: list[str]) -> tuple[DataFrame, tuple]:
    spark, path = edges.sparkSession, new_path(edges.sparkSession, "edges")
    edges.write.parquet(path)
    back = spark.read.schema(edges.schema).parquet(path)
    old.append(path)
    return back, tuple(back.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31)))).first())


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Hang the neighbours of each node on the smallest of it and them: the smaller neighbours, or the larger ones."""
    if small:
        sides = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    else:
        sides = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = sides.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    joined = sides.join(least, "u")
    if small:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
    else:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where("u != v").groupBy("u", "v").agg(F.lit(1).alias("_")).select("u", "v")


def components(links: DataFrame) -> DataFrame:
    """node, root (the smallest node that links lead to) for every node of links (u, v), of integer type.

    Each round is written to the shared folder; rounds grow with the logarithm of the longest chain.
    Self links and repeated links are fine. No link: empty result.
    """
    spark, old = links.sparkSession, []
    edges, mark = _kept(links.where("u != v").select("u", "v").distinct(), old)
    while mark[0]:
        large, _ = _kept(_star(edges, False), old)
        edges, now = _kept(_star(large, True), old)
        if now == mark:
            break
        mark = now
        for path in old[:-1]:
            drop_path(spark, path)
        del old[:-1]
    roots = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    return roots.unionAll(roots.select(F.col("root").alias("node"), "root").distinct())
