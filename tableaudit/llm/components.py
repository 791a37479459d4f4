"""Connected components of very large link tables, by rounds of large-star and small-star.

Each round points every vertex at the smallest vertex it can see, first among its larger neighbours, then among its
smaller ones; the number of rounds grows with the logarithm of a component's size. A vertex with very many neighbours
costs one minimum per task and a join that adaptive execution splits, for which the minima are written first; no
neighbourhood is gathered in one place. Every round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep


def _both(edges: DataFrame) -> DataFrame:
    return edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _smallest(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    near = _both(edges)
    return near.filter("v > u").join(keep(_smallest(near)), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """``edges`` point from the larger to the smaller vertex."""
    edges = keep(edges)
    least = keep(_smallest(edges))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """(vertex, root) for every vertex of the links in the first two columns; root is the smallest vertex reached.

    Vertices are whole numbers; links to oneself and repeated links do no harm, links with a null are left out.
    """
    a, b = edges.columns[:2]
    links = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    links = keep(links.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") > F.col("v"))).distinct())
    state = None
    while True:
        row = links.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")
        ).first()
        if (row["n"], row["s"]) == state or not row["n"]:
            return links.select(F.col("u").alias("vertex"), F.col("v").alias("root")).union(
                links.select(F.col("v").alias("vertex"), F.col("v").alias("root")).distinct()
            )
        state = (row["n"], row["s"])
        links = keep(_small_star(_large_star(links)).filter("u > v").distinct())
