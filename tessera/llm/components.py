"""Connected components of a table of links, by alternating large-star and small-star rounds.

Each round is a few groupBys and equi-joins on node ids; its result is written to the shared folder, so the lineage
stays one round long and a lost executor repeats at most one step. The number of rounds grows with the logarithm of
the longest path; they end where the links are stars around smallest nodes. Nothing but a count a round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import written as cut


def _toward_minimum(both: DataFrame) -> tuple[DataFrame, DataFrame]:
    """both: (u, v). Returns both and, for each u, m = the smallest of u and its v. m is cut: joined back, its
    exchange is then the join's own, so that adaptive execution may split a hub's rows."""
    return both, cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))


def _stars(state: DataFrame) -> bool:
    """Whether each u has one v and no v is a u: then v names u's component. One aggregation, which combines on the map side."""
    ends = state.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(state.select(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    ends = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return ends.agg(F.count(F.when((F.col("out") > 1) | ((F.col("out") > 0) & (F.col("into") > 0)), 1))).first()[0] == 0


def connected_components(links: DataFrame) -> DataFrame:
    """links: columns u, v (long). Returns node, component (the smallest node reachable), for every linked node. Rows with
    a null u or v and links of a node to itself link nothing; repeated links count once; no links give no rows."""
    state = cut(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while not _stars(state):
        both, least = _toward_minimum(state.select("u", "v").unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.where("m < u").select("u", F.col("m").alias("v")))
        large = cut(large.distinct())
        down, least = _toward_minimum(large)
        small = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        state = cut(small.where("u <> v").distinct())
    star = state.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return star.unionByName(state.select(F.col("v").alias("node"), F.col("v").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))
