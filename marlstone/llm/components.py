"""Connected components by alternating large-star and small-star on a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, join_groups, release


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One large-star or small-star step on distinct links (u, v), u > v, which are deleted.

    large: every larger neighbour of a node is linked to the least of the node's neighbours and itself.
    small: the node and its smaller neighbours are linked to the least of these.
    The node with its least neighbour goes to its links by join_groups, so a hub is spread over all tasks.
    """
    both = links.select("u", "v")
    if large:
        both = both.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = cut(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("m", "u")))
    met = join_groups(both, least, ["u"], "n")
    if large:
        new = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        own = least.select("u", F.col("m").alias("v"))
        new = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(own)
    out = cut(new.where("u > v").distinct())
    release(least, links)
    return out


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component) of every id that has a link; component is the least id that can be reached.

    links: (a, b) of any type that has an order, repeats and loops allowed; null ends are left out. Stops when every id is linked to one
    root that is linked to no other; after ``rounds`` rounds without that it raises, rather than give a part.
    """
    ordered = links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    now = cut(ordered.distinct())
    for _ in range(rounds):
        ends = now.select(F.col("u").alias("id"), F.lit(1).alias("up")).unionByName(now.select(F.col("v").alias("id"), F.lit(0).alias("up")))
        open_ = ends.groupBy("id").agg(F.sum("up").alias("ups"), F.min("up").alias("root")).where("ups > 1 or (ups = 1 and root = 0)")
        if open_.isEmpty():
            roots = now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
            return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
        now = _star(_star(now, True), False)
    raise RuntimeError("components did not settle")
