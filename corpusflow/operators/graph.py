"""Connected components of a link table, without collecting links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import Scope, durable


def components(links: DataFrame, seed: int = 3) -> DataFrame:
    """links: (a long, b long), any direction, repeats and self-links allowed.
    Returns (node, component): each node of a proper link with the smallest
    node that it can reach.

    Every round each node takes the first of itself and its neighbours in a
    seeded order of that round, pointers are followed once, links are redrawn
    between the pointers and those within one are dropped.  In such an order
    only every third node of a chain is first among its neighbours, so links
    shrink to a fraction in each round, of a chain in the order of its numbers
    too, and stars vanish at once.  The tables of a
    round go once the next one's are there."""
    with Scope(links.sparkSession) as own:
        return _contracted(links, seed, own)


def _contracted(links: DataFrame, seed: int, own: Scope) -> DataFrame:
    both = links.where(F.col("a") != F.col("b")).select("a", "b")
    open_ = durable(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    known = None
    while not open_.isEmpty():
        seed += 1

        def placed(c: str, seed: int = seed) -> Column:
            return F.struct(F.xxhash64(F.lit(seed), c).alias("h"), F.col(c).alias("id"))

        # a table of its own: joins of tables that are only shuffled can part a hub's rows
        first = open_.groupBy("a").agg(F.min(placed("b")).alias("m"))
        up = durable(first.select(F.col("a").alias("v"), F.least(F.col("m"), placed("a"))["id"].alias("p")), "firsts")
        jump = up.select(F.col("v").alias("p"), F.col("p").alias("q"))
        up = durable(up.join(jump, "p", "left").select("v", F.coalesce("q", "p").alias("p")), "pointers")
        if known is None:
            known = up.select(F.col("v").alias("node"), F.col("p").alias("component"))
        else:
            step = up.select(F.col("v").alias("component"), F.col("p").alias("next"))
            known = durable(known.join(step, "component", "left").select("node", F.coalesce("next", "component").alias("component")), "components")
        pa_, pb = up.select(F.col("v").alias("a"), F.col("p").alias("x")), up.select(F.col("v").alias("b"), F.col("p").alias("y"))
        drawn = open_.join(pa_, "a").join(pb, "b").where(F.col("x") != F.col("y")).select(F.col("x").alias("a"), F.col("y").alias("b"))
        open_ = durable(drawn.distinct(), "links")
        own.clear(open_, known)
    if known is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("component")).limit(0)
    least = known.groupBy("component").agg(F.min("node").alias("least"))
    out = durable(known.join(least, "component").select("node", F.col("least").alias("component")), "components")
    own.clear(out)
    return out
