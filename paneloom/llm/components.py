"""Connected components by alternating large-star and small-star steps, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paneloom.operators.spread import settle

#: Links up to which a step's minima are broadcast: a MB or two.
BROADCAST_LINKS = 20_000


def _state(links: DataFrame) -> tuple:
    """A fingerprint of the set of links: it stops changing when every component is a star."""
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())


def _distinct(links: DataFrame) -> DataFrame:
    return settle(links.where("hi > lo").distinct())


def _minima(nodes: DataFrame, small: bool) -> DataFrame:
    """Minima to be joined back: broadcast, or settled so that adaptive execution can split the shuffle."""
    return F.broadcast(nodes) if small else settle(nodes)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node that has a link to another one; ``root`` is the smallest node of its component.

    In a large-star step each node links its larger neighbours to its smallest neighbour; in a small-star step it links
    its smaller neighbours and itself to the smallest. Both shorten all paths at once, so few rounds are needed even
    for chains. A node's neighbours are never gathered: only their minimum is, in partial aggregates, and the join that
    brings it back is a broadcast below a known number of links and else a shuffle whose hot keys adaptive execution splits.
    """
    found = _distinct(links.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")))
    state = _state(found)
    while state[0]:
        both = found.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            found.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        small = state[0] <= BROADCAST_LINKS  # there are at most twice as many nodes
        nearest = _minima(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), small)
        large = _distinct(both.where("v > u").join(nearest, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")))
        lowest = _minima(large.groupBy("hi").agg(F.min("lo").alias("m")), small)
        moved = large.join(lowest, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        found = _distinct(moved.unionByName(lowest.select("hi", F.col("m").alias("lo"))))
        before, state = state, _state(found)
        if state == before:
            break
    return found.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(
        found.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct()
    )
