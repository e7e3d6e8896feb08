"""Connected components of a link table by alternating large-star and small-star steps.

A node may hold a great share of all links, and the steps make stars of whole components on purpose.
So nothing is gathered by node: least neighbours are found in two levels (a node's links are first
spread over ``SPREAD`` parts), and links are joined to them by ``hot_split_join``, which broadcasts
the few nodes that hold at least one link in a thousand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_split_join, write_shared

#: parts that the links of one node are spread over before they meet
SPREAD = 64


def least_by(rows: DataFrame, key: str, value: str, spread: str) -> DataFrame:
    """(key, m, n): least ``value`` and number of rows of each key, in two levels, so that a key with a third
    of all rows meets as at most SPREAD rows. ``spread`` is the column that deals the first level."""
    part = F.pmod(F.xxhash64(spread, F.lit(3)), F.lit(SPREAD))
    first = rows.groupBy(key, part.alias("_part")).agg(F.min(value).alias("m"), F.count("*").alias("n"))
    return first.groupBy(key).agg(F.min("m").alias("m"), F.sum("n").alias("n"))


def _joined(links: DataFrame, low: DataFrame, total: int) -> DataFrame:
    """``links`` with m, the least neighbour of a."""
    low = write_shared(low, "low")
    return hot_split_join(links, low.select("a", "m"), "a", low.select("a", "n"), total)


def _large_star(e: DataFrame, total: int) -> DataFrame:
    """Every link (a, b) with b > a becomes (b, least of a and its neighbours)."""
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = least_by(both.withColumn("v", F.least("a", "b")), "a", "v", "b")
    return _joined(both.filter("b > a"), low, 2 * total).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(e: DataFrame, total: int) -> DataFrame:
    """Links go down (a > b); all smaller neighbours of a node, and the node, meet at the least of them."""
    low = least_by(e, "a", "b", "b")
    links = _joined(e, low, total)
    # a node's own link to its least neighbour is the row with b = m, so it needs no union
    return links.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).distinct()


def components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node that has a link; root is the smallest node of its component.

    Each step writes its links to the shared folder, so lineage stays one step long; only a few
    numbers per round reach the driver. An empty table gives an empty table; loops, repeated links and
    nulls are dropped.
    """
    e = (
        edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b"))
        .filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    e = write_shared(e, "links")
    state = F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    before = tuple(e.agg(*state).first())
    for _ in range(max_rounds if before[0] else 0):
        e = write_shared(_large_star(e, before[0]), "links")
        e = write_shared(_small_star(e, e.count()), "links")
        now = tuple(e.agg(*state).first())
        if now == before:
            break
        before = now
    else:
        if before[0]:
            raise RuntimeError("components: no fixed point within max_rounds")
    roots = e.select(F.col("b").alias("node")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))
