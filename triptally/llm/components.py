"""Connected components of links between records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triptally.llm.tables import Steps


HOT = 1000  # a node with more than the links divided by this is hot
FEW = 10_000  # nor is a node with no more links than this


def _at(edges: DataFrame, end: str, nodes: DataFrame, limit: int) -> DataFrame:
    """(a, b, m) of each link, with m of the node (n, m, links) at one end; all ends are among the
    nodes. Few can have more than `limit` links, so these hot ones are broadcast and only links of others
    meet by a shuffle."""
    hot = nodes.where(F.col("links") > limit).select(F.col("n").alias("hot"), F.col("m").alias("top"))
    told = edges.join(F.broadcast(hot), F.col(end) == F.col("hot"), "left")
    rest = nodes.where(F.col("links") <= limit).select("n", "m")  # the same shuffle serves both
    cold = told.where("hot is null").join(rest, F.col(end) == F.col("n"))
    near = told.where("hot is not null").select("a", "b", F.col("top").alias("m"))
    return near.unionByName(cold.select("a", "b", "m"))


def components(links: DataFrame, steps: Steps, name: str) -> DataFrame:
    """(node, comp) for every node of `links(a, b)`; comp is the smallest node of its component.

    Every round links each node and its neighbours to the smallest of them, once over the larger
    and once over the smaller neighbours, until nothing changes; long chains halve in each round.
    Only sums and minima are taken per node, so a node with very many links is combined on the map
    side; nodes that hold more than a thousandth of the links, fewer than HOT * 2 by their sum, are
    looked up by a broadcast, so no task gets all links of a centre. Each round reads what the last one
    has written.
    """
    spark = links.sparkSession
    ends = links.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    ).distinct()
    edges, round_no = steps.keep(ends, f"{name}-0"), 0
    while True:
        # Larger neighbours and the node itself go to the smallest neighbour.
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("links")).select(
            F.col("a").alias("n"), F.least("a", "m").alias("m"), "links"
        )
        limit = max(edges.count() // HOT, FEW)
        large = _at(edges, "b", least, limit).select("a", F.col("m").alias("b")).where("a <> b")
        large = large.distinct()
        # Smaller neighbours and the node itself go to the smallest of them.
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("links"))
        small = (
            _at(large, "a", low.withColumnRenamed("a", "n"), limit)
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .where("a <> b")
            .unionByName(low.select("a", F.col("m").alias("b")))
            .distinct()
        )
        round_no += 1
        after = steps.keep(small, f"{name}-{round_no}")
        # Done once every node has one link and no node is both a member and a centre.
        centres = after.select(F.col("b").alias("x")).distinct()
        bad = after.groupBy("a").count().where("count > 1").select("a").limit(1).count()
        bad = bad or after.join(centres, F.col("a") == F.col("x"), "left_semi").limit(1).count()
        steps.drop(f"{name}-{round_no - 1}")
        edges = after
        if not bad:
            break
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct()
    return stars.unionByName(roots) if spark else stars
