"""Connected components by alternating star steps, as DataFrame operations.

Each step hangs nodes directly below the smallest node they know. Only links go in, and only nodes that
have a link come out; nothing is collected. Every round is written to the checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tidemark.llm.common import checkpointed


#: Nodes with more than this part of all links are joined by broadcast; so there are fewer than twice this.
HOT_NODES = 200

#: With no more links than this, the smallest nodes of all neighbourhoods are broadcast (two longs for each node
#: that has a link); with more, those of hubs alone.
MOST_LINKS = 1_000_000


def _star(links: DataFrame, large: bool, count: int) -> DataFrame:
    """One star step over links ``a > b``: each neighbour (the larger ones, or the smaller ones and the
    node itself) is linked to the smallest node of the neighbourhood.

    Nodes with more than a part of the ``count`` links are a small table that is broadcast, so no task gets
    all links of one.
    """
    both = _either_way(links, ("a", "b"), ("b", "a")) if large else links
    smallest = F.least(F.min("b"), F.first("a")) if large else F.min("b")
    low = both.groupBy("a").agg(smallest.alias("low"), F.count("*").alias("n"))
    if count <= MOST_LINKS:
        hung = both.join(F.broadcast(low.drop("n")), "a")
    else:
        most = count // HOT_NODES
        hubs, others = F.broadcast(low.where(F.col("n") > most)), low.where(F.col("n") <= most)
        hung = both.join(hubs, "a").unionByName(both.join(hubs.select("a"), "a", "left_anti").join(others, "a"))
    hung = hung.where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")) if large else _either_way(hung, ("b", "low"), ("a", "low"))
    return hung.where("a > b").distinct()


def _either_way(rows: DataFrame, *ways: tuple[str, str]) -> DataFrame:
    """``a, b``: two columns of each row for each of the ways; the rows are read once."""
    links = F.array(*(F.struct(F.col(x).alias("a"), F.col(y).alias("b")) for x, y in ways))
    return rows.select(F.explode(links).alias("link")).select("link.*")


def _marked(links: DataFrame) -> tuple[DataFrame, tuple]:
    """The links, written, with their count and a sum of their hashes, which are taken as they are written."""
    seen = Observation()
    links = checkpointed(links.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("hashes")))
    return links, (seen.get.get("n") or 0, seen.get.get("hashes"))


def stars(links: DataFrame) -> tuple[DataFrame, int]:
    """``a, b`` from ``a, b`` links of long nodes: each node that can reach a smaller one, and the smallest
    that it can reach. And the number of these rows.

    Direction, repeats and links of a node to itself don't matter; no links give no rows.
    """
    edges, mark = _marked(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct())
    before = None
    while mark != before and mark[0]:
        before = mark
        edges, mark = _marked(_star(_star(edges, True, mark[0]), False, mark[0]))
    return edges, mark[0]


def components(links: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node reachable) for every node of ``a, b`` links of long nodes.

    Direction, repeats and links of a node to itself don't matter; no links give no rows.
    """
    edges, _ = stars(links)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
