"""Connected components of a table of links, by alternating stars.

Each round points every node's larger neighbours at its smallest one (large
star), then its smaller neighbours at the smallest of them (small star); both
keep connectivity, and a number of rounds logarithmic in the number of nodes
leaves a star around each component's smallest node (Kiveris et al. 2014).
Minima are aggregated before they are shuffled, and joined back by the node. In
a round with nodes of more neighbours than ``heavy_links`` (at most ``MOST_HEAVY``
of them, since each takes that share of all links) theirs are joined by a
broadcast instead, so that a hub's links stay where they are; a large star gives
no node more smaller neighbours than it had, so other rounds have no hub in
either star. Every round is a written
table in the shared folder; each round that is not the last shortens some path,
so the rounds end by themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corrobora.llm.durable import forget, materialize

#: Bounds the broadcast: no more nodes than this can be heavy. A node of up to FEW_LINKS neighbours never is.
MOST_HEAVY, FEW_LINKS = 50_000, 500


def heavy_links(links: int) -> int:
    """Neighbours beyond which a node is heavy: twice ``links`` ends, dealt to ``MOST_HEAVY`` nodes."""
    return max(FEW_LINKS, 2 * links // MOST_HEAVY)


def _star(edges: DataFrame, large: bool, heavy: int | None) -> DataFrame:
    """edges: (u, v) with u > v. Large: from all neighbours; small: from the smaller ones. Nodes with more than ``heavy`` neighbours are hubs, if it is given."""
    both = edges.union(edges.select("v", "u")).toDF("u", "v") if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    least = least.select("u", F.least("u", "m").alias("m"), "n")
    if heavy is None:
        joined = both.join(least.select("u", "m"), "u")
    else:
        hubs = F.broadcast(least.where(F.col("n") > heavy).select("u", "m"))  # at most MOST_HEAVY rows
        joined = both.join(hubs, "u").union(both.join(hubs, "u", "left_anti").join(least.where(F.col("n") <= heavy).select("u", "m").hint("merge"), "u"))
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def _state(edges: DataFrame) -> tuple[int, int, int]:
    """Nodes that keep the links from being stars, the number of links and the largest number of neighbours. Stars: each upper end has one link and no lower end is an upper one."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up")).union(edges.select("v", F.lit(0)))
    each = ends.groupBy("x").agg(F.sum("up").alias("up"), F.count("*").alias("n"))
    row = each.agg(F.count_if((F.col("up") > 1) | ((F.col("up") == 1) & (F.col("n") > 1))).alias("odd"), F.sum("up").alias("links"), F.max("n").alias("most")).first()
    return row["odd"], row["links"] or 0, row["most"] or 0


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (columns a, b, longs); root is its component's smallest node."""
    edges = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while True:
        odd, n, most = _state(edges)
        if not odd:
            break
        heavy = heavy_links(2 * n) if most > heavy_links(2 * n) else None  # a large star may have as many links again
        older, edges = edges, materialize(_star(_star(edges, True, heavy), False, heavy), "edges")
        forget(older)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())
