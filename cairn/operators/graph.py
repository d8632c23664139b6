"""Connected components of an edge table, by alternating stars.

Large star: every node's larger neighbours move to its least one; small star: every
node and its smaller neighbours move to the least of them. Both need one minimum a
node, so that a node with very many neighbours is one row a task before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.session import cut, parts


def _settled(stars: DataFrame) -> bool:
    """Whether every node has one parent and no parent has one: all edges are then final."""
    child = stars.groupBy("u").agg(F.count("*").alias("n"))
    again = child.where("n > 1").select("u").unionByName(stars.select("v").distinct().join(child, F.col("v") == F.col("u"), "left_semi").select(F.col("v").alias("u")))
    return not again.take(1)


def _least_reachable(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The least node of the component of each node 0 .. n - 1."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[u], label[v])
        np.minimum.at(label, label[u], low)
        np.minimum.at(label, label[v], low)
        while not np.array_equal(label, label[label]):
            label = label[label]
        if np.array_equal(before, label):
            return label


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of each batch as stars: every node beside the least node that it reaches within the batch."""
    for b in batches:
        u, v = b.column("u").to_numpy(), b.column("v").to_numpy()
        nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        least = nodes[_least_reachable(at[: len(u)], at[len(u) :], len(nodes))]
        far = least < nodes
        yield pa.RecordBatch.from_pydict({"u": pa.array(nodes[far], pa.int64()), "v": pa.array(least[far], pa.int64())})


def contracted(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (u, v long) as stars within batches of neighbouring nodes, and what links these stars (u > v).

    Each node of a star keeps its least centre; centres that a node shares are linked to
    that, so that chains of nodes in order shrink to an edge a batch.
    """
    dealt = edges.repartitionByRange(parts(edges.sparkSession), "v").sortWithinPartitions("v")
    stars = cut(dealt.mapInArrow(_stars, "u long, v long").distinct(), "stars")
    least = cut(stars.groupBy("u").agg(F.min("v").alias("v"), F.max("v").alias("most"), F.count("*").alias("n")), "least")
    one = least.where("n > 1").select("u", F.col("v").alias("m"))
    links = stars.join(one, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    # a centre that is also a node of another star is linked to that one's centre
    chained = least.join(stars.select("v").distinct().withColumnRenamed("v", "u"), "u", "left_semi").select("u", "v")
    return least.select("u", "v"), links.unionByName(chained)


def components(edges: DataFrame, a: str = "a", b: str = "b", most: int = 60, in_order: bool = False) -> DataFrame:
    """node, comp for every node of an edge; comp is the least node reachable.

    in_order is for whole numbers of which neighbours are mostly linked: these edges are
    contracted within batches first, and only what links the batches goes through rounds.
    """
    if not in_order:
        return _by_stars(edges, a, b, most)
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v")
    star, links = contracted(pairs)
    # whole components of the stars' centres, then of the nodes beside them
    centres = cut(_by_stars(links, "u", "v", most).withColumnsRenamed({"node": "v", "comp": "c"}), "centres")
    told = star.join(centres, "v", "left").select(F.col("u").alias("node"), F.coalesce("c", "v").alias("comp"))
    own = star.select("v").unionByName(centres.select("v")).distinct().join(star.select("u"), F.col("v") == F.col("u"), "left_anti").join(centres, "v", "left")
    return told.unionByName(own.select(F.col("v").alias("node"), F.coalesce("c", "v").alias("comp")))


def _by_stars(edges: DataFrame, a: str, b: str, most: int) -> DataFrame:
    """node, comp for every node of an edge; comp is the least node reachable."""
    now = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    for _ in range(most):
        if _settled(now):
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # a table of its own: the join with a node's many neighbours can then be split
        least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        grown = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        grown = cut(grown, "large_star")
        least = grown.groupBy("u").agg(F.min("v").alias("m"))
        moved = grown.join(least, "u").select(F.when(F.col("v") > F.col("m"), F.col("v")).otherwise(F.col("u")).alias("u"), F.col("m").alias("v"))
        now = cut(moved.distinct(), "small_star")
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    own = now.groupBy("v").agg(F.count("*").alias("n")).select(F.col("v").alias("node"), F.col("v").alias("comp"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(own)
