"""Connected components of a link table, in rounds of small-star and large-star.

Each task first ties what its own links connect, so that rounds see stars: few
links, and of a node few in a task. A round deals the links by node once for
small-star and once to look whether stars are all there is; only then is there a
large-star, which joins the few nodes that are both centre and ray. In no step a
node's smallest neighbour grows, and while there is more than stars one becomes
smaller or links become fewer, so that rounds end. What a step gives is written
to the shared folder, which also cuts the lineage.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.llm.common import released, written

#: Links that a task ties at once.
TIED = 1 << 18


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b); the root is the component's smallest node.

    Links of a node to itself and repeated links do no harm; an empty table gives an empty one.
    """
    ends = [F.col(c).cast("long").alias(c) for c in ("a", "b")]
    links = written(_tied(written(links.where("a <> b").select(*ends))))  # a task needn't run Python twice at once, for these and for what gives them
    while True:
        links = written(_small_star(_tied(links)))
        nodes = written(_nodes(links))
        inner = nodes.where("m is not null and (m < last or centre)")
        if inner.isEmpty():
            return nodes.select("node", F.coalesce("m", "node").alias("root"))
        links = written(_large_star(links, written(inner.select("node", "m"))))


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of each node to the smallest one that the links (a, b) connect it with, but for that node's own."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while len(a):
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))  # a and b are roots here
        while not np.array_equal(further := root[root], root):
            root = further
        a, b = root[a], root[b]
        a, b = a[a != b], b[a != b]
    ray = root < np.arange(len(nodes))
    return nodes[ray], nodes[root[ray]]


def _tied(links: DataFrame) -> DataFrame:
    """Links (a, b), a > b, that connect what ``links`` connect: of each task's, ``TIED`` at a time, stars around smallest nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def out():
            a, b = stars(*(np.concatenate([h[i] for h in held]) for i in (0, 1)))
            return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            held.append(tuple(c.to_numpy() for c in batch.columns))
            n += batch.num_rows
            if n >= TIED:
                yield out()
                held, n = [], 0
        if n:
            yield out()
        held = []
        released()

    return links.mapInArrow(run, "a long, b long")


def _small_star(links: DataFrame) -> DataFrame:
    """Each node's smaller neighbours, and itself, link to its smallest one; a node has no more neighbours here than tasks, and their shares, have tied it."""
    moved = links.withColumn("m", F.min("b").over(Window.partitionBy("a")))
    return moved.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))


def _nodes(links: DataFrame) -> DataFrame:
    """(node, m, last, centre): each node's smallest and largest one of its smaller neighbours, null if it has none, and whether it has larger ones."""
    none = F.lit(None).cast("long")
    rays = links.select(F.col("a").alias("node"), F.col("b").alias("smaller"), F.lit(False).alias("larger"))
    both = rays.union(links.select(F.col("b").alias("node"), none.alias("smaller"), F.lit(True).alias("larger")))
    return both.groupBy("node").agg(F.min("smaller").alias("m"), F.max("smaller").alias("last"), F.max("larger").alias("centre"))


def _large_star(links: DataFrame, inner: DataFrame) -> DataFrame:
    """Links to a node of ``inner`` (node, m), a written table, go to its smallest neighbour, and so does a link of its own."""
    moved = links.join(inner, links["b"] == inner["node"], "left").select("a", F.coalesce("m", "b").alias("b"))
    return moved.union(inner.select(F.col("node").alias("a"), F.col("m").alias("b")))
