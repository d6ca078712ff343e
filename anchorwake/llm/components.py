"""Connected components of a distributed table of links."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from anchorwake.llm.store import discard, stored

_PER_TASK = 200_000  # links that one task reads
_AT_ONCE = 1 << 20  # links that a task joins before it sends them on


def _both(links: DataFrame) -> DataFrame:
    return links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(links: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest node around it."""
    around = _both(links).withColumn("low", F.min("b").over(Window.partitionBy("a")))
    return around.where("b > a").select(F.col("b").alias("a"), F.least("a", "low").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """Link every node and its smaller neighbours to the smallest of them; ``links`` go from larger to smaller nodes."""
    around = Window.partitionBy("a").orderBy("b")
    each = links.withColumns({"low": F.first("b").over(around), "last": F.lag("b").over(around)})
    # The smallest neighbour's row becomes the link of the node itself; a repeated row is left out.
    return each.where("last IS NULL OR last <> b").select(F.when(F.col("b") == F.col("low"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("low").alias("b"))


def local_stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of every node with the smallest one of its component of these links."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, up = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        low, high = np.minimum(up[x], up[y]), np.maximum(up[x], up[y])
        apart = low != high
        if not apart.any():
            break
        np.minimum.at(up, high[apart], low[apart])
        while (up[up] != up).any():
            up = up[up]
    own = np.flatnonzero(up != np.arange(len(nodes)))
    return nodes[own], nodes[up[own]]


def _joined_here(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of a task as stars."""
    held, rows = [], 0

    def sent() -> pa.RecordBatch:
        a, b = (np.concatenate([x[i] for x in held]) for i in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in local_stars(a, b)], ["a", "b"])

    for part in parts:
        held.append([part.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)])
        rows += part.num_rows
        if rows >= _AT_ONCE:
            yield sent()
            held, rows = [], 0
    if held:
        yield sent()


def _settled(links: DataFrame) -> tuple[DataFrame, tuple]:
    """The links, stored, with their number and a sum of them that the write observes."""
    seen = Observation()
    table = stored(links.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")))
    return table, (seen.get["n"], seen.get["sum"])


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``links`` (``a, b``), the component being its smallest node.

    Links that a task holds are joined there. The rest are alternating large and small stars, with one
    shuffle each; the number of rounds grows with the logarithm of the size of the largest component,
    the tasks of a round with the number of links. Only sums of the links come to the driver.
    """
    kept = links.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b")
    links, state = _settled(kept.mapInArrow(_joined_here, "a long, b long"))
    before = None
    while state != before:
        tasks = max(1, math.ceil(state[0] / _PER_TASK))
        before, last = state, links
        links, state = _settled(_small_star(_large_star(links.coalesce(tasks)).coalesce(tasks)).coalesce(tasks))
        discard(last)
    low = links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(low)
