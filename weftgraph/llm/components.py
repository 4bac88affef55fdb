"""Connected components of a table of links, by spanning forests and alternating stars."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm import _common as C

#: So many links, 16 bytes each, are solved by one task; more by rounds over all of them.
FEW_LINKS = 1_000_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node that it is connected with) for all nodes of the links a, b but the smallest ones."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    least = np.arange(len(nodes))
    while True:
        low = np.minimum(least[i], least[j])
        after = least.copy()
        for end in (i, j):
            np.minimum.at(after, end, low)
            np.minimum.at(after, least[end], low)
        after = after[after]
        if (after == least).all():
            break
        least = after
    off = least != np.arange(len(nodes))
    return nodes[off], nodes[least[off]]


def _columns(batch) -> tuple[np.ndarray, np.ndarray]:
    return tuple(batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("u", "v"))


def _forests(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in forest(*_columns(batch))], ["u", "v"])


def _solved(batches):
    parts = [_columns(batch) for batch in batches]
    if parts:
        node, root = forest(*(np.concatenate(x) for x in zip(*parts)))
        roots = np.unique(root)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((node, roots))), pa.array(np.concatenate((root, roots)))], ["node", "component"])


def connected(links: DataFrame, few: int = FEW_LINKS) -> DataFrame:
    """node, component (the smallest node that links lead to), for nodes that have links.

    links: a, b (long). Rows with a null, loops and repeated rows are allowed. Each task first cuts its links to spanning
    forests. If no more than ``few`` are left, one task joins them; else each round joins every node with the least of its
    neighbours, first for larger, then for smaller ones; the number of rounds grows with the logarithm of the longest
    path, and each is written to the checkpoint folder.
    """
    pairs = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v")
    pairs = pairs.filter(F.col("u").isNotNull())
    edges = C.checkpointed(pairs.mapInArrow(_forests, "u long, v long"))
    if edges.count() <= few:
        return edges.coalesce(1).mapInArrow(_solved, "node long, component long")
    edges, mark = edges.distinct(), None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        below = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(below, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(below.select("u", F.col("m").alias("v"))).distinct()
        edges = C.checkpointed(small)
        found = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if found == mark:
            break
        mark = found
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
