"""Connected components of a link table by alternating large-star and small-star rounds.

Both kinds of round are grouped minima followed by a join, so the work per round is linear in the
links and a hub's links are never gathered in one task (minima combine map-side; AQE splits the
join). The number of rounds grows with the logarithm of the longest chain.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, materialize


def local_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star-shaped links (node, smallest node) with the same components as the links a-b."""
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inverse[: len(a)], inverse[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        before = label.copy()
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        label = label[label]
        if np.array_equal(label, before):
            break
    keep = label != np.arange(len(nodes))
    return nodes[keep], nodes[label[keep]]


def _contract(batches):
    """Each task replaces its links by stars, a bounded number at a time."""
    held: list = []
    size = 0
    for batch in batches:
        held.append((batch.column("a").to_numpy(), batch.column("b").to_numpy()))
        size += batch.num_rows
        if size >= 1_000_000:
            a, b = local_forest(*map(np.concatenate, zip(*held)))
            held, size = [(a, b)], len(a)
            if size >= 500_000:
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
                held, size = [], 0
    if size:
        a, b = local_forest(*map(np.concatenate, zip(*held)))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def contract(links: DataFrame) -> DataFrame:
    return links.mapInArrow(_contract, "a long, b long")


def _round(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("low"))
    large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
    down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("low"))
    small = down.join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b")
    return small.union(least.select("a", F.col("low").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(a, b) links -> (node, root): the smallest node reachable, for every node that has a link, roots
    themselves included.

    Self links and repeated links are allowed and ignored; an empty table gives an empty one. Nulls
    must be removed before.
    """
    now = materialize(contract(links.where("a <> b").select("a", "b")), "links")
    sign = None
    while True:
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b") % 1_000_003).alias("h"), F.sum((F.col("a") < F.col("b")).cast("int")).alias("up")).first()
        if state["n"] == 0 or (sign == (state["n"], state["h"]) and state["up"] == 0):
            # Links end at their root, so a root has no row among them yet.
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
        sign = (state["n"], state["h"])
        after = materialize(_round(now), "links")
        drop_table(now)
        now = after
