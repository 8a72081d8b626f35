"""Connected components of an edge table by alternating large and small stars, wholly on DataFrames."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import staged


def min_labels(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """The smallest reachable index of each of n nodes under links a-b, by hooking and pointer jumping."""
    label = np.arange(n) if label is None else label
    while True:
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            return label
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        low, high = np.minimum(la, lb), np.maximum(la, lb)
        np.minimum.at(label, high, low)
        while not np.array_equal(nxt := label[label], label):
            label = nxt


def _contract(batches):
    """Links of one partition, replaced by a star around the smallest node of each part that they join."""
    got = [b for b in batches if b.num_rows]
    if got:
        t = pa.Table.from_batches(got)
        u, v = t["u"].to_numpy(), t["v"].to_numpy()
        nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        label = min_labels(len(nodes), at[: len(u)], at[len(u) :])
        moved = label != np.arange(len(nodes))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[label[moved]]), pa.array(nodes[moved])], names=["u", "v"])


def components(edges: DataFrame, tag: str = "components", rounds: int = 50) -> DataFrame:
    """(node, root): the smallest node reachable, for every node of edges (u long, v long).

    Each partition first contracts its own links. Then large-star and small-star steps alternate until the table is a
    set of stars. Minima are pre-aggregated, so a hub's links are joined by a split (skew) join but never gathered.
    The rounds needed grow with the logarithm of the longest chain; should `rounds` not do, a RuntimeError is raised
    rather than a part of the result given. Nodes without links don't appear. Links with a null end and self-links are ignored; an empty table gives none.
    """
    both = edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u is not null and v is not null and u <> v")
    e = staged(both.mapInArrow(_contract, "u long, v long").distinct(), tag)
    was = None
    for _ in range(rounds):
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == was or not now[0]:
            return e.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(e.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())
        was = now
        sym = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = sym.where("v > u").join(low, "u").where("v <> m").select(F.col("m").alias("u"), "v").distinct()
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v").select(F.explode(F.array(F.struct(F.col("m").alias("u"), "v"), F.struct(F.col("m").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
        e = staged(small.where("u <> v").distinct(), tag)
    raise RuntimeError(f"components did not settle in {rounds} rounds")
