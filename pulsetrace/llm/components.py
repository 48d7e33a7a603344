"""Connected components of an edge table, by alternating large and small stars.

No group is gathered: every step is a grouped minimum (combined before the shuffle) and
an equi-join that adaptive execution may split. Each round is written to the shared folder.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest reachable node) over all nodes of the edges a-b, with numpy only."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = flat[: len(a)], flat[len(a):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, label[left], low)
        np.minimum.at(new, label[right], low)
        new = new[new]
        if np.array_equal(new, label):
            return nodes, nodes[label]
        label = new


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars in place of a task's edges, batch by batch: same components, fewer rounds."""
    for batch in batches:
        a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        node, root = roots(a, b)
        far = node != root
        yield pa.RecordBatch.from_arrays([pa.array(node[far]), pa.array(root[far])], ["u", "v"])


def components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(node, component) for every node of ``edges`` (two long columns); component = smallest node.

    Self-loops and repeated edges are allowed. Nodes that no edge names are not returned.
    """
    a, b = edges.columns
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    loops = pairs.where("u = v")
    stars = written(pairs.where("u <> v").mapInArrow(_contract, "u long, v long").distinct(), "stars")
    alone = loops.select(F.col("u").alias("node"), F.col("u").alias("component"))
    state = None
    for _ in range(max_rounds):
        new_state = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new_state == state:
            break
        state = new_state
        both = stars.union(stars.select("v", "u"))
        # Large star: neighbours above a node move to the smallest node it sees.
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Small star: a node and those below it move to the smallest of them.
        large = written(large.where("u <> v").distinct(), "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = moved.union(low.select("u", "m")).where("u <> v")
        stars = written(small.distinct(), "stars")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    found = stars.select(F.col("u").alias("node"), F.col("v").alias("component"))
    heads = stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    known = found.union(heads)
    return known.union(alone.join(known, "node", "left_anti").distinct())
