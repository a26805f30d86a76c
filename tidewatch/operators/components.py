"""Connected components of links, by local forests merged until they agree."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.plans.storage import stored

#: Links that one task joins into a forest; tasks that share the links of one node.
TASK_LINKS, SHARES = 1_000_000, 16


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node of the links and the least node that it reaches."""
    nodes, code = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = code[: len(a)], code[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, label[left], least)
        np.minimum.at(new, label[right], least)
        while True:  # pointer jumping
            jumped = new[new]
            if (jumped == new).all():
                break
            new = jumped
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a, b = [], []
    for batch in batches:
        a.append(batch.column(0).to_numpy())
        b.append(batch.column(1).to_numpy())
        if sum(map(len, a)) > 2 * TASK_LINKS:
            node, root = roots(np.concatenate(a), np.concatenate(b))
            a, b = [node], [root]
    if a:
        node, root = roots(np.concatenate(a), np.concatenate(b))
        for i in range(0, len(node), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(node[i : i + 100_000]), pa.array(root[i : i + 100_000])], ["node", "root"])


def connected_components(links: DataFrame, task_links: int = TASK_LINKS) -> DataFrame:
    """(node, root) of every node of `links` (two long columns); root is the least node reachable.

    Each task turns its share of the links into a forest. A node with roots in several tasks
    links those roots, and only these links go to the next round; one task's worth of links
    ends it. Links may repeat; rounds are written to the shared folder.
    """
    a, b = links.columns
    links = links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).filter("a is not null and b is not null")
    tasks = max(1, -(-links.count() // task_links))
    # a hub's links go to SHARES tasks, so that no node's links are one task's
    local = links.repartition(tasks, "a", F.pmod(F.xxhash64("b"), F.lit(SHARES))).mapInArrow(forest, "node long, root long")
    if tasks == 1:
        return stored(local, "components")
    local = stored(local, "forests")
    least = local.groupBy("node").agg(F.min("root").alias("root"))
    between = local.join(least.withColumnRenamed("root", "least"), "node").filter("root <> least").select("root", "least").distinct()
    between = stored(between, "root-links")
    if between.isEmpty():
        return stored(least, "components")
    top = connected_components(between, task_links).select(F.col("node").alias("root"), F.col("root").alias("top"))
    return stored(least.join(top, "root", "left").select("node", F.coalesce("top", "root").alias("root")), "components")
