"""Connected components: edges are contracted range by range, and what joins ranges is a smaller graph of the same kind.

A graph that ranges don't shrink is settled by minimum labels with pointer jumping; lineage is cut every round in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.session import save


def star_edges(pdf: pd.DataFrame) -> pd.DataFrame:
    """Edges (a, b) that join the same nodes, as stars: each node to the first node of its component."""
    ids, names = pd.factorize(np.concatenate([pdf["a"].to_numpy(), pdf["b"].to_numpy()]), sort=True)
    a, b, root = ids[: len(pdf)], ids[len(pdf) :], np.arange(len(names))
    while (root[a] != root[b]).any():
        np.minimum.at(root, np.maximum(root[a], root[b]), np.minimum(root[a], root[b]))
        while (root != root[root]).any():
            root = root[root]
    far = np.flatnonzero(root != np.arange(len(names)))
    return pd.DataFrame({"a": names[root[far]], "b": names[far]})


def contracted(edges: DataFrame) -> DataFrame:
    """Edges with the same components and shorter paths: every Arrow batch of edges becomes its stars, at most one edge a node."""
    edges = edges.select("a", "b").filter("a <> b")
    return edges.mapInPandas(lambda batches: (star_edges(pdf) for pdf in batches), edges.schema)


def _pieces(batches: Iterator[pd.DataFrame], most: int = 1 << 19) -> Iterator[pd.DataFrame]:
    """Stars of a partition's edges, for at most so many edges at once; each root has an edge to itself, too."""

    def stars(held: list[pd.DataFrame]) -> pd.DataFrame:
        out = star_edges(pd.concat(held, ignore_index=True))
        roots = out["a"].drop_duplicates()
        return pd.concat([out, pd.DataFrame({"a": roots, "b": roots})], ignore_index=True)

    held: list[pd.DataFrame] = []
    for pdf in batches:
        held.append(pdf)
        if sum(map(len, held)) >= most:
            yield stars(held)
            held = []
    if held:
        yield stars(held)


def connected_components(nodes: DataFrame, edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable over undirected edges (a, b). Nodes without edges stand alone.

    Ranges of edges by their smaller node are contracted to stars. A node with roots in several ranges joins these: such edges
    between roots are the next graph, as long as it has at most half as many edges. So the whole table is passed once or twice
    where neighbours have keys near each other, however long a component is.
    """
    pairs = save(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    stars = save(pairs.repartitionByRange("a").mapInPandas(_pieces, pairs.schema))
    home = save(stars.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root"), F.collect_set("a").alias("roots")))
    across = home.filter(F.size("roots") > 1).select(F.col("root").alias("a"), F.explode("roots").alias("b")).filter("a <> b").distinct()
    across = save(across)
    found = home.select("node", "root")
    if n := across.count():
        ends = across.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        settle = connected_components if 2 * n <= stars.count() else _by_rounds
        label = settle(ends, across, rounds).select(F.col("node").alias("root"), F.col("component").alias("least"))
        found = found.join(label, "root", "left").select("node", F.coalesce("least", "root").alias("root"))
    found = found.withColumnRenamed("node", "b")
    return save(nodes.join(found, nodes["node"] == found["b"], "left").select("node", F.coalesce("root", "node").alias("component")))


def _by_rounds(nodes: DataFrame, edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable over undirected edges (a, b). Nodes without edges stand alone.

    Edges are contracted batch by batch first, so rounds follow the number of batches that a component spans, not its length.
    """
    both = save(contracted(edges).select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b").distinct())
    label = save(nodes.select("node", F.col("node").alias("component")))
    for _ in range(rounds):
        near = both.join(label, both["b"] == label["node"]).groupBy("a").agg(F.min("component").alias("m"))
        new = label.join(near, label["node"] == near["a"], "left").select("node", F.least("component", F.coalesce("m", "component")).alias("component"), F.col("component").alias("old"))
        new = save(new)
        if new.filter("component <> old").isEmpty():
            return new.select("node", "component")
        jump = new.select(F.col("node").alias("j"), F.col("component").alias("k"))
        label = save(new.join(jump, new["component"] == jump["j"]).select("node", F.col("k").alias("component")))
    raise RuntimeError("components did not settle")
