"""Connected components of an undirected edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import IntegerType, LongType

from nimboscale.session import discard, stored

#: Edges that a task contracts at once.
HELD_EDGES = 1 << 19


def _smallest(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("_m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of u points to the smallest of u and its neighbours."""
    both = edges.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
    low = _smallest(both).select("u", F.least("u", "_m").alias("_m"))
    return both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("_m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """u and its smaller neighbours point to the smallest of them."""
    low = _smallest(edges)
    moved = edges.join(low, "u").select(F.col("v").alias("u"), F.col("_m").alias("v")).where("u > v")
    return moved.unionByName(low.select("u", F.col("_m").alias("v"))).distinct()


def _stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The edges (u, v) as stars: every node but the smallest of its component, and that smallest."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    root = np.arange(len(nodes))
    while len(a):
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
        a, b = root[a], root[b]
        a, b = a[a != b], b[a != b]
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def _contracted(edges: DataFrame, held: int) -> DataFrame:
    """Edges (u, v) of whole numbers with the same components, where every ``held`` edges or so that a task reads have become stars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.RecordBatch] = []

        def flush() -> pa.RecordBatch:
            ends = [np.concatenate([x.column(i).to_numpy() for x in parts]) for i in (0, 1)]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in _stars(*ends)], ["u", "v"])

        for batch in batches:
            parts.append(batch)
            if sum(x.num_rows for x in parts) >= held:
                yield flush()
                parts.clear()
        if parts:
            yield flush()

    return edges.mapInArrow(run, edges.schema)


def _settled(edges: DataFrame) -> bool:
    """Whether the edges are stars: every u has one edge and is no other's v."""
    roles = edges.select(F.inline(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("_out")), F.struct(F.col("v").alias("node"), F.lit(0).alias("_out")))))
    return roles.groupBy("node").agg(F.sum("_out").alias("_n"), F.min("_out").alias("_least")).where("_n > 1 OR (_n = 1 AND _least = 0)").isEmpty()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an edge; component is its smallest reachable node.

    Where nodes are whole numbers, each task first turns the edges that it holds
    into stars, which leaves little to the rounds. These alternate large and
    small star contractions, each a map-side combined minimum and a join, until
    the edges are stars around the smallest nodes. Every round is stored, so lost
    executors cost at most one round. Self-loops keep their node; edges with a
    null end are left out. Raises if the rounds run out, which needs far longer
    chains than 2**max_rounds / 2.
    """
    given = edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull())
    given = stored(given.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).distinct(), "edges")
    loops = given.where("u = v").select(F.col("u").alias("node"), F.col("u").alias("component"))
    now, rounds = given.where("u > v"), []
    if isinstance(given.schema["u"].dataType, (IntegerType, LongType)):
        now = stored(_contracted(now, HELD_EDGES), "contracted")
        rounds = [now]
    for _ in range(max_rounds):
        if _settled(now):
            break
        now = stored(_small_star(_large_star(now)), "components")
        discard(*rounds)
        rounds = [now]
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    found = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return found.unionByName(roots).unionByName(loops).groupBy("node").agg(F.min("component").alias("component"))


def minimum_spanning_forest(edges: DataFrame, src: str = "src", dst: str = "dst", weight: str = "weight", max_rounds: int = 60) -> DataFrame:
    """(src, dst, weight), src < dst: the edges of the forest of least total weight, of equal weights those of smaller ends.

    Boruvka's rounds: every tree takes its lightest edge out (a map-side combined
    minimum), the trees so joined are contracted, and edges inside a tree go. The
    number of trees at least halves, so rounds grow with its logarithm; each is
    stored. Self-loops, edges with a null end or weight and all but the lightest of
    parallel edges never take part.
    """
    given = edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull() & F.col(weight).isNotNull() & (F.col(src) != F.col(dst)))
    given = given.select(F.least(src, dst).alias("src"), F.greatest(src, dst).alias("dst"), F.col(weight).alias("weight")).groupBy("src", "dst").agg(F.min("weight").alias("weight"))
    now = stored(given.withColumns({"u": F.col("src"), "v": F.col("dst")}), "trees")
    taken = []
    for _ in range(max_rounds):
        if now.isEmpty():
            break
        edge = F.struct("weight", "src", "dst")
        ends = now.select(F.col("u").alias("tree"), edge.alias("e")).unionByName(now.select(F.col("v").alias("tree"), edge.alias("e")))
        best = stored(ends.groupBy("tree").agg(F.min("e").alias("e")).select("e.*").distinct(), "forest")
        taken.append(best)
        # Trees that an edge joins: its ends' trees, not its ends.
        met = now.join(best.select("src", "dst"), ["src", "dst"]).select("u", "v")
        tree = stored(connected_components(met, "u", "v"), "joined-trees")
        of = lambda end, name: tree.select(F.col("node").alias(end), F.col("component").alias(name))
        moved = now.join(of("u", "_u"), "u", "left").join(of("v", "_v"), "v", "left")
        moved = moved.select("src", "dst", "weight", F.coalesce("_u", "u").alias("u"), F.coalesce("_v", "v").alias("v")).where("u <> v")
        after = stored(moved, "trees")
        discard(now, tree)
        now = after
    else:
        raise RuntimeError(f"trees did not join in {max_rounds} rounds")
    out = given.select("src", "dst", "weight").limit(0)
    for part in taken:
        out = out.unionByName(part.select("src", "dst", "weight"))
    return out
