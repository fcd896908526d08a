"""Connected components of an edge table: forests inside tasks, then alternating star contraction (Kiveris et al., SoCC 2014)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.operators.similarity import BLOCK_ROWS, CELL_ROWS, MAX_PIVOTS, connected_blocks, copy_map
from tamis.session import cut_lineage, give_back, next_table

#: Edges that a task joins at once.
CHUNK = 50_000


def smallest_reachable(a: np.ndarray, b: np.ndarray, nodes: int) -> np.ndarray:
    """For each of `nodes` nodes the smallest one it reaches over the edges (a, b)."""
    least = np.arange(nodes)
    while True:
        x, y = least[a], least[b]
        apart = x != y
        if not apart.any():
            return least
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(least, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = least[least]
            if np.array_equal(up, least):
                break
            least = up


def _forest(chunk: pa.Table) -> pa.RecordBatch:
    both = pa.concat_arrays([c for name in "uv" for c in chunk.column(name).chunks])
    coded = both.dictionary_encode()
    order = pc.sort_indices(coded.dictionary)
    values = coded.dictionary.take(order)
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    at = rank[coded.indices.to_numpy()]
    least = smallest_reachable(at[:chunk.num_rows], at[chunk.num_rows:], len(values))
    below = np.flatnonzero(least != np.arange(len(values)))
    return pa.RecordBatch.from_arrays([values.take(pa.array(below)), values.take(pa.array(least[below]))], ["u", "v"])


def _forests(edges: DataFrame, chunk: int) -> DataFrame:
    """Stars (u, v), u > v, that join the same nodes as each `chunk` of edges (u, v) of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= chunk:
                yield _forest(pa.Table.from_batches(held))
                held, rows = [], 0
        if rows:
            yield _forest(pa.Table.from_batches(held))

    return edges.mapInArrow(run, edges.schema)


def _settled(stars: DataFrame) -> bool:
    """Whether each node hangs on one node that hangs on none."""
    sides = stars.select(F.col("u").alias("n"), F.lit(1).alias("up")).unionByName(stars.select(F.col("v").alias("n"), F.lit(0).alias("up")))
    ends = sides.groupBy("n").agg(F.sum("up").alias("ups"), F.min("up").alias("least"))
    return ends.where("ups > 1 or (ups = 1 and least = 0)").isEmpty()


def _star_step(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star pass over (u, v) with u > v. Neighbour minima are combined before the shuffle
    and joined back, so that a node with very many neighbours is never gathered in one task."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    lowest = large.groupBy("u").agg(F.min("v").alias("m"))
    joined = large.join(lowest, "u")
    moved = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    kept = lowest.select("u", F.col("m").alias("v"))
    return moved.unionByName(kept).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60, rows: int | None = None, roots: bool = True, chunk: int = CHUNK) -> DataFrame:
    """(node, component) for every node of the undirected edges (a, b); the component is its smallest node.

    `rows`: the number of edges, where the caller has them in a table already. Without `roots` a component's smallest node has no row."""
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    stored = None
    if rows is None:
        pairs = stored = cut_lineage(pairs)
        rows = stored.count()
    # tasks of about one chunk each; a table of many chunks needs the stars below
    current = cut_lineage(_forests(pairs.coalesce(max(1, -(-rows // chunk))), chunk))
    give_back(stored)
    for _ in range(max_rounds):
        if _settled(current):
            break
        current = next_table(current, _star_step(current))
    else:
        raise RuntimeError("components did not settle; raise max_rounds")
    found = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    if not roots:
        found._tamis_path = current._tamis_path
        return found
    return found.unionByName(found.select(F.col("component").alias("node"), "component").distinct())


def copy_groups(df: DataFrame, tau: float, item_id: str = "item_id", vector: str = "e", strict: bool = True,
                cell_rows: int = CELL_ROWS, block_rows: int = BLOCK_ROWS, max_pivots: int = MAX_PIVOTS,
                same: DataFrame | None = None) -> DataFrame:
    """(item_id, copy_group): rows linked by a chain of near copies share a group, named by its smallest id; a row
    without copies keeps its own. `same`: the map of identical copies, when the caller already has it."""
    if same is None:
        same = cut_lineage(copy_map(df.select(item_id, vector), item_id, vector))
    reps = df.join(same.where(F.col(item_id) == F.col("rep")).select(item_id), item_id, "left_semi").select(item_id, vector)
    found = connected_components(connected_blocks(reps, tau, item_id, vector, strict, cell_rows, block_rows, max_pivots))
    return same.join(found, same["rep"] == found["node"], "left").select(
        item_id, F.coalesce("component", "rep").alias("copy_group"))
