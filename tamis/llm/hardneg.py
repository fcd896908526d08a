"""Hard negatives by Fagin's threshold algorithm over sorted lists of the vector components.

Rows are dealt to shards of about SHARD_ROWS; a shard keeps, for each dimension, the list of its rows sorted by that component. A search
takes the lists of an anchor in the direction of the sign of its components, from the rows that can add most on. Rows that the lists
give are scored in full, as whole numbers. What no list has given yet scores at most the threshold, the product of the anchor with
the next value of each list; a window of scores is done with a shard once the threshold lies strictly below its kth score, or
below its lower end. The anchors of a batch share the rows that their lists give, and a shard whose threshold at the tops of
its lists is too low isn't opened at all. kth scores are carried from shard to shard.

The anchors are a stated query set and meet all rows in blocks: a task has one block of anchors and reads the shards of one lane
one by one, so its memory is a block, its lists and a shard. Positives are searched in the shards of the anchor's label only:
labels are dealt to pools by hash and a pool is cut into shards by row hash, so a label with a third of all rows is many shards.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamis.llm.lanes import CELL, LANES, meet, number_matrix, packed, parts_of_pools, size_of, unpack
from tamis.llm.toplists import TopLists
from tamis.session import cut_lineage

POSITIVES = 5
NEGATIVES = 10
LOW, HIGH = 30, 90
SCALE = 256
SHARD_ROWS = 2048
BLOCK_ANCHORS = 8192
MAX_POOLS = 4096
BATCH = 64
FIRST_DEPTH = 16
_EXACT = 1 << 53


def whole_vectors(rows: DataFrame, row_id: Column, vector: Column, label: Column, scale: int = SCALE) -> DataFrame:
    """(id, label, x) with x = floor(scale * component), distinct. Rows with a null id, label or vector or a component that is null, NaN
    or infinite are left out."""
    def odd(v):
        return v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))

    named = rows.select(row_id.cast("long").alias("id"), label.cast("long").alias("label"), vector.cast("array<double>").alias("v"))
    fit = named.where("id is not null and label is not null and v is not null").where(~F.exists("v", odd))
    return fit.select("id", "label", F.transform("v", lambda v: F.floor(v * scale)).alias("x")).distinct()


def sorted_lists(rows: DataFrame) -> DataFrame:
    """One row per shard of (pool, shard, key, id, label, x): its rows and, by dimension, their places in ascending order."""

    def build(table: pa.Table) -> pa.Table:
        x = number_matrix(table.column("x"))
        return packed(table, True, x, np.argsort(x.T, axis=1, kind="stable"))

    return rows.groupBy("pool", "shard").applyInArrow(build, CELL)


def anchor_blocks(rows: DataFrame) -> DataFrame:
    """One row per block of (pool, block, key, id, label, x, ends): its anchors and the lower and upper ends of their windows."""

    def build(table: pa.Table) -> pa.Table:
        return packed(table, False, number_matrix(table.column("x")), number_matrix(table.column("ends")))

    return rows.groupBy("pool", "block").applyInArrow(build, CELL)


class _Shard:
    """The rows of a shard and its lists."""

    def __init__(self, row: dict, dims: int):
        self.ids, self.labels = unpack(row["ids"]), unpack(row["labels"])
        n = row["rows"]
        x = unpack(row["x"]).reshape(n, -1)
        order = unpack(row["more"]).reshape(-1, n)
        self.values = np.zeros((n, max(dims, x.shape[1])), np.int64)  # a shorter vector is filled with zeros
        self.values[:, :x.shape[1]] = x
        self.order = np.concatenate((order, np.tile(np.arange(n), (self.values.shape[1] - len(order), 1))))
        self.sorted = np.take_along_axis(self.values.T, self.order, 1)


class WindowSearch:
    """The best rows of each window of each anchor of a block, over the shards that are given one after the other."""

    def __init__(self, row: dict, k: int, same: bool):
        self.same, n = same, row["rows"]
        self.keys = np.frombuffer(row["keys"], "<i8")
        self.ids, self.labels = unpack(row["ids"]), unpack(row["labels"])
        self.x = unpack(row["x"]).reshape(n, -1)
        ends = unpack(row["more"]).reshape(n, -1)
        self.windows = ends.shape[1] // 2 if not same else 1
        lowest, highest = np.iinfo(np.int64).min, np.iinfo(np.int64).max
        self.low = np.full((n, 1), lowest) if same else ends[:, ::2]
        self.high = np.full((n, 1), highest) if same else ends[:, 1::2]
        self.best = TopLists(n * self.windows, k)
        self.scored = 0

    def _bars(self, rows: np.ndarray) -> np.ndarray:
        """The score that an unseen row needs to enter each window; the highest number for empty windows."""
        least = self.best.least().reshape(-1, self.windows)[rows]
        return np.where(self.low[rows] > self.high[rows], np.iinfo(np.int64).max, np.maximum(least, self.low[rows]))

    def scan(self, row: dict) -> None:
        shard = _Shard(row, self.x.shape[1])
        width = shard.values.shape[1]
        x = np.zeros((len(self.x), width), np.int64)
        x[:, :self.x.shape[1]] = self.x
        most = size_of(x) * size_of(shard.values) * width
        kind = np.float64 if most < _EXACT else np.int64  # both give whole numbers
        values, ordered, x = shard.values.astype(kind), shard.sorted.astype(kind), x.astype(kind)
        for first in range(0, len(x), BATCH):
            self._scan_batch(np.arange(first, min(first + BATCH, len(x))), x, values, ordered, shard)

    def _scan_batch(self, rows: np.ndarray, x: np.ndarray, values: np.ndarray, ordered: np.ndarray, shard: _Shard) -> None:
        n, depth = len(values), 0
        seen = np.zeros(n, bool)
        while depth < n:
            threshold = np.maximum(x[rows], 0) @ ordered[:, n - 1 - depth] + np.minimum(x[rows], 0) @ ordered[:, depth]
            rows = rows[(threshold.astype(np.int64)[:, None] >= self._bars(rows)).any(axis=1)]
            if not len(rows):
                return
            deeper = min(n, max(4 * depth, FIRST_DEPTH))
            given = np.zeros(n, bool)
            if deeper == n:  # the lists give the rest, to an anchor of zeros as well
                given[:] = True
            else:
                given[shard.order[(x[rows] > 0).any(axis=0), n - deeper:n - depth]] = True
                given[shard.order[(x[rows] < 0).any(axis=0), depth:deeper]] = True
            new = np.flatnonzero(given & ~seen)
            seen[new] = True
            self.scored += len(rows) * len(new)
            self._enter(rows, (x[rows] @ values[new].T).astype(np.int64), shard.ids[new], shard.labels[new])
            depth = deeper

    def _enter(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
        allowed = ((self.labels[rows][:, None] == labels) == self.same) & (self.ids[rows][:, None] != ids)
        bars = self._bars(rows)
        for w in range(self.windows):
            r, c = np.nonzero(allowed & (scores >= bars[:, w, None]) & (scores <= self.high[rows, w, None]))
            self.best.add(rows[r] * self.windows + w, scores[r, c], ids[c])

    def result(self) -> pa.RecordBatch:
        row, score, other = self.best.entries()
        anchor, window = row // self.windows, row % self.windows
        return pa.RecordBatch.from_arrays([pa.array(self.keys[anchor]), pa.array(self.ids[anchor]), pa.array(window.astype(np.int32)),
                                           pa.array(score), pa.array(other)], ["key", "anchor_id", "window", "score", "other_id"])


def search(shards: DataFrame, blocks: DataFrame, parts: dict[int, int] | int, k: int, same: bool, lanes: int = LANES) -> DataFrame:
    """(key, anchor_id, window, rank, score, other_id): the k best rows of each window, from `sorted_lists` and `anchor_blocks`."""
    found = meet(shards, blocks, parts, lambda row: WindowSearch(row, k, same), "key bigint, anchor_id bigint, window int, score bigint, other_id bigint", lanes)
    best = Window.partitionBy("key", "anchor_id", "window").orderBy(F.desc("score"), "other_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
                   shard_rows: int = SHARD_ROWS, block_anchors: int = BLOCK_ANCHORS, lanes: int = LANES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for `rows` and `anchors` (id, label, x) from `whole_vectors`.

    A score is the inner product with the anchor, modulo 2^64. An anchor's positives are the first `positives` rows of its label, by descending score and then
    id; the negatives of a positive are the first `negatives` rows of other labels with low % to high % of its score. Rows with
    the anchor's own id take no part. Equal rows count once; one id on different rows is several rows, and several anchors. Vectors of
    different lengths are compared as if filled with zeros, and an empty vector scores 0. Anchors without a positive, and positives
    without a negative in their window, have no rows."""
    spark = rows.sparkSession
    pools = min(MAX_POOLS, max(1, rows.count() // shard_rows))

    def pooled(df: DataFrame) -> DataFrame:
        return df.select("id", "label", "x", F.pmod(F.xxhash64("label"), F.lit(pools)).cast("int").alias("pool"),
                         F.xxhash64("id", "label", "x").alias("key"))

    def cut(df: DataFrame, size: int, name: str) -> tuple[DataFrame, dict[int, int]]:
        """Each pool cut by hash into parts of about `size` rows, numbered within the pool; at most MAX_POOLS counts come to the driver."""
        counts = {r["pool"]: -(-r["count"] // size) for r in df.groupBy("pool").count().collect()}
        return df.join(parts_of_pools(spark, counts), "pool").withColumn(name, F.pmod("key", "parts").cast("int")).drop("parts"), counts

    stored, _ = cut(pooled(rows), shard_rows, "shard")
    shards = cut_lineage(sorted_lists(stored))
    wanted = cut_lineage(pooled(anchors))
    blocked, parts = cut(wanted, block_anchors, "block")
    none = F.array().cast("array<bigint>")
    alike = cut_lineage(search(shards, anchor_blocks(blocked.withColumn("ends", none)), parts, positives, True, lanes))
    # windows in whole numbers, ceil(low * score / 100) to floor(high * score / 100), and empty ones up to their full count
    ends = F.flatten(F.transform("p", lambda p: F.array(_percent(p["score"], low, 99), _percent(p["score"], high, 0))))
    empty = F.flatten(F.array_repeat(F.array(F.lit(1).cast("long"), F.lit(0).cast("long")), positives))
    with_windows = alike.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("rank", "score", "other_id"))).alias("p"))
    whole = wanted.join(with_windows, "key").withColumn("ends", F.slice(F.concat(ends, empty), 1, 2 * positives)).withColumn("pool", F.lit(0)).drop("p")
    number = max(1, -(-whole.count() // block_anchors))
    blocks = anchor_blocks(whole.withColumn("block", F.pmod("key", F.lit(number)).cast("int")))
    found = search(shards.withColumn("pool", F.lit(0)), blocks, number, negatives, False, lanes)
    of_window = alike.select("key", (F.col("rank") - 1).alias("window"), F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return found.join(of_window, ["key", "window"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"),
                                                           F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def _percent(a: Column, share: int, more: int) -> Column:
    """floor((share * a + more) / 100), without a product that could leave 64 bits."""
    rest = F.pmod(a, F.lit(100))
    return F.call_function("div", a - rest, F.lit(100)) * share + F.call_function("div", rest * share + more, F.lit(100))
