"""Exact nearest binary codes by incremental multi-index hashing.

A code is a row of 64-bit words. It is cut into m parts of some bits; each shard of rows has, for each part, its rows in the order of the
part's value, so that the rows with one value are one run. If two codes differ in at most m * (s + 1) - 1 bits, they differ in at
most s bits in one of the parts. Round s looks up, for a query and every part, the values that differ in exactly s bits: the masks of s
bits are one small table. Rows that are found first are verified over the whole code and kept with their distance, so nothing is probed
twice. A query is done with a shard once its kth verified distance is at most m * (s + 1) - 1; kth distances are carried from shard to
shard, which ends later ones after a few rounds.

The queries are a stated set and meet all rows in blocks (`lanes`). Of equal codes only as many rows are kept as one query can return,
so a code of a third of all rows is a few entries.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamis.llm.flat import gather
from tamis.llm.lanes import CELL, LANES, meet, number_matrix, packed, unpack
from tamis.llm.toplists import NONE, TopLists
from tamis.session import cut_lineage

K = 10
SHARD_ROWS = 1 << 20
LEAST_SHARD = 4096
BLOCK_QUERIES = 16_384
WIDE = 1 << 14  # rows from which parts have 16 bits instead of 8


def sign_code(vector: Column) -> Column:
    """Words of 64 bits for an array of any length: bit i % 64 of word i div 64 is set where element i is positive. A null element or a
    NaN leaves its bit unset; a null array has no code, an empty one has a word of zeros."""
    zero = F.lit(0).cast("long")

    def word(part):
        set_bits = F.transform(part, lambda x, i: F.when((x.cast("double") > 0) & ~F.isnan(x.cast("double")), F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(zero))
        return F.aggregate(set_bits, zero, lambda total, b: total.bitwiseOR(b))

    words = F.greatest(F.lit(1), F.ceil(F.size(vector) / F.lit(64)).cast("int"))
    return F.when(vector.isNotNull(), F.transform(F.sequence(F.lit(0), words - 1), lambda w: word(F.slice(vector, w * 64 + 1, F.lit(64)))))


@lru_cache(maxsize=64)
def masks(width: int, bits: int) -> np.ndarray:
    """All numbers of `width` bits with exactly `bits` set."""
    return np.array([sum(1 << b for b in chosen) for chosen in combinations(range(width), bits)], np.int64)


def parts(codes: np.ndarray, width: int) -> np.ndarray:
    """(parts x codes): the values of the parts of `width` bits."""
    shifts = np.arange(0, 64, width).astype(np.uint64)
    cut = codes.view(np.uint64)[:, :, None] >> shifts & np.uint64((1 << width) - 1)
    return cut.reshape(len(codes), -1).T.astype(np.int64)


class _Index:
    """The rows of a shard, and for each part their order by its value and where each value starts."""

    def __init__(self, row: dict, words: int, width: int | None):
        n = row["rows"]
        self.ids = unpack(row["ids"])
        own = unpack(row["x"]).reshape(n, -1)
        self.codes = np.zeros((n, max(words, own.shape[1])), np.int64)
        self.codes[:, :own.shape[1]] = own
        self.width = width or (16 if n >= WIDE else 8)
        values = parts(self.codes, self.width)
        self.order = np.argsort(values, axis=1, kind="stable")
        self.first = np.stack([np.searchsorted(v[o], np.arange((1 << self.width) + 1)) for v, o in zip(values, self.order, strict=True)])
        self.query = np.zeros(n, np.int64)  # the number of the last query that has found a row

    def probe(self, own: np.ndarray, bits: int) -> np.ndarray:
        """Places of the rows that differ from the part values `own` in exactly `bits` bits of some part; a row may come for several parts."""
        found = []
        for part, value in enumerate(own):
            wanted = value ^ masks(self.width, bits)
            start, end = self.first[part, wanted], self.first[part, wanted + 1]
            some = end > start
            found.append(gather(self.order[part], start[some], end[some] - start[some]))
        return np.concatenate(found)


class CodeSearch:
    """The nearest rows to each query of a block, over the shards that are given one after the other. A score is a negative distance."""

    def __init__(self, row: dict, k: int, width: int | None = None):
        self.ids, self.width, n = unpack(row["ids"]), width, row["rows"]
        self.codes = unpack(row["x"]).reshape(n, -1)
        self.best = TopLists(n, k)
        self.verified = self.probes = 0

    def scan(self, row: dict) -> None:
        index = _Index(row, self.codes.shape[1], self.width)
        codes = np.zeros((len(self.ids), index.codes.shape[1]), np.int64)
        codes[:, :self.codes.shape[1]] = self.codes
        own = parts(codes, index.width)
        for q in range(len(self.ids)):
            for bits in range(index.width + 1):
                if bits and self.best.scores[q, -1] != NONE and -self.best.scores[q, -1] < len(own) * bits:
                    break  # all rows up to len(own) * bits - 1 are known, ties of the kth distance too
                found = index.probe(own[:, q], bits)
                self.probes += len(own) * len(masks(index.width, bits))
                found = np.unique(found[index.query[found] != q + 1])
                index.query[found] = q + 1
                self.verified += len(found)
                distance = np.bitwise_count(index.codes[found].view(np.uint64) ^ codes[q].view(np.uint64)).sum(axis=1, dtype=np.int64)
                near = (index.ids[found] != self.ids[q]) & (-distance >= self.best.scores[q, -1])
                self.best.add(np.full(int(near.sum()), q), -distance[near], index.ids[found[near]])

    def result(self) -> pa.RecordBatch:
        row, score, other = self.best.entries()
        return pa.RecordBatch.from_arrays([pa.array(row), pa.array(self.ids[row]), pa.array(-score), pa.array(other)], ["place", "query_id", "distance", "id"])


def nearest_codes(rows: DataFrame, queries: DataFrame, k: int = K, width: int | None = None, shard_rows: int = SHARD_ROWS,
                  block_queries: int = BLOCK_QUERIES, lanes: int = LANES) -> DataFrame:
    """(query_id, rank, id, distance): the k rows (id, code) nearest to each query (id, code) by Hamming distance, ties by id; a query
    isn't its own neighbour. Rows and queries with a null code or id are left out. Rows with a repeated id and code count once; a query id
    with several codes has a result for the code with the smallest hash only. Codes of different lengths are compared as if filled
    with zeros. Where fewer than k rows exist, all of them come. `width`, the bits of a part, is 8 or 16 and changes the cost, not the result."""
    rows = rows.where("id is not null and code is not null").select("id", "code").distinct()
    # of the rows of a code only the k + 1 smallest ids can matter; the limit is applied before the shuffle as well
    first = Window.partitionBy("code").orderBy("id")
    entries = cut_lineage(rows.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1).select("id", "code", F.xxhash64("id", "code").alias("key")))
    wanted = cut_lineage(queries.where("id is not null and code is not null").groupBy("id").agg(F.min_by("code", F.xxhash64("code")).alias("code")).withColumn(
        "key", F.xxhash64("id")))
    count = entries.count()
    shards = max(1, -(-count // shard_rows), min(lanes, count // LEAST_SHARD))
    blocks = max(1, -(-wanted.count() // block_queries))

    def pack_codes(name: str):
        def build(table: pa.Table) -> pa.Table:
            return packed(table, name == "shard", number_matrix(table.column("code")))

        return build

    one = F.lit(0).alias("pool")
    of_rows = entries.select(one, F.pmod("key", F.lit(shards)).cast("int").alias("shard"), "*").groupBy("shard").applyInArrow(pack_codes("shard"), CELL)
    of_queries = wanted.select(one, F.pmod("key", F.lit(blocks)).cast("int").alias("block"), "*").groupBy("block").applyInArrow(pack_codes("block"), CELL)
    found = meet(cut_lineage(of_rows), of_queries, blocks, lambda row: CodeSearch(row, k, width), "place bigint, query_id bigint, distance bigint, id bigint", lanes)
    best = Window.partitionBy("query_id").orderBy("distance", "id")
    return found.drop("place").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "id", F.col("distance").cast("int").alias("distance"))
