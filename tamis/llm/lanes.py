"""A stated query set against all rows, in blocks: rows as packed shards, queries as packed blocks, and tasks that read the shards of a lane
one by one with one block in memory.

Nothing is emitted per pair. What a task sends is what its search keeps for each query, whatever number of shards it has read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LANES = 16
CELL = "pool int, block int, kind int, shard int, rows int, keys binary, ids binary, labels binary, x binary, more binary"
_COLUMNS = [part.split() for part in CELL.split(", ")]
_NOTHING = np.zeros(0, np.int64)


class Search(Protocol):
    """What a task holds for a block of queries."""

    def scan(self, shard: dict) -> None: ...

    def result(self) -> pa.RecordBatch: ...


def size_of(values: np.ndarray) -> int:
    """The largest absolute value."""
    return max(int(values.max()), -int(values.min())) if values.size else 0


def pack(values: np.ndarray) -> bytes:
    """Whole numbers in as few bytes each as they need, with the kind in front."""
    top = size_of(values)
    kind = "<i2" if top < 1 << 15 else "<i4" if top < 1 << 31 else "<i8"
    return kind.encode() + np.ascontiguousarray(values.astype(kind)).tobytes()


def unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(data, data[:3].decode(), offset=3).astype(np.int64)


def number_matrix(column: pa.ChunkedArray) -> np.ndarray:
    """A list column as a matrix; shorter rows are filled with zeros."""
    lists = column.combine_chunks()
    lengths = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lengths), int(lengths.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < lengths[:, None]] = lists.flatten().to_numpy()
    return out


def packed(table: pa.Table, shard: bool, x: np.ndarray, more: np.ndarray = _NOTHING) -> pa.Table:
    """One CELL row of a table (pool, shard or block, key, id[, label]) with the numbers x and more."""
    one = {"pool": table["pool"][0].as_py(), "block": 0 if shard else table["block"][0].as_py(), "kind": int(shard),
           "shard": table["shard"][0].as_py() if shard else 0, "rows": table.num_rows, "keys": table["key"].to_numpy().astype("<i8").tobytes(),
           "ids": pack(table["id"].to_numpy()), "labels": pack(table["label"].to_numpy() if "label" in table.column_names else _NOTHING), "x": pack(x),
           "more": pack(more)}
    kinds = {"int": pa.int32(), "binary": pa.binary()}
    return pa.table({n: pa.array([one[n]], kinds[k]) for n, k in _COLUMNS})


def parts_of_pools(spark: SparkSession, counts: dict[int, int]) -> DataFrame:
    """(pool, parts) as a table; the number of pools is bounded by the caller."""
    return F.broadcast(spark.createDataFrame(list(counts.items()), "pool int, parts int"))


def meet(shards: DataFrame, blocks: DataFrame, parts: dict[int, int] | int, search: Callable[[dict], Search], result: str, lanes: int = LANES) -> DataFrame:
    """The results of `search(block row)` for each block and lane, after it has scanned the shards of the lane. `parts`: the number of blocks, of each pool
    or in all; a block meets the shards of its pool."""
    spark = shards.sparkSession
    numbered = shards.drop("block")
    numbered = numbered.join(parts_of_pools(spark, parts), "pool") if isinstance(parts, dict) else numbered.withColumn("parts", F.lit(parts))
    of_shards = numbered.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("lane", F.pmod("shard", F.lit(lanes)))
    of_blocks = blocks.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    columns, cell = ["lane", *[n for n, _ in _COLUMNS]], ["pool", "block", "lane"]
    # as many parts as the session asks for: their work is in the arithmetic and not in their bytes
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = of_shards.select(columns).unionByName(of_blocks.select(columns)).repartition(tasks, *cell).sortWithinPartitions(*cell, "kind", "shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, current = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                place = tuple(row[c] for c in cell)
                if place != at:
                    if current is not None:
                        yield current.result()
                    at, current = place, None
                if row["kind"] == 0:
                    current = search(row)
                elif current is not None:
                    current.scan(row)
        if current is not None:
            yield current.result()

    return dealt.mapInArrow(run, result)
