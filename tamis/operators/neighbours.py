"""Exact k-nearest-neighbour joins on cosine similarity.

A reference set that the caller bounds by construction (a fixed number of rows per class) and that is checked to fit is
shipped to the tasks, which multiply Arrow batches against it. Any larger reference goes through `blocked_neighbours`:
pivot cells, a bound from the home cell, and only the cells that the bound cannot rule out. Both multiply tiles of bounded
size and keep the best of each query from tile to tile, so the memory of a task doesn't grow with the reference.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tamis.functions.numeric import matrix, unit_rows
from tamis.operators.similarity import CELL_ROWS, MAX_PIVOTS, choose_pivots
from tamis.session import cut_lineage

MAX_REFERENCE_ROWS = 200_000
MAX_REFERENCE_BYTES = 128 * 1024 * 1024  # every Python worker holds its own copy
SEARCH_ROWS = 20_000
SEND_ROWS = 16_384
TILE = 1_024
REFERENCE_TILE = 4_096


@dataclass
class ReferenceSet:
    """Normalised reference rows that fit in a task, in id order, with an optional unit (own group) per row."""

    ids: np.ndarray
    unit: np.ndarray
    group: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.ids)


class ReferenceTooLarge(ValueError):
    """The reference rows don't fit in a task; use `knn_join`, `knn_distance` or `scoring.score_against`."""


def fits_in_task(df: DataFrame, vector: str = "e", max_rows: int = MAX_REFERENCE_ROWS, max_bytes: int = MAX_REFERENCE_BYTES) -> bool:
    """Whether the vectors keep both bounds. Only two numbers reach the driver."""
    size = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size(vector).cast("long")).alias("numbers")).first()
    return size.n <= max_rows and 8 * (size.numbers or 0) <= max_bytes


def bounded_reference(df: DataFrame, item_id: str = "ref_id", vector: str = "e", group: str | None = None,
                      max_rows: int = MAX_REFERENCE_ROWS, max_bytes: int = MAX_REFERENCE_BYTES) -> ReferenceSet:
    """The rows as one matrix. They are counted and measured first; beyond the bounds it raises ReferenceTooLarge."""
    if not fits_in_task(df, vector, max_rows, max_bytes):
        raise ReferenceTooLarge(f"more than {max_rows} rows or {max_bytes} bytes")
    columns = [item_id, vector] + ([group] if group else [])
    table = df.select(*columns).toArrow().sort_by(item_id)
    rows = unit_rows(matrix(table.column(vector)))
    labels = np.array(table.column(group).to_pylist(), dtype=object) if group else None
    return ReferenceSet(table.column(item_id).to_numpy(), rows, labels)


def largest(s: np.ndarray, k: int) -> np.ndarray:
    """The k largest entries of each row, all where there are fewer."""
    return s if s.shape[1] <= k else np.partition(s, s.shape[1] - k, axis=1)[:, -k:]


def mean_of_top(q: np.ndarray, reference: np.ndarray, k: int) -> np.ndarray:
    """Mean of the k largest products of each row of q with reference rows."""
    best = largest(q @ reference[:REFERENCE_TILE].T, k)
    for start in range(REFERENCE_TILE, len(reference), REFERENCE_TILE):
        s = q @ reference[start:start + REFERENCE_TILE].T
        if best.shape[1] < k:
            best = largest(np.hstack([best, s]), k)
            continue
        # a row that meets nothing larger keeps what it has; nan counts as larger
        better = np.nonzero(~(s <= best.min(axis=1)[:, None]).all(axis=1))[0]
        best[better] = largest(np.hstack([best[better], s[better]]), k)
    return best.mean(axis=1)


def distances(query: np.ndarray, reference: np.ndarray, k: int) -> np.ndarray:
    """1 - mean of the k largest cosine similarities (of all, when fewer), tile by tile."""
    if reference.shape[0] == 0:
        return np.full(len(query), np.nan)
    q = unit_rows(query)
    return np.concatenate([1.0 - mean_of_top(q[i:i + TILE], reference, k) for i in range(0, len(q), TILE)]
                          or [np.zeros(0)])


def _top(s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k largest entries per row, largest first, the smaller column on ties; -inf is left out."""
    k = min(k, s.shape[1])
    edge = np.partition(s, s.shape[1] - k, axis=1)[:, -k][:, None]
    row, col = np.nonzero((s >= edge) & np.isfinite(s))
    keep = _first(row, col, s[row, col], k)
    return row[keep], col[keep]


def _first(row: np.ndarray, col: np.ndarray, value: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest values of each row, by row, largest first, the smaller column on ties."""
    order = np.lexsort((col, -value, row))
    return order[_places(row[order]) < k]


def _places(row: np.ndarray) -> np.ndarray:
    """Place of each entry among those of its row, from 0; rows stand together."""
    first = np.r_[0, np.nonzero(np.diff(row))[0] + 1] if len(row) else np.zeros(0, int)
    return np.arange(len(row)) - np.repeat(first, np.diff(np.r_[first, len(row)]))


def _nearest(q: np.ndarray, reference: np.ndarray, k: int, own: np.ndarray | None = None, group: np.ndarray | None = None,
             low: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`_top` of q @ reference.T with the values, tile by tile: (row, column, similarity). Reference rows of the query's own group
    are left out, and so are those below `low`."""
    row, col, value = np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    bound = np.full(len(q), -np.inf)
    for start in range(0, len(reference), REFERENCE_TILE):
        s = q @ reference[start:start + REFERENCE_TILE].T
        if own is not None:
            s[own[:, None] == group[None, start:start + REFERENCE_TILE]] = -np.inf
        if low is not None:
            s[s < low[:, None]] = -np.inf
        if start:  # earlier columns win ties, so only larger values count; few are left after the first tiles
            hit = s > bound[:, None]
            r, c = np.nonzero(hit)
            if len(r) > k * len(q):
                r, c = _top(np.where(hit, s, -np.inf), k)
        else:
            r, c = _top(s, k)
        row, col, value = np.concatenate([row, r]), np.concatenate([col, start + c]), np.concatenate([value, s[r, c]])
        if start:
            keep = _first(row, col, value, k)
            row, col, value = row[keep], col[keep], value[keep]
        full = _places(row) == k - 1
        bound[row[full]] = value[full]
    return row, col, value


def _codes(values: list, known: dict) -> np.ndarray:
    """A number for each value, equal for equal values; new ones are added to `known`."""
    return np.array([known.setdefault(v, len(known)) for v in values], dtype=np.int64)


def neighbours(queries: DataFrame, reference: ReferenceSet, k: int, item_id: str = "item_id", vector: str = "e",
               group: str | None = None) -> DataFrame:
    """The k best reference rows per query: (item_id, ref_id, similarity, rank), ties by ref_id. With `group`, rows of
    the query's own group are left out. One narrow stage, no shuffle."""
    shared = queries.sparkSession.sparkContext.broadcast(reference)
    columns = [item_id, vector] + ([group] if group else [])
    kind = queries.schema[item_id].dataType.simpleString()

    def search(batches):
        ref = shared.value
        known: dict = {}
        theirs = _codes(ref.group.tolist(), known) if group else None
        for batch in batches:
            if batch.num_rows == 0 or len(ref) == 0:
                continue
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            q = unit_rows(matrix(batch.column(1)))
            # a group without reference rows gets -1
            own = np.array([known.get(v, -1) for v in batch.column(2).to_pylist()], dtype=np.int64) if group else None
            for i in range(0, len(q), TILE):
                row, col, value = _nearest(q[i:i + TILE], ref.unit, k, own[i:i + TILE] if group else None, theirs)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[i + row]), pa.array(ref.ids[col]), pa.array(value), pa.array((_places(row) + 1).astype(np.int32))],
                    names=[item_id, "ref_id", "similarity", "rank"])

    return queries.select(*columns).mapInArrow(search, f"{item_id} {kind}, ref_id bigint, similarity double, rank int")


def _copies(batch: pa.RecordBatch, needed: Callable, parts: dict[int, int]) -> Iterator[pa.RecordBatch]:
    """A copy of each row for every block of its needed cells, but not for its own block: at most SEND_ROWS at once, or those of one row."""
    step = max(1, SEND_ROWS // sum(parts.values()))
    for start in range(0, batch.num_rows, step):
        b = batch.slice(start, step)
        cells, need = needed(b)
        row, col = np.nonzero(need)
        count = np.array([parts[x] for x in cells], dtype=int)[col]
        row, cell = np.repeat(row, count), np.repeat(cells[col], count)
        ends = np.cumsum(count)
        part = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - count, count)
        new = (cell != b.column("cell").to_numpy()[row]) | (part != b.column("part").to_numpy()[row])
        sub = b.take(pa.array(row[new]))
        yield pa.RecordBatch.from_arrays(
            [pa.array(cell[new].astype(np.int32)), pa.array(part[new].astype(np.int32)), sub.column("id"),
             sub.column("v").cast(pa.list_(pa.float64())), sub.column("grp"), sub.column("low")],
            names=["cell", "part", "id", "v", "grp", "low"])


def blocked_neighbours(queries: DataFrame, reference: DataFrame, k: int, item_id: str = "item_id", vector: str = "e",
                       ref_id: str = "ref_id", group: str | None = None, cell_rows: int = CELL_ROWS,
                       block_rows: int = SEARCH_ROWS, max_pivots: int = MAX_PIVOTS) -> DataFrame:
    """The same result for a reference of any size.

    First pass: each query meets one block of its home cell, which bounds its k-th similarity from below. Second pass:
    the query is sent to the remaining blocks of every cell whose bisector bound does not rule out a better row, with its
    bound, and only rows that reach it come back. Blocks are cut by hash on both sides, so neither a crowded cell nor a crowded
    query region makes a large task.
    """
    kind = queries.schema[item_id].dataType.simpleString()
    tag_q = F.col(group).cast("string") if group else F.lit(None).cast("string")
    q = queries.select(F.col(item_id).alias("id"), F.col(vector).alias("v"), tag_q.alias("grp"))
    r = reference.select(F.col(ref_id).alias("id"), F.col(vector).alias("v"), tag_q.alias("grp"))
    pivots = choose_pivots(r, "id", "v", cell_rows, max_pivots)
    if pivots is None:
        pivots = np.zeros((1, 1))
    spark = queries.sparkSession
    shared = spark.sparkContext.broadcast(pivots)
    single = pivots.shape == (1, 1) and not pivots.any()

    def home(df: DataFrame) -> DataFrame:
        if single:
            return df.select(F.lit(0).alias("cell"), "id", "v", "grp")

        def assign(batches):
            for b in batches:
                if b.num_rows:
                    cell = (unit_rows(matrix(b.column("v"))) @ shared.value.T).argmax(axis=1).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(cell), *b.columns], names=["cell", *b.schema.names])

        return df.mapInArrow(assign, df.select(F.lit(0).alias("cell"), "id", "v", "grp").schema)

    placed = home(r)
    sizes = {row.cell: row.n for row in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per pivot
    if not sizes:
        return spark.createDataFrame([], f"{item_id} {kind}, ref_id bigint, similarity double, rank int")
    parts = {c: max(1, math.ceil(n / block_rows)) for c, n in sizes.items()}
    part_table = spark.createDataFrame([(c, p) for c, p in parts.items()], "cell int, parts int")
    blocks = (placed.join(F.broadcast(part_table), "cell")
              .withColumn("part", F.pmod(F.xxhash64("id", F.lit(29)), F.col("parts")).cast("int"))
              .select("cell", "part", "id", "v", "grp"))

    def meet(asked: DataFrame, load: DataFrame) -> DataFrame:
        """Top k of every (query, block) above the query's bound: (id, ref_id, similarity). `load` says in how many shares the queries
        of a block, or of each block of a cell, are met."""
        on = [c for c in load.columns if c != "shares"]
        left = asked.join(load, on).withColumn("share", F.pmod(F.xxhash64("id", F.lit(31)), F.col("shares")).cast("int"))
        right = blocks.join(load, on).withColumn(
            "share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).withColumn("low", F.lit(None).cast("double"))
        pick = ["cell", "part", "share", "id", "v", "grp", "low"]
        rows = left.select(*pick, F.lit(0).alias("side")).unionByName(right.select(*pick, F.lit(1).alias("side")))

        def best(table: pa.Table) -> pa.Table:
            side = table.column("side").to_numpy()
            ids = table.column("id").to_numpy()
            unit = unit_rows(matrix(table.column("v")))
            a, b = np.nonzero(side == 0)[0], np.nonzero(side == 1)[0]
            b = b[np.argsort(ids[b], kind="stable")]
            grp = _codes(table.column("grp").to_pylist(), {}) if group else None
            low = table.column("low").to_numpy()
            others, their_ids, theirs = unit[b], ids[b], grp[b] if group else None
            got_q, got_r, got_s = [], [], []
            for i in range(0, len(a) if len(b) else 0, TILE):
                chunk = a[i:i + TILE]
                row, col, value = _nearest(unit[chunk], others, k, grp[chunk] if group else None, theirs, low[chunk])
                got_q.append(ids[chunk[row]])
                got_r.append(their_ids[col])
                got_s.append(value)
            join = lambda parts_, t: pa.array(np.concatenate(parts_) if parts_ else np.zeros(0), t)
            return pa.table({"id": join(got_q, pa.int64()), "ref_id": join(got_r, pa.int64()),
                             "similarity": join(got_s, pa.float64())})

        return rows.groupBy("cell", "part", "share").applyInArrow(best, "id bigint, ref_id bigint, similarity double")

    have = F.create_map(*[F.lit(x) for c, p in parts.items() for x in (c, p)])
    first = home(q).withColumn("part", F.pmod(F.xxhash64("id", F.lit(37)), F.coalesce(F.try_element_at(have, "cell"), F.lit(1)))
                               .cast("int"))
    order = Window.partitionBy("id").orderBy(F.desc("similarity"), "ref_id")

    def ranked(found: DataFrame) -> DataFrame:
        return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
                .select(F.col("id").cast(kind).alias(item_id), "ref_id", "similarity", "rank"))

    shares = F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("shares")
    found = meet(first.withColumn("low", F.lit(None).cast("double")), first.groupBy("cell", "part").agg(shares))
    if sum(parts.values()) == 1:
        return ranked(found)  # the home block is the whole reference
    seed = cut_lineage(found)
    bound = seed.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("similarity").alias("low")).select(
        "id", F.when(F.col("n") >= k, F.col("low")).alias("low"))
    open_q = cut_lineage(first.join(bound, "id", "left").select("cell", "part", "id", "v", "grp", "low"))

    def needed(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """(cells, mask of query x cell): the cells that may hold a better row, the home cell included."""
        cells = np.array(sorted(parts), dtype=int)
        at = b.column("cell").to_numpy(zero_copy_only=False)
        if single:
            return cells, np.ones((len(at), 1), bool)
        p = shared.value
        gap = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (p @ p.T)))
        low = np.asarray(b.column("low").to_numpy(zero_copy_only=False), dtype=np.float64)
        c = unit_rows(matrix(b.column("v"))) @ p.T
        reach = np.where(np.isnan(low), np.inf, np.sqrt(np.maximum(0.0, 2.0 - 2.0 * low)))
        need = (c[np.arange(len(at)), at][:, None] - c) <= reach[:, None] * gap[at] + 1e-9
        return cells, need[:, cells] | (cells[None, :] == at[:, None])

    def weigh(batches):
        for b in batches:
            if b.num_rows:
                cells, need = needed(b)
                yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), pa.array(need.sum(axis=0).astype(np.int64))],
                                                 names=["cell", "n"])

    def spread(batches):
        for b in batches:
            yield from _copies(b, needed, parts)

    wanted = open_q.mapInArrow(weigh, "cell int, n bigint").groupBy("cell").agg(
        F.greatest(F.lit(1), F.ceil(F.sum("n") / block_rows)).cast("int").alias("shares"))
    wanted = spark.createDataFrame(wanted.collect(), "cell int, shares int")  # one row per pivot
    rest = open_q.mapInArrow(spread, "cell int, part int, id bigint, v array<double>, grp string, low double")
    return ranked(seed.unionByName(meet(rest, F.broadcast(wanted))))


def knn_join(queries: DataFrame, reference: DataFrame, k: int, item_id: str = "item_id", vector: str = "e",
             ref_id: str = "ref_id", group: str | None = None, max_rows: int = MAX_REFERENCE_ROWS) -> DataFrame:
    """(item_id, ref_id, similarity, rank): the shipped form when the reference is checked to be small, else blocked."""
    if fits_in_task(reference, vector, max_rows):
        return neighbours(queries, bounded_reference(reference, ref_id, vector, group, max_rows), k, item_id, vector, group)
    return blocked_neighbours(queries, reference, k, item_id, vector, ref_id, group)


def knn_distance(queries: DataFrame, reference: DataFrame, k: int, item_id: str = "item_id", vector: str = "e",
                 ref_id: str = "ref_id", group: str | None = None, out: str = "distance",
                 max_rows: int = MAX_REFERENCE_ROWS) -> DataFrame:
    """(item_id, distance): 1 - mean of the k largest similarities; a query without any reference row is left out."""
    small = bounded_reference(reference, ref_id, vector, group, max_rows) if fits_in_task(reference, vector, max_rows) else None
    if small is not None and group is None:
        shared = queries.sparkSession.sparkContext.broadcast(small)
        kind = queries.schema[item_id].dataType.simpleString()

        def measure(batches):
            ref = shared.value
            for b in batches:
                if b.num_rows and len(ref):
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0), pa.array(distances(matrix(b.column(1)), ref.unit, k))], names=[item_id, out])

        return queries.select(item_id, vector).mapInArrow(measure, f"{item_id} {kind}, {out} double")
    near = (neighbours(queries, small, k, item_id, vector, group) if small is not None
            else blocked_neighbours(queries, reference, k, item_id, vector, ref_id, group))
    return near.groupBy(item_id).agg((F.lit(1.0) - F.avg("similarity")).alias(out))


def nearest_distance(queries: DataFrame, reference: DataFrame, item_id: str = "item_id", vector: str = "e",
                     ref_id: str = "ref_id", out: str = "distance") -> DataFrame:
    """Every query with 1 - max similarity, null when there is no reference row."""
    found = knn_distance(queries, reference, 1, item_id, vector, ref_id, out=out)
    return queries.select(item_id).join(found, item_id, "left")
