"""Exact cosine-threshold joins without a cross join.

Rows are assigned to the nearest of a bounded set of pivots. A row is also sent, as a guest, to every other pivot cell
that could hold a partner: by the bisector bound (Das Sarma et al., "ClusterJoin", VLDB 2014) a partner of b in the cell
of p needs (cos(b,h) - cos(b,p)) / |p-h| <= sqrt(2 - 2 tau), with h the pivot of b. The bound is exact, so no pair is
lost. Cells are then cut by a hash of the id into blocks of bounded size, so that one cell holding a third of all rows
becomes many tasks. Each task multiplies two blocks and returns what the caller needs: pairs, connectivity, or the labels
met, and the last two never grow with the number of pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.functions.numeric import matrix, unit_rows

CELL_ROWS = 20_000
BLOCK_ROWS = 4_096
MAX_PIVOTS = 512
TILE = 1_024
SLACK = 1e-9


def copy_representatives(df: DataFrame, item_id: str, vector: str, *labels: str) -> DataFrame:
    """(rep, vector, labels..., copies): one row per distinct vector and label. Identical rows are combined before the
    shuffle, so a third of the table being one vector costs one row."""
    return df.groupBy(vector, *labels).agg(F.min(item_id).alias("rep"), F.count(F.lit(1)).alias("copies"))


def copy_map(df: DataFrame, item_id: str, vector: str) -> DataFrame:
    """(id, rep): each row with the smallest id among its identical copies."""
    reps = df.groupBy(vector).agg(F.min(item_id).alias("rep"))
    return df.select(item_id, vector).join(reps, vector).select(item_id, "rep")


def choose_pivots(df: DataFrame, item_id: str, vector: str, cell_rows: int, max_pivots: int) -> np.ndarray | None:
    """At most `max_pivots` rows in hash order; None when one cell is enough."""
    wanted = min(max_pivots, math.ceil(df.count() / cell_rows))
    if wanted <= 1:
        return None
    rows = df.select(vector).orderBy(F.xxhash64(item_id), item_id).limit(wanted).toArrow()
    return unit_rows(matrix(rows.column(0)))


def _cell_rows(df: DataFrame, pivots: np.ndarray | None, reach: float, columns: list[str]) -> DataFrame:
    """Home and guest rows of every cell: (cell, guest, id, v, label)."""
    if pivots is None:
        return df.select(F.lit(0).alias("cell"), F.lit(False).alias("guest"), *columns)
    shared = df.sparkSession.sparkContext.broadcast(pivots)
    schema = df.select(F.lit(0).alias("cell"), F.lit(False).alias("guest"), *columns).schema

    def assign(batches):
        p = shared.value
        gap = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (p @ p.T)))
        for batch in batches:
            if batch.num_rows == 0:
                continue
            c = unit_rows(matrix(batch.column("v"))) @ p.T
            home = c.argmax(axis=1)
            rows = np.arange(len(home))
            near = (c[rows, home][:, None] - c) <= reach * gap[home] + SLACK
            near &= np.arange(p.shape[0])[None, :] < home[:, None]
            guest_row, guest_cell = np.nonzero(near)
            take = np.concatenate([rows, guest_row])
            cells = np.concatenate([home, guest_cell]).astype(np.int32)
            flags = np.concatenate([np.zeros(len(rows), bool), np.ones(len(guest_row), bool)])
            out = batch.take(pa.array(take))
            yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(flags), *out.columns],
                                             names=["cell", "guest", *out.schema.names])

    return df.select(*columns).mapInArrow(assign, schema)


def _blocks(cells: DataFrame, block_rows: int) -> DataFrame:
    """Copies of each row for the block pairs it takes part in: (cell, kind, x, y, side, id, v, label)."""
    sizes = cells.groupBy("cell").agg(
        F.greatest(F.lit(1), F.ceil(F.count_if(~F.col("guest")) / block_rows)).cast("int").alias("hs"),
        F.greatest(F.lit(0), F.ceil(F.count_if("guest") / block_rows)).cast("int").alias("gs"))
    # one row per pivot cell: bounded by the number of pivots
    work = cells.join(F.broadcast(sizes), "cell")
    parts = F.when(F.col("guest"), F.col("gs")).otherwise(F.col("hs"))
    work = work.withColumn("part", F.pmod(F.xxhash64("id", F.lit(17)), parts).cast("int"))
    part = F.col("part")

    def slot(kind: str, x: Column, y: Column, side: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), x.alias("x"), y.alias("y"), side.alias("side"))

    home_home = F.transform(F.sequence(F.lit(0), F.col("hs") - 1), lambda j: slot(
        "h", F.least(part, j), F.greatest(part, j), F.when(j < part, 1).otherwise(0)))
    none = F.filter(home_home, lambda s: F.lit(False))
    home_guest = F.when(F.col("gs") > 0, F.transform(
        F.sequence(F.lit(0), F.greatest(F.col("gs"), F.lit(1)) - 1), lambda g: slot("g", part, g, F.lit(0)))).otherwise(none)
    guest_home = F.transform(F.sequence(F.lit(0), F.col("hs") - 1), lambda i: slot("g", i, part, F.lit(1)))
    slots = F.when(F.col("guest"), guest_home).otherwise(F.concat(home_home, home_guest))
    return work.withColumn("_s", F.explode(slots)).select("cell", "_s.kind", "_s.x", "_s.y", "_s.side", "id", "v", "label")


def _tiles(a: np.ndarray, b: np.ndarray, tau: float, strict: bool, same: bool):
    """(first row, similarity tile, mask tile) over the rows of a; in a block paired with itself only i < j count."""
    for start in range(0, len(a), TILE):
        s = a[start:start + TILE] @ b.T
        m = s > tau if strict else s >= tau
        if same:
            m &= np.arange(len(b))[None, :] > np.arange(start, start + len(s))[:, None]
        yield start, s, m


def _pairs(ids_a, ids_b, labels_a, labels_b, tiles, same, id_type):
    for start, s, m in tiles:
        i, j = np.nonzero(m)
        first, second = ids_a[start + i], ids_b[j]
        yield pa.table({"a": pa.array(np.minimum(first, second), id_type),
                        "b": pa.array(np.maximum(first, second), id_type), "similarity": pa.array(s[i, j])})


def _stars(ids_a, ids_b, labels_a, labels_b, tiles, same, id_type):
    """Edges from the smallest id of each connected part of the block to its other members: at most one per row."""
    mask = np.concatenate([m for _, _, m in tiles]) if len(ids_a) else np.zeros((0, len(ids_b)), bool)
    if same:
        mask = mask | mask.T
    ids = ids_a if same else np.concatenate([ids_a, ids_b])
    na = len(ids_a)
    seen = np.zeros(len(ids), bool)
    starts = np.nonzero(mask.any(axis=1))[0]
    root_of = np.full(len(ids), -1)
    for start in starts:
        if seen[start]:
            continue
        members = [np.array([start])]
        seen[start] = True
        front = members[0]
        while len(front):
            if same:
                found = np.nonzero(mask[front].any(axis=0) & ~seen)[0]
            else:
                left, right = front[front < na], front[front >= na] - na
                hit_b = mask[left].any(axis=0) if len(left) else np.zeros(mask.shape[1], bool)
                hit_a = mask[:, right].any(axis=1) if len(right) else np.zeros(na, bool)
                found = np.nonzero(np.concatenate([hit_a, hit_b]) & ~seen)[0]
            seen[found] = True
            members.append(found)
            front = found
        group = np.concatenate(members)
        root_of[group] = group[np.argmin(ids[group])]
    keep = np.nonzero((root_of >= 0) & (root_of != np.arange(len(ids))))[0]
    yield pa.table({"a": pa.array(ids[root_of[keep]], id_type), "b": pa.array(ids[keep], id_type)})


def _labels_met(ids_a, ids_b, labels_a, labels_b, tiles, same, id_type):
    """For each row the other labels found among its partners: bounded by rows times labels."""
    names = sorted(set(labels_a) | set(labels_b))
    code = {n: k for k, n in enumerate(names)}
    la, lb = np.array([code[x] for x in labels_a], int), np.array([code[x] for x in labels_b], int)
    hit_a = np.zeros((len(ids_a), len(names)), bool)
    hit_b = np.zeros((len(ids_b), len(names)), bool)
    for start, _, m in tiles:
        rows = slice(start, start + len(m))
        for k in range(len(names)):
            hit_a[rows, k] |= m[:, lb == k].any(axis=1)
            hit_b[:, k] |= m[la[rows] == k].any(axis=0)
    out_id, out_own, out_other = [], [], []
    for ids, own, hit in ((ids_a, la, hit_a), (ids_b, lb, hit_b)):
        i, k = np.nonzero(hit)
        keep = own[i] != k
        out_id.append(ids[i[keep]])
        out_own += [names[x] for x in own[i[keep]]]
        out_other += [names[x] for x in k[keep]]
    yield pa.table({"id": pa.array(np.concatenate(out_id), id_type), "label": pa.array(out_own, pa.string()),
                    "other": pa.array(out_other, pa.string())})


def _block_join(df: DataFrame, item_id: str, vector: str, label: str | None, tau: float, strict: bool,
                reduce: Callable, schema: str, cell_rows: int, block_rows: int, max_pivots: int) -> DataFrame:
    if not tau > 0:
        raise ValueError("the similarity threshold must be positive")
    tag = F.col(label).cast("string") if label else F.lit(None).cast("string")
    base = df.select(F.col(item_id).alias("id"), F.col(vector).alias("v"), tag.alias("label"))
    pivots = choose_pivots(base, "id", "v", cell_rows, max_pivots)
    reach = math.sqrt(max(0.0, 2.0 - 2.0 * tau))
    blocks = _blocks(_cell_rows(base, pivots, reach, ["id", "v", "label"]), block_rows)

    def join(table: pa.Table) -> pa.Table:
        id_type = table.schema.field("id").type
        side = table.column("side").to_numpy()
        same = table.column("kind")[0].as_py() == "h" and table.column("x")[0].as_py() == table.column("y")[0].as_py()
        ids = table.column("id").to_numpy()
        labels = np.array(table.column("label").to_pylist(), dtype=object)
        unit = unit_rows(matrix(table.column("v")))
        a = np.ones(len(ids), bool) if same else side == 0
        b = a if same else ~a
        tiles = _tiles(unit[a], unit[b], tau, strict, same)
        found = list(reduce(ids[a], ids[b], labels[a], labels[b], tiles, same, id_type))
        return pa.concat_tables(found) if found else out_schema.empty_table()

    sample = base.select("id").schema["id"].dataType.simpleString()
    schema = schema.replace("ID", sample)
    arrow_id = pa.int64() if sample == "bigint" else pa.int32() if sample == "int" else pa.string()
    fields = [(n, {"ID": arrow_id}.get(t, pa.string() if t == "string" else pa.float64()))
              for n, t in (f.split() for f in schema.replace(sample, "ID").split(", "))]
    out_schema = pa.schema(fields)
    return blocks.groupBy("cell", "kind", "x", "y").applyInArrow(join, schema)


def similarity_self_join(df: DataFrame, tau: float, item_id: str = "item_id", vector: str = "e", strict: bool = True,
                         cell_rows: int = CELL_ROWS, block_rows: int = BLOCK_ROWS,
                         max_pivots: int = MAX_PIVOTS) -> DataFrame:
    """Every unordered pair of vectors above the threshold: (a, b, similarity, copies_a, copies_b).

    Identical vectors are one row here, with the number of copies beside it; `copy_map` names them. n of them are pairs among
    themselves as well: one row (a, a, 1.0, n, n) stands for these n (n - 1) / 2. So the result stays whole without listing the
    square of a group of identical rows.
    """
    reps = copy_representatives(df, item_id, vector)
    pairs = _block_join(reps, "rep", vector, None, tau, strict, _pairs, "a ID, b ID, similarity double",
                        cell_rows, block_rows, max_pivots)
    left = reps.select(F.col("rep").alias("a"), F.col("copies").alias("copies_a"))
    right = reps.select(F.col("rep").alias("b"), F.col("copies").alias("copies_b"))
    found = pairs.join(left, "a").join(right, "b").select("a", "b", "similarity", "copies_a", "copies_b")
    own = reps.where("copies > 1").select(F.col("rep").alias("a"), F.col("rep").alias("b"), F.lit(1.0).alias("similarity"),
                                          F.col("copies").alias("copies_a"), F.col("copies").alias("copies_b"))
    return found.unionByName(own) if tau < 1.0 or not strict else found


def connected_blocks(df: DataFrame, tau: float, item_id: str = "item_id", vector: str = "e", strict: bool = True,
                     cell_rows: int = CELL_ROWS, block_rows: int = BLOCK_ROWS, max_pivots: int = MAX_PIVOTS) -> DataFrame:
    """Edges (a, b) with the same connected parts as all pairs above the threshold, at most one per row and block."""
    return _block_join(df, item_id, vector, None, tau, strict, _stars, "a ID, b ID", cell_rows, block_rows, max_pivots)


def labels_met(df: DataFrame, tau: float, label: str, item_id: str = "item_id", vector: str = "e", strict: bool = False,
               cell_rows: int = CELL_ROWS, block_rows: int = BLOCK_ROWS, max_pivots: int = MAX_PIVOTS) -> DataFrame:
    """(id, label, other): rows with a partner under another label. Identical rows of one label count as one row."""
    reps = copy_representatives(df, item_id, vector, label)
    keyed = reps.select("rep", vector, F.col(label).cast("string").alias(label))
    met = _block_join(keyed, "rep", vector, label, tau, strict, _labels_met, "id ID, label string, other string",
                      cell_rows, block_rows, max_pivots).distinct()
    vectors = keyed.select(F.col("rep").alias("id"), F.col(label).alias("label"), F.col(vector).alias("_v"))
    hit = met.join(vectors, ["id", "label"]).select("_v", F.col("label").alias("_l"), "other")
    rows = df.select(F.col(item_id).alias("id"), F.col(vector).alias("_v"), F.col(label).cast("string").alias("_l"))
    return rows.join(hit, ["_v", "_l"]).select("id", F.col("_l").alias("label"), "other")


def cross_label_twins(df: DataFrame, tau: float, label: str, item_id: str = "item_id", vector: str = "e",
                      **sizes: int) -> tuple[DataFrame, DataFrame]:
    """(ids with a twin under another label, counts per label pair)."""
    met = labels_met(df, tau, label, item_id, vector, **sizes)
    twins = met.select(F.col("id").alias(item_id)).distinct()
    counts = met.groupBy("label", "other").agg(F.count_distinct("id").alias("n"))
    return twins, counts


def near_copy_anti_join(candidates: DataFrame, reference: DataFrame, tau: float, item_id: str = "item_id",
                        vector: str = "e", **sizes: int) -> DataFrame:
    """Candidates without any reference row above the threshold."""
    both = candidates.select(item_id, vector, F.lit("candidate").alias("_side")).unionByName(
        reference.select(item_id, vector, F.lit("reference").alias("_side")))
    met = labels_met(both, tau, "_side", item_id, vector, strict=True, **sizes)
    near = met.where("label = 'candidate'").select(F.col("id").alias(item_id)).distinct()
    return candidates.join(near, item_id, "left_anti")
