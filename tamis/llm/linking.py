"""Links inside candidate nodes, verified on full sets, and the components they make.

A node is a group of items that share a key. Comparing all pairs of a node would grow with the square of its size, so a node is
first compared with its smallest member (a large one with a few more), and what links is merged into components. A node whose
members all lie in one component can add nothing. In the nodes that are left, only members outside the node's major component
count: they are compared with a few other members drawn anew, as long as that closes nodes, and what remains is compared with all others
in blocks of bounded size and inside tasks. Nodes with the same open members are one node. Pairs are never listed.
Small blocks share a call, since a call for each would cost more than the comparison.

Candidate nodes may come in stages (trees, say): what one stage has linked needs no comparison in the next.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.llm.flat import matrix
from tamis.llm.hashing import overlap, overlaps
from tamis.operators.components import connected_components
from tamis.session import cut_lineage, give_back, next_table

FILTER_BITS = 1 << 25
BLOCK = 256
SKETCH_BLOCK = 2048  # sketches are short and of one length, so blocks of them can be larger than those of sets
STEP = 32  # sets that one is compared with at once
PIVOTS = 3
TURNS = 2
FEW = 64  # members outside the major components that go to the blocks at once
SetsOf = Callable[[pa.Array], list[np.ndarray]]
SALTS = 16
_BUCKET = 32768  # bits of one row that bitmap_construct_agg makes


class KeyFilter:
    """A bitmap of fixed size over hashed keys, for leaving out most rows of a scan that a later join would drop. The join stays:
    as the bitmap fills up it lets more rows pass, and the result is the same. `hashed`: the keys are hashes already."""

    def __init__(self, keys: DataFrame, key: str, hashed: bool = False, bits: int = FILTER_BITS):
        self.bits, self.hashed = bits, hashed
        place = self.column(key)
        rows = (keys.select(place.alias("p")).select((F.col("p") / _BUCKET).cast("int").alias("b"), F.pmod("p", F.lit(_BUCKET)).alias("i"))
                .groupBy("b").agg(F.bitmap_construct_agg("i").alias("m")).collect())  # bits / 32768 rows of 4 KB at most
        table = np.zeros((bits // _BUCKET, _BUCKET // 8), np.uint8)
        for r in rows:
            table[r.b] = np.frombuffer(r.m, np.uint8)
        self.shared = keys.sparkSession.sparkContext.broadcast(table.reshape(-1))

    def column(self, key: str):
        """The place of a key, to be computed by Spark and handed to `passes`; of hashed keys it is the key modulo `bits`."""
        return F.pmod(F.col(key) if self.hashed else F.xxhash64(F.col(key)), F.lit(self.bits))

    @staticmethod
    def passes(shared, places: np.ndarray) -> np.ndarray:
        return (shared.value[places >> 3] >> (places & 7).astype(np.uint8) & 1).astype(bool)


def salted_join(left: DataFrame, right: DataFrame, key: str, spread: str, how: str = "inner", salts: int = SALTS) -> DataFrame:
    """left join right on `key`, with the rows of a hot key of `left` dealt over `salts` tasks by the column `spread`."""
    wide = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = left.withColumn("_salt", F.pmod(F.xxhash64(F.col(spread)), F.lit(salts)).cast("int"))
    return dealt.join(wide, [key, "_salt"], how).drop("_salt")


def similar(a: np.ndarray, b: np.ndarray, share: int) -> bool:
    """100 * intersection >= share * union."""
    if min(len(a), len(b)) * 100 < share * max(len(a), len(b)):
        return False
    both = overlap(a, b)
    return both > 0 and 100 * both >= share * (len(a) + len(b) - both)


def stored_sets(column: pa.Array) -> list[np.ndarray]:
    """Sets that are stored as sorted 64-bit hashes."""
    return [np.frombuffer(x.as_buffer(), np.uint64) for x in column]


def verify(pairs: DataFrame, sets: DataFrame, share: int, sets_of: SetsOf = stored_sets) -> DataFrame:
    """Those of `pairs` (a, b) whose sets (id, set) are similar."""

    def check(batches):
        for whole in batches:
            for first in range(0, whole.num_rows, 1000):
                batch = whole.slice(first, 1000)
                ok = [similar(p, q, share) for p, q in zip(sets_of(batch.column("sa")), sets_of(batch.column("sb")), strict=True)]
                yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    kind = pairs.schema["a"].dataType.simpleString()
    both = (pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("sa")), "a")
            .join(sets.select(F.col("id").alias("b"), F.col("set").alias("sb")), "b").select("a", "b", "sa", "sb"))
    return both.mapInArrow(check, f"a {kind}, b {kind}")


def node_stars(members: DataFrame, small: int, pivots: int = PIVOTS) -> DataFrame:
    """Distinct (a, b), a > b: each member (node, id, component) of a node with the node's smallest one, and in nodes above `small` with
    a few others drawn by hash, where their components differ."""
    row = F.struct("id", "component")
    least = members.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min(row).alias("m"), *[
        F.min_by(row, F.xxhash64("id", F.lit(k))).alias(f"m{k}") for k in range(pivots)])
    chosen = F.array_distinct(F.when(F.col("n") > small, F.array("m", *[f"m{k}" for k in range(pivots)])).otherwise(F.array("m")))
    stars = least.where("n > 1").select("node", chosen.alias("pivots"))
    pairs = salted_join(members, stars, "node", "id").select("id", "component", F.explode("pivots").alias("p")).where(
        "component <> p.component")
    return pairs.select(F.greatest("id", "p.id").alias("a"), F.least("id", "p.id").alias("b")).distinct()


def with_components(members: DataFrame, components: DataFrame) -> DataFrame:
    """members with the component of each id; an id without links, or without a row, is its own."""
    return members.join(components.select(F.col("node").alias("id"), "component"), "id", "left").withColumn(
        "component", F.coalesce("component", "id"))


def open_nodes(members: DataFrame) -> DataFrame:
    """(node, size, major, minors) of the nodes whose members (node, id, component) lie in more than one component: the component with
    most members, and how many lie outside it. Two members have met in the star of their node, so such nodes are done."""
    parts = members.groupBy("node", "component").agg(F.count(F.lit(1)).alias("n"))
    nodes = parts.groupBy("node").agg(F.sum("n").alias("size"), F.max_by("component", F.struct("n", "component")).alias("major"), F.max("n").alias("most"))
    return nodes.where("size > most and size > 2").select("node", "size", "major", (F.col("size") - F.col("most")).alias("minors"))


def open_members(members: DataFrame, components: DataFrame) -> DataFrame:
    """The members (node, id) of open nodes with component, size, major and minors, as a table. Of nodes with the same members one is kept."""
    marked = with_components(members.select("node", "id"), components)
    waiting = cut_lineage(salted_join(marked, open_nodes(marked), "node", "id"))
    same = waiting.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("id")).alias("x"), F.sum(F.xxhash64("id", F.lit(1)).cast("decimal(38)")).alias("y"))
    kept = same.groupBy("n", "x", "y").agg(F.min("node").alias("node")).select("node")
    return next_table(waiting, salted_join(waiting, kept, "node", "id", salts=4))


def minor_stars(waiting: DataFrame, turn: int, pivots: int = PIVOTS) -> DataFrame:
    """Distinct (a, b), a > b: the members of open nodes outside the major component, each with members of it and one of the others, drawn by hash
    for this turn."""
    row, outside = F.struct("id", "component"), F.col("component") != F.col("major")
    drawn = [F.min_by(F.when(~outside, row), F.when(~outside, F.xxhash64("id", F.lit(turn * 10 + k)))).alias(f"m{k}") for k in range(pivots)]
    drawn.append(F.min_by(F.when(outside, row), F.when(outside, F.xxhash64("id", F.lit(turn * 10 + 9)))).alias("m9"))
    stars = waiting.groupBy("node").agg(*drawn).select("node", F.array_distinct(F.array(*[f"m{k}" for k in (*range(pivots), 9)])).alias("pivots"))
    pairs = salted_join(waiting.where(outside).select("node", "id", "component"), stars, "node", "id").select("id", "component", F.explode("pivots").alias("p")).where(
        "component <> p.component")
    return pairs.select(F.greatest("id", "p.id").alias("a"), F.least("id", "p.id").alias("b")).distinct()


@dataclass(frozen=True)
class Sketches:
    """Minwise signatures (id, signature). Similar sets agree in `least` places or more, but for a negligible chance."""

    table: DataFrame
    least: int
    dtype: str = "u4"

    def plausible(self, pairs: DataFrame) -> DataFrame:
        """Those of `pairs` (a, b) that can be similar."""
        least, dtype = self.least, self.dtype

        def run(batches):
            for batch in batches:
                if batch.num_rows:
                    x, y = (matrix(batch.column(c), dtype) for c in ("x", "y"))
                    yield batch.select(["a", "b"]).filter(pa.array((x == y).sum(axis=1) >= least))

        kind = pairs.schema["a"].dataType.simpleString()
        both = pairs.join(self.table.select(F.col("id").alias("a"), F.col("signature").alias("x")), "a").join(
            self.table.select(F.col("id").alias("b"), F.col("signature").alias("y")), "b")
        return both.select("a", "b", "x", "y").mapInArrow(run, f"a {kind}, b {kind}")

    def with_partner(self, rows: DataFrame, calls: int, block: int) -> DataFrame:
        """Those of `rows` (node, x, y, id, component, minor, signature) that can be similar to one of another component on the other side of
        the same (node, x, y), in smaller cells (u, v) of at most `block` on a side and `n` rows. `at` numbers the others of a cell, `near` has
        a bit for each of them that a minor one can be similar to."""
        least, dtype = self.least, self.dtype

        def run(table: pa.Table) -> pa.Table:
            signs, minor = matrix(table.column("signature"), dtype), table.column("minor").to_numpy()
            _, part = np.unique(table.column("component").to_numpy(), return_inverse=True)
            counts = np.min_scalar_type(signs.shape[1])
            rows, places, bits = [], [], []
            for cell in _cells(table, ["node", "x", "y"]):
                left, right = cell[~minor[cell]], cell[minor[cell]]
                others = np.ascontiguousarray(signs[left].T)
                near = np.zeros((len(right), len(left)), bool)
                for k, i in enumerate(right.tolist()):
                    near[k] = np.add.reduce((others == signs[i][:, None]).view(np.uint8), axis=0, dtype=counts) >= least
                    near[k] &= part[left] != part[i]
                l, r = np.flatnonzero(near.any(axis=0)), np.flatnonzero(near.any(axis=1))
                for u in range(0, len(l), block):
                    for v in range(0, len(r), block):
                        some = near[np.ix_(r[v:v + block], l[u:u + block])]
                        p, q = np.flatnonzero(some.any(axis=0)), np.flatnonzero(some.any(axis=1))
                        if not len(p):
                            continue
                        rows += [left[l[u + p]], right[r[v + q]]]
                        places.append(np.zeros((len(p) + len(q), 4), np.int32) + np.array([u, v, 0, len(p) + len(q)], np.int32))
                        places[-1][:len(p), 2] = np.arange(len(p))
                        bits += [None] * len(p) + [x.tobytes() for x in np.packbits(some[np.ix_(q, p)], axis=1)]
            at = np.concatenate(places) if places else np.zeros((0, 4), np.int32)
            out = table.drop_columns(["signature", "call"]).take(pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64)))
            for k, name in enumerate(["u", "v", "at", "n"]):
                out = out.append_column(name, pa.array(at[:, k]))
            return out.append_column("near", pa.array(bits, pa.binary()))

        fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "signature")
        return rows.withColumn("call", F.pmod(F.xxhash64("node", "x", "y"), F.lit(calls))).groupBy("call").applyInArrow(
            run, f"{fields}, u int, v int, at int, n int, near binary")


def _cells(table: pa.Table, keys: list[str]) -> list[np.ndarray]:
    """The row numbers of each cell, a cell being the rows with the same keys."""
    columns = [np.unique(table.column(k).to_numpy(), return_inverse=True)[1] for k in keys]
    order = np.lexsort(columns)
    changes = np.any([np.diff(c[order]) != 0 for c in columns], axis=0)
    return np.split(order, np.flatnonzero(changes) + 1)


def compare_blocks(members: DataFrame, load_sets: Callable[[DataFrame], DataFrame], share: int, block: int = BLOCK,
                   sketches: Sketches | None = None, sets_of: SetsOf = stored_sets) -> DataFrame:
    """Links (a, b) between members (node, id, component, size, major, minors) of different components of a node, verified on sets.

    All members of a node meet those outside its major component. Both sides are cut into blocks by hash, and a task sees one block
    of each. Of all links between two components one is enough, so a pair that the task has already joined isn't compared. Sets
    are read only for members that have a plausible partner."""
    kind = members.schema["id"].dataType.simpleString()
    side, keys = (max(block, SKETCH_BLOCK), ["node", "x", "y", "u", "v"]) if sketches else (block, ["node", "x", "y"])
    cells = {n: F.ceil(F.col(c) / side).cast("int") for n, c in (("nx", "size"), ("ny", "minors"))}
    own = members.withColumns(cells).withColumns({n: F.pmod(F.xxhash64("id"), F.col(f"n{n}")).cast("int") for n in ("x", "y")})
    if sketches:  # before the rows are repeated for the blocks
        own = own.join(sketches.table, "id")
    left = F.transform(F.sequence(F.lit(0), F.col("ny") - 1), lambda y: F.struct("x", y.alias("y"), F.lit(False).alias("minor")))
    right = F.transform(F.sequence(F.lit(0), F.col("nx") - 1), lambda x: F.struct(x.alias("x"), "y", F.lit(True).alias("minor")))
    both = F.when(F.col("component") != F.col("major"), F.concat(left, right)).otherwise(left)
    rows = own.select("node", "id", "component", *(["signature"] if sketches else []), F.explode(both).alias("cell")).select("node", "cell.*", "id", "component", *(
        ["signature"] if sketches else []))
    if sketches:
        rows = cut_lineage(sketches.with_partner(rows, members.count() // SKETCH_BLOCK + 1, block))
        few = F.pmod(F.xxhash64(*keys), F.lit(rows.count() // block + 1))
        rows = rows.withColumn("call", F.when(F.col("n") * 4 > block, F.xxhash64(*keys)).otherwise(few))  # sets of a large cell alone
    else:
        rows = rows.withColumn("call", F.xxhash64(*keys))
    rows = rows.join(load_sets(rows.select("id").distinct()), "id")

    def compare(table: pa.Table) -> pa.Table:
        ids, minor = table.column("id").to_pylist(), table.column("minor").to_numpy()
        _, part = np.unique(table.column("component").to_numpy(), return_inverse=True)
        have = sets_of(table.column("set").combine_chunks())
        sizes = np.fromiter(map(len, have), np.int64, len(have))
        found = []
        for cell in _cells(table, keys):
            left, right = cell[~minor[cell]], cell[minor[cell]]
            near = np.ones((len(right), len(left)), bool)
            if "near" in table.column_names and near.size:
                near = np.unpackbits(matrix(table.column("near").take(pa.array(right)), np.uint8), axis=1)[:, table.column("at").to_numpy()[left]].astype(bool)
            for row, i in enumerate(right.tolist()):
                size = sizes[left]
                waiting = left[near[row] & (np.minimum(size, sizes[i]) * 100 >= share * np.maximum(size, sizes[i]))]
                while len(waiting := waiting[part[waiting] != part[i]]):
                    some, waiting = waiting[:STEP], waiting[STEP:]
                    both = overlaps(have[i], [have[j] for j in some])
                    for j in some[(both > 0) & (100 * both >= share * (sizes[some] + sizes[i] - both))].tolist():
                        if part[j] != part[i]:
                            part[part == part[j]] = part[i]
                            found.append((ids[i], ids[j]))
        return pa.table({"a": pa.array([a for a, _ in found], table.schema.field("id").type),
                         "b": pa.array([b for _, b in found], table.schema.field("id").type)})

    return rows.groupBy("call").applyInArrow(compare, f"a {kind}, b {kind}")


def link(members: DataFrame | list[DataFrame], load_sets: Callable[[DataFrame], DataFrame], share: int,
         split: Callable[[DataFrame], DataFrame | None] | None = None, small: int = BLOCK,
         sketches: Sketches | None = None, sets_of: SetsOf = stored_sets) -> DataFrame:
    """(node, component) of all items that have a link, from the members (node, id) of candidate nodes, in one or more stages.

    `load_sets(ids)` gives (id, set) for a table of distinct ids; `sets_of` makes sets of that column. `sketches` spare the reading of sets that can't be similar.
    `split(members)` may give the members of finer nodes in place of open nodes with more than `small`^2 comparisons, or None; a node that it can't
    split it gives back. What is left is compared in blocks."""
    stages = members if isinstance(members, list) else [members]
    spark = stages[0].sparkSession
    kind = stages[0].schema["id"].dataType.simpleString()
    components, joined = spark.createDataFrame([], f"node {kind}, component {kind}"), 0  # without the smallest nodes of components

    def merge(new: DataFrame) -> bool:
        nonlocal components, joined
        new = cut_lineage(new)
        links = new.count()
        if links:
            before = components
            stars = before.select(F.col("node").alias("a"), F.col("component").alias("b"))  # what is joined is one edge a node
            components = connected_components(stars.unionByName(new), rows=joined + links, roots=False)
            joined = components.count()
            give_back(before)
        give_back(new)
        return links > 0

    def compare(stars: DataFrame) -> bool:
        pairs = cut_lineage(sketches.plausible(stars) if sketches else stars)
        linked = not pairs.isEmpty() and merge(verify(pairs, load_sets(_ids(pairs)), share, sets_of))
        give_back(pairs)
        return linked

    def settle(members: DataFrame, pivots: int = PIVOTS, turns: int = TURNS) -> DataFrame:
        compare(node_stars(with_components(members, components), small, pivots))
        waiting = open_members(members, components)
        before = None
        for turn in range(turns):
            outside = waiting.where("component <> major").count()
            if outside <= FEW or before is not None and outside > 0.8 * before or not compare(minor_stars(waiting, turn)):
                break
            before = outside
            waiting = next_table(waiting, open_members(waiting, components))
        return waiting

    left = None
    for stage in stages:
        waiting = settle(stage)
        many = F.col("size") * F.col("minors") > small * small
        large = waiting.where(many)
        finer = split(large) if split and not large.isEmpty() else None
        parts = [waiting] if finer is None else [waiting.where(~many), settle(finer, 0, 0)]
        for part in parts:
            left = part if left is None else left.unionByName(part.select(left.columns))
    left = open_members(left, components)  # links found on finer nodes and in later stages may have closed some
    if not left.isEmpty():
        merge(compare_blocks(left, load_sets, share, sketches=sketches, sets_of=sets_of))
    return components.unionByName(components.select(F.col("component").alias("node"), "component").distinct())


def _ids(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
