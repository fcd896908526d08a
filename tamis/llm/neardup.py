"""Near-duplicate documents: a chosen-path set similarity join on word shingles.

A document's set has its distinct shingles of five words (A-Z lower-cased). Exact copies of a set are one item. Each item has a
minwise signature of 128 tokens. The join grows trees: at a node, one random choice of BRANCHES signature places holds for
all its members, and a member goes to one child for each chosen place, named by its token there. Two sets of similarity s
agree in a place with probability s, so they share a child with 1 - (1 - s)^BRANCHES, and at any depth of one tree with at
least 0.88 for s = 0.75; TREES independent trees leave a chance of about 3e-8 to miss a pair. Nodes of at most SMALL members are
compared exhaustively; larger ones branch again until they are small, or until that no longer halves a node's comparisons. The first tree is worked off before the others, which
find most of their nodes closed then. All links are confirmed on the full sets (`linking`).

Documents are told apart by id and text, so an id with several texts is several documents.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.llm.flat import matrix, slices, text_bytes
from tamis.llm.hashing import minwise, mix, unique_runs, word_shingles
from tamis.llm.linking import SALTS, KeyFilter, Sketches, link, salted_join
from tamis.session import cut_lineage, give_back

WORDS = 5
SHARE = 75
PLACES = 128
TREES = 8
BRANCHES = 2
SMALL = 512
#: Levels beyond which a node that is still large goes to the blocks: at similarity 0.75 a chain of so many shared tokens is an equal set.
DEEPEST = 40
#: A pair needs so many equal places of 128 to be read in full: 6 standard deviations below the mean of similarity 0.75. The sketch has one byte of each
#: token, so that other sets agree in a place with 1/256, in half a place of 128 on average; equal tokens always agree.
SKETCH_LEAST = 66


def shingle_items(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, text_hash, n_shingles, set_key, signature, sketch) of (doc_id, text_hash, text): the size of the set, a 128-bit digest of it (null for an
    empty set), its signature and the lowest byte of each token."""

    def run(batches):
        for part in slices(batches):
            hashes, at = unique_runs(*word_shingles(*text_bytes(part.column("text")), words))
            tokens = minwise(hashes, at, PLACES)
            keys = _set_keys(hashes, at)
            sign, sketch = ([t.tobytes() if k is not None else None for t, k in zip(x, keys, strict=True)] for x in (tokens, tokens.astype(np.uint8)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), pa.array(np.diff(at)), pa.array(keys, pa.binary()),
                                              pa.array(sign, pa.binary()), pa.array(sketch, pa.binary())],
                                             ["doc_id", "text_hash", "n_shingles", "set_key", "signature", "sketch"])

    return docs.mapInArrow(run, "doc_id bigint, text_hash bigint, n_shingles bigint, set_key binary, signature binary, sketch binary")


def _set_keys(hashes: np.ndarray, at: np.ndarray) -> list[bytes | None]:
    raw = hashes.tobytes()
    return [hashlib.blake2b(raw[8 * a:8 * b], digest_size=16).digest() if b > a else None for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def shingle_sets(docs: DataFrame, ids: DataFrame, words: int = WORDS) -> DataFrame:
    """(id, set) for `ids` (id, doc_id, text_hash) from (doc_id, text_hash, text): the sorted hashes of the set, read again from the whole text."""
    wanted = KeyFilter(ids, "doc_id")
    shared, passes = wanted.shared, wanted.passes

    def run(batches):
        for batch in batches:
            chosen = batch.filter(pa.array(passes(shared, batch.column("place").to_numpy())))
            for part in slices(iter([chosen])):
                hashes, at = unique_runs(*word_shingles(*text_bytes(part.column("text")), words))
                raw = hashes.tobytes()
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), pa.array([raw[8 * a:8 * b] for a, b in zip(
                    at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary())], ["doc_id", "text_hash", "set"])

    some = docs.where("doc_id is not null").withColumn("place", wanted.column("doc_id"))
    read = some.mapInArrow(run, "doc_id bigint, text_hash bigint, set binary")
    return read.join(ids.hint("shuffle_hash"), ["doc_id", "text_hash"]).select("id", "set").dropDuplicates(["id"])


def _children(signatures: np.ndarray, nodes: np.ndarray, branches: int) -> np.ndarray:
    """Child keys (rows x branches) for nodes given by their 64-bit keys; the chosen places depend on the node alone."""
    out = np.zeros((len(nodes), branches), np.uint64)
    for b in range(branches):
        place = (mix(nodes + np.uint64((b + 1) * 0xA24BAED4963EE407 % (1 << 64))) % np.uint64(PLACES)).astype(np.int64)
        token = signatures[np.arange(len(nodes)), place].astype(np.uint64)
        out[:, b] = mix(mix(nodes + np.uint64(b + 1)) ^ (token << np.uint64(8) | place.astype(np.uint64)))
    return out


def _grow(rows: DataFrame, trees: range | None, branches: int = BRANCHES) -> DataFrame:
    """(node, id, parent) of the children of (id, signature, node), or (node, id) of the roots of `trees` for (id, signature)."""

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            signatures = matrix(batch.column("signature"), np.uint32)
            if trees is not None:
                keys = np.concatenate([_children(signatures, np.full(n, mix(np.array([t + 1], np.uint64))[0]), branches)
                                       for t in trees], axis=1)
            else:
                nodes = batch.column("node").to_numpy()
                keys = _children(signatures, nodes.view(np.uint64), branches)
            ids = np.repeat(batch.column("id").to_numpy(), keys.shape[1])
            more = [] if trees is not None else [pa.array(np.repeat(nodes, keys.shape[1]))]
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(ids), *more], ["node", "id", "parent"][:2 + len(more)])

    return rows.mapInArrow(run, "node bigint, id bigint" + (", parent bigint" if trees is None else ""))


def _shared_only(members: DataFrame) -> DataFrame:
    """Members of nodes with two or more."""
    sizes = members.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("node")
    return salted_join(members, sizes, "node", "id", salts=4).distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, share: int = SHARE) -> DataFrame:
    """(doc_id, text_hash, n_shingles, component_id, kept): documents linked by 100 * intersection >= share * union, directly or over others,
    have the smallest of their ids as component; that one is kept.

    A null or empty text, or one without words, has an empty set and no links; one with fewer than `words` words is one shingle.
    Rows with a null id come back with a null component and are kept. Equal rows (id, text) are one row of the result; an id
    with several texts has a row for each, told apart by text_hash, and one of them is kept in each component. Other columns are left out."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).withColumn("text_hash", text_hash("text"))
    found = cut_lineage(shingle_items(rows.select("doc_id", "text_hash", "text"), words))
    known = found.where("doc_id is not null").select("doc_id", "text_hash", "n_shingles", "set_key", "signature", "sketch")
    sets = known.where("set_key is not null")
    own = F.struct("doc_id", "text_hash")
    items = cut_lineage(sets.groupBy("set_key").agg(F.min(own).alias("own"), F.count(F.lit(1)).alias("copies"), F.first("signature").alias("signature"),
                                                    F.first("sketch").alias("sketch")).withColumn("id", F.col("own.doc_id")))
    # an item is named by its document; where that has several texts, the others are named by a hash
    again = items.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("own.text_hash").alias("first")).where("n > 1").select("id", "first")
    if not again.isEmpty():
        other = F.col("first").isNotNull() & (F.col("first") != F.col("own.text_hash"))
        items = cut_lineage(items.join(again, "id", "left").withColumn("id", F.when(other, F.xxhash64("own")).otherwise(F.col("id"))).drop("first"))
    signatures = items.select("id", "signature")
    names = items.select("id", "own.doc_id", "own.text_hash")

    def split(members: DataFrame) -> DataFrame | None:
        """Descendants in place of each node, as long as those of a level halve its comparisons; near copies share most tokens, and their nodes stay."""
        done, current = None, members.select("node", "id")
        for _ in range(DEEPEST):
            children = cut_lineage(_grow(current.join(signatures, "id"), None))
            sizes = children.groupBy("parent", "node").agg(F.count(F.lit(1)).alias("n"))
            size = F.col("n").cast("double")
            work = sizes.groupBy("parent").agg(F.sum(F.when(F.col("n") > 1, size * size).otherwise(0.0)).alias("work")).join(
                current.groupBy(F.col("node").alias("parent")).agg(F.count(F.lit(1)).cast("double").alias("whole")), "parent")
            halved = cut_lineage(work.where("2 * work <= whole * whole").select("parent"))
            if halved.isEmpty():
                break
            # a node above SMALL stays where its children save too little, or branches again
            kept = salted_join(current, halved.withColumnRenamed("parent", "node"), "node", "id", "left_anti", salts=4)
            finer = salted_join(children, sizes.join(halved, "parent").where("n > 1").select("node", "n"), "node", "id", salts=4)
            settled = finer.where(F.col("n") <= SMALL).select("node", "id").unionByName(kept)
            done = cut_lineage(settled if done is None else done.unionByName(settled))
            current = cut_lineage(finer.where(F.col("n") > SMALL).select("node", "id"))
            give_back(children, halved)
            if current.isEmpty():
                return done
        return done.unionByName(current) if done is not None else None

    trees = [cut_lineage(_shared_only(_grow(signatures, t))) for t in (range(1), range(1, TREES))]
    components = link(trees, lambda ids: shingle_sets(rows, names.join(ids, "id", "left_semi"), words), share, split, SMALL,
                      Sketches(items.select("id", F.col("sketch").alias("signature")), SKETCH_LEAST, "u1"))
    # from items back to documents: only sets with copies or links
    named = items.select("set_key", "id", "own", "copies").join(components.select(F.col("node").alias("id"), "component"), "id", "left").where(
        "copies > 1 or component is not null").withColumn("component", F.coalesce("component", "id"))
    keepers = named.groupBy("component").agg(F.min("own").alias("keeper"))
    moved = salted_join(named.select("set_key", "component"), keepers, "component", "set_key").select("set_key", "keeper")
    linked = salted_join(sets.select("doc_id", "text_hash", "n_shingles", "set_key"), moved, "set_key", "doc_id", "left", SALTS)
    whole = linked.select("doc_id", "text_hash", "n_shingles", F.coalesce("keeper.doc_id", "doc_id").alias("component_id"),
                          (F.col("keeper").isNull() | (F.col("keeper") == own)).alias("kept"))
    alone = known.where("set_key is null").select("doc_id", "text_hash", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    lost = found.where("doc_id is null").select("doc_id", "text_hash", "n_shingles", F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept"))
    # equal rows (id, text) come once; rows with a null id are documents of their own
    return whole.unionByName(alone).dropDuplicates(["doc_id", "text_hash"]).unionByName(lost)


def text_hash(text: str):
    """Tells the texts of one id apart; a null text is a text of its own."""
    return F.xxhash64(F.coalesce(text, F.lit("")), F.col(text).isNull())


def without_copies(docs: DataFrame, found: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` without the documents that `found` (from `near_duplicates`) doesn't keep; of equal rows (id, text) all stay or all go."""
    gone = found.where("not kept").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_text"))
    return docs.join(gone, (F.col(doc_id).cast("long") == F.col("_id")) & (text_hash(text) == F.col("_text")), "left_anti").select(docs.columns)
