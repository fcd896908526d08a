"""Fuzzy line deduplication: one line of each group of near-equal lines stays in the corpus.

A line is what stands between line feeds, without ASCII white space at its ends; a line with nothing left takes no part. Equal
lines are one item, named by a 64-bit hash of the line (two different lines of n share a name with probability n^2 / 2^65). Its
set has the distinct 5-character shingles, or the line itself where it is shorter. BANDS x ROWS minwise values are banded; lines
that share a band are candidates, links are confirmed by exact Jaccard similarity, and a distributed union-find gives the
components (`linking`). The first line of a component by (doc_id, line number) is kept.

With 16 bands of 5 rows a pair of similarity 0.8 is missed with probability 0.002, one of 0.9 with 5e-7.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.llm.flat import free_name, matrix, slices
from tamis.llm.hashing import minwise, mix, unique_runs, windows
from tamis.llm.linking import KeyFilter, Sketches, link, salted_join
from tamis.llm.neardup import text_hash
from tamis.session import cut_lineage

CHARACTERS = 5
SHARE = 80
BANDS, ROWS = 16, 5
#: A pair is read in full when it has so many equal values of 80: 5 standard deviations below the mean of similarity 0.8.
SKETCH_LEAST = 46
_BLANK = b" \t\v\f\r"


def _lines(column: pa.Array):
    """(row, number in its text, line) of all lines that aren't blank."""
    for row, text in enumerate(column.cast(pa.binary()).to_pylist()):
        if text:
            for number, line in enumerate(text.split(b"\n")):
                line = line.strip(_BLANK)
                if line:
                    yield row, number, line


def _name(line: bytes) -> int:
    """64-bit hash as a signed number."""
    h = xxhash.xxh3_64_intdigest(line)
    return h - (1 << 64) if h >> 63 else h


def _shingles(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets) of the character shingles of each line, with repeats."""
    texts = [x.decode("utf-8", "replace") for x in lines]
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    offsets = np.concatenate(([0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))))
    return windows(points.astype(np.uint64) + np.uint64(1), offsets, CHARACTERS)


def shingle_sets(lines: pa.Array) -> list[np.ndarray]:
    """The set of each line."""
    hashes, at = unique_runs(*_shingles(lines.to_pylist()))
    return [hashes[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def line_places(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, line, id) of (doc_id, text_hash, text): one row per line that isn't blank."""

    def run(batches):
        for part in slices(batches):
            found = [(row, number, _name(line)) for row, number, line in _lines(part.column("text"))]
            rows, numbers, names = zip(*found, strict=True) if found else ((), (), ())
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("doc_id").take(at), part.column("text_hash").take(at), pa.array(numbers, pa.int32()),
                                              pa.array(names, pa.int64())], ["doc_id", "text_hash", "line", "id"])

    return docs.mapInArrow(run, "doc_id bigint, text_hash bigint, line int, id bigint")


def line_items(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, line, id, copies, signature) of (doc_id, text_hash, text): one row per distinct line of a slice of texts, at its first place
    there by (doc_id, text_hash, line). The signature has the low 16 bits of BANDS x ROWS minwise values."""

    def run(batches):
        for part in slices(batches):
            ids, kinds = part.column("doc_id").to_pylist(), part.column("text_hash").to_pylist()
            first: dict[int, tuple] = {}  # by name: place, with null ids first
            count: dict[int, int] = {}
            text: dict[int, bytes] = {}
            for row, number, line in _lines(part.column("text")):
                name, place = _name(line), (ids[row] is not None, ids[row] or 0, kinds[row], number)
                if name not in first:
                    first[name], count[name], text[name] = place, 1, line
                else:
                    count[name] += 1
                    first[name] = min(first[name], place)
            if not first:
                continue
            tokens = minwise(*_shingles(list(text.values())), BANDS * ROWS).astype(np.uint16)
            signs = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * BANDS * ROWS), len(first), [None, pa.py_buffer(tokens)])
            yield pa.RecordBatch.from_arrays([
                pa.array([p[1] if p[0] else None for p in first.values()], pa.int64()), pa.array([p[2] for p in first.values()], pa.int64()),
                pa.array([p[3] for p in first.values()], pa.int32()),
                pa.array(list(first), pa.int64()), pa.array(list(count.values()), pa.int64()), signs.cast(pa.binary())],
                ["doc_id", "text_hash", "line", "id", "copies", "signature"])

    return docs.mapInArrow(run, "doc_id bigint, text_hash bigint, line int, id bigint, copies bigint, signature binary")


def line_texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, set) of the lines named in `ids`, read again from the texts; `set` is the line itself, see `shingle_sets`."""
    wanted = KeyFilter(ids, "id", hashed=True)
    shared, bits = wanted.shared, wanted.bits

    def run(batches):
        for part in slices(batches):
            seen = {_name(line): line for _, _, line in _lines(part.column("text"))}
            names = np.fromiter(seen, np.int64, len(seen))
            ok = KeyFilter.passes(shared, names % bits)
            yield pa.RecordBatch.from_arrays([pa.array(names[ok]), pa.array([x for x, k in zip(seen.values(), ok.tolist(), strict=True) if k], pa.binary())],
                                             ["id", "set"])

    found = docs.mapInArrow(run, "id bigint, set binary")
    return found.join(ids.hint("shuffle_hash"), "id", "left_semi").dropDuplicates(["id"])


def line_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", share: int = SHARE) -> DataFrame:
    """(doc_id, text_hash, line, component_id, kept) of every line that isn't blank, lines numbered from 0 within a text.

    Lines linked by a Jaccard similarity of at least share / 100, directly or over others, have one component_id, the smallest name
    of its lines; `kept` is true for the first by (doc_id, line), null ids first. Null and empty texts have no lines. Rows with a
    repeated id and text are repeated in the result, each line of them with the same decision; the texts of one id are told apart by text_hash.
    Other columns are left out."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).withColumn("text_hash", text_hash("text"))
    place = F.struct("doc_id", "text_hash", "line")
    # one row per distinct line; a line of a third of all rows is combined before the shuffle
    items = cut_lineage(line_items(rows).groupBy("id").agg(F.min(place).alias("first"), F.sum("copies").alias("copies"),
                                                           F.first("signature").alias("signature")))
    members = cut_lineage(_candidates(items))
    components = link(members, lambda ids: line_texts(rows, ids), share, sketches=Sketches(items.select("id", "signature"), SKETCH_LEAST, "u2"),
                      sets_of=shingle_sets)
    named = items.select("id", "first", "copies").join(components.select(F.col("node").alias("id"), "component"), "id", "left")
    linked = named.where("component is not null")
    first = linked.groupBy("component").agg(F.min("first").alias("first"))
    moved = salted_join(linked.select("id", "component"), first, "component", "id").select("id", "component", "first").unionByName(
        named.where("component is null and copies > 1").select("id", F.col("id").alias("component"), "first"))
    out = salted_join(line_places(rows), cut_lineage(moved), "id", "doc_id", "left")
    return out.select("doc_id", "text_hash", "line", F.coalesce("component", "id").alias("component_id"),
                      (F.col("first").isNull() | F.col("first").eqNullSafe(place)).alias("kept"))


def _candidates(items: DataFrame) -> DataFrame:
    """(node, id): the bands that two or more items share. Band keys are counted first, which needs no ids; then only the rows of
    shared keys are dealt out."""
    keys = _band_rows(items.select("id", "signature"), None)
    shared = cut_lineage(keys.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("node"))
    some = _band_rows(items.select("id", "signature"), KeyFilter(shared, "node", hashed=True))
    return some.join(shared.hint("shuffle_hash"), "node", "left_semi")


def _band_rows(items: DataFrame, wanted: KeyFilter | None) -> DataFrame:
    shared, bits = (wanted.shared, wanted.bits) if wanted else (None, 1)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                tokens = matrix(batch.column("signature"), np.uint16).reshape(-1, BANDS, ROWS).astype(np.uint64)
                keys = np.zeros(tokens.shape[:2], np.uint64) + np.arange(BANDS, dtype=np.uint64)
                for r in range(ROWS):
                    keys = keys << np.uint64(1) ^ mix(tokens[:, :, r] + np.uint64(r << 16 | 1 << 32))
                keys = mix(keys).reshape(-1).view(np.int64)
                ids = np.repeat(batch.column("id").to_numpy(), BANDS)
                if shared is not None:
                    ok = KeyFilter.passes(shared, keys % bits)
                    keys, ids = keys[ok], ids[ok]
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(ids)], ["node", "id"])

    return items.mapInArrow(run, "node bigint, id bigint")


def without_repeats(docs: DataFrame, groups: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` without the lines that `groups` (from `line_groups`) doesn't keep. A document whose every line with content goes is left
    out: all of it stands elsewhere. Documents that lose no line stay as they are, rows with a null id as well."""
    key, kind, gone = (free_name(docs.columns, n) for n in ("_doc", "_kind", "_gone"))
    lost = groups.where("not kept and doc_id is not null").groupBy(F.col("doc_id").alias(key), F.col("text_hash").alias(kind)).agg(F.collect_set("line").alias(gone))
    rows = docs.join(lost, (F.col(doc_id) == F.col(key)) & (text_hash(text) == F.col(kind)), "left")
    rest = F.array_join(F.filter(F.split(F.col(text), "\n", -1), lambda x, i: ~F.array_contains(gone, i)), "\n")
    cut = rows.withColumn(text, F.when(F.col(gone).isNull(), F.col(text)).otherwise(rest))
    return cut.where(F.col(gone).isNull() | F.col(text).rlike("[^\\x20\\x09-\\x0D]")).select(docs.columns)
