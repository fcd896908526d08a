"""Best-two-fit packing of tokenised documents into sequences of a fixed length.

Documents longer than a sequence are cut into full pieces from the end, so only the first piece may be shorter; full pieces are
sequences of their own. The other pieces are dealt by hash into groups of a bounded number of tokens and packed group by group:
a sequence is filled greedily with the longest piece that fits; then its smallest piece is replaced by two unpacked ones that
fit the widened gap more tightly, as long as that helps. A group has thousands of sequences, so packing apart costs at most
about one sequence in two thousand.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.llm.flat import slices, text_bytes
from tamis.llm.tokens import byte_tokens
from tamis.session import cut_lineage

VOCABULARY = "byte_bpe_50k.json"
LENGTH = 2048
END_ID = 0
GROUP_TOKENS = 4 << 20


def token_pieces(docs: DataFrame, length: int = LENGTH, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text",
                 vocabulary: str = VOCABULARY, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): the tokens of every whole text and the end id, cut to `length`.

    A null or empty text is the end id alone. `ids_crc32` is of the ids as little-endian unsigned 32-bit numbers, `ids` those bytes."""

    def run(batches):
        coder = byte_tokens(vocabulary)
        for part in slices(batches):
            ids, at = coder.encode(*text_bytes(part.column("text")))
            at = at + np.arange(len(at))
            body = np.full(int(at[-1]), end_id, "<u4")
            inside = np.ones(len(body), bool)
            inside[at[1:] - 1] = False
            body[inside] = ids
            sizes = np.diff(at)
            n = -(-sizes // length)
            row = np.repeat(np.arange(len(sizes)), n)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            first = sizes - (n - 1) * length
            start = np.where(piece == 0, 0, first[row] + (piece - 1) * length)
            size = np.where(piece == 0, first[row], length)
            raw = body.tobytes()
            begin = ((at[:-1][row] + start) * 4).tolist()
            end = ((at[:-1][row] + start + size) * 4).tolist()
            crc = [zlib.crc32(raw[a:b]) for a, b in zip(begin, end, strict=True)]
            columns = [part.column("doc_id").take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(size),
                       pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array([raw[a:b] for a, b in zip(begin, end, strict=True)], pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint"
    return rows.mapInArrow(run, schema + (", ids binary" if with_ids else ""))


def best_two_fit(lengths: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) for each length (1..room). Pieces of one length are alike, so the search runs over distinct lengths."""
    n = len(lengths)
    order = np.argsort(lengths, kind="stable")
    sizes, first, count = np.unique(lengths[order], return_index=True, return_counts=True)
    stock = {int(s): order[f:f + c].tolist() for s, f, c in zip(sizes, first, count, strict=True)}
    have = [int(s) for s in sizes]  # distinct lengths that are left, ascending
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)

    def take(size: int) -> int:
        rows = stock[size]
        row = rows.pop()
        if not rows:
            del have[bisect_right(have, size) - 1]
        return row

    def give(size: int, row: int) -> None:
        if not stock[size]:
            insort(have, size)
        stock[size].append(row)

    number = 0
    while have:
        packed: list[tuple[int, int]] = []
        gap = room
        while gap and have:
            k = bisect_right(have, gap)
            if not k:
                break
            size = have[k - 1]
            packed.append((size, take(size)))
            gap -= size
        while gap and have:
            small = min(packed)
            pair = _tightest_pair(have, stock, gap + small[0], small[0])
            if pair is None:
                break
            packed.remove(small)
            packed += [(s, take(s)) for s in pair]
            give(*small)
            gap += small[0] - sum(pair)
        at = 0
        for size, row in packed:
            bins[row], offsets[row] = number, at
            at += size
        number += 1
    return bins, offsets


def _tightest_pair(have: list[int], stock: dict[int, list[int]], room: int, more_than: int) -> tuple[int, int] | None:
    """The two lengths left with the largest sum in (more_than, room], or None."""
    sizes = np.array(have[:bisect_right(have, room - 1)], np.int64)
    if not len(sizes):
        return None
    mate = np.searchsorted(sizes, np.minimum(sizes, room - sizes), "right") - 1  # the longest partner that is not longer
    same = np.flatnonzero((mate >= 0) & (sizes[mate] == sizes))
    for i in same:  # twice the same length needs two pieces
        if len(stock[int(sizes[i])]) < 2:
            mate[i] -= 1
    total = np.where(mate >= 0, sizes + sizes[mate], 0)
    best = int(total.argmax())
    return (int(sizes[best]), int(sizes[mate[best]])) if total[best] > more_than else None


def pack_pieces(pieces: DataFrame, length: int = LENGTH, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """`pieces` (a stored table with doc_id, piece, length and any others) with sequence_id and offset. Every row gets a place;
    repeated rows get a place each. The sequences of group g are numbered from g * 2^32; full pieces have negative numbers."""
    full = pieces.where(F.col("length") >= length).withColumns({
        "sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    short = pieces.where(F.col("length") < length)
    total = short.agg(F.sum("length")).first()[0] or 0
    groups = max(1, -(-int(total) // group_tokens))
    names = pieces.columns

    def pack(table: pa.Table) -> pa.Table:
        bins, offsets = best_two_fit(table.column("length").to_numpy(), length)
        number = (int(table.column("_group")[0].as_py()) << 32) + bins
        return table.select(names).append_column("sequence_id", pa.array(number)).append_column("offset", pa.array(offsets))

    schema = full.schema
    dealt = short.withColumn("_group", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)))
    return full.unionByName(dealt.groupBy("_group").applyInArrow(pack, schema))


def pack_documents(docs: DataFrame, length: int = LENGTH, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text",
                   vocabulary: str = VOCABULARY, group_tokens: int = GROUP_TOKENS, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset) for all documents; see `token_pieces`."""
    pieces = token_pieces(docs, length, end_id, doc_id, text, vocabulary, with_ids)
    return pack_pieces(cut_lineage(pieces), length, group_tokens)
