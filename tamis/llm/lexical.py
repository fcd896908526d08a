"""Ranked lexical search: blocked products of dense item and document tiles.

Three passes. The first splits every text into terms and stores, for each document, its length and how often it has each term of
the items (`term_counts`). The second counts the documents of each term and the length of the corpus. The third turns the
counts of some thousand documents into a tile of impacts (terms x documents), multiplies it by tiles of the items' weights (items
x terms) and keeps the best documents of each item. A tile has only the terms that both its items and its documents have.

Scores are whole numbers, and the product is exact in float64: weights are cut into digits below 2^22, an impact is below 2^20 and a tile
has at most 2^11 terms, so every partial sum stays below 2^53; tiles are added as 64-bit integers. A tile's best documents are chosen with all
ties of the kth score, so ties are decided by the id alone.

Documents aren't shuffled. Equal item texts are searched once. The items that a pass ships to the tasks hold at most ITEM_BYTES of text, or one
text that is longer; more items are more passes over the documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tamis.llm.flat import slices, spans_outside, text_bytes, words_of
from tamis.llm.hashing import lower_ascii
from tamis.llm.linking import salted_join
from tamis.llm.toplists import TopLists
from tamis.session import cut_lineage

K = 10
UNIT = 1_000_000_000
SPREAD, SLOPE = 8, 75  # of the length, in 1/1000 and in percent
DIGIT = 22
TILE_TERMS = 1 << (53 - DIGIT - 20)
TILE_DOCS = 2048
CHUNK_ITEMS = 256
ITEM_BYTES = 8 << 20
SALTS = 32

_GAP = np.ones(256, bool)
_GAP[np.frombuffer(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", np.uint8)] = False
_GAP[128:] = False


def terms(body: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """(terms, offsets by text): maximal runs of ASCII letters, digits and other characters beyond ASCII, A-Z lower-cased."""
    low = lower_ascii(body)
    starts, ends, by_text = spans_outside(low, offsets, _GAP[low])
    return words_of(low, starts, ends), by_text


@dataclass
class Items:
    """Items that one pass searches: their distinct terms, and for each item the numbers of its terms and how often it has them."""

    keys: list[str]
    vocabulary: pa.Array
    counts: list[tuple[np.ndarray, np.ndarray]]
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    @classmethod
    def of(cls, keys: list[str], texts: list[str]) -> Items:
        words, at = terms(*text_bytes(pa.array(texts, pa.string())))
        coded = words.dictionary_encode()
        codes = coded.indices.to_numpy().astype(np.int64)
        return cls(keys, coded.dictionary, [np.unique(codes[a:b], return_counts=True) for a, b in zip(at[:-1], at[1:], strict=True)])

    def chunks(self) -> Iterator[list[int]]:
        """Runs of items; at most CHUNK_ITEMS are multiplied together."""
        for first in range(0, len(self.keys), CHUNK_ITEMS):
            yield list(range(first, min(first + CHUNK_ITEMS, len(self.keys))))


def term_counts(docs: DataFrame, vocabulary: pa.Array) -> DataFrame:
    """(doc_id, n, codes, counts) of (doc_id, text), for documents with a term: n of them, and those of the vocabulary."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        known = shared.value
        for part in slices(batches):
            words, at = terms(*text_bytes(part.column("text")))
            code = pc.fill_null(pc.index_in(words, value_set=known), -1).to_numpy().astype(np.int64)
            text = np.repeat(np.arange(part.num_rows), np.diff(at))
            pair, tf = np.unique((text * len(known) + code)[code >= 0], return_counts=True)
            ends = np.searchsorted(pair, np.arange(part.num_rows + 1) * len(known)).astype(np.int32)

            def lists(values, kind):
                return pa.ListArray.from_arrays(pa.array(ends), pa.array(values, kind))

            rows = pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(at)), lists(pair % max(1, len(known)), pa.int32()),
                                               lists(tf, pa.int64())], ["doc_id", "n", "codes", "counts"])
            yield rows.filter(pa.array(np.diff(at) > 0))

    return docs.mapInArrow(run, "doc_id bigint, n bigint, codes array<int>, counts array<bigint>")


def _flat(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    lists = batch.column(name)
    offsets = lists.offsets.to_numpy()
    return lists.flatten().to_numpy().astype(np.int64), (offsets - offsets[0]).astype(np.int64)


def document_frequency(counted: DataFrame, size: int) -> np.ndarray:
    """In how many documents each term of the vocabulary stands. One number per term comes to the driver."""

    def run(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(_flat(batch, "codes")[0], minlength=size)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["code", "df"])

    out = np.zeros(size, np.int64)
    for r in counted.select("codes").mapInArrow(run, "code int, df bigint").groupBy("code").agg(F.sum("df").alias("df")).toLocalIterator():
        out[r.code] = r.df
    return out


def impacts(n: np.ndarray, counts: np.ndarray, documents: int, length: int) -> np.ndarray:
    """(UNIT * tf) div (1000 * tf + SPREAD * m) with m = 100 - SLOPE + (SLOPE * n * documents) div length, for lengths `n` and counts of the same entries."""
    different, which = np.unique(n, return_inverse=True)
    m = np.array([100 - SLOPE + SLOPE * int(x) * documents // length for x in different], np.int64)[which]
    return UNIT * counts // (1000 * counts + SPREAD * m)


def multiply(items: Items, chunk: list[int], doc: np.ndarray, code: np.ndarray, impact: np.ndarray, docs: int) -> np.ndarray:
    """Scores (items of the chunk x documents) from the entries (document, code, impact) of a tile of documents."""
    number = np.repeat(np.arange(len(chunk)), [len(items.counts[i][0]) for i in chunk])
    own = np.concatenate([items.counts[i][0] for i in chunk]) if chunk else np.zeros(0, np.int64)
    amount = np.concatenate([items.counts[i][1] for i in chunk]) * items.weights[own] if chunk else own
    present = np.intersect1d(own, code)
    scores = np.zeros((len(chunk), docs), np.int64)
    own_at, code_at = np.searchsorted(present, own), np.searchsorted(present, code)
    has_own = np.append(present, -1)[own_at] == own
    has_code = np.append(present, -1)[code_at] == code
    number, own_at, amount = number[has_own], own_at[has_own], amount[has_own]
    doc, code_at, impact = doc[has_code], code_at[has_code], impact[has_code]
    digits = max(1, -(-int(amount.max(initial=0)).bit_length() // DIGIT))
    for first in range(0, len(present), TILE_TERMS):
        size = min(TILE_TERMS, len(present) - first)
        here, there = (own_at >= first) & (own_at < first + size), (code_at >= first) & (code_at < first + size)
        right = np.zeros((size, docs))
        right[code_at[there] - first, doc[there]] = impact[there]
        for digit in range(digits):
            part = amount[here] >> (DIGIT * digit) & ((1 << DIGIT) - 1)
            if part.any():
                left = np.zeros((len(chunk), size))
                left[number[here], own_at[here] - first] = part
                scores += (left @ right).astype(np.int64) << (DIGIT * digit)
    return scores


def best_documents(counted: DataFrame, items: Items, documents: int, length: int, k: int = K, tile_docs: int = TILE_DOCS) -> DataFrame:
    """(item, salt, doc_id, score): the best of each partition for each item number."""
    shared = counted.sparkSession.sparkContext.broadcast(items)

    def run(batches):
        wanted: Items = shared.value
        best = TopLists(len(wanted.keys), k)
        for whole in batches:
            for first in range(0, whole.num_rows, tile_docs):
                batch = whole.slice(first, tile_docs)
                ids = batch.column("doc_id").to_numpy()
                code, at = _flat(batch, "codes")
                doc = np.repeat(np.arange(len(ids)), np.diff(at))
                impact = impacts(batch.column("n").to_numpy()[doc], _flat(batch, "counts")[0], documents, length)
                for chunk in wanted.chunks():
                    scores = multiply(wanted, chunk, doc, code, impact, len(ids))
                    row, place = np.nonzero(scores >= np.maximum(best.least()[chunk], 1)[:, None])
                    best.add(row + chunk[0], scores[row, place], ids[place])
        row, score, doc_id = best.entries()
        salt = np.full(len(row), TaskContext.get().partitionId() % SALTS, np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(row.astype(np.int32)), pa.array(salt), pa.array(doc_id), pa.array(score)], ["item", "salt", "doc_id", "score"])

    return counted.where("doc_id is not null and size(codes) > 0").mapInArrow(run, "item int, salt int, doc_id bigint, score bigint")


def _passes(texts: DataFrame, item_bytes: int) -> Iterator[Items]:
    """The distinct texts (key, text), dealt by hash to groups of about `item_bytes`."""
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, -(-total // item_bytes))
    dealt = cut_lineage(texts.withColumn("group", F.pmod(F.xxhash64("key"), F.lit(groups))))
    for g in range(groups):
        rows = dealt.where(F.col("group") == g).select("key", "text").toArrow()
        if rows.num_rows:
            yield Items.of(rows["key"].to_pylist(), rows["text"].to_pylist())


def ranked(docs: DataFrame, items: DataFrame, k: int = K, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
           item_bytes: int = ITEM_BYTES, tile_docs: int = TILE_DOCS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item with a score above 0, equal scores by ascending id.

    Null texts and texts without a term are no documents and give no result as items. Documents with a null id count for the
    corpus and aren't ranked. A repeated document row is a document each time. Items with a repeated or null id have results of their own for
    each row. Other columns are left out."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    named = items.where(F.col(item_text).isNotNull()).select(F.col(item_id).alias("item_id"), F.sha2(F.col(item_text), 256).alias("key"),
                                                             F.col(item_text).alias("text"))
    found = None
    for wanted in _passes(named.select("key", "text").dropDuplicates(["key"]), item_bytes):
        if not len(wanted.vocabulary):
            continue
        counted = cut_lineage(term_counts(rows, wanted.vocabulary))
        documents, length = counted.agg(F.count(F.lit(1)), F.sum("n")).first()
        if not documents:
            break
        df = document_frequency(counted, len(wanted.vocabulary))
        wanted.weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(x) + 1))) for x in df], np.int64)
        keys = spark.createDataFrame(list(enumerate(wanted.keys)), "item int, key string")
        some = best_documents(counted, wanted, documents, length, k, tile_docs)
        order = [F.desc("score"), F.asc("doc_id")]
        for cell in (["item", "salt"], ["item"]):
            some = some.withColumn("rank", F.row_number().over(Window.partitionBy(*cell).orderBy(*order))).where(F.col("rank") <= k)
        one = some.join(keys, "item").select("key", "rank", "doc_id", "score")
        found = one if found is None else found.unionByName(one)
    if found is None:
        return named.limit(0).select("item_id", F.lit(1).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score"))
    return salted_join(named.select("item_id", "key"), found, "key", "item_id", salts=4).select("item_id", "rank", "doc_id", "score")
