"""Token-id files with Elias-Fano document boundaries.

A data set is a folder of shards in ascending order of document ids. A shard holds, in this order: all token ids, 2 or 4 bytes
each; the document ids (int64); the boundaries; a select sample; a footer of fixed size. The boundaries are the starts of the
documents within the shard and its end, a monotone list of n + 1 values below u: the lowest l = floor(log2(u / n)) bits of each
are packed, the rest is a bit vector in which value i sets bit (value >> l) + i. That is at most 2 + l bits a document, where a
plain table takes 64. Every 512th set bit has its place in the sample, so select looks at a short run of words.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.llm.flat import slices, text_bytes
from tamis.llm.tokens import word_tokens
from tamis.session import cut_lineage, scratch_path

VOCABULARY = "word_bpe_49k.json"
END_ID = 2
SAMPLE = 512
MAGIC = b"EFID0001"
FOOTER = struct.Struct("<8sQQBBQQQQ")  # magic, documents, ids, id width, low bits, places of doc ids, low, high, sample
READ_IDS = 1 << 20


class EliasFano:
    """A monotone list of non-negative numbers with random access by select."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, sample: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.sample = n, low_bits, low, high, sample

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        bits = max(0, (top // max(n, 1)).bit_length() - 1)
        low = np.zeros(0, np.uint8)
        if bits:
            columns = (values[:, None] >> np.arange(bits, dtype=np.uint64) & np.uint64(1)).astype(np.uint8)
            low = np.packbits(columns.reshape(-1), bitorder="little")
        ones = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        mask = np.zeros((int(ones[-1]) if n else 0) // 64 * 64 + 64, np.uint8)
        mask[ones] = 1
        return cls(n, bits, low, np.packbits(mask, bitorder="little").view("<u8"), ones[::SAMPLE].astype("<u8"))

    def select(self, index: np.ndarray) -> np.ndarray:
        """The values at the places `index`."""
        index = np.asarray(index, np.int64)
        word = (self.sample[index // SAMPLE] // np.uint64(64)).astype(np.int64)
        # ones before the sampled place in its word, so that counting starts at a word edge
        inside = self.sample[index // SAMPLE] % np.uint64(64)
        head = np.bitwise_count(self.high[word] & ((np.uint64(1) << inside) - np.uint64(1))).astype(np.int64)
        rest = index % SAMPLE + head
        todo = np.arange(len(index))
        while len(todo):
            ones = np.bitwise_count(self.high[word[todo]]).astype(np.int64)
            todo, ones = todo[rest[todo] >= ones], ones[rest[todo] >= ones]
            rest[todo] -= ones
            word[todo] += 1
        bits = np.unpackbits(self.high[word].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        place = (np.cumsum(bits, axis=1, dtype=np.int16) > rest[:, None]).argmax(axis=1)
        high = word * 64 + place - index
        if not self.low_bits:
            return high
        at = index[:, None] * self.low_bits + np.arange(self.low_bits)
        low = (self.low[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(np.int64)
        return high << self.low_bits | (low << np.arange(self.low_bits)).sum(axis=1)


def _files(path: str):
    """(file system, path) for a folder or file in a store that pyarrow reaches: file, hdfs, s3, gs or a plain path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class ShardWriter:
    """One shard; ids go to the file as they come, only boundaries and document ids are held."""

    def __init__(self, path: str, width: int):
        store, place = _files(path)
        self.file = store.open_output_stream(place)
        self.width, self.n_ids = width, 0
        self.doc_ids: list[np.ndarray] = []
        self.starts: list[np.ndarray] = []

    def add(self, doc_ids: np.ndarray, ids: np.ndarray, offsets: np.ndarray) -> None:
        self.file.write(ids.astype(f"<u{self.width}").tobytes())
        self.doc_ids.append(doc_ids)
        self.starts.append(offsets[:-1] + self.n_ids)
        self.n_ids += int(offsets[-1])

    def close(self) -> tuple[int, int]:
        doc_ids = np.concatenate(self.doc_ids).astype("<i8")
        bounds = EliasFano.of(np.append(np.concatenate(self.starts), self.n_ids))
        at = [self.n_ids * self.width]
        for part in (doc_ids, bounds.low, bounds.high, bounds.sample):
            self.file.write(part.tobytes())
            at.append(at[-1] + part.nbytes)
        self.file.write(FOOTER.pack(MAGIC, len(doc_ids), self.n_ids, self.width, bounds.low_bits, *at[:4]))
        self.file.close()
        return len(doc_ids), self.n_ids


class ShardReader:
    """Random access to the documents of one shard."""

    def __init__(self, path: str):
        store, place = _files(path)
        self.file = store.open_input_file(place)
        size = self.file.size()
        magic, n, n_ids, width, bits, docs, low, high, sample = FOOTER.unpack(self.file.read_at(FOOTER.size, size - FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{path} is no token-id shard")
        part = lambda a, b, kind: np.frombuffer(self.file.read_at(b - a, a), kind)
        self.n, self.n_ids, self.width = n, n_ids, width
        self.doc_ids = part(docs, low, "<i8")
        self.bounds = EliasFano(n + 1, bits, part(low, high, np.uint8), part(high, sample, "<u8"), part(sample, size - FOOTER.size, "<u8"))

    def ids(self, first: int, last: int) -> np.ndarray:
        """The ids at the places first..last of the shard."""
        return np.frombuffer(self.file.read_at((last - first) * self.width, first * self.width), f"<u{self.width}")

    def document(self, i: int) -> np.ndarray:
        first, last = self.bounds.select(np.array([i, i + 1]))
        return self.ids(int(first), int(last))


def write_ids(docs: DataFrame, folder: str | None = None, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text",
              vocabulary: str = VOCABULARY) -> DataFrame:
    """Write the shards of all documents and return their list: (shard, path, documents, ids, base), `base` counting the ids of all
    shards before. Documents go in ascending order of id, null ids first, repeated ids by text; a null or empty text is the end
    id alone. A shard is named by the task attempt that wrote it, and only attempts that ended well are in the list."""
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "ids")
    store, place = _files(folder)
    store.create_dir(place, recursive=True)

    def run(batches):
        coder = word_tokens(vocabulary)
        names = coder.vocabulary.names
        width = 2 if max(*names, end_id) < 1 << 16 else 4
        context = TaskContext.get()
        path = f"{folder}/shard-{context.partitionId():06d}-{context.taskAttemptId()}.efid"
        writer = None
        for part in slices(batches):
            ids, at = coder.encode(*text_bytes(part.column("text")))
            at = at + np.arange(len(at))
            body = np.full(int(at[-1]), end_id, np.int64)
            inside = np.ones(len(body), bool)
            inside[at[1:] - 1] = False
            body[inside] = ids
            writer = writer or ShardWriter(path, width)
            keys = part.column("doc_id").fill_null(np.iinfo(np.int64).min).to_numpy()
            writer.add(keys, body, at)
        if writer:
            n, n_ids = writer.close()
            yield pa.RecordBatch.from_pydict({"shard": [context.partitionId()], "path": [path], "documents": [n], "ids": [n_ids]},
                                             pa.schema([("shard", pa.int32()), ("path", pa.string()), ("documents", pa.int64()),
                                                        ("ids", pa.int64())]))

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    shards = cut_lineage(ordered.mapInArrow(run, "shard int, path string, documents bigint, ids bigint"))
    listed, base = [], 0
    for r in sorted(shards.collect(), key=lambda r: r.shard):  # one line per shard
        listed.append((r.shard, r.path, r.documents, r.ids, base))
        base += r.ids
    return spark.createDataFrame(listed, "shard int, path string, documents bigint, ids bigint, base bigint")


def read_documents(spark: SparkSession, shards: DataFrame, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of all documents, read from the shards; a shard is read in runs of bounded size."""

    def run(batches):
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                shard = ShardReader(path)
                i = 0
                while i < shard.n:
                    bounds = shard.bounds.select(np.arange(i, min(shard.n, i + 20_000) + 1))
                    j = max(1, int(np.searchsorted(bounds, bounds[0] + READ_IDS, "right")) - 1)
                    bounds = bounds[:j + 1]
                    ids = shard.ids(int(bounds[0]), int(bounds[-1]))
                    raw = ids.astype("<u4").tobytes()
                    cut = ((bounds - bounds[0]) * 4).tolist()
                    parts = [raw[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
                    keys = shard.doc_ids[i:i + j]
                    columns = [pa.array(keys, mask=keys == np.iinfo(np.int64).min), pa.array(base + bounds[:-1]), pa.array(np.diff(bounds)),
                               pa.array([zlib.crc32(p) for p in parts], pa.int64())]
                    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                    if with_ids:
                        flat = pa.array(np.frombuffer(raw, "<u4").astype(np.int64))
                        columns.append(pa.ListArray.from_arrays(pa.array((bounds - bounds[0]).astype(np.int32)), flat))
                        names.append("ids")
                    yield pa.RecordBatch.from_arrays(columns, names)
                    i += j

    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + (", ids array<bigint>" if with_ids else "")
    return shards.select("path", "base").repartition(max(1, shards.count()), "path").mapInArrow(run, schema)
