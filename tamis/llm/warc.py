"""WARC 1.1 archives: a writer that records equal payloads once, and a Python data source that reads headers first.

Writing. A payload of at least LEAST_BYTES bytes that occurs more than once is stored with the row of the largest id; the others
become `revisit` records (profile identical-payload-digest) that name it and carry the HTTP head only. Each task writes files
of bounded size, one gzip member a record.

Reading. The source plans one partition per file, or per run of records where an index of member offsets lies beside the
file. Predicates on the record type and on headers reach the reader (options, or filters that Spark pushes down). A
reader parses the WARC header of a record, tests it, and skips the block of a record that fails without building its payload;
payload columns that are not asked for are never decoded.
"""

from __future__ import annotations

import base64
import gzip
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

from tamis.llm.idfiles import _files
from tamis.llm.linking import salted_join
from tamis.session import cut_lineage, scratch_path

LEAST_BYTES = 1000
FILE_BYTES = 512 << 20
RUN_BYTES = 64 << 20
READ_BYTES = 256 << 10
ROWS = 256  # made into Python values at a time
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID_PREFIX = "urn:page:"
DATE = "1970-01-01T00:00:00Z"  # pages carry no time of capture
SCHEMA = ("record_type string, record_id string, target_uri string, refers_to string, payload_digest string, content_type string, "
          "content_length bigint, http_length bigint, payload binary")
_COLUMNS = ("record_type", "record_id", "target_uri", "refers_to", "payload_digest", "content_type", "content_length", "http_length", "payload")
_HEADERS = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "refers_to": "warc-refers-to",
            "payload_digest": "warc-payload-digest", "content_type": "content-type"}
_BARE = ("record_id", "refers_to")  # written in angle brackets


def plan_records(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = LEAST_BYTES) -> DataFrame:
    """(page_id, url, payload, digest, refers_to): `refers_to` is the id of the row that keeps the payload, null where the row keeps its
    own. A null html is an empty payload, a null url an empty one. Rows with equal ids and payloads keep one another's."""
    payload = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.coalesce(F.col(url).cast("string"), F.lit("")).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    # only payloads that occur again take part in the join; they are counted with partial sums before the shuffle
    groups = rows.where(F.length("payload") >= least_bytes).groupBy("digest").agg(
        F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "keeper")
    joined = salted_join(rows, groups, "digest", "page_id", "left")
    return joined.select("page_id", "url", "payload", "digest", F.when(
        (F.length("payload") >= least_bytes) & ~F.col("keeper").eqNullSafe(F.col("page_id")), F.col("keeper")).alias("refers_to"))


def _clean(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def _record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
            f"WARC-Record-ID: <{ID_PREFIX}{'none' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    head.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{ID_PREFIX}{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_warc(pages: DataFrame, folder: str | None = None, page_id: str = "page_id", url: str = "url", html: str = "html",
               least_bytes: int = LEAST_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the archives and return their list: (path, run, first, last, records); first..last are the bytes of a run of whole
    records. Names hold the task attempt, and only files of attempts that ended well are in the list."""
    folder = folder or scratch_path(pages.sparkSession, "warc")
    store, place = _files(folder)
    store.create_dir(place, recursive=True)

    def run(batches):
        context = TaskContext.get()
        stem = f"{folder}/pages-{context.partitionId():06d}-{context.taskAttemptId()}"
        out, at, number, runs = None, 0, 0, []
        parts = (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS))
        for batch in parts:
            for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to")), strict=True):
                if out is None or at >= file_bytes:
                    if out is not None:
                        out.close()
                    path = f"{stem}-{number:04d}.warc.gz"
                    fs, where = _files(path)
                    out, at, number = fs.open_output_stream(where, compression=None), 0, number + 1
                    runs.append([path, 0, 0, 0])
                elif at - runs[-1][1] >= RUN_BYTES:
                    runs.append([path, at, at, 0])
                packed = gzip.compress(_record(*row), 4, mtime=0)
                out.write(packed)
                at += len(packed)
                runs[-1][2], runs[-1][3] = at, runs[-1][3] + 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*runs, strict=True), (
                pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["path", "first", "last", "records"])

    planned = plan_records(pages, page_id, url, html, least_bytes)
    return cut_lineage(planned.mapInArrow(run, "path string, first bigint, last bigint, records bigint"))


class WarcPartition(InputPartition):
    def __init__(self, path: str, first: int, last: int):
        super().__init__((path, first, last))
        self.path, self.first, self.last = path, first, last


def _header(lines: bytes) -> dict[str, str]:
    out = {}
    for line in lines.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        out[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    return out


class _Stream:
    """The bytes first..last of a file, unpacked where they are gzip members. Holds one read and what a record needs beyond it."""

    def __init__(self, path: str, first: int, last: int):
        store, place = _files(path)
        self.file = store.open_input_file(place)
        self.last = self.file.size() if last < 0 else last
        self.file.seek(first)
        self.at, self.packed, self.unzip = first, None, None
        self.held, self.place = b"", 0  # bytes, and how many of them are used up

    def _more(self) -> bool:
        raw = self.file.read(min(READ_BYTES, self.last - self.at))
        if not raw:
            return False
        self.at += len(raw)
        if self.packed is None:
            self.packed = raw[:2] == b"\x1f\x8b"
        parts = [self.held[self.place:]]
        while raw and self.packed:
            self.unzip = self.unzip or zlib.decompressobj(31)
            parts.append(self.unzip.decompress(raw))
            raw = self.unzip.unused_data
            if self.unzip.eof:
                self.unzip = None
        self.held, self.place = b"".join([*parts, raw]), 0
        return True

    def until(self, mark: bytes) -> bytes | None:
        while (k := self.held.find(mark, self.place)) < 0:
            if not self._more():
                return None
        out, self.place = self.held[self.place:k], k + len(mark)
        return out

    def take(self, n: int, keep: bool) -> bytes:
        """The next n bytes, or nothing where they aren't wanted."""
        parts = []
        while n:
            here = min(n, len(self.held) - self.place)
            if keep:
                parts.append(self.held[self.place:self.place + here])
            self.place += here
            n -= here
            if n and not self._more():
                break
        return b"".join(parts)


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str], columns: tuple[str, ...]):
        self.columns = columns
        self.files = [tuple(x.split("\t")) for x in options.get("runs", "").split("\n") if x]
        self.path = options.get("path")
        self.tests: list[tuple[str, frozenset[str]]] = []
        if options.get("record_types"):
            self.tests.append(("record_type", frozenset(options["record_types"].split(","))))
        for name, value in options.items():
            if name.startswith("header."):
                self.tests.append((name[7:].lower(), frozenset([value])))

    def pushFilters(self, filters):
        """Take equality and membership tests on columns that are headers; the others stay with Spark."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and f.attribute[0] in _HEADERS:
                self.tests.append((f.attribute[0], frozenset(f.value if isinstance(f, In) else [f.value])))
            else:
                yield f

    def partitions(self):
        if self.files:
            return [WarcPartition(p, int(a), int(b)) for p, a, b in self.files]
        from pyarrow import fs

        store, place = _files(self.path)
        root = self.path[:len(self.path) - len(place)] if self.path.endswith(place) else ""
        info = store.get_file_info(place)
        found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(place, recursive=True))
        return [WarcPartition(root + f.path, 0, -1) for f in found if f.type == fs.FileType.File and f.path.endswith((".warc", ".warc.gz"))]

    def read(self, partition):
        stream = _Stream(partition.path, partition.first, partition.last)
        schema = pa.schema([(c, pa.binary() if c == "payload" else pa.int64() if c.endswith("_length") else pa.string()) for c in self.columns])
        want_block = "payload" in self.columns or "http_length" in self.columns
        rows, held = [], 0
        while True:
            head = stream.until(b"\r\n\r\n")
            if head is None or not head.strip():
                break
            named = _header(head.lstrip(b"\r\n"))
            length = int(named.get("content-length", 0))
            values = {c: named.get(h) for c, h in _HEADERS.items()}
            for c in _BARE:
                values[c] = values[c] and values[c].strip("<>")
            passes = all((values[c] if c in values else named.get(c)) in allowed for c, allowed in self.tests)
            block = stream.take(length, passes and want_block)
            stream.take(4, False)
            if not passes:
                continue
            values |= {"content_length": length, "http_length": None, "payload": None}
            if want_block:
                payload = block
                if (values["content_type"] or "").startswith("application/http"):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    size = _header(http).get("content-length", "")
                    values["http_length"] = int(size) if size.isdigit() else None
                values["payload"] = None if values["record_type"] == "revisit" else payload
            rows.append([values[c] for c in self.columns])
            held += len(block)
            if held > 1 << 20 or len(rows) >= 5000:
                yield self._batch(rows, schema)
                rows, held = [], 0
        if rows:
            yield self._batch(rows, schema)

    def _batch(self, rows, schema):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


class WarcSource(DataSource):
    """spark.read.format("warc").load(path). Options: record_types (comma list), header.<name> = value, columns (comma list), runs
    (lines of path, first byte, last byte: partitions that are known already)."""

    @classmethod
    def name(cls):
        return "warc"

    def _columns(self):
        chosen = self.options.get("columns")
        return tuple(c for c in _COLUMNS if not chosen or c in chosen.split(","))

    def schema(self):
        kinds = dict(x.split(" ") for x in SCHEMA.split(", "))
        return ", ".join(f"{c} {kinds[c]}" for c in self._columns())

    def reader(self, schema):
        return WarcReader(dict(self.options), self._columns())


def read_warc(spark: SparkSession, source: str | DataFrame, record_types: tuple[str, ...] = (), headers: dict[str, str] | None = None,
              columns: tuple[str, ...] = ()) -> DataFrame:
    """The records of archives: a folder or file, or the list that `write_warc` returns (one line per run of records, read in parallel).

    `record_types` and `headers` (name to value) leave records out before their blocks are read; `columns` leaves out columns. With
    `spark.sql.python.filterPushdown.enabled` filters of a query do the same."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    reader = spark.read.format("warc")
    if record_types:
        reader = reader.option("record_types", ",".join(record_types))
    for name, value in (headers or {}).items():
        reader = reader.option(f"header.{name}", value)
    if columns:
        reader = reader.option("columns", ",".join(columns))
    if isinstance(source, str):
        return reader.load(source)
    runs = [f"{r.path}\t{r.first}\t{r.last}" for r in source.orderBy("path", "first").collect()]  # one line per run of records
    if not runs:
        return spark.createDataFrame([], WarcSource({"columns": ",".join(columns)} if columns else {}).schema())
    return reader.option("runs", "\n".join(runs)).load()


def page_records(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of archived pages. Size and digest of a response come from the
    payload itself; a revisit has them in its heads."""
    number = lambda c: F.expr(f"try_cast(substring({c}, {len(ID_PREFIX) + 1}) AS bigint)")
    stored = F.lower(F.hex(_unbase32(F.substring("payload_digest", 6, 32))))
    revisit = F.col("record_type") == "revisit"
    return records.select(
        number("record_id").alias("page_id"),
        F.when(revisit, F.col("http_length")).otherwise(F.length("payload")).cast("long").alias("payload_bytes"),
        F.when(revisit, stored).otherwise(F.sha1("payload")).alias("payload_digest"), "record_type", number("refers_to").alias("refers_to"))


def _unbase32(text):
    """Bytes of 32 base-32 letters: eight letters are five bytes, that is ten hex digits."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

    def digit(k):
        return (F.call_function("locate", F.substring(text, k, 1), F.lit(letters)) - 1).cast("long")

    groups = []
    for g in range(4):
        total = F.lit(0).cast("long")
        for k in range(8):
            total = total * 32 + digit(8 * g + k + 1)
        groups.append(F.lpad(F.hex(total), 10, "0"))
    return F.unhex(F.concat(*groups))
