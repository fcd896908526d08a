"""A keyed table on plain Parquet: one row per key, cut into buckets, changed by versions.

A bucket is a list of parts; a part holds each of its keys once and comes with bitmaps of its keys, so a batch reads and replaces only
the parts that may hold one of its keys and appends the rest. No key stands in two parts. A version is a small list of parts and counts
from the moment its list is complete, so a reader sees a batch whole or not at all, and a batch that failed half way leaves nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamis.session import cut_lineage, give_back

BUCKET = "tamis_bucket"
PAGE_BITS = 32_768  # bits of one bitmap of the SQL function
_LIST = "bucket int, version bigint, stream string, batch bigint"

Part = tuple[int, int]


@dataclass(frozen=True)
class Merged:
    """What a batch cost: buckets it touched, parts it read and replaced of those there were in them, and the new version."""

    version: int
    touched: int
    parts_there: int
    parts_read: int
    applied: bool = True


def _seen(rows: DataFrame, of: Column) -> set:
    """The distinct values, combined inside tasks and then in one; for values that are buckets or parts, never keys."""
    return set(rows.agg(F.collect_set(of)).first()[0])


class KeyedTable:
    """The table at `path`. Of several rows of a key the largest by the SQL expressions in `order` stays (null is smallest); on a
    tie, and without an order, the stored row does, and within a batch the same one in every run. Null keys are equal. One writer at a time.

    `buckets` and `pages` are fixed for the life of a table; a part has `pages` bitmaps of 4 KB. The driver sees buckets and parts,
    never keys. Choose `buckets` so that a bucket fits a task; hot keys are combined before they reach one."""

    def __init__(self, path: str, schema: T.StructType, keys: Iterable[str], order: Iterable[str] = (), buckets: int = 256,
                 pages: int = 8, most_parts: int = 8):
        self.path, self.schema, self.keys, self.order = path.rstrip("/"), schema, list(keys), list(order)
        self.buckets, self.pages, self.most_parts = buckets, pages, most_parts

    def rows(self, spark: SparkSession) -> DataFrame:
        """The table at its newest version; empty before the first."""
        versions = self._versions(spark)
        parts, _ = self._list(spark, versions[-1]) if versions else (set(), {})
        return self._read(spark, parts)

    def lookup(self, probe: DataFrame) -> DataFrame:
        """The stored rows of the keys in `probe`; only parts that may hold one of them are read."""
        spark = probe.sparkSession
        versions = self._versions(spark)
        parts, _ = self._list(spark, versions[-1]) if versions else (set(), {})
        asked = cut_lineage(self._placed(probe.select(*self.keys).distinct()))
        there = self._met(asked, parts)
        same = [F.col(f"s.{k}").eqNullSafe(F.col(f"a.{k}")) for k in self.keys]
        return self._read(spark, there).alias("s").join(asked.alias("a"), same, "left_semi")

    def merge(self, batch: DataFrame, batch_id: int, stream: str = "") -> Merged:
        """Apply one batch. A batch that `stream` has applied already, by its id, changes nothing."""
        spark = batch.sparkSession
        versions = self._versions(spark)
        parts, done = self._list(spark, versions[-1]) if versions else (set(), {})
        version = versions[-1] + 1 if versions else 0
        if batch_id <= done.get(stream, -1):
            return Merged(versions[-1], 0, 0, 0, applied=False)
        fresh = cut_lineage(self._placed(self._best(batch.select(*self.schema.names).withColumn("_stored", F.lit(False)))))
        touched = _seen(fresh, F.col(BUCKET))
        near = {p for p in parts if p[0] in touched}
        replaced = self._met(fresh, near)
        for bucket in touched:
            rest = {p for p in near - replaced if p[0] == bucket}
            if len(rest) + 1 > self.most_parts:
                replaced |= rest
        if touched:
            self._write(fresh, replaced, version)
        made = {(bucket, version) for bucket in touched}
        self._commit(spark, (parts - replaced) | made, done | {stream: batch_id}, version)
        give_back(fresh)
        self._vacuum(spark)
        return Merged(version, len(touched), len(near), len(replaced))

    def sink(self, stream: str = "", report: Callable[[Merged], None] | None = None) -> Callable[[DataFrame, int], None]:
        """`merge` for foreachBatch. Streams with checkpoints of their own need names of their own."""

        def write(batch: DataFrame, batch_id: int) -> None:
            merged = self.merge(batch, batch_id, stream)
            if report:
                report(merged)

        return write

    def _rank(self) -> Column:
        return F.struct(*[F.expr(o).alias(f"o{i}") for i, o in enumerate(self.order)], F.col("_stored"))

    def _best(self, rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
        """One row per key. Rows of equal rank within a batch are told apart by all columns, so reruns agree."""
        row = F.struct(*[F.col(c) for c in self.schema.names])
        text = F.xxhash64(*[F.col(c).cast("string") for c in self.schema.names])
        best = rows.groupBy(*by, *self.keys).agg(F.max_by(row, F.struct(self._rank(), text)).alias("_r"))
        return best.select(*by, "_r.*")

    def _placed(self, rows: DataFrame) -> DataFrame:
        """Adds the bucket, and page and bit of the key in the bitmaps."""
        place = F.pmod(F.xxhash64(F.lit(1), *self.keys), F.lit(self.pages * PAGE_BITS))
        return rows.withColumns({BUCKET: F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"),
                                 "_page": F.floor(place / PAGE_BITS).cast("int"), "_bit": (place % PAGE_BITS).cast("int")})

    def _met(self, asked: DataFrame, parts: set[Part]) -> set[Part]:
        """The parts that may hold a key of `asked`, by their bitmaps."""
        if not parts:
            return set()
        spark = asked.sparkSession
        maps = spark.read.schema(f"version bigint, _page int, bits binary, {BUCKET} int").option("basePath", f"{self.path}/keys").parquet(
            *[f"{self.path}/keys/of={v}/{BUCKET}={b}" for b, v in sorted(parts)])
        byte = F.conv(F.hex(F.substring("bits", F.floor(F.col("_bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        hit = F.expr("shiftright(_byte, _bit % 8) & 1") == 1
        found = asked.select(BUCKET, "_page", "_bit").join(maps, [BUCKET, "_page"]).withColumn("_byte", byte).where(hit)
        return {(r[0], r[1]) for r in _seen(found, F.struct(BUCKET, "version"))}

    def _read(self, spark: SparkSession, parts: set[Part]) -> DataFrame:
        if not parts:
            return spark.createDataFrame([], self.schema)
        return spark.read.schema(self.schema).parquet(*[f"{self.path}/data/of={v}/{BUCKET}={b}" for b, v in sorted(parts)])

    def _write(self, fresh: DataFrame, replaced: set[Part], version: int) -> None:
        spark = fresh.sparkSession
        rows = fresh.select(BUCKET, *self.schema.names)
        if replaced:
            old = self._placed(self._read(spark, replaced)).select(BUCKET, *self.schema.names, F.lit(True).alias("_stored"))
            both = rows.withColumn("_stored", F.lit(False)).unionByName(old)
            rows = self._best(both.repartition(BUCKET), (BUCKET,))  # already one row per key and side: nothing to combine before
        else:
            rows = rows.repartition(BUCKET)
        data = f"{self.path}/data/of={version}"
        rows.write.mode("overwrite").partitionBy(BUCKET).option("maxRecordsPerFile", 5_000_000).parquet(data)
        stored = self._placed(spark.read.schema(T.StructType([f for f in self.schema if f.name in self.keys])).parquet(f"{data}/{BUCKET}=*"))
        maps = stored.groupBy(BUCKET, "_page").agg(F.bitmap_construct_agg(F.col("_bit").cast("bigint")).alias("bits"))
        maps.withColumn("version", F.lit(version).cast("bigint")).write.mode("overwrite").partitionBy(BUCKET).parquet(
            f"{self.path}/keys/of={version}")

    def _commit(self, spark: SparkSession, parts: set[Part], done: dict[str, int], version: int) -> None:
        rows = [(b, v, None, None) for b, v in sorted(parts)] + [(None, None, s, b) for s, b in sorted(done.items())]
        spark.createDataFrame(rows, _LIST).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/list/of={version}")

    def _list(self, spark: SparkSession, version: int) -> tuple[set[Part], dict[str, int]]:
        """Parts of a version, and the last batch of every stream; as many rows as buckets x parts at most."""
        rows = spark.read.schema(_LIST).parquet(f"{self.path}/list/of={version}").collect()
        return {(r.bucket, r.version) for r in rows if r.bucket is not None}, {r.stream: r.batch for r in rows if r.stream is not None}

    def _files(self, spark: SparkSession, path: str):
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        return place, place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def _versions(self, spark: SparkSession) -> list[int]:
        """Complete versions, ascending."""
        place, files = self._files(spark, f"{self.path}/list")
        if not files.exists(place):
            return []
        names = [s.getPath().getName() for s in files.listStatus(place)]
        hadoop = spark._jvm.org.apache.hadoop.fs.Path
        return sorted(int(n[3:]) for n in names if n.startswith("of=") and files.exists(hadoop(f"{self.path}/list/{n}/_SUCCESS")))

    def _vacuum(self, spark: SparkSession) -> None:
        """Keep the last two versions, so that a reader of the one before the last can end."""
        versions = self._versions(spark)
        for old, following in zip(versions[:-2], versions[1:-1], strict=True):
            gone = self._list(spark, old)[0] - self._list(spark, following)[0]
            for bucket, version in gone:
                for kind in ("data", "keys"):
                    place, files = self._files(spark, f"{self.path}/{kind}/of={version}/{BUCKET}={bucket}")
                    files.delete(place, True)
            place, files = self._files(spark, f"{self.path}/list/of={old}")
            files.delete(place, True)
