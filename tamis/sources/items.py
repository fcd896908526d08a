"""Item tables, manifests, annotations and labelled folders."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

INDEX_SCHEMA = "item_id bigint, source string, label string, detail string, `group` string, path string"
EMBEDDING_SCHEMA = "item_id bigint, embedding array<float>"
MANIFEST_SCHEMA = "cls string, filename string, id string, size bigint, sha256 string, url string"
ANNOTATION_SCHEMA = T.StructType([T.StructField("name", T.StringType()), T.StructField("objects", T.ArrayType(T.StructType([
    T.StructField("classTitle", T.StringType())])))])


def read_items(spark: SparkSession, index: str, embeddings: str) -> DataFrame:
    """The item index joined to its vectors by key; fails when a key is missing on either side."""
    rows = spark.read.schema(INDEX_SCHEMA).parquet(index)
    vectors = spark.read.schema(EMBEDDING_SCHEMA).parquet(embeddings)
    lost = rows.select("item_id", F.lit(1).alias("a")).join(
        vectors.select("item_id", F.lit(1).alias("b")), "item_id", "full_outer").agg(
        F.count_if(F.col("b").isNull()).alias("without_vector"), F.count_if(F.col("a").isNull()).alias("without_index")).first()
    if lost.without_vector or lost.without_index:
        raise ValueError(f"index and vectors do not match: {lost.asDict()}")
    return rows.join(vectors, "item_id")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST_SCHEMA).option("sep", "\t").option("header", True).csv(path)


def write_manifest(df: DataFrame, path: str) -> None:
    df.select("cls", "filename", "id", "size", "sha256", "url").write.option("sep", "\t").option("header", True).csv(path)


def single_class(titles: Column, generic: str = "unhealthy") -> Column:
    """The one specific class of an annotation, null when there is none or more than one."""
    kept = F.array_except(F.array_distinct(titles), F.array(F.lit(generic)))
    return F.when(F.size(kept) == 1, F.get(kept, F.lit(0)))


def annotation_label(detail: Column) -> Column:
    return (F.when(detail.startswith("rust"), "rust").when(detail == "healthy", "healthy").when(detail.isNotNull(), "mite"))


def read_annotations(spark: SparkSession, path: str, generic: str = "unhealthy", multi_line: bool = True) -> DataFrame:
    """(file, detail, label) of the annotations with exactly one specific class. One document per file by default; many
    documents per file, one per line with their name, when `multi_line` is off."""
    raw = spark.read.schema(ANNOTATION_SCHEMA).option("multiLine", multi_line).json(path)
    titles = F.transform("objects", lambda o: o["classTitle"])
    file = F.coalesce("name", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1))
    return (raw.select(file.alias("file"),
                       single_class(titles, generic).alias("detail"))
            .where("detail is not null").withColumn("label", annotation_label(F.col("detail"))))


def read_labelled_folders(spark: SparkSession, path: str, folder_labels: Mapping[str, str],
                          suffixes: Sequence[str] = ("jpg", "jpeg", "png")) -> DataFrame:
    """(path, label) of the files below labelled folders; folders without a label are left out. Content is not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    pattern = r"(?i)\.(" + "|".join(suffixes) + r")$"
    folder = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    table = F.create_map(*[F.lit(x) for p in folder_labels.items() for x in p])
    return files.where(F.col("path").rlike(pattern)).select(
        "path", F.try_element_at(table, folder).alias("label")).where("label is not null")


def read_coded_labels(spark: SparkSession, path: str, codes: Mapping[int, str], id_column: str = "id",
                      code_column: str = "predominant_stress") -> DataFrame:
    """(id, label) of a coded CSV; unknown codes are dropped."""
    raw = spark.read.schema(f"{id_column} string, {code_column} int").option("header", True).csv(path)
    table = F.create_map(*[F.lit(x) for p in codes.items() for x in p])
    return raw.select(id_column, F.try_element_at(table, F.col(code_column)).alias("label")).where("label is not null")


def count_by(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


def write_index(df: DataFrame, path: str, partition: str = "source") -> None:
    """The item index, one folder per source so that later scans read only the sources they name."""
    df.write.mode("overwrite").partitionBy(partition).parquet(path)


def append_run_log(runs: DataFrame, path: str) -> None:
    runs.write.mode("append").json(path)
