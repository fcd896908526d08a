"""Head documents, reference tables and head updates."""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.functions import vectors as V
from tamis.operators.scoring import Head

HEAD_SCHEMA = """version string, classes array<string>, embed_dim int, W array<array<double>>, b array<double>,
  temperature double, threshold double, high_band double, prior_strength double, route_to_officer array<string>,
  ood struct<metric: string, k: int, cutoff: double, local_nearest_cutoff: double,
             reference: struct<file: string, n: int, dim: int>>"""
UPDATE_KIND = "head-update"
UPDATE_SCHEMA = """kind string, base_version string, n_labels int, source string, W array<array<double>>, b array<double>,
  reference_add struct<int8: array<array<int>>, scale: array<double>>, labels array<string>,
  wording_corrections array<map<string, string>>"""


def head_rows(document: DataFrame) -> DataFrame:
    """One row per class of a head document: (version, class_idx, class, w, b)."""
    rows = F.posexplode(F.arrays_zip(F.col("classes").alias("c"), F.col("W").alias("w"), F.col("b").alias("b")))
    return document.select("version", rows.alias("class_idx", "r")).select(
        "version", "class_idx", F.col("r.c").alias("class"), F.col("r.w").alias("w"), F.col("r.b").alias("b"))


def read_head_document(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(HEAD_SCHEMA).option("multiLine", True).json(path)


def read_head(spark: SparkSession, path: str) -> Head:
    """The head of one document; absent optional fields switch the feature off. Refuses wrong shapes."""
    d = read_head_document(spark, path).first()  # one document
    w = np.array([list(r) for r in d.W], dtype=np.float64)
    if w.ndim != 2 or w.shape != (len(d.classes), d.embed_dim) or len(d.b) != len(d.classes):
        raise ValueError("weights do not match the classes and the dimension of the head")
    ood = d.ood
    return Head(tuple(d.classes), w, np.array(list(d.b)), d.temperature, d.threshold,
                (ood.k if ood is not None and ood.k is not None else 10), ood.cutoff if ood is not None else None,
                ood.local_nearest_cutoff if ood is not None else None, d.high_band,
                d.prior_strength if d.prior_strength is not None else 1.0,
                tuple(d.classes.index(c) for c in (d.route_to_officer or []) if c in d.classes), d.version)


def write_head(spark: SparkSession, head: Head, path: str) -> None:
    """One JSON document, weights rounded to six places."""
    ood = {"metric": "knn_cosine", "k": head.k}
    if head.cutoff is not None:
        ood["cutoff"] = head.cutoff
    if head.local_cutoff is not None:
        ood["local_nearest_cutoff"] = head.local_cutoff
    doc = {"version": head.version, "classes": list(head.classes), "embed_dim": head.dim,
           "W": [[round(float(x), 6) for x in r] for r in head.weights], "b": [round(float(x), 6) for x in head.bias],
           "temperature": head.temperature, "threshold": head.threshold, "prior_strength": head.prior_strength, "ood": ood}
    if head.routed:
        doc["route_to_officer"] = [head.classes[i] for i in head.routed]
    if head.high_band is not None:
        doc["high_band"] = head.high_band
    spark.createDataFrame([(json.dumps(doc),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def build_reference(df: DataFrame, item_id: str = "item_id", vector: str = "e", origin: str = "shipped") -> DataFrame:
    """(ref_id, q, scale, origin): normalised rows as int8 with one scale each."""
    unit = V.l2_normalise(F.col(vector))
    rows = df.select(F.col(item_id).alias("ref_id"), unit.alias("_u"))
    return rows.select("ref_id", V.quantise(F.col("_u")).alias("q"), V.quantise_scale(F.col("_u")).cast("float").alias("scale"),
                       F.lit(origin).alias("origin"))


def write_reference(reference: DataFrame, path: str) -> None:
    reference.write.mode("overwrite").parquet(path)


def load_reference(reference: DataFrame) -> DataFrame:
    """(ref_id, e, origin): dequantised unit rows."""
    return reference.select("ref_id", V.dequantise(F.col("q"), F.col("scale")).alias("e"), "origin")


def extend_reference(shipped: DataFrame, reviewed: DataFrame) -> DataFrame:
    return shipped.unionByName(reviewed, allowMissingColumns=True)


def export_update(spark: SparkSession, base: Head, adapted: Head, added: DataFrame, labels: DataFrame,
                  corrections: DataFrame | None, path: str, source: str = "reviewed labels",
                  max_rows: int = 100_000) -> None:
    """One update document: adapted weights, added reference rows, labels, corrections.

    The document is one JSON value by definition, so the number of rows it may carry is checked first."""
    for part in (added, labels, corrections):
        n = 0 if part is None else part.count()
        if n > max_rows:
            raise ValueError(f"{n} rows do not fit one update document; send them as a table instead")
    head = spark.createDataFrame([(UPDATE_KIND, base.version, source, [[round(float(x), 6) for x in r] for r in adapted.weights],
                                   [round(float(x), 6) for x in adapted.bias])],
                                 "kind string, base_version string, source string, W array<array<double>>, b array<double>")
    rows = F.array_sort(F.collect_list(F.struct("ref_id", "q", "scale")))
    refs = added.agg(rows.alias("r")).select(F.struct(
        F.transform("r", lambda x: x["q"].cast("array<int>")).alias("int8"),
        F.transform("r", lambda x: x["scale"].cast("double")).alias("scale")).alias("reference_add"))
    names = labels.agg(F.transform(F.array_sort(F.collect_list(F.struct("ref_id", "label"))), lambda x: x["label"]).alias("labels"))
    if corrections is None:
        notes = spark.range(1).select(F.expr("cast(array() as array<map<string,string>>)").alias("wording_corrections"))
    else:
        entry = F.create_map(*[x for c in corrections.columns for x in (F.lit(c), F.col(c).cast("string"))])
        notes = corrections.agg(F.collect_list(entry).alias("wording_corrections"))
    # four one-row tables
    doc = head.join(F.broadcast(refs)).join(F.broadcast(names)).join(F.broadcast(notes)).withColumn("n_labels", F.size("labels"))
    doc.select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def read_updates(spark: SparkSession, path: str) -> DataFrame:
    return (spark.read.schema(UPDATE_SCHEMA + ", _corrupt string").option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", "_corrupt").json(path).withColumn("file", F.col("_metadata.file_name")))


def check_updates(updates: DataFrame, version: str, classes: Sequence[str], dim: int) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with reason)."""
    wrong_shape = ((F.size("W") != len(classes)) | F.exists("W", lambda r: F.size(r) != dim) | (F.size("b") != len(classes)))
    reason = (F.when(F.coalesce(F.col("kind") != UPDATE_KIND, F.lit(True)), "not an update")
              .when(F.coalesce(F.col("base_version") != version, F.lit(True)), "made for another head")
              .when(F.coalesce(wrong_shape, F.lit(True)), "weights do not match"))
    marked = updates.withColumn("reason", reason)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null").select("file", "reason")


def added_rows(updates: DataFrame) -> DataFrame:
    """(file, place, e): the dequantised reference rows of accepted updates."""
    zipped = F.arrays_zip(F.col("reference_add.int8").alias("q"), F.col("reference_add.scale").alias("s"))
    rows = updates.select("file", F.posexplode(zipped).alias("place", "r"))
    return rows.select("file", "place", V.dequantise(F.col("r.q"), F.col("r.s")).alias("e"))
