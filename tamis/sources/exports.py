"""Spreadsheet exports. Every text cell is guarded, in the visit and in the group export alike."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.functions.text import csv_cell, guard_cell

VISIT_COLUMNS = ("plot_id", "village", "visit_date", "status", "includes_sample_photos", "photos", "answered")
BYTE_ORDER_MARK = "﻿"


def visit_export(rolled: DataFrame, classes: Sequence[str], created: str = "created") -> DataFrame:
    """The export projection: real visits only, text guarded, nulls blank."""
    real = rolled.where(~F.col("synthetic"))
    return real.select(
        F.col("plot_id").cast("string").alias("plot_id"), guard_cell(F.col("village")).alias("village"),
        F.date_format(created, "yyyy-MM-dd").alias("visit_date"), guard_cell(F.col("status")).alias("status"),
        F.col("has_samples").cast("string").alias("includes_sample_photos"),
        *[F.col(c).cast("string").alias(c) for c in ("photos", "answered")],
        *[F.col(f"n_{c}").cast("string").alias(c) for c in classes],
        F.col("waiting").cast("string").alias("waiting"), F.col("disputed").cast("string").alias("disputed"),
        F.coalesce("verdict", F.lit("")).alias("verdict"), guard_cell(F.col("variety")).alias("variety"))


def four_places(c: Column) -> Column:
    return F.coalesce(F.format_string("%.4f", c), F.lit(""))


def group_ranking_export(ranked: DataFrame, prior_source: str) -> DataFrame:
    return ranked.select(
        F.col("rank").cast("string").alias("rank"), guard_cell(F.col("village")).alias("village"),
        F.col("n").cast("string").alias("answered"), F.col("x").cast("string").alias("flagged"),
        *[F.when(F.col(c).isNotNull(), F.format_string("%.4f", F.col(c))).otherwise("").alias(c)
          for c in ("raw", "adjusted", "p_above")],
        F.col("alert").cast("string").alias("alert"), F.lit(prior_source).alias("prior_source"))


def write_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """Comma-separated text with a header, CRLF line ends and, in the header line of each part, a byte-order mark.

    Part files keep the write parallel; `single_file` is for exports that a person opens and are known to be small."""
    line = F.concat_ws(",", *[csv_cell(F.col(c).cast("string")) for c in df.columns]).alias("value")
    header = BYTE_ORDER_MARK + ",".join(df.columns)
    lines = df.select(line)
    if single_file:
        lines = lines.coalesce(1)

    def with_header(batches):
        import pyarrow as pa

        first = True
        for b in batches:
            if b.num_rows == 0:
                continue
            values = b.column(0)
            if first:
                values = pa.concat_arrays([pa.array([header], values.type), values])
                first = False
            yield pa.RecordBatch.from_arrays([values], names=["value"])

    if df.isEmpty():  # the header alone
        df.sparkSession.createDataFrame([(header,)], "value string").coalesce(1).write.mode("overwrite").option("lineSep", "\r\n").text(path)
        return
    lines.mapInArrow(with_header, "value string").write.mode("overwrite").option("lineSep", "\r\n").text(path)
