"""Checks that refuse bad inputs; each returns the offending rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def validate_head(head_rows: DataFrame, dim: int, classes: Sequence[str]) -> DataFrame:
    """(class, problem): wrong length, missing bias or missing class."""
    wrong = head_rows.select("class", F.when(F.size("w") != dim, "wrong length").when(F.col("b").isNull(), "no bias").alias("problem"))
    wanted = head_rows.sparkSession.createDataFrame([(c,) for c in classes], "class string")
    missing = wanted.join(head_rows, "class", "left_anti").select("class", F.lit("missing class").alias("problem"))
    return wrong.where("problem is not null").unionByName(missing)


def changed_keys(old: DataFrame, new: DataFrame, key: str, value: str, exempt: Sequence[str] = ()) -> DataFrame:
    """Keys whose value differs between two releases, absent counting as null."""
    o = old.select(key, F.col(value).alias("old_value"))
    n = new.select(key, F.col(value).alias("new_value"))
    both = o.join(n, key, "full_outer").where(~F.col("old_value").eqNullSafe(F.col("new_value")))
    return both.where(~F.col(key).isin(*exempt)) if exempt else both


def same_artifact(result: DataFrame, head: DataFrame, key: str = "field", value: str = "value") -> DataFrame:
    """Fields in which a result and the head in use differ; must be empty."""
    return changed_keys(result, head, key, value)


def checksum_filter(df: DataFrame, content: Column, expected: Column) -> DataFrame:
    """Rows whose stored hash is empty or equals the hash of the content."""
    return df.where(expected.isNull() | (expected == "") | (F.sha2(content, 256) == expected))


def drop_reason(size: Column, present: Column, readable: Column, content: Column, expected: Column) -> Column:
    """Why an input is dropped; the first reason wins, null keeps it."""
    return (F.when(size == 0, "empty_file").when(~present, "missing")
            .when((F.coalesce(expected, F.lit("")) != "") & (F.sha2(content, 256) != expected), "checksum_mismatch")
            .when(~readable, "unreadable"))


def paired_rows_check(first: DataFrame, second: DataFrame, item_id: str, vector: str, decision: str) -> DataFrame:
    """Two runs on the same rows: rows, smallest cosine, largest difference, equal decisions."""
    from tamis.functions import vectors as V

    a = first.select(item_id, F.col(vector).alias("_a"), F.col(decision).alias("_da"))
    b = second.select(item_id, F.col(vector).alias("_b"), F.col(decision).alias("_db"))
    gap = F.array_max(F.zip_with("_a", "_b", lambda x, y: F.abs(x - y)))
    return a.join(b, item_id).agg(F.count(F.lit(1)).alias("n"), F.min(V.cosine(F.col("_a"), F.col("_b"))).alias("min_cosine"),
                                  F.max(gap).alias("max_abs_difference"), F.count_if(F.col("_da").eqNullSafe(F.col("_db"))).alias("same_decision"))
