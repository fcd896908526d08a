"""Answer files of raters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.functions import text as T
from tamis.operators.raters import latest_per_key

RATER_SCHEMA = """kind string, version string, `set` string, name string, sent_at string, user_agent string,
  answers array<struct<id: string, position: int, answer: string, seconds: double, times_answered: int, changed: boolean>>,
  _corrupt string"""


def read_rater_files(spark: SparkSession, path: str, set_name: str) -> tuple[DataFrame, DataFrame]:
    """(one row per answer of the newest file of each rater, skipped files with a reason).

    A document is one line; a file may hold one or many. Its stamp is the part of the file name between the last `--` and `.json`,
    which the receiver wrote, or else `sent_at` by the rater's clock."""
    raw = (spark.read.schema(RATER_SCHEMA).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt")
           .json(path).withColumn("file", F.col("_metadata.file_name")))
    named = raw.withColumn("rater", T.normalise_name(F.coalesce("name", F.lit(""))))
    reason = (F.when(F.col("_corrupt").isNotNull(), "unreadable").when(~F.col("set").eqNullSafe(F.lit(set_name)), "another set")
              .when(F.col("rater") == "", "no name"))
    marked = named.withColumn("reason", reason)
    good = marked.where("reason is null").withColumn(
        "stamp", F.regexp_replace(F.coalesce(F.nullif(F.regexp_extract("file", r"--(.*)\.json$", 1), F.lit("")), "sent_at"), "[^0-9]", "").try_cast("decimal(30,0)"))
    newest = latest_per_key(good.drop("_corrupt", "reason"), "rater", "stamp", "file")
    answers = newest.select("rater", "file", "user_agent", "sent_at", F.explode("answers").alias("a")).select(
        "rater", "file", "user_agent", "sent_at", F.col("a.id").alias("item_id"), "a.position", "a.answer", "a.seconds", "a.changed")
    return answers, marked.where("reason is not null").select("file", "reason")


def apply_alias(df: DataFrame, aliases: DataFrame, name: str = "rater") -> DataFrame:
    """Display name from a table (name, alias), the original when there is none."""
    a = aliases.select(F.col("name").alias("_n"), "alias")
    return df.join(a, df[name] == a["_n"], "left").withColumn("display", F.coalesce("alias", name)).drop("_n", "alias")
