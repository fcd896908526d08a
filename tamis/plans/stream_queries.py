"""Streaming queries over the test tables; each must equal its batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from tamis.functions import decisions as D
from tamis.operators import review as R
from tamis.plans import views as W
from tamis.plans.aggregate_queries import CLASSES
from tamis.plans.registry import query
from tamis.session import scratch_path
from tamis.streaming import jobs as J
from tamis.streaming import state as S
from tamis.streaming.keyed import KeyedTable


@query("t01_stream_score_route", W.with_views("decided", "SELECT item_id, top::INT AS top, answered, reason FROM decided"))
def t01(spark, sf):
    _, head = W.scored(spark, sf)
    items = W.items(spark, sf)
    stream = J.arrivals(items, "item_id")
    out = scratch_path(spark, "scored")
    J.run_available(J.score_and_route(stream, head, W.reference(spark, sf)).select("item_id", "top", "answered", "reason"), out, scratch_path(spark, "cp"))
    return spark.read.schema("item_id bigint, top int, answered boolean, reason string").parquet(out)


@query("t02_stream_queue_backlog", W.with_views("finals", """SELECT count(*) FILTER (WHERE in_queue) AS waiting, count(officer_label) AS reviewed,
  count(*) FILTER (WHERE officer_label IN ('healthy', 'rust', 'other')) AS labelled FROM finals"""))
def t02(spark, sf):
    """Every photo arrives unlabelled; its label, when there is one, arrives later as a second record of the same key. The counts are
    the sum of one line of changes per batch."""
    photos = W.photos(spark, sf).select("photo_id", "not_sure", "spot_check", "disputed", "officer_label", F.col("created").alias("at"))
    first = photos.withColumn("officer_label", F.lit(None).cast("string"))
    second = photos.where("officer_label is not null").withColumn("at", F.col("at") + F.expr("interval 40 days"))
    label = F.col("officer_label")
    flags = {"waiting": D.in_queue(F.col("not_sure"), F.col("spot_check"), F.col("disputed"), label),
             "reviewed": label.isNotNull(), "labelled": label.isin(*CLASSES)}
    # the replayed files come in no fixed order, so the hold spans the years of the table
    changes = S.count_changes(J.arrivals(first.unionByName(second), "at"), "photo_id", "at", label, label.isNotNull(), flags, "10000 days",
                              buckets=photos.count() // 256 + 1)
    out = scratch_path(spark, "log")
    sums = [F.coalesce(F.sum(n), F.lit(0)).cast("bigint").alias(n) for n in flags]
    with S.state_store(spark):
        J.run_batches(changes, lambda df, i: J.batch_log(out)(df.agg(*sums), i), scratch_path(spark, "cp"), "append")
    return spark.read.schema("waiting bigint, reviewed bigint, labelled bigint").parquet(out).agg(*sums)


_WINDOWS = """AND b AS (SELECT grp, time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01') AS start, flagged FROM ev)
  SELECT grp, start, start + INTERVAL 7 DAY AS "end", count(*) AS n, count(*) FILTER (WHERE flagged) AS x FROM b
  WHERE start + INTERVAL 7 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM ev) GROUP BY 1, 2, 3"""


@query("t03_stream_group_rollup", W.with_views("ev", _WINDOWS))
def t03(spark, sf):
    ev = W.ev(spark, sf).select("ts", "grp", "flagged")
    stream = J.arrivals(ev, "ts")
    out = scratch_path(spark, "windows")
    J.run_available(J.group_windows(stream, "ts", "grp", F.col("flagged")), out, scratch_path(spark, "cp"))
    return spark.read.schema("grp bigint, start timestamp, end timestamp, n bigint, x bigint").parquet(out)


@query("t04_stream_latest_submission", W.with_views("ev", """SELECT grp, event_id, event_type FROM (SELECT *, row_number() OVER (
  PARTITION BY grp ORDER BY date_trunc('hour', ts) DESC, event_id) AS rn FROM ev) WHERE rn = 1"""))
def t04(spark, sf):
    ev = W.ev(spark, sf).select("grp", "event_id", "event_type", F.unix_seconds(F.date_trunc("hour", "ts")).alias("stamp"))
    newest = KeyedTable(scratch_path(spark, "latest"), ev.schema, ["grp"], ["stamp", "-event_id"], buckets=8, pages=1)
    J.run_batches(J.arrivals(ev, "event_id"), newest.sink(), scratch_path(spark, "cp"), "append")
    return newest.rows(spark).select("grp", "event_id", "event_type")


@query("t05_stream_corrections_merge", W.with_views("ev", "SELECT DISTINCT grp, event_type, date_trunc('hour', ts)::TIMESTAMP AS created FROM ev"))
def t05(spark, sf):
    """The same records arrive twice; each is kept once."""
    ev = W.ev(spark, sf).select("grp", "event_type", F.date_trunc("hour", "ts").alias("created"), "event_id")
    twice = ev.unionByName(ev.withColumn("event_id", F.col("event_id") + 1_000_000_000))
    kept = KeyedTable(scratch_path(spark, "corrections"), twice.schema, ["grp", "event_type", "created"], buckets=8)
    J.run_batches(J.arrivals(twice, "event_id"), kept.sink(), scratch_path(spark, "cp"), "append")
    return kept.rows(spark).select("grp", "event_type", "created")


@query("t06_late_labels", W.with_views("finals", """SELECT final_label, count(*) AS n FROM finals GROUP BY 1"""))
def t06(spark, sf):
    """Labels that arrive long after their photo still count: photos and labels are two keyed tables joined on read."""
    photos = W.photos(spark, sf).select("photo_id", "not_sure", "disputed", "label", F.col("created").alias("ts"))
    labels = W.photos(spark, sf).where("officer_label is not null").select(
        "photo_id", "officer_label", (F.col("created") + F.expr("interval 400 days")).alias("ts"))
    kept = []
    for rows, order in ((photos, []), (labels, ["ts", "officer_label"])):
        table = KeyedTable(scratch_path(spark, "table"), rows.schema, ["photo_id"], order, buckets=8)
        J.run_batches(J.arrivals(rows, "ts"), table.sink(), scratch_path(spark, "cp"), "append")
        kept.append(table.rows(spark))
    joined = kept[0].join(kept[1].select("photo_id", "officer_label"), "photo_id", "left")
    return R.with_final_label(joined).groupBy("final_label").agg(F.count(F.lit(1)).alias("n"))
