"""Review queue, visit and group roll-ups, label synchronisation, and the documented weekly measures.

Photos are always combined per visit before they meet the visits, so one visit or village that holds a third of all
photos is a single row by the time it is joined.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamis.functions import decisions as D
from tamis.functions import text as T
from tamis.operators.ranks import exact_quantiles

CORRECTION_KEY = ("id", "lang", "suggestion", "created")


def with_final_label(photos: DataFrame) -> DataFrame:
    return photos.withColumn("final_label", D.final_label(
        F.col("officer_label"), F.col("not_sure"), F.col("disputed"), F.col("label")))


def visit_counts(photos: DataFrame, classes: Sequence[str]) -> DataFrame:
    """One row per visit: photos, answered, problem rows, per-class counts, waiting, disputed, verdict."""
    lab = F.col("final_label")
    sick = lab.isNotNull() & (lab != "healthy")
    tree = F.when(sick, F.coalesce(F.col("tree"), F.lit(-1)))  # a missing tree counts as a tree of its own
    per = with_final_label(photos).groupBy("plot_id").agg(
        F.count(F.lit(1)).alias("photos"), F.count("final_label").alias("answered"), F.count_if(sick).alias("problems"),
        *[F.count_if(lab == c).alias(f"n_{c}") for c in classes],
        F.count_if(lab.isNull() & F.col("officer_label").isNull()).alias("waiting"),
        F.count_if("disputed").alias("disputed"),
        F.count_if(F.col("not_sure") & F.col("officer_label").isNull()).alias("card_waiting"),
        F.count_if(F.col("disputed") & F.col("officer_label").isNull()).alias("card_disputed"),
        F.min(tree).alias("_t0"), F.max(tree).alias("_t1"))
    trees = F.when(F.col("_t0") == F.col("_t1"), 1).when(F.col("_t0") < F.col("_t1"), 2).otherwise(0)
    return per.withColumn("verdict", D.visit_verdict(F.col("answered"), F.col("problems"), trees)).drop("_t0", "_t1")


def visits_with_photos(plots: DataFrame, photos: DataFrame, classes: Sequence[str]) -> DataFrame:
    """Every visit with its counts, zero when it has no photos."""
    counts = visit_counts(photos, classes)
    numeric = [c for c in counts.columns if c not in ("plot_id", "verdict")]
    return plots.join(counts, "plot_id", "left").select(
        *[plots[c] for c in plots.columns], *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in numeric], "verdict")


def group_rollup(plots: DataFrame, photos: DataFrame, target: str = "rust") -> DataFrame:
    """Per group name: visits, answered rows, target rows, waiting, flags. Synthetic visits bring stored counts."""
    joined = visits_with_photos(plots, photos, [target])
    real = ~F.col("synthetic")
    return joined.groupBy(T.group_key(F.col("village")).alias("village_key")).agg(
        F.min_by(T.group_display(F.col("village")), F.col("plot_id")).alias("village"),
        F.count(F.lit(1)).alias("visits"),
        F.sum(F.when(real, F.col("answered")).otherwise(F.col("synth_answered"))).cast("bigint").alias("n"),
        F.sum(F.when(real, F.col(f"n_{target}")).otherwise(F.col("synth_rust"))).cast("bigint").alias("x"),
        F.sum(F.when(real, F.col("waiting")).otherwise(0)).cast("bigint").alias("waiting"),
        F.bool_or("synthetic").alias("synthetic"), F.bool_or(real & F.col("has_samples")).alias("samples"))


def label_histogram(rows: DataFrame, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Map of label to count: one entry per label."""
    per = rows.where(F.col(label).isNotNull()).groupBy(*by, label).agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(label, "n")))).alias("counts"))


def queue(photos: DataFrame) -> DataFrame:
    return photos.where(D.in_queue(F.col("not_sure"), F.col("spot_check"), F.col("disputed"), F.col("officer_label")))


def queue_with_visit(photos: DataFrame, plots: DataFrame, columns: Sequence[str]) -> DataFrame:
    return queue(photos).join(plots.select("plot_id", *columns), "plot_id", "left")


def queue_stats(photos: DataFrame, classes: Sequence[str]) -> DataFrame:
    waiting = D.in_queue(F.col("not_sure"), F.col("spot_check"), F.col("disputed"), F.col("officer_label"))
    return photos.agg(F.count_if(waiting).alias("waiting"), F.count("officer_label").alias("reviewed"),
                      F.count_if(F.col("officer_label").isin(*classes)).alias("labelled"))


def set_disputed(photos: DataFrame, actions: DataFrame) -> DataFrame:
    """Apply (photo_id, on) actions unless a person has labelled the row."""
    acts = actions.select("photo_id", F.col("on").alias("_on"))
    change = F.col("_on").isNotNull() & F.col("officer_label").isNull()
    joined = photos.join(acts, "photo_id", "left")
    return joined.withColumn("disputed", F.when(change, F.col("_on")).otherwise(F.col("disputed"))).drop("_on")


def sync_labels(open_rows: DataFrame, store: DataFrame, key: str = "photo_id", label: str = "officer_label") -> DataFrame:
    """Copy the stored label onto the open records; adds changed."""
    s = store.select(key, F.col(label).alias("_l"), F.lit(True).alias("_in"))
    joined = open_rows.join(s, key, "left")
    differs = F.coalesce(F.col("_in"), F.lit(False)) & ~F.col(label).eqNullSafe(F.col("_l"))
    return joined.withColumn("changed", differs).withColumn(
        label, F.when(differs, F.col("_l")).otherwise(F.col(label))).drop("_l", "_in")


def discard_visits(plots: DataFrame, photos: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    ids = gone.select("plot_id").distinct()
    return plots.join(ids, "plot_id", "left_anti"), photos.join(ids, "plot_id", "left_anti")


def merge_corrections(old: DataFrame, new: DataFrame, key: Sequence[str] = CORRECTION_KEY) -> DataFrame:
    """Old records plus the unseen clean new ones, once per key; column added marks the new ones."""
    clean = new.select(*T.clean_fields(new.columns)).where(T.required(key))
    fresh = clean.join(old.select(*[F.col(k).cast("string").alias(k) for k in key]).distinct(), list(key), "left_anti")
    once = fresh.dropDuplicates(list(key)).select(*new.columns)
    return (old.select(*[F.col(c).cast("string").alias(c) for c in new.columns], F.lit(False).alias("added"))
            .unionByName(once.withColumn("added", F.lit(True))))


def remove_correction(corrections: DataFrame, gone: DataFrame, key: Sequence[str] = CORRECTION_KEY) -> DataFrame:
    return corrections.join(gone.select(*key).distinct(), list(key), "left_anti")


def open_visit(plots: DataFrame, updated: str) -> DataFrame:
    """The most recently updated visit in progress: one row."""
    return plots.where((F.col("status") == "in_progress") & ~F.col("synthetic")).orderBy(F.desc(updated), "plot_id").limit(1)


def known_villages(plots: DataFrame) -> DataFrame:
    return plots.where(~F.col("synthetic")).select(F.nullif(F.trim("village"), F.lit("")).alias("village")).where(
        "village is not null").distinct()


def recent_visits(plots: DataFrame, photos: DataFrame, created: str, size: int = 10) -> DataFrame:
    """The newest visits with their number of photos; only the listed visits are joined."""
    top = plots.where(~F.col("synthetic")).orderBy(F.desc(created), F.desc("plot_id")).limit(size)
    # at most `size` visits
    counts = photos.join(F.broadcast(top.select("plot_id")), "plot_id", "left_semi").groupBy("plot_id").agg(
        F.count(F.lit(1)).alias("photos"))
    return top.join(counts, "plot_id", "left").withColumn("photos", F.coalesce("photos", F.lit(0)))


def median_days_to_label(photos: DataFrame, created: Column, reviewed: Column) -> DataFrame:
    return exact_quantiles(photos, F.datediff(reviewed, created), [0.5]).select("n", F.col("q0").alias("median_days"))


def weekly_disagreement(photos: DataFrame, created: str = "created") -> DataFrame:
    """Per week and automatic class: answered rows, disputed share, and how often the reviewer sided with the person."""
    reviewed = F.col("disputed") & F.col("officer_label").isNotNull() & (F.col("officer_label") != "skip")
    sided = reviewed & (F.col("officer_label") != F.col("label"))
    return photos.where("label is not null").groupBy(F.date_trunc("week", created).alias("week"), "label").agg(
        F.count(F.lit(1)).alias("n"), (F.count_if("disputed") / F.count(F.lit(1))).alias("disputed_share"),
        F.count_if(reviewed).alias("disputed_reviewed"),
        (F.count_if(sided) / F.nullif(F.count_if(reviewed), F.lit(0))).alias("sided_with_person"))


def recent_group_view(plots: DataFrame, photos: DataFrame, until: Column, days: int = 30, tap: str = "variety") -> DataFrame:
    """Per group and tap value: photos, target rows and the share of the group's photos in the last `days`."""
    window = (F.col("created") > until - F.expr(f"interval {days} days")) & (F.col("created") <= until)
    per = with_final_label(photos.where(window)).groupBy("plot_id").agg(
        F.count(F.lit(1)).alias("photos"), F.count_if(F.col("final_label") == "rust").alias("rust"))
    cell = per.join(plots, "plot_id").groupBy(T.group_key(F.col("village")).alias("village_key"), tap).agg(
        F.sum("photos").alias("photos"), F.sum("rust").alias("rust"))
    # few tap values per group
    whole = F.sum("photos").over(Window.partitionBy("village_key"))
    return cell.withColumn("share_of_group", F.col("photos") / whole)


def pause_alerts(photos: DataFrame, until: Column, routed_share: Column, max_days: int = 30, max_routed: float = 0.05) -> DataFrame:
    """(rule, value, paused): oldest waiting row in days, and share of healthy test rows routed away after an update."""
    oldest = queue(photos).agg(F.max(F.datediff(until, F.col("created"))).cast("double").alias("value"))
    routed = photos.sparkSession.range(1).select(routed_share.cast("double").alias("value"))
    return oldest.select(F.lit("queue_age").alias("rule"), "value", F.coalesce(F.col("value") > max_days, F.lit(False)).alias("paused")).unionByName(
        routed.select(F.lit("healthy_routed").alias("rule"), "value", F.coalesce(F.col("value") > max_routed, F.lit(False)).alias("paused")))
