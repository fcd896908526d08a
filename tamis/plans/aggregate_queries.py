"""Evaluation and roll-up aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tamis.functions import text as T
from tamis.functions import vectors as V
from tamis.functions.edits import list_distance
from tamis.operators import components as CC
from tamis.operators import metrics as M
from tamis.operators import neighbours as N
from tamis.operators import priors as PR
from tamis.operators import raters as RT
from tamis.operators import review as R
from tamis.operators import scoring as S
from tamis.operators import shrinkage as SH
from tamis.operators import validation as VAL
from tamis.operators.ranks import exact_quantiles
from tamis.plans import views as W
from tamis.plans.registry import query
from tamis.session import cut_lineage
from tamis.sources.items import count_by


def rounded(df, places=6):
    """All double columns rounded."""
    return df.select(*[F.round(f.name, places).alias(f.name) if f.dataType.simpleString() == "double" else F.col(f.name)
                       for f in df.schema.fields])


@query("a01_count_by", W.with_views("items", "SELECT split, class_idx, count(*) AS n FROM items GROUP BY 1, 2"))
def a01(spark, sf):
    return count_by(W.items(spark, sf), "split", "class_idx")


@query("a02_dimension_stats", W.with_views("items", """SELECT (i - 1)::INT AS dim, round(avg(x), 6) AS mean, round(stddev_pop(x) + 1e-6, 6) AS sd FROM (
  SELECT unnest(e) AS x, generate_subscripts(e, 1) AS i FROM items WHERE split = 'train') GROUP BY 1"""))
def a02(spark, sf):
    return rounded(S.dimension_stats(W.items(spark, sf).where("split = 'train'")))


@query("a03_class_centroids", W.with_views("cent", """SELECT class_idx, (generate_subscripts(c, 1) - 1)::INT AS i, round(unnest(c), 6) AS x FROM cent"""))
def a03(spark, sf):
    cents = S.class_centroids(W.items(spark, sf).where("split = 'train'"))
    return rounded(cents.select("class_idx", F.posexplode("centroid").alias("i", "x")))


@query("a04_centroid_distance", W.with_views("items cent", """SELECT item_id, round(1 - max(list_cosine_similarity(e, c)), 6) AS distance
  FROM items CROSS JOIN cent GROUP BY 1"""))
def a04(spark, sf):
    return rounded(centroid_distance(W.items(spark, sf), W.items(spark, sf).where("split = 'train'")), 6)


def centroid_distance(rows, train):
    """1 - max cosine to a class centroid; one centroid per class is shipped."""
    cents = S.class_centroids(train).select(F.col("class_idx").cast("bigint").alias("ref_id"), F.col("centroid").alias("e"))
    return N.knn_distance(rows, cents, 1)


_RULE = """count(*) AS n, round(avg(answered::INT), 6) AS coverage, round(avg((NOT answered)::INT), 6) AS not_sure,
  round(avg((top = class_idx)::INT) FILTER (WHERE answered), 6) AS acc_answered, round(avg((forced = class_idx)::INT), 6) AS acc_all,
  round(avg((forced = class_idx)::INT) FILTER (WHERE NOT answered), 6) AS acc_not_sure_if_forced,
  round(avg(((top = 0) = (class_idx = 0))::INT) FILTER (WHERE answered), 6) AS healthy_vs_problem_answered,
  round(count(*) FILTER (WHERE top = 1 AND answered AND class_idx = 1) / greatest(1, count(*) FILTER (WHERE class_idx = 1)), 6) AS target_named,
  round(count(*) FILTER (WHERE top <> 0 AND answered AND class_idx = 0) / greatest(1, count(*) FILTER (WHERE class_idx = 0)), 6) AS healthy_flagged,
  round(count(*) FILTER (WHERE top = 1 AND answered AND class_idx = 1) / greatest(1, count(*) FILTER (WHERE answered AND class_idx = 1)), 6) AS sensitivity_answered,
  round(count(*) FILTER (WHERE top = 1 AND answered AND class_idx = 0) / greatest(1, count(*) FILTER (WHERE answered AND class_idx = 0)), 6) AS false_positive_rate_answered,
  round(avg(max_prob), 6) AS mean_confidence, round(avg((NOT confident AND familiar AND NOT routed)::INT), 6) AS not_sure_low_confidence,
  round(avg((NOT familiar AND NOT routed)::INT), 6) AS not_sure_unfamiliar, round(avg(routed::INT), 6) AS routed_other,
  round(count(*) FILTER (WHERE routed AND class_idx = 1) / greatest(1, count(*) FILTER (WHERE class_idx = 1)), 6) AS target_routed_other,
  round(count(*) FILTER (WHERE routed AND class_idx = 0) / greatest(1, count(*) FILTER (WHERE class_idx = 0)), 6) AS healthy_routed_other"""


@query("a05_rule_metrics", W.with_views("decided", f"SELECT split, {_RULE} FROM decided WHERE class_idx <> 9 GROUP BY 1"))
def a05(spark, sf):
    known = W.decided(spark, sf).where(f"class_idx <> {W.OTHER}")
    return rounded(M.rule_metrics(known, by=["split"]))


@query("a06_out_of_scope", W.with_views("decided", """SELECT split, count(*) AS n, round(avg((NOT answered)::INT), 6) AS not_sure,
  round(avg((NOT confident AND familiar AND NOT routed)::INT), 6) AS not_sure_low_confidence,
  round(avg((NOT familiar AND NOT routed)::INT), 6) AS not_sure_unfamiliar, round(avg(routed::INT), 6) AS routed_other,
  round(avg((answered AND top = 1)::INT), 6) AS called_target, round(avg((answered AND top = 0)::INT), 6) AS called_healthy
  FROM decided WHERE class_idx = 9 GROUP BY 1"""))
def a06(spark, sf):
    return rounded(M.out_of_scope_metrics(W.decided(spark, sf).where(f"class_idx = {W.OTHER}"), by=["split"]))


@query("a06_answered_as", W.with_views("decided", """SELECT string_agg(top || '=' || n, ',' ORDER BY top) AS answered_as, split FROM (
  SELECT split, top, count(*) AS n FROM decided WHERE answered GROUP BY 1, 2) GROUP BY split"""))
def a06_map(spark, sf):
    called = M.answered_as(W.decided(spark, sf), by=["split"])
    entries = F.transform(F.array_sort(F.map_entries("answered_as")), lambda e: F.concat_ws("=", e["key"].cast("string"), e["value"].cast("string")))
    return called.select("split", F.array_join(entries, ",").alias("answered_as"))


@query("a07_ece", W.with_views("scored", """SELECT split, sum(n)::BIGINT AS n, round(sum(abs(k - s)) / sum(n), 6) AS ece FROM (
  SELECT split, ceil(max_prob * 10)::INT AS b, count(*) AS n, sum((top = class_idx)::INT) AS k, sum(max_prob) AS s FROM scored GROUP BY 1, 2) GROUP BY 1"""))
def a07(spark, sf):
    rows, _ = W.scored(spark, sf)
    return rounded(M.ece(rows, F.col("top") == F.col("class_idx"), by=["split"]))


@query("a08_mean_nll", W.with_views("lg items", """SELECT split, count(*) AS n,
  round(avg(ln(list_sum(list_transform(z, lambda v: exp(v - list_max(z))))) + list_max(z) - z[class_idx + 1]), 6) AS nll
  FROM lg JOIN items USING (item_id) GROUP BY 1"""))
def a08(spark, sf):
    rows = S.score(W.items(spark, sf), W.head(spark, sf))
    loss = V.log_loss(F.col("logits"), F.col("class_idx"))
    return rounded(rows.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.avg(loss).alias("nll")))


@query("a09_confusion", W.with_views("scored", "SELECT class_idx, " + ", ".join(
    f"count(*) FILTER (WHERE top = {c}) AS pred_{c}" for c in range(10)) + " FROM scored GROUP BY 1"))
def a09(spark, sf):
    rows, _ = W.scored(spark, sf)
    return M.confusion(rows, range(10))


_SHARES = {
    "answered_share": ("answered", "true"), "correct_of_answered": ("answered AND top = class_idx", "answered"),
    "correct_of_all": ("answered AND top = class_idx", "true"), "forced_correct": ("forced = class_idx", "true"),
    "target_named": ("answered AND top = 1", "class_idx = 1"), "healthy_flagged": ("answered AND top <> 0", "class_idx = 0"),
    "sick_called_a_problem": ("answered AND top <> 0", "class_idx <> 0"),
    "healthy_vs_problem_of_answered": ("(top = 0) = (class_idx = 0)", "answered"),
    "not_sure_low_confidence": ("coalesce(reason2 = 'low_confidence', false)", "true"),
    "not_sure_unfamiliar": ("coalesce(reason2 = 'unfamiliar', false)", "true"),
    "routed_as_other": ("coalesce(reason2 = 'other', false)", "true")}


def shares_sql(weight: str = "w") -> str:
    return ", ".join(f"round(coalesce(sum({weight}) FILTER (WHERE ({h}) AND ({b})), 0) / nullif(sum({weight}) FILTER (WHERE {b}), 0), 6) AS {n}"
                     for n, (h, b) in _SHARES.items())


_WEIGHTED = """AND d AS (SELECT *, class_idx || '-' || (item_id % 7) AS grp FROM decided WHERE split <> 'train'),
  x AS (SELECT *, 1.0 / count(*) OVER (PARTITION BY grp) AS w FROM d)"""


def grouped(spark, sf):
    """Decided rows outside training, with a copy-group key."""
    return W.decided(spark, sf, exclusive=True).where("split <> 'train'").withColumn(
        "grp", F.concat_ws("-", F.col("class_idx").cast("string"), (F.col("item_id") % 7).cast("string")))


@query("a10_weighted_shares", W.with_views("decided", _WEIGHTED + f"""
  SELECT count(*) AS n, round(sum(w), 6) AS n_effective, {shares_sql()}, round(sum(w * max_prob) / sum(w), 6) AS mean_confidence FROM x"""))
def a10(spark, sf):
    return rounded(M.weighted_shares(grouped(spark, sf), M.standard_measures(F.col("class_idx")), "grp",
                                     means={"mean_confidence": F.col("max_prob")}))


@query("a10_shares_by_class", W.with_views("decided", _WEIGHTED + """
  SELECT class_idx, count(*) AS n, round(sum(w), 6) AS n_effective, round(coalesce(sum(w) FILTER (WHERE answered AND top = class_idx), 0) / sum(w), 6) AS right_share,
    round(coalesce(sum(w) FILTER (WHERE NOT answered), 0) / sum(w), 6) AS routed_share,
    round(coalesce(sum(w) FILTER (WHERE answered AND top <> class_idx), 0) / sum(w), 6) AS answered_wrong FROM x GROUP BY 1"""))
def a10_class(spark, sf):
    every, ans, right = F.lit(True), F.col("answered"), F.col("top") == F.col("class_idx")
    measures = {"right_share": (ans & right, every), "routed_share": (~ans, every), "answered_wrong": (ans & ~right, every)}
    return rounded(M.weighted_shares(grouped(spark, sf), measures, "grp", by=["class_idx"]))


@query("a10_answered_as", W.with_views("decided", _WEIGHTED + """, t AS (SELECT class_idx, sum(w) AS base FROM x GROUP BY 1)
  SELECT class_idx, top::INT AS top, round(coalesce(sum(w) FILTER (WHERE answered), 0) / any_value(base), 6) AS answered_as,
    round(sum(w) / any_value(base), 6) AS forced_as FROM x JOIN t USING (class_idx) GROUP BY 1, 2"""))
def a10_called(spark, sf):
    rows = grouped(spark, sf)
    per = rows.groupBy("class_idx", "grp", "top").agg(F.count(F.lit(1)).alias("n"), F.count_if("answered").alias("a"))
    size = per.groupBy("grp").agg(F.sum("n").alias("size"))  # a copy group belongs to one class
    cell = per.join(size, "grp").groupBy("class_idx", "top").agg(F.sum(F.col("a") / F.col("size")).alias("wa"),
                                                                F.sum(F.col("n") / F.col("size")).alias("wn"))
    base = cell.groupBy("class_idx").agg(F.sum("wn").alias("base"))
    return rounded(cell.join(base, "class_idx").select("class_idx", "top", (F.col("wa") / F.col("base")).alias("answered_as"),
                                                       (F.col("wn") / F.col("base")).alias("forced_as")))


ROLLUP_SQL = """AND pc AS (SELECT plot_id, count(final_label) AS a, count(*) FILTER (WHERE final_label = 'rust') AS r,
    count(*) FILTER (WHERE final_label IS NULL AND officer_label IS NULL) AS w FROM finals GROUP BY 1),
  roll AS (SELECT lower(trim(village)) AS village_key, arg_min(trim(village), p.plot_id) AS village, count(*) AS visits,
    sum(CASE WHEN synthetic THEN synth_answered ELSE coalesce(a, 0) END)::BIGINT AS n,
    sum(CASE WHEN synthetic THEN synth_rust ELSE coalesce(r, 0) END)::BIGINT AS x,
    sum(CASE WHEN synthetic THEN 0 ELSE coalesce(w, 0) END)::BIGINT AS waiting, bool_or(synthetic) AS synthetic,
    bool_or(NOT synthetic AND has_samples) AS samples FROM plots p LEFT JOIN pc USING (plot_id) GROUP BY 1)"""


@query("a11_village_rollup", W.with_views("plots finals", ROLLUP_SQL + " SELECT * FROM roll"))
def a11(spark, sf):
    return R.group_rollup(W.plots(spark, sf), W.photos(spark, sf))


VISIT_SQL = """AND vc AS (SELECT plot_id, count(*) AS photos, count(final_label) AS answered,
    count(*) FILTER (WHERE final_label <> 'healthy') AS problems, count(*) FILTER (WHERE final_label = 'healthy') AS n_healthy,
    count(*) FILTER (WHERE final_label = 'rust') AS n_rust, count(*) FILTER (WHERE final_label = 'other') AS n_other,
    count(*) FILTER (WHERE final_label IS NULL AND officer_label IS NULL) AS waiting, count(*) FILTER (WHERE disputed) AS disputed,
    count(*) FILTER (WHERE not_sure AND officer_label IS NULL) AS card_waiting,
    count(*) FILTER (WHERE disputed AND officer_label IS NULL) AS card_disputed,
    count(DISTINCT coalesce(tree, -1)) FILTER (WHERE final_label <> 'healthy') AS trees FROM finals GROUP BY 1),
  vv AS (SELECT *, CASE WHEN problems >= 3 OR trees >= 2 THEN 'officer_alert' WHEN problems >= 1 THEN 'some_problem'
    WHEN answered > 0 THEN 'all_healthy' END AS verdict FROM vc)"""
CLASSES = ("healthy", "rust", "other")


@query("a12_visit_rollup", W.with_views("plots finals", VISIT_SQL + """
  SELECT p.plot_id, p.variety, coalesce(photos, 0) AS photos, coalesce(answered, 0) AS answered, coalesce(n_healthy, 0) AS n_healthy,
    coalesce(n_rust, 0) AS n_rust, coalesce(n_other, 0) AS n_other, coalesce(waiting, 0) AS waiting, coalesce(disputed, 0) AS disputed, verdict
  FROM plots p LEFT JOIN vv USING (plot_id) WHERE NOT synthetic"""))
def a12(spark, sf):
    rolled = R.visits_with_photos(W.plots(spark, sf).where(~F.col("synthetic")), W.photos(spark, sf), CLASSES)
    return rolled.select("plot_id", "variety", "photos", "answered", *[f"n_{c}" for c in CLASSES], "waiting", "disputed", "verdict")


@query("a13_label_counts", W.with_views("photos", """SELECT status, string_agg(officer_label || '=' || n, ',' ORDER BY officer_label) AS counts FROM (
  SELECT not_sure AS status, officer_label, count(*) AS n FROM photos WHERE officer_label IS NOT NULL GROUP BY 1, 2) GROUP BY 1"""))
def a13(spark, sf):
    counts = R.label_histogram(W.photos(spark, sf).withColumnRenamed("not_sure", "status"), "officer_label", ["status"])
    entries = F.transform(F.array_sort(F.map_entries("counts")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return counts.select("status", F.array_join(entries, ",").alias("counts"))


@query("a14_queue_stats", W.with_views("finals", """SELECT count(*) FILTER (WHERE in_queue) AS waiting, count(officer_label) AS reviewed,
  count(*) FILTER (WHERE officer_label IN ('healthy', 'rust', 'other')) AS labelled FROM finals"""))
def a14(spark, sf):
    return R.queue_stats(W.photos(spark, sf), CLASSES)


def keyed(spark, sf):
    return RT.answers_with_key(W.answers(spark, sf), W.answer_key(spark, sf))


def cells(spark, sf):
    return RT.answer_cells(W.answers(spark, sf), W.answer_key(spark, sf))


@query("a15_rater_score", W.with_views("keyed", """SELECT rater, count(*) AS n, count(*) FILTER (WHERE answered) AS n_answered,
  round(avg(answered::INT), 6) AS share_answered, round(avg(correct::INT) FILTER (WHERE answered), 6) AS acc_answered,
  round(avg(((answer = 'healthy') = (truth = 'healthy'))::INT) FILTER (WHERE answered), 6) AS healthy_vs_problem_answered,
  round(avg((answered AND correct)::INT), 6) AS correct_of_all FROM keyed GROUP BY 1"""))
def a15(spark, sf):
    return rounded(RT.rater_score(cells(spark, sf)))


@query("a15_answer_counts", W.with_views("keyed", "SELECT rater, coalesce(answer, 'missing') AS answer, count(*) AS n FROM keyed GROUP BY 1, 2"))
def a15_counts(spark, sf):
    return RT.answer_counts(cells(spark, sf))


LEVEL_SQL = """AND lv AS (SELECT rater, level, count(*) AS n, count(*) FILTER (WHERE answered) AS n_answered,
    avg((answered AND correct)::INT) AS correct_of_all, avg(correct::INT) FILTER (WHERE answered) AS acc_answered,
    avg(coalesce(answer NOT IN ('healthy', 'not_sure'), false)::INT) AS called_a_problem FROM keyed GROUP BY 1, 2)"""


@query("a16_score_by_level", W.with_views("keyed", LEVEL_SQL + """
  SELECT rater, level, n, n_answered, round(correct_of_all, 6) AS correct_of_all, round(acc_answered, 6) AS acc_answered,
    round(called_a_problem, 6) AS called_a_problem FROM lv"""))
def a16(spark, sf):
    return rounded(RT.score_by_level(cells(spark, sf)))


@query("a17_rater_effort", W.with_views("answers", """SELECT rater, round(sum(seconds) / 60, 6) AS total_minutes, count(*) FILTER (WHERE changed) AS n_changed,
  round(quantile_cont(seconds, 0.5), 6) AS median_seconds FROM answers GROUP BY 1"""))
def a17(spark, sf):
    return rounded(RT.rater_effort(W.answers(spark, sf)))


@query("a18_pairwise_agreement", W.with_views("keyed", """SELECT a.rater AS rater_a, b.rater AS rater_b,
  round(avg((a.answer IS NOT DISTINCT FROM b.answer)::INT), 6) AS same_answer,
  round(avg(((a.answer = 'healthy') = (b.answer = 'healthy'))::INT) FILTER (WHERE a.answered AND b.answered), 6) AS same_healthy_vs_problem
  FROM keyed a JOIN keyed b ON a.item_id = b.item_id AND a.rater < b.rater GROUP BY 1, 2"""))
def a18(spark, sf):
    return rounded(RT.pairwise_agreement(RT.rater_pairs(keyed(spark, sf))))


def spread_pairs(spark, sf):
    """The pairs over all shuffle partitions: each pair is small but costly, so they must not be packed by size."""
    return W.pairs(spark, sf).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "conv_id", "turn")


def error_rates(pairs):
    """Character and word errors per pair."""
    return pairs.select(F.levenshtein("ref", "hyp").alias("ce"), F.length("ref").alias("cl"),
                        list_distance(T.words(F.col("ref")), T.words(F.col("hyp"))).alias("we"), F.size(T.words(F.col("ref"))).alias("wl"))


@query("a19_character_errors", W.with_views("pairs", """SELECT conv_id, count(*) AS n, sum(length(ref))::BIGINT AS n_chars,
  round(sum(levenshtein(ref, hyp)) / sum(length(ref)), 6) AS cer FROM pairs GROUP BY 1"""))
def a19(spark, sf):
    edits = spread_pairs(spark, sf).select("conv_id", F.levenshtein("ref", "hyp").alias("d"), F.length("ref").alias("l"))
    return rounded(edits.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.sum("l").alias("n_chars"),
                                               (F.sum("d") / F.sum("l")).alias("cer")))


@query("a19_word_errors")
def a19_words(spark, sf):
    edits = error_rates(spread_pairs(spark, sf))
    return rounded(edits.agg(F.count(F.lit(1)).alias("n"), F.sum("wl").alias("n_words"), (F.sum("we") / F.sum("wl")).alias("wer"),
                             (F.sum("ce") / F.sum("cl")).alias("cer")))


COMPONENTS_SQL = """AND edge AS MATERIALIZED (SELECT a.item_id AS a, b.item_id AS b FROM unit_aug a JOIN unit_aug b ON a.item_id <> b.item_id
    WHERE list_dot_product(a.u, b.u) > {tau}),
  reach(a, b) AS (SELECT item_id, item_id FROM unit_aug UNION SELECT r.a, e.b FROM reach r JOIN edge e ON e.a = r.b),
  grp AS MATERIALIZED (SELECT a AS item_id, min(b) AS copy_group FROM reach GROUP BY 1)"""


@query("a20_group_size_profile", W.with_views("unit_aug", COMPONENTS_SQL.format(tau=0.98) + """
  SELECT count(*) AS n_groups, count(*) FILTER (WHERE s = 1)::BIGINT AS singletons, round(quantile_cont(s, 0.5), 6) AS median_size,
    round(quantile_cont(s, 0.9), 6) AS p90_size, max(s) AS max_size FROM (SELECT copy_group, count(*) AS s FROM grp GROUP BY 1)""", recursive=True))
def a20(spark, sf):
    return rounded(M.group_size_profile(CC.copy_groups(W.items_aug(spark, sf), 0.98), "copy_group"))


@query("a20_group_size_counts", W.with_views("unit_aug", COMPONENTS_SQL.format(tau=0.98) + """
  SELECT s AS size, count(*) AS groups FROM (SELECT copy_group, count(*) AS s FROM grp GROUP BY 1) GROUP BY 1""", recursive=True))
def a20_counts(spark, sf):
    return M.group_size_counts(CC.copy_groups(W.items_aug(spark, sf), 0.98), "copy_group")


AUROC_SQL = """SELECT count(*) FILTER (WHERE y) AS n_pos, count(*) FILTER (WHERE NOT y) AS n_neg,
    round((sum(rk) FILTER (WHERE y) - count(*) FILTER (WHERE y) * (count(*) FILTER (WHERE y) + 1) / 2)
      / (count(*) FILTER (WHERE y) * count(*) FILTER (WHERE NOT y)), 6) AS auroc FROM (
    SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2 AS rk FROM ({t}))"""


@query("a21_auroc", W.with_views("scored", AUROC_SQL.format(t="SELECT round(distance, 3) AS s, split = 'field' AS y FROM scored")))
def a21(spark, sf):
    rows, _ = W.scored(spark, sf)
    return rounded(M.auroc(rows.withColumn("s", F.round("distance", 3)), "s", F.col("split") == "field"))


@query("a22_summarise_folds", W.with_views("decided", """AND f AS (SELECT fold, avg(answered::INT) AS coverage,
    avg((top = class_idx)::INT) FILTER (WHERE answered) AS acc_answered, avg((forced = class_idx)::INT) AS acc_all
    FROM decided WHERE split <> 'train' GROUP BY 1)
  SELECT count(*) AS runs, round(avg(coverage), 6) AS coverage_mean, round(stddev_pop(coverage), 6) AS coverage_sd,
    round(avg(acc_answered), 6) AS acc_answered_mean, round(stddev_pop(acc_answered), 6) AS acc_answered_sd,
    round(avg(acc_all), 6) AS acc_all_mean, round(stddev_pop(acc_all), 6) AS acc_all_sd FROM f"""))
def a22(spark, sf):
    per = M.rule_metrics(W.decided(spark, sf).where("split <> 'train'"), by=["fold"])
    return rounded(M.summarise_runs(per, ["coverage", "acc_answered", "acc_all"]))


@query("a23_mixed_population", W.with_views("decided", """SELECT count(*) AS n, round(avg(answered::INT), 6) AS coverage,
  round(count(*) FILTER (WHERE answered AND top = class_idx AND class_idx <> 9) / greatest(1, count(*) FILTER (WHERE answered)), 6) AS acc_answered,
  round(count(*) FILTER (WHERE answered AND top = 1 AND class_idx = 9) / greatest(1, count(*) FILTER (WHERE answered AND top = 1)), 6) AS flagged_out_of_scope
  FROM decided"""))
def a23(spark, sf):
    return rounded(M.mixed_population(W.decided(spark, sf), F.col("class_idx") == W.OTHER, F.col("class_idx")))


@query("a24_drop_reasons", """SELECT coalesce(CASE WHEN n_chars % 41 = 0 THEN 'empty_file' WHEN doc_id % 37 = 0 THEN 'missing'
  WHEN doc_id % 50 = 0 THEN 'checksum_mismatch' WHEN lang = 'xx' OR n_chars < 20 THEN 'unreadable' END, 'kept') AS reason, count(*) AS n
  FROM documents GROUP BY 1""")
def a24(spark, sf):
    docs = W.table(spark, sf, "documents")
    size = F.when(F.col("n_chars") % 41 == 0, 0).otherwise(F.col("n_chars"))
    expected = F.when(F.col("doc_id") % 50 == 0, "0" * 64).otherwise(F.sha2("text", 256))
    reason = VAL.drop_reason(size, F.col("doc_id") % 37 != 0, (F.col("lang") != "xx") & (F.col("n_chars") >= 20), F.col("text"), expected)
    return docs.groupBy(F.coalesce(reason, F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("a25_duplicate_counts", """SELECT lang, count(*) AS n, (count(*) - count(DISTINCT sha256(text)))::BIGINT AS extra_copies FROM documents GROUP BY 1""")
def a25(spark, sf):
    """Equal texts are combined by hash before anything is counted per language."""
    per = W.table(spark, sf, "documents").groupBy("lang", F.sha2("text", 256).alias("h")).agg(F.count(F.lit(1)).alias("c"))
    return per.groupBy("lang").agg(F.sum("c").alias("n"), (F.sum("c") - F.count(F.lit(1))).alias("extra_copies"))


@query("a26_section_flags", """SELECT source, count(*)::BIGINT AS guides, (3 * count(*))::BIGINT AS sections,
  sum((n_chars % 2 = 0)::INT + (n_chars % 3 = 0)::INT + (n_chars % 5 = 0)::INT)::BIGINT AS ok,
  sum((n_chars % 2 <> 0)::INT + (n_chars % 3 <> 0)::INT + (n_chars % 5 <> 0)::INT)::BIGINT AS to_check FROM documents GROUP BY 1""")
def a26(spark, sf):
    def section(key, k):
        return F.struct(F.lit(key).alias("key"), F.when(F.col("n_chars") % k == 0, "ok").otherwise("check").alias("status"))

    guides = W.table(spark, sf, "documents").select(
        "doc_id", "source", F.array(section("what", 2), section("why", 3), section("do", 5)).alias("sections"))
    counted = guides.select("source", F.size("sections").alias("k"),
                            F.size(F.filter("sections", lambda s: s["status"] == "ok")).alias("ok"))
    return counted.groupBy("source").agg(F.count(F.lit(1)).alias("guides"), F.sum("k").alias("sections"), F.sum("ok").alias("ok"),
                                         F.sum(F.col("k") - F.col("ok")).alias("to_check"))


@query("a27_alert_backtest", """WITH g AS (SELECT l_linenumber AS round, l_suppkey AS grp, count(*) AS n,
    count(*) FILTER (WHERE l_returnflag = 'R') AS x, avg(l_quantity) > 26 AS truth FROM lineitem GROUP BY 1, 2),
  r AS (SELECT *, x / n AS raw, (5 + x) / (20 + n) AS adj FROM g),
  o AS (SELECT *, row_number() OVER (PARTITION BY round ORDER BY raw DESC, grp) AS r1, row_number() OVER (PARTITION BY round ORDER BY adj DESC, grp) AS r2 FROM r)
  SELECT 'raw' AS rule, round, count(*) FILTER (WHERE raw > 0.25 AND NOT truth) AS false_alarms, count(*) FILTER (WHERE raw <= 0.25 AND truth) AS missed,
    count(*) FILTER (WHERE r1 <= 5 AND truth) AS top_hits FROM o GROUP BY 2
  UNION ALL SELECT 'adjusted', round, count(*) FILTER (WHERE adj > 0.25 AND NOT truth), count(*) FILTER (WHERE adj <= 0.25 AND truth),
    count(*) FILTER (WHERE r2 <= 5 AND truth) FROM o GROUP BY 2""")
def a27(spark, sf):
    g = W.table(spark, sf, "lineitem").groupBy(F.col("l_linenumber").alias("round"), F.col("l_suppkey").alias("grp")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("x"), (F.avg("l_quantity") > 26).alias("truth"))
    g = g.withColumns({"raw": F.col("x") / F.col("n"), "adj": (5 + F.col("x")) / (20 + F.col("n"))})
    parts = [SH.alert_backtest(g.withColumn("hit", F.col(s) > 0.25), "truth", "hit", s, "grp").select(F.lit(name).alias("rule"), "*")
             for name, s in (("raw", "raw"), ("adjusted", "adj"))]
    return parts[0].unionByName(parts[1])


def backtest_rounds(spark, sf):
    """Line numbers stand for rounds and suppliers for groups."""
    return W.table(spark, sf, "lineitem").groupBy(F.col("l_linenumber").alias("round"), F.col("l_suppkey").alias("grp")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("x"), (F.avg("l_quantity") > 26).alias("truth"))


BACKTEST_SQL = """WITH g AS (SELECT l_linenumber AS round, l_suppkey AS grp, count(*) AS n,
    count(*) FILTER (WHERE l_returnflag = 'R') AS x, avg(l_quantity) > 26 AS truth FROM lineitem GROUP BY 1, 2),
  a AS (SELECT i, exp(-3 + i * 0.1::DOUBLE) AS al FROM range(0, 91) r(i)), b AS (SELECT j, exp(-3 + j * 0.1::DOUBLE) AS be FROM range(0, 101) r(j)),
  cx AS (SELECT round, x AS v, count(*) AS c FROM g GROUP BY 1, 2), cy AS (SELECT round, n - x AS v, count(*) AS c FROM g GROUP BY 1, 2),
  cn AS (SELECT round, n AS v, count(*) AS c FROM g GROUP BY 1, 2),
  fa AS (SELECT round, i, al, sum(c * (lgamma(v + al) - lgamma(al))) AS s FROM cx, a GROUP BY 1, 2, 3),
  fb AS (SELECT round, j, be, sum(c * (lgamma(v + be) - lgamma(be))) AS s FROM cy, b GROUP BY 1, 2, 3),
  fn AS (SELECT round, i, j, sum(c * (lgamma(v + al + be) - lgamma(al + be))) AS s FROM cn, a, b GROUP BY 1, 2, 3),
  best AS (SELECT round, al, be FROM fn JOIN fa USING (round, i) JOIN fb USING (round, j)
    QUALIFY row_number() OVER (PARTITION BY round ORDER BY round(fa.s + fb.s - fn.s, 9) DESC, i, j) = 1),
  post AS (SELECT g.*, x + al * least(1, 50 / (al + be)) AS pa, n - x + be * least(1, 50 / (al + be)) AS pb FROM g JOIN best USING (round)),
  m AS (SELECT DISTINCT pa, pb FROM post),
  above AS (SELECT pa, pb, sum(exp((pa - 1) * ln(0.25 + 0.75 * (i + 0.5) / 4000) + (pb - 1) * ln(0.75 - 0.75 * (i + 0.5) / 4000)
    + lgamma(pa + pb) - lgamma(pa) - lgamma(pb))) * 0.75 / 4000 AS p FROM m, range(0, 4000) r(i) GROUP BY 1, 2),
  r AS (SELECT *, x / n AS raw, round(p, 4) AS adj FROM post JOIN above USING (pa, pb)),
  o AS (SELECT *, row_number() OVER (PARTITION BY round ORDER BY raw DESC, grp) AS r1, row_number() OVER (PARTITION BY round ORDER BY adj DESC, grp) AS r2 FROM r),
  t AS (SELECT 'raw' AS rule, round, count(*) FILTER (WHERE raw > 0.25 AND NOT truth) AS false_alarms, count(*) FILTER (WHERE raw <= 0.25 AND truth) AS missed,
    count(*) FILTER (WHERE r1 <= 5 AND truth) AS top_hits FROM o GROUP BY 2
  UNION ALL SELECT 'adjusted', round, count(*) FILTER (WHERE adj > 0.5 AND NOT truth), count(*) FILTER (WHERE adj <= 0.5 AND truth),
    count(*) FILTER (WHERE r2 <= 5 AND truth) FROM o GROUP BY 2)"""


@query("a27_posterior_backtest", BACKTEST_SQL + " SELECT * FROM t")
def a27_posterior(spark, sf):
    """Raw and posterior rule per round, each round with its own prior from the grid."""
    return PR.posterior_backtest(backtest_rounds(spark, sf), "truth", "grp", grid=True, places=4)


@query("a27_mean_backtest", BACKTEST_SQL + """ SELECT rule, count(*) AS rounds, round(avg(false_alarms), 6) AS false_alarms, round(avg(missed), 6) AS missed,
  round(avg(top_hits), 6) AS top_hits FROM t GROUP BY 1""")
def a27_mean(spark, sf):
    return rounded(PR.mean_backtest(PR.posterior_backtest(backtest_rounds(spark, sf), "truth", "grp", grid=True, places=4)))


@query("a27_fitted_backtest")
def a27_fitted(spark, sf):
    """The same with priors by Newton steps."""
    return rounded(PR.mean_backtest(PR.posterior_backtest(backtest_rounds(spark, sf), "truth", "grp")))


@query("a28_near_copy_summary", W.with_views("unit_aug", """AND m AS (SELECT a.item_id, max(list_dot_product(a.u, b.u)) AS c FROM unit_aug a CROSS JOIN unit_aug b
    WHERE a.split <> 'train' AND b.split = 'train' GROUP BY 1)
  SELECT round(max(c), 6) AS max_cosine, count(*) FILTER (WHERE c > 0.98) AS n_copies, count(*) AS n, round(quantile_cont(c, 0.5), 6) AS median_cosine FROM m"""))
def a28(spark, sf):
    rows = W.items_aug(spark, sf)
    ref = rows.where("split = 'train'").select(F.col("item_id").alias("ref_id"), "e")
    return rounded(M.near_copy_summary(cut_lineage(N.nearest_distance(rows.where("split <> 'train'"), ref))))  # read several times


@query("a29_familiarity_summary", W.with_views("unit knn cut", """AND s AS (SELECT a.item_id, list_dot_product(a.u, b.u) AS s, row_number() OVER (
    PARTITION BY a.item_id ORDER BY list_dot_product(a.u, b.u) DESC, b.item_id) AS rn FROM unit a CROSS JOIN unit b WHERE a.item_id // 5 <> b.item_id // 5),
  o AS (SELECT item_id, 1 - avg(s) AS d FROM s WHERE rn <= 10 GROUP BY 1),
  w AS (SELECT item_id, 1.0 / count(*) OVER (PARTITION BY item_id // 5) AS w FROM unit)
  SELECT 'reference' AS target, round(quantile_cont(distance, 0.5), 6) AS median_distance, round(sum(w) FILTER (WHERE distance <= cutoff) / sum(w), 6) AS share_within
    FROM knn JOIN w USING (item_id) CROSS JOIN cut
  UNION ALL SELECT 'other groups', round(quantile_cont(d, 0.5), 6), round(coalesce(sum(w) FILTER (WHERE d <= cutoff), 0) / sum(w), 6) FROM o JOIN w USING (item_id) CROSS JOIN cut"""))
def a29(spark, sf):
    scored, head = W.scored(spark, sf)
    unit = F.floor(F.col("item_id") / 5)
    items = W.items(spark, sf).withColumn("unit", unit)
    others = cut_lineage(N.knn_distance(items, items.select(F.col("item_id").alias("ref_id"), "e", "unit"), W.K, group="unit"))  # read several times
    out = None
    for name, d in (("reference", scored.select("item_id", "distance")), ("other groups", others)):
        rows = d.withColumn("unit", unit)
        within = M.weighted_shares(rows, {"share_within": (F.col("distance") <= head.cutoff, F.lit(True))}, "unit").select("share_within")
        mid = exact_quantiles(rows, F.col("distance"), [0.5]).select(F.lit(name).alias("target"), F.col("q0").alias("median_distance"))
        part = mid.join(F.broadcast(within))  # two one-row tables
        out = part if out is None else out.unionByName(part)
    return rounded(out)


@query("a30_reason_histogram", W.with_views("decided", "SELECT split, coalesce(reason, 'answered') AS reason, count(*) AS n FROM decided GROUP BY 1, 2"))
def a30(spark, sf):
    return W.decided(spark, sf).groupBy("split", F.coalesce("reason", F.lit("answered")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("a31_counts_from_shares", W.with_views("keyed", LEVEL_SQL + """
  SELECT rater, sum(round(correct_of_all * n)::BIGINT)::BIGINT AS correct, sum(round(called_a_problem * n)::BIGINT)::BIGINT AS called
  FROM lv WHERE level <> 0 GROUP BY 1"""))
def a31(spark, sf):
    lv = RT.score_by_level(cells(spark, sf)).where("level <> 0")
    return lv.groupBy("rater").agg(F.sum(F.bround(F.col("correct_of_all") * F.col("n")).cast("bigint")).alias("correct"),
                                   F.sum(F.bround(F.col("called_a_problem") * F.col("n")).cast("bigint")).alias("called"))


@query("a32_range_over_raters", W.with_views("keyed", """AND s AS (SELECT rater, avg(answered::INT) AS a, avg(correct::INT) FILTER (WHERE answered) AS c FROM keyed GROUP BY 1)
  SELECT 'share_answered' AS measure, round(min(a), 6) AS low, round(max(a), 6) AS high FROM s
  UNION ALL SELECT 'acc_answered', round(min(c), 6), round(max(c), 6) FROM s"""))
def a32(spark, sf):
    s = RT.rater_score(cells(spark, sf))
    long = s.select(F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("v")) for m in ("share_answered", "acc_answered")])).alias("r"))
    return rounded(long.groupBy("r.measure").agg(F.min("r.v").alias("low"), F.max("r.v").alias("high")))


@query("a33_visit_card_counts", W.with_views("finals", VISIT_SQL + """
  SELECT plot_id, n_healthy, n_rust, n_other, card_waiting, card_disputed FROM vv"""))
def a33(spark, sf):
    return R.visit_counts(W.photos(spark, sf), CLASSES).select("plot_id", *[f"n_{c}" for c in CLASSES], "card_waiting", "card_disputed")
