"""Registered forms of the composed experiments."""

from __future__ import annotations

from pyspark.sql import functions as F

from tamis.operators import fitting as FT
from tamis.operators import metrics as M
from tamis.operators import raters as RT
from tamis.operators import scoring as S
from tamis.operators import splits as X
from tamis.operators.bootstrap import group_bootstrap, paired_bootstrap
from tamis.plans import experiments as E
from tamis.plans import views as W
from tamis.plans.aggregate_queries import cells, grouped, rounded
from tamis.plans.registry import query
from tamis.session import cut_lineage, scratch_path
from tamis.sources import items as I


@query("x09_group_bootstrap")
def x09(spark, sf):
    measures = M.standard_measures(F.col("class_idx"))
    short = {m: measures[m] for m in ("answered_share", "correct_of_answered", "forced_correct", "healthy_flagged")}
    return rounded(group_bootstrap(grouped(spark, sf), "grp", short))


#: Budget of the routed class, and whether the threshold is chosen on known classes alone.
TRADEOFF = ((None, False), (None, True), (0.005, True), (0.01, True), (0.02, True), (0.05, True))
IN_USE = (0.05, True)


FOLDS = 5


def _rows(spark, sf):
    """(all rows, lab, pool, calibration rows, fixed reference rows)."""
    rows = cut_lineage(W.items_aug(spark, sf).drop("fold"))
    # a tenth of the field rows stands for the sealed photos
    lab, pool = E.training_pool(rows, rows.where("split = 'field' and item_id % 50 = 49"), W.OTHER, FOLDS, "cv")
    calib = rows.where(f"split = 'calib' and class_idx <> {W.OTHER}")
    reference = S.stratified_reference(lab, W.REFERENCE_PER_CLASS, seed="ref", strict=False).select(F.col("item_id").alias("ref_id"), "e")
    return rows, lab, pool, calib, reference


def _models(spark, sf):
    _, lab, pool, calib, reference = _rows(spark, sf)
    return E.fold_models(lab, pool, calib, reference, W.CLASSES, FT.STRENGTHS, W.REFERENCE_PER_CLASS, FOLDS, W.OTHER), calib


@query("e01_cross_validate")
def e01(spark, sf):
    decided, scalars = E.evaluate_folds(*_models(spark, sf), W.OTHER, *IN_USE)
    return rounded(E.with_summary(E.fold_table(decided, scalars, W.OTHER)), 4)


@query("e01_final_rule")
def e01_final(spark, sf):
    """The head of all training rows with its scalars, and the rows of no known class: those of the folds under their fold's rule, the others under the final one."""
    rows, lab, pool, calib, reference = _rows(spark, sf)
    models = E.fold_models(lab, pool, calib, reference, W.CLASSES, FT.STRENGTHS, W.REFERENCE_PER_CLASS, FOLDS, W.OTHER)
    decided, _ = E.evaluate_folds(models, calib, W.OTHER, *IN_USE)
    head, stored = E.final_rule(models, lab, pool, calib, reference, W.REFERENCE_PER_CLASS, W.OTHER, *IN_USE)
    outside = F.col("class_idx") == W.OTHER
    rest = rows.where(outside).join(pool.select("item_id"), "item_id", "left_anti")
    mixed = cut_lineage(E.decided_by_both(decided.where(outside), rest, head, stored))
    part = F.explode(F.array(F.lit("all"), F.when(F.col("fold").isNull(), "final").otherwise("folds"))).alias("part")
    table = M.out_of_scope_metrics(mixed.select("*", part), by=["part"])
    return rounded(table.select("part", F.lit(models.c).alias("c"), F.lit(head.temperature).alias("temperature"), F.lit(head.threshold).alias("threshold"),
                                F.lit(head.cutoff).alias("cutoff"), *[c for c in table.columns if c != "part"]), 4)


@query("c17_tradeoff_table")
def c17(spark, sf):
    """The same evaluation for every setting; the folds are fitted and scored once."""
    models, calib = _models(spark, sf)
    known, out = F.col("class_idx") != W.OTHER, None
    for setting in TRADEOFF:
        decided, _ = E.evaluate_folds(models, calib, W.OTHER, *setting)
        outside = M.out_of_scope_metrics(decided.where(~known), by=["fold"]).select(
            "fold", F.col("not_sure").alias("oos_not_sure"), F.col("routed_other").alias("oos_routed_other"))
        metrics = M.rule_metrics(decided.where(known), by=["fold"]).join(outside, "fold", "left")
        row = M.summarise_runs(metrics, ["coverage", "acc_answered", "routed_other", "oos_not_sure", "oos_routed_other"]).select(
            F.lit(setting[0]).cast("double").alias("budget"), F.lit(setting[1]).alias("known_only"), F.lit(setting == IN_USE).alias("in_use"), "*")
        out = row if out is None else out.unionByName(row)
    return rounded(out, 4)


@query("e02_learning_curve")
def e02(spark, sf):
    rows, head = W.scored(spark, sf)
    pool = W.items_aug(spark, sf).where(f"split <> 'train' and class_idx <> {W.OTHER}").withColumn("unit", F.col("item_id") % 1000000).withColumn(
        "grp", F.concat_ws("-", F.col("class_idx").cast("string"), F.col("unit").cast("string")))
    return rounded(E.learning_curve(pool, head.with_settings(local_cutoff=0.62, prior_strength=0.3), W.reference(spark, sf), "unit", "grp",
                                    (2000, 2001, 2002, 2003, 2004), (0, 10, 20, 50, 100, 200)), 4)


@query("e03_external_test")
def e03(spark, sf):
    """Two fitted heads on rows that neither has seen: one of all train rows, one of those of two folds."""
    base = W.items(spark, sf)
    train, reference = base.where("split = 'train'"), W.reference(spark, sf)
    settings = dict(threshold=0.13, cutoff=0.76, routed=(W.OTHER,))
    test, out = None, None
    for name, rows in (("shipped", train), ("lab_only", train.where("fold < 2"))):
        head = FT.fit_head(rows, 0.1, W.CLASSES).with_settings(**settings)
        part = S.decide(S.score(base.where("split <> 'train'"), head, reference), head, exclusive=True).withColumn("model", F.lit(name)).withColumn(
            "grp", F.concat_ws("-", F.col("class_idx").cast("string"), (F.col("item_id") % 7).cast("string")))
        test = part if test is None else test.unionByName(part)
    test = cut_lineage(test)
    for name in ("shipped", "lab_only"):
        weighted, plain, interval = E.external_test(test.where(F.col("model") == name), "grp", F.col("class_idx"), reps=1000)
        pick = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("v")) for m in ("answered_share", "correct_of_answered", "target_named", "healthy_flagged")]))
        w = weighted.select(pick.alias("r")).select("r.measure", F.col("r.v").alias("weighted"))
        p = plain.select(pick.alias("r")).select("r.measure", F.col("r.v").alias("unweighted"))
        part = w.join(p, "measure").join(interval, "measure").select(F.lit(name).alias("model"), "measure", "weighted", "unweighted", "low", "high")
        out = part if out is None else out.unionByName(part)
    measures = M.standard_measures(F.col("class_idx"))
    short = {m: measures[m] for m in ("answered_share", "correct_of_answered", "target_named", "healthy_flagged")}
    paired = paired_bootstrap(test, "model", ("shipped", "lab_only"), "grp", short)
    return rounded(out.unionByName(paired.select(F.lit("lab_only - shipped").alias("model"), "measure", F.col("difference").alias("weighted"),
                                                 F.lit(None).cast("double").alias("unweighted"), "low", "high")))


@query("e05_cross_source")
def e05(spark, sf):
    rows = W.items(spark, sf)
    return rounded(E.cross_source_accuracy(rows.where("fold < 3"), rows.where("fold >= 3"), 1.0, W.CLASSES), 4)


def _update(spark, sf):
    """The head, the head after an update with the calibration rows, and the rows the update adds."""
    rows, head = W.scored(spark, sf)
    head = head.with_settings(prior_strength=0.3, local_cutoff=0.62)
    labelled = W.items(spark, sf).where(f"split = 'calib' and class_idx <> {W.OTHER}")
    adapted = FT.adapt_head(head, labelled)
    return rows, head, adapted, labelled.select(F.col("item_id").alias("ref_id"), "e")


@query("e06_out_of_scope_after_update")
def e06(spark, sf):
    _, head, adapted, added = _update(spark, sf)
    out_rows = W.items(spark, sf).where(f"class_idx = {W.OTHER}")
    return rounded(E.out_of_scope_after_update(out_rows, head, adapted, W.reference_rows(spark, sf), added), 4)


@query("c16_update_diagnosis")
def c16(spark, sf):
    """Which half of an update moves the out-of-scope rows: the refit or the added rows."""
    _, head, adapted, added = _update(spark, sf)
    out_rows = W.items(spark, sf).where(f"class_idx = {W.OTHER}")
    table = E.out_of_scope_after_update(out_rows, head, adapted, W.reference_rows(spark, sf), added)
    return rounded(table.where("variant in ('before', 'refit_only', 'rows_only')").select("variant", "n", "not_sure"), 4)


@query("e07_method_bakeoff")
def e07(spark, sf):
    rows, head = W.scored(spark, sf)
    base = W.items(spark, sf)
    ref = W.reference(spark, sf)

    def shipped(labelled, unlabelled, test):
        return S.decide(S.score(test, head, ref), head)

    def refit(labelled, unlabelled, test):
        h = FT.adapt_head(head.with_settings(prior_strength=0.3), labelled)
        return S.decide(S.score(test, h, ref), h)

    # methods are tuned on one part of the units and reported on the sealed one; every run goes to the log
    parts = cut_lineage(X.development_sealed_split(base.where("split = 'field'"), "item_id", 0.5, "bakeoff"))
    path = scratch_path(spark, "runs")
    for part in ("dev", "sealed"):
        test = parts.where(F.col("part") == part).drop("part")
        run = E.method_bakeoff({"shipped": shipped, "refit": refit}, base.where("split = 'calib'"), test.drop("class_idx"), test)
        run = rounded(run, 4).select(F.lit(part).alias("part"), "*")
        I.append_run_log(run, path)
    return spark.read.schema(run.schema).json(path)


@query("e08_unchanged_decisions", "SELECT count(*) AS n, 0::BIGINT AS changed, true AS identical FROM embeddings")
def e08(spark, sf):
    _, head = W.scored(spark, sf)
    return E.unchanged_decisions(W.items(spark, sf), head, W.reference(spark, sf), 0.7)


@query("e09_rater_vs_model", W.with_views("keyed", """AND m AS (SELECT 'model' AS rater, k.item_id, k.truth, CASE WHEN d.n_chars % 6 = 0 THEN 'not_sure' WHEN d.n_chars % 2 = 0 THEN 'healthy' ELSE 'rust' END AS answer
    FROM answer_key k JOIN documents d ON d.doc_id = k.item_id),
  u AS (SELECT rater, truth, answer, answered, correct FROM keyed UNION ALL SELECT rater, truth, answer, answer <> 'not_sure', answer = truth FROM m)
  SELECT rater, count(*) AS n, count(*) FILTER (WHERE answered) AS n_answered, round(avg(answered::INT), 6) AS share_answered,
    round(avg(correct::INT) FILTER (WHERE answered), 6) AS acc_answered,
    round(avg(((answer = 'healthy') = (truth = 'healthy'))::INT) FILTER (WHERE answered), 6) AS healthy_vs_problem_answered,
    round(avg((answered AND correct)::INT), 6) AS correct_of_all FROM u GROUP BY 1"""))
def e09(spark, sf):
    n = F.col("n_chars")
    model = W.table(spark, sf, "documents").select(F.lit("model").alias("rater"), F.col("doc_id").alias("item_id"),
                                                  F.when(n % 6 == 0, "not_sure").when(n % 2 == 0, "healthy").otherwise("rust").alias("answer"))
    return rounded(RT.rater_score(cells(spark, sf).unionByName(RT.answer_cells(model, W.answer_key(spark, sf)))))
