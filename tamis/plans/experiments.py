"""Composed evaluations. Folds, seeds and label counts are columns wherever the step is relational; loops on the driver run
only over the handful of fits."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.functions.numeric import lists, matrix, softmax_rows, unit_rows
from tamis.operators import calibration as C
from tamis.operators import fitting as FT
from tamis.operators import metrics as M
from tamis.operators import scoring as S
from tamis.operators import splits as X
from tamis.operators import stacked as ST
from tamis.operators.bootstrap import group_bootstrap
from tamis.operators.components import copy_groups
from tamis.operators.neighbours import MAX_REFERENCE_ROWS, ReferenceSet, largest
from tamis.operators.ranks import hash_order
from tamis.session import cut_lineage
from tamis.sources.heads import build_reference, load_reference


def local_heads(rows: DataFrame, seeds: Sequence[int], sizes: Sequence[int], classes: Sequence[str]) -> DataFrame:
    """(seed, k, fitted, norm): a head from the first k labels of each seed alone. At most max(sizes) rows per task."""
    picks = first_labels(rows, seeds, sizes)
    names = tuple(classes)

    def fit(table: pa.Table) -> pa.Table:
        found = FT.local_only_rows(names, matrix(table.column("e")), table.column("class_idx").to_numpy())
        norm = float(np.sqrt((found[0] ** 2).sum())) if found else None
        return pa.table({"seed": pa.array([table.column("seed")[0].as_py()], pa.int32()), "k": pa.array([table.column("k")[0].as_py()], pa.int32()),
                         "fitted": [found is not None], "norm": pa.array([None if norm is None else round(norm, 4)], pa.float64())})

    return picks.groupBy("seed", "k").applyInArrow(fit, "seed int, k int, fitted boolean, norm double")


def first_labels(rows: DataFrame, seeds: Sequence[int], sizes: Sequence[int]) -> DataFrame:
    """(seed, k, item_id, e, class_idx): nested sets of the first k rows in the order of each seed."""
    wanted = F.array(*[F.lit(int(s)) for s in seeds])
    seeded = rows.select("item_id", "class_idx", F.explode(wanted).alias("seed"))
    top = X.nested_prefixes(seeded, hash_order(F.col("seed"), F.col("item_id")), [k for k in sizes if k > 0], ["seed"], "item_id")
    # at most seeds x max(sizes) picked rows
    return rows.select("item_id", "e").join(F.broadcast(top), "item_id").select("seed", F.col("k").cast("int").alias("k"), "item_id", "e", "class_idx")


def training_pool(rows: DataFrame, held_out: DataFrame, other: int, folds: int, seed: str, tau: float = 0.98) -> tuple[DataFrame, DataFrame]:
    """(lab, pool) of labelled rows with a column split. Copies are grouped over all rows; a group with a held-out row or two labels
    goes. The pool is the field rows of known classes and all rows of class `other`, dealt into folds by copy group. The lab rows, which
    every fold trains on, are the train rows of known classes without a copy in the pool."""
    groups = cut_lineage(copy_groups(rows, tau))
    outside = held_out.select("item_id", "class_idx")
    free = cut_lineage(X.leakage_filter(rows.join(outside, "item_id", "left_anti"), outside, groups, "class_idx"))
    pool = cut_lineage(X.group_kfold(free.where((F.col("split") == "field") | (F.col("class_idx") == other)), "copy_group", "class_idx", folds, seed))
    lab = free.where((F.col("split") == "train") & (F.col("class_idx") != other)).join(pool.select("copy_group").distinct(), "copy_group", "left_anti")
    return cut_lineage(lab), pool


@dataclass
class FoldModels:
    """The chosen strength, heads and reference rows by fold, and the scored rows of all folds, each by the head that hasn't seen it."""

    c: float
    heads: dict[int, S.Head]
    references: dict[int, DataFrame]
    out_of_fold: DataFrame


def fold_models(lab: DataFrame, pool: DataFrame, calib: DataFrame, lab_reference: DataFrame, classes: Sequence[str], grid: Sequence[float],
                per_class: int, folds: int, other: int) -> FoldModels:
    """Fold f: head from the lab rows and the other folds of the pool; reference from the fixed lab rows and `per_class` rows of each known
    class of the other folds. The strength of the grid with the lowest out-of-fold and calibration loss is used, the first on ties.
    The scored rows are stored, so that every setting reads them."""
    by_strength = ST.fit_heads(_training(lab, pool), grid, classes, range(folds), tol=1e-6)
    c = ST.loss_by_strength(pool, calib, by_strength).agg(F.min_by("c", F.struct("nll", "i"))).first()[0]
    heads, references, out_of_fold = by_strength[c], {}, None
    for f in range(folds):
        references[f] = _reference(lab_reference, pool.where(F.col("fold") != f), per_class, other, f"fold{f}")
        scored = S.score_against(pool.where(F.col("fold") == f), heads[f], references[f])
        out_of_fold = scored if out_of_fold is None else out_of_fold.unionByName(scored)
    return FoldModels(c, heads, references, cut_lineage(out_of_fold))


def _training(lab: DataFrame, pool: DataFrame) -> DataFrame:
    """The lab rows, which have no fold and train every head, and the rows of the pool."""
    return lab.select("e", "class_idx", F.lit(None).cast("int").alias("fold")).unionByName(pool.select("e", "class_idx", F.col("fold").cast("int").alias("fold")))


def _reference(fixed: DataFrame, rows: DataFrame, per_class: int, other: int, seed: str) -> DataFrame:
    """The fixed rows and `per_class` rows of each known class, as they are stored: int8 with one scale a row."""
    some = X.sample_cap_per_class(rows.where(F.col("class_idx") != other), per_class, "class_idx", "item_id", seed)
    stored = build_reference(fixed.unionByName(some.select(F.col("item_id").alias("ref_id"), "e")), "ref_id")
    return load_reference(cut_lineage(stored)).select("ref_id", "e")


def evaluate_folds(models: FoldModels, calib: DataFrame, other: int, budget: float | None = 0.05, known_only: bool = True,
                   target: float = C.TARGET_ACCURACY, least: int = C.MIN_ANSWERED) -> tuple[DataFrame, DataFrame]:
    """(decided rows of all folds, scalars per fold) of the whole rule.

    Temperature, cutoff, threshold and the bias of the routed class come from the calibration rows and the out-of-fold rows of the
    other folds; the rule is applied to the rows of its fold. `known_only`: the threshold is chosen on rows of known classes."""
    out_of_fold, decided, scalars = models.out_of_fold, None, []
    for f, head in models.heads.items():
        rest = out_of_fold.where(F.col("fold") != f)
        head, bias = _with_scalars(head, rest, calib, models.references[f], other, budget, known_only, target, least)
        scalars.append((int(f), models.c, head.temperature, head.threshold, head.cutoff, float(bias)))
        test = S.decide(_probabilities(_shifted(out_of_fold.where(F.col("fold") == f), other, bias).select(*_SCORED), head.temperature), head)
        decided = test if decided is None else decided.unionByName(test)
    table = out_of_fold.sparkSession.createDataFrame(
        scalars, "fold int, c double, temperature double, threshold double, cutoff double, other_bias double")
    return cut_lineage(decided), table


_SCORED = ["item_id", "class_idx", "fold", "logits", "distance"]


def _with_scalars(head: S.Head, rest: DataFrame, calib: DataFrame, reference: DataFrame, other: int, budget: float | None, known_only: bool,
                  target: float, least: int) -> tuple[S.Head, float]:
    """The head with temperature, cutoff, threshold and the bias of the routed class, from scored rows `rest` and the calibration rows."""
    known = F.col("class_idx") != other
    bias = 0.0 if budget is None else C.other_bias(rest.where(known), other, budget).first()[0] or 0.0
    shift = head.bias.copy()
    shift[other] += bias
    head = head.with_settings(bias=shift, routed=(other,))
    pool = cut_lineage(S.score_against(calib, head, reference).withColumn("fold", F.lit(None).cast("int")).select(*_SCORED).unionByName(
        _shifted(rest, other, bias).select(*_SCORED)))
    head = head.with_settings(temperature=C.fit_temperature(pool, "class_idx"), cutoff=C.familiarity_cutoff(pool.where(known)))
    ready = S.decide(_probabilities(pool, head.temperature), head)
    chosen = C.select_threshold(ready, "class_idx", target, least, mask=known if known_only else None).first()[0]
    return head.with_settings(threshold=float(chosen)), float(bias)


def final_rule(models: FoldModels, lab: DataFrame, pool: DataFrame, calib: DataFrame, lab_reference: DataFrame, per_class: int, other: int,
               budget: float | None = 0.05, known_only: bool = True, target: float = C.TARGET_ACCURACY, least: int = C.MIN_ANSWERED) -> tuple[S.Head, DataFrame]:
    """(head, reference) that are shipped: the head of all training rows at the chosen strength, started from a fold's head, with scalars from the
    calibration rows and all out-of-fold rows, and the stored reference of all of them."""
    some = next(iter(models.heads.values()))
    head = ST.fit_heads(_training(lab, pool), [models.c], some.classes, [None], start={None: some})[models.c][None]
    reference = _reference(lab_reference, pool, per_class, other, "final")
    return _with_scalars(head, models.out_of_fold, calib, reference, other, budget, known_only, target, least)[0], reference


def decided_by_both(decided: DataFrame, rest: DataFrame, head: S.Head, reference: DataFrame) -> DataFrame:
    """Rows of the folds, each decided with the scalars of its fold, and rows outside them decided by the final head: no row meets a head that has seen it."""
    scored = S.score_against(rest, head, reference).withColumn("fold", F.lit(None).cast("int")).select(*_SCORED)
    return decided.unionByName(S.decide(_probabilities(scored, head.temperature), head))


def fold_table(decided: DataFrame, scalars: DataFrame, other: int) -> DataFrame:
    """A row per fold: its scalars, the rule on known rows, out-of-scope rows (oos_), both together (mixed_), and how well confidence,
    distance and the probability of `other` tell them apart (auroc_)."""
    known, outside = decided.where(F.col("class_idx") != other), decided.where(F.col("class_idx") == other)
    named = lambda df, prefix: df.select("fold", *[F.col(c).alias(prefix + c) for c in df.columns if c != "fold"])
    out = scalars.join(M.rule_metrics(known, by=["fold"]), "fold", "left").join(named(M.out_of_scope_metrics(outside, by=["fold"]), "oos_"), "fold", "left")
    mixed = M.mixed_population(decided, F.col("class_idx") == other, F.col("class_idx"), by=["fold"])
    out = out.join(named(mixed, "mixed_"), "fold", "left")
    for name, signal in {"confidence": -F.col("max_prob"), "distance": F.col("distance"), "other": F.get("probs", F.lit(other))}.items():
        area = M.auroc(decided.withColumn("signal", signal), "signal", F.col("class_idx") == other, by=["fold"])
        out = out.join(area.select("fold", F.col("auroc").alias(f"auroc_{name}")), "fold", "left")
    return out


def with_summary(per_fold: DataFrame) -> DataFrame:
    """The rows of the folds, then their mean and population sd; `part` is fold, mean or sd."""
    names = [c for c in per_fold.columns if c != "fold"]
    per_fold = cut_lineage(per_fold.select("fold", *[F.col(c).cast("double").alias(c) for c in names]))
    runs = M.summarise_runs(per_fold, names)
    out = per_fold.select(F.lit("fold").alias("part"), "*")
    for part in ("mean", "sd"):
        out = out.unionByName(runs.select(F.lit(part).alias("part"), F.lit(None).cast("int").alias("fold"), *[F.col(f"{c}_{part}").alias(c) for c in names]))
    return out


def _shifted(rows: DataFrame, other: int | None, bias: float) -> DataFrame:
    from tamis.functions import vectors as V

    return rows if other is None or not bias else rows.withColumn("logits", V.shift_logit(F.col("logits"), other, bias))


def _probabilities(rows: DataFrame, temperature: float) -> DataFrame:
    """Adds probs, top and max_prob to rows that already carry logits."""
    keep = rows.columns
    at = keep.index("logits")
    schema = rows.select("*", F.lit(None).cast("array<double>").alias("probs"), F.lit(None).cast("int").alias("top"),
                         F.lit(None).cast("double").alias("max_prob"), F.lit(None).cast("double").alias("local_distance")).schema

    def run(batches):
        for b in batches:
            if b.num_rows:
                p = softmax_rows(matrix(b.column(at)) / temperature)
                top = p.argmax(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [*b.columns, lists(p), pa.array(top.astype(np.int32)), pa.array(p[np.arange(len(top)), top]), pa.nulls(len(top), pa.float64())],
                    names=[*keep, "probs", "top", "max_prob", "local_distance"])

    return rows.mapInArrow(run, schema)


def curve_heads(labelled: DataFrame, head: S.Head, seeds: Sequence[int], sizes: Sequence[int], methods: Sequence[str]) -> DataFrame:
    """(seed, k, method, w, b): the refit of every case from the first k of the labels (seed, place, e, y) of its seed, one task a case."""
    cases = [(int(s), int(k), m) for s in seeds for k in sizes for m in methods]
    table = labelled.sparkSession.createDataFrame(cases, "seed int, k int, method string")
    # a case without labels has a row of nulls
    rows = table.join(labelled, (table["seed"] == labelled["seed"]) & (labelled["place"] <= table["k"]), "left").select(
        table["seed"], "k", "method", "place", "e", "y")

    def run(key, t):
        seed, k, m = (x.as_py() for x in key)
        t = t.sort_by("place")
        t = t.filter(pc.is_valid(t.column("y")))
        e, y = matrix(t.column("e")), t.column("y").to_numpy().astype(int)
        if m == "prior":
            h = FT.adapt_rows(head, e, y)
        else:
            found = FT.local_only_rows(head.classes, e, y) if len(y) else None
            h = head if found is None else head.with_settings(weights=found[0], bias=found[1])
        return pa.table({"seed": pa.array([seed], pa.int32()), "k": pa.array([k], pa.int32()), "method": [m],
                         "w": pa.array([h.weights.ravel().tolist()], pa.list_(pa.float64())), "b": pa.array([h.bias.tolist()], pa.list_(pa.float64()))})

    return rows.groupBy("seed", "k", "method").applyInArrow(run, "seed int, k int, method string, w array<double>, b array<double>")


def learning_outcomes(rows: DataFrame, head: S.Head, reference: ReferenceSet, unit: str, group: str, seeds: Sequence[int],
                      sizes: Sequence[int], methods: Sequence[str] = ("prior", "local_only")) -> DataFrame:
    """(seed, k, method, rule, item_id, group, class_idx, top, answered, forced...): every test row under every refit.

    Units are halved per seed; the first k labels, one per copy group, refit the head and join the reference; the other
    half is scored. The labels of a seed are a fixed number k, so the refits and the added rows are shipped to the tasks.
    """
    split = X.seeded_pool_split(rows, unit, seeds)
    chosen = X.one_per_group(split.where("in_pool"), group, "item_id", F.concat(F.lit("curve"), F.col("seed").cast("string")), by=["seed"])
    top = max(sizes)
    first = chosen.where(F.col("place") <= top).select("seed", "item_id", "place")
    # at most seeds x max(sizes) rows, by the definition of the experiment
    labelled = rows.join(F.broadcast(first), "item_id").select(F.col("seed").cast("int").alias("seed"), "place", "e", F.col("class_idx").cast("int").alias("y"))
    picked = labelled.toArrow().sort_by([("seed", "ascending"), ("place", "ascending")])
    seed_of, e_all = picked.column("seed").to_numpy(), matrix(picked.column("e"))
    near = {int(s): unit_rows(e_all[seed_of == s]) if (seed_of == s).any() else np.zeros((0, head.weights.shape[1])) for s in seeds}
    spark = rows.sparkSession
    fitted = {(r.seed, r.k, r.method): (np.array(r.w).reshape(head.weights.shape), np.array(r.b))
              for r in curve_heads(spark.createDataFrame(picked), head, seeds, sizes, methods).collect()}
    shared = spark.sparkContext.broadcast((fitted, near, reference.unit, head))
    test = split.where(~F.col("in_pool")).select("seed", "item_id", F.col(group).cast("string").alias("grp"), "class_idx", "e")

    def run(batches):
        heads, labels, ref, h = shared.value
        for b in batches:
            if b.num_rows == 0:
                continue
            seeds_in, e_batch = b.column("seed").to_numpy(zero_copy_only=False), matrix(b.column("e"))
            for s in seeds:
                at = np.nonzero(seeds_in == s)[0]
                if not len(at):
                    continue
                e, n = e_batch[at], len(at)
                u = unit_rows(e)
                shipped = largest(u @ ref.T, h.k)  # once for all sizes and methods
                local = u @ labels[s].T
                sub = b.select(["item_id", "grp", "class_idx"]).take(pa.array(at))
                for k in sizes:
                    best_k = largest(np.hstack([shipped, local[:, :k]]), h.k)
                    # without any reference row no familiarity check applies
                    fam = 1.0 - best_k.mean(axis=1) <= h.cutoff if h.cutoff is not None and best_k.shape[1] else np.ones(n, bool)
                    wide = fam.copy()
                    if local[:, :k].shape[1] and h.local_cutoff is not None:
                        wide |= 1.0 - local[:, :k].max(axis=1) <= h.local_cutoff
                    for m in methods:
                        w, bias = heads[s, k, m]
                        p = softmax_rows((e @ w.T + bias) / h.temperature)
                        best = p.argmax(axis=1)
                        peak = p[np.arange(n), best]
                        q = p.copy()
                        q[:, list(h.routed)] = -1
                        away = np.isin(best, list(h.routed))
                        for rule, f in (("app", wide), ("previous", fam)):
                            reason = np.where(~f, "unfamiliar", np.where(peak < h.threshold, "low_confidence", np.where(away, "other", "")))
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(np.full(n, s, np.int32)), pa.array(np.full(n, k, np.int32)), pa.array([m] * n), pa.array([rule] * n), *sub.columns,
                                 pa.array(best.astype(np.int32)), pa.array(q.argmax(axis=1).astype(np.int32)), pa.array((peak >= h.threshold) & ~away & f),
                                 pa.array(reason.tolist())],
                                names=["seed", "k", "method", "rule", "item_id", "grp", "class_idx", "top", "forced", "answered", "reason"])

    return test.mapInArrow(run, """seed int, k int, method string, rule string, item_id bigint, grp string, class_idx int, top int, forced int,
                                   answered boolean, reason string""")


def learning_curve(rows: DataFrame, head: S.Head, reference: ReferenceSet, unit: str, group: str, seeds: Sequence[int],
                   sizes: Sequence[int], methods: Sequence[str] = ("prior", "local_only")) -> DataFrame:
    """(method, rule, k): mean and sd over seeds of the group-weighted measures."""
    outcomes = learning_outcomes(rows, head, reference, unit, group, seeds, sizes, methods)
    measures = M.standard_measures(F.col("class_idx"))
    keep = ("answered_share", "correct_of_answered", "forced_correct", "target_named", "healthy_flagged", "not_sure_unfamiliar")
    per = M.weighted_shares(outcomes, {m: measures[m] for m in keep}, "grp", ["method", "rule", "k", "seed"])
    return M.summarise_runs(per, keep, ["method", "rule", "k"])


def external_test(decided: DataFrame, group: str, truth: Column, reps: int = 1000, seed: int = 11) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(group-weighted measures, unweighted measures, bootstrap intervals)."""
    measures = M.standard_measures(truth)
    short = {m: measures[m] for m in ("answered_share", "correct_of_answered", "target_named", "healthy_flagged")}
    return (M.weighted_shares(decided, measures, group), M.weighted_shares(decided, measures),
            group_bootstrap(decided, group, short, reps, seed))


def cross_source_accuracy(train: DataFrame, test: DataFrame, c: float, classes: Sequence[str]) -> DataFrame:
    head = FT.fit_head(train, c, classes, tol=1e-6)
    return S.score(test, head).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("top") == F.col("class_idx")).cast("double")).alias("accuracy"))


def out_of_scope_after_update(out_rows: DataFrame, head: S.Head, adapted: S.Head, reference: DataFrame, added: DataFrame,
                              max_rows: int = MAX_REFERENCE_ROWS) -> DataFrame:
    """Routing of rows of no known class: before an update, after it under both familiarity rules, and with only one half of
    the update (the refit alone, or the added rows alone). `reference` and `added` are tables (ref_id, e) of any size; their ids differ."""
    joined = reference.select("ref_id", "e").unionByName(added.select("ref_id", "e"))
    # the distances don't depend on the weights, so each reference is met once
    plain = {"local_cutoff": None}
    near = {"before": cut_lineage(S.score_against(out_rows, head, reference, max_rows=max_rows)),
            "after": cut_lineage(S.score_against(out_rows, head, joined, added, max_rows=max_rows))}
    variants = (("before", head.with_settings(**plain), "before"), ("after", adapted, "after"),
                ("after_previous_rule", adapted.with_settings(**plain), "after"),
                ("refit_only", adapted.with_settings(**plain), "before"), ("rows_only", head.with_settings(**plain), "after"))
    out = None
    for name, h, at in variants:
        measured = near[at].select("item_id", "distance", "local_distance")
        scored = S.score(out_rows, h).drop("distance", "local_distance").join(measured, "item_id")
        row = M.out_of_scope_metrics(S.decide(scored, h)).select(F.lit(name).alias("variant"), "*")
        out = row if out is None else out.unionByName(row)
    return out


Method = Callable[[DataFrame, DataFrame, DataFrame], DataFrame]


def method_bakeoff(methods: dict[str, Method], labelled: DataFrame, unlabelled: DataFrame, test: DataFrame, truth: str = "class_idx") -> DataFrame:
    """Plug-in methods side by side. A method maps (labelled, unlabelled, test) to the test rows with columns top, forced,
    confident, familiar, routed, answered and max_prob; all are scored with one set of measures."""
    out = None
    for name, method in methods.items():
        row = M.rule_metrics(method(labelled, unlabelled, test), truth).select(F.lit(name).alias("method"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def unchanged_decisions(rows: DataFrame, head: S.Head, reference: ReferenceSet, local_cutoff: float) -> DataFrame:
    """A second cutoff without reviewed rows must change nothing: (n, changed, identical)."""
    base = S.score(rows, head, reference)
    now = S.decide(base, head.with_settings(local_cutoff=None)).select("item_id", F.col("answered").alias("a"), F.col("reason").alias("ra"))
    new = S.decide(base, head.with_settings(local_cutoff=local_cutoff)).select("item_id", F.col("answered").alias("b"), F.col("reason").alias("rb"))
    same = F.col("a").eqNullSafe(F.col("b")) & F.col("ra").eqNullSafe(F.col("rb"))
    return now.join(new, "item_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(~same).alias("changed"), F.bool_and(same).alias("identical"))
