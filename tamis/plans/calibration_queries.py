"""Calibration, shrinkage, rule selection, and fits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tamis.operators import calibration as C
from tamis.operators import fitting as FT
from tamis.operators import metrics as M
from tamis.operators import scoring as S
from tamis.operators import priors as PR
from tamis.operators import shrinkage as SH
from tamis.operators import stacked as ST
from tamis.operators.ranks import exact_quantiles
from tamis.plans import views as W
from tamis.plans.aggregate_queries import ROLLUP_SQL, centroid_distance, rounded
from tamis.plans.registry import query
from tamis.plans.scalar_queries import _LOCAL, with_local

T_SHARP = 0.15


@query("c03_temperature_curve", W.with_views("lg items", """AND g AS (SELECT i AS t_idx, exp(ln(0.05) + i * (ln(20) - ln(0.05)) / 199) AS t FROM range(0, 200) r(i)),
  zz AS (SELECT z, class_idx, list_max(z) AS m FROM lg JOIN items USING (item_id) WHERE split = 'calib')
  SELECT t_idx::INT AS t_idx, round(t, 6) AS t, count(*) AS n, round(avg(ln(list_sum(list_transform(z, lambda v: exp((v - m) / t)))) + (m - z[class_idx + 1]) / t), 6) AS nll
  FROM zz CROSS JOIN g GROUP BY 1, 2"""))
def c03_curve(spark, sf):
    rows = S.score(W.items(spark, sf).where("split = 'calib'"), W.head(spark, sf))
    return rounded(C.nll_curve(rows, "class_idx", C.temperature_grid(*C.TEMPERATURE_RANGE)))


@query("c03_fit_temperature")
def c03(spark, sf):
    rows = S.score(W.items(spark, sf).where("split = 'train'"), W.head(spark, sf))
    t = C.fit_temperature(rows, "class_idx")
    return rounded(C.nll_curve(rows, "class_idx", [t, 1.0]))


@query("c04_familiarity_cutoff", W.with_views("cut", "SELECT round(cutoff, 6) AS cutoff FROM cut"))
def c04(spark, sf):
    rows = S.score(W.items(spark, sf), W.head(spark, sf), W.reference(spark, sf)).where(f"split = 'calib' and class_idx <> {W.OTHER}")
    return rounded(exact_quantiles(rows, F.col("distance"), [0.95]).select(F.col("q0").alias("cutoff")))


_SHARP = f"""AND sharp AS (SELECT item_id, class_idx, split, distance <= cutoff AS familiar, list_position(p, list_max(p)) - 1 AS top, list_max(p) AS conf FROM (
    SELECT item_id, class_idx, split, distance, cutoff, list_transform(x, lambda v: v / list_sum(x)) AS p FROM (
    SELECT item_id, class_idx, split, distance, cutoff, list_transform(z, lambda v: exp((v - list_max(z)) / {T_SHARP}::DOUBLE)) AS x FROM scored CROSS JOIN cut))),
  curve AS (SELECT split, i::INT AS t_idx, 0.3::DOUBLE + i * 0.69::DOUBLE / 69 AS t, count(*) AS answered, count(*) FILTER (WHERE top = class_idx) AS correct
    FROM sharp, range(0, 70) r(i) WHERE familiar AND top <> 9 AND conf >= 0.3::DOUBLE + i * 0.69::DOUBLE / 69 GROUP BY 1, 2, 3)"""


def sharp(spark, sf):
    """Decided rows under a low temperature, where confidences reach the threshold grid."""
    rows, head = W.scored(spark, sf)
    cold = head.with_settings(temperature=T_SHARP)
    base = rows.select("item_id", "e", "class_idx", "split", F.col("distance").alias("d"))
    again = S.score(base, cold).drop("distance").withColumnRenamed("d", "distance")
    return S.decide(again, cold)


@query("c05_threshold_curve", W.with_views("scored cut", _SHARP + " SELECT split, t_idx, round(t, 6) AS t, answered, correct FROM curve"))
def c05_curve(spark, sf):
    return rounded(C.threshold_curve(sharp(spark, sf), "class_idx", by=["split"]))


@query("c05_select_threshold", W.with_views("scored cut", _SHARP + """
  SELECT split, round(coalesce(t, 0.0), 6) AS threshold FROM (SELECT DISTINCT split FROM sharp)
    LEFT JOIN (SELECT split, min(t) AS t FROM curve WHERE answered >= 20 AND correct / answered >= 0.6 GROUP BY 1) USING (split)"""))
def c05(spark, sf):
    return rounded(C.select_threshold(sharp(spark, sf), "class_idx", target=0.6, by=["split"]))


@query("c06_other_bias", W.with_views("lg items", """SELECT fold, round(-quantile_cont(z[10] - list_max(z[1:9]), 0.95), 6) AS other_bias FROM lg JOIN items USING (item_id)
  WHERE class_idx <> 9 GROUP BY 1"""))
def c06(spark, sf):
    rows = S.score(W.items(spark, sf), W.head(spark, sf)).where(f"class_idx <> {W.OTHER}")
    return rounded(C.other_bias(rows, W.OTHER, 0.05, ["fold"]))


PRIOR_SQL = """AND xn AS (SELECT x, n, count(*) AS c FROM {g} WHERE n > 0 GROUP BY 1, 2),
  a AS (SELECT i, exp(-3 + i * 0.1::DOUBLE) AS al FROM range(0, 91) r(i)), b AS (SELECT j, exp(-3 + j * 0.1::DOUBLE) AS be FROM range(0, 101) r(j)),
  fa AS (SELECT i, al, sum(c * lgamma(x + al)) AS s FROM a, xn GROUP BY 1, 2), fb AS (SELECT j, be, sum(c * lgamma(n - x + be)) AS s FROM b, xn GROUP BY 1, 2),
  fn AS (SELECT n, sum(c) AS c FROM xn GROUP BY 1), k AS (SELECT sum(c) AS k FROM xn),
  fab AS (SELECT i, j, sum(c * lgamma(n + al + be)) AS s FROM a, b, fn GROUP BY 1, 2),
  ll AS (SELECT i, j, al, be, fa.s + fb.s - fab.s - k * (lgamma(al) + lgamma(be) - lgamma(al + be)) AS ll FROM fab JOIN fa USING (i) JOIN fb USING (j), k),
  best AS (SELECT al, be FROM ll ORDER BY round(ll, 9) DESC, i, j LIMIT 1),
  prior AS (SELECT al * least(1, 50 / (al + be)) AS alpha, be * least(1, 50 / (al + be)) AS beta, al + be > 50 AS capped FROM best)"""


@query("c11_beta_binomial_prior", W.with_views("groups", PRIOR_SQL.format(g="groups") + """
  SELECT round(alpha, 6) AS alpha, round(beta, 6) AS beta, 'fitted' AS source, capped, (SELECT count(*) FILTER (WHERE n > 0) FROM groups) AS groups FROM prior"""))
def c11(spark, sf):
    return rounded(SH.beta_binomial_prior(W.groups(spark, sf)))


@query("c11_prior_by_month", W.with_views("ev", """AND eg AS (SELECT grp, count(*) AS n, count(*) FILTER (WHERE flagged AND value > 20) AS x FROM ev GROUP BY 1),"""
       + PRIOR_SQL.format(g="eg")[4:] + " SELECT round(alpha, 6) AS alpha, round(beta, 6) AS beta, capped FROM prior"))
def c11_events(spark, sf):
    """The same over event groups, where flagged rows are rarer."""
    g = W.ev(spark, sf).groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("flagged") & (F.col("value") > 20)).alias("x"))
    return rounded(SH.beta_binomial_prior(g).select("alpha", "beta", "capped"))


@query("c11_prior_continuous")
def c11_continuous(spark, sf):
    """The prior by Newton steps, uncapped, over the event groups of each month; no grid, so no SQL."""
    ev = W.ev(spark, sf).withColumn("month", F.date_trunc("month", "ts"))
    g = ev.groupBy("month", "grp").agg(F.count(F.lit(1)).alias("n"), F.count_if("flagged").alias("x"))
    return rounded(PR.fitted_priors(g, ["month"], cap=None).drop("gradient"))


POSTERIOR_SQL = """, post AS (SELECT {key}, n, x, alpha + x AS pa, beta + n - x AS pb FROM {g} CROSS JOIN prior WHERE n > 0),
  m AS (SELECT DISTINCT pa, pb FROM post),
  dens AS (SELECT pa, pb, i, exp((pa - 1) * ln(0.25 + 0.75 * (i + 0.5) / 4000) + (pb - 1) * ln(1 - 0.25 - 0.75 * (i + 0.5) / 4000) + lgamma(pa + pb) - lgamma(pa) - lgamma(pb)) AS d
    FROM m, range(0, 4000) r(i)),
  above AS (SELECT pa, pb, sum(d) * 0.75 / 4000 AS p_above FROM dens GROUP BY 1, 2)"""


@query("c12_posterior_alert", W.with_views("groups", PRIOR_SQL.format(g="groups") + POSTERIOR_SQL.format(key="grp", g="groups") + """
  SELECT grp, n, x, round(x / n, 6) AS raw, round(pa / (pa + pb), 6) AS adjusted, round(p_above, 4) AS p_above, p_above > 0.5 AS alert
  FROM post JOIN above USING (pa, pb)"""))
def c12(spark, sf):
    g = W.groups(spark, sf)
    out = SH.posterior_alert(g, SH.fit_prior(g))
    return rounded(out.withColumn("p_above", F.round("p_above", 4)))


@query("w07_village_ranking", W.with_views("plots finals", ROLLUP_SQL + "," + PRIOR_SQL.format(g="roll")[4:]
       + POSTERIOR_SQL.format(key="village_key", g="roll") + """
  SELECT row_number() OVER (ORDER BY coalesce(round(p_above, 4), -1) DESC, roll.n DESC, village_key) AS rank, village_key, roll.n, roll.x, waiting, round(p_above, 4) AS p_above
  FROM roll LEFT JOIN post USING (village_key) LEFT JOIN above USING (pa, pb)"""))
def w07_villages(spark, sf):
    from tamis.operators import review as R

    roll = R.group_rollup(W.plots(spark, sf), W.photos(spark, sf))
    out = SH.posterior_alert(roll, SH.fit_prior(roll)).withColumn("p_above", F.round("p_above", 4))
    return SH.rank_groups(out, "village_key").select("rank", "village_key", "n", "x", "waiting", "p_above")


CANDIDATES = [0.50, 0.54, 0.58, 0.62, 0.66]
_ABLATION = _LOCAL + """, c AS (SELECT unnest([0.50, 0.54, 0.58, 0.62, 0.66]::DOUBLE[]) AS candidate),
  x AS (SELECT fold, top, class_idx, dl, max_prob >= 0.13 AND top <> 9 AS extra, distance <= 0.7::DOUBLE AND max_prob >= 0.13 AND top <> 9 AS cur,
    1.0::DOUBLE / count(*) OVER (PARTITION BY fold, class_idx || '-' || (item_id % 7)) AS w FROM scored JOIN near USING (item_id) WHERE split <> 'train'),
  abl AS (SELECT fold, candidate, coalesce(sum(w) FILTER (WHERE NOT cur AND extra AND dl <= candidate), 0) / sum(w) AS added_share,
    coalesce(sum(w) FILTER (WHERE NOT cur AND extra AND dl <= candidate AND top = class_idx), 0) / nullif(sum(w) FILTER (WHERE NOT cur AND extra AND dl <= candidate), 0) AS added_accuracy
    FROM x CROSS JOIN c GROUP BY 1, 2)"""


def _ablation(spark, sf):
    rows, _ = with_local(spark, sf)
    rows = rows.where("split <> 'train'").withColumn(
        "grp", F.concat_ws("-", F.col("class_idx").cast("string"), (F.col("item_id") % 7).cast("string")))
    extra = (F.col("max_prob") >= 0.13) & (F.col("top") != W.OTHER)
    return C.rule_ablation(rows, CANDIDATES, "dl", (F.col("distance") <= 0.7) & extra, extra, F.col("top") == F.col("class_idx"),
                           by=["fold"], group="grp")


@query("c13_rule_ablation", W.with_views("unit scored", _ABLATION + """
  SELECT fold, round(candidate, 6) AS candidate, round(added_share, 6) AS added_share, round(added_accuracy, 6) AS added_accuracy FROM abl"""))
def c13(spark, sf):
    return rounded(_ablation(spark, sf))


@query("c14_select_candidate", W.with_views("unit scored", _ABLATION + """
  SELECT round(max(candidate) FILTER (WHERE ok), 6) AS selected FROM (SELECT candidate, bool_and(added_accuracy IS NULL OR added_accuracy >= 0.05) AS ok FROM abl GROUP BY 1)"""))
def c14(spark, sf):
    return rounded(C.select_candidate(_ablation(spark, sf), 0.05))


@query("c15_decision_gates", W.with_views("decided", """AND t AS (SELECT fold, avg(answered::INT) AS a, avg((max_prob >= 0.135 AND familiar AND NOT routed)::INT) AS b,
    avg((forced = class_idx)::INT) AS f FROM decided WHERE split = 'field' GROUP BY 1),
  g AS (SELECT 'coverage' AS gate, round(min(b - a), 6) AS worst_change, 0.01::DOUBLE AS "limit", bool_and(a - b <= 0.01) AS passed FROM t
    UNION ALL SELECT 'acc_all', round(min(f - f), 6), 0.03::DOUBLE, bool_and(f - f <= 0.03) FROM t)
  SELECT * FROM g UNION ALL SELECT 'all gates', NULL, NULL, bool_and(passed) FROM g"""))
def c15(spark, sf):
    rows, head = W.scored(spark, sf)
    field = rows.where("split = 'field'")
    now = M.rule_metrics(S.decide(field, head), by=["fold"])
    new = M.rule_metrics(S.decide(field, head.with_settings(threshold=0.135)), by=["fold"])
    return rounded(C.decision_gates(now, new, "fold", {"coverage": 0.01, "acc_all": 0.03}))


@query("e04_ood_signals", W.with_views("scored items cent", """AND cd AS (SELECT item_id, 1 - max(list_cosine_similarity(e, c)) AS cd FROM items CROSS JOIN cent GROUP BY 1),
  s AS (SELECT split, unnest([{'k': 'max_softmax', 'v': -max_prob}, {'k': 'centroid', 'v': cd}, {'k': 'knn', 'v': distance}]) AS u FROM scored JOIN cd USING (item_id) WHERE split <> 'train'),
  v AS (SELECT u.k AS k, u.v AS s, split = 'field' AS y FROM s),
  r AS (SELECT k, y, s, rank() OVER (PARTITION BY k ORDER BY s) + (count(*) OVER (PARTITION BY k, s) - 1) / 2 AS rk FROM v),
  q AS (SELECT k, quantile_cont(s, 0.95) AS c FROM v WHERE NOT y GROUP BY 1)
  SELECT k AS signal, round((sum(rk) FILTER (WHERE y) - count(*) FILTER (WHERE y) * (count(*) FILTER (WHERE y) + 1) / 2) / (count(*) FILTER (WHERE y) * count(*) FILTER (WHERE NOT y)), 6) AS auroc,
    round(avg((s <= c)::INT) FILTER (WHERE y), 6) AS accepted FROM r JOIN q USING (k) GROUP BY 1"""))
def e04(spark, sf):
    """Which signal notices the field rows: area and the share of them accepted at the 95th percentile of the others."""
    rows, _ = W.scored(spark, sf)
    cents = centroid_distance(W.items(spark, sf), W.items(spark, sf).where("split = 'train'")).withColumnRenamed("distance", "cd")
    both = rows.join(cents, "item_id").where("split <> 'train'").select(
        "split", (-F.col("max_prob")).alias("max_softmax"), F.col("cd").alias("centroid"), F.col("distance").alias("knn")).persist()
    out = None
    for signal in ("max_softmax", "centroid", "knn"):
        cut = exact_quantiles(both.where("split = 'calib'"), F.col(signal), [0.95]).select("q0")
        accepted = both.where("split = 'field'").join(F.broadcast(cut)).agg(F.avg((F.col(signal) <= F.col("q0")).cast("double")).alias("accepted"))
        area = M.auroc(both, signal, F.col("split") == "field").select("auroc")
        part = area.join(F.broadcast(accepted)).select(F.lit(signal).alias("signal"), "auroc", "accepted")  # one-row tables
        out = part if out is None else out.unionByName(part)
    return rounded(out)


def _train(spark, sf):
    return W.items(spark, sf).where("split = 'train'")


@query("c01_fit_head")
def c01(spark, sf):
    head = FT.fit_head(_train(spark, sf), 1.0, W.CLASSES)
    return rounded(S.score(W.items(spark, sf), head).groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("top") == F.col("class_idx")).cast("double")).alias("accuracy")), 4)


@query("c02_select_c")
def c02(spark, sf):
    return rounded(ST.select_c(_train(spark, sf), FT.STRENGTHS, W.CLASSES), 4)


@query("c08_adapt_head")
def c08(spark, sf):
    start = W.head(spark, sf, prior_strength=0.3)
    rows = W.items(spark, sf).where("split = 'calib'")
    head = FT.adapt_head(start, rows)
    both = [S.score(rows, h).agg(F.lit(n).alias("head"), F.avg((F.col("top") == F.col("class_idx")).cast("double")).alias("accuracy"))
            for n, h in (("before", start), ("after", head))]
    return rounded(both[0].unionByName(both[1]), 4)


@query("c09_fit_local_only")
def c09(spark, sf):
    """Heads from the first k reviewed rows of each seed alone; one task per seed and k, at most k rows each."""
    from tamis.plans.experiments import local_heads

    return local_heads(W.items(spark, sf).where("split = 'calib'"), (1, 2, 3, 4, 5), (10, 20, 50, 100, 200), W.CLASSES)


@query("c10_select_lambda")
def c10(spark, sf):
    rows = W.items(spark, sf).where("split = 'calib'")
    return rounded(FT.select_strength(rows.where("fold < 3"), rows.where("fold >= 3"), W.head(spark, sf), [0.03, 0.1, 0.3, 1.0, 3.0]), 4)


