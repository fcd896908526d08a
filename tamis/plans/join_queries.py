"""Similarity joins, membership joins and keyed assemblies."""

from __future__ import annotations

from pyspark.sql import functions as F

from tamis.operators import calibration as C
from tamis.operators import metrics as M
from tamis.operators import neighbours as N
from tamis.operators import raters as RT
from tamis.operators import review as R
from tamis.operators import scoring as S
from tamis.operators import similarity as SIM
from tamis.operators import validation as VAL
from tamis.operators.mentions import mentions, whole_words
from tamis.plans import views as W
from tamis.plans.registry import query

TAU = 0.4
COPY = 0.98


def _rounded(df, *columns):
    return df.select(*[F.round(c, 6).alias(c) if c in columns else F.col(c) for c in df.columns])


@query("j01_knn_distance", W.with_views("knn", "SELECT item_id, round(distance, 6) AS distance FROM knn"))
def knn_distance(spark, sf):
    return _rounded(N.knn_distance(W.items(spark, sf), W.reference_rows(spark, sf), W.K), "distance")


_ALL_TRAIN = """AND s AS (SELECT u.item_id, list_dot_product(u.u, f.u) AS s, row_number() OVER (PARTITION BY u.item_id
    ORDER BY list_dot_product(u.u, f.u) DESC, f.item_id) AS rn FROM unit u CROSS JOIN unit f WHERE f.split = 'train')
  SELECT item_id, round(1 - avg(s), 6) AS distance FROM s WHERE rn <= 10 GROUP BY 1"""


@query("j01_knn_distance_blocked", W.with_views("unit", _ALL_TRAIN))
def knn_distance_blocked(spark, sf):
    """The form for a reference of any size: all training rows, blocked even where they would fit."""
    ref = W.items(spark, sf).where("split = 'train'").select(F.col("item_id").alias("ref_id"), "e")
    near = N.blocked_neighbours(W.items(spark, sf), ref, W.K)
    return near.groupBy("item_id").agg(F.round(1 - F.avg("similarity"), 6).alias("distance"))


@query("j02_nearest_distance", W.with_views("unit", """SELECT u.item_id, round(1 - max(list_dot_product(u.u, r.u)), 6) AS distance
  FROM unit u CROSS JOIN unit r WHERE u.split = 'field' AND r.split <> 'field' GROUP BY 1"""))
def nearest_distance(spark, sf):
    ref = W.items(spark, sf).where("split <> 'field'").select(F.col("item_id").alias("ref_id"), "e")
    return _rounded(N.nearest_distance(W.items(spark, sf).where("split = 'field'"), ref), "distance")


@query("j03_knn_other_groups", W.with_views("unit_aug", """AND s AS (SELECT a.item_id, list_dot_product(a.u, b.u) AS s, row_number() OVER (
    PARTITION BY a.item_id ORDER BY list_dot_product(a.u, b.u) DESC, b.item_id) AS rn FROM unit_aug a CROSS JOIN unit_aug b
    WHERE a.item_id % 1000000 <> b.item_id % 1000000)
  SELECT item_id, round(1 - avg(s), 6) AS distance FROM s WHERE rn <= 10 GROUP BY 1"""))
def knn_other_groups(spark, sf):
    rows = W.items_aug(spark, sf).withColumn("unit", F.col("item_id") % 1000000)
    ref = rows.select(F.col("item_id").alias("ref_id"), "e", "unit")
    return _rounded(N.knn_distance(rows, ref, W.K, group="unit"), "distance")


@query("j04_similarity_pairs", W.with_views("unit_aug", f"""AND d AS (SELECT item_id, u FROM unit_aug UNION ALL SELECT item_id + t.k * 10000000, u FROM unit_aug, range(1, 3) t(k)
    WHERE item_id % 25 = 0), r AS (SELECT min(item_id) AS id, count(*) AS n, u FROM d GROUP BY u)
  SELECT a.id AS a, b.id AS b, round(list_dot_product(a.u, b.u), 6) AS similarity, a.n AS copies_a, b.n AS copies_b FROM r a JOIN r b ON a.id < b.id
  WHERE list_dot_product(a.u, b.u) > {TAU} UNION ALL SELECT id, id, 1.0, n, n FROM r WHERE n > 1"""))
def similarity_pairs(spark, sf):
    """With two identical copies of every twenty-fifth row."""
    rows = W.items_aug(spark, sf).select("item_id", "e")
    same = rows.where("item_id % 25 = 0").withColumn("item_id", F.explode(F.array(*[F.col("item_id") + k * 10_000_000 for k in (1, 2)])))
    return _rounded(SIM.similarity_self_join(rows.unionByName(same), TAU), "similarity")


@query("j05_near_copy_anti_join", W.with_views("unit_aug", f"""SELECT item_id FROM unit_aug a WHERE split <> 'train' OR item_id >= 1000000
  EXCEPT SELECT a.item_id FROM unit_aug a JOIN unit_aug b ON b.split = 'train' AND b.item_id < 1000000
  WHERE (a.split <> 'train' OR a.item_id >= 1000000) AND list_dot_product(a.u, b.u) > {COPY}"""))
def near_copy_anti_join(spark, sf):
    rows = W.items_aug(spark, sf)
    ref = rows.where("split = 'train' and item_id < 1000000")
    cand = rows.where("split <> 'train' or item_id >= 1000000")
    return SIM.near_copy_anti_join(cand, ref, COPY).select("item_id")


@query("j06_exclude_ids", W.with_views("items", "SELECT item_id, class_idx FROM items WHERE item_id NOT IN (SELECT item_id FROM benchmark)"))
def exclude_ids(spark, sf):
    held = W.table(spark, sf, "benchmark").select("item_id")
    return W.items(spark, sf).select("item_id", "class_idx").join(held, "item_id", "left_anti")


@query("j07_keep_ids", W.with_views("items", "SELECT item_id, class_idx FROM items WHERE item_id IN (SELECT doc_id FROM labels WHERE quality = 1)"))
def keep_ids(spark, sf):
    keep = W.table(spark, sf, "labels").where("quality = 1").select(F.col("doc_id").alias("item_id"))
    return W.items(spark, sf).select("item_id", "class_idx").join(keep, "item_id", "left_semi")


@query("j08_visits_with_photos", W.with_views("plots finals", """SELECT p.plot_id, p.status, count(f.photo_id) AS photos, count(final_label) AS answered
  FROM plots p LEFT JOIN finals f USING (plot_id) GROUP BY 1, 2"""))
def visits_with_photos(spark, sf):
    return R.visits_with_photos(W.plots(spark, sf), W.photos(spark, sf), ()).select("plot_id", "status", "photos", "answered")


@query("j09_queue_with_visit", W.with_views("plots finals", """SELECT photo_id, plot_id, variety, status FROM finals LEFT JOIN plots USING (plot_id)
  WHERE in_queue"""))
def queue_with_visit(spark, sf):
    return R.queue_with_visit(W.photos(spark, sf), W.plots(spark, sf), ["variety", "status"]).select(
        "photo_id", "plot_id", "variety", "status")


@query("j10_answers_with_key", W.with_views("keyed", "SELECT rater, item_id, truth, level, answer FROM keyed"))
def answers_with_key(spark, sf):
    return RT.answers_with_key(W.answers(spark, sf), W.answer_key(spark, sf)).select("rater", "item_id", "truth", "level", "answer")


@query("j11_rater_pairs", W.with_views("keyed", """SELECT a.rater AS rater_a, b.rater AS rater_b, count(*) AS n_items,
  count(*) FILTER (WHERE a.answer IS NOT DISTINCT FROM b.answer) AS n_same, count(*) FILTER (WHERE a.answered AND b.answered) AS n_both,
  count(*) FILTER (WHERE a.answered AND b.answered AND (a.answer = 'healthy') = (b.answer = 'healthy')) AS n_same_side
  FROM keyed a JOIN keyed b ON a.item_id = b.item_id AND a.rater < b.rater GROUP BY 1, 2"""))
def rater_pairs(spark, sf):
    return RT.rater_pairs(RT.answers_with_key(W.answers(spark, sf), W.answer_key(spark, sf)))


@query("j12_assemble_by_key", """SELECT d.doc_id, d.lang, l.quality, b.item_id IS NOT NULL AS in_benchmark FROM documents d
  LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN benchmark b ON b.item_id = d.doc_id""")
def assemble_by_key(spark, sf):
    docs = W.table(spark, sf, "documents").select("doc_id", "lang")
    labels = W.table(spark, sf, "labels").select("doc_id", "quality")
    bench = W.table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), F.lit(True).alias("_b"))
    return docs.join(labels, "doc_id", "left").join(bench, "doc_id", "left").select(
        "doc_id", "lang", "quality", F.coalesce("_b", F.lit(False)).alias("in_benchmark"))


_TWINS = """AND m AS (SELECT a.item_id, a.class_idx AS label, b.class_idx AS other FROM unit_aug a JOIN unit_aug b
    ON a.item_id <> b.item_id AND a.class_idx <> b.class_idx WHERE list_dot_product(a.u, b.u) >= 0.95)"""


@query("j13_cross_label_twins", W.with_views("unit_aug", _TWINS + """
  SELECT item_id, class_idx FROM unit_aug WHERE item_id NOT IN (SELECT item_id FROM m)"""))
def cross_label_twins(spark, sf):
    rows = W.items_aug(spark, sf)
    twins, _ = SIM.cross_label_twins(rows, 0.95, "class_idx")
    return rows.select("item_id", "class_idx").join(twins, "item_id", "left_anti")


@query("j13_twin_label_pairs", W.with_views("unit_aug", _TWINS + """
  SELECT label::VARCHAR AS label, other::VARCHAR AS other, count(DISTINCT item_id) AS n FROM m GROUP BY 1, 2"""))
def twin_label_pairs(spark, sf):
    return SIM.cross_label_twins(W.items_aug(spark, sf), 0.95, "class_idx")[1]


def _quantised(spark, sf):
    from tamis.sources import heads as H

    stored = H.load_reference(H.build_reference(W.items(spark, sf)))
    return stored.select(F.col("ref_id").alias("item_id"), "e")


_QUANT = """AND sc AS (SELECT item_id, u, list_max(list_transform(u, lambda x: abs(x))) / 127 + 1e-12 AS s FROM unit),
  qt AS (SELECT item_id, u, s::FLOAT AS scale, list_transform(u, lambda x: round_even(x / s, 0)::TINYINT) AS q FROM sc),
  dq AS (SELECT item_id, u, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS e FROM (
    SELECT item_id, u, list_transform(q, lambda x: x::DOUBLE * scale::DOUBLE) AS v FROM qt))"""


@query("j14_paired_rows_check", W.with_views("unit cent", _QUANT + """, tops AS (
    SELECT item_id, arg_max(class_idx, list_dot_product(u, c)) = arg_max(class_idx, list_dot_product(e, c)) AS same FROM dq CROSS JOIN cent GROUP BY 1)
  SELECT count(*) AS n, round(min(list_dot_product(u, e) / sqrt(list_dot_product(u, u) * list_dot_product(e, e))), 6) AS min_cosine,
    round(max(list_max(list_transform(list_zip(u, e), lambda p: abs(p[1] - p[2])))), 6) AS max_abs_difference, count(*) FILTER (WHERE same) AS same_decision FROM dq JOIN tops USING (item_id)"""))
def paired_rows_check(spark, sf):
    from tamis.functions import vectors as V

    head = W.head(spark, sf)
    first = S.score(W.items(spark, sf).select("item_id", V.l2_normalise(F.col("e")).alias("e")), head)
    second = S.score(_quantised(spark, sf), head)
    return _rounded(VAL.paired_rows_check(first, second, "item_id", "e", "top"), "min_cosine", "max_abs_difference")


@query("j15_paired_folds", W.with_views("decided", """AND t AS (SELECT *, max_prob >= 0.135 AND familiar AND NOT routed AS answered2 FROM decided WHERE split = 'field'),
  a AS (SELECT fold, avg(answered::INT) AS coverage, avg((forced = class_idx)::INT) AS acc_all FROM t GROUP BY 1),
  b AS (SELECT fold, avg(answered2::INT) AS coverage, avg((forced = class_idx)::INT) AS acc_all FROM t GROUP BY 1)
  SELECT 'coverage' AS measure, round(avg(b.coverage - a.coverage), 6) AS mean_difference,
    count(*) FILTER (WHERE b.coverage < a.coverage) AS folds_lower FROM a JOIN b USING (fold)
  UNION ALL SELECT 'acc_all', round(avg(b.acc_all - a.acc_all), 6), count(*) FILTER (WHERE b.acc_all < a.acc_all) FROM a JOIN b USING (fold)"""))
def paired_folds(spark, sf):
    rows, head = W.scored(spark, sf)
    field = rows.where("split = 'field'")
    first = M.rule_metrics(S.decide(field, head), by=["fold"])
    second = M.rule_metrics(S.decide(field, head.with_settings(threshold=0.135)), by=["fold"])
    return _rounded(C.paired_folds(first, second, ["coverage", "acc_all"]), "mean_difference")


GRID = [0.60 + 0.02 * i for i in range(10)]


@query("j16_parameter_cross", W.with_views("scored", """SELECT (g - 1)::INT AS candidate_idx, round((0.60 + 0.02 * (g - 1))::DOUBLE, 6) AS candidate,
  count(*) FILTER (WHERE distance <= 0.6::DOUBLE + 0.02::DOUBLE * (g - 1)) AS passed,
  count(*) FILTER (WHERE distance <= 0.6::DOUBLE + 0.02::DOUBLE * (g - 1) AND top = class_idx) AS hits FROM scored, range(1, 11) t(g) GROUP BY g"""))
def parameter_cross(spark, sf):
    rows, _ = W.scored(spark, sf)
    counts = C.parameter_counts(rows, GRID, F.col("top") == F.col("class_idx"), F.col("distance"))
    return _rounded(counts, "candidate")


@query("j17_apply_fold_scalars", W.with_views("scored", """AND f AS (SELECT fold, avg(max_prob) AS threshold, quantile_cont(distance, 0.95) AS cutoff
    FROM scored WHERE split = 'calib' AND fold <> 4 GROUP BY 1)
  SELECT item_id, round(coalesce(f.threshold, 0.13), 6) AS threshold, round(coalesce(f.cutoff, 0.76), 6) AS cutoff,
    max_prob >= coalesce(f.threshold, 0.13) AND distance <= coalesce(f.cutoff, 0.76) AS passes FROM scored LEFT JOIN f USING (fold)"""))
def apply_fold_scalars(spark, sf):
    from tamis.operators.ranks import exact_quantiles

    rows, _ = W.scored(spark, sf)
    calib = rows.where("split = 'calib' and fold <> 4")
    scalars = calib.groupBy("fold").agg(F.avg("max_prob").alias("threshold")).join(
        exact_quantiles(calib, F.col("distance"), [0.95], ["fold"]).select("fold", F.col("q0").alias("cutoff")), "fold")
    out = C.apply_fold_scalars(rows, scalars, {"threshold": 0.13, "cutoff": 0.76})
    return out.select("item_id", F.round("threshold", 6).alias("threshold"), F.round("cutoff", 6).alias("cutoff"),
                      ((F.col("max_prob") >= F.col("threshold")) & (F.col("distance") <= F.col("cutoff"))).alias("passes"))


@query("j18_mentions_join", r"""WITH k AS (SELECT DISTINCT unnest(string_split_regex(lower(text), '[^\p{L}\p{N}_]+')) AS key FROM benchmark),
  w AS (SELECT DISTINCT doc_id, unnest(string_split_regex(lower(text), '[^\p{L}\p{N}_]+')) AS word FROM documents)
  SELECT doc_id, key FROM w JOIN k ON key = word WHERE key <> ''""")
def mentions_join(spark, sf):
    """Texts linked to the keys they name as a whole word. Words are matched by equality, not text by text and key by key."""
    pattern = r"[^\p{L}\p{N}_]+"
    keys = W.table(spark, sf, "benchmark").select(F.explode(F.array_distinct(F.split(F.lower("text"), pattern))).alias("key")).where("key <> ''").distinct()
    words = W.table(spark, sf, "documents").select("doc_id", F.explode(F.array_distinct(F.split(F.lower("text"), pattern))).alias("key"))
    return words.join(keys, "key").select("doc_id", "key")


@query("j18_phrases", r"""WITH b AS (SELECT item_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}_]+'), lambda w: w <> '') AS w FROM benchmark),
  k AS (SELECT DISTINCT array_to_string(w[1:item_id % 4 + 1], ' ') AS key, len(w[1:item_id % 4 + 1]) AS l FROM b WHERE len(w) > 0),
  d AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}_]+'), lambda w: w <> '') AS w FROM documents),
  r AS (SELECT doc_id, l, unnest(list_transform(range(1, len(w) - l + 2), lambda i: array_to_string(w[i:i + l - 1], ' '))) AS key FROM d, (SELECT DISTINCT l FROM k))
  SELECT doc_id, key, count(*) AS n FROM r JOIN k USING (key, l) GROUP BY 1, 2""")
def phrases(spark, sf):
    """Texts linked to keys of one to four words: the first words of each benchmark item."""
    first = W.table(spark, sf, "benchmark").select(F.array_join(F.slice(whole_words(F.col("text")), F.lit(1), (F.col("item_id") % 4 + 1).cast("int")), " ").alias("key"))
    return mentions(W.table(spark, sf, "documents"), first)


@query("j19_changed_keys", """WITH o AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'good' ELSE 'poor' END AS v FROM labels WHERE doc_id % 11 <> 0),
  n AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'poor' ELSE 'good' END AS v FROM labels WHERE doc_id % 7 <> 0)
  SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, o.v AS old_value, n.v AS new_value FROM o FULL JOIN n ON o.doc_id = n.doc_id
  WHERE o.v IS DISTINCT FROM n.v AND coalesce(o.doc_id, n.doc_id) NOT IN (3, 5, 8)""")
def changed_keys(spark, sf):
    base = W.table(spark, sf, "labels")
    old = base.where("doc_id % 11 <> 0").select("doc_id", F.when(F.col("quality") == 1, "good").otherwise("poor").alias("v"))
    new = base.where("doc_id % 7 <> 0").select("doc_id", F.when(F.col("toxic") == 1, "poor").otherwise("good").alias("v"))
    return VAL.changed_keys(old, new, "doc_id", "v", exempt=(3, 5, 8))
