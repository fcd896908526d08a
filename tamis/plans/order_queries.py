"""Rankings, top lists, splits, samples, set operations, copy groups and checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tamis.operators import components as CC
from tamis.operators import linkage as LK
from tamis.operators import metrics as M
from tamis.operators import neighbours as N
from tamis.operators import raters as RT
from tamis.operators import review as R
from tamis.operators import shrinkage as SH
from tamis.operators import splits as X
from tamis.operators import validation as VAL
from tamis.operators.ranks import hash_order
from tamis.plans import views as W
from tamis.plans.aggregate_queries import COMPONENTS_SQL, rounded
from tamis.plans.registry import query


@query("w01_topk_neighbours", W.with_views("sims", "SELECT item_id, ref_id, round(s, 6) AS similarity, rn::INT AS rank FROM sims"))
def w01(spark, sf):
    return rounded(N.knn_join(W.items(spark, sf), W.reference_rows(spark, sf), W.K))


@query("w02_risk_coverage", W.with_views("scored", """SELECT item_id, place, round(hits / place, 6) AS accuracy FROM (
  SELECT item_id, row_number() OVER o AS place, sum((top = class_idx)::INT) OVER o AS hits FROM scored
  WINDOW o AS (ORDER BY round(max_prob, 3) DESC, item_id ROWS UNBOUNDED PRECEDING))"""))
def w02(spark, sf):
    rows, _ = W.scored(spark, sf)
    return rounded(M.risk_coverage(rows.withColumn("p", F.round("max_prob", 3)), "item_id", F.col("top") == F.col("class_idx"), "p"))


@query("w02_area_and_points", W.with_views("scored", """AND c AS (SELECT row_number() OVER o AS place, sum((top = class_idx)::INT) OVER o AS hits, count(*) OVER () AS n FROM scored
    WINDOW o AS (ORDER BY max_prob DESC, item_id ROWS UNBOUNDED PRECEDING)),
  k AS (SELECT DISTINCT floor((n - 1) * g / 39)::BIGINT + 1 AS place FROM c, range(0, 40) t(g))
  SELECT place, round(place / n, 4) AS coverage, round(hits / place, 4) AS accuracy, round((SELECT avg(1 - hits / place) FROM c), 6) AS aurc
  FROM c JOIN k USING (place)"""))
def w02_points(spark, sf):
    """The area under the risk curve and 40 evenly spaced points of it."""
    rows, _ = W.scored(spark, sf)
    curve = M.risk_coverage(rows, "item_id", F.col("top") == F.col("class_idx")).persist()
    n, area = curve.agg(F.count(F.lit(1)), F.avg(1 - F.col("accuracy"))).first()
    wanted = sorted({int((n - 1) * g / 39) + 1 for g in range(40)})
    return curve.where(F.col("place").isin(wanted)).select(
        "place", F.round(F.col("place") / n, 4).alias("coverage"), F.round("accuracy", 4).alias("accuracy"), F.round(F.lit(area), 6).alias("aurc"))


@query("w03_group_weights", W.with_views("items", """SELECT item_id, round(1.0 / count(*) OVER (PARTITION BY class_idx, item_id % 7), 6) AS weight
  FROM items WHERE split = 'field'""".replace("round(1.0", "round(1.0::DOUBLE")))
def w03(spark, sf):
    rows = W.items(spark, sf).where("split = 'field'").withColumn(
        "grp", F.concat_ws("-", F.col("class_idx").cast("string"), (F.col("item_id") % 7).cast("string")))
    return rounded(M.group_weights(rows, "grp").select("item_id", "weight"))


@query("w04_dedup_by_hash", """SELECT lang, sha256(text) AS h, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1, 2""")
def w04(spark, sf):
    return W.table(spark, sf, "documents").groupBy("lang", F.sha2("text", 256).alias("h")).agg(
        F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


@query("w05_latest_per_key", W.with_views("ev", """SELECT grp, event_id, event_type FROM (SELECT *, row_number() OVER (
  PARTITION BY grp ORDER BY date_trunc('hour', ts) DESC, event_id) AS rn FROM ev) WHERE rn = 1"""))
def w05(spark, sf):
    rows = W.ev(spark, sf).select("grp", "event_id", "event_type", F.unix_seconds(F.date_trunc("hour", "ts")).alias("stamp"))
    return RT.latest_per_key(rows, "grp", "stamp", "event_id").select("grp", "event_id", "event_type")


@query("w06_open_visit", W.with_views("plots", """SELECT p.plot_id, round(max(o_totalprice), 6) AS updated FROM plots p JOIN orders ON o_custkey = plot_id
  WHERE status = 'in_progress' AND NOT synthetic GROUP BY 1 ORDER BY max(o_totalprice) DESC, p.plot_id LIMIT 1"""))
def w06(spark, sf):
    updated = W.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("plot_id")).agg(F.max("o_totalprice").alias("updated"))
    return R.open_visit(W.plots(spark, sf).join(updated, "plot_id"), "updated").select("plot_id", F.round("updated", 6).alias("updated"))


@query("w06_known_villages", W.with_views("plots", "SELECT DISTINCT trim(village) AS village FROM plots WHERE NOT synthetic AND trim(village) <> ''"))
def w06_villages(spark, sf):
    return R.known_villages(W.plots(spark, sf))


@query("w07_rank_groups", W.with_views("groups", """SELECT grp, n, x, row_number() OVER (ORDER BY round(coalesce((5 + x) / (20 + n), -1), 12) DESC, n DESC, grp) AS rank FROM groups"""))
def w07(spark, sf):
    scored = W.groups(spark, sf).withColumn("p_above", (5 + F.col("x")) / (20 + F.col("n")))
    return SH.rank_groups(scored, "grp").select("grp", "n", "x", "rank")


@query("w08_queue_order", W.with_views("finals", "SELECT photo_id, created FROM finals WHERE in_queue ORDER BY created, photo_id"))
def w08(spark, sf):
    return R.queue(W.photos(spark, sf)).select("photo_id", "created").orderBy("created", "photo_id")


@query("w08_newest_visits", W.with_views("plots photos", """AND c AS (SELECT plot_id, max(created) AS created, count(*) AS k FROM photos GROUP BY 1),
  t AS (SELECT p.plot_id, c.created FROM plots p JOIN c USING (plot_id) WHERE NOT synthetic ORDER BY c.created DESC, p.plot_id DESC LIMIT 10)
  SELECT t.plot_id, t.created, k AS photos FROM t JOIN c USING (plot_id)"""))
def w08_newest(spark, sf):
    photos = W.photos(spark, sf)
    last = photos.groupBy("plot_id").agg(F.max("created").alias("created"))
    return R.recent_visits(W.plots(spark, sf).join(last, "plot_id"), photos, "created").select("plot_id", "created", "photos")


@query("w09_largest_remainder", """WITH s AS (SELECT lang, count(*) AS size FROM documents GROUP BY 1), p AS (SELECT *, size * 37 / sum(size) OVER () AS sh FROM s),
  r AS (SELECT *, floor(sh) AS f, row_number() OVER (ORDER BY round(sh - floor(sh), 9) DESC, lang) AS rn, 37 - sum(floor(sh)) OVER () AS rest FROM p)
  SELECT lang, size, (f + (rn <= rest)::INT)::BIGINT AS seats FROM r""")
def w09(spark, sf):
    strata = W.table(spark, sf, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("size"))
    return X.largest_remainder(strata, "lang", "size", 37)


@query("w10_nested_prefix", W.with_views("items", """SELECT k, item_id, rn::INT AS rn FROM (SELECT item_id, row_number() OVER (ORDER BY md5('nest|' || item_id), item_id) AS rn
  FROM items WHERE split = 'field') CROSS JOIN (VALUES (10), (20), (50)) t(k) WHERE rn <= k"""))
def w10(spark, sf):
    rows = W.items(spark, sf).where("split = 'field'").select("item_id")
    return X.nested_prefixes(rows, hash_order("nest", F.col("item_id")), [10, 20, 50], tie="item_id").select("k", "item_id", "rn")


@query("w11_per_key_shuffle", W.with_views("answers", """SELECT rater, item_id, row_number() OVER (PARTITION BY rater ORDER BY md5('show|' || rater || '|' || item_id), item_id) AS position FROM answers"""))
def w11(spark, sf):
    return X.per_key_shuffle(W.answers(spark, sf).select("rater", "item_id"), "rater", "item_id", "show").select("rater", "item_id", "position")


@query("w12_visit_shortlist", W.with_views("groups", "SELECT grp, round(x / n, 6) AS score FROM groups ORDER BY x / n DESC, grp LIMIT 5"))
def w12(spark, sf):
    g = W.groups(spark, sf).withColumn("score", F.col("x") / F.col("n"))
    return rounded(SH.shortlist(g, "score", "grp").select("grp", "score"))


@query("u01_union_items", W.with_views("items", """SELECT source, count(*) AS n, count(label) AS labelled FROM (
  SELECT 'vectors' AS source, item_id, class_idx::VARCHAR AS label FROM items UNION ALL SELECT source, doc_id, NULL FROM documents) GROUP BY 1"""))
def u01(spark, sf):
    a = W.items(spark, sf).select(F.lit("vectors").alias("source"), "item_id", F.col("class_idx").cast("string").alias("label"))
    b = W.table(spark, sf, "documents").select("source", F.col("doc_id").alias("item_id"))
    return a.unionByName(b, allowMissingColumns=True).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count("label").alias("labelled"))


@query("u02_extend_reference", W.with_views("items", """SELECT item_id AS ref_id, CASE WHEN split = 'train' THEN 'shipped' ELSE 'reviewed' END AS origin
  FROM items WHERE split IN ('train', 'calib')"""))
def u02(spark, sf):
    from tamis.sources.heads import build_reference, extend_reference

    rows = W.items(spark, sf)
    return extend_reference(build_reference(rows.where("split = 'train'")),
                            build_reference(rows.where("split = 'calib'"), origin="reviewed")).select("ref_id", "origin")


@query("u03_merge_corrections", """WITH b AS (SELECT doc_id::VARCHAR AS id, lang, source AS suggestion, n_chars::VARCHAR AS created FROM documents),
  o AS (SELECT * FROM b WHERE id::BIGINT % 3 = 0), n AS (SELECT DISTINCT * FROM b WHERE id::BIGINT % 2 = 0 AND lang <> 'fr')
  SELECT *, false AS added FROM o UNION ALL SELECT *, true FROM (SELECT * FROM n EXCEPT SELECT * FROM o)""")
def u03(spark, sf):
    base = W.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), "lang", F.col("source").alias("suggestion"),
                                                  F.col("n_chars").cast("string").alias("created"))
    old = base.where("cast(id as bigint) % 3 = 0")
    new = base.where("cast(id as bigint) % 2 = 0").withColumn("lang", F.when(F.col("lang") != "fr", F.col("lang")))
    return R.merge_corrections(old, new.unionByName(new))


@query("u04_sync_labels", W.with_views("photos", """AND s AS (SELECT photo_id, CASE WHEN photo_id % 6 = 0 THEN 'rust' ELSE officer_label END AS l FROM photos WHERE photo_id % 5 <> 0)
  SELECT p.photo_id, CASE WHEN s.photo_id IS NOT NULL AND p.officer_label IS DISTINCT FROM s.l THEN s.l ELSE p.officer_label END AS officer_label,
    s.photo_id IS NOT NULL AND p.officer_label IS DISTINCT FROM s.l AS changed FROM photos p LEFT JOIN s USING (photo_id)"""))
def u04(spark, sf):
    rows = W.photos(spark, sf).select("photo_id", "officer_label")
    store = rows.where("photo_id % 5 <> 0").withColumn(
        "officer_label", F.when(F.col("photo_id") % 6 == 0, "rust").otherwise(F.col("officer_label")))
    return R.sync_labels(rows, store).select("photo_id", "officer_label", "changed")


@query("u05_discard_visits", W.with_views("plots photos", """AND gone AS (SELECT plot_id FROM plots WHERE status = 'in_progress' OR synthetic)
  SELECT 'plots' AS kind, count(*) AS kept FROM plots WHERE plot_id NOT IN (FROM gone)
  UNION ALL SELECT 'photos', count(*) FROM photos WHERE plot_id NOT IN (FROM gone)"""))
def u05(spark, sf):
    plots = W.plots(spark, sf)
    a, b = R.discard_visits(plots, W.photos(spark, sf), plots.where("status = 'in_progress' or synthetic"))
    return a.agg(F.lit("plots").alias("kind"), F.count(F.lit(1)).alias("kept")).unionByName(
        b.agg(F.lit("photos").alias("kind"), F.count(F.lit(1)).alias("kept")))


@query("u06_id_sets", """SELECT 'both' AS part, doc_id FROM (SELECT doc_id FROM labels INTERSECT SELECT item_id FROM benchmark)
  UNION ALL SELECT 'labels only', doc_id FROM (SELECT doc_id FROM labels EXCEPT SELECT item_id FROM benchmark)""")
def u06(spark, sf):
    a = W.table(spark, sf, "labels").select("doc_id")
    b = W.table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"))
    return a.intersect(b).select(F.lit("both").alias("part"), "doc_id").unionByName(a.subtract(b).select(F.lit("labels only").alias("part"), "doc_id"))


@query("x01_stratified_half", """SELECT doc_id, CASE WHEN rn <= floor(n / 2) THEN 'train' ELSE 'calib' END AS part FROM (
  SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5('half|' || doc_id), doc_id) AS rn, count(*) OVER (PARTITION BY lang) AS n FROM documents)""")
def x01(spark, sf):
    return X.stratified_half_split(W.table(spark, sf, "documents").select("doc_id", "lang"), "lang", "doc_id", "half").select("doc_id", "part")


@query("x02_group_holdout", """WITH u AS (SELECT unit, row_number() OVER (ORDER BY md5('hold|' || unit), unit) AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT o_custkey AS unit FROM orders))
  SELECT o_orderkey, CASE WHEN rn <= floor(n * 0.15::DOUBLE) THEN 'val' ELSE 'train' END AS split FROM orders JOIN u ON unit = o_custkey""")
def x02(spark, sf):
    rows = W.table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("unit"))
    return X.group_holdout(rows, "unit", 0.15, "hold").select("o_orderkey", "split")


@query("x03_group_kfold", """WITH o AS (SELECT o_custkey AS unit, min(o_orderstatus) AS owner FROM orders GROUP BY 1),
  f AS (SELECT unit, ((row_number() OVER (PARTITION BY owner ORDER BY md5('fold|' || unit), unit) - 1) % 5)::INT AS fold FROM o)
  SELECT o_orderkey, fold FROM orders JOIN f ON unit = o_custkey""")
def x03(spark, sf):
    rows = W.table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("unit"), "o_orderstatus")
    return X.group_kfold(rows, "unit", "o_orderstatus", 5, "fold").select("o_orderkey", "fold")


@query("x04_seeded_pool_split", W.with_views("items_aug", """AND u AS (SELECT unit, seed, row_number() OVER (PARTITION BY seed ORDER BY md5(seed || '|' || unit), unit) AS rn,
    count(*) OVER (PARTITION BY seed) AS n FROM (SELECT DISTINCT item_id % 1000000 AS unit FROM items_aug) CROSS JOIN (VALUES (2000), (2001), (2002)) t(seed))
  SELECT seed, item_id, rn <= floor(n * 0.5) AS in_pool FROM items_aug JOIN u ON unit = item_id % 1000000"""))
def x04(spark, sf):
    rows = W.items_aug(spark, sf).select("item_id", (F.col("item_id") % 1000000).alias("unit"))
    return X.seeded_pool_split(rows, "unit", [2000, 2001, 2002]).select("seed", "item_id", "in_pool")


@query("x05_dev_sealed_split", W.with_views("items_aug", """AND p AS (SELECT DISTINCT item_id % 1000000 AS unit FROM items_aug WHERE item_id IN (SELECT item_id FROM benchmark)),
  u AS (SELECT unit, unit IN (SELECT unit FROM p) AS forced, row_number() OVER (ORDER BY (unit IN (SELECT unit FROM p))::INT || md5('dev|' || unit), unit) AS rn, count(*) OVER () AS n
    FROM (SELECT DISTINCT item_id % 1000000 AS unit FROM items_aug))
  SELECT item_id, CASE WHEN NOT forced AND rn <= round(n * 0.4) THEN 'dev' ELSE 'sealed' END AS part FROM items_aug JOIN u ON unit = item_id % 1000000"""))
def x05(spark, sf):
    rows = W.items_aug(spark, sf).select("item_id", (F.col("item_id") % 1000000).alias("unit"))
    protected = W.table(spark, sf, "benchmark").select("item_id")
    return X.development_sealed_split(rows, "unit", 0.4, "dev", protected).select("item_id", "part")


@query("x06_sample_cap", """SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('cap|' || doc_id), doc_id) AS rn FROM documents) WHERE rn <= 60""")
def x06(spark, sf):
    return X.sample_cap_per_class(W.table(spark, sf, "documents").select("doc_id", "lang"), 60, "lang", "doc_id", "cap")


@query("x07_reference_sample", W.with_views("refs", "SELECT ref_id, class_idx FROM refs"))
def x07(spark, sf):
    from tamis.operators.scoring import stratified_reference

    train = W.items(spark, sf).where("split = 'train'")
    return stratified_reference(train, W.REFERENCE_PER_CLASS, seed="ref", strict=False).select(F.col("item_id").alias("ref_id"), "class_idx")


@query("x08_one_per_group", W.with_views("items_aug", """AND f AS (SELECT item_id % 1000000 AS g, arg_min(item_id, md5('one-member|' || item_id)) AS item_id FROM items_aug GROUP BY 1)
  SELECT g, item_id, row_number() OVER (ORDER BY md5('one-group|' || g), g) AS place FROM f"""))
def x08(spark, sf):
    rows = W.items_aug(spark, sf).select("item_id", (F.col("item_id") % 1000000).alias("g"))
    return X.one_per_group(rows, "g", "item_id", "one").select("g", "item_id", "place")


@query("x10_copy_groups", W.with_views("unit_aug", COMPONENTS_SQL.format(tau=0.98) + " SELECT item_id, copy_group FROM grp", recursive=True))
def x10(spark, sf):
    return CC.copy_groups(W.items_aug(spark, sf), 0.98)


@query("x10_loose_groups", W.with_views("unit_aug", COMPONENTS_SQL.format(tau=0.4) + " SELECT item_id, copy_group FROM grp", recursive=True))
def x10_loose(spark, sf):
    """The same at a low threshold, where chains of several rows join."""
    return CC.copy_groups(W.items_aug(spark, sf), 0.4)


@query("x11_average_linkage")
def x11(spark, sf):
    return LK.average_linkage_cuts(W.items_aug(spark, sf), {"unit_fine": 0.85, "unit_coarse": 0.70})


@query("x12_conflict_groups", W.with_views("unit_aug", COMPONENTS_SQL.format(tau=0.98) + """
  SELECT copy_group, count(*) AS n, count(DISTINCT class_idx) AS labels FROM grp JOIN unit_aug USING (item_id) GROUP BY 1 HAVING count(DISTINCT class_idx) > 1""", recursive=True))
def x12(spark, sf):
    rows = W.items_aug(spark, sf)
    return X.conflict_groups(CC.copy_groups(rows, 0.98).join(rows.select("item_id", "class_idx"), "item_id"), "copy_group", "class_idx")


@query("x12_conflict_label_pairs", W.with_views("unit_aug", COMPONENTS_SQL.format(tau=0.98) + """,
  l AS (SELECT DISTINCT copy_group, class_idx FROM grp JOIN unit_aug USING (item_id))
  SELECT a.class_idx AS low, b.class_idx AS high, count(*) AS groups FROM l a JOIN l b ON a.copy_group = b.copy_group AND a.class_idx < b.class_idx GROUP BY 1, 2""", recursive=True))
def x12_pairs(spark, sf):
    """Per copy group the set of its labels (bounded by the classes), then the label pairs of each set."""
    rows = W.items_aug(spark, sf)
    labels = CC.copy_groups(rows, 0.98).join(rows.select("item_id", "class_idx"), "item_id").groupBy("copy_group").agg(
        F.array_sort(F.collect_set("class_idx")).alias("l")).where(F.size("l") > 1)
    low = labels.select("l", F.posexplode("l").alias("i", "low"))
    return low.select("low", F.explode(F.slice("l", F.col("i") + 2, F.size("l"))).alias("high")).groupBy("low", "high").agg(
        F.count(F.lit(1)).alias("groups"))


@query("x13_leakage_filter", W.with_views("unit_aug", COMPONENTS_SQL.format(tau=0.98) + """,
  m AS (SELECT u.item_id, class_idx, split, copy_group FROM unit_aug u JOIN grp USING (item_id)),
  bad AS (SELECT copy_group FROM m WHERE split = 'field' UNION SELECT copy_group FROM m WHERE split IN ('field', 'train') GROUP BY 1 HAVING count(DISTINCT class_idx) > 1)
  SELECT item_id, class_idx FROM m WHERE split = 'train' AND copy_group NOT IN (FROM bad)""", recursive=True))
def x13(spark, sf):
    rows = W.items_aug(spark, sf)
    groups = CC.copy_groups(rows, 0.98)
    return X.leakage_filter(rows.where("split = 'train'"), rows.where("split = 'field'"), groups, "class_idx").select("item_id", "class_idx")


@query("x14_copy_unit_key", W.with_views("items_aug", "SELECT item_id, class_idx || '-' || (item_id % 1000000) AS copy_unit FROM items_aug"))
def x14(spark, sf):
    return W.items_aug(spark, sf).select("item_id", X.copy_unit_key(F.col("class_idx"), F.col("item_id") % 1000000).alias("copy_unit"))


@query("v02_same_artifact", """WITH r AS (SELECT n_name AS field, n_regionkey::VARCHAR AS value FROM nation),
  h AS (SELECT n_name AS field, CASE WHEN n_nationkey % 6 = 0 THEN '9' WHEN n_nationkey % 6 = 1 THEN NULL ELSE n_regionkey::VARCHAR END AS value FROM nation)
  SELECT field, r.value AS old_value, h.value AS new_value FROM r JOIN h USING (field) WHERE r.value IS DISTINCT FROM h.value""")
def v02(spark, sf):
    nation = W.table(spark, sf, "nation")
    result = nation.select(F.col("n_name").alias("field"), F.col("n_regionkey").cast("string").alias("value"))
    key = F.col("n_nationkey") % 6
    used = nation.select(F.col("n_name").alias("field"), F.when(key == 0, "9").when(key != 1, F.col("n_regionkey").cast("string")).alias("value"))
    return VAL.same_artifact(result, used)


@query("v03_no_straddle", W.with_views("items_aug", """SELECT item_id % 1000000 AS unit, count(DISTINCT CASE WHEN item_id % 3 = 0 THEN 'a' ELSE 'b' END) AS splits
  FROM items_aug GROUP BY 1 HAVING count(DISTINCT CASE WHEN item_id % 3 = 0 THEN 'a' ELSE 'b' END) > 1"""))
def v03(spark, sf):
    rows = W.items_aug(spark, sf).select((F.col("item_id") % 1000000).alias("unit"), F.when(F.col("item_id") % 3 == 0, "a").otherwise("b").alias("s"))
    return X.straddling_units(rows, "unit", "s")


@query("v04_checksum_filter", """SELECT doc_id FROM documents WHERE doc_id % 9 <> 0 OR doc_id % 2 = 0""")
def v04(spark, sf):
    docs = W.table(spark, sf, "documents")
    stored = F.when((F.col("doc_id") % 9 == 0) & (F.col("doc_id") % 2 != 0), "bad").when(F.col("doc_id") % 2 == 0, F.lit(None).cast("string")).otherwise(F.sha2("text", 256))
    return VAL.checksum_filter(docs, F.col("text"), stored).select("doc_id")


@query("d01_median_days_to_label", W.with_views("photos", """AND r AS (SELECT created, created + to_days((photo_id % 23)::INT) AS reviewed FROM photos WHERE officer_label IS NOT NULL)
  SELECT count(*) AS n, round(quantile_cont(date_diff('day', created, reviewed), 0.5), 6) AS median_days FROM r"""))
def d01(spark, sf):
    reviewed = F.date_add(F.to_date("created"), (F.col("photo_id") % 23).cast("int"))
    return rounded(R.median_days_to_label(W.photos(spark, sf).where("officer_label is not null"), F.col("created"), reviewed))


@query("d02_weekly_disagreement", W.with_views("photos", """SELECT date_trunc('week', created)::TIMESTAMP AS week, label, count(*) AS n, round(avg(disputed::INT), 6) AS disputed_share,
  count(*) FILTER (WHERE disputed AND officer_label <> 'skip') AS disputed_reviewed,
  round(count(*) FILTER (WHERE disputed AND officer_label <> 'skip' AND officer_label <> label) / nullif(count(*) FILTER (WHERE disputed AND officer_label <> 'skip'), 0), 6) AS sided_with_person
  FROM photos WHERE label IS NOT NULL GROUP BY 1, 2"""))
def d02(spark, sf):
    return rounded(R.weekly_disagreement(W.photos(spark, sf)))


@query("d03_recent_group_view", W.with_views("plots finals", """AND m AS (SELECT max(created) AS until FROM finals),
  c AS (SELECT lower(trim(village)) AS village_key, variety, count(*) AS photos, count(*) FILTER (WHERE final_label = 'rust') AS rust
    FROM finals JOIN plots USING (plot_id) CROSS JOIN m WHERE created > until - INTERVAL 30 DAY AND created <= until GROUP BY 1, 2)
  SELECT *, round(photos / sum(photos) OVER (PARTITION BY village_key), 6) AS share_of_group FROM c"""))
def d03(spark, sf):
    photos = W.photos(spark, sf)
    until = photos.agg(F.max("created")).first()[0]
    return rounded(R.recent_group_view(W.plots(spark, sf), photos, F.lit(until)))


@query("d04_pause_rules", W.with_views("finals decided", """SELECT 'queue_age' AS rule, v AS value, v > 30 AS paused FROM (
    SELECT max(date_diff('day', created, TIMESTAMP '1998-08-03'))::DOUBLE AS v FROM finals WHERE in_queue)
  UNION ALL SELECT 'healthy_routed', round(v, 6), v > 0.05 FROM (SELECT avg(routed::INT) AS v FROM decided WHERE class_idx = 0 AND split = 'field')"""))
def d04(spark, sf):
    healthy = W.decided(spark, sf).where("class_idx = 0 and split = 'field'")
    share = healthy.agg(F.avg(F.col("routed").cast("double"))).first()[0]
    return rounded(R.pause_alerts(W.photos(spark, sf), F.lit("1998-08-03").cast("timestamp"), F.lit(share)))


