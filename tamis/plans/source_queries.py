"""Readers and writers, exercised on copies of the test tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from tamis.functions import vectors as V
from tamis.operators import shrinkage as SH
from tamis.operators import validation as VAL
from tamis.plans import views as W
from tamis.plans.aggregate_queries import CLASSES, ROLLUP_SQL, VISIT_SQL, rounded
from tamis.plans.calibration_queries import POSTERIOR_SQL, PRIOR_SQL
from tamis.plans.join_queries import _QUANT
from tamis.plans.registry import query
from tamis.session import scratch_path
from tamis.sources import exports as X
from tamis.sources import heads as H
from tamis.sources import items as I
from tamis.sources import raters as RS


@query("s01_read_items", W.with_views("items", """SELECT item_id, 'src' || (item_id % 3) AS source, class_idx::VARCHAR AS label, round(list_sum(e), 6) AS total FROM items"""))
def s01(spark, sf):
    base = W.table(spark, sf, "embeddings")
    index, vectors = scratch_path(spark, "index"), scratch_path(spark, "vectors")
    I.write_index(base.select(F.col("vec_id").alias("item_id"), F.concat(F.lit("src"), F.col("vec_id") % 3).alias("source"),
                              F.col("label").cast("string").alias("label"), F.lit("").alias("detail"), F.lit("g").alias("group"),
                              F.lit("p").alias("path")), index)
    base.select(F.col("vec_id").alias("item_id"), "embedding").write.parquet(vectors)
    return rounded(I.read_items(spark, index, vectors).select("item_id", "source", "label", V.total(V.as_double(F.col("embedding"))).alias("total")))


@query("s02_manifest", "SELECT lang AS cls, source AS filename, doc_id::VARCHAR AS id, n_chars AS size, sha256(text) AS sha256, 'u' || doc_id AS url FROM documents")
def s02(spark, sf):
    path = scratch_path(spark, "manifest")
    I.write_manifest(W.table(spark, sf, "documents").select(
        F.col("lang").alias("cls"), F.col("source").alias("filename"), F.col("doc_id").cast("string").alias("id"), F.col("n_chars").alias("size"),
        F.sha2("text", 256).alias("sha256"), F.concat(F.lit("u"), F.col("doc_id")).alias("url")), path)
    return I.read_manifest(spark, path)


@query("s03_annotations", """SELECT 'd' || doc_id AS file, CASE WHEN quality = 1 THEN 'rust_level_2' WHEN toxic = 1 THEN 'red_spider_mite' ELSE 'healthy' END AS detail,
  CASE WHEN quality = 1 THEN 'rust' WHEN toxic = 1 THEN 'mite' ELSE 'healthy' END AS label FROM labels WHERE doc_id % 7 <> 0 AND doc_id % 11 <> 0""")
def s03(spark, sf):
    path = scratch_path(spark, "annotations")
    doc = F.col("doc_id")
    name = F.when(F.col("quality") == 1, "rust_level_2").when(F.col("toxic") == 1, "red_spider_mite").otherwise("healthy")
    extra = F.when(doc % 7 == 0, "another").when(doc % 2 == 0, "unhealthy").otherwise(name)
    titles = F.when(doc % 11 == 0, F.array(F.lit("unhealthy"))).otherwise(F.array(name, extra))
    W.table(spark, sf, "labels").select(F.concat(F.lit("d"), doc).alias("name"),
                                        F.transform(titles, lambda t: F.struct(t.alias("classTitle"))).alias("objects")).write.json(path)
    return I.read_annotations(spark, path, multi_line=False)


@query("s04_coded_labels", """SELECT doc_id::VARCHAR AS id, CASE (quality + 2 * toxic) WHEN 0 THEN 'healthy' WHEN 1 THEN 'miner' WHEN 2 THEN 'rust' END AS label
  FROM labels WHERE quality + 2 * toxic < 3""")
def s04(spark, sf):
    path = scratch_path(spark, "coded")
    W.table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("id"), (F.col("quality") + 2 * F.col("toxic")).alias("predominant_stress")
                                        ).write.option("header", True).csv(path)
    return I.read_coded_labels(spark, path, {0: "healthy", 1: "miner", 2: "rust"})


@query("s04_labelled_folders", "SELECT CASE lang WHEN 'en' THEN 'healthy' ELSE 'rust' END AS label, count(DISTINCT lang) AS folders FROM documents WHERE lang IN ('en', 'fr', 'de') GROUP BY 1")
def s04_folders(spark, sf):
    """Files below folders named by language; the number of files is the writer's choice, so folders are counted."""
    path = scratch_path(spark, "folders")
    W.table(spark, sf, "documents").select("text", "lang").write.partitionBy("lang").text(path)
    names = {"lang=en": "healthy", "lang=fr": "rust", "lang=de": "rust"}
    found = I.read_labelled_folders(spark, path, names, suffixes=("txt",))
    return found.groupBy("label").agg(F.count_distinct(F.regexp_extract("path", "([^/]+)/[^/]+$", 1)).alias("folders"))


@query("s05_head_document", W.with_views("cent", """SELECT 'c' || class_idx AS class, (generate_subscripts(c, 1) - 1)::INT AS i, round(unnest(c) * 8, 6) AS w FROM cent"""))
def s05(spark, sf):
    path = scratch_path(spark, "head")
    H.write_head(spark, W.head(spark, sf), path)
    rows = H.head_rows(H.read_head_document(spark, path))
    return rounded(rows.select("class", F.posexplode("w").alias("i", "w")))


@query("s06_build_reference", W.with_views("unit", _QUANT + """
  SELECT item_id AS ref_id, (generate_subscripts(q, 1) - 1)::INT AS i, unnest(q)::INT AS q, round(scale::DOUBLE, 6) AS scale FROM qt"""))
def s06(spark, sf):
    ref = H.build_reference(W.items(spark, sf))
    return rounded(ref.select("ref_id", F.posexplode("q").alias("i", "q"), F.col("scale").cast("double").alias("scale")).withColumn("q", F.col("q").cast("int")))


@query("s07_load_reference", W.with_views("unit", _QUANT + " SELECT item_id AS ref_id, (generate_subscripts(e, 1) - 1)::INT AS i, round(unnest(e), 6) AS x FROM dq"))
def s07(spark, sf):
    path = scratch_path(spark, "reference")
    H.write_reference(H.build_reference(W.items(spark, sf)), path)
    return rounded(H.load_reference(spark.read.parquet(path)).select("ref_id", F.posexplode("e").alias("i", "x")))


def _updates(spark, sf):
    """One good update with all calibration rows and all corrections, and two that must be refused."""
    head = W.head(spark, sf)
    rows = W.items(spark, sf).where("split = 'calib'")
    added = H.build_reference(rows)
    labels = rows.select(F.col("item_id").alias("ref_id"), F.col("class_idx").cast("string").alias("label"))
    notes = W.table(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("id"), F.lit("en").alias("lang"))
    root = scratch_path(spark, "updates")
    H.export_update(spark, head, head, added, labels, notes, f"{root}/good")
    H.export_update(spark, head.with_settings(version="older"), head, added, labels, None, f"{root}/stale")
    H.export_update(spark, head, head.with_settings(weights=head.weights[:2]), added, labels, None, f"{root}/shape")
    return head, H.read_updates(spark, f"{root}/*")


@query("s08_export_update", W.with_views("unit", _QUANT + """
  SELECT count(*)::INT AS n_labels, count(*)::INT AS n_rows, round(sum(list_sum(q) * scale::DOUBLE), 4) AS total, (SELECT count(*)::INT FROM benchmark) AS corrections
  FROM qt JOIN (SELECT item_id FROM items WHERE split = 'calib') USING (item_id)"""))
def s08(spark, sf):
    head, updates = _updates(spark, sf)
    good, _ = H.check_updates(updates, head.version, head.classes, head.dim)
    sums = F.zip_with("reference_add.int8", "reference_add.scale", lambda q, s: F.aggregate(q, F.lit(0.0), lambda a, x: a + x) * s)
    return good.select("n_labels", F.size("reference_add.scale").alias("n_rows"), F.round(V.total(sums), 4).alias("total"),
                       F.size("wording_corrections").alias("corrections"))


@query("s09_import_updates", W.with_views("unit", _QUANT + """, ok AS (SELECT count(*) AS n, round(sum(list_sum(e)), 4) AS total FROM dq JOIN (SELECT item_id FROM items WHERE split = 'calib') USING (item_id))
  SELECT 'accepted' AS outcome, n, total FROM ok UNION ALL VALUES ('made for another head', 1, NULL), ('weights do not match', 1, NULL)"""))
def s09(spark, sf):
    head, updates = _updates(spark, sf)
    good, bad = H.check_updates(updates, head.version, head.classes, head.dim)
    rows = H.added_rows(good)
    return rows.agg(F.lit("accepted").alias("outcome"), F.count(F.lit(1)).alias("n"), F.round(F.sum(V.total(F.col("e"))), 4).alias("total")).unionByName(
        bad.groupBy(F.col("reason").alias("outcome")).agg(F.count(F.lit(1)).alias("n")), allowMissingColumns=True)


@query("s10_rater_files", W.with_views("answers", """SELECT lower(rater) || ' ' || (item_id // 100) AS rater, item_id::VARCHAR AS item_id, answer,
  round(seconds, 6) AS seconds FROM answers"""))
def s10(spark, sf):
    """Newest valid document per rater. A rater answers up to 100 items; the older copy holds fewer answers and must not show."""
    root = scratch_path(spark, "raters")
    entry = F.struct(F.col("item_id").cast("string").alias("id"), "answer", "seconds", "changed")
    whole = W.answers(spark, sf).groupBy("rater", F.floor(F.col("item_id") / 100).alias("k")).agg(F.collect_list(entry).alias("answers"))
    name = F.concat(F.lit("  "), F.col("rater"), F.lit("  "), F.col("k"), F.lit(" "))
    for stamp, keep in (("2024-01-01T00:00:00", F.slice("answers", 1, 1)), ("2024-02-01T00:00:00", F.col("answers"))):
        doc = whole.select(F.lit("set1").alias("set"), name.alias("name"), F.lit(stamp).alias("sent_at"), keep.alias("answers"))
        doc.select(F.to_json(F.struct("*")).alias("value")).write.mode("append").text(root)
    spark.createDataFrame([("{not json",), ('{"set": "set2", "name": "x"}',), ('{"set": "set1", "name": " "}',)], "value string").write.mode("append").text(root)
    answers, skipped = RS.read_rater_files(spark, root, "set1")
    if {r.reason for r in skipped.collect()} != {"unreadable", "another set", "no name"}:  # the three bad documents above
        raise ValueError("bad documents must be skipped with their reason")
    return rounded(answers.select("rater", "item_id", "answer", "seconds"))


@query("s11_visit_export", W.with_views("plots finals", VISIT_SQL + """,
  g AS (SELECT *, CASE WHEN plot_id % 13 = 0 THEN '=1+' || village ELSE village END AS v2, TIMESTAMP '2024-01-01' + to_days((plot_id % 50)::INT) AS created FROM plots WHERE NOT synthetic)
  SELECT g.plot_id::VARCHAR AS plot_id, regexp_replace(v2, '^([=+@\\t\\r-])', '''\\1') AS village, strftime(created, '%Y-%m-%d') AS visit_date, g.status,
    has_samples::VARCHAR AS includes_sample_photos, coalesce(photos, 0)::VARCHAR AS photos, coalesce(answered, 0)::VARCHAR AS answered,
    coalesce(n_healthy, 0)::VARCHAR AS healthy, coalesce(n_rust, 0)::VARCHAR AS rust, coalesce(n_other, 0)::VARCHAR AS other,
    coalesce(waiting, 0)::VARCHAR AS waiting, coalesce(disputed, 0)::VARCHAR AS disputed, coalesce(verdict, '') AS verdict, variety FROM g LEFT JOIN vv USING (plot_id)"""))
def s11(spark, sf):
    from tamis.operators import review as R

    plots = W.plots(spark, sf).withColumn("village", F.when(F.col("plot_id") % 13 == 0, F.concat(F.lit("=1+"), "village")).otherwise(F.col("village")))
    plots = plots.withColumn("created", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("plot_id") % 50).cast("int")))
    return X.visit_export(R.visits_with_photos(plots, W.photos(spark, sf), CLASSES), CLASSES)


@query("s12_group_ranking_export", W.with_views("plots finals", ROLLUP_SQL + "," + PRIOR_SQL.format(g="roll")[4:]
       + POSTERIOR_SQL.format(key="village_key", g="roll") + """
  SELECT village, roll.n::VARCHAR AS answered, roll.x::VARCHAR AS flagged, coalesce(printf('%.4f', round(roll.x / nullif(roll.n, 0), 4)), '') AS raw,
    coalesce(printf('%.4f', round(pa / (pa + pb), 4)), '') AS adjusted, coalesce(p_above > 0.5, false)::VARCHAR AS alert, 'fitted' AS prior_source
  FROM roll LEFT JOIN post USING (village_key) LEFT JOIN above USING (pa, pb)"""))
def s12(spark, sf):
    """Four places, a tie at the fifth going up as in the original export; `printf` alone would take the even digit."""
    from tamis.operators import review as R

    roll = R.group_rollup(W.plots(spark, sf), W.photos(spark, sf))
    prior = SH.fit_prior(roll)
    ranked = SH.rank_groups(SH.posterior_alert(roll, prior), "village_key")
    return X.group_ranking_export(ranked, prior.source).select("village", "answered", "flagged", "raw", "adjusted", "alert", "prior_source")


@query("s13_run_log", "SELECT lang AS part, (2 * count(*))::BIGINT AS n FROM documents GROUP BY 1")
def s13(spark, sf):
    path = scratch_path(spark, "runs")
    run = W.table(spark, sf, "documents").groupBy(F.col("lang").alias("part")).agg(F.count(F.lit(1)).alias("n"))
    for _ in range(2):
        I.append_run_log(run, path)
    return spark.read.schema("part string, n bigint").json(path).groupBy("part").agg(F.sum("n").alias("n"))


@query("s14_write_index", "SELECT source, lang AS label, count(*) AS n FROM documents GROUP BY 1, 2")
def s14(spark, sf):
    path = scratch_path(spark, "index")
    I.write_index(W.table(spark, sf, "documents").select(F.col("doc_id").alias("item_id"), "source", F.col("lang").alias("label")), path)
    return I.count_by(spark.read.schema("item_id bigint, label string, source string").parquet(path), "source", "label")


@query("v01_validate_head", W.with_views("cent", """SELECT 'c' || class_idx AS class, CASE WHEN class_idx = 3 THEN 'wrong length' ELSE 'no bias' END AS problem FROM cent WHERE class_idx IN (3, 5)
  UNION ALL VALUES ('c10', 'missing class')"""))
def v01(spark, sf):
    head = W.head(spark, sf)
    path = scratch_path(spark, "head")
    H.write_head(spark, head, path)
    rows = H.head_rows(H.read_head_document(spark, path))
    broken = rows.select("class", F.when(F.col("class") == "c3", F.slice("w", 1, 5)).otherwise(F.col("w")).alias("w"),
                         F.when(F.col("class") != "c5", F.col("b")).alias("b"))
    return VAL.validate_head(broken, head.dim, [*head.classes, "c10"])
