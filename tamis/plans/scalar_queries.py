"""Queries over single rows: vectors, decisions, review rules, text."""

from __future__ import annotations

from pyspark.sql import functions as F

from tamis.functions import decisions as D
from tamis.functions import text as T
from tamis.functions import vectors as V
from tamis.operators import review as R
from tamis.operators import scoring as S
from tamis.plans import views as W
from tamis.plans.registry import query

QUESTIONS = ("q4", "q5")
VOCABULARY = "abcdefghijklmnopqrstuvwxyz '"


def _long(df, column, out="x", places=6):
    """One row per array element, with the place counted from zero."""
    return df.select("item_id", F.posexplode(column).alias("i", "_x")).select("item_id", "i", F.round("_x", places).alias(out))


@query("p01_l2_normalise", W.with_views("items_aug", """SELECT item_id, (generate_subscripts(e, 1) - 1)::INT AS i,
  round(unnest(list_transform(e, lambda x: x / sqrt(list_dot_product(e, e)))), 6) AS x FROM items_aug"""))
def l2_normalise(spark, sf):
    return _long(W.items_aug(spark, sf).select("item_id", V.l2_normalise(F.col("e")).alias("v")), "v")


@query("p02_dot_cosine", W.with_views("items_aug", """SELECT a.item_id, round(list_dot_product(a.e, b.e), 6) AS dot,
  round(list_cosine_similarity(a.e, b.e), 6) AS cosine FROM items_aug a JOIN items b ON b.item_id = a.item_id % 1000000"""))
def dot_cosine(spark, sf):
    base = W.items(spark, sf).select(F.col("item_id").alias("o"), F.col("e").alias("f"))
    return W.items_aug(spark, sf).join(base, F.col("item_id") % 1000000 == F.col("o")).select(
        "item_id", F.round(V.dot(F.col("e"), F.col("f")), 6).alias("dot"),
        F.round(V.cosine(F.col("e"), F.col("f")), 6).alias("cosine"))


@query("p03_linear_scores", W.with_views("lg", """SELECT item_id, (generate_subscripts(z, 1) - 1)::INT AS i,
  round(unnest(z), 6) AS score FROM lg"""))
def linear_scores(spark, sf):
    h = W.head(spark, sf)
    rows = W.items(spark, sf).select("item_id", V.linear_scores(F.col("e"), h.weights.tolist(), h.bias.tolist()).alias("z"))
    return _long(rows, "z", "score")


@query("p04_softmax", W.with_views("lg", """SELECT item_id, (generate_subscripts(p, 1) - 1)::INT AS i, round(unnest(p), 6) AS p FROM (
  SELECT item_id, list_transform(x, lambda v: v / list_sum(x)) AS p FROM (SELECT item_id,
    list_transform(z, lambda v: exp((v - list_max(z)) / 0.5)) AS x FROM lg))"""))
def softmax(spark, sf):
    rows = S.score(W.items(spark, sf), W.head(spark, sf))
    return _long(rows.select("item_id", V.softmax_t(F.col("logits"), 0.5).alias("p")), "p", "p")


@query("p05_top_class", W.with_views("pr", """SELECT item_id, (list_position(p, list_max(p)) - 1)::INT AS top,
  round(list_max(p), 6) AS max_prob FROM pr"""))
def top_class(spark, sf):
    rows = S.score(W.items(spark, sf), W.head(spark, sf))
    return rows.select("item_id", V.argmax(F.col("probs")).alias("top"), F.round(F.array_max("probs"), 6).alias("max_prob"))


@query("p06_log_loss", W.with_views("lg items", """SELECT i.item_id,
  round(ln(list_sum(list_transform(z, lambda v: exp(v / 0.5 - list_max(z) / 0.5)))) + list_max(z) / 0.5 - z[class_idx + 1] / 0.5, 6) AS loss
  FROM lg JOIN items i USING (item_id)"""))
def log_loss(spark, sf):
    rows = S.score(W.items(spark, sf), W.head(spark, sf))
    return rows.select("item_id", F.round(V.log_loss(F.col("logits"), F.col("class_idx"), 0.5), 6).alias("loss"))


@query("p07_standardise", W.with_views("items", """AND s AS (SELECT i, avg(x) AS m, stddev_pop(x) + 1e-6 AS sd FROM (
    SELECT unnest(e) AS x, generate_subscripts(e, 1) AS i FROM items WHERE split = 'train') GROUP BY 1),
  l AS (SELECT item_id, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM items)
  SELECT item_id, (l.i - 1)::INT AS i, round((x - m) / sd, 6) AS x FROM l JOIN s USING (i)"""))
def standardise(spark, sf):
    stats = S.dimension_stats(W.items(spark, sf).where("split = 'train'")).orderBy("dim").collect()  # one row per dimension
    mean, sd = F.lit([r["mean"] for r in stats]), F.lit([r["sd"] for r in stats])
    return _long(W.items(spark, sf).select("item_id", V.standardise(F.col("e"), mean, sd).alias("v")), "v")


@query("p08_route", W.with_views("decided", """SELECT item_id, top::INT AS top, round(max_prob, 6) AS max_prob, round(distance, 6) AS distance,
  answered, reason FROM decided"""))
def route(spark, sf):
    return W.decided(spark, sf).select("item_id", "top", F.round("max_prob", 6).alias("max_prob"),
                                       F.round("distance", 6).alias("distance"), "answered", "reason")


@query("p09_route_exclusive", W.with_views("decided", "SELECT item_id, answered, reason2 AS reason FROM decided"))
def route_exclusive(spark, sf):
    return W.decided(spark, sf, exclusive=True).select("item_id", "answered", "reason")


_LOCAL = """AND near AS (SELECT u.item_id, 1 - max(list_dot_product(u.u, l.u)) AS dl FROM unit u CROSS JOIN unit l
    WHERE l.split = 'calib' AND l.class_idx <> 9 AND l.item_id <> u.item_id GROUP BY 1)"""


def with_local(spark, sf):
    """Decided rows with the distance to the nearest other calibration row, which plays the reviewed rows."""
    from tamis.operators import neighbours as N

    local = W.items(spark, sf).where(f"split = 'calib' and class_idx <> {W.OTHER}")
    ref = local.select(F.col("item_id").alias("ref_id"), "e", F.col("item_id").alias("own"))
    queries = W.items(spark, sf).select("item_id", "e", F.col("item_id").alias("own"))
    near = N.knn_distance(queries, ref, 1, group="own", out="dl")
    rows, head = W.scored(spark, sf)
    return rows.drop("local_distance").join(near, "item_id", "left"), head


@query("p10_is_familiar", W.with_views("unit scored cut", _LOCAL + """
  SELECT item_id, distance <= cutoff OR coalesce(dl <= 0.62, false) AS familiar FROM scored JOIN near USING (item_id) CROSS JOIN cut"""))
def is_familiar(spark, sf):
    rows, head = with_local(spark, sf)
    return rows.select("item_id", D.is_familiar(F.col("distance"), head.cutoff, F.col("dl"), 0.62).alias("familiar"))


@query("p11_familiar_by", W.with_views("unit scored cut", _LOCAL + """
  SELECT item_id, CASE WHEN distance <= cutoff THEN 'stored_rows' WHEN dl <= 0.62 THEN 'reviewed_row' END AS familiar_by
  FROM scored JOIN near USING (item_id) CROSS JOIN cut"""))
def familiar_by(spark, sf):
    rows, head = with_local(spark, sf)
    fam = D.is_familiar(F.col("distance"), head.cutoff, F.col("dl"), 0.62)
    return rows.select("item_id", D.familiar_by(F.col("distance"), head.cutoff, fam).alias("familiar_by"))


@query("p12_confidence_band", W.with_views("decided", """SELECT item_id, CASE WHEN NOT answered THEN NULL WHEN max_prob >= 0.145 THEN 'high' ELSE 'medium' END AS band,
  CASE WHEN NOT answered THEN NULL WHEN max_prob >= 0.13 + (1 - 0.13) / 2 THEN 'high' ELSE 'medium' END AS default_band FROM decided"""))
def confidence_band(spark, sf):
    unsure = ~F.col("answered")
    return W.decided(spark, sf).select(
        "item_id", D.confidence_band(F.col("max_prob"), W.THRESHOLD, unsure, 0.145).alias("band"),
        D.confidence_band(F.col("max_prob"), W.THRESHOLD, unsure).alias("default_band"))


@query("p13_forced_prediction", W.with_views("decided", "SELECT item_id, top::INT AS top, forced::INT AS forced FROM decided"))
def forced_prediction(spark, sf):
    return W.decided(spark, sf).select("item_id", "top", "forced")


@query("p14_final_label", W.with_views("finals", "SELECT photo_id, final_label FROM finals"))
def final_label(spark, sf):
    return R.with_final_label(W.photos(spark, sf)).select("photo_id", "final_label")


@query("p15_in_queue", W.with_views("finals", "SELECT photo_id, plot_id FROM finals WHERE in_queue"))
def in_queue(spark, sf):
    return R.queue(W.photos(spark, sf)).select("photo_id", "plot_id")


PICKED_SQL = f"NOT not_sure AND ('0x' || substr(md5('0|' || photo_id), 1, 12))::BIGINT % 1000000 < {int(D.SPOT_CHECK_RATE * 1_000_000)}"


@query("p16_spot_check", W.with_views("photos", f"SELECT photo_id, {PICKED_SQL} AS picked FROM photos"))
def spot_check(spark, sf):
    return W.photos(spark, sf).select("photo_id", D.spot_check(F.col("photo_id"), ~F.col("not_sure")).alias("picked"))


@query("p16_spot_check_hash", W.with_views("photos", f"SELECT not_sure, count(*) AS n, count(*) FILTER (WHERE {PICKED_SQL}) AS picked FROM photos GROUP BY 1"))
def spot_check_hash(spark, sf):
    picked = D.spot_check(F.col("photo_id"), ~F.col("not_sure"))
    return W.photos(spark, sf).groupBy("not_sure").agg(F.count(F.lit(1)).alias("n"), F.count_if(picked).alias("picked"))


@query("p17_set_disputed", W.with_views("photos", """SELECT p.photo_id, CASE WHEN a.flag IS NOT NULL AND officer_label IS NULL
  THEN a.flag ELSE disputed END AS disputed FROM photos p LEFT JOIN (SELECT o_orderkey AS photo_id, o_orderkey % 2 = 0 AS flag
  FROM orders WHERE o_totalprice > 200000) a USING (photo_id)"""))
def set_disputed(spark, sf):
    actions = W.table(spark, sf, "orders").where("o_totalprice > 200000").select(
        F.col("o_orderkey").alias("photo_id"), (F.col("o_orderkey") % 2 == 0).alias("on"))
    return R.set_disputed(W.photos(spark, sf), actions).select("photo_id", "disputed")


@query("p18_decode_codes", W.with_views("plots", """SELECT plot_id, CASE variety WHEN 'AUTOMOBILE' THEN 'kind one'
  WHEN 'BUILDING' THEN 'kind two' WHEN 'MACHINERY' THEN 'kind three' END AS variety FROM plots"""))
def decode_codes(spark, sf):
    names = {"AUTOMOBILE": "kind one", "BUILDING": "kind two", "MACHINERY": "kind three"}
    return W.plots(spark, sf).select("plot_id", D.decode_codes(F.col("variety"), names).alias("variety"))




@query("p19_text_with_fallback", """WITH t AS (SELECT doc_id, CASE WHEN lang = 'fr' THEN '  ' ELSE source END AS kik,
    CASE WHEN n_chars % 3 = 0 THEN NULL ELSE lang END AS sw, source || '-' || lang AS en FROM documents)
  SELECT doc_id, coalesce(nullif(trim(kik), ''), nullif(trim(sw), ''), nullif(trim(en), ''), '') AS text,
    CASE WHEN trim(kik) <> '' THEN 'kik' WHEN trim(sw) <> '' THEN 'sw' ELSE 'en' END AS lang,
    NOT coalesce(trim(kik) <> '', false) AS fallback FROM t""")
def text_with_fallback(spark, sf):
    texts = F.create_map(
        F.lit("kik"), F.when(F.col("lang") == "fr", "  ").otherwise(F.col("source")),
        F.lit("sw"), F.when(F.col("n_chars") % 3 != 0, F.col("lang")), F.lit("en"), F.concat_ws("-", "source", "lang"))
    return W.table(spark, sf, "documents").select(
        "doc_id", D.text_with_fallback(texts, ("kik", "sw", "en")).alias("t")).select("doc_id", "t.*")


@query("p20_pseudonymise", "SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN sha256('member|' || c_custkey) END AS member FROM customer")
def pseudonymise(spark, sf):
    member = F.when(F.col("c_custkey") % 7 != 0, F.col("c_custkey").cast("string"))
    return W.table(spark, sf, "customer").select("c_custkey", T.pseudonymise(member).alias("member"))


@query("p21_normalise_name", W.with_views("plots", """SELECT plot_id, lower(trim(regexp_replace(village, '\\s+', ' ', 'g'))) AS name FROM plots"""))
def normalise_name(spark, sf):
    return W.plots(spark, sf).select("plot_id", T.normalise_name(F.col("village")).alias("name"))


@query("p22_normalise_transcript", """SELECT doc_id, trim(regexp_replace(regexp_replace(lower(text), '[^a-z'' ]+', ' ', 'g'), ' +', ' ', 'g')) AS s
  FROM documents""")
def normalise_transcript(spark, sf):
    return W.table(spark, sf, "documents").select("doc_id", T.normalise_transcript(F.col("text"), "a-z'").alias("s"))


@query("p23_split_sentences", r"""SELECT item_id, s, count(*) AS n FROM (SELECT item_id, unnest(string_split(regexp_replace(
    trim(text, E' \n\t\r'), '([.?!])\s+', '\1' || chr(1), 'g'), chr(1))) AS s FROM benchmark) WHERE s <> '' GROUP BY 1, 2""")
def split_sentences(spark, sf):
    whole = F.regexp_replace("text", r"^\s+|\s+$", "")
    return W.table(spark, sf, "benchmark").select("item_id", F.explode(T.split_sentences(whole)).alias("s")).groupBy(
        "item_id", "s").agg(F.count(F.lit(1)).alias("n"))


@query("p24_clean_record", """SELECT page_id::VARCHAR AS id, substr(url, 1, 2000) AS url, substr(html, 1, 2000) AS html FROM pages
  WHERE url <> '' AND html <> '' AND page_id % 3 <> 0""")
def clean_record(spark, sf):
    """Fields longer than the allowed length are cut, as the record format demands; rows without an id are refused."""
    raw = W.table(spark, sf, "pages").select(F.when(F.col("page_id") % 3 != 0, F.col("page_id")).alias("id"), "url", "html")
    return raw.select(*T.clean_fields(["id", "url", "html"])).where(T.required(["id", "url", "html"]))


@query("p25_vector_quality", W.with_views("items", """SELECT item_id, round(m, 6) AS mean, round(sd, 6) AS sd,
  CASE WHEN m < -0.02 THEN 'too dark' WHEN m > 0.02 THEN 'too bright' WHEN sd < 0.1245 THEN 'almost no detail' END AS reason
  FROM (SELECT item_id, list_avg(e) AS m, sqrt(greatest(0, list_dot_product(e, e) / len(e) - list_avg(e) ** 2)) AS sd FROM items)"""))
def vector_quality(spark, sf):
    q = V.numeric_quality(F.col("e"), -0.02, 0.02, 0.1245)
    return W.items(spark, sf).select("item_id", q.alias("q")).select(
        "item_id", F.round("q.mean", 6).alias("mean"), F.round("q.sd", 6).alias("sd"), "q.reason")


@query("p26_visit_verdict", W.with_views("finals", """SELECT plot_id, CASE WHEN sick >= 3 OR trees >= 2 THEN 'officer_alert'
  WHEN sick >= 1 THEN 'some_problem' WHEN answered > 0 THEN 'all_healthy' END AS verdict FROM (
  SELECT plot_id, count(*) FILTER (WHERE final_label <> 'healthy') AS sick, count(final_label) AS answered,
    count(DISTINCT coalesce(tree, -1)) FILTER (WHERE final_label <> 'healthy') AS trees FROM finals GROUP BY 1)"""))
def visit_verdict(spark, sf):
    return R.visit_counts(W.photos(spark, sf), ()).select("plot_id", "verdict")


@query("p27_position_to_cell", W.with_views("photos", """SELECT photo_id, CASE WHEN idx < 15 THEN (idx // 3)::INT + 1 END AS tree,
  CASE WHEN idx < 15 THEN (idx % 3)::INT + 1 END AS leaf FROM photos"""))
def position_to_cell(spark, sf):
    tree, leaf = D.position_to_cell(F.col("idx"))
    return W.photos(spark, sf).select("photo_id", tree.alias("tree"), leaf.alias("leaf"))


@query("p28_device_class", """SELECT page_id, CASE WHEN regexp_matches(url, 'iPhone|Android|Mobile') OR url LIKE '%m.%' THEN 'phone'
  ELSE 'laptop/tablet' END AS device FROM pages""")
def device_class(spark, sf):
    agent = F.when(F.col("url").contains("m."), F.concat(F.lit("Mobile "), F.col("url"))).otherwise(F.col("url"))
    return W.table(spark, sf, "pages").select("page_id", D.device_class(agent).alias("device"))


@query("p29_percent_format", W.with_views("pr", """SELECT item_id, i, CASE WHEN q > 0.995 THEN '>99%' WHEN q < 0.005 THEN '<1%' WHEN q IS NULL THEN '–'
  ELSE floor(q * 100 + 0.5)::BIGINT || '%' END AS shown FROM (SELECT item_id, (generate_subscripts(p, 1) - 1)::INT AS i,
    unnest(list_transform(p, lambda v: CASE WHEN v > 0.13 THEN NULL WHEN v > 0.12 THEN 1.0 WHEN v < 0.08 THEN 0.001 ELSE v END)) AS q FROM pr)"""))
def percent_format(spark, sf):
    rows = S.score(W.items(spark, sf), W.head(spark, sf)).select("item_id", F.posexplode("probs").alias("i", "v"))
    q = (F.when(F.col("v") > 0.13, F.lit(None).cast("double")).when(F.col("v") > 0.12, 1.0).when(F.col("v") < 0.08, 0.001)
         .otherwise(F.col("v")))
    return rows.withColumn("q", q).select("item_id", "i", D.percent_format(F.col("q")).alias("shown"))


@query("p30_apply_alias", W.with_views("answers", """SELECT a.rater, coalesce(n.alias, a.rater) AS display, count(*) AS n FROM answers a
  LEFT JOIN (VALUES ('A', 'Rater one')) n(name, alias) ON n.name = a.rater GROUP BY 1, 2"""))
def apply_alias(spark, sf):
    from tamis.sources.raters import apply_alias as alias

    names = spark.createDataFrame([("A", "Rater one")], "name string, alias string")
    per = W.answers(spark, sf).groupBy("rater").agg(F.count(F.lit(1)).alias("n"))
    return alias(per, names).select("rater", "display", "n")


@query("p31_decision_audit", W.with_views("decided", """SELECT item_id, class_idx AS truth, top::INT AS predicted, round(max_prob, 3) AS confidence,
  round(distance, 3) AS distance, answered, coalesce(CASE reason WHEN 'other_problem' THEN 'other' ELSE reason END, 'answered') AS route
  FROM decided WHERE split = 'field'"""))
def decision_audit(spark, sf):
    route_name = F.coalesce(F.when(F.col("reason") == "other_problem", "other").otherwise(F.col("reason")), F.lit("answered"))
    return W.decided(spark, sf).where("split = 'field'").select(
        "item_id", F.col("class_idx").alias("truth"), F.col("top").alias("predicted"), F.round("max_prob", 3).alias("confidence"),
        F.round("distance", 3).alias("distance"), "answered", route_name.alias("route"))


@query("p32_out_of_vocabulary", f"""SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(string_split(lower(text), ''),
  lambda c: c <> '' AND NOT contains('{VOCABULARY.replace("'", "''")}.,?!;:', c)))), '') AS missing FROM documents""")
def out_of_vocabulary(spark, sf):
    return W.table(spark, sf, "documents").select(
        "doc_id", F.array_join(T.out_of_vocabulary(F.col("text"), VOCABULARY), "").alias("missing"))


@query("p33_checklist_referral", W.with_views("plots", """SELECT plot_id, variety = 'BUILDING' OR plot_id % 5 = 0 AS refer FROM plots"""))
def checklist_referral(spark, sf):
    checklist = F.create_map(
        F.lit("q1"), F.lit("yes"), F.lit("q4"), F.when(F.col("variety") == "BUILDING", "yes").otherwise("no"),
        F.lit("q5"), F.when(F.col("plot_id") % 5 == 0, "yes").otherwise("unknown"))
    return W.plots(spark, sf).select("plot_id", D.checklist_referral(checklist, QUESTIONS).alias("refer"))


@query("c07_shift_logit", W.with_views("lg", """SELECT item_id, (generate_subscripts(z, 1) - 1)::INT AS i,
  round(unnest(list_transform(z, lambda v, k: CASE WHEN k = 10 THEN v + 0.25 ELSE v END)), 6) AS z FROM lg"""))
def shift_logit(spark, sf):
    rows = S.score(W.items(spark, sf), W.head(spark, sf))
    return _long(rows.select("item_id", V.shift_logit(F.col("logits"), W.OTHER, 0.25).alias("v")), "v", "z")
