"""Canonical views over the test tables, for Spark and as SQL text (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.functions import vectors as V
from tamis.operators import neighbours as N
from tamis.operators import scoring as S

CLASSES = tuple(f"c{i}" for i in range(10))
OTHER = 9
K = 10
REFERENCE_PER_CLASS = 200
THRESHOLD = 0.13


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.col("vec_id") % 10
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("item_id"), V.as_double(F.col("embedding")).alias("e"), F.col("label").alias("class_idx"),
        F.when(part < 6, "train").when(part < 8, "calib").otherwise("field").alias("split"),
        (F.col("vec_id") % 5).cast("int").alias("fold"))


def items_aug(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items plus near copies; some first copies carry another class."""
    base = items(spark, sf_dir)
    first = base.where("item_id % 10 = 0").select(
        (F.col("item_id") + 1000000).alias("item_id"),
        F.transform("e", lambda x, i: x + 0.005 * (i % 3 - 1)).alias("e"),
        F.when(F.col("item_id") % 50 == 0, (F.col("class_idx") + 1) % 10).otherwise(F.col("class_idx")).cast("int").alias("class_idx"),
        "split", "fold")
    second = base.where("item_id % 20 = 0").select(
        (F.col("item_id") + 2000000).alias("item_id"),
        F.transform("e", lambda x, i: x + 0.004 * (i % 2)).alias("e"), "class_idx", "split", "fold")
    return base.unionByName(first).unionByName(second)


def plots(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        key.alias("plot_id"),
        F.when(key % 3 == 0, F.concat(F.lit("  "), F.lower("n_name"), F.lit(" "))).otherwise(F.col("n_name")).alias("village"),
        F.when(key % 11 == 0, "in_progress").otherwise("done").alias("status"), (key % 97 == 0).alias("synthetic"),
        F.lit(80).alias("synth_answered"), F.lit(30).alias("synth_rust"), (key % 29 == 0).alias("has_samples"),
        F.col("c_mktsegment").alias("variety"))


def photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    key, status = F.col("o_orderkey"), F.col("o_orderstatus")
    idx = (key % 18).cast("int")
    return o.select(
        key.alias("photo_id"), F.col("o_custkey").alias("plot_id"), F.col("o_orderdate").cast("timestamp").alias("created"),
        idx.alias("idx"), F.when(idx < 15, F.floor(idx / 3).cast("int") + 1).alias("tree"), (status == "P").alias("not_sure"),
        F.when(status == "P", F.lit(None).cast("string")).when((status == "F") & (key % 2 == 0), "rust").otherwise("healthy").alias("label"),
        F.when(key % 4 == 0, F.when(F.col("o_orderpriority") == "1-URGENT", "rust").when(F.col("o_orderpriority") == "2-HIGH", "healthy")
               .when(F.col("o_orderpriority") == "3-MEDIUM", "skip").when(F.col("o_orderpriority") == "5-LOW", "other")).alias("officer_label"),
        (key % 17 == 0).alias("disputed"), ((status != "P") & (key % 10 == 0)).alias("spot_check"))


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("grp")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("x"))


def ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("grp"),
        (F.col("event_type") == "error").alias("flagged"), "event_type", "value")


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two raters over the labelled documents; a few answers are missing."""
    base = table(spark, sf_dir, "labels")
    doc = F.col("doc_id")
    a = base.where(doc % 19 != 0).select(
        F.lit("A").alias("rater"), doc.alias("item_id"),
        F.when(doc % 13 == 0, "not_sure").when(F.col("quality") == 1, "healthy").otherwise("rust").alias("answer"),
        (doc % 7 + 0.5).alias("seconds"), (doc % 9 == 0).alias("changed"))
    b = base.where(doc % 23 != 0).select(
        F.lit("B").alias("rater"), doc.alias("item_id"),
        F.when(doc % 7 == 0, "not_sure").when(F.col("toxic") == 1, "rust").otherwise("healthy").alias("answer"),
        (doc % 5 + 1.25).alias("seconds"), (doc % 6 == 0).alias("changed"))
    return a.unionByName(b)


def answer_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.col("doc_id")
    return table(spark, sf_dir, "labels").select(
        doc.alias("item_id"), F.when(doc % 2 == 0, "healthy").otherwise("rust").alias("truth"), (doc % 5).cast("int").alias("level"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive turns of a conversation as reference and hypothesis, whole texts. Turns are numbered, so the previous
    turn is found by an equality join instead of a window over the conversation."""
    t = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.trim(F.regexp_replace(F.regexp_replace(F.lower("text"), "[^a-z ]+", " "), " +", " ")).alias("s"))
    before = t.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("s").alias("ref"))
    return t.join(before, ["conv_id", "turn"]).where("ref <> '' and s <> ''").select("conv_id", "turn", "ref", F.col("s").alias("hyp"))


def head(spark: SparkSession, sf_dir: str, **settings) -> S.Head:
    train = items(spark, sf_dir).where("split = 'train'")
    return S.centroid_head(train, CLASSES, routed=(OTHER,), k=K, threshold=THRESHOLD, version="centroid-1", **settings)


def reference_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The familiarity reference: 200 training rows per class."""
    train = items(spark, sf_dir).where("split = 'train'")
    return S.stratified_reference(train, REFERENCE_PER_CLASS, seed="ref", strict=False).select(F.col("item_id").alias("ref_id"), "e")


def reference(spark: SparkSession, sf_dir: str) -> N.ReferenceSet:
    found = N.bounded_reference(reference_rows(spark, sf_dir))
    if found is None:
        raise ValueError("the reference holds more rows than classes x rows per class")
    return found


def scored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, S.Head]:
    """All items with scores and distances, and the head with its cutoff from the calibration rows."""
    from tamis.operators.calibration import familiarity_cutoff

    h, ref = head(spark, sf_dir), reference(spark, sf_dir)
    known = items(spark, sf_dir).where(f"split = 'calib' and class_idx <> {OTHER}")
    cut = familiarity_cutoff(S.score(known, h, ref))  # only the calibration rows are scored for it
    return S.score(items(spark, sf_dir), h, ref), h.with_settings(cutoff=cut)


def decided(spark: SparkSession, sf_dir: str, exclusive: bool = False) -> DataFrame:
    rows, h = scored(spark, sf_dir)
    return S.decide(rows, h, exclusive)


# SQL text of the same views ------------------------------------------------------------------------------------------
_SQL = {
    "items": """items AS MATERIALIZED (SELECT vec_id AS item_id, embedding::DOUBLE[] AS e, label AS class_idx,
      CASE WHEN vec_id % 10 < 6 THEN 'train' WHEN vec_id % 10 < 8 THEN 'calib' ELSE 'field' END AS split,
      (vec_id % 5)::INT AS fold FROM embeddings)""",
    "items_aug": """items_aug AS MATERIALIZED (SELECT item_id, e, class_idx, split, fold FROM items
      UNION ALL SELECT item_id + 1000000, list_transform(e, lambda x, i: x + 0.005::DOUBLE * ((i - 1) % 3 - 1)),
        CASE WHEN item_id % 50 = 0 THEN (class_idx + 1) % 10 ELSE class_idx END, split, fold FROM items WHERE item_id % 10 = 0
      UNION ALL SELECT item_id + 2000000, list_transform(e, lambda x, i: x + 0.004::DOUBLE * ((i - 1) % 2)),
        class_idx, split, fold FROM items WHERE item_id % 20 = 0)""",
    "unit": """unit AS MATERIALIZED (SELECT item_id, class_idx, split, fold,
      list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS u FROM items)""",
    "unit_aug": """unit_aug AS MATERIALIZED (SELECT item_id, class_idx, split, fold,
      list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS u FROM items_aug)""",
    "plots": """plots AS MATERIALIZED (SELECT c_custkey AS plot_id,
      CASE WHEN c_custkey % 3 = 0 THEN '  ' || lower(n_name) || ' ' ELSE n_name END AS village,
      CASE WHEN c_custkey % 11 = 0 THEN 'in_progress' ELSE 'done' END AS status, c_custkey % 97 = 0 AS synthetic,
      80 AS synth_answered, 30 AS synth_rust, c_custkey % 29 = 0 AS has_samples, c_mktsegment AS variety
      FROM customer JOIN nation ON c_nationkey = n_nationkey)""",
    "photos": """photos AS MATERIALIZED (SELECT o_orderkey AS photo_id, o_custkey AS plot_id, o_orderdate::TIMESTAMP AS created,
      (o_orderkey % 18)::INT AS idx, CASE WHEN o_orderkey % 18 < 15 THEN ((o_orderkey % 18) // 3)::INT + 1 END AS tree,
      o_orderstatus = 'P' AS not_sure,
      CASE WHEN o_orderstatus = 'P' THEN NULL WHEN o_orderstatus = 'F' AND o_orderkey % 2 = 0 THEN 'rust' ELSE 'healthy' END AS label,
      CASE WHEN o_orderkey % 4 = 0 THEN CASE o_orderpriority WHEN '1-URGENT' THEN 'rust' WHEN '2-HIGH' THEN 'healthy'
        WHEN '3-MEDIUM' THEN 'skip' WHEN '5-LOW' THEN 'other' END END AS officer_label,
      o_orderkey % 17 = 0 AS disputed, o_orderstatus <> 'P' AND o_orderkey % 10 = 0 AS spot_check FROM orders)""",
    "finals": """finals AS MATERIALIZED (SELECT *, CASE WHEN officer_label IS NOT NULL AND officer_label <> 'skip' THEN officer_label
      WHEN not_sure OR disputed THEN NULL ELSE label END AS final_label,
      (not_sure OR spot_check OR disputed) AND officer_label IS NULL AS in_queue FROM photos)""",
    "groups": """groups AS MATERIALIZED (SELECT l_partkey AS grp, count(*) AS n,
      count(*) FILTER (WHERE l_returnflag = 'R') AS x FROM lineitem GROUP BY 1)""",
    "ev": """ev AS (SELECT event_id, ts::TIMESTAMP AS ts, user_id AS grp, event_type = 'error' AS flagged, event_type, value FROM events)""",
    "answers": """answers AS MATERIALIZED (SELECT 'A' AS rater, doc_id AS item_id, CASE WHEN doc_id % 13 = 0 THEN 'not_sure'
        WHEN quality = 1 THEN 'healthy' ELSE 'rust' END AS answer, doc_id % 7 + 0.5::DOUBLE AS seconds, doc_id % 9 = 0 AS changed
        FROM labels WHERE doc_id % 19 <> 0
      UNION ALL SELECT 'B', doc_id, CASE WHEN doc_id % 7 = 0 THEN 'not_sure' WHEN toxic = 1 THEN 'rust' ELSE 'healthy' END,
        doc_id % 5 + 1.25::DOUBLE, doc_id % 6 = 0 FROM labels WHERE doc_id % 23 <> 0)""",
    "answer_key": """answer_key AS MATERIALIZED (SELECT doc_id AS item_id, CASE WHEN doc_id % 2 = 0 THEN 'healthy' ELSE 'rust' END AS truth,
      (doc_id % 5)::INT AS level FROM labels)""",
    "keyed": """keyed AS MATERIALIZED (SELECT r.rater, k.item_id, k.truth, k.level, a.answer,
      coalesce(a.answer <> 'not_sure', false) AS answered, coalesce(a.answer = k.truth, false) AS correct
      FROM answer_key k CROSS JOIN (SELECT DISTINCT rater FROM answers) r
      LEFT JOIN answers a ON a.item_id = k.item_id AND a.rater = r.rater)""",
    "pairs": """pairs AS MATERIALIZED (WITH t AS (SELECT conv_id, turn, trim(regexp_replace(regexp_replace(lower(text), '[^a-z ]+', ' ', 'g'), ' +', ' ', 'g')) AS s
        FROM conversations)
      SELECT t.conv_id, t.turn, p.s AS ref, t.s AS hyp FROM t JOIN t p ON p.conv_id = t.conv_id AND p.turn + 1 = t.turn
      WHERE p.s <> '' AND t.s <> '')""",
    "cent": """cent AS MATERIALIZED (SELECT class_idx, list(m ORDER BY i) AS c FROM (
      SELECT class_idx, i, avg(x) AS m FROM (SELECT class_idx, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM items WHERE split = 'train')
      GROUP BY 1, 2) GROUP BY 1)""",
    "lg": """lg AS MATERIALIZED (SELECT item_id, list(8 * list_dot_product(e, c) ORDER BY cent.class_idx) AS z
      FROM items CROSS JOIN cent GROUP BY item_id)""",
    "pr": """pr AS MATERIALIZED (SELECT item_id, z, list_transform(x, lambda v: v / list_sum(x)) AS p FROM (
      SELECT item_id, z, list_transform(z, lambda v: exp(v - list_max(z))) AS x FROM lg))""",
    "refs": """refs AS MATERIALIZED (SELECT item_id AS ref_id, class_idx, u AS r FROM (SELECT *, row_number() OVER (
      PARTITION BY class_idx ORDER BY md5('ref|' || item_id), item_id) AS rn FROM unit WHERE split = 'train') WHERE rn <= 200)""",
    "sims": """sims AS MATERIALIZED (SELECT * FROM (SELECT u.item_id, f.ref_id, list_dot_product(u.u, f.r) AS s, row_number() OVER (
      PARTITION BY u.item_id ORDER BY list_dot_product(u.u, f.r) DESC, f.ref_id) AS rn FROM unit u CROSS JOIN refs f) WHERE rn <= 10)""",
    "knn": """knn AS MATERIALIZED (SELECT item_id, 1 - avg(s) AS distance FROM sims GROUP BY 1)""",
    "scored": """scored AS MATERIALIZED (SELECT i.item_id, i.class_idx, i.split, i.fold, pr.z, pr.p,
      list_position(p, list_max(p)) - 1 AS top, list_max(p) AS max_prob, knn.distance FROM items i JOIN pr USING (item_id) JOIN knn USING (item_id))""",
    "cut": """cut AS MATERIALIZED (SELECT quantile_cont(distance, 0.95) AS cutoff FROM scored WHERE split = 'calib' AND class_idx <> 9)""",
    "decided": """decided AS MATERIALIZED (SELECT *, confident AND familiar AND NOT routed AS answered,
      CASE WHEN routed THEN 'other_problem' WHEN NOT familiar THEN 'unfamiliar' WHEN NOT confident THEN 'low_confidence' END AS reason,
      CASE WHEN NOT familiar THEN 'unfamiliar' WHEN NOT confident THEN 'low_confidence' WHEN routed THEN 'other' END AS reason2,
      list_position(p[1:9], list_max(p[1:9])) - 1 AS forced
      FROM (SELECT s.*, max_prob >= 0.13 AS confident, distance <= cutoff AS familiar, top = 9 AS routed FROM scored s CROSS JOIN cut))""",
}
_NEEDS = {"items_aug": ["items"], "unit": ["items"], "unit_aug": ["items_aug"], "finals": ["photos"], "keyed": ["answers", "answer_key"],
          "cent": ["items"], "lg": ["items", "cent"], "pr": ["lg"], "refs": ["unit"], "sims": ["unit", "refs"], "knn": ["sims"],
          "scored": ["items", "pr", "knn"], "cut": ["scored"], "decided": ["scored", "cut"]}


def with_views(names: str, body: str, recursive: bool = False) -> str:
    """The body with the named views, and those they need, in front of it."""
    order: list[str] = []

    def add(n: str) -> None:
        for m in _NEEDS.get(n, []):
            add(m)
        if n not in order:
            order.append(n)

    for n in names.split():
        add(n)
    extra = body.strip()
    head_sql = "WITH RECURSIVE " if recursive else "WITH "
    text = head_sql + ",\n".join(_SQL[n] for n in order)
    return text + (",\n" + extra[4:] if extra.startswith("AND ") else "\n" + extra)
