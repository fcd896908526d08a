"""Registered queries of the training-data operators, and their comparison SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.llm import budget, codes, hardneg, idfiles, lexical, linedup, mixing, neardup, packing, pieces, quality, secrets, warc

QUERIES = {}
ORACLES: dict[str, str] = {}


def _query(run):
    QUERIES[run.__name__] = run
    return run


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-duplicate documents by a chosen-path similarity join."""
    return neardup.near_duplicates(_table(spark, sf_dir, "documents")).drop("text_hash")


@_query
def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every document by merge rounds and decode its ids."""
    return pieces.piece_digests(_table(spark, sf_dir, "documents"))


@_query
def op3_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences of 2048 tokens."""
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


@_query
def op4_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near-equal lines over all documents, and which line of each stays."""
    return linedup.line_groups(_table(spark, sf_dir, "documents"))


@_query
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document from the counts at its prefixes, and where to cut it for 2048."""
    return budget.token_budget(_table(spark, sf_dir, "documents"))


@_query
def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, with the ownership frequency of their values."""
    return secrets.span_report(secrets.scan(_table(spark, sf_dir, "documents")))


@_query
def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the token ids of all documents with Elias-Fano boundaries and read them back."""
    return idfiles.read_documents(spark, idfiles.write_ids(_table(spark, sf_dir, "documents")))


@_query
def op8_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest sign codes to every hundredth vector, among all vectors."""
    rows = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), codes.sign_code(F.col("embedding")).alias("code"))
    return codes.nearest_codes(rows, rows.where("id % 100 = 0"))


ORACLES["op8_hamming_topk"] = """
WITH c AS (SELECT vec_id, array_to_string(list_transform(embedding, lambda x: CASE WHEN x > 0 AND NOT isnan(x) THEN '1' ELSE '0' END), '')::BIT AS code
           FROM embeddings WHERE embedding IS NOT NULL),
     d AS (SELECT q.vec_id AS query_id, r.vec_id AS id, CAST(bit_count(xor(q.code, r.code)) AS INTEGER) AS distance
           FROM c q JOIN c r ON q.vec_id % 100 = 0 AND q.vec_id <> r.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS INTEGER) AS rank, id, distance
FROM d QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, id) <= 10
"""


@_query
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, tokeniser fertility and verdict for every document."""
    return quality.quality(_table(spark, sf_dir, "documents"))


@_query
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every page as a WARC record, equal payloads as revisits, and read the archives back."""
    return warc.page_records(warc.read_warc(spark, warc.write_warc(_table(spark, sf_dir, "pages"))))

ORACLES["op10_warc"] = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
     d AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS payload_digest, max(page_id) OVER (PARTITION BY b) AS keeper FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND keeper <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND keeper <> page_id THEN keeper END AS refers_to
FROM d
"""

ORACLES["op1_minhash_near_dedup"] = r"""
WITH RECURSIVE
  w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                          '[^\x20\x09-\x0D]+') AS ws FROM documents),
  s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
          ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM w),
  n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
  p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
  e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
  both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
  reach(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION
          SELECT b, root FROM reach JOIN both_ways ON a = doc_id WHERE root < b),
  c AS (SELECT doc_id, min(root) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)
"""

ORACLES["op6_secret_scan"] = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS owner FROM documents),
  runs AS (
    SELECT doc_id, owner, 0 AS kind, regexp_extract_all(text, '{assign}', 0) AS ms, regexp_extract_all(text, '{assign}', 1) AS vs,
           string_split_regex(text, '{assign}') AS ss FROM t WHERE regexp_matches(text, '{assign}')
    UNION ALL SELECT doc_id, owner, 1, regexp_extract_all(text, 'AKIA[A-Z0-9]+', 0), regexp_extract_all(text, 'AKIA[A-Z0-9]+', 0),
           string_split_regex(text, 'AKIA[A-Z0-9]+') FROM t WHERE contains(text, 'AKIA')
    UNION ALL SELECT doc_id, owner, 2, regexp_extract_all(text, '[0-9a-f]+', 0), regexp_extract_all(text, '[0-9a-f]+', 0),
           string_split_regex(text, '[0-9a-f]+') FROM t WHERE regexp_matches(text, '[0-9a-f]{{32}}')
    UNION ALL SELECT doc_id, owner, 3, regexp_extract_all(text, '[A-Za-z0-9_-]+', 0), regexp_extract_all(text, '[A-Za-z0-9_-]+', 0),
           string_split_regex(text, '[A-Za-z0-9_-]+') FROM t WHERE regexp_matches(text, '[A-Za-z0-9_-]{{20}}')),
  flat AS (SELECT doc_id, owner, kind, unnest(ss[1:len(ms)]) AS seg, unnest(ms) AS m, unnest(vs) AS value, generate_subscripts(ms, 1) AS i FROM runs),
  placed AS (SELECT doc_id, owner, kind, value, sum(length(seg) + length(m)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS stop, length(m) AS size FROM flat),
  base AS (SELECT *, stop - size AS start FROM placed WHERE kind < 3 AND length(value) >= CASE kind WHEN 0 THEN 8 WHEN 1 THEN 16 ELSE 32 END),
  more AS (SELECT *, stop - size AS start FROM placed p WHERE kind = 3 AND length(value) BETWEEN 20 AND 128
      AND length(regexp_replace(value, '[^0-9]', '', 'g')) >= 3 AND regexp_matches(value, '[A-Za-z]') AND len(list_distinct(string_split(value, ''))) >= 10
      AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = p.doc_id AND b.start < p.stop AND p.stop - p.size < b.stop)),
  spans AS (SELECT * FROM base UNION ALL SELECT * FROM more),
  owners AS (SELECT value, count(DISTINCT owner) AS owners FROM spans GROUP BY 1),
  kept AS (SELECT doc_id, kind, start, owners, ['assign', 'access', 'hex', 'owned'][kind + 1] || ':' || start::BIGINT || ':' || stop::BIGINT AS name
           FROM spans JOIN owners USING (value) WHERE kind < 3 OR owners = 1),
  found AS (SELECT doc_id, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex,
      count(*) FILTER (WHERE kind = 3) AS n_owned, count(*) FILTER (WHERE owners < 3) AS n_live,
      string_agg(name, ',' ORDER BY start, kind) FILTER (WHERE kind < 3) AS base, string_agg(name, ',' ORDER BY start, kind) AS spans FROM kept GROUP BY 1)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
       coalesce(spans, '') AS spans, coalesce(n_owned, 0) AS n_owned, coalesce(n_live, 0) AS n_live
FROM t LEFT JOIN found USING (doc_id)
""".format(assign=secrets.ASSIGN.replace("'", "''"))


@_query
def op11_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document a mix of 150 % takes, with sources at target weights."""
    return mixing.words_taken(mixing.mix(_table(spark, sf_dir, "documents")))


ORACLES["op11_mixture"] = rf"""
WITH z AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
  s AS (SELECT source, sum(size)::BIGINT AS source_size, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM z GROUP BY 1),
  a AS (SELECT *, 2 * source_size AS most, 2 * source_size / weight AS room FROM s),
  l AS (SELECT *, (1.5::DOUBLE * (SELECT sum(source_size) FROM s) - coalesce(sum(most) OVER (ORDER BY room, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(weight) OVER (ORDER BY room, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM a),
  t AS (SELECT source, source_size, least(most::DOUBLE, weight * coalesce((SELECT arg_min(level, room) FROM l WHERE level <= room), 'inf'::DOUBLE)) AS target FROM l),
  r AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, '')), doc_id, size ROWS UNBOUNDED PRECEDING) - size AS first FROM z),
  q AS (SELECT doc_id, size, source_size, target, floor(target + 0.5)::BIGINT AS quota, first FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (greatest(0, least(size, quota - first)) + greatest(0, least(size, quota - source_size - first)))::BIGINT AS taken FROM q
"""


@_query
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector and its positives, among all vectors."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = hardneg.whole_vectors(_table(spark, sf_dir, "embeddings"), F.col("vec_id"), F.col("embedding"), label)
    return hardneg.hard_negatives(rows, rows.where("id % 100 = 0"))


ORACLES["op12_hard_negatives"] = """
WITH e AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda v: floor(256 * v::DOUBLE)) AS x
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
  s AS (SELECT a.id AS anchor_id, r.id, a.label = r.label AS alike, list_dot_product(a.x, r.x)::BIGINT AS score FROM e a JOIN e r ON a.id % 100 = 0 AND a.id <> r.id),
  p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
  n AS (SELECT anchor_id, positive_id, positive_score, id AS negative_id, score AS negative_score,
               row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS rank
        FROM p JOIN s USING (anchor_id) WHERE NOT alike AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""


@_query
def op13_lexical_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best documents of every benchmark item, by term weights and length."""
    return lexical.ranked(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


_TERMS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                          '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""
ORACLES["op13_lexical_topk"] = f"""
WITH t AS (SELECT doc_id, unnest({_TERMS}) AS term FROM documents),
  n AS (SELECT doc_id, count(*) AS n FROM t GROUP BY 1),
  c AS (SELECT count(*) AS docs, sum(n)::BIGINT AS len FROM n),
  f AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY 1, 2),
  w AS (SELECT term, floor(1000 * ln((2 * (SELECT docs FROM c) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM f GROUP BY 1),
  i AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY 1, 2),
  m AS (SELECT doc_id, 25 + (75 * n * docs) // len AS m FROM n, c),
  s AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
        FROM i JOIN w USING (term) JOIN f USING (term) JOIN m USING (doc_id) GROUP BY 1, 2)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
"""
