"""The subpackage's queries, each over its whole table, and the SQL that DuckDB can check them with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bitsliced, bpe, exact_dedup, importance, licenses, negatives, packing, phrases, prefix_bpe, secrets, simhash, suffixes, toxicity
from .common import materialize, read


def op1_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op2_license_inheritance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents has no paths, so each document is filed by its source and, like shelves, by the thousands and twenties of its identifier."""
    shelf = lambda n: F.floor(F.col("doc_id") / n).cast("string")
    path = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), shelf(1000), shelf(20), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return licenses.scan(read(spark, sf_dir, "documents"), path)


def op3_difference_cover_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.remove_repeats(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op4_phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = phrases.remove_repeats(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op5_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(read(spark, sf_dir, "documents"))


def op7_bitsliced_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitsliced.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op8_pivot_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = materialize(simhash.fingerprints(read(spark, sf_dir, "documents")), "simhash")
    return simhash.near_duplicates(rows).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(read(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("secret_spans", lambda x: x["kind"] < 3)
    count = lambda k: F.size(F.filter("secret_spans", lambda x: x["kind"] == k)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(secrets.listed(base), 256).alias("base_sha256"), secrets.listed(F.col("secret_spans")).alias("spans"),
    )


def op10_tree_merge_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(read(spark, sf_dir, "documents"))


def op11_crc_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = importance.scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def op12_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_bpe.encode_digests(read(spark, sf_dir, "documents"))


def op13_pivot_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label)


QUERIES = {f.__name__: f for f in (op1_hilbert_packing, op2_license_inheritance, op3_difference_cover_dedup, op4_phrase_automata, op5_counterfactual_toxicity, op6_byte_bpe, op7_bitsliced_topk, op8_pivot_simhash, op9_markov_secrets, op10_tree_merge_dedup, op11_crc_resampling, op12_prefix_bpe, op13_pivot_negatives)}

ORACLES = {
    "op4_phrase_automata": r"""
WITH docs AS (
  SELECT doc_id, list_filter(regexp_split_to_array(COALESCE(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents
), windows AS (
  SELECT doc_id, p, array_to_string(words[p : p + 34], ' ') AS w
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 33)) AS p FROM docs WHERE len(words) >= 35)
), recurring AS (
  SELECT doc_id, p FROM windows WHERE w IN (SELECT w FROM windows GROUP BY w HAVING COUNT(*) > 1)
), removed AS (
  SELECT doc_id, list(DISTINCT q) AS gone FROM (SELECT doc_id, unnest(range(p, p + 35)) AS q FROM recurring) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(COALESCE(len(gone), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN words ELSE list_transform(list_filter(range(1, len(words) + 1), lambda i: NOT list_contains(gone, i)), lambda i: words[i]) END, ' ')) AS kept_sha256
FROM docs d LEFT JOIN removed r ON r.doc_id = d.doc_id""",
    "op7_bitsliced_topk": """
WITH rows AS (
  SELECT row_number() OVER () AS row_no, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, q.row_no AS query_no, r.row_no, r.vec_id, CAST(list_sum(list_transform(list_zip(q.v, r.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM rows q JOIN rows r ON q.vec_id % 50 = 0 AND r.row_no <> q.row_no AND len(r.v) = len(q.v)
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id, query_no ORDER BY score DESC, vec_id, row_no) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY rank <= 5""",
    "op10_tree_merge_dedup": """
SELECT doc_id, MAX(doc_id) OVER (PARTITION BY COALESCE(text, '')) AS keep_id, COUNT(*) OVER (PARTITION BY COALESCE(text, '')) AS group_size,
       doc_id = MAX(doc_id) OVER (PARTITION BY COALESCE(text, '')) AS kept, sha256(COALESCE(text, '')) AS text_sha256
FROM documents""",
    "op11_crc_resampling": r"""
WITH bits AS (
  SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t
), texts AS (
  SELECT 'd' || row_number() OVER () AS no, doc_id, text FROM documents UNION ALL SELECT 'b' || row_number() OVER (), NULL, text FROM benchmark
), words AS (
  SELECT no, doc_id, list_filter(regexp_split_to_array(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM texts
), features AS (
  SELECT no, unnest(list_transform(range(1, len(w) - k + 2), lambda p: array_to_string(w[p : p + k - 1], ' '))) AS f FROM words, (SELECT unnest([1, 2, 3]) AS k) WHERE len(w) >= k
), spelt AS (
  SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM features)
), crcs AS (
  SELECT f, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, len(h), 2), lambda i: 16 * (instr('0123456789ABCDEF', h[i]) - 1) + instr('0123456789ABCDEF', h[i + 1]) - 1)), lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295) % 10000 AS bucket FROM spelt, bits
), counted AS (
  SELECT no, bucket, COUNT(*) AS n FROM features JOIN crcs USING (f) GROUP BY ALL
), sums AS (
  SELECT bucket, SUM(n) FILTER (no[1] = 'd') AS s, SUM(n) FILTER (no[1] = 'b') AS t FROM counted GROUP BY bucket
), gains AS (
  SELECT bucket, CAST(floor(1000 * ln((CAST(COALESCE(t, 0) AS DOUBLE) + 1) * (CAST((SELECT SUM(s) FROM sums) AS DOUBLE) + 10000) / ((CAST(COALESCE(s, 0) AS DOUBLE) + 1) * (CAST((SELECT COALESCE(SUM(t), 0) FROM sums) AS DOUBLE) + 10000)))) AS BIGINT) AS gain FROM sums
), weights AS (
  SELECT no, CAST(SUM(n * gain) AS BIGINT) AS weight, CAST(SUM(n) AS BIGINT) AS n_features FROM counted JOIN gains USING (bucket) GROUP BY no
), scored AS (
  SELECT no, doc_id, len(w) AS n_words, COALESCE(n_features, 0) AS n_features, COALESCE(weight, 0) AS weight,
    COALESCE(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST(CAST('0x' || substr(sha256('42:' || COALESCE(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS DOUBLE) + 0.5) / 4294967296))) AS BIGINT) AS score
  FROM words LEFT JOIN weights USING (no) WHERE no[1] = 'd'
), ranked AS (
  SELECT no, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features) AS rank FROM scored WHERE n_words >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 5 * (SELECT COUNT(*) FROM ranked) // 100 THEN rank END AS rank FROM scored LEFT JOIN ranked USING (no)""",
    "op13_pivot_negatives": """
WITH rows AS (
  SELECT row_number() OVER () AS no, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, a.no AS anchor_no, r.vec_id, r.no, a.label = r.label AS same, CAST(COALESCE(list_sum(list_transform(list_zip(a.v, r.v), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
  FROM rows a JOIN rows r ON a.vec_id % 50 = 0 AND a.no <> r.no AND len(a.v) = len(r.v)
), positives AS (
  SELECT anchor_no, anchor_id, no, vec_id AS positive_id, score AS positive_score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_no ORDER BY score DESC, vec_id, no) <= 5
)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_no, p.no ORDER BY s.score DESC, s.vec_id, s.no) AS INTEGER) AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_no = p.anchor_no AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
QUALIFY rank <= 3""",
}
