"""The registered queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeline.llm import ann, chat, decontam, filter_audit, lm_scores, mixing, ngram_join, secrets, sharding, suffix_dedup, token_counts, toxicity, whitening
from tapeline.session import table


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_classes(table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "source", F.col("mix_block").cast("long").alias("block"), F.col("mix_place").alias("place"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_table(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), k=20, divisor=20)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each text and benchmark item that it holds."""
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text is counted, then gets one edit in its middle: twelve characters give way to a short note."""
    docs = table(spark, sf_dir, "documents")
    middle = F.floor(F.length("text") / 2)
    edit = F.struct(middle.cast("long").alias("start"), (middle + 12).cast("long").alias("end"), F.concat(F.lit(" see note "), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("put"))
    return token_counts.count_with_edits(docs.withColumn("edits", F.array(edit)), edits_col="edits")


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], turns.schema)
    return chat.read_back(chat.format_turns(turns.unionByName(more)))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_rows(table(spark, sf_dir, "documents"), n_shards=8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.summary(suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")))


def op11_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores.score_texts(table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_ngram_join": op1_ngram_join,
    "op2_mixing": op2_mixing,
    "op3_toxicity": op3_toxicity,
    "op4_secrets": op4_secrets,
    "op5_nearest": op5_nearest,
    "op6_decontamination": op6_decontamination,
    "op7_token_counts": op7_token_counts,
    "op8_chat": op8_chat,
    "op9_sharding": op9_sharding,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_lm_scores": op11_lm_scores,
    "op12_filter_audit": op12_filter_audit,
    "op13_whitening": op13_whitening,
}

_WORDS = r"[^\x20\x09-\x0D]+"

def _spans_sql(rank: int, rule: secrets.Rule) -> str:
    regex = rule.regex.replace("'", "''")
    return f"""
  SELECT doc_id, start, {rank} AS rank, '{rule.kind}' AS kind, start + length(m) AS stop FROM (
    SELECT doc_id, whole[i] AS m, own[i] AS g,
           CAST(list_sum([length(x) for x in gaps[1:i]]) + coalesce(list_sum([length(x) for x in whole[1:i-1]]), 0) AS BIGINT) AS start
    FROM (SELECT *, unnest(range(1, len(whole) + 1)) AS i FROM (
      SELECT doc_id, string_split_regex(t, '{regex}') AS gaps, regexp_extract_all(t, '{regex}', 0) AS whole, regexp_extract_all(t, '{regex}', {rule.group}) AS own
      FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)) WHERE len(whole) > 0))
  WHERE length(g) >= {rule.least}"""


_BASE = ", ".join(str(i) for i, r in enumerate(secrets.RULES) if r.base)

SQL = {
    "op12_filter_audit": rf"""
WITH docs AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS ws FROM documents),
marks AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS bad FROM labels GROUP BY doc_id),
facts AS (
  SELECT part, coalesce(good, false) AS good, coalesce(bad, false) AS bad,
         (CASE WHEN len(ws) < 200 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 2 ELSE 0 END) + (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 4 ELSE 0 END)
         + (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END) + (CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END) AS fails
  FROM docs LEFT JOIN marks USING (doc_id)),
counts AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (bad) AS bad FROM facts GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
bits AS (SELECT filter_order, step, [1 << (ascii(substr(filter_order, CAST(i AS BIGINT), 1)) - 65) FOR i IN range(1, step + 1)] AS b FROM orders, (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS step)),
steps AS (SELECT filter_order, step, b[step] AS own, CAST(list_sum(b) AS BIGINT) - b[step] AS earlier FROM bits),
sums AS (
  SELECT part, filter_order, step, own,
         coalesce(sum(n) FILTER (fails & own = 0 AND fails & earlier = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (fails & own <> 0 AND fails & earlier = 0), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (fails & own <> 0 AND fails & earlier <> 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (fails = own), 0)::BIGINT AS unique_fails,
         coalesce(sum(good) FILTER (fails & own <> 0 AND fails & earlier = 0), 0)::BIGINT AS good_lost, coalesce(sum(bad) FILTER (fails & own <> 0 AND fails & earlier = 0), 0)::BIGINT AS toxic_lost
  FROM counts, steps GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM sums
""",
    "op4_secrets": f"""
WITH spans AS ({" UNION ALL ".join(_spans_sql(i, r) for i, r in enumerate(secrets.RULES))}),
found AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
         coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (rank IN ({_BASE})), '') AS base,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans
  FROM spans GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN found USING (doc_id)
""",
    "op2_mixing": rf"""
WITH RECURSIVE docs AS (
  SELECT doc_id, source, coalesce(source, '') AS src,
         md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || '|' || md5(coalesce(text, ''))) AS key,
         len(regexp_extract_all(coalesce(text, ''), '{_WORDS}')) AS tokens
  FROM documents),
sizes AS (SELECT src, sum(tokens)::BIGINT AS tokens FROM docs GROUP BY src HAVING sum(tokens) > 0),
shares AS (SELECT src, tokens, tokens / (SELECT sum(tokens) FROM sizes) AS p, (SELECT count(*) FROM sizes) AS n, (SELECT sum(tokens)::BIGINT FROM sizes) AS total FROM sizes),
bis AS (
  SELECT 0 AS i, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi, 0.0::DOUBLE AS rlo, 1.0::DOUBLE AS rhi
  UNION ALL
  SELECT i + 1,
         CASE WHEN h > 0.97 * ln(n) THEN mid ELSE lo END, CASE WHEN h > 0.97 * ln(n) THEN hi ELSE mid END,
         CASE WHEN r > 4.0 THEN rmid ELSE rlo END, CASE WHEN r > 4.0 THEN rhi ELSE rmid END
  FROM (
    SELECT i, lo, hi, rlo, rhi, (lo + hi) / 2 AS mid, (rlo + rhi) / 2 AS rmid,
           (SELECT max(n) FROM shares) AS n,
           (SELECT -sum(w * ln(w)) FROM (SELECT pow(p, (lo + hi) / 2) / (SELECT sum(pow(p, (lo + hi) / 2)) FROM shares) AS w FROM shares)) AS h,
           (SELECT max(w / p) FROM (SELECT p, pow(p, (rlo + rhi) / 2) / (SELECT sum(pow(p, (rlo + rhi) / 2)) FROM shares) AS w FROM shares)) AS r
    FROM bis WHERE i < 60)),
a AS (SELECT greatest(0.0, hi, rhi) AS a FROM bis WHERE i = 60),
w AS (SELECT src, tokens, total, pow(p, a) / sum(pow(p, a)) OVER () AS w FROM shares, a),
b AS (SELECT src, tokens, CAST(round(w * total) AS BIGINT) AS budget FROM w),
q AS (SELECT src, budget // tokens AS passes, budget % tokens AS rest FROM b),
o AS (
  SELECT d.*, q.passes, q.rest, coalesce(sum(d.tokens) OVER (PARTITION BY d.src ORDER BY d.key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM docs d JOIN q USING (src)),
c AS (SELECT src, max(key) AS cut FROM o WHERE start < rest AND rest > 0 GROUP BY src),
k AS (SELECT o.doc_id, o.source, o.key, o.passes, o.passes + CASE WHEN c.cut IS NOT NULL AND o.key <= c.cut THEN 1 ELSE 0 END AS copies FROM o LEFT JOIN c USING (src))
SELECT doc_id, source, CAST(block AS BIGINT) AS block,
       CASE WHEN block = passes THEN key ELSE md5(CAST(block AS VARCHAR) || '/' || key) END AS place
FROM (SELECT *, unnest(range(0, copies)) AS block FROM k WHERE copies > 0)
""",
}
