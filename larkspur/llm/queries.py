"""Registered queries of the corpus operators, and SQL that says the same where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import chat, decontam, licences, mixing, quality, rules, simhash, tokens, toxicity, warc
from larkspur.llm._common import crc_mod, materialize, n_words, table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = materialize(docs.select(F.col("doc_id").alias("id"), "source", n_words("text").alias("size"), mixing.tie("doc_id", "text").alias("tie")), "mix")
    sized = mixing.with_blocks(sized, mixing.fineness(sized.count()))
    blocks = materialize(mixing.count_blocks(sized), "mix-blocks")
    mixed = mixing.mix(sized, blocks, blocks.count())
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    model = quality.train(docs, labels, lambda c: crc_mod(c, 5) != 0)
    return quality.score(docs, model).select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations 2k (chosen) and 2k + 1 (rejected) are a pair."""
    turns = table(spark, sf_dir, "conversations")
    pairs = chat.preference_pairs(turns, F.shiftright("conv_id", 1), F.col("conv_id") % 2 == 0)
    spans = "array_join(transform({0}, s -> concat(s.start, '-', s.end)), ',') AS {0}"
    return pairs.selectExpr("pair_id", "paired", "n_prompt_turns", "prompt", "chosen", "rejected", spans.format("chosen_mask"), spans.format("rejected_mask"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    model = toxicity.train(docs, labels, lambda c: crc_mod(c, 4) != 2, toxicity.language_model(toxicity.gram_counts(docs)))
    return toxicity.score(docs, model).select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "score", "predicted")


def op5_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = tokens.write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return tokens.read_tokens(spark, folder)


def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return licences.scan(docs, licences.train(docs))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.write_archives(table(spark, sf_dir, "pages"))
    captures = warc.assemble(warc.read_records(spark, folder, payloads=False))
    return warc.resolve(captures).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "common_distance")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_mixing, op2_quality, op3_chat, op4_toxicity, op5_tokens, op6_licences, op7_decontamination, op8_simhash, op9_warc, op10_rules, pipeline)}

WORDS = r"regexp_extract_all(text, '[^\x20\x09-\x0D]+')"

ORACLE: dict[str, str] = {}

ORACLE["op1_mixing"] = rf"""
WITH d AS (SELECT doc_id, source, coalesce(len({WORDS}), 0)::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '') || '|' || coalesce(md5(text), '')) AS tie FROM documents),
b AS (SELECT *, ('0x' || substr(tie, 1, 8))::BIGINT % 64 AS sub,
  CASE WHEN size <= 0 THEN 0 ELSE length(bin(size)) * 8 + ((size >> greatest(length(bin(size)) - 4, 0)) & 7) END AS bin FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source ASC NULLS LAST)) - 1) % 3 + 1] AS weight FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY source_size / weight, source ASC NULLS LAST) AS i FROM w),
c AS (SELECT *, (sum(source_size) OVER () - 3 * (sum(source_size) OVER (ORDER BY i) - source_size))::BIGINT AS left_words,
  (sum(weight) OVER () - sum(weight) OVER (ORDER BY i) + weight)::BIGINT AS left_weight FROM o),
k AS (SELECT min(i) AS k FROM c WHERE left_words * weight <= source_size * 3 * left_weight),
t AS (SELECT source, source_size, CASE WHEN i < k THEN (3 * source_size)::DOUBLE ELSE (weight * (SELECT left_words FROM c WHERE i = k))::DOUBLE / (SELECT left_weight FROM c WHERE i = k) END AS target,
  ('0x' || substr(md5('mix-1|' || coalesce('s' || source, 'n')), 1, 6))::BIGINT AS off FROM c, k),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target * 16777216.0::DOUBLE / source_size)::BIGINT ELSE 0 END AS expect FROM t),
p AS (SELECT b.doc_id, b.size, e.source_size, e.target, e.expect,
  e.expect * row_number() OVER (PARTITION BY b.source ORDER BY b.bin, b.sub, b.size, b.doc_id NULLS FIRST, b.tie) + e.off AS ends
  FROM b JOIN e ON b.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, ((ends >> 24) - ((ends - expect) >> 24)) * size AS taken FROM p
"""

ORACLE["op7_decontamination"] = r"""
WITH d AS (SELECT doc_id AS id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT item_id AS id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
ds AS (SELECT DISTINCT id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k+4], ' ')) END) AS s FROM d),
si AS (SELECT DISTINCT id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k+4], ' ')) END) AS s FROM i),
m AS (SELECT id, count(*) AS m FROM si GROUP BY id)
SELECT ds.id AS doc_id, si.id AS item_id, any_value(m.m) AS n_item, count(*) AS n_shared, count(*)::DOUBLE / any_value(m.m) AS containment
FROM ds JOIN si ON ds.s = si.s JOIN m ON m.id = si.id GROUP BY ds.id, si.id HAVING count(*) * 1000 >= any_value(m.m) * 800
"""

ORACLE["op3_chat"] = r"""
WITH t AS (SELECT conv_id >> 1 AS pair_id, conv_id % 2 = 0 AS ok, coalesce(turn, -1) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY pair_id, ok ORDER BY turn, role, text) AS i FROM t),
p AS (SELECT pair_id, bool_or(ok) AND bool_or(NOT ok) AS paired, max(CASE WHEN ok THEN i END) AS nc, max(CASE WHEN NOT ok THEN i END) AS nr FROM n GROUP BY pair_id),
x AS (SELECT a.pair_id, min(a.i) AS i FROM n a JOIN n b ON a.pair_id = b.pair_id AND a.i = b.i AND a.ok AND NOT b.ok WHERE a.role <> b.role OR a.text <> b.text GROUP BY a.pair_id),
k AS (SELECT p.pair_id, paired, CASE WHEN NOT paired THEN 0 ELSE least(coalesce(x.i - 1, nc), coalesce(x.i - 1, nr), nc, nr) END AS k FROM p LEFT JOIN x USING (pair_id)),
r AS (SELECT n.*, k.k, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS s FROM n JOIN k USING (pair_id)),
c AS (SELECT *, coalesce(sum(length(s)) OVER (PARTITION BY pair_id, ok ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos FROM r WHERE i > k),
m AS (SELECT *, (pos + 13 + length(role))::VARCHAR || '-' || (pos + 23 + length(role) + length(text))::VARCHAR AS span FROM c)
SELECT k.pair_id, k.paired, k.k AS n_prompt_turns,
  coalesce((SELECT string_agg(s, '' ORDER BY i) FROM r WHERE r.pair_id = k.pair_id AND ok AND i <= r.k), '') AS prompt,
  coalesce((SELECT string_agg(s, '' ORDER BY i) FROM m WHERE m.pair_id = k.pair_id AND ok), '') AS chosen,
  coalesce((SELECT string_agg(s, '' ORDER BY i) FROM m WHERE m.pair_id = k.pair_id AND NOT ok), '') AS rejected,
  coalesce((SELECT string_agg(span, ',' ORDER BY i) FROM m WHERE m.pair_id = k.pair_id AND ok AND role = 'assistant'), '') AS chosen_mask,
  coalesce((SELECT string_agg(span, ',' ORDER BY i) FROM m WHERE m.pair_id = k.pair_id AND NOT ok AND role = 'assistant'), '') AS rejected_mask
FROM k
"""

ORACLE["op9_warc"] = """
WITH g AS (SELECT html, max(page_id) AS keep FROM (SELECT page_id, coalesce(html, '') AS html FROM pages) GROUP BY html),
p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT p.page_id, p.html, g.keep, (keep IS NOT NULL AND (page_id IS NULL OR page_id < keep)) AS revisit FROM p JOIN g USING (html)),
x AS (SELECT *, sha1(html) AS sha FROM h),
b AS (SELECT *, (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', v + 1, 1), '' ORDER BY k) FROM (
  SELECT k, (('0x' || substr(sha, 10 * (k // 8) + 1, 10))::BIGINT >> (35 - 5 * (k % 8))) & 31 AS v FROM range(32) t(k))) AS payload_digest FROM x)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, payload_digest, CASE WHEN revisit THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN revisit THEN keep END AS refers_to FROM b
"""
