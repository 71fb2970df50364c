"""The contract's queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

import corpus_pipeline
from tidewell.llm import align, audit, chat, decontam, html_main, licenses, lm, packing, quality, sharding, simhash, substring, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.document_quality(_table(spark, sf_dir, "documents"))
    signals = [F.col("q")[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return judged.select("doc_id", *signals, "base_failed", "kept", F.col("host_bad"))


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source AS host, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
twice AS (SELECT doc_id, g FROM grams GROUP BY 1, 2 HAVING count(*) > 1),
rep AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (
    SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM grams JOIN twice USING (doc_id, g)) GROUP BY 1),
lines AS (
  SELECT doc_id, l FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM d)
  WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
dup AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM lines GROUP BY 1),
s AS (
  SELECT d.doc_id, host, len(w)::BIGINT AS n_words,
         coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id)),
f AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         100 * n_symbols > 25 * n_words OR n_dup_lines > 10
           OR word_chars < 2 * n_words OR word_chars > 20 * n_words AS soft FROM s),
h AS (
  SELECT host, count(*)::DOUBLE AS n, (count(*) FILTER (base_failed OR soft))::DOUBLE AS f
  FROM f WHERE host IS NOT NULL GROUP BY 1),
p AS (SELECT sum(f) / sum(n) AS m, sum(f * f / n) / sum(n) - (sum(f) / sum(n)) ** 2 AS v FROM h),
k AS (SELECT m, CASE WHEN v <= 1e-12 THEN 1e6 ELSE greatest(1.0, least(1e6, m * (1 - m) / v - 1)) END AS k FROM p),
b AS (SELECT host, (f + m * k) / (n + k) > 0.5 AS host_bad FROM h, k)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (coalesce(host_bad, false) AND soft) AS kept, host_bad
FROM f LEFT JOIN b USING (host)
"""


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substring.deduplicated(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select(F.col("row.doc_id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


OP3_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
wins AS (
  SELECT doc_id, s, list_aggregate(w[s + 1 : s + 20], 'string_agg', ' ') AS win
  FROM (SELECT doc_id, w, unnest(range(0, len(w) - 19)) AS s FROM d WHERE len(w) >= 20)),
ranked AS (SELECT doc_id, s, row_number() OVER (PARTITION BY win ORDER BY doc_id, s) AS k FROM wins),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS p FROM ranked WHERE k > 1),
lists AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM gone GROUP BY 1),
words AS (SELECT doc_id, unnest(w) AS x, unnest(range(0, len(w))) AS p FROM d),
kept AS (
  SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN lists USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_texts(_table(spark, sf_dir, "documents"))


#: Bytes of a shard in op5.
SHARD_BYTES = 1 << 20


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return sharding.extendible_shards(docs, "doc_id", F.col("n_bytes"), SHARD_BYTES)


OP5_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes,
         ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT AS bits FROM documents),
l AS (SELECT unnest(range(0, 33)) AS level),
paths AS (SELECT doc_id, n_bytes, level, bits >> (32 - level)::INT AS prefix FROM d, l),
large AS (SELECT level, prefix FROM paths GROUP BY 1, 2 HAVING sum(n_bytes) > {SHARD_BYTES} AND count(*) > 1),
deep AS (SELECT doc_id, max(level) + 1 AS depth FROM paths JOIN large USING (level, prefix) GROUP BY 1)
SELECT doc_id, n_bytes, substr(lpad(bin(bits), 32, '0'), 1, coalesce(depth, 0)::INT) AS shard,
       coalesce(depth, 0)::INT AS shard_depth
FROM d LEFT JOIN deep USING (doc_id)
"""


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.judged(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("row.doc_id").alias("doc_id"), "n_words", "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated",
    )


OP6_SQL = r"""
WITH low AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
d AS (SELECT doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM low),
i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, list_aggregate(w[s + 1 : s + 13], 'string_agg', ' ') AS win
  FROM (SELECT item_id, w, unnest(range(0, greatest(0, len(w) - 13) + 1)) AS s FROM i WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM iw),
dw AS (
  SELECT doc_id, n, s, list_aggregate(w[s + 1 : s + n], 'string_agg', ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS s FROM d, lens WHERE len(w) >= n)),
hits AS (SELECT doc_id, s, n, win FROM dw WHERE win IN (SELECT win FROM iw)),
cov AS (SELECT doc_id, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hits) GROUP BY 1),
its AS (
  SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(x, ',' ORDER BY x) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM hits JOIN iw USING (win)) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
"""


def op7_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_main.extract(_table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.sql(
        "SELECT * FROM VALUES (-7L, 0L, 'user', '</s>[INST] ok [/INST]'), "
        "(-7L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)"
    )
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(probe)
    back = chat.read_chats(chat.format_chats(turns))
    digest = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(digest, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP10_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))),
m AS (
  SELECT *, coalesce(lag(role) OVER w <> role, true) AS opens, coalesce(lead(role) OVER w <> role, true) AS closes
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
n AS (
  SELECT *, length(text) + len(regexp_extract_all(text, '[\[\]<\\]')) AS text_chars,
         length(role) + len(regexp_extract_all(role, '[\[\]<\\]')) AS role_chars FROM m)
SELECT conv_id::BIGINT AS conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(text_chars + CASE WHEN opens THEN role_chars + 2 ELSE 6 END + CASE WHEN closes THEN 4 ELSE 0 END)::BIGINT AS formatted_chars
FROM n GROUP BY 1
"""


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.read_archives(warc.write_archives(_table(spark, sf_dir, "pages")))
    ids = [F.col(c).cast("long").alias(n) for c, n in (("record_id", "page_id"), ("refers_to", "refers_to"))]
    return back.where("record_type IN ('response', 'revisit')").select(ids[0], "payload_bytes", "payload_digest", "record_type", ids[1])


OP11_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
m AS (SELECT html, max(page_id) AS largest FROM p WHERE strlen(html) >= 1000 GROUP BY 1)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN page_id < largest THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < largest THEN largest END AS refers_to
FROM p LEFT JOIN m USING (html)
"""


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    paths = [public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    return align.align(_table(spark, sf_dir, "documents"), *paths)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.replay(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).drop("filter")


OP13_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
firsts AS (SELECT t, min(doc_id) AS first FROM w GROUP BY 1),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1),
f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         map(['A', 'B', 'C', 'D', 'E'], [
           len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w),
           100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t),
           regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > first, false)]) AS fails
  FROM w LEFT JOIN firsts USING (t) LEFT JOIN l USING (doc_id)),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
o AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM x a, x b, x c, x d, x e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
r AS (
  SELECT part, good, toxic, fails, filter_order,
         coalesce(list_position(list_transform(range(1, 6), lambda s: fails[filter_order[s]]), true), 6) AS first,
         unnest(range(1, 6)) AS step
  FROM f, o),
c AS (
  SELECT part, filter_order, step::INT AS step, filter_order[step] AS f,
         count(*) FILTER (first > step) AS kept, count(*) FILTER (first = step) AS removed,
         count(*) FILTER (fails[filter_order[step]] AND first < step) AS redundant,
         count(*) FILTER (fails[filter_order[step]] AND len(list_filter(map_values(fails), lambda v: v)) = 1) AS unique_fails,
         count(*) FILTER (first = step AND good) AS good_lost, count(*) FILTER (first = step AND toxic) AS toxic_lost
  FROM r GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM c
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": op1_quality_rules,
        "op2_simhash": op2_simhash,
        "op3_substring_dedup": op3_substring_dedup,
        "op4_lm_score": op4_lm_score,
        "op5_sharding": op5_sharding,
        "op6_decontamination": op6_decontamination,
        "op7_html_main_text": op7_html_main_text,
        "op8_license_scan": op8_license_scan,
        "op9_packing": op9_packing,
        "op10_chat_format": op10_chat_format,
        "op11_warc": op11_warc,
        "op12_token_alignment": op12_token_alignment,
        "op13_filter_audit": op13_filter_audit,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": OP1_SQL, "op3_substring_dedup": OP3_SQL, "op5_sharding": OP5_SQL, "op6_decontamination": OP6_SQL, "op10_chat_format": OP10_SQL, "op11_warc": OP11_SQL, "op13_filter_audit": OP13_SQL}
