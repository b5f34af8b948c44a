"""The registered queries of this subpackage: each applies one operator, with production parameters, to whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.llm import chat, decontaminate, divergence, langid, minhash, packing, passages, repeats, sharding, site_quality, spelling, toxicity, whitening
from wayfare.llm.common import table

#: The conversation whose texts look like control strings.
TRICKY = "\\### Assistant: </turn> ok"


def op1_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op2_passage_banding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.remove_passages(table(spark, sf_dir, "documents")).drop("kept_text")


def op3_chat_prefix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(TRICKY).alias("text"))
    return chat.read_back(chat.format_conversations(rows.unionByName(extra)))


def op4_minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leak_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.stratified_shards(table(spark, sf_dir, "documents"))


def op7_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence_rules(table(spark, sf_dir, "documents"))


def op8_language_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_languages(table(spark, sf_dir, "documents"))


def op9_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_spellings(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_repeated_bytes, op2_passage_banding, op3_chat_prefix_tree, op4_minhash_near_duplicates, op5_benchmark_leaks, op6_stratified_shards,
        op7_divergence_rules, op8_language_network, op9_site_quality, op10_best_fit_packing, op11_counterfactual_toxicity, op12_embedding_whitening, op13_spelling_variants,
    )
    return {f.__name__: f for f in found}


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_OP3 = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
sized AS (SELECT *, 12 + 2*length(r) - length(replace(replace(replace(r, '\', ''), '<', ''), '|', '')) + 2*length(t) - length(replace(replace(t, '\', ''), '<', '')) AS size FROM turns)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn, r, t)) AS turns_sha256,
  sum(CASE WHEN r = 'assistant' THEN length(t) ELSE 0 END)::BIGINT AS loss_chars, sha256(coalesce(string_agg(CASE WHEN r = 'assistant' THEN t END, '' ORDER BY turn, r, t), '')) AS loss_sha256,
  sum(size)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id"""

_OP4 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS sh FROM d),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
links AS (
  SELECT x, y FROM (SELECT a.doc_id AS x, b.doc_id AS y, a.n AS na, b.n AS nb, count(*) AS k FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL) WHERE 100*k >= 85*(na + nb - k)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM s UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y),
least_id AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
SELECT s.doc_id, len(sh)::BIGINT AS n_shingles, component_id, s.doc_id = component_id AS kept FROM s JOIN least_id ON x = s.doc_id"""

_OP5 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i+n-1], ' ') AS g FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
own AS (SELECT doc_id, i, n, array_to_string(w[i:i+n-1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d CROSS JOIN (SELECT DISTINCT n FROM windows))),
hits AS (SELECT doc_id, i, own.n, item_id FROM own JOIN windows ON windows.g = own.g AND windows.n = own.n),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words ON words.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id"""


_OP1 = """
WITH d AS (SELECT row_number() OVER () AS k, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
strings AS (SELECT k, i, md5(substr(h, 2*i + 1, 800)) AS g FROM (SELECT k, h, unnest(range(0, length(h)//2 - 399)) AS i FROM d WHERE length(h) >= 800)),
again AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY g) AS n FROM strings) WHERE n > 1),
runs AS (
  SELECT k, min(i) AS a, max(i) + 400 AS b FROM (SELECT k, i, sum(new) OVER (PARTITION BY k ORDER BY i) AS run FROM (SELECT k, i, CASE WHEN i - lag(i) OVER (PARTITION BY k ORDER BY i) <= 400 THEN 0 ELSE 1 END AS new FROM again)) GROUP BY k, run),
gone AS (
  SELECT k, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS last, string_agg(substr(h, 2*prior + 1, 2*(a - prior)), '' ORDER BY a) AS kept
  FROM (SELECT r.*, h, lag(b, 1, 0) OVER (PARTITION BY r.k ORDER BY a) AS prior FROM runs r JOIN d ON d.k = r.k) GROUP BY k)
SELECT doc_id, (length(h)//2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN gone.k IS NULL THEN h ELSE kept || substr(h, 2*last + 1) END)) AS kept_sha256
FROM d LEFT JOIN gone ON gone.k = d.k"""

#: CRC-32 by its table of 256 remainders, each from eight shifts.
_OP6 = """
WITH RECURSIVE shifts AS (SELECT n, 0 AS k, n AS c FROM range(256) t(n) UNION ALL SELECT n, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM shifts WHERE k < 8),
remainders AS (SELECT list(c ORDER BY n) AS t FROM shifts WHERE k = 8),
d AS (SELECT row_number() OVER () AS k, doc_id, source, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS h, coalesce('=' || source, '') AS stratum FROM documents),
digits AS (SELECT k, list_transform(range(1, length(h), 2), lambda i: ((instr('0123456789ABCDEF', substr(h, i, 1)) - 1)*16 + instr('0123456789ABCDEF', substr(h, i + 1, 1)) - 1)::BIGINT) AS bytes FROM d),
sums AS (SELECT k, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) AS crc FROM digits CROSS JOIN remainders),
ranked AS (
  SELECT d.k, doc_id, source, strlen(text) + 1 AS size, crc, stratum, row_number() OVER (PARTITION BY stratum ORDER BY md5(concat_ws(':', 'wayfare', coalesce(doc_id::VARCHAR, ''), text)), doc_id, crc) AS rank,
    count(*) OVER (PARTITION BY stratum) AS n, (instr('0123456789abcdef', substr(md5('wayfare:' || stratum), 1, 1)) - 1)*16 + instr('0123456789abcdef', substr(md5('wayfare:' || stratum), 2, 1)) - 1 AS shift
  FROM d JOIN sums ON sums.k = d.k),
placed AS (SELECT *, row_number() OVER (ORDER BY (rank*256 - shift)::DOUBLE/n, stratum, rank) - 1 AS pos, count(*) OVER () AS total FROM ranked)
SELECT doc_id, size::BIGINT AS size, crc AS text_crc32, 'rows' AS law, (pos*16//total)::INT AS shard, (pos - ceil((pos*16//total)*total/16.0::DOUBLE))::BIGINT AS slot, NULL::INT AS grown_shard, source FROM placed"""

_JS = "sqrt(greatest(list_sum(list_transform(range(1, len({p}) + 1), lambda j: CASE WHEN {p}[j] > 0 THEN {p}[j]*log2({p}[j]/(({p}[j] + {q}[j])/2)) ELSE 0 END + CASE WHEN {q}[j] > 0 THEN {q}[j]*log2({q}[j]/(({p}[j] + {q}[j])/2)) ELSE 0 END))/2, 0))"

_OP7 = rf"""
WITH d AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, regexp_extract_all(translate(t, '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS lw, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM (SELECT row_number() OVER () AS k, doc_id, lang, coalesce(text, '') AS t FROM documents)),
twice AS (SELECT k, i, i - lag(i, 1, -5) OVER (PARTITION BY k ORDER BY i) AS step FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS n FROM (SELECT k, i, array_to_string(w[i:i+4], ' ') AS g FROM (SELECT k, w, unnest(range(1, len(w) - 3)) AS i FROM d))) WHERE n > 1),
repeats AS (SELECT k, sum(least(step, 5)) AS n_repeat_words FROM twice GROUP BY k),
counts AS (SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest(lw) AS word FROM d) GROUP BY ALL),
total AS (SELECT sum(n) AS n FROM counts),
per AS (SELECT lang, sum(n) AS n FROM counts GROUP BY lang),
shares AS (SELECT word, sum(c.n)/any_value(total.n)::DOUBLE AS share FROM counts c CROSS JOIN total GROUP BY word),
ranked AS (SELECT lang, word, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS rank FROM counts),
tops AS (SELECT lang, list(r.word ORDER BY rank) AS top, list(share ORDER BY rank) AS share FROM ranked r JOIN shares s ON s.word = r.word WHERE rank <= 24 GROUP BY lang),
measured AS (
  SELECT d.k, doc_id, d.lang, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, length(t) AS chars, strlen(t) AS octets, length(t) - length(regexp_replace(t, '[0-9]', '', 'g')) AS digit, length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS upper,
    length(t) - length(regexp_replace(t, '[.,;:!?''"()-]', '', 'g')) AS point, list_transform(range(1, 25), lambda j: len(list_filter(lw, lambda y: y = top[j]))::DOUBLE) AS placed
  FROM d LEFT JOIN repeats ON repeats.k = d.k LEFT JOIN tops ON tops.lang IS NOT DISTINCT FROM d.lang),
listed AS (
  SELECT *, [chars - word_chars, n_symbols, digit, upper, point, octets - chars, word_chars - n_symbols - digit - upper - point]::DOUBLE[] AS classes, list_append(placed, (n_words - list_sum(placed))::DOUBLE) AS common FROM measured),
class_sums AS (SELECT lang, list(s ORDER BY j) AS s FROM (SELECT lang, j, sum(classes[j]) AS s FROM listed CROSS JOIN range(1, 8) r(j) GROUP BY ALL) GROUP BY lang),
whole AS (SELECT list(s ORDER BY j) AS s FROM (SELECT j, sum(classes[j]) AS s FROM listed CROSS JOIN range(1, 8) r(j) GROUP BY j)),
common_sums AS (SELECT lang, list(s ORDER BY j) AS s FROM (SELECT lang, j, sum(common[j]) AS s FROM listed CROSS JOIN range(1, 26) r(j) GROUP BY ALL) GROUP BY lang),
mixed AS (
  SELECT c.lang, 2000/(coalesce(per.n, 0) + 2000)::DOUBLE AS thin, list_transform(c.s, lambda x: CASE WHEN list_sum(c.s) > 0 THEN x/list_sum(c.s) ELSE 0 END) AS own, list_transform(whole.s, lambda x: CASE WHEN list_sum(whole.s) > 0 THEN x/list_sum(whole.s) ELSE 0 END) AS every,
    list_transform(m.s, lambda x: CASE WHEN list_sum(m.s) > 0 THEN x/list_sum(m.s) ELSE 0 END) AS own_common, list_append(list_transform(range(1, 25), lambda j: coalesce(share[j], 0)), 1 - list_sum(share)) AS every_common
  FROM class_sums c CROSS JOIN whole JOIN common_sums m ON m.lang IS NOT DISTINCT FROM c.lang LEFT JOIN per ON per.lang IS NOT DISTINCT FROM c.lang LEFT JOIN tops ON tops.lang IS NOT DISTINCT FROM c.lang),
reference AS (SELECT lang, thin, list_transform(range(1, 8), lambda j: (1 - thin)*own[j] + thin*every[j]) AS rc, list_transform(range(1, 26), lambda j: (1 - thin)*own_common[j] + thin*every_common[j]) AS rw FROM mixed),
distances AS (
  SELECT l.*, thin, rc, rw, list_transform(classes, lambda x: CASE WHEN chars > 0 THEN x/list_sum(classes) ELSE 0 END) AS pc, list_transform(common, lambda x: CASE WHEN n_words > 0 THEN x/list_sum(common) ELSE 0 END) AS pw
  FROM listed l JOIN reference r ON r.lang IS NOT DISTINCT FROM l.lang),
judged AS (
  SELECT *, n_words < 10 OR 100*n_repeat_words > 20*n_words AS base_failed, CASE WHEN n_words >= 20 THEN round({_JS.format(p='pc', q='rc')}, 6) END AS class_distance, CASE WHEN n_words >= 40 THEN round({_JS.format(p='pw', q='rw')}, 6) END AS common_distance FROM distances)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND coalesce(class_distance, 0) <= 0.30*(1 - thin) + thin AND coalesce(common_distance, 0) <= 0.50*(1 - thin) + thin AS kept, class_distance, common_distance
FROM judged"""


#: Near words share a form with one letter masked or one place left open; CRC-32 as in op6.
_OP13 = rf"""
WITH RECURSIVE shifts AS (SELECT n, 0 AS k, n AS c FROM range(256) t(n) UNION ALL SELECT n, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM shifts WHERE k < 8),
remainders AS (SELECT list(c ORDER BY n) AS t FROM shifts WHERE k = 8),
runs AS (SELECT run, coalesce(doc_id::VARCHAR, '') || ':' || run AS keyed, count(*) AS times FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents) GROUP BY ALL),
digits AS (SELECT run, times, hex(encode(keyed)) AS h FROM runs),
hashed AS (
  SELECT run, times, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(h), 2), lambda i: ((instr('0123456789ABCDEF', substr(h, i, 1)) - 1)*16 + instr('0123456789ABCDEF', substr(h, i + 1, 1)) - 1)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) AS h
  FROM digits CROSS JOIN remainders),
words AS (SELECT word, sum(times)::BIGINT AS n FROM (SELECT times, CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word FROM hashed) GROUP BY word HAVING length(word) >= 5 AND sum(times) >= 3),
replaced AS (SELECT word, n, substr(word, 1, i::INT) || '*' || substr(word, i::INT + 2) AS g FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM words)),
dropped AS (SELECT DISTINCT word, n, substr(word, 1, i::INT) || substr(word, i::INT + 2) AS g FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM words)),
near AS (
  SELECT a.word, a.n, b.word AS v, b.n AS m FROM replaced a JOIN replaced b ON a.g = b.g AND a.word <> b.word
  UNION SELECT d.word, d.n, w.word, w.n FROM dropped d JOIN words w ON w.word = d.g UNION SELECT w.word, w.n, d.word, d.n FROM dropped d JOIN words w ON w.word = d.g),
best AS (SELECT word, count(*) AS n_near, first(v ORDER BY m DESC, v) AS v, max(m) AS m FROM near GROUP BY word),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN m >= 2*w.n THEN v END AS form, CASE WHEN m >= 2*w.n THEN m END AS form_n FROM words w LEFT JOIN best b ON b.word = w.word),
ways AS (SELECT word, word AS root FROM forms UNION ALL SELECT ways.word, f.form FROM ways JOIN forms f ON f.word = ways.root WHERE f.form IS NOT NULL),
last AS (SELECT ways.word, ways.root FROM ways JOIN forms f ON f.word = ways.root WHERE f.form IS NULL)
SELECT f.word, form, root, n, n_near, form_n FROM forms f JOIN last ON last.word = f.word"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_repeated_bytes": _OP1, "op3_chat_prefix_tree": _OP3, "op4_minhash_near_duplicates": _OP4, "op5_benchmark_leaks": _OP5, "op6_stratified_shards": _OP6,
        "op7_divergence_rules": _OP7, "op13_spelling_variants": _OP13,
    }
