"""The queries opN_<name>: each applies one operator with production parameters to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantspark.llm import alignment, chat, exact_dedup, merkle, mixing, near_dedup, packing, quality, secrets, sentence_pieces, sharding, substring_dedup, toxicity


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_documents(spark, sf_dir))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_documents(spark, sf_dir))


def tool_turns(turns: DataFrame) -> DataFrame:
    """Conversations with a call and a result for every turn, as the tables hold none.

    Turn t of a conversation stands at 3 t; at 3 t + 1 a call is made with the turn's text as an argument, which refers
    to the call before it unless t is a multiple of four; at 3 t + 2 it is answered, unless t is one less than a multiple
    of four. Conversations declare the tool; in every fourth its schema doesn't fit the calls, every second lacks it.
    """
    t, text = F.col("turn"), F.coalesce("text", F.lit(""))
    name = lambda k: F.concat(F.lit("c"), k.cast("string"))
    after = F.when(t % 4 != 0, F.struct(name(t - 1).alias("$ref")))
    call = F.struct(name(t).alias("id"), F.lit("search").alias("name"), F.struct(t.alias("limit"), text.alias("query"), after.alias("after")).alias("arguments"))
    made = turns.select("conv_id", (3 * t + 1).alias("turn"), F.lit("assistant").alias("role"), F.to_json(F.struct(F.array(call).alias("tool_calls"))).alias("text"))
    answered = turns.where(t % 4 != 3).select("conv_id", (3 * t + 2).alias("turn"), F.lit("tool").alias("role"), F.to_json(F.struct(name(t).alias("tool_call_id"), text.alias("content"))).alias("text"))
    kind = F.when(F.col("conv_id") % 4 == 0, "string").otherwise("integer")
    parameters = F.struct(F.array(F.lit("query")).alias("required"), F.struct(F.struct(F.lit("string").alias("type")).alias("query"), F.struct(kind.alias("type")).alias("limit")).alias("properties"))
    tools = F.to_json(F.struct(F.array(F.struct(F.lit("search").alias("name"), parameters.alias("parameters"))).alias("tools")))
    declared = turns.where("conv_id % 2 = 0").groupBy("conv_id").agg(F.min("turn").alias("first")).select("conv_id", (3 * F.col("first") - 1).alias("turn"), F.lit("system").alias("role"), tools.alias("text"))
    plain = turns.select("conv_id", (3 * t).alias("turn"), "role", "text")
    return plain.unionByName(made).unionByName(answered).unionByName(declared)


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.formatted(tool_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return quality.quality_rules(_documents(spark, sf_dir)).select(*columns, "n_tokens", *quality.MEASURES)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(_documents(spark, sf_dir))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_documents(spark, sf_dir))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_documents(spark, sf_dir))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(_documents(spark, sf_dir)).select("doc_id", "class_id", "kept", "n_shingles")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    tampered = merkle.leaf_digest(*fields[:3], F.col("n_chars") + 1, fields[4])
    chosen = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    leaves = docs.select(F.col("lang").alias("group"), F.col("doc_id").alias("key"), merkle.leaf_digest(*fields).alias("digest"), F.struct("doc_id", F.when(chosen, tampered).alias("tampered")).alias("kept"))
    proven = merkle.manifest(leaves).withColumn("folded_root", merkle.folded(F.coalesce("kept.tampered", "digest"), F.col("proof")))
    return proven.select("kept.doc_id", F.col("digest").alias("leaf"), "subroot", "root", merkle.proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.digests(_documents(spark, sf_dir))


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment(_documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_mixing": op2_mixing,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_secret_scans": op4_secret_scans,
    "op5_sharding": op5_sharding,
    "op6_chat_formatting": op6_chat_formatting,
    "op7_toxicity": op7_toxicity,
    "op8_packing": op8_packing,
    "op9_quality_rules": op9_quality_rules,
    "op10_minhash_near_dedup": op10_minhash_near_dedup,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_sentencepiece": op12_sentencepiece,
    "op13_tokenizer_alignment": op13_tokenizer_alignment,
}

# All pairs that share a shingle are compared, and links are followed to the end.
_OP10 = r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), shingled AS (
  SELECT doc_id, array_to_string(words[i:i + 4], ' ') AS shingle FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS i FROM texts WHERE len(words) > 0)
), bags AS (
  SELECT doc_id, shingle, count(*) AS n FROM shingled GROUP BY doc_id, shingle
), sizes AS (
  SELECT doc_id, sum(n)::BIGINT AS total FROM bags GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, sum(least(a.n, b.n)) AS common FROM bags a JOIN bags b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY x, y
), links AS (
  SELECT x, y FROM pairs JOIN sizes s ON s.doc_id = x JOIN sizes t ON t.doc_id = y WHERE common * 5 >= 4 * (s.total + t.total - common)
  UNION ALL SELECT (SELECT min(doc_id) FROM texts WHERE len(words) = 0), doc_id FROM texts WHERE len(words) = 0
), both_ways AS (
  SELECT x, y FROM links UNION SELECT y, x FROM links
), reached AS (
  SELECT doc_id, doc_id AS other FROM texts UNION SELECT r.doc_id, b.y FROM reached r JOIN both_ways b ON r.other = b.x
), classes AS (
  SELECT doc_id, min(other) AS class_id FROM reached GROUP BY doc_id
)
SELECT c.doc_id, class_id, c.doc_id = class_id AS kept, coalesce(total, 0)::BIGINT AS n_shingles FROM classes c LEFT JOIN sizes s ON s.doc_id = c.doc_id
"""

_OP3 = r"""
WITH normal AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents
), grouped AS (
  SELECT doc_id, body, min(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size FROM normal
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256 FROM grouped
"""

# What becomes of the calls and results that ``tool_turns`` adds follows from the numbers of turns and conversations.
_OP6 = """
WITH t AS (
  SELECT conv_id, turn AS t, role, text, coalesce(text, '') AS body, 'c' || turn AS id FROM conversations
), calls AS (
  SELECT *, CASE WHEN t % 4 <> 3 THEN 3 * t + 2 END AS result_turn, CASE WHEN conv_id % 2 = 1 THEN NULL ELSE conv_id % 4 <> 0 END AS valid,
    CASE WHEN t % 4 = 0 THEN json_object('limit', t, 'query', body) ELSE json_object('after', json_object('$ref', 'c' || (t - 1)), 'limit', t, 'query', body) END AS arguments FROM t
)
SELECT conv_id, 3 * t AS turn, CAST(-1 AS INTEGER) AS nth, 'message' AS kind, role, CAST(NULL AS VARCHAR) AS call_id, CAST(NULL AS INTEGER) AS level, CAST(NULL AS BIGINT) AS result_turn, CAST(NULL AS BOOLEAN) AS valid,
  CAST(json_object('content', text, 'role', role) AS VARCHAR) AS json FROM t
UNION ALL SELECT conv_id, 3 * t + 1, -1, 'message', 'assistant', NULL, NULL, NULL, NULL, CAST(json_object('role', 'assistant') AS VARCHAR) FROM t
UNION ALL SELECT conv_id, 3 * t + 1, 0, 'call', 'assistant', id, CAST(t % 4 AS INTEGER), result_turn, valid,
  CAST(CASE WHEN result_turn IS NULL THEN json_object('arguments', arguments, 'id', id, 'name', 'search') ELSE json_object('arguments', arguments, 'id', id, 'name', 'search', 'result', body) END AS VARCHAR) FROM calls
UNION ALL SELECT conv_id, 3 * t + 2, -1, 'result', 'tool', id, NULL, NULL, NULL, CAST(json_object('content', body, 'role', 'tool', 'tool_call_id', id) AS VARCHAR) FROM t WHERE t % 4 <> 3
UNION ALL SELECT conv_id, 3 * min(t) - 1, -1, 'message', 'system', NULL, NULL, NULL, NULL, CAST(json_object('content',
  CASE WHEN conv_id % 4 = 0 THEN '{"tools":[{"name":"search","parameters":{"required":["query"],"properties":{"query":{"type":"string"},"limit":{"type":"string"}}}}]}'
  ELSE '{"tools":[{"name":"search","parameters":{"required":["query"],"properties":{"query":{"type":"string"},"limit":{"type":"integer"}}}}]}' END, 'role', 'system') AS VARCHAR)
FROM t WHERE conv_id % 2 = 0 GROUP BY conv_id
"""

# Quotas by listing all quotients; the operator lists only those near the cut.
_OP2 = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), shards AS (
  SELECT greatest(1, ceil(count(*) / greatest(2000, 10 * floor(sqrt(count(*)))))::BIGINT) AS n FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight, 3 * source_size AS most FROM sources
), levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / (sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM weighed WINDOW o AS (ORDER BY most::DOUBLE / weight, source NULLS LAST)
), aimed AS (
  SELECT source, source_size, weight, CASE WHEN level * weight <= most THEN max(level) FILTER (level * weight <= most) OVER () * weight ELSE most END::DOUBLE AS target FROM levels
), won AS (
  SELECT source, count(*) AS quota FROM (
    SELECT source, row_number() OVER (ORDER BY target / (2 * seat + 1) DESC, source NULLS LAST, seat) AS nth
    FROM aimed, range((SELECT floor(sum(target) / 16)::BIGINT FROM aimed)) AS s(seat) WHERE target > 0
  ) WHERE nth <= (SELECT floor(sum(target) / 16)::BIGINT FROM aimed) GROUP BY source
), placed AS (
  SELECT *, ('0x' || substr(md5(concat_ws(':', '2', coalesce(doc_id::VARCHAR, ''))), 1, 15))::BIGINT % (SELECT n FROM shards) AS shard,
    ('0x' || substr(md5(concat_ws(':', '1', coalesce(doc_id::VARCHAR, ''))), 1, 15))::BIGINT AS place FROM sized
), cells AS (
  SELECT source, shard, sum(size)::BIGINT AS cell_size FROM placed GROUP BY source, shard
), cells_won AS (
  SELECT source, shard, count(*) AS quota FROM (
    SELECT c.source, c.shard, w.quota AS seats, row_number() OVER (PARTITION BY c.source ORDER BY c.cell_size::DOUBLE / (2 * seat + 1) DESC, c.shard, seat) AS nth
    FROM cells c JOIN won w ON c.source IS NOT DISTINCT FROM w.source, range(w.quota) AS s(seat) WHERE c.cell_size > 0
  ) WHERE nth <= seats GROUP BY source, shard
), goals AS (
  SELECT c.*, least(coalesce(q.quota, 0) * 16, 3 * cell_size)::BIGINT AS goal,
    ('0x' || substr(md5(concat_ws(':', '1', c.shard::VARCHAR, coalesce(c.source, ''))), 1, 15))::BIGINT % greatest(1, cell_size // 16) * 16 AS run_start
  FROM cells c LEFT JOIN cells_won q ON c.source IS NOT DISTINCT FROM q.source AND c.shard = q.shard
), runs AS (
  SELECT *, CASE WHEN cell_size > 0 THEN goal // cell_size ELSE 0 END AS passes, goal - CASE WHEN cell_size > 0 THEN goal // cell_size ELSE 0 END * cell_size AS run FROM goals
), lined AS (
  SELECT p.*, g.cell_size, g.passes, g.run, g.run_start, sum(size) OVER (PARTITION BY p.source, p.shard ORDER BY place, doc_id NULLS LAST, size ROWS UNBOUNDED PRECEDING)::BIGINT AS until
  FROM placed p JOIN runs g ON p.source IS NOT DISTINCT FROM g.source AND p.shard = g.shard
)
SELECT doc_id, size, source_size, target, (passes * size
    + greatest(0, least(until, least(run_start + run, cell_size)) - greatest(until - size, run_start))
    + greatest(0, least(until, run_start + run - cell_size) - greatest(until - size, 0)))::BIGINT AS taken,
  l.source, a.weight::INTEGER AS weight, l.shard::INTEGER AS shard
FROM lined l JOIN aimed a ON l.source IS NOT DISTINCT FROM a.source
"""

_OP1 = r"""
WITH texts AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), windows AS (
  SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS start FROM texts
), keyed AS (
  SELECT doc_id, start, array_to_string(words[start:start + 19], ' ') AS run FROM windows
), later AS (
  SELECT doc_id, start FROM (SELECT doc_id, start, row_number() OVER (PARTITION BY run ORDER BY doc_id, start) AS nth FROM keyed) WHERE nth > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(start, start + 20)) AS place FROM later
), placed AS (
  SELECT doc_id, unnest(range(1, len(words) + 1)) AS place, unnest(words) AS word FROM texts
), kept AS (
  SELECT p.doc_id, count(*) AS n_kept, string_agg(word, ' ' ORDER BY p.place) AS body
  FROM placed p ANTI JOIN gone g ON p.doc_id = g.doc_id AND p.place = g.place GROUP BY p.doc_id
)
SELECT t.doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n_kept, 0))::BIGINT AS n_removed, sha256(coalesce(body, '')) AS kept_sha256
FROM texts t LEFT JOIN kept k ON t.doc_id = k.doc_id
"""

# Trees of all languages level by level (tree 0), then the tree over their roots (tree 1); each leaf climbs both.
_OP11 = r"""
WITH RECURSIVE hashed AS (
  SELECT doc_id, lang, [coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-')] AS head,
    n_chars, coalesce(strlen(text) || ':' || text, '-') AS tail,
    coalesce(list_reduce(range(8 * len(doc_id::VARCHAR)), lambda c, k: xor(CASE WHEN k % 8 = 0 THEN xor(c, ascii(substr(doc_id::VARCHAR, k // 8 + 1, 1))) ELSE c END >> 1,
      CASE WHEN (CASE WHEN k % 8 = 0 THEN xor(c, ascii(substr(doc_id::VARCHAR, k // 8 + 1, 1))) ELSE c END) & 1 = 1 THEN 3988292384 ELSE 0 END), 4294967295::BIGINT), 0) AS crc
  FROM documents
), leaves AS (
  SELECT doc_id, lang, sha256(array_to_string(head, '') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
    sha256(array_to_string(head, '') || coalesce(strlen((n_chars + CASE WHEN xor(crc, 4294967295) % 7 = 0 THEN 1 ELSE 0 END)::VARCHAR) || ':' || (n_chars + CASE WHEN xor(crc, 4294967295) % 7 = 0 THEN 1 ELSE 0 END), '-') || tail) AS shown
  FROM hashed
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n FROM leaves
), lower AS (
  SELECT lang, 0 AS level, idx, n, leaf AS digest FROM numbered
  UNION ALL SELECT lang, level + 1, idx // 2, (any_value(n) + 1) // 2, sha256(string_agg(digest, '' ORDER BY idx)) FROM lower WHERE n > 1 GROUP BY lang, level, idx // 2
), subroots AS (
  SELECT lang, digest AS subroot, level AS top, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM lower WHERE n = 1
), upper AS (
  SELECT 0 AS level, idx, n, subroot AS digest FROM subroots
  UNION ALL SELECT level + 1, idx // 2, (any_value(n) + 1) // 2, sha256(string_agg(digest, '' ORDER BY idx)) FROM upper WHERE n > 1 GROUP BY level, idx // 2
), steps AS (
  SELECT l.lang, l.level, l.idx, l.idx % 2 AS odd, coalesce(s.digest, '') AS other FROM lower l LEFT JOIN lower s ON s.lang IS NOT DISTINCT FROM l.lang AND s.level = l.level AND s.idx = xor(l.idx, 1) WHERE l.n > 1
  UNION ALL SELECT r.lang, r.top + u.level, r.idx >> u.level, (r.idx >> u.level) % 2, coalesce(s.digest, '') FROM subroots r JOIN (SELECT DISTINCT level FROM upper WHERE n > 1) u ON true LEFT JOIN upper s ON s.level = u.level AND s.idx = xor(r.idx >> u.level, 1)
), climbing AS (
  SELECT doc_id, lang, idx AS start, idx, 0 AS level, '' AS siblings, shown AS acc FROM numbered
  UNION ALL SELECT c.doc_id, c.lang, c.start, CASE WHEN c.level + 1 = r.top THEN r.idx ELSE c.idx // 2 END, c.level + 1, c.siblings || s.other, sha256(CASE WHEN s.odd = 1 THEN s.other || c.acc ELSE c.acc || s.other END)
  FROM climbing c JOIN subroots r ON r.lang IS NOT DISTINCT FROM c.lang JOIN steps s ON s.lang IS NOT DISTINCT FROM c.lang AND s.level = c.level
    AND s.idx = CASE WHEN c.level = 0 AND r.top = 0 THEN r.idx ELSE c.idx END
), ended AS (
  SELECT *, row_number() OVER (PARTITION BY lang, start ORDER BY level DESC) AS nth FROM climbing
), root AS (
  SELECT digest AS root FROM upper WHERE n = 1
)
SELECT n.doc_id, leaf, subroot, root, sha256(siblings) AS proof_sha256, acc AS folded_root, acc = root AS verified
FROM ended e JOIN numbered n ON n.lang IS NOT DISTINCT FROM e.lang AND n.idx = e.start JOIN subroots r ON r.lang IS NOT DISTINCT FROM n.lang, root WHERE nth = 1
"""

ORACLE_SQL: dict[str, str] = {
    "op11_merkle_manifest": _OP11,
    "op1_substring_dedup": _OP1,
    "op2_mixing": _OP2,
    "op3_exact_dedup": _OP3,
    "op6_chat_formatting": _OP6,
    "op10_minhash_near_dedup": _OP10,
}
