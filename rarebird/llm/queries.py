"""One registered query for each operator, over its whole table, and the SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rarebird.llm import (conversations, decontamination, language_id, license_scan, ngram_join, nn_descent, packing, phrases, sharding, token_counts,
                          token_files, warc_derivatives, word_bpe)
from rarebird.llm.vocab import public_path
from rarebird.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_plan(table(spark, sf_dir, "documents"), 8)


@query
def op2_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.near_duplicates(table(spark, sf_dir, "embeddings"))


@query
def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return license_scan.scan(docs, license_scan.train(docs))


@query
def op4_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    made = warc_derivatives.derivatives(warc_derivatives.responses(table(spark, sf_dir, "pages")))
    warc_derivatives.write_warc(made, path)
    return warc_derivatives.read_warc(spark, path).select("type", "record_id", "refers_to", "uri", "date", "n_bytes", "block_digest")


@query
def op5_huffman_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    file = token_files.write_token_file(table(spark, sf_dir, "documents"), public_path("byte_bpe_50k.json"),
                                        scratch_path(spark, "tokens"))
    return token_files.read_token_file(spark, file, digest=True)


@query
def op6_simhash_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


@query
def op8_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_bpe.round_trip(table(spark, sf_dir, "documents"), public_path("word_bpe_49k.json"))


@query
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_path("byte_bpe_50k.json"))


@query
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    guessed = language_id.predict(docs.select("doc_id", "text"), language_id.fit(docs))
    return guessed.select("doc_id", language_id.held_out("doc_id").alias("held_out"), "lang_pred", "score")


@query
def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query
def op12_setm_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.top_phrases(table(spark, sf_dir, "documents"))


ORACLE["op12_setm_phrases"] = r"""
WITH pieces AS (
  SELECT lang, row_number() OVER () AS piece, words FROM (
    SELECT lang, regexp_extract_all(part, '[^ \t]+') AS words FROM (
      SELECT coalesce(lang, 'und') AS lang,
             unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0B\x0C\r]')) AS part
      FROM documents))),
w AS (SELECT lang, piece, unnest(words) AS w1, generate_subscripts(words, 1) AS pos FROM pieces),
g AS (SELECT lang, w1, lead(w1, 1) OVER p AS w2, lead(w1, 2) OVER p AS w3, lead(w1, 3) OVER p AS w4 FROM w WINDOW p AS (PARTITION BY piece ORDER BY pos)),
f1 AS (SELECT lang, w1, count(*) AS f FROM g GROUP BY ALL),
f2 AS (SELECT lang, w1, w2, count(*) AS f FROM g WHERE w2 IS NOT NULL GROUP BY ALL),
f3 AS (SELECT lang, w1, w2, w3, count(*) AS f FROM g WHERE w3 IS NOT NULL GROUP BY ALL),
f4 AS (SELECT lang, w1, w2, w3, w4, count(*) AS f FROM g WHERE w4 IS NOT NULL GROUP BY ALL),
cuts AS (
  SELECT c.lang, [c.w1, c.w2] AS words, c.f AS a, 1 AS k, x.f AS l, y.f AS r FROM f2 c JOIN f1 x ON x.lang = c.lang AND x.w1 = c.w1 JOIN f1 y ON y.lang = c.lang AND y.w1 = c.w2 WHERE c.f >= 30
  UNION ALL SELECT c.lang, [c.w1, c.w2, c.w3], c.f, 1, x.f, y.f FROM f3 c JOIN f1 x ON x.lang = c.lang AND x.w1 = c.w1 JOIN f2 y ON y.lang = c.lang AND y.w1 = c.w2 AND y.w2 = c.w3 WHERE c.f >= 30
  UNION ALL SELECT c.lang, [c.w1, c.w2, c.w3], c.f, 2, x.f, y.f FROM f3 c JOIN f2 x ON x.lang = c.lang AND x.w1 = c.w1 AND x.w2 = c.w2 JOIN f1 y ON y.lang = c.lang AND y.w1 = c.w3 WHERE c.f >= 30
  UNION ALL SELECT c.lang, [c.w1, c.w2, c.w3, c.w4], c.f, 1, x.f, y.f FROM f4 c JOIN f1 x ON x.lang = c.lang AND x.w1 = c.w1 JOIN f3 y ON y.lang = c.lang AND y.w1 = c.w2 AND y.w2 = c.w3 AND y.w3 = c.w4 WHERE c.f >= 30
  UNION ALL SELECT c.lang, [c.w1, c.w2, c.w3, c.w4], c.f, 2, x.f, y.f FROM f4 c JOIN f2 x ON x.lang = c.lang AND x.w1 = c.w1 AND x.w2 = c.w2 JOIN f2 y ON y.lang = c.lang AND y.w1 = c.w3 AND y.w2 = c.w4 WHERE c.f >= 30
  UNION ALL SELECT c.lang, [c.w1, c.w2, c.w3, c.w4], c.f, 3, x.f, y.f FROM f4 c JOIN f3 x ON x.lang = c.lang AND x.w1 = c.w1 AND x.w2 = c.w2 AND x.w3 = c.w3 JOIN f1 y ON y.lang = c.lang AND y.w1 = c.w4 WHERE c.f >= 30),
scored AS (
  SELECT lang, words, a, min(struct_pack(score := (2000000::HUGEINT * a) // (l + r), k := k, l := l, r := r)) AS cut FROM cuts GROUP BY lang, words, a),
inner_parts AS (
  SELECT lang, f, unnest([[w1, w2], [w2, w3]]) AS words FROM f3 WHERE f >= 30
  UNION ALL SELECT lang, f, unnest([[w1, w2], [w2, w3], [w3, w4], [w1, w2, w3], [w2, w3, w4]]) FROM f4 WHERE f >= 30),
most AS (SELECT lang, words, max(f) AS f FROM inner_parts GROUP BY lang, words),
kept AS (
  SELECT s.* FROM scored s LEFT JOIN most m ON m.lang = s.lang AND m.words = s.words WHERE m.f IS NULL OR 100::HUGEINT * m.f < 80::HUGEINT * s.a),
ranked AS (
  SELECT lang, array_to_string(words, ' ') AS phrase, a, cut.l AS l, cut.r AS r, cut.score AS score,
         row_number() OVER (PARTITION BY lang ORDER BY cut.score DESC, a DESC, array_to_string(words, ' ')) AS rank FROM kept)
SELECT r.lang, r.rank::BIGINT AS rank, r.phrase, r.a::BIGINT AS a, r.l::BIGINT AS l, r.r::BIGINT AS r, t.n::BIGINT AS n, r.score::BIGINT AS score
FROM ranked r JOIN (SELECT lang, sum(f) AS n FROM f1 GROUP BY lang) t ON t.lang = r.lang WHERE r.rank <= 2000
"""


@query
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(conversations.damage(table(spark, sf_dir, "conversations")))


#: CRC-32 bit by bit; four states of the search as structs (cost, audit, repaired lines), whose order is the contract's.
ORACLE["op13_conversation_repair"] = r"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
ways AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(length(k)), lambda i: list_transform(range(8), lambda j: ((ascii(k[i + 1]) >> j) & 1)::BIGINT)))),
    lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295::BIGINT) % 20 AS way FROM keyed),
damaged AS (
  SELECT conv_id, turn, CASE WHEN way = 4 THEN 'user' ELSE role END AS role,
         CASE way WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(CASE way WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM ways)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged),
rows_ AS (
  SELECT *, left(role, 1) AS c,
    CASE WHEN NOT regexp_matches(text, '[^ 	-]') THEN 1
         WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2
         WHEN NOT regexp_matches(text, '[.!?][ 	-]*\z') THEN 3 ELSE 0 END AS fault,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before
  FROM placed),
steps AS (
  SELECT conv_id, 0::BIGINT AS i, {'c': 0::BIGINT, 'a': '', 'r': ''} AS n, {'c': 1000000000::BIGINT, 'a': '', 'r': ''} AS s,
         {'c': 1000000000::BIGINT, 'a': '', 'r': ''} AS u, {'c': 1000000000::BIGINT, 'a': '', 'r': ''} AS a FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, i,
    {'c': n.c + 4, 'a': n.a || 'D', 'r': n.r} AS n,
    least({'c': s.c + 4, 'a': s.a || 'D', 'r': s.r}, CASE WHEN ok AND ini = 's' THEN {'c': n.c + t, 'a': n.a || 'K', 'r': n.r || line} ELSE far END) AS s,
    least({'c': u.c + 4, 'a': u.a || 'D', 'r': u.r},
      CASE WHEN ok AND ini = 'u' THEN least({'c': n.c + t, 'a': n.a || 'K', 'r': n.r || line}, {'c': s.c + t, 'a': s.a || 'K', 'r': s.r || line}, {'c': a.c + t, 'a': a.a || 'K', 'r': a.r || line}) ELSE far END,
      CASE WHEN ok THEN least({'c': n.c + t + 3, 'a': n.a || 'R', 'r': n.r || uline}, {'c': s.c + t + 3, 'a': s.a || 'R', 'r': s.r || uline}, {'c': a.c + t + 3, 'a': a.a || 'R', 'r': a.r || uline}) ELSE far END) AS u,
    least({'c': a.c + 4, 'a': a.a || 'D', 'r': a.r},
      CASE WHEN ok AND ini = 'a' THEN {'c': u.c + t, 'a': u.a || 'K', 'r': u.r || line} ELSE far END,
      CASE WHEN ok THEN {'c': u.c + t + 3, 'a': u.a || 'R', 'r': u.r || aline} ELSE far END) AS a
  FROM (
    SELECT p.conv_id, r.i, r.c AS ini, r.fault NOT IN (1, 2) AS ok, CASE WHEN r.fault = 3 THEN 3 ELSE 0 END AS t, {'c': 1000000000::BIGINT, 'a': '', 'r': ''} AS far,
      chr(10) || r.role || ':' || r.text AS line, chr(10) || 'user:' || r.text AS uline, chr(10) || 'assistant:' || r.text AS aline, p.n, p.s,
      least(p.u, {'c': p.n.c + 3, 'a': p.n.a || 'I', 'r': p.n.r || chr(10) || 'user:'}, {'c': p.s.c + 3, 'a': p.s.a || 'I', 'r': p.s.r || chr(10) || 'user:'},
        {'c': p.a.c + 3, 'a': p.a.a || 'I', 'r': p.a.r || chr(10) || 'user:'}) AS u,
      least(p.a, {'c': p.u.c + 3, 'a': p.u.a || 'I', 'r': p.u.r || chr(10) || 'assistant:'},
        {'c': p.n.c + 6, 'a': p.n.a || 'II', 'r': p.n.r || chr(10) || 'user:' || chr(10) || 'assistant:'},
        {'c': p.s.c + 6, 'a': p.s.a || 'II', 'r': p.s.r || chr(10) || 'user:' || chr(10) || 'assistant:'}) AS a
    FROM steps p JOIN rows_ r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.i = p.i + 1)),
last_ AS (SELECT conv_id, arg_max({'n': n, 's': s, 'u': u, 'a': a}, i) AS x FROM steps GROUP BY conv_id),
best AS (
  SELECT conv_id, least(x.n, x.a, {'c': x.u.c + 3, 'a': x.u.a || 'I', 'r': x.u.r || chr(10) || 'assistant:'},
    {'c': x.s.c + 6, 'a': x.s.a || 'II', 'r': x.s.r || chr(10) || 'user:' || chr(10) || 'assistant:'}) AS x FROM last_),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 1) AS blank, count(*) FILTER (WHERE fault = 2) AS duplicate,
         count(*) FILTER (WHERE fault = 3) AS truncated, count(*) FILTER (WHERE i > 1 AND before || c NOT IN ('su', 'ua', 'au')) AS illegal FROM rows_ GROUP BY conv_id)
SELECT b.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, x.c::BIGINT AS cost, x.a AS audit, sha256(substr(x.r, 2)) AS repaired_sha256
FROM best b LEFT JOIN counts n ON n.conv_id IS NOT DISTINCT FROM b.conv_id
"""
