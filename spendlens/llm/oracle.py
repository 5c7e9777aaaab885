"""DuckDB SQL of the queries that SQL can express: joins (op5), search (op7), chat
digests (op8), decontamination (op10), resampling (op12), sharding (op13).  Extraction, run detection, classifiers, tokenizers and
the language model are tested against plain versions instead."""

from __future__ import annotations

_LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP5 = rf"""WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format('text')}, '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (
    SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM docs
    WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM shingles a
  JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM docs
  UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT d.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(reach.b) AS component_id
FROM docs d JOIN reach ON reach.a = d.doc_id LEFT JOIN sizes USING (doc_id) GROUP BY d.doc_id"""

OP7 = """WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(
    embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT)
  AS rank, vec_id, score FROM scored
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20"""

OP8 = r"""WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'),
    (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))),
shown AS (
  SELECT *, CASE WHEN role = 'assistant' THEN text ELSE '' END AS learned,
    length(regexp_replace(text, '([<\[])(\\*)(\||/?s>|/?INST\])', '\1\2\\\3', 'g')) AS body
  FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text))
    AS turns_sha256,
  CAST(sum(length(learned)) AS BIGINT) AS loss_chars,
  sha256(string_agg(learned, '' ORDER BY turn, role, text)) AS loss_sha256,
  CAST(sum(length('<|im_start|>') + length(role) + 1 + body + length('<|im_end|>') + 1) AS BIGINT)
    AS formatted_chars
FROM shown GROUP BY conv_id"""

_WORDS = rf"regexp_extract_all({_LOWER.format('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP10 = f"""WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
items AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM (
    SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i
    FROM items WHERE len(w) > 0)),
seen AS (
  SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS win FROM (
    SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i
    FROM docs JOIN (SELECT DISTINCT n FROM windows) ON len(w) >= n)),
hits AS (SELECT rid, n, i, item_id FROM seen JOIN windows USING (n, win)),
covered AS (
  SELECT rid, count(DISTINCT p) AS n_hit FROM (
    SELECT rid, unnest(range(i, i + n)) AS p FROM hits) GROUP BY rid),
found AS (
  SELECT rid, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (
    SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS id FROM hits WHERE item_id IS NOT NULL)
  GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered USING (rid) LEFT JOIN found USING (rid)"""

#: crc32 in SQL: the byte table of the reflected polynomial 0xEDB88320, then a fold over
#: the bytes of {0}.
_CRC_TABLE = """crc_table AS (
  SELECT list(c ORDER BY b) AS t FROM (
    SELECT b, list_reduce(range(8), lambda c, i:
      CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) AS c
    FROM range(256) r(b)))"""
_CRC = """xor(list_reduce(
  list_transform(regexp_extract_all(hex(encode({0})), '..'), lambda x: CAST('0x' || x AS BIGINT)),
  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295)"""

OP12 = f"""WITH {_CRC_TABLE},
docs AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
source AS (SELECT rid, unnest(w) AS word FROM docs),
target AS (SELECT unnest({_WORDS}) AS word FROM benchmark),
vocabulary AS (SELECT DISTINCT word FROM (SELECT word FROM source UNION ALL FROM target)),
buckets AS (SELECT word, {_CRC.format('word')} % 10000 AS bucket FROM vocabulary, crc_table),
s AS (SELECT bucket, count(*) AS s FROM source JOIN buckets USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM target JOIN buckets USING (word) GROUP BY bucket),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln(
    ((coalesce(t, 0) + 1.0::DOUBLE) * ((SELECT count(*) FROM source) + 10000.0::DOUBLE))
    / ((s + 1.0::DOUBLE) * ((SELECT count(*) FROM target) + 10000.0::DOUBLE)))) AS BIGINT) AS gain
  FROM s LEFT JOIN t USING (bucket)),
sums AS (
  SELECT rid, sum(gain) AS total FROM source JOIN buckets USING (word) JOIN gains USING (bucket)
  GROUP BY rid),
weights AS (
  SELECT rid, doc_id, CAST(len(w) AS BIGINT) AS n_features,
    CASE WHEN len(w) = 0 THEN 0 ELSE CAST((total - ((total % len(w)) + len(w)) % len(w)) // len(w)
      AS BIGINT) END AS weight,
    CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h
  FROM docs LEFT JOIN sums USING (rid)),
scores AS (
  SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT)
    AS score FROM weights),
ranks AS (
  SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id, n_features) AS rank,
    count(*) OVER () AS n FROM scores WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank
FROM scores LEFT JOIN ranks USING (rid)"""

OP13 = f"""WITH {_CRC_TABLE},
docs AS (
  SELECT doc_id, source, strlen(coalesce(text, '')) + 1 AS size,
    {_CRC.format("coalesce(text, '')")} AS text_crc32 FROM documents, crc_table),
keyed AS (
  SELECT *, md5('2024:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || text_crc32) AS key
  FROM docs),
ranked AS (
  SELECT *, (2 * row_number() OVER (PARTITION BY source ORDER BY key) - 1.0::DOUBLE)
    / (2 * count(*) OVER (PARTITION BY source)) AS fraction FROM keyed),
placed AS (
  SELECT *, row_number() OVER (ORDER BY fraction, key, source NULLS FIRST) - 1 AS place,
    count(*) OVER () AS n FROM ranked),
dealt AS (SELECT *, place * 8 // n AS shard FROM placed)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(shard AS INT) AS shard,
  place - (shard * n + 7) // 8 AS slot, CAST(NULL AS INT) AS grown_shard FROM dealt"""

ORACLE = {"op5_jaccard_join": OP5, "op7_pivot_topk": OP7, "op8_chat_events": OP8,
          "op10_decontaminate": OP10, "op12_importance_resampling": OP12,
          "op13_stratified_sharding": OP13}
