"""Queries that apply the text operators to whole tables, with the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from phenoframe.llm import chat, decontaminate, imatch, jaccardjoin, neardup, negatives, packing, pages, quality, secrets, sharding, substrings, trie

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


_LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES["op5_near_duplicates"] = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format('text')}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5
      THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
      WHEN len(ws) > 0 THEN ['short ' || array_to_string(ws, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
r AS (SELECT doc_id AS id, doc_id AS low FROM documents UNION SELECT e.a, r.low FROM r JOIN e ON e.b = r.id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.low AS component_id, d.doc_id = c.low AS kept
FROM documents d JOIN (SELECT id, min(low) AS low FROM r GROUP BY id) c ON c.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""

ORACLES["op7_tool_calls"] = """
WITH u AS (SELECT * FROM conversations WHERE role = 'user'), a AS (SELECT * FROM conversations WHERE role = 'assistant')
SELECT u.conv_id, u.conv_id || ':' || u.turn AS call_id, u.turn::INT AS level, u.turn,
  CASE WHEN a.turn IS NULL THEN 'unanswered' ELSE 'linked' END AS status, length(u.text) > 0 AS valid,
  (length(u.text) = 0)::INT AS n_errors,
  '{"arguments":{"prompt":' || to_json(u.text) || ',"turn":' || u.turn || '},"id":"' || u.conv_id || ':' || u.turn
  || '","name":"reply","result":' || coalesce(to_json(a.text)::VARCHAR, 'null') || '}' AS json
FROM u LEFT JOIN a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
UNION ALL
SELECT a.conv_id, a.conv_id || ':' || (a.turn - 1), a.turn::INT, a.turn, 'orphan', true, 0,
  '{"id":"' || a.conv_id || ':' || (a.turn - 1) || '","result":' || to_json(a.text) || '}'
FROM a WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.conv_id = a.conv_id AND u.turn = a.turn - 1)
UNION ALL
SELECT conv_id, conv_id || ':' || turn, turn::INT, turn, 'other', true, 0,
  '{"id":"' || conv_id || ':' || turn || '","role":' || coalesce(to_json(role)::VARCHAR, 'null') || ',"text":' || coalesce(to_json(text)::VARCHAR, 'null') || '}'
FROM conversations WHERE coalesce(role, '') NOT IN ('user', 'assistant')"""

_BENCH_WORDS = rf"regexp_extract_all({_LOWER.format('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLES["op9_decontaminate"] = f"""
WITH d AS (SELECT doc_id, {_BENCH_WORDS} AS ws FROM documents),
i AS (SELECT item_id, {_BENCH_WORDS} AS ws FROM benchmark),
t AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, greatest(len(ws) - 12, 1) + 1), lambda k: ws[k:k + 12])) AS win FROM i WHERE len(ws) > 0),
z AS (SELECT DISTINCT len(win) AS size FROM t),
v AS (SELECT doc_id, size, ws, unnest(range(1, len(ws) - size + 2)) AS pos FROM d, z WHERE len(ws) >= size),
h AS (SELECT v.doc_id, v.pos, v.size, t.item_id FROM v JOIN t ON v.ws[v.pos:v.pos + v.size - 1] = t.win),
c AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(pos, pos + size)) FROM h) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS names
      FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN m USING (doc_id)"""

# CRC-32 of decimal digits: bytes are folded in one by one, each with eight shifts.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}, ''), lambda ch: ascii(ch)::BIGINT)),
  lambda acc, ch: list_reduce(list_prepend(xor(acc, ch), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
    lambda v, z: xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384 ELSE 0 END))))"""
ORACLES["op13_prefix_trie"] = f"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS body, turn,
    sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')) AS sig
  FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, sig, octet_length(encode(body)) AS bytes, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sig) AS place FROM t),
c AS (SELECT conv_id, conv_id - conv_id % 5 AS base, {_CRC.format('conv_id::VARCHAR')} % 9 AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, 0 AS part, o.place, o.sig, o.bytes FROM c JOIN o ON o.conv_id = c.base AND o.place <= c.h
  UNION ALL SELECT c.conv_id, 1, o.place, o.sig, o.bytes FROM c JOIN o ON o.conv_id = c.conv_id AND o.place > c.h),
p AS (SELECT conv_id, row_number() OVER w AS depth, string_agg(sig, '') OVER w AS name, bytes FROM r
  WINDOW w AS (PARTITION BY conv_id ORDER BY part, place)),
m AS (SELECT conv_id, depth, name, bytes FROM p UNION ALL SELECT conv_id, 0, '', 0 FROM c),
z AS (SELECT conv_id, max(depth) AS size FROM m GROUP BY conv_id),
n AS (SELECT depth, name, min(m.conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes,
  sha256(coalesce(string_agg(CASE WHEN size = depth THEN m.conv_id::VARCHAR END, ',' ORDER BY m.conv_id), '')) AS ends_sha256
  FROM m JOIN z USING (conv_id) GROUP BY depth, name),
k AS (SELECT n.*, (SELECT count(*) FROM n x WHERE x.depth = n.depth + 1 AND starts_with(x.name, n.name)) AS n_children FROM n)
SELECT k.conv_id, k.depth, u.conv_id AS parent_conv_id, k.n_convs, k.n_children,
  (SELECT count(*) FROM k x WHERE x.n_children = 0 AND x.depth >= k.depth AND starts_with(x.name, k.name)) AS n_leaves,
  (SELECT sum((x.n_convs - 1) * x.bytes) FROM n x WHERE x.depth >= k.depth AND starts_with(x.name, k.name))::BIGINT AS saved_tokens, k.ends_sha256
FROM k LEFT JOIN n u ON u.depth = k.depth - 1 AND u.name = left(k.name, 64 * (k.depth - 1))"""


ORACLES["op11_jaccard_join"] = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format('text')}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 3
      THEN list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' '))
      WHEN len(ws) > 0 THEN ['short ' || array_to_string(ws, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * shared >= 90 * (x.n + y.n - shared)),
r AS (SELECT doc_id AS id, doc_id AS low FROM documents UNION SELECT e.a, r.low FROM r JOIN e ON e.b = r.id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.low AS component_id
FROM documents d JOIN (SELECT id, min(low) AS low FROM r GROUP BY id) c ON c.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""

ORACLES["op12_hard_negatives"] = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id, row_number() OVER w AS rank, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id)
QUALIFY row_number() OVER w <= 5"""


def query(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[build.__name__] = build
    return build


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


@query
def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placement of every document on 64 shards, and after one of them has left."""
    shards = [f"shard-{k:02d}" for k in range(64)]
    placed = sharding.place(table(spark, sf_dir, "documents").select("doc_id"), shards, ["doc_id"])
    left = [s for s in shards if s != "shard-07"]
    return sharding.place(placed, left, ["doc_id"], names=("slot_after", "shard_after")).select("doc_id", "slot", "shard", "shard_after")


@query
def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "pages")
    found = pages.extract(raw, pages.fit_weights(raw))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.remove_repeats(table(spark, sf_dir, "documents"), with_bytes=False)
    return found.select(
        F.col("doc").alias("doc_id"), "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


@query
def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    forest = secrets.fit_forest(secrets.labelled_findings(spark))
    found = secrets.scan(table(spark, sf_dir, "documents"), forest)
    spans = F.transform("secrets", lambda c: F.concat_ws("+", c["start"].cast("string"), c["length"].cast("string")))
    return found.select(
        "doc_id", "n_candidates", F.size("secrets").cast("long").alias("n_secrets"), F.array_join(spans, ",").alias("secret_spans"),
        F.round(F.array_max(F.transform("secrets", lambda c: c["score"])), 6).alias("highest"),
        F.sha2(F.coalesce(secrets.redacted(F.col("text"), F.col("secrets")), F.lit("")), 256).alias("redacted_sha256"))


@query
def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(table(spark, sf_dir, "documents"), percent=85)
    return found.withColumnRenamed("doc", "doc_id")


@query
def op6_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return imatch.edited_fingerprints(docs, imatch.fit_lexicon(docs)).withColumnRenamed("doc", "doc_id")


@query
def op7_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    calls, results = chat.turns_as_calls(turns)
    return chat.link(calls, results, chat.REPLY, chat.other_turns(turns)).select(
        F.col("conv").alias("conv_id"), "call_id", "level", "turn", "status", "valid", F.size("errors").alias("n_errors"), "json")


@query
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit_model(docs, labels.where(~quality.held_out("doc_id")), "doc_id", "text", "quality")
    return quality.score(docs, model).select(
        F.col("doc").alias("doc_id"), quality.held_out("doc").alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_windows(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("doc").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


@query
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, sf_dir, "documents"))
    return packed.withColumnRenamed("doc", "doc_id")


@query
def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccardjoin.jaccard_join(table(spark, sf_dir, "documents")).withColumnRenamed("doc", "doc_id")


@query
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors are the rows whose id is divisible by 100; every seventh label is another one."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").withColumn("label", moved)
    return negatives.mine(rows, F.col("vec_id") % 100 == 0)


@query
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.conversation_trie(table(spark, sf_dir, "conversations"))
