"""One query per operator, over the whole table it is meant for, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.byte_bpe import byte_bpe_roundtrip
from plumbline.llm.decontamination import find_leaks
from plumbline.llm.hard_negatives import hard_negatives
from plumbline.llm.html_text import extract_pages
from plumbline.llm.lattice_lm import lattice_scores
from plumbline.llm.prefix_trie import prefix_trie
from plumbline.llm.quality_mil import fit_quality, score_quality
from plumbline.llm.secret_scan import scan_secrets, secret_digest
from plumbline.llm.simhash import simhash_components
from plumbline.llm.substring_dedup import remove_repeats
from plumbline.llm.token_counts import count_tokens
from plumbline.llm.topk import top_k
from plumbline.llm.transcripts import chat_format

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(_table(spark, sf_dir, "documents"))


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op4_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return score_quality(docs, fit_quality(docs, _table(spark, sf_dir, "labels")))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe_roundtrip(_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format(_table(spark, sf_dir, "conversations"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_table(spark, sf_dir, "documents"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(_table(spark, sf_dir, "pages"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digest(scan_secrets(_table(spark, sf_dir, "documents")))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = F.col("conv")
    return prefix_trie(_table(spark, sf_dir, "conversations"), F.crc32(conv.cast("string")) % 4, conv - conv % 20)


def op12_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    return lattice_scores(_table(spark, sf_dir, "documents"), held_out, public_tokenizers.path("piece_bpe_32k.model"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec_id, label = F.col("vec_id"), F.col("label")
    moved = F.when(F.pmod(vec_id, F.lit(7)) == 0, F.pmod(label + 1, F.lit(10))).otherwise(label)
    return hard_negatives(_table(spark, sf_dir, "embeddings"), vec_id % 50 == 0, moved)


QUERIES = (
    op1_decontamination, op2_simhash, op3_topk, op4_quality_mil, op5_byte_bpe, op6_chat_format, op7_substring_dedup, op8_html_text, op9_token_counts, op10_secret_scan,
    op11_prefix_trie, op12_lattice_lm, op13_hard_negatives,
)

OP3_SQL = """
WITH v AS MATERIALIZED (
  SELECT vec_id, [floor(64 * x::DOUBLE) for x in embedding] AS t FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id, list_inner_product(q.t, d.t)::BIGINT AS score FROM v q JOIN v d ON q.vec_id % 20 = 0 AND d.vec_id <> q.vec_id)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS "rank", vec_id, score FROM s
QUALIFY "rank" <= 20"""

OP7_SQL = """
WITH d AS MATERIALIZED (SELECT doc_id, [w for w in string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+') if w <> ''] AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS s FROM d),
k AS MATERIALIZED (SELECT doc_id, s, array_to_string(w[s : s + 49], ' ') AS k FROM p),
f AS (SELECT k, min(doc_id) AS least FROM k GROUP BY k),
g AS (SELECT DISTINCT doc_id, s + unnest(range(0, 50)) AS pos FROM (SELECT doc_id, s FROM k JOIN f USING (k) WHERE doc_id > least)),
r AS (SELECT doc_id, list(pos) AS gone FROM g GROUP BY doc_id),
x AS (SELECT doc_id, w, coalesce(gone, []) AS gone FROM d LEFT JOIN r USING (doc_id))
SELECT doc_id, len(w) AS n_words, len(gone) AS n_removed,
  sha256(array_to_string(CASE WHEN len(gone) = 0 THEN w ELSE list_select(w, [i for i in range(1, len(w) + 1) if NOT list_contains(gone, i)]) END, ' ')) AS kept_sha256 FROM x"""


#: CRC-32 of a text of ASCII characters, bit by bit.
CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}, ''), lambda c: ascii(c)::BIGINT)), lambda acc, c:
  list_reduce([xor(acc, c), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"""

OP11_SQL = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations WHERE conv_id IS NOT NULL),
c AS MATERIALIZED (SELECT conv_id, list({{'r': r, 't': t}} ORDER BY turn NULLS FIRST, sha256(concat(length(r), ':', r, t))) AS own, {CRC32.format("conv_id::VARCHAR")} % 4 AS h FROM t GROUP BY conv_id),
b AS (SELECT c.conv_id, list_concat(list_slice(coalesce(a.own, []), 1, c.h), list_slice(c.own, c.h + 1, len(c.own))) AS s FROM c LEFT JOIN c a ON a.conv_id = c.conv_id - c.conv_id % 20),
p AS (SELECT conv_id, s, len(s) AS l, unnest(range(0, len(s) + 1)) AS depth FROM b),
k AS MATERIALIZED (
  SELECT conv_id, l, depth, sha256(to_json(list_slice(s, 1, depth))::VARCHAR) AS key, CASE WHEN depth > 0 THEN sha256(to_json(list_slice(s, 1, depth - 1))::VARCHAR) END AS parent,
    CASE WHEN depth > 0 THEN len([w for w in string_split_regex(s[depth].t, '[\\x20\\x09-\\x0D]+') if w <> '']) ELSE 0 END AS words FROM p),
n AS MATERIALIZED (
  SELECT key, any_value(parent) AS parent, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS saved,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (l = depth), '')) AS ends_sha256 FROM k GROUP BY key, depth),
kids AS MATERIALIZED (SELECT parent AS key, count(*) AS n_children FROM n WHERE parent IS NOT NULL GROUP BY parent),
above AS (SELECT DISTINCT x.key, y.key AS top FROM k x JOIN k y ON x.conv_id = y.conv_id AND y.depth <= x.depth),
sums AS (SELECT top, sum(saved) AS saved_tokens, count(*) FILTER (kids.key IS NULL) AS n_leaves FROM above JOIN n USING (key) LEFT JOIN kids USING (key) GROUP BY top)
SELECT n.conv_id, n.depth, q.conv_id AS parent_conv_id, n.n_convs, coalesce(kids.n_children, 0) AS n_children, sums.n_leaves, sums.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM n JOIN sums ON sums.top = n.key LEFT JOIN kids ON kids.key = n.key LEFT JOIN n q ON q.key = n.parent"""

OP13_SQL = """
WITH v AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) for x in embedding] AS t FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, d.vec_id, a.label = d.label AS same, list_inner_product(a.t, d.t)::BIGINT AS score
  FROM v a JOIN v d ON a.vec_id % 50 = 0 AND d.vec_id <> a.vec_id),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, p.vec_id AS positive_id, (row_number() OVER (PARTITION BY anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id))::INTEGER AS "rank",
  s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
QUALIFY "rank" <= 3"""


def build() -> dict[str, Query]:
    return {query.__name__: query for query in QUERIES}


def oracle() -> dict[str, str]:
    return {"op3_topk": OP3_SQL, "op7_substring_dedup": OP7_SQL, "op11_prefix_trie": OP11_SQL, "op13_hard_negatives": OP13_SQL}
