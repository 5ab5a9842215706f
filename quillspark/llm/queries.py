"""The queries op1 to op13, over whole tables, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import graph_search, html, lines, media, mixing, near_duplicates, packing, pii, prefix_trie, substrings, tokens, toxicity, vector_codes
from quillspark.llm.common import table

BYTE_RANKS = "byte_bpe_multi_50k.tiktoken"
WORD_VOCABULARY = "word_bpe_49k.json"


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.dedup_substrings(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.dedup_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_VOCABULARY))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.link_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_search.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_RANKS))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_column(table(spark, sf_dir, "documents"))


def op11_source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    return codes.select("vec_id", "code", "error", "label_error", F.lit(vector_codes.books_digest(books)).alias("codebooks_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_line_dedup": op3_line_dedup,
    "op4_html_extraction": op4_html_extraction,
    "op5_toxicity": op5_toxicity,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_nearest_neighbours": op8_nearest_neighbours,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_media": op10_media,
    "op11_source_mixture": op11_source_mixture,
    "op12_vector_codes": op12_vector_codes,
    "op13_prefix_trie": op13_prefix_trie,
}

_LINE_KEY = r"translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_WORDS = r"list_filter(regexp_split_to_array({}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"
_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_ROUND = """
near{n} AS MATERIALIZED (SELECT vec_id, p, arg_min(e, gap * 256 + e) AS e, min(gap) AS gap FROM (
 SELECT vec_id, p, e, (list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c))::BIGINT AS gap FROM parts JOIN book{n} USING (p)) GROUP BY vec_id, p),"""
_NEXT_BOOK = """
means{n} AS MATERIALIZED (SELECT p, e, list(m ORDER BY pos) AS c FROM (SELECT p, e, pos, floor(sum(v) / count(*)) AS m FROM (
 SELECT p, e, unnest(x) AS v, generate_subscripts(x, 1) AS pos FROM near{n} JOIN parts USING (vec_id, p)) GROUP BY p, e, pos) GROUP BY p, e),
book{m} AS MATERIALIZED (SELECT p, e, coalesce(means{n}.c, book{n}.c) AS c FROM book{n} LEFT JOIN means{n} USING (p, e)),"""
_CRC = """list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
 lambda a, x: list_reduce([xor(a, x), 1, 2, 3, 4, 5, 6, 7, 8], lambda b, i: CASE WHEN b & 1 = 1 THEN xor(b >> 1, 3988292384) ELSE b >> 1 END))"""

ORACLES: dict[str, str] = {
    "op11_source_mixture": rf"""
WITH RECURSIVE sized AS (SELECT doc_id, source, len({_WORDS.format("coalesce(text, '')")})::BIGINT AS size FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM sized GROUP BY source),
levels AS (SELECT 0 AS turn, -1::BIGINT AS stopped, 1.5::DOUBLE * sum(source_size) AS amount, sum(weight)::DOUBLE AS free FROM sources
 UNION ALL SELECT turn + 1, n, 1.5::DOUBLE * total - 2.0::DOUBLE * taken, rest FROM (
  SELECT turn, stopped, count(*) FILTER (WHERE 2.0::DOUBLE * source_size <= amount / free * weight) AS n, sum(source_size) AS total,
   coalesce(sum(source_size) FILTER (WHERE 2.0::DOUBLE * source_size <= amount / free * weight), 0) AS taken, sum(weight) FILTER (WHERE 2.0::DOUBLE * source_size > amount / free * weight) AS rest
  FROM levels, sources GROUP BY turn, stopped) WHERE n > stopped AND rest > 0),
aims AS (SELECT source, source_size, CASE WHEN 2.0::DOUBLE * source_size <= amount / free * weight THEN 2.0::DOUBLE * source_size ELSE amount * weight / free END AS target
 FROM sources, (SELECT * FROM levels ORDER BY turn DESC LIMIT 1)),
rates AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM aims),
met AS (SELECT doc_id, s.source, size, source_size, target, rate, ('0x' || substr(md5(doc_id::VARCHAR), 1, 13))::BIGINT AS a, ('0x' || substr(md5(doc_id::VARCHAR), 14, 13))::BIGINT AS b
 FROM sized s JOIN rates r ON s.source IS NOT DISTINCT FROM r.source),
drawn AS (SELECT *, seed, ((a + seed * b) & 4503599627370495) < (rate - floor(rate)) * 4503599627370496 AS more FROM met, range(16) AS seeds(seed)),
tried AS (SELECT source, seed, abs(coalesce(sum(size) FILTER (WHERE more), 0) - (any_value(target) - floor(any_value(rate)) * any_value(source_size))) AS gap FROM drawn GROUP BY source, seed),
best AS (SELECT source, seed FROM tried QUALIFY row_number() OVER (PARTITION BY source ORDER BY gap, seed) = 1)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + more::INT))::BIGINT AS taken FROM drawn JOIN best ON drawn.source IS NOT DISTINCT FROM best.source AND drawn.seed = best.seed""",
    "op12_vector_codes": "WITH kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)) AS v FROM embeddings"
    + " WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),\n"
    + "parts AS MATERIALIZED (SELECT vec_id, p, v[p * len(v) // 4 + 1:(p + 1) * len(v) // 4] AS x FROM kept, range(4) AS parts(p)),\n"
    + "book0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM parts WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 256)),"
    + "".join(_ROUND.format(n=n) + _NEXT_BOOK.format(n=n, m=n + 1) for n in range(4))
    + _ROUND.format(n=4)
    + """
done AS (SELECT vec_id, label, string_agg(format('{:02x}', e), '' ORDER BY p) AS code, sum(gap)::BIGINT AS error FROM near4 JOIN kept USING (vec_id) GROUP BY vec_id, label)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
 (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda x: x::BIGINT), ','), ',' ORDER BY p, e)) FROM book4) AS codebooks_sha256 FROM done""",
    "op13_prefix_trie": f"""
WITH placed AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, count(*) AS n, xor({_CRC}, 4294967295) % 9 AS h, conv_id - conv_id % 5 AS base FROM placed GROUP BY conv_id),
plan AS (SELECT c.*, least(c.h, coalesce(b.n, 0)) AS taken FROM convs c LEFT JOIN convs b ON b.conv_id = c.base),
rebuilt AS (SELECT plan.conv_id, pos AS depth, role, text FROM plan JOIN placed t ON t.conv_id = base AND pos <= taken
 UNION ALL SELECT conv_id, pos - h + taken, role, text FROM placed JOIN plan USING (conv_id) WHERE pos > h),
chain AS MATERIALIZED (SELECT conv_id, depth, strlen(text) AS bytes, string_agg(md5(len(role) || ':' || role || text), '') OVER (PARTITION BY conv_id ORDER BY depth) AS node FROM rebuilt
 UNION ALL SELECT conv_id, 0, 0, '' FROM convs),
nodes AS MATERIALIZED (SELECT node, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes FROM chain GROUP BY node),
kids AS (SELECT left(node, length(node) - 32) AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
sums AS (SELECT c.node, sum((n_convs - 1) * u.bytes)::BIGINT AS saved_tokens, count(*) FILTER (WHERE n_children IS NULL) AS n_leaves
 FROM (SELECT * FROM nodes LEFT JOIN kids USING (node)) u JOIN chain c ON c.conv_id = u.conv_id AND c.depth <= u.depth GROUP BY c.node),
ends AS (SELECT node, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends_sha256 FROM (SELECT conv_id, arg_max(node, depth) AS node FROM chain GROUP BY conv_id) GROUP BY node)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0)::BIGINT AS n_children, n_leaves, saved_tokens, coalesce(ends_sha256, sha256('')) AS ends_sha256
FROM nodes n JOIN sums USING (node) LEFT JOIN kids USING (node) LEFT JOIN ends USING (node) LEFT JOIN nodes p ON n.depth > 0 AND p.node = left(n.node, length(n.node) - 32)""",

    "op3_line_dedup": rf"""
WITH texts AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
lines AS (SELECT doc_id, generate_subscripts(parts, 1) AS pos, unnest(parts) AS line FROM texts),
keyed AS (SELECT doc_id, pos, line, {_LINE_KEY} AS key FROM lines),
firsts AS (SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE first < doc_id) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE first IS NULL OR first >= doc_id), '')) AS kept_sha256
FROM keyed LEFT JOIN firsts USING (key) GROUP BY doc_id""",
    "op2_substring_dedup": rf"""
WITH texts AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS words FROM documents),
windows AS (SELECT doc_id, i, md5(array_to_string(words[i:i + 49], ' ')) AS grams FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM texts)),
firsts AS (SELECT grams, min(doc_id) AS first FROM windows GROUP BY grams),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS pos FROM windows JOIN firsts USING (grams) WHERE first < doc_id),
placed AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM texts),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS text, count(*) AS n FROM placed ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM texts LEFT JOIN kept USING (doc_id)""",
    "op7_jaccard_join": rf"""
WITH RECURSIVE texts AS (SELECT doc_id, {_WORDS.format(_FOLDED)} AS words FROM documents),
shingles AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) >= 5 THEN list_transform(range(1, len(words) - 3), lambda i: md5(array_to_string(words[i:i + 4], ' ')))
 WHEN len(words) > 0 THEN [md5(array_to_string(words, ' '))] ELSE [] END) AS shingle FROM texts),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM shingles a JOIN shingles b USING (shingle) WHERE a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (SELECT doc_id, doc_id AS low FROM documents UNION SELECT b, low FROM reached JOIN both_ways ON a = doc_id),
lowest AS (SELECT doc_id, min(low) AS component_id FROM reached GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN lowest USING (doc_id)""",
}
