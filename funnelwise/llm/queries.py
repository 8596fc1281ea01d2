"""Registered queries of this subpackage and their DuckDB texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from funnelwise.llm import (decontaminate, extract, katz, language, licenses, merkle, near_dup, packing, prefix_trie, quality, token_counts, toxicity,
                            vector_codes)

#: op8's links: three-word shingles, at least 85 % of the union shared.
OP8_RULE = near_dup.Rule(shingle=3, percent=85, rows=6, bands=40)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_line_block_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(_table(spark, sf_dir, "pages"))


def op3_levenshtein_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.fingerprints(_table(spark, sf_dir, "documents"))


def op5_factorisation_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op7_trie_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"))


def op8_bbit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.components(_table(spark, sf_dir, "documents"), OP8_RULE)


def op9_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score_texts(_table(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.report(_table(spark, sf_dir, "conversations"))


def op12_centroid_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.classify(_table(spark, sf_dir, "documents"))


def op13_dictionary_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_decontamination": op1_suffix_decontamination,
    "op2_line_block_extraction": op2_line_block_extraction,
    "op3_levenshtein_toxicity": op3_levenshtein_toxicity,
    "op4_merkle_fingerprints": op4_merkle_fingerprints,
    "op5_factorisation_quality": op5_factorisation_quality,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_trie_token_counts": op7_trie_token_counts,
    "op8_bbit_minhash": op8_bbit_minhash,
    "op9_katz_backoff": op9_katz_backoff,
    "op10_license_scan": op10_license_scan,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_centroid_language": op12_centroid_language,
    "op13_dictionary_codes": op13_dictionary_codes,
}

def _codes_sql(rounds: int = 6, entries: int = 16, parts: int = 8) -> str:
    """op13 in SQL: one pair of steps a round over (vector, dimension, integer) rows."""
    steps = [f"""
kept AS (
  SELECT row_number() OVER () AS r, vec_id, label, embedding AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
ints AS (
  SELECT r, d, (d - 1) * {parts} // len(v) AS part, floor(4096 * v[d]::DOUBLE)::BIGINT AS x
  FROM (SELECT r, v, unnest(generate_series(1, len(v))) AS d FROM kept)),
first AS (SELECT r, row_number() OVER (ORDER BY vec_id, v) - 1 AS e FROM kept ORDER BY vec_id, v LIMIT {entries}),
book0 AS (SELECT e, d, part, x AS y FROM ints JOIN first USING (r))"""]
    for k in range(rounds + 1):
        steps.append(f"""
near{k} AS MATERIALIZED (
  SELECT r, part, min(struct_pack(far := far, e := e)) AS best FROM (
    SELECT r, i.part, e, sum((x - y) * (x - y))::BIGINT AS far FROM ints i JOIN book{k} b USING (d) GROUP BY r, i.part, e)
  GROUP BY r, part)""")
        if k < rounds:
            steps.append(f"""
means{k} AS (
  SELECT best.e AS e, d, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS y
  FROM near{k} JOIN ints USING (r, part) GROUP BY best.e, d),
book{k + 1} AS MATERIALIZED (SELECT e, d, part, coalesce(m.y, b.y)::BIGINT AS y FROM book{k} b LEFT JOIN means{k} m USING (e, d))""")
    return f"""WITH {",".join(steps)},
coded AS (
  SELECT r, string_agg(lpad(lower(hex(best.e)), 2, '0'), '' ORDER BY part) AS code, sum(best.far)::BIGINT AS error FROM near{rounds} GROUP BY r)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(y::VARCHAR, ',' ORDER BY part, e, d)) FROM book{rounds}) AS codebooks_sha256
FROM kept JOIN coded USING (r)
"""


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE: dict[str, str] = {
    "op1_suffix_decontamination": rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(coalesce({_LOWER}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, w, least(10, len(w)) AS size
  FROM (SELECT item_id, regexp_extract_all(coalesce({_LOWER}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark)
  WHERE len(w) > 0),
windows AS (
  SELECT DISTINCT item_id, size, array_to_string(list_slice(w, i, i + size - 1), ' ') AS g
  FROM (SELECT *, unnest(generate_series(1, len(w) - size + 1)) AS i FROM b)),
sizes AS (SELECT DISTINCT size FROM windows),
places AS (
  SELECT r, i, size, array_to_string(list_slice(w, i, i + size - 1), ' ') AS g
  FROM (SELECT r, w, size, unnest(generate_series(1, len(w) - size + 1)) AS i FROM d, sizes WHERE len(w) >= size)),
found AS (SELECT r, i, p.size, item_id FROM places p JOIN windows USING (size, g)),
hit AS (
  SELECT r, count(DISTINCT pos) AS n_hit
  FROM (SELECT r, unnest(generate_series(i, i + size - 1)) AS pos FROM found) GROUP BY r),
items AS (
  SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
  FROM found GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r)
""",
    "op8_bbit_minhash": rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(coalesce({_LOWER}, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, list_sort(list_distinct(list_transform(generate_series(1, len(w) - least(3, len(w)) + 1),
         lambda i: array_to_string(list_slice(w, i, i + least(3, len(w)) - 1), ' ')))) AS s
  FROM d WHERE len(w) > 0),
classes AS (SELECT s, min(doc_id) AS c, len(s) AS n FROM sets GROUP BY s),
grams AS (SELECT c, n, unnest(s) AS g FROM classes),
rare AS (
  SELECT c, n, g, row_number() OVER (PARTITION BY c ORDER BY f, g) AS rank
  FROM grams JOIN (SELECT g, count(*) AS f FROM grams GROUP BY g) USING (g)),
prefix AS (SELECT c, n, g FROM rare WHERE rank <= n - ceil(0.85 * n) + 1),
pairs AS (
  SELECT DISTINCT x.c AS a, y.c AS b FROM prefix x JOIN prefix y USING (g)
  WHERE x.c < y.c AND 100 * least(x.n, y.n) >= 85 * greatest(x.n, y.n)),
links AS (
  SELECT a, b FROM (
    SELECT a, b, len(list_intersect(x.s, y.s)) AS shared, x.n AS nx, y.n AS ny
    FROM pairs JOIN classes x ON x.c = a JOIN classes y ON y.c = b)
  WHERE 100 * shared >= 85 * (nx + ny - shared)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(c, t) AS (
  SELECT DISTINCT a, a FROM edges UNION SELECT r.c, b FROM reach r JOIN edges ON a = r.t),
roots AS (SELECT c, min(t) AS root FROM reach GROUP BY c),
placed AS (
  SELECT doc_id, n, coalesce(root, c) AS component_id
  FROM sets JOIN classes USING (s) LEFT JOIN roots USING (c))
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(component_id, doc_id) AS component_id,
       doc_id = coalesce(component_id, doc_id) AS kept
FROM d LEFT JOIN placed USING (doc_id)
""",
    "op11_prefix_trie": rf"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS n, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list(struct_pack(role := role, text := text) ORDER BY n) AS turns FROM t GROUP BY conv_id),
hashed AS (
  SELECT conv_id, turns, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: ord(ch)::BIGINT)),
    lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 4 AS h
  FROM own),
seqs AS (
  SELECT c.conv_id, list_concat(coalesce(list_slice(b.turns, 1, c.h), []), list_slice(c.turns, c.h + 1, len(c.turns))) AS s
  FROM hashed c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 20),
paths AS (SELECT conv_id, len(s) AS size, unnest(generate_series(0, len(s))) AS depth, s FROM seqs),
named AS (SELECT conv_id, size, depth, list_slice(s, 1, depth) AS node, CASE WHEN depth > 0 THEN list_slice(s, 1, depth - 1) END AS parent, s[depth].text AS last FROM paths),
nodes AS (
  SELECT node, any_value(parent) AS parent, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(CASE WHEN size = depth THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends_sha256,
         (count(*) - 1) * len(regexp_extract_all(coalesce(any_value(last), ''), '[^\x20\x09-\x0D]+')) AS gain
  FROM named GROUP BY node, depth),
kids AS (SELECT parent AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY parent),
full_nodes AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids USING (node)),
above AS (SELECT list_slice(node, 1, d) AS node, gain, (n_children = 0)::INT AS leaf FROM (SELECT *, unnest(generate_series(0, depth)) AS d FROM full_nodes)),
sums AS (SELECT node, sum(leaf) AS n_leaves, sum(gain) AS saved_tokens FROM above GROUP BY node)
SELECT n.conv_id::BIGINT AS conv_id, n.depth::BIGINT AS depth, p.conv_id::BIGINT AS parent_conv_id, n.n_convs::BIGINT AS n_convs, n.n_children::BIGINT AS n_children,
       s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM full_nodes n JOIN sums s USING (node) LEFT JOIN nodes p ON n.parent = p.node
""",
    "op13_dictionary_codes": _codes_sql(),
}
