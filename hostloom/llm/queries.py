"""The registered queries of this subpackage and the SQL they are compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hostloom.llm import bpe, decontaminate, jaccard_join, line_dedup, mixing, passages, pii, prefix_trie, quality, runs, token_files, toxicity, url_rules
from hostloom.llm.common import batched

QUERIES = {}
ORACLES = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return batched(spark).read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_pii_crf")
def op1(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return pii.find(docs, pii.train(pii.labelled_chains(docs)))


@query("op2_template_decontamination")
def op2(spark, sf_dir):
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op3_ranked_token_files")
def op3(spark, sf_dir):
    return token_files.round_trip(table(spark, sf_dir, "documents"))


@query("op4_ngram_ratio_quality")
def op4(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


LINES_SQL = r"""
WITH every AS (
  SELECT doc_id, unnest(list_transform(string_split(text, chr(10)), lambda x, i: {'no': i - 1, 'line': x})) AS l FROM documents WHERE doc_id IS NOT NULL
), sets AS (
  SELECT doc_id, l.no AS line_no, list_sort(list_distinct(regexp_extract_all(l.line, '[^\x20\x09-\x0D]+'))) AS words FROM every
), filled AS (SELECT * FROM sets WHERE len(words) > 0
), first AS (
  SELECT words, len(words) AS n, min((doc_id, line_no)) AS place FROM filled GROUP BY words
), near AS (
  SELECT DISTINCT b.place FROM first a JOIN first b ON a.place < b.place AND 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n
  WHERE 5 * len(list_intersect(a.words, b.words)) >= 4 * (a.n + b.n - len(list_intersect(a.words, b.words)))
)
SELECT DISTINCT f.doc_id, CAST(f.line_no AS INTEGER) AS line_no FROM filled f JOIN first USING (words)
WHERE (f.doc_id, f.line_no) > first.place OR first.place IN (SELECT place FROM near)
"""


@query("op5_line_set_join", LINES_SQL)
def op5(spark, sf_dir):
    return line_dedup.repeated_lines(table(spark, sf_dir, "documents"))


@query("op9_lsh_forest_join")
def op9(spark, sf_dir):
    return jaccard_join.joined(table(spark, sf_dir, "documents"))


@query("op6_suffix_automaton_dedup")
def op6(spark, sf_dir):
    return passages.without_repeats(table(spark, sf_dir, "documents"))


@query("op7_byte_bpe")
def op7(spark, sf_dir):
    return bpe.token_digests(table(spark, sf_dir, "documents"))


@query("op8_url_association_rules")
def op8(spark, sf_dir):
    return url_rules.judge(table(spark, sf_dir, "pages"))


@query("op10_compression_toxicity")
def op10(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = toxicity.scores(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    from pyspark.sql import functions as F

    return found.select("doc_id", (toxicity.remainder(F.col("doc_id")) == 2).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS key,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), sources AS (
  SELECT key, CAST(sum(size) AS BIGINT) AS s, [5, 2, 1][1 + (row_number() OVER (ORDER BY key) - 1) % 3] AS w FROM sized GROUP BY key
), levels AS (
  SELECT s, w, (sum(s) OVER () - 3 * (sum(s) OVER fill - s)) / CAST(sum(w) OVER () - (sum(w) OVER fill - w) AS DOUBLE) AS level,
    row_number() OVER fill AS place
  FROM sources WINDOW fill AS (ORDER BY s / CAST(w AS DOUBLE), key ROWS UNBOUNDED PRECEDING)
), chosen AS (SELECT coalesce(arg_min(level, place), 0) AS level FROM levels WHERE level * w <= 3 * s
), targets AS (
  SELECT key, s, least(level * w, CAST(3 * s AS DOUBLE)) AS target,
    CAST(CAST('0x' || substr(md5('11:' || key), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0 AS u FROM sources, chosen
), placed AS (
  SELECT doc_id, size, s, target, u, row_number() OVER (PARTITION BY key ORDER BY size, doc_id NULLS FIRST) - 1 AS k,
    CASE WHEN s > 0 THEN target / s ELSE 0.0 END AS e
  FROM sized JOIN targets USING (key)
)
SELECT doc_id, size, s AS source_size, target,
  CAST(least(floor(u + (k + 1) * e) - floor(u + k * e), 3) AS BIGINT) * size AS taken FROM placed
"""


@query("op11_systematic_mix", MIX_SQL)
def op11(spark, sf_dir):
    return mixing.taken(table(spark, sf_dir, "documents"))


@query("op12_synchronised_runs")
def op12(spark, sf_dir):
    return runs.run_digests(table(spark, sf_dir, "documents"))


TRIE_SQL = """
WITH crcs AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t
), own AS (
  SELECT conv_id AS c, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), given AS (
  SELECT c, turns, xor(list_reduce(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT)),
    lambda a, x: xor(a >> 8, t[1 + (xor(a, x) & 255)]), 4294967295), 4294967295) % 6 AS h FROM own, crcs
), rebuilt AS (
  SELECT g.c, list_concat(coalesce(f.turns[1:g.h], []), g.turns[g.h + 1:]) AS turns FROM given g LEFT JOIN own f ON f.c = g.c - g.c % 100
), members AS (SELECT c, len(turns) AS n, turns[1:d] AS node, d FROM (SELECT c, turns, unnest(range(len(turns) + 1)) AS d FROM rebuilt)
), nodes AS (
  SELECT node, d, min(c) AS c, count(*) AS n,
    sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE n = d), '')) AS ends FROM members GROUP BY node, d
), kids AS (SELECT node[1:d - 1] AS node, count(*) AS kids FROM nodes WHERE d > 0 GROUP BY 1
), known AS (SELECT nodes.*, coalesce(kids, 0) AS kids FROM nodes LEFT JOIN kids USING (node)
), above AS (
  SELECT node[1:a] AS node, CASE WHEN kids = 0 THEN 1 ELSE 0 END AS leaf, (n - 1) * coalesce(length(node[d].t), 0) AS saved
  FROM (SELECT *, unnest(range(d + 1)) AS a FROM known)
), sums AS (SELECT node, sum(leaf) AS leaves, sum(saved) AS saved FROM above GROUP BY node)
SELECT k.c AS conv_id, CAST(k.d AS BIGINT) AS depth, p.c AS parent_conv_id, k.n AS n_convs, CAST(k.kids AS BIGINT) AS n_children,
  CAST(s.leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, k.ends AS ends_sha256
FROM known k JOIN sums s ON s.node = k.node LEFT JOIN nodes p ON k.d > 0 AND p.node = k.node[1:k.d - 1]
"""


@query("op13_prefix_trie", TRIE_SQL)
def op13(spark, sf_dir):
    return prefix_trie.prefix_nodes(table(spark, sf_dir, "conversations"))
