"""Registered queries of this package, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import ann, contexts, decontam, divergence, html, langid, mixing, neardup, prefixes, quality, substring, suffixes, tokens
from tidemark.llm.common import fold, table
from tidemark.session import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

TOKENIZER = "byte_bpe_50k.json"


def query(name: str, sql: str | None = None):
    def keep(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def language_model(docs: DataFrame) -> langid.Model:
    """Learned from the labelled documents that are not held out."""
    return langid.fit(docs.where(fold(F.col("doc_id"), 5) != 0))


NEAREST_SQL = """
WITH e AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score FROM e q JOIN e c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)
)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY rank <= 20
"""


@query("op1_nearest_neighbours", NEAREST_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.pmod(F.col("vec_id"), F.lit(20)) == 0)


WORDS_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT doc_id, s, md5(array_to_string(list_slice(w, s, s + 34), ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS s FROM w WHERE len(w) >= 35)
), rep AS (
  SELECT g FROM win GROUP BY g HAVING count(*) > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(s, s + 35)) AS p FROM win JOIN rep USING (g)
), left_over AS (
  SELECT doc_id, sha256(string_agg(x, ' ' ORDER BY p)) AS kept
  FROM (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM w) ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
), n AS (
  SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, coalesce(kept, sha256('')) AS kept_sha256
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN left_over USING (doc_id)
"""


@query("op2_substring_dedup", WORDS_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.removal_digest(table(spark, sf_dir, "documents"))


@query("op3_language_id")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out")  # a null id is neither learned from nor held out
    return langid.identify(docs, language_model(docs), ["doc_id", held_out])


@query("op4_html_extraction")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


@query("op5_suffix_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.removal_digest(table(spark, sf_dir, "documents"))


NEAR_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]] ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM w
), each AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS sh FROM sets
), ids AS (
  SELECT sh, row_number() OVER () AS t FROM (SELECT sh FROM each GROUP BY sh HAVING count(*) > 1)
), tok AS (
  SELECT doc_id, n, t FROM each JOIN ids USING (sh)
), link AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM tok a JOIN tok b ON a.t = b.t AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))
), both_ways AS (
  SELECT a, b FROM link UNION SELECT b, a FROM link
), reach AS (
  SELECT doc_id AS node, doc_id AS seen FROM documents
  UNION
  SELECT r.node, e.b FROM reach r JOIN both_ways e ON r.seen = e.a
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, c.component_id, c.component_id = s.doc_id AS kept
FROM sets s JOIN (SELECT node, min(seen) AS component_id FROM reach GROUP BY node) c ON c.node = s.doc_id
"""


@query("op6_near_duplicates", NEAR_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), shingle=2, threshold=0.8).drop("k")


MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || '/mix') AS h, md5(coalesce(text, '')) AS t
  FROM documents
), src AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), weighed AS (
  SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w,
         CAST(sum(source_size) OVER () AS DOUBLE) * 1.5 AS budget, row_number() OVER (ORDER BY source NULLS LAST) AS place
  FROM src
), level AS (
  SELECT *, budget - coalesce(sum(2.0::DOUBLE * source_size) OVER b, 0) AS rest, sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS w_left
  FROM weighed WINDOW b AS (ORDER BY 2.0::DOUBLE * source_size / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), lvl AS (
  SELECT min_by(rest / w_left, (2.0::DOUBLE * source_size / w, place)) FILTER (WHERE 2.0::DOUBLE * source_size / w * w_left > rest) AS l FROM level
), targets AS (
  SELECT source, source_size, budget, least(2.0::DOUBLE * source_size, coalesce(w * l, 2.0::DOUBLE * source_size)) AS target FROM level, lvl
), queue AS (
  SELECT d.*, source_size, target, budget, sum(size) OVER (PARTITION BY d.source ORDER BY h, t ROWS UNBOUNDED PRECEDING) AS fin
  FROM d JOIN targets s ON d.source IS NOT DISTINCT FROM s.source
), copies AS (
  SELECT *, (fin + copy * source_size - size / 2) / target AS finish FROM queue, (VALUES (0), (1)) c(copy) WHERE size > 0
), total AS (
  SELECT *, sum(size) OVER (ORDER BY finish, source NULLS FIRST, copy, h, t ROWS UNBOUNDED PRECEDING) AS total FROM copies
), taken AS (
  SELECT doc_id, source, h, t, sum(size) AS taken FROM total WHERE total - size / 2 <= budget GROUP BY ALL
)
SELECT q.doc_id, q.size, q.source_size, q.target, CAST(coalesce(k.taken, 0) AS BIGINT) AS taken
FROM queue q LEFT JOIN taken k ON q.h = k.h AND q.t = k.t AND q.source IS NOT DISTINCT FROM k.source
"""


@query("op7_source_mixing", MIX_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUALITY_SAMPLE = 8_000  # labelled documents that the ranking learns from at most, about


@query("op8_quality_ranking")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    known = quality.bounded_sample(table(spark, sf_dir, "labels").where(fold(F.col("doc_id"), 3) != 1), QUALITY_SAMPLE)
    model = quality.fit(docs.select("doc_id", "text").join(F.broadcast(known), "doc_id"))  # bounded by QUALITY_SAMPLE
    scored = quality.score(docs, model, ["doc_id", F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out")])
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


LEAK_SQL = r"""
WITH bw AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), dw AS (
  SELECT doc_id, coalesce(list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> ''), []) AS w FROM documents
), win AS (
  SELECT DISTINCT item_id, list_slice(w, s, s + least(10, len(w)) - 1) AS g, least(10, len(w)) AS n
  FROM (SELECT *, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS s FROM bw WHERE len(w) > 0)
), spots AS (
  SELECT doc_id, s, n, list_slice(w, s, s + n - 1) AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM dw, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)
), hits AS (
  SELECT doc_id, s, spots.n, item_id FROM spots JOIN win ON spots.g = win.g
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hits) GROUP BY doc_id
), found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY doc_id
)
SELECT dw.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM dw LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""


@query("op9_benchmark_decontamination", LEAK_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), "contaminated")


@query("op10_token_ids")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_output(table(spark, sf_dir, "documents"), tokenizer_path())


AUDIT_SQL = r"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents
), t AS (
  SELECT lang, source, r, unnest(w) AS term FROM d
), kept AS (
  SELECT lang, term, count(*)::HUGEINT AS n FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 30
), n_lang AS (
  SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS n FROM kept GROUP BY lang
), grp AS (
  SELECT DISTINCT lang, source FROM d
), own AS (
  SELECT t.lang, source, term, count(*)::HUGEINT AS c FROM t JOIN kept USING (lang, term) GROUP BY ALL
), n_grp AS (
  SELECT g.lang, g.source, coalesce(sum(c), 0)::HUGEINT AS n FROM grp g LEFT JOIN own o ON g.lang = o.lang AND g.source = o.source GROUP BY ALL
), rates AS (
  SELECT g.lang, g.source, k.term, coalesce(c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(c, 0) + 5)) // (g.n + 5 * l.v) AS p, 1 + (1000000000::HUGEINT * (k.n + 5)) // (l.n + 5 * l.v) AS q
  FROM n_grp g JOIN n_lang l USING (lang) JOIN kept k USING (lang) LEFT JOIN own o ON o.lang = g.lang AND o.source = g.source AND o.term = k.term
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(v, 0)::BIGINT AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source AS s, y.source AS o, sum(abs(x.p - y.p)) AS v FROM rates x JOIN rates y USING (lang, term) GROUP BY ALL) m ON m.lang = a.lang AND m.s = a.source AND m.o = b.source
), terms AS (
  SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM rates WHERE c > 0 AND p > q
)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms) QUALIFY part = 'pair' OR rank <= 50
"""


@query("op11_source_divergence", AUDIT_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


TRIE_SQL = r"""
WITH RECURSIVE tab AS (
  SELECT i AS n, i::BIGINT AS c, 0 AS k FROM range(256) r(i)
  UNION ALL
  SELECT n, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM tab WHERE k < 8
), own AS (
  SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS t
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), crc AS (
  SELECT conv_id, conv_id::VARCHAR AS s, 0 AS pos, 4294967295 AS c FROM own
  UNION ALL
  SELECT conv_id, s, pos + 1, xor(crc.c >> 8, tab.c) FROM crc JOIN tab ON tab.k = 8 AND tab.n = xor(crc.c & 255, ascii(substr(s, pos + 1, 1))) WHERE pos < length(s)
), head AS (
  SELECT conv_id, xor(c, 4294967295) % 9 AS h FROM crc WHERE pos = length(s)
), conv AS (
  SELECT o.conv_id, list_concat(coalesce(list_slice(b.t, 1, h), []), CASE WHEN len(o.t) > h THEN list_slice(o.t, h + 1, len(o.t)) ELSE [] END) AS t
  FROM own o JOIN head USING (conv_id) LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 5
), pre AS (
  SELECT conv_id, t, d, CASE WHEN d = 0 THEN [] ELSE list_slice(t, 1, d) END AS p FROM (SELECT conv_id, t, unnest(range(0, len(t) + 1)) AS d FROM conv)
), node AS (
  SELECT p, d, min(conv_id) AS conv_id, count(*) AS n, (count(*) - 1) * CASE WHEN d = 0 THEN 0 ELSE strlen(any_value(p[d]['text'])) END AS saved,
         string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE len(t) = d) AS ends FROM pre GROUP BY p, d
), kids AS (
  SELECT list_slice(p, 1, d - 1) AS p, d - 1 AS d, count(*) AS k FROM node WHERE d > 0 GROUP BY ALL
), full_node AS (
  SELECT n.*, coalesce(k, 0) AS k FROM node n LEFT JOIN kids ON n.d = kids.d AND (n.d = 0 OR n.p = kids.p)
), up AS (
  SELECT CASE WHEN a = 0 THEN [] ELSE list_slice(p, 1, a) END AS p, a AS d, sum(saved) AS saved, count(*) FILTER (WHERE k = 0) AS leaves
  FROM (SELECT p, saved, k, unnest(range(0, d + 1)) AS a FROM full_node) GROUP BY ALL
)
SELECT n.conv_id, n.d AS depth, par.conv_id AS parent_conv_id, n.n AS n_convs, n.k AS n_children, u.leaves AS n_leaves, CAST(u.saved AS BIGINT) AS saved_tokens, sha256(coalesce(n.ends, '')) AS ends_sha256
FROM full_node n JOIN up u ON u.d = n.d AND u.p = n.p LEFT JOIN node par ON par.d = n.d - 1 AND (n.d = 1 OR par.p = list_slice(n.p, 1, n.d - 1))
"""


@query("op12_conversation_trie", TRIE_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.trie(prefixes.spliced(prefixes.paths(table(spark, sf_dir, "conversations"))))


@query("op13_context_tree_scores")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    remainder = fold(F.col("doc_id"), 5)
    return contexts.score(docs, contexts.fit(docs, remainder != 1), remainder == 1)
