"""The registered queries of this folder: one per operator, each over its whole table, and their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripledger.llm import byte_bpe, exact_dedup, filter_audit, language_id, lexical_search, line_dedup, minhash_join, mixing, projection_search, quality, suffix_dedup, superkmer_dedup, toxicity
from tripledger.llm.common import documents, held_out

Query = Callable[[SparkSession, str], DataFrame]


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    grades = toxicity.graded(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return grades.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "severity", "predicted")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.without_repeats(documents(spark, sf_dir))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "position")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return byte_bpe.encoded(documents(spark, sf_dir), ranks, public_tokenizers.PATTERN)


def op5_quality_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = quality.scored(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scores.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op6_minhash_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_join.near_groups(documents(spark, sf_dir))


def op7_superkmer_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superkmer_dedup.without_repeats(documents(spark, sf_dir))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = language_id.train(docs)
    return language_id.predict(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op10_projection_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return projection_search.nearest(vectors, vectors.where("vec_id % 50 = 0"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.without_shared_lines(documents(spark, sf_dir))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.ranked(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP3_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS mark
  FROM documents),
walked AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY mark, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first
  FROM sized),
ranked AS (
  SELECT source, source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS place
  FROM (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source)),
sources AS (
  SELECT source, source_size, [3.0, 1.0, 2.0][place + 1]::DOUBLE AS weight, [-0.5, 0.5, 0.0][place + 1]::DOUBLE AS tilt FROM ranked),
levels AS (
  SELECT 2 * source_size AS most, weight, 2 * source_size / weight AS ratio,
         (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2 * source_size) OVER up, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER up, 0)) AS level
  FROM sources
  WINDOW up AS (ORDER BY 2 * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
chosen AS (SELECT arg_min(level, ratio) AS level FROM levels WHERE most > weight * level),
plan AS (
  SELECT source, source_size, tilt, least((2 * source_size)::DOUBLE, weight * level) AS target FROM sources, chosen),
laps AS (
  SELECT doc_id, size, first, tilt, p.source_size, target, floor(target)::BIGINT AS words,
         CASE WHEN p.source_size > 0 THEN floor(target)::BIGINT // p.source_size ELSE 0 END AS whole
  FROM walked w JOIN plan p ON w.source IS NOT DISTINCT FROM p.source),
counted AS (
  SELECT *, least(whole * size + least(greatest(words - whole * source_size - first, 0), size), 2 * size)::BIGINT AS taken,
         least(first / target, 1.0::DOUBLE) AS x
  FROM laps)
SELECT doc_id, size, source_size, target, taken,
       CASE WHEN taken = 0 THEN NULL WHEN tilt = 0 THEN x
            ELSE 2 * x / ((1 - tilt) + sqrt((1 - tilt) * (1 - tilt) + 4 * tilt * x)) END AS position
FROM counted
"""

OP2_SQL = """
WITH docs AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
starts AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM docs, unnest(range(0, n - 49)) t(i)),
firsts AS (SELECT s, min(doc_id) AS first FROM starts GROUP BY s),
lost AS (SELECT doc_id, i FROM starts JOIN firsts USING (s) WHERE doc_id > first),
edges AS (
  SELECT doc_id, i AS pos, 1 AS d FROM lost UNION ALL SELECT doc_id, i + 50, -1 FROM lost
  UNION ALL SELECT doc_id, 0, 0 FROM docs UNION ALL SELECT doc_id, n, 0 FROM docs),
steps AS (SELECT doc_id, pos, sum(d) AS d FROM edges GROUP BY doc_id, pos),
parts AS (
  SELECT doc_id, pos, d, sum(d) OVER w AS deep, coalesce(lead(pos) OVER w, pos) AS upto FROM steps WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
whole AS (
  SELECT doc_id, sum(upto - pos) FILTER (deep > 0) AS gone, count(*) FILTER (deep > 0 AND deep = d) AS spans,
    string_agg(substr(h, 2 * pos + 1, 2 * (upto - pos)), '' ORDER BY pos) FILTER (deep = 0) AS kept
  FROM parts JOIN docs USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, spans AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM docs JOIN whole USING (doc_id)
"""

OP6_SQL = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM docs, unnest(range(1, greatest(len(w) - 3, 2))) t(i) WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, r) AS (
  SELECT doc_id, doc_id FROM docs UNION SELECT ways.b, reach.r FROM reach JOIN ways ON ways.a = reach.doc_id),
least_of AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM least_of LEFT JOIN sizes USING (doc_id)
"""

OP7_SQL = r"""
WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM docs, unnest(range(1, len(w) - 11)) t(i)),
firsts AS (SELECT s, min(doc_id) AS first FROM windows GROUP BY s),
lost AS (SELECT doc_id, i FROM windows JOIN firsts USING (s) WHERE doc_id > first),
hit AS (SELECT DISTINCT doc_id, i + k AS pos FROM lost, range(13) r(k)),
words AS (SELECT doc_id, i AS pos, w[i] AS word FROM docs, unnest(range(1, len(w) + 1)) t(i)),
stay AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS kept FROM words ANTI JOIN hit USING (doc_id, pos) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM docs LEFT JOIN stay USING (doc_id)
"""

OP8_SQL = r"""
WITH facts AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS body
  FROM documents),
ranked AS (
  SELECT doc_id, body, count(*) OVER (PARTITION BY body) AS group_size,
         first_value(doc_id) OVER (PARTITION BY body ORDER BY points DESC, doc_id) AS keep_id
  FROM facts)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256 FROM ranked
"""

OP11_SQL = r"""
WITH docs AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
flags AS (
  SELECT doc_id, part, [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w), 100 * len(regexp_extract_all(t, '[A-Z]')) > 10 * length(t),
    regexp_matches(t, '[#$%&*|]'), doc_id > min(doc_id) OVER (PARTITION BY t)] AS fails
  FROM docs),
marked AS (
  SELECT part, list_transform(fails, lambda f: f::INT) AS f, coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS toxic
  FROM flags LEFT JOIN labels USING (doc_id)),
masks AS (
  SELECT part, f, list_sum(f)::INT AS many, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM marked GROUP BY ALL),
five AS (SELECT unnest([1, 2, 3, 4, 5]) AS k),
orders AS (
  SELECT [a.k, b.k, c.k, d.k, e.k] AS o FROM five a, five b, five c, five d, five e
  WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
steps AS (SELECT o, array_to_string(list_transform(o, lambda k: 'ABCDE'[k]), '') AS filter_order, s AS step, o[s] AS own FROM orders, range(1, 6) r(s)),
judged AS (
  SELECT part, filter_order, step::INT AS step, f[own] = 1 AS fails, many, n, good, toxic,
    coalesce(list_sum(list_transform(o[1:step - 1], lambda k: f[k])), 0) = 0 AS passed
  FROM masks, steps)
SELECT part, filter_order, step, coalesce(sum(n) FILTER (passed AND NOT fails), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (passed AND fails), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (fails AND NOT passed), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (fails AND many = 1), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (passed AND fails), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (passed AND fails), 0)::BIGINT AS toxic_lost,
  coalesce(sum(n * (120 // greatest(many, 1))) FILTER (fails), 0)::BIGINT AS shapley
FROM judged GROUP BY part, filter_order, step
"""

OP12_SQL = r"""
WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS w FROM documents),
lines AS (
  SELECT doc_id, i, w[i] AS line,
    translate(trim(w[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM docs, unnest(range(1, len(w) + 1)) t(i)),
shared AS (SELECT key, max(doc_id) AS last FROM lines WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
judged AS (SELECT doc_id, i, line, coalesce(doc_id <> last, false) AS lost FROM lines LEFT JOIN shared USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT lost), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

OP13_SQL = r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents WHERE text IS NOT NULL),
sizes AS (SELECT doc_id, len(w) AS n FROM docs WHERE len(w) > 0),
total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM sizes),
wanted AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark) GROUP BY ALL),
held AS (
  SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM docs) WHERE term IN (SELECT term FROM wanted) GROUP BY ALL),
weights AS (
  SELECT term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS weight FROM held, total GROUP BY term),
scores AS (
  SELECT item_id, doc_id, sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // words))))::BIGINT AS score
  FROM wanted JOIN held USING (term) JOIN weights USING (term) JOIN sizes USING (doc_id), total GROUP BY item_id, doc_id)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 10
"""


def llm_queries() -> dict[str, Query]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_suffix_dedup": op2_suffix_dedup,
        "op3_source_mixing": op3_source_mixing,
        "op4_byte_bpe": op4_byte_bpe,
        "op5_quality_discriminant": op5_quality_discriminant,
        "op6_minhash_join": op6_minhash_join,
        "op7_superkmer_dedup": op7_superkmer_dedup,
        "op8_exact_dedup": op8_exact_dedup,
        "op9_language_id": op9_language_id,
        "op10_projection_search": op10_projection_search,
        "op11_filter_audit": op11_filter_audit,
        "op12_line_dedup": op12_line_dedup,
        "op13_lexical_search": op13_lexical_search,
    }


def llm_oracles() -> dict[str, str]:
    return {
        "op2_suffix_dedup": OP2_SQL,
        "op3_source_mixing": OP3_SQL,
        "op6_minhash_join": OP6_SQL,
        "op7_superkmer_dedup": OP7_SQL,
        "op8_exact_dedup": OP8_SQL,
        "op11_filter_audit": OP11_SQL,
        "op12_line_dedup": OP12_SQL,
        "op13_lexical_search": OP13_SQL,
    }
