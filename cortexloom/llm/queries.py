"""The queries of the training-data operators, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import divergence, fingerprints, host_rules, language, mixing, near_duplicates, pieces, quality, repeats, token_counts, top_k, warc, whitening
from .common import crc_mod, scratch, table

PIECE_MODEL = "piece_bpe_32k.model"


def tokenizer_path(name: str = PIECE_MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rules = quality.train(docs, labels.where(crc_mod("doc_id", 5) != 0))
    scored = quality.score(docs, rules)
    return scored.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", F.col("predicted").cast("int").alias("predicted"))


def op2_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.schedule(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path())


def op4_dart_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = near_duplicates.near_duplicates(table(spark, sf_dir, "documents"))
    return classes.select("doc_id", "class_id", (F.col("doc_id") == F.col("class_id")).alias("kept"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_next(table(spark, sf_dir, "documents"))


def op6_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = repeats.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learned = language.train(docs.where(crc_mod("doc_id", 4) != 2))
    return language.identify(docs, learned).select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op9_piece_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_and_check(table(spark, sf_dir, "documents"), tokenizer_path())


def op10_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archive is written when this is called, to a folder of its own that goes when the program ends; the result reads it."""
    path = scratch(spark, "warc")
    warc.write_pages(table(spark, sf_dir, "pages"), path)
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    responses = warc.read_archive(spark, path).where("record_type = 'response'").select(*columns, F.length("payload").cast("long").alias("_read"))
    responses = responses.withColumn("payload_bytes", F.col("_read")).select(*columns)  # as read from the payload itself
    revisits = warc.read_archive(spark, path, payload=False).where("record_type = 'revisit'").select(*columns)
    return responses.unionAll(revisits)


def op11_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source of a document is its host."""
    judged = host_rules.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_whitened_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def queries() -> dict:
    own = (op1_quality_rules, op2_pfair_mixing, op3_token_counts, op4_dart_near_duplicates, op5_fingerprints, op6_repeated_passages, op7_exact_top_k, op8_language_id, op9_piece_ids, op10_warc_round_trip, op11_host_rules, op12_source_divergence, op13_whitened_embeddings)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op6_repeated_passages": OP6_SQL, "op7_exact_top_k": OP7_SQL, "op10_warc_round_trip": OP10_SQL, "op11_host_rules": OP11_SQL, "op12_source_divergence": OP12_SQL}


OP6_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
n AS (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 12)) AS i FROM w WHERE len(ws) >= 13),
g AS (SELECT doc_id, i, list_slice(ws, i, i + 12) AS k FROM n),
m AS (SELECT k, min(doc_id) AS low FROM g GROUP BY k HAVING min(doc_id) < max(doc_id)),
r AS (SELECT g.doc_id, list(DISTINCT g.i) AS places FROM g JOIN m USING (k) WHERE g.doc_id > m.low GROUP BY g.doc_id),
c AS (SELECT doc_id, list_distinct(flatten(list_transform(places, lambda i: generate_series(i, i + 12)))) AS gone FROM r),
o AS (SELECT w.doc_id, ws, coalesce(gone, []) AS gone FROM w LEFT JOIN c USING (doc_id))
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(gone) AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string(list_select(ws, list_sort(list_filter(generate_series(1, len(ws)), lambda j: NOT list_contains(gone, j)))), ' '), '')) AS kept_sha256
FROM o
"""

OP7_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

OP10_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS n, sha1(h) AS s, max(page_id) OVER (PARTITION BY sha1(h)) AS top FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(s, CAST(1 + (i // 4) * 5 AS INTEGER), 5) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN top = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN top <> page_id THEN top END AS refers_to
FROM d
"""

OP11_SQL = r"""
WITH w AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws, row_number() OVER () AS r FROM documents),
g AS (SELECT r, i, list_slice(ws, i, i + 2) AS k FROM (SELECT r, ws, unnest(generate_series(1, len(ws) - 2)) AS i FROM w WHERE len(ws) >= 3)),
t AS (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS times FROM g),
c AS (SELECT r, CAST(len(list_distinct(flatten(list(generate_series(i, i + 2))))) AS BIGINT) AS n_repeat_words FROM t WHERE times > 1 GROUP BY r),
n AS (SELECT r, doc_id, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
      CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
      list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM w),
d AS (SELECT doc_id, source, n_words, word_chars, n_symbols, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM n LEFT JOIN c USING (r)),
f AS (SELECT *, unnest([{'rule': 'short', 'failed': n_words < 50}, {'rule': 'repetitive', 'failed': 100 * n_repeat_words > 50 * n_words}, {'rule': 'symbols', 'failed': 10 * n_symbols > n_words},
      {'rule': 'lines', 'failed': 3 * n_dup_lines > n_lines}, {'rule': 'word_length', 'failed': word_chars < 3 * n_words OR word_chars > 10 * n_words}]) AS x FROM d),
h AS (SELECT source, x.rule AS rule, CAST(count(*) AS DOUBLE) AS m, CAST(count(*) FILTER (x.failed) AS DOUBLE) AS k FROM f WHERE source IS NOT NULL GROUP BY ALL),
s AS (SELECT rule, sum(k) / sum(m) AS p, count(*) - 1 AS chance, sum(m) - sum(m * m) / sum(m) - (count(*) - 1) AS room, sum(k * k / m) - sum(k) * (sum(k) / sum(m)) AS spread FROM h GROUP BY rule),
o AS (SELECT rule, p, least(greatest(CASE WHEN p > 0 AND p < 1 AND room > 0 THEN (spread / (p * (1 - p)) - chance) / room ELSE 0 END, 1e-6), 0.999) AS rho FROM s),
v AS (SELECT source, rule, (k + p * (1 / rho - 1)) / (m + (1 / rho - 1)) AS rate FROM h JOIN o USING (rule)),
b AS (SELECT source, bool_or(rate > 0.5) AS rejected, list(rule) FILTER (rate > 0.05) AS enforced FROM v GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT coalesce(rejected, false)
  AND NOT (coalesce(list_contains(enforced, 'symbols'), false) AND 10 * n_symbols > n_words) AND NOT (coalesce(list_contains(enforced, 'lines'), false) AND 3 * n_dup_lines > n_lines)
  AND NOT (coalesce(list_contains(enforced, 'word_length'), false) AND (word_chars < 3 * n_words OR word_chars > 10 * n_words)) AS kept
FROM d LEFT JOIN b ON d.source = b.source
"""

OP12_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
e AS (SELECT r, lang, source, unnest(ws) AS term FROM t),
k AS (SELECT lang, term, CAST(count(*) AS HUGEINT) AS c FROM e GROUP BY ALL HAVING count(DISTINCT r) >= 30),
l AS (SELECT lang, CAST(count(*) AS HUGEINT) AS v, sum(c) AS n FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM t),
o AS (SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS c FROM e GROUP BY ALL),
a AS (SELECT g.lang, g.source, k.term, coalesce(o.c, 0) AS c, k.c AS all_c FROM g JOIN k USING (lang) LEFT JOIN o ON o.lang = g.lang AND o.source = g.source AND o.term = k.term),
n AS (SELECT lang, source, sum(c) AS n FROM a GROUP BY ALL),
p AS (SELECT a.lang, a.source, a.term, a.c, 1 + (1000000000 * (a.c + 5)) // (n.n + 5 * l.v) AS p, 1 + (1000000000 * (a.all_c + 5)) // (l.n + 5 * l.v) AS q
      FROM a JOIN n USING (lang, source) JOIN l USING (lang)),
s AS (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
d AS (SELECT x.lang, x.source, y.source AS item, coalesce(s.value, 0) AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source
      LEFT JOIN s ON s.lang = x.lang AND s.source = x.source AND s.item = y.source),
f AS (SELECT lang, source, 'pair' AS part, item, value FROM d UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE c > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM f)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""
