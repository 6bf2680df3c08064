"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import block_naming, filter_audit, hard_negatives, license_scan, lm_scoring, mixing, packing, quality_rules, simhash, suffix_dedup, token_files, toxicity, warc
from .common import documents


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(documents(spark, sf_dir))


def op3_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derive(warc.responses_of_pages(spark.read.parquet(f"{sf_dir}/pages.parquet")))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(documents(spark, sf_dir))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(documents(spark, sf_dir)).drop("spans")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_naming.exact_groups(documents(spark, sf_dir))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(documents(spark, sf_dir))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(documents(spark, sf_dir))


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.encoded_documents(documents(spark, sf_dir))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (
        op1_best_fit_packing,
        op2_license_scan,
        op3_warc_derivatives,
        op4_source_mixing,
        op5_simhash_near_dedup,
        op6_suffix_dedup,
        op7_exact_dedup,
        op8_toxicity,
        op9_lm_scoring,
        op10_quality_rules,
        op11_token_files,
        op12_hard_negatives,
        op13_filter_audit,
    )
    return {f.__name__: f for f in named}


_SPACE = r"[\x20\x09-\x0D]"
_WORD = r"[^\x20\x09-\x0D]+"

OP4_SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS BIGINT) AS size
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM sized GROUP BY source),
level AS (
  SELECT *, 3 * source_size AS cap, 3 * source_size / weight AS level, sum(source_size) OVER () AS total FROM sources),
filled AS (
  SELECT *, sum(cap) OVER (ORDER BY level RANGE UNBOUNDED PRECEDING)
            + level * (sum(weight) OVER () - sum(weight) OVER (ORDER BY level RANGE UNBOUNDED PRECEDING)) <= total AS is_full
  FROM level),
targets AS (
  SELECT source, source_size, is_full,
         CASE WHEN is_full THEN CAST(cap AS DOUBLE)
              ELSE (total - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER ())
                   / sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER () * weight END AS target
  FROM filled),
rates AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0.0::DOUBLE WHEN is_full THEN 3.0::DOUBLE ELSE least(target / source_size, 3.0::DOUBLE) END AS rate FROM targets),
draws AS (
  SELECT d.doc_id, d.size, r.source_size, r.target, r.rate,
         list_reduce(list_transform(string_split(substr(md5('{mixing.SEED}:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null')), 1, 13), ''),
                                    lambda c: CAST(strpos('0123456789abcdef', c) - 1 AS BIGINT)),
                     lambda a, b: a * 16 + b) / 4503599627370496.0::DOUBLE AS draw
  FROM sized d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target,
       CAST(floor(rate) AS BIGINT) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END AS copies,
       size * (CAST(floor(rate) AS BIGINT) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) AS taken
FROM draws
"""

OP7_SQL = rf"""
WITH bare AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '{_SPACE}+', '', 'g') AS bare FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY bare ORDER BY n DESC, doc_id NULLS LAST) AS keep_id,
       count(*) OVER (PARTITION BY bare) AS group_size,
       row_number() OVER (PARTITION BY bare ORDER BY n DESC, doc_id NULLS LAST) = 1 AS kept,
       sha256(bare) AS text_sha256
FROM bare
"""


def _op10_sql() -> str:
    stop = ", ".join(f"'{w}'" for w in sorted(set(quality_rules.STOP_WORDS)))
    measures = {r.name: r for r in quality_rules.RULES}
    broken = []
    for name, rule in measures.items():
        tests = [f"({rule.measure}) < {rule.low}"] * (rule.low is not None) + [f"({rule.measure}) > {rule.high}"] * (rule.high is not None)
        broken.append(f"CASE WHEN {' OR '.join(tests)} THEN '{name}' END".replace("if(", "if("))
    return rf"""
WITH split AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines
  FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(words[i:i + 4], ' ') AS w
  FROM split, unnest(range(1, greatest(len(words) - 3, 1))) AS t(i)),
repeated AS (
  SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, w) > 1),
covered AS (
  SELECT doc_id, CAST(sum(least(5, coalesce(nxt - i, 5))) AS BIGINT) AS n
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM repeated) GROUP BY doc_id),
measured AS (
  SELECT s.doc_id, len(words) AS n_words, length(regexp_replace(text, '{_SPACE}+', '', 'g')) AS word_chars,
         CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         coalesce(c.n, 0) AS n_repeat_words, CAST(len(lines) AS BIGINT) AS n_lines,
         CAST(len(list_filter(words, lambda x: lower(x) IN ({stop}))) AS BIGINT) AS n_stop_words
  FROM split s LEFT JOIN covered c ON s.doc_id = c.doc_id),
judged AS (SELECT *, concat_ws(',', {", ".join(broken)}) AS failed_rules FROM measured)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_stop_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, failed_rules = '' AS kept, failed_rules
FROM judged
"""


OP12_SQL = """
WITH vectors AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM vectors a JOIN vectors b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank,
       id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scored s ON p.anchor_id = s.anchor_id AND NOT s.same
WHERE 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) <= 5
"""

OP13_SQL = rf"""
WITH named AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '{_WORD}') AS words
  FROM documents),
said AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
failing AS (
  SELECT n.doc_id, part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         CASE WHEN len(words) < 50 THEN 'A' ELSE '' END
         || CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 'B' ELSE '' END
         || CASE WHEN 100 * len(regexp_extract_all(text, '[A-Z]')) > 5 * length(text) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
         || CASE WHEN n.doc_id > min(n.doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END AS fails
  FROM named n LEFT JOIN said s ON n.doc_id = s.doc_id),
cells AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM failing GROUP BY part, fails),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
steps AS (
  SELECT filter_order, CAST(k AS INTEGER) AS step, substr(filter_order, k, 1) AS letter, substr(filter_order, 1, k - 1) AS earlier
  FROM orders, range(1, 6) AS t(k)),
crossed AS (
  SELECT part, filter_order, step, letter, n, good, toxic, fails,
         contains(fails, letter) AS fails_it,
         len(list_filter(string_split(earlier, ''), lambda x: x <> '' AND contains(fails, x))) > 0 AS gone
  FROM cells, steps),
counted AS (
  SELECT part, filter_order, step, letter,
         CAST(coalesce(sum(n) FILTER (NOT gone AND NOT fails_it), 0) AS BIGINT) AS kept,
         CAST(coalesce(sum(n) FILTER (NOT gone AND fails_it), 0) AS BIGINT) AS removed,
         CAST(coalesce(sum(n) FILTER (gone AND fails_it), 0) AS BIGINT) AS redundant,
         CAST(coalesce(sum(n) FILTER (fails = letter), 0) AS BIGINT) AS unique_fails,
         CAST(coalesce(sum(good) FILTER (NOT gone AND fails_it), 0) AS BIGINT) AS good_lost,
         CAST(coalesce(sum(toxic) FILTER (NOT gone AND fails_it), 0) AS BIGINT) AS toxic_lost
  FROM crossed GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM counted
"""


def oracle_sql() -> dict[str, str]:
    return {"op12_hard_negatives": OP12_SQL, "op13_filter_audit": OP13_SQL, "op4_source_mixing": OP4_SQL, "op7_exact_dedup": OP7_SQL, "op10_quality_rules": _op10_sql()}
