"""Registered queries of parsing, cleaning, chunking and retrieval; those that SQL can express have a twin."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import folding
from ..operators import chunking, parsing, pii
from ..operators import retrieval as R
from ..sources import tables
from .oracle import normalized


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.load(spark, sf_dir, "documents").select("doc_id", "text")


def _digest(c: str) -> F.Column:
    return F.md5(F.encode(F.col(c), "UTF-8")).alias("digest")


def line_id() -> F.Column:
    """An id of (doc_id, line) from 60 bits of its MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("line").cast("string"))), 1, 15), 16, 10).cast("long")


def _paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the documents as (vec_id, doc_id, section, text)."""
    lines = _docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text")).filter(F.trim("text") != "")
    return lines.select(line_id().alias("vec_id"), "doc_id", F.lit("").alias("section"), "text")


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def src_04_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-4 and SRC-6."""
    s = parsing.parse_html(tables.load(spark, sf_dir, "pages").select("page_id", "html"))
    return s.select("page_id", "section", "level", F.array_join("path", " > ").alias("path"), _digest("text"))


def src_05_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = parsing.parse_markdown(_docs(spark, sf_dir))
    return s.select("doc_id", "section", "level", "heading", _digest("text"))


def src_07_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.load(spark, sf_dir, "events").select("event_id", parsing.flatten_json("props").alias("lines"))


def txt_01_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).withColumn("text", folding.normalize_text("text")).select("doc_id", _digest("text"))


def txt_02_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).withColumn("text", folding.normalize_for_matching("text")).select("doc_id", _digest("text"))


def txt_04_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = folding.split_sentences(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", F.size(parts).cast("long").alias("sentences"), F.md5(F.encode(F.array_join(parts, "|"), "UTF-8")).alias("digest"))


def txt_06_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).withColumn("text", folding.truncate_to_tokens(F.col("text"), 128)).select("doc_id", _digest("text"))


def txt_14_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan_pii(_docs(spark, sf_dir))


def txt_15_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, _ = pii.apply_pii_policy(_docs(spark, sf_dir), "MASK", ("CREDIT_CARD",))
    return kept.select("doc_id", F.array_join("pii_kinds", ",").alias("pii_kinds"), _digest("text"))


def txt_16_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_summary(pii.scan_pii(_docs(spark, sf_dir)))


def _chunks(strategy: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk(_docs(spark, sf_dir), strategy).drop("text")


def chk_09_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations among parent and child chunks; none is right."""
    return chunking.check_chunks(chunking.chunk(_docs(spark, sf_dir), "PARENT_CHILD"))


def emb_01_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EMB-1 and EMB-9."""
    v = R.embed_distinct(_docs(spark, sf_dir))
    return v.select("doc_id", F.array_join(F.transform("embedding", lambda x: F.round(x, 6).cast("string")), ",").alias("vector"))


def ret_01_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.lexical_search(_asked(spark, sf_dir), _paragraphs(spark, sf_dir)).withColumn("score", F.round("score", 9))


def ret_02_trigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.trigram_search(_asked(spark, sf_dir), _paragraphs(spark, sf_dir)).withColumn("score", F.round("score", 6))


def ret_03_leg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.lexical_leg(_asked(spark, sf_dir), _paragraphs(spark, sf_dir)).withColumn("score", F.round("score", 9))


def ret_13_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RET-7, RET-8, RET-9 and RET-13."""
    found = R.retrieve(_asked(spark, sf_dir), _paragraphs(spark, sf_dir))
    return found.select("query_id", "vec_id", "final_rank", F.round("final_score", 6).alias("final_score"), _digest("text"))


def ret_12_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RET-10 and RET-12 over the trigram leg."""
    leg = R.trigram_search(_asked(spark, sf_dir), _paragraphs(spark, sf_dir), 10).withColumnRenamed("rank", "final_rank")
    return R.build_context(leg.join(_paragraphs(spark, sf_dir), "vec_id"), 100).select("query_id", "tokens", "chunks", "truncated", _digest("context"))


_CHUNKERS = {f"chk_{k:02}_{s.lower()}": partial(_chunks, s) for k, s in enumerate(chunking.STRATEGIES, 1)}
_FUNCTIONS = (
    src_04_html, src_05_markdown, src_07_json, txt_01_normalize, txt_02_fold, txt_04_sentences, txt_06_truncate, txt_14_pii, txt_15_mask, txt_16_summary,
    chk_09_check, emb_01_hash, ret_01_lexical, ret_02_trigram, ret_03_leg, ret_12_context, ret_13_retrieve,
)
QUERIES = {f.__name__: f for f in _FUNCTIONS} | _CHUNKERS

_LINES = r"""chunks AS (SELECT CAST('0x' || substr(md5(doc_id || ':' || (k - 1)), 1, 15) AS BIGINT) AS vec_id, p[k] AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS p
  FROM documents), unnest(range(1, len(p) + 1)) AS t(k) WHERE trim(p[k]) <> ''),
asked AS (SELECT item_id AS query_id, text AS query FROM benchmark)"""
_GRAMS = r"""list_distinct(flatten([[substr('  ' || w || ' ', k, 3) FOR k IN range(1,
  length(w) + 2)] FOR w IN regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')]))"""
SQL = {
    "src_07_json": "SELECT event_id, 'k: ' || (props ->> '$.k') AS lines FROM events",
    "txt_02_fold": r"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(replace(lower(strip_accents(text)), 'ß', 'ss'), '[^a-z0-9\s]+', ' ', 'g'), '\s+', ' ', 'g'))) AS digest
      FROM documents""",
    "txt_04_sentences": r"""WITH m AS (SELECT doc_id, regexp_replace(regexp_replace(text, '\b(Mr|Mrs|Dr|No|Inc|Ltd|Jan|Feb|e\.g|i\.e|vs|etc)([.!?。！？])(\s)', '\1\2' || chr(2) || '\3', 'g'), '(\d[.!?。！？])(\s)', '\1' || chr(2) || '\2', 'g') AS t
      FROM documents),
        s AS (SELECT doc_id, list_filter([replace(regexp_replace(x, '^\s+|\s+$', '', 'g'), chr(2), '') FOR x IN string_split(regexp_replace(t, '([.!?。！？])\s+', '\1' || chr(1), 'g'), chr(1))], lambda x: x <> '') AS p
          FROM m)
        SELECT doc_id, len(p) AS sentences, md5(coalesce(array_to_string(p, '|'), '')) AS digest FROM s""",
    "txt_01_normalize": f"SELECT doc_id, md5({normalized('text')}) AS digest FROM documents",
    "txt_06_truncate": r"""WITH h AS (SELECT doc_id, text, substr(text, 1, 512) AS head FROM documents),
        p AS (SELECT *, length(head) AS n, strpos(reverse(head), ' .') AS a, strpos(reverse(head), chr(10)) AS b, strpos(reverse(head), ' ') AS c FROM h),
        k AS (SELECT *, CASE WHEN a > 0 AND n - a - 1 > 0.6 * 512 THEN n - a WHEN b > 0 AND n - b > 0.6 * 512 THEN n - b + 1
          WHEN c > 0 AND n - c > 0.6 * 512 THEN n - c ELSE n END AS e FROM p)
        SELECT doc_id, md5(CASE
          WHEN floor(length(text) / 4.0::DOUBLE + 0.999::DOUBLE) <= 128 THEN text ELSE regexp_replace(substr(head, 1, CAST(e AS BIGINT)), '^\s+|\s+$', '', 'g') END) AS digest
          FROM k""",
    "chk_09_check": "SELECT '' AS chunk_id, '' AS violation WHERE false",
    "ret_02_trigram": f"""WITH {_LINES}, q AS (SELECT query_id, {_GRAMS.format("query")} AS g FROM asked),
      c AS (SELECT vec_id, {_GRAMS.format("text")} AS g FROM chunks),
        s AS (SELECT query_id, vec_id, len(list_intersect(q.g, c.g)) AS n, len(q.g) + len(c.g) AS m FROM q, c
          WHERE len(c.g) * 0.3 <= len(q.g) AND len(q.g) * 0.3 <= len(c.g)),
        r AS (SELECT query_id, vec_id, n::DOUBLE / (m - n) AS score FROM s WHERE n::DOUBLE / (m - n) > 0.3)
        SELECT query_id, vec_id,
          round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS INT) AS rank FROM r
          QUALIFY rank <= 50""",
}

_TERMS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"
#: Lines that hold all words of a question, with the sum over the shortest runs that hold them.
_COVERED = rf"""{_LINES},
q AS (SELECT query_id, unnest(list_distinct({_TERMS.format("query")})) AS term FROM asked),
n AS (SELECT query_id, count(*) AS n FROM q GROUP BY query_id),
w AS (SELECT vec_id, k AS pos, ws[k] AS term FROM (SELECT vec_id, {_TERMS.format("text")} AS ws FROM chunks), unnest(range(1, len(ws) + 1)) AS t(k)),
met AS (SELECT query_id, vec_id, term, pos FROM w JOIN q USING (term)),
whole AS (SELECT query_id, vec_id FROM met JOIN n USING (query_id) GROUP BY query_id, vec_id, n HAVING count(DISTINCT term) = n),
e AS (SELECT *, row_number() OVER (PARTITION BY query_id, vec_id ORDER BY pos) AS i FROM met SEMI JOIN whole USING (query_id, vec_id)),
ahead AS (SELECT a.query_id, a.vec_id, a.pos AS a, a.i, b.term, min(b.pos) AS p FROM e a JOIN e b ON a.query_id = b.query_id AND a.vec_id = b.vec_id
  AND b.pos >= a.pos GROUP BY ALL),
runs AS (SELECT query_id, vec_id, a, i, max(p) AS b FROM ahead JOIN n USING (query_id) GROUP BY query_id, vec_id, a, i, n HAVING count(*) = n),
least AS (SELECT query_id, vec_id, b, max(a) AS a, max(i) AS i FROM runs GROUP BY ALL),
dense AS (SELECT l.query_id, l.vec_id, round(sum(0.1::DOUBLE / (1 + (l.b - l.a) - (e.i - l.i))), 9) AS score FROM least l
  JOIN e ON e.query_id = l.query_id AND e.vec_id = l.vec_id AND e.pos = l.b GROUP BY ALL),
full_text AS (SELECT query_id, vec_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM dense
  QUALIFY rank <= 50)"""
SQL["ret_01_lexical"] = f"WITH {_COVERED} SELECT * FROM full_text"
SQL["ret_03_leg"] = f"""WITH {_COVERED},
gq AS (SELECT query_id, {_GRAMS.format("query")} AS g FROM asked ANTI JOIN full_text USING (query_id)),
  gc AS (SELECT vec_id, {_GRAMS.format("text")} AS g FROM chunks),
s AS (SELECT query_id, vec_id, len(list_intersect(gq.g, gc.g)) AS c, len(gq.g) + len(gc.g) AS m FROM gq, gc
  WHERE len(gc.g) * 0.3 <= len(gq.g) AND len(gq.g) * 0.3 <= len(gc.g)),
r AS (SELECT query_id, vec_id, round(c::DOUBLE / (m - c), 9) AS score FROM s WHERE c::DOUBLE / (m - c) > 0.3),
alike AS (SELECT query_id, vec_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM r QUALIFY rank <= 50)
SELECT * FROM full_text UNION ALL SELECT * FROM alike"""
