"""Registered queries of receipt signals, document search and vector checks, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chains, receipts
from ..operators import duplicates as U
from ..operators import library as L
from ..sources import tables
from .oracle import _FP, _ITEMS, _PAIRS, _VENDOR


def _receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints with a hash that stands for the receipt's image."""
    fp = U.with_keys(tables.fingerprints(spark, sf_dir))
    return fp.withColumn("image_hash", F.substring(F.md5(F.concat_ws("|", F.col("vendor"), F.col("amount_usd").cast("string"))), 1, 16))


def dup_04_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DUP-4 and DUP-7 over the candidates of DUP-1."""
    fp = _receipts(spark, sf_dir).select("item_id", "claim_id", "vendor", "merchant_vendor", "expense_date", "image_hash")
    return receipts.best_signals(fp)


def dup_10_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = receipts.multi_receipt(U.with_keys(tables.expense_items(spark, sf_dir)))
    return found.select("item_id", F.array_join(F.transform("parts", lambda x: x.cast("string")), ",").alias("parts"))


def dup_13_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DUP-11 and DUP-13."""
    out = receipts.scan_duplicates(_receipts(spark, sf_dir), parts=tables.task_count(spark, sf_dir))
    related = F.array_join(F.transform(F.array_sort("related"), lambda x: x.cast("string")), ",")
    return out.select("item_id", "exact", "invoice", "hash", "cross", "split", "near", "flags", related.alias("related"), "score", "verdict")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a policy library: languages are tenants, sources titles."""
    status = F.when(F.col("doc_id") % 5 == 0, "SUPERSEDED").when(F.col("doc_id") % 7 == 0, "ARCHIVED").otherwise("INDEXED")
    day = lambda n: F.date_add(F.lit("2026-01-01").cast("date"), n.cast("int"))
    return tables.load(spark, sf_dir, "documents").select(
        "doc_id", F.col("lang").alias("tenant"), F.col("source").alias("title"), F.col("doc_id").alias("version"), F.col("doc_id").alias("created_at"), status.alias("status"),
        F.when(F.col("doc_id") % 3 > 0, day(F.col("doc_id") % 100)).alias("effective_from"), F.when(F.col("doc_id") % 4 > 0, day(F.col("doc_id") % 200)).alias("effective_to"),
        "n_chars", F.when(F.col("n_chars") > 1000, "POLICY").when(F.col("n_chars") > 300, "NOTE").alias("source_type"),
        F.concat(F.lit('{"size":"'), F.when(F.col("n_chars") > 500, "big").otherwise("small"), F.lit('"}')).alias("extra"),
    )


_DOCS = """docs AS (SELECT doc_id, lang AS tenant, source AS title, CASE WHEN doc_id % 5 = 0 THEN 'SUPERSEDED'
  WHEN doc_id % 7 = 0 THEN 'ARCHIVED' ELSE 'INDEXED' END AS status,
  CASE WHEN doc_id % 3 > 0 THEN DATE '2026-01-01' + CAST(doc_id % 100 AS INTEGER) END AS f, CASE
    WHEN doc_id % 4 > 0 THEN DATE '2026-01-01' + CAST(doc_id % 200 AS INTEGER) END AS t, n_chars FROM documents)"""


_SUPERSEDES = """CASE WHEN doc_id % 300 = 0 THEN NULL WHEN doc_id % 97 = 5 THEN doc_id + 1000000000 WHEN doc_id % 129 = 7 THEN doc_id + 4
  ELSE doc_id - 1 END"""


def doc_03_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains across titles, with links to documents that are not there and with cycles."""
    docs = tables.load(spark, sf_dir, "documents").select("doc_id", F.expr(_SUPERSEDES).alias("supersedes_id"))
    return chains.version_chains(docs)


def doc_04_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOC-4 and DOC-5."""
    return L.search_documents(_documents(spark, sf_dir), on=F.lit("2026-03-01").cast("date"), tenant="en").select("doc_id", "status")


def doc_06_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = L.assign_profile(_documents(spark, sf_dir), {"POLICY": ("HYBRID", "policy"), "NOTE": ("RECURSIVE", "note")}, ("TOKEN", "general"))
    return out.select("doc_id", "strategy", "category")


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("event_type") == "error", "FAILED").when(F.col("event_type") == "view", "SKIPPED_DUPLICATE").otherwise("INDEXED")
    return tables.load(spark, sf_dir, "events").select(
        F.col("event_id").alias("run_id"), F.concat(F.lit("t"), (F.col("event_id") % 3).cast("string")).alias("tenant"), F.col("user_id").alias("doc_id"),
        status.alias("status"), F.col("ts").alias("started_at"), F.col("event_id").alias("finished_at"),
    )


def doc_09_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.ingestion_summary(_runs(spark, sf_dir))


def doc_09_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest failed runs of a tenant, and the three newest of each document."""
    runs = _runs(spark, sf_dir)
    failed = L.recent_runs(runs, "t1", status="FAILED", limit=50).select(F.lit("failed").alias("list"), "run_id", "doc_id", F.lit(0).alias("rank"))
    return failed.unionByName(L.runs_of_documents(runs, 3).select(F.lit("document").alias("list"), "run_id", "doc_id", "rank"))


def doc_10_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = [("tenant", "in", ["en", "de"]), ("type", "ne", "NOTE"), ("size", "gte", 50), ("from", "exists", True), ("extra.size", "eq", "big"), ("title", "contains", "RC1")]
    fields = {"tenant": "tenant", "type": "source_type", "size": "n_chars", "from": "effective_from", "title": "title"}
    return _documents(spark, sf_dir).filter(L.compile_filters(asked, fields, extra="extra")).select("doc_id")


def emb_10_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = tables.load(spark, sf_dir, "embeddings").select(
        "vec_id", F.when(F.col("label") % 2 == 0, "a").otherwise("").alias("spec"), F.when(F.col("vec_id") % 50 == 0, F.slice("embedding", 1, 60)).otherwise(F.col("embedding")).alias("embedding")
    )
    return L.check_vectors(v, 64)


def emb_11_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    usage = tables.load(spark, sf_dir, "events").select(
        F.col("event_type").alias("provider"), F.when(F.col("event_id") % 2 == 0, "small").otherwise("large").alias("model"),
        F.get_json_object("props", "$.k").cast("long").alias("tokens"), F.floor("value").cast("long").alias("latency_ms"), (F.col("value") > 100).alias("hit"),
    )
    prices = spark.createDataFrame([("view", "small", 0.5), ("view", "large", 2.0), ("click", "small", 0.25)], "provider string, model string, unit_price double")
    return L.usage_summary(usage, prices)


def pol_15_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as chunks, three to a page; the last of every ten is unpaged."""
    lines = tables.load(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("chunk_index", "text"))
    chunks = lines.select(
        "doc_id", "chunk_index", "text", F.when(F.col("chunk_index") % 10 < 9, F.floor(F.col("chunk_index") / 3).cast("int")).alias("page"),
        F.when(F.col("chunk_index") % 3 == 1, F.concat(F.lit("s"), F.col("chunk_index"))).otherwise("").alias("section"), F.lit("top").alias("heading_path"),
    )
    return L.pages_from_chunks(chunks).select("doc_id", "place", "page", F.md5(F.encode("text", "UTF-8")).alias("digest"), "hint")


_SCORED = f"""{_FP}, fq AS (SELECT *, substr(md5(vendor || '|' || CAST(amount_usd AS VARCHAR)), 1, 16) AS h FROM fp), {_PAIRS},
scored AS (SELECT p.item_id, CAST(a.checksum = b.checksum AS INT) AS exact, 1.0::DOUBLE - bit_count(xor(('0x' || a.h)::UBIGINT, ('0x' || b.h)::UBIGINT)) / 64.0::DOUBLE AS hash,
    CAST(a.vendor = b.vendor AND a.merchant_vendor <> b.merchant_vendor AS INT) AS alias,
    (0.35 * (a.vendor = b.vendor)::INT + 0.15 * (a.expense_date = b.expense_date)::INT + 0.15 * (abs(a.amount_usd - b.amount_usd) <= 0.01)::INT
      + CASE WHEN a.invoice_number IS NOT NULL
        AND b.invoice_number IS NOT NULL THEN 0.35 * (lower(trim(a.invoice_number)) = lower(trim(b.invoice_number)))::INT ELSE 0 END)::DOUBLE
      / CASE WHEN a.invoice_number IS NOT NULL AND b.invoice_number IS NOT NULL THEN 1.0 ELSE 0.65 END AS invoice
  FROM pairs p JOIN fq a ON p.item_id = a.item_id JOIN fq b ON p.other_id = b.item_id),
best AS (SELECT item_id, max(exact) AS exact, round(max(invoice), 6) AS invoice, max(hash) AS hash, max(alias) AS alias FROM scored GROUP BY item_id)"""
_SETS = """sets AS (SELECT bits, ks, list_max(ks) AS m FROM (SELECT bits, [k FOR k IN range(1, 13) IF (bits >> (k - 1)) & 1 = 1] AS ks
  FROM range(3, 4096) AS t(bits) WHERE bit_count(bits) > 1))"""
_HIT = """hit AS (SELECT item_id, ids, ks FROM sib, sets WHERE m <= len(c) AND abs(list_sum([c[k] FOR k IN ks]) - cents) <= 1
  QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY len(ks), ks) = 1)"""
SQL = {
    "dup_04_signals": f"WITH {_SCORED} SELECT item_id, hash, alias FROM best",
    "dup_13_scan": f"""WITH {_SCORED},
        crossed AS (SELECT a.item_id, min(b.item_id) AS other FROM fp a JOIN fp b USING (vendor, expense_date)
          WHERE a.employee_id <> b.employee_id AND abs(a.amount_usd - b.amount_usd) <= 0.01 GROUP BY a.item_id HAVING min(b.item_id) < a.item_id),
        sib AS (SELECT a.item_id, CAST(any_value(a.amount_usd) * 100 AS BIGINT) AS cents, list(CAST(b.amount_usd * 100 AS BIGINT) ORDER BY b.expense_date, b.item_id)[1:12] AS c,
            list(b.item_id ORDER BY b.expense_date, b.item_id)[1:12] AS ids
          FROM fp a JOIN fp b ON a.employee_id = b.employee_id AND a.vendor = b.vendor AND abs(a.expense_date - b.expense_date) <= 7
            AND b.item_id < a.item_id GROUP BY a.item_id HAVING count(*) > 1),
        {_SETS}, {_HIT},
        split AS (SELECT item_id, [ids[k] FOR k IN ks] AS parts FROM hit),
        same AS (SELECT p.item_id, min(p.other_id) AS other FROM pairs p JOIN fp a ON p.item_id = a.item_id JOIN fp b ON p.other_id = b.item_id
          WHERE a.checksum = b.checksum GROUP BY p.item_id),
        j AS (SELECT item_id, CAST(exact AS DOUBLE) AS exact, invoice,
          round(hash, 6) AS hash, (crossed.other IS NOT NULL)::INT::DOUBLE AS "cross", (parts IS NOT NULL)::INT::DOUBLE AS split,
            array_to_string(list_sort(list_distinct(list_concat(list_filter([same.other, crossed.other], lambda x: x IS NOT NULL), coalesce(parts, [])))), ',') AS related
          FROM best FULL JOIN crossed USING (item_id) FULL JOIN split USING (item_id) LEFT JOIN same USING (item_id)),
        n AS (SELECT *, CASE WHEN exact = 1 THEN NULL WHEN greatest(hash, invoice) >= 0.8::DOUBLE THEN greatest(hash, invoice)
          WHEN greatest(hash, invoice) IS NOT NULL THEN 0.0::DOUBLE END AS near FROM j),
        s AS (SELECT *, concat_ws(',', CASE WHEN exact = 1 THEN 'EXACT' END, CASE WHEN hash >= 0.9::DOUBLE THEN 'IMAGE' END, CASE
          WHEN invoice >= 0.9::DOUBLE THEN 'INVOICE' END,
            CASE WHEN "cross" = 1 THEN 'CROSS_EMPLOYEE' END, CASE WHEN split = 1 THEN 'MULTI_RECEIPT' END) AS flags,
          round(greatest(CASE WHEN exact = 1 OR "cross" = 1 OR split = 1 THEN 1.0::DOUBLE END, CASE WHEN invoice >= 0.9::DOUBLE THEN invoice END, CASE
            WHEN hash >= 0.9::DOUBLE THEN hash END,
            CASE WHEN near > 0 THEN near END, 0.0::DOUBLE), 6) AS score FROM n)
        SELECT *, CASE WHEN score >= 0.95 THEN 'CONFIRMED' WHEN score >= 0.75 THEN 'LIKELY'
          WHEN score > 0 THEN 'POSSIBLE' ELSE 'NO_MATCH' END AS verdict FROM s""",
    "dup_10_multi": f"""WITH {_ITEMS}, k AS (SELECT *, {_VENDOR} AS vendor FROM items),
        sib AS (SELECT a.item_id, CAST(any_value(a.amount_usd) * 100 AS BIGINT) AS cents, list(CAST(b.amount_usd * 100 AS BIGINT) ORDER BY b.expense_date, b.item_id)[1:12] AS c,
            list(b.item_id ORDER BY b.expense_date, b.item_id)[1:12] AS ids
          FROM k a JOIN k b ON a.employee_id = b.employee_id AND a.vendor = b.vendor AND abs(a.expense_date - b.expense_date) <= 7
            AND b.item_id <> a.item_id GROUP BY a.item_id HAVING count(*) > 1),
        {_SETS}, {_HIT}
        SELECT item_id, array_to_string([ids[k] FOR k IN ks], ',') AS parts FROM hit""",
    "doc_03_chain": f"""WITH RECURSIVE l AS (SELECT doc_id, {_SUPERSEDES} AS up FROM documents),
      s AS (SELECT l.doc_id, d.doc_id AS up FROM l LEFT JOIN documents d ON d.doc_id = l.up),
      c AS (SELECT doc_id, doc_id AS here, [doc_id] AS seen FROM s
        UNION ALL SELECT c.doc_id, s.up, list_append(seen, s.up) FROM c JOIN s ON s.doc_id = c.here WHERE s.up IS NOT NULL AND NOT list_contains(seen, s.up))
      SELECT c.doc_id, CAST(max(len(seen)) AS BIGINT) AS place, arg_max(here, len(seen)) AS oldest, arg_max(s.up IS NOT NULL, len(seen)) AS cyclic
      FROM c JOIN s ON s.doc_id = c.here GROUP BY c.doc_id""",
    "doc_04_search": f"""WITH {_DOCS} SELECT doc_id, status FROM docs
      WHERE status = 'INDEXED' AND tenant = 'en' AND coalesce(f <= DATE '2026-03-01', true) AND coalesce(t >= DATE '2026-03-01', true)""",
    "doc_06_profile": """SELECT doc_id, CASE WHEN n_chars > 1000 THEN 'HYBRID' WHEN n_chars > 300 THEN 'RECURSIVE' ELSE 'TOKEN' END AS strategy, CASE
      WHEN n_chars > 1000 THEN 'policy' WHEN n_chars > 300 THEN 'note' ELSE 'general' END AS category FROM documents""",
    "doc_09_ledger": """WITH r AS (SELECT CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'view' THEN 'SKIPPED_DUPLICATE' ELSE 'INDEXED' END AS status, event_id
      FROM events) SELECT status, count(*) AS runs, max(event_id) AS last, status <> 'FAILED' AS succeeded FROM r GROUP BY status""",
    "doc_09_recent": """WITH r AS (SELECT event_id AS run_id, 't' || event_id % 3 AS tenant, user_id AS doc_id, event_type, ts FROM events),
      f AS (SELECT 'failed' AS list, run_id, doc_id, 0 AS rank FROM r WHERE tenant = 't1' AND event_type = 'error' ORDER BY ts DESC, run_id LIMIT 50)
      SELECT * FROM f UNION ALL SELECT 'document', run_id, doc_id, CAST(row_number() OVER (PARTITION BY tenant, doc_id ORDER BY ts DESC, run_id) AS INT) AS rank FROM r
      QUALIFY rank <= 3""",
    "doc_10_filters": f"""WITH {_DOCS} SELECT doc_id FROM docs
      WHERE tenant IN ('en', 'de') AND NOT coalesce(n_chars > 300 AND n_chars <= 1000, false) AND f IS NOT NULL AND n_chars > 500 AND contains(lower(title), 'rc1')""",
    "emb_10_check": """WITH v AS (SELECT vec_id, label % 2 AS odd, CASE WHEN vec_id % 50 = 0 THEN embedding[1:60] ELSE embedding END AS e FROM embeddings),
        c AS (SELECT vec_id, CASE WHEN odd = 0 THEN 'a' ELSE '' END AS spec, concat_ws(',', CASE WHEN len(e) <> 64 THEN 'WIDTH' END, CASE
          WHEN odd <> 0 THEN 'NO_SPEC' END,
          CASE WHEN abs(sqrt(list_dot_product(CAST(e AS DOUBLE[]), CAST(e AS DOUBLE[]))) - 1) > 1e-4 THEN 'NOT_UNIT' END, CASE
            WHEN count(*) OVER (PARTITION BY vec_id, odd) > 1 THEN 'REPEATED' END) AS faults FROM v)
        SELECT * FROM c WHERE faults <> ''""",
    "emb_11_usage": """WITH u AS (SELECT event_type AS provider, CASE
      WHEN event_id % 2 = 0 THEN 'small' ELSE 'large' END AS model, CAST(props ->> '$.k' AS BIGINT) AS k, CAST(floor(value) AS BIGINT) AS ms, value > 100 AS hit
      FROM events)
        SELECT provider, model, count(*) AS calls, CAST(sum(k) AS BIGINT) AS tokens, CAST(sum(ms) AS BIGINT) AS latency_ms,
          count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses,
          CAST(sum(k) AS DOUBLE) * CASE WHEN provider = 'view' AND model = 'small' THEN 0.5 WHEN provider = 'view' THEN 2.0
            WHEN provider = 'click' AND model = 'small' THEN 0.25 ELSE 0 END::DOUBLE AS cost FROM u GROUP BY provider, model""",
    "pol_15_pages": """WITH l AS (SELECT doc_id, k - 1 AS i, p[k] AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS p
      FROM documents), unnest(range(1, len(p) + 1)) AS t(k)),
        g AS (SELECT doc_id, CASE WHEN i % 10 < 9 THEN CAST(floor(i / 3) AS INT) END AS page, string_agg(text, chr(10) ORDER BY i) AS t,
          min(i) FILTER (i % 3 = 1) AS s FROM l GROUP BY ALL)
        SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page NULLS LAST) AS INT) AS place, page, md5(t) AS digest, coalesce('s' || s, 'top') AS hint
          FROM g""",
}
QUERIES = (dup_04_signals, dup_10_multi, dup_13_scan, doc_03_chain, doc_04_search, doc_06_profile, doc_09_ledger, doc_09_recent, doc_10_filters, emb_10_check, emb_11_usage, pol_15_pages)
