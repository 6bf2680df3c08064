"""Registered queries of claims, travel rules and submissions, each beside its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import claims as C
from ..operators import submission as S
from ..operators import travel
from ..sources import tables

_ITEMS = f"items AS ({tables.items_sql('duckdb')})"
_HISTORY = f"history AS ({tables.history_sql('duckdb')})"
_CLAIMS = """claims AS (
  SELECT o_orderkey AS claim_id, CAST(floor(o_custkey / 10) AS BIGINT) AS employee_id, DATE '2026-01-01' + CAST((CAST(o_orderdate AS DATE) - DATE '1995-01-01') % 180 AS INTEGER) AS submission_date,
    CASE o_orderstatus WHEN 'F' THEN 'Approved' WHEN 'O' THEN 'Manager_Review' ELSE 'Submitted' END AS status, CASE
      WHEN o_custkey % 3 = 0 THEN o_custkey % 7 END AS reviewer_id FROM orders)"""


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "Approved").when(F.col("o_orderstatus") == "O", "Manager_Review").otherwise("Submitted")
    day = (F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date")) % 180).cast("int")
    return tables.load(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("claim_id"), F.floor(F.col("o_custkey") / 10).cast("long").alias("employee_id"), F.date_add(F.lit("2026-01-01").cast("date"), day).alias("submission_date"),
        status.alias("status"), F.when(F.col("o_custkey") % 3 == 0, F.col("o_custkey") % 7).alias("reviewer_id"),
    )


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.load(spark, sf_dir, "events")


def pol_14_travel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """POL-13 and POL-14."""
    bands = F.create_map(*[F.lit(x) for pair in travel.BANDS.items() for x in pair])
    items = tables.expense_items(spark, sf_dir).select(
        "item_id", "category", F.when(F.col("receipt_attached"), "Local").alias("travel_type"), bands[F.col("employee_grade")].alias("grade_band"),
        F.when(F.col("line_number") % 3 == 0, "Week").otherwise("Day").alias("duration"), F.col("amount_usd").cast("double").alias("amount"),
        F.when(F.col("status") == "Rejected", "USD").otherwise("INR").alias("currency"),
    )
    return travel.evaluate_travel_policy(items, travel.seed_travel_rules(spark))


def _travel_sql() -> str:
    rules = [f"('LOCAL_TAXI_{b[-1]}', 'Taxi / Cab / Ride-hailing', '{b}', {x}::DOUBLE)" for b, x in travel.TAXI_CAPS.items()]
    rules += [f"('LOCAL_MEAL_{b[-1]}', 'Meals', '{b}', {x}::DOUBLE)" for b, x in travel.MEAL_CAPS.items()]
    bands = " ".join(f"WHEN '{g}' THEN '{b}'" for g, b in travel.BANDS.items())
    return f"""WITH {_ITEMS}, caps(code, category, band, cap) AS (VALUES {", ".join(rules)}),
        i AS (SELECT *,
          CASE employee_grade {bands} END AS band, line_number % 3 <> 0 AS day, CAST(amount_usd AS DOUBLE) AS amount, status = 'Rejected' AS usd
          FROM items),
        m AS (SELECT i.*, CASE WHEN receipt_attached AND i.category = 'Hotel / Lodging' THEN 'LOCAL_HOTEL_PROHIBITED'
          WHEN receipt_attached AND day AND c.code IS NOT NULL THEN c.code ELSE 'UNSCOPED_CAP' END AS code,
              CASE WHEN receipt_attached AND day AND c.code IS NOT NULL THEN c.cap ELSE 400.0::DOUBLE END AS cap FROM i LEFT
                JOIN caps c ON i.category = c.category AND i.band = c.band),
        j AS (SELECT *, code = 'LOCAL_HOTEL_PROHIBITED' AS banned, code <> 'LOCAL_HOTEL_PROHIBITED' AND NOT usd AND amount > cap AS over_cap FROM m)
        SELECT item_id, NOT (banned OR over_cap) AS passed, banned OR over_cap OR usd AS manual_review,
          CASE WHEN banned THEN 0.0::DOUBLE WHEN usd THEN amount ELSE least(amount, cap) END AS eligible,
          code || CASE WHEN banned OR over_cap THEN '-' WHEN usd THEN '_CURRENCY_MISMATCH+' ELSE '+' END AS checks FROM j"""


def lif_10_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = C.search_claims(
        _claims(spark, sf_dir), tables.expense_items(spark, sf_dir), statuses=["Approved", "Manager_Review"], category="Meals", date_from="2026-02-01", date_to="2026-04-30"
    )
    return found.select("claim_id", "employee_id", "submission_date", "status")


def lif_11_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    staff = tables.load(spark, sf_dir, "customer").select(F.floor(F.col("c_custkey") / 10).cast("long").alias("employee_id")).distinct()
    return C.scope_claims(_claims(spark, sf_dir), staff.withColumn("manager_id", F.floor(F.col("employee_id") / 10).cast("long")))


def lif_12_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.review_queue(_claims(spark, sf_dir), 3).select("claim_id", "submission_date", "reviewer_id")


def lif_13_workflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = F.create_map(F.lit("F"), F.lit(2), F.lit("P"), F.lit(1), F.lit("O"), F.lit(0))[F.col("o_orderstatus")]
    steps = tables.load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("claim_id"), F.col("o_orderkey").alias("workflow_id"), done.alias("done"), F.explode(F.array(F.lit(1), F.lit(2))).alias("step_order"))
    return C.workflow_state(steps.withColumn("step_status", F.when(F.col("step_order") <= F.col("done"), "DONE").otherwise("PENDING")))


def lif_14_finance_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moves of the ledger into 'Flagged_Fraud' stand for rejections."""
    history = tables.status_history(spark, sf_dir)
    return C.finance_rejected(history.withColumn("to_status", F.when(F.col("to_status") == "Flagged_Fraud", "Rejected").otherwise(F.col("to_status"))))


def lif_16_tabs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.text_filter(C.claim_tabs(_claims(spark, sf_dir)), "PROV", ["status"]).select("claim_id", "in_approvals", "in_disbursements")


def lif_17_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations are comments, every third turn an internal one; events are verdicts; receipts are attachments."""
    items = tables.expense_items(spark, sf_dir)
    comments = tables.load(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("claim_id"), F.col("turn").alias("created_at"), F.col("role").alias("author"), F.md5("text").alias("body"), (F.col("turn") % 3 == 2).alias("is_internal")
    )
    verdicts = _events(spark, sf_dir).select(
        F.col("user_id").alias("claim_id"), F.col("event_id").alias("id"), F.col("ts").alias("evaluated_at"), F.col("event_id").alias("created_at"),
        F.floor("value").cast("int").alias("risk_score"), F.col("event_type").alias("risk_level"), (F.col("value") > 50).alias("is_flagged"),
    )
    attached = items.filter("receipt_attached").select("claim_id", F.col("line_number").alias("created_at"), F.col("item_id").alias("file_name"), F.lit("").alias("checksum"))
    docs = C.claim_documents(_claims(spark, sf_dir), items, tables.status_history(spark, sf_dir), comments, attachments=attached, fraud=verdicts)
    joined = lambda name, value, by: F.array_join(F.transform(name, value), by)
    return docs.select(
        "claim_id", joined("items", lambda x: x["item_id"].cast("string"), ",").alias("item_ids"), joined("history", lambda x: x["to_status"], ">").alias("moves"),
        joined("comments", lambda x: F.concat_ws(":", x["author"], x["body"]), ",").alias("comments"), joined("attachments", lambda x: x["file_name"].cast("string"), ",").alias("files"),
        F.col("fraud.risk_level").alias("risk_level"), F.col("fraud.is_flagged").alias("is_flagged"),
    )


def _logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select(
        "event_id", F.col("event_type").alias("action"), F.when(F.col("user_id") % 2 == 0, "claim").otherwise("expense_item").alias("entity_type"), F.col("user_id").alias("entity_id"),
        (F.col("event_id") % 10).alias("actor"), F.concat(F.lit("req-"), (F.col("event_id") % 7).cast("string")).alias("correlation_id"), F.col("ts").alias("occurred_at"),
    )


def aud_01_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.search_audit(_logs(spark, sf_dir), entity_type="claim", actions=["error", "purchase"], actor=3, correlation_id="req-2")


def aud_01_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.count_audit(_logs(spark, sf_dir))


def aud_03_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's properties against those of the user's event before."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    return C.audit_changes(_events(spark, sf_dir).select("event_id", F.lag("props").over(w).alias("before"), F.col("props").alias("after")))


def _inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select(
        F.col("event_id").alias("run_id"), F.col("user_id").alias("claim_id"), (F.col("event_id") % 1000).alias("item_id"), F.col("ts").alias("created_at"),
        F.col("event_type").alias("operation"), F.when(F.col("value") > 100, "SLOW").otherwise("OK").alias("status"),
        F.get_json_object("props", "$.k").cast("long").alias("tokens"), F.floor("value").cast("long").alias("latency_ms"),
    )


def aud_04_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.inference_summary(_inference(spark, sf_dir))


def aud_04_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest runs of each claim, item and operation, and those of one claim."""
    runs, out = _inference(spark, sf_dir), None
    for name, n in (("claim_id", 5), ("item_id", 3), ("operation", 20)):
        one = C.newest_inference(runs, [name], n).select(F.lit(name).alias("list"), "run_id", "rank")
        out = one if out is None else out.unionByName(one)
    return out.unionByName(C.recent_inference(runs, claim_id=7, operation="error", limit=10).select(F.lit("of 7").alias("list"), "run_id", F.lit(0).alias("rank")))


def aud_06_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events as a tree: event n under event n / 2."""
    n = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    spans = _events(spark, sf_dir).select(F.col("user_id").alias("trace_id"), n.alias("span_id"))
    return C.flatten_spans(spans.withColumn("parent_id", F.when(F.col("span_id") > 1, F.floor(F.col("span_id") / 2).cast("long"))))


def sub_03_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejected items with their reasons."""
    items = tables.expense_items(spark, sf_dir).withColumns({
        "currency": F.when(F.col("line_number") == 5, "US").when(F.col("line_number") != 4, "INR"),
        "attendees_required": F.col("category") == "Client / Business Entertainment",
    })
    _, rejected = S.validate_items(items, F.lit("2026-04-01").cast("date"))
    return rejected.select("item_id", F.array_join("reasons", ",").alias("reasons"))


def sub_04_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.stale_items(tables.expense_items(spark, sf_dir), F.lit("2026-04-01").cast("date")).select("item_id", "age_days", "is_stale")


def sub_05_custom_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three fields of every item against a schema; one field is unknown."""
    pairs = F.array(
        F.struct(F.lit("grade").alias("field"), F.col("employee_grade").alias("raw")),
        F.struct(F.lit("paid").alias("field"), F.when(F.col("has_pre_approval"), "Yes").otherwise("maybe").alias("raw")),
        F.struct(F.lit("note").alias("field"), F.col("invoice_number").alias("raw")),
        F.struct(F.lit("size").alias("field"), F.col("amount_usd").cast("string").alias("raw")),
    )
    values = tables.expense_items(spark, sf_dir).select("item_id", "category", F.explode(pairs).alias("p")).select("item_id", "category", "p.field", "p.raw")
    schema = spark.createDataFrame(
        [("Meals", "grade", "enum", ["L1", "L2"]), (None, "paid", "boolean", None), (None, "grade", "text", None), ("Meals", "size", "number", None)],
        "category string, field string, kind string, choices array<string>",
    )
    return S.coerce_custom_fields(values, F.broadcast(schema)).select("item_id", "field", F.when(F.col("field") != "size", F.col("value")).alias("value"), "dropped")  # four rows


def sub_06_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = tables.expense_items(spark, sf_dir).select(
        "item_id", "category", F.when(F.col("line_number") % 3 == 0, F.upper("category")).when(F.col("line_number") % 3 == 1, " meals ").otherwise("Unknown").alias("predicted"),
        (F.col("line_number") / 10).alias("confidence"),
    )
    names = ["Meals", "Taxi / Cab / Ride-hailing", "Air Travel", "Hotel / Lodging", "Client / Business Entertainment"]
    return S.classification_outcome(df, names).select("item_id", "matched", "mismatch", "needs_review")


def sub_08_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = S.extraction_text([("Vendor", "merchant_vendor"), ("Invoice", "invoice_number"), ("Total", "amount_usd"), ("Attendees", "attendees")])
    return tables.expense_items(spark, sf_dir).select("item_id", made.alias("text"))


def sub_09_outside(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = _claims(spark, sf_dir).select("claim_id", F.date_sub("submission_date", 60).alias("date_from"), F.date_sub("submission_date", 5).alias("date_to"))
    items = tables.expense_items(spark, sf_dir).select("item_id", "claim_id", "expense_date", (F.col("line_number") % 4).alias("days"))
    return S.items_outside_claim(items, claims).select("item_id", "last_day", "date_from", "date_to")


SQL = {
    "pol_14_travel": _travel_sql(),
    "lif_10_search": f"""WITH {_ITEMS}, {_CLAIMS} SELECT claim_id, employee_id, submission_date, status FROM claims c
      WHERE status IN ('Approved', 'Manager_Review')
        AND EXISTS (FROM items i WHERE i.claim_id = c.claim_id AND category = 'Meals') AND EXISTS (FROM items i
          WHERE i.claim_id = c.claim_id AND expense_date >= DATE '2026-02-01')
        AND EXISTS (FROM items i WHERE i.claim_id = c.claim_id AND expense_date <= DATE '2026-04-30')""",
    "lif_11_scope": f"""WITH {_CLAIMS}, staff AS (SELECT DISTINCT CAST(floor(c_custkey / 10) AS BIGINT) AS employee_id FROM customer)
        SELECT claim_id, employee_id AS actor_id, 'own' AS access FROM claims
        UNION ALL SELECT claim_id, CAST(floor(employee_id / 10) AS BIGINT), 'report' FROM claims JOIN staff USING (employee_id)
          WHERE CAST(floor(employee_id / 10) AS BIGINT) <> employee_id""",
    "lif_12_queue": f"""WITH {_CLAIMS} SELECT claim_id, submission_date, reviewer_id FROM claims
      WHERE status = 'Manager_Review' AND (reviewer_id IS NULL OR reviewer_id = 3)""",
    "lif_13_workflow": """WITH w AS (SELECT o_custkey AS claim_id, o_orderkey AS workflow_id,
      CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'P' THEN 1 WHEN 'O' THEN 0 END AS done FROM orders)
        SELECT claim_id, workflow_id, CASE
          WHEN done < 2 THEN CAST(done + 1 AS INT) END AS current_step, 2::BIGINT AS steps, (2 - done)::BIGINT AS open_steps, done = 2 AS completed,
          coalesce(workflow_id = max(workflow_id) FILTER (done < 2) OVER (PARTITION BY claim_id), false) AS is_active FROM w""",
    "lif_14_finance_rejected": f"""WITH {_HISTORY}, r AS (SELECT claim_id, arg_max(actor_role, sequence) AS role FROM history
      WHERE to_status = 'Flagged_Fraud' GROUP BY claim_id) SELECT *, role = 'finance' AS by_finance FROM r""",
    "lif_16_tabs": f"WITH {_CLAIMS} SELECT claim_id, false AS in_approvals, true AS in_disbursements FROM claims WHERE status = 'Approved'",
    "lif_17_documents": f"""WITH {_ITEMS}, {_HISTORY}, i AS (SELECT claim_id, string_agg(item_id, ',' ORDER BY line_number) AS item_ids FROM items
      GROUP BY claim_id),
        h AS (SELECT claim_id, string_agg(to_status, '>' ORDER BY sequence) AS moves FROM history GROUP BY claim_id),
        c AS (SELECT conv_id AS claim_id, string_agg(role || ':' || md5(text), ',' ORDER BY turn) AS comments FROM conversations WHERE turn % 3 <> 2
          GROUP BY conv_id),
        f AS (SELECT claim_id, string_agg(item_id, ',' ORDER BY line_number) AS files FROM items WHERE receipt_attached GROUP BY claim_id),
        v AS (SELECT user_id AS claim_id, arg_max(event_type, (ts, event_id)) AS risk_level, arg_max(value > 50, (ts, event_id)) AS is_flagged
          FROM events GROUP BY user_id)
        SELECT o_orderkey AS claim_id, item_ids, moves, comments, files, risk_level, is_flagged FROM orders LEFT JOIN i ON i.claim_id = o_orderkey
          LEFT JOIN h ON h.claim_id = o_orderkey
        LEFT JOIN c ON c.claim_id = o_orderkey LEFT JOIN f ON f.claim_id = o_orderkey LEFT JOIN v ON v.claim_id = o_orderkey""",
    "aud_01_search": """SELECT event_id, event_type AS action, 'claim' AS entity_type, user_id AS entity_id, event_id % 10 AS actor, 'req-2' AS correlation_id, ts AS occurred_at FROM events
      WHERE event_type IN ('error', 'purchase') AND event_id % 10 = 3 AND user_id % 2 = 0 AND event_id % 7 = 2""",
    "aud_01_counts": """SELECT CASE WHEN user_id % 2 = 0 THEN 'claim' ELSE 'expense_item' END AS entity_type, user_id AS entity_id, count(*) AS entries, min(ts) AS first, max(ts) AS last
      FROM events GROUP BY ALL""",
    "aud_04_recent": """WITH r AS (SELECT event_id AS run_id, user_id AS claim_id, event_id % 1000 AS item_id, event_type AS operation, ts FROM events),
      a AS (SELECT 'claim_id' AS list, run_id, CAST(row_number() OVER (PARTITION BY claim_id ORDER BY ts DESC, run_id DESC) AS INT) AS rank FROM r QUALIFY rank <= 5),
      b AS (SELECT 'item_id' AS list, run_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY ts DESC, run_id DESC) AS INT) AS rank FROM r QUALIFY rank <= 3),
      c AS (SELECT 'operation' AS list, run_id, CAST(row_number() OVER (PARTITION BY operation ORDER BY ts DESC, run_id DESC) AS INT) AS rank FROM r QUALIFY rank <= 20),
      d AS (SELECT 'of 7' AS list, run_id, 0 AS rank FROM r WHERE claim_id = 7 AND operation = 'error' ORDER BY ts DESC, run_id DESC LIMIT 10)
      FROM a UNION ALL FROM b UNION ALL FROM c UNION ALL FROM d""",
    "aud_03_changes": """WITH e AS (SELECT event_id, lag(props) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b, props AS a FROM events)
        SELECT event_id, 'k' AS field, b ->> '$.k' AS old, a ->> '$.k' AS new FROM e WHERE (b ->> '$.k') IS DISTINCT FROM (a ->> '$.k')""",
    "aud_04_inference": """SELECT event_type AS operation, CASE WHEN value > 100 THEN 'SLOW' ELSE 'OK' END AS status,
      count(*) AS runs, CAST(sum(CAST(props ->> '$.k' AS BIGINT)) AS BIGINT) AS tokens,
        avg(CAST(floor(value) AS BIGINT)) AS mean_ms, max(CAST(floor(value) AS BIGINT)) AS max_ms FROM events GROUP BY ALL""",
    "aud_06_spans": """WITH RECURSIVE s AS (SELECT user_id AS trace_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS span_id FROM events),
        t AS (SELECT trace_id, span_id, 0 AS depth, lpad(CAST(span_id AS VARCHAR), 12, '0') AS path FROM s WHERE span_id = 1
          UNION ALL SELECT s.trace_id, s.span_id, depth + 1, path || '/' || lpad(CAST(s.span_id AS VARCHAR), 12, '0') FROM t
            JOIN s ON s.trace_id = t.trace_id AND s.span_id // 2 = t.span_id AND s.span_id > 1 WHERE depth < 10)
        SELECT trace_id, span_id, depth, path FROM t""",
    "sub_03_validate": f"""WITH {_ITEMS}, r AS (SELECT item_id, concat_ws(',', CASE WHEN amount_usd <= 0 THEN 'AMOUNT_NOT_POSITIVE' END, CASE
      WHEN line_number = 5 THEN 'CURRENCY_NOT_THREE_LETTERS' END,
        CASE WHEN expense_date > DATE '2026-04-02' THEN 'DATE_IN_FUTURE' END, CASE
          WHEN category = 'Client / Business Entertainment' AND length(trim(coalesce(attendees, ''))) < 5 THEN 'ATTENDEES_TOO_SHORT' END) AS reasons
          FROM items)
        SELECT * FROM r WHERE reasons <> ''""",
    "sub_04_stale": f"""WITH {_ITEMS}
      SELECT item_id, CAST(greatest(DATE '2026-04-01' - expense_date, 0) AS INT) AS age_days, DATE '2026-04-01' - expense_date > 90 AS is_stale
      FROM items""",
    "sub_05_custom_fields": f"""WITH {_ITEMS}
        SELECT item_id, 'grade' AS field, CASE WHEN category <> 'Meals' OR employee_grade IN ('L1', 'L2') THEN employee_grade END AS value,
          CASE WHEN category = 'Meals' AND employee_grade NOT IN ('L1', 'L2') THEN 'NOT_A_ENUM' END AS dropped FROM items
        UNION ALL SELECT item_id, 'paid', CASE WHEN has_pre_approval THEN 'true' END, CASE WHEN NOT has_pre_approval THEN 'NOT_A_BOOLEAN' END FROM items
        UNION ALL SELECT item_id, 'note', NULL, 'UNKNOWN_FIELD' FROM items
        UNION ALL SELECT item_id, 'size', NULL, CASE WHEN category <> 'Meals' THEN 'UNKNOWN_FIELD' END FROM items""",
    "sub_06_classification": f"""WITH {_ITEMS}, m AS (SELECT item_id, category, line_number / 10.0::DOUBLE AS sure, CASE line_number % 3 WHEN 0
      THEN CASE WHEN category <> 'Miscellaneous / Others' THEN category END WHEN 1 THEN 'Meals' END AS matched FROM items)
        SELECT item_id, matched, coalesce(matched <> category, false) AS mismatch, matched IS NULL OR matched <> category OR sure < 0.7::DOUBLE AS needs_review
          FROM m""",
    "sub_08_text": f"""WITH {_ITEMS}
      SELECT item_id, concat_ws(chr(10), 'Vendor: ' || merchant_vendor, 'Invoice: ' || invoice_number, 'Total: ' || CAST(amount_usd AS VARCHAR), 'Attendees: ' || attendees) AS text
      FROM items""",
    "sub_09_outside": f"""WITH {_ITEMS},
      m AS (SELECT item_id, expense_date, expense_date + CAST(greatest(line_number % 4, 1) - 1 AS INT) AS last_day, submission_date - 60 AS date_from, submission_date - 5 AS date_to
      FROM items)
        SELECT item_id, last_day, date_from, date_to FROM m WHERE expense_date < date_from OR last_day > date_to""",
}

QUERIES = (
    pol_14_travel, lif_10_search, lif_11_scope, lif_12_queue, lif_13_workflow, lif_14_finance_rejected, lif_16_tabs, lif_17_documents,
    aud_01_search, aud_01_counts, aud_03_changes, aud_04_inference, aud_04_recent, aud_06_spans, sub_03_validate, sub_04_stale, sub_05_custom_fields, sub_06_classification, sub_08_text, sub_09_outside,
)
