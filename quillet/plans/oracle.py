"""SQL twins of the registered queries, for another engine over the same tables."""

from __future__ import annotations

from ..functions.text import LEAST_CHARS, STOP_WORDS
from ..operators.lifecycle import EDGES, ROLES
from ..sources.tables import history_sql, items_sql

_N = [f"n_{lang}" for lang in STOP_WORDS]


def normalized(text: str) -> str:
    """Clean text as a SQL expression; texts of the given tables are in the compatible normal form already."""
    plain = f"translate(regexp_replace({text}, '\\r\\n?', chr(10), 'g'), '‘’“”–—−' || chr(160), chr(39) || chr(39) || '\"\"--- ')"
    whole = f"regexp_replace(replace({plain}, chr(173), ''), '([\\p{{L}}\\p{{N}}_])-\\n([\\p{{L}}\\p{{N}}_])', '\\1\\2', 'g')"
    blanks = f"regexp_replace(regexp_replace({whole}, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')"
    return f"regexp_replace(regexp_replace({blanks}, ' ?\\n ?', chr(10), 'g'), '^\\s+|\\s+$', '', 'g')"


def language_counts(text: str = "text") -> str:
    """Occurrences of each language's stop words, as a list of SQL columns."""
    words = f"regexp_extract_all(lower({text}), '[\\p{{L}}]+')"
    return ", ".join(f"len(list_filter({words}, lambda w: w IN ({', '.join(map(repr, stops.split()))}))) AS n_{lang}" for lang, stops in STOP_WORDS.items())


def language(text: str = "text") -> str:
    """The language that leads in the counts, as a SQL expression."""
    top = f"greatest({', '.join(_N)})"
    lead = " + ".join(f"({n} = {top})::INT" for n in _N)
    pick = " ".join(f"WHEN {n} THEN '{n[2:]}'" for n in _N)
    return f"CASE WHEN length(trim({text})) >= {LEAST_CHARS} AND {top} > 0 AND {lead} = 1 THEN CASE {top} {pick} END END"


_ITEMS = f"items AS ({items_sql('duckdb')})"
_VENDOR = "lower(trim(regexp_replace(merchant_vendor, '\\s+', ' ', 'g')))"
_FP = f"""fp0 AS ({items_sql("duckdb", "l_suppkey")}),
fp AS (SELECT *, {_VENDOR} AS vendor, sha256({_VENDOR} || '|' || CAST(amount_usd AS VARCHAR) || '|' || CAST(expense_date AS VARCHAR)) AS checksum FROM fp0)"""
_KEYED = f"keyed AS (SELECT *, {_VENDOR} AS vendor FROM items)"
_HISTORY = f"history AS ({history_sql('duckdb')})"
_RULED = """
ruled AS (
  SELECT i.*, min(expense_date) OVER (PARTITION BY claim_id) AS ruleset_date,
    CASE category WHEN 'Meals' THEN 'MEALS_STANDARD' WHEN 'Taxi / Cab / Ride-hailing' THEN 'GROUND_TRANSPORT_STANDARD' WHEN 'Air Travel' THEN 'FLIGHTS_STANDARD'
      WHEN 'Hotel / Lodging' THEN 'LODGING_STANDARD' WHEN 'Client / Business Entertainment' THEN 'CLIENT_ENTERTAINMENT_STANDARD' END AS code,
    CASE category WHEN 'Meals' THEN 40.0::DOUBLE WHEN 'Taxi / Cab / Ride-hailing' THEN 150.0 WHEN 'Air Travel' THEN 10000.0
      WHEN 'Hotel / Lodging' THEN CASE
        WHEN employee_grade IN ('L1', 'L2', 'L3') THEN 120.0 ELSE 250.0 END WHEN 'Client / Business Entertainment' THEN 500.0 END AS max_limit,
    CASE category WHEN 'Meals' THEN 25.0::DOUBLE WHEN 'Taxi / Cab / Ride-hailing' THEN 50.0 END AS auto,
    CASE category WHEN 'Meals' THEN 25.0::DOUBLE WHEN 'Client / Business Entertainment' THEN 50.0 WHEN 'Miscellaneous / Others' THEN NULL ELSE 0.0 END AS receipt_from,
    greatest(submission_date - expense_date, 0) AS days, CAST(amount_usd AS DOUBLE) AS amount
  FROM items i)"""
_POLICY = (
    _RULED
    + """,
checked AS (
  SELECT *, concat_ws(',',
    CASE WHEN days > 90 THEN 'AGE_LIMIT_90_DAYS-' ELSE 'AGE_LIMIT_90_DAYS+' END,
    CASE WHEN code IS NULL THEN 'POLICY_RULE_MISSING-' END,
    CASE WHEN code IS NOT NULL THEN
      CASE code WHEN 'MEALS_STANDARD' THEN CASE WHEN amount > max_limit THEN 'MEAL_MAX_EXCEEDED-' ELSE 'MEAL_MAX_PASS+' END
        WHEN 'GROUND_TRANSPORT_STANDARD' THEN CASE WHEN amount > max_limit THEN 'TAXI_MAX_EXCEEDED-' ELSE 'TAXI_MAX_PASS+' END
        WHEN 'FLIGHTS_STANDARD' THEN CASE WHEN amount > max_limit THEN 'FLIGHT_MAX_EXCEEDED-' ELSE 'FLIGHT_MAX_PASS+' END
        WHEN 'LODGING_STANDARD' THEN CASE WHEN amount > max_limit THEN 'LODGING_LIMIT_EXCEEDED-' ELSE 'LODGING_LIMIT_PASS+' END
        ELSE CASE WHEN amount > max_limit THEN 'CLIENT_ENT_MAX_EXCEEDED-' ELSE 'CLIENT_ENT_MAX_PASS+' END END END,
    CASE code WHEN 'MEALS_STANDARD' THEN CASE WHEN amount > auto THEN 'MEAL_REQUIRES_REVIEW+' END
      WHEN 'GROUND_TRANSPORT_STANDARD' THEN CASE WHEN amount > auto THEN 'TAXI_REVIEW_REQUIRED+' END
      WHEN 'FLIGHTS_STANDARD' THEN 'FLIGHT_ALWAYS_MANUAL+' WHEN 'LODGING_STANDARD' THEN 'LODGING_ALWAYS_MANUAL+'
      WHEN 'CLIENT_ENTERTAINMENT_STANDARD' THEN 'CLIENT_ENT_ALWAYS_MANUAL+' END,
    CASE WHEN code = 'CLIENT_ENTERTAINMENT_STANDARD' THEN
      CASE WHEN employee_grade IN ('L5', 'Director', 'VP') THEN 'CLIENT_ENT_GRADE_PASS+' ELSE 'CLIENT_ENT_GRADE_RESTRICTION-' END END,
    CASE WHEN code = 'FLIGHTS_STANDARD' THEN CASE WHEN employee_grade IN ('L1', 'L2', 'L3', 'L4') THEN 'FLIGHT_CLASS_L1_L4+'
      WHEN employee_grade IN ('L5', 'Director') THEN 'FLIGHT_CLASS_L5+' ELSE 'FLIGHT_CLASS_VP+' END END,
    CASE WHEN code IN ('FLIGHTS_STANDARD', 'CLIENT_ENTERTAINMENT_STANDARD') AND NOT has_pre_approval THEN code || '_PRE_APPROVAL_REQUIRED-' END,
    CASE WHEN amount > receipt_from AND NOT receipt_attached THEN 'RECEIPT_REQUIRED_MISSING-' END,
    CASE WHEN code = 'MEALS_STANDARD' AND extracted_receipt IS NOT NULL THEN 'MEAL_ALCOHOL_PROHIBITED-' END,
    CASE WHEN code = 'CLIENT_ENTERTAINMENT_STANDARD' AND length(trim(coalesce(attendees, ''))) < 5 THEN 'CLIENT_ENT_MISSING_ATTENDEES-' END) AS checks
  FROM ruled),
judged AS (
  SELECT *, NOT contains(checks || ',', '-,') AS policy_passed, contains(checks || ',', '-,') OR auto IS NULL OR amount > auto AS manual_review FROM checked)"""
)


def _screen(source: str) -> str:
    before = "ORDER BY submission_date, claim_id, line_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    return f"""
primed AS (
  SELECT *, lower(trim(merchant_vendor)) AS v, CAST(amount_usd AS DOUBLE) AS usd, status <> 'Rejected' AS live FROM {source}),
wide AS (
  SELECT *, count(*) FILTER (live) OVER (PARTITION BY employee_id, v, expense_date, amount_usd {before}) AS twins,
    count(*) FILTER (live) OVER (PARTITION BY employee_id, v, expense_date {before}) AS same_day,
    CAST(coalesce(sum(amount_usd) FILTER (live) OVER (PARTITION BY employee_id, v, expense_date {before}), 0) AS DOUBLE) AS same_day_usd,
    count(*) OVER (PARTITION BY employee_id {before}) AS prior,
    CAST(coalesce(sum(amount_usd) OVER (PARTITION BY employee_id {before}), 0) AS DOUBLE) AS prior_usd
  FROM primed),
hits AS (
  SELECT *, twins > 0 AS f1, same_day > 0 AND category = 'Taxi / Cab / Ride-hailing' AND same_day_usd + usd > 50 AS f2,
    same_day > 0 AND category = 'Meals' AND same_day_usd + usd > 25 AS f3,
    (usd > 23.5 AND usd <= 25) OR (usd > 47.5 AND usd <= 50) OR (usd > 115 AND usd <= 120) OR (usd > 242 AND usd <= 250) OR (usd > 485 AND usd <= 500) AS f4,
    prior > 3 AND usd * prior > prior_usd * 3.5 AND usd > 150 AS f5, regexp_matches(v, 'uber|lyft|taxi') AND category = 'Meals' AS f6
  FROM wide),
screened AS (
  SELECT *, CAST(50 * f1::INT + 35 * f2::INT + 30 * f3::INT + 15 * f4::INT + 20 * f5::INT + 25 * f6::INT AS INT) AS risk_score,
    [x FOR x IN [CASE WHEN f1 THEN 'DUPLICATE_SUBMISSION' END, CASE WHEN f2 THEN 'SPLIT_TRANSACTION' END, CASE WHEN f3 THEN 'SPLIT_TRANSACTION' END,
      CASE WHEN f4 THEN 'THRESHOLD_ENGINEERING' END, CASE WHEN f5 THEN 'HIGH_SPEND_VELOCITY' END, CASE
        WHEN f6 THEN 'VENDOR_CATEGORY_MISMATCH' END] IF x IS NOT NULL] AS flags
  FROM hits),
levelled AS (
  SELECT *, CASE WHEN risk_score >= 70 THEN 'CRITICAL' WHEN risk_score >= 40 THEN 'HIGH' WHEN risk_score >= 15 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
    CASE WHEN risk_score >= 70 THEN 'INVESTIGATE_FRAUD' WHEN risk_score >= 40 THEN 'FINANCE_AUDIT'
      WHEN risk_score >= 15 THEN 'MANAGER_REVIEW' ELSE 'AUTO_APPROVE' END AS recommended_action,
    risk_score >= 15 AS is_flagged FROM screened)"""


_ROUTED = f"""{_ITEMS}, {_POLICY}, {_screen("judged")},
routed AS (
  SELECT *, CASE WHEN is_flagged AND risk_score >= 40 THEN 'Fraud_Flag'
    WHEN NOT policy_passed OR manual_review THEN 'Policy_Hold' ELSE 'Auto_Approved' END AS route FROM levelled)"""
_CLAIMS = """SELECT claim_id, CASE WHEN bool_or(route = 'Fraud_Flag') THEN 'Flagged_Fraud'
  WHEN bool_or(route = 'Policy_Hold') THEN 'Manager_Review' ELSE 'Auto_Approved' END AS claim_status,
  sum(amount_usd) AS total_usd, count(*) AS item_count, max(risk_score) AS risk_score, count(*) FILTER (NOT policy_passed) AS violations FROM routed
    GROUP BY claim_id"""
_PAIRS = """
pairs AS (
  SELECT a.item_id, b.item_id AS other_id FROM fp a JOIN fp b ON a.vendor = b.vendor AND b.expense_date BETWEEN a.expense_date - 7 AND a.expense_date + 7
    AND b.item_id < a.item_id AND a.claim_id <> b.claim_id)"""
_KNN = """
q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id % 20 = 0),
near AS (
  SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank
  FROM (SELECT query_id, vec_id, round(list_cosine_similarity(e, CAST(embedding AS DOUBLE[])), 9) AS score FROM q, embeddings)
  QUALIFY rank <= 10)"""


def _pairs_of(table: dict[str, list[str]]) -> str:
    return ", ".join(f"('{a}', '{b}')" for a, many in table.items() for b in many)


def statements() -> dict[str, str]:
    chunks = "chunks AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INT) AS chunk_index, chunk FROM (SELECT doc_id, k, trim(p[k]) AS chunk FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents), unnest(range(1, len(p) + 1)) AS t(k)) WHERE chunk <> '')"
    return {
        "src_01_expense_items": f"WITH {_ITEMS} SELECT * FROM items",
        "pol_02_rules_as_of": f"WITH {_ITEMS}, {_RULED} SELECT item_id, ruleset_date, code, 90.0::DOUBLE AS age_limit FROM ruled",
        "pol_07_check_age": f"WITH {_ITEMS}, {_RULED} SELECT item_id, CAST(days AS INT) AS days, days > 90 AS over_age FROM ruled",
        "pol_08_check_limits": f"""WITH {_ITEMS}, {_RULED} SELECT item_id, max_limit, auto, amount > max_limit AS over_max, amount > auto AS over_auto
          FROM ruled""",
        "pol_12_policy_report": f"""WITH {_ITEMS}, {_POLICY}
          SELECT item_id, policy_passed, manual_review, coalesce(amount <= max_limit, false) AS within_max, coalesce(amount <= auto, false) AS within_auto,
          max_limit, CAST(days AS INT) AS days_since_expense, checks FROM judged""",
        "frd_07_screen_fraud": f"""WITH {_ITEMS}, {_screen('items')}
          SELECT item_id, risk_score, least(risk_score, 100) AS risk_score_capped, risk_level, recommended_action, is_flagged, array_to_string(flags, ',') AS flags
          FROM levelled""",
        "frd_08_claim_fraud": f"""WITH {_ITEMS}, {_screen('items')} SELECT claim_id,
          max(risk_score) AS risk_score, arg_max(line_number, risk_score * 1000 - line_number) AS worst_line, arg_max(risk_level, risk_score * 1000 - line_number) AS risk_level, bool_or(is_flagged) AS is_flagged, coalesce(string_agg(CAST(line_number AS VARCHAR) || ':' || array_to_string(flags, '+'), ';' ORDER BY line_number) FILTER (len(flags) > 0), '') AS flags
          FROM levelled GROUP BY claim_id""",
        "lif_01_route_items": f"WITH {_ROUTED} SELECT item_id, route FROM routed",
        "lif_02_hold_reasons": f"""WITH {_ROUTED} SELECT claim_id, coalesce(string_agg('Item #' || line_number || ' (' || category || '): ' ||
            CASE route WHEN 'Fraud_Flag' THEN array_to_string(flags, ',') ELSE CASE WHEN policy_passed THEN 'Held for manual review.'
              ELSE array_to_string([replace(x, '-', '') FOR x IN string_split(checks, ',') IF ends_with(x, '-')], ',') END END, '; ' ORDER BY line_number)
            FILTER (route <> 'Auto_Approved'), '') AS hold_reasons FROM routed GROUP BY claim_id""",
        "lif_03_claims_audit": f"WITH {_ROUTED} {_CLAIMS}",
        "lif_04_decisions": f"""WITH {_ITEMS} SELECT claim_id, CASE WHEN bool_or(status IN ('Submitted', 'Policy_Hold', 'Fraud_Flag')) THEN NULL
          WHEN bool_and(status = 'Rejected') THEN 'Rejected' ELSE 'Approved' END AS decision FROM items GROUP BY claim_id""",
        "lif_05_claim_totals": f"""WITH {_ITEMS} SELECT o_orderkey AS claim_id, CAST(coalesce(sum(amount_usd), 0) AS DECIMAL(24,2)) AS total_usd,
          count(item_id) AS item_count FROM orders LEFT JOIN items ON o_orderkey = claim_id GROUP BY o_orderkey""",
        "lif_06_transitions": f"""WITH {_HISTORY},
          moves AS (SELECT *, (from_status, to_status) NOT IN ({_pairs_of(EDGES)}) AS illegal_edge, (to_status, actor_role) NOT IN ({_pairs_of(ROLES)}) AS illegal_role
            FROM history WHERE from_status IS NOT NULL AND from_status <> to_status)
            SELECT event_id, claim_id, from_status, to_status, actor_role, illegal_edge, illegal_role FROM moves WHERE illegal_edge OR illegal_role""",
        "lif_08_snapshot": f"""WITH {_HISTORY} SELECT claim_id, arg_max(to_status, sequence) AS status,
          min(occurred_at) FILTER (to_status = 'Submitted') AS submitted_at,
            min(occurred_at) FILTER (to_status = 'Processing') AS processing_started_at,
              min(occurred_at) FILTER (to_status IN ('Manager_Review', 'Finance_Review')) AS review_started_at,
            min(occurred_at) FILTER (to_status IN ('Approved', 'Auto_Approved')) AS approved_at,
              max(occurred_at) FILTER (to_status IN ('Approved', 'Rejected')) AS decided_at,
            min(occurred_at) FILTER (to_status = 'Rejected') AS rejected_at, min(occurred_at) FILTER (to_status = 'Reimbursed') AS reimbursed_at,
              min(occurred_at) FILTER (to_status = 'Withdrawn') AS withdrawn_at,
            count(*) AS moves FROM history GROUP BY claim_id""",
        "lif_09_status_sets": f"""WITH {_HISTORY}
          SELECT event_id, to_status AS status, to_status IN ('Rejected', 'Reimbursed', 'Withdrawn', 'Failed') AS is_terminal, to_status = 'Draft' AS is_editable,
            to_status IN ('Submitted', 'Processing', 'Auto_Approved', 'Manager_Review', 'Finance_Review') AS is_withdrawable, to_status IN ('Manager_Review', 'Finance_Review', 'Flagged_Fraud') AS is_reviewable
              FROM history""",
        "lif_15_dashboard": f"""WITH {_ROUTED}, claims AS ({_CLAIMS}) SELECT count(*) FILTER (claim_status = 'Manager_Review') AS pending,
          count(*) FILTER (claim_status = 'Flagged_Fraud') AS flagged,
            count(*) FILTER (claim_status = 'Auto_Approved') AS auto_approved, CAST(round(100.0 * count(*) FILTER (claim_status = 'Auto_Approved') / greatest(count(*), 1)) AS BIGINT) AS auto_rate,
            sum(total_usd) FILTER (claim_status IN ('Auto_Approved', 'Approved')) AS paid_usd FROM claims""",
        "aud_02_trails": """WITH firsts AS (SELECT user_id, event_id % 10 AS actor, min((ts, event_id)) AS k FROM events GROUP BY ALL),
            ordered AS (SELECT user_id, string_agg(CAST(actor AS VARCHAR), ',' ORDER BY k) AS actors FROM firsts GROUP BY user_id)
            SELECT user_id AS entity_id, any_value(actors) AS actors, count(*) AS entries, max(ts) AS last_activity FROM events
              JOIN ordered USING (user_id) GROUP BY user_id""",
        "aud_05_operation_metrics": """WITH s AS (SELECT event_type AS operation, CAST(floor(value) AS BIGINT) AS d FROM events)
            SELECT operation, count(*) AS runs,
              count(*) FILTER (operation = 'error') AS failures, CAST(sum(d) AS BIGINT) AS total_ms, avg(d) AS mean_ms, max(d) AS max_ms,
              count(*) FILTER (d >= 50) AS slow FROM s GROUP BY operation""",
        "ven_03_vendor_stats": f"""WITH {_FP} SELECT vendor, count(DISTINCT claim_id) AS claims, count(*) AS items, sum(amount_usd) AS spend_usd,
          min(expense_date) AS first_seen, max(expense_date) AS last_seen FROM fp GROUP BY vendor""",
        "dup_01_candidates": f"""WITH {_FP}, {_PAIRS} SELECT item_id, count(*) AS candidates, min(other_id) AS least, max(other_id) AS most FROM pairs
          GROUP BY item_id""",
        "dup_09_cross_employee": f"""WITH {_FP} SELECT a.item_id, min(b.item_id) AS first_id, count(*) AS links FROM fp a
          JOIN fp b USING (vendor, expense_date) WHERE a.employee_id <> b.employee_id AND abs(a.amount_usd - b.amount_usd) <= 0.01 GROUP BY a.item_id""",
        "dup_12_verdicts": f"""WITH {_FP}, {_PAIRS}, scored AS (
            SELECT p.item_id, CAST(a.checksum = b.checksum AS INT) AS exact,
              (0.35 * (a.vendor = b.vendor)::INT + 0.15 * (a.expense_date = b.expense_date)::INT + 0.15 * (abs(a.amount_usd - b.amount_usd) <= 0.01)::INT
               + CASE WHEN a.invoice_number IS NOT NULL
                 AND b.invoice_number IS NOT NULL THEN 0.35 * (lower(trim(a.invoice_number)) = lower(trim(b.invoice_number)))::INT ELSE 0 END)::DOUBLE
              / CASE WHEN a.invoice_number IS NOT NULL AND b.invoice_number IS NOT NULL THEN 1.0 ELSE 0.65 END AS invoice
            FROM pairs p JOIN fp a ON p.item_id = a.item_id JOIN fp b ON p.other_id = b.item_id),
            signals AS (SELECT item_id, max(exact) AS exact, round(max(invoice), 6) AS invoice, count(*) AS candidates FROM scored GROUP BY item_id),
            final AS (SELECT *, greatest(CASE WHEN exact = 1 THEN 1.0::DOUBLE ELSE 0 END, CASE WHEN invoice >= 0.9 THEN invoice ELSE 0 END) AS score
              FROM signals)
            SELECT *, CASE WHEN score >= 0.95 THEN 'CONFIRMED' WHEN score >= 0.75 THEN 'LIKELY'
              WHEN score > 0 THEN 'POSSIBLE' ELSE 'NO_MATCH' END AS verdict FROM final""",
        "dup_14_duplicate_items": f"""WITH {_ITEMS}, {_KEYED}, live AS (SELECT * FROM keyed WHERE status NOT IN ('Rejected', 'Withdrawn'))
          SELECT a.item_id, min(b.item_id) AS first_id, count(*) AS links FROM live a
          JOIN live b USING (employee_id, expense_date, vendor, amount_usd) WHERE a.claim_id <> b.claim_id GROUP BY a.item_id""",
        "dup_15_same_day_vendor": f"""WITH {_ITEMS}, {_KEYED} SELECT employee_id, vendor, expense_date, count(*) AS items,
          sum(amount_usd) AS total_usd FROM keyed GROUP BY ALL HAVING count(*) > 1""",
        "dup_16_same_file_hash": f"""WITH {_FP} SELECT checksum, count(DISTINCT claim_id) AS claims, min(item_id) AS first_item, count(*) AS items
          FROM fp GROUP BY checksum HAVING count(DISTINCT claim_id) > 1""",
        "txt_03_paragraphs": r"""SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\n\s*\n'), lambda p: trim(p) <> '')) AS paragraphs,
            CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, CAST(floor(length(text) / 4.0::DOUBLE + 0.999::DOUBLE) AS BIGINT)) END AS tokens
              FROM documents""",
        "txt_09_page_numbers": r"""SELECT doc_id, md5(array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(trim(x), '(?i)^[\-–—\s]*(?:page\s+)?\d{1,4}(?:\s*[/\-of]+\s*\d{1,4})?[\-–—\s]*$')), chr(10))) AS digest
          FROM documents""",
        "txt_12_quality": r"""WITH t AS (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM documents),
            m AS (SELECT doc_id, length(t) AS n, length(t) - length(regexp_replace(t, '[\p{L}\p{Nd}\s]', '', 'g')) AS a,
              len(regexp_extract_all(t, '\S+')) AS w, length(regexp_replace(t, '\s', '', 'g')) AS c FROM t),
            p AS (SELECT doc_id, (CASE WHEN n = 0 THEN 0
              WHEN n < 80 THEN n / 80 * 0.3::DOUBLE ELSE least(1.0::DOUBLE, 0.3::DOUBLE + 0.7::DOUBLE * (n - 80) / 1920) END) AS length_score,
              (CASE WHEN n = 0 THEN 0 ELSE a / n END) AS alnum_score,
              (CASE WHEN n = 0 THEN 0 ELSE greatest(0.0::DOUBLE, 1 - CASE WHEN c / w < 2 THEN 2 - c / w
                WHEN c / w > 10 THEN c / w - 10 ELSE 0 END / 10) END) AS word_score FROM m)
            SELECT p.*, CASE WHEN length_score > 0 THEN round(100 * (0.3::DOUBLE * length_score + 0.3::DOUBLE * alnum_score + 0.2::DOUBLE * word_score
              + CASE WHEN several THEN 0.1::DOUBLE ELSE 0.05::DOUBLE END + CASE
                WHEN language IS NULL THEN 0.03::DOUBLE ELSE 0.1::DOUBLE END), 3) ELSE 0 END AS score
            FROM p JOIN (SELECT doc_id, contains(text, chr(10)) AS several, @LANGUAGE AS language FROM (SELECT doc_id, text, @COUNTS
              FROM documents)) USING (doc_id)""".replace("@COUNTS", language_counts()).replace("@LANGUAGE", language()),
        "doc_01_dedup": """WITH f AS (SELECT doc_id, lang, sha256(coalesce(text, '')) AS checksum FROM documents) SELECT *,
          min(doc_id) OVER w AS first_id, count(*) OVER w AS copies, CASE
          WHEN doc_id = min(doc_id) OVER w THEN 'INDEXED' ELSE 'SKIPPED_DUPLICATE' END AS status FROM f WINDOW w AS (PARTITION BY lang, checksum)""",
        "doc_02_versions": """SELECT doc_id, lang, source, CAST(row_number() OVER w AS INT) AS version, lag(doc_id) OVER w AS supersedes_id, lead(doc_id) OVER w AS superseded_by,
          CASE WHEN lead(doc_id) OVER w IS NULL THEN 'INDEXED' ELSE 'SUPERSEDED' END AS status FROM documents
          WINDOW w AS (PARTITION BY lang, source ORDER BY doc_id)""",
        "doc_07_count_by_spec": "SELECT label % 2 AS tenant, label AS spec, count(*) AS vectors FROM embeddings GROUP BY ALL",
        "doc_11_reassemble": f"WITH {chunks} SELECT doc_id, md5(string_agg(chunk, chr(10) ORDER BY chunk_index)) AS digest FROM chunks GROUP BY doc_id",
        "chk_08_chunks": f"""WITH {chunks}
          SELECT doc_id, chunk_index, sha256(doc_id || '|' || chunk_index || '|' || chunk) AS chunk_id, CAST(length(chunk) AS INT) AS n_chars, CAST(greatest(1, floor(length(chunk) / 4.0::DOUBLE + 0.999::DOUBLE)) AS INT) AS tokens
          FROM chunks""",
        "emb_02_norms": """SELECT vec_id,
          round(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS norm, 1.0::DOUBLE AS unit FROM embeddings""",
        "emb_05_centroids": """SELECT label, CAST(i - 1 AS INT) AS i, round(avg(CAST(embedding[i] AS DOUBLE)), 6) AS x
          FROM embeddings, unnest(range(1, len(embedding) + 1)) AS t(i) GROUP BY label, i""",
        "emb_06_knn": f"WITH {_KNN} SELECT query_id, vec_id, CAST(rank AS INT) AS rank, round(score, 6) AS score FROM near",
        "ret_04_min_max": f"""WITH {_KNN} SELECT query_id, vec_id, round(CASE
          WHEN max(score) OVER w = min(score) OVER w THEN 1.0::DOUBLE ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END, 4) AS scaled
          FROM near WINDOW w AS (PARTITION BY query_id)""",
        "ret_06_rrf": f"""WITH {_KNN},
          both_legs AS (SELECT query_id, vec_id, 0.6::DOUBLE / (60 + rank) + 0.4::DOUBLE / (60 + row_number() OVER (PARTITION BY query_id ORDER BY vec_id)) AS raw
          FROM near),
            fused AS (SELECT query_id, vec_id, least(1.0::DOUBLE, raw / (0.6::DOUBLE / 61 + 0.4::DOUBLE / 61)) AS fused FROM both_legs)
            SELECT query_id, vec_id,
              round(fused, 9) AS fused, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(fused, 12) DESC, vec_id) AS INT) AS rank
              FROM fused""",
    }
