"""Searches, queues, workflow state and nested documents of claims, and audit logs (LIF-10..17, AUD-1, 3, 4, 6)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .blocks import cut

QUEUE = ("Manager_Review", "Finance_Review", "Flagged_Fraud")
MAX_OFFSET, MAX_PAGE = 10_000, 500


def page(df: DataFrame, *order: Column | str, offset: int = 0, limit: int | None = None) -> DataFrame:
    """Rows in order; a page of them if a limit is given."""
    out = df.orderBy(*order)
    if limit is None:
        return out
    if not (0 <= offset <= MAX_OFFSET and 0 < limit <= MAX_PAGE):
        raise ValueError(f"offset up to {MAX_OFFSET}, limit up to {MAX_PAGE}")
    return out.offset(offset).limit(limit)


def search_claims(
    claims: DataFrame, items: DataFrame, fraud: DataFrame | None = None, *, employees: list[int] | None = None, statuses: list[str] | None = None, reviewer: int | None = None,
    risk_levels: list[str] | None = None, category: str | None = None, date_from: str | None = None, date_to: str | None = None,
    offset: int = 0, limit: int | None = None,
) -> DataFrame:
    """Claims that meet every given condition, newest first (LIF-10).

    Category, from-date and to-date each ask for some item of the claim, not the same
    one; the three are flags of one aggregate over the items, so the items are read once.
    """
    out = claims
    if employees is not None:
        out = out.filter(F.col("employee_id").isin(*employees))
    if statuses is not None:
        out = out.filter(F.col("status").isin(*statuses))
    if reviewer is not None:
        out = out.filter(F.col("reviewer_id") == reviewer)
    wanted = []
    if category is not None:
        wanted.append(F.bool_or(F.col("category") == category))
    if date_from is not None:
        wanted.append(F.bool_or(F.col("expense_date") >= F.lit(date_from).cast("date")))
    if date_to is not None:
        wanted.append(F.bool_or(F.col("expense_date") <= F.lit(date_to).cast("date")))
    if wanted:
        flags = items.groupBy("claim_id").agg(*[w.alias(f"_w{k}") for k, w in enumerate(wanted)])
        held = flags.filter(" AND ".join(f"_w{k}" for k in range(len(wanted)))).select("claim_id")
        out = out.join(held, "claim_id", "left_semi")
    if risk_levels is not None:
        if fraud is None:
            raise ValueError("risk levels need the latest verdicts")
        out = out.join(fraud.filter(F.col("risk_level").isin(*risk_levels)).select("claim_id"), "claim_id", "left_semi")
    return page(out, F.desc("submission_date"), F.desc("claim_id"), offset=offset, limit=limit)


def scope_claims(claims: DataFrame, employees: DataFrame) -> DataFrame:
    """(claim_id, actor_id, access): who may see a claim: its employee, and the employee's direct manager (LIF-11)."""
    joined = claims.select("claim_id", "employee_id").join(employees.select("employee_id", "manager_id"), "employee_id", "left")
    who = F.array(F.struct(F.col("employee_id").alias("actor_id"), F.lit("own").alias("access")), F.struct(F.col("manager_id").alias("actor_id"), F.lit("report").alias("access")))
    seen = joined.select("claim_id", "employee_id", F.explode(who).alias("w")).filter("w.actor_id IS NOT NULL AND (w.access = 'own' OR w.actor_id <> employee_id)")
    return seen.select("claim_id", "w.actor_id", "w.access")


def review_queue(claims: DataFrame, reviewer: int | None = None) -> DataFrame:
    """Claims that wait for review, unassigned or the reviewer's, oldest first (LIF-12)."""
    waiting = claims.filter(F.col("status").isin(*QUEUE))
    if reviewer is not None:
        waiting = waiting.filter(F.col("reviewer_id").isNull() | (F.col("reviewer_id") == reviewer))
    return waiting.orderBy("submission_date", "claim_id")


def workflow_state(steps: DataFrame) -> DataFrame:
    """Open step, completion and the newest open workflow per claim, from (claim_id, workflow_id, step_order, step_status) (LIF-13)."""
    open_ = F.col("step_status") == "PENDING"
    state = steps.groupBy("claim_id", "workflow_id").agg(F.min(F.when(open_, F.col("step_order"))).alias("current_step"), F.count("*").alias("steps"), F.count_if(open_).alias("open_steps"))
    newest = F.max(F.when(F.col("open_steps") > 0, F.col("workflow_id"))).over(W.partitionBy("claim_id"))
    return state.withColumn("completed", F.col("open_steps") == 0).withColumn("is_active", F.coalesce(F.col("workflow_id") == newest, F.lit(False)))


def finance_rejected(history: DataFrame) -> DataFrame:
    """Role behind each claim's last rejection, and whether it was finance (LIF-14)."""
    last = history.filter("to_status = 'Rejected'").groupBy("claim_id").agg(F.max_by("actor_role", "sequence").alias("role"))
    return last.withColumn("by_finance", F.coalesce(F.col("role") == "finance", F.lit(False)))


def claim_tabs(claims: DataFrame) -> DataFrame:
    """Flags of the tabs a claim is listed under (LIF-16)."""
    return claims.withColumns({"in_approvals": F.col("status").isin(*QUEUE), "in_disbursements": F.col("status").isin("Approved", "Auto_Approved")})


def text_filter(claims: DataFrame, words: str, columns: list[str]) -> DataFrame:
    """Claims with the words in one of the columns, whatever the case (LIF-16)."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.lower(F.col(c).cast("string")).contains(words.lower()), F.lit(False))
    return claims.filter(hit)


def claim_documents(
    claims: DataFrame, items: DataFrame, history: DataFrame, comments: DataFrame | None = None, *, attachments: DataFrame | None = None,
    fraud: DataFrame | None = None, steps: DataFrame | None = None, internal: bool = False,
) -> DataFrame:
    """Claims with their items, moves, comments, attachments, newest fraud verdict and workflow steps nested in order (LIF-17).

    Children are grouped before they are joined, so each side is shuffled once by claim.
    Internal comments are left out unless asked for.
    """

    def nest(df: DataFrame, name: str, order: str, columns: list[str]) -> DataFrame:
        return df.groupBy("claim_id").agg(F.sort_array(F.collect_list(F.struct(order, *[c for c in columns if c != order]))).alias(name))

    children = [
        nest(items, "items", "line_number", ["item_id", "category", "amount_usd", "expense_date"]),
        nest(history, "history", "sequence", ["from_status", "to_status", "actor_role", "occurred_at"]),
    ]
    if comments is not None:
        seen = comments if internal else comments.filter(~F.coalesce("is_internal", F.lit(False)))
        children.append(nest(seen, "comments", "created_at", ["author", "body"]))
    if attachments is not None:
        children.append(nest(attachments, "attachments", "created_at", ["file_name", "checksum"]))
    if fraud is not None:
        newest = F.struct("evaluated_at", "created_at", "id")
        verdict = F.max_by(F.struct("risk_score", "risk_level", "is_flagged", "evaluated_at"), newest)
        children.append(fraud.groupBy("claim_id").agg(verdict.alias("fraud")))
    if steps is not None:
        children.append(nest(steps, "workflow", "step_order", ["step", "status"]))
    out = claims
    for child in children:
        out = out.join(child, "claim_id", "left")
    return out


def search_audit(
    logs: DataFrame, *, entity_type: str | None = None, entity_id: int | None = None, actions: list[str] | None = None, actor: int | None = None, correlation_id: str | None = None,
    offset: int = 0, limit: int | None = None,
) -> DataFrame:
    """Entries that meet every given condition, newest first (AUD-1)."""
    for name, value in (("entity_type", entity_type), ("entity_id", entity_id), ("actor", actor), ("correlation_id", correlation_id)):
        if value is not None:
            logs = logs.filter(F.col(name) == value)
    if actions is not None:
        logs = logs.filter(F.col("action").isin(*actions))
    return page(logs, F.desc("occurred_at"), F.desc("event_id"), offset=offset, limit=limit)


def count_audit(logs: DataFrame) -> DataFrame:
    """Entries of each entity, with the first and the last (AUD-1)."""
    return logs.groupBy("entity_type", "entity_id").agg(F.count("*").alias("entries"), F.min("occurred_at").alias("first"), F.max("occurred_at").alias("last"))


def audit_changes(logs: DataFrame, before: str = "before", after: str = "after") -> DataFrame:
    """(event_id, field, old, new) of the fields that differ between two JSON snapshots (AUD-3)."""
    fields = "map<string,string>"
    empty = F.create_map().cast(fields)
    maps = logs.select("event_id", F.coalesce(F.from_json(before, fields), empty).alias("b"), F.coalesce(F.from_json(after, fields), empty).alias("a"))
    keys = maps.select("event_id", "b", "a", F.explode(F.array_distinct(F.concat(F.map_keys("b"), F.map_keys("a")))).alias("field"))
    out = keys.select("event_id", "field", F.try_element_at("b", F.col("field")).alias("old"), F.try_element_at("a", F.col("field")).alias("new"))
    return out.filter(~F.col("old").eqNullSafe(F.col("new")))


def inference_summary(runs: DataFrame) -> DataFrame:
    """Runs, tokens and latency per operation and status (AUD-4)."""
    return runs.groupBy("operation", "status").agg(F.count("*").alias("runs"), F.sum("tokens").alias("tokens"), F.avg("latency_ms").alias("mean_ms"), F.max("latency_ms").alias("max_ms"))


def recent_inference(
    runs: DataFrame, *, claim_id: int | None = None, item_id: int | None = None, operation: str | None = None, offset: int = 0, limit: int | None = None
) -> DataFrame:
    """Runs of a claim, an item or an operation, newest first (AUD-4)."""
    for name, value in (("claim_id", claim_id), ("item_id", item_id), ("operation", operation)):
        if value is not None:
            runs = runs.filter(F.col(name) == value)
    return page(runs, F.desc("created_at"), F.desc("run_id"), offset=offset, limit=limit)


def newest_inference(runs: DataFrame, by: list[str], n: int) -> DataFrame:
    """The ``n`` newest runs of each claim, item or operation, numbered (AUD-4): a top-n per key, cut before the shuffle."""
    rank = F.row_number().over(W.partitionBy(*by).orderBy(F.desc("created_at"), F.desc("run_id")))
    return runs.withColumn("rank", rank).filter(F.col("rank") <= n)


def flatten_spans(spans: DataFrame, every: int = 4) -> DataFrame:
    """Spans (trace_id, span_id, parent_id) with depth and a path that sorts depth first (AUD-6).

    One self join per level, by trace and parent, until a level is empty; ``every`` few
    levels are checkpointed, so plans stay small at any depth.  Span ids are unique in
    their trace; spans under a missing parent raise no row.
    """
    spans = cut(spans.select("trace_id", "span_id", "parent_id").repartition("trace_id", "parent_id"))
    step = lambda c: F.lpad(F.col(c).cast("string"), 12, "0")
    level = spans.filter("parent_id IS NULL").select("trace_id", "span_id", F.lit(0).alias("depth"), step("span_id").alias("path"))
    out, depth = [], 0
    while not out or not level.isEmpty():
        levels = [level]
        for k in range(depth + 1, depth + every + 1):
            up = levels[-1].select("trace_id", F.col("span_id").alias("parent_id"), F.col("path").alias("_up"))
            below = spans.join(up, ["trace_id", "parent_id"])
            levels.append(below.select("trace_id", "span_id", F.lit(k).alias("depth"), F.concat_ws("/", "_up", step("span_id")).alias("path")))
        some = cut(reduce(DataFrame.unionByName, levels))
        depth += every
        out.append(some.filter(F.col("depth") < depth))
        level = some.filter(F.col("depth") == depth)
    return reduce(DataFrame.unionByName, out)
