"""The append-only jobs as Structured Streaming transformations (STR-*)."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, GroupedData, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..operators.blocks import shared_folder
from ..operators.lifecycle import EDGES


def by_time(rows: DataFrame, batches: int, at: str = "ts") -> list[DataFrame]:
    """``rows`` in so many parts of about the same size, the earlier ones first; rows without a time come in the last."""
    cuts = rows.select(F.percentile_approx(F.col(at).cast("double"), [k / batches for k in range(1, batches)])).first()[0] or []
    part = F.lit(0)
    for c in cuts:
        part = part + F.coalesce(F.col(at).cast("double") > c, F.lit(True)).cast("int")
    return [rows.filter(part == k) for k in range(len(cuts) + 1)]


def drained(job: Callable[[DataFrame], DataFrame], batches: list[DataFrame], keys: list[str] | None = None, seen: list[dict] | None = None) -> DataFrame:
    """What ``job`` gives over the ``batches``, one after the other, as a table in the folder that all machines share.

    Each batch is added to the source's folder and the stream started again from its checkpoint, so state and watermark go
    from one batch to the next.  Rows of later batches replace those of equal ``keys`` (running results), or are
    added.  ``seen`` is given the progress of every micro-batch.
    """
    spark = batches[0].sparkSession
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/rows/{number}")

    for batch in batches:
        batch.write.mode("append").parquet(f"{folder}/source")
        stream = job(spark.readStream.schema(batch.schema).parquet(f"{folder}/source"))
        started = stream.writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
        query = started.outputMode("append" if keys is None else "update").foreachBatch(keep).start()
        query.awaitTermination()
        if seen is not None:
            seen.extend(json.loads(p.json) for p in query.recentProgress)
    schema = T.StructType([*stream.schema.fields, T.StructField("_batch", T.IntegerType())])
    rows = spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{folder}/rows")
    if keys is None:
        return rows.drop("_batch")
    last = rows.groupBy(*keys).agg(F.max("_batch").alias("_batch"))
    return rows.join(last, [*keys, "_batch"], "left_semi").drop("_batch")


def stream_dedup(docs: DataFrame, delay: str = "1 hour", keys: tuple[str, ...] = ("tenant", "checksum")) -> DataFrame:
    """Each (tenant, checksum) once within the watermark (STR-1).

    A key's state ends ``delay`` after its first row, by the watermark; an equal row after that passes.
    """
    return docs.withWatermark("ts", delay).dropDuplicatesWithinWatermark(list(keys))


def stream_totals(items: DataFrame) -> DataFrame:
    """Running totals per claim, for update or complete mode (STR-3)."""
    return items.groupBy("claim_id").agg(F.sum("amount_usd").alias("total_usd"), F.count("*").alias("item_count"))


def stream_metrics(spans: DataFrame, width: str = "5 minutes", delay: str = "10 minutes", slow_ms: int = 2_000) -> DataFrame:
    """Operation metrics per tumbling window of (ts, operation, duration_ms, failed); late rows are dropped (STR-4)."""
    return (
        spans.withWatermark("ts", delay)
        .groupBy(F.window("ts", width).alias("window"), "operation")
        .agg(
            F.count("*").alias("runs"), F.count_if("failed").alias("failures"), F.sum("duration_ms").alias("total_ms"), F.avg("duration_ms").alias("mean_ms"),
            F.max("duration_ms").alias("max_ms"), F.count_if(F.col("duration_ms") >= slow_ms).alias("slow"),
        )
        .select(F.col("window.start").alias("start"), "operation", "runs", "failures", "total_ms", "mean_ms", "max_ms", "slow")
    )


def stream_cross_employee(a: DataFrame, b: DataFrame, delay: str = "1 day") -> DataFrame:
    """Alerts for equal receipts of two employees within a day (STR-5)."""
    left = a.withWatermark("ts", delay).alias("a")
    right = b.withWatermark("ts", delay).alias("b")
    same = (F.col("a.vendor") == F.col("b.vendor")) & (F.col("a.amount_usd") == F.col("b.amount_usd")) & (F.col("a.employee_id") != F.col("b.employee_id"))
    near = F.expr("b.ts BETWEEN a.ts - INTERVAL 1 DAY AND a.ts")
    return left.join(right, same & near).select(F.col("a.item_id").alias("item_id"), F.col("b.item_id").alias("other_id"))


_DAY = 86_400_000_000


class _Alerts(StatefulProcessor):
    """The receipts of a vendor and amount of the last day, as three columns of numbers in order of time; a timer ends an idle key."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", "rows binary, until long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = np.concatenate([r[["us", "item_id", "employee_id"]].to_numpy(np.int64) for r in rows])
        held, until = self.kept.get() if self.kept.exists() else (b"", None)
        every = np.concatenate([np.frombuffer(held, np.int64).reshape(-1, 3), new])
        order = np.lexsort((every[:, 1], every[:, 0]))
        every, fresh = every[order], order >= len(every) - len(new)
        at = every[:, 0]
        oldest = timerValues.getCurrentWatermarkInMs() * 1000 - _DAY
        if until is not None:
            self.handle.deleteTimer(until)
        until = int(at[-1] + _DAY) // 1000 + 1
        self.handle.registerTimer(until)
        self.kept.update((every[at >= oldest].tobytes(), until))
        yield from self.found(every, fresh, np.searchsorted(at, at - _DAY, "left"), np.searchsorted(at, at, "right"))

    def found(self, every: np.ndarray, fresh: np.ndarray, begin: np.ndarray, end: np.ndarray) -> Iterator[pd.DataFrame]:
        """Rows of receipts that the new ones among them change; begin and end of the day up to each."""
        at, item, who = every.T
        # Those of the same employee: places in an order by employee, then time.
        by = np.lexsort((at, who))
        bounds = np.flatnonzero(np.r_[True, np.diff(who[by]) != 0, True])
        same = np.zeros(len(at), np.int64)
        for x, y in zip(bounds[:-1], bounds[1:], strict=True):
            t = at[by[x:y]]
            same[by[x:y]] = np.searchsorted(t, t, "right") - np.searchsorted(t, t - _DAY, "left")
        links = end - begin - same
        # The first of a day that is another's: the first at all, or the one after its run of one employee.
        after = np.r_[np.flatnonzero(np.diff(who)) + 1, len(who)]
        run_end = after[np.searchsorted(after, np.arange(len(who)), "right")]
        first = np.where(who[begin] != who, begin, run_end[begin])
        told = (at >= at[fresh].min()) & (links > 0)
        yield pd.DataFrame({"item_id": item[told], "first_id": item[first[told]], "links": links[told]})

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.kept.clear()
        return iter(())

    def close(self) -> None:
        pass


#: Pairs that are handed on together.
_PAIRS = 1 << 20


class _Pairs(_Alerts):
    """Every pair that a new receipt makes, by bounded parts."""

    def found(self, every: np.ndarray, fresh: np.ndarray, begin: np.ndarray, end: np.ndarray) -> Iterator[pd.DataFrame]:
        at, item, who = every.T
        ends = np.cumsum(end - begin)
        x = int(np.searchsorted(at, at[fresh].min()))  # none before has a new receipt in the day up to it
        while x < len(at):
            y = max(x + 1, int(np.searchsorted(ends, (ends[x - 1] if x else 0) + _PAIRS, "right")))
            n = (end - begin)[x:y]
            i = np.repeat(np.arange(x, y), n)
            j = np.arange(len(i)) + np.repeat(begin[x:y] - (np.cumsum(n) - n), n)
            pair = (who[i] != who[j]) & (fresh[i] | fresh[j])
            if pair.any():
                yield pd.DataFrame({"item_id": item[i[pair]], "other_id": item[j[pair]]})
            x = y


def _of_vendor_and_amount(receipts: DataFrame, delay: str) -> GroupedData:
    receipts.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    timed = receipts.withWatermark("ts", delay).dropna(subset=["ts", "vendor", "amount_usd", "employee_id", "item_id"])
    rows = timed.select("vendor", "amount_usd", "ts", F.unix_micros("ts").alias("us"), "item_id", "employee_id")
    return rows.groupBy("vendor", "amount_usd")


def stream_alerts(receipts: DataFrame, delay: str = "1 day") -> DataFrame:
    """(item_id, first_id, links) of each receipt with equal ones of other employees in the day up to it: the earliest and their number (STR-5).

    One row for an item instead of its pairs, for update mode: a late receipt gives the rows that it changes anew.  State is
    the receipts of the day before the watermark and later, so every row that can still change is counted whole.
    """
    return _of_vendor_and_amount(receipts, delay).transformWithStateInPandas(_Alerts(), "item_id long, first_id long, links long", "update", "EventTime")


def stream_alert_pairs(receipts: DataFrame, delay: str = "1 day") -> DataFrame:
    """(item_id, other_id): every equal receipt of another employee in the day up to each, once, when the later to come of the two comes (STR-5).

    Pairs grow with the square of equal receipts; state is those of a day, as for ``stream_alerts``, and no more than some of a receipt's pairs are held.
    """
    return _of_vendor_and_amount(receipts, delay).transformWithStateInPandas(_Pairs(), "item_id long, other_id long", "append", "EventTime")


_MOVES = "claim_id long, event_id long, from_status string, to_status string, accepted boolean"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Moves(StatefulProcessor):
    """The last accepted status of a claim and the time of its last move; a timer ends the state of an idle claim."""

    def __init__(self, edges: set[tuple[str, str]], idle_ms: int) -> None:
        self.edges, self.idle_ms = edges, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "status string, at long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:  # noqa: N802, N803
        status, at = self.last.get() if self.last.exists() else ("Draft", None)
        if at is not None:
            self.handle.deleteTimer(at + self.idle_ms)
        for r in sorted(rows, key=lambda r: (r["ms"], r["event_id"])):
            if at is not None and r["ms"] - at > self.idle_ms:
                status = "Draft"
            ok = (status, r["to_status"]) in self.edges
            yield Row(claim_id=key[0], event_id=r["event_id"], from_status=status, to_status=r["to_status"], accepted=ok)
            status, at = (r["to_status"] if ok else status), (r["ms"] if at is None else max(at, r["ms"]))
        self.last.update((status, at))
        self.handle.registerTimer(at + self.idle_ms)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def stream_transitions(moves: DataFrame, delay: str = "1 hour", idle_ms: int = 90 * 86_400_000) -> DataFrame:
    """Moves (claim_id, event_id, to_status, ts) against each claim's last accepted status, kept as state (STR-2).

    A claim begins as Draft, and again after ``idle_ms`` without a move; a move along a legal edge is accepted
    and changes the status, any other is reported and does not.  Moves of one batch are taken by time and
    event_id.  When the watermark passes the end of its idle time, a claim's state goes: no move
    that is still let in could have read it, so the batches do not show in the result.  Late moves are dropped.
    The state store is RocksDB, which value states and timers need.
    """
    moves.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    edges = {(a, b) for a, many in EDGES.items() for b in many}
    timed = moves.withWatermark("ts", delay).select("claim_id", "event_id", "to_status", "ts", F.unix_millis("ts").alias("ms"))
    return timed.groupBy("claim_id").transformWithState(_Moves(edges, idle_ms), _MOVES, "append", "EventTime")
