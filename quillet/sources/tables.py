"""Business tables: reading them, and the projections that make them from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

_ITEMS = """
WITH b AS (
  SELECT l.*, o.o_custkey, {days} AS day_no,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
           l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS line_no
  FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey)
SELECT l_orderkey * 1000 + line_no AS item_id, l_orderkey AS claim_id, CAST(line_no AS INT) AS line_number,
       CAST(floor(o_custkey / 10) AS BIGINT) AS employee_id,
       CASE CAST(floor(o_custkey / 10) AS BIGINT) % 7 WHEN 0 THEN 'L1' WHEN 1 THEN 'L2' WHEN 2 THEN 'L3'
            WHEN 3 THEN 'L4' WHEN 4 THEN 'L5' WHEN 5 THEN 'Director' ELSE 'VP' END AS employee_grade,
       CASE WHEN l_partkey % 13 = 0 THEN 'Miscellaneous / Others' WHEN l_partkey % 5 = 0 THEN 'Meals'
            WHEN l_partkey % 5 = 1 THEN 'Taxi / Cab / Ride-hailing' WHEN l_partkey % 5 = 2 THEN 'Air Travel'
            WHEN l_partkey % 5 = 3 THEN 'Hotel / Lodging' ELSE 'Client / Business Entertainment' END AS category,
       CASE l_linenumber % 3 WHEN 0 THEN concat('  Uber Trip  ', CAST({vendor} AS STRING))
            WHEN 1 THEN concat('UBER TRIP ', CAST({vendor} AS STRING))
            ELSE concat('Hotel Inn ', CAST({vendor} AS STRING)) END AS merchant_vendor,
       CAST((floor(l_extendedprice / 1000) + 1) * 5 AS DECIMAL(14,2)) AS amount_usd,
       {sub} AS submission_date, {exp} AS expense_date,
       (l_linestatus = 'F' OR l_linenumber % 3 <> 0) AS receipt_attached, l_tax > 0.04 AS has_pre_approval,
       CASE WHEN l_partkey % 4 = 0 THEN 'Ann, Bo' WHEN l_partkey % 4 = 1 THEN 'Al' END AS attendees,
       CASE WHEN l_partkey % 11 = 0 THEN '{receipt}' END AS extracted_receipt,
       CASE WHEN CAST(l_quantity AS INT) % 2 = 0 THEN concat('INV-', CAST(l_partkey % 300 AS STRING)) END AS invoice_number,
       CASE l_returnflag WHEN 'R' THEN 'Rejected' WHEN 'A' THEN 'Auto_Approved' ELSE 'Submitted' END AS status
FROM b
"""
_RECEIPT = '{"prohibitedItems":["Alcohol"]}'
_HISTORY = """
SELECT event_id, user_id AS claim_id,
       CAST(row_number() OVER w AS INT) AS sequence, lag(to_status) OVER w AS from_status, to_status,
       CASE WHEN event_id % 4 = 0 THEN 'employee' WHEN event_id % 4 = 1 THEN 'system'
            WHEN event_id % 4 = 2 THEN 'manager' ELSE 'finance' END AS actor_role, ts AS occurred_at
FROM (SELECT *, CASE event_type WHEN 'signup' THEN 'Submitted' WHEN 'click' THEN 'Processing'
                     WHEN 'view' THEN 'Manager_Review' WHEN 'purchase' THEN 'Approved'
                     ELSE 'Flagged_Fraud' END AS to_status FROM {events}) e
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
"""


def items_sql(dialect: str, vendor: str = "l_suppkey % 8") -> str:
    """The projection of expense items as text for one engine ('spark' or 'duckdb')."""
    if dialect == "spark":
        return _ITEMS.format(
            lineitem="{lineitem}", orders="{orders}", vendor=vendor, receipt="{{" + _RECEIPT[1:-1] + "}}",
            days="datediff(CAST(o.o_orderdate AS DATE), DATE '1995-01-01') % 180",
            sub="date_add(DATE '2026-01-01', day_no)",
            exp="date_add(DATE '2026-01-01', CAST(day_no - l_partkey % 120 AS INT))",
        )
    return _ITEMS.format(
        lineitem="lineitem", orders="orders", vendor=vendor, receipt=_RECEIPT,
        days="(CAST(o.o_orderdate AS DATE) - DATE '1995-01-01') % 180",
        sub="DATE '2026-01-01' + CAST(day_no AS INTEGER)",
        exp="DATE '2026-01-01' + CAST(day_no - l_partkey % 120 AS INTEGER)",
    )


def history_sql(dialect: str) -> str:
    return _HISTORY.format(events="{events}" if dialect == "spark" else "events")


def load_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """All tables of a folder of Parquet tables, by name."""
    return {name: load(spark, folder, name) for name in TABLES}


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Lines that a task takes, where the session's number of shuffle partitions would give it more.
TASK_LINES = 500_000


def line_count(spark: SparkSession, folder: str) -> int:
    return load(spark, folder, "lineitem").count()  # from the footers of the files


def task_count(spark: SparkSession, folder: str) -> int | None:
    """So many tasks that none has more than ``TASK_LINES`` lines on average; none where the session's partitions do."""
    n = -(-line_count(spark, folder) // TASK_LINES)
    return n if n > int(spark.conf.get("spark.sql.shuffle.partitions")) else None


def _items(spark: SparkSession, folder: str, *vendor: str) -> DataFrame:
    lines, orders, n = load(spark, folder, "lineitem"), load(spark, folder, "orders"), task_count(spark, folder)
    if n is not None:  # a task's share stays the same however large the tables are
        lines, orders = lines.repartition(n, "l_orderkey"), orders.repartition(n, "o_orderkey")
    return spark.sql(items_sql("spark", *vendor), lineitem=lines, orders=orders)


def expense_items(spark: SparkSession, folder: str) -> DataFrame:
    """One row per expense item; vendors repeat within eight names a kind."""
    return _items(spark, folder)


def fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Expense items whose vendors grow with the data, for duplicate detection."""
    return _items(spark, folder, "l_suppkey")


def status_history(spark: SparkSession, folder: str) -> DataFrame:
    """Append-only status moves per claim; some are illegal on purpose."""
    return spark.sql(history_sql("spark"), events=load(spark, folder, "events"))
