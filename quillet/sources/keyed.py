"""A keyed table: batches replace or add rows by key, and documents' rows are deleted (SRC-9, SRC-10).

The table is a folder of Parquet partitioned by ``bucket``, a hash of the key.  An upsert reads and
writes only the buckets that its batch touches (partition filter, dynamic partition overwrite);
Spark stages the new files and renames the directories when the job commits, so a job that fails
leaves the table as it was.  A bad batch is refused before anything is written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.blocks import cut

KEYS = ("tenant", "chunk_id", "spec")
BUCKETS = 64


class BadBatch(ValueError):
    """A batch that must not be written."""


def _bucket(keys: tuple[str, ...], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _write(rows: DataFrame, path: str) -> None:
    rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{path}/rows")


def _layout(spark: SparkSession, path: str) -> tuple[tuple[str, ...], int, str]:
    r = spark.read.parquet(f"{path}/layout").first()
    return tuple(r["keys"]), r["buckets"], r["columns"]


def check(batch: DataFrame, keys: tuple[str, ...] = KEYS) -> None:
    """Raise ``BadBatch`` if a key repeats or, where there is a spec, if there are several."""
    if "spec" in batch.columns:
        specs = [r[0] for r in batch.select("spec").distinct().limit(21).collect()]
        if len(specs) > 1:
            raise BadBatch(f"one spec a batch is allowed, found {sorted(map(str, specs))[:20]}")
    _unique(batch, keys)


def _unique(rows: DataFrame, keys: tuple[str, ...]) -> None:
    repeated = rows.groupBy(*keys).count().filter("count > 1")
    some = repeated.limit(20).collect()  # a report of at most 20 keys
    if some:
        raise BadBatch(f"{repeated.count()} keys repeat within the batch: {sorted(tuple(map(str, r[:-1])) for r in some)}")


def create(rows: DataFrame, path: str, keys: tuple[str, ...] = KEYS, buckets: int = BUCKETS) -> None:
    """A new table at ``path``; keys are unique in ``rows`` (of any number of specs)."""
    spark = rows.sparkSession
    _unique(rows, keys)
    columns = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    spark.createDataFrame([(list(keys), buckets, columns)], "keys array<string>, buckets int, columns string").coalesce(1).write.parquet(f"{path}/layout")
    _write(rows.withColumn("bucket", _bucket(keys, buckets)), path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the table."""
    return _stored(spark, path).drop("bucket")


def _stored(spark: SparkSession, path: str) -> DataFrame:
    _, _, columns = _layout(spark, path)
    return spark.read.schema(f"{columns}, bucket int").parquet(f"{path}/rows")


def _replace(spark: SparkSession, path: str, touched: list[int], rows: DataFrame) -> None:
    """Put ``rows`` in place of the touched buckets; those left without a row go."""
    rows = cut(rows)  # what is read is overwritten, so it is computed first
    full = {r[0] for r in rows.select("bucket").distinct().collect()}  # one row per bucket
    if full:
        _write(rows, path)
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/rows").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for b in set(touched) - full:
        fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/rows/bucket={b}"), True)


def upsert(batch: DataFrame, path: str) -> list[int]:
    """Rows of ``batch`` replace those of equal key, others are added; gives the buckets written.  A bad batch changes nothing."""
    spark = batch.sparkSession
    keys, buckets, _ = _layout(spark, path)
    stored = _stored(spark, path)
    batch = cut(batch.select(*[c for c in stored.columns if c != "bucket"]).withColumn("bucket", _bucket(keys, buckets)))
    check(batch, keys)
    touched = sorted(r[0] for r in batch.select("bucket").distinct().collect())  # one row per bucket
    if touched:
        old = stored.filter(F.col("bucket").isin(touched)).join(batch.select(*keys), list(keys), "left_anti")
        _replace(spark, path, touched, old.select(batch.columns).unionByName(batch))
    return touched


def delete(spark: SparkSession, path: str, ids: DataFrame, on: tuple[str, ...] = ("tenant", "doc_id"), spec: str | None = None) -> list[int]:
    """Delete the rows of ``ids`` by the columns ``on``, of one spec or all; gives the buckets written.  A second run changes nothing."""
    stored = _stored(spark, path)
    gone = ids.select(*on).distinct()
    hit = stored if spec is None else stored.filter(F.col("spec") == spec)
    touched = sorted(r[0] for r in hit.join(gone, list(on), "left_semi").select("bucket").distinct().collect())  # one row per bucket
    if touched:
        old = stored.filter(F.col("bucket").isin(touched))
        if spec is None:
            left = old.join(gone, list(on), "left_anti")
        else:
            left = old.join(gone.withColumn("spec", F.lit(spec)), [*on, "spec"], "left_anti")
        _replace(spark, path, touched, left.select(stored.columns))
    return touched
