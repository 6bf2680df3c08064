"""What the operators of this subpackage share: lineage cuts, row keys and text pieces."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that part words in most of the operators' contracts.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"


def session(df: DataFrame) -> SparkSession:
    return df.sparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, made known to Spark where it is not yet.

    ``spark.checkpoint.dir`` names it.  Where that is unset, one machine (a test)
    takes a folder of its own and a cluster the warehouse, which all machines see.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and re.fullmatch(r"local(\[.*)?", context.master):
            named = tempfile.mkdtemp(prefix="spark-")
        context.setCheckpointDir(named or spark.conf.get("spark.sql.warehouse.dir") + "/_intermediate")
    return context._jsc.sc().getCheckpointDir().get()


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, the same on every later read."""
    path = f"{shared_folder(session(df))}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return session(df).read.schema(df.schema).parquet(path)


def delete_folder(spark: SparkSession, path: str) -> None:
    """Remove an intermediate table that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def with_row_ids(docs: DataFrame) -> DataFrame:
    """(rid, row): every row of ``docs`` whole under an id of its own.

    Written to the shared folder, so that the ids hold whatever is computed again.
    Decisions are made per rid, never per doc_id, which may be null or repeated.
    """
    return written(docs.select(F.monotonically_increasing_id().alias("rid"), F.struct("*").alias("row")), "rows")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint.

    The files go to the folder that the cluster names in
    ``spark.checkpoint.dir``; only where that is unset (tests, a laptop) a
    folder is made.  Executors can be lost afterwards without a recompute.
    """
    shared_folder(session(df))
    return df.checkpoint(eager=True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
