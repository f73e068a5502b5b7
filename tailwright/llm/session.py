"""What the operators need from the session: the shared folder, tables that cut lineage, and safe column names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tailwright.plans import store
from tailwright.plans.store import drop_tables, shared_dir

__all__ = ["bounded", "documents", "drop_tables", "extended", "remainder", "shared_dir", "table"]


def bounded(spark: SparkSession, rows: int = 2000, size: int = 8 << 20) -> None:
    """Has Spark hand Python at most so many rows, of about so many bytes, at once, so that long texts don't fill a
    worker's memory.  Smaller settings of the session stay."""
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = spark.conf.get(name).rstrip("bB")
        if not now.lstrip("-").isdigit() or not 0 < int(now) <= most:
            spark.conf.set(name, str(most))


def table(df: DataFrame, name: str, rows: int | None = None, each: int = 2_500) -> DataFrame:
    """``df`` written to the shared folder and read again.  Where about how many ``rows`` it has is known, it is written
    by a task for ``each`` of them at most, as many tiny files cost more than they hold."""
    return store.table(df if rows is None else df.coalesce(max(1, -(-rows // each))), name)


def extended(fields: list[StructField], ddl: str) -> StructType:
    """A schema of ``fields``, whatever their names, and those of ``ddl``."""
    return StructType([*fields, *StructType.fromDDL(ddl).fields])


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def remainder(column: str, n: int):
    """crc32(column as text) mod n; a null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n
