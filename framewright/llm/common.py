"""What the operators share: tables, the shared work folder, key handling."""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright import work
from framewright.work import new_path, shared_dir  # noqa: F401  (the operators take them from here)

#: ASCII white space: the only characters that part words (0x20 and 0x09-0x0D).
SPACE = r"[\x20\x09-\x0D]+"

#: Stands for a null document id in joins; no document may use it.
NO_ID = -(2**63)


#: Rows of an Arrow batch: texts can be long, and both sides of the Python boundary hold whole batches.
BATCH_ROWS = 1000


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batch size to BATCH_ROWS where it is larger."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    bound_batches(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it again: cuts lineage, survives lost executors."""
    bound_batches(df.sparkSession)
    return work.stored(df, name)


#: For tables whose rows are megabytes.  Parquet looks at a row group's size only after 100 rows by itself, and a reader
#: holds what a row group has; the Arrow bound is in bytes, as 1000 such rows are gigabytes.
ROW_GROUP_BYTES, BATCH_BYTES = 16 << 20, 16 << 20


def stored_long(df: DataFrame, name: str) -> DataFrame:
    """Like stored, for rows of megabytes: no writer, reader or Arrow batch holds more than a few of them."""
    spark = df.sparkSession
    bound_batches(spark)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key)  # -1: no bound
    if now.startswith("-") or spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(now) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))
    path = new_path(spark, name)
    checks = {f"parquet.{of}.size.row.check.min": "1" for of in ("block", "page")}
    df.write.options(compression="zstd", **{"parquet.block.size": str(ROW_GROUP_BYTES)}, **checks).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished steps that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def clear_names(taken: list[str], *wanted: str) -> list[str]:
    """The wanted names, each made longer until no taken one equals it (Spark's names have no case)."""
    used, out = {c.lower() for c in taken}, []
    for name in wanted:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def columns_of(df: DataFrame, *but: str) -> list[Column]:
    """df's columns, whatever their names, without those named."""
    left_out = {c.lower() for c in but}
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns if c.lower() not in left_out]


def key_of(column: str | Column) -> Column:
    """A document id that equals itself in joins even when null."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(c.cast("long"), F.lit(NO_ID))


def text_of(column: str | Column) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(c, F.lit(""))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(words: bytes) -> bytes:
    """Lower-cases A-Z only."""
    return words.lower()  # bytes.lower() leaves bytes over 0x7F alone


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")
