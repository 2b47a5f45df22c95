"""Streaming import: new statement files of a folder become statement rows and transactions as they arrive.

Each micro-batch is one idempotent append: its rows are joined against what is there, and its directory is named by the
batch, so a batch that is run again after a failure replaces what it wrote. A file that can't be read at all, for a column
that is missing or its size, is a row of the table FAILED.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import types as T
from ..operators import convert, importing
from ..sources import statements

#: Table of files that can't be read, and its columns.
FAILED, FAILED_ROW = "failed_files", "source_path string, source_sha256 string, schema_error string"


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table of batch directories, empty if none is there yet."""
    empty = spark.createDataFrame([], schema)
    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch=*"))
    return spark.read.schema(empty.schema).parquet(f"{path}/batch=*") if found and len(found) else empty


def import_stream(spark: SparkSession, folder: str, out: str, layout: statements.Adapter, options: convert.Options) -> StreamingQuery:
    """Imports files that are in folder and those that come; stop() ends it, processAllAvailable() waits."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    raw = statements.files_of(files).mapInArrow(statements.parsed(layout), statements.RAW)

    def append(rows: DataFrame, number: int) -> None:
        session = rows.sparkSession
        converted = convert.convert(rows.where("schema_error is null"), layout.id, options).cache()
        before = stored(session, f"{out}/transactions", T.TRANSACTION)
        before = before.where(F.input_file_name().rlike(f"/batch={number}/") == F.lit(False))  # not what a failed run of this batch wrote
        new = importing.new_transactions(convert.transactions(converted), before.select("id"))
        new.write.mode("overwrite").parquet(f"{out}/staged/batch={number}")
        done = session.read.schema(new.schema).parquet(f"{out}/staged/batch={number}")
        done.write.mode("overwrite").parquet(f"{out}/transactions/batch={number}")
        convert.statement_rows(converted, layout.id, options).write.mode("overwrite").parquet(f"{out}/statement_rows/batch={number}")
        rows.where("schema_error is not null").select("source_path", "source_sha256", "schema_error").write.mode("overwrite").parquet(f"{out}/{FAILED}/batch={number}")
        converted.unpersist()

    return raw.writeStream.foreachBatch(append).option("checkpointLocation", f"{out}/checkpoint").start()
