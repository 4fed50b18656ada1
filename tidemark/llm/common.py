"""Helpers that several training-data operators share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of an Arrow batch on its way to Python.
BATCH = 16 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see: the session's spark.checkpoint.dir. Only a session without executors of its own (master local) gets one of ours where none is set; on a cluster that is an error, as executors would not see each other's files."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete through Spark's file systems, so that any store works."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _forget(spark: SparkSession, path: str) -> None:
    try:
        drop_folder(spark, path)
    except Exception:  # noqa: BLE001  the session has ended before us
        pass


def new_folder(spark: SparkSession, label: str) -> str:
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    atexit.register(_forget, spark, path)
    return path


def settle(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write the rows as Parquet to the shared folder and read them back. Lost executors cost nothing then."""
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.settled_at = path
    return out


def release(settled: DataFrame) -> None:
    """Delete a settled table that nothing reads any more."""
    drop_folder(settled.sparkSession, settled.settled_at)


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the third of documents that no model may learn from; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def texts(batch: pa.RecordBatch, name: str) -> list[str]:
    """The column's values, null as an empty string."""
    return ["" if x is None else x for x in batch.column(name).to_pylist()]


def in_slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a slice holds about limit bytes of the column (a row at least): bounds what a worker builds at once."""
    for batch in batches:
        start, size = 0, 0
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        for i, n in enumerate(lengths):
            if size and size + n > limit:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        yield batch.slice(start)


def smallest_hashes(rows: DataFrame, of: Column, most: int) -> DataFrame:
    """The rows whose hash (column of) is among the `most` smallest: a bounded sample that follows from the rows. Only hashes travel to one task; rows that are equal share theirs and stay together."""
    hashed = rows.withColumn("__h", of)
    bound = hashed.select("__h").orderBy("__h").limit(most).agg(F.max("__h")).first()[0]
    return hashed.filter(F.col("__h") <= bound) if bound is not None else hashed.filter(F.lit(False))


def arrow_rows(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """df through a function over Arrow batches of at most 16 MB or so (a row at least), whatever the session's default."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    return df.mapInArrow(work, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value evaluated once; lambdas have no common subexpressions."""
    return F.transform(F.array(value), use)[0]
