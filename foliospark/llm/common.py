"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows of an Arrow batch handed to Python; texts are long, so batches stay far below Spark's 10,000 rows.
ARROW_ROWS = 1024


def shared_dir(spark: SparkSession, tag: str) -> str:
    """A new path in the folder all executors share (spark.checkpoint.dir).

    Where that setting is absent, as in tests on one machine, a temporary folder is set for this session.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local["):
            raise RuntimeError("on a cluster, spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="foliospark-"))
        base = sc.getCheckpointDir()
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """An eager reliable checkpoint: lineage is cut and the files are in the shared folder."""
    shared_dir(df.sparkSession, "unused")  # sets a checkpoint folder where there is none
    return df.checkpoint()


def materialised(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again; for rows that carry whole texts."""
    path = shared_dir(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, path: str) -> None:
    """Deletes a folder that ``shared_dir`` named and nothing reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def shipped(spark: SparkSession, folder: str) -> list[str]:
    """Has Spark give each Parquet file of a folder to every executor; their names, for SparkFiles."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    found = [f.getPath() for f in path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)]
    files = sorted(f.toString() for f in found if f.getName().endswith(".parquet"))
    for f in files:
        spark.sparkContext.addFile(f)
    return [f.rsplit("/", 1)[1] for f in files]


def small_batches(spark: SparkSession) -> None:
    """Bounds the memory of a Python worker: a batch of very long texts is still a few hundred MB at most."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(text: str | None) -> bytes:
    """UTF-8 of a text; null is empty. A lone surrogate, which UTF-8 can't hold, becomes a question mark."""
    return b"" if text is None else text.encode("utf-8", "replace")


def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (b for b in it if b.num_rows)
