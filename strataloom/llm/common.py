"""What the operators share: documents as a frame, written tables in the cluster's shared folder, null-safe columns."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENTS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with a null text as the empty one; any other columns, whatever their names, are left behind."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def arrow_rows(spark: SparkSession, rows: int = 1000) -> None:
    """Bound the rows of an Arrow batch: texts are long, and a batch of them lies in the worker's memory."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) != rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir. Only a local master gets a temporary one."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors see")
        folder = tempfile.mkdtemp(prefix="strataloom-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


class Tables:
    """Parquet tables in the shared folder that cut a job's lineage: a lost executor loses none of them.

    They live as long as the application, as the frames that an operator returns may read them late.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.n = 0
        atexit.register(self._drop, self.base)

    def write(self, df: DataFrame, name: str, *by: str) -> DataFrame:
        """The table as it is read back, in a folder for each value of the columns by."""
        self.n += 1
        path = f"{self.base}/{self.n:03d}-{name}"
        df.write.partitionBy(*by).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _drop(self, path: str) -> None:
        try:
            jvm = self.spark.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session has ended before
            pass
