"""Work tables: results written below a folder that driver and executors share, and read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def workspace(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir, which driver and executors share.

    Only where that setting is absent and everything runs on one machine (tests), a temporary folder stands in.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="foliant-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/work-{uuid.uuid4().hex}"


def stored(df: DataFrame, packed: bool = False, by: str | None = None, dealt: tuple[str, int] | None = None) -> DataFrame:
    """Cut the lineage: write df to the shared folder and read it again. packed: already compressed; by: a column of few
    values whose rows are read apart; dealt: a column by which df is in so many partitions already, and stays so."""
    spark, path = df.sparkSession, workspace(df.sparkSession)
    writer = df.write.option("compression", "none" if packed else "zstd")
    writer = writer.partitionBy(by) if by else writer
    if dealt:
        # a document's rows lie together, so joins by more columns than its id need no exchange either
        spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
        table = f"work_{uuid.uuid4().hex}"
        writer.bucketBy(dealt[1], dealt[0]).option("path", path).saveAsTable(table)
        out = spark.table(table).select(*df.columns)
    else:
        writer.parquet(path)
        out = spark.read.schema(df.schema).parquet(path)
    if by:  # what is not there need not be planned
        out._present = values_of(spark, path)
    return out


def values_of(spark: SparkSession, path: str) -> set[str]:
    """Values of the column by which a work table was partitioned: the names of its folders."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)
    return {s.getPath().getName().partition("=")[2] for s in found if s.isDirectory()}


def spread(df: DataFrame) -> DataFrame:
    """df, a plain scan, over all cores where its files make fewer partitions than there are cores: what follows is
    dearer than moving so little. Scans of as many partitions and more stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df
