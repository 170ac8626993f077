"""Tables as they are read by the queries, and tables in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a table for each core below which its files may not feed all cores.
SMALL = 4 << 20
#: What a scan or an Arrow batch holds at once of texts that go to Python. The JVM holds the text of a batch some times over, in
#: large arrays that make its heap grow.
IN_PARTS = {"spark.sql.parquet.columnarReaderBatchSize": 512, "spark.sql.execution.arrow.maxRecordsPerBatch": 512, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}
SMALL_READ = 1 << 18


def spread(df: DataFrame, small: int = SMALL) -> DataFrame:
    """df dealt evenly over the cores if it is so small that few files or row groups hold all of it.

    Large tables stay as their files lie: nothing is shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < small * cores else df


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df.select(*columns) if columns else df)


def in_parts(spark: SparkSession, small_reads: bool = False) -> SparkSession:
    """A session like this one, which reads and sends all rows in parts of at most IN_PARTS; this one's settings stay.

    small_reads: what a row group has of a column comes in arrays of SMALL_READ bytes, too, not in one. The collector of the
    JVM copies them, which only pays where the query makes few objects besides.
    """
    own = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
    for key, most in IN_PARTS.items():
        told = re.match(r"\d+$", spark.conf.get(key, None) or "")
        own.conf.set(key, str(min(int(told[0]) or most, most) if told else most))
    if small_reads:
        own.conf.set("parquet.hadoop.vectored.io.enabled", "false")
        own.conf.set("parquet.read.allocation.size", str(SMALL_READ))
    return own


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or the checkpoint folder of the context.

    Where neither is set, a local master gets a temporary folder; on a cluster that is an error, for a
    folder of the driver's machine is not the executors'.
    """
    sc = spark.sparkContext
    told = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if told:
        return told.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="tokenloom-"))
    return sc.getCheckpointDir().rstrip("/")


def _filed(spark: SparkSession, path: str) -> tuple:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def scratch(spark: SparkSession, name: str) -> str:
    """A path of this name in a new folder of the shared one; the folder goes when the application ends."""
    folder = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    where, files = _filed(spark, folder)
    files.mkdirs(where)
    files.deleteOnExit(where)  # only takes what is there
    return f"{folder}/{name}"


def cut(df: DataFrame, folder: str | None = None) -> tuple[DataFrame, str]:
    """Write df as a table in the shared folder and read it back: (frame without lineage, path).

    The table goes with forget(), or when the application ends.
    """
    spark = df.sparkSession
    path = f"{folder or shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    where, files = _filed(spark, path)
    files.deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path), path


def forget(spark: SparkSession, path: str) -> None:
    """Delete a table that cut() wrote."""
    where, files = _filed(spark, path)
    files.delete(where, True)
    files.cancelDeleteOnExit(where)
