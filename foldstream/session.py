"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_roots: dict[str, str] = {}


def build_session(app: str = "foldstream", master: str | None = None, **conf) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # keep the skew split even when an aggregate on the join key follows
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only on a local master."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        root = _local_roots.get(sc.applicationId)
        if root is None:
            root = _local_roots[sc.applicationId] = tempfile.mkdtemp(prefix="foldstream-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _files(spark: SparkSession, path: str):
    """The file system of a path, as Spark knows it, and the path there."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(conf), at


def write_small(spark: SparkSession, path: str, text: str) -> None:
    """A small file, replaced as a whole."""
    fs, at = _files(spark, path)
    out = fs.create(at, True)
    out.write(bytearray(text.encode()))
    out.close()


def read_small(spark: SparkSession, path: str) -> str:
    fs, at = _files(spark, path)
    stream = fs.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def folders_in(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder."""
    fs, at = _files(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory()]


def remove_path(spark: SparkSession, path: str) -> None:
    """Remove what this library wrote below its own scratch folder."""
    fs, at = _files(spark, path)
    fs.delete(at, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of steps that are done. It does when the driver's collector finds that nothing names them,
    which on a driver with memory to spare it looks for every half hour."""
    spark._jvm.System.gc()


def staged(df: DataFrame, name: str) -> DataFrame:
    """The rows, written once as Parquet in the shared folder; later steps read what they need of them."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows once to the shared folder and continue from there."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint()
