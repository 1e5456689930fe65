"""Session helpers: nothing here overrides what the cluster has set."""

import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app="pageaudit", cpus="8", partitions="8", memory="12g") -> SparkSession:
    """Session for tests and the benchmark; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # building large expressions from Python is several times faster without call sites
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        # sessions of a busy key shrink before the shuffle
        .config("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
        .config("spark.driver.extraJavaOptions", "-Xss16m")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and written intermediate tables.

    A folder already set on the context or named by ``spark.checkpoint.dir`` wins;
    otherwise a folder below the session's warehouse, which all executors share.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    sc.setCheckpointDir(named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, kind: str) -> str:
    """A fresh folder below the shared checkpoint folder, as a full address."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{ensure_checkpoint_dir(spark)}/{kind}-{uuid.uuid4().hex[:12]}")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()


def written(df: DataFrame, kind: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back from there.

    Cuts the lineage; later reads survive lost executors, and a join of the table
    starts from its own exchange, so that skewed partitions can be split.
    """
    path = scratch_path(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame) -> DataFrame:
    """``df`` for a join that deals both sides out by the key, however small Spark thinks it is.

    Spark sends a side whole to the driver and to every task if its compressed files are small; the rows of numbers
    in them take ten times that and more in the driver's memory, several tables at a time.
    """
    return df.hint("merge")


def drop_scratch(spark: SparkSession) -> None:
    """Removes what this application wrote to the shared folder; results that were not saved go with it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(ensure_checkpoint_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
