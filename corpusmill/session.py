"""Session settings and the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def local_session(cpus: int | str = "*", **conf: str) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    n = 8 if cpus == "*" else int(cpus)
    b = SparkSession.builder.master(f"local[{cpus}]").appName("corpusmill")
    base = {
        "spark.sql.shuffle.partitions": str(n),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for k, v in (base | conf).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset on one machine (tests), a temporary one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="corpusmill-")
    return _OWN[app]


def materialise(df: DataFrame, name: str, batch: int | None = None) -> DataFrame:
    """Writes a table in the shared folder and reads it again: cuts lineage and outlives lost executors.

    ``batch`` are the rows that Python gets at once at most, for rows that hold a text or more.
    """
    spark = df.sparkSession
    at = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    held = {_CLEAN: spark.conf.get(_CLEAN, "false"), _BATCH: spark.conf.get(_BATCH)}
    spark.conf.set(_CLEAN, "true")  # the table replaces its shuffle files
    if batch and not 0 < int(held[_BATCH]) <= batch:
        spark.conf.set(_BATCH, str(batch))
    try:
        df.write.parquet(at)
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(at)


def forget(df: DataFrame) -> None:
    """Deletes the files of a table that materialise() wrote, once nothing reads it any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
