"""Session defaults and the shared work folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_ROOTS: dict[str, str] = {}


# Settings that decide results, as opposed to speed.
PINNED = {
    "spark.sql.session.timeZone": "UTC",
    # JSON with a repeated key is valid; the last value counts.
    "spark.sql.variant.allowDuplicateKeys": "true",
}


def pin(spark: SparkSession) -> SparkSession:
    for key, value in PINNED.items():
        spark.conf.set(key, value)
    return spark


def session(app: str = "tidelog", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time and adaptive execution.

    On a cluster leave ``master`` unset; partition counts then come from the
    submit configuration, and AQE coalesces or splits them at run time.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false")
    defaults = {
        **PINNED,
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_dir(spark: SparkSession, label: str) -> str:
    """A fresh path under the folder named by ``spark.checkpoint.dir``.

    That folder is shared by all executors. Only a local session may fall back
    to a temporary folder of its own, which goes when the process ends.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        sc = spark.sparkContext
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
        if sc.applicationId not in _LOCAL_ROOTS:
            _LOCAL_ROOTS[sc.applicationId] = tempfile.mkdtemp(prefix="tidelog-")
            atexit.register(shutil.rmtree, _LOCAL_ROOTS[sc.applicationId], ignore_errors=True)
        root = _LOCAL_ROOTS[sc.applicationId]
    else:
        root = qualified(spark, root)
    application = spark.sparkContext.applicationId
    return f"{root.rstrip('/')}/tidelog/{application}/{label}-{uuid.uuid4().hex[:12]}"


def release(spark: SparkSession) -> None:
    """Remove all that this application has written to its work folder.

    Call it when no result that is still to be computed needs that: operators return
    plans that read these tables.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(work_dir(spark, "any")).getParent()
    folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its file system, so that tasks outside the JVM open the same one."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return files.makeQualified(folder).toString()


def materialize(frame: DataFrame, label: str) -> DataFrame:
    """Write a result that several parts of a plan use, and read it back.

    It survives the loss of executors and is computed once.
    """
    path = work_dir(frame.sparkSession, label)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
