"""Session defaults and the two helpers that touch shared storage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None, **conf) -> SparkSession:
    """A session with the defaults above; ``master`` only for local runs."""
    builder = SparkSession.builder.appName("patronlens")
    if master:
        builder = builder.master(master)
    settings = dict(DEFAULTS)
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update({k.replace("__", "."): str(v) for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session, whose executors are this
    one process, may fall back to a temporary folder.
    """
    sc = spark.sparkContext
    folder = sc.getCheckpointDir()
    if folder is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
            folder = tempfile.mkdtemp(prefix="patronlens-")
        sc.setCheckpointDir(folder)
        folder = sc.getCheckpointDir()
    return folder


_steps: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a written table in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and go on from there.

    Used before a plan is read several times, and once per round in iterative operators. Later steps
    read only the columns they need, the planner knows the table's true size, and a lost executor
    costs only its own tasks.
    """
    path = scratch_path(df.sparkSession, "step")
    _steps.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tasks(spark: SparkSession) -> int:
    """How many tasks keep all cores busy to the end of a step whose rows cost unequal time."""
    return 3 * spark.sparkContext.defaultParallelism


def spread(df: DataFrame) -> DataFrame:
    """``df`` written as ``cut_lineage`` does, dealt evenly over the cores.

    For tables that many rounds or costly comparisons go over: shuffles and files are cut by bytes, so such
    a table would otherwise be the work of one or two tasks, however long its rows take.
    """
    return cut_lineage(df.repartition(tasks(df.sparkSession)))


def release_steps(spark: SparkSession) -> int:
    """Delete the step tables this process has written; results built on them must be saved before."""
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    released = 0
    while _steps:
        path = spark._jvm.org.apache.hadoop.fs.Path(_steps.pop())
        released += bool(path.getFileSystem(conf).delete(path, True))
    return released
