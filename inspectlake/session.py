"""Session helper and the shared working folder."""

import pathlib
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

_PACKAGE = pathlib.Path(__file__).resolve().parent
_SHIPPED = set()


def build_session(app_name="inspectlake", master=None, **conf):
    """A session with the settings the operators are tuned for.

    Every operator also works on a session made elsewhere; these settings only
    help adaptive execution split and merge shuffle partitions.  The package is
    sent to the workers, so it need not be installed there.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.python.worker.reuse", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def ship_package(spark):
    """Send this package to the session's Python workers, once per application.

    The archive is only the hand-over to Spark, which copies it to every
    executor; nothing reads it from this machine's folder later.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    archive = pathlib.Path(tempfile.mkdtemp(prefix="spark-", dir="/tmp")) / f"{_PACKAGE.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for source in sorted(_PACKAGE.rglob("*.py")):
            z.write(source, source.relative_to(_PACKAGE.parent))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)


def shared_dir(spark):
    """The folder named in ``spark.checkpoint.dir``.

    Only a local session may fall back to a folder of this machine: executors
    elsewhere could neither write nor find it.
    """
    conf = spark.sparkContext.getConf()
    folder = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(folder)
        return folder
    in_use = spark.sparkContext.getCheckpointDir()
    if in_use:
        return in_use
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return spark.sparkContext.getCheckpointDir()


def work_dir(spark, name):
    """A new folder path for one run under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _remove_at_end(spark, path):
    """Have the folder deleted when the application ends."""
    context = spark.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(folder)


def saved(rows, name, per_file=None):
    """``rows`` written to a new folder of the shared storage and read back.

    Cuts the lineage at work that is used more than once; later steps read
    only the columns they need.  The folder goes when the application ends.
    ``per_file`` bounds the rows of a file, and so those of a task that reads them: a task
    takes one large file or a few dozen small ones, whatever their rows compress to.
    """
    path = work_dir(rows.sparkSession, name)
    writer = rows.write.option("maxRecordsPerFile", per_file) if per_file else rows.write
    writer.parquet(path)
    _remove_at_end(rows.sparkSession, path)
    return rows.sparkSession.read.parquet(path)
