"""Session settings and the shared checkpoint folder."""

import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, name: str = "paperloom", **conf) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a scratch one in local runs only."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    current = context.getCheckpointDir()
    if named:
        if current is None:
            context.setCheckpointDir(named)
        return named
    if current:
        return current
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    scratch = tempfile.mkdtemp(prefix="paperloom-checkpoint-")
    context.setCheckpointDir(scratch)
    return scratch


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder, so lost executors do not lose it."""
    checkpoint_dir(df.sparkSession)
    with _shuffles_dropped(df.sparkSession):
        return df.select("*").checkpoint(eager=True)


def write_through(df: DataFrame) -> DataFrame:
    """Like ``cut_lineage`` for wide tables that are read several times.

    A Parquet table in the checkpoint folder lets every reader take only the columns it
    needs, such as vectors without texts.  The table goes when the application ends, or
    with ``release``.
    """
    spark = df.sparkSession
    path = scratch_folder(spark)
    with _shuffles_dropped(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go with the query that wrote them: nothing reads them once its result is stored."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def discard(table: DataFrame) -> None:
    """Delete a table that ``write_through`` returned; nothing may read it any more."""
    spark = table.sparkSession
    files = {f.rpartition("/")[0] for f in table.inputFiles()}
    for path in [p for p in _WRITTEN.get(spark.sparkContext.applicationId, []) if any(f.endswith(p.rpartition("/")[2]) for f in files)]:
        folder, store = stored_path(spark, path)
        store.delete(folder, True)
        _WRITTEN[spark.sparkContext.applicationId].remove(path)


def scratch_folder(spark: SparkSession) -> str:
    """A new path in the checkpoint folder, deleted as ``write_through`` says."""
    path = f"{checkpoint_dir(spark)}/table-{uuid.uuid4()}"
    folder, store = stored_path(spark, path)
    store.deleteOnExit(folder)
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def release(spark: SparkSession) -> None:
    """Delete the tables written so far; results that still read them must be stored before."""
    for path in _WRITTEN.pop(spark.sparkContext.applicationId, []):
        folder, store = stored_path(spark, path)
        store.delete(folder, True)


_WRITTEN: dict[str, list[str]] = {}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored_path(spark: SparkSession, path: str):
    """A path and the file system that holds it."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application.

    Needed where a job starts outside the repository and neither ``PYTHONPATH`` nor
    ``--py-files`` gives the workers the package.
    """
    context = spark.sparkContext
    if getattr(context, "_paperloom_shipped", False):
        return
    package = Path(__file__).resolve().parent
    if package.parent.is_dir():  # not a zip that was shipped itself
        zipped = shutil.make_archive(
            f"{tempfile.mkdtemp(prefix='paperloom-')}/{package.name}", "zip", package.parent, package.name
        )
        context.addPyFile(zipped)
    context._paperloom_shipped = True
