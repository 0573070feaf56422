"""Session settings and the two ways this package cuts a plan in pieces."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("treeshift")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a fresh one if unset in local mode."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get(
        "spark.checkpoint.dir"
    )
    if not configured and not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="treeshift-ckpt-"))
    return context.getCheckpointDir()


_folders: list[tuple[SparkSession, str]] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder, removed when the driver ends."""
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _folders:
        atexit.register(_remove)
    _folders.append((spark, path))
    return path


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def _remove() -> None:
    for spark, path in _folders:
        try:
            _delete(spark, path)
        except Exception:  # the JVM has gone already; the folder is scratch space
            return


#: Folders of the cuts made since the innermost ``settled`` began.
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)
#: While a cut is written: its shuffles leave the disk with it, and a table's size is
#: not taken from its compressed files, from which a broadcast would be many times larger.
CUTTING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.sources.fileCompressionFactor": "20",
}


def _note(path: str) -> None:
    made = _made.get()
    if made is not None:
        made.append(path)


@contextlib.contextmanager
def _settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    before = {key: spark.conf.get(key, None) for key in wanted}
    try:
        for key, value in wanted.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and go on from the written files.

    Used where a result feeds several branches of one plan, or a loop would
    otherwise grow its lineage. The files outlive a lost executor. They are Parquet,
    unlike those of ``checkpoint()``: compressed, and read by column. Rows come back
    in any order.
    """
    path = scratch(df.sparkSession, "cut")
    with _settings(df.sparkSession, CUTTING):
        df.write.option("compression", "zstd").parquet(path)
    _note(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(build: Callable[[], DataFrame]) -> DataFrame:
    """Cut what ``build`` gives, and remove the cuts made on the way to it.

    None of those may be used elsewhere: not kept by ``build``, nor part of what it gives
    besides the table.
    """
    inner: list[str] = []
    token = _made.set(inner)
    try:
        out = cut(build())
    finally:
        _made.reset(token)
    _note(inner.pop())
    for path in inner:
        _delete(out.sparkSession, path)
    return out
