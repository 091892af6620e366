"""Session settings and the shared folder used for written intermediates."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_DIR_KEY = "spark.checkpoint.dir"
SHUFFLE_CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_LOCAL_DIRS: dict[str, str] = {}


def build_session(app_name: str = "tributary", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the operators are tuned for.

    Shuffle partition count is left to the cluster: AQE coalesces small shuffles
    and splits skewed joins, so only the upper bound has to be set per cluster.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # k-per-group filters prune inside the map tasks up to this k
        "spark.sql.optimizer.windowGroupLimitThreshold": "100000",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the session names it.

    A cluster names it in ``spark.checkpoint.dir``.  Only a local session may
    fall back to a temporary folder of this machine.
    """
    configured = spark.conf.get(CHECKPOINT_DIR_KEY, None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_DIR_KEY} to a folder that every executor can reach")
    application = spark.sparkContext.applicationId
    if application not in _LOCAL_DIRS:
        _LOCAL_DIRS[application] = tempfile.mkdtemp(prefix="tributary-")
    return _LOCAL_DIRS[application]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path that no other run uses, below :func:`shared_dir`."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path below the shared folder, and the path in it; tasks open it too."""
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", uri))


def cut_lineage(frame: DataFrame) -> DataFrame:
    """The rows of ``frame`` from a reliable checkpoint in the shared folder.

    For intermediates that several branches of a plan read: they are computed once,
    their partitioning is kept, and losing an executor does not lose them.
    """
    spark = frame.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(spark))
    return frame.checkpoint(eager=True)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """A frame that is made and written inside leaves no shuffle files; else they lie there until the driver collects garbage."""
    before = spark.conf.get(SHUFFLE_CLEANUP_KEY, None)
    spark.conf.set(SHUFFLE_CLEANUP_KEY, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP_KEY)
        else:
            spark.conf.set(SHUFFLE_CLEANUP_KEY, before)


def worked_out(frame: DataFrame, *names: str) -> DataFrame:
    """``frame`` with the named columns worked out once a row.

    A filter on a column is pushed below it and repeats its whole expression, once for each place that names it.  It
    stays above a generated row, and what is generated here is the one row that there is.
    """
    rest = [c for c in frame.columns if c not in names]
    return frame.select(*rest, F.inline(F.array(F.struct(*names)))).select(*frame.columns)
