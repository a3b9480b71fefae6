"""Session defaults and stage boundaries."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

Found = TypeVar("Found")

_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "ludometry", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are tested under.

    ``conf`` keys use ``__`` for dots (``spark__sql__shuffle__partitions="8"``).
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**_DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for stage boundaries.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session may
    fall back to a temporary folder: on a cluster that would be a machine-local
    path other executors cannot read, so an unset value is an error there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="ludometry-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts lineage, gives the planner true sizes, keeps column pruning for the
    passes that follow, and survives the loss of any executor. Used where an
    operator reads an intermediate result several times.
    """
    spark = df.sparkSession
    path = os.path.join(checkpoint_dir(spark), f"stage-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def side_by_side(spark: SparkSession, tasks: Mapping[str, Callable[[], Found]]) -> dict[str, Found]:
    """Results of independent drivers' work, such as model fits, run at the same time.

    Each task has a thread of its own with the caller's local properties, and a
    scheduler pool of its own, so that a session with the fair scheduler shares
    its slots between them.
    """

    def alone(name: str, task: Callable[[], Found]) -> Found:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", name)
        return task()

    with ThreadPoolExecutor(max(1, len(tasks))) as threads:
        running = {name: threads.submit(inheritable_thread_target(spark)(alone), name, task) for name, task in tasks.items()}
        return {name: work.result() for name, work in running.items()}


#: Rows of a training set that are worth a task, and the most a task gets.
_ROWS_A_TASK, _ROWS_AT_MOST = 50_000, 1_000_000


def few_tasks(rows: DataFrame, fits: int = 1) -> DataFrame:
    """``rows``, written, in no more partitions than their number is worth.

    A fit runs several jobs for each tree, so a small training set is paid for
    in tasks, not in rows. ``fits`` that run at the same time get equal parts,
    so many that the tasks of all fit into the session's slots together; a part
    has a bounded number of rows all the same.
    """
    written = materialize(rows)
    n = written.count()
    worth = max(1, -(-n // _ROWS_A_TASK))
    if fits == 1 or worth == 1:
        return written.coalesce(worth)
    share = max(1, written.sparkSession.sparkContext.defaultParallelism // fits)
    return written.repartition(min(worth, share * -(-n // (share * _ROWS_AT_MOST))))
