"""Session helpers shared by the training-data operators: the cluster's shared
folder, written tables that cut lineage, and portable file access for code that
runs inside tasks."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
#: What workers keep between the tasks of one stage, such as tokenizers with their memos.
CACHES: list[dict] = []
_STAGE: list[int | None] = [None]
_LIBC = ctypes.CDLL(None)


def enter_stage() -> None:
    """Called by code that runs in a task: a worker outlives its stage, so what it kept
    for another stage goes before new work starts."""
    context = TaskContext.get()
    stage = context.stageId() if context else None
    if stage != _STAGE[0]:
        _STAGE[0] = stage
        for c in CACHES:
            c.clear()
        trim()


def trim() -> None:
    """Called at a task's end: an idle worker gives its freed memory back."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor shares: ``spark.checkpoint.dir`` of the session.

    Only where that is unset and the master is ``local`` (tests, one machine) a folder
    of our own is made and set as the checkpoint folder; a cluster without one is an error,
    as executors share no machine's temporary folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="newsloom-")
        spark.sparkContext.setCheckpointDir(_OWN[app])
    return _OWN[app]


_RECORD: ContextVar[list[str] | None] = ContextVar("record", default=None)


def run_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one; its name is never reused."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    record = _RECORD.get()
    if record is not None:
        record.append(path)
    return path


@contextmanager
def recorded(folders: list[str]):
    """Notes the folders made inside, for ``dropped``."""
    token = _RECORD.set(folders)
    try:
        yield
    finally:
        _RECORD.reset(token)


def dropped(folders: list[str]) -> None:
    """Delete folders that no frame still in use reads."""
    while folders:
        fs, inner = open_fs(folders.pop())
        if fs.get_file_info(inner).type == pafs.FileType.Directory:
            fs.delete_dir(inner)


@contextmanager
def scratch():
    """``with scratch():`` call an operator and write its result inside; the folders it
    made in the shared one are deleted at the end."""
    made: list[str] = []
    try:
        with recorded(made):
            yield
    finally:
        dropped(made)


def written(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` as Parquet to ``path`` and read it back: a lineage cut whose
    files outlive the executors."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Texts have no size bound, so Arrow batches hold few of them."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI or plain path, and the path within it."""
    return pafs.FileSystem.from_uri(path if ":" in path.split("/")[0] else "file://" + path)


def free_name(taken, name: str) -> str:
    """``name``, or ``name`` with underscores appended until it clashes with no
    column of the input (Spark compares names without regard to case)."""
    have = {c.lower() for c in taken}
    while name.lower() in have:
        name += "_"
    return name
