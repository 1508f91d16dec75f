"""Where jobs keep intermediate tables, and the few file-system calls they need."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

_SCRATCH: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


def tune(spark: SparkSession) -> SparkSession:
    """Session settings for listings tables. All can be changed per session.

    A projection of 60 and more cleaning expressions fused into one generated method
    is too long for the JVM to compile, or even for a class file. Above 50 columns
    the stages are left unfused: their expressions then sit in methods of their own.
    Narrow plans, such as the reports, stay fused. Rows that are dealt to a few folders
    are written to them side by side; without that, wide text is sorted by folder first.
    """
    spark.conf.set("spark.sql.codegen.maxFields", 50)
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", 8000)
    spark.conf.set("spark.sql.maxConcurrentOutputFileWriters", 16)
    return spark


def shared_root(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    A machine-local folder is only set up when the whole session is one process.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    root = tempfile.mkdtemp(prefix="hearthline-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; nothing is created yet."""
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str, *, temporary: bool = True, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts lineage and survives lost executors: later stages read committed files
    instead of recomputing their input. ``temporary`` tables go with the ``scratch`` block
    they are written in.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    if temporary and (kept := _SCRATCH.get()) is not None:
        kept.append(path)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Remove the tables ``stored`` writes in this block when it ends.

    For jobs that write their own result; a result that is still to be read keeps its
    tables.
    """
    kept: list[str] = []
    token = _SCRATCH.set(kept)
    try:
        yield
    finally:
        _SCRATCH.reset(token)
        for path in kept:
            remove_path(spark, path)


def _hadoop(spark: SparkSession, path: str):
    """File system and path object for ``path``, whatever store it lives in."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _hadoop(spark, path)
    return fs.exists(p)


def path_bytes(spark: SparkSession, path: str) -> int:
    """Bytes below ``path``; a name-node call, no data is read."""
    fs, p = _hadoop(spark, path)
    return fs.getContentSummary(p).getLength()


def remove_path(spark: SparkSession, path: str) -> None:
    fs, p = _hadoop(spark, path)
    fs.delete(p, True)


def child_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none if there is no such folder."""
    fs, p = _hadoop(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(p)) if fs.exists(p) else []


def read_small_file(spark: SparkSession, path: str) -> str:
    """A small file as text, all of it."""
    fs, p = _hadoop(spark, path)
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _written_aside(spark: SparkSession, path: str, text: str):
    """A whole new file beside ``path``, with its file system and both path objects."""
    fs, target = _hadoop(spark, path)
    _, fresh = _hadoop(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    stream = fs.create(fresh)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    return fs, target, fresh


def create_small_file(spark: SparkSession, path: str, text: str) -> None:
    """A whole new file under its name; ``FileExistsError`` if there is one already.

    Of writers that try at the same time one succeeds: by a hard link on a local file
    system, else by a rename that does not replace.
    """
    fs, target, fresh = _written_aside(spark, path, text)
    jvm = spark.sparkContext._jvm
    try:
        if fs.getUri().getScheme() == "file":
            local = jvm.java.io.File
            jvm.java.nio.file.Files.createLink(local(target.toUri().getPath()).toPath(), local(fresh.toUri().getPath()).toPath())
        elif fs.exists(target) or not fs.rename(fresh, target):
            raise FileExistsError(path)
    except Py4JJavaError as error:
        if "FileAlreadyExists" not in str(error.java_exception):
            raise
        raise FileExistsError(path) from error
    finally:
        fs.delete(fresh, False)


def replace_small_file(spark: SparkSession, path: str, text: str) -> None:
    """A small file that may be lost or old: readers have to do without it."""
    fs, target, fresh = _written_aside(spark, path, text)
    fs.delete(target, False)
    if not fs.rename(fresh, target):
        fs.delete(fresh, False)
