"""Intermediate tables in the folder that all machines of the cluster share."""

from __future__ import annotations

import gc
import io
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_shipped: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; set here only where it is unset and all runs in one process, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
        named = f"file://{tempfile.mkdtemp(prefix='quillpack-')}"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def ship_code(spark: SparkSession) -> None:
    """Sends this package to the executors once per application, so that Python workers can import it."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as archive:
        for file in sorted(root.rglob("*.py")):
            archive.write(file, file.relative_to(root.parent))
    path = os.path.join(tempfile.mkdtemp(prefix="quillpack-code-"), "quillpack_code.zip")
    Path(path).write_bytes(packed.getvalue())
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


@contextmanager
def shuffles_end(spark: SparkSession) -> Iterator[None]:
    """What runs inside leaves no shuffle files behind; its results must not depend on them."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def settle(df: DataFrame) -> DataFrame:
    """Computes df now and cuts its lineage with a reliable checkpoint."""
    shared_folder(df.sparkSession)
    tidy(df.sparkSession)
    trim(df.sparkSession)
    with shuffles_end(df.sparkSession):
        return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files and checkpoints of frames that are no longer referenced."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def tidy(spark: SparkSession) -> bool:
    """Whether the driver's heap had grown beyond half its bound; if so it is collected, which gives memory back to the system.

    Plans and task events are garbage soon, but left alone the heap grows to its bound in a query of very many steps.
    """
    runtime = spark.sparkContext._jvm.java.lang.Runtime.getRuntime()
    grown = 2 * runtime.totalMemory() > runtime.maxMemory()
    if grown:
        release(spark)
    return grown


def trim(spark: SparkSession) -> bool:
    """Whether the driver's JVM gave back to the system what it had freed outside its heap; not all JVMs can (OpenJDK on Linux can from 17.0.9).

    Compiling the code of many steps leaves such memory in malloc's arenas, which no collection of the heap returns.
    """
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    try:
        # by the interface's method, as the server's own class is not open to py4j
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        what = gateway.new_array(jvm.java.lang.Object, 4)
        what[0], what[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), what)
    except Py4JError:
        return False
    return True


class Scratch:
    """Parquet tables of one query in the shared folder, removed by drop() or at the end of a with block."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_folder(spark).rstrip('/')}/quillpack-{uuid.uuid4().hex}"

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        self.drop()

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        tidy(self.spark)
        trim(self.spark)
        with shuffles_end(self.spark):
            df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def local_path(self, name: str) -> str:
        """A folder below the shared one as a mounted path, for files that Python workers map into memory."""
        if "://" in self.root and not self.root.startswith("file://"):
            raise ValueError(f"memory-mapped files need spark.checkpoint.dir on a mounted file system, not {self.root}")
        return f"{self.root.removeprefix('file://').removeprefix('file:')}/{name}"

    def drop(self, name: str = "") -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
