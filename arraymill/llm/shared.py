"""Tables in the shared folder, document keys and vocabulary paths for the corpus operators.

An operator cuts lineage by writing a table below ``spark.checkpoint.dir``, which the driver and
every executor reach, and reading it again: a lost executor then costs only the tasks it ran.
Tables that a later step replaces are deleted at once, the rest when the driver ends. With each table
the driver's JVM returns the native memory that planning and compiling it took and freed.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import uuid
import weakref

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.cut import checkpoint_folder

_open: dict[str, weakref.ref] = {}


def drop_table(spark: SparkSession, path: str) -> None:
    """Delete a written table; a path that is already gone is no error."""
    _open.pop(path, None)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def _at_exit() -> None:
    for path, ref in list(_open.items()):
        spark = ref()
        try:
            if spark is not None and spark.sparkContext._jsc is not None:
                drop_table(spark, path)
        except Exception:  # noqa: BLE001  the JVM may be gone already
            pass


atexit.register(_at_exit)


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` written as a compressed table in the shared folder and read back, with its path."""
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/arraymill/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _open[path] = weakref.ref(spark)
    give_back_driver(spark)
    return spark.read.schema(df.schema).parquet(path), path


def give_back() -> None:
    """Return freed memory to the system, which a worker that waits for its next task else keeps."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries than glibc have no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def give_back_driver(spark: SparkSession) -> None:
    """Return native memory that the driver's JVM has freed to the system; the arenas of its hundreds of threads else keep it."""
    with contextlib.suppress(Py4JError):  # a JVM without this command keeps it
        jvm = spark._jvm
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        args = spark.sparkContext._gateway.new_array(jvm.Object, 4)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        # by the interface: Python can't call methods of the server's own class, which its module doesn't open
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        invoke.invoke(server, args)


def text_or_empty(col: str | Column = "text") -> Column:
    """The text, with null read as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def text_key(col: str | Column = "text") -> Column:
    """64 bits of a text that tell apart rows of one doc_id."""
    return F.xxhash64(text_or_empty(col))


def same_id(left: Column, right: Column) -> Column:
    """Equality of ids under which null equals null."""
    return left.eqNullSafe(right)
