"""Arrays from and to raw binary and delimited text, read and written by Spark so that any store works."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.grid import Grid
from ..plans.ordered import ranked

#: Values in a chunk of a binary file or a line of a text file.
CHUNK = 65_536


def from_string(text: Column, sep: str = " ") -> Column:
    """Numbers of a delimited text as an array, up to the first part that is no number."""
    parts = F.transform(F.filter(F.split(text, "[" + ("\\s" if sep == " " else "\\" + sep) + "]+"), lambda p: p != ""), lambda p: p.try_cast("double"))
    stop = F.array_position(F.transform(parts, lambda p: p.isNull()), True)
    return F.when(stop > 0, F.slice(parts, F.lit(1), F.greatest(stop - 1, F.lit(0)).cast("int"))).otherwise(parts)


def from_buffer(data: Column, dtype: str = "<f8") -> Column:
    """Numbers of a binary column as an array."""

    @F.pandas_udf("array<double>")
    def run(s):
        return s.map(lambda b: np.frombuffer(b, dtype).astype(float))

    return run(data)


def to_binary(x: Grid, path: str, dtype: str = "<f8") -> None:
    """The flattened values as raw chunks with their positions, a table that ``from_binary`` reads.

    Each task writes its own part; nothing passes through the driver.
    """
    chunks = x.df.select(F.floor(x.idx / CHUNK).alias("chunk"), (x.idx % CHUNK).alias("at"), F.col("value").cast("double").alias("value"))
    packed = chunks.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("cells"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [np.array([c["value"] for c in cells]).astype(dtype).tobytes() for cells in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], names=["chunk", "data"])

    packed.mapInArrow(encode, "chunk bigint, data binary").withColumns({"rows": F.lit(x.rows), "cols": F.lit(x.cols), "dtype": F.lit(dtype)}).write.mode("overwrite").parquet(path)


def from_binary(spark: SparkSession, path: str) -> Grid:
    """A grid that ``to_binary`` wrote."""
    table = spark.read.parquet(path)
    head = table.select("rows", "cols", "dtype").first()
    if head is None:
        return Grid(spark.createDataFrame([], "row long, col long, value double"), 0, 0)
    values = table.select("chunk", F.posexplode(from_buffer(F.col("data"), head["dtype"])).alias("at", "value"))
    at = F.col("chunk") * CHUNK + F.col("at")
    return Grid(values.select(F.floor(at / head["cols"]).cast("long").alias("row"), (at % head["cols"]).alias("col"), "value"), head["rows"], head["cols"])


def from_raw_files(spark: SparkSession, path: str, dtype: str = "<f8") -> DataFrame:
    """``path, idx, value`` of raw binary files, a file being one task's work."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.posexplode(from_buffer(F.col("content"), dtype)).alias("idx", "value"))


def to_raw_files(x: Grid, path: str, dtype: str = "<f8", chunk: int = 1 << 20) -> int:
    """The flattened values as raw bytes; returns how many there are.

    Files of ``chunk`` values each, ``000000000000.bin`` and so on, that joined in the order of their names
    are the array's bytes and nothing else. Tasks write them straight to the store, which all of them reach;
    a task that runs again writes the same file again.
    """

    def write(key: tuple, rows: pa.Table) -> pa.Table:
        store, folder = fs.FileSystem.from_uri(path)
        data = rows.sort_by("at").column("value").to_numpy().astype(dtype).tobytes()
        store.create_dir(folder)
        with store.open_output_stream(f"{folder}/{key[0].as_py():012d}.bin") as out:
            out.write(data)
        return pa.table({"bytes": pa.array([len(data)], pa.int64())})

    cells = x.df.select(F.floor(x.idx / chunk).cast("long").alias("chunk"), x.idx.alias("at"), F.col("value").cast("double").alias("value"))
    return cells.groupBy("chunk").applyInArrow(write, "bytes bigint").agg(F.sum("bytes")).first()[0] or 0


def from_raw(spark: SparkSession, path: str, rows: int, cols: int, dtype: str = "<f8") -> Grid:
    """A grid from the raw bytes of a file, or of all files of a folder in the order of their names.

    A file is one task's work, so a large array is best in many.
    """
    files = spark.read.format("binaryFile").load(path)
    # a row a file; only sizes are read here
    before = F.sum("length").over(Window.partitionBy(F.lit(0)).orderBy("path").rowsBetween(Window.unboundedPreceding, -1))
    sizes = files.select("path", F.coalesce(before, F.lit(0)).alias("before"))
    values = files.select("path", F.posexplode(from_buffer(F.col("content"), dtype)).alias("pos", "value")).join(sizes, "path")
    at = F.floor(F.col("before") / np.dtype(dtype).itemsize) + F.col("pos")
    cells = values.select(at.cast("long").alias("at"), "value").filter(F.col("at") < rows * cols)
    return Grid(cells.select(F.floor(F.col("at") / cols).cast("long").alias("row"), (F.col("at") % cols).alias("col"), "value"), rows, cols)


def to_text(x: Grid, path: str, sep: str = " ") -> None:
    """Lines of ``row<TAB>values``, one for each row of the grid, with values between separators."""
    lines = x.df.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("col", "value"))).alias("cells"))
    text = F.concat(F.col("row").cast("string"), F.lit("\t"), F.array_join(F.transform("cells", lambda c: c["value"].cast("string")), sep))
    lines.select(text.alias("value")).write.mode("overwrite").text(path)


def from_text(spark: SparkSession, path: str, sep: str = " ") -> Grid:
    """A grid that ``to_text`` wrote."""
    lines = spark.read.text(path).select(F.split("value", "\t").alias("p"))
    cells = lines.select(F.col("p")[0].cast("long").alias("row"), F.posexplode(from_string(F.col("p")[1], sep)).alias("col", "value"))
    return Grid.of(cells)


def from_table(df: DataFrame, value: Column, *order: Column | str) -> Grid:
    """A numeric column of a table as a flat grid in the order of its key."""
    rows = ranked(df.withColumn("_value", value), *order, name="_idx")
    n = df.count()
    return Grid(rows.select(F.lit(0).cast("long").alias("row"), F.col("_idx").alias("col"), F.col("_value").alias("value")), 1, n)


def to_list(x: Grid) -> list:
    """The flattened values on the driver; for grids that fit there."""
    return [r["value"] for r in x.df.select(x.idx.alias("_i"), "value").orderBy("_i").toLocalIterator()]


def to_numpy(x: Grid) -> np.ndarray:
    """The grid as a numpy array on the driver."""
    rows = x.df.toPandas()
    out = np.zeros(x.shape)
    out[rows["row"], rows["col"]] = rows["value"]
    return out


def show(x: Grid, n: int = 20) -> str:
    """The first rows as text."""
    lines = x.df.filter(F.col("row") < n).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("col", "value"))).alias("c"))
    return "\n".join("[" + ", ".join(str(c["value"]) for c in r["c"]) + "]" for r in lines.orderBy("row").collect())
