"""Small dense computations in a task of their own.

A driver shares its process with the JVM's gateway and whatever else the program runs, where a numerical
library's own threads may wait for each other without end; Spark's workers run it on one thread.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

_SCHEMA = "at int, shape array<int>, data binary"


def computed(spark: SparkSession, f: Callable[..., tuple[np.ndarray, ...]], *arrays: np.ndarray) -> list[np.ndarray]:
    """The arrays that f makes of some arrays; an error that it raises comes back with its message."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                made = [np.ascontiguousarray(m, np.float64) for m in f(*arrays)]
                yield pa.RecordBatch.from_arrays([pa.array(range(len(made)), pa.int32()), pa.array([list(m.shape) for m in made], pa.list_(pa.int32())), pa.array([m.tobytes() for m in made], pa.binary())], ["at", "shape", "data"])

    rows = spark.range(1, numPartitions=1).mapInArrow(run, _SCHEMA).collect()
    return [np.frombuffer(r["data"]).reshape(r["shape"]) for r in sorted(rows, key=lambda r: r["at"])]
