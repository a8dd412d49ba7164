"""Stacks of equally shaped grids: ``z, row, col, value``."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .grid import Grid


@dataclass(frozen=True)
class DataCube:
    df: DataFrame | None = None
    depth: int = 0
    rows: int = 0
    cols: int = 0

    def push_back(self, x: Grid) -> DataCube:
        layer = x.df.select(F.lit(self.depth).cast("long").alias("z"), "row", "col", "value")
        if self.df is None:
            return DataCube(layer, 1, x.rows, x.cols)
        if x.shape != (self.rows, self.cols):
            raise ValueError("layers differ in shape")
        return DataCube(self.df.unionByName(layer), self.depth + 1, self.rows, self.cols)

    def pop_back(self) -> DataCube:
        return DataCube(self.df.filter(F.col("z") < self.depth - 1), self.depth - 1, self.rows, self.cols)

    def at(self, z: int) -> Grid:
        if not 0 <= z < self.depth:
            raise IndexError("no such layer")
        return Grid(self.df.filter(F.col("z") == z).select("row", "col", "value"), self.rows, self.cols)

    def front(self) -> Grid:
        return self.at(0)

    def back(self) -> Grid:
        return self.at(self.depth - 1)

    def isempty(self) -> bool:
        return self.depth == 0

    @property
    def shape(self) -> tuple[int, int, int]:
        return self.rows, self.cols, self.depth

    def slice_z(self, row: Column | int, col: Column | int) -> DataFrame:
        """``z, value`` through the stack at a place."""
        return self.df.filter((F.col("row") == row) & (F.col("col") == col)).select("z", "value")

    def reduce_z(self, f) -> Grid:
        """An aggregate through the stack at every place."""
        return Grid(self.df.groupBy("row", "col").agg(f(F.col("value")).alias("value")), self.rows, self.cols)
