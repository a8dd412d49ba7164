"""Grid operators: creation, reductions by axis, layout, indexing, neighbours and products.

The grid m has a row of 20 values for each 20 parts; b is another of the same shape.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import numeric, reducers
from ..operators import creation, cumulative, filters, indexing, layout, multiset, order, products, reduce
from ..operators.cube import DataCube
from ..operators.filters import Boundary
from ..operators.grid import Axis, Grid, Slice
from ..sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_CTE = """WITH RECURSIVE m AS (SELECT p_partkey // 20 AS row, p_partkey % 20 AS col, CAST(p_size - 25 AS DOUBLE) AS value FROM part),
b AS (SELECT p_partkey // 20 AS row, p_partkey % 20 AS col, CAST((p_partkey * 7) % 13 AS DOUBLE) AS value FROM part),
d AS (SELECT max(row) + 1 AS R FROM m) """


def _grids(spark: SparkSession, sf_dir: str) -> tuple[Grid, Grid]:
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_size")
    rows = part.count() // 20
    key = F.col("p_partkey")
    cells = part.select(F.floor(key / 20).cast("long").alias("row"), (key % 20).alias("col"), "p_partkey", "p_size")
    m, b = Grid.columns(cells, rows, 20, (F.col("p_size") - 25).cast("double"), ((key * 7) % 13).cast("double"))
    return m, b


def _sums(x: Grid) -> Grid:
    """The sum of each column, as a flat grid."""
    return Grid(reduce.reduce(x, reducers.sum_, Axis.ROW).select(F.lit(0).cast("long").alias("row"), "col", "value"), 1, x.cols)


def _number(v: Column) -> Column:
    return v.cast("double")


def _whole(x: Grid) -> Grid:
    return x.map(lambda v: v.cast("long"))


def _df(x: Grid | DataFrame) -> DataFrame:
    return x.df if isinstance(x, Grid) else x


def _add(name: str, f: Callable[[Grid, Grid], Grid | DataFrame], sql: str, round_to: int | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = _df(f(*_grids(spark, sf_dir)))
        return out.withColumn("value", numeric.half_up("value", round_to)) if round_to else out

    QUERIES[name] = run
    text = _CTE + sql
    SQL[name] = f"SELECT * REPLACE (floor(value * 1e{round_to} + 0.5) / 1e{round_to} AS value) FROM ({text})" if round_to else text


_c = creation
#: The grid's values in one line, with their number n; a signal that windows and ranges are laid over.
_LINE = "SELECT CAST(0 AS BIGINT) AS row, row * 20 + col AS col, {} AS value FROM (SELECT *, CAST(row * 20 + col AS DOUBLE) AS i, (SELECT R * 20 FROM d) AS n, (SELECT min(value) FROM m) AS low, (SELECT max(value) FROM m) AS high FROM m)"
_PLANE = "SELECT row, col, {} AS value FROM m"
#: Sums of the columns and of the rows.
_TOTALS = "x AS (SELECT col AS i, sum(value) AS v FROM m GROUP BY col), y AS (SELECT row AS j, sum(value) AS v FROM m GROUP BY row) "


def _over(made: Callable[[SparkSession, int], Grid], f: Callable[[Column, Column], Column] = lambda v, w: v + w) -> Callable[[Grid, Grid], Grid]:
    """An array of the line's length, and f of the line and of it."""
    return lambda m, b: layout.flatten(m).zip(made(m.df.sparkSession, m.size), f)


def _row_sums(x: Grid) -> Grid:
    return Grid(reduce.reduce(x, reducers.sum_, Axis.COL).select(F.lit(0).cast("long").alias("row"), F.col("row").alias("col"), "value"), 1, x.rows)


def _between(m: Grid, num: int, endpoint: bool = True) -> Grid:
    """Numbers from the grid's least value to its greatest."""
    low, high = m.df.agg(F.min("value"), F.max("value")).first()
    return _c.linspace(m.df.sparkSession, low, high, num, endpoint)


for _name, _f, _sql in (
    ("arange", _over(lambda s, n: _c.arange(s, 0, n * 0.5, 0.5)), _LINE.format("value + i * 0.5")),
    ("arange_int", _over(lambda s, n: _c.arange(s, 3.9, n * 1.9 + 3, 1.9, integer=True)), _LINE.format("value + 3 + i")),
    ("linspace", lambda m, b: layout.flatten(m) - _between(m, m.size), _LINE.format("value - (low + i * (high - low) / (n - 1))")),
    ("linspace_noend", lambda m, b: layout.flatten(m) - _between(m, m.size, False), _LINE.format("value - (low + i * (high - low) / n)")),
    ("logspace", _over(lambda s, n: _c.logspace(s, 0, 2, n)), _LINE.format("value + pow(10, 2 * i / (n - 1))")),
    ("geomspace", _over(lambda s, n: _c.geomspace(s, 1, 81, n)), _LINE.format("value + pow(81, i / (n - 1))")),
    ("full", lambda m, b: m + _c.full(m.df.sparkSession, *m.shape, 3.14), _PLANE.format("value + 3.14")),
    ("ones", lambda m, b: m - _c.ones(m.df.sparkSession, *m.shape), _PLANE.format("value - 1")),
    ("zeros", lambda m, b: m + _c.zeros(m.df.sparkSession, *m.shape), _PLANE.format("value")),
    ("empty", lambda m, b: m.zip(_c.empty(m.df.sparkSession, *m.shape), lambda v, e: F.coalesce(e, -v)), _PLANE.format("-value")),
    ("eye", lambda m, b: m * _c.eye(m.df.sparkSession, *m.shape, 1), _PLANE.format("value * CAST(col - row = 1 AS INT)")),
    ("eye_negative", lambda m, b: m * _c.eye(m.df.sparkSession, *m.shape, -1), _PLANE.format("value * CAST(col - row = -1 AS INT)")),
    ("identity", lambda m, b: products.matmul(_c.identity(m.df.sparkSession, m.rows, sparse=True), m), _PLANE.format("value")),
    ("meshgrid", lambda m, b: _c.meshgrid(_sums(m), _row_sums(m))[0], f", {_TOTALS} SELECT j AS row, i AS col, x.v AS value FROM x, y"),
    ("meshgrid_j", lambda m, b: _c.meshgrid(_sums(m), _row_sums(m))[1], f", {_TOTALS} SELECT j AS row, i AS col, y.v AS value FROM x, y"),
    ("diagflat", lambda m, b: _c.diagflat(_sums(m), 1), f", {_TOTALS} SELECT r AS row, c AS col, CASE WHEN c = r + 1 THEN (SELECT v FROM x WHERE i = r) ELSE 0 END AS value FROM range(0, 21) p(r), range(0, 21) q(c)"),
    ("asarray", lambda m, b: m - _c.asarray(m.df.sparkSession, files.to_list(_sums(m))), _PLANE.format("value - sum(value) OVER (PARTITION BY col)")),
    ("fromiter", lambda m, b: m - _c.fromiter(m.df.sparkSession, (v / 2 for v in files.to_list(_sums(m)))), _PLANE.format("value - sum(value) OVER (PARTITION BY col) / 2")),
    ("fromfunction", lambda m, b: m + _c.from_function(m.df.sparkSession, lambda r, c: r * 10 + c, *m.shape), _PLANE.format("value + row * 10 + col")),
    ("tri", lambda m, b: products.matmul(m, _c.tri(m.df.sparkSession, 20, 1)), "SELECT m.row, c.col, sum(CASE WHEN c.col <= m.col + 1 THEN value ELSE 0 END) AS value FROM m, range(0, 20) c(col) GROUP BY m.row, c.col"),
    ("tri_upper", lambda m, b: products.matmul(m, _c.tri(m.df.sparkSession, 20, -1, upper=True)), "SELECT m.row, c.col, sum(CASE WHEN c.col >= m.col - 1 THEN value ELSE 0 END) AS value FROM m, range(0, 20) c(col) GROUP BY m.row, c.col"),
    ("vander", lambda m, b: _c.vander(layout.flatten(m), 3), "SELECT row * 20 + col AS row, p AS col, pow(value, p) AS value FROM m, range(0, 3) q(p)"),
    ("bartlett", _over(_c.bartlett, lambda v, w: v * w), _LINE.format("value * (1 - abs(2 * i / (n - 1) - 1))")),
    ("blackman", _over(_c.blackman, lambda v, w: v * w), _LINE.format("value * (0.42 - 0.5 * cos(2 * pi() * i / (n - 1)) + 0.08 * cos(4 * pi() * i / (n - 1)))")),
    ("hamming", _over(_c.hamming, lambda v, w: v * w), _LINE.format("value * (0.54 - 0.46 * cos(2 * pi() * i / (n - 1)))")),
    ("hanning", _over(_c.hanning, lambda v, w: v * w), _LINE.format("value * (0.5 - 0.5 * cos(2 * pi() * i / (n - 1)))")),
    ("kaiser", _over(lambda s, n: _c.kaiser(s, n, 2.0), lambda v, w: v * w), _LINE.format("value * (SELECT sum(pow(1 - pow(2 * i / (n - 1) - 1, 2), k) / pow(gamma(k + 1), 2)) FROM range(0, 30) r(k)) / (SELECT sum(1 / pow(gamma(k + 1), 2)) FROM range(0, 30) r(k))")),
):
    _add(_name, lambda m, b, f=_f: f(m, b).map(_number), _sql, 6)
_flat = "SELECT CAST(0 AS BIGINT) AS row, row * 20 + col AS col, value FROM m"
for _name, _f, _sql in (
    ("full_like", lambda m, b: _c.full_like(m, 2.5), "SELECT row, col, CAST(2.5 AS DOUBLE) AS value FROM m"),
    ("ones_like", lambda m, b: _c.ones_like(m), "SELECT row, col, CAST(1 AS DOUBLE) AS value FROM m"),
    ("zeros_like", lambda m, b: _c.zeros_like(m), "SELECT row, col, CAST(0 AS DOUBLE) AS value FROM m"),
    ("empty_like", lambda m, b: _c.empty_like(m), "SELECT row, col, CAST(NULL AS DOUBLE) AS value FROM m"),
    ("nans", lambda m, b: reduce.reduce(_c.nans_like(m), lambda v: F.count_if(F.isnan(v)).cast("double")), "SELECT CAST(count(*) AS DOUBLE) AS value FROM m"),
    ("operator_arithmetic", lambda m, b: (m + b * 2 - 1) % 7, "SELECT row, col, (m.value + b.value * 2 - 1) % 7 AS value FROM m JOIN b USING (row, col)"),
    ("operator_divide", lambda m, b: m / (b + 1), "SELECT row, col, m.value / (b.value + 1) AS value FROM m JOIN b USING (row, col)"),
    ("operator_compare", lambda m, b: (m > b).map(lambda v: v.cast("double")), "SELECT row, col, CAST(m.value > b.value AS DOUBLE) AS value FROM m JOIN b USING (row, col)"),
    ("operator_bits", lambda m, b: ((m.map(lambda v: v.cast("long")) ^ b.map(lambda v: v.cast("long"))) << 2).map(lambda v: v.cast("double")), "SELECT row, col, CAST(xor(CAST(m.value AS BIGINT), CAST(b.value AS BIGINT)) * 4 AS DOUBLE) AS value FROM m JOIN b USING (row, col)"),
    ("broadcast_row", lambda m, b: m + Grid(b.df.filter("row = 0"), 1, 20), "SELECT m.row, m.col, m.value + b.value AS value FROM m JOIN b ON b.row = 0 AND b.col = m.col"),
    ("broadcast_column", lambda m, b: Grid(b.df.filter("col = 0"), b.rows, 1) + m, "SELECT m.row, m.col, m.value + b.value AS value FROM m JOIN b ON b.col = 0 AND b.row = m.row"),
    ("sum_rows", lambda m, b: reduce.reduce(m, reducers.sum_, Axis.ROW), "SELECT col, sum(value) AS value FROM m GROUP BY col"),
    ("max_cols", lambda m, b: reduce.reduce(m, reducers.amax, Axis.COL), "SELECT row, max(value) AS value FROM m GROUP BY row"),
    ("reduce_cube", lambda m, b: reduce.cube(m, reducers.sum_).na.fill(-1, ["row", "col"]), "SELECT coalesce(row, -1) AS row, coalesce(col, -1) AS col, sum(value) AS value FROM m GROUP BY GROUPING SETS ((m.row), (m.col), ())"),
    ("argmax", lambda m, b: reduce.argmax(m), "SELECT row * 20 + col AS value FROM m ORDER BY m.value DESC, row, col LIMIT 1"),
    ("argmin", lambda m, b: reduce.argmin(m, Axis.COL), "SELECT row, arg_min(col, value * 100 + col) AS value FROM m GROUP BY row"),
    ("nanargmax", lambda m, b: reduce.nanargmax(m.map(lambda v: F.when(v == 25, float("nan")).otherwise(v)), Axis.ROW), "SELECT col, arg_max(row, value * 1000 - row) AS value FROM m WHERE value <> 25 GROUP BY col"),
    ("nanargmin", lambda m, b: reduce.nanargmin(m.map(lambda v: F.when(v == -24, float("nan")).otherwise(v))), "SELECT row * 20 + col AS value FROM m WHERE value <> -24 ORDER BY m.value, row, col LIMIT 1"),
    ("trace", lambda m, b: reduce.trace(m, 2), "SELECT sum(value) AS value FROM m WHERE row - col = 2"),
    ("allclose", lambda m, b: reduce.allclose(m, m.map(lambda v: v + 1e-7)).select(F.col("value").cast("double").alias("value")), "SELECT CAST(1 AS DOUBLE) AS value"),
    ("array_equal", lambda m, b: reduce.array_equal(m, b).select(F.col("value").cast("double").alias("value")), "SELECT CAST(0 AS DOUBLE) AS value"),
    ("array_equiv", lambda m, b: reduce.array_equiv(m, layout.flatten(m)).select(F.col("value").cast("double").alias("value")), "SELECT CAST(1 AS DOUBLE) AS value"),
    ("issorted", lambda m, b: reduce.issorted(m).select(F.col("value").cast("double").alias("value")), "SELECT CAST(0 AS DOUBLE) AS value"),
    ("cumsum", lambda m, b: cumulative.cumsum(m), "SELECT CAST(0 AS BIGINT) AS row, row * 20 + col AS col, sum(value) OVER (ORDER BY row, col) AS value FROM m"),
    ("cumsum_cols", lambda m, b: cumulative.cumsum(m, Axis.COL), "SELECT row, col, sum(value) OVER (PARTITION BY row ORDER BY col) AS value FROM m"),
    ("nancumsum", lambda m, b: cumulative.cumsum(m.map(lambda v: F.when(v < 0, float("nan")).otherwise(v)), Axis.ROW, nan_safe=True), "SELECT row, col, sum(greatest(value, 0)) OVER (PARTITION BY col ORDER BY row) AS value FROM m"),
    ("diff", lambda m, b: cumulative.diff(m), "SELECT CAST(0 AS BIGINT) AS row, row * 20 + col AS col, lead(value) OVER (ORDER BY row, col) - value AS value FROM m QUALIFY value IS NOT NULL AND lead(m.value) OVER (ORDER BY row, col) IS NOT NULL"),
    ("diff_rows", lambda m, b: cumulative.diff(m, Axis.ROW), "SELECT * FROM (SELECT row, col, lead(value) OVER (PARTITION BY col ORDER BY row) - value AS value FROM m) WHERE value IS NOT NULL"),
    ("gradient", lambda m, b: cumulative.gradient(m), "SELECT row, col, (coalesce(lead(value) OVER w, value) - coalesce(lag(value) OVER w, value)) / CASE WHEN row IN (0, (SELECT R - 1 FROM d)) THEN 1 ELSE 2 END AS value FROM m WINDOW w AS (PARTITION BY col ORDER BY row)"),
    ("roll", lambda m, b: cumulative.roll(m, 27), "SELECT ((row * 20 + col + 27) % (R * 20)) // 20 AS row, (row * 20 + col + 27) % 20 AS col, value FROM m, d"),
    ("roll_cols", lambda m, b: cumulative.roll(m, -3, Axis.COL), "SELECT row, (col + 17) % 20 AS col, value FROM m"),
    ("trapz", lambda m, b: cumulative.trapz(m, 0.5), "SELECT sum((value + n) / 4) AS value FROM (SELECT value, lead(value) OVER (ORDER BY row, col) AS n FROM m)"),
    ("trapz_x", lambda m, b: cumulative.trapz(m, axis=Axis.COL, at=b), "SELECT row, sum((value + n) / 2 * (y - x)) AS value FROM (SELECT row, m.value, lead(m.value) OVER w AS n, b.value AS x, lead(b.value) OVER w AS y FROM m JOIN b USING (row, col) WINDOW w AS (PARTITION BY row ORDER BY col)) GROUP BY row"),
    ("sort_cols", lambda m, b: order.sort(m, Axis.COL), "SELECT row, row_number() OVER (PARTITION BY row ORDER BY value) - 1 AS col, value FROM m"),
    ("argsort_rows", lambda m, b: order.argsort(m, Axis.ROW), "SELECT row_number() OVER (PARTITION BY col ORDER BY value, row) - 1 AS row, col, row AS value FROM m"),
    ("transpose", lambda m, b: layout.transpose(m), "SELECT col AS row, row AS col, value FROM m"),
    ("flatten", lambda m, b: layout.flatten(m), _flat), ("ravel", lambda m, b: layout.ravel(m), _flat), ("copy", lambda m, b: layout.copy(m), "SELECT * FROM m"),
    ("reshape", lambda m, b: layout.reshape(m, -1, 10), "SELECT (row * 20 + col) // 10 AS row, (row * 20 + col) % 10 AS col, value FROM m"),
    ("reshape_fortran", lambda m, b: layout.reshape(m, 20, m.rows, "F"), "SELECT (row + col * R) % 20 AS row, (row + col * R) // 20 AS col, value FROM m, d"),
    ("resizeSlow", lambda m, b: layout.resize(m, 7, 25), "SELECT r AS row, c AS col, coalesce(value, 0) AS value FROM range(0, 7) x(r) CROSS JOIN range(0, 25) y(c) LEFT JOIN m ON row = r AND col = c"),
    ("flip", lambda m, b: layout.flip(m), "SELECT R - 1 - row AS row, 19 - col AS col, value FROM m, d"),
    ("fliplr", lambda m, b: layout.fliplr(m), "SELECT row, 19 - col AS col, value FROM m"),
    ("flipud", lambda m, b: layout.flipud(m), "SELECT R - 1 - row AS row, col, value FROM m, d"),
    ("rot90", lambda m, b: layout.rot90(m), "SELECT 19 - col AS row, row AS col, value FROM m"),
    ("rot90_3", lambda m, b: layout.rot90(m, 3), "SELECT col AS row, R - 1 - row AS col, value FROM m, d"),
    ("vstack", lambda m, b: layout.vstack([m, b]), "SELECT * FROM m UNION ALL SELECT row + R, col, value FROM b, d"),
    ("row_stack", lambda m, b: layout.row_stack([b, m]), "SELECT * FROM b UNION ALL SELECT row + R, col, value FROM m, d"),
    ("hstack", lambda m, b: layout.hstack([m, b]), "SELECT * FROM m UNION ALL SELECT row, col + 20, value FROM b"),
    ("column_stack", lambda m, b: layout.column_stack([b, m]), "SELECT * FROM b UNION ALL SELECT row, col + 20, value FROM m"),
    ("stack", lambda m, b: layout.stack([m, b], Axis.COL), "SELECT * FROM m UNION ALL SELECT row, col + 20, value FROM b"),
    ("concatenate", lambda m, b: layout.concatenate([m, b]), "SELECT CAST(0 AS BIGINT) AS row, row * 20 + col AS col, value FROM m UNION ALL SELECT CAST(0 AS BIGINT), row * 20 + col + R * 20, value FROM b, d"),
    ("append", lambda m, b: layout.append(m, b, Axis.ROW), "SELECT * FROM m UNION ALL SELECT row + R, col, value FROM b, d"),
    ("vsplit", lambda m, b: layout.vsplit(m, [2, 5])[1], "SELECT row - 2 AS row, col, value FROM m WHERE row BETWEEN 2 AND 4"),
    ("hsplit", lambda m, b: layout.hsplit(m, [3, 15])[2], "SELECT row, col - 15 AS col, value FROM m WHERE col >= 15"),
    ("split", lambda m, b: layout.split(m, [4], Axis.ROW)[0], "SELECT * FROM m WHERE row < 4"),
    ("pad", lambda m, b: layout.pad(m, 2, 9), "SELECT r AS row, c AS col, coalesce(value, 9) AS value FROM range(0, (SELECT R + 4 FROM d)) x(r) CROSS JOIN range(0, 24) y(c) LEFT JOIN m ON row = r - 2 AND col = c - 2"),
    ("tile", lambda m, b: layout.tile(m, 2, 3), "SELECT row + i * R AS row, col + j * 20 AS col, value FROM m, d, range(0, 2) x(i), range(0, 3) y(j)"),
    ("repeat", lambda m, b: layout.repeat(m, 1, 2), "SELECT row, col + j * 20 AS col, value FROM m, range(0, 2) y(j)"),
    ("swapRows", lambda m, b: layout.swap_rows(m, 1, 4), "SELECT CASE row WHEN 1 THEN 4 WHEN 4 THEN 1 ELSE row END AS row, col, value FROM m"),
    ("swapCols", lambda m, b: layout.swap_cols(m, 0, 19), "SELECT row, CASE col WHEN 0 THEN 19 WHEN 19 THEN 0 ELSE col END AS col, value FROM m"),
    ("swapaxes", lambda m, b: layout.swapaxes(m), "SELECT col AS row, row AS col, value FROM m"),
    ("diag", lambda m, b: layout.diag(m, 1), "SELECT CAST(0 AS BIGINT) AS row, row AS col, value FROM m WHERE col - row = 1"),
    ("diagonal", lambda m, b: indexing.diagonal(m, 2, Axis.COL), "SELECT CAST(0 AS BIGINT) AS row, col, value FROM m WHERE row - col = 2"),
    ("triu_of", lambda m, b: creation.triangle(m, 1, upper=True), "SELECT row, col, CASE WHEN col - row >= 1 THEN value ELSE 0 END AS value FROM m"),
    ("at", lambda m, b: indexing.at(m, -1, 3), "SELECT value FROM m, d WHERE row = R - 1 AND col = 3"),
    ("front_back", lambda m, b: indexing.front(m).union(indexing.back(m)), "SELECT value FROM m, d WHERE (row = 0 AND col = 0) OR (row = R - 1 AND col = 19)"),
    ("row", lambda m, b: indexing.row(m, 3), "SELECT col, value FROM m WHERE row = 3"),
    ("column", lambda m, b: indexing.column(m, 3), "SELECT row, value FROM m WHERE col = 3"),
    ("slice", lambda m, b: indexing.sliced(m, Slice(1, 8, 3), Slice(-2, 4, -5)), "SELECT (row - 1) // 3 AS row, (col - 4) // 5 AS col, value FROM m WHERE row >= 1 AND row < 8 AND (row - 1) % 3 = 0 AND col >= 4 AND col < 18 AND (col - 4) % 5 = 0"),
    ("nonzero", lambda m, b: indexing.nonzero(m).withColumn("value", F.lit(1.0)), "SELECT row, col, CAST(1 AS DOUBLE) AS value FROM m WHERE value <> 0"),
    ("flatnonzero", lambda m, b: indexing.flatnonzero(b), "SELECT CAST(0 AS BIGINT) AS row, row_number() OVER (ORDER BY row, col) - 1 AS col, row * 20 + col AS value FROM b WHERE value <> 0"),
    ("argwhere", lambda m, b: indexing.argwhere(m), "SELECT CAST(0 AS BIGINT) AS row, row_number() OVER (ORDER BY row, col) - 1 AS col, row * 20 + col AS value FROM m WHERE value <> 0"),
    ("find", lambda m, b: indexing.find(m > 20, 5), "SELECT CAST(0 AS BIGINT) AS row, row_number() OVER (ORDER BY row, col) - 1 AS col, row * 20 + col AS value FROM m WHERE value > 20 ORDER BY m.row, m.col LIMIT 5"),
    ("extract", lambda m, b: indexing.extract(b > 10, m), "SELECT CAST(0 AS BIGINT) AS row, row_number() OVER (ORDER BY row, col) - 1 AS col, m.value FROM m JOIN b USING (row, col) WHERE b.value > 10"),
    ("take", lambda m, b: indexing.take(m, [5, 0, -1, 5]), "SELECT CAST(0 AS BIGINT) AS row, CAST(p AS BIGINT) AS col, value FROM d, (VALUES (0, 5), (1, 0), (2, -1), (3, 5)) t(p, i) JOIN m ON row * 20 + col = CASE WHEN i < 0 THEN (SELECT R * 20 - 1 FROM d) ELSE i END"),
    ("take_rows", lambda m, b: indexing.take(m, [2, 0], Axis.ROW), "SELECT CAST(CASE row WHEN 2 THEN 0 ELSE 1 END AS BIGINT) AS row, col, value FROM m WHERE row IN (0, 2)"),
    ("deleteIndices", lambda m, b: indexing.delete_indices(m, [1, 3], Axis.COL), "SELECT row, CASE WHEN col > 3 THEN col - 2 WHEN col = 2 THEN 1 ELSE col END AS col, value FROM m WHERE col NOT IN (1, 3)"),
    ("deleteIndices_flat", lambda m, b: indexing.delete_indices(m, [0, 21]), "SELECT CAST(0 AS BIGINT) AS row, row_number() OVER (ORDER BY m.row, m.col) - 1 AS col, value FROM m WHERE m.row * 20 + m.col NOT IN (0, 21)"),
    ("insert", lambda m, b: indexing.insert(m, 4, [7, 8]), "SELECT CAST(0 AS BIGINT) AS row, row * 20 + col + CASE WHEN row * 20 + col >= 4 THEN 2 ELSE 0 END AS col, value FROM m UNION ALL SELECT CAST(0 AS BIGINT), 4, 7 UNION ALL SELECT CAST(0 AS BIGINT), 5, 8"),
    ("fillDiagonal", lambda m, b: indexing.fill_diagonal(m, 99.0), "SELECT row, col, CASE WHEN row = col THEN 99 ELSE value END AS value FROM m"),
    ("replace", lambda m, b: indexing.replace(m, 0.0, -1.0), "SELECT row, col, CASE WHEN value = 0 THEN -1 ELSE value END AS value FROM m"),
    ("put", lambda m, b: indexing.put(m, [0, 25], 5.5), "SELECT row, col, CASE WHEN row * 20 + col IN (0, 25) THEN 5.5 ELSE value END AS value FROM m"),
    ("putmask", lambda m, b: indexing.putmask(m, m > 10, 10.0), "SELECT row, col, least(value, 10) AS value FROM m"),
    ("place", lambda m, b: indexing.place(m, m > 20, Grid.local(m.df.sparkSession, [1, 2, 3])), "SELECT row, col, CASE WHEN value > 20 THEN 1 + (count(*) FILTER (value > 20) OVER (ORDER BY row, col) - 1) % 3 ELSE value END AS value FROM m"),
    ("trim_zeros", lambda m, b: indexing.trim_zeros(layout.flatten(m.map(lambda v: F.when(v < 20, 0.0).otherwise(v)))), ", z AS (SELECT row * 20 + col AS i, CASE WHEN value < 20 THEN 0 ELSE value END AS v FROM m), e AS (SELECT min(i) AS a, max(i) AS b FROM z WHERE v <> 0) SELECT CAST(0 AS BIGINT) AS row, i - a AS col, v AS value FROM z, e WHERE i BETWEEN a AND b"),
    ("matmul", lambda m, b: products.filled(products.matmul(layout.transpose(m), b)), "SELECT m.col AS row, b.col AS col, sum(m.value * b.value) AS value FROM m JOIN b ON m.row = b.row GROUP BY m.col, b.col"),
    ("dot", lambda m, b: products.dot(layout.flatten(m), layout.flatten(b)), "SELECT sum(m.value * b.value) AS value FROM m JOIN b USING (row, col)"),
    ("inner", lambda m, b: products.inner(m, b), "SELECT sum(m.value * b.value) AS value FROM m JOIN b USING (row, col)"),
    ("outer", lambda m, b: products.outer(_sums(m), _sums(b)), "SELECT x.col AS row, y.col AS col, x.value * y.value AS value FROM (SELECT col, sum(value) AS value FROM m GROUP BY col) x, (SELECT col, sum(value) AS value FROM b GROUP BY col) y"),
    ("operator_left_scalar", lambda m, b: 2 * m + 1 - (3 - b), "SELECT row, col, 2 * m.value + 1 - (3 - b.value) AS value FROM m JOIN b USING (row, col)"),
    ("operator_left_divide", lambda m, b: 7 / (b + 1) + 100 % (b + 1), "SELECT row, col, 7 / (value + 1) + 100 % (value + 1) AS value FROM b"),
    ("operator_equal", lambda m, b: (m == b).map(_number), "SELECT row, col, CAST(m.value = b.value AS DOUBLE) AS value FROM m JOIN b USING (row, col)"),
    ("operator_not_equal", lambda m, b: (m != 7).map(_number), "SELECT row, col, CAST(value <> 7 AS DOUBLE) AS value FROM m"),
    ("operator_logical", lambda m, b: m.logical_and(b).logical_or((m > 20).logical_not()).map(_number), "SELECT row, col, CAST((m.value <> 0 AND b.value <> 0) OR NOT m.value > 20 AS DOUBLE) AS value FROM m JOIN b USING (row, col)"),
    ("operator_step", lambda m, b: m.increment() * b.decrement() - -m, "SELECT row, col, (m.value + 1) * (b.value - 1) + m.value AS value FROM m JOIN b USING (row, col)"),
    ("operator_and_or_not", lambda m, b: (~(_whole(m) & _whole(b)) | (_whole(b) >> 1)).map(_number), "SELECT row, col, CAST((~(CAST(m.value AS BIGINT) & CAST(b.value AS BIGINT))) | (CAST(b.value AS BIGINT) >> 1) AS DOUBLE) AS value FROM m JOIN b USING (row, col)"),
    ("operator_less_greater_equal", lambda m, b: (m < b).map(_number) + 2 * (m <= b).map(_number) + 4 * (m >= b).map(_number), "SELECT row, col, CAST(m.value < b.value AS DOUBLE) + 2 * CAST(m.value <= b.value AS DOUBLE) + 4 * CAST(m.value >= b.value AS DOUBLE) AS value FROM m JOIN b USING (row, col)"),
    ("fill", lambda m, b: indexing.fill(m, 4.5), "SELECT row, col, CAST(4.5 AS DOUBLE) AS value FROM m"),
    ("multi_dot", lambda m, b: products.filled(products.multi_dot([layout.transpose(m), b, creation.identity(m.df.sparkSession, 20)])), "SELECT m.col AS row, b.col AS col, sum(m.value * b.value) AS value FROM m JOIN b ON m.row = b.row GROUP BY m.col, b.col"),
    ("datacube", lambda m, b: DataCube().push_back(m).push_back(b).push_back(m).pop_back().reduce_z(F.sum), "SELECT row, col, m.value + b.value AS value FROM m JOIN b USING (row, col)"),
):
    _add(_name, _f, _sql)
for _name, _f, _sql in (
    ("centerOfMass", lambda m, b: reduce.center_of_mass(b, Axis.COL), "SELECT row, sum(value * col) / sum(value) AS value FROM b GROUP BY row"),
    ("cov", lambda m, b: products.cov(layout.transpose(m)), "SELECT x.col AS row, y.col AS col, covar_samp(x.value, y.value) AS value FROM m x JOIN m y ON x.row = y.row GROUP BY x.col, y.col"),
    ("cov_bias", lambda m, b: products.cov(layout.transpose(m), True), "SELECT x.col AS row, y.col AS col, covar_pop(x.value, y.value) AS value FROM m x JOIN m y ON x.row = y.row GROUP BY x.col, y.col"),
    ("corrcoef", lambda m, b: products.corrcoef(layout.transpose(m)), "SELECT x.col AS row, y.col AS col, corr(x.value, y.value) AS value FROM m x JOIN m y ON x.row = y.row GROUP BY x.col, y.col"),
    ("cov_inv", lambda m, b: (lambda v: products.filled(products.matmul(products.cov_inv(v), products.cov(v))))(layout.transpose(layout.reshape(m, -1, 5))), "SELECT r AS row, c AS col, CAST(r = c AS DOUBLE) AS value FROM range(0, 5) x(r), range(0, 5) y(c)"),
    ("cumprod", lambda m, b: cumulative.cumprod(b.map(lambda v: 1 + v / 100 - 0.06), Axis.COL), "SELECT row, col, exp(sum(ln(0.94 + value / 100)) OVER (PARTITION BY row ORDER BY col)) AS value FROM b"),
    ("cumprod_flat", lambda m, b: cumulative.cumprod(b.map(lambda v: (1 + (v - 6) / 1000) * F.when(v == 3, -1).otherwise(1))), "SELECT CAST(0 AS BIGINT) AS row, row * 20 + col AS col, exp(sum(ln(1 + (value - 6) / 1000)) OVER (ORDER BY row, col)) * CASE WHEN (count(*) FILTER (value = 3) OVER (ORDER BY row, col)) % 2 = 1 THEN -1 ELSE 1 END AS value FROM b"),
    ("nancumprod", lambda m, b: cumulative.cumprod(b.map(lambda v: F.when(v == 0, float("nan")).otherwise(0.94 + v / 100)), Axis.ROW, nan_safe=True), "SELECT row, col, exp(sum(CASE WHEN value = 0 THEN 0 ELSE ln(0.94 + value / 100) END) OVER (PARTITION BY col ORDER BY row)) AS value FROM b"),
    ("softmax", lambda m, b: Grid(b.df.withColumn("value", F.exp("value") / F.sum(F.exp("value")).over(Window.partitionBy("row"))), b.rows, 20), "SELECT row, col, exp(value) / sum(exp(value)) OVER (PARTITION BY row) AS value FROM b"),
):
    _add(_name, _f, _sql, 6)

# ---- neighbourhood filters: places outside are turned inside by each boundary rule
_PLACE = {
    Boundary.REFLECT: "CASE WHEN {p} < 0 THEN -{p} - 1 WHEN {p} >= {n} THEN 2 * {n} - 1 - {p} ELSE {p} END",
    Boundary.MIRROR: "CASE WHEN {p} < 0 THEN -{p} WHEN {p} >= {n} THEN 2 * {n} - 2 - {p} ELSE {p} END",
    Boundary.NEAREST: "greatest(least({p}, {n} - 1), 0)",
    Boundary.WRAP: "({p} + {n}) % {n}",
    Boundary.CONSTANT: "CASE WHEN {p} >= 0 AND {p} < {n} THEN {p} END",
}


def _near(rule: Boundary, deep: bool, half: int = 1) -> str:
    r = _PLACE[rule].format(p="(q.row + i)", n="(SELECT R FROM d)") if deep else "q.row"
    c = _PLACE[rule].format(p="(q.col + j)", n="20")
    down = half if deep else 0
    return f", near AS (SELECT q.row, q.col, i, j, coalesce(s.value, 0) AS value FROM m q CROSS JOIN range({-down}, {down + 1}) x(i) CROSS JOIN range({-half}, {half + 1}) y(j) LEFT JOIN m s ON s.row = {r} AND s.col = {c}) "


_f = filters
for _name, _run, _value, _rule, _half in (
    ("uniformFilter", lambda m, **k: _f.uniform_filter(m, 3, **k), "avg(value)", Boundary.REFLECT, 1),
    ("maximumFilter", lambda m, **k: _f.maximum_filter(m, 3, **k), "max(value)", Boundary.NEAREST, 1),
    ("minimumFilter", lambda m, **k: _f.minimum_filter(m, 5, **k), "min(value)", Boundary.WRAP, 2),
    ("medianFilter", lambda m, **k: _f.median_filter(m, 3, **k), "median(value)", Boundary.MIRROR, 1),
    ("percentileFilter", lambda m, **k: _f.percentile_filter(m, 3, 30, **k), "quantile_cont(value, 0.3)", Boundary.REFLECT, 1),
    ("rankFilter", lambda m, **k: _f.rank_filter(m, 3, 2, **k), "list_sort(list(value))[3]", Boundary.CONSTANT, 1),
):
    for _deep in (True, False):
        _add(
            _name if _deep else f"{_name}1d",
            lambda m, b, run=_run, rule=_rule, deep=_deep: run(m, rule=rule, two_dimensional=deep),
            f"{_near(_rule, _deep, _half)} SELECT row, col, {_value} AS value FROM near GROUP BY row, col",
            6,
        )
_add("complementaryMedianFilter", lambda m, b: _f.complementary_median_filter(m, 3), f"{_near(Boundary.REFLECT, True)} SELECT row, col, any_value(m.value) - median(near.value) AS value FROM near JOIN m USING (row, col) GROUP BY row, col", 6)
_add("complementaryMedianFilter1d", lambda m, b: _f.complementary_median_filter(m, 3, two_dimensional=False), f"{_near(Boundary.REFLECT, False)} SELECT row, col, any_value(m.value) - median(near.value) AS value FROM near JOIN m USING (row, col) GROUP BY row, col", 6)
_add("convolve", lambda m, b: _f.convolve(m, [[1, 2, 3], [4, 5, 6], [7, 8, 9]]), f"{_near(Boundary.REFLECT, True)} SELECT row, col, sum(value * (5 - 3 * i - j)) AS value FROM near GROUP BY row, col")
_add("convolve1d", lambda m, b: _f.convolve(m, [1, 2, 4]), f"{_near(Boundary.REFLECT, False)} SELECT row, col, sum(value * CASE j WHEN -1 THEN 4 WHEN 0 THEN 2 ELSE 1 END) AS value FROM near GROUP BY row, col")
_add("laplace", lambda m, b: _f.laplace(m, Boundary.WRAP), f"{_near(Boundary.WRAP, True)} SELECT row, col, sum(CASE WHEN i = 0 AND j = 0 THEN -4 WHEN i = 0 OR j = 0 THEN 1 ELSE 0 END * value) AS value FROM near GROUP BY row, col")
for _name, _flatten in (("gaussianFilter1d", True), ("gaussianFilter", False)):
    _w = "exp(-(j * j) / 0.98)" if _flatten else "exp(-(i * i + j * j) / 0.98)"
    _add(_name, lambda m, b, flat=_flatten: _f.convolve(m, _f.gaussian_kernel(0.7).tolist()) if flat else _f.gaussian_filter(m, 0.7), f"{_near(Boundary.REFLECT, not _flatten, 3)} SELECT row, col, sum(value * {_w}) / sum({_w}) AS value FROM near GROUP BY row, col", 6)
for _rule in Boundary:
    _add(
        f"boundary_{_rule.value}",
        lambda m, b, rule=_rule: _f.add_boundary_2d(m, rule, 5, 0.0),
        f"SELECT r AS row, c AS col, coalesce(value, 0) AS value FROM range(0, (SELECT R + 4 FROM d)) x(r) CROSS JOIN range(0, 24) y(c) LEFT JOIN m ON row = {_PLACE[_rule].format(p='(r - 2)', n='(SELECT R FROM d)')} AND col = {_PLACE[_rule].format(p='(c - 2)', n='20')}",
    )
_add("trimBoundary", lambda m, b: _f.trim_boundary(m, 1), "SELECT row - 1 AS row, col - 1 AS col, value FROM m, d WHERE row BETWEEN 1 AND R - 2 AND col BETWEEN 1 AND 18")
_add("fillCorners", lambda m, b: _f.fill_corners(m, 2, 0.5), "SELECT row, col, CASE WHEN (row < 2 OR row >= R - 2) AND (col < 2 OR col >= 18) THEN 0.5 ELSE value END AS value FROM m, d")
for _rule in Boundary:
    _add(
        f"boundary1d_{_rule.value}",
        lambda m, b, rule=_rule: _f.add_boundary_1d(m, rule, 7, 0.0),
        f"SELECT r AS row, c AS col, coalesce(value, 0) AS value FROM range(0, (SELECT R FROM d)) x(r) CROSS JOIN range(0, 26) y(c) LEFT JOIN m ON row = r AND col = {_PLACE[_rule].format(p='(c - 3)', n='20')}",
    )
_add("addBoundary1d", lambda m, b: reduce.reduce(_f.add_boundary_1d(m, Boundary.REFLECT, 5), reducers.sum_, Axis.ROW), "SELECT c AS col, sum(value) AS value FROM range(0, 24) y(c) JOIN m ON col = CASE WHEN c < 2 THEN 1 - c WHEN c > 21 THEN 41 - c ELSE c - 2 END GROUP BY c")
_add("trimBoundary1d", lambda m, b: _f.trim_boundary(m, 2, two_dimensional=False), "SELECT row, col - 2 AS col, value FROM m WHERE col BETWEEN 2 AND 17")


# ---- facts of a grid, updates and exports
def _fact(name: str, f: Callable[[Grid], float | bool], sql: str) -> None:
    """A fact of the grid, beside the sum of its values."""
    _add(name, lambda m, b: m.df.agg(F.sum("value").alias("total")).select(F.lit(float(f(m))).alias("value"), "total"), f"SELECT CAST({sql} AS DOUBLE) AS value, (SELECT sum(value) FROM m) AS total FROM d")


for _name, _fact_of, _sql in (
    ("numRows", lambda m: m.shape[0], "R"), ("numCols", lambda m: m.shape[1], "20"), ("shape", lambda m: m.shape[0] * 1000 + m.shape[1], "R * 1000 + 20"), ("alen", layout.alen, "R"),
    ("dimSize", lambda m: m.dim_size(Axis.NONE) + m.dim_size(Axis.ROW) + m.dim_size(Axis.COL), "R * 20 + R + 20"), ("nbytes", lambda m: m.nbytes(), "R * 20 * 8"),
    ("isempty", lambda m: m.isempty(), "R = 0"), ("isflat", lambda m: layout.flatten(m).isflat() and not m.isflat(), "R > 1"), ("isscalar", lambda m: m.isscalar(), "R * 20 = 1"), ("issquare", lambda m: m.issquare(), "R = 20"),
    ("item", lambda m: indexing.item(Grid.of(reduce.reduce(m, reducers.amax).select(F.lit(0).alias("row"), F.lit(0).alias("col"), "value"), 1, 1)), "(SELECT max(value) FROM m)"),
):
    _fact(_name, _fact_of, _sql)
_fact("DtypeInfo", lambda m: sum(numeric.dtype_info(m.df.schema["value"].dataType.simpleString())[k] for k in ("bits", "is_integer", "is_signed")), "64 + 0 + 1")
_add("toIndices", lambda m, b: indexing.take(m, Slice(1, -1, 3).to_indices(m.rows), Axis.ROW), "SELECT (row - 1) // 3 AS row, col, value FROM m, d WHERE row >= 1 AND row < R - 1 AND (row - 1) % 3 = 0")
_add("copyto", lambda m, b: layout.copyto(m, b, m > 0), "SELECT row, col, CASE WHEN m.value > 0 THEN b.value ELSE m.value END AS value FROM m JOIN b USING (row, col)")
_add("swap", lambda m, b: (lambda x, y: x - y * 2)(*layout.swap(m, b)), "SELECT row, col, b.value - m.value * 2 AS value FROM m JOIN b USING (row, col)")
_add("resizeFast", lambda m, b: layout.resize_fast(m, m.cols, m.rows) + layout.transpose(m), "SELECT col AS row, row AS col, value FROM m")
_add("toStlVector", lambda m, b: m.df.sparkSession.createDataFrame(list(enumerate(files.to_list(_sums(m)))), "col long, value double"), "SELECT col, sum(value) AS value FROM m GROUP BY col")
_add("print", lambda m, b: m.df.sparkSession.createDataFrame(list(enumerate(files.show(_sums(m)).split("\n"))), "row long, value string"), "SELECT CAST(0 AS BIGINT) AS row, '[' || string_agg(CAST(v AS VARCHAR), ', ' ORDER BY col) || ']' AS value FROM (SELECT col, sum(value) AS v FROM m GROUP BY col)")


def _bits_in_place(m: Grid, b: Grid) -> Grid:
    x = _whole(m)
    x |= 5
    x &= _whole(b) + 64
    x >>= 1
    return x.map(_number)


_add("operator_in_place", _bits_in_place, "SELECT row, col, CAST(((CAST(m.value AS BIGINT) | 5) & (CAST(b.value AS BIGINT) + 64)) >> 1 AS DOUBLE) AS value FROM m JOIN b USING (row, col)")

_COUNTS = "w AS (SELECT value, sum(a) AS a, sum(b) AS b FROM (SELECT value, 1 AS a, 0 AS b FROM m UNION ALL SELECT value, 0, 1 FROM b) GROUP BY value)"
for _name, _times in (("set_union", "greatest(a, b)"), ("set_intersection", "least(a, b)"), ("set_difference", "greatest(a - b, 0)"), ("set_symmetric_difference", "abs(a - b)"), ("merge", "a + b")):
    _add(f"multi{_name}", lambda m, b, f=getattr(multiset, _name): f(m, b).df.select("col", "value"), f", {_COUNTS} SELECT row_number() OVER (ORDER BY value) - 1 AS col, value FROM (SELECT value, unnest(range(0, CAST({_times} AS BIGINT))) FROM w)")
_add("minmax_element", lambda m, b: multiset.minmax_element(m).withColumn("value", F.lit(0.0)), "SELECT (SELECT row * 20 + col FROM m ORDER BY value, row, col LIMIT 1) AS first_min, (SELECT row * 20 + col FROM m ORDER BY value DESC, row DESC, col DESC LIMIT 1) AS last_max, CAST(0 AS DOUBLE) AS value")
_add("rotate", lambda m, b: multiset.rotate(layout.flatten(m), 33), "SELECT CAST(0 AS BIGINT) AS row, (row * 20 + col - 33 + R * 20) % (R * 20) AS col, value FROM m, d")
