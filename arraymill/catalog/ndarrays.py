"""Arrays of three axes made from tables by key columns: lines by flag, status and month, events by type, day and hour."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import reducers
from ..operators import ndarray
from ..operators.grid import Slice
from ..operators.ndarray import NDArray

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def lines(spark: SparkSession, sf_dir: str, order: str) -> NDArray:
    keys = {"flag": F.col("l_returnflag"), "status": F.col("l_linestatus"), "month": F.date_trunc("month", "l_shipdate")}
    return ndarray.from_table(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), keys, F.sum("l_quantity"), order)[0]


def events(spark: SparkSession, sf_dir: str, order: str) -> NDArray:
    keys = {"type": F.col("event_type"), "day": F.to_date("ts"), "hour": F.hour("ts")}
    return ndarray.from_table(spark.read.parquet(f"{sf_dir}/events.parquet"), keys, F.count(F.lit(1)).cast("double"), order)[0]


_LINES = "SELECT l_returnflag AS x, l_linestatus AS y, date_trunc('month', l_shipdate) AS z, sum(l_quantity) AS value FROM lineitem GROUP BY ALL"
_EVENTS = "SELECT event_type AS x, CAST(ts AS DATE) AS y, hour(ts) AS z, CAST(count(*) AS DOUBLE) AS value FROM events GROUP BY ALL"
_INDEXED = "WITH c AS ({}), a AS (SELECT dense_rank() OVER (ORDER BY x) - 1 AS i, dense_rank() OVER (ORDER BY y) - 1 AS j, dense_rank() OVER (ORDER BY z) - 1 AS k, value FROM c), n AS (SELECT max(i) + 1 AS ni, max(j) + 1 AS nj, max(k) + 1 AS nk FROM a) "


def _at(order: str, *axes: tuple[str, str]) -> str:
    """SQL of the position of (index, length) pairs."""
    out = "0"
    for index, length in axes[::-1] if order == "F" else axes:
        out = f"({out}) * {length} + {index}"
    return f"CAST({out} AS BIGINT)"


_I, _J, _K = ("i", "ni"), ("j", "nj"), ("k", "nk")

#: The operation, and its SQL for an order's position ``p`` of (index, length) pairs.
_OPERATIONS: dict[str, tuple[Callable[[NDArray], NDArray], Callable[[Callable[..., str]], str]]] = {
    "of_table": (lambda a: a, lambda p: f"SELECT {p(_I, _J, _K)} AS at, value FROM a, n"),
    "filled": (lambda a: a.filled(-1.0), lambda p: f"SELECT {p(_I, _J, _K)} AS at, coalesce(value, -1) AS value FROM n CROSS JOIN range((SELECT ni FROM n)) x(i) CROSS JOIN range((SELECT nj FROM n)) y(j) CROSS JOIN range((SELECT nk FROM n)) z(k) LEFT JOIN a USING (i, j, k)"),
    "flatten": (lambda a: a.flatten(), lambda p: f"SELECT {p(_I, _J, _K)} AS at, value FROM a, n"),
    "reshape_plane": (lambda a: a.reshape(-1, a.shape[2]).reduce(reducers.sum_, 0), lambda p: f"SELECT ({p(_I, _J, _K)}) {'// (ni * nj)' if p(_I, _J) == _at('F', _I, _J) else '% nk'} AS at, sum(value) AS value FROM a, n GROUP BY 1"),
    "order_switch": (lambda a: a.with_order("C" if a.order == "F" else "F").reduce(reducers.sum_, (1, 2)), lambda p: "SELECT k AS at, sum(value) AS value FROM a GROUP BY k"),
    "reordered": (lambda a: a.reordered("C" if a.order == "F" else "F"), lambda p: f"SELECT {_at('C' if p(_I, _J) == _at('F', _I, _J) else 'F', _I, _J, _K)} AS at, value FROM a, n"),
    "transpose": (lambda a: a.transpose(2, 0, 1), lambda p: f"SELECT {p(_K, _I, _J)} AS at, value FROM a, n"),
    "flip_roll": (lambda a: a.flip(0).roll(5, 2), lambda p: f"SELECT {p(('ni - 1 - i', 'ni'), _J, ('(k + 5) % nk', 'nk'))} AS at, value FROM a, n"),
    "slice": (lambda a: a.slice(None, Slice(0, 1), Slice(1, -1, 3)), lambda p: f"SELECT {p(_I, ('0', '1'), ('(k - 1) // 3', '((nk - 2 + 2) // 3)'))} AS at, value FROM a, n WHERE j = 0 AND k >= 1 AND k < nk - 1 AND (k - 1) % 3 = 0"),
    "sum_all": (lambda a: a.reduce(reducers.sum_), lambda p: "SELECT CAST(0 AS BIGINT) AS at, sum(value) AS value FROM a"),
    "max_first": (lambda a: a.reduce(reducers.amax, 0), lambda p: f"SELECT {p(_J, _K)} AS at, max(value) AS value FROM a, n GROUP BY 1"),
    "sum_outer": (lambda a: a.reduce(reducers.sum_, (0, 2)), lambda p: "SELECT j AS at, sum(value) AS value FROM a GROUP BY j"),
    "argmax": (lambda a: a.arg_extreme((0, 1)), lambda p: f"SELECT k AS at, CAST(arg_min(q, (-value, q)) AS BIGINT) AS value FROM (SELECT *, {p(_I, _J)} AS q FROM a, n) GROUP BY k"),
    "argmin": (lambda a: a.arg_extreme(2, largest=False), lambda p: f"SELECT {p(_I, _J)} AS at, CAST(arg_min(k, (value, k)) AS BIGINT) AS value FROM a, n GROUP BY 1"),
    "cumsum": (lambda a: a.cumulative(F.sum, 2), lambda p: f"SELECT {p(_I, _J, _K)} AS at, sum(value) OVER (PARTITION BY i, j ORDER BY k) AS value FROM a, n"),
    "broadcast": (lambda a: a - a.reduce(reducers.amax, (0, 1), keep=True), lambda p: f"SELECT {p(_I, _J, _K)} AS at, value - max(value) OVER (PARTITION BY k) AS value FROM a, n"),
    "broadcast_both": (
        lambda a: a.reduce(reducers.sum_, (1, 2), keep=True) + a.reduce(reducers.sum_, (0, 1)),
        lambda p: f"SELECT {p(_I, ('0', '1'), _K)} AS at, x.v + z.v AS value FROM n, (SELECT i, sum(value) AS v FROM a GROUP BY i) x, (SELECT k, sum(value) AS v FROM a GROUP BY k) z",
    ),
    "same_table": (lambda a: ndarray.tmax(*(lambda m, n: (m, n, 0.5 * (m + n)))(*NDArray.columns(a.df, a.shape, F.col("value"), 100 - F.col("value"), order=a.order))), lambda p: f"SELECT {p(_I, _J, _K)} AS at, greatest(value, 100 - value) AS value FROM a, n"),
    "dstack": (lambda a: ndarray.dstack([a, a.map(lambda v: -v)]), lambda p: f"SELECT {p(_I, _J, ('k', '(2 * nk)'))} AS at, value FROM a, n UNION ALL SELECT {p(_I, _J, ('(k + nk)', '(2 * nk)'))}, -value FROM a, n"),
    "hstack": (lambda a: ndarray.hstack([a, a.flip(2)]), lambda p: f"SELECT {p(_I, ('j', '(2 * nj)'), _K)} AS at, value FROM a, n UNION ALL SELECT {p(_I, ('(j + nj)', '(2 * nj)'), ('(nk - 1 - k)', 'nk'))}, value FROM a, n"),
    "vstack": (lambda a: ndarray.vstack([a.reduce(reducers.sum_, (0, 1)), a.reduce(reducers.amax, (0, 1))]), lambda p: f"SELECT {p(('r', '2'), _K)} AS at, v AS value FROM n, (SELECT 0 AS r, k, sum(value) AS v FROM a GROUP BY k UNION ALL SELECT 1, k, max(value) FROM a GROUP BY k)"),
    "meshgrid": (
        lambda a: ndarray.tsum(*[m * w for m, w in zip(ndarray.meshgrid([a.reduce(reducers.sum_, (1, 2)), a.reduce(reducers.sum_, (0, 2)), a.reduce(reducers.sum_, (0, 1))]), (1.0, 2.0, 3.0), strict=True)]),
        lambda p: f"SELECT {p(_I, _J, _K)} AS at, x.v + 2 * y.v + 3 * z.v AS value FROM n, (SELECT i, sum(value) AS v FROM a GROUP BY i) x, (SELECT j, sum(value) AS v FROM a GROUP BY j) y, (SELECT k, sum(value) AS v FROM a GROUP BY k) z",
    ),
    "diag": (lambda a: ndarray.diagonal_matrix(a.reduce(reducers.sum_, (0, 1)), 1), lambda p: f"SELECT {p(('r', 'nk'), ('c', 'nk'))} AS at, CASE WHEN c = r + 1 THEN v ELSE 0 END AS value FROM n, range((SELECT nk FROM n)) y(r), (SELECT k AS c, sum(value) AS v FROM a GROUP BY k) z"),
    "diag_value": (lambda a: a.zip(ndarray.diag(a.df.sparkSession, 7.0, a.shape, a.order), lambda v, d: v + d), lambda p: f"SELECT {p(_I, _J, _K)} AS at, value + CASE WHEN i = j AND j = k THEN 7 ELSE 0 END AS value FROM a, n"),
    "full_like": (lambda a: a.fill(2.5).zip(ndarray.ones(a.df.sparkSession, a.shape, a.order), lambda v, w: v - w), lambda p: f"SELECT {p(_I, _J, _K)} AS at, CAST(1.5 AS DOUBLE) AS value FROM n, range((SELECT ni FROM n)) x(i), range((SELECT nj FROM n)) y(j), range((SELECT nk FROM n)) z(k)"),
    "front_back": (lambda a: NDArray(a.filled(0.0).front().union(a.filled(0.0).back()).select(F.lit(0).cast("long").alias("at"), "value"), (2,)), lambda p: "SELECT CAST(0 AS BIGINT) AS at, coalesce(a.value, 0) AS value FROM n, (VALUES (0), (1)) e(e) LEFT JOIN a ON i = e * (SELECT ni - 1 FROM n) AND j = e * (SELECT nj - 1 FROM n) AND k = e * (SELECT nk - 1 FROM n)"),
}

for _order in ndarray.ORDERS:
    for _n, (_name, (_f, _sql)) in enumerate(_OPERATIONS.items()):
        # lines and events take turns, the other way round in the other order
        _made, _source = ((lines, _LINES), (events, _EVENTS))[(_n + (_order == "C")) % 2]
        QUERIES[f"nd_{_name}_{_order.lower()}"] = lambda spark, sf_dir, make=_made, f=_f, order=_order: f(make(spark, sf_dir, order)).df.select("at", "value")
        SQL[f"nd_{_name}_{_order.lower()}"] = _INDEXED.format(_source) + _sql(lambda *axes, order=_order: _at(order, *axes))
