"""Reductions by group over lineitem, and set, counting and binning operators over columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numeric, polynomials, reducers
from ..functions.numeric import NAN
from ..operators import order, products
from ..operators.grid import Grid
from ..plans.asof import bracket
from ..plans.ordered import ranked, running_sum
from ..sources.files import from_table
from ..streaming.running import appended, cumulative, sessions, settled, windowed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_R = reducers
_X = "CASE WHEN l_linenumber = 3 THEN NULL ELSE l_quantity END"


def _round(c: Column) -> Column:
    return numeric.half_up(c, 4)


def _reducer(name: str, f: Callable[[Column], Column], sql: str, kind: str = "double", nan: bool = False) -> None:
    """A reduction of l_quantity by return flag; for nan, with NaN in every third line."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        v = F.when(F.col("l_linenumber") == 3, F.lit(NAN)).otherwise(F.col("l_quantity")) if nan else F.col("l_quantity")
        out = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_returnflag").agg(f(v).alias("value"))
        return out.select("l_returnflag", (_round(F.col("value")) if kind == "double" else F.col("value").cast(kind)).alias("value"))

    QUERIES[name] = run
    out = f"floor(CAST({sql} AS DOUBLE) * 1e4 + 0.5) / 1e4" if kind == "double" else f"CAST({sql} AS {kind})"
    SQL[name] = f"SELECT l_returnflag, {out} AS value FROM (SELECT l_returnflag, {_X if nan else 'l_quantity'} AS v FROM lineitem) GROUP BY l_returnflag"


for _name, _f, _sql, _kind in (
    ("all", _R.all_, "bool_and(v <> 0)", "boolean"), ("any", _R.any_, "bool_or(v <> 0)", "boolean"), ("none", _R.none, "NOT bool_or(v <> 0)", "boolean"),
    ("amax", _R.amax, "max(v)", "double"), ("amin", _R.amin, "min(v)", "double"), ("max", _R.max_, "max(v)", "double"), ("min", _R.min_, "min(v)", "double"),
    ("mean", _R.mean, "avg(v)", "double"), ("median", _R.median, "median(v)", "double"), ("median_int", lambda v: _R.median(v.cast("int"), True), "floor(median(v))", "bigint"),
    ("sum", _R.sum_, "sum(v)", "double"), ("size", _R.size, "count(*)", "bigint"), ("count_nonzero", lambda v: _R.count_nonzero(v - 7), "count(*) FILTER (v <> 7)", "bigint"),
    ("contains", lambda v: _R.contains(v, 51.0), "bool_or(v = 51)", "boolean"), ("ptp", _R.ptp, "max(v) - min(v)", "double"), ("rms", _R.rms, "sqrt(avg(v * v))", "double"),
    ("norm", _R.norm, "sqrt(sum(v * v))", "double"), ("stdev", _R.stdev, "stddev_pop(v)", "double"), ("var", _R.var, "var_pop(v)", "double"),
    ("percentile", lambda v: _R.percentile(v, 30), "quantile_cont(v, 0.3)", "double"), ("average_weighted", lambda v: _R.average(v, v + 1), "sum(v * (v + 1)) / sum(v + 1)", "double"), ("average", _R.average, "avg(v)", "double"),
    ("prod", lambda v: F.log(_R.prod(1 + v / 1e6)), "sum(ln(1 + v / 1e6))", "double"),
):
    _reducer(_name, _f, _sql, _kind)
for _name, _f, _sql in (
    ("nanmax", _R.nanmax, "max(v)"), ("nanmin", _R.nanmin, "min(v)"), ("nansum", _R.nansum, "coalesce(sum(v), 0)"), ("nanmean", _R.nanmean, "avg(v)"), ("nanvar", _R.nanvar, "var_pop(v)"),
    ("nanstdev", _R.nanstdev, "stddev_pop(v)"), ("nanpercentile", lambda v: _R.nanpercentile(v, 75), "quantile_cont(v, 0.75)"), ("nanprod", lambda v: F.log(_R.nanprod(1 + v / 1e6)), "coalesce(sum(ln(1 + v / 1e6)), 0)"),
):
    _reducer(_name, _f, _sql, nan=True)


def _register(name: str, sql: str):
    def keep(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name], SQL[name] = f, sql
        return f

    return keep


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _column(spark: SparkSession, sf_dir: str, table: str, value: str, key: str) -> Grid:
    return from_table(_table(spark, sf_dir, table), F.col(value), key)


@_register("flagship", """
    SELECT l_returnflag, floor(avg(l_extendedprice) * 100 + 0.5) / 100 AS mean, floor(stddev_pop(l_extendedprice) * 100 + 0.5) / 100 AS stdev, floor(median(l_extendedprice) * 100 + 0.5) / 100 AS median,
           floor(quantile_cont(l_extendedprice, 0.9) * 100 + 0.5) / 100 AS p90, floor((max(l_extendedprice) - min(l_extendedprice)) * 100 + 0.5) / 100 AS ptp, floor(sqrt(avg(l_extendedprice * l_extendedprice)) * 100 + 0.5) / 100 AS rms
    FROM lineitem GROUP BY l_returnflag
""")  # fmt: skip
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("l_extendedprice")
    cents = lambda c: F.floor(c * 100 + 0.5) / 100
    lines = _table(spark, sf_dir, "lineitem").select("l_returnflag", "l_extendedprice")
    sums = lines.groupBy("l_returnflag").agg(cents(_R.mean(v)).alias("mean"), cents(_R.stdev(v)).alias("stdev"), cents(_R.ptp(v)).alias("ptp"), cents(_R.rms(v)).alias("rms"))
    ranked_values = order.percentiles(lines, ["l_returnflag"], "l_extendedprice", {"median": 50, "p90": 90})
    return sums.join(ranked_values, "l_returnflag").select("l_returnflag", "mean", "stdev", cents(F.col("median")).alias("median"), cents(F.col("p90")).alias("p90"), "ptp", "rms")


@_register("cumsum_orders", "SELECT o_orderkey, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) OVER (ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS cents FROM orders")
def cumsum_orders(spark, sf_dir):
    rows = running_sum(_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_totalprice"), F.round(F.col("o_totalprice") * 100).cast("long"), "o_orderdate", "o_orderkey", name="cents")
    return rows.select("o_orderkey", "cents")


@_register("global_rank", "SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS idx FROM customer")
def global_rank(spark, sf_dir):
    return ranked(_table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", "c_custkey").select("c_custkey", "idx")


@_register("sort", "SELECT row_number() OVER (ORDER BY c_acctbal) - 1 AS col, c_acctbal AS value FROM customer")
def sort(spark, sf_dir):
    return order.sort(_column(spark, sf_dir, "customer", "c_acctbal", "c_custkey")).df.select("col", "value")


@_register("argsort", "WITH k AS (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS pos, c_acctbal AS v FROM customer) SELECT row_number() OVER (ORDER BY v, pos) - 1 AS col, pos AS value FROM k")
def argsort(spark, sf_dir):
    return order.argsort(_column(spark, sf_dir, "customer", "c_acctbal", "c_custkey")).df.select("col", "value")


@_register("partition", "SELECT CAST(sign(r - 10) AS DOUBLE) AS side, count(*) AS n, min(v) AS low, max(v) AS high FROM (SELECT c_acctbal AS v, row_number() OVER (ORDER BY c_acctbal) - 1 AS r FROM customer) GROUP BY 1")
def partition(spark, sf_dir):
    """What lies before, at and behind place 10 of all values."""
    out = order.partition(_column(spark, sf_dir, "customer", "c_acctbal", "c_custkey"), 10).df
    return out.groupBy(F.signum(F.col("col") - 10).alias("side")).agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))


for _mode, _pick in (("lower", "floor((n - 1) * 0.37)"), ("higher", "ceil((n - 1) * 0.37)"), ("nearest", "round_even((n - 1) * 0.37, 0)")):

    def _percentile(spark, sf_dir, mode=_mode):
        return order.percentile(_column(spark, sf_dir, "customer", "c_acctbal", "c_custkey"), 37, mode=mode)

    QUERIES[f"percentile_{_mode}"] = _percentile
    SQL[f"percentile_{_mode}"] = f"SELECT v AS value FROM (SELECT c_acctbal AS v, row_number() OVER (ORDER BY c_acctbal) - 1 AS r, count(*) OVER () AS n FROM customer) WHERE r = {_pick}"


@_register("percentile_midpoint", "SELECT floor(avg(v) * 1e4 + 0.5) / 1e4 AS value FROM (SELECT c_acctbal AS v, row_number() OVER (ORDER BY c_acctbal) - 1 AS r, count(*) OVER () AS n FROM customer) WHERE r IN (floor((n - 1) * 0.37), ceil((n - 1) * 0.37))")
def percentile_midpoint(spark, sf_dir):
    return order.percentile(_column(spark, sf_dir, "customer", "c_acctbal", "c_custkey"), 37, mode="midpoint").select(_round(F.col("value")).alias("value"))


for _mode, _low, _high in (("linear", "floor(x)", "ceil(x)"), ("lower", "floor(x)", "floor(x)"), ("higher", "ceil(x)", "ceil(x)"), ("nearest", "round_even(x, 0)", "round_even(x, 0)"), ("midpoint", "floor(x)", "ceil(x)")):

    def _by_group(spark, sf_dir, mode=_mode):
        found = order.percentiles(_table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice", {"p10": 10, "p37": 37, "p99": 99}, mode)
        return found.select("l_returnflag", "l_linestatus", *[_round(F.col(c)).alias(c) for c in ("p10", "p37", "p99")])

    QUERIES[f"percentiles_by_group_{_mode}"] = _by_group
    _one = lambda p, low=_low, high=_high, share="x - floor(x)" if _mode == "linear" else "0.5": f"floor((max(v) FILTER (r = {low.replace('x', f'((n - 1) * {p})')}) * (1 - ({share.replace('x', f'((any_value(n) - 1) * {p})')})) + max(v) FILTER (r = {high.replace('x', f'((n - 1) * {p})')}) * ({share.replace('x', f'((any_value(n) - 1) * {p})')})) * 1e4 + 0.5) / 1e4"
    SQL[f"percentiles_by_group_{_mode}"] = f"""
        WITH k AS (SELECT l_returnflag, l_linestatus, l_extendedprice AS v, row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY l_extendedprice) - 1 AS r, count(*) OVER (PARTITION BY l_returnflag, l_linestatus) AS n FROM lineitem)
        SELECT l_returnflag, l_linestatus, {_one(0.1)} AS p10, {_one(0.37)} AS p37, {_one(0.99)} AS p99 FROM k GROUP BY l_returnflag, l_linestatus
    """


@_register("nth_element", "SELECT l_shipdate_month AS month, v AS value FROM (SELECT month(l_shipdate) AS l_shipdate_month, l_extendedprice AS v, row_number() OVER (PARTITION BY month(l_shipdate) ORDER BY l_extendedprice) AS r FROM lineitem) WHERE r = 101")
def nth_element(spark, sf_dir):
    """The value of rank 100 of each month, ties counted one by one."""
    lines = _table(spark, sf_dir, "lineitem").select(F.month("l_shipdate").cast("long").alias("month"), "l_extendedprice")
    return order.nth_element(lines, ["month"], "l_extendedprice", 100).filter("value IS NOT NULL")


@_register("nanmedian", "SELECT v AS value FROM (SELECT c_acctbal AS v, row_number() OVER (ORDER BY c_acctbal) - 1 AS r, count(*) OVER () AS n FROM customer WHERE c_nationkey <> 3) WHERE r = n // 2")
def nanmedian(spark, sf_dir):
    rows = _table(spark, sf_dir, "customer").withColumn("v", F.when(F.col("c_nationkey") == 3, F.lit(NAN)).otherwise(F.col("c_acctbal")))
    return order.nanmedian(from_table(rows, F.col("v"), "c_custkey"))


@_register("unique", "SELECT row_number() OVER (ORDER BY v) - 1 AS col, v AS value FROM (SELECT DISTINCT CAST(p_size AS DOUBLE) AS v FROM part)")
def unique(spark, sf_dir):
    rows = _table(spark, sf_dir, "part").withColumn("v", F.col("p_size").cast("double"))
    return order.unique(from_table(rows, F.col("v"), "p_partkey")).select("col", "value")


for _name, _op in (("union1d", "UNION"), ("intersect1d", "INTERSECT"), ("setdiff1d", "EXCEPT")):

    def _set(spark, sf_dir, name=_name):
        a = from_table(_table(spark, sf_dir, "part"), F.col("p_size").cast("long"), "p_partkey")
        b = from_table(_table(spark, sf_dir, "customer"), F.col("c_custkey") % 40 + 20, "c_custkey")
        return getattr(order, name)(a, b).select("col", "value")

    QUERIES[_name] = _set
    SQL[_name] = f"SELECT row_number() OVER (ORDER BY v) - 1 AS col, v AS value FROM (SELECT CAST(p_size AS BIGINT) AS v FROM part {_op} SELECT c_custkey % 40 + 20 FROM customer)"


@_register("bincount", "WITH c AS (SELECT greatest(CAST(p_size AS BIGINT) - 3, 0) AS col, count(*) AS n FROM part GROUP BY 1) SELECT b AS col, coalesce(n, 0) AS value FROM range(0, greatest((SELECT max(col) FROM c), 59) + 1) r(b) LEFT JOIN c ON c.col = b")
def bincount(spark, sf_dir):
    return order.bincount(from_table(_table(spark, sf_dir, "part"), F.col("p_size") - 3, "p_partkey"), min_length=60)


@_register("digitize", "SELECT event_id, CAST((value >= 1) AS INT) + CAST((value >= 2.5) AS INT) + CAST((value >= 10) AS INT) AS bin FROM events")
def digitize(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", order.digitize(F.col("value"), [10, 1, 2.5, 1]).alias("bin"))


@_register("histogram", "SELECT b AS bin, b * 10.0 AS low, b * 10.0 + 10 AS high, (SELECT count(*) FROM lineitem WHERE l_quantity >= b * 10 AND (l_quantity < b * 10 + 10 OR (b = 4 AND l_quantity = 50))) AS value FROM range(0, 5) r(b)".replace("b * 10.0 AS low, b * 10.0 + 10 AS high", "CAST(b * 10 AS DOUBLE) AS low, CAST(b * 10 + 10 AS DOUBLE) AS high"))
def histogram(spark, sf_dir):
    rows = _table(spark, sf_dir, "lineitem").select(F.lit(0).alias("row"), F.lit(0).alias("col"), F.col("l_quantity").alias("value"))
    return order.histogram(Grid(rows, 1, 1), [0, 10, 20, 30, 40, 50]).withColumn("bin", F.col("bin").cast("long"))


@_register("histogram_bins", "WITH m AS (SELECT min(l_quantity) AS a, max(l_quantity) AS b FROM lineitem) SELECT least(floor((l_quantity - a) * 7 / (b - a)), 6) AS bin, count(*) AS value FROM lineitem, m GROUP BY 1")
def histogram_bins(spark, sf_dir):
    rows = _table(spark, sf_dir, "lineitem").select(F.lit(0).alias("row"), F.lit(0).alias("col"), F.col("l_quantity").alias("value"))
    return order.histogram_bins(Grid(rows, 1, 1), 7).select(F.col("bin").cast("double").alias("bin"), "value").filter("value > 0")


@_register("interp", """
    WITH p AS (SELECT DISTINCT CAST(p_size AS DOUBLE) AS xp, CAST(p_size * p_size AS DOUBLE) AS fp FROM part),
    s AS (SELECT xp AS a, fp AS fa, lead(xp) OVER (ORDER BY xp) AS b, lead(fp) OVER (ORDER BY xp) AS fb FROM p),
    v AS (SELECT event_id, least(greatest(value, 1), 50) AS x FROM events)
    SELECT event_id, floor((fa + (fb - fa) * (x - a) / (b - a)) * 1e4 + 0.5) / 1e4 AS value FROM v JOIN s ON x >= a AND (x < b OR (x = b AND b = 50))
""")  # fmt: skip
def interp(spark, sf_dir):
    points = _table(spark, sf_dir, "part").select(F.col("p_size").cast("double").alias("xp"), (F.col("p_size") * F.col("p_size")).cast("double").alias("fp")).distinct()
    rows = _table(spark, sf_dir, "events").select(F.lit(0).cast("long").alias("row"), F.col("event_id").alias("col"), F.greatest(F.least("value", F.lit(50.0)), F.lit(1.0)).alias("value"))
    out = order.interp(Grid(rows, 1, 0), points)
    return out.df.select(F.col("col").alias("event_id"), _round(F.col("value")).alias("value"))


_EDGES = "WITH e AS (SELECT x, row_number() OVER (ORDER BY x) AS n FROM (SELECT DISTINCT o_totalprice AS x FROM orders))"


@_register("digitize_by_table", f"{_EDGES} SELECT l_orderkey, l_linenumber, coalesce(e.n, 0) AS bin FROM lineitem l ASOF LEFT JOIN e ON l.l_extendedprice >= e.x")
def digitize_by_table(spark, sf_dir):
    """Bins of line prices between all order prices."""
    lines = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("row"), F.col("l_linenumber").cast("long").alias("col"), F.col("l_extendedprice").alias("value"))
    edges = _table(spark, sf_dir, "orders").select(F.col("o_totalprice").alias("edge"))
    return order.digitize_by(Grid(lines, 0, 0), edges).df.select(F.col("row").alias("l_orderkey"), F.col("col").cast("int").alias("l_linenumber"), F.col("value").alias("bin"))


@_register("histogram_by_table", f"""{_EDGES}, b AS (SELECT n - 1 AS bin, x AS low, lead(x) OVER (ORDER BY x) AS high, count(*) OVER () AS m FROM e),
    c AS (SELECT CASE WHEN l_extendedprice = (SELECT max(x) FROM e) THEN (SELECT max(n) FROM e) - 2 ELSE e.n - 1 END AS bin, count(*) AS value FROM lineitem l ASOF JOIN e ON l.l_extendedprice >= e.x WHERE l_extendedprice <= (SELECT max(x) FROM e) GROUP BY 1)
    SELECT bin, low, high, coalesce(value, 0) AS value FROM b LEFT JOIN c USING (bin) WHERE high IS NOT NULL""")  # fmt: skip
def histogram_by_table(spark, sf_dir):
    lines = _table(spark, sf_dir, "lineitem").select(F.lit(0).alias("row"), F.lit(0).alias("col"), F.col("l_extendedprice").alias("value"))
    return order.histogram_by(Grid(lines, 1, 1), _table(spark, sf_dir, "orders").select(F.col("o_totalprice").alias("edge")))


@_register("interp_by_table", """
    WITH p AS (SELECT CAST(epoch(o_orderdate) / 86400 AS DOUBLE) AS xp, avg(o_totalprice) AS fp FROM orders GROUP BY 1),
    s AS (SELECT xp AS a, fp AS fa, lead(xp) OVER (ORDER BY xp) AS b, lead(fp) OVER (ORDER BY xp) AS fb FROM p),
    v AS (SELECT l_orderkey, l_linenumber, least(greatest(CAST(epoch(l_shipdate) / 86400 AS DOUBLE), (SELECT min(xp) FROM p)), (SELECT max(xp) FROM p)) AS x FROM lineitem)
    SELECT l_orderkey, l_linenumber, floor(CASE WHEN x = a THEN fa ELSE fa * (1 - (x - a) / (b - a)) + fb * ((x - a) / (b - a)) END * 1e4 + 0.5) / 1e4 AS value FROM v ASOF JOIN s ON v.x >= s.a
""")  # fmt: skip
def interp_by_table(spark, sf_dir):
    """The average order price of days, interpolated at the days lines were shipped."""
    day = lambda c: F.unix_timestamp(F.col(c).cast("timestamp")) / 86400
    points = _table(spark, sf_dir, "orders").groupBy(day("o_orderdate").alias("xp")).agg(F.avg("o_totalprice").alias("fp"))
    ends = points.agg(F.min("xp").alias("_first"), F.max("xp").alias("_last"))
    lines = _table(spark, sf_dir, "lineitem").join(F.broadcast(ends))
    lines = lines.select(F.col("l_orderkey").alias("row"), F.col("l_linenumber").cast("long").alias("col"), F.least(F.greatest(day("l_shipdate"), "_first"), "_last").alias("value"))
    return order.interp(Grid(lines, 0, 0), points).df.select(F.col("row").alias("l_orderkey"), F.col("col").cast("int").alias("l_linenumber"), _round(F.col("value")).alias("value"))


@_register("asof_orders", """
    WITH o AS (SELECT o_custkey, o_orderdate, max(o_orderkey) AS o_orderkey FROM orders GROUP BY ALL),
    b AS (SELECT event_id, o_orderkey AS before FROM events e ASOF LEFT JOIN o ON e.user_id = o.o_custkey AND e.ts >= o.o_orderdate),
    n AS (SELECT o_custkey, o_orderdate, min(o_orderkey) AS o_orderkey FROM orders GROUP BY ALL),
    a AS (SELECT event_id, o_orderkey AS after FROM events e ASOF LEFT JOIN n ON e.user_id = n.o_custkey AND e.ts < n.o_orderdate)
    SELECT event_id, coalesce(before, -1) AS before, coalesce(after, -1) AS after FROM b JOIN a USING (event_id)
""")  # fmt: skip
def asof_orders(spark, sf_dir):
    """For each event the last order of its user before it and the first after it."""
    events = _table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("custkey"), F.col("ts").alias("at"))
    orders = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("custkey"), F.col("o_orderdate").alias("at"), "o_orderkey")
    return bracket(events, orders, "at", ["custkey"]).select("event_id", *[F.coalesce(c, F.lit(-1)).alias(n) for n, c in (("before", F.col("below.o_orderkey")), ("after", F.col("above.o_orderkey")))])


@_register("poly1d_fit", "SELECT floor((avg(y) - covar_pop(x, y) / var_pop(x) * avg(x)) * 1e4 + 0.5) / 1e4 AS c0, floor(covar_pop(x, y) / var_pop(x) * 1e4 + 0.5) / 1e4 AS c1 FROM (SELECT l_quantity AS x, l_extendedprice / 1000 AS y FROM lineitem)")
def poly1d_fit(spark, sf_dir):
    rows = _table(spark, sf_dir, "lineitem")
    c = polynomials.Poly1d.fit(rows, F.col("l_quantity"), F.col("l_extendedprice") / 1000, 1).coefficients
    return spark.range(1).select(_round(F.lit(c[0])).alias("c0"), _round(F.lit(c[1])).alias("c1"))


@_register("gaussNewtonNlls", "SELECT 2.0 AS a, 0.5 AS b, 0.0 AS rms".replace("2.0", "CAST(2 AS DOUBLE)").replace("0.5", "CAST(0.5 AS DOUBLE)").replace("0.0", "CAST(0 AS DOUBLE)"))
def gauss_newton(spark, sf_dir):
    """y = a exp(b x) recovered from exact measurements."""
    rows = _table(spark, sf_dir, "part").select((F.col("p_size") / 20).alias("x")).withColumn("y", 2 * F.exp(0.5 * F.col("x")))
    x, y = F.col("x"), F.col("y")
    beta, rms = products.gauss_newton(rows, lambda p: y - p[0] * F.exp(p[1] * x), [lambda p: F.exp(p[1] * x), lambda p: p[0] * x * F.exp(p[1] * x)], [1.5, 0.4], 12)
    return spark.range(1).select(_round(F.lit(beta[0])).alias("a"), _round(F.lit(beta[1])).alias("b"), _round(F.lit(rms)).alias("rms"))


@_register("embedding_dot", "SELECT vec_id, floor(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))) * 1e4 + 0.5) / 1e4 AS value FROM embeddings")
def embedding_dot(spark, sf_dir):
    return _table(spark, sf_dir, "embeddings").select("vec_id", _round(products.array_dot(F.col("embedding"), F.col("embedding"))).alias("value"))


@_register("windowed_stream", """
    SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, floor(sum(value) * 1e4 + 0.5) / 1e4 AS total, max(value) AS max FROM events GROUP BY ALL
""")  # fmt: skip
def windowed_stream(spark, sf_dir):
    """The streaming operator on a bounded table: event-time windows have the same rows there."""
    out = windowed(_table(spark, sf_dir, "events").select("ts", "event_type", "value"), "ts", F.col("value"), "1 hour", "event_type")
    return out.select("start", "event_type", "n", _round(F.col("sum")).alias("total"), "max")


@_register("stream_windows", SQL["windowed_stream"])
def stream_windows(spark, sf_dir):
    """The same windows from a stream that reads the table's files."""
    path = f"{sf_dir}/events.parquet"
    # a pattern, which may name a file or a folder of files
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[t]")
    out = settled(windowed(stream.select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value"), "ts", F.col("value"), "1 hour", "event_type"), "stream-windows")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", _round(F.col("sum")).alias("total"), "max")


@_register("stream_cumulative", """
    WITH e AS (SELECT event_type, ts, value FROM events WHERE ts <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 10 MINUTE FROM events)),
    r AS (SELECT *, row_number() OVER w AS n, sum(value) OVER w AS s, value - lag(value) OVER w AS d, max(value) OVER w AS m, coalesce(value > max(value) OVER (PARTITION BY event_type ORDER BY ts, value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS top
          FROM e WINDOW w AS (PARTITION BY event_type ORDER BY ts, value ROWS UNBOUNDED PRECEDING))
    SELECT event_type, ts, n, floor(s * 1e4 + 0.5) / 1e4 AS sum, floor(coalesce(d, 0) * 1e4 + 0.5) / 1e4 AS diff, m AS largest, last_value(CASE WHEN top THEN ts END IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY ts, value ROWS UNBOUNDED PRECEDING) AS largest_at FROM r
""")  # fmt: skip
def stream_cumulative(spark, sf_dir):
    """Running sums, differences and greatest values of a stream's events by type, up to the watermark."""
    path = f"{sf_dir}/events.parquet"
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[t]")
    out = appended(cumulative(stream, "ts", F.col("value"), "event_type"), "stream-cumulative")
    at = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return out.select("event_type", at("ts"), "n", _round(F.col("sum")).alias("sum"), _round(F.coalesce("diff", F.lit(0.0))).alias("diff"), "largest", at("largest_at"))


@_register("session_stream", """
    WITH e AS (SELECT ts, event_type, value, CASE WHEN ts - lag(ts) OVER w < INTERVAL 5 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts)),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY event_type ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM e)
    SELECT min(ts) AS start, max(ts) + INTERVAL 5 MINUTE AS "end", event_type, count(*) AS n, floor(sum(value) * 1e4 + 0.5) / 1e4 AS total FROM s GROUP BY event_type, session
""")  # fmt: skip
def session_stream(spark, sf_dir):
    """Sessions of events of a type with pauses below five minutes."""
    rows = _table(spark, sf_dir, "events").select("ts", "event_type", "value")
    out = sessions(rows, "ts", F.col("value"), "5 minutes", "event_type")
    return out.select("start", "end", "event_type", "n", _round(F.col("sum")).alias("total"))
