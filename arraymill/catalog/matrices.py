"""Matrices of the tables' size: products in tiles, least squares and singular values by orthogonal factors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numeric
from ..operators import blocks, tall
from ..operators.blocks import BlockMatrix
from ..operators.grid import Grid
from ..plans.ordered import ranked

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _register(name: str, sql: str):
    def keep(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name], SQL[name] = f, sql
        return f

    return keep


def _round(c: Column, digits: int = 4) -> Column:
    return numeric.half_up(c, digits)


def _rounded(x: BlockMatrix) -> DataFrame:
    return x.to_grid().df.withColumn("value", _round(F.col("value")))


def _embeddings(spark: SparkSession, sf_dir: str) -> BlockMatrix:
    rows = ranked(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), "vec_id", name="at")
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("d")).first()
    return BlockMatrix.from_vectors(rows, F.col("at"), F.col("embedding"), size["n"], size["d"])


_E = "WITH e AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS r, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"


@_register("block_matmul", f"{_E} SELECT a.r AS row, b.r AS col, floor(list_dot_product(a.v, b.v) * 1e4 + 0.5) / 1e4 AS value FROM e a, e b")
def block_matmul(spark, sf_dir):
    """All vectors times their transpose."""
    e = _embeddings(spark, sf_dir)
    return _rounded(e.multiply(e.transpose()))


@_register("block_cov", f"{_E}, c AS (SELECT r, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS k FROM e) SELECT a.k AS row, b.k AS col, floor(covar_samp(a.x, b.x) * 1e4 + 0.5) / 1e4 AS value FROM c a JOIN c b USING (r) GROUP BY a.k, b.k")
def block_cov(spark, sf_dir):
    return _rounded(_embeddings(spark, sf_dir).covariance())


_FEATURES = {"l_quantity": 1.0, "l_extendedprice": 0.001, "l_discount": 100.0, "l_tax": 100.0, "l_linenumber": 1.0}


@_register("block_gram", f"""
    WITH f AS (SELECT [{", ".join(f"{c} * {w}" for c, w in _FEATURES.items())}] AS v FROM lineitem), g AS (SELECT i, j, sum(v[i + 1] * v[j + 1]) AS s FROM f, range(5) a(i), range(5) b(j) GROUP BY i, j)
    SELECT i AS row, j AS col, floor(s / (SELECT count(*) FROM lineitem) * 1e4 + 0.5) / 1e4 AS value FROM g
""")  # fmt: skip
def block_gram(spark, sf_dir):
    """The lines' features, as a matrix with a row a line, multiplied by their transpose."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", F.array(*[F.col(c) * w for c, w in _FEATURES.items()]).alias("v"))
    rows = ranked(lines, "l_orderkey", "l_linenumber", "v", name="at")
    n = rows.count()
    return _rounded(BlockMatrix.from_vectors(rows, F.col("at"), F.col("v"), n, len(_FEATURES)).gram().map(lambda t: t / n))


_ORDERS = """WITH c AS (SELECT CAST(c_nationkey AS BIGINT) AS i, (year(o_orderdate) - 1990) * 12 + month(o_orderdate) AS j, CAST(count(*) AS DOUBLE) AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
    n AS (SELECT max(i) + 1 AS ni, max(j) + 1 AS nj FROM c), m AS (SELECT i, j, coalesce(v, 0) AS v FROM (SELECT i, j FROM n CROSS JOIN range((SELECT ni FROM n)) x(i) CROSS JOIN range((SELECT nj FROM n)) y(j)) LEFT JOIN c USING (i, j))"""


def _orders(spark: SparkSession, sf_dir: str) -> Grid:
    """Orders by the customer's nation and by month; months before the first are empty columns."""
    orders, customers = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "customer"))
    month = (F.year("o_orderdate") - 1990) * 12 + F.month("o_orderdate")
    cells = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("row"), month.alias("col")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    return Grid.of(cells)


@_register("block_chain", f"{_ORDERS}, s AS (SELECT a.i, b.i AS k, sum(a.v * b.v) AS v FROM m a JOIN m b USING (j) GROUP BY a.i, b.i) SELECT m.j AS row, s.k AS col, sum(m.v * s.v) AS value FROM m JOIN s USING (i) GROUP BY m.j, s.k")
def block_chain(spark, sf_dir):
    """Months by nations, nations by months, months by nations: the short product comes first."""
    m = BlockMatrix.from_grid(_orders(spark, sf_dir), side=16)
    return blocks.chain([m.transpose(), m, m.transpose()]).to_grid().df


@_register("block_power", f"{_ORDERS}, s AS (SELECT a.i, b.i AS k, sum(a.v * b.v) / 1e4 AS v FROM m a JOIN m b USING (j) GROUP BY a.i, b.i), t AS (SELECT a.i, b.k, sum(a.v * b.v) AS v FROM s a JOIN s b ON a.k = b.i GROUP BY a.i, b.k) SELECT a.i AS row, b.k AS col, floor(sum(a.v * b.v) * 1e4 + 0.5) / 1e4 AS value FROM t a JOIN s b ON a.k = b.i GROUP BY a.i, b.k")
def block_power(spark, sf_dir):
    m = BlockMatrix.from_grid(_orders(spark, sf_dir), side=16)
    return _rounded(blocks.power(m.multiply(m.transpose()).map(lambda t: t / 1e4), 3))


@_register("block_nan", f"{_ORDERS} SELECT a.i AS row, b.i AS col, CASE WHEN bool_or(a.v = 7) THEN -1 ELSE sum(a.v * b.v) END AS value FROM m a JOIN m b USING (j) GROUP BY a.i, b.i")
def block_nan(spark, sf_dir):
    """NaN in a row reaches all of the row's products, those with zero too."""
    x = _orders(spark, sf_dir)
    m, holes = (BlockMatrix.from_grid(g, side=16) for g in (x, x.map(lambda v: F.when(v == 7, F.lit(float("nan"))).otherwise(v))))
    return holes.multiply(m.transpose()).to_grid().df.withColumn("value", F.when(F.isnan("value"), F.lit(-1.0)).otherwise(F.col("value")))


_CLOSE = "SELECT l_quantity AS q, l_discount * 100 AS d, l_extendedprice / 1000 AS y FROM lineitem"


@_register("lstsq_collinear", f"""
    WITH s AS (SELECT avg(q) AS mq, avg(d) AS md, avg(y) AS my, var_pop(q) AS qq, var_pop(d) AS dd, covar_pop(q, d) AS qd, covar_pop(q, y) AS qy, covar_pop(d, y) AS dy FROM ({_CLOSE})),
    b AS (SELECT (qy * dd - dy * qd) / (qq * dd - qd * qd) AS bq, (dy * qq - qy * qd) / (qq * dd - qd * qd) AS bd, * FROM s)
    SELECT floor((my - bq * mq - bd * md) * 1e6 + 0.5) / 1e6 AS c0, floor((bq - bd * 1e6) / 1e2 + 0.5) AS c1, floor(bd * 1e6 / 1e2 + 0.5) AS c2, floor(bq * 1e6 + 0.5) / 1e6 AS total FROM b
""")  # fmt: skip
def lstsq_collinear(spark, sf_dir):
    """Two columns of all lines that differ by a millionth of the discount: the fit must tell them apart.

    With d the discount, c1 q + c2 (q + d / 10^6) is (c1 + c2) q + c2 d / 10^6, whose own fit is well conditioned.
    """
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    q, d = F.col("l_quantity"), F.col("l_discount") * 100
    c, _ = tall.lstsq(lines, [F.lit(1.0), q, q + d / 1e6], [F.col("l_extendedprice") / 1000])
    out = [float(v) for v in c[:, 0]]
    return spark.range(1).select(_round(F.lit(out[0]), 6).alias("c0"), F.floor(F.lit(out[1]) / 1e2 + 0.5).cast("double").alias("c1"), F.floor(F.lit(out[2]) / 1e2 + 0.5).cast("double").alias("c2"), _round(F.lit(out[1] + out[2]), 6).alias("total"))


_PAIR = "SELECT sum(l_quantity * l_quantity) AS a, sum(l_quantity * l_extendedprice / 1000) AS b, sum(l_extendedprice / 1000 * l_extendedprice / 1000) AS c, count(*) AS n FROM lineitem"


@_register("svd_tall", f"SELECT floor(sqrt((a + c + sqrt((a - c) * (a - c) + 4 * b * b)) / 2 / n) * 1e6 + 0.5) / 1e6 AS s0, floor(sqrt((a * c - b * b) / ((a + c + sqrt((a - c) * (a - c) + 4 * b * b)) / 2) / n) * 1e6 + 0.5) / 1e6 AS s1 FROM ({_PAIR})")
def svd_tall(spark, sf_dir):
    """Singular values of quantity and price over all lines, by the root of their number."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    s, _ = tall.singular_values(lines, F.col("l_quantity"), F.col("l_extendedprice") / 1000)
    root = F.sqrt(F.count(F.lit(1)))
    return lines.agg(_round(F.lit(float(s[0])) / root, 6).alias("s0"), _round(F.lit(float(s[1])) / root, 6).alias("s1"))


@_register("svd_rows", "SELECT l_orderkey, l_linenumber, l_quantity AS quantity, floor(l_extendedprice * 100 + 0.5) / 100 AS price FROM lineitem")
def svd_rows(spark, sf_dir):
    """Each line's cells put together again from its left vector, the singular values and the right vectors."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    out, s, vt = tall.svd(lines, [F.col("l_quantity"), F.col("l_extendedprice"), F.col("l_tax")])
    cell = lambda j: sum((F.col(f"u{i}") * float(s[i] * vt[i, j]) for i in range(1, len(s))), F.col("u0") * float(s[0] * vt[0, j]))
    return out.select("l_orderkey", "l_linenumber", _round(cell(0), 6).alias("quantity"), _round(cell(1), 2).alias("price"))
