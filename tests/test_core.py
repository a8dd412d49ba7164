"""Golden values, quirks and properties of the array operators, with numpy as an independent reference."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from arraymill.functions import numeric, special
from arraymill.functions.bits import hamming_decode, hamming_encode
from arraymill.operators import creation, cumulative, filters, indexing, integrate, layout, order, products, reduce, roots
from arraymill.operators.cube import DataCube
from arraymill.operators.grid import Axis, Grid, Slice
from arraymill.operators.random import RNG
from arraymill.plans.ordered import ranked
from arraymill.sources import files
from arraymill.streaming import running

A = np.random.default_rng(0).integers(-9, 9, (5, 4)).astype(float)


@pytest.fixture(scope="module")
def a(spark):
    return Grid.local(spark, A.tolist())


def column(spark, c):
    return spark.range(1).select(c.alias("v")).first()["v"]


def test_golden_creation(spark):
    assert files.to_list(creation.linspace(spark, 2, 3, 5)) == [2, 2.25, 2.5, 2.75, 3]
    assert np.allclose(files.to_list(creation.linspace(spark, 2, 3, 5, False)), [2, 2.2, 2.4, 2.6, 2.8])
    assert files.to_list(creation.arange(spark, 20)) == list(range(20))
    assert files.to_list(creation.arange(spark, 0, 5, 0.5, integer=True)) == [0] * 10
    assert (files.to_numpy(creation.identity(spark, 5)) == np.eye(5)).all()
    assert (files.to_numpy(creation.eye(spark, 3, 3, -1)) == np.eye(3, k=-1)).all()
    assert (files.to_numpy(creation.eye(spark, 3, 3, -1, compat=True)) == 0).all()
    with pytest.raises(ValueError):
        creation.linspace(spark, 3, 2)


def test_quirks(spark):
    v = spark.createDataFrame([(0, 0, x) for x in (1.0, 2.0, 3.0, 4.0)], "row long, col long, value double")
    assert order.nanmedian(Grid(v.withColumn("col", F.monotonically_increasing_id()), 1, 4)).first().value == 3
    assert column(spark, numeric.round_even(F.lit(2.5))) == 2
    assert math.isnan(column(spark, numeric.sinc(F.lit(0.0))))
    assert column(spark, numeric.divide(F.lit(1.0), F.lit(0.0))) == math.inf
    assert math.isnan(column(spark, numeric.divide(F.lit(0.0), F.lit(0.0))))
    assert column(spark, numeric.log(F.lit(0.0))) == -math.inf and math.isnan(column(spark, numeric.log(F.lit(-1.0))))
    assert column(spark, numeric.astype(F.lit(300), 8)) == 44 and column(spark, numeric.astype(F.lit(-1), 8, signed=False)) == 255
    assert column(spark, numeric.int_divide(F.lit(-7), F.lit(2))) == -3
    assert not column(spark, numeric.essentially_equal(F.lit(float("nan")), F.lit(float("nan"))))
    assert column(spark, numeric.gcd(F.lit(-12), F.lit(18))) == 6 and column(spark, numeric.lcm(F.lit(0), F.lit(5))) == 0


def test_against_numpy(spark, a):
    to = files.to_numpy
    assert np.allclose(to(cumulative.cumsum(a)), A.cumsum()[None])
    assert np.allclose(to(cumulative.gradient(a)), np.gradient(A, axis=0))
    assert np.allclose(to(cumulative.roll(a, 3)), np.roll(A, 3))
    assert np.allclose(to(layout.rot90(a)), np.rot90(A)) and np.allclose(to(layout.rot90(a, 3)), np.rot90(A, 3))
    assert np.allclose(to(layout.reshape(a, 2, 10)), A.reshape(2, 10))
    assert np.allclose(to(layout.reshape(a, 2, 10, "F")), A.reshape(2, 10, order="F"))
    assert np.allclose(to(products.matmul(a, layout.transpose(a))), A @ A.T)
    assert np.allclose(to(products.cov(a)), np.cov(A))
    assert np.allclose(to(products.pinv(a)), np.linalg.pinv(A))
    assert {tuple(r) for r in reduce.argmax(a, Axis.COL).collect()} == set(enumerate(A.argmax(1).tolist()))
    assert to(indexing.sliced(a, Slice(0, 5, 2), Slice(-1, 0, -2))).tolist() == A[0:5:2, 0:3:2].tolist()
    assert files.to_list(order.argsort(a)) == np.argsort(A.ravel(), kind="stable").tolist()
    for p in (0, 37.5, 100):
        assert math.isclose(order.percentile(a, p).first().value, np.percentile(A, p))
        for mode in ("lower", "higher", "nearest", "midpoint"):
            assert math.isclose(order.percentile(a, p, mode=mode).first().value, np.percentile(A, p, method=mode))


def test_properties(spark, a):
    assert np.allclose(files.to_numpy(layout.flip(layout.flip(a))), A)
    assert np.allclose(files.to_numpy(cumulative.cumprod(a)), A.cumprod()[None], rtol=1e-9)
    assert order.unique(a).count() == len(np.unique(A))
    with pytest.raises(ValueError, match="broadcast"):
        a + Grid.local(spark, [1, 2, 3])
    with pytest.raises(ValueError):
        filters.uniform_filter(a, 4)
    with pytest.raises(IndexError):
        indexing.at(a, 9, 0)


def test_global_rank_without_one_task(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"))
    rows = ranked(df, "x", partitions=7)
    assert rows.filter("idx <> x").count() == 0
    assert "SinglePartition" not in df.transform(lambda d: ranked(d, "x", partitions=7).drop("_x"))._jdf.queryExecution().executedPlan().toString().split("BroadcastExchange")[0]


def test_files_round_trip(spark, a, tmp_path):
    files.to_binary(a, f"file://{tmp_path}/bin")
    back = files.from_binary(spark, f"file://{tmp_path}/bin")
    assert back.shape == a.shape and np.allclose(files.to_numpy(back), A)
    files.to_text(a, f"file://{tmp_path}/txt", ",")
    assert np.allclose(files.to_numpy(files.from_text(spark, f"file://{tmp_path}/txt", ",")), A)
    (tmp_path / "x.bin").write_bytes(np.arange(5.0).tobytes())
    assert [r.value for r in files.from_raw_files(spark, f"file://{tmp_path}/x.bin").orderBy("idx").collect()] == [0, 1, 2, 3, 4]
    assert files.show(a, 1).count(",") == 3


def test_cube_random_integrals_roots(spark, a):
    cube = DataCube().push_back(a).push_back(a * 2)
    assert cube.shape == (5, 4, 2) and np.allclose(files.to_numpy(cube.back()), A * 2)
    g, h = RNG(5), RNG(5)
    assert files.to_list(g.array(spark, 2, 3, g.normal())) == files.to_list(h.array(spark, 2, 3, h.normal()))
    assert math.isclose(integrate.romberg(spark, 0, 1, 6, F.exp), math.e - 1, rel_tol=1e-9)
    f = lambda x: np.cos(x) - x
    low, high = np.zeros(3), np.ones(3)
    for solve in (roots.bisection, roots.dekker, roots.brent, roots.secant):
        assert np.allclose(solve(f, low, high, 1e-10), 0.7390851332)
    with pytest.raises(RuntimeError):
        roots.newton(lambda x: x * x + 1, lambda x: 2 * x, high, most=20)


def test_special_functions_at_tabled_points():
    s = special
    for got, known in (
        (s.bessel_jn(0, np.array([5.0])), -0.1775967713), (s.bessel_yn(1, np.array([2.0])), -0.1070324315), (s.bessel_in(1, np.array([2.0])), 1.5906368546), (s.bessel_kn(1, np.array([2.0])), 0.1398658818),
        (s.airy_ai(1.0), 0.1352924163), (s.airy_bi(1.0), 1.2074235950), (s.airy_ai(-2.0), 0.2274074283), (s.digamma([-0.5]), 0.0364899740), (s.riemann_zeta([3.0]), 1.2020569032), (s.riemann_zeta([-1.0]), -1 / 12),
        (s.expint([1.0]), 1.8951178164), (s.expint([-5.0]), -0.0011482956), (s.comp_ellint_1(np.array([0.5])), 1.6857503548), (s.erf_inv([0.5]), 0.4769362762), (s.polygamma(2, [1.0]), -2.4041138063), (s.bernoulli([3]), 1 / 42),
    ):
        assert np.allclose(got, known, rtol=1e-8, atol=1e-9)
    assert s.prime(0) == 2 and s.prime(9999) == 104729


def test_special_functions_work_out_distinct_arguments_once(spark):
    values = np.array([0.5, -0.0, np.nan, 0.0, 0.5, 2.0, np.nan, -0.0] * 300)
    sizes = []
    got = special.each_distinct(lambda x, y: sizes.append(len(x)) or np.copysign(1, x) + y, values, np.repeat([1.0, 2.0], 1200))
    np.testing.assert_array_equal(got, np.copysign(1, values) + np.repeat([1.0, 2.0], 1200))
    assert sum(sizes) == 10 and special.each_distinct(special.erf, np.zeros(0)).shape == (0,)
    special.each_distinct(lambda x: sizes.append(len(x)) or x, np.arange(3000.0))
    assert max(sizes) <= special.BLOCK and sum(sizes) == 3010
    # each batch of a table, too: the function tells how many values it got
    rows = spark.range(0, 4000, 1, 2).select(special.column(lambda x: np.full(len(x), float(len(x))), F.col("id") % 7).alias("n"))
    assert rows.agg(F.max("n")).collect() == [(7.0,)]


@pytest.mark.parametrize(("function", "known"), [("airy_bi", [-0.4123025879, 0.6149266274, 0.6149266274, 1.2074235950, np.nan, 3.2980949999, 0.3803526598]), ("airy_bi_prime", [0.2787951669, 0.4482883574, 0.4482883574, 0.9324359334, np.nan, 4.1006820500, 0.5059337136])])
def test_airy_functions_integrate_each_side_for_its_own_arguments(monkeypatch, function, known):
    x, asked = np.array([-2.0, -1e-13, 0.0, 1.0, np.nan, 2.0, -0.5]), []
    for name in ("bessel_jn", "bessel_in"):
        f = getattr(special, name)
        monkeypatch.setattr(special, name, lambda v, z, f=f, name=name: asked.append((name, len(z))) or f(v, z))
    assert np.allclose(getattr(special, function)(x), known, rtol=1e-8, equal_nan=True)
    assert set(asked) == {("bessel_in", 2), ("bessel_jn", 3)}


def test_bernoulli_numbers_of_many_indexes_at_once(monkeypatch):
    asked, zeta = [], special.riemann_zeta
    monkeypatch.setattr(special, "riemann_zeta", lambda s: asked.append(np.size(s)) or zeta(s))
    got = special.bernoulli(np.array([0.0, 1, 2, 3, 10, 0, 400, 401, np.nan]))
    assert np.allclose(got, [1, 1 / 6, -1 / 30, 1 / 42, -174611 / 330, 1, -np.inf, np.inf, np.nan], rtol=1e-12, equal_nan=True)
    assert asked == [9]


def test_hamming_code(spark):
    rows = spark.range(200).select("id", hamming_encode(F.col("id"), 11).alias("w"))
    for k in range(16):
        bad = rows.select("id", hamming_decode(F.col("w").bitwiseXOR(F.lit(1 << k)), 11).alias("d")).filter("d.value <> id or d.status <> 1")
        assert bad.limit(1).count() == 0 or k == 15
    assert rows.select(hamming_decode(F.col("w"), 11).alias("d"), "id").filter("d.value <> id or d.status <> 0").count() == 0


def test_operators_of_grids(spark, a):
    to = files.to_numpy
    b = Grid.local(spark, (A.T.reshape(A.shape) + 0.5).tolist())
    B = A.T.reshape(A.shape) + 0.5
    assert np.allclose(to(2 * a), 2 * A) and np.allclose(to(1 - a), 1 - A) and np.allclose(to(3 / b), 3 / B)
    assert np.allclose(to(7 % b), np.fmod(7, B)) and np.allclose(to(2 + a - b), 2 + A - B)
    number = lambda v: v.cast("double")
    assert (to((a == a.map(lambda v: v + 0)).map(number)) == 1).all()
    assert (to((a == b).map(number)) == (A == B)).all() and (to((a != 3).map(number)) == (A != 3)).all()
    assert (to(a.logical_and(b).map(number)) == ((A != 0) & (B != 0))).all()
    assert (to(a.logical_or(b - b).logical_not().map(number)) == (A == 0)).all()
    assert len({a, b}) == 2


def test_grids_of_one_table_need_no_join(spark):
    cells = spark.range(12).select(F.floor(F.col("id") / 4).alias("row"), (F.col("id") % 4).alias("col"), F.col("id").alias("v"))
    m, n = Grid.columns(cells, 3, 4, F.col("v") * 1.0, F.col("v") % 5)
    out = (m * 2 + n) / (m + 1)
    assert "Join" not in out.df._jdf.queryExecution().optimizedPlan().toString()
    v = np.arange(12.0).reshape(3, 4)
    assert np.allclose(files.to_numpy(out), (v * 2 + v % 5) / (v + 1))


def test_separable_filters(spark, a):
    padded = np.pad(A, 1, constant_values=2.0)
    near = np.stack([padded[i : i + 5, j : j + 4] for i in range(3) for j in range(3)])
    for f, g in ((filters.uniform_filter, np.mean), (filters.maximum_filter, np.max), (filters.minimum_filter, np.min)):
        assert np.allclose(files.to_numpy(f(a, 3, rule=filters.Boundary.CONSTANT, constant=2.0)), g(near, axis=0))


def test_interpolation_of_crowded_points(spark):
    rng = np.random.default_rng(4)
    xs = np.unique(np.concatenate([rng.normal(0, 1e-3, 900), [-50.0, 50.0]]))
    points = spark.createDataFrame([(float(x), float(np.sin(x))) for x in xs], "xp double, fp double")
    at = np.concatenate([xs, rng.uniform(-50, 50, 200)])
    got = files.to_numpy(order.interp(Grid.local(spark, at.tolist()), points))[0]
    assert np.allclose(got, np.interp(at, xs, np.sin(xs)))


def test_raw_files(spark, a, tmp_path):
    assert files.to_raw_files(a, f"file://{tmp_path}/raw", "<f4", 7) == 4 * A.size
    parts = sorted((tmp_path / "raw").glob("*.bin"))
    assert len(parts) == 3 and b"".join(p.read_bytes() for p in parts) == A.astype("<f4").tobytes()
    assert np.allclose(files.to_numpy(files.from_raw(spark, f"file://{tmp_path}/raw", *A.shape, "<f4")), A)


def test_streams(spark, tmp_path):
    """Five batches; one value of the fourth comes after the watermark has passed its window."""
    place, shape = f"file://{tmp_path}/in", "ts timestamp, k string, v double"
    batches = (["2024-01-01 10:00", "2024-01-01 10:30"], ["2024-01-01 13:00", "2024-01-01 13:01"], ["2024-01-01 13:03"], ["2024-01-01 10:05", "2024-01-01 13:02"], ["2024-01-01 18:00"])
    for n, times in enumerate(batches):
        rows = spark.createDataFrame([(t, "a" if i else "b", float(n + 1)) for i, t in enumerate(times)], "ts string, k string, v double")
        rows.select(F.col("ts").cast("timestamp").alias("ts"), "k", "v").coalesce(1).write.mode("append").parquet(place)

    def run(f, mode, name):
        stream = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(place)
        out = f(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"file://{tmp_path}/{name}")
        out.trigger(availableNow=True).start().awaitTermination()
        return spark.table(name)

    hours = run(lambda s: running.windowed(s, "ts", F.col("v"), "1 hour"), "append", "hours").collect()
    # the late value is in no window
    assert sorted((r.start.hour, r.n, r.sum) for r in hours) == [(10, 2, 2.0), (13, 4, 11.0)]
    pauses = run(lambda s: running.sessions(s, "ts", F.col("v"), "5 minutes", "k"), "append", "pauses").collect()
    assert sorted((r.start.hour, r.start.minute, r.n) for r in pauses) == [(10, 0, 1), (10, 30, 1), (13, 0, 2), (13, 1, 2)]
    sums = run(lambda s: running.totals(s, F.col("v"), "k"), "update", "sums").groupBy("k").agg(F.max("n").alias("n"), F.max("sum").alias("sum")).collect()
    assert {(r.k, r.n, r.sum) for r in sums} == {("b", 5, 15.0), ("a", 3, 7.0)}
    steps = run(lambda s: running.cumulative(s, "ts", F.col("v"), "k"), "append", "steps").collect()
    # the row of 10:05 comes after the watermark and is dropped, that of 13:02 counts where it belongs
    assert sorted((r.k, r.ts.hour, r.ts.minute, r.n, r.sum, r["diff"], r.largest) for r in steps) == [
        ("a", 10, 30, 1, 1.0, None, 1.0), ("a", 13, 1, 2, 3.0, 1.0, 2.0), ("a", 13, 2, 3, 7.0, 2.0, 4.0),
        ("b", 10, 0, 1, 1.0, None, 1.0), ("b", 13, 0, 2, 3.0, 1.0, 2.0), ("b", 13, 3, 3, 6.0, 1.0, 3.0),
    ]
    assert all(r.largest_at == r.ts for r in steps)
    table = running.settled(running.windowed(spark.readStream.schema(shape).parquet(place), "ts", F.col("v"), "1 hour"), "test-windows")
    assert table.agg(F.sum("n")).first()[0] == 8


def test_a_cluster_without_a_shared_folder_is_an_error(spark, monkeypatch):
    from arraymill.plans.cut import checkpoint_folder

    monkeypatch.setattr(type(spark.conf), "get", lambda conf, key, *other: other[0] if key == "spark.checkpoint.dir" else "file:/tmp/warehouse")
    assert checkpoint_folder(spark) == "file:/tmp/warehouse/_arraymill"
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_folder(spark)


def test_integrals_of_rows_by_arrays(spark):
    rows = spark.createDataFrame([(0.0, 2.0), (1.0, 1.0), (-1.0, 3.0)], "low double, high double")
    for rule, n in ((integrate.trapezoidal_rows, 4000), (integrate.simpson_rows, 60), (integrate.romberg_rows, 7), (integrate.gauss_legendre_rows, 10)):
        for low, high, v in rows.withColumn("v", integrate.column(rule, F.col("low"), F.col("high"), n, np.sin)).collect():
            assert math.isclose(v, math.cos(low) - math.cos(high), abs_tol=1e-6)


def test_rounding_of_values_beyond_64_bit_integers(spark):
    values = [1.25e20, -3.5e300, 0.12345, -0.00005, float("inf"), float("nan")]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(numeric.half_up("v", 4)).collect()]
    assert got[:2] == pytest.approx(values[:2], rel=1e-15)
    assert got[2:5] == [0.1235, 0.0, math.inf] and math.isnan(got[5])


def test_a_sparse_identity_has_its_diagonal_alone(spark):
    m = Grid.local(spark, [[1.0, 2.0], [3.0, 4.0], [5.0, 6.0]])
    unit = creation.identity(spark, 3, sparse=True)
    assert unit.df.count() == 3
    assert sorted(map(tuple, products.matmul(unit, m).df.select("row", "col", "value").collect())) == sorted(map(tuple, m.df.select("row", "col", "value").collect()))


def test_greatest_common_divisors(spark):
    rows = [(12, 18), (0, 0), (0, 7), (-12, 18), (2**40, 2**39 + 2**38), (10**12, 15), (None, 4), (4, None)]
    got = spark.createDataFrame(rows, "a long, b long").select("a", "b", numeric.gcd("a", "b").alias("g"), numeric.lcm("a", "b").alias("l")).collect()
    for a, b, g, m in got:
        if a is None or b is None:
            assert g is None
        else:
            assert g == math.gcd(a, b) and m == math.lcm(a, b)
    assert "aggregate" not in str(spark.range(1).select(numeric.gcd("id", "id"))._jdf.queryExecution().analyzed())


def test_draws_by_key_are_compiled_and_stay_the_same(spark):
    rows = spark.range(3000)
    draws = {"beta": (lambda g: g.beta(2, 3), 218160915790673430), "poisson": (lambda g: g.poisson(4), -4430342645745389939), "gamma": (lambda g: g.gamma(2, 1.5), 8880239825269635290)}
    for draw, known in draws.values():
        assert rows.select(F.bit_xor(F.xxhash64("id", draw(RNG(7, "id"))))).first()[0] == known
    assert "filter(" not in str(rows.select(RNG(7, "id").poisson(4))._jdf.queryExecution().analyzed())
    assert "transform(" not in str(rows.select(RNG(7, "id").beta(2, 3))._jdf.queryExecution().analyzed())


def test_rows_of_a_stream_leave_in_pieces(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(running, "PIECE", 3)
    rows = [(f"2024-01-01 00:{m:02d}:00", float(v)) for m, v in enumerate([4, 2, 9, 9, 1, 12, 3, 12, 0, 5, 20])]
    spark.createDataFrame(rows, "t string, v double").selectExpr("'k' AS k", "CAST(t AS timestamp) AS ts", "v").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("k string, ts timestamp, v double").parquet(f"{tmp_path}/in")
    got = running.appended(running.cumulative(stream, "ts", F.col("v"), "k", "0 seconds"), "pieces").orderBy("n").collect()
    total, last, best = 0.0, None, None
    assert len(got) >= 10
    for r, (_, v) in zip(got, rows, strict=False):
        total, best = total + v, (r["ts"], v) if best is None or v > best[1] else best
        assert (r["value"], r["sum"], r["diff"], r["largest_at"], r["largest"]) == (v, total, None if last is None else v - last, *best)
        last = v
