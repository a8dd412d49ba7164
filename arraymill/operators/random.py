"""Seeded random arrays, every distribution a Column made from uniforms.

Draws without a key come from Spark's generators and repeat as long as rows are partitioned alike. Draws by
a row's key are hashes of the key, the seed and a counter, so they belong to the row: any partitioning,
order or subset of the table gives a row the same draws. What has no closed form is drawn by rejection, one
try after the other, or looked up in a table of the distribution function.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.ordered import ranked
from .grid import Grid

#: Tries of a rejection. One is accepted with probability 0.95 or more, so all fail in 10^-26 of the draws.
TRIES = 20
#: Tries that are expressions of their own, without a loop.
COMPILED = 2
#: Mean of the largest count that is drawn in one look-up; larger ones are sums.
TABLE_MEAN = 256
#: Bounds of a look-up that are compared by expressions; more of them are an array.
COMPARED = 128


def _inverse(weights: list[float]) -> Callable[[Column], Column]:
    """Number of a weight for a uniform value, in proportion to the weights."""
    total, done, bounds = math.fsum(weights), 0.0, []
    for w in weights[:-1]:
        done += w / total
        bounds.append(done)

    def below(u: Column, low: int, high: int) -> Column:
        """How many bounds lie at or below u, of which at least ``low`` and at most ``high`` do: halves are compared, as Spark compiles them."""
        if low == high:
            return F.lit(low).cast("long")
        middle = (low + high) // 2
        return F.when(u < bounds[middle], below(u, low, middle)).otherwise(below(u, middle + 1, high))

    if len(bounds) <= COMPARED:
        return lambda u: below(u, 0, len(bounds))
    own = F.array(*[F.lit(b) for b in bounds])
    return lambda u: F.size(F.filter(own, lambda b: b <= u)).cast("long")


def _weights(mass: Callable[[int], float], middle: float) -> list[float]:
    """Probabilities of 0, 1, ... until what is left beyond the middle is below the steps of a uniform."""
    out = []
    while True:
        out.append(mass(len(out)))
        if len(out) > middle and out[-1] < 2.0**-60:
            return out


class RNG:
    """Draws that repeat for a seed; each call takes the next counter in line. With keys, draws by row."""

    def __init__(self, seed: int = 0, *key: Column | str):
        self._seed, self._key, self._drawn = seed, [F.col(k) if isinstance(k, str) else k for k in key], 0

    def seed(self, value: int) -> None:
        self._seed, self._drawn = value, 0

    def _next(self) -> int:
        self._drawn += 1
        return self._seed + self._drawn

    def _once(self, values: list[Column], f: Callable[..., Column]) -> Column:
        """f of draws that it may use several times. A key's draws are the same each time, others are held."""
        if self._key:
            return f(*values)
        named = F.struct(*[v.alias(f"v{i}") for i, v in enumerate(values)])
        return F.transform(F.array(named), lambda s: f(*[s[f"v{i}"] for i in range(len(values))]))[0]

    # ---- uniforms and normals

    def rand(self) -> Column:
        """A value above 0 and below 1."""
        if not self._key:
            return F.rand(self._next())
        self._drawn += 1
        return self._hashed(F.lit(self._drawn).cast("long"))

    def _hashed(self, counter: Column) -> Column:
        """The uniform value of a row's counter."""
        mixed = F.xxhash64(*self._key, F.lit(self._seed).cast("long"), counter)
        return (F.shiftrightunsigned(mixed, 11).cast("double") + 0.5) * 2.0**-53

    def _by_row(self, draw: Callable[[RNG], Column]) -> Column:
        """A draw that needs many counters of a row; without a key, a row's key is a value drawn for it."""
        return draw(self) if self._key else self._once([self.rand()], lambda u: draw(RNG(self._next(), u)))

    def randn(self) -> Column:
        if not self._key:
            return F.randn(self._next())
        return F.sqrt(-2 * F.log(self.rand())) * F.cos(2 * math.pi * self.rand())

    standard_normal = randn

    def uniform(self, low: float, high: float) -> Column:
        return low + (high - low) * self.rand()

    rand_float = uniform

    def rand_int(self, low: int, high: int) -> Column:
        return F.floor(low + (high - low) * self.rand()).cast("long")

    def normal(self, mean: float = 0.0, sigma: float = 1.0) -> Column:
        return mean + sigma * self.randn()

    def lognormal(self, mean: float = 0.0, sigma: float = 1.0) -> Column:
        return F.exp(self.normal(mean, sigma))

    def bernoulli(self, p: float = 0.5) -> Column:
        return self.rand() < p

    def cauchy(self, mean: float = 0.0, sigma: float = 1.0) -> Column:
        return mean + sigma * F.tan(math.pi * (self.rand() - 0.5))

    def exponential(self, rate: float = 1.0) -> Column:
        """The parameter is the rate, not its inverse."""
        return -F.log1p(-self.rand()) / rate

    def extreme_value(self, a: float = 1.0, b: float = 1.0) -> Column:
        return a - b * F.log(-F.log1p(-self.rand()))

    def geometric(self, p: float = 0.5) -> Column:
        return F.floor(F.log1p(-self.rand()) / math.log1p(-p)).cast("long") if p < 1 else F.lit(0).cast("long")

    def laplace(self, loc: float = 0.0, scale: float = 1.0) -> Column:
        return loc + scale * (F.log1p(-self.rand()) - F.log1p(-self.rand()))

    def triangle(self, a: float = 0.0, b: float = 0.5, c: float = 1.0) -> Column:
        """From a to c with the peak at b."""
        side, v = self.rand() < (b - a) / (c - a), self.rand()
        return F.when(side, a + (b - a) * F.sqrt(v)).otherwise(c - (c - b) * F.sqrt(v))

    def weibull(self, a: float = 1.0, b: float = 1.0) -> Column:
        return b * F.pow(-F.log1p(-self.rand()), F.lit(1 / a))

    def discrete(self, weights: list[float]) -> Column:
        """Index of a weight, drawn in proportion to it."""
        return self._once([self.rand()], _inverse(weights))

    def on_sphere(self, dims: int = 2) -> Column:
        """A point of the unit sphere as an array."""
        point = F.array(*[self.randn() for _ in range(dims)])

        def onto(o: Column) -> Column:
            length = F.sqrt(sum((o[i] * o[i] for i in range(1, dims)), o[0] * o[0]))
            return F.array(*[o[i] / length for i in range(dims)])

        return self._once([point], onto)

    # ---- by rejection and by tables

    def gamma(self, shape: float | Column, scale: float = 1.0) -> Column:
        """By cubes of normals (Marsaglia and Tsang); a shape below 1 by the one above it."""
        a = shape if isinstance(shape, Column) else F.lit(float(shape))
        return self._by_row(lambda g: scale * g._gamma(a))

    def _gamma(self, a: Column) -> Column:
        d = F.when(a < 1, a + 1).otherwise(a) - 1 / 3
        first = self._drawn + 1
        self._drawn += 3 * TRIES

        def attempt(i: Column) -> Column:
            r, turn, u = (self._hashed(F.lit(first + j).cast("long") + 3 * i.cast("long")) for j in range(3))
            x = F.sqrt(-2 * F.log(r)) * F.cos(2 * math.pi * turn)
            v = F.pow(1 + x / F.sqrt(9 * d), F.lit(3.0))
            return F.when((v > 0) & (F.log(u) < 0.5 * x * x + d - d * v + d * F.log(v)), d * v)

        # once a try is accepted the others aren't evaluated; the first are compiled, and nearly all draws end there
        later = F.aggregate(F.sequence(F.lit(COMPILED), F.lit(TRIES - 1)), F.lit(None).cast("double"), lambda found, i: F.coalesce(found, attempt(i)))
        drawn = F.coalesce(*[attempt(F.lit(i)) for i in range(COMPILED)], later, d)
        return F.when(a < 1, drawn * F.pow(self.rand(), 1 / a)).otherwise(drawn)

    def chi_square(self, dof: float | Column) -> Column:
        return self.gamma(dof / 2, 2.0)

    def beta(self, a: float, b: float) -> Column:
        # the ratio of one to both
        return self._once([self.gamma(a), self.gamma(b)], lambda x, y: x / (x + y))

    def f(self, dof1: float, dof2: float) -> Column:
        return (self.chi_square(dof1) / dof1) / (self.chi_square(dof2) / dof2)

    def student_t(self, dof: float) -> Column:
        return self.randn() / F.sqrt(self.chi_square(dof) / dof)

    def non_central_chi_squared(self, k: float = 1.0, lam: float = 1.0) -> Column:
        return self._once([self.poisson(lam / 2)], lambda n: self.chi_square(k + 2 * n))

    def _looked_up(self, mass: Callable[[int], float], middle: float) -> Column:
        return self._once([self.rand()], _inverse(_weights(mass, middle)))

    def poisson(self, mean: float = 1.0) -> Column:
        parts = max(1, math.ceil(mean / TABLE_MEAN))
        m = mean / parts
        mass = lambda k: math.exp(k * math.log(m) - m - math.lgamma(k + 1)) if m else float(k == 0)
        return sum((self._looked_up(mass, m) for _ in range(parts - 1)), self._looked_up(mass, m)).cast("double")

    def binomial(self, n: int, p: float = 0.5) -> Column:
        if p in (0, 1):
            return F.lit(float(n * p))
        parts = max(1, math.ceil(n * p / TABLE_MEAN))
        sizes = [n // parts + (i < n % parts) for i in range(parts)]
        mass = lambda k, m: math.exp(math.lgamma(m + 1) - math.lgamma(k + 1) - math.lgamma(m - k + 1) + k * math.log(p) + (m - k) * math.log1p(-p)) if k <= m else 0.0
        draws = [self._looked_up(lambda k, m=m: mass(k, m), m * p) for m in sizes]
        return sum(draws[1:], draws[0]).cast("double")

    def negative_binomial(self, n: int, p: float = 0.5) -> Column:
        """Failures before the n-th success."""
        if p == 1:
            return F.lit(0.0)
        mean = n * (1 - p) / p
        mass = lambda k: math.exp(math.lgamma(k + n) - math.lgamma(k + 1) - math.lgamma(n) + n * math.log(p) + k * math.log1p(-p))
        return self._looked_up(mass, mean).cast("double")

    # ---- arrays

    def array(self, spark: SparkSession, rows: int, cols: int, value: Column) -> Grid:
        """A grid of draws, such as ``rng.array(spark, 3, 4, rng.normal())``."""
        cells = spark.range(rows * cols).withColumn("value", value)
        return Grid(cells.select(F.floor(F.col("id") / cols).cast("long").alias("row"), (F.col("id") % cols).alias("col"), "value"), rows, cols)

    def choice(self, x: Grid, n: int, replace: bool = True) -> DataFrame:
        """n values of the grid. With replacement positions are drawn and joined, not collected."""
        if replace:
            at = x.df.sparkSession.range(n).select(F.col("id").alias("pos"), F.floor(RNG(self._next(), "id").rand() * x.size).alias("at"))
            return at.join(x.df.select(x.idx.alias("at"), "value"), "at").select("pos", "value")
        if n > x.size:
            raise ValueError("more values are wanted than there are")
        return ranked(x.df.withColumn("_u", F.xxhash64(F.lit(self._next()), x.idx)), "_u", "row", "col", name="pos").filter(F.col("pos") < n).select("pos", "value")

    def permutation(self, x: Grid) -> Grid:
        """The flattened values in random order, the order being that of a hash of their places."""
        rows = ranked(x.df.withColumn("_u", F.xxhash64(F.lit(self._next()), x.idx)), "_u", "row", "col", name="pos")
        return Grid(rows.select(F.floor(F.col("pos") / x.cols).cast("long").alias("row"), (F.col("pos") % x.cols).alias("col"), "value"), x.rows, x.cols)

    shuffle = permutation
