"""Element-wise functions over lineitem's numeric columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bits, complexes, datetimes, geometry, logic, numeric, polynomials, special

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Inputs: q 1 to 50, u and s around 0, d small, i j n integers, w equals s or s + d.
_BASE = """
    l_orderkey, l_linenumber, l_quantity AS q, (l_quantity - 25) / CAST(26 AS DOUBLE) AS u, l_extendedprice / 10000 - 3 AS s,
    l_discount AS d, l_partkey AS i, l_suppkey AS j, CAST(l_linenumber AS BIGINT) AS n,
    CASE WHEN l_linenumber % 2 = 0 THEN l_extendedprice / 10000 - 3 ELSE l_extendedprice / 10000 - 3 + l_discount END AS w
"""


def _add(name: str, column: Callable[[], Column], sql: str, kind: str = "double") -> None:
    """Register a function of the base columns; doubles are compared to six decimals."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr(*_split(_BASE))
        value = column()
        value = _N.half_up(value, 6) if kind == "double" else value.cast(kind)
        return rows.select("l_orderkey", "l_linenumber", value.alias("value"))

    QUERIES[name] = run
    out = f"floor(CAST({sql} AS DOUBLE) * 1e6 + 0.5) / 1e6" if kind == "double" else f"CAST({sql} AS {kind})"
    SQL[name] = f"SELECT l_orderkey, l_linenumber, {out} AS value FROM (SELECT {_BASE} FROM lineitem)"


def _split(text: str) -> list[str]:
    """Top-level comma-separated expressions."""
    out, depth, own = [], 0, ""
    for ch in text:
        depth += (ch == "(") - (ch == ")")
        if ch == "," and not depth:
            out.append(own.strip())
            own = ""
        else:
            own += ch
    return [*out, own.strip()]


def _c(*names: str) -> list[Column]:
    return [F.col(n) for n in names]


_N, _L, _B, _P = numeric, logic, bits, polynomials
_DOUBLES = {
    "abs": (lambda: _N.absolute("s"), "abs(s)"),
    "add": (lambda: _N.add("s", "q"), "s + q"),
    "subtract": (lambda: _N.subtract("s", "q"), "s - q"),
    "multiply": (lambda: _N.multiply("s", "q"), "s * q"),
    "divide": (lambda: _N.divide("s", "q"), "s / q"),
    "negative": (lambda: _N.negative("s"), "-s"),
    "reciprocal": (lambda: _N.reciprocal("q"), "1 / q"),
    "arccos": (lambda: _N.arccos("u"), "acos(u)"),
    "arccosh": (lambda: _N.arccosh("q"), "acosh(q)"),
    "arcsin": (lambda: _N.arcsin("u"), "asin(u)"),
    "arcsinh": (lambda: _N.arcsinh("s"), "asinh(s)"),
    "arctan": (lambda: _N.arctan("s"), "atan(s)"),
    "arctan2": (lambda: _N.arctan2("s", "u"), "atan2(s, u)"),
    "arctanh": (lambda: _N.arctanh("u"), "atanh(u)"),
    "around": (lambda: _N.around("s", 1), "round_even(s * 10, 0) / 10"),
    "round": (lambda: _N.round_even("s", 2), "round_even(s * 100, 0) / 100"),
    "rint": (lambda: _N.rint(F.col("q") / 2), "round_even(q / 2, 0)"),
    "cbrt": (lambda: _N.cbrt("s"), "cbrt(s)"),
    "ceil": (lambda: _N.ceil("s"), "ceil(s)"),
    "floor": (lambda: _N.floor("s"), "floor(s)"),
    "trunc": (lambda: _N.trunc("s"), "trunc(s)"),
    "fix": (lambda: _N.fix("s"), "trunc(s)"),
    "clip": (lambda: _N.clip("s", -1.5, 2.0), "least(greatest(s, -1.5), 2.0)"),
    "copySign": (lambda: _N.copysign("q", "s"), "CASE WHEN s < 0 THEN -abs(q) ELSE abs(q) END"),
    "cos": (lambda: _N.cos("s"), "cos(s)"),
    "cosh": (lambda: _N.cosh("u"), "cosh(u)"),
    "sin": (lambda: _N.sin("s"), "sin(s)"),
    "sinh": (lambda: _N.sinh("u"), "sinh(u)"),
    "tan": (lambda: _N.tan("u"), "tan(u)"),
    "tanh": (lambda: _N.tanh("s"), "tanh(s)"),
    "sinc": (lambda: _N.sinc("q"), "sin(q * pi()) / (q * pi())"),
    "unwrap": (lambda: _N.unwrap("q"), "atan2(sin(q), cos(q))"),
    "cube": (lambda: _N.cube("s"), "s * s * s"),
    "square": (lambda: _N.square("s"), "s * s"),
    "sqrt": (lambda: _N.sqrt("q"), "sqrt(q)"),
    "deg2rad": (lambda: _N.deg2rad("q"), "radians(q)"),
    "radians": (lambda: _N.radians("q"), "radians(q)"),
    "degrees": (lambda: _N.degrees("u"), "degrees(u)"),
    "rad2deg": (lambda: _N.rad2deg("u"), "degrees(u)"),
    "exp": (lambda: _N.exp("s"), "exp(s)"),
    "exp2": (lambda: _N.exp2("u"), "pow(2, u)"),
    "expm1": (lambda: _N.expm1("u"), "exp(u) - 1"),
    "fmax": (lambda: _N.fmax("s", "u"), "greatest(s, u)"),
    "fmin": (lambda: _N.fmin("s", "u"), "least(s, u)"),
    "maximum": (lambda: _N.maximum("s", "d"), "greatest(s, d)"),
    "minimum": (lambda: _N.minimum("s", "d"), "least(s, d)"),
    "fmod": (lambda: _N.fmod("s", "q"), "s % q"),
    "remainder": (lambda: _N.remainder("q", F.lit(4.0)), "q - 4 * round_even(q / 4, 0)"),
    "hypot": (lambda: _N.hypot("s", "u"), "sqrt(s * s + u * u)"),
    "hypot3": (lambda: _N.hypot("s", "u", "d"), "sqrt(s * s + u * u + d * d)"),
    "ldexp": (lambda: _N.ldexp("s", "n"), "s * pow(2, n)"),
    "log": (lambda: _N.log("q"), "ln(q)"),
    "log10": (lambda: _N.log10("q"), "log10(q)"),
    "log1p": (lambda: _N.log1p("q"), "ln(1 + q)"),
    "log2": (lambda: _N.log2("q"), "log2(q)"),
    "logaddexp": (lambda: _N.logaddexp("s", "u"), "ln(exp(s) + exp(u))"),
    "logaddexp2": (lambda: _N.logaddexp2("s", "u"), "log2(pow(2, s) + pow(2, u))"),
    "logb": (lambda: _N.logb("q", 3.0), "ln(q) / ln(3)"),
    "nth_root": (lambda: _N.nth_root("q", 3), "pow(q, 1.0 / 3)"),
    "power": (lambda: _N.power("s", 3), "pow(s, 3)"),
    "powerf": (lambda: _N.powerf("q", "u"), "pow(q, u)"),
    "nan_to_num": (lambda: _N.nan_to_num(F.when(F.col("n") == 1, float("nan")).when(F.col("n") == 2, float("inf")).otherwise(F.col("s")), 7.0, 8.0, 9.0), "CASE n WHEN 1 THEN 7 WHEN 2 THEN 8 ELSE s END"),
    "utils_interp": (lambda: _N.interp("s", "q", "d"), "s * (1 - d) + q * d"),
    "gaussian": (lambda: _N.gaussian("s", "u", 2.0), "exp(-(s * s + u * u) / 8) / (8 * pi())"),
    "gaussian1d": (lambda: _N.gaussian1d("s", "u", 2.0), "exp(-(s - u) * (s - u) / 8) / (2 * sqrt(2 * pi()))"),
    "where": (lambda: _L.where(F.col("s") > 0, "s", "q"), "CASE WHEN s > 0 THEN s ELSE q END"),
    "select": (lambda: _L.select([F.col("s") > 2, F.col("s") > 0], ["q", "d"], -1), "CASE WHEN s > 2 THEN q WHEN s > 0 THEN d ELSE -1 END"),
    "applyFunction": (lambda: (lambda v: v * 2 + 1)(F.col("s")), "s * 2 + 1"),
    "applyPoly1d": (lambda: _P.Poly1d((1.0, -2.0, 0.5, 0.25))(F.col("u")), "1 - 2 * u + 0.5 * u * u + 0.25 * u * u * u"),
    "poly1d_deriv_integ": (lambda: _P.Poly1d((1.0, -2.0, 0.5)).deriv()("u") + _P.Poly1d((1.0, -2.0, 0.5)).integ()("u"), "-2 + u + u - u * u + 0.5 / 3 * u * u * u"),
    "poly1d_arithmetic": (lambda: ((_P.Poly1d((1.0, 1.0)) ** 2) * _P.Poly1d((0.0, 1.0)) - _P.Poly1d((2.0,)))("u"), "u * (1 + u) * (1 + u) - 2"),
    "chebyshev_t": (lambda: _P.chebyshev_t(3, "u"), "4 * u * u * u - 3 * u"),
    "chebyshev_u": (lambda: _P.chebyshev_u(3, "u"), "8 * u * u * u - 4 * u"),
    "hermite": (lambda: _P.hermite(3, "u"), "8 * u * u * u - 12 * u"),
    "laguerre": (lambda: _P.laguerre(2, "u"), "(u * u - 4 * u + 2) / 2"),
    "laguerre_assoc": (lambda: _P.laguerre(2, "u", 1), "u * u / 2 - 3 * u + 3"),
    "legendre_p": (lambda: _P.legendre_p(3, "u"), "(5 * u * u * u - 3 * u) / 2"),
    "legendre_p_assoc": (lambda: _P.legendre_p(2, "u", 1), "-3 * u * sqrt(1 - u * u)"),
    "legendre_q": (lambda: _P.legendre_q(1, "u"), "u / 2 * ln((1 + u) / (1 - u)) - 1"),
    "spherical_harmonic_r": (lambda: _P.spherical_harmonic(1, 1, "s", "u")["re"], "-sqrt(3 / (8 * pi())) * abs(sin(s)) * cos(u)"),
    "spherical_harmonic_i": (lambda: _P.spherical_harmonic(2, 0, "s", "u")["re"] + _P.spherical_harmonic(2, 0, "s", "u")["im"], "sqrt(5 / (16 * pi())) * (3 * cos(s) * cos(s) - 1)"),
    "complex_abs_angle": (lambda: complexes.magnitude(complexes.complex_("s", "u")) + complexes.angle(complexes.complex_("s", "u")), "sqrt(s * s + u * u) + atan2(u, s)"),
    "complex_conj": (lambda: complexes.conj(complexes.complex_("s", "u"))["im"], "-u"),
    "complex_real_imag": (lambda: complexes.real(complexes.complex_("s", "u")) - complexes.imag(complexes.complex_("s", "u")), "s - u"),
    "complex_polar": (lambda: complexes.polar("q", "s")["re"] + complexes.polar("q", "s")["im"], "q * cos(s) + q * sin(s)"),
    "complex_proj": (lambda: complexes.proj(complexes.complex_(F.when(F.col("n") == 1, F.lit(1.0)).otherwise(F.col("s")), "u"))["re"], "CASE WHEN n = 1 THEN 1 ELSE s END"),
    "complex_multiply": (lambda: complexes.multiply(complexes.complex_("s", "u"), complexes.complex_("d", "q"))["im"], "s * q + u * d"),
    "complex_divide": (lambda: complexes.quotient(complexes.complex_("s", "u"), complexes.complex_("d", "q"))["re"], "(s * d + u * q) / (d * d + q * q)"),
    "vec2_dot_norm": (lambda: geometry.dot(_c("s", "u"), _c("d", "q")) + geometry.norm(_c("s", "u")), "s * d + u * q + sqrt(s * s + u * u)"),
    "vec2_distance_lerp": (lambda: geometry.distance(_c("s", "u"), _c("d", "q")) + geometry.lerp(_c("s", "u"), _c("d", "q"), 0.25)[1], "sqrt((s - d) * (s - d) + (u - q) * (u - q)) + u + (q - u) * 0.25"),
    "vec3_cross": (lambda: geometry.cross(_c("s", "u", "d"), _c("q", "d", "u"))[2], "s * d - u * q"),
    "vec3_angle": (lambda: geometry.angle(_c("s", "u", "q"), geometry.direction("up")), "acos(u / sqrt(s * s + u * u + q * q))"),
    "vec3_project_clamp": (lambda: geometry.project(_c("s", "u", "q"), _c("q", "d", "u"))[0] + geometry.clamp_magnitude(_c("s", "u", "q"), 2.0)[2], "q * (s * q + u * d + q * u) / (q * q + d * d + u * u) + CASE WHEN sqrt(s * s + u * u + q * q) > 2 THEN 2 * q / sqrt(s * s + u * u + q * q) ELSE q END"),
    "quaternion_rotate_z": (lambda: geometry.rotate(geometry.axis_angle_quaternion(geometry.direction("forward"), "s"), geometry.vector(1.0, 0.0, 0.0))[1], "sin(s)"),
    "quaternion_euler": (lambda: geometry.roll(geometry.euler_quaternion("u", "d", "u")) + 10 * geometry.pitch(geometry.euler_quaternion("u", "d", "u")) + 100 * geometry.yaw(geometry.euler_quaternion("u", "d", "u")), "u + 10 * d + 100 * u"),
    "quaternion_slerp": (lambda: geometry.angle_of_rotation(geometry.slerp(geometry.quaternion(0, 0, 0, 1), geometry.axis_angle_quaternion(geometry.direction("up"), 2.0), "d")), "2 * d"),
    "dcm_euler": (lambda: geometry.dcm_angles(geometry.euler_dcm("u", "d", "u"))["roll"] + geometry.dcm_angles(geometry.euler_dcm("u", "d", "u"))["yaw"], "2 * u"),
    "rodriguesRotation": (lambda: geometry.rodrigues(geometry.direction("forward"), "s", _c("q", "u", "d"))[0], "q * cos(s) - u * sin(s)"),
    "degreeSeperation": (lambda: geometry.degree_separation("q", 0.0, "u", 0.0), "q - u"),
    "radianSeperation": (lambda: geometry.radian_separation(0.0, "q", 0.0, "u"), "radians(q - u)"),
    "ra_parts": (lambda: geometry.ra_degrees(*[geometry.ra_parts("q")[k] for k in ("hours", "minutes", "seconds")]), "q"),
    "dec_parts": (lambda: geometry.dec_degrees(*[geometry.dec_parts("s")[k] for k in ("sign", "degrees", "minutes", "seconds")]), "s"),
    "coordinate_round_trip": (lambda: geometry.from_xyz(geometry.to_xyz("q", "s"))["ra"] + geometry.from_xyz(geometry.to_xyz("q", "s"))["dec"], "q + s"),
    "factorial": (lambda: special.factorial("n"), "CASE n WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 6 WHEN 4 THEN 24 WHEN 5 THEN 120 WHEN 6 THEN 720 ELSE 5040 END"),
    "cnr": (lambda: special.cnr("q", 2), "q * (q - 1) / 2"),
    "pnr": (lambda: special.pnr("q", 2), "q * (q - 1)"),
    "gamma": (lambda: special.column(special.gamma, "n"), "gamma(n)"),
    "log_gamma": (lambda: special.column(special.log_gamma, "q"), "lgamma(q)"),
    "beta": (lambda: special.column(special.beta, "n", F.lit(2.0)), "1.0 / (n * (n + 1))"),
}
_DOUBLES["floor_divide"] = (lambda: _N.floor_divide("s", "q"), "floor(s / q)")
_LONGS = {
    "astype_int8": (lambda: _N.astype("i", 8), "(i + 128) % 256 - 128"),
    "astype_uint16": (lambda: _N.astype(-F.col("i"), 16, signed=False), "(65536 - i % 65536) % 65536"),
    "int_divide": (lambda: _N.int_divide(F.col("i") - 500, "n"), "(CASE WHEN i < 500 THEN -1 ELSE 1 END) * (abs(i - 500) // n)"),
    "gcd": (lambda: _N.gcd("i", "j"), "gcd(i, j)"),
    "lcm": (lambda: _N.lcm("i", "j"), "lcm(i, j)"),
    "mod": (lambda: _N.mod(F.col("i") - 500, "n"), "(i - 500) % n"),
    "sign": (lambda: _N.sign("s"), "sign(s)"),
    "bit_count": (lambda: _B.bit_count("i"), "bit_count(i)"),
    "bitwise_and": (lambda: _B.bitwise_and("i", "j"), "i & j"),
    "bitwise_or": (lambda: _B.bitwise_or("i", "j"), "i | j"),
    "bitwise_xor": (lambda: _B.bitwise_xor("i", "j"), "xor(i, j)"),
    "bitwise_not": (lambda: _B.bitwise_not("i"), "~i"),
    "invert": (lambda: _B.invert("j"), "~j"),
    "left_shift": (lambda: _B.left_shift("i", 3), "i << 3"),
    "right_shift": (lambda: _B.right_shift("i", 3), "i >> 3"),
    "byteswap": (lambda: _B.byteswap("i", 4), "CASE WHEN i % 256 >= 128 THEN -4294967296 ELSE 0 END + (i % 256) * 16777216 + ((i >> 8) % 256) * 65536 + ((i >> 16) % 256) * 256 + (i >> 24)"),
    "newbyteorder": (lambda: _B.newbyteorder("i", "little", "big", 2), "CASE WHEN i % 256 >= 128 THEN -65536 ELSE 0 END + (i % 256) * 256 + (i >> 8) % 256"),
    "packbits": (lambda: _B.pack_bits(F.array(*[F.shiftright("i", k).bitwiseAND(F.lit(1)) for k in range(8)]))[0], "((i & 1) << 7) + ((i & 2) << 5) + ((i & 4) << 3) + ((i & 8) << 1) + ((i & 16) >> 1) + ((i & 32) >> 3) + ((i & 64) >> 5) + ((i & 128) >> 7)"),
    "unpackbits": (lambda: F.aggregate(_B.unpack_bits(F.array(F.col("i") % 256), big=False), F.lit(0), lambda a, b: a + b), "bit_count(i % 256)"),
    "hammingEncode": (lambda: _B.hamming_decode(_B.hamming_encode("i", 26).bitwiseXOR(F.lit(64)), 26)["value"], "i"),
}
_TEXTS = {
    "binaryRepr": (lambda: _B.binary_repr("i"), "lpad(bin(i), 31, '0')"),
    "num2str": (lambda: _N.to_text("i"), "i"),
    "value2str": (lambda: _N.to_text("n"), "n"),
}
_BOOLEANS = {
    "equal": (lambda: _L.equal("s", "w"), "s = w"),
    "not_equal": (lambda: _L.not_equal("s", "w"), "s <> w"),
    "less": (lambda: _L.less("s", "u"), "s < u"),
    "less_equal": (lambda: _L.less_equal("s", "w"), "s <= w"),
    "greater": (lambda: _L.greater("s", "u"), "s > u"),
    "greater_equal": (lambda: _L.greater_equal("s", "w"), "s >= w"),
    "isclose": (lambda: _L.isclose("s", "w", 0.01, 0.02), "abs(s - w) <= 0.02 + 0.01 * abs(w)"),
    "essentiallyEqual": (lambda: _N.essentially_equal("s", "w"), "s = w"),
    "isnan": (lambda: _L.isnan(F.when(F.col("n") == 1, float("nan")).otherwise(F.col("s"))), "n = 1"),
    "isinf": (lambda: _L.isinf(F.when(F.col("n") == 1, float("-inf")).otherwise(F.col("s"))), "n = 1"),
    "isposinf": (lambda: _L.isposinf(F.when(F.col("n") == 1, float("inf")).otherwise(F.col("s"))), "n = 1"),
    "isneginf": (lambda: _L.isneginf(F.when(F.col("n") == 1, float("-inf")).when(F.col("n") == 2, float("inf")).otherwise(F.col("s"))), "n = 1"),
    "logical_and": (lambda: _L.logical_and("d", "s"), "d <> 0 AND s <> 0"),
    "logical_or": (lambda: _L.logical_or("d", F.col("n") - 1), "d <> 0 OR n <> 1"),
    "logical_xor": (lambda: _L.logical_xor("d", F.col("n") - 1), "(d <> 0) <> (n <> 1)"),
    "logical_not": (lambda: _L.logical_not("d"), "d = 0"),
    "signbit": (lambda: _N.signbit("s"), "s < 0"),
    "complex_less": (lambda: complexes.less(complexes.complex_("q", "s"), complexes.complex_("n", "u")), "q < n OR (q = n AND s < u)"),
    "essentiallyEqualComplex": (lambda: complexes.essentially_equal_complex(complexes.complex_("s", "n"), complexes.complex_("w", F.col("n") + F.when(F.col("n") == 3, 1).otherwise(0))), "s = w AND n <> 3"),
    "dcm_isValid": (lambda: geometry.is_rotation(geometry.euler_dcm("s", "u", "q")), "true"),
    "hamming_two_errors": (lambda: _B.hamming_decode(_B.hamming_encode("i", 26).bitwiseXOR(F.lit(5)), 26)["status"] == 2, "true"),
}
for _kind, _specs in (("double", _DOUBLES), ("bigint", _LONGS), ("string", _TEXTS), ("boolean", _BOOLEANS)):
    for _name, (_column, _sql) in _specs.items():
        _add(_name, _column, _sql, _kind)
SQL |= {k: v.replace(" AS string)", " AS VARCHAR)") for k, v in SQL.items()}


def _special(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Special functions where a closed form exists, at x of 0.1 to 5."""
    x, s = F.col("x"), special
    h = F.lit(0.5)
    known = {
        "bessel_jn": s.column(s.bessel_jn, h, x), "bessel_yn": s.column(s.bessel_yn, h, x), "bessel_in": s.column(s.bessel_in, h, x), "bessel_kn": s.column(s.bessel_kn, h, x),
        "bessel_jn_prime": s.column(s.bessel_jn_prime, h, x), "bessel_yn_prime": s.column(s.bessel_yn_prime, h, x), "bessel_in_prime": s.column(s.bessel_in_prime, h, x), "bessel_kn_prime": s.column(s.bessel_kn_prime, h, x),
        "spherical_bessel_jn": s.column(s.spherical_bessel_jn, F.lit(1.0), x), "spherical_bessel_yn": s.column(s.spherical_bessel_yn, F.lit(1.0), x),
        "cyclic_hankel_1": s.hankel(h, x)["im"], "cyclic_hankel_2": s.hankel(h, x, 2)["im"], "spherical_hankel_1": s.hankel(F.lit(1.0), x, 1, True)["im"], "spherical_hankel_2": s.hankel(F.lit(1.0), x, 2, True)["im"],
        "digamma": s.column(s.digamma, x + 1) - s.column(s.digamma, x), "trigamma": s.column(s.trigamma, x) - s.column(s.trigamma, x + 1), "polygamma": s.column(lambda v: s.polygamma(2, v + 1) - s.polygamma(2, v), x),
        "erf_erfc": s.column(s.erf, x) + s.column(s.erfc, x), "erf_inv": s.column(lambda v: s.erf(s.erf_inv(v)), x / 10), "erfc_inv": s.column(lambda v: s.erfc(s.erfc_inv(v)), x / 10),
        "ellint_1": s.column(s.ellint_1, F.lit(0.0), x / 5), "ellint_2": s.column(s.ellint_2, F.lit(1.0), x / 5), "ellint_3": s.column(s.ellint_3, F.lit(0.0), F.lit(0.0), x / 5),
        "comp_ellint": s.column(lambda v: s.comp_ellint_1(v) * (s.comp_ellint_2(np_sqrt(v)) - s.comp_ellint_1(np_sqrt(v))) + s.comp_ellint_2(v) * s.comp_ellint_1(np_sqrt(v)), x / 10), "comp_ellint_3": s.column(s.comp_ellint_3, F.lit(0.0), x / 10),
        "expint": s.column(lambda v: s.expint(v) - s.expint(-v), x), "riemann_zeta": s.column(s.riemann_zeta, F.lit(2.0)), "bernoulli": s.column(s.bernoulli, F.lit(1.0)), "gamma1pm1": s.column(s.gamma1pm1, F.lit(1.0)) + 0 * x,
        "airy_wronskian": s.column(lambda v: s.airy_ai(-v) * s.airy_bi_prime(-v) - s.airy_ai_prime(-v) * s.airy_bi(-v), x), "prime": s.primes(F.col("k")),
    }
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_size").alias("k"), (F.col("p_size") / 10.0).alias("x")).distinct()
    return rows.select("x", *[(F.round(c.cast("double"), 5) + 0.0).alias(n) for n, c in known.items()])


def np_sqrt(v):
    """The complementary modulus."""
    return (1 - v * v) ** 0.5


_SPECIAL_SQL = {
    "bessel_jn": "sqrt(2 / (pi() * x)) * sin(x)", "bessel_yn": "-sqrt(2 / (pi() * x)) * cos(x)", "bessel_in": "sqrt(2 / (pi() * x)) * sinh(x)", "bessel_kn": "sqrt(pi() / (2 * x)) * exp(-x)",
    "bessel_jn_prime": "sqrt(2 / (pi() * x)) * (cos(x) - sin(x) / (2 * x))", "bessel_yn_prime": "sqrt(2 / (pi() * x)) * (sin(x) + cos(x) / (2 * x))", "bessel_in_prime": "sqrt(2 / (pi() * x)) * (cosh(x) - sinh(x) / (2 * x))", "bessel_kn_prime": "-sqrt(pi() / (2 * x)) * exp(-x) * (1 + 1 / (2 * x))",
    "spherical_bessel_jn": "sin(x) / (x * x) - cos(x) / x", "spherical_bessel_yn": "-cos(x) / (x * x) - sin(x) / x",
    "cyclic_hankel_1": "-sqrt(2 / (pi() * x)) * cos(x)", "cyclic_hankel_2": "sqrt(2 / (pi() * x)) * cos(x)", "spherical_hankel_1": "-cos(x) / (x * x) - sin(x) / x", "spherical_hankel_2": "cos(x) / (x * x) + sin(x) / x",
    "digamma": "1 / x", "trigamma": "1 / (x * x)", "polygamma": "2 / (x * x * x)", "erf_erfc": "1", "erf_inv": "x / 10", "erfc_inv": "x / 10",
    "ellint_1": "x / 5", "ellint_2": "sin(x / 5)", "ellint_3": "x / 5", "comp_ellint": "pi() / 2", "comp_ellint_3": "pi() / 2 / sqrt(1 - x / 10)",
    "expint": "2 * (SELECT sum(pow(x, 2 * n + 1) / ((2 * n + 1) * gamma(2 * n + 2))) FROM range(0, 30) r(n))", "riemann_zeta": "pi() * pi() / 6", "bernoulli": "1.0 / 6", "gamma1pm1": "0",
    "airy_wronskian": "1 / pi()",
}
QUERIES["special_functions"] = _special
SQL["special_functions"] = (
    "WITH primes AS (SELECT p, row_number() OVER (ORDER BY p) - 1 AS k FROM (SELECT a AS p FROM range(2, 260) t(a) WHERE NOT EXISTS (SELECT 1 FROM range(2, 17) u(b) WHERE b < a AND a % b = 0)))"
    " SELECT x, " + ", ".join(f"round(CAST({e} AS DOUBLE), 5) + 0.0 AS {n}" for n, e in _SPECIAL_SQL.items()) + ", CAST(p AS DOUBLE) AS prime FROM (SELECT DISTINCT p_size AS k, p_size / 10 AS x FROM part) JOIN primes USING (k)"
)


def _datetime(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("ts")
    p = datetimes.parts(ts)
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    again = datetimes.parse(datetimes.to_iso(ts))
    whole = datetimes.build(p["year"], p["month"], p["day"], p["hour"], p["minute"], p["second"])
    return rows.select(
        "event_id", *[p[k].cast("bigint").alias(k) for k in ("year", "month", "day", "hour", "minute", "second")], datetimes.to_iso(ts).alias("iso"),
        (F.round(datetimes.seconds_between(again, whole), 6)).alias("fraction"), (again == ts).alias("same"),
    )


QUERIES["datetime"] = _datetime
SQL["datetime"] = """
SELECT event_id, year(ts) AS year, month(ts) AS month, day(ts) AS day, hour(ts) AS hour, minute(ts) AS minute, CAST(floor(second(ts)) AS BIGINT) AS second,
       strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS iso, round((epoch_us(ts) % 1000000) / 1e6, 6) AS fraction, true AS same FROM events
"""
