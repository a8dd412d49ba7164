"""Bits, byte order and error-correcting codes on integer columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import Value, col


def bitwise_and(a: Value, b: Value) -> Column:
    return col(a).bitwiseAND(col(b))


def bitwise_or(a: Value, b: Value) -> Column:
    return col(a).bitwiseOR(col(b))


def bitwise_xor(a: Value, b: Value) -> Column:
    return col(a).bitwiseXOR(col(b))


def bitwise_not(x: Value) -> Column:
    return F.bitwise_not(col(x))


invert = bitwise_not


def left_shift(x: Value, n: int) -> Column:
    return F.shiftleft(col(x), n)


def right_shift(x: Value, n: int) -> Column:
    return F.shiftright(col(x), n)


def bit_count(x: Value) -> Column:
    return F.bit_count(col(x))


def binary_repr(x: Value, digits: int = 31) -> Column:
    """The low digits of a number in base 2; 31 of them stand for a signed 32-bit number."""
    return F.right(F.lpad(F.bin(col(x).cast("long")), 64, "0"), F.lit(digits))


def byteswap(x: Value, size: int = 4) -> Column:
    """The integer of ``size`` bytes with its bytes in reverse order, as a signed number."""
    x = col(x).cast("long")
    out = F.lit(0).cast("long")
    for i in range(size):
        byte = F.shiftright(x, 8 * i).bitwiseAND(F.lit(255))
        out = out.bitwiseOR(F.shiftleft(byte, 8 * (size - 1 - i)))
    if size == 8:
        return out
    top = 1 << (8 * size)
    return F.when(out >= top // 2, out - top).otherwise(out)


def newbyteorder(x: Value, stored: str, wanted: str, size: int = 4) -> Column:
    """The value as stored in the wanted byte order, "little" or "big"."""
    return col(x) if stored == wanted else byteswap(x, size)


def endianess() -> str:
    """The byte order in which this engine holds values."""
    return "little"


def pack_bits(bits: Column, big: bool = True) -> Column:
    """Bytes from an array of 0s and 1s, eight to a byte; the last byte is filled with 0s."""
    n = F.ceil(F.size(bits) / 8).cast("int")
    bit = lambda b, k: (F.coalesce(F.get(bits, b * 8 + k), F.lit(0)) != 0).cast("int")
    byte = lambda b: sum((F.shiftleft(bit(b, k), 7 - k if big else k) for k in range(1, 8)), F.shiftleft(bit(b, 0), 7 if big else 0))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), byte)).otherwise(F.array().cast("array<int>"))


def unpack_bits(values: Column, big: bool = True) -> Column:
    """Eight 0s and 1s for each byte of an array."""
    order = range(7, -1, -1) if big else range(8)
    return F.flatten(F.transform(values, lambda v: F.array(*[F.shiftright(v.cast("int"), k).bitwiseAND(F.lit(1)) for k in order])))


def parity_bits(data_bits: int) -> int:
    """Check bits, the overall parity included, of an extended Hamming code."""
    n = 1
    while (1 << n) < data_bits + n + 1:
        n += 1
    return n + 1


def _layout(data_bits: int) -> tuple[list[int], int]:
    """Positions of the data bits, counted from 1, and the length without overall parity."""
    length = data_bits + parity_bits(data_bits) - 1
    return [p for p in range(1, length + 1) if p & (p - 1)], length


def _bound(value: Column, f) -> Column:
    """f(value) with the value worked out once, however often f uses it."""
    return F.transform(F.array(value), f)[0]


def _parity(x: Column, mask: int) -> Column:
    return (F.bit_count(x.bitwiseAND(F.lit(mask).cast("long"))) % 2).cast("long")


def hamming_encode(x: Value, data_bits: int) -> Column:
    """Extended Hamming (single error correcting, double detecting) code word of the low data bits.

    Bit p - 1 of the word is position p; the overall parity is the topmost bit. Every bit of the
    word is the parity of the data under a mask.
    """
    places, length = _layout(data_bits)
    masks = {p: 1 << i for i, p in enumerate(places)}
    p = 1
    while p <= length:
        masks[p] = sum(1 << i for i, q in enumerate(places) if q & p)
        p <<= 1
    whole = 0
    for mask in masks.values():
        whole ^= mask
    masks[length + 1] = whole

    def word(v: Column) -> Column:
        out = F.lit(0).cast("long")
        for q, mask in masks.items():
            out = out.bitwiseOR(F.shiftleft(_parity(v, mask), q - 1))
        return out

    return _bound(col(x).cast("long"), word)


def hamming_decode(word: Value, data_bits: int) -> Column:
    """``STRUCT<status, value>``: 0 as sent, 1 one error corrected, 2 two errors (value null)."""
    places, length = _layout(data_bits)

    def data(w: Column) -> Column:
        out = F.lit(0).cast("long")
        for i, q in enumerate(places):
            out = out.bitwiseOR(F.shiftleft(F.shiftright(w, q - 1).bitwiseAND(F.lit(1).cast("long")), i))
        return out

    def checked(w: Column) -> Column:
        syndrome, p = F.lit(0).cast("long"), 1
        while p <= length:
            syndrome = syndrome + _parity(w, sum(1 << (k - 1) for k in range(1, length + 1) if k & p)) * p
            p <<= 1
        return F.struct(w.alias("w"), syndrome.alias("s"), (F.bit_count(w) % 2 == 1).alias("odd"))

    def corrected(c: Column) -> Column:
        flip = F.when(c["odd"] & (c["s"] > 0) & (c["s"] <= length), c["s"] - 1).otherwise(F.lit(length).cast("long"))
        fixed = F.when(c["odd"], c["w"].bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), flip.cast("int")))).otherwise(c["w"])
        status = F.when(c["odd"], F.lit(1)).when(c["s"] != 0, F.lit(2)).otherwise(F.lit(0))
        return F.struct(status.alias("status"), fixed.alias("fixed"))

    def result(r: Column) -> Column:
        return F.struct(r["status"].alias("status"), F.when(r["status"] != 2, data(r["fixed"])).alias("value"))

    return _bound(_bound(_bound(col(word).cast("long"), checked), corrected), result)
