"""Scalar functions over vectors, as Column expressions (JVM side, double precision)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("l2", "ip", "cos")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_squared(a, b) -> Column:
    """Squared Euclidean distance, without a root."""
    d = F.zip_with(_col(a), _col(b), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.aggregate(d, F.lit(0.0), lambda s, x: s + x)


def negative_product(a, b) -> Column:
    return -dot(a, b)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def normalize(a) -> Column:
    """Unit length; a zero vector stays as it is."""
    n = F.when(norm(a) == 0, F.lit(1.0)).otherwise(norm(a))
    return F.transform(F.arrays_zip(_col(a).alias("x"), F.array_repeat(n, F.size(_col(a))).alias("n")), lambda z: z["x"].cast("double") / z["n"])


def cosine_distance(a, b) -> Column:
    """Negative product of the normalised vectors; 0 where either is zero."""
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(0.0)).otherwise(-dot(a, b) / n)


def distance(metric: str, a, b) -> Column:
    if metric not in METRICS:
        raise ValueError(f"Unsupported metric: {metric}")
    return {"l2": l2_squared, "ip": negative_product, "cos": cosine_distance}[metric](a, b)


def scalar_codes(a, low, high, levels: int) -> Column:
    """floor((x - low) / (high - low) * levels), clamped to 0..levels; 0 where the range is empty. levels: 255 or 15."""
    z = F.arrays_zip(_col(a).alias("x"), _col(low).alias("l"), _col(high).alias("h"))

    def code(v):
        x, l, h = (v[k].cast("double") for k in "xlh")
        t = F.floor((x - l) / (h - l) * levels)
        return F.when(h == l, F.lit(0)).otherwise(F.greatest(F.lit(0), F.least(F.lit(levels), t))).cast("int")

    return F.transform(z, code)


def from_codes(codes, low, high, levels: int) -> Column:
    z = F.arrays_zip(_col(codes).alias("c"), _col(low).alias("l"), _col(high).alias("h"))
    return F.transform(z, lambda v: v["l"].cast("double") + v["c"] / float(levels) * (v["h"].cast("double") - v["l"].cast("double")))


def pack_nibbles(codes) -> Column:
    """Two 4-bit codes a byte, the first in the high half; an odd last one is padded with 0."""
    c = _col(codes)
    return F.transform(F.sequence(F.lit(0), F.greatest(F.size(c) - 1, F.lit(0)), F.lit(2)), lambda i: F.get(c, i) * 16 + F.coalesce(F.get(c, i + 1), F.lit(0)))


def sortable_hex(c) -> Column:
    """Order-preserving 16-digit key of a long: the sign bit is flipped."""
    flipped = _col(c).cast("long").bitwiseXOR(F.lit(-(2**63)))
    return F.lower(F.lpad(F.hex(flipped), 16, "0"))


def from_sortable_hex(c) -> Column:
    """The long of a sortable_hex key."""
    high = F.conv(F.substring(_col(c), 1, 8), 16, 10).cast("long").bitwiseXOR(F.lit(1 << 31))
    low = F.conv(F.substring(_col(c), 9, 8), 16, 10).cast("long")
    return F.shiftleft(high, 32).bitwiseOR(low)


def sortable_double(c) -> Column:
    """Order-preserving 16-digit key of a double: negative ones inverted, others with the sign bit set; -0.0 as 0.0."""
    v = F.when(_col(c) == 0, F.lit(0.0)).otherwise(_col(c).cast("double"))
    raw = _double_bits(v)
    return F.lower(F.lpad(F.hex(F.when(raw < 0, F.bitwise_not(raw)).otherwise(raw.bitwiseXOR(F.lit(-(2**63))))), 16, "0"))


def _double_bits(v: Column) -> Column:
    """IEEE bits of a double, from its exponent and mantissa."""
    size = F.abs(v)
    e = F.greatest(F.floor(F.log2(size)), F.lit(-1022))
    # log2 rounds: one step up or down
    e = F.when(F.pow(F.lit(2.0), e) > size, e - 1).when(F.pow(F.lit(2.0), e + 1) <= size, e + 1).otherwise(e)
    e = F.greatest(e, F.lit(-1022))
    half = F.floor(e / 2)
    scaled = size / F.pow(F.lit(2.0), half) / F.pow(F.lit(2.0), e - half)  # in [1, 2), or below for subnormals
    mantissa = (scaled * F.lit(float(1 << 52))).cast("long")
    bits = F.when(mantissa < (1 << 52), mantissa).otherwise(F.shiftleft((e + 1023).cast("long"), 52) + (mantissa - (1 << 52)))
    bits = F.when(size == 0, F.lit(0)).when(F.isnan(v), F.lit(0x7FF8000000000000)).when(size == float("inf"), F.lit(0x7FF0000000000000)).otherwise(bits)
    return F.when(v < 0, bits.bitwiseOR(F.lit(-(2**63)))).otherwise(bits)


def sortable_key(kind: str, c) -> Column:
    """Typed key: numbers by their sortable digits, booleans as 0 and 1, strings as they are."""
    return {"long": lambda: F.concat(F.lit("i_"), sortable_hex(c)), "double": lambda: F.concat(F.lit("d_"), sortable_double(c)), "boolean": lambda: F.concat(F.lit("b_"), _col(c).cast("int").cast("string")), "string": lambda: F.concat(F.lit("s_"), _col(c))}[kind]()


def same_set(a, b) -> Column:
    """Whether two arrays hold the same members, in any order."""
    return F.array_sort(_col(a)) == F.array_sort(_col(b))


def code_l2(codes, low, high, levels: int, query) -> Column:
    return l2_squared(from_codes(codes, low, high, levels), query)


def code_ip(codes, low, high, levels: int, query) -> Column:
    return negative_product(from_codes(codes, low, high, levels), query)


def nibbles(packed, dim: int) -> Column:
    """4-bit codes of packed bytes."""
    both = F.flatten(F.transform(_col(packed), lambda b: F.array(F.shiftright(b, 4), b.bitwiseAND(F.lit(15)))))
    return F.slice(both, 1, dim)


normalize_vectors = normalize
