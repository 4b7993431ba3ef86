"""Array expressions of the block transforms. Everything here is row-local: no shuffle, no Python on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def matrix(rows: list[list[float]]) -> Column:
    return F.array(*[F.array(*[F.lit(float(v)) for v in r]) for r in rows])


def vector(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def dot(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: a * b))


def matvec(kernel: list[list[float]], x: Column) -> Column:
    """One output for every kernel row."""
    return F.transform(matrix(kernel), lambda row: dot(row, x))


def energy(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v)


def butterflies(x: Column, cs: list[float], ca: list[float], width: int, encode: bool) -> Column:
    """The eight rotations at every boundary of `width` lines.

    At a boundary with d = width * sb - 1 - i below and u = width * sb + i above. Decoding: u' = u cs - d ca, d' = d cs + u ca;
    encoding rotates the other way. A line outside the reach of any boundary stays.
    """
    sign = -1.0 if encode else 1.0
    c, a = vector(cs), vector([sign * v for v in ca])
    reach, n = len(cs), F.size(x)

    def line(v: Column, i: Column) -> Column:
        at = i % width
        up, down = (i >= width) & (at < reach), (i < n - width) & (at >= width - reach)
        k = F.when(up, at).otherwise(width - 1 - at)
        other = F.get(x, F.when(up, i - 2 * at - 1).otherwise(i + 2 * (width - 1 - at) + 1))
        return F.when(up, v * F.get(c, k) - other * F.get(a, k)).when(down, v * F.get(c, k) + other * F.get(a, k)).otherwise(v)

    return F.transform(x, line)


def flip_odd(x: Column, width: int) -> Column:
    """Frequency inversion: odd samples of odd subbands change sign."""
    return F.transform(x, lambda v, i: F.when((F.floor(i / width) % 2 == 1) & ((i % width) % 2 == 1), -v).otherwise(v))


def reorder_short(x: Column, widths: list[int]) -> Column:
    """Window-major short bands to lines interleaved by three."""
    source, at = [], 0
    for w in widths:
        source += [at + win * w + i for i in range(w) for win in range(3)]
        at += 3 * w
    return F.transform(vector(source), lambda i: F.get(x, i))


def to_s16(v: Column) -> Column:
    """Half away from zero, then clamped."""
    return F.greatest(F.lit(-32768), F.least(F.lit(32767), F.round(v * F.lit(32768.0)).cast("long"))).cast("long")


def clamp(v: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), v))


def quarter_power(q: Column) -> Column:
    """2^(q / 4), the integer part exact."""
    return F.get(vector([1.0, 2**0.25, 2**0.5, 2**0.75]), q.bitwiseAND(3)) * F.pow(F.lit(2.0), F.shiftright(q, 2))


def quantise(v: Column, q: Column | int, rounding: float = 0.4054, most: int = 8206) -> Column:
    """sign * floor((|v| 2^(q/4))^(3/4) + rounding), clamped."""
    t = F.abs(v) * quarter_power(F.lit(q) if isinstance(q, int) else q)
    return (F.signum(v) * F.least(F.floor(F.sqrt(t * F.sqrt(t)) + rounding), F.lit(most))).cast("long")


def dequantise(i: Column, q: Column | int) -> Column:
    """|i|^(4/3) 2^(q/4)"""
    return F.pow(F.abs(i).cast("double"), F.lit(4.0 / 3.0)) * quarter_power(F.lit(q) if isinstance(q, int) else q)


def spectrum_partition(x: Column) -> tuple[Column, Column]:
    """(big_values pairs, count1 quads): trailing zero pairs go, then trailing quads of magnitudes up to 1."""
    last = F.aggregate(F.transform(x, lambda v, i: F.when(v != 0, i + 1).otherwise(0)), F.lit(0), lambda a, v: F.greatest(a, v))
    used = (F.floor((last + 1) / 2) * 2).cast("int")
    big = F.aggregate(F.transform(x, lambda v, i: F.when(F.abs(v) > 1, i + 1).otherwise(0)), F.lit(0), lambda a, v: F.greatest(a, v))
    quads = F.floor((used - big) / 4).cast("int")
    return ((used - 4 * quads) / 2).cast("long"), quads.cast("long")
