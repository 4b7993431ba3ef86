"""Bytes and bits of BINARY columns as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _at(off: Column | int) -> Column:
    return F.lit(off) if isinstance(off, int) else off


def uint(content: Column, off: Column | int, n: int) -> Column:
    """n bytes big-endian from a 0-based offset; NULL where they do not all exist."""
    off = _at(off)
    return F.when((off >= 0) & (off + n <= F.length(content)), F.conv(F.hex(F.substring(content, (off + 1).cast("int"), F.lit(n))), 16, 10).cast("long"))


def ascii_at(content: Column, off: Column | int, word: str) -> Column:
    off = _at(off)
    return (off >= 0) & (off + len(word) <= F.length(content)) & (F.substring(content, (off + 1).cast("int"), F.lit(len(word))) == F.lit(word).cast("binary"))


def field(value: Column, shift: int, width: int) -> Column:
    return F.shiftright(value, shift).bitwiseAND((1 << width) - 1)


def msb_bits(content: Column, bit: Column | int, n: int) -> Column:
    """n <= 24 bits, most significant first, from a bit offset; 0 past the end, as a latching reader gives."""
    bit = _at(bit)
    first = F.floor(bit / 8).cast("int")
    word = F.lit(0).cast("long")
    for k in range(4):
        word = word * 256 + F.coalesce(uint(content, first + k, 1), F.lit(0))
    return F.when(bit + n <= 8 * F.length(content), F.floor(word / F.pow(F.lit(2.0), F.lit(32 - n) - bit % 8)).cast("long").bitwiseAND((1 << n) - 1)).otherwise(0)
