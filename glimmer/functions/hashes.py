"""Ids and perceptual hashes."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def photo_id(relative_path: Column, size: Column, mtime: Column) -> Column:
    """16 hex digits that change when a file does; computed in the JVM."""
    return F.lower(F.lpad(F.hex(F.xxhash64(F.concat(relative_path, size.cast("string"), mtime.cast("string")))), 16, "0"))


def photo_id_portable(relative_path: Column, size: Column, mtime: Column) -> Column:
    """XXH64 with seed 0 over path, size and mtime as Python prints them: byte for byte what other tools compute."""

    def digest(path: str, size: int, mtime: float) -> str:
        import xxhash

        return xxhash.xxh64_hexdigest(f"{path}{size}{mtime}")

    return F.udf(digest, "string", useArrow=True)(relative_path, size.cast("long"), mtime.cast("double"))


def point_id(hex_id: Column) -> Column:
    """The first 16 hex digits as an unsigned integer."""
    return F.conv(F.substring(hex_id, 1, 16), 16, 10).cast("decimal(20,0)")


def chunks(digest: Column, digits: int) -> list[Column]:
    """A hex string of `digits` digits as integers, fifteen digits each."""
    return [F.conv(F.substring(digest, i, min(15, digits - i + 1)), 16, 10).cast("long") for i in range(1, digits + 1, 15)]


def hamming(a: Column, b: Column, digits: int = 64) -> Column:
    """Differing bits of two hex strings of `digits` digits, fifteen digits at a time; null unless both have that length."""
    total = reduce(lambda x, y: x + y, [F.bit_count(p.bitwiseXOR(q)) for p, q in zip(chunks(a, digits), chunks(b, digits), strict=True)])
    return F.when((F.length(a) == digits) & (F.length(b) == digits), total)


def _bound(value: Column, fn: Callable[[Column], Column]) -> Column:
    """fn(value), with value computed once however often fn uses it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def median_bits(values: Column) -> Column:
    """A string of 0 and 1: which values exceed the array's median."""

    def over(ordered: Column) -> Column:
        n = F.size(ordered)
        middle = (F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.floor(n / 2).cast("int"))) / 2
        return F.array_join(F.transform(values, lambda x: F.when(x > middle, F.lit("1")).otherwise(F.lit("0"))), "")

    return _bound(F.sort_array(values), over)


def bits_to_hex(bits: Column, size: int) -> Column:
    """A bit string of fixed size (a multiple of 4) as hex digits."""

    def digits(b: Column) -> Column:
        parts = [F.lpad(F.lower(F.conv(F.substring(b, i, 32), 2, 16)), min(32, size - i + 1) // 4, "0") for i in range(1, size + 1, 32)]
        return F.concat(*parts)

    return _bound(bits, digits)
