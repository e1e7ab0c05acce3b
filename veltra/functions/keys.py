"""Functions on binary keys: separators and successors for index entries, prefixes, abbreviations and checksums."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1 by unsigned bytes."""
    return F.when(a < b, -1).when(a > b, 1).when(a == b, 0)


def _byte(key: Column, at: Column) -> Column:
    return F.conv(F.hex(F.substring(key, at, F.lit(1))), 16, 10).cast("int")


def _first(key_from: Column, key_to: Column, test) -> Column:
    """The first place from one to another for which test holds; null if there is none."""
    places = F.when(key_from <= key_to, F.sequence(key_from, key_to))
    return F.array_min(F.filter(places, test))


def _raised(key: Column, at: Column) -> Column:
    """The key up to a place, whose byte grows by one."""
    return F.concat(F.substring(key, F.lit(1), at - 1), F.unhex(F.lpad(F.hex(_byte(key, at) + 1), 2, "0")))


def separator(a: Column, b: Column) -> Column:
    """A short x with a <= x < b for a < b; a itself where there is none shorter or a isn't below b."""
    size_a, size_b = F.octet_length(a), F.octet_length(b)
    n = _first(F.lit(1), F.least(size_a, size_b), lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1)))
    longer = _first(n + 1, size_a, lambda i: _byte(a, i) < 255)  # where a's byte + 1 is b's end, a longer prefix of a is raised
    short = F.when(n.isNull() | (_byte(a, n) >= _byte(b, n)), a).when((n < size_b) | (_byte(a, n) + 1 < _byte(b, n)), _raised(a, n)).otherwise(F.coalesce(_raised(a, longer), a))
    return F.when(a.isNotNull() & b.isNotNull(), short)


def successor(a: Column) -> Column:
    """A short x with x >= a."""
    return F.coalesce(_raised(a, _first(F.lit(1), F.octet_length(a), lambda i: _byte(a, i) < 255)), a)


def split(key: Column, suffix: int = 0) -> tuple[Column, Column]:
    """Prefix and suffix of a key whose version takes the last ``suffix`` bytes; by default the key is all prefix."""
    size = F.octet_length(key)
    at = F.greatest(size - suffix, F.lit(0))
    return F.substring(key, F.lit(1), at), F.substring(key, at + 1, size - at)


def abbreviated(key: Column) -> Column:
    """The first 8 bytes, filled up with zeros."""
    return F.rpad(F.substring(key, 1, 8), 8, F.lit(b"\0"))


def checksum(block: Column, aux: Column) -> Column:
    """CRC-32 (IEEE) of a block and its auxiliary byte."""
    return F.crc32(F.concat(block, aux))


def bloom_hash(key: Column) -> Column:
    """64 bits of a key for filters and caches."""
    return F.xxhash64(key)
