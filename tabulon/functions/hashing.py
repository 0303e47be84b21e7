"""Deterministic draws, splits and 64-bit hashes, from digests alone.

Nothing here depends on the order or partitioning of rows, so any two runs (or engines) agree.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest_number(text: Column, first: int = 1, digits: int = 8) -> Column:
    """Some hex digits of the SHA-1 of a string, as a number."""
    return F.conv(F.substring(F.sha1(text.cast("binary")), first, digits), 16, 10).cast("long")


def keyed_uniform(seed: int, operator: str, *keys: Column) -> Column:
    """A uniform draw in [0, 1] that belongs to (seed, operator, keys)."""
    text = F.concat_ws("|", F.lit(str(seed)), F.lit(operator), *[k.cast("string") for k in keys])
    return digest_number(text) / F.lit(4294967295.0)


def content_id(data: Column) -> Column:
    return F.concat(F.lit("sha1:"), F.substring(F.sha1(data.cast("binary")), 1, 16))


def group_key(image_id: Column) -> Column:
    """Derived copies (``id#suffix``) share the key of their source, and so its split."""
    return F.split_part(image_id, F.lit("#"), F.lit(1))


def calibration_split(image_id: Column, share: float = 0.2) -> Column:
    return F.when(digest_number(image_id) / F.lit(4294967295.0) < share, "calib").otherwise("report")


def in_calibration(image_id: Column) -> Column:
    """One group in twenty is kept for calibration."""
    return digest_number(F.concat(F.lit("calib:"), group_key(image_id))) % 20 == 0


def in_development(image_id: Column, share: float = 0.02) -> Column:
    return digest_number(F.concat(F.lit("dev:"), image_id)) / F.lit(4294967295.0) < share


def digest_mod10(text: Column) -> Column:
    """The whole 160-bit SHA-1 modulo 10: every power of 16 but the first leaves 6."""
    digits = F.transform(F.split(F.sha1(text.cast("binary")), ""), lambda c: F.conv(c, 16, 10).cast("long"))
    digits = F.slice(digits, 1, 40)
    ahead = F.aggregate(F.slice(digits, 1, 39), F.lit(0).cast("long"), lambda a, x: a + x)
    return (F.lit(6) * ahead + F.element_at(digits, 40)) % 10


def adjacent_bits(values: Column, n: int = 64) -> Column:
    """64 bits: is each value greater than the next (around the end)?  First comparison in the highest bit."""
    bits = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when(F.get(values, i) > F.get(values, (i + 1) % n), F.expr("1L")).otherwise(F.expr("0L")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: F.shiftleft(a, 1).bitwiseOR(b))


def unsigned_text_to_bits(text: Column) -> Column:
    """The decimal text of an unsigned 64-bit number, as the BIGINT of the same bits."""
    d = text.cast("decimal(20,0)")
    return F.when(d >= F.lit("9223372036854775808").cast("decimal(20,0)"), d - F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(d).cast("long")


#: Bands of a 64-bit hash, and bits of each.
BANDS, BAND_BITS = 4, 16


def _masks(most: int) -> list[int]:
    """All band values with at most so many bits."""
    return [sum(1 << i for i in at) for k in range(most + 1) for at in combinations(range(BAND_BITS), k)]


def bands(bits: Column) -> Column:
    """(band, value) of each of the four bands of a hash."""
    return F.array(*[F.struct(F.lit(i).alias("band"), F.shiftrightunsigned(bits, i * BAND_BITS).bitwiseAND(F.lit((1 << BAND_BITS) - 1)).cast("int").alias("value")) for i in range(BANDS)])


def _flipped(bits: Column, band: int, most: int) -> Column:
    value = F.shiftrightunsigned(bits, band * BAND_BITS).bitwiseAND(F.lit((1 << BAND_BITS) - 1)).cast("int")
    return F.transform(F.lit(_masks(most)), lambda m: F.struct(F.lit(band).alias("band"), value.bitwiseXOR(m.cast("int")).alias("value")))


def probes(bits: Column, distance: int) -> Column:
    """(band, value) pairs of which any hash within the distance has one.

    Two hashes that differ in ``distance`` bits can't differ in more than t(i) bits in every band i when the sum of all t(i) + 1 exceeds
    the distance; so each band is probed with all values within its t(i), which grow evenly from -1 (not probed).
    """
    return F.concat(*[_flipped(bits, i, own) for i, own in enumerate(_most(distance)) if own >= 0])


def _most(distance: int) -> list[int]:
    return [(distance + BANDS - i) // BANDS - 1 for i in range(BANDS)]


def probe_share(distance: int) -> float:
    """How many other hashes a hash's probes meet by chance, as a share of all."""
    return sum(len(_masks(own)) for own in _most(distance)) / (1 << BAND_BITS)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))
