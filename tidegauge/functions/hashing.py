"""Identities and draws derived from SHA-256."""

from pyspark.sql import functions as F


def canonical_json(columns):
    """JSON of the named columns in sorted key order."""
    return F.to_json(F.struct(*sorted(columns)))


def identity(columns):
    return F.sha2(canonical_json(columns), 256)


def derived_integer(seed, key):
    """First 16 hex digits of SHA-256 of ``seed:key`` as a whole number."""
    digest = F.sha2(F.concat_ws(":", F.lit(str(seed)), key.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)")


def bounded_draw(seed, key, low, high):
    """Whole number in ``[low, high]`` derived from seed and key."""
    span = F.lit(high - low + 1).cast("decimal(20,0)")
    return (derived_integer(seed, key) % span).cast("bigint") + low


def unit_draw(seed, *keys):
    """Uniform double in [0, 1) from a 53-bit row hash; the same on a rerun."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11)
    return bits.cast("double") / F.lit(float(1 << 53))
