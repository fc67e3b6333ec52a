"""Time as whole numbers."""

from pyspark.sql import functions as F


def micros_of(column):
    """Microseconds since the epoch of a zone-less timestamp, in any session zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {column})")


def window_end(t, period):
    """End of the right-closed window ``(end - period, end]`` that holds ``t``."""
    shifted = t + F.lit(period - 1)
    return shifted - F.pmod(shifted, F.lit(period))
