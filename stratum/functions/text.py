"""Numbers and times as text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = ("B", "KB", "MB", "GB", "TB")


def size_text(n: Column, units: Sequence[str] = UNITS) -> Column:
    """Bytes in the largest unit below 1024 of it, or else the last one, with one decimal place beyond bytes; halves go to the even digit. Beyond 2^53 bytes count as the nearest double."""
    m = n.cast("double").cast("long")

    def part(k: int) -> Column:
        # whole numbers only: the shortest text of a double can show a half where its value has none
        bits, low = 10 * k, 1024**k - 1
        rest = m.bitwiseAND(low) * 10
        digit = F.shiftright(rest, bits)
        digit = digit + (rest.bitwiseAND(low) + digit.bitwiseAND(1) > 1024**k // 2).cast("long")
        return F.concat((F.shiftright(m, bits) + (digit == 10).cast("long")).cast("string"), F.lit("."), (digit % 10).cast("string"), F.lit(f" {units[k]}"))

    out = part(len(units) - 1)
    for k in range(len(units) - 2, 0, -1):
        out = F.when(n < 1024 ** (k + 1), part(k)).otherwise(out)
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).otherwise(out)


def local_time(millis: Column, zone: str) -> Column:
    """YYYY-MM-DD HH:MM:SS and the offset of the zone, whatever the session's zone is."""
    utc = F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(secs=millis / 1000)
    wall = F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)
    minutes = F.timestamp_diff("MINUTE", utc, wall).cast("int")
    offset = F.format_string("%02d:%02d", F.floor(F.abs(minutes) / 60).cast("int"), (F.abs(minutes) % 60).cast("int"))
    return F.concat(F.date_format(wall, "yyyy-MM-dd HH:mm:ss"), F.when(minutes < 0, "-").otherwise("+"), offset)
