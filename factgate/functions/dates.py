"""Column builders for calendar values; independent of the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# English month names.
MONTHS = (
    "january", "february", "march", "april", "may", "june",
    "july", "august", "september", "october", "november", "december",
)
#: Full names before three-letter ones, so that the longer matches.
MONTH_RE = "(?:" + "|".join([*MONTHS, *(m[:3] for m in MONTHS)]) + ")"
DAY_US = 86_400_000_000


def month_number(name: Column) -> Column:
    """1 to 12 of an English month name matched by MONTH_RE, in any case."""
    packed = "".join(m[:3] for m in MONTHS)
    return ((F.instr(F.lit(packed), F.lower(F.substring(name, 1, 3))) + 2) / 3).cast("int")


def existing_date(y: Column, m: Column, d: Column) -> Column:
    """The date, or null when there is no such day. Year 0 does not exist."""
    text = F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), m.cast("string"), d.cast("string"))
    ok = y.isNotNull() & m.isNotNull() & d.isNotNull() & (y.cast("int") > 0)
    return F.when(ok, text.try_cast("date"))


def micros_text(us: Column) -> Column:
    """Microseconds since 1970 UTC as yyyy-MM-ddTHH:mm:ss.ffffffZ."""
    tod = F.pmod(us, F.lit(DAY_US))
    day = F.date_from_unix_date(((us - tod) / F.lit(DAY_US)).cast("int"))
    sec = (tod / F.lit(1_000_000)).cast("bigint")

    def two(c: Column) -> Column:
        return F.lpad(c.cast("bigint").cast("string"), 2, "0")

    return F.concat(
        day.cast("string"), F.lit("T"), two(F.floor(sec / 3600)), F.lit(":"), two(F.floor(sec / 60) % 60), F.lit(":"),
        two(sec % 60), F.lit("."), F.lpad((tod % 1_000_000).cast("string"), 6, "0"), F.lit("Z"),
    )
