"""Date expressions; every result is epoch seconds as BIGINT."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skein.functions.text import trim_space

HOUR = 3600
_RFC3339 = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}([.,]\d+)?(Z|[+-]\d{2}:\d{2})$"
_JP = r"^(\d{4})年(\d{1,2})月(\d{1,2})日"


def flexible_date(text: Column, now: Column) -> Column:
    """RFC 3339, then ``YYYY-MM-DD``, then a leading ``YYYY年M月D日``; UTC.

    Dates more than one hour after ``now`` are rejected.  The third form
    normalizes overflow (February 31 becomes early March).
    """
    s = trim_space(text)
    full = F.when(s.rlike(_RFC3339), F.replace(s, F.lit(","), F.lit(".")).try_cast("timestamp"))
    day = F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}$"), s.try_cast("date").cast("timestamp"))

    def part(i: int) -> Column:
        return F.regexp_extract(s, _JP, i).try_cast("int")

    first = F.make_date(part(1), F.lit(1), F.lit(1))
    jp = F.when(
        s.rlike(_JP), F.date_add(F.add_months(first, part(2) - 1), part(3) - 1).cast("timestamp")
    )
    parsed = F.unix_seconds(F.coalesce(full, day, jp))
    return F.when(parsed <= now + HOUR, parsed)


def http_date(text: Column) -> Column:
    """RFC 1123 date, weekday ignored."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(text), "^[A-Za-z]+, *", ""), " *(GMT|UTC|Z)$", "")
    return F.unix_seconds(F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss")))


def retry_after_seconds(value: Column, now: Column) -> Column:
    """Retry-After as seconds from now; 0 when absent, invalid or past."""
    secs = F.when(value.rlike(r"^\+?\d{1,18}$"), value.try_cast("bigint"))
    return F.coalesce(secs, F.greatest(http_date(value) - now, F.lit(0)), F.lit(0))


def published_or_now(published: Column, now: Column) -> Column:
    """A missing or implausibly late published date becomes ``now``."""
    return F.when(published <= now + HOUR, published).otherwise(now)
