"""Numbers, flags, times and lists from loosely typed values: Column to Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

TRUE_WORDS = ["true", "1", "yes", "y"]
_ISO = r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,9})?)?(?:Z|[+-]\d{2}:?\d{2})?)?$"


def number(c: Column) -> Column:
    """A finite double, or null; NaN and text that is no number are null."""
    text = c.cast("string")
    value = F.coalesce(text.try_cast("double"), strip(text).try_cast("double"))  # all blanks are trimmed only where the cast's own don't do
    return F.when(~F.isnan(value), value)


def whole(c: Column) -> Column:
    """A whole number, or null; hexadecimal text is null."""
    return F.when(strip(c).rlike(r"^[+-]?\d+$"), strip(c).try_cast("bigint"))


def flag(c: Column) -> Column:
    """true, 1, yes, y in any case, or a number other than 0; all else, null included, is false."""
    text = F.lower(strip(c))
    value = text.try_cast("double")
    return F.coalesce(text.isin(TRUE_WORDS) | ((value != 0) & ~F.isnan(value)), F.lit(False))


def as_list(c: Column) -> Column:
    """Array of text from a JSON array, comma-separated or single text; null stays null, blank text gives an empty array."""
    text = strip(c)
    parsed = F.when(text.startswith("[") & text.endswith("]"), F.from_json(text, "array<string>"))
    parts = F.filter(F.transform(F.split(text, ","), lambda x: F.regexp_replace(strip(x), "^[\"']+|[\"']+$", "")), lambda x: x != "")
    listed = F.when(text.contains(",") & (F.size(parts) > 0), parts)
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.coalesce(parsed, listed, F.when(text.isNotNull(), F.array(text))))


def iso_ts(c: Column) -> Column:
    """ISO date or time text to a time in UTC; text without a zone is UTC; other text is null."""
    text = strip(c)
    return F.when(text.rlike(_ISO), text.try_cast("timestamp"))


def _scaled(value: Column) -> Column:
    """Epoch seconds of seconds, milli-, micro- or nanoseconds, told apart by size."""
    return (
        F.when(value > 10**17, F.floor(value / 10**9)).when(value > 10**14, F.floor(value / 10**6)).when(value > 10**11, F.floor(value / 10**3)).otherwise(value).cast("bigint")
    )


def epoch_ts(*candidates: Column) -> Column:
    """Time of the first candidate that isn't null or blank: epoch digits of any unit, or ISO text. Whole seconds."""
    first = candidates[0].cast("string")
    plain = F.when(~first.startswith("+"), _scaled(first.try_cast("bigint")))  # most are digits alone, with nothing to trim
    text = F.coalesce(*[F.nullif(strip(c), F.lit("")) for c in candidates])
    seconds = F.when(text.rlike(r"^-?\d+(?:\.\d+)?$"), _scaled(F.coalesce(text.try_cast("bigint"), F.floor(text.try_cast("double")))))
    return F.timestamp_seconds(F.coalesce(plain, seconds, F.floor(F.unix_micros(iso_ts(text)) / 1_000_000)))


def compact_ts(c: Column) -> Column:
    """yyyyMMddHHmmss text in UTC."""
    return F.when(strip(c).rlike(r"^\d{14}$"), F.try_to_timestamp(strip(c), F.lit("yyyyMMddHHmmss")))


def seen_ts(c: Column) -> Column:
    """yyyyMMddHHmmss, else ISO text."""
    return F.coalesce(compact_ts(c), iso_ts(c))


def article_ts(*candidates: Column) -> Column:
    """The first candidate that parses: yyyyMMddHHmmss, epoch seconds or milliseconds, or ISO text."""

    def one(c: Column) -> Column:
        text = strip(c)
        value = F.when(text.rlike(r"^\d+$") & (F.length(text) != 14), text.try_cast("bigint"))
        return F.coalesce(compact_ts(c), F.timestamp_seconds(F.when(value > 10**12, F.floor(value / 1000)).otherwise(value)), iso_ts(c))

    return F.coalesce(*map(one, candidates))


def compact_text(c: Column) -> Column:
    """A time as yyyyMMddHHmmss in UTC."""
    return F.date_format(c, "yyyyMMddHHmmss")


SPAN_SECONDS = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}


def span_seconds(c: Column) -> Column:
    """Seconds of texts such as 15m, 3h, 7d; null for 0 and other texts."""
    text = F.lower(strip(c))
    n = F.regexp_extract(text, r"^(\d+)[smhdw]$", 1).try_cast("bigint")
    unit = F.regexp_extract(text, r"^\d+([smhdw])$", 1)
    factor = F.coalesce(*[F.when(unit == u, k) for u, k in SPAN_SECONDS.items()])
    return F.nullif(n * factor, F.lit(0))


def parse_span(text: str | None) -> int | None:
    """Seconds of a duration such as 15min, 3h or 7d given to a plan; None for None, 0 and other texts."""
    import re

    m = re.fullmatch(r"\s*(\d+)\s*(s|sec|m|min|h|d|w)\s*", text or "", re.IGNORECASE)
    return int(m[1]) * SPAN_SECONDS[m[2][0].lower()] or None if m else None


def time_bounds(start: str | None, end: str | None, span: str | None, now: str) -> tuple[str, str | None]:
    """A closed window of ISO times. An open end is now; with a span and no start, the window is that long. ValueError if it ends before it starts."""
    from datetime import datetime, timedelta

    last = datetime.fromisoformat(end or now)
    seconds = parse_span(span)
    first = datetime.fromisoformat(start) if start else (last - timedelta(seconds=seconds) if seconds else None)
    if first and first > last:
        raise ValueError("the window ends before it starts")
    return last.isoformat(), first.isoformat() if first else None
