"""Published dates in the formats the sources use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from recordweave import dims
from recordweave.functions.text import let, strip

_ZONE = r"(Z|[+-]\d{2}:?\d{2})$"
_COMPACT = r"^(\d{8})(?:T?(\d{6})Z?)?$"


def _parse(raw: Column) -> Column:
    iso_day = F.when(raw.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(raw, F.lit("T00:00:00Z")))
    iso_time = F.when(
        raw.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}"),
        F.when(raw.rlike(_ZONE), raw).otherwise(F.concat(raw, F.lit("Z"))),
    )
    mail = F.regexp_replace(raw, r"^[A-Za-z]{3},\s*", "")
    mail = F.regexp_replace(mail, r"\s+(GMT|UTC|UT|Z)$", " +0000")
    mail = F.when(raw.rlike(r"^([A-Za-z]{3},\s*)?\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2} (GMT|UTC|UT|Z|[+-]\d{4})$"), mail)
    stamp = F.regexp_extract(raw, _COMPACT, 1)
    clock = F.rpad(F.regexp_extract(raw, _COMPACT, 2), 6, "0")
    compact = F.when(raw.rlike(_COMPACT), F.concat(stamp, clock, F.lit(" +0000")))
    return F.coalesce(
        F.coalesce(iso_day, iso_time).try_cast("timestamp"),
        F.try_to_timestamp(mail, F.lit("d MMM yyyy HH:mm:ss Z")),
        F.try_to_timestamp(compact, F.lit("yyyyMMddHHmmss Z")),
    )


def parse_published(value: Column) -> Column:
    """ISO, RFC-822 or compact stamp -> timestamp (zone-less values are UTC), else null."""
    return let(strip(value), _parse)


def published_at(source_id: Column, field) -> Column:
    """First parseable date over the source's own keys, then the common ones.

    ``field`` maps a key name to the column that holds it (for instance
    ``lambda k: F.get_json_object("structured_data", "$." + k)``).
    """
    own = [
        F.when(source_id == source, field(key)) for source, keys in dims.PUBLISHED_KEYS.items() for key in keys
    ]
    # one array, so the parser is written once however many keys there are
    given = F.array_compact(F.array(*own, *[field(key) for key in dims.PUBLISHED_FALLBACK_KEYS]))
    return F.get(F.array_compact(F.transform(F.transform(given, strip), _parse)), 0)


def award_too_old(start: Column, as_of: str, days: int = dims.AWARD_MAX_AGE_DAYS) -> Column:
    """True for a start date before the floor; unknown dates are never too old."""
    day = F.left(start, F.lit(10))
    parsed = F.when(day.rlike(r"^\d{4}-\d{2}-\d{2}$"), day).try_cast("date")
    return F.coalesce(parsed < F.date_sub(F.lit(as_of).cast("date"), days), F.lit(False))
