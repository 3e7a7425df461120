"""Lenient parsers for vendor text (C1-C3, C7, C9, C10, C13, C15-C19). Bad input gives null, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .measures import round_to

# What vendors write for yes and no.
YES_WORDS = ("y", "yes", "true", "t", "1")
NO_WORDS = ("n", "no", "false", "f", "0")
_MONTH_FIRST = r"^(\d{1,2})/(\d{1,2})/(\d{4})"
_TWELVE_HOUR = "yyyy-M-d h:mm[:ss] a"
_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
_FIRST_NUMBER = r"-?\d[\d,]*(?:\.\d+)?"
_CLOCK = r"^(?:(\d+) days?,? +)?(\d+):(\d{1,2}):(\d{1,2}(?:\.\d+)?)$"
_ZONE = r"(?:Z|UTC|[+-]\d{2}:?\d{2})$"
# The station-level code and the note its rows carry.
STATION_CODE = "C03"
STATION_NOTE = "[Station-level C03]"


def blank_to_null(x: Column) -> Column:
    return F.nullif(F.trim(x), F.lit(""))


def number(x: Column) -> Column:
    """C1."""
    text = F.trim(x)
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def datetime(x: Column) -> Column:
    """Year first or month first, 24-hour or AM/PM clock, date alone allowed."""
    text = F.regexp_replace(F.trim(x), _MONTH_FIRST, r"$3-$1-$2")
    return F.coalesce(
        text.try_cast("timestamp_ntz"), F.try_to_timestamp(text, F.lit(_TWELVE_HOUR)).cast("timestamp_ntz")
    )


def day(x: Column) -> Column:
    """C2 for dates."""
    return F.to_date(datetime(x))


def datetime_of_parts(date_text: Column, time_text: Column) -> Column:
    """C3."""
    return datetime(F.concat_ws(" ", F.trim(date_text), F.trim(time_text)))


def utc_datetime(x: Column) -> Column:
    """A zone suffix is applied, text without one already is UTC."""
    text = blank_to_null(x)
    zoned = F.convert_timezone(F.current_timezone(), F.lit("UTC"), text.try_cast("timestamp").cast("timestamp_ntz"))
    return F.when(text.rlike(_ZONE), zoned).otherwise(datetime(text))


def duration_minutes(x: Column) -> Column:
    """``hh:mm:ss`` (hours may exceed 23, days may lead) or a workbook's fraction of a day."""
    text = F.trim(x)

    def part(i: int) -> Column:
        return F.nullif(F.regexp_extract(text, _CLOCK, i), F.lit("")).try_cast("double")

    clock = F.coalesce(part(1), F.lit(0.0)) * 1440 + part(2) * 60 + part(3) + part(4) / 60
    return F.coalesce(clock, number(x) * 1440)


def duration_hours(x: Column) -> Column:
    """C10."""
    return duration_minutes(x) / 60


def _as_share(x: Column, above: float) -> Column:
    return F.when(x > above, x / 100).otherwise(x)


def soc_share(x: Column) -> Column:
    """0-1 or 0-100, four places."""
    return round_to(_as_share(x, 1.0), 4)


def soc_from_percent(x: Column) -> Column:
    """Always 0-100."""
    return round_to(x / 100, 4)


def soc_share_exact(x: Column) -> Column:
    """0-1 or 0-100, unrounded."""
    return _as_share(x, 1.0)


def soc_share_clamped(x: Column) -> Column:
    """C13d: 0-1 or 0-100 with tolerance, clamped to [0, 1]."""
    share = _as_share(x, 1.000001)
    return F.when(x.isNotNull(), round_to(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)), 4))


def soc_from_percent_text(x: Column) -> Column:
    """C13e: "85%" or "85"."""
    return number(F.replace(x, F.lit("%"), F.lit(""))) / 100


def boolean(x: Column) -> Column:
    """C15."""
    word = F.lower(F.trim(x))
    return F.when(word.isin(*YES_WORDS), F.lit(True)).when(word.isin(*NO_WORDS), F.lit(False))


def first_number(x: Column) -> Column:
    """The first number in free text, thousands separators removed."""
    found = F.nullif(F.regexp_extract(x, _FIRST_NUMBER, 0), F.lit(""))
    return F.replace(found, F.lit(","), F.lit("")).try_cast("double")


def cost_note(x: Column) -> Column:
    """C17: what remains of a cost text without its first number, or the whole text when it has none."""
    text = blank_to_null(x)
    found = F.regexp_extract(text, _FIRST_NUMBER, 0)
    at = F.instr(text, found)
    rest = F.concat(F.substring(text, F.lit(1), at - 1), F.substring(text, at + F.length(found), F.length(text)))
    rest = F.btrim(F.trim(F.replace(rest, F.lit("$"), F.lit(""))), F.lit("() "))
    return F.when(found == "", text).otherwise(F.nullif(rest, F.lit("")))


def category(x: Column) -> Column:
    """C18, left part: the text before the first colon."""
    return blank_to_null(F.element_at(F.split(x, ":", 2), 1))


def problem_with_detail(category_text: Column, problem: Column) -> Column:
    """C18, right part: detail after the colon leads the problem text."""
    detail = blank_to_null(F.try_element_at(F.split(category_text, ":", 2), F.lit(2)))
    said = F.nullif(problem, F.lit(""))
    return F.when(detail.isNotNull(), F.concat_ws(": ", detail, said)).otherwise(blank_to_null(problem))


def with_station_note(code: Column, problem: Column) -> Column:
    """Mark station-level rows once."""
    base = F.coalesce(problem, F.lit(""))
    noted = F.when(F.contains(base, F.lit(STATION_NOTE)), base).otherwise(
        F.trim(F.concat_ws(" ", base, F.lit(STATION_NOTE)))
    )
    return F.when(code == STATION_CODE, noted).otherwise(problem)


def charger_code(serial: Column, connector: Column) -> Column:
    """Serial and connector of one plug."""
    return F.concat_ws("-", F.trim(serial), F.trim(connector))


def charger_code_before_colon(charger: Column, port: Column) -> Column:
    """The part before a colon, then the port."""
    return F.concat_ws("-", F.element_at(F.split(charger, ":"), 1), port)


def vehicle_code(*candidates: Column) -> Column:
    """Upper case, no blanks or question marks; the first usable candidate."""
    return F.coalesce(*[F.nullif(F.translate(F.upper(F.trim(c)), " ?", ""), F.lit("")) for c in candidates])


def leading_code(x: Column) -> Column:
    """The code in front of a hash suffix."""
    return F.nullif(F.trim(F.element_at(F.split(x, ":", 2), 1)), F.lit("nan"))
