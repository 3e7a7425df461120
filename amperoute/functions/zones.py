"""Wall clock <-> UTC for zone-less timestamps."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .measures import hour_floor
from .staging import evaluated

LOCAL_TZ = "America/New_York"


def _hour() -> Column:
    return F.expr("interval 1 hour")


def _in_utc_session() -> bool:
    session = SparkSession.getActiveSession()
    return session is not None and session.conf.get("spark.sql.session.timeZone") == "UTC"


def utc_to_local(ts: Column, tz: str = LOCAL_TZ) -> Column:
    """C8. In a UTC session the zoned functions serve, which look the zone up once per query, not per row."""
    if _in_utc_session():
        return F.from_utc_timestamp(ts.cast("timestamp"), tz).cast("timestamp_ntz")
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), ts)


def _raw_utc(local: Column, tz: str) -> Column:
    if _in_utc_session():
        return F.to_utc_timestamp(local.cast("timestamp"), tz).cast("timestamp_ntz")
    return F.convert_timezone(F.lit(tz), F.lit("UTC"), local)


def is_gap(local: Column, tz: str = LOCAL_TZ) -> Column:
    """True for wall times the spring change skips: converting there and back does not return."""
    return _skipped(local, _raw_utc(local, tz), tz)


def is_ambiguous(local: Column, tz: str = LOCAL_TZ) -> Column:
    """True for wall times the autumn change repeats: one hour later shows the same clock."""
    return _repeated(local, _raw_utc(local, tz), tz)


def _skipped(local: Column, utc: Column, tz: str) -> Column:
    return utc_to_local(utc, tz) != local


def _repeated(local: Column, utc: Column, tz: str) -> Column:
    return utc_to_local(utc + _hour(), tz) == local


def local_to_utc(
    df: DataFrame, columns: Sequence[str] | Mapping[str, str], tz: str = LOCAL_TZ, *, gap: str = "shift", fold: Column | None = None
) -> DataFrame:
    """Replace local wall clocks by UTC, or add them under new names (a mapping).

    ``gap='shift'`` moves a skipped time to the change, ``'null'`` drops it. ``fold`` tells for a repeated
    time which pass it is: 0 first, 1 second, null unknown. Only clocks within three hours of a change of
    offset take the detailed checks; conversions are evaluated once per row.
    """
    names = dict(columns) if isinstance(columns, Mapping) else {c: c for c in columns}
    nothing = F.lit(None).cast("timestamp_ntz")
    margin = F.expr("interval 3 hours")
    staged = df
    for c, out in names.items():
        staged = staged.withColumns(
            {f"__early_{out}": _raw_utc(F.col(c) - margin, tz), f"__late_{out}": _raw_utc(F.col(c) + margin, tz)}
        )
    staged = evaluated(staged)

    def near_change(local: Column) -> Column:
        utc = _raw_utc(local, tz)
        second = nothing if fold is None else F.when(fold == 0, utc).when(fold == 1, utc + _hour())
        moved = hour_floor(utc) if gap == "shift" else nothing
        return F.when(_skipped(local, utc, tz), moved).when(_repeated(local, utc, tz), second).otherwise(utc)

    def resolved(c: str, out: str) -> Column:
        early, late = F.col(f"__early_{out}"), F.col(f"__late_{out}")
        return F.when(late - early == margin + margin, early + margin).otherwise(near_change(F.col(c)))

    done = staged.withColumns({out: resolved(c, out) for c, out in names.items()})
    return evaluated(done.drop(*[f"__{side}_{out}" for side in ("early", "late") for out in names.values()]))


def localize_in_row_order(
    df: DataFrame, local: str, out: str, keys: Sequence[str], row_order: Sequence[str], tz: str = LOCAL_TZ
) -> DataFrame:
    """For repeated wall times, a step back in row order starts the second pass.

    Only repeated times are ordered, within one key and local day; all other rows pass without a shuffle. A repeated
    hour with no step back cannot be told apart and yields null.
    """
    told = evaluated(df.withColumn("__twice", F.coalesce(is_ambiguous(F.col(local), tz), F.lit(False))))
    once = local_to_utc(told.where(~F.col("__twice")), {local: out}, tz)
    group = Window.partitionBy(*keys, "__day")
    scope = group.orderBy(*row_order)
    again = told.where("__twice").withColumn("__day", F.to_date(F.col(local)))
    again = again.withColumn("__step", F.coalesce((F.lag(local).over(scope) > F.col(local)).cast("int"), F.lit(0)))
    fold = F.when(F.max("__step").over(group) == 1, F.max("__step").over(scope))
    twice = local_to_utc(again.withColumn("__fold", fold), {local: out}, tz, fold=F.col("__fold"))
    return once.drop("__twice").unionByName(twice.drop("__twice", "__day", "__step", "__fold"))
