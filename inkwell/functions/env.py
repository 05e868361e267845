"""Clock, weather of panic, and region effects as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hour below which a period of the day lasts.
PERIODS = ((6, "凌晨"), (9, "早晨"), (12, "上午"), (14, "中午"), (17, "下午"), (19, "傍晚"))
NIGHT = "夜晚"
#: States of a place.
NORMAL, BROKEN, DELAYED, TIGHT, PLENTY = "正常", "中断", "延迟", "紧张", "充足"


def advance(day: Column, hour: Column, hours: Column) -> Column:
    """struct(absolute_day, hour, is_night) after ``hours`` have passed."""
    later = hour + hours
    over = later >= 24
    new_hour = F.when(over, later - 24 * F.floor(later / 24)).otherwise(later)
    return F.struct(
        (day + F.when(over, F.floor(later / 24)).otherwise(0)).cast("int").alias("absolute_day"),
        new_hour.cast("double").alias("hour"),
        is_night(new_hour).alias("is_night"),
    )


def is_night(hour: Column) -> Column:
    return (hour < 6) | (hour >= 19)


def day_period(hour: Column, periods=PERIODS, night: str = NIGHT) -> Column:
    (first, name), *rest = periods
    out = F.when(hour < first, name)
    for limit, name in rest:
        out = out.when(hour < limit, name)
    return out.otherwise(night)


def formatted(day: Column, hour: Column) -> Column:
    return F.concat(F.lit("第"), day.cast("string"), F.lit("天 "), day_period(hour), F.lit(" ("), F.bround(hour, 0).cast("int").cast("string"), F.lit(":00)"))


def region_effects(level: Column, power: Column, communication: Column, accessible: Column, supply: Column, panic: Column) -> Column:
    """State of a place after effects of ``level``; what a level doesn't touch keeps its earlier value."""
    return F.struct(
        F.when(level >= 3, BROKEN).otherwise(power).alias("power"),
        F.when(level >= 3, BROKEN).when(level >= 2, DELAYED).otherwise(communication).alias("communication"),
        F.when(level >= 3, False).otherwise(accessible).alias("accessible"),
        F.when(level >= 1, TIGHT).otherwise(supply).alias("supply_status"),
        F.when(level >= 1, F.least(F.lit(10), level * 3)).otherwise(panic).cast("int").alias("panic_level"),
    )


def fresh_place() -> dict[str, Column]:
    """Columns of a place that nothing is known about."""
    return {"power": F.lit(NORMAL), "communication": F.lit(NORMAL), "accessible": F.lit(True), "supply_status": F.lit(PLENTY), "panic_level": F.lit(0), "mutation_level": F.lit(0)}


def panic_from_events(n: Column) -> Column:
    """0 without public events, else twice their number, between 1 and 10."""
    return F.when(n > 0, F.least(F.lit(10), F.greatest(F.lit(1), n * 2))).otherwise(0).cast("int")


def level_from_status(status: Column, level: Column) -> Column:
    """A region whose infrastructure is down counts as level 3 at least."""
    return F.when(status == "down", F.greatest(level, F.lit(3))).otherwise(level)
