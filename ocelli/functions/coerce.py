"""Coercion of loose values: numbers, booleans, epochs, refresh rates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import any_term, text

# Words for true and false.
TRUE_WORDS = ("1", "true", "yes", "y", "active", "enabled", "online", "inservice", "in service")
FALSE_WORDS = ("0", "false", "no", "n", "inactive", "disabled", "offline", "outofservice", "out of service")


def first_number(c: Column) -> Column:
    """The first number within a text, or null."""
    return F.regexp_extract(text(c), r"[-+]?\d+(?:\.\d+)?", 0).try_cast("double")


def whole_number(c: Column) -> Column:
    """A text that is a number as a whole (no type suffix), or null."""
    t = F.trim(text(c))
    return F.when(t.rlike(r"^[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?$"), t.try_cast("double"))


def boolean(c: Column) -> Column:
    t = F.lower(F.trim(text(c)))
    return F.when(t.isin(*TRUE_WORDS), True).when(t.isin(*FALSE_WORDS), False)


def epoch_to_iso(c: Column) -> Column:
    """Epoch seconds, or milliseconds beyond 10**11, as ``YYYY-MM-DDTHH:MM:SSZ``; null outside of 1970 to 2100.

    Written with arithmetic on days, so it doesn't depend on the session's time zone.
    """
    raw = whole_number(c)
    s = F.when(raw > 1e11, raw / 1000).otherwise(raw)
    whole = F.floor(s)
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(whole / 86400).cast("int"))
    rest = F.pmod(whole, F.lit(86400))
    two = lambda v: F.lpad(v.cast("long").cast("string"), 2, "0")
    clock = F.concat_ws(":", two(F.floor(rest / 3600)), two(F.pmod(F.floor(rest / 60), F.lit(60))), two(F.pmod(rest, F.lit(60))))
    return F.when((s > 0) & (s <= 4102444800), F.concat(day.cast("string"), F.lit("T"), clock, F.lit("Z")))


def refresh_seconds(c: Column) -> Column:
    """A number, or "30 sec" or "2 min", in seconds; null for other texts."""
    t = F.trim(text(c))
    pattern = r"(?i)(\d+(?:\.\d+)?)\s*(seconds?|secs?|s|minutes?|mins?|m)\b"
    amount, unit = F.regexp_extract(t, pattern, 1).try_cast("double"), F.lower(F.regexp_extract(t, pattern, 2))
    return F.coalesce(whole_number(c), F.when(unit.startswith("m"), amount * 60).otherwise(amount))


def camera_type(c: Column) -> Column:
    """One of the display categories, by ordered keyword classes; ``camera`` where nothing is given."""
    t = F.lower(F.trim(text(c)))
    return (
        F.when(t == "", "camera")
        .when(any_term(t, ("traffic", "road", "highway", "cctv", "transportation")), "traffic")
        .when(any_term(t, ("weather", "wx", "meteo")), "weather")
        .when(any_term(t, ("transit", "rail", "bus", "train")), "transit")
        .when(any_term(t, ("beach", "surf", "coast")), "beach")
        .when(t.contains("airport"), "airport")
        .when(any_term(t, ("port", "harbor", "harbour", "marina")), "port")
        .when(any_term(t, ("park", "trail")), "park")
        .when(any_term(t, ("ski", "snow", "mountain")), "ski")
        .when(any_term(t, ("security", "public safety", "police", "fire")), "security_public_safety")
        .when(t.contains("tour"), F.when(any_term(t, ("tourism", "tourist", "public", "webcam")), "tourism").when(any_term(t, ("camera", "cam", "video", "image")), "camera").otherwise("other"))
        .when(any_term(t, ("public", "webcam")), "public")
        .when(any_term(t, ("camera", "cam", "video", "image")), "camera")
        .otherwise("other")
    )
