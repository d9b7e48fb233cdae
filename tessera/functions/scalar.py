"""Scalars: guarded casts, clamps, ratios, names and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_int(x: Column) -> Column:
    """Whole number of a string; 0 where it is none (also for "1.5")."""
    text = F.trim(x.cast("string"))
    return F.coalesce(F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("int")), F.lit(0))


def safe_float(x: Column) -> Column:
    return F.coalesce(x.cast("string").try_cast("double"), F.lit(0.0))


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """x held to [low, high]; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def half_up(x: Column, digits: int) -> Column:
    """Rounding that does not depend on decimal expansion."""
    return F.floor(x * 10**digits + 0.5) / 10**digits


def label_key(x: Column) -> Column:
    return F.lower(F.trim(x))


def folder_name(x: Column) -> Column:
    """A name fit for a folder: illegal runs become one underscore; dots and spaces go at the ends."""
    cleaned = F.regexp_replace(x, r'[<>:"/\\|?*]+', "_")
    cleaned = F.regexp_replace(cleaned, r"^[ .]+|[ .]+$", "")
    return F.coalesce(F.nullif(F.regexp_replace(cleaned, r"_+", "_"), F.lit("")), F.lit("Unknown"))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/*$", 1)


def stem(path: Column) -> Column:
    """Base name without its last suffix; a leading dot is no suffix."""
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]+$", "")


def suffix(path: Column) -> Column:
    return F.regexp_extract(base_name(path), r"^.+(\.[^.]+)$", 1)


def parent(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*$", "")


def normal_path(path: Column) -> Column:
    """A path without empty and `.` parts, and without `x/..` where there is an x to leave; `.` if nothing is left."""
    rooted = path.startswith("/")
    none = F.array().cast("array<string>")

    def step(kept: Column, part: Column) -> Column:
        last = F.try_element_at(kept, F.lit(-1))
        up = F.when(last.isNotNull() & (last != ".."), F.slice(kept, 1, F.size(kept) - 1)).when(rooted, kept).otherwise(F.concat(kept, F.array(part)))
        return F.when(part.isin("", "."), kept).when(part == "..", up).otherwise(F.concat(kept, F.array(part)))

    joined = F.concat(F.when(rooted, "/").otherwise(""), F.array_join(F.aggregate(F.split(path, "/"), none, step), "/"))
    return F.when(joined == "", ".").otherwise(joined)


def utc_now() -> Column:
    """The time of the query as an ISO string in UTC, to the second."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def elapsed_seconds(start: Column, end: Column) -> Column:
    """Seconds from start to end, 0 at least, to the millisecond."""
    t = lambda c: c.cast("timestamp").cast("double")
    return half_up(F.greatest(F.lit(0.0), t(end) - t(start)), 3)


def title(x: Column) -> Column:
    """Upper case at the start and after anything that is no letter."""
    return F.array_join(F.transform(F.split(x, r"(?<=[^a-zA-Z])(?=[a-zA-Z])"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2))))), "")


def profile_key(x: Column) -> Column:
    """A profile's canonical name."""
    return F.coalesce(F.nullif(F.regexp_replace(F.lower(F.trim(x)), "[- ]", "_"), F.lit("")), F.lit("balanced"))


def clock(seconds: Column) -> Column:
    """Duration as 1h 02m 03s."""
    s = F.greatest(F.lit(0), seconds.cast("int"))
    h, m, r = F.floor(s / 3600).cast("int"), F.floor((s % 3600) / 60).cast("int"), s % 60
    return F.when(h > 0, F.format_string("%dh %02dm %02ds", h, m, r)).when(m > 0, F.format_string("%dm %02ds", m, r)).otherwise(F.format_string("%ds", r))


def eta(done: Column, total: Column, per_minute: Column) -> Column:
    """Time left at a rate, as `clock` shows it; `complete` when all is done, -- while there is no rate or no total."""
    left = F.greatest(F.lit(0), total - done) / per_minute * 60.0
    return F.when((total > 0) & (done >= total), "complete").when((per_minute > 1e-6) & (total > 0), clock(left)).otherwise("--")


def frame_index(ts: Column, fps: Column, total: Column) -> Column:
    """Frame at a time, truncated and held to the frames there are."""
    rate = F.when((fps <= 0) | F.isnan(fps) | fps.isNull(), F.lit(25.0)).otherwise(fps)
    return F.greatest(F.lit(0), F.least(total - 1, (ts * rate).cast("int")))


def consistency(pos: Column, neg: Column) -> Column:
    """Share of positive feedback; 0 without any."""
    p, n = F.greatest(pos, F.lit(0)), F.greatest(neg, F.lit(0))
    return F.when(p + n > 0, p / (p + n)).otherwise(F.lit(0.0))


def adaptive_threshold(pos: Column, neg: Column, auto: float = 0.82, suggest: float = 0.74, share: Column | None = None) -> Column:
    """Auto-apply threshold moved by feedback, never outside [suggest, auto]."""
    c = consistency(pos, neg) if share is None else clamp(share)
    strength = lambda x: F.least(F.lit(1.0), F.greatest(x, F.lit(0)) / 20.0)
    bonus = F.least(F.lit(0.08), 0.08 * strength(pos) * c)
    penalty = F.least(F.lit(0.05), 0.05 * strength(neg) * (1 + F.greatest(F.lit(0.0), 0.6 - c)))
    return half_up(F.greatest(F.lit(suggest), F.least(F.lit(auto), F.lit(auto) - bonus + penalty)), 4)


def trend(pos: Column, neg: Column) -> Column:
    return F.when((pos <= 0) & (neg <= 0), "no_data").when((pos >= 2 * neg) & (pos >= 2), "improving").when(neg > pos, "conflicting").otherwise("mixed")
