"""Date rules; the present is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAYS = ("월", "화", "수", "목", "금", "토", "일")


def parse_mail_date(c: Column, zone: str = "Asia/Seoul") -> Column:
    """RFC 2822; the weekday is not read; null if it can't be parsed; without offset it is local in ``zone``."""
    t = F.regexp_replace(F.trim(c), r"^[A-Za-z]{3},\s*", "")
    t = F.regexp_replace(t, r"\s+\([^)]*\)$", "")
    t = F.regexp_replace(t, r"\s+(GMT|UT|UTC|Z)$", " +0000")
    local = F.try_to_timestamp(F.concat(t, F.lit(" +0000")), F.lit("d MMM yyyy HH:mm:ss Z"))
    return F.coalesce(F.try_to_timestamp(t, F.lit("d MMM yyyy HH:mm:ss Z")), F.to_utc_timestamp(local, zone))


def parse_iso(c: Column) -> Column:
    return F.try_to_timestamp(F.trim(c))


def within_hours(ts: Column, now: Column, hours: int) -> Column:
    """Closed on both sides: later rows are out, too."""
    return ts.between(now - F.expr(f"INTERVAL {hours} HOURS"), now)


def age_bucket(ts: Column, now: Column, bucket_hours: int) -> Column:
    """Whole hours of age, in buckets counted back from now."""
    seconds = F.timestamp_diff("SECOND", ts, now)
    return F.floor(F.floor(seconds / 3600) / bucket_hours).cast("bigint")


def korean_date(ts: Column) -> Column:
    """Date with weekday and 오전/오후."""
    day = F.element_at(F.array(*map(F.lit, DAYS)), F.weekday(ts) + 1)
    half = F.when(F.hour(ts) < 12, "오전").otherwise("오후")
    hour = F.when(F.hour(ts) % 12 == 0, 12).otherwise(F.hour(ts) % 12)
    return F.concat(F.date_format(ts, "yyyy년 MM월 dd일"), F.lit(" ("), day, F.lit(") "), half, F.lit(" "), hour.cast("string"), F.lit(":"), F.date_format(ts, "mm"))


def best_date(published: Column, iso: Column, mail: Column) -> Column:
    """A1: the parsed time, else the ISO text's, else the mail date's."""
    return F.coalesce(published, parse_iso(iso), parse_mail_date(mail))


def range_text(latest: Column, oldest: Column) -> Column:
    """G5."""
    day = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm")
    return F.when(latest.isNull() | oldest.isNull(), "발행일 범위 확인 불가").otherwise(F.concat(F.lit("최근 "), day(latest), F.lit(" / 가장 오래됨 "), day(oldest)))
