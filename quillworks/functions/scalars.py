"""Column functions of the screens, intake forms and reports.

All are expressions over built-in functions, so they stay inside code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillworks.functions.fixed_values import (
    INVITE_CODE_PATTERN,
    PREVIEW_CHARACTERS,
    WHITESPACE,
)

# Calendar date or week date, then a time after any one character; extended or basic form.
ISO_TIME = r"(\d\d)(?::?(\d\d)(?::?(\d\d)(?:[.,](\d+))?)?)?"
ISO_CALENDAR = r"(?s)^(\d{4})(-?)(\d\d)\2(\d\d)"
ISO_WEEK = r"^(\d{4})(-?)W(\d\d)(?:\2([1-7]))?"
ISO_TIME_FORMS = r"\d\d(:\d\d(:\d\d([.,]\d+)?)?|\d\d(\d\d([.,]\d+)?)?)?$"


def strip(text: Column) -> Column:
    """Text without blank characters at both ends, Unicode blanks included."""
    return F.btrim(text, F.lit(WHITESPACE))


def or_default(value: Column, default: str) -> Column:
    """``default`` where the text is NULL or empty."""
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(default))


def blank_to_null(text: Column) -> Column:
    """Stripped text, NULL when nothing is left."""
    return F.nullif(strip(text), F.lit(""))


def preview(text: Column, characters: int = PREVIEW_CHARACTERS) -> Column:
    """First characters followed by an ellipsis, also for short and NULL texts."""
    return F.concat(F.left(F.coalesce(text, F.lit("")), F.lit(characters)), F.lit("..."))


def title_case(word: Column) -> Column:
    """Every word capitalised; underscores count as word breaks but stay."""
    return F.array_join(F.transform(F.split(word, "_"), F.initcap), "_")


def first_upper(text: Column) -> Column:
    """First character in upper case, the rest unchanged."""
    return F.concat(F.upper(F.left(text, F.lit(1))), F.substring(text, 2, 2147483647))


def initial(text: Column) -> Column:
    """First character in upper case (avatar letter)."""
    return F.upper(F.left(text, F.lit(1)))


def spaced(label: Column) -> Column:
    """Underscores shown as blanks."""
    return F.replace(label, F.lit("_"), F.lit(" "))


def bare_handle(name: Column) -> Column:
    """Account name without surrounding blanks and leading ``@`` signs."""
    return F.ltrim(strip(name), F.lit("@"))


def handle(name: Column) -> Column:
    """Account name with exactly one leading ``@``."""
    return F.concat(F.lit("@"), bare_handle(name))


def comma_list(text: Column) -> Column:
    """Items of a comma-separated text: stripped, empty ones dropped, order and repeats kept."""
    return F.filter(F.transform(F.split(text, ","), strip), lambda item: item != "")


def normal_code(code: Column) -> Column:
    """Invite code as stored: stripped, upper case."""
    return F.upper(strip(code))


def is_invite_code(code: Column) -> Column:
    return code.rlike(INVITE_CODE_PATTERN)


def rate(likes: Column, comments: Column, shares: Column, views: Column) -> Column:
    """Engagement in percent of the views, two decimals; NULL without views."""
    interactions = (likes + comments + shares).cast("decimal(20,0)") * 100
    return F.try_divide(interactions, views.cast("decimal(20,0)")).cast("decimal(38,2)")


def iso_timestamp(text: Column) -> Column:
    """ISO date and time as a zone-less timestamp; NULL when it is not one.

    Accepted as in Python 3.11: extended and basic form, week dates, a bare hour, any number of
    fractional digits (six count), any one character between date and time. A time with an
    offset is no zone-less time.
    """

    def part(pattern: str, group: int, missing: str) -> Column:
        found = F.regexp_extract(text, pattern, group)
        return F.when(found == "", missing).otherwise(found)

    def with_time(head: str) -> tuple[Column, str]:
        return text.rlike(f"{head}(.{ISO_TIME_FORMS}|$)"), f"{head}.{ISO_TIME}$"

    def moment(day: Column, pattern: str, first: int) -> Column:
        clock = F.concat_ws(":", *[part(pattern, first + i, "00") for i in range(3)])
        fraction = F.rpad(F.left(F.regexp_extract(text, pattern, first + 3), F.lit(6)), 6, "0")
        return F.concat(day.cast("string"), F.lit(" "), clock, F.lit("."), fraction).try_cast("timestamp_ntz")

    is_calendar, calendar = with_time(ISO_CALENDAR)
    calendar_day = F.concat_ws("-", *[F.regexp_extract(text, ISO_CALENDAR, i) for i in (1, 3, 4)]).try_cast("date")
    is_week, week = with_time("(?s)" + ISO_WEEK)
    fourth = F.concat(F.regexp_extract(text, ISO_WEEK, 1), F.lit("-01-04")).try_cast("date")
    number = F.regexp_extract(text, ISO_WEEK, 3).try_cast("int")
    weekday = part(ISO_WEEK, 4, "1").try_cast("int")
    # The fourth of January lies in the first week; a week that is not of the year is refused.
    monday = F.date_add(F.date_sub(fourth, F.weekday(fourth)), (number - 1) * 7)
    of_year = (number >= 1) & (F.year(F.date_add(monday, 3)) == F.year(fourth))
    week_day = F.when(of_year, F.date_add(monday, weekday - 1))
    return F.when(is_calendar, moment(calendar_day, calendar, 5)).when(is_week, moment(week_day, week, 5))


def week_end(day: Column) -> Column:
    """Last day of the seven-day week starting at ``day``."""
    return F.date_add(day, 6)


def older_than(moment: Column, days: int, as_of: Column) -> Column:
    return moment < as_of - F.make_interval(days=F.lit(days))


def day_text(moment: Column) -> Column:
    """``yyyy-MM-dd`` prefix of a timestamp."""
    return F.date_format(moment, "yyyy-MM-dd")


def minute_text(moment: Column) -> Column:
    """``yyyy-MM-dd HH:mm`` prefix of a timestamp."""
    return F.date_format(moment, "yyyy-MM-dd HH:mm")


def form_minute(moment: Column) -> Column:
    """Minute stamp in the format of a date-time form field."""
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm")


def thousands(number: Column) -> Column:
    """Whole number with thousands separators."""
    return F.format_number(number, 0)


def counted(number: Column, noun: str) -> Column:
    """``1 post``, ``2 posts``."""
    return F.concat(number.cast("string"), F.lit(f" {noun}"), F.when(number == 1, "").otherwise("s"))


def collated(text: Column) -> Column:
    """Human-entered key compared without regard to case, accents and trailing blanks."""
    return F.collate(text, "UNICODE_CI_AI_RTRIM")


def stable_id(*parts: Column | str) -> Column:
    """Identifier in UUID form derived from its parts.

    A recomputed task yields the same identifiers, so rows written from one
    batch refer to each other even when an executor is lost in between.
    """
    digest = F.md5(F.concat_ws("|", *parts))
    return F.regexp_replace(digest, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
