"""Fields of an article record."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# The part of a date field that is read, and how.
DATE = r"^(\d{1,4}-\d{1,2}-\d{1,2})(?!\d)"
DATE_PATTERN = "y-M-d"


def string_field(name: str) -> Column:
    """Text of a field; a missing field reads as the empty string."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def int_field(name: str, strict: bool = True) -> Column:
    """Whole number in a field.

    ``strict`` stops the job at the first value that is no number, whatever
    the session's ANSI setting is; otherwise such a value reads as null.
    """
    number = F.trim(string_field(name)).try_cast("bigint")
    if not strict:
        return number
    complaint = F.concat(F.lit(f"not a whole number in {name}: "), string_field(name))
    return F.when(number.isNull(), F.raise_error(complaint).cast("bigint")).otherwise(number)


def date_field(name: str, strict: bool = False) -> Column:
    """Timestamp at midnight of a date field; an empty one is null.

    Months and days may have one digit; a time of day behind the date is
    dropped, but not a further digit. An unreadable date is null, or stops the job if ``strict``.
    """
    text = F.trim(string_field(name))
    day = F.try_to_timestamp(F.regexp_extract(text, DATE, 1), F.lit(DATE_PATTERN))
    found = F.when(text != "", day)
    if not strict:
        return found
    complaint = F.concat(F.lit(f"not a date in {name}: "), text)
    unreadable = (text != "") & day.isNull()
    return F.when(unreadable, F.raise_error(complaint).cast("timestamp")).otherwise(found)


def title_and_text(title: str = "title", text: str = "text") -> Column:
    return F.concat_ws(" ", string_field(title), string_field(text))


def has_letters(name: str) -> Column:
    """True where the text holds at least one letter of any script."""
    return string_field(name).rlike(r"\p{L}")
