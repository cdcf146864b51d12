"""Months and dates found in texts, links and timestamps, as ``YYYY-MM`` strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from noticeboard.constants import MONTH_NAMES

# Fixed list of accepted date spellings, in the order they are tried.
DATE_FORMATS = ["yyyy-M-d", "yyyy/M/d", "d MMMM yyyy", "MMMM d, yyyy", "yyyy 年 M 月 d 日"]


def month_number(name: Column) -> Column:
    """Two-digit number of an English month name in any case, else NULL."""
    table = F.create_map(*[F.lit(x) for i, m in enumerate(MONTH_NAMES, 1) for x in (m.lower(), f"{i:02d}")])
    return F.try_element_at(table, F.lower(name))


def url_year_month(url: Column, default: str) -> Column:
    found = F.regexp_extract(url, r"/([0-9]{4})/([0-9]{2})/", 0)
    return F.when(found != "", F.concat(F.substring(found, 2, 4), F.lit("-"), F.substring(found, 7, 2))).otherwise(
        F.lit(default)
    )


def smart_date(text: Column, url: Column, as_of: str) -> Column:
    """Month of a dated text, else of a ``/YYYY-month`` link, else of the run date."""
    parsed = [F.date_format(F.try_to_timestamp(F.trim(text), F.lit(f)), "yyyy-MM") for f in DATE_FORMATS]
    year = F.nullif(F.regexp_extract(url, r"/([0-9]{4})-([a-zA-Z]+)", 1), F.lit(""))
    month = month_number(F.regexp_extract(url, r"/([0-9]{4})-([a-zA-Z]+)", 2))
    return F.coalesce(*parsed, F.concat(year, F.lit("-"), month), F.lit(as_of[:7]))


def latest_mentioned_month(text: Column, as_of: str) -> Column:
    """Latest valid month written in the text that is not after the run date, else ''."""
    dashed = F.transform(
        F.regexp_extract_all(text, F.lit(r"[0-9]{4}-[0-9]{1,2}"), F.lit(0)), lambda m: F.split(m, "-")
    )
    written = F.transform(
        F.regexp_extract_all(text, F.lit(r"[0-9]{4}\s*年\s*[0-9]{1,2}\s*月"), F.lit(0)),
        lambda m: F.split(F.regexp_replace(m, r"[\s月]", ""), "年"),
    )
    months = F.transform(
        F.filter(F.concat(dashed, written), lambda p: p[1].cast("int").between(1, 12)),
        lambda p: F.concat(p[0], F.lit("-"), F.lpad(p[1].cast("int").cast("string"), 2, "0")),
    )
    return F.coalesce(F.array_max(F.filter(months, lambda m: m <= as_of[:7])), F.lit(""))


def parse_cy_month(text: Column) -> Column:
    """``March CY2025`` to ``2025-03``; NULL when it is not of that form."""
    pattern = r"^(" + "|".join(MONTH_NAMES) + r")\s+CY([0-9]{4})$"
    text = F.trim(text)
    return F.concat(
        F.nullif(F.regexp_extract(text, pattern, 2), F.lit("")),
        F.lit("-"),
        month_number(F.regexp_extract(text, pattern, 1)),
    )


def _iso(text: Column, pattern: str, length: int) -> Column:
    """The date as it is written: an offset does not move it to another day."""
    valid = F.try_to_timestamp(F.replace(text, F.lit("T"), F.lit(" "))).isNotNull()
    written = F.regexp_extract(text, r"^\s*(\d{4})-(\d{1,2})(?:-(\d{1,2}))?", 0)
    parts = F.split(F.trim(written), "-")
    month = F.concat(parts[0], F.lit("-"), F.lpad(parts[1], 2, "0"))
    day = F.concat(month, F.lit("-"), F.lpad(F.coalesce(F.get(parts, F.lit(2)), F.lit("1")), 2, "0"))
    parsed = F.when(valid & (written != ""), month if length == 7 else day)
    fallback = F.substring(F.regexp_replace(text, r"(?s)[^0-9-].*", ""), 1, length)
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit("")).otherwise(F.coalesce(parsed, fallback))


def iso_month(text: Column) -> Column:
    return _iso(text, "yyyy-MM", 7)


def iso_date(text: Column) -> Column:
    return _iso(text, "yyyy-MM-dd", 10)


def resolve_months(kind: Column, n: Column, as_of: str) -> Column:
    """Months meant by a relative phrase: last, past (n months), recent (three), none."""
    day = F.to_date(F.lit(as_of))

    def back(i: Column) -> Column:
        return F.date_format(F.add_months(day, -i), "yyyy-MM")

    def run_of(count: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), count - 1), back)

    return (
        F.when(kind == "last", F.array(back(F.lit(1))))
        .when((kind == "past") & (n > 0), run_of(F.greatest(n, F.lit(1))))
        .when(kind == "recent", run_of(F.lit(3)))
        .otherwise(F.array().cast("array<string>"))
    )


def staleness_label(update_date: Column, count: Column, as_of: str) -> Column:
    days = F.datediff(F.lit(as_of).cast("date"), F.to_date(update_date, "y-M-d"))
    return (
        F.when(days == 0, F.concat(F.lit("updated today: "), count))
        .when(days.between(1, 7), F.concat(F.lit("updated "), days.cast("string"), F.lit(" days ago")))
        .otherwise(F.concat(F.lit("updated on "), update_date))
    )
