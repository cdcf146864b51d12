"""Line dedup: drop lines that too many pages of one site share.

Pages holding a line are counted per (site, line) and divided by the pages of
the site. Line counts are combined before the shuffle, so a site with a third of
all pages costs no more than its distinct lines. The lines to drop are few: at
most lines per page divided by the ratio, for each site.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeboard.llm import texts
from noticeboard.session import materialise

#: A line on more than this share of a site's pages is boilerplate, if it is on at least so many pages.
MAX_RATIO, MIN_PAGES = 0.1, 5

#: Block elements end a line; other tags vanish.
DROPPED = [r"(?is)<script[^>]*>.*?</script>", r"(?is)<style[^>]*>.*?</style>", r"(?s)<!--.*?-->"]
BLOCK = r"(?i)</?(p|div|li|ul|ol|nav|article|section|header|footer|table|tr|h1|h2|h3|h4|h5|h6|br|title|head|body|html)( [^>]*)?/?>"
TAG = r"<[^>]*>"
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)"


def page_lines(html: Column) -> Column:
    """The text of a page with one line per block."""
    out = html
    for pattern in DROPPED:
        out = F.regexp_replace(out, pattern, "")
    return F.regexp_replace(F.regexp_replace(out, BLOCK, "\n"), TAG, "")


def host_of(url: Column) -> Column:
    """The host of an absolute URL in lower case, empty for anything else."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1))


def boilerplate(pages: DataFrame, text: str, site: str, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(site, lines): the lines to drop on each site that has any."""
    plain = pages.select(F.col(f"`{site}`").alias("site"), F.col(f"`{text}`").alias("text"))
    totals = plain.groupBy("site").agg(F.count(F.lit(1)).alias("pages"))
    lines = plain.select("site", F.explode(F.array_distinct(F.transform(F.split("text", "\n"), F.trim))).alias("line"))
    held = lines.filter("line <> ''").groupBy("site", "line").agg(F.count(F.lit(1)).alias("held"))
    held = held.filter(F.col("held") >= min_pages)
    shared = held.join(totals.withColumnRenamed("site", "_s"), F.col("site").eqNullSafe(F.col("_s"))).drop("_s")
    return shared.filter(F.col("held") > max_ratio * F.col("pages")).groupBy("site").agg(F.collect_list("line").alias("lines"))


def drop_boilerplate(
    pages: DataFrame, text: str, site: str, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, removed: str | None = None
) -> DataFrame:
    """``pages`` with boilerplate lines cut from ``text``; all rows and columns stay.

    Lines are compared without outer blanks; blank lines stay. A null text stays
    null, a null site is a site of its own, and repeated rows count as pages of
    their own. A page of boilerplate alone keeps an empty text. ``removed`` names
    a column to add with the number of lines cut. Sites with fewer than ``min_pages`` pages never lose a
    line: a line on so few pages is no evidence. Extra columns may have any names. Empty tables give no rows.
    """
    shared = materialise(boilerplate(pages, text, site, max_ratio, min_pages), "boilerplate")
    size = shared.agg(F.sum(F.length(F.array_join("lines", "\n")) * 4)).first()[0] or 0
    # the given row travels as one column, so that its names cannot meet those used here
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("given"), F.col(f"`{site}`").alias("site"))
    body = F.col("given")[text]
    out = texts.spread_lookup(rows, shared, "site", size, body)
    whole = F.col("lines").isNull() | body.isNull()
    cut = F.array_join(F.filter(F.split(body, "\n"), lambda x: ~F.array_contains("lines", F.trim(x))), "\n")
    values = {c: F.when(whole, body).otherwise(cut) if c == text else F.col("given")[c] for c in pages.columns}
    if removed:
        lost = F.size(F.filter(F.split(body, "\n"), lambda x: F.array_contains("lines", F.trim(x)))).cast("long")
        values[removed] = F.when(whole, F.lit(0).cast("long")).otherwise(lost)
    return out.select(F.struct(*[value.alias(c) for c, value in values.items()]).alias("given")).select("given.*")
