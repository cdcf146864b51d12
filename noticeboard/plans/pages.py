"""Crawled pages to chunks: mark-up, title, article, sections, pieces, month and links in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeboard import constants as C
from noticeboard.functions import dates, html
from noticeboard.operators import chunking
from noticeboard.operators.common import computed


def pages_to_chunks(
    pages: DataFrame,
    default_month: str = "",
    title_suffix: str = "",
    size: int = C.CHUNK_SIZE,
    overlap: int = C.CHUNK_OVERLAP,
    tolerance: int = C.CHUNK_TOLERANCE,
    min_chars: int = C.MIN_CHUNK_CHARS,
) -> DataFrame:
    """website, link, heading_link, year_month, main_title, title, content, page_id, section, chunk.

    pages: page_id, website, url, html. The title comes from the whole page, the text from its
    article without boilerplate. Each section is cut at natural breaks if it is too long and keeps
    its nearest heading as title. Error pages, pages without an article and blank or very short
    pieces give no rows. Nothing is shuffled: a page is worked on inside its row, and its
    mark-up is read once.
    """
    titled = computed(pages.select("page_id", "website", "url", "html"), main_title=html.extract_title(F.col("html"), title_suffix))
    titled = titled.filter(F.col("main_title").isNotNull()).select(
        "page_id",
        "website",
        html.canonical_link(F.col("url")).alias("link"),
        F.col("url").alias("heading_link"),
        dates.url_year_month(F.col("url"), default_month).alias("year_month"),
        "main_title",
        "html",
    )
    read = computed(titled, content=html.html_to_markdown(html.extract_article(html.strip_boilerplate(F.col("html")))))
    sections = chunking.split_by_headings(read.drop("html"))
    chunks = chunking.chunk_smart(sections, "content", size, overlap, tolerance)
    return chunking.chunk_explode(chunks, "chunk_text", min_chars).withColumnRenamed("chunk_text", "content")
