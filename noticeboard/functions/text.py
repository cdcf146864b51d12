"""Text clean-up, fingerprints, tokens and keyword matching."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from noticeboard.constants import (
    CJK_RANGE,
    METADATA_LABELS,
    RETRY_STRIPPED_CHARS,
    TEMPLATE_HEADINGS,
    WHITESPACE,
)

WORD_BREAK = r"[^\p{L}\p{N}]+"

# Fixed patterns of the clean-up, applied in this order: (pattern, replacement).
# ``(?md)`` makes ``.``, ``^`` and ``$`` treat only ``\n`` as a line end.
CLEAN_RULES: list[tuple[str, str]] = [
    (r"https?://[^\s\x{3000}]+", ""),
    (r"(?md)^\*\s*\*\*(?:" + "|".join(METADATA_LABELS) + r")\*\*[：:].*\r?\n?", ""),
    (r"(?md)^#{3,6}\s*(?:" + "|".join(TEMPLATE_HEADINGS) + r")\s*$", ""),
    (r"(?d)!\[.*?\]\(.*?\)", ""),
    (r"(?md)^(?:\*{3,}|-{3,}|_{3,})\s*$", ""),
]

# Markdown marks dropped by our plain-text form, in this order.
MARKDOWN_RULES: list[tuple[str, str]] = [
    (r"(?md)^[ \t]*```.*$", ""),
    (r"(?md)^\|?[ \t]*:?-{2,}[-:| \t]*$", ""),
    (r"(?md)^[ \t]*\||\|[ \t]*$|[ \t]\|(?:[ \t])", " "),
    (r"\[([^\]\n]*)\]\([^)\n]*\)", "$1"),
    (r"(?md)^[ \t]*(?:>[ \t]?|[-*+][ \t]+|[0-9]+\.[ \t]+|#{1,6}[ \t]*)", ""),
    (r"\*{1,3}([^*\n]+)\*{1,3}", "$1"),
    (r"(^|[^\p{L}\p{N}_])_{1,3}([^_\n]+)_{1,3}([^\p{L}\p{N}_]|$)", "$1$2$3"),
    (r"`([^`\n]+)`", "$1"),
    (r"<[^>]+>", ""),
    (r" +", " "),
    (r" ?(?:\n ?)+", " "),
]


def replace_all(col: Column, rules: list[tuple[str, str]]) -> Column:
    for pattern, replacement in rules:
        col = F.regexp_replace(col, pattern, replacement)
    return col


def strip(col: Column) -> Column:
    """Trim every kind of white space at both ends, not only blanks."""
    return F.btrim(col, F.lit(WHITESPACE))


def blank_to_null(col: Column) -> Column:
    return F.when(F.length(strip(col)) > 0, col)


def clean_content(col: Column) -> Column:
    text = replace_all(F.coalesce(col, F.lit("")), CLEAN_RULES)
    return strip(replace_all(text, MARKDOWN_RULES))


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed one time, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def year_of(year_month: Column) -> Column:
    return F.when(F.contains(year_month, F.lit("-")), F.split_part(year_month, F.lit("-"), F.lit(1))).otherwise(
        F.substring(year_month, 1, 4)
    )


def estimate_tokens(col: Column) -> Column:
    """2.5 tokens per CJK character and a quarter for any other, rounded up."""
    cjk = F.regexp_count(col, F.lit(CJK_RANGE))
    return F.coalesce(
        F.ceil(cjk * F.lit(2.5) + (F.length(col) - cjk) / F.lit(4.0)).cast("long"),
        F.lit(0).cast("long"),
    )


def fingerprint(website: Column, main_title: Column, title: Column, content: Column) -> Column:
    parts = [strip(F.coalesce(c, F.lit(""))) for c in (website, main_title, title, content)]
    return F.md5(F.concat_ws("|", *parts).cast("binary"))


def words(col: Column) -> Column:
    """Lower-cased runs of letters and digits, in order; of CJK characters every two that stand side by side."""
    runs = F.filter(F.split(F.lower(col), WORD_BREAK), lambda w: w != "")
    has = lambda x: F.rlike(x, F.lit(CJK_RANGE))

    def pairs(part: Column) -> Column:
        both = F.transform(F.sequence(F.lit(1), F.length(part) - 1), lambda i: F.substring(part, i, F.lit(2)))
        return F.when(has(part) & (F.length(part) > 1), both).otherwise(F.array(part))

    def pieces(run: Column) -> Column:
        parts = F.regexp_extract_all(run, F.lit(f"{CJK_RANGE}+|[^{CJK_RANGE[1:-1]}]+"), F.lit(0))
        return F.when(has(run), F.flatten(F.transform(parts, pairs))).otherwise(F.array(run))

    return F.when(has(col), F.flatten(F.transform(runs, pieces))).otherwise(runs)


def squash(col: Column) -> Column:
    """Lower case without blanks and hyphens."""
    return F.translate(F.lower(col), " -", "")


def keyword_match(text: Column, keyword: Column) -> Column:
    """True when the squashed keyword occurs in the squashed text."""
    text = F.coalesce(text, F.lit(""))
    keyword = F.coalesce(keyword, F.lit(""))
    return (text != "") & (keyword != "") & F.contains(squash(text), squash(keyword))


def distinct_keywords(keywords: Column) -> Column:
    return F.array_distinct(
        F.transform(F.coalesce(keywords, F.array().cast("array<string>")), lambda k: strip(F.lower(k)))
    )


def embedding_text(col: Column) -> Column:
    return F.translate(col, "\n", " ")


def embedding_retry_text(col: Column) -> Column:
    return F.translate(col, RETRY_STRIPPED_CHARS, "")


def clip_with_dots(col: Column, keep: int) -> Column:
    return F.when(F.length(col) > keep, F.concat(F.substring(col, 1, keep), F.lit("..."))).otherwise(col)


def normalize_citations(col: Column) -> Column:
    return F.regexp_replace(col, "[【［]([0-9]+)[】］]", "[$1]")


def strip_code_fence(col: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(strip(col), r"^```(?:json)?\s*", ""), r"\s*```\z", ""))
