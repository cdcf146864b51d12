"""Sections and chunks of documents, and item lists turned into documents."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeboard import constants as C
from noticeboard.functions.dates import parse_cy_month
from noticeboard.functions.text import estimate_tokens, strip
from noticeboard.operators.common import computed

MARK = "\u0001"


# -- items from listing APIs ----------------------------------------------
def tag_names(tags: Column) -> Column:
    """Names of an array of tag structs, blanks dropped; a missing array gives none."""
    names = F.transform(tags, lambda t: t["tagName"])
    return F.coalesce(F.filter(names, lambda n: n.isNotNull() & (n != "")), F.array().cast("array<string>"))


def labelled_line(label: str, value: Column) -> Column:
    return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(label + ": "), value))


def compose_content(body: Column, lines: list[tuple[str, Column]]) -> Column:
    """Body and the labelled lines that have a value, one per line."""
    body = F.nullif(strip(F.coalesce(body, F.lit(""))), F.lit(""))
    return strip(F.concat_ws("\n", body, *[labelled_line(label, v) for label, v in lines]))


def route_status(df: DataFrame, status: str) -> DataFrame:
    """Adds the bucket of a normalised status; rows of unknown status are dropped."""
    table = F.create_map(*[F.lit(x) for pair in C.STATUS_BUCKETS.items() for x in pair])
    bucket = F.try_element_at(table, strip(F.lower(F.coalesce(F.col(status), F.lit("")))))
    return df.withColumn("bucket", bucket).filter(F.col("bucket").isNotNull())


def month_key(preview: Column, rollout: Column) -> Column:
    return F.coalesce(parse_cy_month(preview), parse_cy_month(rollout), F.lit("unknown"))


def group_by_month(df: DataFrame, preview: str, rollout: str, title: str) -> DataFrame:
    """Items with their month, sorted by month (unknown last), preview text and title.

    The groups stay rows: a range-partitioned sort orders any number of items
    of one month, where a list per month would have to fit one task.
    """
    keyed = df.withColumn("month_key", month_key(F.col(preview), F.col(rollout)))
    return keyed.orderBy(F.col("month_key") == "unknown", "month_key", preview, title)


# -- sections -------------------------------------------------------------
def _mark_headings(text: Column) -> Column:
    """Put a mark before every heading of level 1 to 3 that is outside code fences."""
    pieces = F.split(text, "(?m)^[ \\t]*```")
    marked = F.transform(
        pieces,
        lambda piece, i: F.when(
            i % 2 == 0, F.regexp_replace(piece, r"(?m)^[ \t]*(#{1,3} )", MARK + "$1")
        ).otherwise(piece),
    )
    return F.array_join(marked, "```")


def split_by_headings(df: DataFrame, text: str = "content", main_title: str = "main_title") -> DataFrame:
    """One row per section with its nearest heading as ``title``.

    Sections are cut inside the row, so nothing is shuffled. A text that does
    not open with a heading gets its main title as one; sections that hold only
    heading marks are dropped.
    """
    body = strip(F.coalesce(F.col(text), F.lit("")))
    body = F.when(F.startswith(body, F.lit("#")), body).otherwise(
        F.concat(F.lit("# "), F.col(main_title), F.lit("\n\n"), body)
    )
    sections = F.split(_mark_headings(body), MARK)
    kept = F.filter(F.transform(sections, strip), lambda s: F.regexp_replace(s, r"[#\s]+", "") != "")
    out = df.filter(F.length(strip(F.coalesce(F.col(text), F.lit("")))) > 0).select(
        *[c for c in df.columns if c not in (text, "title")],
        F.posexplode(kept).alias("section", text),
    )
    heading = F.regexp_extract(F.col(text), r"^#{1,3} +([^\n]*)", 1)
    return out.withColumn("title", F.coalesce(F.nullif(strip(heading), F.lit("")), F.col(main_title)))


def split_by_details(df: DataFrame, html: str = "content", title: str = "title") -> DataFrame:
    """Long sections cut at their ``<details>`` blocks with a bold summary; others stay whole."""
    block = r"(?is)(<details>\s*<summary>[^<]*<strong>.*?</details>)"
    pieces = F.filter(
        F.split(F.regexp_replace(F.col(html), block, MARK + "$1" + MARK), MARK), lambda s: strip(s) != ""
    )
    whole = F.array(F.col(html))
    parts = F.when(
        (F.length(html) > C.DETAILS_MIN_CHARS) & (F.size(pieces) > 0) & F.rlike(F.col(html), F.lit(block)), pieces
    ).otherwise(whole)
    out = df.select(*[c for c in df.columns if c != html], F.size(parts).alias("_n"), F.posexplode(parts).alias("part", html))
    own = strip(F.regexp_replace(F.regexp_extract(F.col(html), r"(?is)^<details>\s*<summary>[^<]*<strong>(.*?)</strong>", 1), "<[^>]+>", ""))
    split = F.col("_n") > 1
    named = (
        F.when(split & (own != ""), own)
        .when(split & (F.col("part") == F.col("_n") - 1) & (F.col("part") > 0), F.lit("Summary"))
        .when(split & (F.col("part") > 0), F.concat(F.col(title), F.lit(" (Part "), F.col("part").cast("string"), F.lit(")")))
        .otherwise(F.col(title))
    )
    body = F.when(own != "", strip(F.regexp_replace(F.col(html), r"(?is)<summary>.*?</summary>|</?details>", ""))).otherwise(
        F.when(split, strip(F.col(html))).otherwise(F.col(html))
    )
    return out.withColumn("_named", named).withColumn(html, body).withColumn(title, F.col("_named")).drop("_n", "_named")


# -- fixed-size chunks ----------------------------------------------------
def chunk_fixed(
    df: DataFrame,
    text: str,
    size: int = C.CHUNK_SIZE,
    overlap: int = C.CHUNK_OVERLAP,
    tolerance: int = C.CHUNK_TOLERANCE,
) -> DataFrame:
    """Windows of ``size`` tokens that overlap; a tail within the tolerance joins the last one.

    Tokens are words between white space. Everything happens inside the row.
    """
    step = size - overlap
    if step <= 0:
        raise ValueError("the overlap must be smaller than the chunk")
    tokens = F.filter(F.split(F.col(text), r"\s+"), lambda t: t != "")
    n = F.size("_tokens")
    windows = F.when(n == 0, 0).when(n <= size + tolerance, 1).otherwise(
        F.lit(1) + F.ceil((n - (size + tolerance)) / F.lit(float(step))).cast("int")
    )
    starts = F.when(F.col("_windows") > 0, F.sequence(F.lit(0), F.col("_windows") - 1))
    out = (
        df.withColumn("_tokens", tokens)
        .withColumn("_windows", windows)
        .withColumn("chunk", F.explode(starts))
    )
    last = F.col("chunk") == F.col("_windows") - 1
    begin = F.col("chunk") * step
    length = F.when(last, n - begin).otherwise(F.lit(size))
    return (
        out.withColumn("chunk_tokens", length)
        .withColumn("chunk_text", F.array_join(F.slice("_tokens", begin + 1, length), " "))
        .drop("_tokens", "_windows", text)
    )


def _occurrences(codes: np.ndarray, piece: str) -> np.ndarray:
    """Places where a short text begins among code points."""
    n = max(0, len(codes) - len(piece) + 1)
    same = np.ones(n, bool)
    for i, ch in enumerate(piece):
        same &= codes[i : i + n] == ord(ch)
    return np.flatnonzero(same)


@dataclass(frozen=True)
class Breaks:
    """Where a text may be cut: all separators by the place behind them, and line breaks and solid characters by place."""

    behind: np.ndarray
    before: np.ndarray
    rank: np.ndarray
    lines: np.ndarray
    solid: np.ndarray

    @classmethod
    def of(cls, text: str) -> Breaks:
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        places = [_occurrences(codes, s) for s in C.CHUNK_SEPARATORS]
        before = np.concatenate(places)
        rank = np.repeat(np.arange(len(places)), [len(p) for p in places])
        behind = before + np.array([len(s) for s in C.CHUNK_SEPARATORS])[rank]
        order = np.lexsort((rank, before, behind))
        behind, before, rank = behind[order], before[order], rank[order]
        blank = np.isin(codes, np.array([ord(c) for c in C.WHITESPACE], np.uint32))
        return cls(behind, before, rank, np.flatnonzero(codes == 10), np.flatnonzero(~blank))

    def best(self, low: int, high: int) -> int | None:
        """The last place behind a separator of the best rank that lies between two places."""
        at = np.arange(np.searchsorted(self.behind, low), np.searchsorted(self.behind, high, side="right"))
        at = at[self.before[at] >= low]
        return int(self.behind[at[np.lexsort((-self.behind[at], self.rank[at]))[0]]]) if len(at) else None

    def trimmed(self, start: int, end: int) -> int:
        """``end`` without the blanks before it; ``start`` if there is nothing else."""
        k = int(np.searchsorted(self.solid, end)) - 1
        return int(self.solid[k]) + 1 if k >= 0 and self.solid[k] >= start else start

    def after_line(self, low: int, high: int) -> int:
        """Behind the first line break between two places, else the lower one."""
        k = int(np.searchsorted(self.lines, low))
        return int(self.lines[k]) + 1 if k < len(self.lines) and self.lines[k] < high else low


def smart_pieces(text: str, size: int, overlap: int, tolerance: int) -> list[str]:
    """Chunks of one text: each ends at the best break in its last part, the next starts
    after the first line break of the overlap.

    Tokens are counted in quarters (ten per CJK character, one per other), which
    is the estimate used everywhere else.
    """
    body = text.strip(C.WHITESPACE)
    codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    weight = np.append(0, np.cumsum(np.where((codes >= 0x4E00) & (codes <= 0x9FA5), 10, 1)))
    rest_fits = int(np.searchsorted(weight, weight[-1] - 4 * (size + tolerance)))  # from here on, all of it is one chunk
    if not body or not rest_fits:
        return [body] if body else []
    breaks, spans, start = Breaks.of(text), [], 0
    while start < min(rest_fits, len(text)):
        full = max(start + 1, int(np.searchsorted(weight, weight[start] + 4 * size, side="right")) - 1)
        cut = breaks.best(full - min((full - start) // C.CHUNK_TAIL_SHARE, C.CHUNK_TAIL), full)
        if cut is None or breaks.trimmed(start, cut) == start:
            cut = full
        stop = max(breaks.trimmed(start, cut), start + 1)
        spans.append((start, stop))
        back = max(start, int(np.searchsorted(weight, weight[stop] - 4 * overlap)))
        start = max(start + 1, breaks.after_line(back, stop))
    if start < len(text):
        spans.append((start, len(text)))
    return [piece for a, b in spans if (piece := text[a:b].strip(C.WHITESPACE))]


def chunk_smart(
    df: DataFrame,
    text: str,
    size: int = C.CHUNK_SIZE,
    overlap: int = C.CHUNK_OVERLAP,
    tolerance: int = C.CHUNK_TOLERANCE,
) -> DataFrame:
    """Chunks at natural breaks. Only texts over the limit are sent to Python; rows are read once."""

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else smart_pieces(t, size, overlap, tolerance))

    # otherwise Spark would run it a second time, in a filter on empty results that it puts before the explode
    cut = cut.asNondeterministic()
    body = strip(F.coalesce(F.col(text), F.lit("")))
    whole = F.filter(F.array(body), lambda b: b != "")
    fits = F.coalesce(estimate_tokens(F.col(text)) <= size + tolerance, F.lit(True))
    judged = computed(df, _long=F.when(~fits, F.col(text)))
    pieces = judged.withColumn("_cut", cut(F.col("_long")))
    return pieces.select(*[c for c in df.columns if c != text], F.posexplode(F.coalesce("_cut", whole)).alias("chunk", "chunk_text"))


def chunk_explode(chunks: DataFrame, text: str = "chunk_text", min_chars: int = C.MIN_CHUNK_CHARS) -> DataFrame:
    """Chunk rows with their parent's columns; blank and very short chunks are dropped."""
    return chunks.filter((strip(F.col(text)) != "") & (F.length(text) >= min_chars))


def drop_blocklisted(df: DataFrame, column: str, blocked: DataFrame) -> DataFrame:
    """Anti join to a list of titles."""
    return df.join(blocked.select(F.col(blocked.columns[0]).alias(column)), column, "left_anti")


def drop_passages(col: Column, passages: list[str]) -> Column:
    for passage in passages:
        col = F.replace(col, F.lit(passage), F.lit(""))
    return col
