"""Page mark-up as text: articles, titles, links and a Markdown-like form."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from noticeboard.constants import ERROR_TITLES, NAV_LABELS
from noticeboard.functions.text import once, replace_all, strip

# Named characters of HTML.
NAMED = {name: chr(code) for name, code in name2codepoint.items()} | {"apos": "'"}

# Fixed order: each rule sees what the ones before it left.
MARKDOWN_FROM_HTML: list[tuple[str, str]] = [
    (r"(?i)<br\s*/?>", "\n"),
    (r"(?is)<t[dh](?:\s[^>]*)?>(.*?)</t[dh]>", "$1\t"),
    (r"(?i)</tr>\s*<tr(?:\s[^>]*)?>", "\t"),
    (r"(?i)<tr(?:\s[^>]*)?>\s*", ""),
    (r"(?i)</tr>", "\n"),
    (r'(?is)<a\s[^>]*?href="\s*([^"]+?)\s*"[^>]*>\s*(.*?)\s*</a>', "[$2]($1)"),
    (r"(?is)<li(?:\s[^>]*)?>(?:\s|<[^>]+>)*(.*?)(?:\s|<[^>]+>)*</li>", "- $1\n"),
    (r"(?is)<p(?:\s[^>]*)?>(?:\s|<[^>]+>)*(.*?)(?:\s|<[^>]+>)*</p>", "$1\n\n"),
    (r"<[^>]+>", ""),
    (r"\r", ""),
    (r"\n{3,}", "\n\n"),
]

BOILERPLATE: list[tuple[str, str]] = [
    (r"(?s)<!--.*?-->", ""),
    (
        r"(?is)<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>|<noscript\b[^>]*>.*?</noscript>"
        r"|<nav\b[^>]*>.*?</nav>|<footer\b[^>]*>.*?</footer>|<button\b[^>]*>.*?</button>",
        "",
    ),
    (r"(?is)<a\b[^>]*>\s*(?:" + "|".join(NAV_LABELS) + r")\s*</a>", ""),
    (r"(?is)<h[1-6]\b[^>]*>\s*</h[1-6]>", ""),
]

# Classes of boxes that are not part of the text.
BOX_CLASSES = ["share-buttons", "social-share", "related-posts", "global-footer", "uhf-footer", "pagenav", "cookie-banner"]
BOX_TAGS = "div|section|aside"
BOX = rf'(?is)<(?:{BOX_TAGS})\b[^>]*class="[^"]*(?:{"|".join(BOX_CLASSES)})'

# Containers tried in order for the body of a page: opening tag and name of the element.
ARTICLE_CONTAINERS = [
    (r'(?is)<div\b[^>]*class="[^"]*entry-content[^"]*"[^>]*>', "div"),
    (r'(?is)<div\b[^>]*class="[^"]*post-content[^"]*"[^>]*>', "div"),
    (r"(?is)<main\b[^>]*>", "main"),
    (r"(?is)<article\b[^>]*>", "article"),
    (r'(?is)<div\b[^>]*id="main-content"[^>]*>', "div"),
]

H1_PATTERN = r"(?is)<h1\b[^>]*>(.*?)</h1>"
TITLE_PATTERN = r"(?is)<title\b[^>]*>(.*?)</title>"
HREF_PATTERN = r'(?i)<a\s[^>]*?href="([^"]+)"'
ROW_PATTERN = r"(?is)<tr\b[^>]*>(.*?)</tr>"
CELL_PATTERN = r"(?is)<td\b[^>]*>(.*?)</td>"


def _character(code: Column) -> Column:
    """The character of a code point, written as UTF-16 or, above the first plane, as four bytes of UTF-8."""
    parts = (F.floor(code / 262144) + 240, F.floor(code / 4096) % 64 + 128, F.floor(code / 64) % 64 + 128, code % 64 + 128)
    wide = F.decode(F.unhex(F.concat(*[F.lpad(F.hex(x.cast("long")), 2, "0") for x in parts])), "UTF-8")
    low = F.decode(F.unhex(F.lpad(F.hex(code.cast("long")), 4, "0")), "UTF-16BE")
    valid = (code > 0) & (code < 1114112) & ~code.between(55296, 57343)
    return F.when(valid & (code < 65536), low).when(valid, wide)


def _referred(name: Column) -> Column:
    """The character of a reference without ``&`` and ``;``: a name, a decimal or a hexadecimal number; NULL if unknown."""
    names = F.create_map(*[F.lit(x) for pair in NAMED.items() for x in pair])
    decimal = F.when(F.rlike(name, F.lit("^#[0-9]{1,7}$")), F.substring(name, 2, 9))
    code = F.coalesce(decimal, F.when(F.rlike(name, F.lit("^#[xX][0-9A-Fa-f]{1,6}$")), F.conv(F.substring(name, 3, 9), 16, 10)))
    return F.coalesce(_character(code.cast("int")), F.try_element_at(names, name))


def _unescape_pieces(col: Column) -> Column:
    """Every reference by itself, from left to right."""

    def piece(part: Column) -> Column:
        name = F.regexp_extract(part, r"^(#?[A-Za-z0-9]+);", 1)
        char = _referred(name)
        rest = F.substring(part, F.length(name) + F.lit(2), F.length(part))
        return F.when(char.isNotNull(), F.concat(char, rest)).otherwise(F.concat(F.lit("&"), part))

    parts = F.split(col, "&")
    return F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(F.slice(parts, F.lit(2), F.size(parts)), piece), ""))


def unescape(col: Column) -> Column:
    """Character references as characters, once each: names, decimal and hexadecimal numbers. Unknown ones stay.

    A page has few distinct references, so each is looked up once and replaced everywhere, ``&amp;`` last. That
    is the same as going from left to right unless one stands for a character that may be part of
    another; such pages go the long way.
    """


    def known(text: Column) -> Column:
        found = F.array_distinct(F.regexp_extract_all(text, F.lit(r"&(#?[A-Za-z0-9]+);"), F.lit(1)))
        return F.filter(F.transform(found, lambda n: F.struct(n.alias("name"), _referred(n).alias("char"))), lambda x: x["char"].isNotNull())

    def replaced(start: Column, refs: Column) -> Column:
        alone = F.forall(refs, lambda x: (x["name"] == "amp") | ~F.rlike(x["char"], F.lit("^[A-Za-z0-9#;&]$")))
        last = F.concat(F.filter(refs, lambda x: x["name"] != "amp"), F.filter(refs, lambda x: x["name"] == "amp"))
        text = F.aggregate(last, start, lambda t, x: F.replace(t, F.concat(F.lit("&"), x["name"], F.lit(";")), x["char"]))
        return F.when(alone, text).otherwise(_unescape_pieces(start))

    return once(col, lambda t: F.when(F.contains(t, F.lit("&")), once(known(t), lambda refs: replaced(t, refs))).otherwise(t))


def inner(col: Column, opening: str, tag: str) -> Column:
    """What stands between the first opening tag that matches and its own closing tag; NULL without one.

    The rest of the page is cut in front of every tag of that name, and the cuts
    are walked until the depth is back at zero. An element that is never closed
    reaches to the end.
    """
    place = F.regexp_instr(col, F.lit(opening))

    def step(acc: Column, x: Column) -> Column:
        depth = acc["depth"] + F.when(F.rlike(x, F.lit(rf"(?i)^</{tag}\b")), -1).when(F.rlike(x, F.lit(rf"(?i)^<{tag}\b")), 1).otherwise(0)
        walked = F.struct(depth.alias("depth"), (acc["n"] + F.when(depth > 0, 1).otherwise(0)).alias("n"))
        return F.when(acc["depth"] > 0, walked).otherwise(acc)

    def body(at: Column) -> Column:
        rest = F.substring(col, at + F.length(F.regexp_extract(col, opening, 0)), F.length(col))
        return once(F.split(rest, rf"(?i)(?=</?{tag}\b)"), walked_text)

    def walked_text(cuts: Column) -> Column:
        kept = F.aggregate(cuts, F.struct(F.lit(1).alias("depth"), F.lit(0).alias("n")), step)["n"]
        return F.array_join(F.slice(cuts, F.lit(1), kept), "")

    return once(place, lambda at: F.when(at > 0, body(at)))


def drop_boxes(col: Column) -> Column:
    """The page without boxes of the fixed classes, whatever is nested in them. A box that is never closed reaches to the end."""
    return once(col, _without_boxes)


def _without_boxes(col: Column) -> Column:
    cuts = F.split(col, rf"(?i)(?=</?(?:{BOX_TAGS})\b)")

    def step(acc: Column, x: Column) -> Column:
        opens, closes = F.rlike(x, F.lit(rf"(?i)^<(?:{BOX_TAGS})\b")), F.rlike(x, F.lit(rf"(?i)^</(?:{BOX_TAGS})\b"))
        inside = acc["depth"] > 0
        within = acc["depth"] + F.when(opens, 1).when(closes, -1).otherwise(0)
        depth = F.when(inside, within).when(opens & F.rlike(x, F.lit(BOX)), 1).otherwise(0)
        after = F.when(inside & (depth == 0), F.regexp_replace(x, r"(?s)^[^>]*>", ""))
        part = F.when(depth > 0, F.lit("")).otherwise(F.coalesce(after, x))
        return F.struct(depth.alias("depth"), F.concat(acc["out"], F.array(part)).alias("out"))

    start = F.struct(F.lit(0).alias("depth"), F.array().cast("array<string>").alias("out"))
    return F.when(F.rlike(col, F.lit(BOX)), F.array_join(F.aggregate(cuts, start, step)["out"], "")).otherwise(col)


def html_to_markdown(col: Column) -> Column:
    return strip(replace_all(unescape(F.coalesce(col, F.lit(""))), MARKDOWN_FROM_HTML))


def strip_boilerplate(col: Column) -> Column:
    return replace_all(drop_boxes(replace_all(col, BOILERPLATE[:2])), BOILERPLATE[2:])


def first_group(col: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(col, pattern, 1), F.lit(""))


def extract_article(col: Column) -> Column:
    """The first container that is there and not empty; the page itself is made once for all of them."""

    def first(page: Column) -> Column:
        return F.coalesce(*[once(inner(page, opening, tag), lambda x: F.when(x != "", x)) for opening, tag in ARTICLE_CONTAINERS])

    return once(col, first)


def tag_text(col: Column) -> Column:
    return strip(F.regexp_replace(col, "<[^>]+>", ""))


def extract_title(col: Column, suffix: str = "", blocklist: list[str] | None = None) -> Column:
    """First h1, else the page title, else a fixed text; NULL for error pages.

    ``suffix`` is the fixed end that a site gives its titles; only there it is cut.
    """
    title = F.coalesce(
        F.nullif(tag_text(first_group(col, H1_PATTERN)), F.lit("")),
        F.nullif(tag_text(first_group(col, TITLE_PATTERN)), F.lit("")),
        F.lit("No Title"),
    )
    if suffix:
        title = F.when(F.endswith(title, F.lit(suffix)), F.left(title, F.length(title) - len(suffix))).otherwise(title)
    for bad in ERROR_TITLES if blocklist is None else blocklist:
        title = F.when(~F.contains(title, F.lit(bad)), title)
    return title


def base_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^(https?://[^/?#]+)", 1)


def absolute_link(href: Column, url: Column) -> Column:
    """The address that a link of a page leads to: whole ones, ``//host/...``, ``/...``, ``?...``, ``#...`` and those
    relative to the folder of the page, with ``.`` and ``..`` resolved."""
    base, page = base_of(url), F.regexp_extract(url, r"^([^?#]*)", 1)
    scheme = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    path = F.substring(page, F.length(base) + F.lit(1), F.length(page))
    folder = F.regexp_replace(path, r"[^/]*$", "")
    parts = F.split(F.regexp_replace(F.regexp_extract(href, r"^([^?#]*)", 1), r"^/", ""), "/")
    relative = F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), F.array_join(parts, "/"))

    def resolve(path: Column) -> Column:
        steps = F.slice(F.split(path, "/"), 2, F.size(F.split(path, "/")))
        last = F.element_at(steps, -1)
        start = F.array().cast("array<string>")
        up = lambda acc: F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
        walk = lambda acc, x: F.when(x == "..", up(acc)).when(x == ".", acc).otherwise(F.concat(acc, F.array(x)))
        kept = F.aggregate(steps, start, walk)
        end = F.when(last.isin(".", "..") & (F.size(kept) > 0), F.lit("/")).otherwise(F.lit(""))
        return F.concat(F.lit("/"), F.array_join(kept, "/"), end)

    tail = F.regexp_extract(href, r"([?#].*)$", 1)
    return (
        F.when(F.rlike(href, F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*:")), href)
        .when(F.startswith(href, F.lit("//")), F.concat(scheme, href))
        .when(F.startswith(href, F.lit("/")), F.concat(base, href))
        .when((href == "") | F.startswith(href, F.lit("#")), F.concat(page, href))
        .when(F.startswith(href, F.lit("?")), F.concat(page, href))
        .otherwise(F.concat(base, resolve(relative), tail))
    )


def extract_links(html: Column, url: Column, include: str = "", exclude: str | None = None) -> Column:
    links = F.transform(
        F.regexp_extract_all(html, F.lit(HREF_PATTERN), F.lit(1)), lambda h: absolute_link(h, url)
    )
    if include:
        links = F.filter(links, lambda h: F.rlike(h, F.lit(include)))
    if exclude:
        links = F.filter(links, lambda h: ~F.rlike(h, F.lit(exclude)))
    return F.array_distinct(links)


def canonical_link(url: Column) -> Column:
    return F.split_part(url, F.lit("#"), F.lit(1))


def table_rows(html: Column) -> Column:
    """Cells of every table row that has exactly three, as array<array<string>>."""
    rows = F.transform(
        F.regexp_extract_all(html, F.lit(ROW_PATTERN), F.lit(1)),
        lambda r: F.regexp_extract_all(r, F.lit(CELL_PATTERN), F.lit(1)),
    )
    return F.filter(rows, lambda cells: F.size(cells) == 3)
