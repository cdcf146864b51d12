"""Cleaning, page mark-up, dates, sections and chunks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from checks.registry import query
from checks.views import (
    AS_OF,
    corpus,
    joined,
    markdown_docs,
    quote,
    sql_chars,
    sql_clean,
    sql_rules,
    sql_strip,
    sql_tokens,
    table,
    view,
    with_views,
)
from noticeboard import constants as C
from noticeboard.functions import dates, html, text
from noticeboard.operators import chunking, vector
from noticeboard.plans.sync import enrich
from noticeboard.session import materialise

NL = "chr(10)"
MONTHS = ", ".join(f"'{m.lower()}': '{i:02d}'" for i, m in enumerate(C.MONTH_NAMES, 1))


# -- documents ------------------------------------------------------------
@query("c1_clean_content", with_views(["markdown_docs"], f"SELECT id, {sql_clean('content')} AS cleaned FROM markdown_docs"))
def c1(spark, d):
    return markdown_docs(spark, d).select("id", text.clean_content(F.col("content")).alias("cleaned"))


@query(
    "c2_enrich",
    with_views(
        ["markdown_docs"],
        f"""SELECT id, CASE WHEN contains(ym, '-') THEN split_part(ym, '-', 1) ELSE substr(ym, 1, 4) END AS year,
  {sql_clean("content")} AS cleaned_content, {sql_tokens("content")} AS token, '2025-12-16-00-00' AS update_time
FROM (SELECT *, CASE WHEN CAST(id AS BIGINT) % 3 = 0 THEN '202311' ELSE '2024-05' END AS ym FROM markdown_docs)""",
    ),
)
def c2(spark, d):
    docs = markdown_docs(spark, d).withColumn(
        "year_month", F.when(F.col("id").cast("long") % 3 == 0, "202311").otherwise("2024-05")
    )
    return enrich(docs, "2025-12-16-00-00").select("id", "year", "cleaned_content", "token", "update_time")


@query("c25_estimate_tokens", f"SELECT doc_id, {sql_tokens('text')} AS token FROM documents")
def c25(spark, d):
    return table(spark, d, "documents").select("doc_id", text.estimate_tokens(F.col("text")).alias("token"))


@query(
    "c27_embedding_text",
    f"""SELECT doc_id, replace(text, chr(10), ' ') AS plain, translate(text, {sql_chars(C.RETRY_STRIPPED_CHARS)}, '') AS retry FROM documents""",
)
def c27(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", text.embedding_text(F.col("text")).alias("plain"), text.embedding_retry_text(F.col("text")).alias("retry")
    )


# -- pages ----------------------------------------------------------------
def sql_unescape(expr: str) -> str:
    """Named references in any order, ``&amp;`` last."""
    for name, char in [(n, c) for n, c in html.NAMED.items() if n != "amp"] + [("amp", "&")]:
        expr = f"replace({expr}, {quote(f'&{name};')}, {sql_chars(char)})"
    return expr


# The given pages have one article each and no other container.
SQL_ARTICLE = "nullif(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '')"


def sql_markdown(expr: str) -> str:
    return sql_strip(sql_rules(sql_unescape(f"coalesce({expr}, '')"), html.MARKDOWN_FROM_HTML))


@query("c3_html_to_markdown", f"SELECT page_id, {sql_markdown(SQL_ARTICLE)} AS markdown FROM pages")
def c3(spark, d):
    return table(spark, d, "pages").select("page_id", html.html_to_markdown(html.extract_article(F.col("html"))).alias("markdown"))


@query("c4_strip_boilerplate", f"SELECT page_id, {sql_rules('html', html.BOILERPLATE)} AS html FROM pages")
def c4(spark, d):
    return table(spark, d, "pages").select("page_id", html.strip_boilerplate(F.col("html")).alias("html"))


@query("c5_extract_article", f"SELECT page_id, {SQL_ARTICLE} AS article FROM pages")
def c5(spark, d):
    return table(spark, d, "pages").select("page_id", html.extract_article(F.col("html")).alias("article"))


# Pages built from parts, so that the SQL knows the answer without looking for tags.
view("nested", [], "SELECT page_id, regexp_replace(html, '<[^>]*>|&', ' ', 'g') AS t, page_id % 3 AS kind FROM pages")


def nested(spark, d):
    plain = F.regexp_replace("html", "<[^>]*>|&", " ")
    return table(spark, d, "pages").select("page_id", plain.alias("t"), (F.col("page_id") % 3).alias("kind"))


@query(
    "c4_nested_boxes",
    with_views(["nested"], "SELECT page_id, '<div>' || t || '</div>' || CASE WHEN kind = 0 THEN '' ELSE '<p>' || t || '</p>' END || '<section>end</section>' AS html FROM nested"),
)
def c4_nested(spark, d):
    box = '<div id="x" class="a share-buttons b"><div><aside>one</aside></div><div class="c">two</div></div>'
    text = F.when(F.col("kind") == 0, F.lit("")).otherwise(F.concat(F.lit("<p>"), "t", F.lit("</p>")))
    page = F.concat(F.lit("<div>"), "t", F.lit("</div>" + box), text, F.lit("<section>end</section>" + box.replace("share-buttons", "uhf-footer")))
    return nested(spark, d).select("page_id", html.strip_boilerplate(page).alias("html"))


@query(
    "c5_nested_article",
    with_views(["nested"], "SELECT page_id, '<div class=\"a\"><div>' || t || '</div></div><p>two</p>' AS article FROM nested"),
)
def c5_nested(spark, d):
    start = F.when(F.col("kind") == 0, '<div class="entry-content x">').when(F.col("kind") == 1, '<DIV class="post-content">').otherwise("<main>")
    end = F.when(F.col("kind") == 2, "</main>").otherwise("</div>")
    page = F.concat(F.lit("<div><div>head</div></div>"), start, F.lit('<div class="a"><div>'), "t", F.lit("</div></div><p>two</p>"), end, F.lit("<div>tail</div></main></div>"))
    return nested(spark, d).select("page_id", html.extract_article(page).alias("article"))


@query(
    "c3_character_references",
    with_views(["nested"], "SELECT page_id, t || '’ — é & &lt; &nope; AB😀' || chr(160) || 'x' || page_id AS text FROM nested"),
)
def c3_references(spark, d):
    said = F.concat("t", F.lit("&#8217; &mdash; &eacute; &amp; &amp;lt; &nope; &#65;&#x42;&#128512;&nbsp;x"), "page_id")
    return nested(spark, d).select("page_id", html.unescape(said).alias("text"))


def sql_tag_text(expr: str) -> str:
    return sql_strip(f"regexp_replace({expr}, '<[^>]+>', '', 'g')")


SQL_TITLE = (
    f"coalesce(nullif({sql_tag_text(f'regexp_extract(html, {quote(html.H1_PATTERN)}, 1)')}, ''), "
    f"nullif({sql_tag_text(f'regexp_extract(html, {quote(html.TITLE_PATTERN)}, 1)')}, ''), 'No Title')"
)
SQL_BAD_TITLE = " OR ".join(f"contains(t, {quote(b)})" for b in C.ERROR_TITLES)


@query("c6_extract_title", f"SELECT page_id, CASE WHEN {SQL_BAD_TITLE} THEN NULL ELSE t END AS title FROM (SELECT page_id, {SQL_TITLE} AS t FROM pages)")
def c6(spark, d):
    return table(spark, d, "pages").select("page_id", html.extract_title(F.col("html")).alias("title"))


@query(
    "c7_extract_links",
    f"""SELECT page_id, pos, link FROM (
  SELECT page_id, link, row_number() OVER (PARTITION BY page_id ORDER BY min(n)) - 1 AS pos FROM (
    SELECT page_id, n, CASE WHEN starts_with(h, 'http') THEN h WHEN starts_with(h, '/') THEN base || h ELSE base || '/' || h END AS link
    FROM (SELECT page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS base, unnest(hrefs) AS h, generate_subscripts(hrefs, 1) AS n
      FROM (SELECT *, regexp_extract_all(html, {quote(html.HREF_PATTERN)}, 1) AS hrefs FROM pages)))
  WHERE NOT regexp_matches(link, '[,.]$') GROUP BY page_id, link)""",
)
def c7(spark, d):
    links = html.extract_links(F.col("html"), F.col("url"), exclude="[,.]$")
    return table(spark, d, "pages").select("page_id", F.posexplode(links).alias("pos", "link"))


@query(
    "c8_canonical_link",
    "SELECT page_id, split_part(url, '#', 1) AS link, split_part(url, '#', 1) || '#s' || page_id AS heading_link FROM pages",
)
def c8(spark, d):
    link = html.canonical_link(F.col("url"))
    return table(spark, d, "pages").select("page_id", link.alias("link"), F.concat(link, F.lit("#s"), F.col("page_id").cast("string")).alias("heading_link"))


@query(
    "c9_url_year_month",
    r"""SELECT page_id, CASE WHEN regexp_matches(u, '/[0-9]{4}/[0-9]{2}/') THEN replace(regexp_extract(u, '/([0-9]{4}/[0-9]{2})/', 1), '/', '-') ELSE 'latest' END AS year_month
FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url || '/blog/2025/' || lpad(CAST(page_id % 12 + 1 AS VARCHAR), 2, '0') || '/' ELSE url END AS u FROM pages)""",
)
def c9(spark, d):
    i = F.col("page_id")
    tail = F.concat(F.col("url"), F.lit("/blog/2025/"), F.lpad((i % 12 + 1).cast("string"), 2, "0"), F.lit("/"))
    url = F.when(i % 2 == 0, tail).otherwise(F.col("url"))
    return table(spark, d, "pages").select("page_id", dates.url_year_month(url, "latest").alias("year_month"))


# -- dates ----------------------------------------------------------------
@query(
    "c10_smart_date",
    f"""SELECT o_orderkey, coalesce(strftime(coalesce(try_strptime(t, '%Y-%m-%d'), try_strptime(t, '%Y/%m/%d'), try_strptime(t, '%d %B %Y'),
    try_strptime(t, '%B %d, %Y'), try_strptime(t, '%Y 年 %m 月 %d 日')), '%Y-%m'),
  CASE WHEN u <> '' THEN substr(u, 2, 4) || '-' || MAP {{{MONTHS}}}[lower(substr(u, 7))] END, '{AS_OF[:7]}') AS year_month
FROM (SELECT o_orderkey,
  CASE o_orderkey % 7 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y/%m/%d')
    WHEN 2 THEN strftime(o_orderdate, '%-d %B %Y') WHEN 3 THEN strftime(o_orderdate, '%B %-d, %Y')
    WHEN 4 THEN strftime(o_orderdate, '%Y 年 %-m 月 %-d 日') ELSE 'soon' END AS t,
  CASE WHEN o_orderkey % 7 = 5 THEN regexp_extract('/news/' || strftime(o_orderdate, '%Y-%B') || '/x', '/[0-9]{{4}}-[a-zA-Z]+', 0) ELSE '' END AS u FROM orders)""",
)
def c10(spark, d):
    k, day = F.col("o_orderkey") % 7, F.col("o_orderdate")
    said = (
        F.when(k == 0, F.date_format(day, "yyyy-MM-dd")).when(k == 1, F.date_format(day, "yyyy/MM/dd"))
        .when(k == 2, F.date_format(day, "d MMMM yyyy")).when(k == 3, F.date_format(day, "MMMM d, yyyy"))
        .when(k == 4, F.date_format(day, "yyyy 年 M 月 d 日")).otherwise(F.lit("soon"))
    )
    url = F.when(k == 5, F.concat(F.lit("/news/"), F.date_format(day, "yyyy-MMMM"), F.lit("/x"))).otherwise(F.lit(""))
    return table(spark, d, "orders").select("o_orderkey", dates.smart_date(said, url, AS_OF).alias("year_month"))


@query(
    "c11_latest_mentioned_month",
    f"""SELECT o_orderkey, coalesce(max(ym) FILTER (WHERE m BETWEEN 1 AND 12 AND ym <= '1996-06'), '') AS year_month FROM (
  SELECT o_orderkey, m, y || '-' || lpad(CAST(m AS VARCHAR), 2, '0') AS ym FROM (
    SELECT o.o_orderkey, p.y, CAST(p.m AS INTEGER) AS m FROM orders o LEFT JOIN (
      SELECT l_orderkey, strftime(l_shipdate, '%Y') AS y, strftime(l_shipdate, '%-m') AS m FROM lineitem
      UNION ALL SELECT o_orderkey, strftime(o_orderdate, '%Y'), '13' FROM orders) p ON p.l_orderkey = o.o_orderkey)) GROUP BY o_orderkey""",
)
def c11(spark, d):
    """Texts that name the ship months of an order in both spellings, and a month 13."""
    day = F.col("l_shipdate")
    said = F.when(F.col("l_linenumber") % 2 == 0, F.date_format(day, "yyyy-M")).otherwise(F.date_format(day, "yyyy 年 M 月"))
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_join(F.collect_list(said), " und ").alias("said"))
    docs = table(spark, d, "orders").join(lines, "o_orderkey", "left")
    body = F.concat_ws(" ", F.col("said"), F.date_format("o_orderdate", "yyyy-13"))
    return docs.select("o_orderkey", dates.latest_mentioned_month(body, "1996-06-30").alias("year_month"))


@query(
    "c12_parse_cy_month",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 3 THEN strftime(o_orderdate, '%Y-%m') END AS month FROM orders""",
)
def c12(spark, d):
    k = F.col("o_orderkey")
    said = F.when(k % 4 != 3, F.concat(F.lit(" "), F.date_format("o_orderdate", "MMMM"), F.lit(" CY"), F.date_format("o_orderdate", "yyyy"))).otherwise(
        F.date_format("o_orderdate", "MMM yyyy")
    )
    return table(spark, d, "orders").select("o_orderkey", dates.parse_cy_month(said).alias("month"))


@query(
    "c13_iso_month",
    """SELECT event_id, CASE WHEN event_type = 'error' THEN strftime(ts, '%Y-') ELSE strftime(ts, '%Y-%m') END AS month,
  CASE WHEN event_type = 'error' THEN strftime(ts, '%Y-') ELSE strftime(ts, '%Y-%m-%d') END AS day FROM events""",
)
def c13(spark, d):
    # An offset does not move the date that is written.
    offset = F.when(F.col("event_id") % 3 == 0, "Z").when(F.col("event_id") % 3 == 1, "-05:00").otherwise("+14:00")
    ok = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), offset)
    said = F.when(F.col("event_type") == "error", F.concat(F.date_format("ts", "yyyy-"), F.lit("about"))).otherwise(ok)
    return table(spark, d, "events").select("event_id", dates.iso_month(said).alias("month"), dates.iso_date(said).alias("day"))


# -- listing items --------------------------------------------------------
def nested_parts(spark, d):
    tag = lambda c: F.struct(c.alias("tagName"))
    products = F.array(tag(F.col("p_brand")), tag(F.lit("")), tag(F.col("p_type")), tag(F.lit(None).cast("string")))
    return table(spark, d, "part").select(
        "p_partkey", "p_name", "p_brand", "p_size",
        F.struct(F.when(F.col("p_size") > 5, products).alias("products")).alias("tagsContainer"),
    )


@query("c14_flatten_tags", "SELECT p_partkey, CASE WHEN p_size > 5 THEN p_brand || '|' || p_type ELSE '' END AS tags FROM part")
def c14(spark, d):
    return nested_parts(spark, d).select("p_partkey", joined(chunking.tag_names(F.col("tagsContainer.products"))).alias("tags"))


@query(
    "c15_compose_content",
    """SELECT p_partkey, trim(concat_ws(chr(10), nullif(trim(p_name), ''), CASE WHEN p_size % 2 = 0 THEN 'Status: ' || p_type END,
  CASE WHEN p_size > 5 THEN 'Products: ' || p_brand || ', ' || p_type END, 'More info: https://parts.example/' || p_partkey)) AS content FROM part""",
)
def c15(spark, d):
    items = nested_parts(spark, d).join(table(spark, d, "part").select("p_partkey", "p_type"), "p_partkey")
    content = chunking.compose_content(
        F.col("p_name"),
        [
            ("Status", F.when(F.col("p_size") % 2 == 0, F.col("p_type"))),
            ("Products", F.array_join(chunking.tag_names(F.col("tagsContainer.products")), ", ")),
            ("More info", F.concat(F.lit("https://parts.example/"), F.col("p_partkey").cast("string"))),
        ],
    )
    return items.select("p_partkey", content.alias("content"))


def order_items(spark, d):
    status = F.when(F.col("o_orderstatus") == "F", " Launched ").when(F.col("o_orderstatus") == "O", "In Development").otherwise("paused")
    cy = F.concat(F.date_format("o_orderdate", "MMMM"), F.lit(" CY"), F.date_format("o_orderdate", "yyyy"))
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(
        "o_orderkey", status.alias("status"),
        F.when(k % 3 == 0, cy).otherwise(F.lit("")).alias("preview"),
        F.when(k % 3 == 1, cy).otherwise(F.lit("later")).alias("rollout"),
        F.concat(F.col("o_orderpriority"), F.lit(" "), k.cast("string")).alias("title"),
    )


@query(
    "c16_route_status",
    "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'launched' ELSE 'in_development' END AS bucket FROM orders WHERE o_orderstatus IN ('F', 'O')",
)
def c16(spark, d):
    return chunking.route_status(order_items(spark, d), "status").select("o_orderkey", "bucket")


@query(
    "c17_group_by_month",
    """SELECT o_orderkey, month_key, title, row_number() OVER (ORDER BY month_key = 'unknown', month_key, preview, title) - 1 AS position FROM (
  SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN strftime(o_orderdate, '%Y-%m') ELSE 'unknown' END AS month_key,
    CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%B CY%Y') ELSE '' END AS preview, o_orderpriority || ' ' || o_orderkey AS title FROM orders)""",
)
def c17(spark, d):
    """The order is the feature: rows are numbered as they come out, partition after partition."""
    out = chunking.group_by_month(order_items(spark, d), "preview", "rollout", "title").select("o_orderkey", "month_key", "title")
    out = materialise(out.withColumn("at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("at", 33).alias("part")
    sizes = out.groupBy(part).agg(F.count("*").alias("n"))  # one row per partition
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begins = sizes.select("part", before.alias("begin"))
    numbered = out.withColumn("part", part).join(F.broadcast(begins), "part")
    return numbered.select("o_orderkey", "month_key", "title", (F.col("begin") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).alias("position"))


# -- sections and chunks --------------------------------------------------
@query(
    "c18_split_by_headings",
    with_views(
        ["markdown_docs"],
        f"""SELECT id, section, content, coalesce(nullif({sql_strip("regexp_extract(content, '^#{1,3} +([^\\n]*)', 1)")}, ''), main_title) AS title FROM (
  SELECT id, main_title, row_number() OVER (PARTITION BY id ORDER BY s) - 1 AS section, content FROM (
    SELECT id, main_title, s, {sql_strip(f"string_agg(line, {NL} ORDER BY n)")} AS content FROM (
      SELECT *, sum(is_head) OVER (PARTITION BY id ORDER BY n) AS s FROM (
        SELECT *, CASE WHEN fences % 2 = 0 AND regexp_matches(line, '^[ \\t]*#{{1,3}} ') THEN 1 ELSE 0 END AS is_head FROM (
          SELECT *, sum(CASE WHEN regexp_matches(line, '^[ \\t]*```') THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY n) AS fences FROM (
            SELECT id, main_title, unnest(lines) AS line, generate_subscripts(lines, 1) AS n FROM (
              SELECT id, main_title, string_split(CASE WHEN starts_with(b, '#') THEN b ELSE '# ' || main_title || chr(10) || chr(10) || b END, {NL}) AS lines
              FROM (SELECT id, main_title, {sql_strip("content")} AS b FROM markdown_docs)))))) GROUP BY id, main_title, s)
  WHERE regexp_replace(content, '[#\\s]+', '', 'g') <> '')""",
    ),
)
def c18(spark, d):
    return chunking.split_by_headings(markdown_docs(spark, d)).select("id", "section", "content", "title")


def page_details(spark, d):
    """Articles wrapped in two detail blocks with text before, between and after."""
    article = html.extract_article(F.col("html"))
    block = lambda n: F.concat(F.lit(f"<details><summary><strong>Issue {n}</strong></summary>"), article, F.lit("</details>"))
    return table(spark, d, "pages").select(
        "page_id", F.lit("Known issues").alias("title"),
        F.concat(F.lit("<p>intro</p>"), block(1), F.lit("<p>between</p>"), block(2), F.lit("<p>end</p>")).alias("content"),
    )


@query(
    "c19_split_by_details",
    f"""SELECT page_id, part, CASE WHEN NOT long THEN 'Known issues' WHEN part = 0 THEN 'Known issues' WHEN part = 1 THEN 'Issue 1' WHEN part = 2 THEN 'Known issues (Part 2)'
    WHEN part = 3 THEN 'Issue 2' ELSE 'Summary' END AS title,
  CASE WHEN NOT long THEN whole WHEN part = 0 THEN '<p>intro</p>' WHEN part = 2 THEN '<p>between</p>' WHEN part = 4 THEN '<p>end</p>' ELSE {sql_strip("a")} END AS content
FROM (SELECT *, length(whole) > 3000 AS long FROM (SELECT page_id, a,
    '<p>intro</p><details><summary><strong>Issue 1</strong></summary>' || a || '</details><p>between</p><details><summary><strong>Issue 2</strong></summary>' || a || '</details><p>end</p>' AS whole
    FROM (SELECT page_id, {SQL_ARTICLE} AS a FROM pages))), unnest(range(0, 5)) AS p(part) WHERE long OR part = 0""",
)
def c19(spark, d):
    return chunking.split_by_details(page_details(spark, d)).select("page_id", "part", "title", "content")


@query(
    "c20_table_to_rows",
    """SELECT o_orderkey, 'desk ' || o_orderstatus AS workspace, o_orderpriority AS title, 'https://list.example/o/' || o_orderkey AS link,
  strftime(o_orderdate, '%Y-%m-%d') AS date_text FROM orders""",
)
def c20(spark, d):
    cell = lambda c: F.concat(F.lit("<td class='x'>"), c, F.lit("</td>"))
    key = F.col("o_orderkey").cast("string")
    row = F.concat(
        F.lit("<table><tr><th>a</th></tr><tr>"),
        cell(F.concat(F.lit(" desk "), F.col("o_orderstatus"))),
        cell(F.concat(F.lit('<a href="/o/'), key, F.lit('">'), F.col("o_orderpriority"), F.lit("</a>"))),
        cell(F.date_format("o_orderdate", "yyyy-MM-dd")),
        F.lit("</tr><tr><td>only one</td></tr></table>"),
    )
    rows = table(spark, d, "orders").select("o_orderkey", F.explode(html.table_rows(row)).alias("c"))
    href = F.regexp_extract(F.col("c")[1], html.HREF_PATTERN, 1)
    return rows.select(
        "o_orderkey",
        html.tag_text(F.col("c")[0]).alias("workspace"),
        html.tag_text(F.col("c")[1]).alias("title"),
        html.absolute_link(href, F.lit("https://list.example/index")).alias("link"),
        html.tag_text(F.col("c")[2]).alias("date_text"),
    )


@query(
    "c21_match_heading",
    """SELECT page, title_id, heading_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY title_id ORDER BY score DESC, heading_id) AS rn FROM (
    SELECT CAST(t.label AS BIGINT) AS page, t.vec_id AS title_id, h.vec_id AS heading_id,
      round(list_cosine_similarity(CAST(t.embedding AS DOUBLE[]), CAST(h.embedding AS DOUBLE[])), 6) AS score
    FROM embeddings t JOIN (SELECT label, min(vec_id) AS vec_id FROM embeddings GROUP BY label) f ON t.vec_id = f.vec_id
    JOIN embeddings h ON h.label = t.label AND h.vec_id <> t.vec_id)) WHERE rn = 1 AND score > 0.25""",
)
def c21(spark, d):
    """Each label is a page; its first vector is the title and the others are headings."""
    emb = table(spark, d, "embeddings").select(
        F.col("label").cast("long").alias("page"), "vec_id", F.col("embedding").cast("array<double>").alias("vector")
    )
    first = emb.groupBy("page").agg(F.min("vec_id").alias("vec_id"))
    titles = emb.join(first.select("vec_id"), "vec_id", "left_semi").withColumnRenamed("vec_id", "title_id")
    headings = emb.join(first.select("vec_id"), "vec_id", "left_anti").withColumnRenamed("vec_id", "heading_id")
    return vector.match_heading(titles, headings, 0.25).select("page", "title_id", "heading_id", "score")


SIZE, OVERLAP, TOLERANCE = 100, 20, 15
view(
    "token_lists",
    [],
    f"""SELECT doc_id, t, len(t) AS n, CASE WHEN len(t) = 0 THEN 0 WHEN len(t) <= {SIZE + TOLERANCE} THEN 1
  ELSE 1 + CAST(ceil((len(t) - {SIZE + TOLERANCE}) / {float(SIZE - OVERLAP)}) AS BIGINT) END AS windows
FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS t FROM documents)""",
)
view(
    "chunks",
    ["token_lists"],
    f"""SELECT doc_id, chunk, CASE WHEN chunk = windows - 1 THEN n - chunk * {SIZE - OVERLAP} ELSE {SIZE} END AS chunk_tokens,
  array_to_string(t[chunk * {SIZE - OVERLAP} + 1 : CASE WHEN chunk = windows - 1 THEN n ELSE chunk * {SIZE - OVERLAP} + {SIZE} END], ' ') AS chunk_text
FROM (SELECT *, unnest(range(0, windows)) AS chunk FROM token_lists)""",
)


def fixed_chunks(spark, d):
    return chunking.chunk_fixed(table(spark, d, "documents").select("doc_id", "text"), "text", SIZE, OVERLAP, TOLERANCE)


@query("c22_chunk_fixed", with_views(["chunks"], "SELECT * FROM chunks"))
def c22(spark, d):
    return fixed_chunks(spark, d).select("doc_id", "chunk", "chunk_tokens", "chunk_text")


# The given texts have no CJK characters, so a token is four characters and the
# limits below are in characters: 800 per chunk, 160 of overlap, 100 of tolerance.
SMART_CUT = "coalesce(" + ", ".join(
    f"CASE WHEN strpos(reverse(tail), reverse({sql_chars(s)})) > 0 THEN 600 + length(tail) - strpos(reverse(tail), reverse({sql_chars(s)})) + 1 END"
    for s in C.CHUNK_SEPARATORS
) + ", 800)"


def sql_piece(source: str) -> str:
    """One step from ``source`` with doc_id, text, step and start: the chunk and the next start."""
    white = sql_chars(C.WHITESPACE)
    return f"""SELECT doc_id, text, step, start, CASE WHEN last THEN {sql_strip("substr(text, start + 1)")} ELSE {sql_strip("solid")} END AS piece,
  CASE WHEN last THEN length(text) ELSE greatest(start + 1, CASE WHEN lb = 0 THEN back ELSE back + lb END) END AS next FROM (
    SELECT *, strpos(substr(text, back + 1, stop - back), chr(10)) AS lb FROM (
      SELECT *, greatest(start, stop - 160) AS back FROM (
        SELECT *, start + greatest(length(solid), 1) AS stop FROM (
          SELECT *, rtrim(substr(text, start + 1, CASE WHEN {sql_strip("substr(text, start + 1, cut)")} = '' THEN 800 ELSE cut END), {white}) AS solid FROM (
            SELECT *, {SMART_CUT} AS cut FROM (
              SELECT doc_id, text, step, start, length(text) - start <= 900 AS last, substr(text, start + 601, 200) AS tail FROM {source}))))))"""


view(
    "smart",
    [],
    f"""SELECT * FROM ({sql_piece(f"(SELECT doc_id, text, 0 AS step, CAST(0 AS BIGINT) AS start FROM documents WHERE {sql_strip('text')} <> '')")})
UNION ALL {sql_piece("(SELECT doc_id, text, step + 1 AS step, next AS start FROM smart WHERE next < length(text))")}""",
)


@query(
    "c23_chunk_smart",
    with_views(["smart"], "SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY step) - 1 AS chunk, piece AS chunk_text FROM smart WHERE piece <> ''"),
)
def c23(spark, d):
    out = chunking.chunk_smart(table(spark, d, "documents").select("doc_id", "text"), "text", 200, 40, 25)
    return out.select("doc_id", "chunk", "chunk_text")


@query("c24_chunk_explode", with_views(["chunks"], "SELECT c.doc_id, d.source, c.chunk, c.chunk_text FROM chunks c JOIN documents d USING (doc_id) WHERE length(c.chunk_text) >= 30"))
def c24(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    chunks = chunking.chunk_fixed(docs, "text", SIZE, OVERLAP, TOLERANCE)
    return chunking.chunk_explode(chunks).select("doc_id", "source", "chunk", "chunk_text")


@query(
    "c26_drop_blocklisted",
    f"""SELECT page_id, title, replace(article, '</p><p>', '') AS body FROM (SELECT page_id, {SQL_TITLE} AS title, {SQL_ARTICLE} AS article FROM pages)
WHERE title NOT IN (SELECT split_part(text, chr(10), 1) FROM documents)""",
)
def c26(spark, d):
    pages = table(spark, d, "pages").select(
        "page_id", html.extract_title(F.col("html"), blocklist=[]).alias("title"), html.extract_article(F.col("html")).alias("article")
    )
    blocked = corpus(spark, d).select("title").distinct()
    kept = chunking.drop_blocklisted(pages, "title", blocked)
    return kept.select("page_id", "title", chunking.drop_passages(F.col("article"), ["</p><p>"]).alias("body"))
