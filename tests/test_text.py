import random
import re

import pytest
from pyspark.sql import functions as F

from noticeboard import constants as C
from noticeboard.functions import dates, html, text
from noticeboard.operators import chunking, intent


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(fn(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    "source, expected",
    [
        ("# Top\n## Next\n### Low\n\nBody line.", "Top Next Low Body line."),
        ("a **bold** and *slanted* __more__ and _thin_ ***both***", "a bold and slanted more and thin both"),
        ("run `make all`\n\n```sh\nls -l\n```\nend", "run make all ls -l end"),
        ("see https://x.example/a?b=1 now", "see now"),
        ("[guide](guide.html) page", "guide page"),
        ("before\n![alt](pic.png)\nafter", "before after"),
        ("| a | b |\n|---|---|\n| 1 | 2 |\n\nend", "a b 1 2 end"),
        ("one\n\n---\n\ntwo\n\n***\n\nthree", "one two three"),
        ("* **日期**：2024-01-15\n* **工作區**：x\n\nstart", "start"),
        ("#### 現已推出\nout now", "out now"),
        ("a\n\n\n\nb     c\n", "a b c"),
        ("- x\n- y\n1. z\n> quoted", "x y z quoted"),
        ("keep snake_case_name", "keep snake_case_name"),
        ("<b>tag</b>", "tag"),
        ("", ""),
        (None, ""),
    ],
)
def test_clean_content(spark, source, expected):
    assert one(spark, source, text.clean_content) == expected


def test_estimate_tokens_rounds_up(spark):
    for value, expected in [("", 0), (None, 0), ("a", 1), ("abcd", 1), ("abcde", 2), ("漢字", 5), ("漢ab", 3)]:
        assert one(spark, value, text.estimate_tokens) == expected


def test_fingerprint_ignores_outer_space_and_nulls(spark):
    df = spark.createDataFrame([(" w　", None, "t\n", "c"), ("w", "", "t", " c ")], "a string, b string, c string, d string")
    prints = {r[0] for r in df.select(text.fingerprint(*[F.col(c) for c in "abcd"])).collect()}
    assert len(prints) == 1


def test_html_to_markdown(spark):
    source = '<p>Hi &amp; <b>bye</b></p><ul><li><i> one</i></li><li>two</li></ul><a class="x" href="/a"> link </a><br/>end'
    assert one(spark, source, html.html_to_markdown) == "Hi & bye\n\n- one\n- two\n[link](/a)\nend"
    assert one(spark, "<table><tr><td>a</td><td>b</td></tr><tr><td>c</td></tr></table>", html.html_to_markdown) == "a\tb\t\tc"


def test_title_falls_back_and_drops_error_pages(spark):
    assert one(spark, "<title>T - Site</title><h1> </h1>", lambda c: html.extract_title(c, " - Site")) == "T"
    assert one(spark, "<title>One - two</title>", html.extract_title) == "One - two"
    assert one(spark, "<title>One - Site - two</title>", lambda c: html.extract_title(c, " - Site")) == "One - Site - two"
    assert one(spark, "<h1>Page not found</h1>", html.extract_title) is None
    assert one(spark, "<p>x</p>", html.extract_title) == "No Title"


def test_smart_date(spark):
    df = spark.createDataFrame(
        [("2025-03-04", ""), ("2025/3/4", ""), ("4 March 2025", ""), ("March 4, 2025", ""), ("2025 年 3 月 4 日", ""),
         ("?", "https://x/2025-march/a"), (None, "https://x/2025-foo"), ("", "")],
        "t string, u string",
    )
    got = [r[0] for r in df.select(dates.smart_date(F.col("t"), F.col("u"), "2025-12-16")).collect()]
    assert got == ["2025-03"] * 6 + ["2025-12"] * 2


def test_latest_month_is_valid_and_not_in_the_future(spark):
    source = "2024-3 then 2025 年 12 月, 2026-01 and 2025-13"
    assert one(spark, source, lambda c: dates.latest_mentioned_month(c, "2025-12-16")) == "2025-12"
    assert one(spark, "none", lambda c: dates.latest_mentioned_month(c, "2025-12-16")) == ""


def test_resolve_months(spark):
    df = spark.createDataFrame([("last", 0), ("past", 2), ("recent", 0), ("none", 0)], "k string, n int")
    got = [r[0] for r in df.select(dates.resolve_months(F.col("k"), F.col("n"), "2026-01-05")).collect()]
    assert got == [["2025-12"], ["2026-01", "2025-12"], ["2026-01", "2025-12", "2025-11"], []]


def test_must_have_rules(spark):
    keys = ["KB1234567", "Update", "one two three", "one two three four", "雲端服務", "雲合作夥伴計劃", " ", "安全性"]
    assert one(spark, keys, intent.valid_must_have, "array<string>") == ["KB1234567", "one two three", "雲端服務"]


def test_sections_take_their_own_heading(spark):
    df = spark.createDataFrame(
        [("a", "Main", "intro\n\n## One\ntext\n```\n# no\n```\n### Two\n#\nmore\n#### deep\nx"), ("b", "M", "# Only\n\n##  \n"), ("c", "M", " \n")],
        "id string, main_title string, content string",
    )
    rows = [(r.id, r.section, r.title) for r in chunking.split_by_headings(df).collect()]
    assert rows == [("a", 0, "Main"), ("a", 1, "One"), ("a", 2, "Two"), ("b", 0, "Only")]


def test_fixed_chunks_cover_the_text(spark):
    rng = random.Random(1)
    sizes = [0, 1, 99, 100, 115, 116, 180, 195, 196, 500, 1234]
    docs = [(n, " ".join(f"w{i}{rng.choice('abc')}" for i in range(n))) for n in sizes]
    out = chunking.chunk_fixed(spark.createDataFrame(docs, "n int, text string"), "text", 100, 20, 15).collect()
    for n, body in docs:
        parts = sorted((r.chunk, r.chunk_text.split()) for r in out if r.n == n)
        joined = [w for i, (_, ws) in enumerate(parts) for w in (ws if i == 0 else ws[20:])]
        assert joined == body.split()
        assert all(len(ws) <= 115 for _, ws in parts)


def paragraphs(blocks):
    lines = ["A long walk by the river at dawn.\n", "漢字的段落，用來測試。\n", "Rain fell; the road was empty: nobody came.\n\n", "第二個段落！\n"]
    return "".join(f"{i} {line}" for i in range(blocks) for line in lines)


@pytest.mark.parametrize("size, overlap, tolerance", [(200, 40, 25), (50, 10, 5), (100, 0, 0), (60, 55, 10)])
def test_smart_chunks(spark, size, overlap, tolerance):
    rng = random.Random(4)
    solid = "".join(rng.choice("abcdefgh") for _ in range(3000))
    cjk = "".join(chr(rng.randint(0x4E00, 0x9FA5)) for _ in range(900))
    for body in (paragraphs(40), solid, cjk, "\n".join(map(str, range(2000))), "tail " * 3):
        parts = chunking.smart_pieces(body, size, overlap, tolerance)
        quarters = lambda t: sum(10 if "一" <= c <= "龥" else 1 for c in t)
        assert all(quarters(p) <= (size + tolerance) * 4 for p in parts)
        at, covered = 0, 0
        for p in parts:  # parts are in order and leave only white space out
            at = body.find(p, max(0, at))
            assert at >= 0
            assert not body[covered:at].strip() if at > covered else True
            covered = max(covered, at + len(p))
            at += 1
        assert not body[covered:].strip()


def test_smart_chunks_leave_short_texts_alone(spark):
    df = spark.createDataFrame([(1, " short "), (2, paragraphs(60)), (3, " "), (4, None)], "i int, text string")
    out = chunking.chunk_smart(df, "text", 100, 20, 10).collect()
    assert [r.chunk_text for r in out if r.i == 1] == ["short"]
    assert [r.chunk_text for r in out if r.i == 2] == chunking.smart_pieces(paragraphs(60), 100, 20, 10)
    assert not [r for r in out if r.i > 2]


def test_constants_agree():
    assert C.MAX_PRE_MERGE == C.MAX_LIMIT * C.PRE_MERGE_FACTOR
    assert C.MAX_PRE_LIMIT == int(max(C.PRE_LIMIT_FLOOR, int(C.MAX_LIMIT * C.PRE_LIMIT_FACTOR + C.PRE_LIMIT_OFFSET)) * C.RETRY_FACTOR)


def test_nested_blocks(spark):
    page = '<div class="entry-content"><div class="a">one</div><p>two</p></div><div>tail</div>'
    assert one(spark, page, html.extract_article) == '<div class="a">one</div><p>two</p>'
    assert one(spark, "<main><article>a</article>b", html.extract_article) == "<article>a</article>b"
    assert one(spark, "<p>none</p>", html.extract_article) is None
    box = 'x<aside class="related-posts"><div>a<div>b</div></div>c</aside>y'
    assert one(spark, box, html.strip_boilerplate) == "xy"


def test_character_references(spark):
    assert one(spark, "&#8217; &mdash; &eacute; &#x1F600; &amp;amp; a&b; AT&T &#0; &#xD800;", html.unescape) == "’ — é 😀 &amp; a&b; AT&T &#0; &#xD800;"


def test_links_follow_the_page(spark):
    links = {
        "//cdn.x/y": "https://cdn.x/y", "e": "https://a.b/c/e", "../e": "https://a.b/e", "./e/../f?q=1#z": "https://a.b/c/f?q=1#z", "/r/s": "https://a.b/r/s",
        "?p=2": "https://a.b/c/d?p=2", "#top": "https://a.b/c/d#top", "mailto:x@y": "mailto:x@y", "http://o.p": "http://o.p", "../../../e/": "https://a.b/e/",
    }
    for href, want in links.items():
        assert one(spark, href, lambda c: html.absolute_link(c, F.lit("https://a.b/c/d?x#y"))) == want, href
    assert one(spark, "e", lambda c: html.absolute_link(c, F.lit("https://a.b"))) == "https://a.b/e"


def test_dates_stay_where_they_are_written(spark):
    assert one(spark, "2024-01-31T23:00:00-05:00", dates.iso_month) == "2024-01"
    assert one(spark, "2024-01-31T23:00:00-05:00", dates.iso_date) == "2024-01-31"
    assert one(spark, "2024-3-5", dates.iso_date) == "2024-03-05"
    assert one(spark, "top 1000", intent.extract_limit) == 1000


def test_cjk_words_are_pairs(spark):
    assert one(spark, "AI Cloud 合作夥伴計劃公告 更新v2", text.words) == ["ai", "cloud", "合作", "作夥", "夥伴", "伴計", "計劃", "劃公", "公告", "更新", "v2"]
    assert one(spark, "查 a-b", text.words) == ["查", "a", "b"]


def test_references_are_decoded_once_from_left_to_right(spark):
    from html.entities import name2codepoint

    cases = [
        "&amp;lt; &lt;b&gt; &amp;amp; a & b &unknown; &amp;#60; &#38;amp; &#x26;lt; &am&#112;; &#35;60; &lt&#59; &#0; &#x110000; &#128512; &eacute;&Eacute;",
        "no reference", "&", "&;", "&&amp;&", "&nbsp;" * 50, "x&#65;&amp;#65;y", None, "",
    ]
    names = {n: chr(c) for n, c in name2codepoint.items()} | {"apos": "'"}

    def plain(text):
        def one(m):
            name = m.group(1)
            if name[0] != "#":
                return names.get(name, m.group(0))
            digits, base, most = (name[2:], 16, 6) if name[1:2] in ("x", "X") else (name[1:], 10, 7)
            if not (0 < len(digits) <= most and all(c in "0123456789abcdefABCDEF"[: 22 if base == 16 else 10] for c in digits)):
                return m.group(0)
            code = int(digits, base)
            return chr(code) if 0 < code < 0x110000 and not 0xD800 <= code <= 0xDFFF else m.group(0)

        return text if text is None else re.sub(r"&(#?[A-Za-z0-9]+);", one, text)

    got = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i int, t string").select("i", html.unescape(F.col("t")).alias("u")).orderBy("i").collect()
    assert [r.u for r in got] == [plain(t) for t in cases]
