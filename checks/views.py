"""Views over the given tables, once as DataFrames and once as SQL.

The given tables lack some fields of the document model; both forms derive the
same values for every row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticeboard import constants as C
from noticeboard.functions.text import CLEAN_RULES, MARKDOWN_RULES, clean_content, estimate_tokens, strip, words
from noticeboard.operators import intent
from noticeboard.plans.search import prepare

AS_OF = "2025-12-16"


# -- helpers --------------------------------------------------------------
def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A given table. A table of texts that comes as one small file is spread over the
    cores; a table of many files already is."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name in ("documents", "pages") and df.rdd.getNumPartitions() < min(cores, 8):
        return df.repartition(cores)
    return df


def tidy(df: DataFrame) -> DataFrame:
    """Whole numbers as bigint and fractions as double, as in the SQL results."""
    casts = {T.IntegerType: "long", T.ShortType: "long", T.FloatType: "double", T.DecimalType: "double"}
    return df.select(
        *[
            F.col(f"`{f.name}`").cast(casts[type(f.dataType)]).alias(f.name) if type(f.dataType) in casts else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def joined(col, sep: str = "|"):
    return F.array_join(col, sep)


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_chars(text: str) -> str:
    """A SQL text from any characters, control characters by number."""
    parts, plain = [], ""
    for ch in text:
        if ord(ch) < 32 or 0x7F <= ord(ch) < 0xA1:
            if plain:
                parts.append(quote(plain))
                plain = ""
            parts.append(f"chr({ord(ch)})")
        else:
            plain += ch
    if plain or not parts:
        parts.append(quote(plain))
    return "(" + " || ".join(parts) + ")"


def sql_strip(expr: str) -> str:
    return f"trim({expr}, {sql_chars(C.WHITESPACE)})"


def sql_rules(expr: str, rules: list[tuple[str, str]]) -> str:
    """A chain of regexp_replace with patterns in the notation of RE2."""
    for pattern, replacement in rules:
        pattern = pattern.replace("(?md)", "(?m)").replace("(?d)", "")
        for i in range(1, 10):
            replacement = replacement.replace(f"${i}", f"\\{i}")
        expr = f"regexp_replace({expr}, {quote(pattern)}, {sql_chars(replacement)}, 'g')"
    return expr


def sql_clean(expr: str) -> str:
    return sql_strip(sql_rules(sql_rules(f"coalesce({expr}, '')", CLEAN_RULES), MARKDOWN_RULES))


def sql_words(expr: str) -> str:
    runs = rf"list_filter(regexp_split_to_array(lower({expr}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"
    both = "list_transform(range(1, length(p)), lambda i: substr(p, CAST(i AS INTEGER), 2))"
    pairs = f"CASE WHEN regexp_matches(p, '[一-龥]') AND length(p) > 1 THEN {both} ELSE [p] END"
    pieces = f"flatten(list_transform(regexp_extract_all(w, '[一-龥]+|[^一-龥]+'), lambda p: {pairs}))"
    cjk = f"flatten(list_transform({runs}, lambda w: CASE WHEN regexp_matches(w, '[一-龥]') THEN {pieces} ELSE [w] END))"
    return f"CASE WHEN regexp_matches({expr}, '[一-龥]') THEN {cjk} ELSE {runs} END"


def sql_distinct(expr: str) -> str:
    """Distinct values of a list in their first order."""
    return f"list_filter({expr}, lambda x, i: list_position({expr}, x) = i)"


def sql_tokens(expr: str) -> str:
    cjk = f"(length({expr}) - length(regexp_replace({expr}, '[一-龥]', '', 'g')))"
    return f"CAST(ceil({cjk} * 2.5 + (length({expr}) - {cjk}) / 4.0) AS BIGINT)"


# -- DataFrame views ------------------------------------------------------
def corpus(spark: SparkSession, d: str) -> DataFrame:
    doc = table(spark, d, "documents")
    page = F.floor(F.col("doc_id") / 4)
    month = F.date_format(F.add_months(F.lit("2023-01-01").cast("date"), (F.col("doc_id") % 24).cast("int")), "yyyy-MM")
    return doc.select(
        F.col("doc_id").cast("string").alias("id"),
        F.col("source").alias("website"),
        F.concat(F.lit("https://corpus.example/"), page.cast("string")).alias("link"),
        F.concat(F.lit("https://corpus.example/"), page.cast("string"), F.lit("#"), F.col("doc_id").cast("string")).alias("heading_link"),
        F.concat(F.lit("doc-"), page.cast("string")).alias("main_title"),
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
        F.col("text").alias("content"),
        clean_content(F.col("text")).alias("cleaned_content"),
        month.alias("year_month"),
        F.substring(month, 1, 4).alias("year"),
        estimate_tokens(F.col("text")).alias("token"),
        F.col("doc_id").alias("seq"),
        "lang",
    )


def requests(spark: SparkSession, d: str) -> DataFrame:
    bench = table(spark, d, "benchmark")
    i = F.col("item_id")
    parts = F.filter(F.transform(F.split("text", "[.\n]+"), strip), lambda s: s != "")
    none = F.array().cast("array<string>")
    month = F.concat(F.lit("2023-"), F.lpad((1 + i % 12).cast("string"), 2, "0"))
    df = bench.select(
        i.alias("request_id"),
        "text",
        F.element_at(parts, 1).alias("user_query"),
        F.element_at(parts, 1).alias("keyword_query"),
        F.when(i % 2 == 0, F.lit("")).otherwise(F.col("text")).alias("semantic_query"),
        F.slice(parts, F.lit(2), F.greatest(F.size(parts), F.lit(1))).alias("sub_queries"),
        F.array_distinct(F.filter(words(F.col("text")), lambda w: F.length(w) >= 9)).alias("must_have"),
        (1 + i % 10).cast("int").alias("limit"),
        F.when(i % 7 == 0, 60).cast("int").alias("intent_limit"),
        ((i % 11) / 10.0).alias("ratio"),
        F.when(i % 3 == 1, F.array(month)).otherwise(none).alias("months"),
        F.when(i % 6 == 2, F.array(F.lit("2024"))).otherwise(none).alias("years"),
        none.alias("links"),
        F.when(i % 5 == 4, F.array(*[F.lit(f"src{n}") for n in range(0, 20, 2)])).otherwise(none).alias("websites"),
        F.when(i % 10 == 9, F.array(*[F.lit(f"src{n}") for n in range(0, 12)])).otherwise(none).alias("manual_websites"),
        F.when(i % 4 == 3, F.lit("2023-03-15")).alias("start_date"),
        F.when(i % 4 == 3, F.lit("2024-06-30")).alias("end_date"),
    )
    return df


def vectors(spark: SparkSession, d: str) -> DataFrame:
    emb = table(spark, d, "embeddings").select(
        F.col("vec_id").cast("string").alias("id"), F.col("embedding").cast("array<double>").alias("vector")
    )
    meta = corpus(spark, d).select("id", "year_month", "link", "website")
    return emb.join(meta, "id")


def candidates(spark: SparkSession, d: str) -> DataFrame:
    """Prepared queries of all requests, each with its own vector where there is one."""
    cands = prepare(requests(spark, d)).withColumn("vec_id", F.col("request_id") * 5 + F.col("cand"))
    emb = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    return cands.join(emb, "vec_id", "left").drop("vec_id")


def old_snap(spark: SparkSession, d: str) -> DataFrame:
    return corpus(spark, d).select("website", "link", "main_title", "title", "content", "year_month", "seq")


def new_snap(spark: SparkSession, d: str) -> DataFrame:
    """A later crawl: some sources lost languages, one gave nothing, toxic pages were
    revised and the pages of other sites came in."""
    toxic = table(spark, d, "labels").filter("toxic = 1").select(F.col("doc_id").alias("seq"), F.lit(1).alias("toxic"))
    docs = corpus(spark, d).join(toxic, "seq", "left")
    kept = docs.filter(
        (F.col("website") != "src7")
        & ~((F.col("lang") == "es") & (F.col("website") != "src3"))
        & ~((F.length("website") == 5) & (F.col("lang") != "en"))
    ).select(
        "website", "link", "main_title", "title",
        F.when((F.col("toxic") == 1) & (F.col("website") != "src3"), F.concat("content", F.lit(" (revised)"))).otherwise(F.col("content")).alias("content"),
        "year_month", "seq",
    )
    pages = table(spark, d, "pages").select(
        F.regexp_extract("url", "^https?://([^/]+)/", 1).alias("website"),
        F.col("url").alias("link"),
        F.lit("page").alias("main_title"),
        F.col("url").alias("title"),
        F.col("html").alias("content"),
        F.lit("2025-01").alias("year_month"),
        (F.col("page_id") + 1000000).alias("seq"),
    )
    return kept.unionByName(pages)


def markdown_docs(spark: SparkSession, d: str) -> DataFrame:
    """Documents with Markdown set in by position: headings, a link, an image, a rule and labels."""
    doc = table(spark, d, "documents")
    i = F.col("doc_id")
    first = F.split_part("text", F.lit("\n"), F.lit(1))
    head = (
        F.when(i % 5 == 0, F.concat(F.lit("# "), first, F.lit("\n\n")))
        .when(i % 5 == 1, F.lit("* **日期**：2024-01-15\n* **工作區**：notes\n\n"))
        .when(i % 5 == 2, F.lit("#### 現已推出\nsee https://docs.example/a?b=1 and [the guide](guide.html)\n\n"))
        .when(i % 5 == 3, F.lit("![shot](img/a.png)\n\n---\n\n"))
        .otherwise(F.lit(""))
    )
    middle = F.lit("\n\n## part **one**\n\n- item `code` and _slanted_\n1. step\n\n```\n# not a heading\n```\n\n### detail\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n")
    return doc.select(
        i.cast("string").alias("id"),
        F.concat(F.lit("doc-"), F.floor(i / 4).cast("string")).alias("main_title"),
        F.concat(head, F.col("text"), middle, F.col("text")).alias("content"),
    )


# -- SQL views ------------------------------------------------------------
_MIDDLE = (
    "\n\n## part **one**\n\n- item `code` and _slanted_\n1. step\n\n```\n# not a heading\n```\n\n### detail\n\n"
    "| a | b |\n|---|---|\n| 1 | 2 |\n\n"
)

SQL_VIEWS: dict[str, tuple[list[str], str]] = {}


def view(name: str, needs: list[str], body: str) -> None:
    SQL_VIEWS[name] = (needs, body)


def with_views(names: list[str], body: str) -> str:
    """``WITH`` the named views and those they need, followed by the query."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for need in SQL_VIEWS[n][0]:
            visit(need)
        order.append(n)

    for n in names:
        visit(n)
    parts = ",\n".join(f"{n} AS MATERIALIZED ({SQL_VIEWS[n][1]})" for n in order)
    return f"WITH RECURSIVE {parts}\n{body}"


view(
    "corpus",
    [],
    f"""SELECT CAST(doc_id AS VARCHAR) AS id, source AS website,
  'https://corpus.example/' || (doc_id // 4) AS link,
  'https://corpus.example/' || (doc_id // 4) || '#' || doc_id AS heading_link,
  'doc-' || (doc_id // 4) AS main_title,
  split_part(text, chr(10), 1) AS title, text AS content,
  {sql_clean("text")} AS cleaned_content,
  strftime(DATE '2023-01-01' + to_months(CAST(doc_id % 24 AS INTEGER)), '%Y-%m') AS year_month,
  CAST(2023 + (doc_id % 24) // 12 AS VARCHAR) AS year,
  {sql_tokens("text")} AS token, doc_id AS seq, lang
FROM documents""",
)
view(
    "request_parts",
    [],
    f"""SELECT item_id, text,
  list_filter(list_transform(regexp_split_to_array(text, '[.\\n]+'), lambda s: {sql_strip("s")}), lambda s: s <> '') AS parts,
  list_filter({sql_words("text")}, lambda w: length(w) >= 9) AS long_words
FROM benchmark""",
)
view(
    "requests",
    ["request_parts"],
    f"""SELECT item_id AS request_id, text, parts[1] AS user_query, parts[1] AS keyword_query,
  CASE WHEN item_id % 2 = 0 THEN '' ELSE text END AS semantic_query,
  parts[2:] AS sub_queries, {sql_distinct("long_words")} AS must_have,
  1 + item_id % 10 AS "limit", CASE WHEN item_id % 7 = 0 THEN 60 END AS intent_limit,
  (item_id % 11) / 10.0 AS ratio,
  CASE WHEN item_id % 3 = 1 THEN ['2023-' || lpad(CAST(1 + item_id % 12 AS VARCHAR), 2, '0')] ELSE CAST([] AS VARCHAR[]) END AS months,
  CASE WHEN item_id % 6 = 2 THEN ['2024'] ELSE CAST([] AS VARCHAR[]) END AS years,
  CAST([] AS VARCHAR[]) AS links,
  CASE WHEN item_id % 5 = 4 THEN list_transform(range(0, 20, 2), lambda n: 'src' || n) ELSE CAST([] AS VARCHAR[]) END AS websites,
  CASE WHEN item_id % 10 = 9 THEN list_transform(range(0, 12), lambda n: 'src' || n) ELSE CAST([] AS VARCHAR[]) END AS manual_websites,
  CASE WHEN item_id % 4 = 3 THEN '2023-03-15' END AS start_date,
  CASE WHEN item_id % 4 = 3 THEN '2024-06-30' END AS end_date
FROM request_parts""",
)
view(
    "vectors",
    ["corpus"],
    """SELECT c.id, c.year_month, c.link, c.website, CAST(e.embedding AS DOUBLE[]) AS vector
FROM embeddings e JOIN corpus c ON c.id = CAST(e.vec_id AS VARCHAR)""",
)
view(
    "limits",
    ["requests"],
    """SELECT *, least(coalesce(intent_limit, "limit"), 50) AS final_limit,
  greatest(50, CAST(floor(least(coalesce(intent_limit, "limit"), 50) * 1.5 + 20) AS BIGINT)) AS pre_limit
FROM requests""",
)
view(
    "queries",
    ["limits"],
    """SELECT *, list_prepend(keyword_query, list_filter(sub_queries, lambda q: q IS NOT NULL AND q <> '')) AS all_queries
FROM limits""",
)
view(
    "queries_flat",
    ["queries"],
    "SELECT request_id, unnest(all_queries) AS query, generate_subscripts(all_queries, 1) AS n FROM queries",
)
view(
    "queries_first",
    ["queries_flat"],
    "SELECT request_id, query, row_number() OVER (PARTITION BY request_id ORDER BY min(n)) - 1 AS cand FROM queries_flat GROUP BY request_id, query",
)
view(
    "candidates",
    ["queries_first", "limits"],
    """SELECT l.*, f.cand, f.query,
  CASE WHEN f.query = l.keyword_query THEN CASE WHEN trim(l.semantic_query) <> '' THEN l.semantic_query ELSE l.user_query END ELSE f.query END AS embedding_text,
  CAST(e.embedding AS DOUBLE[]) AS vector
FROM queries_first f JOIN limits l USING (request_id) LEFT JOIN embeddings e ON e.vec_id = f.request_id * 5 + f.cand""",
)
def allowed_view(name: str, cands: str, seen: str | None = None) -> None:
    """Documents that pass the filters of each query, without those already seen."""
    unseen = f" AND (r.request_id, d.id) NOT IN (SELECT (request_id, id) FROM {seen})" if seen else ""
    view(
        name,
        [cands, "corpus", *([seen] if seen else [])],
        f"""SELECT r.request_id, r.cand, d.id FROM {cands} r, corpus d
WHERE (len(r.months) = 0 OR list_contains(r.months, d.year_month))
  AND (len(r.years) = 0 OR list_contains(r.years, d.year))
  AND (len(r.links) = 0 OR list_contains(r.links, d.link))
  AND (len(r.websites) = 0 OR list_contains(r.websites, d.website))
  AND (len(r.manual_websites) = 0 OR list_contains(r.manual_websites, d.website))
  AND (len(r.months) > 0 OR ((r.start_date IS NULL OR d.year_month >= substr(r.start_date, 1, 7))
    AND (r.end_date IS NULL OR d.year_month <= substr(r.end_date, 1, 7)))){unseen}""",
    )


allowed_view("allowed", "candidates")
view(
    "old_snap",
    ["corpus"],
    "SELECT website, link, main_title, title, content, year_month, seq FROM corpus",
)
view(
    "new_snap",
    ["corpus"],
    """SELECT c.website, c.link, c.main_title, c.title,
  CASE WHEN l.toxic = 1 AND c.website <> 'src3' THEN c.content || ' (revised)' ELSE c.content END AS content, c.year_month, c.seq
FROM corpus c LEFT JOIN labels l ON l.doc_id = c.seq
WHERE c.website <> 'src7' AND NOT (c.lang = 'es' AND c.website <> 'src3') AND NOT (length(c.website) = 5 AND c.lang <> 'en')
UNION ALL
SELECT regexp_extract(url, '^https?://([^/]+)/', 1), url, 'page', url, html, '2025-01', page_id + 1000000 FROM pages""",
)
view(
    "markdown_docs",
    [],
    f"""SELECT CAST(doc_id AS VARCHAR) AS id, 'doc-' || (doc_id // 4) AS main_title,
  CASE doc_id % 5
    WHEN 0 THEN '# ' || split_part(text, chr(10), 1) || chr(10) || chr(10)
    WHEN 1 THEN {sql_chars("* **日期**：2024-01-15" + chr(10) + "* **工作區**：notes" + chr(10) * 2)}
    WHEN 2 THEN {sql_chars("#### 現已推出" + chr(10) + "see https://docs.example/a?b=1 and [the guide](guide.html)" + chr(10) * 2)}
    WHEN 3 THEN {sql_chars("![shot](img/a.png)" + chr(10) * 2 + "---" + chr(10) * 2)}
    ELSE '' END || text || {sql_chars(_MIDDLE)} || text AS content
FROM documents""",
)
