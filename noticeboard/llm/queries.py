"""Registered queries of the operators, each over its whole table, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

import corpus_pipeline
from noticeboard.llm import ann, licences, lines, mixing, near_dups, packing, phrases, quality, runs, substrings, suffix_tree, toxicity, warc
from noticeboard.llm.texts import let, read, words
from noticeboard.session import new_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@query("op1_toxicity")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.score(read(spark, folder, "documents"), read(spark, folder, "labels"))


@query("op2_nearest_vectors")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return ann.search(read(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


@query("op3_quality_rules")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judge(read(spark, folder, "documents"), read(spark, folder, "labels"))


@query("op4_lm_scores")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_tree.score(read(spark, folder, "documents"))


@query("op5_substring_dedup")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    left = substrings.remove_repeats(read(spark, folder, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op6_packing")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(read(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json")).drop("ids")


@query("op7_near_dups")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return near_dups.classify(read(spark, folder, "documents"))


def _op8_sql() -> str:
    """Rules are applied one after another, each in a table of its own."""
    steps = ["r0 AS (SELECT doc_id, ids, list_aggregate(list_transform(ids, lambda x: '<' || x || '>'), 'string_agg', '') AS rest, '' AS found FROM named)"]
    for i, (sequence, name) in enumerate(licences.RULES):
        pattern = "".join(f"(<{x}>)+" for x in sequence)
        steps.append(
            f"r{i + 1} AS (SELECT doc_id, ids, regexp_replace(rest, '{pattern}', '/', 'g') AS rest, CASE WHEN regexp_matches(rest, '{pattern}') "
            f"AND NOT contains(found, '|{name}|') THEN found || '|{name}|' ELSE found END AS found FROM r{i})"
        )
    known = " ".join(f"WHEN '{sentence}' THEN '{name}'" for name, sentence in licences.SENTENCES)
    anyone = "|".join(sentence for _, sentence in licences.SENTENCES)
    return rf"""
WITH cut AS (
  SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(coalesce(text, ''), '(?i)(\bv|-identifier)[.!?;:]([ \t\r\n])', '\1 \2', 'g'),
    '[.!?;:]+[ \t\r\n]|\n[^\p{{L}}\p{{N}}\n]*\n'), lambda x: regexp_matches(x, '{licences.TRIGGERS}')) AS raw
  FROM documents),
plain AS (
  SELECT doc_id, list_transform(raw, lambda x: regexp_replace(trim(regexp_replace(regexp_replace(lower(x), '([0-9])\+', '\1 or later', 'g'),
    '[^a-z0-9]+', ' ', 'g')), '{licences.UNDER}', 'under ', 'g')) AS all_s
  FROM cut),
sentences AS (
  SELECT doc_id, list_transform(all_s, lambda x: CASE WHEN contains(x, '{licences.IDENTIFIER}')
    THEN replace(regexp_replace(x, ' (or|and) ', ' {licences.IDENTIFIER} ', 'g'), ' {licences.IDENTIFIER} later', ' or later') ELSE x END) AS all_s
  FROM plain),
named AS (
  SELECT doc_id, list_transform(flatten(list_transform(all_s, lambda s: regexp_extract_all(s, '\b(?:{anyone})\b'))), lambda x: CASE x {known} END) AS ids
  FROM sentences),
{", ".join(steps)}
SELECT doc_id, coalesce(list_aggregate(ids, 'string_agg', ' '), '') AS sentence_ids, trim(regexp_replace(found, '\|+', ' ', 'g')) AS licences,
  trim(regexp_replace(coalesce(rest, ''), '[<>/]+', ' ', 'g')) AS leftover
FROM r{len(licences.RULES)}"""


@query("op8_licence_scan", _op8_sql())
def op8(spark: SparkSession, folder: str) -> DataFrame:
    found = licences.scan(read(spark, folder, "documents"))
    return found.select("doc_id", *[F.array_join(c, " ").alias(c) for c in ("sentence_ids", "licences", "leftover")])


def _sql_lines() -> str:
    out = "html"
    for pattern in lines.DROPPED:
        out = f"regexp_replace({out}, '{pattern}', '', 'g')"
    return f"regexp_replace(regexp_replace({out}, '{lines.BLOCK}', chr(10), 'g'), '{lines.TAG}', '', 'g')"


OP9 = f"""
WITH pages_in AS (
  SELECT page_id, lower(regexp_extract(coalesce(url, ''), '{lines.HOST}', 1)) AS host, string_split({_sql_lines()}, chr(10)) AS ls FROM pages),
totals AS (SELECT host, count(*) AS n FROM pages_in GROUP BY host),
held AS (
  SELECT host, line, count(*) AS c FROM (SELECT host, unnest(list_distinct(list_transform(ls, lambda x: trim(x, ' ')))) AS line FROM pages_in)
  WHERE line <> '' GROUP BY host, line),
bad AS (
  SELECT host, list(line) AS lines FROM held JOIN totals USING (host)
  WHERE c >= {lines.MIN_PAGES} AND c > {lines.MAX_RATIO} * n GROUP BY host)
SELECT page_id, host, CAST(len(list_filter(ls, lambda x: list_contains(coalesce(lines, []), trim(x, ' ')))) AS BIGINT) AS n_removed,
  coalesce(list_aggregate(list_filter(ls, lambda x: NOT list_contains(coalesce(lines, []), trim(x, ' '))), 'string_agg', chr(10)), '') AS text
FROM pages_in LEFT JOIN bad USING (host)"""


@query("op9_line_dedup", OP9)
def op9(spark: SparkSession, folder: str) -> DataFrame:
    pages = read(spark, folder, "pages")
    pages = pages.select("page_id", lines.host_of(F.col("url")).alias("host"), lines.page_lines(F.col("html")).alias("text"))
    return lines.drop_boilerplate(pages, "text", "host", removed="n_removed").select("page_id", "host", "n_removed", "text")


OP10 = r"""
WITH sizes AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
per_source AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source),
ranked AS (
  SELECT *, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS cap
  FROM per_source),
levels AS (
  SELECT *,
    1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights
  FROM ranked),
capped AS (SELECT *, cap * weights <= rest * weight AS capped FROM levels),
level AS (SELECT rest, weights FROM capped WHERE NOT capped ORDER BY cap / weight, source NULLS LAST LIMIT 1),
targets AS (
  SELECT c.source, c.source_size, CASE WHEN c.capped THEN c.cap ELSE level.rest * c.weight / level.weights END AS target
  FROM capped c LEFT JOIN level ON true),
rated AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
    ('0x' || substr(md5('mix-1:' || coalesce(CAST(s.doc_id AS VARCHAR), 'null')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM rated"""


@query("op10_mixing", OP10)
def op10(spark: SparkSession, folder: str) -> DataFrame:
    chosen = mixing.plan(read(spark, folder, "documents"))
    return chosen.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP11 = r"""
WITH pieces AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM pieces GROUP BY lang),
grams AS (
  SELECT lang, m, w[i:i + m - 1] AS p FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM pieces, (SELECT unnest([1, 2, 3, 4]) AS m))),
counted AS (SELECT lang, m, p, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 30),
cuts AS (
  SELECT c.lang, c.m, c.p, c.f AS a, k, x.f AS l, y.f AS r, (2000000::HUGEINT * c.f) // (x.f + y.f) AS score
  FROM (SELECT *, unnest(range(1, m)) AS k FROM counted WHERE m > 1) c
  JOIN counted x ON x.lang = c.lang AND x.p = c.p[1:k] JOIN counted y ON y.lang = c.lang AND y.p = c.p[k + 1:c.m]),
low AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
parts AS (SELECT lang, p[1:m - 1] AS p, f FROM counted WHERE m > 2 UNION ALL SELECT lang, p[2:m] AS p, f FROM counted WHERE m > 2),
longer AS (SELECT lang, p, max(f) AS f FROM parts GROUP BY ALL),
kept AS (
  SELECT low.lang, array_to_string(low.p, ' ') AS phrase, a, l, r, score FROM low LEFT JOIN longer ON longer.lang = low.lang AND longer.p = low.p
  WHERE longer.f IS NULL OR 100::HUGEINT * longer.f < 80 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n, CAST(score AS BIGINT) AS score
FROM ranked JOIN totals USING (lang) WHERE rank <= 2000"""


@query("op11_phrases", OP11)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.mine(read(spark, folder, "documents"))


def planted_tails(docs: DataFrame) -> DataFrame:
    """doc_id, text: one text in ten, by the hash of its id, goes on with a repetition of its own words."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")

    def tail(own: Column) -> Column:
        n = F.size(own).cast("long")
        a = F.pmod(g, n)
        p = F.floor((n - a) / (3 + F.pmod(g, F.lit(8)))).cast("long") + 1
        again = F.transform(F.sequence(F.lit(0).cast("long"), n - a - 1), lambda j: F.element_at(own, (a + F.pmod(j, p) + 1).cast("int")))
        return F.array_join(F.concat(F.slice(own, F.lit(1), a.cast("int")), again), " ")

    planted = let(words(F.col("text")), lambda own: F.when(F.size(own) > 0, tail(own)))
    return docs.select("doc_id", F.when(h % 10 == 0, planted).otherwise(F.col("text")).alias("text"))


@query("op12_periodic_runs")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    found = runs.find_runs(planted_tails(read(spark, folder, "documents")))
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"),
        F.sha2("text", 256).alias("collapsed_sha256"),
    )


OP13 = """
WITH captured AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
sized AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS payload_digest FROM captured),
held AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS kept FROM sized)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN kept = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN kept <> page_id THEN kept END AS refers_to
FROM held"""


@query("op13_warc", OP13)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    archives = new_path(spark, "archives")
    warc.write_archives(read(spark, folder, "pages"), archives)
    found = warc.resolve(warc.captures(warc.records(spark, archives, with_payload=False).drop("payload")))
    page = lambda metadata: F.col(metadata)[0]["fields"]["page-id"].cast("long")
    revisit = F.col("record.record_type") == "revisit"
    return found.select(
        page("metadata").alias("page_id"),
        F.when(revisit, F.col("original.record.payload_bytes")).otherwise(F.col("record.payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.col("original.record.payload_digest")).otherwise(F.col("record.payload_digest")).alias("payload_digest"),
        F.col("record.record_type").alias("record_type"),
        page("original.metadata").alias("refers_to"),
    )


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    return corpus_pipeline.run(spark, folder)
