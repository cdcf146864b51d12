"""Keyword and vector retrieval, blending, reranking, merging and rounds."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import functions as F

from checks.registry import query
from checks.views import allowed_view, candidates, corpus, joined, quote, requests, sql_words, table, vectors, view, with_views
from noticeboard import constants as C
from noticeboard.functions import text
from noticeboard.operators import lexical, ranking, rules, vector
from noticeboard.operators.common import largest, ranked
from noticeboard.plans import search
from noticeboard.session import materialise

CAND = ["request_id", "cand"]
ATTRS = C.SEARCH_ATTRIBUTES

view(
    "tokens",
    ["corpus"],
    " UNION ALL ".join(
        f"SELECT id, {i} AS attr, generate_subscripts(w, 1) - 1 AS pos, unnest(w) AS term FROM (SELECT id, {sql_words(a)} AS w FROM corpus)"
        for i, a in enumerate(ATTRS)
    ),
)
view(
    "query_words",
    ["candidates"],
    f"SELECT request_id, cand, unnest(w) AS term, generate_subscripts(w, 1) AS n FROM (SELECT request_id, cand, {sql_words('query')} AS w FROM candidates)",
)
view(
    "terms",
    ["query_words"],
    """SELECT request_id, cand, term, term_idx, count(*) OVER (PARTITION BY request_id, cand) AS n_terms FROM (
  SELECT request_id, cand, term, row_number() OVER (PARTITION BY request_id, cand ORDER BY min(n)) - 1 AS term_idx FROM query_words GROUP BY 1, 2, 3)""",
)
def sql_edits(a: str, b: str) -> str:
    """Edit distance in characters; the SQL function counts bytes, so the letters
    beyond ASCII that occur in the given texts become one-byte capitals."""
    one_byte = "translate({}, 'ßäçèéêíñóöü', 'ABCDEFGHIJK')"
    return f"levenshtein({one_byte.format(a)}, {one_byte.format(b)})"


view("vocabulary", ["tokens"], "SELECT DISTINCT term FROM tokens")
view("asked_terms", ["terms"], "SELECT DISTINCT term AS q_term, term_idx = n_terms - 1 AS is_last, CASE WHEN length(term) >= 9 THEN 2 WHEN length(term) >= 5 THEN 1 ELSE 0 END AS k FROM terms")
view(
    "expansion",
    ["vocabulary", "asked_terms"],
    f"""SELECT q_term, is_last, term, min(typos) AS typos, max(exact) AS exact FROM (
  SELECT q_term, is_last, term, 0 AS typos, 1 AS exact FROM asked_terms JOIN vocabulary ON term = q_term
  UNION ALL SELECT q_term, is_last, term, 0, 0 FROM asked_terms JOIN vocabulary ON starts_with(term, q_term) AND term <> q_term WHERE is_last
  UNION ALL SELECT q_term, is_last, term, {sql_edits("q_term", "term")}, 0 FROM asked_terms JOIN vocabulary ON length(term) BETWEEN length(q_term) - k AND length(q_term) + k
    WHERE k > 0 AND term <> q_term AND {sql_edits("q_term", "term")} <= k)
GROUP BY 1, 2, 3""",
)
view(
    "query_expansion",
    ["terms", "expansion"],
    """SELECT t.request_id, t.cand, t.n_terms, t.term_idx, e.term, e.typos, e.exact
FROM terms t JOIN expansion e ON e.q_term = t.term AND e.is_last = (t.term_idx = t.n_terms - 1)""",
)
view("postings", ["tokens"], "SELECT id, term, min(attr) AS attr FROM tokens GROUP BY 1, 2")
def search_views(p: str, cands: str, ok: str) -> None:
    """Retrieval of one round, with names that begin with ``p``."""
    view(
        f"{p}rules",
        ["query_expansion", "postings", ok],
        f"""SELECT request_id, cand, n_terms, id, count(*) AS words, CAST(sum(typos) AS BIGINT) AS typos, min(attr) AS attr, CAST(sum(exact) AS BIGINT) AS exact FROM (
      SELECT q.request_id, q.cand, q.n_terms, p.id, q.term_idx, min(q.typos) AS typos, min(p.attr) AS attr, max(q.exact) AS exact
      FROM query_expansion q JOIN postings p USING (term) JOIN {ok} a ON a.request_id = q.request_id AND a.cand = q.cand AND a.id = p.id
      GROUP BY 1, 2, 3, 4, 5) GROUP BY 1, 2, 3, 4""",
    )
    view(
        f"{p}front",
        [f"{p}rules", cands],
        f"""SELECT r.*, l.pre_limit FROM (SELECT *, rank() OVER (PARTITION BY request_id, cand ORDER BY words DESC, typos) AS place FROM {p}rules) r
    JOIN {cands} l USING (request_id, cand) WHERE place <= l.pre_limit""",
    )
    view(
        f"{p}placed",
        [f"{p}front", "query_expansion", "tokens"],
        f"""SELECT DISTINCT l.request_id, l.cand, l.id, t.attr, q.term_idx, t.pos FROM {p}front l
    JOIN query_expansion q ON q.request_id = l.request_id AND q.cand = l.cand JOIN tokens t ON t.id = l.id AND t.term = q.term""",
    )
    view(
        f"{p}gaps",
        [f"{p}placed"],
        f"""SELECT request_id, cand, id, term_idx AS pair, least(8, min(gap)) AS gap FROM (
      SELECT a.request_id, a.cand, a.id, a.term_idx, least(coalesce(a.pos - b.pos, 8), coalesce(c.pos - a.pos, 8)) AS gap FROM {p}placed a
      ASOF LEFT JOIN {p}placed b ON a.request_id = b.request_id AND a.cand = b.cand AND a.id = b.id AND a.attr = b.attr AND b.term_idx = a.term_idx + 1 AND a.pos >= b.pos
      ASOF LEFT JOIN {p}placed c ON a.request_id = c.request_id AND a.cand = c.cand AND a.id = c.id AND a.attr = c.attr AND c.term_idx = a.term_idx + 1 AND a.pos <= c.pos)
    GROUP BY 1, 2, 3, 4""",
    )
    view(
        f"{p}near",
        [f"{p}front", f"{p}gaps"],
        f"""SELECT l.request_id, l.cand, l.id, CASE WHEN n_terms <= 1 THEN 1.0 ELSE coalesce(g.s, 0) / (8.0 * (n_terms - 1)) END AS proximity
    FROM {p}front l LEFT JOIN (SELECT request_id, cand, id, sum(8 - gap) AS s FROM {p}gaps GROUP BY 1, 2, 3) g USING (request_id, cand, id)""",
    )
    view(
        f"{p}ladder_hits",
        [f"{p}front", f"{p}near"],
        f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id, cand ORDER BY words DESC, typos, proximity DESC, attr, exact DESC, id) AS rank FROM (
      SELECT l.*, n.proximity, round(CAST(0.6 * words / n_terms + 0.15 * (1.0 - typos / (2.0 * words)) + 0.1 * proximity + 0.1 * (3 - attr) / 3.0 + 0.05 * exact / words AS DOUBLE), 9) AS score
      FROM {p}front l JOIN {p}near n USING (request_id, cand, id))) WHERE rank <= pre_limit""",
    )
    view(
        f"{p}keyword_hits",
        ["index_terms", "index_frequencies", "index_size", "terms", cands, ok],
        f"""SELECT request_id, cand, id, rank, CASE WHEN best > 0 THEN round(score / best, 6) ELSE 0.0 END AS score FROM (
      SELECT *, max(score) OVER (PARTITION BY request_id, cand) AS best FROM (
        SELECT *, row_number() OVER (PARTITION BY request_id, cand ORDER BY score DESC, id) AS rank FROM (
          SELECT q.request_id, q.cand, t.id, l.pre_limit, round(sum(ln(1 + (n.n - f.df + 0.5) / (f.df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / n.avg))), 6) AS score
          FROM index_terms t JOIN index_frequencies f USING (term) JOIN terms q USING (term) JOIN {cands} l ON l.request_id = q.request_id AND l.cand = q.cand
          JOIN {ok} a ON a.request_id = q.request_id AND a.cand = q.cand AND a.id = t.id, index_size n GROUP BY 1, 2, 3, 4)) WHERE rank <= pre_limit)""",
    )
    view(
        f"{p}semantic_hits",
        [cands, "vectors", ok],
        f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id, cand ORDER BY score DESC, id) AS rank FROM (
      SELECT c.request_id, c.cand, c.pre_limit, v.id, round(list_cosine_similarity(c.vector, v.vector), 6) AS score
      FROM {cands} c JOIN {ok} a USING (request_id, cand) JOIN vectors v ON v.id = a.id WHERE c.vector IS NOT NULL)) WHERE rank <= pre_limit""",
    )
    view(
        f"{p}hybrid_hits",
        [f"{p}keyword_hits", f"{p}semantic_hits", cands],
        f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id, cand ORDER BY score DESC, id) AS rank FROM (
      SELECT request_id, cand, id, kw_score, sem_score, pre_limit, CAST((1 - r) * coalesce(kw_score, 0) + r * coalesce(sem_score, 0) AS DOUBLE) AS score FROM (
        SELECT request_id, cand, id, k.score AS kw_score, s.score AS sem_score FROM {p}keyword_hits k FULL OUTER JOIN {p}semantic_hits s USING (request_id, cand, id))
      JOIN (SELECT request_id, cand, pre_limit, CASE WHEN vector IS NULL THEN 0.0 ELSE CAST(ratio AS DOUBLE) END AS r FROM {cands}) USING (request_id, cand)))
    WHERE rank <= pre_limit""",
    )


view("index_words", ["corpus"], f"SELECT id, {sql_words("(title || ' ' || content)")} AS w FROM corpus")
view("index_terms", ["index_words"], "SELECT id, term, dl, count(*)::DOUBLE AS tf FROM (SELECT id, len(w)::DOUBLE AS dl, unnest(w) AS term FROM index_words) GROUP BY 1, 2, 3")
view("index_frequencies", ["index_terms"], "SELECT term, count(*)::DOUBLE AS df FROM index_terms GROUP BY 1")
view("index_size", ["index_words"], "SELECT count(*)::DOUBLE AS n, avg(len(w)) AS avg FROM index_words WHERE len(w) > 0")
search_views("", "candidates", "allowed")


def tokens(spark, d):
    return lexical.tokenize_fields(corpus(spark, d))


# -- keyword rules --------------------------------------------------------
@query(
    "k1_tokenize_fields",
    with_views(["tokens"], "SELECT id, attr::BIGINT AS attr, count(*) AS n, string_agg(pos || ' ' || term, '|' ORDER BY pos) AS terms FROM tokens GROUP BY 1, 2"),
)
def k1(spark, d):
    """All terms of every field with their positions, one row per document and field."""
    return lexical.placed_terms(corpus(spark, d))


@query(
    "k2_words_rule",
    with_views(["terms", "postings"], "SELECT request_id, cand, id, count(*) AS words FROM terms JOIN postings USING (term) GROUP BY 1, 2, 3"),
)
def k2(spark, d):
    """How many words of each query every document has, without typos, prefixes and filters."""
    return rules.rule_counts(searched(spark, d, expanded=False)).select(*CAND, "id", "words")


@query(
    "k3_typo_rule",
    with_views(
        ["vocabulary", "asked_terms"],
        f"""SELECT DISTINCT q_term, term, CAST({sql_edits("q_term", "term")} AS BIGINT) AS typos FROM asked_terms JOIN vocabulary ON length(term) BETWEEN length(q_term) - k AND length(q_term) + k
WHERE k > 0 AND term <> q_term AND {sql_edits("q_term", "term")} <= k""",
    ),
)
def k3(spark, d):
    terms = lexical.search_terms(candidates(spark, d))
    return lexical.fuzzy_pairs(terms, tokens(spark, d).select("term").distinct())


@query(
    "k4_prefix_match",
    with_views(["vocabulary", "asked_terms"], "SELECT q_term, term FROM asked_terms JOIN vocabulary ON starts_with(term, q_term) AND term <> q_term WHERE is_last"),
)
def k4(spark, d):
    last = lexical.search_terms(candidates(spark, d)).filter("term_idx = n_terms - 1")
    return lexical.prefix_pairs(last, tokens(spark, d).select("term").distinct())


def searched(spark, d, expanded=True):
    return rules.stored_words(corpus(spark, d), candidates(spark, d), expanded)


@query("k5_proximity_rule", with_views(["near"], "SELECT request_id, cand, id, round(CAST(proximity AS DOUBLE), 9) AS proximity FROM near"))
def k5(spark, d):
    return rules.front(searched(spark, d)).select(*CAND, "id", F.round("proximity", 9).alias("proximity"))


@query("k6_attribute_rule", with_views(["rules"], "SELECT request_id, cand, id, CAST(attr AS BIGINT) AS attr FROM rules"))
def k6(spark, d):
    return rules.rule_counts(searched(spark, d)).select(*CAND, "id", "attr")


@query("k7_exactness_rule", with_views(["rules"], "SELECT request_id, cand, id, words, typos, round(exact / CAST(words AS DOUBLE), 9) AS exactness FROM rules"))
def k7(spark, d):
    return rules.rule_counts(searched(spark, d)).select(*CAND, "id", "words", "typos", F.round(F.col("exact") / F.col("words"), 9).alias("exactness"))


@query("k8_keyword_score", with_views(["ladder_hits"], "SELECT request_id, cand, id, rank, score FROM ladder_hits"))
def k8(spark, d):
    words = searched(spark, d)
    best = lexical.weighted_rules(rules.front(words), largest(words.candidates, "pre_limit"))
    return best.select(*CAND, "id", "rank", "score")


def sql_bm25(docs: str, terms: str) -> str:
    """BM25 over the content of a view, best 50 documents of each query."""
    w = sql_words("content")
    return f"""SELECT request_id, cand, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY request_id, cand ORDER BY score DESC, id) AS rank FROM (
  SELECT request_id, cand, id, round(sum(ln(1 + (n.n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / n.avg))), 6) AS score
  FROM (SELECT id, term, count(*)::DOUBLE AS tf FROM (SELECT id, unnest({w}) AS term FROM {docs}) GROUP BY 1, 2) t
  JOIN (SELECT term, count(DISTINCT id)::DOUBLE AS df FROM (SELECT id, unnest({w}) AS term FROM {docs}) GROUP BY 1) f USING (term)
  JOIN (SELECT id, len({w})::DOUBLE AS dl FROM {docs}) l USING (id)
  JOIN {terms} q USING (term), (SELECT count(*)::DOUBLE AS n, avg(len({w})) AS avg FROM {docs} WHERE len({w}) > 0) n
  GROUP BY 1, 2, 3)) WHERE rank <= 50"""


def best_by_bm25(cands, docs):
    index = lexical.term_index(docs, ["content"])
    return lexical.bm25(cands, index, k=50, filtered=False).select(*CAND, "id", "score", "rank")


@query("k9_bm25", with_views(["terms", "corpus"], sql_bm25("corpus", "terms")))
def k9(spark, d):
    return best_by_bm25(candidates(spark, d), corpus(spark, d))


# The given texts have no CJK characters; these stand for some of their letters.
LETTERS, SIGNS = "aeinorst", "合作夥伴計劃公告"
view("cjk_corpus", ["corpus"], f"SELECT id, translate(content, '{LETTERS}', '{SIGNS}') AS content FROM corpus")
view("cjk_queries", ["candidates"], f"SELECT request_id, cand, translate(query, '{LETTERS}', '{SIGNS}') AS query FROM candidates")
view("cjk_terms", ["cjk_queries"], f"SELECT DISTINCT request_id, cand, unnest({sql_words('query')}) AS term FROM cjk_queries")


@query("k9_bm25_cjk", with_views(["cjk_terms", "cjk_corpus"], sql_bm25("cjk_corpus", "cjk_terms")))
def k9_cjk(spark, d):
    docs = corpus(spark, d).withColumn("content", F.translate("content", LETTERS, SIGNS))
    return best_by_bm25(candidates(spark, d).withColumn("query", F.translate("query", LETTERS, SIGNS)), docs)


# -- vectors and blending -------------------------------------------------
@query("v1_cosine_topk", with_views(["semantic_hits"], "SELECT request_id, cand, id, score, rank FROM semantic_hits"))
def v1(spark, d):
    return vector.cosine_topk(candidates(spark, d), vectors(spark, d)).select(*CAND, "id", "score", "rank")


@query("v2_cosine_topk_lsh")
def v2(spark, d):
    asked = candidates(spark, d).filter(F.col("vector").isNotNull())
    return vector.cosine_topk_lsh(asked, vectors(spark, d), dim=64, k=10).select(*CAND, "id", "score", "rank")


@query(
    "v2_lsh_recall",
    with_views(["candidates"], "SELECT count(*) AS n_queries, true AS recall_holds FROM candidates WHERE vector IS NOT NULL"),
)
def v2_recall(spark, d):
    """Whether the approximate form finds nine tenths of the exact ten nearest, over all queries."""
    asked = materialise(candidates(spark, d).filter(F.col("vector").isNotNull()).select(*CAND, "vector", F.lit(10).alias("ten")), "asked")
    stored = materialise(vectors(spark, d).select("id", "vector"), "stored")
    exact = vector.cosine_topk(asked, stored, "ten", filtered=False).select(*CAND, "id")
    near = vector.cosine_topk_lsh(asked, stored, dim=64, k=10).select(*CAND, "id", F.lit(1).alias("hit"))
    found = exact.join(near, [*CAND, "id"], "left").agg(F.sum("hit").alias("hits"), F.count("*").alias("n"))
    queries = asked.agg(F.count("*").alias("n_queries"))
    return queries.crossJoin(found).select("n_queries", (F.col("hits") >= 0.9 * F.col("n")).alias("recall_holds"))


@query("h1_hybrid", with_views(["hybrid_hits"], "SELECT request_id, cand, id, kw_score, sem_score, score FROM hybrid_hits"))
def h1(spark, d):
    cands = candidates(spark, d)
    keyword = search.keyword_search(cands, search.stored_index(corpus(spark, d)))
    return ranking.hybrid(keyword, vector.cosine_topk(cands, vectors(spark, d)), cands).select(*CAND, "id", "kw_score", "sem_score", "score")


@query("h2_multi_search", with_views(["hybrid_hits"], "SELECT request_id, cand, id, rank, score FROM hybrid_hits"))
def h2(spark, d):
    return search.multi_search(candidates(spark, d), search.stored_index(corpus(spark, d)), vectors(spark, d)).select(*CAND, "id", "rank", "score")


@query(
    "h3_single_search",
    with_views(
        ["vectors"],
        """SELECT v.id, round(list_cosine_similarity(v.vector, q.vector), 6) AS score FROM vectors v, (SELECT CAST(embedding AS DOUBLE[]) AS vector FROM embeddings WHERE vec_id = 0) q
ORDER BY score DESC, v.id LIMIT 20""",
    ),
)
def h3(spark, d):
    probe = table(spark, d, "embeddings").filter("vec_id = 0").select(F.col("embedding").cast("array<double>")).scalar()
    scored = vectors(spark, d).withColumn("q", probe).select("id", F.round(vector.cosine(F.col("vector"), F.col("q")), 6).alias("score"))
    return ranking.single_search(scored, 20)


# -- reranking and merging (over the vector hits of every query) -----------
def vector_hits(spark, d):
    return vector.cosine_topk(candidates(spark, d), vectors(spark, d)).select(*CAND, "id", "score", "rank")


def hits_with_texts(spark, d):
    limits = candidates(spark, d).filter("cand = 0")
    return search.with_documents(ranking.dedupe_hits(vector_hits(spark, d)), corpus(spark, d), limits)


view(
    "deduped",
    ["semantic_hits"],
    """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id, id ORDER BY cand, rank) AS rn FROM semantic_hits) WHERE rn = 1""",
)


def sql_reranked(source: str, limits: str = "limits") -> str:
    squash = "translate(lower({}), ' -', '')"
    return f"""SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY rerank_score DESC, cand, rank) AS position FROM (
  SELECT *, CASE WHEN n_keys = 0 THEN '0/0' ELSE n_found || '/' || n_keys END AS has_keyword, CASE WHEN n_keys = 0 THEN 0.0 ELSE CAST(n_found AS DOUBLE) / n_keys END AS hit_ratio,
    CASE WHEN n_keys = 0 THEN score ELSE greatest(0.0, least(1.0, s * (1.0 - 0.15 * (1.0 - CAST(n_found AS DOUBLE) / n_keys)) + 0.6 * (CAST(n_found AS DOUBLE) / n_keys) * (1.0 - s))) END AS rerank_score
  FROM (SELECT h.request_id, h.cand, h.rank, h.id, h.score, greatest(0.0, least(1.0, h.score)) AS s, d.title, d.content, d.link, d.heading_link, d.token, d.website, d.year_month, d.year,
      l.final_limit, len(l.must_have) AS n_keys, len(list_filter(l.must_have, lambda k: k <> '' AND (contains({squash.format("d.title")}, {squash.format("k")}) OR contains({squash.format("d.content")}, {squash.format("k")})))) AS n_found
    FROM {source} h JOIN corpus d USING (id) JOIN {limits} l USING (request_id)))"""


def sql_merged(source: str) -> str:
    """Fold of the chunks of one page in order of position."""
    return f"""SELECT * FROM (SELECT request_id, key, position, step, all_ids, content, token, max(step) OVER (PARTITION BY request_id, key) AS last FROM {source}_fold) WHERE step = last"""


def fold_views(prefix: str, source: str) -> None:
    view(f"{prefix}_steps", [source], f"SELECT *, link AS key, row_number() OVER (PARTITION BY request_id, link ORDER BY position) AS step FROM {source}")
    view(
        f"{prefix}_fold",
        [f"{prefix}_steps"],
        f"""SELECT request_id, key, position, step, [id] AS all_ids, content, token FROM {prefix}_steps WHERE step = 1
UNION ALL SELECT f.request_id, f.key, f.position, s.step, CASE WHEN list_contains(f.all_ids, s.id) THEN f.all_ids ELSE list_append(f.all_ids, s.id) END,
  CASE WHEN s.content <> '' AND NOT contains(f.content, s.content) THEN f.content || {_sep()} || s.content ELSE f.content END,
  CASE WHEN s.content <> '' AND NOT contains(f.content, s.content) THEN f.token + s.token ELSE f.token END
FROM {prefix}_fold f JOIN {prefix}_steps s ON s.request_id = f.request_id AND s.key = f.key AND s.step = f.step + 1""",
    )
    view(f"{prefix}_merged", [f"{prefix}_fold"], sql_merged(prefix))
    view(
        f"{prefix}_final",
        [f"{prefix}_merged", source],
        f"""SELECT * FROM (SELECT m.request_id, m.key AS link, m.all_ids, m.content, m.token, r.id, r.title, r.heading_link, r.website, r.year_month, r.year, r.score, r.rerank_score, r.hit_ratio, r.has_keyword,
    r.final_limit, row_number() OVER (PARTITION BY m.request_id ORDER BY m.position) AS rank
  FROM {prefix}_merged m JOIN {source} r ON r.request_id = m.request_id AND r.position = m.position) WHERE rank <= final_limit""",
    )


def _sep() -> str:
    from checks.views import sql_chars

    return sql_chars(C.CONTENT_SEPARATOR)


view("reranked", ["deduped", "corpus", "limits"], sql_reranked("deduped"))
view("cut", ["reranked"], "SELECT * FROM reranked WHERE position <= round_even(final_limit * 2.5, 0)")
fold_views("page", "cut")


@query("r1_dedupe_hits", with_views(["deduped"], "SELECT request_id, id, cand, rank, score FROM deduped"))
def r1(spark, d):
    return ranking.dedupe_hits(vector_hits(spark, d)).select("request_id", "id", "cand", "rank", "score")


@query("r2_normalize", "SELECT doc_id, translate(lower(text), ' -', '') AS squashed FROM documents")
def r2(spark, d):
    return table(spark, d, "documents").select("doc_id", text.squash(F.col("text")).alias("squashed"))


# Every document against the second word of its own text and of the next one.
R3_SQUASH = "translate(lower({}), ' -', '')"


@query(
    "r3_keyword_match",
    f"""SELECT d.doc_id, own, coalesce(own <> '' AND contains({R3_SQUASH.format("d.text")}, {R3_SQUASH.format("own")}), false) AS own_matched,
  coalesce(n.word <> '' AND contains({R3_SQUASH.format("d.text")}, {R3_SQUASH.format("n.word")}), false) AS next_matched
FROM (SELECT doc_id, text, split_part(text, ' ', 2) AS own FROM documents) d LEFT JOIN (SELECT doc_id - 1 AS doc_id, split_part(text, ' ', 2) AS word FROM documents) n USING (doc_id)""",
)
def r3(spark, d):
    docs = table(spark, d, "documents")
    word = F.split_part("text", F.lit(" "), F.lit(2))
    following = docs.select((F.col("doc_id") - 1).alias("doc_id"), word.alias("word"))
    matched = lambda k: F.coalesce(text.keyword_match(F.col("text"), F.col(k)), F.lit(False)).alias(f"{k}_matched")
    out = docs.select("doc_id", "text", word.alias("own")).join(following, "doc_id", "left")
    return out.select("doc_id", "own", matched("own"), matched("word")).withColumnRenamed("word_matched", "next_matched")


@query("r4_hit_ratio", with_views(["reranked"], "SELECT request_id, id, round(hit_ratio, 9) AS hit_ratio, has_keyword FROM reranked"))
def r4(spark, d):
    from noticeboard.functions.scoring import keyword_hits

    # ASCII capitals alone: others, as SS for ß, need not come back as the letters they were
    shouted = F.transform("must_have", lambda k: F.concat(F.lit(" "), F.translate(k, ascii_lowercase, ascii_uppercase)))
    keys = text.distinct_keywords(F.concat("must_have", shouted))
    hits = hits_with_texts(spark, d).withColumn("keys", keys).withColumn("found", keyword_hits(F.col("title"), F.col("content"), F.col("keys")))
    total = F.size("keys")
    return hits.select(
        "request_id", "id", F.round(F.coalesce(F.try_divide(F.col("found"), total), F.lit(0.0)), 9).alias("hit_ratio"),
        F.concat(F.col("found").cast("string"), F.lit("/"), total.cast("string")).alias("has_keyword"),
    )


@query(
    "r5_rerank_score",
    """SELECT event_id, round(greatest(0.0, least(1.0, s * (1.0 - 0.15 * (1.0 - r)) + 0.6 * r * (1.0 - s))), 9) AS score FROM (
  SELECT event_id, greatest(0.0, least(1.0, value / 20 - 0.1)) AS s, (user_id % 5) / 4.0 AS r FROM events)""",
)
def r5(spark, d):
    from noticeboard.functions.scoring import rerank_score

    score = rerank_score(F.col("value") / 20 - 0.1, (F.col("user_id") % 5) / F.lit(4.0))
    return table(spark, d, "events").select("event_id", F.round(score, 9).alias("score"))


@query(
    "r6_rerank",
    with_views(
        ["deduped", "corpus", "limits", "reranked"],
        """SELECT request_id, id, position, rerank_score, round(hit_ratio, 9) AS hit_ratio, has_keyword,
  CASE WHEN n_keys = 0 THEN 'none' ELSE 'keywords' END AS rerank_mode FROM reranked WHERE request_id % 4 <> 0
UNION ALL SELECT * FROM (SELECT request_id, id, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, cand, rank) AS position, score, NULL, 'disabled', 'disabled'
  FROM deduped WHERE request_id % 4 = 0)""",
    ),
)
def r6(spark, d):
    out = ranking.rerank(hits_with_texts(spark, d), F.col("request_id") % 4 != 0)
    return out.select("request_id", "id", "position", "rerank_score", F.round("hit_ratio", 9).alias("hit_ratio"), "has_keyword", "rerank_mode")


@query("r7_pre_merge_cut", with_views(["cut"], "SELECT request_id, id, position FROM cut"))
def r7(spark, d):
    return ranking.pre_merge_cut(ranking.rerank(hits_with_texts(spark, d))).select("request_id", "id", "position")


def results(spark, d):
    return ranking.rerank_and_merge(hits_with_texts(spark, d))


@query("g1_merge_links", with_views(["page_merged"], "SELECT request_id, key AS link, position, array_to_string(all_ids, '|') AS all_ids, content, token FROM page_merged"))
def g1(spark, d):
    merged = ranking.merge_links(ranking.pre_merge_cut(ranking.rerank(hits_with_texts(spark, d))))
    return merged.select("request_id", "link", "position", joined(F.col("all_ids")).alias("all_ids"), "content", "token")


@query("g2_final_cut", with_views(["page_final"], "SELECT request_id, link, rank, id, rerank_score FROM page_final"))
def g2(spark, d):
    return results(spark, d).select("request_id", "link", "rank", "id", "rerank_score")


view("full_deduped", ["hybrid_hits"], "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id, id ORDER BY cand, rank) AS rn FROM hybrid_hits) WHERE rn = 1")
view("full_reranked", ["full_deduped", "corpus", "limits"], sql_reranked("full_deduped"))
view("full_cut", ["full_reranked"], "SELECT * FROM full_reranked WHERE position <= round_even(final_limit * 2.5, 0)")
fold_views("full", "full_cut")


@query(
    "g3_full_search",
    with_views(["full_final"], "SELECT request_id, rank, link, id, title, array_to_string(all_ids, '|') AS all_ids, token, score, rerank_score, has_keyword FROM full_final"),
)
def g3(spark, d):
    docs = corpus(spark, d)
    out = search.search_candidates(candidates(spark, d), docs, search.stored_index(docs), vectors(spark, d))
    return out.select("request_id", "rank", "link", "id", "title", joined(F.col("all_ids")).alias("all_ids"), "token", "score", "rerank_score", "has_keyword")


# -- rounds ---------------------------------------------------------------
# First round: the keyword query alone. Second round: the other queries without
# the documents already seen.
view("first_hits", ["semantic_hits"], "SELECT * FROM semantic_hits WHERE cand = 0")
view("first_reranked", ["first_hits", "corpus", "limits"], sql_reranked("first_hits"))
view("first_cut", ["first_reranked"], "SELECT * FROM first_reranked WHERE position <= round_even(final_limit * 2.5, 0)")
fold_views("first", "first_cut")
view("first_seen", ["first_final"], "SELECT DISTINCT request_id, unnest(all_ids) AS id FROM first_final")
view(
    "second_hits",
    ["semantic_hits", "first_seen"],
    """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id, id ORDER BY cand, rank) AS rn FROM semantic_hits WHERE cand > 0
  AND (request_id, id) NOT IN (SELECT (request_id, id) FROM first_seen)) WHERE rn = 1""",
)
view("second_reranked", ["second_hits", "corpus", "limits"], sql_reranked("second_hits"))
view("second_cut", ["second_reranked"], "SELECT * FROM second_reranked WHERE position <= round_even(final_limit * 2.5, 0)")
fold_views("second", "second_cut")
view(
    "rounds",
    ["first_final", "second_final"],
    "SELECT *, 1 AS round FROM first_final UNION ALL SELECT *, 2 AS round FROM second_final",
)


def round_views(p: str, rounds_view: str, limits: str) -> None:
    """Merge of the results of all rounds and the final cut."""
    view(f"{p}steps", [rounds_view], f"SELECT *, row_number() OVER (PARTITION BY request_id, link ORDER BY round, rank) AS step FROM {rounds_view}")
    view(
        f"{p}fold",
        [f"{p}steps"],
        f"""SELECT request_id, link, step, round, rank, id, title, all_ids, content, token, score, rerank_score FROM {p}steps WHERE step = 1
UNION ALL SELECT f.request_id, f.link, s.step, f.round, f.rank, f.id, f.title, list_concat(f.all_ids, list_filter(s.all_ids, lambda x: NOT list_contains(f.all_ids, x))),
  CASE WHEN s.content <> '' AND NOT contains(f.content, s.content) THEN f.content || {_sep()} || s.content ELSE f.content END,
  CASE WHEN s.content <> '' AND NOT contains(f.content, s.content) THEN f.token + s.token ELSE f.token END,
  greatest(f.score, s.score), CASE WHEN s.score > f.score THEN s.rerank_score ELSE f.rerank_score END
FROM {p}fold f JOIN {p}steps s ON s.request_id = f.request_id AND s.link = f.link AND s.step = f.step + 1""",
    )
    view(f"{p}accumulated", [f"{p}fold"], f"SELECT * FROM (SELECT *, max(step) OVER (PARTITION BY request_id, link) AS last FROM {p}fold) WHERE step = last")
    view(
        f"{p}final_results",
        [f"{p}accumulated", limits],
        f"""SELECT * FROM (SELECT a.*, row_number() OVER (PARTITION BY a.request_id ORDER BY a.rerank_score DESC, a.round, a.rank) AS final_rank, l.final_limit
  FROM {p}accumulated a JOIN {limits} l USING (request_id)) WHERE final_rank <= final_limit""",
    )


round_views("", "rounds", "limits")


def rounds(spark, d):
    limits = candidates(spark, d).filter("cand = 0")
    docs, hits = corpus(spark, d), vector_hits(spark, d)
    first = ranking.rerank_and_merge(search.with_documents(hits.filter("cand = 0"), docs, limits))
    rest = ranking.exclude_seen(hits.filter("cand > 0"), first)
    second = ranking.rerank_and_merge(search.with_documents(ranking.dedupe_hits(rest), docs, limits))
    return first.withColumn("round", F.lit(1)).unionByName(second.withColumn("round", F.lit(2)))


def accumulated(spark, d):
    return ranking.accumulate_rounds(rounds(spark, d))


@query(
    "a1_accumulate_rounds",
    with_views(["accumulated"], "SELECT request_id, link, id, array_to_string(all_ids, '|') AS all_ids, content, token, score, rerank_score FROM accumulated"),
)
def a1(spark, d):
    return accumulated(spark, d).select("request_id", "link", "id", joined(F.col("all_ids")).alias("all_ids"), "content", "token", "score", "rerank_score")


@query("a2_seen_ids", with_views(["rounds"], "SELECT DISTINCT request_id, unnest(all_ids) AS id FROM rounds"))
def a2(spark, d):
    return ranking.seen_ids(rounds(spark, d))


def final_results(spark, d):
    limits = candidates(spark, d).filter("cand = 0").select("request_id", F.col("final_limit").alias("limit"))
    return ranking.final_results(accumulated(spark, d), limits)


@query("a3_final_results", with_views(["final_results"], "SELECT request_id, final_rank AS rank, link, id, rerank_score FROM final_results"))
def a3(spark, d):
    return final_results(spark, d).select("request_id", "rank", "link", "id", "rerank_score")


DECISIONS = "SELECT item_id AS request_id, CASE WHEN item_id % 6 <> 5 THEN length(text) > 160 END AS relevant FROM benchmark"


def decisions(spark, d):
    good = F.when(F.col("item_id") % 6 != 5, F.length("text") > 160)
    return table(spark, d, "benchmark").select(F.col("item_id").alias("request_id"), good.alias("relevant"))


@query(
    "a4_retry_plan",
    with_views(
        ["page_final", "limits"],
        f"""SELECT l.request_id, CAST(l.final_limit AS BIGINT) AS "limit", coalesce(c.n, 0) AS n_results,
  NOT (coalesce(c.n, 0) > 0 AND coalesce(x.relevant, true)) AS retry, CAST(least(50, floor(l.final_limit * 1.5)) AS BIGINT) AS retry_limit
FROM limits l LEFT JOIN (SELECT request_id, count(*) AS n FROM page_final GROUP BY 1) c USING (request_id) LEFT JOIN ({DECISIONS}) x USING (request_id)""",
    ),
)
def a4(spark, d):
    asked = candidates(spark, d).filter("cand = 0").select("request_id", F.col("final_limit").alias("limit"))
    return ranking.retry_plan(asked, results(spark, d), decisions(spark, d))


view("decisions", [], DECISIONS)
view(
    "retry_plan",
    ["full_final", "limits", "decisions"],
    """SELECT l.request_id, NOT (coalesce(c.n, 0) > 0 AND coalesce(x.relevant, true)) AS retry, CAST(least(50, floor(l.final_limit * 1.5)) AS BIGINT) AS retry_limit, l.final_limit AS first_limit
FROM limits l LEFT JOIN (SELECT request_id, count(*) AS n FROM full_final GROUP BY 1) c USING (request_id) LEFT JOIN decisions x USING (request_id)""",
)
view("full_seen", ["full_final"], "SELECT DISTINCT request_id, unnest(all_ids) AS id FROM full_final")
view(
    "again_candidates",
    ["candidates", "retry_plan"],
    """SELECT c.* REPLACE (r.retry_limit AS final_limit, CAST(floor(greatest(50, floor(r.retry_limit * 1.5 + 20)) * 1.5) AS BIGINT) AS pre_limit)
FROM candidates c JOIN retry_plan r USING (request_id) WHERE r.retry""",
)
view("again_limits", ["again_candidates"], "SELECT * FROM again_candidates WHERE cand = 0")
allowed_view("again_allowed", "again_candidates", "full_seen")
search_views("again_", "again_candidates", "again_allowed")
view("again_deduped", ["again_hybrid_hits"], "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id, id ORDER BY cand, rank) AS rn FROM again_hybrid_hits) WHERE rn = 1")
view("again_reranked", ["again_deduped", "corpus", "again_limits"], sql_reranked("again_deduped", "again_limits"))
view("again_cut", ["again_reranked"], "SELECT * FROM again_reranked WHERE position <= round_even(final_limit * 2.5, 0)")
fold_views("again", "again_cut")
view("both_rounds", ["full_final", "again_final"], "SELECT *, 1 AS round FROM full_final UNION ALL SELECT *, 2 AS round FROM again_final")
view("both_limits", ["retry_plan"], "SELECT request_id, CASE WHEN retry THEN retry_limit ELSE first_limit END AS final_limit FROM retry_plan")
round_views("both_", "both_rounds", "both_limits")


@query("two_rounds", with_views(["both_final_results"], "SELECT request_id, final_rank AS rank, link, id, rerank_score FROM both_final_results"))
def two_rounds(spark, d):
    out = search.two_rounds(candidates(spark, d), corpus(spark, d), vectors(spark, d), decisions(spark, d))
    return out.select("request_id", "rank", "link", "id", "rerank_score")


@query(
    "a5_query_history",
    with_views(
        ["queries", "requests"],
        """SELECT request_id, array_to_string(list_filter(h, lambda q, i: q <> '' AND list_position(h, q) = i), '|') AS query_history,
  array_to_string(list_sort(list_distinct(subs)), '|') AS all_sub_queries FROM (
  SELECT request_id, list_concat([user_query, keyword_query], list_concat(sub_queries, list_concat(['retry ' || keyword_query], list_concat(sub_queries, must_have)))) AS h,
    list_concat(sub_queries, must_have) AS subs FROM requests)""",
    ),
)
def a5(spark, d):
    req = requests(spark, d)
    first = req.select("request_id", "user_query", F.lit(1).alias("round"), "keyword_query", "sub_queries")
    second = req.select(
        "request_id", "user_query", F.lit(2).alias("round"), F.concat(F.lit("retry "), "keyword_query").alias("keyword_query"),
        F.concat("sub_queries", "must_have").alias("sub_queries"),
    )
    out = ranking.query_history(first.unionByName(second))
    return out.select("request_id", joined(F.col("query_history")).alias("query_history"), joined(F.col("all_sub_queries")).alias("all_sub_queries"))


@query(
    "a6_evidence_preview",
    with_views(
        ["page_final"],
        """SELECT request_id, string_agg('ID: ' || id || chr(10) || 'Title: ' || title || chr(10) || 'Content: ' || substr(content, 1, 200) || '...' || chr(10) || chr(10), '' ORDER BY rank) AS preview
FROM page_final WHERE rank <= 5 GROUP BY request_id""",
    ),
)
def a6(spark, d):
    return ranking.evidence_preview(results(spark, d))
