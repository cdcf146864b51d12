"""Quality rules: a decision list of threshold conjunctions learned from labelled statistics.

Sequential covering: grow a conjunction on two thirds of the labelled rows by
information gain, cut it back on the other third, keep it if it is precise
enough there, remove the rows it covers and go on. Each step is one grouped
aggregation over all labelled rows; only per-threshold counts (features times
bins) reach the driver. The list becomes one ``CASE WHEN``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeboard.llm import texts
from noticeboard.session import materialise

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
SYMBOLS = "[#*$%&|<>]"
FEATURES = ["n_words", "mean_word", "symbol_rate", "dup_line_rate", "repeat_rate", "shout_rate", "mark_rate"]
#: Thresholds per feature, rules in a list, conditions in a rule.
BINS, MAX_RULES, MAX_CONDITIONS = 24, 12, 4
#: A rule must cover this many rows of the pruning third, this share of them bad.
MIN_COVER, MIN_PRECISION = 4, 0.95


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = F.col(self.feature)
        return value > F.lit(self.threshold) if self.above else value <= F.lit(self.threshold)


Rule = list[Condition]


def repeated_words(words: Column) -> Column:
    """Words inside 8-word windows that the text holds twice or more, each word once.

    Windows are compared by a 64-bit hash. Only texts with a repeated window pay
    for the sort.
    """

    def covered(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def at(pairs: Column) -> Column:
            last = F.size(pairs) - 1
            same = lambda k: (
                ((k > 0) & (F.get(pairs, k - 1)["h"] == F.get(pairs, k)["h"]))
                | ((k < last) & (F.get(pairs, k + 1)["h"] == F.get(pairs, k)["h"]))
            )
            twice = F.filter(F.sequence(F.lit(0), last), same)
            places = F.sort_array(F.transform(twice, lambda k: F.get(pairs, k)["i"]))
            start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
            step = lambda acc, x: F.struct((acc["n"] + F.least(F.lit(WINDOW), x - acc["last"])).alias("n"), x.alias("last"))
            return F.aggregate(places, start, step)["n"]

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(texts.let(pairs, at))

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(w) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(w, i, WINDOW)))

    return texts.let(
        words, lambda w: F.when(F.size(w) < WINDOW, F.lit(0)).otherwise(texts.let(windows(w), covered))
    ).cast("long")


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the base statistics and the rates that rules use; null counts as empty."""
    body = F.coalesce(F.col(text), F.lit(""))
    line_stats = lambda lines: F.struct(
        F.size(lines).cast("long").alias("lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("twice"),
    )
    stats = lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.aggregate(w, F.lit(0).cast("long"), lambda n, x: n + F.length(x)).alias("word_chars"),
        repeated_words(w).alias("n_repeat_words"),
    )
    out = docs.withColumns(
        {
            "_w": texts.let(texts.words(F.col(text)), stats),
            "_l": texts.let(F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^ \t-\r]")), line_stats),
            "n_symbols": F.regexp_count(body, F.lit(SYMBOLS)).cast("long"),
            "_shout": F.regexp_count(body, F.lit(r"\p{Lu}\p{Lu}")),
            "_marks": F.regexp_count(body, F.lit(r"[!?]")),
        }
    )
    words = F.greatest(F.col("_w.n_words"), F.lit(1))
    return out.withColumns(
        {
            "n_words": F.col("_w.n_words"),
            "word_chars": F.col("_w.word_chars"),
            "n_dup_lines": F.col("_l.twice"),
            "n_repeat_words": F.col("_w.n_repeat_words"),
            "mean_word": F.col("_w.word_chars") / words,
            "symbol_rate": F.col("n_symbols") / words,
            "dup_line_rate": F.col("_l.twice") / F.greatest(F.col("_l.lines"), F.lit(1)),
            "repeat_rate": F.col("_w.n_repeat_words") / words,
            "shout_rate": F.col("_shout") / words,
            "mark_rate": F.col("_marks") / words,
        }
    ).drop("_w", "_l", "_shout", "_marks")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def matches(rule: Rule) -> Column:
    return reduce(lambda a, b: a & b, [c.column() for c in rule])


def verdict(rules: list[Rule]) -> Column:
    """The ordered list as one conditional expression: true keeps a row."""
    out = F
    for rule in rules:
        out = out.when(matches(rule), F.lit(False))
    return out.otherwise(F.lit(True)) if rules else F.lit(True)


def thresholds(rows: DataFrame) -> dict[str, list[float]]:
    """Distinct quantiles of every feature over the labelled rows: of all values and of those above zero."""
    shares = [(i + 1) / (BINS // 2 + 1) for i in range(BINS // 2)]
    quantiles = lambda x: F.percentile_approx(x.cast("double"), shares, 10000)
    row = rows.agg(
        *[quantiles(F.col(f)).alias(f) for f in FEATURES],
        *[quantiles(F.when(F.col(f) > 0, F.col(f))).alias(f"{f}_above") for f in FEATURES],
        *[(F.min(F.when(F.col(f) > 0, F.col(f))) / 2).alias(f"{f}_least") for f in FEATURES],
    ).first()
    least = {f: [row[f"{f}_least"]] if row[f"{f}_least"] else [] for f in FEATURES}
    return {f: sorted({*(row[f] or []), *(row[f"{f}_above"] or []), *least[f]}) for f in FEATURES}


def _gain(p: float, n: float, p0: float, n0: float) -> float:
    """Information gain of narrowing (p0, n0) rows to (p, n)."""
    if not p:
        return 0.0
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))


def _best_condition(rows: DataFrame, cuts: dict[str, list[float]]) -> tuple[Condition | None, float]:
    """The condition of the largest gain, from one aggregation by (feature, bin)."""
    place = lambda f: reduce(lambda a, b: a + b, [(F.col(f) > F.lit(c)).cast("int") for c in cuts[f]])
    used = [f for f in FEATURES if cuts[f]]
    if not used:
        return None, 0.0
    long = rows.select("bad", F.explode(F.array(*[F.struct(F.lit(f).alias("f"), place(f).alias("b")) for f in used])).alias("x"))
    counts = long.groupBy("x.f", "x.b").agg(F.sum("bad").alias("p"), F.sum(1 - F.col("bad")).alias("n")).collect()
    best, best_gain = None, 0.0
    for f in used:
        cells = {r["b"]: (r["p"], r["n"]) for r in counts if r["f"] == f}
        p0, n0 = sum(c[0] for c in cells.values()), sum(c[1] for c in cells.values())
        low_p = low_n = 0
        for i, cut in enumerate(cuts[f]):
            p, n = cells.get(i, (0, 0))
            low_p, low_n = low_p + p, low_n + n
            for above, (q, m) in ((False, (low_p, low_n)), (True, (p0 - low_p, n0 - low_n))):
                if (g := _gain(q, m, p0, n0)) > best_gain + 1e-9:
                    same = i  # cuts up to the next value that occurs do the same: take the middle one
                    while same + 1 < len(cuts[f]) and same + 1 not in cells:
                        same += 1
                    best, best_gain = Condition(f, above, cuts[f][(i + same + 1) // 2]), g
    return best, best_gain


def _grow(rows: DataFrame, cuts: dict[str, list[float]]) -> Rule:
    rule: Rule = []
    for _ in range(MAX_CONDITIONS):
        condition, _gained = _best_condition(rows.filter(matches(rule)) if rule else rows, cuts)
        if condition is None:
            break
        rule.append(condition)
    return rule


def _prune(rows: DataFrame, rule: Rule) -> Rule | None:
    """The shortest prefix that does best on the pruning rows, or none if it isn't precise enough."""
    sums = []
    for k in range(1, len(rule) + 1):
        hit = matches(rule[:k])
        sums += [F.sum(F.when(hit, F.col("bad"))).alias(f"p{k}"), F.sum(F.when(hit, 1 - F.col("bad"))).alias(f"n{k}")]
    row = rows.agg(*sums).first()
    best, best_value = None, -2.0
    for k in range(1, len(rule) + 1):
        p, n = row[f"p{k}"] or 0, row[f"n{k}"] or 0
        if p + n >= MIN_COVER and p >= MIN_PRECISION * (p + n) and (value := (p - n) / (p + n)) > best_value + 1e-9:
            best, best_value = rule[:k], value
    return best


def learn_rules(labelled: DataFrame) -> list[Rule]:
    """Rules that reject, in order, from rows with the features, ``bad`` (0 or 1) and ``pruning`` (boolean)."""
    cuts = thresholds(labelled)
    grow, prune = labelled.filter(~F.col("pruning")), labelled.filter("pruning")
    rules: list[Rule] = []
    while len(rules) < MAX_RULES:
        rule = _grow(grow, cuts)
        rule = _prune(prune, rule) if rule else None
        if rule is None:
            break
        rules.append(rule)
        rest = ~matches(rule)
        grow, prune = grow.filter(rest), prune.filter(rest)
    return rules


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Statistics and verdict of every row of ``docs``.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed and kept, one row per row of ``docs``. Null texts count as empty
    and fail; a null or repeated id is judged by its text like any other; labels
    other than 0 and 1 and labels of unknown ids are passed over; conflicting
    labels of one id count as their smaller value. Without labels no rule is
    learned and ``kept`` is the base verdict alone. Empty tables give no rows.
    """
    stats = materialise(
        with_statistics(docs.select("doc_id", "text")).drop("text").withColumn("base_failed", base_failed()), "quality"
    )
    marks = labels.filter(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    labelled = stats.filter(~F.col("base_failed")).join(marks, "doc_id").select(
        *FEATURES, (1 - F.col("quality")).alias("bad"), (texts.bucket(F.col("doc_id"), 3) == 0).alias("pruning")
    )
    rules = learn_rules(materialise(labelled, "quality-labelled"))
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return stats.select(*names, (~F.col("base_failed") & verdict(rules)).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the base rules and the learned list keep, all columns unchanged.

    The list is learned from rows that pass the base rules. Handles nulls, empty
    tables and extra columns like :func:`judge`; no rows are matched by id, so
    repeated ids are harmless.
    """
    key = F.col("doc_id") if "doc_id" in docs.columns else F.lit(None).cast("long")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), key.alias("doc_id"), F.col("text").alias("text"))
    # written with its statistics, so that texts are read once and never shuffled
    judged = materialise(with_statistics(rows).drop("text").withColumn("base_failed", base_failed()), "judged")
    marks = labels.filter(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    labelled = judged.select("doc_id", "base_failed", *FEATURES).filter(~F.col("base_failed")).join(marks, "doc_id").select(
        *FEATURES, (1 - F.col("quality")).alias("bad"), (texts.bucket(F.col("doc_id"), 3) == 0).alias("pruning")
    )
    rules = learn_rules(materialise(labelled, "quality-labelled"))
    return judged.filter(~F.col("base_failed") & verdict(rules)).select("_row.*")
