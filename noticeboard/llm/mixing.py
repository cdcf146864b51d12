"""Mix sources to target weights by repeating documents.

Words are summed per source, targets become repetition rates, and a document is
emitted floor(rate) times plus once more with the probability of the fraction,
decided by a hash of its id. Only one row per source is ever sorted together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticeboard.llm import texts
from noticeboard.session import materialise

#: Weights of sources in order of their names, repeating.
WEIGHTS = (5, 2, 1)
#: Words of the mix against words of the input, and of a source's target against its own words.
TOTAL_SHARE, MAX_REPEATS = 1.5, 2.0
SEED = "mix-1"
HASH_DIGITS = 13


def uniform(key: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) fixed by the key and the seed."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(digest, 1, HASH_DIGITS), 16, 10).cast("double") / F.lit(float(16**HASH_DIGITS))


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) from rows of (source, size).

    Sources in order of their names, null last, take the weights in turn. The
    excess over ``MAX_REPEATS`` times a source's words is shared again by weight
    until no target is above; that end state fills sources in the order of their
    cap per weight, so sorted sums give it without iterating.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(WEIGHTS)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (place + 1).cast("int"))
    ranked = per_source.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(MAX_REPEATS))
    order = [(F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last()]
    upto = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    onwards = Window.orderBy(*order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    levels = ranked.withColumns(
        {
            "rest": F.sum("source_size").over(everything) * F.lit(TOTAL_SHARE) - F.coalesce(F.sum("cap").over(upto), F.lit(0.0)),
            "weights": F.sum("weight").over(onwards),
        }
    )
    capped = F.col("cap") * F.col("weights") <= F.col("rest") * F.col("weight")
    levels = levels.withColumn("capped", capped)
    # the first source below its cap sets the level for itself and all after it
    first = F.min_by(F.struct("rest", "weights"), F.struct(*[(F.col("cap") / F.col("weight")).alias("a"), F.col("source").isNull().alias("b"), F.col("source").alias("c")]))
    level = first.over(Window.partitionBy("capped"))
    shared = level["rest"] * F.col("weight") / level["weights"]
    return levels.withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(shared)).select(
        "source", "source_size", "target"
    )


def plan(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, copies.

    Null texts have size 0, null sources form the last source, rows with equal ids
    share one draw, and an empty table gives no rows. No document is taken more
    than ``MAX_REPEATS`` times, since no rate is above it.
    """
    sizes = docs.select(
        F.col(f"`{key}`").alias("doc_id"), F.col(f"`{source}`").alias("source"), texts.word_count(F.col(f"`{text}`")).alias("size")
    )
    sizes = materialise(sizes, "sizes")
    wanted = materialise(targets(sizes), "targets")
    held = wanted.agg(F.sum(F.length(F.coalesce("source", F.lit(""))) * 4 + 32)).first()[0] or 0
    out = texts.spread_lookup(sizes, wanted, "source", held, F.col("doc_id"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(rate)
    return out.withColumn("copies", (whole + (uniform(F.col("doc_id")) < rate - whole).cast("long")).cast("long"))


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``docs`` with every row repeated as often as the mix takes it, columns unchanged.

    Nulls, empty tables and repeated ids as in :func:`plan`; extra columns may have any names.
    """
    sizes = docs.select(F.col(f"`{source}`").alias("source"), texts.word_count(F.col(f"`{text}`")).alias("size"))
    wanted = materialise(targets(sizes), "targets")
    held = wanted.agg(F.sum(F.length(F.coalesce("source", F.lit(""))) * 4 + 32)).first()[0] or 0
    # the given row travels as one column, so that its names cannot meet those used here
    given = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("given")
    rows = docs.select(given, F.col(f"`{source}`").alias("source"), F.col(f"`{key}`").alias("key"))
    out = texts.spread_lookup(rows, wanted, "source", held, F.col("key"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(rate)
    copies = (whole + (uniform(F.col("key")) < rate - whole).cast("long")).cast("int")
    return out.select("given", F.explode(F.array_repeat(F.lit(1), copies))).select("given.*")
