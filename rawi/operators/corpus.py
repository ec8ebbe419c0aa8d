"""Corpus statistics, value lists, feasibility and profiles."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rawi.functions.text import norm, strip, verse_count
from rawi.operators.search import ATTRIBUTES, Criteria, attribute_hit, predicate


def _filled(c: str) -> Column:
    value = strip(F.coalesce(F.col(c), F.lit("")))
    return F.when(value != "", value)


def statistics(corpus: DataFrame) -> DataFrame:
    """One row: totals, distinct values, line counts and sorted value lists; no row for an empty corpus."""
    count = verse_count(F.col("verses"))
    return corpus.agg(
        F.count("*").alias("total"),
        *[F.countDistinct(_filled(a)).alias(f"n_{a}") for a in ("meter", "theme", "poet_name", "poet_era")],
        F.avg(count).alias("avg_verses"),
        F.min(count).cast("long").alias("min_verses"),
        F.max(count).cast("long").alias("max_verses"),
        *[F.sort_array(F.collect_set(_filled(a))).alias(f"{a}_values") for a in ("meter", "theme", "poet_era", "qafiya")],
    ).filter("total > 0")


def inverted_index(corpus: DataFrame, attribute: str) -> DataFrame:
    """Normalised value -> number of rows and their first and last ordinals (the lists themselves are a filter away)."""
    return corpus.groupBy(norm(F.col(attribute)).alias("value")).agg(F.count("*").alias("n"), F.min("poem_idx").alias("first_idx"), F.max("poem_idx").alias("last_idx")).filter("value <> ''")


def values(corpus: DataFrame, attribute: str) -> DataFrame:
    """Sorted distinct trimmed values of an attribute."""
    return corpus.select(_filled(attribute).alias("value")).filter("value is not null").distinct().orderBy("value")


def exists(corpus: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """One row: for each attribute, does any row hold the key?"""
    return corpus.agg(*[F.coalesce(F.bool_or(attribute_hit(a, k)), F.lit(False)).alias(f"has_{a}") for a, k in wanted.items()])


def variations(corpus: DataFrame, attribute: str, key: str) -> DataFrame:
    """Spellings that hold the key: the first row's spelling of each normalised value."""
    hit = corpus.filter(attribute_hit(attribute, key))
    first = hit.groupBy(norm(F.col(attribute)).alias("value")).agg(F.min_by(strip(F.col(attribute)), F.col("poem_idx")).alias("spelling"))
    return first.select("spelling").distinct()


def constraint_statistics(corpus: DataFrame, criteria: Criteria) -> DataFrame:
    """One row from one scan: matches per attribute, of all and of any, and their share of the corpus."""
    given = [a for a in ATTRIBUTES if getattr(criteria, a)]
    share = lambda c: F.when(F.count("*") > 0, F.count_if(c) * 100.0 / F.count("*")).otherwise(F.lit(0.0))
    all_, any_ = predicate(replace(criteria, mode="AND")), predicate(replace(criteria, mode="OR"))
    return corpus.agg(
        F.count("*").alias("total"),
        *[F.count_if(attribute_hit(a, getattr(criteria, a))).alias(f"{a}_matches") for a in given],
        F.count_if(all_).alias("all_matches"),
        F.count_if(any_).alias("any_matches"),
        share(all_).alias("all_percent"),
        share(any_).alias("any_percent"),
    )


def feasibility(corpus: DataFrame, criteria: Criteria) -> DataFrame:
    """One row: can the request be met, which attributes are unknown, and how many rows meet all."""
    given = [a for a in ("meter", "theme", "qafiya") if getattr(criteria, a)]
    known = {a: F.coalesce(F.bool_or(attribute_hit(a, getattr(criteria, a))), F.lit(False)) for a in given}
    both = F.count_if(predicate(replace(criteria, mode="AND")))
    row = corpus.agg(*[k.alias(a) for a, k in known.items()], both.alias("all_matches"))
    issues = F.filter(F.array(*[F.when(~F.col(a), F.lit(f"unknown {a}")) for a in given]), lambda x: x.isNotNull()) if given else F.array().cast("array<string>")
    issues = F.when(F.col("all_matches") == 0, F.concat(issues, F.array(F.lit("no row meets all")))).otherwise(issues)
    return row.select((F.size(issues) == 0).alias("feasible"), F.array_join(issues, "; ").alias("issues"), "all_matches")


def suggestions(corpus: DataFrame, attribute: str, n: int = 5) -> DataFrame:
    """The first ``n`` values of an attribute in alphabetical order."""
    return values(corpus, attribute).limit(n)


def profile(df: DataFrame, column: str, top: int = 20, rare: int = 5, examples: int = 10) -> DataFrame:
    """Value frequencies of a column: rank, share of rows and whether the value is among the top or a rare example.

    Values are counted first, so the ranking windows see one row per value.
    """
    counts = df.filter(F.col(column).isNotNull() & (strip(F.col(column).cast("string")) != "")).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("rows"))
    rank = F.row_number().over(Window.orderBy(F.desc("n"), "value"))
    rare_rank = F.sum((F.col("n") <= rare).cast("int")).over(Window.orderBy("n", "value").rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.withColumns({"place": rank, "rare_place": rare_rank}).crossJoin(F.broadcast(total))  # one row
    return ranked.select(
        "value",
        "n",
        F.col("place").cast("long").alias("place"),
        (F.col("n") * 100.0 / F.col("rows")).alias("percent"),
        (F.col("place") <= top).alias("is_top"),
        ((F.col("n") <= rare) & (F.col("rare_place") <= examples)).alias("is_rare_example"),
    )


def split_counts(df: DataFrame, column: str, token: str, top: int = 10) -> DataFrame:
    """The most frequent values that hold a token, and that do not."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    counts = counts.withColumn("has_token", F.col("value").contains(token))
    place = F.row_number().over(Window.partitionBy("has_token").orderBy(F.desc("n"), "value"))
    return counts.withColumn("place", place.cast("long")).filter(F.col("place") <= top)


def sample(corpus: DataFrame, n: int, seed: int = 7) -> DataFrame:
    """``n`` rows without replacement, the same ones in every run."""
    return corpus.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("poem_idx").cast("string"))), "poem_idx").limit(n)
