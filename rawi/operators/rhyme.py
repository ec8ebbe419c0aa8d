"""Rhyme dictionary in long form: one row per (rhyme_key, word).

The reference shape, a map from key to a set of words, is only made at the sink
(``as_map``); every step here is a projection, an explode or a distinct, so no
key's words are gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rawi.functions import arabic as A
from rawi.functions.text import every_second, strip
from rawi.operators.steps import once

#: Vowel letters, and the marks a bare key is spread over.
VOWEL_LETTERS = ("و", "ي", "ا")
SPREAD_MARKS = ("ْ", "َ", "ِ", "ُ")
#: Signs that do not count as the letter before a rhyme.
NOT_LETTERS = ("ـ", "ٰ", "ٔ", "ٕ")


def dictionary(corpus: DataFrame) -> DataFrame:
    """Distinct (rhyme_key, word) from the lines of ``verses``.

    One line rhymes on its own tail; an even number of lines on the common end of
    the last three second halves, and all second halves that rhyme with it are
    its words; other poems give nothing.
    """
    lines = F.filter(F.transform("verses", lambda v: F.regexp_replace(strip(v), f"[{A.TATWEEL}{A.BIDI}]", "")), A.is_verse)
    rows = once(corpus, [], last=F.transform(lines, A.last_word)).filter((F.size("last") == 1) | ((F.size("last") > 0) & (F.size("last") % 2 == 0)))
    alone = F.size("last") == 1
    rows = once(rows, ["last"], alone=alone, second=F.when(alone, F.col("last")).otherwise(every_second(F.col("last"))))
    ends = F.slice("second", F.greatest(F.size("second") - 2, F.lit(1)), F.lit(3))
    rows = once(once(rows, ["alone", "second"], ends=ends), ["alone", "second"], rhyme_key=F.when(F.col("alone"), A.rhyme_tail(F.get("ends", F.lit(0)))).otherwise(A.rhyme_pattern(F.col("ends"))))
    rows = rows.filter("rhyme_key <> ''").select("alone", "rhyme_key", F.explode("second").alias("word"))
    return rows.filter(F.col("alone") | A.rhymes_with(F.col("word"), F.col("rhyme_key"))).select("rhyme_key", "word").distinct()


def move_vowels(words: DataFrame) -> DataFrame:
    """One-letter keys: words with a vowel letter before the last two characters move to key + vowel."""
    single = F.length(A.strip_marks(F.col("rhyme_key"))) == 1
    before = F.substring("word", -3, 1)
    moves = single & (F.length("word") >= 3) & before.isin(*VOWEL_LETTERS)
    return words.select(F.when(moves, F.concat("rhyme_key", before)).otherwise(F.col("rhyme_key")).alias("rhyme_key"), "word").distinct()


def strip_prefixes(words: DataFrame) -> DataFrame:
    return words.select("rhyme_key", A.without_prefix(F.col("word")).alias("word")).distinct()


def spread_bare_keys(words: DataFrame) -> DataFrame:
    """Bare one-letter keys become four keys with a mark each, behind the word's last letter if that is a vowel."""
    key, last = F.col("rhyme_key"), F.right("word", F.lit(1))
    bare = (F.length(key) == 1) & (A.strip_marks(key) == key)
    stem = F.when(last.isin(*VOWEL_LETTERS), F.concat(key, last)).otherwise(key)
    keys = F.when(bare, F.array(*[F.concat(stem, F.lit(m)) for m in SPREAD_MARKS])).otherwise(F.array(key))
    return words.filter("word <> ''").select(F.explode(keys).alias("rhyme_key"), "word").distinct()


def clean(words: DataFrame) -> DataFrame:
    return words.filter(A.is_arabic_word(F.col("word")))


def cleaning_summary(words: DataFrame) -> DataFrame:
    """One row: words and keys before and after keeping Arabic words only."""
    ok = A.is_arabic_word(F.col("word"))
    per_key = words.groupBy("rhyme_key").agg(F.count("*").alias("n"), F.count_if(ok).alias("kept"))
    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("words_before"),
        F.coalesce(F.sum("kept"), F.lit(0)).alias("words_after"),
        F.coalesce(F.sum(F.col("n") - F.col("kept")), F.lit(0)).alias("words_removed"),
        F.count_if(F.col("kept") == 0).alias("keys_removed"),
    )


def suffix_matches(words: DataFrame, keys: DataFrame, word: str = "word") -> DataFrame:
    """Words joined to every key that is their last one, two or three characters."""
    tails = F.array_distinct(F.array(*[F.right(F.col(word), F.lit(n)) for n in (3, 2, 1)]))
    return words.select("*", F.explode(tails).alias("rhyme_key")).join(keys.select("rhyme_key").distinct(), "rhyme_key")


def majority_letter(lines: DataFrame) -> DataFrame:
    """Most frequent last letter of the lines of each ``poem_idx`` (columns poem_idx, pos, line); the first seen wins a tie."""
    letter = F.right(A.strip_marks(F.regexp_replace(strip(F.col("line")), f"[{A.TATWEEL}]", "")), F.lit(1))
    counted = lines.select("poem_idx", "pos", letter.alias("letter")).groupBy("poem_idx", "letter").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    best = counted.groupBy("poem_idx").agg(F.max_by("letter", F.struct("n", -F.col("first"))).alias("letter"))
    return best.select("poem_idx", "letter", A.letter_name(F.col("letter")).alias("name"))


def as_map(words: DataFrame) -> DataFrame:
    """rhyme_key and its sorted words, for the JSON sink."""
    return words.groupBy("rhyme_key").agg(F.sort_array(F.collect_set("word")).alias("words"))


def longer_rhyme(verses: Column) -> Column:
    return F.coalesce(A.rhyme_letter(verses), F.lit(""))


def first_examples(words: DataFrame, n: int = 3) -> DataFrame:
    """The first ``n`` words of each key by code point."""
    place = F.row_number().over(Window.partitionBy("rhyme_key").orderBy("word"))
    return words.withColumn("place", place).filter(F.col("place") <= n)
