"""Meters, scansion, rhyme letters and diacritics over the lines of ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rawi.functions import scansion as S
from rawi.functions.arabic import transliterated
from rawi.operators import meters as M
from rawi.operators.flow import shared
from rawi.operators.steps import once
from rawi.plans import meter_sql, rhyme_queries
from rawi.sources.tables import table

_FATHA, _SUKUN = "َ", "ْ"


def _rows(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.lower(F.coalesce("text", F.lit(""))), "\n")).alias("pos", "line"))


def _beat(letters):
    """Letters as a pattern: a vowel is moving, other letters are still."""
    return F.regexp_replace(F.regexp_replace(letters, "[aeiou]", "1"), "[a-z]", "0")


def beats(spark, sf_dir):
    """Lines as patterns."""
    rows = _rows(spark, sf_dir).select("doc_id", F.col("pos").cast("long").alias("pos"), "line")
    return once(rows, ["doc_id", "pos"], beat=_beat(F.regexp_replace("line", "[^a-z]", ""))).filter("beat <> ''")


def prefixes(rows, shortest: int, longest: int):
    """The prefixes of each line's pattern, from ``shortest`` to ``longest`` letters."""
    long = rows.filter(F.length("beat") >= shortest)
    sizes = F.sequence(F.lit(shortest), F.least(F.length("beat"), F.lit(longest)))
    return long.select("doc_id", "pos", F.explode(F.transform(sizes, lambda n: F.substring("beat", F.lit(1), n))).alias("pattern"))


def pattern_membership(spark, sf_dir):
    """Lines that begin with a whole foot, by foot and form."""
    starts = prefixes(beats(spark, sf_dir), 3, 9)
    return starts.join(F.broadcast(M.feet(spark)), "pattern").groupBy("foot", "form", "pattern").agg(F.count("*").alias("n"))  # 37 fixed rows


def half_prefix_membership(spark, sf_dir):
    """Lines that begin with a half line of a one-half meter or of any meter's first half."""
    letters = F.substring(F.regexp_replace("line", "[^a-z]", ""), 1, 32)  # no half line is longer
    return M.half_counts(_rows(spark, sf_dir).select(_beat(letters).alias("beat")).filter(F.length("beat") >= 8))


def first_foot(spark, sf_dir):
    """First foot of each line by first letters, with the pattern that names it first."""
    names = M.feet(spark).groupBy("pattern").agg(F.min(F.struct("foot", "form")).alias("f")).select("pattern", "f.foot", "f.form")
    start = beats(spark, sf_dir).select("doc_id", "pos", F.substring("beat", 1, 5).alias("pattern"))
    return start.join(F.broadcast(names), "pattern", "left").select("doc_id", "pos", "pattern", "foot", "form")


_KEPT: dict[str, DataFrame] = {}


def line_feet(spark):
    """The fixed table of whole lines, written once for an application; some 57,000 short rows."""
    key = spark.sparkContext.applicationId
    if key not in _KEPT:
        _KEPT[key] = shared(M.line_feet(spark))
    return _KEPT[key]


def whole_pattern_membership(spark, sf_dir):
    """Lines whose whole pattern belongs to a meter, by meter."""
    return M.with_pattern(beats(spark, sf_dir), line_feet(spark).select("meter", "pattern"), "beat").groupBy("meter").agg(F.count("*").alias("n"))


def whole_pattern_to_feet(spark, sf_dir):
    """All feet of each line by its whole pattern, once for every meter that has it; null where none has."""
    return beats(spark, sf_dir).join(line_feet(spark).withColumnRenamed("pattern", "beat"), "beat", "left").select("doc_id", "pos", "beat", "meter", "feet")


def marked(spark, sf_dir):
    """Transliterated lines with a mark behind every letter: fatha before a vowel's place, else sukun."""
    # few large files are dealt to all cores: reading a line costs far more than moving it
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").repartition("doc_id")
    lines = rhyme_queries.lines_of(rhyme_queries.in_arabic(docs))
    letter = F.regexp_replace("line", "([^\\s.,؟!])", "$1" + _FATHA)
    for rests in "دذرز":
        letter = F.replace(letter, F.lit(rests + _FATHA), F.lit(rests + _SUKUN))
    return lines.select("poem_idx", "pos", letter.alias("line"))


def scansion(spark, sf_dir):
    s = S.scan("line")
    return marked(spark, sf_dir).withColumn("s", s).groupBy("poem_idx").agg(F.count("*").alias("n"), F.count("s.error").alias("failed"), F.sum(F.length("s.pattern")).alias("beats"), F.sum(F.length("s.spelling")).alias("letters"))


def rawwy(spark, sf_dir):
    return rhyme_queries.lines(spark, sf_dir).select(S.rhyme("line").alias("r")).groupBy("r.letter", "r.parts").agg(F.count("*").alias("n"))


def diacritics(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.n_mark_issues(transliterated(F.col("text"))).alias("n_issues"))


QUERIES = {f.__name__: f for f in (pattern_membership, half_prefix_membership, first_foot, whole_pattern_membership, whole_pattern_to_feet, scansion, rawwy, diacritics)}

_BEATS = "beats AS (SELECT * FROM (SELECT doc_id, pos, translate(translate(regexp_replace(line, '[^a-z]', '', 'g'), 'aeiou', '11111'), 'bcdfghjklmnpqrstvwxyz', '000000000000000000000') AS beat FROM (SELECT doc_id, unnest(l) AS line, unnest(range(0, len(l))) AS pos FROM (SELECT doc_id, string_split(lower(coalesce(text, '')), chr(10)) AS l FROM documents))) WHERE beat <> '')"
SQL = {
    "whole_pattern_membership": f"WITH {_BEATS}, {meter_sql.LINES} SELECT meter, count(*) AS n FROM beats JOIN line_feet USING (beat) GROUP BY meter",
    "whole_pattern_to_feet": f"WITH {_BEATS}, {meter_sql.LINES} SELECT doc_id, pos, beat, meter, feet FROM beats LEFT JOIN line_feet USING (beat)",
    "pattern_membership": f"WITH {_BEATS}, {meter_sql.FEET} SELECT foot, form, pattern, count(*) AS n FROM beats JOIN feet ON starts_with(beat, pattern) GROUP BY ALL",
    "half_prefix_membership": f"WITH {_BEATS}, {meter_sql.HALVES} SELECT meter, count(*) AS n FROM (SELECT doc_id, pos, unnest(list_distinct(list_transform(range(8, 33), lambda k: substr(beat, 1, k)))) AS pattern FROM beats) JOIN halves USING (pattern) GROUP BY meter",
    "first_foot": f"WITH {_BEATS}, {meter_sql.FEET}, first AS (SELECT pattern, foot, form FROM (SELECT *, row_number() OVER (PARTITION BY pattern ORDER BY foot, form) AS r FROM feet) WHERE r = 1) SELECT doc_id, pos, substr(beat, 1, 5) AS pattern, foot, form FROM beats LEFT JOIN first ON first.pattern = substr(beat, 1, 5)",
}
