"""The meter guide applied to ``documents``: names, themes, suggestions and searches."""

from __future__ import annotations

from pyspark.sql import functions as F

from rawi.operators import meter_guide as G
from rawi.sources.tables import table

#: Spellings that documents ask for, by id; the last two name no meter.
ASKED = ("بحر الطويل", "طويل", "الكامل", "Rajaz", "رجز", "بحر البسيط المجزوء", "الوافر المجزوء", "RajazManhook", "محدث", "Mujtath", "unknown", "")
THEMES = ("غزل", "مدح", "هجاء", "رثاء", "فخر", "none")
WORDS = ("taw", "خفيف", "مجزوء", "هجاء", "الأغراض", "Majzoo", "zzz")


def _by_id(values, key="doc_id"):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col(key) % len(values) + 1).cast("int"))


def asked(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", _by_id(ASKED).alias("asked"), _by_id(THEMES).alias("theme"), _by_id(WORDS).alias("word"))


def meter_alias(spark, sf_dir):
    """The meter that each document's spelling names, and the meter's first name."""
    named = G.named(asked(spark, sf_dir), "asked")
    return named.join(F.broadcast(G.first_aliases(spark)), "meter", "left").select("doc_id", "meter", "alias", F.col("meter").isNotNull().alias("known"))


def meter_enrichment(spark, sf_dir):
    return G.enriched(asked(spark, sf_dir), "asked").select("doc_id", "asked", "meter", "parent", "feet_text")


def meter_suggestions(spark, sf_dir):
    """Meters for each document's theme, easy first."""
    return G.suggested(asked(spark, sf_dir), "doc_id", "theme").select("doc_id", F.array_join("meters", ",").alias("meters"))


def meter_suggestions_hard(spark, sf_dir):
    return G.suggested(asked(spark, sf_dir), "doc_id", "theme", "hard").select("doc_id", F.array_join("meters", ",").alias("meters"))


def meter_search(spark, sf_dir):
    """How many meters each document's word finds."""
    hits = asked(spark, sf_dir).join(F.broadcast(G.guide(spark)), G.found_by(F.col("word")))
    return hits.groupBy("doc_id", "word").agg(F.count("*").alias("n"))


def meter_levels(spark, sf_dir):
    """Documents by the difficulty of the meter they ask for."""
    known = G.named(asked(spark, sf_dir), "asked").join(F.broadcast(G.guide(spark).select("meter", "difficulty")), "meter")
    return known.groupBy("difficulty", G.level(F.col("difficulty")).alias("level")).agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (meter_alias, meter_enrichment, meter_suggestions, meter_suggestions_hard, meter_search, meter_levels)}

# literal values, written apart from the library's table
_GUIDE = """main(i, meter, short, level, themes, description, feet) AS (VALUES
  (0, 'Taweel', 'طويل', 'medium', ['ملاحم', 'قصائد طويلة', 'مدح', 'فخر'], 'أطول بحور الشعر العربي، مناسب للقصائد الطويلة والملاحم', 'Fawlon Mafaeelon Fawlon Mafaeelon'),
  (1, 'Madeed', 'مديد', 'easy', ['غزل', 'مدح', 'وصف'], 'بحر متوسط الطول، مناسب للغزل والمدح', 'Faelaton Faelon Faelaton'),
  (2, 'Baseet', 'بسيط', 'medium', ['جميع الأغراض', 'غزل', 'مدح', 'هجاء', 'وصف'], 'بحر واسع ومتعدد الأغراض، مناسب لجميع أنواع الشعر', 'Mustafelon Faelon Mustafelon Faelon'),
  (3, 'Wafer', 'وافر', 'easy', ['حماسة', 'فخر', 'مدح'], 'بحر قوي وموسيقي، مناسب للحماسة والفخر', 'Mafaelaton Mafaelaton Mafaelaton'),
  (4, 'Kamel', 'كامل', 'medium', ['جميع الأغراض', 'غزل', 'مدح', 'وصف'], 'بحر كامل ومتوازن، مناسب لجميع الأغراض الشعرية', 'Mutafaelon Mutafaelon Mutafaelon'),
  (5, 'Hazaj', 'هزج', 'easy', ['غزل', 'وصف', 'رثاء'], 'بحر خفيف وموسيقي، مناسب للغزل والوصف', 'Mafaeelon Mafaeelon'),
  (6, 'Rajaz', 'رجز', 'easy', ['هجاء', 'سخرية', 'وصف'], 'بحر سريع وخفيف، مناسب للهجاء والسخرية', 'Mustafelon Mustafelon Mustafelon'),
  (7, 'Ramal', 'رمل', 'medium', ['غزل', 'وصف', 'رثاء'], 'بحر متوسط، مناسب للغزل والوصف', 'Faelaton Faelaton Faelaton'),
  (8, 'Saree', 'سريع', 'hard', ['هجاء', 'حماسة', 'وصف'], 'بحر سريع، مناسب للهجاء والحماسة', 'Mustafelon Mustafelon Mafoolato'),
  (9, 'Munsareh', 'منسرح', 'hard', ['وصف', 'غزل', 'رثاء'], 'بحر منسرح، مناسب للوصف والغزل', 'Mustafelon Mafoolato Mustafelon'),
  (10, 'Khafeef', 'خفيف', 'medium', ['غزل', 'وصف', 'رثاء'], 'بحر خفيف، مناسب للغزل والوصف', 'Faelaton Mustafe_lon Faelaton'),
  (11, 'Mudhare', 'مضارع', 'easy', ['غزل', 'وصف'], 'بحر مضارع، مناسب للغزل والوصف', 'Mafaeelon Fae_laton'),
  (12, 'Muqtadheb', 'مقتضب', 'hard', ['هجاء', 'سخرية'], 'بحر مقتضب، مناسب للهجاء والسخرية', 'Mafoolato Mustafelon'),
  (13, 'Mujtath', 'مجتث', 'medium', ['غزل', 'وصف'], 'بحر مجتث، مناسب للغزل والوصف', 'Mustafe_lon Faelaton'),
  (14, 'Mutakareb', 'متقارب', 'medium', ['غزل', 'وصف'], 'بحر متقارب، مناسب للغزل والوصف', 'Fawlon Fawlon Fawlon Fawlon'),
  (15, 'Mutadarak', 'محدث', 'medium', ['غزل', 'وصف'], 'بحر محدث، مناسب للغزل والوصف', 'Faelon Faelon Faelon Faelon')),
sub(i, meter, of, ending, feet) AS (VALUES
  (16, 'BaseetMajzoo', 'Baseet', 'المجزوء', 'Mustafelon Faelon Mustafelon'), (17, 'BaseetMukhalla', 'Baseet', 'المخلى', 'Mustafelon Faelon Mustafelon'), (18, 'WaferMajzoo', 'Wafer', 'المجزوء', 'Mafaelaton Mafaelaton'),
  (19, 'KamelMajzoo', 'Kamel', 'المجزوء', 'Mutafaelon Mutafaelon'), (20, 'RajazManhook', 'Rajaz', 'المنهوك', 'Mustafelon Mustafelon'), (21, 'RajazMashtoor', 'Rajaz', 'المشطور', 'Mustafelon Mustafelon Mustafelon'),
  (22, 'RajazMajzoo', 'Rajaz', 'المجزوء', 'Mustafelon Mustafelon'), (23, 'RamalMajzoo', 'Ramal', 'المجزوء', 'Faelaton Faelaton'), (24, 'SareeMashtoor', 'Saree', 'المشطور', 'Mustafelon Mustafelon Mafoolato'),
  (25, 'MunsarehManhook', 'Munsareh', 'المنهوك', 'Mustafelon Mafoolato'), (26, 'KhafeefMajzoo', 'Khafeef', 'المجزوء', 'Faelaton Mustafe_lon'), (27, 'MutakarebMajzoo', 'Mutakareb', 'المجزوء', 'Fawlon Fawlon Fawlon'),
  (28, 'MutadarakMashtoor', 'Mutadarak', 'المشطور', 'Faelon Faelon Faelon'), (29, 'MutadarakMajzoo', 'Mutadarak', 'المجزوء', 'Faelon Faelon Faelon')),
guide AS (SELECT i, meter, 'بحر ال' || short AS name, NULL AS parent, feet, description, themes, level FROM main
  UNION ALL SELECT s.i, s.meter, 'بحر ال' || m.short || ' ' || s.ending, s.of, s.feet, 'مجزوء من بحر ال' || m.short, m.themes, 'hard' FROM sub s JOIN main m ON m.meter = s.of),
alias AS (SELECT name AS asked, meter FROM guide UNION ALL SELECT short, meter FROM main UNION ALL SELECT substr(name, 5), meter FROM guide UNION ALL SELECT meter, meter FROM guide)"""


def _pick(values):
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][doc_id % {len(values)} + 1]"


_ASK = f"{_GUIDE}, ask AS (SELECT doc_id, {_pick(ASKED)} AS asked, {_pick(THEMES)} AS theme, {_pick(WORDS)} AS word FROM documents)"
_LEVEL = "CASE level WHEN 'easy' THEN 0 WHEN 'hard' THEN 2 ELSE 1 END"
_THEME = "len(list_filter(g.themes, lambda t: contains(t, a.theme))) > 0"
SQL = {
    "meter_alias": f"WITH {_ASK} SELECT doc_id, a.meter, g.name AS alias, a.meter IS NOT NULL AS known FROM ask LEFT JOIN alias a USING (asked) LEFT JOIN guide g ON g.meter = a.meter",
    "meter_enrichment": f"WITH {_ASK} SELECT doc_id, asked, a.meter, g.parent, g.feet AS feet_text FROM ask LEFT JOIN alias a USING (asked) LEFT JOIN guide g ON g.meter = a.meter",
    "meter_suggestions": f"WITH {_ASK} SELECT doc_id, string_agg(g.meter, ',' ORDER BY {_LEVEL}, g.i) AS meters FROM ask a JOIN guide g ON {_THEME} GROUP BY doc_id",
    "meter_suggestions_hard": f"WITH {_ASK} SELECT doc_id, string_agg(g.meter, ',' ORDER BY g.i) AS meters FROM ask a JOIN guide g ON {_THEME} AND level = 'hard' GROUP BY doc_id",
    "meter_search": f"WITH {_ASK} SELECT doc_id, word, count(*) AS n FROM ask a JOIN guide g ON contains(lower(g.meter), lower(word)) OR contains(g.name, word) OR contains(g.description, word) OR len(list_filter(g.themes, lambda t: contains(t, a.word))) > 0 GROUP BY ALL",
    "meter_levels": f"WITH {_ASK} SELECT level AS difficulty, {_LEVEL} AS level, count(*) AS n FROM ask JOIN alias a USING (asked) JOIN guide g ON g.meter = a.meter GROUP BY ALL",
}
