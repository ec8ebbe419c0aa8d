"""What is known about each meter: names, themes, difficulty; look-up, search and suggestions.

The guide is a dimension of 30 rows and some 80 names, so it is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rawi.operators.meters import DIFFICULTY, METERS

# Main meter -> Arabic name, difficulty, themes, description.
GUIDE = {
    "Taweel": ("بحر الطويل", "medium", ("ملاحم", "قصائد طويلة", "مدح", "فخر"), "أطول بحور الشعر العربي، مناسب للقصائد الطويلة والملاحم"),
    "Madeed": ("بحر المديد", "easy", ("غزل", "مدح", "وصف"), "بحر متوسط الطول، مناسب للغزل والمدح"),
    "Baseet": ("بحر البسيط", "medium", ("جميع الأغراض", "غزل", "مدح", "هجاء", "وصف"), "بحر واسع ومتعدد الأغراض، مناسب لجميع أنواع الشعر"),
    "Wafer": ("بحر الوافر", "easy", ("حماسة", "فخر", "مدح"), "بحر قوي وموسيقي، مناسب للحماسة والفخر"),
    "Kamel": ("بحر الكامل", "medium", ("جميع الأغراض", "غزل", "مدح", "وصف"), "بحر كامل ومتوازن، مناسب لجميع الأغراض الشعرية"),
    "Hazaj": ("بحر الهزج", "easy", ("غزل", "وصف", "رثاء"), "بحر خفيف وموسيقي، مناسب للغزل والوصف"),
    "Rajaz": ("بحر الرجز", "easy", ("هجاء", "سخرية", "وصف"), "بحر سريع وخفيف، مناسب للهجاء والسخرية"),
    "Ramal": ("بحر الرمل", "medium", ("غزل", "وصف", "رثاء"), "بحر متوسط، مناسب للغزل والوصف"),
    "Saree": ("بحر السريع", "hard", ("هجاء", "حماسة", "وصف"), "بحر سريع، مناسب للهجاء والحماسة"),
    "Munsareh": ("بحر المنسرح", "hard", ("وصف", "غزل", "رثاء"), "بحر منسرح، مناسب للوصف والغزل"),
    "Khafeef": ("بحر الخفيف", "medium", ("غزل", "وصف", "رثاء"), "بحر خفيف، مناسب للغزل والوصف"),
    "Mudhare": ("بحر المضارع", "easy", ("غزل", "وصف"), "بحر مضارع، مناسب للغزل والوصف"),
    "Muqtadheb": ("بحر المقتضب", "hard", ("هجاء", "سخرية"), "بحر مقتضب، مناسب للهجاء والسخرية"),
    "Mujtath": ("بحر المجتث", "medium", ("غزل", "وصف"), "بحر مجتث، مناسب للغزل والوصف"),
    "Mutakareb": ("بحر المتقارب", "medium", ("غزل", "وصف"), "بحر متقارب، مناسب للغزل والوصف"),
    "Mutadarak": ("بحر المحدث", "medium", ("غزل", "وصف"), "بحر محدث، مناسب للغزل والوصف"),
}
# Endings of sub-meters' names; their difficulty; the text before a parent's name; tones of beginners.
SHORTER = {"Majzoo": "المجزوء", "Mukhalla": "المخلى", "Mashtoor": "المشطور", "Manhook": "المنهوك"}
SUB_DIFFICULTY = "hard"
SUB_TEXT = "مجزوء من "
BEGINNER_TONES = ("بسيط", "سهل", "مبتدئ")
PREFIX, ARTICLE = "بحر ", "ال"


def guide_rows() -> list[tuple]:
    """(place, meter, arabic_name, parent, feet, description, themes, difficulty): main meters, then shorter ones with their parents' themes."""
    rows = [(m, name, None, text, list(themes), level) for m, (name, level, themes, text) in GUIDE.items()]
    for parent in GUIDE:
        for meter, (_, _, _, of) in METERS.items():
            if of == parent:
                name = f"{GUIDE[parent][0]} {SHORTER[meter.removeprefix(parent)]}"
                rows.append((meter, name, parent, SUB_TEXT + GUIDE[parent][0], list(GUIDE[parent][2]), SUB_DIFFICULTY))
    return [(i, m, name, parent, " ".join(METERS[m][0]), text, themes, level) for i, (m, name, parent, text, themes, level) in enumerate(rows)]


def guide(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(guide_rows(), "place int, meter string, arabic_name string, parent string, feet string, description string, themes array<string>, difficulty string")


def alias_rows() -> list[tuple[str, str, int]]:
    """(alias, meter, order): full Arabic names first, then without the noun and the article, then with the article, then Latin names."""
    names = [(r[2], r[1]) for r in guide_rows()]
    main = [(name, m) for name, m in names if m in GUIDE]
    forms = names + [(n.removeprefix(PREFIX + ARTICLE), m) for n, m in main] + [(n.removeprefix(PREFIX), m) for n, m in names] + [(m, m) for _, m in names]
    return [(a, m, i) for i, (a, m) in enumerate(forms)]


def aliases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(alias_rows(), "alias string, meter string, alias_order int")


def named(df: DataFrame, column: str, as_name: str = "meter") -> DataFrame:
    """``df`` with the meter that a column names in any spelling; null where it names none."""
    names = aliases(df.sparkSession).select(F.col("alias").alias(column), F.col("meter").alias(as_name))
    return df.join(F.broadcast(names), column, "left")


def first_aliases(spark: SparkSession) -> DataFrame:
    """The first name of each meter."""
    return aliases(spark).groupBy("meter").agg(F.min_by("alias", "alias_order").alias("alias"))


def enriched(df: DataFrame, column: str) -> DataFrame:
    """``df`` with meter, parent and feet_text of the meter that a column names; rows of unknown meters stay, without them."""
    info = guide(df.sparkSession).select("meter", "parent", F.col("feet").alias("feet_text"))
    return named(df, column).join(F.broadcast(info), "meter", "left")


def has_theme(theme: Column) -> Column:
    """Does one of a meter's themes hold the text, in either case?"""
    return F.exists("themes", lambda t: F.lower(t).contains(F.lower(theme)))


def found_by(query: Column) -> Column:
    """Does a meter's name, else description, else theme hold the text, in either case?"""
    low = F.lower(query)
    return F.lower("meter").contains(low) | F.lower("arabic_name").contains(low) | F.lower("description").contains(low) | has_theme(query)


def level(difficulty: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in DIFFICULTY.items() for x in kv])[difficulty], F.lit(1))


def suggested(requests: DataFrame, key: str, theme: str, difficulty: str | None = None) -> DataFrame:
    """key and the meters that suit each request's theme (of one difficulty if given), easy first: an array of at most 30."""
    known = guide(requests.sparkSession)
    known = known.filter(F.col("difficulty") == difficulty) if difficulty else known
    rows = requests.select(key, F.col(theme).alias("_theme")).join(F.broadcast(known), has_theme(F.col("_theme")))
    at = F.struct(level(F.col("difficulty")).alias("level"), "place", "meter")
    return rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_set(at)), lambda x: x["meter"]).alias("meters"))


def suggestion_text(spark: SparkSession, theme: str | None, tone: str | None = None) -> DataFrame:
    """One row, ``text``: up to five meters of the theme, three easy ones for beginners or without a theme, three of medium difficulty."""
    known = guide(spark)
    parts = []
    if theme:
        parts.append(("theme: " + theme, known.filter(has_theme(F.lit(theme))), 5))
    if not theme or tone in BEGINNER_TONES:
        parts.append(("easy", known.filter("difficulty = 'easy'"), 3))
    parts.append(("medium", known.filter("difficulty = 'medium'"), 3))
    rows = None
    for i, (head, some, most) in enumerate(parts):
        some = some.orderBy("place").limit(most).select(F.lit(i).alias("part"), F.lit(head).alias("head"), "place", F.concat(F.lit("  - "), "arabic_name", F.lit(" ("), "difficulty", F.lit(")")).alias("line"))
        rows = some if rows is None else rows.unionByName(some)
    texts = rows.groupBy("part", "head").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), "\n").alias("lines"))
    block = F.concat("head", F.lit(":\n"), "lines")
    return texts.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", block.alias("b")))), lambda x: x["b"]), "\n").alias("text"))
