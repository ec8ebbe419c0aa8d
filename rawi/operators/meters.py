"""Meters of classical verse as dimension tables: feet, their modified forms and the patterns of lines.

A pattern is a string of 1 (moving) and 0 (still).  The tables below are small
and fixed; the line patterns, some 57,000, are made from them once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable
from functools import lru_cache
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Feet with their patterns and allowed modifications.
FEET = {
    "Fawlon": ("11010", ("Qabadh", "Thalm", "Tharm")),
    "Faelon": ("10110", ("Khaban", "Tasheeth")),
    "Mafaeelon": ("1101010", ("Qabadh", "Kaff")),
    "Mustafelon": ("1010110", ("Khaban", "Tay", "Khabal")),
    "Mutafaelon": ("1110110", ("Edmaar", "Waqas", "Khazal")),
    "Mafaelaton": ("1101110", ("Asab",)),
    "Mafoolato": ("1010101", ("Khaban", "Tay", "Khabal")),
    "Fae_laton": ("1011010", ("Kaff",)),
    "Mustafe_lon": ("1010110", ("Khaban", "Kaff")),
    "Faelaton": ("1011010", ("Khaban", "Kaff", "Shakal", "Tasheeth")),
}
# What a modification does, step by step: ("drop", i) removes place i, ("still", i) makes it 0,
# ("cut", n) removes the last n, ("add", text) appends, ("put", text) inserts before the last.
CHANGES = {
    "None": (),
    "Khaban": (("drop", 1),), "Tay": (("drop", 3),), "Waqas": (("drop", 1),), "Qabadh": (("drop", 4),), "Kaff": (("drop", 6),), "Akal": (("drop", 4),),
    "Kasf": (("drop", 6),), "Tasheeth": (("drop", 2),), "Thalm": (("drop", 0),), "Edmaar": (("still", 1),), "Asab": (("still", 4),),
    "Khabal": (("drop", 3), ("drop", 1)), "Khazal": (("drop", 3), ("still", 1)), "Shakal": (("drop", 6), ("drop", 1)), "Nakas": (("drop", 6), ("still", 4)),
    "TayAndKasf": (("drop", 6), ("drop", 3)), "Tharm": (("drop", 4), ("drop", 0)),
    "Hadhf": (("cut", 2),), "HadhfAndKhaban": (("cut", 2), ("drop", 1)), "Qataf": (("cut", 2), ("still", 4)), "Qataa": (("cut", 1), ("still", -1)),
    "Tatheel": (("put", "0"),), "Tasbeegh": (("put", "0"),), "TatheelAndEdmaar": (("put", "0"), ("still", 1)), "Tarfeel": (("add", "10"),),
    "TarfeelAndEdmaar": (("add", "10"), ("still", 1)), "TarfeelAndKhaban": (("drop", 1), ("add", "10")), "KhabanAndQataa": (("cut", 1), ("still", -1), ("drop", 1)),
    "QataaAndEdmaar": (("cut", 1), ("still", -1), ("still", 1)), "Hathath": (("cut", 3),), "HathathAndEdmaar": (("cut", 3), ("still", 1)), "Salam": (("cut", 3),),
    "Waqf": (("still", -1),), "WaqfAndTay": (("drop", 3), ("still", -1)), "KhabalAndKasf": (("drop", 3), ("drop", 1), ("drop", 4)), "Batr": (("cut", 2), ("cut", 1), ("still", -1)),
}
_RAJAZ = ("None", "Khaban", "Tay", "Khabal", "Qataa", "KhabanAndQataa")
_RAMAL = ("None", "Khaban", "Hadhf", "HadhfAndKhaban", "Qataa", "KhabanAndQataa")
_KAMEL = ("None", "Edmaar", "Qataa", "QataaAndEdmaar", "HathathAndEdmaar")
_KAMEL_SHORT = ("None", "Edmaar", "Qataa", "QataaAndEdmaar", "Tatheel", "TatheelAndEdmaar", "Tarfeel", "TarfeelAndEdmaar")
_MUTADARAK = ("None", "Khaban", "Tasheeth", "Tatheel", "TarfeelAndKhaban")
_TH = ("Thalm", "Tharm")
# Meter -> feet of a half; endings of the first half with those of the second (a tuple alone: one half only);
# forms that are barred per half and place; parent meter.
METERS = {
    "Taweel": (("Fawlon", "Mafaeelon", "Fawlon", "Mafaeelon"), {"Qabadh": ("Qabadh", "Hadhf", "None")}, (((), (), _TH), (_TH, (), _TH)), None),
    "Madeed": (("Faelaton", "Faelon", "Faelaton"), {"None": ("None",), "Hadhf": ("Qataa",), "HadhfAndKhaban": ("HadhfAndKhaban",)}, ((("Shakal", "Tasheeth"), ("Tasheeth",)),) * 2, None),
    "BaseetMajzoo": (("Mustafelon", "Faelon", "Mustafelon"), {"None": ("None", "Tatheel", "Qataa"), "Qataa": ("None",)}, (((), ("Tasheeth",)),) * 2, "Baseet"),
    "BaseetMukhalla": (("Mustafelon", "Faelon", "Mustafelon"), {"KhabanAndQataa": ("KhabanAndQataa",)}, (((), ("Tasheeth",)),) * 2, "Baseet"),
    "Baseet": (("Mustafelon", "Faelon", "Mustafelon", "Faelon"), {"Khaban": ("Khaban", "Qataa")}, (((), ("Tasheeth",), ()),) * 2, None),
    "WaferMajzoo": (("Mafaelaton",) * 2, {"None": ("None", "Asab"), "Asab": ("None", "Asab")}, None, "Wafer"),
    "Wafer": (("Mafaelaton",) * 3, {"Qataf": ("Qataf",)}, None, None),
    "KamelMajzoo": (("Mutafaelon",) * 2, {"None": _KAMEL_SHORT, "Edmaar": _KAMEL_SHORT}, None, "Kamel"),
    "Kamel": (("Mutafaelon",) * 3, {"None": _KAMEL, "Edmaar": _KAMEL, "Hathath": ("Hathath", "HathathAndEdmaar")}, None, None),
    "Hazaj": (("Mafaeelon",) * 2, {"None": ("None", "Hadhf"), "Kaff": ("None", "Hadhf")}, ((("Qabadh",),),) * 2, None),
    "RajazManhook": (("Mustafelon",) * 2, _RAJAZ, None, "Rajaz"),
    "RajazMashtoor": (("Mustafelon",) * 3, _RAJAZ, None, "Rajaz"),
    "RajazMajzoo": (("Mustafelon",) * 2, {k: _RAJAZ[:4] for k in _RAJAZ[:4]}, None, "Rajaz"),
    "Rajaz": (("Mustafelon",) * 3, {k: _RAJAZ for k in _RAJAZ[:4]}, None, None),
    "RamalMajzoo": (("Faelaton",) * 2, {k: ("None", "Khaban", "Tasbeegh", "Hadhf", "HadhfAndKhaban") for k in ("None", "Khaban")}, ((("Tasheeth",),),) * 2, "Ramal"),
    "Ramal": (("Faelaton",) * 3, {"Hadhf": _RAMAL, "HadhfAndKhaban": _RAMAL}, ((("Tasheeth",), ("Tasheeth",)),) * 2, None),
    "SareeMashtoor": (("Mustafelon", "Mustafelon", "Mafoolato"), ("Waqf", "Kasf"), None, "Saree"),
    "Saree": (("Mustafelon", "Mustafelon", "Mafoolato"), {"TayAndKasf": ("TayAndKasf", "Salam", "WaqfAndTay"), "KhabalAndKasf": ("KhabalAndKasf", "Salam")}, None, None),
    "MunsarehManhook": (("Mustafelon", "Mafoolato"), ("Waqf", "Kasf"), None, "Munsareh"),
    "Munsareh": (("Mustafelon", "Mafoolato", "Mustafelon"), {"Tay": ("Tay", "Qataa")}, None, None),
    "KhafeefMajzoo": (("Faelaton", "Mustafe_lon"), {"None": ("None", "KhabanAndQataa"), "Khaban": ("Khaban",)}, ((("Kaff", "Shakal", "Tasheeth"),),) * 2, "Khafeef"),
    "Khafeef": (("Faelaton", "Mustafe_lon", "Faelaton"), {k: ("None", "Tasheeth", "Hadhf", "HadhfAndKhaban") for k in ("None", "Khaban")}, ((("Kaff", "Shakal"), ()),) * 2, None),
    "Mudhare": (("Mafaeelon", "Fae_laton"), {"None": ("None",)}, None, None),
    "Muqtadheb": (("Mafoolato", "Mustafelon"), {"Tay": ("Tay",)}, ((("Khabal",),),) * 2, None),
    "Mujtath": (("Mustafe_lon", "Faelaton"), {k: ("None", "Khaban", "Tasheeth") for k in ("None", "Khaban")}, ((("Kaff",),),) * 2, None),
    "MutakarebMajzoo": (("Fawlon",) * 3, {"Hadhf": ("Hadhf", "Batr")}, (((), _TH), (_TH, _TH)), "Mutakareb"),
    "Mutakareb": (("Fawlon",) * 4, {k: ("None", "Hadhf", "Qataa", "Batr") for k in ("None", "Qabadh", "Hadhf")}, (((), _TH, _TH), (_TH, _TH, _TH)), None),
    "MutadarakMashtoor": (("Faelon",) * 3, _MUTADARAK, None, "Mutadarak"),
    "MutadarakMajzoo": (("Faelon",) * 3, {k: _MUTADARAK for k in _MUTADARAK[:3]}, None, "Mutadarak"),
    "Mutadarak": (("Faelon",) * 4, {k: ("None", "Khaban", "Tasheeth") for k in ("None", "Khaban", "Tasheeth")}, None, None),
}
#: Meters whose first foot, if it has the first form, must not be followed by the second; and those whose first foot must be modified.
BARRED_PAIR = {"Madeed": ("Kaff", "Khaban")}
MODIFIED_START = ("Mudhare",)


def modify(pattern: str, change: str) -> str:
    """The pattern after a modification."""
    for step, x in CHANGES[change]:
        if step == "drop":
            pattern = pattern[:x] + pattern[x + 1 :]
        elif step == "still":
            at = x % len(pattern)
            pattern = pattern[:at] + "0" + pattern[at + 1 :]
        elif step == "cut":
            pattern = pattern[:-x]
        else:
            pattern = pattern + x if step == "add" else pattern[:-1] + x + pattern[-1]
    return pattern


def foot_rows() -> list[tuple[str, str, str]]:
    """(foot, form, pattern) of every foot, unmodified and with each allowed modification."""
    return [(f, c, modify(p, c)) for f, (p, allowed) in FEET.items() for c in ("None", *allowed)]


def half_rows() -> list[tuple[str, str, int, str, str]]:
    """(meter, ending, half, pattern, feet) of every half line; half 0 also takes the endings of half 1."""
    out = []
    for meter, (feet, endings, barred, _) in METERS.items():
        single = not isinstance(endings, dict)
        for ending, seconds in (("one", endings),) if single else endings.items():
            for half in (0,) if single else (0, 1):
                places = []
                for i, foot in enumerate(feet[:-1]):
                    no = barred[half][i] if barred else ()
                    places.append([(c, modify(FEET[foot][0], c)) for c in ("None", *FEET[foot][1]) if c not in no])
                lasts = dict.fromkeys((ending, *seconds) if half == 0 and not single else seconds)
                places.append([(c, modify(FEET[feet[-1]][0], c)) for c in lasts])
                for forms in product(*places):
                    names = [c for c, _ in forms]
                    if meter in BARRED_PAIR and tuple(names[:2]) == BARRED_PAIR[meter]:
                        continue
                    if meter in MODIFIED_START and names[0] == "None":
                        continue
                    out.append((meter, ending, half, "".join(p for _, p in forms), " ".join(f"{f}:{c}" for f, c in zip(feet, names, strict=True))))
    return out


def feet(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(foot_rows(), "foot string, form string, pattern string")


def halves(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(half_rows(), "meter string, ending string, half int, pattern string, feet string")


def meters(spark: SparkSession) -> DataFrame:
    """meter, parent, feet and whether it has one half only."""
    rows = [(m, parent, " ".join(f), not isinstance(e, dict)) for m, (f, e, _, parent) in METERS.items()]
    return spark.createDataFrame(rows, "meter string, parent string, feet string, one_half boolean")


def line_patterns(spark: SparkSession) -> DataFrame:
    """Distinct (meter, pattern) of whole lines; a meter has the patterns of its sub-meters too."""
    h = halves(spark)
    one, two = h.filter("half = 0 and ending = 'one'"), h.filter("ending <> 'one'")
    second = two.filter("half = 1").select("meter", "ending", F.col("pattern").alias("p2"))
    whole = two.filter("half = 0").join(second, ["meter", "ending"]).select("meter", F.concat("pattern", "p2").alias("pattern")).unionByName(one.select("meter", "pattern"))
    parents = meters(spark).select("meter", F.explode(F.array_distinct(F.array("meter", F.coalesce("parent", "meter")))).alias("of"))
    return whole.join(parents, "meter").select(F.col("of").alias("meter"), "pattern").distinct()


@lru_cache(maxsize=1)
def line_feet_rows() -> tuple[tuple[str, str, str], ...]:
    """(meter, pattern, feet) of whole lines, with the first combination of half lines that makes the pattern; # parts the halves."""
    firsts, seconds, found = {}, {}, {}
    for meter, ending, half, pattern, names in half_rows():
        (seconds if half else firsts).setdefault((meter, ending), []).append((pattern, names))
    for (meter, ending), rows in firsts.items():
        of = dict.fromkeys((meter, METERS[meter][3] or meter))
        ends = [("", None)] if ending == "one" else seconds.get((meter, ending), [])
        for (p1, f1), (p2, f2) in product(rows, ends):
            for name in of:
                found.setdefault((name, p1 + p2), f1 if f2 is None else f"{f1}#{f2}")
    return tuple((*key, names) for key, names in found.items())


def line_feet(spark: SparkSession) -> DataFrame:
    """``line_feet_rows`` as a table: fixed rows, made once on the driver."""
    return spark.createDataFrame(pd.DataFrame(line_feet_rows(), columns=["meter", "pattern", "feet"]), "meter string, pattern string, feet string")


class Walk:
    """The least acyclic automaton of named patterns over 0 and 1, walked by all texts of a batch at once."""

    def __init__(self, named: Iterable[tuple[str, str]]):
        tree: list[dict] = [{"next": {}, "names": []}]
        for name, pattern in named:
            at = 0
            for c in pattern:
                if c not in tree[at]["next"]:
                    tree[at]["next"][c] = len(tree)
                    tree.append({"next": {}, "names": []})
                at = tree[at]["next"][c]
            tree[at]["names"].append(name)
        # nodes come after the ones above them, so from the end on all that hang below are settled; state 0 is the dead one
        settled, states, place = {}, [(0, 0, ())], [0] * len(tree)
        for k in range(len(tree) - 1, -1, -1):
            below = tree[k]["next"]
            key = (place[below["0"]] if "0" in below else 0, place[below["1"]] if "1" in below else 0, tuple(sorted(tree[k]["names"])))
            if key not in settled:
                settled[key] = len(states)
                states.append(key)
            place[k] = settled[key]
        self.start = place[0]
        self.next = np.array([s[:2] for s in states], dtype=np.int32)
        self.names = [s[2] for s in states]
        self.ends = np.array([bool(s[2]) for s in states])

    def prefixes(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(text, state) for each prefix that is a pattern, shorter ones first."""
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
        data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
        alive = np.arange(len(texts))
        state, at, end = np.full(len(texts), self.start, dtype=np.int32), offsets[:-1].astype(np.int64), offsets[1:].astype(np.int64)
        found = []
        while len(alive):
            inside = at < end
            alive, state, at, end = alive[inside], state[inside], at[inside], end[inside]
            bit = data[at].astype(np.int32) - 48
            state = np.where((bit == 0) | (bit == 1), self.next[state, bit & 1], 0)
            hit = self.ends[state]
            found.append((alive[hit], state[hit]))
            on = state > 0
            alive, state, at, end = alive[on], state[on], at[on] + 1, end[on]
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int32))


@lru_cache(maxsize=1)
def half_walk() -> Walk:
    """The first half lines of all meters."""
    return Walk(sorted({(r[0], r[3]) for r in half_rows() if r[2] == 0}))


def half_counts(rows: DataFrame, column: str = "beat") -> DataFrame:
    """meter and n, how many prefixes of the patterns are half lines of each meter: one pass, added up within each task first."""
    walk = half_walk()

    def run(batches):
        total = Counter()
        for batch in batches:
            _, states = walk.prefixes(batch.column(0).cast(pa.string()))
            for state, n in zip(*np.unique(states, return_counts=True), strict=True):
                for name in walk.names[state]:
                    total[name] += int(n)
        yield pa.RecordBatch.from_pydict({"meter": pa.array(list(total), pa.string()), "n": pa.array(list(total.values()), pa.int64())})

    return rows.filter(F.col(column).isNotNull()).select(column).mapInArrow(run, "meter string, n long").groupBy("meter").agg(F.sum("n").alias("n"))


def with_pattern(lines: DataFrame, patterns: DataFrame, column: str = "pattern") -> DataFrame:
    """Lines joined to every meter that has their pattern."""
    return lines.join(patterns.withColumnRenamed("pattern", column), column)


def pattern_bounds(patterns: DataFrame) -> DataFrame:
    return patterns.groupBy("meter").agg(F.count("*").alias("n"), F.min(F.length("pattern")).alias("shortest"), F.max(F.length("pattern")).alias("longest"))


def search_meters(table: DataFrame, text: str) -> DataFrame:
    """Meters whose name, else feet or parent, hold the text."""
    key = text.strip().lower()
    hit = [F.lower(F.coalesce(F.col(c), F.lit(""))).contains(key) for c in ("meter", "feet", "parent")]
    return table.filter(hit[0] | hit[1] | hit[2])


#: Order of difficulty; anything else counts as medium.
DIFFICULTY = {"easy": 0, "medium": 1, "hard": 2}


def by_difficulty(table: DataFrame, difficulty: str = "difficulty", order: str = "place") -> DataFrame:
    """Easy meters first, in their given order."""
    rank = F.coalesce(F.create_map(*[F.lit(x) for kv in DIFFICULTY.items() for x in kv])[F.col(difficulty)], F.lit(1))
    return table.orderBy(rank, order)
