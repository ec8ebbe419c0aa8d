"""Scansion and rhyme letters as Arrow UDFs; diacritic checks.

A line is cut into units, a letter with what marks it, by one regular expression;
what a unit adds to the beat and to the spelling stands in a table, by the kind of
its mark and by whether the beat rests so far.  Each distinct line of an Arrow
batch is worked out once, and what a word inside a line adds is kept by the task.  A line that cannot be read gives an ``error``, not a
failed job.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters.
SHORT, SUKUN, SHADDA, TANWEEN = "َُِ", "ْ", "ّ", "ًٌٍ"
MARKS = SHORT + SUKUN + SHADDA + TANWEEN
ACCEPTED = set(MARKS + "اوىيإةبتثجحخدذرزسشصضطظعغفقكلمنهأءئؤ #ـ")

#: A letter; behind it a doubling and its vowel, another mark, or a blank and a mark; then a blank.  Else a mark that stands alone.
_UNIT = re.compile(f"([^{MARKS} ])(?:({SHADDA})([{SHORT}{TANWEEN}]?)|([{SHORT}{SUKUN}{TANWEEN}])| ([{MARKS}]))?( ?)|.")
_DOUBLE_SHORT, _OTHER, _BLANKS = re.compile(f"[{SHORT}](?=[{SHORT}])"), re.compile(f"[^{''.join(sorted(ACCEPTED))}]+"), re.compile("  +")
_KIND = {**dict.fromkeys(SHORT, "short"), SUKUN: "rest", **dict.fromkeys(TANWEEN, "nasal"), SHADDA: "double"}
#: Kind of a unit -> (beats, letters, does it swallow the letter before it) while the beat moves, and while it rests.
_ADDS = {
    "short": (("1", 1, False), ("1", 1, False)),
    "rest": (("0", 1, False), ("", 1, True)),
    "nasal": (("10", 1, False), ("10", 1, False)),
    "double": (("01", 2, False), ("1", 2, True)),
    "bare": (("0", 1, False), ("", 1, True)),
    "open": (("0", 1, False), ("1", 1, False)),
}
#: The long vowel that a vowel at the end of a line, or behind a closing ه, is read as.
_LENGTHENED = {"ِ": "ي", "َ": "ا", "ُ": "و"}
_NASAL_END = {"ٍ": "ي", "ٌ": "و"}


class _Reading:
    """Beats and letters of what is read so far, whether the beat rests, and whether a marked letter and a blank were last."""

    def __init__(self):
        self.beat, self.said, self.rests, self.opened = [], [], False, False

    def read(self, units: list[tuple], last: bool) -> None:
        """Reads whole words; ``last``: the line ends with them."""
        beat, said, rests, opened, held = self.beat, self.said, self.rests, self.opened, False
        if last and units and units[-1][0] and not any(units[-1][1:]):
            units.pop()  # a bare letter at the end is not read
            end = -1
        else:
            end = len(units) - 1 if last else -1
        for i, (letter, doubled, vowel, mark, far, blank) in enumerate(units):
            if not letter:
                break
            mark = doubled or mark or far
            if not mark and letter == "#":
                if beat and not rests and not held:
                    beat.append("0")
                    rests = True
            else:
                kind = _KIND[mark] if mark else "open" if blank else "bare"
                digits, times, swallows = _ADDS[kind][rests]
                if i == end and rests and kind == "rest" and not far:
                    beat[-1], digits, swallows = beat[-1][:-1] + "1", "0", False
                if swallows:
                    _swallow(said)
                if kind != "nasal" or letter != "ا":
                    said += letter * times
                if kind == "nasal" or vowel and vowel in TANWEEN:
                    said.append("ن")
                    digits += "0" if kind == "double" else ""
                if digits:
                    beat.append(digits)
                    rests = digits[-1] == "0"
                if letter == "ه" and not doubled and mark in _LENGTHENED and mark != "َ" and (blank or (i == end and opened)):
                    said.append(_LENGTHENED[mark])
                    beat.append("0")
                    rests = True
            if far:
                break
            opened, held = bool(blank and mark and not vowel), letter == "ـ" and not blank and not mark
            if blank:
                said.append(" ")
        self.rests, self.opened = rests, opened

    def read_word(self, word: str) -> bool:
        """Reads a word and the blank behind it, which the line goes on after; False, and nothing is read, where the reading would end in it."""
        known = _KNOWN[2 * bool(self.beat) + self.rests]
        adds = known.get(word)
        if adds is None:
            adds = _added(word, bool(self.beat), self.rests)
            if len(word) <= KEPT_LENGTH:
                if len(known) >= KEPT_WORDS:
                    known.clear()
                known[word] = adds
        if not adds:
            return False
        digits, letters, swallows, self.rests, self.opened = adds
        if swallows:
            _swallow(self.said)
        if digits:
            self.beat.append(digits)
        self.said += letters
        return True


def _swallow(said: list[str]) -> None:
    """Takes back the last letter, and the blank behind it."""
    del said[-2 if said[-1:] == [" "] else -1 :]


#: What words inside a line add, by whether a beat is before them and whether it rests: words recur where lines do not.
_KNOWN: tuple[dict, ...] = ({}, {}, {}, {})
#: Words kept in each, and their longest.
KEPT_WORDS, KEPT_LENGTH = 50_000, 64


def _added(word: str, begun: bool, rests: bool) -> tuple:
    """(beats, letters, is the letter before swallowed, the state after it) of a word and a blank; empty where the reading would end in it."""
    units = _UNIT.findall(word + " ")
    if not all(u[0] for u in units):
        return ()
    alone, before = _Reading(), ["?", " "]  # stand for what was read before
    alone.beat, alone.said, alone.rests = ["?"] * begun, before[:], rests
    alone.read(units, False)
    swallows = alone.said[:2] != before
    return "".join(alone.beat[begun:]), "".join(alone.said[0 if swallows else 2 :]), swallows, alone.rests, alone.opened


_DOUBLES, _IS_MARK = tuple(a + b for a in SHORT for b in SHORT), frozenset(MARKS)


def scanned(line: str) -> tuple[str, str]:
    """(spelling as it is read, 0/1 pattern) of a marked line: 1 moving, 0 still.

    A mark that follows neither a letter nor a doubling ends the reading.
    """
    if any(x in line for x in _DOUBLES):
        line = _DOUBLE_SHORT.sub("", line)
    text = _OTHER.sub("", line.replace("آ", "ءَا").strip())
    if "  " in text:
        text = _BLANKS.sub(" ", text)
    reading, start = _Reading(), 0
    for word in text[:-1].split(" ")[:-1]:  # all but the last, which a blank may follow
        after = start + len(word) + 1
        if text[after] in _IS_MARK:  # ends the reading
            whole = after + 2 >= len(text)
            reading.read(_UNIT.findall(text[start : after + 2]), whole)
            break
        if not reading.read_word(word):
            reading.read(_UNIT.findall(word + " "), False)
            break
        start = after
    else:
        reading.read(_UNIT.findall(text[start:]), True)
    beat, said = reading.beat, reading.said
    if not reading.rests:
        beat.append("0")
    last = text[-1:]
    if last in _NASAL_END:
        said = [*said[:-1], _NASAL_END[last]]
    elif last in _LENGTHENED:
        said.append(_LENGTHENED[last])
    elif last and last in "ىاوي" and text[-2:-1] not in TANWEEN:
        said.append(last)
    return "".join(said).replace("ةن", "تن"), "".join(beat)


def pattern_of(line: str) -> str:
    """0/1 pattern of a marked line."""
    return scanned(line)[1]


#: Spellings that are read otherwise, in order; the first entry of the second list also holds at the end of a line.
LEADING_ALIF = "أَ"
READ_AS = (
    ("وْا", "و"), ("الله", "اللاه"), ("اللّه", "الله"), ("إلَّا", "إِلّا"), ("نْ ال", "نَ ال"), ("لْ ال", "لِ ال"), ("إلَى", "إِلَى"), ("إذَا", "إِذَا"),
    ("ك ", "كَ "), (" ال ", " الْ "), ("ْ ال", "ِ ال"),
)
#: Words with a long vowel that is not written; the first entry that a word holds is used.
READ_WORDS = {
    "هذا": "هَاذَا", "هذه": "هَاذِه", "هذان": "هَاذَان", "هذين": "هَاذَين", "ذلك": "ذَالِك", "ذلكما": "ذَالِكُمَا", "ذلكم": "ذَالِكُم", "الله": "اللَّاه",
    "اللهم": "اللَّاهُمّ", "إله": "إِلَاه", "الإله": "الإِلَاه", "إلهي": "إِلَاهي", "إلهنا": "إِلَاهنا", "إلهكم": "إِلَاهكم", "إلههم": "إِلَاههم", "إلههن": "إِلَاههن",
    "رحمن": "رَحمَان", "طاوس": "طَاوُوس", "داود": "دَاوُود", "لكنه": "لَاكِنّهُ", "أولئك": "أُلَائِك", "أولئكم": "أُلَائِكُم",
}


_MARK, _SILENT = re.compile("[ً-ْ]"), re.compile(f"([{TANWEEN}])ا[{MARKS}]?")


def prepared(line: str) -> str:
    """The line spelled as it is read: a leading alif, silent alifs, the article and words with unwritten vowels."""
    line = line.strip()
    if line.startswith("ا"):
        line = LEADING_ALIF + line[1:]
    line = re.sub("وا(?= |$)", "و", line)
    for written, read in READ_AS:
        line = line.replace(written, read)
    plain_line = line
    for mark in MARKS:
        plain_line = plain_line.replace(mark, "")
    if any(k in plain_line for k in READ_WORDS):
        said = []
        for word in line.split(" "):
            bare = _MARK.sub("", word)
            key = next((k for k in READ_WORDS if k in bare), None)
            said.append(bare.replace(key, READ_WORDS[key]) if key else word)
        line = " ".join(said)
    if len(line) > 1 and line[1] in ACCEPTED and line[1] not in MARKS:
        line = line[0] + "َ" + line[1:]
    return _SILENT.sub(r"\1", line) if any(x in line for x in TANWEEN) else line


#: Letters of a line's end that carry no rhyme, forms of hamza, and ends in which ي is the rhyme.
SKIPPED, SOMETIMES, LONG, HAMZA, YA_ENDS = "ايىو", "هةك", "اويآ", "ؤئأء", ("يا", "يه", "ية")


def plain(line: str) -> str:
    return re.sub(r"[^ء-غف-ي ]", "", line or "").strip()


def rhyme_letter(line: str) -> tuple[str, int]:
    """(rhyme consonant, its index in the plain line); raises where the line has none."""
    text = plain(line)
    if text.endswith(YA_ENDS):
        return "ي", len(text) - 2
    at = len(text) - 1
    while at >= 0 and (text[at] in SKIPPED or (text[at] in SOMETIMES and at > 0 and text[at - 1] not in LONG)):
        at -= 1
    if at < 0:
        raise ValueError("no rhyme letter")
    letter = text[at]
    return ("ء" if letter in HAMZA else "ه" if letter in "هة" else letter), at


def rhyme_parts(line: str) -> str:
    """Names of what surrounds the rhyme letter: wasl, khuruj, ridf, tasis."""
    text, (_, at) = plain(line), rhyme_letter(line)
    kept = "".join(c for c in line if c in ACCEPTED or c == "آ").strip()
    after, still = text[at + 1 :], kept.endswith(SUKUN)
    found = []
    if not still and (after == "" or (len(after) == 1 and after in "ىاوي")):
        found.append("wasl")
    if len(after) == 1 and after in "كهة":
        found += ["wasl"] if still else ["wasl", "khuruj"]
    elif len(after) == 2 and after[0] in "كهة" and after[1] in "اوي":
        found += ["wasl", "khuruj"]
    if at >= 1 and text[at - 1] in "اويآى":
        found.append("ridf")
    elif at >= 2 and text[at - 2] in "اآ":
        found.append("tasis")
    return " ".join(dict.fromkeys(found))


def unmarked(text: str) -> list[str]:
    """Consonants without a mark, and doubled letters whose mark follows the doubling."""
    vowels, marks, out = "اويى", SHORT + SUKUN + TANWEEN, []
    for i, c in enumerate(text):
        if c in vowels or not "؀" <= c <= "ۿ":
            continue
        if "ء" <= c <= "ي" and not (c == "ل" and i and text[i - 1] == "ا"):
            near = next((x for x in text[i + 1 : i + 3] if "؀" <= x <= "ۿ"), "")
            if not near or near not in marks + SHADDA:
                out.append(f"unmarked {c}")
        if c == SHADDA and text[i + 1 : i + 2] and text[i + 1] in marks:
            out.append(f"doubled {c}{text[i + 1]}")
    return out


def _each(lines: pd.Series, fn) -> pd.Series:
    known: dict = {}
    for x in lines.unique():
        known[x] = fn(x)
    return lines.map(known)


def _struct(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


@F.pandas_udf(_struct("spelling", "pattern", "error"))
def scan(lines: pd.Series) -> pd.DataFrame:
    """Spelling and pattern of each line, both empty for an empty line; null with an ``error`` for a line that cannot be read."""

    def one(x):
        if x is None or not x.strip():
            return ("", "", None)
        try:
            return (*scanned(prepared(x)), None)
        except (IndexError, ValueError) as e:
            return (None, None, str(e))

    got = _each(lines, one)
    return pd.DataFrame({name: [g[i] for g in got] for i, name in enumerate(("spelling", "pattern", "error"))})


@F.pandas_udf(_struct("letter", "parts", "error"))
def rhyme(lines: pd.Series) -> pd.DataFrame:
    """Rhyme consonant of each line and the names of what surrounds it."""

    def one(x):
        try:
            return (rhyme_letter(x)[0], rhyme_parts(x), None)
        except (ValueError, TypeError, AttributeError) as e:
            return (None, None, str(e) or "no line")

    got = _each(lines, one)
    return pd.DataFrame({"letter": [g[0] for g in got], "parts": [g[1] for g in got], "error": [g[2] for g in got]})


#: What ``unmarked`` finds, as one expression: a consonant (ل not behind ا) before anything but a mark, with at most one foreign character between; a doubling and the mark behind it.
_ISSUE = f"(?:(?<!ا)ل|[ء-ي&&[^اويىل]])(?![^؀-ۿ]?[{MARKS}])|{SHADDA}[{SHORT}{SUKUN}{TANWEEN}]"


def mark_issues(text: Column) -> Column:
    """Diacritic issues of each text, as ``unmarked`` names them; null has none.

    Built-in functions hold one text at a time: a list of a whole Arrow batch's issues is larger than an executor.
    """
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_ISSUE), F.lit(0))
    return F.transform(found, lambda x: F.concat(F.when(x.startswith(SHADDA), "doubled ").otherwise("unmarked "), x))


def n_mark_issues(text: Column) -> Column:
    """How many ``mark_issues`` a text has, without naming them."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(_ISSUE)).cast("long")
