"""Column functions on Arabic script: marks, letters, words and rhymes.

All of these are Catalyst expressions; scansion, which reads its own output as it
goes, is in ``rawi.functions.scansion``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rawi.functions.text import strip

# Unicode ranges and characters.
MARKS = r"ً-ْ"
WIDE_MARKS = r"ً-ٰٟـ"
TATWEEL = "ـ"
BIDI = "‏‎‬"
WORD_LETTERS = r"ء-غف-يپچژکگھی"
BLOCKS = r"؀-ۿݐ-ݿࢠ-ࣿﭐ-﷿ﹰ-﻿ ‌‍"
KEY_LETTERS = "ءآأؤإئابةتثجحخدذرزسشصضطظعغفقكلمنهويى"
FATHATAN, DAMMATAN, KASRATAN, FATHA, DAMMA, KASRA, SHADDA, SUKUN = "ًٌٍَُِّْ"
KEY_MARKS = "ًٌٍَُِّْـٰ"
SHORT_VOWELS = FATHA + DAMMA + KASRA
VOWEL_MARKS = {"فتحة": FATHA, "ضمة": DAMMA, "كسرة": KASRA, "سكون": SUKUN}

#: Names of the letters.
LETTER_NAMES = {
    "ا": "الألف", "ب": "الباء", "ت": "التاء", "ث": "الثاء", "ج": "الجيم", "ح": "الحاء", "خ": "الخاء", "د": "الدال", "ذ": "الذال", "ر": "الراء",
    "ز": "الزاي", "س": "السين", "ش": "الشين", "ص": "الصاد", "ض": "الضاد", "ط": "الطاء", "ظ": "الظاء", "ع": "العين", "غ": "الغين", "ف": "الفاء",
    "ق": "القاف", "ك": "الكاف", "ل": "اللام", "م": "الميم", "ن": "النون", "ه": "الهاء", "و": "الواو", "ي": "الياء",
}

#: Letters that rhyme as another letter.
SAME_RHYME = {"أ": "ء", "إ": "ء", "ؤ": "ء", "ئ": "ء", "آ": "ء", "ى": "ا", "ٱ": "ا", "ة": "ه", "ک": "ك", "ی": "ي", "ہ": "ه", "ھ": "ه"}

#: Prefixes of longer words and what stays of them, first match wins.
PREFIXES = (("وبال", "ال"), ("كال", "ال"), ("وال", "ال"), ("فال", "ال"), ("بال", "ال"), ("ولل", "ال"), ("لل", "ال"), ("وا", "ا"), ("فا", "ا"))


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def strip_marks(c: Column) -> Column:
    return F.regexp_replace(c, f"[{MARKS}]", "")


def strip_tatweel(c: Column) -> Column:
    return F.replace(c, F.lit(TATWEEL), F.lit(""))


def normalise(c: Column) -> Column:
    """Arabic letters, marks and spaces only, without marks and tatweel, trimmed."""
    return strip(strip_marks(F.regexp_replace(c, r"[^ء-ْ ]|ـ", "")))


def clean_line(c: Column) -> Column:
    """A line without tatweel, direction marks and punctuation at its end."""
    return strip(F.regexp_replace(F.regexp_replace(c, f"[{TATWEEL}{BIDI}]", ""), r"[،؛؟!.\-\s]+$", ""))


def clean_word(c: Column) -> Column:
    """A word without marks and trailing punctuation; empty unless all letters are Arabic."""
    bare = strip(F.regexp_replace(F.regexp_replace(c, f"[{WIDE_MARKS}]", ""), r"[،؛؟!.\-\s]+$", ""))
    return F.regexp_extract(bare, f"^[{WORD_LETTERS}]+[\\x{{85}}\\x{{2028}}\\x{{2029}}]?\\z", 0)  # a line end behind the letters stays


def words(line: Column) -> Column:
    return F.filter(F.split(strip(line), r"\s+"), lambda w: w != "")


def last_word(line: Column) -> Column:
    # tried at starts of words only and without going back, so that long lines take linear time
    return F.regexp_extract(line, r"(?<!\S)(\S++)\s*+$", 1)


def last_clean_word(line: Column) -> Column:
    """The last word that cleans to something."""
    last = clean_word(F.element_at(F.split(strip(line), r"\s+"), -1))
    found = F.filter(F.transform(words(line), clean_word), lambda w: w != "")  # made only where the last word cleans to nothing
    return F.coalesce(F.when(last != "", last), F.try_element_at(found, F.lit(-1)), F.lit(""))


def rhyme_tail(word: Column) -> Column:
    """From the last letter to the end, with the marks that follow it."""
    return F.regexp_extract(word, r"(\p{L}\P{L}*)$", 1)


def is_verse(line: Column) -> Column:
    """Not blank, and at least five characters of the Arabic block."""
    return (strip(line) != "") & (line.rlike(r"(?:[؀-ۿ][^؀-ۿ]*+){5}"))


def is_arabic_word(word: Column) -> Column:
    return F.coalesce(word.rlike(f"^[{BLOCKS}]+$") & (strip(word) != ""), F.lit(False))


def _ending(tail: Column):
    return lambda w: w.endswith(tail)


def rhyme_pattern(ends: Column) -> Column:
    """Longest common end of up to three characters of the words, else the tail of the first."""
    first = F.get(ends, F.lit(0))
    out = F.when(F.size(ends) == 0, F.lit(""))
    for n in (3, 2, 1):
        tail = F.right(first, F.lit(n))
        out = out.when(F.forall(ends, _ending(tail)), tail)
    return out.otherwise(rhyme_tail(first))


def rhymes_with(word: Column, key: Column) -> Column:
    """Does the word end with the key, with or without marks, or with the key and ي, ا or وا?"""
    bare = strip_marks(word)
    ends = word.endswith(key) | bare.endswith(key)
    for more in ("ي", "ا", "وا"):
        ends = ends | word.endswith(F.concat(key, F.lit(more)))
    return (strip(word) != "") & (bare != "") & ends


def last_consonant(word: Column) -> Column:
    """The last letter that is neither ي nor ا; null for a single letter."""
    return F.when(F.length(word) > 1, F.regexp_extract(word, r"([^يا])[يا]*$", 1))


def uniform_rhyme(ends: Column) -> Column:
    """The last consonant that all words share, else null."""
    return shared_tail(F.transform(ends, last_consonant))


def shared_tail(tails: Column) -> Column:
    """What all elements are, else null."""
    return F.when((F.size(F.array_distinct(tails)) == 1) & (F.size(tails) > 0), F.get(tails, F.lit(0)))


def ends_of(verses: Column) -> Column:
    """Last words of the second, fourth, ... line; none unless the number of lines is even and at least 2."""
    even = (F.size(verses) % 2 == 0) & (F.size(verses) >= 2)
    kept = F.filter(F.filter(verses, lambda v, i: i % 2 == 1), lambda v: strip(v) != "")
    return F.when(even, F.transform(kept, last_word)).otherwise(F.array().cast("array<string>"))


def without_vowel_end(word: Column) -> Column:
    """The word without وا, else without one ي or ا, at its end."""
    return F.regexp_replace(word, r"(وا|[يا])$", "")


def rhyme_letter(verses: Column) -> Column:
    """Letter on which the lines rhyme: the last of the first end, unified; null without two ends."""
    return rhyme_letter_of(F.transform(ends_of(verses), bare_end))


def bare_end(word: Column) -> Column:
    return strip_marks(without_vowel_end(word))


def unified(letter: Column) -> Column:
    """The letter as which it rhymes."""
    return F.coalesce(_map(SAME_RHYME)[letter], letter)


def rhyme_letter_of(ends: Column) -> Column:
    """Last letter, unified, of the first bare end that has two letters."""
    ends = F.filter(ends, lambda w: F.length(w) >= 2)
    return F.when(F.size(ends) >= 1, unified(F.right(F.get(ends, F.lit(0)), F.lit(1))))


#: Letters, beside those with a name, that count as a letter on which lines rhyme; marks that stay in front of it.
MORE_LETTERS = "ءأإآؤئةى"
OPEN_MARKS = SUKUN + FATHA + KASRA + DAMMA


def doubled_rhyme(ends: Column) -> Column:
    """Rhyme of lines of which one ends in a letter behind a shadda; null for other lines.

    It is the first two letters of the first word, marks and a ي or ا at the end
    aside, if all words begin with them, else the last letter of the first word
    that does not.
    """
    short = F.transform(ends, lambda w: F.regexp_replace(w, "[يا]$", ""))
    doubled = F.exists(short, lambda w: (F.length(w) >= 2) & (F.substring(w, -2, 1) == SHADDA))
    bare = F.filter(F.transform(short, strip_marks), lambda w: F.length(w) >= 2)
    head = F.left(F.get(bare, F.lit(0)), F.lit(2))
    odd = F.filter(bare, lambda w: F.left(w, F.lit(2)) != head)
    return F.when((F.size(ends) >= 2) & doubled & (F.size(bare) >= 2), F.when(F.size(odd) == 0, head).otherwise(F.right(F.get(odd, F.lit(0)), F.lit(1))))


def loose_rhyme(ends: Column) -> Column:
    """Letter of lines whose last three letters hold no vowel and whose last letter but one differs; null for other lines.

    A short vowel or sukun at the end of the first word stands in front of the letter.
    """
    long = F.filter(F.transform(ends, strip_marks), lambda w: F.length(w) >= 3)
    kept = F.filter(F.transform(long, lambda w: F.regexp_replace(w, "[يا]$", "")), lambda w: F.length(w) >= 3)
    vowel = F.exists(kept, lambda w: F.right(w, F.lit(3)).rlike("[ويا]"))
    same = F.forall(kept, lambda w: F.substring(w, -2, 1) == F.substring(F.get(kept, F.lit(0)), -2, 1))
    letter = F.right(F.get(kept, F.lit(0)), F.lit(1))
    known = letter.rlike(f"^[{''.join(LETTER_NAMES)}{MORE_LETTERS}]$")
    mark = F.regexp_extract(F.get(ends, F.lit(0)), f"[{OPEN_MARKS}]$", 0)
    return F.when((F.size(ends) >= 2) & (F.size(long) >= 2) & (F.size(kept) >= 2) & ~vowel & ~same & known, F.concat(mark, unified(letter)))


def letter_name(letter: Column) -> Column:
    return F.coalesce(_map(LETTER_NAMES)[letter], letter)


def vowel_mark(name: Column) -> Column:
    return F.coalesce(_map(VOWEL_MARKS)[name], name)


def one_vowel(c: Column) -> Column:
    """Of short vowels in a row the last stays."""
    return F.regexp_replace(c, f"[{SHORT_VOWELS}](?=[{SHORT_VOWELS}])", "")


def after_scansion(c: Column) -> Column:
    return F.replace(c, F.lit("ةن"), F.lit("تن"))


def without_prefix(word: Column) -> Column:
    """Words of more than four letters lose the first fitting prefix, marks and all."""
    bare, out = strip_marks(word), None
    for prefix, stays in PREFIXES:
        spelled = "".join(f"[{MARKS}]*{letter}" for letter in prefix)
        step = F.concat(F.lit(stays), F.regexp_replace(word, f"^{spelled}", ""))
        out = F.when(bare.startswith(prefix), step) if out is None else out.when(bare.startswith(prefix), step)
    return F.when(F.length(bare) > 4, out.otherwise(word)).otherwise(word)


def is_rhyme_key(key: Column) -> Column:
    """A usable key: Arabic letters, more than marks, not one letter with two vowel marks, not a bare alif."""
    trimmed = strip(key)
    bare = strip_marks(trimmed)
    vowels = F.length(F.regexp_replace(trimmed, f"[^{KEY_MARKS}]|{SHADDA}", ""))
    letters = F.length(F.regexp_replace(trimmed, f"[{KEY_MARKS}\\s]", ""))
    return bare.rlike(f"^[{KEY_LETTERS}]*$") & ~trimmed.rlike(f"^[{KEY_MARKS}]*$") & ~((vowels >= 2) & (letters == 1)) & (trimmed != "ا")


#: Latin letters in order and the Arabic letters that stand for them when Latin text is used as input.
LATIN, ARABIC = "abcdefghijklmnopqrstuvwxyz", "ابتثجحخدذرزسشصضطظعغفقكلمنهو"


def transliterated(text: Column) -> Column:
    return F.translate(F.lower(text), LATIN, ARABIC)
