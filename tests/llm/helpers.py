"""Inputs that the operators must take, and plain-Python versions of their results."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYLLABLES = {"en": "th er on an re he in ed nd ha at en".split(), "fr": "le ou eu re qu tion ment é ai eau".split(), "de": "ein ung ch sch der keit ö ver".split()}


def text(rng, lang="en", words=80):
    out = ["".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(words)]
    return "\n".join(" ".join(out[i : i + 12]) for i in range(0, len(out), 12))


def documents(n=60, seed=1):
    """(doc_id, text, lang, source, n_chars) rows with copies, near copies, shared passages and secrets."""
    rng = random.Random(seed)
    rows = []
    passage = text(rng, words=60).replace("\n", " ")
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        t = text(rng, lang, rng.choice([5, 40, 90, 200]))
        if i % 10 in (3, 5):
            _, t, lang, _, _ = rows[rng.randrange(len(rows))]
        if i % 10 == 5:
            w = t.split(" ")
            w[len(w) // 2] = f"edit{i}"
            t = " ".join(w)
        elif i % 10 == 7:
            t = t + "\n" + passage + " " + t[:50]
        elif i % 10 == 9:
            t += f'\ntoken = "{rng.getrandbits(160):040x}" é {rng.choice(["AKIA" + "ABCDEFGH23456789", "AKIA12"])}'
        rows.append((i, t, lang, f"s{i % 3}", len(t)))
    return rows


def odd_rows():
    """Nulls in every column, empty and very long texts, repeated rows and ids."""
    rng = random.Random(5)
    long = " ".join(text(rng, words=30_000).split())
    a = text(rng)
    return [
        (None, a, "en", "s0", 1), (1, None, "en", "s0", None), (2, "", None, None, 0), (3, "   \n\n ", "fr", "s1", 5), (4, "1234 %%% 99", "en", "s1", 11), (5, long, "en", "s1", len(long)),
        (6, a, "en", "s0", len(a)), (6, a, "en", "s0", len(a)), (7, a, None, "s0", len(a)), (8, "x" * 50_000, "de", None, 50_000), (9, "one", "en", "", 3), (10, "É ß \U0001f600 ok", "de", "s2", 8),
    ]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside.
CLASHES = ("hits", "keys", "score", "size", "row", "same", "weight", "target", "copies", "taken", "evidence", "tid", "code", "key", "label", "found", "n_words", "kept", "lang_pred", "ordinal", "file", "block")


def frame(spark, rows, clashing=False):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({c: F.lit("clash") for c in CLASHES}) if clashing else df
