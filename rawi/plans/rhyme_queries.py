"""Lines, pairs and rhymes over ``documents``, transliterated to Arabic letters."""

from __future__ import annotations

from pyspark.sql import functions as F

from rawi.functions import arabic as A
from rawi.functions import text as X
from rawi.operators import rhyme as R
from rawi.operators.steps import once, pair_rows, with_pairs
from rawi.sources.tables import table


def in_arabic(docs):
    """doc_id as poem_idx, and the text's lines in Arabic letters."""
    return docs.select(F.col("doc_id").alias("poem_idx"), F.split(A.transliterated(F.coalesce("text", F.lit(""))), "\n").alias("verses"))


def poems(spark, sf_dir):
    return in_arabic(table(spark, sf_dir, "documents"))


def lines_of(poems):
    """Non-blank lines with their place."""
    return poems.select("poem_idx", F.posexplode(F.filter(F.transform("verses", X.strip), lambda v: v != "")).alias("pos", "line"))


def lines(spark, sf_dir):
    return lines_of(poems(spark, sf_dir))


def verse_counts(spark, sf_dir):
    d = with_pairs(table(spark, sf_dir, "documents"), ["doc_id"])
    return d.select("doc_id", X.verse_count(F.col("verses")).cast("long").alias("n_verses"), F.size("pairs").cast("long").alias("n_pairs"), (F.size("verses") % 2 == 0).alias("even"))


def bait_pairs(spark, sf_dir):
    return pair_rows(table(spark, sf_dir, "documents"), "doc_id")


def pair_text(spark, sf_dir):
    d = with_pairs(table(spark, sf_dir, "documents"), ["doc_id"]).filter(F.size("pairs") > 0)
    return d.select("doc_id", F.md5(X.pairs_text(F.col("pairs"))).alias("digest"))


def rhyme_dictionary(spark, sf_dir):
    return R.dictionary(poems(spark, sf_dir))


def rhyme_rekey(spark, sf_dir):
    return R.move_vowels(R.dictionary(poems(spark, sf_dir)))


def rhyme_prefix_strip(spark, sf_dir):
    return R.strip_prefixes(R.dictionary(poems(spark, sf_dir)))


def rhyme_distribute(spark, sf_dir):
    return R.spread_bare_keys(R.dictionary(poems(spark, sf_dir)))


def rhyme_cleaning(spark, sf_dir):
    return R.cleaning_summary(R.dictionary(poems(spark, sf_dir)))


def rhyme_keys(spark, sf_dir):
    keys = R.dictionary(poems(spark, sf_dir)).select("rhyme_key").distinct()
    return keys.select("rhyme_key", A.is_rhyme_key(F.col("rhyme_key")).alias("usable"))


def rhyme_suffix_join(spark, sf_dir):
    words = lines(spark, sf_dir).select("poem_idx", "pos", A.last_word(F.col("line")).alias("word"))
    keys = R.dictionary(poems(spark, sf_dir)).select("rhyme_key").distinct()
    return R.suffix_matches(words, keys).select("poem_idx", F.col("pos").cast("long").alias("pos"), "word", "rhyme_key")


def rhyme_majority(spark, sf_dir):
    return R.majority_letter(lines(spark, sf_dir).filter("pos % 2 = 1"))


def poem_ends(spark, sf_dir):
    """poem_idx and the last words of every second line; lines are cleaned once."""
    cleaned = once(poems(spark, sf_dir), ["poem_idx"], lines=F.transform("verses", A.clean_line))
    kept = once(cleaned, ["poem_idx"], lines=F.filter("lines", lambda v: v != ""))
    return once(kept, ["poem_idx"], ends=A.ends_of(F.col("lines")))


def rhyme_letter_first(spark, sf_dir):
    bare = once(poem_ends(spark, sf_dir), ["poem_idx"], ends=F.transform("ends", A.bare_end))
    return bare.select("poem_idx", F.coalesce(A.rhyme_letter_of(F.col("ends")), F.lit("")).alias("letter"))


def rhyme_uniform(spark, sf_dir):
    tails = once(poem_ends(spark, sf_dir), ["poem_idx"], tails=F.transform("ends", A.last_consonant))
    return tails.select("poem_idx", A.shared_tail(F.col("tails")).alias("rhyme"))


def last_words(spark, sf_dir):
    return lines(spark, sf_dir).groupBy(A.last_clean_word(F.col("line")).alias("word")).agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        verse_counts, bait_pairs, pair_text, rhyme_dictionary, rhyme_rekey, rhyme_prefix_strip, rhyme_distribute, rhyme_cleaning, rhyme_keys,
        rhyme_suffix_join, rhyme_majority, rhyme_letter_first, rhyme_uniform, last_words,
    )
}

_V = "list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x)), lambda x: x <> '')"
_T = f"string_split(translate(lower(coalesce(text, '')), '{A.LATIN}', '{A.ARABIC}'), chr(10))"
_DICT = rf"""verse AS (
  SELECT list_filter(list_transform({_T}, lambda x: trim(x)), lambda x: len(regexp_extract_all(x, '[\x{{0600}}-\x{{06FF}}]')) >= 5) AS l FROM documents
), ends AS (
  SELECT list_transform(l, lambda x: regexp_extract(x, '([^ ]+)$', 1)) AS w FROM verse WHERE len(l) = 1 OR (len(l) > 0 AND len(l) % 2 = 0)
), own AS (
  SELECT w, CASE WHEN len(w) = 1 THEN w ELSE list_filter(w[greatest(1, len(w) - 5):], lambda x, i: i % 2 = 0) END AS e FROM ends
), keyed AS (
  SELECT w, CASE
    WHEN len(w) > 1 AND len(list_filter(e, lambda x: ends_with(x, right(e[1], 3)))) = len(e) THEN right(e[1], 3)
    WHEN len(w) > 1 AND len(list_filter(e, lambda x: ends_with(x, right(e[1], 2)))) = len(e) THEN right(e[1], 2)
    WHEN len(w) > 1 AND len(list_filter(e, lambda x: ends_with(x, right(e[1], 1)))) = len(e) THEN right(e[1], 1)
    ELSE regexp_extract(e[1], '(\p{{L}}\P{{L}}*)$', 1) END AS k FROM own
), dict AS (
  SELECT DISTINCT k AS rhyme_key, word FROM (
    SELECT k, unnest(CASE WHEN len(w) = 1 THEN w ELSE list_filter(list_filter(w, lambda x, i: i % 2 = 0),
      lambda x: ends_with(x, k) OR ends_with(x, k || 'ي') OR ends_with(x, k || 'ا') OR ends_with(x, k || 'وا')) END) AS word FROM keyed WHERE k <> '')
)"""
_LINES = rf"lines AS (SELECT doc_id AS poem_idx, unnest(l) AS line, unnest(range(0, len(l))) AS pos FROM (SELECT doc_id, list_filter(list_transform({_T}, lambda x: trim(x)), lambda x: x <> '') AS l FROM documents))"
_BARE = r"[\x{064B}-\x{0652}]"
_CLEAN = rf"list_filter(list_transform({_T}, lambda x: trim(regexp_replace(regexp_replace(x, '[\x{{0640}}\x{{200F}}\x{{200E}}\x{{202C}}]', '', 'g'), '[،؛؟!.\-\s]+$', ''))), lambda x: x <> '')"
# literal values, so that a wrong table of the library shows
_PREFIX = """WHEN starts_with(word, 'وبال') THEN 'ال' || substr(word, 5) WHEN starts_with(word, 'كال') THEN 'ال' || substr(word, 4) WHEN starts_with(word, 'وال') THEN 'ال' || substr(word, 4)
  WHEN starts_with(word, 'فال') THEN 'ال' || substr(word, 4) WHEN starts_with(word, 'بال') THEN 'ال' || substr(word, 4) WHEN starts_with(word, 'ولل') THEN 'ال' || substr(word, 4)
  WHEN starts_with(word, 'لل') THEN 'ال' || substr(word, 3) WHEN starts_with(word, 'وا') THEN 'ا' || substr(word, 3) WHEN starts_with(word, 'فا') THEN 'ا' || substr(word, 3)"""
_SAME = "CASE WHEN letter IN ('أ', 'إ', 'ؤ', 'ئ', 'آ') THEN 'ء' WHEN letter IN ('ى', 'ٱ') THEN 'ا' WHEN letter IN ('ة', 'ہ', 'ھ') THEN 'ه' WHEN letter = 'ک' THEN 'ك' WHEN letter = 'ی' THEN 'ي' ELSE letter END"
_NAMES = """CASE letter WHEN 'ا' THEN 'الألف' WHEN 'ب' THEN 'الباء' WHEN 'ت' THEN 'التاء' WHEN 'ث' THEN 'الثاء' WHEN 'ج' THEN 'الجيم' WHEN 'ح' THEN 'الحاء' WHEN 'خ' THEN 'الخاء' WHEN 'د' THEN 'الدال'
  WHEN 'ذ' THEN 'الذال' WHEN 'ر' THEN 'الراء' WHEN 'ز' THEN 'الزاي' WHEN 'س' THEN 'السين' WHEN 'ش' THEN 'الشين' WHEN 'ص' THEN 'الصاد' WHEN 'ض' THEN 'الضاد' WHEN 'ط' THEN 'الطاء' WHEN 'ظ' THEN 'الظاء'
  WHEN 'ع' THEN 'العين' WHEN 'غ' THEN 'الغين' WHEN 'ف' THEN 'الفاء' WHEN 'ق' THEN 'القاف' WHEN 'ك' THEN 'الكاف' WHEN 'ل' THEN 'اللام' WHEN 'م' THEN 'الميم' WHEN 'ن' THEN 'النون' WHEN 'ه' THEN 'الهاء'
  WHEN 'و' THEN 'الواو' WHEN 'ي' THEN 'الياء' ELSE letter END"""

SQL = {
    "verse_counts": f"SELECT doc_id, CAST(len({_V}) AS BIGINT) AS n_verses, CAST(CASE WHEN len({_V}) % 2 = 0 THEN len({_V}) // 2 ELSE 0 END AS BIGINT) AS n_pairs, len({_V}) % 2 = 0 AS even FROM documents",
    "bait_pairs": f"SELECT doc_id, i // 2 AS pair_no, v[i + 1] AS first, v[i + 2] AS second FROM (SELECT doc_id, v, unnest(range(0, len(v), 2)) AS i FROM (SELECT doc_id, {_V} AS v FROM documents) WHERE len(v) % 2 = 0)",
    "pair_text": f"SELECT doc_id, md5(array_to_string(v, chr(10)) || chr(10)) AS digest FROM (SELECT doc_id, {_V} AS v FROM documents) WHERE len(v) > 0 AND len(v) % 2 = 0",
    "rhyme_dictionary": f"WITH {_DICT} SELECT * FROM dict",
    "rhyme_rekey": f"WITH {_DICT} SELECT DISTINCT CASE WHEN length(rhyme_key) = 1 AND length(word) >= 3 AND substr(word, length(word) - 2, 1) IN ('و', 'ي', 'ا') THEN rhyme_key || substr(word, length(word) - 2, 1) ELSE rhyme_key END AS rhyme_key, word FROM dict",
    "rhyme_prefix_strip": f"WITH {_DICT} SELECT DISTINCT rhyme_key, CASE WHEN length(word) <= 4 THEN word {_PREFIX} ELSE word END AS word FROM dict",
    "rhyme_distribute": f"WITH {_DICT} SELECT DISTINCT rhyme_key, word FROM (SELECT unnest(CASE WHEN length(rhyme_key) > 1 THEN [rhyme_key] ELSE list_transform(['ْ', 'َ', 'ِ', 'ُ'], lambda m: rhyme_key || CASE WHEN right(word, 1) IN ('و', 'ي', 'ا') THEN right(word, 1) ELSE '' END || m) END) AS rhyme_key, word FROM dict WHERE word <> '')",
    "rhyme_cleaning": rf"""WITH {_DICT}, flags AS (SELECT rhyme_key, regexp_matches(word, '^[\x{{0600}}-\x{{06FF}}\x{{0750}}-\x{{077F}}\x{{08A0}}-\x{{08FF}}\x{{FB50}}-\x{{FDFF}}\x{{FE70}}-\x{{FEFF}} \x{{200C}}\x{{200D}}]+$') AS ok FROM dict),
      keys AS (SELECT rhyme_key, count(*) AS n, sum(CASE WHEN ok THEN 1 ELSE 0 END) AS kept FROM flags GROUP BY rhyme_key)
      SELECT CAST(sum(n) AS BIGINT) AS words_before, CAST(sum(kept) AS BIGINT) AS words_after, CAST(sum(n - kept) AS BIGINT) AS words_removed, CAST(sum(CASE WHEN kept = 0 THEN 1 ELSE 0 END) AS BIGINT) AS keys_removed FROM keys""",
    "rhyme_keys": f"WITH {_DICT} SELECT DISTINCT rhyme_key, regexp_matches(rhyme_key, '^[{A.KEY_LETTERS}]+$') AND rhyme_key <> 'ا' AS usable FROM dict",
    "rhyme_suffix_join": f"WITH {_DICT}, {_LINES}, k AS (SELECT DISTINCT rhyme_key FROM dict), w AS (SELECT poem_idx, pos, regexp_extract(line, '([^ ]+)$', 1) AS word FROM lines) SELECT poem_idx, CAST(pos AS BIGINT) AS pos, word, rhyme_key FROM w JOIN k ON rhyme_key IN (right(word, 1), right(word, 2), right(word, 3))",
    "rhyme_majority": f"WITH {_LINES}, c AS (SELECT poem_idx, right(line, 1) AS letter, count(*) AS n, min(pos) AS first FROM lines WHERE pos % 2 = 1 GROUP BY ALL) SELECT poem_idx, letter, {_NAMES} AS name FROM (SELECT *, row_number() OVER (PARTITION BY poem_idx ORDER BY n DESC, first) AS r FROM c) WHERE r = 1",
    "rhyme_letter_first": rf"""WITH v AS (SELECT doc_id, {_CLEAN} AS l FROM documents), e AS (SELECT doc_id, CASE WHEN len(l) % 2 = 0 AND len(l) >= 2 THEN list_filter(list_transform(list_filter(l, lambda x, i: i % 2 = 0),
      lambda x: regexp_replace(regexp_extract(x, '([^\s]+)$', 1), '(وا|[يا])$', '')), lambda x: length(x) >= 2) ELSE [] END AS w FROM v), f AS (SELECT doc_id, right(w[1], 1) AS letter FROM e)
      SELECT doc_id AS poem_idx, coalesce({_SAME}, '') AS letter FROM f""",
    "rhyme_uniform": rf"""WITH v AS (SELECT doc_id, {_CLEAN} AS l FROM documents), e AS (SELECT doc_id, CASE WHEN len(l) % 2 = 0 AND len(l) >= 2 THEN list_transform(list_filter(l, lambda x, i: i % 2 = 0), lambda x: regexp_extract(x, '([^\s]+)$', 1)) ELSE [] END AS w FROM v),
      c AS (SELECT doc_id, list_transform(w, lambda x: CASE WHEN length(x) > 1 THEN regexp_extract(x, '([^يا])[يا]*$', 1) END) AS t, w FROM e)
      SELECT doc_id AS poem_idx, CASE WHEN len(w) > 0 AND len(list_filter(t, lambda x: x IS NOT DISTINCT FROM t[1])) = len(t) THEN t[1] END AS rhyme FROM c""",
    "last_words": rf"""WITH {_LINES}, w AS (SELECT list_filter(list_transform(string_split_regex(line, '\s+'), lambda x: regexp_replace(regexp_replace(x, '[\x{{064B}}-\x{{065F}}\x{{0670}}\x{{0640}}]', '', 'g'), '[،؛؟!.\-\s]+$', '')),
      lambda x: regexp_matches(x, '^[\x{{0621}}-\x{{063A}}\x{{0641}}-\x{{064A}}\x{{067E}}\x{{0686}}\x{{0698}}\x{{06A9}}\x{{06AF}}\x{{06BE}}\x{{06CC}}]+$')) AS l FROM lines)
      SELECT coalesce(l[len(l)], '') AS word, count(*) AS n FROM w GROUP BY 1""",
}
