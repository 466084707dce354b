"""Text normalisation and tokenising as column expressions (all JVM-side)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Turkish letters and their plain forms; abbreviations written out (longest first when applied).
FOLD_FROM, FOLD_TO = "şığüöçŞİĞÜÖÇ", "siguocSIGUOC"
ABBREVIATIONS = {"d / d": "d/d", "vb.": "ve benzeri", "approx.": "approximately", "bkz.": "bakınız"}
SPACE = r"\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"  # white space, inside a class


def lower_tr(c: Column) -> Column:
    """Lower case with the dotted and dotless i told apart before the general rule applies."""
    return F.lower(F.translate(c, "İI", "iı"))


def fold(c: Column) -> Column:
    """Letters without diacritics; combining marks dropped."""
    return F.regexp_replace(F.translate(c, FOLD_FROM, FOLD_TO), r"\p{M}", "")


def collapse_repeats(c: Column) -> Column:
    """Four and more of one character become two."""
    return F.regexp_replace(c, r"(.)\1{3,}", "$1$1")


def collapse_vowels(c: Column) -> Column:
    """Three and more of one vowel become one."""
    return F.regexp_replace(c, r"([aeiouüöıâAEIOUÜÖİ])\1{2,}", "$1")


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def abbreviations(c: Column, table: dict[str, str] | None = None) -> Column:
    """Written out, longest first."""
    pairs = sorted((table or ABBREVIATIONS).items(), key=lambda kv: -len(kv[0]))
    return reduce(lambda x, kv: F.replace(x, F.lit(kv[0]), F.lit(kv[1])), pairs, c)


def normalize(c: Column) -> Column:
    return squeeze(collapse_repeats(abbreviations(lower_tr(c))))


def tokens(c: Column, stop: tuple[str, ...] = (), least: int = 2) -> Column:
    """Distinct words in order of first occurrence: punctuation stripped, short ones and stop words dropped."""
    words = F.split(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}\s]", " "), r"\s+")
    keep = lambda w: (F.length(w) >= least) & (~w.isin(*stop) if stop else F.lit(True))
    return F.array_distinct(F.filter(words, keep))


def word_ngrams(words: Column, n: int) -> Column:
    """n-grams of an array of words; none where it is shorter."""
    grams = F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, n), " "))
    return F.when(F.size(words) >= n, grams).otherwise(F.array().cast("array<string>"))


def char_ngrams(c: Column, n: int = 3) -> Column:
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - (n - 1)), lambda i: F.substr(c, i, F.lit(n))))
    return F.when(F.length(c) >= n, grams).otherwise(F.array().cast("array<string>"))


def ellipsis(c: Column, n: int, mark: str = "…") -> Column:
    """Trimmed; cut to n characters including the mark where longer."""
    t = F.trim(c)
    return F.when(F.length(t) > n, F.concat(F.substring(t, 1, n - len(mark)), F.lit(mark))).otherwise(t)


def rating_int(c: Column) -> Column:
    """Whole rating from text: an integer, else a number rounded half to even, clamped to 1-5, else 3."""
    x = F.replace(c, F.lit(","), F.lit(".")).try_cast("double")
    return F.when(x.isNull(), 3).otherwise(F.least(F.greatest(F.bround(x), F.lit(1.0)), F.lit(5.0)).cast("int"))  # greatest skips NULLs


def rating_half_up(c: Column) -> Column:
    """floor(x + 0.5) clamped to 1-5; NULL where there is no number."""
    x = F.replace(c, F.lit(","), F.lit(".")).try_cast("double")
    return F.when(x.isNotNull(), F.least(F.greatest(F.floor(x + 0.5), F.lit(1)), F.lit(5))).cast("int")


def chunks(c: Column, size: int) -> Column:
    """Pieces of `size` characters."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.length(c) - 1) / size), F.lit(0)).cast("int")), lambda i: F.substr(c, i * size + 1, F.lit(size)))


# Letters of Turkish, German, French and Spanish and the plain ones they are folded to.
PLAIN_FROM, PLAIN_TO = "çğıöşüâîûäàáãéèêëíìïóòôõúùñßčćžœæ", "cgiosuaiuaaaaeeeeiiioooouunscczoa"


def folded(c: Column) -> Column:
    """Lower case without diacritics, white space as single blanks: what rule terms are compared with. NULL stays NULL."""
    return F.trim(F.regexp_replace(F.translate(F.lower(F.translate(c, "İI", "ii")), PLAIN_FROM, PLAIN_TO), "[ \\t\\r\\n]+", " "))


def folded_sql(column: str) -> str:
    return f"trim(regexp_replace(translate(lower(translate({column}, 'İI', 'ii')), '{PLAIN_FROM}', '{PLAIN_TO}'), '[ \\t\\r\\n]+', ' ', 'g'))"


def words_of(folded_text: Column) -> Column:
    """The words of a folded text in order, repeated ones too."""
    return F.filter(F.split(folded_text, r"[^\p{L}\p{N}]+"), lambda w: w != "")
