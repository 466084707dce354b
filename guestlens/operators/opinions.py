"""Rule tables over folded text as column expressions: cue hits, scores per label, polarity with negation, ordered overrides.

Every table is a fixed, small dictionary, so it is part of the plan; no join, no shuffle, whole-stage code where Spark has it.
NULL texts have no hits and score 0.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guestlens.functions import text as tx
from guestlens.rulesets import hotel

TRAPS = [t for ts in hotel.TRAPS.values() for t in ts]
NEGATED = -0.8  # what a negation leaves of a word's weight
STRENGTHENED = 1.5


def cue_text(text: Column) -> Column:
    """Folded, trap phrases taken out, a blank on either side."""
    plain = reduce(lambda c, t: F.replace(c, F.lit(t), F.lit(" ")), TRAPS, tx.folded(text))
    return F.concat(F.lit(" "), F.coalesce(plain, F.lit("")), F.lit(" "))


def settled(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are computed once, however often they are used afterwards: projections over a generator aren't merged."""
    one = F.explode(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))).alias("settled_")
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, one).select(*kept, *[F.col(f"settled_.{k}").alias(k) for k in columns])


def short(term: str) -> bool:
    return len(term) <= 4 and " " not in term


def cue(t: Column, term: str) -> Column:
    """Whether a cue text has the term: short ones as whole words, longer ones anywhere, so with any ending."""
    return t.rlike(rf"(^|[^\p{{L}}]){term}([^\p{{L}}]|$)") if short(term) else F.contains(t, F.lit(term))


def total(t: Column, weighted: Iterable[tuple[str, float]]) -> Column:
    """Sum of the weights of the terms a cue text has."""
    return sum((F.when(cue(t, term), F.lit(w)).otherwise(F.lit(0.0)) for term, w in weighted), F.lit(0.0))


def ranked(scores: dict[str, Column]) -> Column:
    """Array of struct(neg, label) of the labels with a positive score, best first, ties by label."""
    return F.array_sort(F.filter(F.array(*[F.struct((-F.round(s, 6)).alias("neg"), F.lit(k).alias("label")) for k, s in sorted(scores.items())]), lambda x: x["neg"] < 0))


def first_match(t: Column, ladder: Iterable[tuple], default: Column) -> Column:
    """The value of the first (name, pattern, value) whose pattern the text has."""
    return F.coalesce(*[F.when(t.rlike(p), F.lit(v)) for _, p, v in ladder], default)


def polarity(text: Column) -> Column:
    """struct(positive, negative, words, phrases): hits of either polarity, summed word weights with negation, phrase weights."""
    weights = F.create_map(*[F.lit(x) for kv in {**hotel.POSITIVE, **{w: -x for w, x in hotel.NEGATIVE.items()}}.items() for x in kv])
    f = F.coalesce(tx.folded(text), F.lit(""))

    def one(tokens: Column) -> Column:
        at = lambda i: F.coalesce(F.get(tokens, i), F.lit(""))

        def value(w: Column, i: Column) -> Column:
            before, before2, after = at(i - 1), at(i - 2), at(i + 1)
            turned = before.isin(*hotel.NEGATES_NEXT) | before2.isin(*hotel.NEGATES_NEXT) | after.isin(*hotel.NEGATES_BEFORE)
            x = F.coalesce(F.element_at(weights, w), F.lit(0.0))
            return x * F.when(turned, NEGATED).otherwise(1.0) * F.when(before.isin(*hotel.STRENGTHENS), STRENGTHENED).otherwise(1.0)

        return F.transform(tokens, value)

    hits = F.get(F.transform(F.array(tx.words_of(f)), one), F.lit(0))  # bound to a variable, so that the words are split once
    phrases = sum((F.when(F.contains(f, F.lit(p)), F.lit(w)).otherwise(F.lit(0.0)) for p, w in hotel.PHRASES.items()), F.lit(0.0))
    add = lambda a, x: a + x
    return F.struct(
        F.size(F.filter(hits, lambda x: x > 0)).alias("positive"), F.size(F.filter(hits, lambda x: x < 0)).alias("negative"),
        F.round(F.aggregate(hits, F.lit(0.0), add), 6).alias("words"), F.round(phrases, 6).alias("phrases"),
    )


def manner(t: Column, name: str) -> Column:
    """Whether a cue text shows all signs of a manner of writing."""
    return reduce(lambda a, b: a & b, [F.trim(t).rlike(p) if name == "short" else t.rlike(p) for p in hotel.MANNERS[name]])


def text_score(p: Column, t: Column) -> Column:
    """Score of a text in [-1, 1]: words and phrases, a hyperbole counts double."""
    s = (p["words"] + p["phrases"]) / 4 * F.when(manner(t, "hyperbole"), 2.0).otherwise(1.0)
    return F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), s)), 6)
