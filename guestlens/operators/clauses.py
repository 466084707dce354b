"""Clauses of a review: masks, recursive splitting by rank of separator, coordination and topic guards, merging of fragments.

Work is on offsets into the text as it is, so nothing that is masked must be put back. Separators are tried by rank:
line breaks and sentence ends, contrast connectors, paired conjunctions (hem ... hem, ne ... ne, either ... or), commas and
semicolons, "and" words, and last a change of topic between predicates. A cut is kept where both sides stand on their own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from guestlens.functions.text import PLAIN_FROM, PLAIN_TO
from guestlens.rulesets import hotel

MAX_DEPTH = 8  # levels of separators inside each other
MIN_CHARS = 12  # characters of a clause without a predicate; shorter ones join a neighbour
FOLD = str.maketrans("İI" + PLAIN_FROM, "ii" + PLAIN_TO)

#: Where a mark ends nothing: decimals, times, dates, thousands, ordinals, abbreviations, and marks inside quotations or brackets.
MASKS = re.compile(
    r"\d+(?:[.,:/]\d+)+(?:\s?[-–]\s?\d+(?:[.,:/]\d+)*)?|(?<![\w.])\d{1,3}\.(?= ?[a-zçğıöşüа-я])|(?<!\w)(?:dk|sn|vb|vs|bkz|no|tel|cad|sok|mah|dr|prof|mr|mrs|ms|st|approx|ca|bzw|z\. ?b|nr|str|ул|д|г|т\. ?е)\.(?=\s?\S)"
    r"|\"[^\"\n]*\"|“[^”\n]*”|„[^“\n]*“|«[^»\n]*»|‘[^’\n]*’|\([^()\n]*\)",
    re.I,
)
SENTENCE = re.compile(r"\n+|[.!?…。！？]+(?=\s|$)|(?<=[a-zçğıöşü])\.(?=[A-ZÇĞİÖŞÜ])|;|\s\|\s|[\U0001F300-\U0001FAFF]+")
CONTRAST = re.compile(
    r"(?:,\s*|\s)(?:ama|fakat|ancak|lakin|oysa|halbuki|yine de|buna rağmen|öte yandan|bununla birlikte|üstelik|ayrıca|bir de|onun dışında|but|however|although|even though|on the other hand|besides|moreover|aber|jedoch|obwohl|allerdings|außerdem|но|однако|хотя|зато|mais|pourtant|pero|aunque)(?=[\s,])"
    r"|(?<=[nsy][ıiuüea])\s+rağmen(?=\s)|(?<=[nsy][ae])\s+rağmen(?=\s)",
    re.I,
)
PAIRED = re.compile(r"(?<!\w)(hem|ne|either|neither|sowohl|weder|и то|ni)\s+(.+?)[,\s]+(?:\1|or|nor|als auch|noch)\s+(?:de\s+|da\s+)?(?=\S)", re.I | re.S)
COMMA = re.compile(r"[,;:]\s+|\s[–—-]\s")
AND = re.compile(r"\s(?:ve|and|und|и|et|y)\s", re.I)
LEADING = re.compile(r"^(?:[\s,;:.!?–—-]+|(?:ama|fakat|ancak|lakin|oysa|yine de|ayrıca|üstelik|rağmen|ve|and|but|however|although|even though|und|aber|и|но|хотя|et|mais|y|pero)(?=[\s,]))+", re.I)
VERB = re.compile(
    r"(?:[dt][ıiuü](?:k|m|lar|ler)?|yor(?:du|lar)?|m[ıiuü]ş(?:t[ıiuü])?|[ae]cak|m[ae]l[ıi]|ydı|ydi|ydu|ydü)$"
    r"|^(?:was|were|is|are|had|has|have|did|would|could|kept|got|took|smelled|needed|forgot|dropped|served|gave|paid|lost|came|went|found|war|waren|ist|sind|hatte|hatten|wurde|wurden|war|gab|brauchte|fand|был|была|было|были|есть|стоил[аи]?)$"
    r"|(?:ed|te|ten)$|(?:ла|ло|ли|л|лся|лась)$",
    re.I,
)
META = re.compile(r"^(?:tel|tc no|not|note|p\.?s|edit|güncelleme|update|review|yorum|puan|rating|devamı|read more)\b[\s:.]*", re.I)


def fold(text: str) -> str:
    return text.translate(FOLD).lower()


def topic(text: str) -> str | None:
    """The department of the aspect whose term stands first, of several there the longest."""
    m = TOPIC.search(" " + fold(text) + " ")
    return TOPIC_OF[m[0]] if m else None


TOPIC_OF = {t: d for _, d, kind, t in hotel.terms() if kind == "keyword"}
TOPIC = re.compile("|".join(sorted(map(re.escape, TOPIC_OF), key=len, reverse=True)))


def has_predicate(text: str) -> bool:
    return any(VERB.search(w) for w in re.findall(r"[^\W\d_]{3,}", text))


def masked(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in MASKS.finditer(text)]


def free(spans: list[tuple[int, int]], a: int, b: int) -> bool:
    """Whether no mask touches [a, b)."""
    return not any(x < b and a < y for x, y in spans)


def stands_alone(text: str) -> bool:
    return len(text.split()) >= 2 and has_predicate(text)


def fragment(text: str) -> bool:
    """A single word, or a short piece without a predicate."""
    return len(text.split()) < 2 or len(text) < MIN_CHARS and not has_predicate(text)


def coordinated(left: str, right: str) -> bool:
    """Whether an "and" joins words of one clause: lists and pairs of nouns or adjectives, not two predicates or topics."""
    if has_predicate(left) and has_predicate(right):
        return False
    a, b = topic(left), topic(right)
    if a and b and a != b and has_predicate(right) and len(left.split()) >= 3:
        return False
    return True


def topic_cut(text: str, spans: list[tuple[int, int]]) -> int | None:
    """Where a text without marks passes from one predicate to another topic: the place after the first predicate, if any."""
    words = list(re.finditer(r"\S+", text))
    if len(words) < 6:
        return None
    for i in range(1, len(words) - 2):
        if VERB.search(words[i][0].strip(".,")) and free(spans, words[i].end(), words[i].end() + 1):
            left, right = text[: words[i].end()], text[words[i].end() :]
            a, b = topic(left), topic(right)
            if a and b and a != b and stands_alone(left) and stands_alone(right):
                return words[i].end()
    return None


def _cut(text: str, places: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The parts between separators."""
    out, at = [], 0
    for a, b in places:
        out.append((at, a))
        at = b
    return [p for p in [*out, (at, len(text))] if text[p[0] : p[1]].strip()]


def split(text: str, depth: int = 0) -> list[tuple[int, int]]:
    """Offsets of the clauses, before merging."""
    whole = [(0, len(text))] if text.strip() else []
    if depth > MAX_DEPTH or not whole:
        return whole
    spans = masked(text)

    def deeper(parts: list[tuple[int, int]]) -> list[tuple[int, int]]:
        return [(a + x, a + y) for a, b in parts for x, y in split(text[a:b], depth + 1)]

    for pattern in (SENTENCE, CONTRAST):
        parts = _cut(text, [m.span() for m in pattern.finditer(text) if free(spans, *m.span())])
        if len(parts) > 1 and (pattern is SENTENCE or all(len(text[a:b].split()) >= 2 for a, b in parts)):
            return deeper(parts)
    if (m := PAIRED.search(text)) and free(spans, *m.span()):
        second = m.end()
        if m[2].split() and len(text[second:].split()) >= 1 and has_predicate(text[second:]):
            head = [(0, m.start())] if text[: m.start()].strip(" ,") else []
            return deeper([*head, (m.start(), m.end(2)), (second, len(text))])
    commas = _cut(text, [m.span() for m in COMMA.finditer(text) if free(spans, *m.span())])
    if len(commas) > 1:
        pieces = [text[a:b] for a, b in commas]
        topics = [topic(p) for p in pieces]
        if all(map(stands_alone, pieces)) or len({t for t in topics if t}) > 1 and sum(map(has_predicate, pieces)) >= max(2, len(pieces) - 1):
            return deeper(commas)
        # a part that doesn't stand alone stays with the one before it
        kept = [commas[0]]
        for (a, b), p in zip(commas[1:], pieces[1:]):
            if stands_alone(p) and stands_alone(text[slice(*kept[-1])]):
                kept.append((a, b))
            else:
                kept[-1] = (kept[-1][0], b)
        if len(kept) > 1:
            return deeper(kept)
    for m in AND.finditer(text):
        if free(spans, *m.span()) and not coordinated(text[: m.start()], text[m.end() :]) and min(len(text[: m.start()].split()), len(text[m.end() :].split())) >= 2:
            return deeper([(0, m.start()), (m.end(), len(text))])
    if (k := topic_cut(text, spans)) is not None:
        return deeper([(0, k), (k, len(text))])
    return whole


def finalize(text: str, parts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Connectors and blanks are taken off the ends; a fragment joins the clause before it (the first one: the one after)."""
    out: list[tuple[int, int]] = []
    for a, b in parts:
        if m := LEADING.match(text[a:b]):
            a += m.end()
        piece = text[a:b]
        a, b = a + len(piece) - len(piece.lstrip()), b - (len(piece) - len(piece.rstrip(" \t\r\n,;:")))
        if a >= b:
            continue
        if out and (fragment(text[a:b]) or fragment(text[slice(*out[-1])])) and "\n" not in text[out[-1][1] : a]:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def skipped(piece: str) -> bool:
    """Remarks about the review and pieces too short to say anything."""
    return len(piece.strip()) < 4 or not any(c.isalpha() for c in piece) or bool(META.match(piece.strip())) and len(piece.split()) <= 6


def clauses(text: str | None, finer: bool = True) -> list[tuple[int, int]]:
    """Offsets of the clauses of a text. With `finer` each clause is split once more on its own, and the finer result counts.

    NULL, '' and blank texts have none; a text without any separator is one clause.
    """
    if not text or not text.strip():
        return []
    parts = finalize(text, split(text))
    if finer:
        again = [(a + x, a + y) for a, b in parts for x, y in finalize(text[a:b], split(text[a:b]))]
        parts = again if len(again) > len(parts) else parts
    return [(a, b) for a, b in parts if not skipped(text[a:b])]


def with_clauses(df: DataFrame, text: str, splitter=clauses) -> DataFrame:
    """One row per clause: df's columns but the text, and clause_no, start_pos (from 1), clause. Rows without clauses have none."""
    others = [f for f in df.schema.fields if f.name != text]
    clash = {"clause_no", "start_pos", "clause"} & {f.name for f in others}
    if clash:
        raise ValueError(f"columns {sorted(clash)} exist already")
    schema = T.StructType([*others, T.StructField("clause_no", T.IntegerType()), T.StructField("start_pos", T.LongType()), T.StructField("clause", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows, cells = [], []
            for i, t in enumerate(pdf[text]):
                for k, (a, b) in enumerate(splitter(t)):
                    rows.append(i)
                    cells.append((k + 1, a + 1, t[a:b]))
            out = pdf.iloc[rows][[f.name for f in others]].reset_index(drop=True)
            for j, name in enumerate(("clause_no", "start_pos", "clause")):
                out[name] = [c[j] for c in cells]
            yield out

    return df.select(*[F.col(f.name) for f in others], text).where(F.length(text) > 0).mapInPandas(run, schema)
