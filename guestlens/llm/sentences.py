"""Sentence boundaries across languages and scripts by a pushdown automaton.

The automaton reads terminators, line breaks, quotation marks and brackets. Quotations and brackets go on a stack, inside
which nothing ends; a line opens with an optional list label; a full stop is weighed by the abbreviation trie, ordinals,
decimals, addresses and what follows. It emits the offset of each sentence's first character that is not white space.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Abbreviations that go on in the same sentence whatever follows.
INNER = """mr mrs ms dr prof st no approx incl dept mt fig bkz doç av apt örn sn hr fr nr ca bzw inkl vgl evtl ggf zzgl mme mlle env cf dra sr sra aprox imp núm dott sig
hab habit bijv mevr dhr ул прим см вул див p.ej c.-à-d i.e e.g z.b d.h u.a p.ex т.е küç gen col lt rev hon""".split()
# Abbreviations that may also end a sentence, which a capital after them tells.
ENDING = "vb vs cad sok mah etc p.m a.m usw ecc enz мин руб др т.д т.п хв tel jr inc ltd yy str ej d cm km kg".split()
NEEDS_NUMBER = {"no", "nr", "núm"}
ORDINAL_CUES = set("im am der die das dem den vom zum beim ab bis seit".split())
OPENERS = {"“": "”", "„": "“”", "«": "»", "「": "」", "『": "』", "(": ")", "[": "]", '"': '"', "（": "）", "【": "】"}
EVENT = re.compile(r"\n|[.!?…。！？।؟]+|[“„«「『(\[\"（【”»」』)\]）】]")
MARK = re.compile("[\n" + re.escape("".join(OPENERS) + "".join(OPENERS.values())) + "]")
CLOSERS = "”“»」』\")]）】’"
THAI = re.compile(r"[ก-๛]")


class Trie:
    """Abbreviations spelled backwards from their full stop."""

    def __init__(self, words: dict[str, str]) -> None:
        self.root: dict = {}
        for w, kind in words.items():
            node = self.root
            for c in reversed(w):
                node = node.setdefault(c, {})
            node["$"] = (w, kind)

    def match(self, text: str, end: int) -> tuple[str, str] | None:
        """The longest abbreviation that ends right before `end` and begins a token."""
        node, i, found = self.root, end - 1, None
        while i >= 0 and (c := text[i].lower()) in node:
            node = node[c]
            i -= 1
            if "$" in node and (i < 0 or not text[i].isalnum()):
                found = node["$"]
        return found


ABBREVIATIONS = Trie({w: "inner" for w in INNER} | {w: "ending" for w in ENDING})


def begins(c: str) -> bool:
    """Whether a sentence can begin with c as far as case tells: capitals, caseless letters, digits, opening marks."""
    return c.isdigit() or c.isalpha() and not c.islower() or c in "“„«「『(\"[¿¡—–-*•#"


def stop_ends(text: str, a: int, b: int, line: int) -> bool:
    """Whether the full stops text[a:b] end a sentence; line is the start of the line."""
    n = len(text)
    nxt = text[b] if b < n else "\n"
    prev = text[a - 1] if a > line else " "
    after = b
    while after < n and text[after] in " \t ":
        after += 1
    follow = text[after] if after < n else "\n"
    if follow == "\n":
        return True
    if b - a > 1 or text[a] == "…":
        return begins(follow) and nxt.isspace() or nxt.isupper()
    if nxt.isdigit() and prev.isdigit():
        return False
    start = a
    while start > line and not text[start - 1].isspace():
        start -= 1
    start = max([start, *(m.end() + start for m in re.finditer(r"[!?。！？…]+|(?<=[^\W\d_]{3})\.(?=[A-ZÀ-ÞА-Я])", text[start:a]))])
    token = text[start:a]
    if not nxt.isspace():
        # no blank: a capital after a small letter or number, outside addresses and dotted abbreviations
        if not nxt.isalpha() or "@" in token or "www" in token.lower() or "/" in token or "." in token and not prev.isdigit():
            return nxt in "¿¡“„«「" and len(token) > 2
        if nxt.isupper():
            return (prev.islower() or prev.isdigit() or prev in CLOSERS) and not ABBREVIATIONS.match(text, a) and len(token) > 1
        tail = re.match(r"\w+", text[b:])[0]
        return nxt.isalpha() and prev.isalpha() and len(token) > 3 and not ABBREVIATIONS.match(text, a) and not re.match(r"(?:example|test|com|net|org|php|html|de|tr|eu)\b", tail) and (text[b + len(tail) : b + len(tail) + 1] in (" ", ","))
    capital = begins(follow)
    if prev.isdecimal():
        digits = re.search(r"\d+$", token)[0]
        if start == line and token == digits:
            return False  # a list label
        word = text[line:start].split()[-1].lower() if text[line:start].split() else ""
        if token == digits and int(digits[:6]) <= 31 and word in ORDINAL_CUES:
            return False
        if not capital:
            return not (token == digits and int(digits[:6]) <= 31)
        return True
    abbreviation = ABBREVIATIONS.match(text, a)
    if abbreviation:
        word, kind = abbreviation
        if word in NEEDS_NUMBER and not follow.isdigit():
            abbreviation = None
        elif kind == "inner" or not capital:
            return False
        else:
            return True
    if len(token.strip("“„«\"(['’")) == 1 and token[-1:].isalpha() and not ("぀" <= prev <= "鿿"):
        return False  # an initial
    if token.lower().endswith("str") and len(token) > 4:
        return capital
    return True


def closed_openers(text: str) -> set[int]:
    """Places of the quotation marks and brackets that have a closer of their own on their line, in one linear pass."""
    out: set[int] = set()
    stack: list[tuple[int, str]] = []
    waiting: dict[str, int] = {}  # open marks that a closer would close
    for m in MARK.finditer(text):
        c = m[0]
        if c == "\n":
            stack.clear()
            waiting.clear()
        elif waiting.get(c):
            while True:  # marks opened since, which nothing closed, are dropped
                at, closers = stack.pop()
                for x in closers:
                    waiting[x] -= 1
                if c in closers:
                    break
            out.add(at)
        elif c in OPENERS:
            stack.append((m.start(), OPENERS[c]))
            for x in OPENERS[c]:
                waiting[x] = waiting.get(x, 0) + 1
    return out


def boundaries(text: str) -> list[int]:
    """0-based offsets of the sentences' first characters. White space alone has none."""
    cuts, stack, line, n = [0], [], 0, len(text)
    closed = closed_openers(text)
    pos = 0
    while m := EVENT.search(text, pos):
        a, b = m.span()
        pos = b
        mark = text[a]
        if mark == "\n":
            stack.clear()
            line = b
            cuts.append(b)
            continue
        if stack and mark in stack[-1][0]:
            _, last = stack.pop()
            # a closed quotation that itself ended, before something that begins like a sentence
            if last and not stack and b < n and text[b].isspace() and text[b] != "\n" and mark not in ")]）】":
                rest = text[b:].lstrip(" \t ")[:1]
                if rest and begins(rest) and rest.isupper():
                    cuts.append(b)
            continue
        if mark in OPENERS:
            if a in closed:
                stack.append((OPENERS[mark], False))
            continue
        if mark in ".!?…。！？।؟":
            if stack:
                stack[-1] = (stack[-1][0], True)
                continue
            while b < n and text[b] in CLOSERS:
                b += 1
            full = mark == "." or mark == "…" and b - a == 1
            ends = stop_ends(text, a, b, line) if full and not any(c in "!?。！？।؟" for c in text[a:b]) else not (mark in "!?" and b < n and text[b] in ",;:")
            pos = b
            if ends:
                cuts.append(b)
    # blanks between Thai phrases
    if THAI.search(text):
        for m in re.finditer(r"(?<=[ก-๛\d])[ \t]+(?=[ก-๛A-ZÀ-Þ])|(?<=[^\s\d][.!?”])[ \t]+(?=[ก-๛])|(?<=[A-Za-zışğ])[ \t]+(?=[ก-๛])", text):
            if THAI.match(text[m.start() - 1]) or THAI.match(text[m.end()]):
                cuts.append(m.end())
    out = []
    cuts = sorted(set(cuts))
    for i, c in enumerate(cuts):
        end = cuts[i + 1] if i + 1 < len(cuts) else n
        piece = text[c:end]
        if piece.strip(" \t\r\n ​﻿") and any(ch.isalnum() or ord(ch) > 0x2000 for ch in piece):
            out.append(c + len(piece) - len(piece.lstrip()))
    return out


def sentence_starts(text: str) -> list[int]:
    """Offsets in the text as stored; text damaged by a wrong decoding is read as repaired and its words matched."""
    from guestlens.llm import mojibake

    if not mojibake.worth_a_look([text])[0]:
        return boundaries(text)
    read = mojibake.repair(text)[0]
    if read == text:
        return boundaries(text)
    words = [m.span() for m in re.finditer(r"\S+", text)]
    read_words = [m.span() for m in re.finditer(r"\S+", read)]
    if len(words) != len(read_words):
        return boundaries(text)
    out = []
    for p in boundaries(read):
        k = next(i for i, (a, b) in enumerate(read_words) if a <= p < b)
        inside, (a, b) = p - read_words[k][0], words[k]
        if inside:  # begins within a word: after the same number of terminators
            marks = sum(c in ".!?" for c in read[read_words[k][0] : p])
            seen, q = 0, a
            while q < b and seen < marks:
                seen += text[q] in ".!?"
                q += 1
            out.append(q)
        else:
            out.append(a)
    return out


def split_sentences(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row per sentence: key, sentence_no, start_pos (from 1), sentence. NULL, '' and blank texts have none."""
    schema = T.StructType([df.schema[key], T.StructField("sentence_no", T.IntegerType()), T.StructField("start_pos", T.LongType()), T.StructField("sentence", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, t in zip(pdf[key], pdf[text]):
                starts = sentence_starts(t)
                rows += [(k, i + 1, p + 1, t[p : starts[i + 1] if i + 1 < len(starts) else len(t)].strip()) for i, p in enumerate(starts)]
            yield pd.DataFrame(rows, columns=[key, "sentence_no", "start_pos", "sentence"])

    return df.select(key, text).where(F.length(text) > 0).mapInPandas(run, schema)
