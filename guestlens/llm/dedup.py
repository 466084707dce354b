"""New batches against all accepted history: a persistent store of winnowed fingerprints behind partitioned Bloom filters.

A comment is brought to a canonical form (markup, accents, case, punctuation, damage undone). Equal forms are one class at
once. Of the others, pairs of neighbouring words are winnowed: those stay that are rarer than all within RADIUS pairs around
them, by counts over the whole first batch that the store keeps; short comments have all their pairs too. The RAREST of
them, taken two together, or three where two are too common, are the fingerprints: what two long texts share by chance is hardly
ever such a combination, so few rows meet that aren't repeats. Fingerprints travel as packed arrays by filter partition.
Those that pass the Bloom filter of their partition are looked up in the fingerprint store, and those that an earlier row of the batch
has lead to that row. Sketches of the words bound what a pair can share; of the pairs left, one counts as a repeat when the
words shared in order cover enough of both. Only first rows enter the fingerprint store, so copies never pile up there. Rows
with a crowd before them at a fingerprint are first compared with its first row; of what repeats one only the rows before that one
are still looked for, so the result doesn't depend on what counts as crowded. Every fingerprint that remains is expanded whole.
"""

from __future__ import annotations

import html
import itertools
import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from guestlens.llm import mojibake
from guestlens.session import scratch_path

RADIUS = 2  # pairs of neighbouring words to either side that a winnowed pair is rarer than
FINE = 48  # words of a comment below which all its pairs of neighbouring words are taken too
RAREST, CHANCE = 9, 0.3  # winnowed pairs a text's fingerprints are made of; rows that two may be in by chance, else they are three
LOST_ALONE = RAREST  # of a text with lost letters, the winnowed pairs that lead to another text alone
MIN_WORDS = 5
KEEP_FIRST, KEEP_REPEAT = 0.74, 0.6  # words in order shared, of the first row's and of the repeat's
CROWD = 1_000  # earlier rows at one fingerprint beyond which its first row is compared first; a matter of time only
SKETCH = 6  # words of 64 bits in a sketch
BITS_PER_KEY, HASHES = 10, 4
KEYS_PER_FILTER = 500_000
COUNT_BITS, SLICES = 22, 64  # counts of pairs are kept in 2 ** COUNT_BITS hash bins, added up in slices
ONCE, NEVER = 120, 121  # classes of pairs that the counts know once, or not at all
PACKED = 20_000  # texts whose fingerprints are packed at once
KEY_BITS = 39  # of a fingerprint within its partition; one more bit tells those that count alone

TAG = re.compile(r"<[^<>\n]{0,200}>")
# Letters that stand for two.
FOLD = (("İ", "i"), ("ß", "ss"), ("æ", "ae"), ("Æ", "ae"), ("œ", "oe"), ("Œ", "oe"))
# Letters that decomposition doesn't fold, and invisible characters.
ALSO = {"ı": "i", "ə": "e", "ø": "o"}
INVISIBLE = (0xAD, 0x200B, 0x200C, 0x200D, 0xFEFF)
SEPARATOR, DROPPED, END = 0, 1, 2
LOST = 0xFFFD
NONE = np.uint64(2**64 - 1)
TWO, THREE = (np.array(list(itertools.combinations(range(RAREST), k))) for k in (2, 3))


@lru_cache(maxsize=1)
def letters() -> tuple[np.ndarray, np.ndarray]:
    """Per code point its folded letter (or SEPARATOR, DROPPED, END), and whether it is a word of its own."""
    n = 0x20000
    folded, alone = np.zeros(n, np.uint32), np.zeros(n, bool)
    for c in range(n):
        if 0xD800 <= c < 0xE000:
            continue
        f = unicodedata.normalize("NFKD", chr(c).lower())[0]
        if c in INVISIBLE or unicodedata.combining(f):
            folded[c] = DROPPED
        elif c == LOST or f.isalnum():
            folded[c] = ord(ALSO.get(f, f))
        alone[c] = 0x3040 <= c < 0x3100 or 0x3400 <= c < 0xA000 or 0x0E00 <= c < 0x0E80
    folded[ord("\n")] = END
    return folded, alone


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(30))


BASE = np.uint64(0x100000001B3)


def word_hashes(letter: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    if not len(first):
        return np.zeros(0, np.uint64)
    offset = np.arange(len(letter)) - np.repeat(first, sizes)
    with np.errstate(over="ignore"):
        up = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(int(sizes.max()), BASE)]))
        return mixed(np.add.reduceat(mixed((letter + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)) * up[offset], first))


class Words:
    """The words of many texts at once: per word its text, hash, and whether letters are lost."""

    def __init__(self, texts: list[str]) -> None:
        folded, alone = letters()
        plain = [TAG.sub(" ", html.unescape(t) if "&" in t else t) if "<" in t or "&" in t else t for t in texts]
        joined = "".join([t.replace("\n", " ") + "\n" for t in plain])
        for x, y in FOLD:
            joined = joined.replace(x, y)
        cps = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        cps = np.where(cps < len(folded), cps, 0)
        code = folded[cps]
        kept = np.flatnonzero(code != DROPPED)
        code, alone = code[kept], alone[cps[kept]]
        self.n = len(texts)
        ends = code == END
        in_word = code > END
        before = np.concatenate([[False], in_word[:-1]])
        starts_word = in_word & (~before | alone | np.concatenate([[False], alone[:-1]]))
        at = np.flatnonzero(in_word)
        first = np.flatnonzero(starts_word[at])
        sizes = np.diff(np.append(first, len(at)))
        letter = code[at].astype(np.uint64)
        self.hash = word_hashes(letter, first, sizes)
        self.text = (np.cumsum(ends) - ends)[at][first]
        self.lost = np.logical_or.reduceat(letter == LOST, first) if len(first) else np.zeros(0, bool)
        self.counts = np.bincount(self.text, minlength=self.n)
        self.code, self.shown, self.begins = code, in_word | ends, at[first]

    @property
    def forms(self) -> list[str]:
        """Each text's words, a blank between."""
        gap = np.zeros(len(self.code), bool)
        gap[self.begins] = True
        if len(self.text):
            gap[self.begins[np.concatenate([[True], self.text[1:] != self.text[:-1]])]] = False
        lead = gap[self.shown]
        out = np.full(int(self.shown.sum() + lead.sum()), 32, np.uint32)
        out[np.arange(len(lead)) + np.cumsum(lead)] = self.code[self.shown]
        out[out == END] = 10
        return out.tobytes().decode("utf-32-le", "surrogatepass").split("\n")[:-1]

    def sketches(self) -> np.ndarray:
        """Per text the number of its words with lost letters, and of its others a bit for each word's each occurrence, in SKETCH integers."""
        out = np.zeros((self.n, SKETCH), np.uint64)
        text, word = self.text[~self.lost], self.hash[~self.lost]
        if len(text):
            order = np.lexsort((word, text))
            text, word = text[order], word[order]
            new = np.concatenate([[True], (text[1:] != text[:-1]) | (word[1:] != word[:-1])])
            first = np.flatnonzero(new)
            occurrence = np.arange(len(text)) - first[np.cumsum(new) - 1]
            with np.errstate(over="ignore"):
                bit = (mixed(word + occurrence.astype(np.uint64) * BASE) >> np.uint64(20)) % np.uint64(64 * SKETCH)
            place = text * SKETCH + (bit >> np.uint64(6)).astype(np.int64)
            order = np.argsort(place, kind="stable")
            place, one = place[order], (np.uint64(1) << (bit & np.uint64(63)))[order]
            starts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
            out.ravel()[place[starts]] = np.bitwise_or.reduceat(one, starts)
        return np.concatenate([np.bincount(self.text[self.lost], minlength=self.n)[:, None], out.view(np.int64)], axis=1)


def neighbours(forms: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text, key): the pairs of neighbouring words of canonical forms; a text of one word has that word."""
    code = np.frombuffer("".join([f + "\n" for f in forms]).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends, in_word = code == 10, (code != 10) & (code != 32)
    at = np.flatnonzero(in_word)
    first = np.flatnonzero((in_word & ~np.concatenate([[False], in_word[:-1]]))[at])
    word = word_hashes(code[at].astype(np.uint64), first, np.diff(np.append(first, len(at))))
    text = (np.cumsum(ends) - ends)[at][first]
    follows = text[1:] == text[:-1]
    paired = np.append(follows, False)
    with np.errstate(over="ignore"):
        key = mixed((word * BASE + np.where(paired, np.append(word[1:], np.uint64(0)), np.uint64(7))) * np.uint64(0xBF58476D1CE4E5B9))
    own = paired | ~np.append(False, follows)
    return text[own], key[own]


def rarest(text: np.ndarray, key: np.ndarray, n: int, classes: np.ndarray, radius: int) -> np.ndarray:
    """(n, RAREST): each text's rarest keys among those rarer than all within the radius, as class and hash; NONE where there are no more."""
    rank = (classes[key >> np.uint64(64 - COUNT_BITS)].astype(np.uint64) << np.uint64(56)) | (key >> np.uint64(8))
    if radius and len(text):
        line = np.full(len(text) + 2 * radius * (n + 1), NONE)
        places = np.arange(len(text)) + 2 * radius * text + radius
        line[places] = rank
        least, width, window = line, 1, 2 * radius + 1
        while width < window:
            step = min(width, window - width)
            least = np.minimum(least, np.concatenate([least[step:], np.full(step, NONE)]))
            width += step
        kept = least[places - radius] == rank
        text, rank = text[kept], rank[kept]
    order = np.lexsort((rank, text))
    text, rank = text[order], rank[order]
    if len(text):
        new = np.concatenate([[True], (text[1:] != text[:-1]) | (rank[1:] != rank[:-1])])
        text, rank = text[new], rank[new]
    counts = np.bincount(text, minlength=n)
    at = np.arange(len(text)) - (np.cumsum(counts) - counts)[text]
    out = np.full((n, RAREST), NONE)
    out[text[at < RAREST], at[at < RAREST]] = rank[at < RAREST]
    return out


def combined(ranks: np.ndarray, lost: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, fingerprint, alone) of texts with these rarest keys, by the rows that the counts are of; alone: a single key, for texts with lost letters."""
    known = ranks != NONE
    n = known.sum(1)
    classes = (ranks >> np.uint64(56)).astype(float)
    often = np.where(classes >= ONCE, 0, classes / 4)  # log2 of the counts
    with np.errstate(over="ignore"):
        one = mixed(ranks * np.uint64(0x9E3779B97F4A7C15))
        few = often[:, TWO[:, 0]] + often[:, TWO[:, 1]] <= np.log2(max(rows, 1) * CHANCE)
        two = mixed((one[:, TWO[:, 0]] + one[:, TWO[:, 1]]) * np.uint64(0xBF58476D1CE4E5B9))
        three = mixed((one[:, THREE[:, 0]] + one[:, THREE[:, 1]] + one[:, THREE[:, 2]]) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(1))
    few_of = np.zeros((len(ranks), RAREST, RAREST), bool)
    few_of[:, TWO[:, 0], TWO[:, 1]] = few
    has_two = known[:, TWO[:, 1]] & (few | (n < 3)[:, None])
    has_three = known[:, THREE[:, 2]] & ~(few_of[:, THREE[:, 0], THREE[:, 1]] | few_of[:, THREE[:, 0], THREE[:, 2]] | few_of[:, THREE[:, 1], THREE[:, 2]])
    alone = known & ((np.arange(RAREST) < LOST_ALONE) | (lost == 0)[:, None])
    has_one = (n == 1)[:, None] & known
    text = np.concatenate([np.nonzero(x)[0] for x in (has_one, has_two, has_three, alone)])
    keys = np.concatenate([one[has_one], two[has_two], three[has_three], one[alone]])
    return text, keys, np.arange(len(keys)) >= len(keys) - alone.sum()


def packed(part: np.ndarray, key: np.ndarray, row: np.ndarray, lost: np.ndarray) -> pd.DataFrame:
    """(part, data): the partitions' keys of KEY_BITS + 1 bits and their rows, those of a row together, as bytes."""
    order = np.lexsort((key, row, part))
    part, key, row, lost = part[order], key[order], row[order], lost[order]
    starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, np.int64)
    out = []
    for i, j in zip(starts, [*starts[1:], len(part)]):
        first = np.flatnonzero(np.concatenate([[True], row[i + 1 : j] != row[i : j - 1]])) + i
        head = np.stack([np.diff(row[first], prepend=0), np.diff(np.append(first, j)), lost[first]]).tobytes()
        small = pa.compress(head, codec="zstd", asbytes=True)
        out.append(np.array([len(first), len(small)], np.int64).tobytes() + small + key[i:j].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes())
    return pd.DataFrame({"part": part[starts].astype(np.int32), "data": out})


def unpacked(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, row, lost) of what was packed."""
    keys, rows, losts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
    for b in blobs:
        n, size = np.frombuffer(b, np.int64, 2)
        row, counts, lost = np.frombuffer(pa.decompress(b[16 : 16 + size], 24 * int(n), codec="zstd", asbytes=True), np.int64).reshape(3, -1)
        wide = np.zeros((int(counts.sum()), 8), np.uint8)
        wide[:, :5] = np.frombuffer(b, np.uint8, offset=16 + int(size)).reshape(-1, 5)
        keys.append(wide.view(np.int64).ravel())
        rows.append(np.repeat(np.cumsum(row), counts))
        losts.append(np.repeat(lost > 0, counts))
    return np.concatenate(keys), np.concatenate(rows), np.concatenate(losts)


def by_part(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[int, pd.DataFrame]]:
    """The rows of one partition after the other, as they are sorted by it."""
    for part, group in itertools.groupby((pair for pdf in frames for pair in pdf.groupby("part", sort=False)), key=lambda x: x[0]):
        yield int(part), pd.concat([x for _, x in group], ignore_index=True)


def grouped(key: np.ndarray, row: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, ...]:
    """All by key and row, with each place's start and size of its key."""
    order = np.lexsort((row, key))
    key = key[order]
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, len(key)))
    return row[order], *(x[order] for x in more), np.repeat(starts, sizes), np.repeat(sizes, sizes)


def spans(at: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, other): each place `at` with all others of its span, a million pairs at once."""
    ends, i = np.cumsum(sizes), 0
    while i < len(at):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + 1_000_000)))
        n = sizes[i:j]
        yield np.repeat(at[i:j], n), np.repeat(starts[i:j] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        i = j


def meetings(key: np.ndarray, row: np.ndarray, lost: np.ndarray, asking: np.ndarray, limits: tuple[np.ndarray, np.ndarray] | None, among: bool) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(a, b, crowded): each asking row b with the rows a before it at its keys; beyond a crowd only the first, and such b as crowded
    once more; among: whether a may ask too. With limits (rows, the row to stop before) only the crowded ones: the rows below the limit."""
    alone = (key & 1) == 1
    r, ask, start, _ = grouped(key[~alone], row[~alone], asking[~alone])
    before = np.arange(len(r)) - start
    many = before > CROWD
    if limits is None:
        crowd = np.flatnonzero(ask & (before > 0) & many)
        a = start[crowd]
        ok = (r[a] < r[crowd]) & (among | ~ask[a])
        yield r[a[ok]], r[crowd[ok]], False
        yield r[crowd], r[crowd], True
        at = np.flatnonzero(ask & ~many)
    elif len(limits[0]):
        place = np.minimum(np.searchsorted(limits[0], r), len(limits[0]) - 1)
        at = np.flatnonzero(ask & many & (limits[0][place] == r))
    else:
        at = np.zeros(0, np.int64)
    for b, a in spans(at, start[at], before[at]):
        ok = (r[a] < (r[b] if limits is None else limits[1][place[b]])) & (among | ~ask[a])
        yield r[a[ok]], r[b[ok]], False
    if limits is None and lost[alone].any():  # single keys: only where one of the two has lost letters
        r, ask, gone, start, size = grouped(key[alone], row[alone], asking[alone], lost[alone])
        at = np.flatnonzero(gone)
        for x, y in spans(at, start[at], size[at]):
            a, b = np.minimum(x, y), np.maximum(x, y)
            ok = (r[a] < r[b]) & ask[b] & (among | ~ask[a])
            yield r[a[ok]], r[b[ok]], False


def pair_counts(texts: DataFrame) -> tuple[np.ndarray, int]:
    """Per hash bin a class of how often its pairs of neighbouring words stand in all the texts (quarter powers of two, ONCE, NEVER), and the texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros(1 << COUNT_BITS, np.int64), 0
        for pdf in batches:
            n += len(pdf)
            for i in range(0, len(pdf), PACKED):
                at, more = np.unique((neighbours(pdf["form"].iloc[i : i + PACKED].tolist())[1] >> np.uint64(64 - COUNT_BITS)).astype(np.int64), return_counts=True)
                total[at] += more
        if n:
            yield pd.DataFrame({"part": range(SLICES), "n": n, "counts": [zlib.compress(x.tobytes(), 1) for x in np.split(total, SLICES)]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(zlib.decompress(x), np.int64) for x in pdf["counts"])
        classes = np.where(total < 1, NEVER, np.where(total < 2, ONCE, np.floor(4 * np.log2(np.maximum(total, 1))))).astype(np.uint8)
        return pd.DataFrame({"part": pdf["part"].iloc[:1], "n": pdf["n"].sum(), "classes": [classes.tobytes()]})

    out, n = np.full((SLICES, (1 << COUNT_BITS) // SLICES), NEVER, np.uint8), 0
    counted = texts.select("form").mapInPandas(run, "part int, n bigint, counts binary")
    for r in counted.groupBy("part").applyInPandas(add, "part int, n bigint, classes binary").collect():  # SLICES rows, four megabytes in all
        out[r.part], n = np.frombuffer(r.classes, np.uint8), r.n
    return out.ravel(), n


def may_repeat() -> Column:
    """Whether b's words may cover row a's: a bound on is_repeat, as each bit of one sketch alone is a word not shared."""

    def alone(x: str, y: str) -> Column:
        return sum((F.bit_count(F.col(f"s{i}_{x}").bitwiseAND(F.bitwise_not(F.col(f"s{i}_{y}")))) for i in range(SKETCH)), F.lit(0))

    lengths = (F.col("n_words_a") * KEEP_FIRST <= F.col("n_words_b") + 1e-6) & (F.col("n_words_b") * KEEP_REPEAT <= F.col("n_words_a") + 1e-6)
    one = alone("a", "b") <= F.col("n_words_a") * (1 - KEEP_FIRST) + F.col("lost_b") + 1e-6
    return lengths & one & (alone("b", "a") <= F.col("n_words_b") * (1 - KEEP_REPEAT) + F.col("lost_a") + 1e-6)


def features(df: DataFrame, key: str, text: str) -> DataFrame:
    """row_id, form, n_words, sketch, form_hash; rows of fewer than MIN_WORDS words are left out."""
    names = ["lost", *(f"s{i}" for i in range(SKETCH))]
    schema = "row_id bigint, form string, n_words int, lost int, " + ", ".join(f"{x} bigint" for x in names[1:])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), 2000):
                part = pdf.iloc[i : i + 2000]
                words = Words(mojibake.repaired_texts(part["t"].tolist()))
                out = pd.DataFrame({"row_id": part["k"].to_numpy(), "form": words.forms, "n_words": words.counts})
                out[names] = words.sketches()
                yield out[words.counts >= MIN_WORDS]

    rows = df.select(F.col(key).cast("bigint").alias("k"), F.col(text).alias("t")).where("length(t) >= 9")
    return rows.mapInPandas(run, schema).withColumn("form_hash", F.xxhash64("form"))


def winnowed(forms: list[str], short: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, ranks): each text's rarest pairs of neighbouring words, of short texts with and without a radius."""
    text, key = neighbours(forms)
    dense = rarest(text[short[text]], key[short[text]], len(forms), classes, 0)
    return np.concatenate([np.arange(len(forms)), np.flatnonzero(short)]), np.concatenate([rarest(text, key, len(forms), classes, RADIUS), dense[short]])


def fingerprints(fresh: DataFrame, classes: np.ndarray, texts: int, filters: int) -> DataFrame:
    """(part, data): the rows' packed fingerprints, by classes of pairs and the texts that these are counted over."""

    def pack(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pd.DataFrame:
        row, lost, ranks = (np.concatenate(x) for x in zip(*held))
        text, key, alone = combined(ranks, lost, texts)
        part = ((key >> np.uint64(KEY_BITS + 1)) % np.uint64(filters)).astype(np.int64)
        key = ((key & np.uint64((1 << KEY_BITS) - 1)) << np.uint64(1) | alone.astype(np.uint64)).astype(np.int64)
        return packed(part, key, row[text], (lost[text] > 0).astype(np.int64))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for pdf in batches:
            for i in range(0, len(pdf), 2000):
                part = pdf.iloc[i : i + 2000]
                text, ranks = winnowed(part["form"].tolist(), part["n_words"].to_numpy() < FINE, classes)
                held.append((part["row_id"].to_numpy()[text], part["lost"].to_numpy()[text], ranks))
                if sum(len(x) for x, _, _ in held) >= PACKED:
                    yield pack(held)
                    held = []
        if held:
            yield pack(held)

    return fresh.select("row_id", "form", "n_words", "lost").mapInPandas(run, "part int, data binary")


SKETCHED = ("n_words", "lost", *(f"s{i}" for i in range(SKETCH)))


def common_words(a: str, b: str) -> int:
    """Length of the longest common subsequence of words (bit-parallel); a word with lost letters equals what fits it."""
    x, y = a.split(" "), b.split(" ")
    if "�" in a or "�" in b:
        x, y = fitted(x, y), fitted(y, x)
    masks: dict[str, int] = {}
    for i, w in enumerate(x):
        masks[w] = masks.get(w, 0) | 1 << i
    full = (1 << len(x)) - 1
    s = full
    for w in y:
        u = s & masks.get(w, 0)
        s = ((s + u) | (s - u)) & full
    return len(x) - s.bit_count()


def fitted(words: list[str], others: list[str]) -> list[str]:
    pool = set(others)
    out = []
    for w in words:
        if "�" in w:
            p = re.compile(re.escape(w).replace("�", ".{1,2}"))
            w = next((o for o in pool if p.fullmatch(o)), w)
        out.append(w)
    return out


def is_repeat(first: str, later: str, n_first: int, n_later: int) -> bool:
    if n_later < KEEP_FIRST * n_first or n_first < KEEP_REPEAT * n_later:
        return False
    if "�" not in first and "�" not in later:
        x, y = set(first.split(" ")), set(later.split(" "))
        both = len(x & y)
        # a word that the other text lacks isn't shared, so most pairs need no alignment
        most = min(n_first - len(x) + both, n_later - len(y) + both)
        if most < KEEP_FIRST * n_first or most < KEEP_REPEAT * n_later:
            return False
    n = common_words(first, later)
    return n >= KEEP_FIRST * n_first and n >= KEEP_REPEAT * n_later


class Store:
    """The accepted reviews: classes (form hash -> first row), rows with their forms and sketches, links from rows that repeat
    another form to their first row, and by filter partition the packed fingerprints of all forms and the Bloom filters;
    classes of pairs of words.

    All tables lie in one folder that every executor sees; Store(spark, path) opens what is there. Each accepted batch is
    one sub-folder and counts only once its mark is written, so a batch that failed half way is not seen; filters are
    replaced by a new version.
    """

    CLASSES, MARK, LINKS = "form_hash bigint, first_row bigint", "filters int, texts bigint, classes binary", "row_id bigint, first_row bigint"
    TEXTS = "row_id bigint, form string, n_words int, lost int, " + ", ".join(f"s{i} bigint" for i in range(SKETCH))
    POSTED = "a bigint, b bigint, crowded boolean, n bigint, data binary, kind string, part int"

    def __init__(self, spark: SparkSession, path: str, filters: int = 64) -> None:
        self.spark, self.path, self.filters, self.steps = spark, path, filters, 0
        self.classes: np.ndarray | None = None
        self.texts = 0
        fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
        while fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/mark/step={self.steps}/_SUCCESS")):
            self.steps += 1
        if self.steps:
            mark = spark.read.schema(self.MARK).parquet(f"{path}/mark/step=0").first()  # one row, four megabytes
            self.filters, self.texts, self.classes = mark.filters, mark.texts, np.frombuffer(mark.classes, np.uint8)

    def read(self, name: str, schema: str) -> DataFrame:
        paths = [f"{self.path}/{name}/step={i}" for i in range(self.steps)]
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{name}").parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def write(self, df: DataFrame, name: str, *by: str) -> None:
        df.write.mode("overwrite").option("compression", "zstd").partitionBy(*by).parquet(f"{self.path}/{name}/step={self.steps}")

    def posted(self, step: int, kind: str) -> DataFrame:
        return self.spark.read.schema(self.POSTED).parquet(f"{self.path}/posted/step={step}").where(F.col("kind") == kind)

    def accept(self, rows: DataFrame, key: str, text: str) -> DataFrame:
        """Checks a batch against everything accepted and itself, stores it, and returns (row_id_a, row_id_b)."""
        spark = self.spark
        scratch = scratch_path(spark, "batch")
        self.write(features(rows, key, text), "texts")
        f = spark.read.parquet(f"{self.path}/texts/step={self.steps}")
        if self.classes is None:
            self.classes, self.texts = pair_counts(f)
        members = f.select("row_id", "form_hash")
        # equal forms: one representative, the first row (partial aggregation, so a crowd of copies stays small)
        f.groupBy("form_hash").agg(F.min("row_id").alias("rep")).join(self.read("classes", self.CLASSES), "form_hash", "left").write.parquet(f"{scratch}/reps")
        reps = spark.read.parquet(f"{scratch}/reps")
        copies = members.join(reps, "form_hash").where("first_row IS NOT NULL OR rep < row_id").select("row_id")
        copies.write.parquet(f"{scratch}/copies")
        fresh = f.join(spark.read.parquet(f"{scratch}/copies"), "row_id", "left_anti")
        near = self.near(fresh, f, scratch)
        found = reps.where("first_row IS NULL").select("form_hash", F.col("rep").alias("b")).join(near, "b", "left").select("form_hash", F.coalesce("a", "b").alias("first_row"), "b")
        found.write.parquet(f"{scratch}/found")
        found = spark.read.parquet(f"{scratch}/found")
        self.write(found.select("form_hash", "first_row"), "classes")
        self.write(found.where("first_row < b").select(F.col("b").alias("row_id"), "first_row"), "links")
        first_of = reps.where("first_row IS NOT NULL").select("form_hash", "first_row").unionByName(found.select("form_hash", "first_row"))
        out = members.join(first_of, "form_hash").where("first_row < row_id").select(F.col("first_row").alias("row_id_a"), F.col("row_id").alias("row_id_b"))
        out.write.parquet(f"{self.path}/repeats/step={self.steps}")
        mark = spark.createDataFrame([(self.filters, self.texts, bytearray(self.classes.tobytes()))], self.MARK)
        self.write(mark, "mark")
        for kind in ("pairs", "wanted"):
            remove(spark, f"{self.path}/posted/step={self.steps}/kind={kind}")
        self.steps += 1
        remove(spark, scratch)
        return spark.read.parquet(f"{self.path}/repeats/step={self.steps - 1}")

    def near(self, fresh: DataFrame, f: DataFrame, scratch: str) -> DataFrame:
        """(b, a): the batch's rows that repeat an earlier row without having its form, and the first row of that review."""
        spark = self.spark
        self.write(self.meet(fingerprints(fresh, self.classes, self.texts, self.filters)), "posted", "kind", "part")
        self.candidates(None, f"{scratch}/met")
        met = spark.read.parquet(f"{scratch}/met")
        self.sketched(met.where("NOT crowded").select("a", "b").distinct(), f).write.parquet(f"{scratch}/pairs")
        pairs = self.checked(spark.read.parquet(f"{scratch}/pairs"), f)
        pairs.groupBy("b").agg(F.min("a").alias("a")).write.parquet(f"{scratch}/led")
        near = spark.read.parquet(f"{scratch}/led")
        crowded = met.where("crowded").select("part", "b").distinct()
        if not crowded.isEmpty():
            # a crowded row that repeats the first row of a crowd repeats that row or one before it, so only those before it
            # are looked at for that row: what is found is the same as without, only sooner
            limits = crowded.join(near, "b", "left").select("part", F.coalesce("a", "b").alias("a"), "b")
            self.candidates(limits, f"{scratch}/rest")
            self.sketched(spark.read.parquet(f"{scratch}/rest").select("a", "b").distinct(), f).write.parquet(f"{scratch}/pairs-rest")
            near.unionByName(self.checked(spark.read.parquet(f"{scratch}/pairs-rest"), f)).groupBy("b").agg(F.min("a").alias("a")).write.parquet(f"{scratch}/near")
            near = spark.read.parquet(f"{scratch}/near")
        if self.steps:
            links = self.read("links", self.LINKS).select(F.col("row_id").alias("a"), "first_row")
            near.join(links, "a", "left").select("b", F.coalesce("first_row", "a").alias("a")).write.parquet(f"{scratch}/linked")
            near = spark.read.parquet(f"{scratch}/linked")
        # a first row found inside the batch may itself repeat an earlier one: pointers are doubled until none changes
        for i in range(64):
            up = near.select(F.col("b").alias("a"), F.col("a").alias("a2"))
            if not near.join(up, "a", "left_semi").limit(1).count():
                break
            near.join(up, "a", "left").select("b", F.coalesce("a2", "a").alias("a")).write.parquet(f"{scratch}/near{i}")
            near = spark.read.parquet(f"{scratch}/near{i}")
        return near

    def meet(self, own: DataFrame) -> DataFrame:
        """POSTED: the batch's keys and the filters with them added, by partition; the pairs of its rows that have a key in common, and
        the keys that a filter knows (wanted)."""
        spark, size, steps = self.spark, KEYS_PER_FILTER * BITS_PER_KEY // 8, self.steps

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part, pdf in by_part(frames):
                key, row, lost = unpacked(pdf.loc[pdf["kind"] == "own", "data"].tolist())
                old = pdf[pdf["kind"] == "bits"]
                bits = np.frombuffer(old["data"].iloc[0], np.uint8) if len(old) else np.zeros(size, np.uint8)
                if len(key):
                    yield posting("keys", packed(np.full(len(key), part), key, row, lost.astype(np.int64)))
                    if len(old) and (hit := bloom_has(bits, key)).any():
                        yield posting("wanted", packed(np.full(int(hit.sum()), part), key[hit], row[hit], lost[hit].astype(np.int64)))
                    for a, b, crowded in meetings(key, row, lost, np.ones(len(key), bool), None, True):
                        yield posting("pairs", pd.DataFrame({"part": part, "a": a, "b": b, "crowded": crowded}))
                n = len(key) + (int(old["n"].iloc[0]) if len(old) else 0)
                bits = bits.copy()
                while n > len(bits) * 8 // BITS_PER_KEY:
                    bits = np.concatenate([bits, bits])  # places are taken modulo the size, so a doubled filter knows what it knew
                for p in bloom_places(key, len(bits) * 8):
                    np.bitwise_or.at(bits, p >> 3, (1 << (p & 7)).astype(np.uint8))
                yield posting("bits", pd.DataFrame({"part": [part], "n": [n], "data": [bits.tobytes()]}))

        rows = own.select("part", F.lit("own").alias("kind"), F.lit(0).cast("bigint").alias("n"), "data")
        if steps:
            rows = rows.unionByName(self.posted(steps - 1, "bits").select("part", "kind", "n", "data"))
        return rows.repartition(self.filters, "part").sortWithinPartitions("part").mapInPandas(run, self.POSTED)

    def candidates(self, limits: DataFrame | None, path: str) -> None:
        """Writes (part, a, b, crowded): the pairs of the batch's rows with rows before them at a key, its own and stored ones. With limits
        (part, a, b) the pairs passed over before: b's crowded keys with all rows before a."""
        spark = self.spark
        wanted = self.posted(self.steps, "wanted")
        kept = ["part", "kind", "a", "b", "data"]
        known, limited = None, limits is not None
        for i in range(self.steps):
            known = self.posted(i, "keys") if known is None else known.unionByName(self.posted(i, "keys"))

        def met(rows: DataFrame, among: bool) -> DataFrame:
            def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for part, pdf in by_part(frames):
                    blobs = [unpacked(pdf.loc[pdf["kind"].isin(k), "data"].tolist()) for k in (["keys"], ["wanted"])]
                    asking = np.repeat([among, True], [len(x[0]) for x in blobs])
                    at = pdf[pdf["kind"] == "limit"].sort_values("b")
                    before = (at["b"].to_numpy(np.int64), at["a"].to_numpy(np.int64)) if limited else None
                    for a, b, crowded in meetings(*(np.concatenate(x) for x in zip(*blobs)), asking, before, among):
                        yield pd.DataFrame({"part": part, "a": a, "b": b, "crowded": crowded})

            rows = rows.select(kept)
            if limited:
                rows = rows.unionByName(limits.select("part", F.lit("limit").alias("kind"), "a", "b", F.lit(None).cast("binary").alias("data")))
            return rows.repartition(self.filters, "part").sortWithinPartitions("part").mapInPandas(run, "part int, a bigint, b bigint, crowded boolean")

        out = self.posted(self.steps, "pairs").select("part", "a", "b", "crowded") if limits is None else met(self.posted(self.steps, "keys"), True)
        if known is not None:
            asked = known.join(F.broadcast(wanted.select("part").distinct()), "part", "left_semi")  # only the partitions that are asked for
            out = out.unionByName(met(asked.unionByName(wanted), False))
        out.write.parquet(path)

    def sketched(self, pairs: DataFrame, f: DataFrame) -> DataFrame:
        """The pairs (a, b) that may be repeats by their sketches."""
        a, b = self.rows(f, *SKETCHED), f
        pairs = pairs.join(a.select(F.col("row_id").alias("a"), *(F.col(c).alias(f"{c}_a") for c in SKETCHED)), "a")
        return pairs.join(b.select(F.col("row_id").alias("b"), *(F.col(c).alias(f"{c}_b") for c in SKETCHED)), "b").where(may_repeat()).select("a", "b")

    def rows(self, f: DataFrame, *columns: str) -> DataFrame:
        """row_id and these columns of all accepted rows and the batch's."""
        new = f.select("row_id", *columns)
        return self.read("texts", self.TEXTS).select(new.columns).unionByName(new) if self.steps else new

    def checked(self, pairs: DataFrame, f: DataFrame) -> DataFrame:
        """The pairs (a, b) that are repeats, by their texts."""
        first = self.rows(f, "form", "n_words").select(F.col("row_id").alias("a"), F.col("form").alias("form_a"), F.col("n_words").alias("n_a"))
        later = f.select(F.col("row_id").alias("b"), F.col("form").alias("form_b"), F.col("n_words").alias("n_b"))
        return verified(pairs.join(later, "b").join(pairs.join(first, "a"), ["a", "b"]))

def posting(kind: str, pdf: pd.DataFrame) -> pd.DataFrame:
    return pdf.assign(kind=kind).reindex(columns=["a", "b", "crowded", "n", "data", "kind", "part"]).astype({"a": "Int64", "b": "Int64", "n": "Int64", "crowded": "boolean", "part": "int32"})


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of intermediate tables."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def bloom_places(keys: np.ndarray, size: int) -> list[np.ndarray]:
    with np.errstate(over="ignore"):
        a = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        b = (keys.astype(np.uint64) ^ np.uint64(0xD6E8FEB86659FD93)) * np.uint64(0xFF51AFD7ED558CCD) | np.uint64(1)
        return [(((a + b * np.uint64(i)) >> np.uint64(20)) % np.uint64(size)).astype(np.int64) for i in range(HASHES)]


def bloom_has(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    hit = np.ones(len(keys), bool)
    for p in bloom_places(keys, len(bits) * 8):
        hit &= (bits[p >> 3] >> (p & 7).astype(np.uint8) & 1).astype(bool)
    return hit


def verified(pairs: DataFrame) -> DataFrame:
    """The pairs (a, b, form_a, form_b, n_a, n_b) whose shared words cover enough of both."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ok = [is_repeat(x, y, m, n) for x, y, m, n in zip(pdf["form_a"], pdf["form_b"], pdf["n_a"], pdf["n_b"])]
            yield pdf.loc[ok, ["a", "b"]]

    return pairs.mapInPandas(run, T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())]))


def repeats(spark: SparkSession, rows: DataFrame, steps: list[Column], key: str = "row_id", text: str = "comment", filters: int | None = None) -> DataFrame:
    """Accepts the rows step by step (each a condition on them) and returns every step's repeats.

    NULL and '' comments, and those of fewer than five words, are neither repeats nor first rows. Rows of one step are
    ordered by key; the result does not depend on how consecutive batches are grouped into steps.
    """
    if filters is None:
        filters = max(8, int(rows.count() * 48 / KEYS_PER_FILTER) + 1)
    store = Store(spark, scratch_path(spark, "dedup-store"), filters)
    out = [store.accept(rows.where(c), key, text).withColumn("step", F.lit(i)) for i, c in enumerate(steps)]
    result = out[0]
    for df in out[1:]:
        result = result.unionByName(df)
    return result
