"""Text decoded with the wrong character encoding: find it and undo it by round trips.

A pass over character classes finds the values worth a look (a few per cent). For those, the text is re-encoded under candidate
legacy encodings, strictly decoded as the intended encoding, chunk by chunk, and the result is kept when a garbling
cost drops; this repeats for nested layers. What stays garbled without a repair is reported as damaged, not restored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRIAL_CHUNKS = 2  # chunks an encoding is tried on at once
# Single-byte encodings tried as the wrong decoding, and as the intended one.
WRONG = ("cp1252", "latin-1", "cp1254", "mac_roman", "cp1251", "cp437", "cp850", "cp866", "koi8-r", "cp857", "mac_cyrillic", "iso8859-5", "cp1250", "cp1256")
# Fixed values: (wrong, intended) pairs of single-byte encodings that are confused in practice.
SINGLE_PAIRS = (
    ("cp1252", "cp1254"), ("cp1252", "cp1251"), ("latin-1", "cp1251"), ("cp1251", "cp1252"), ("cp1251", "cp1254"), ("cp1251", "koi8-r"), ("koi8-r", "cp1251"),
    ("cp1251", "cp866"), ("cp866", "cp1251"), ("mac_roman", "cp1252"), ("mac_roman", "cp1254"), ("cp1252", "mac_roman"), ("latin-1", "mac_roman"), ("cp437", "cp1252"), ("cp850", "cp1252"),
    ("cp850", "cp1254"), ("cp437", "cp1254"), ("cp1252", "cp850"), ("cp1252", "cp437"), ("cp1252", "cp857"), ("cp857", "cp1254"), ("latin-1", "koi8-r"), ("cp1252", "koi8-r"),
    ("cp1252", "cp866"), ("latin-1", "cp866"), ("cp866", "koi8-r"), ("koi8-r", "cp866"), ("iso8859-5", "cp1251"), ("cp1251", "iso8859-5"), ("cp1251", "mac_cyrillic"),
    ("mac_cyrillic", "cp1251"), ("mac_roman", "cp1251"), ("cp1250", "cp1252"), ("cp1250", "cp1254"), ("cp1250", "cp1251"), ("cp866", "cp1252"), ("cp866", "cp1254"),
)
# Letters beyond a-z of the languages' own alphabets (tr az de fr es it nl uk ru and loan spellings).
LATIN = "çğıöşüâîûÇĞİÖŞÜÂÎÛəƏäÄßéèêëàùôœïÿÉÈÊËÀÙÔŒÏæÆáíóúñÁÍÓÚÑìòÌÒ"
SYMBOLS_IN_WORD = r"¡-©«-¶¸¹»-¿×÷ˆ˜–—‘‚-„†-•…‰‹›€™∀-⋿─-◿⌐ЂЃ№ªº"
JUNK = r"\u0080-\u009f�─-▯-"
ODD_LETTERS = r"ÃÅÐÞØÕÝðþøõýåãŸžŽšŠƒµ¶ˆ˜"

# Character classes of the first look: values are worth more where a class or a pair of neighbours is suspicious.
(PLAIN, LOWER, UPPER, TURKIC_LOWER, TURKIC_UPPER, ACCENT_LOWER, ACCENT_UPPER, CYRILLIC_LOWER, CYRILLIC_UPPER, SYMBOL, QUESTION, BAD) = range(12)
# Letters of the first look that stand in ordinary words side by side, and capitals that hardly open a word.
TURKIC = "çğıöşüəâîäß"
RARE_CAPITALS = "ÈËÌÒÙÏÎÔ"


@lru_cache(maxsize=1)
def first_look() -> tuple[np.ndarray, np.ndarray]:
    """Class per code point, and the suspicious pairs of classes."""
    n = 0x20000
    classes = np.zeros(n, np.uint8)
    bad, symbol = re.compile(f"[{JUNK}ÃÅÐÞØÕÝðþøõýåãŸžŽšŠƒµ¶ˆ˜ЂЃѓЉЊЌЋЏђљњќћџЎўЈѕЅјҐ{RARE_CAPITALS}]"), re.compile(f"[{SYMBOLS_IN_WORD}]")
    for c in range(n):
        ch = chr(c)
        if bad.match(ch) or c in (0xAD,):
            classes[c] = BAD
        elif c < 128:
            classes[c] = LOWER if ch.islower() else UPPER if ch.isupper() else QUESTION if ch == "?" else PLAIN
        elif ch in "…“”«»„’‘¿¡№":
            classes[c] = PLAIN
        elif symbol.match(ch):
            classes[c] = SYMBOL
        elif ch in TURKIC:
            classes[c] = TURKIC_LOWER
        elif ch.lower() in TURKIC or ch == "İ":
            classes[c] = TURKIC_UPPER
        elif 0x0400 <= c < 0x0530:
            classes[c] = CYRILLIC_LOWER if ch.islower() else CYRILLIC_UPPER
        elif c < 0x0250 and ch.isalpha():
            classes[c] = ACCENT_LOWER if ch.islower() else ACCENT_UPPER
    lower, upper = [LOWER, TURKIC_LOWER, ACCENT_LOWER, CYRILLIC_LOWER], [UPPER, TURKIC_UPPER, ACCENT_UPPER, CYRILLIC_UPPER]
    latin, cyrillic = [LOWER, UPPER, TURKIC_LOWER, TURKIC_UPPER, ACCENT_LOWER, ACCENT_UPPER], [CYRILLIC_LOWER, CYRILLIC_UPPER]
    pairs = np.zeros((12, 12), bool)
    for x, y in ((lower, upper), (latin, cyrillic), (cyrillic, latin), (latin + cyrillic, [SYMBOL]), ([SYMBOL], [SYMBOL]), ([QUESTION], lower), ([ACCENT_LOWER, ACCENT_UPPER], [ACCENT_LOWER, ACCENT_UPPER]), ([UPPER, TURKIC_UPPER], [ACCENT_UPPER])):
        pairs[np.ix_(x, y)] = True
    pairs[BAD, :] = True
    return classes, pairs


def worth_a_look(texts: list[str]) -> np.ndarray:
    """Which texts hold a suspicious character or pair; one pass over all of them at once."""
    classes, pairs = first_look()
    cps = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    c = classes[np.where(cps < 0x20000, cps, 0)]
    hits = np.flatnonzero(pairs[c[:-1], c[1:]])
    out = np.zeros(len(texts), bool)
    starts = np.cumsum([0] + [len(t) + 1 for t in texts])
    out[np.searchsorted(starts, hits, "right") - 1] = True
    return out


COSTS = [
    (regex.compile(r"[\u0080-\u009f]"), 3.0),
    (regex.compile(r"�"), 4.0),
    (regex.compile(r"[─-▯-]"), 3.0),
    # capitals with tilde stand in all-capital words, thorn before an accented vowel in Icelandic ones
    (regex.compile(rf"(?V1)(?<!\p{{Lu}})[ÃÅÕ](?!\p{{Lu}})|[ÃÅÕ](?=[{SYMBOLS_IN_WORD}\u0080-¿--[”“]])|[Þ](?![óúíáéö])|(?<!\p{{Lu}})Ð|[{ODD_LETTERS}--[ÃÅÕÞÐøåãõ]]|(?<=\P{{L}})[øåãõ](?=\P{{L}})"), 1.6),
    (regex.compile(r"\p{Ll}(?=\p{Lu})"), 1.0),
    (regex.compile(r"(?<!\p{L})[а-яё](?=[А-ЯЁ])"), 0.5),
    (regex.compile(r"[A-Za-zÀ-ɏ](?=\p{Cyrillic})|\p{Cyrillic}(?=[A-Za-zÀ-ɏ])"), 1.5),
    (regex.compile(r"[À-ÆÈ-ÕØ-Ûà-ãåæè-õø-ûÿ](?=[À-ÆÈ-ÕØ-Ûà-ãåæè-õø-ûÿ]{2})|[À-ÿ](?=[À-ÿ]{4})"), 0.9),
    (regex.compile(r"(?<![\p{L}])[À-ÖØ-öø-ÿ][À-ÖØ-öø-ÿ](?!\p{L})"), 0.8),
    (regex.compile(rf"(?V1)(?<=[\p{{L}}--[\p{{Han}}\p{{Hiragana}}\p{{Katakana}}]])[{SYMBOLS_IN_WORD}--[’‘]]+(?=\p{{L}})"), 1.6),
    (regex.compile(rf"(?V1)[{SYMBOLS_IN_WORD}--[»”“«„]](?=[{SYMBOLS_IN_WORD}--[¡¿»”“«„]])"), 0.8),
    (regex.compile(rf"[ÄÂâГΓ](?=[{SYMBOLS_IN_WORD}\u0080-¿])"), 1.6),
    (regex.compile(r"(?<=[A-Z])[ÀÈÉÊËÌÍÎÏÒÓÔÙÚÛÑÖÜÄÇ](?=[a-z])"), 1.2),
    (regex.compile(r"[ЂЃѓЉЊЌЋЏђљњќћџЎўЈѕЅјѐѝ]"), 1.2),
    (regex.compile(r"[\p{L}]\u00ad(?=\p{L})|\u00ad\u00a0"), 0.6),
    (regex.compile(r"(?<=\s)[ÈËÀ](?=[bcdfghjklmnpqrstvwxz])"), 0.7),
    (regex.compile(r"(?<=\p{Ll})\?(?=\p{Ll})"), 0.9),
    (regex.compile(r"[ｦ-ﾟ]|[؀-ۿ](?=[A-Za-zÀ-ÿ])|[A-Za-zÀ-ÿ](?=[؀-ۿ])"), 1.2),
    (regex.compile(r"[\p{Han}\p{Hangul}\p{Thai}\p{Devanagari}\p{Hiragana}](?=[À-ɏЀ-ӿ])|[À-ɏЀ-ӿ](?=[\p{Han}\p{Hangul}\p{Thai}\p{Devanagari}\p{Hiragana}])"), 2.0),
    (regex.compile(r"[ѠѡѢѣѤѥѦѧѨѩѪѫѬѭѮѯѰѱѲѳѴѵ\u0460-\u048f\u0492-\u052f]|[ƀ-ƎƐ-ɏ]|[\u0250-\u0258\u025a-\u036f]"), 1.2),
    (regex.compile(r"[^\p{Latin}\p{Cyrillic}\p{Arabic}\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Devanagari}\P{L}ªºµー々]"), 1.2),
]


ANY = regex.compile("|".join(f"(?:{p.pattern.replace('(?V1)', '')})" for p, _ in COSTS), flags=regex.V1)


@lru_cache(maxsize=20_000)
def garbling_cost(text: str) -> float:
    """Sum of the weights of garbling signs: control codes, replacement marks, symbols, case or script breaks inside words."""
    if not ANY.search(text):
        return 0.0
    return sum(w * sum(1 for _ in p.finditer(text)) for p, w in COSTS)


@lru_cache(maxsize=None)
def encoder(name: str) -> dict[str, int]:
    """Character to byte of a single-byte encoding; bytes it leaves undefined stand for the control codes of that number."""
    table: dict[str, int] = {}
    for b in range(256):
        try:
            c = bytes([b]).decode(name)
        except UnicodeDecodeError:
            c = chr(b)
        table.setdefault(c, b)
    return table


def encode(text: str, name: str) -> bytes | None:
    table = encoder(name)
    try:
        return bytes([table[c] for c in text])
    except KeyError:
        return None


CHUNK = re.compile(r"[^.!?\n]+[.!?\n]*|[.!?\n]+")
NON_ASCII = re.compile(r"[^\x00-\x7f]+")


def undo_utf8(text: str, wrong: str) -> str | None:
    """Every non-ASCII run that is UTF-8 under the wrong encoding is decoded; the others stay. NULL where none is."""
    changed = False

    def run(m: re.Match) -> str:
        nonlocal changed
        s = m[0]
        b = encode(s, wrong)
        if b is not None:
            try:
                out = b.decode("utf-8")
                changed = True
                return out
            except UnicodeDecodeError:
                pass
        # sound text may touch the damage: decode the sequences that are well-formed, leave the rest
        table, parts, i = encoder(wrong), [], 0
        while i < len(s):
            lead = table.get(s[i], 0)
            n = 2 if 0xC2 <= lead <= 0xDF else 3 if 0xE0 <= lead <= 0xEF else 4 if 0xF0 <= lead <= 0xF4 else 0
            piece = s[i : i + n]
            b = encode(piece, wrong) if n and len(piece) == n else None
            try:
                if b is not None:
                    parts.append(b.decode("utf-8"))
                    changed = True
                    i += n
                    continue
            except UnicodeDecodeError:
                pass
            parts.append(s[i])
            i += 1
        return "".join(parts)

    out = NON_ASCII.sub(run, text)
    return out if changed else None


def undo_single(text: str, wrong: str, intended: str) -> str:
    """The text with every maximal run that the wrong encoding can write decoded as intended, where that is strictly
    possible and lowers the run's cost."""
    table = encoder(wrong)
    out, run = [], []

    def flush() -> None:
        piece = "".join(run)
        run.clear()
        if piece.isascii() or not (cost := garbling_cost(piece)):
            out.append(piece)
            return
        try:
            new = bytes([table[c] for c in piece]).decode(intended)
        except UnicodeDecodeError:
            new = piece
        out.append(new if garbling_cost(new) < cost - 0.5 else piece)

    for c in text:
        if c in table:
            run.append(c)
        else:
            if run:
                flush()
            out.append(c)
    if run:
        flush()
    return "".join(out)


def undo_layer(text: str) -> tuple[str, str | None]:
    """The cheapest text after one round trip, and the encodings used; the text itself where no trip lowers the cost."""
    # a blank may stand for the no-break space that completes a sequence (à)
    chunks = CHUNK.findall(regex.sub(r"Ã (?=\p{L}|\s)", "Ã\u00a0", text) if "Ã " in text else text)
    costs = [garbling_cost(c) for c in chunks]
    dirty = [i for i, c in enumerate(costs) if c > 0]
    if not dirty:
        return text, None
    # the encodings are chosen on the worst chunks and then applied to every chunk; where none helps, on the next worst
    by_cost = sorted(dirty, key=lambda i: -costs[i])
    for k in range(0, len(by_cost), TRIAL_CHUNKS):
        if best := chosen_encodings(chunks, costs, by_cost[k : k + TRIAL_CHUNKS]):
            break
    else:
        return text, None
    for i in dirty:
        new = undo_utf8(chunks[i], best[0]) if best[1] == "utf-8" else undo_single(chunks[i], *best)
        if new is not None and garbling_cost(new) < costs[i]:
            chunks[i] = new
    return "".join(chunks), ">".join(best)


def chosen_encodings(chunks: list[str], costs: list[float], worst: list[int]) -> tuple[str, str] | None:
    """The pair of encodings (wrong, intended) whose round trip lowers the cost of some chunks most, if any does."""
    before = sum(costs[i] for i in worst)
    best_cost, best = before - 0.6, None
    for wrong in WRONG:
        cost = sum(min(costs[i], garbling_cost(o) if (o := undo_utf8(chunks[i], wrong)) is not None else costs[i]) for i in worst)
        if cost < best_cost:
            best_cost, best = cost, (wrong, "utf-8")
        if best and best_cost <= 0.8:
            break
    # a clean result settles it; else well-formed sequences of several bytes, which hardly arise by chance, go before single bytes
    if not (best and best_cost <= 0.8):
        multi, multi_cost = best, best_cost
        best_cost, best = before - 0.6, None
        for wrong, intended in SINGLE_PAIRS:
            cost = sum(garbling_cost(undo_single(chunks[i], wrong, intended)) for i in worst)
            if cost < best_cost - 0.15:
                best_cost, best = cost, (wrong, intended)
            if best and best_cost <= 0.5:
                break
        if multi and multi_cost <= 0.75 * before and not (best and best_cost <= max(0.8, 0.05 * before)):
            best = multi
    return best


#: What no clean value holds, whether a round trip removes it or not.
SURE = regex.compile(r"�|[\u0080-\u009f]|(?<!\p{Lu})[ÃÂÄÅ][\u00a1-¿€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]|[ÐÑ][\u00a1-¿‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]|â€|[├┬┼─][─-◿а-яÇ-ÿ]|\p{Ll}[√≈∂ƒ]\p{L}?")
def repair(text: str | None) -> tuple[str | None, bool, str | None]:
    """(text, damaged, how). NULL and '' stay as they are; what can't be restored comes back unchanged and damaged."""
    if not text:
        return text, False, None
    if "\ufffd" in text and not garbling_cost(text.replace("\ufffd", "")):
        return text, True, None
    layers, now = [], text
    while True:  # every layer lowers the cost, so this ends
        before = now
        now, how = undo_layer(now)
        if how is None or now == before:
            break
        layers.append(how)
    if layers:
        return now, True, " ".join(layers)
    return text, bool(SURE.search(text)), None


def repaired_texts(texts: list[str]) -> list[str]:
    """The texts with what a wrong decoding did undone."""
    return [repair(t)[0] if look else t for t, look in zip(texts, worth_a_look(texts))]


def damaged_rows(df: DataFrame, text: str) -> DataFrame:
    """The rows whose text is damaged, with `restored` (NULL: the original can't be had) and `layers` (the round trips).

    NULL and '' are never damaged; repeated rows come out as often as they came in; other columns pass unchanged.
    """
    schema = T.StructType([*df.schema.fields, T.StructField("restored", T.StringType()), T.StructField("layers", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf[worth_a_look(pdf[text].tolist())]
            out = [repair(t) for t in pdf[text]]
            pdf = pdf.assign(restored=[o[0] if o[2] else None for o in out], layers=[o[2] for o in out])
            yield pdf[[o[1] for o in out]]

    return df.where(F.length(text) > 0).mapInPandas(run, schema)
