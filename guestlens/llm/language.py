"""Language of texts and of one-language stretches by hyperdimensional n-gram profiles.

Every letter has a random +-1 vector. An n-gram is bound as the product of its letters' vectors, each rotated by its
place; a language prototype is the bundle (weighted sum) of its n-grams' vectors. A text is compared with the prototypes
by cosine. As the comparison is linear in the text's n-grams, each distinct n-gram is compared once and its 15 numbers
are added up per word, which gives the same cosines as adding up vectors; a Viterbi pass over the words with a price for
each change of language finds the stretches.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIM = 4096
SEED = 7
SAMPLE_ROWS = 1500  # labelled rows per table that the profiles are fitted on, at most
SLICE = 1000  # texts worked on at once
LANGS = ("tr", "en", "de", "ru", "fr", "es", "it", "nl", "uk", "az", "ar", "zh", "ja", "th", "hi")
BOUNDARY_PRICE, INNER_PRICE = 5.0, 10.0  # price of a language change, in words' worth of evidence
WORD_CAP = 3.0  # one word's evidence at most
RETRAIN_ROUNDS = 4
MEMORY = 400_000  # n-grams whose comparisons a worker keeps

# Names and codes of the languages other than the two-letter code.
LABELS = {
    "tr": "tur turkish türkçe turkce", "en": "eng english ingilizce", "de": "deu ger german deutsch", "ru": "rus russian русский", "fr": "fra fre french français francais",
    "es": "spa spanish español espanol", "it": "ita italian italiano", "nl": "nld dut dutch nederlands", "uk": "ukr ukrainian українська", "az": "aze azeri azerbaijani azərbaycan azərbaycanca",
    "ar": "ara arabic العربية", "zh": "zho chi chinese 中文", "ja": "jpn japanese 日本語", "th": "tha thai ไทย", "hi": "hin hindi हिन्दी",
}
#: A few plain sentences per language, so that every language has a profile whatever the labelled rows hold.
SEEDS = {
    "tr": "Bu otelde çok güzel bir hafta geçirdik. Oda temiz değildi ama personel bize her zaman yardımcı oldu. Yemekler çok lezzetliydi ve deniz manzarası harikaydı. Kahvaltıda her şey vardı.",
    "en": "We had a very nice week at this hotel. The room was not clean but the staff always helped us. The food was tasty and the view of the sea was wonderful. There was everything at breakfast.",
    "de": "Wir hatten eine sehr schöne Woche in diesem Hotel. Das Zimmer war nicht sauber, aber das Personal hat uns immer geholfen. Das Essen war lecker und der Blick auf das Meer wunderbar.",
    "ru": "Мы провели очень хорошую неделю в этом отеле. Номер был не очень чистый, но персонал всегда нам помогал. Еда была вкусная, и вид на море был прекрасный. На завтраке было всё.",
    "fr": "Nous avons passé une très belle semaine dans cet hôtel. La chambre n'était pas propre mais le personnel nous a toujours aidés. La nourriture était bonne et la vue sur la mer magnifique.",
    "es": "Pasamos una semana muy bonita en este hotel. La habitación no estaba limpia pero el personal siempre nos ayudó. La comida estaba muy rica y la vista al mar era maravillosa.",
    "it": "Abbiamo passato una settimana molto bella in questo albergo. La camera non era pulita ma il personale ci ha sempre aiutato. Il cibo era buono e la vista sul mare era meravigliosa.",
    "nl": "We hadden een hele mooie week in dit hotel. De kamer was niet schoon maar het personeel heeft ons altijd geholpen. Het eten was lekker en het uitzicht op de zee was prachtig.",
    "uk": "Ми провели дуже гарний тиждень у цьому готелі. Номер був не дуже чистий, але персонал завжди нам допомагав. Їжа була смачна, і вид на море був чудовий. На сніданок було все.",
    "az": "Bu oteldə çox gözəl bir həftə keçirdik. Otaq təmiz deyildi, amma işçilər bizə həmişə kömək edirdilər. Yeməklər çox dadlı idi və dəniz mənzərəsi əla idi. Səhər yeməyində hər şey var idi.",
    "ar": "قضينا أسبوعا جميلا جدا في هذا الفندق. لم تكن الغرفة نظيفة ولكن الموظفين ساعدونا دائما. كان الطعام لذيذا وكان منظر البحر رائعا. كان كل شيء موجودا في الإفطار.",
    "zh": "我们在这家酒店度过了非常愉快的一周。房间不太干净，但是工作人员一直帮助我们。食物很好吃，海景也很美。早餐什么都有。",
    "ja": "このホテルでとても楽しい一週間を過ごしました。部屋はあまりきれいではありませんでしたが、スタッフはいつも助けてくれました。料理は美味しくて、海の景色も素晴らしかったです。",
    "th": "เราใช้เวลาหนึ่งสัปดาห์ที่ดีมากในโรงแรมนี้ ห้องไม่ค่อยสะอาดแต่พนักงานช่วยเหลือเราเสมอ อาหารอร่อยและวิวทะเลสวยมาก มีทุกอย่างในมื้อเช้า",
    "hi": "हमने इस होटल में बहुत अच्छा सप्ताह बिताया। कमरा साफ नहीं था लेकिन कर्मचारियों ने हमेशा हमारी मदद की। खाना स्वादिष्ट था और समुद्र का दृश्य बहुत सुंदर था।",
}

LATIN, CYRILLIC, ARABIC, HAN, KANA, THAI, DEVANAGARI, OTHER = 1, 2, 3, 4, 5, 6, 7, 8
PLAIN_LETTER = re.compile(r"[A-Za-z]")
QUOTED = re.compile(r"[“„«\"「『][^“”„«»\"「」『』\n]+[”“»\"」』]")
QUOTED_SHARE = 0.25  # of the text: a quotation beyond it counts like any other part
ADDRESS = re.compile(r"\S*(?:@|＠|www\.|://)\S*")
TERMINATOR = re.compile(r"[.!?…。！？।؟]+[\"”»“)\]]*(?=\s|$)|[。！？।]+|\n")
SKIP = re.compile(r"[\s/|•·–—*\-​]+")


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray]:
    """Per code point: the lower-case letter's code point (0 for what is no letter) and its script."""
    n = 0x20000
    letter, script = np.zeros(n, np.uint32), np.zeros(n, np.uint8)
    for c in range(n):
        ch = chr(c)
        cat = unicodedata.category(ch)
        if cat[0] == "L" or cat[0] == "M" and 0x0300 <= c < 0x1000 and not 0x0300 <= c < 0x0370:
            low = {"İ": "i"}.get(ch, ch.lower())
            letter[c] = ord(low[0])
            script[c] = (
                LATIN if c < 0x0370 or 0x1E00 <= c < 0x1F00 else CYRILLIC if 0x0400 <= c < 0x0530 else ARABIC if 0x0600 <= c < 0x0780 else THAI if 0x0E00 <= c < 0x0E80
                else DEVANAGARI if 0x0900 <= c < 0x0980 else KANA if 0x3040 <= c < 0x3100 or 0xFF66 <= c < 0xFFA0 else HAN if 0x3400 <= c < 0xA000 or 0x3005 == c else OTHER
            )
    return letter, script


class Letters:
    """Random +-1 vectors of letters, each made from its own code point, with the rotations for every place."""

    def __init__(self) -> None:
        self.index = np.zeros(0x20000, np.int32)
        self.rows = np.ones((1, DIM), np.int8)

    def of(self, letters: np.ndarray) -> np.ndarray:
        new = np.unique(letters)
        new = new[(self.index[new] == 0) & (new > 0)]
        if len(new):
            made = [np.random.default_rng([SEED, int(c)]).integers(0, 2, DIM, dtype=np.int8) * 2 - 1 for c in new]
            self.index[new] = np.arange(len(self.rows), len(self.rows) + len(new))
            self.rows = np.vstack([self.rows, *[m[None] for m in made]])
        return self.index[letters]


SPACE = 0x1FFFF  # stands for the edge of a word
letters = Letters()


def bind(ids: np.ndarray) -> np.ndarray:
    """The vectors of packed n-grams (three letters of 21 bits; absent ones are 0)."""
    a, b, c = (ids >> np.uint64(42)).astype(np.int64), ((ids >> np.uint64(21)) & np.uint64(0x1FFFFF)).astype(np.int64), (ids & np.uint64(0x1FFFFF)).astype(np.int64)
    ia, ib, ic = letters.of(a), letters.of(b), letters.of(c)  # row 0 is all ones: an absent letter changes nothing
    return letters.rows[ic] * np.roll(letters.rows, 1, axis=1)[ib] * np.roll(letters.rows, 2, axis=1)[ia]


class Text:
    """A slice of texts as arrays: words with their text, place and script, and n-grams with their word."""

    def __init__(self, texts: list[str]) -> None:
        letter, script = tables()
        joined = "\n\0\n".join(texts) + "\n\0\n"
        cps = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        cps = np.where(cps < 0x20000, cps, 0x20)
        low, scr = letter[cps], script[cps]
        scr = np.where(scr == KANA, HAN, scr)  # a word may mix the two
        starts = np.cumsum([0] + [len(t) + 3 for t in texts])
        prev = np.concatenate([[0], scr[:-1]])
        first = (scr > 0) & (scr != prev)
        last = (scr > 0) & (np.concatenate([scr[1:], [0]]) != scr)
        self.begin, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.script = scr[self.begin]
        self.doc = np.searchsorted(starts, self.begin, "right") - 1
        self.offset = starts
        self.joined = joined
        word = np.cumsum(first) - 1
        at = np.flatnonzero(scr > 0)
        edge = np.uint64(SPACE)
        mid = low[at].astype(np.uint64)
        left = np.where(first[at], edge, low[np.maximum(at - 1, 0)].astype(np.uint64))
        right = np.where(last[at], edge, low[np.minimum(at + 1, len(low) - 1)].astype(np.uint64))
        three = (left << np.uint64(42)) | (mid << np.uint64(21)) | right
        two = (mid << np.uint64(21)) | right
        alone = scr[at] >= ARABIC  # single letters tell something in the large or unusual alphabets only
        in_word = word[at]
        self.orders = [(three, in_word, 1.0), (two, in_word, 0.7), (mid[alone], in_word[alone], 0.7)]
        term = np.isin(cps, [ord(c) for c in ".!?…؟"])
        blank = np.isin(cps, [0x20, 0x09, 0x0D, 0xA0])
        hard = np.isin(cps, [ord(c) for c in "\n。！？।/|"])
        t, w, h = (np.concatenate([[0], np.cumsum(x)]) for x in (term, blank, hard))
        lo, hi = self.end[:-1], self.begin[1:]
        soft = (t[hi] > t[lo]) & (w[hi] > w[lo]) | (h[hi] > h[lo]) | (hi > lo) & (self.script[1:] != self.script[:-1])
        self.boundary = np.concatenate([[True], soft]) if len(self.begin) else np.zeros(0, bool)


class Profiles:
    """Language prototypes and the memory of n-gram comparisons."""

    def __init__(self, prototypes: np.ndarray, unit: float = 1.0) -> None:
        self.prototypes, self.unit = prototypes, unit
        self.known: dict = {}
        self.index = pd.Index(np.zeros(0, np.uint64))
        self.scores = np.zeros((len(LANGS), 0), np.float32)

    def compare(self, ids: np.ndarray) -> np.ndarray:
        """Row numbers of ids in self.scores; new n-grams are bound and compared with the prototypes."""
        codes, distinct = pd.factorize(ids)
        rows = self.index.get_indexer(distinct)
        new = distinct[rows < 0]
        if len(new):
            parts = [self.prototypes @ bind(new[i : i + 1024]).astype(np.float32).T for i in range(0, len(new), 1024)]
            self.index = self.index.append(pd.Index(new))
            self.scores = np.ascontiguousarray(np.hstack([self.scores, *parts]))
            rows = self.index.get_indexer(distinct)
        return rows[codes]

    def by_word(self, t: Text) -> np.ndarray:
        """Per word and language the sum of its n-grams' comparisons; words that occur again are reckoned once."""
        n = len(t.begin)
        if self.scores.shape[1] > MEMORY:
            self.index, self.scores = pd.Index(np.zeros(0, np.uint64)), self.scores[:, :0]
        if not n:
            return np.zeros((0, len(LANGS)), np.float32)
        ids, word, _ = t.orders[0]  # every word has three-letter grams with its edges, which name it
        with np.errstate(over="ignore"):
            h = ids * np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            names = np.add.reduceat(h ^ (h >> np.uint64(32)), np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])))
        codes, distinct = pd.factorize(names)
        new = np.ones(n, bool)
        new[1:] = codes[1:] > np.maximum.accumulate(codes)[:-1]  # codes are given in the order of appearance
        out = np.zeros((len(distinct), len(LANGS)), np.float32)
        # orders over the same letters are added before the sums per word
        groups: list[list[tuple[np.ndarray, np.ndarray, float]]] = []
        source = None
        for ids, word, weight in t.orders:
            if groups and source is word:
                groups[-1].append((ids[kept], groups[-1][0][1], weight))
            elif len(ids):
                source, kept = word, new[word]
                groups.append([(ids[kept], codes[word[kept]], weight)])
        for group in groups:
            word = group[0][1]
            if not len(word):
                continue
            looked_up = [(self.compare(ids), np.float32(w)) for ids, _, w in group]
            firsts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            at = word[firsts]
            for i, column in enumerate(self.scores):
                values = column[looked_up[0][0]] * looked_up[0][1]
                for rows, w in looked_up[1:]:
                    values += column[rows] * w
                out[at, i] += np.add.reduceat(values, firsts)
        return out[codes]


def fit(texts: list[str], labels: list[str]) -> Profiles:
    """Prototypes from labelled texts, some of whose labels may be wrong or hold for a part of the text only.

    A bundle is linear in its n-grams, so its weights are worked out per n-gram first: the root of the n-gram's rate in
    the language times the language's share of it. Pieces that clearly contradict their label are left out. Then come
    rounds of retraining, in which a piece taken for another language is added to its own bundle and taken from the other.
    """
    texts, labels = list(texts), list(labels)
    for lang, seed in SEEDS.items():
        texts += [seed] * 3
        labels += [lang] * 3
    pieces, owner = [], []
    for text, lab in zip(texts, labels):
        for p in re.split(r"(?<=[.!?。！？।\n])\s*", ADDRESS.sub(" ", text)):
            if len(p) > 5:
                pieces.append(p)
                owner.append(LANGS.index(lab))
    owner, k = np.array(owner), len(LANGS)
    t = Text(pieces)
    ids = np.concatenate([o[0] for o in t.orders])
    piece = np.concatenate([t.doc[o[1]] for o in t.orders])
    gram_weight = np.concatenate([np.full(len(o[0]), o[2]) for o in t.orders])
    codes, distinct = pd.factorize(ids)
    order = np.argsort(piece, kind="stable")
    codes, piece, gram_weight = codes[order], piece[order], gram_weight[order]
    firsts = np.flatnonzero(np.concatenate([[True], piece[1:] != piece[:-1]]))
    there = piece[firsts]
    norm = np.sqrt(np.add.reduceat(gram_weight**2, firsts))

    def total(w: np.ndarray) -> np.ndarray:
        out = np.zeros((len(pieces), k))
        for i, column in enumerate(np.ascontiguousarray(w.T)):
            out[there, i] = np.add.reduceat(column[codes] * gram_weight, firsts) / norm
        return out

    def bundle(use: np.ndarray, owners: np.ndarray, by_norm: bool) -> np.ndarray:
        scale = np.zeros(len(pieces))
        scale[there] = 1 / norm if by_norm else 1
        part = use[piece]
        at = codes[part] * k + owners[piece[part]]
        return np.bincount(at, weights=(gram_weight * scale[piece])[part], minlength=len(distinct) * k).reshape(len(distinct), k)

    keep = np.ones(len(pieces), bool)
    for _ in range(2):
        counts = bundle(keep, owner, False)
        rate = counts / np.maximum(counts.sum(0), 1)
        w = np.sqrt(rate) * rate / np.maximum(rate.sum(1, keepdims=True), 1e-12)
        w -= w.mean(1, keepdims=True)
        w /= np.linalg.norm(w, axis=0)
        sums = total(w)
        best, mine = sums.argmax(1), sums[np.arange(len(pieces)), owner]
        gap = sums.max(1) - mine
        keep = gap <= 0.5 * np.median(np.sort(sums, axis=1)[:, -1] - np.sort(sums, axis=1)[:, -2])
    for _ in range(RETRAIN_ROUNDS):
        sums = total(w)
        rival = np.where(np.arange(k) == owner[:, None], -np.inf, sums)
        second = rival.argmax(1)
        wrong = keep & (sums[np.arange(len(pieces)), owner] < rival.max(1) + 0.02)
        step = (bundle(wrong, owner, True) - bundle(wrong, second, True)) / np.maximum(np.bincount(owner[keep], minlength=k), 1)
        w += step
        w /= np.linalg.norm(w, axis=0)
    prototypes = np.zeros((k, DIM), np.float32)
    for i in range(0, len(distinct), 1024):
        prototypes += w[i : i + 1024].T.astype(np.float32) @ bind(distinct[i : i + 1024]).astype(np.float32)
    profiles = Profiles(prototypes / np.linalg.norm(prototypes, axis=1, keepdims=True) / np.sqrt(DIM))
    words = profiles.by_word(t)
    by_piece = np.zeros((len(pieces), k))
    docs = np.flatnonzero(np.concatenate([[True], t.doc[1:] != t.doc[:-1]]))
    by_piece[t.doc[docs]] = np.add.reduceat(words, docs, axis=0)
    n_words = np.bincount(t.doc, minlength=len(pieces))
    ranked = np.sort(by_piece, axis=1)
    long = (n_words >= 4) & keep
    profiles.unit = float(np.median(((ranked[:, -1] - ranked[:, -2]) / np.maximum(n_words, 1))[long])) if long.any() else 1.0
    return profiles


def viterbi(scores: np.ndarray, price: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The best language of each word, all documents side by side. price[i]: of a change right before word i."""
    n, k = scores.shape
    starts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if n else np.zeros(0, int)
    lengths = np.diff(np.concatenate([starts, [n]]))
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    back = np.zeros((n, k), np.int8)
    best = scores[starts].copy() if n else scores
    ends = np.zeros((len(starts), k), np.float32)
    for step in range(1, int(lengths[0]) if len(lengths) else 0):
        live = int(np.searchsorted(-lengths, -step, "left"))
        ends[live:len(best)] = best[live:] if len(best) > live else ends[live:len(best)]
        at = starts[:live] + step
        cur = best[:live]
        top = cur.argmax(1)
        jump = cur[np.arange(live), top] - price[at]
        stay = cur >= jump[:, None]
        back[at] = np.where(stay, np.arange(k, dtype=np.int8), top[:, None].astype(np.int8))
        best = np.where(stay, cur, jump[:, None]) + scores[at]
    if len(starts):
        ends[: len(best)] = best
    path = np.zeros(n, np.int8)
    state = ends.argmax(1).astype(np.int8) if len(starts) else np.zeros(0, np.int8)
    for step in range((int(lengths[0]) if len(lengths) else 0) - 1, -1, -1):
        live = int(np.searchsorted(-lengths, -step, "left"))
        at = starts[:live] + step
        path[at] = state[:live]
        state[:live] = back[at, state[:live]]
    return path


def stretches(texts: list[str], profiles: Profiles) -> list[list[tuple[int, str, float]]]:
    """Per text its one-language stretches: (start position from 1, language, confidence). No letters: no stretch."""
    t = Text(texts)
    n = len(t.begin)
    out: list[list[tuple[int, str, float]]] = [[] for _ in texts]
    if not n:
        return out
    scores = profiles.by_word(t) / max(profiles.unit, 1e-6)
    masked = scores - scores.max(1, keepdims=True)
    # runs of scripts without blanks are several words long
    words = np.where((t.script == HAN) | (t.script == THAI), np.maximum((t.end - t.begin) / 3, 1), 1)
    masked = np.maximum(masked, -WORD_CAP * words[:, None]).astype(np.float32)
    quiet = np.zeros(n, bool)
    for d, text in enumerate(texts):
        for pattern, marks in ((QUOTED, "“„«\"「『"), (ADDRESS, "@＠./")):
            if any(q in text for q in marks):
                lo, hi = np.searchsorted(t.doc, [d, d + 1])
                for m in pattern.finditer(text):
                    if pattern is QUOTED and len(m[0]) > max(60, QUOTED_SHARE * len(text)):
                        continue
                    a, b = t.offset[d] + m.start(), t.offset[d] + m.end()
                    i, j = np.searchsorted(t.begin[lo:hi], [a, b])
                    quiet[lo + i : lo + j] = True
    # a Latin word beside another script is a name there, or the first or last word of its stretch
    latin = t.script == LATIN
    same = np.concatenate([[False], t.doc[1:] == t.doc[:-1]])
    before = same & np.concatenate([[False], ~latin[:-1]])
    after = np.concatenate([same[1:] & ~latin[1:], [False]])
    quiet |= latin & (before | after)
    loud = np.bincount(t.doc, weights=~quiet, minlength=len(texts))
    quiet &= loud[t.doc] >= 3
    masked[quiet] = 0
    price = np.where(t.boundary, BOUNDARY_PRICE, INNER_PRICE).astype(np.float32)
    path = viterbi(masked, price, t.doc)
    change = np.concatenate([[True], (path[1:] != path[:-1]) | (t.doc[1:] != t.doc[:-1])])
    firsts = np.flatnonzero(change)
    sums = np.add.reduceat(scores, firsts, axis=0)
    sizes = np.diff(np.concatenate([firsts, [n]]))
    logits = sums / np.sqrt(sizes)[:, None]
    own = path[firsts]
    z = logits - logits.max(1, keepdims=True)
    conf = np.exp(z)[np.arange(len(firsts)), own] / np.exp(z).sum(1)
    for j, i in enumerate(firsts):
        d = t.doc[i]
        base = t.offset[d]
        if not out[d]:
            out[d].append((1, LANGS[own[j]], float(conf[j])))
            continue
        a, b = t.end[i - 1], t.begin[i]
        gap = t.joined[a:b]
        m = TERMINATOR.search(gap)
        pos = m.end() if m else 0
        while pos < len(gap) and not m and gap[pos] in ".,;:!?…»”“\")]'":
            pos += 1
        m = SKIP.match(gap, pos)
        pos = m.end() if m else pos
        out[d].append((int(a + pos - base) + 1, LANGS[own[j]], float(conf[j])))
    return out


def canonical_label(label: Column) -> Column:
    """The two-letter code a label names, in whatever notation; NULL where it names none of the languages."""
    names = {x: code for code, others in LABELS.items() for x in [code, *others.split()]}
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    low = F.lower(F.translate(F.trim(label), "İI", "ii"))
    return F.coalesce(F.element_at(table, low), F.element_at(table, F.regexp_extract(low, r"^([a-z]{2,3})[-_]", 1)))


def training_rows(df: DataFrame, text: str, label: str) -> tuple[list[str], list[str]]:
    """At most SAMPLE_ROWS labelled rows of a table, by hash: the fit's documented bound."""
    rows = df.select(F.col(text).alias("t"), canonical_label(F.col(label)).alias("l")).where("l IS NOT NULL AND length(t) > 30").withColumn("x", F.xxhash64("t"))
    # one row, that of the least hash, for each of SAMPLE_ROWS buckets: no task sends more than that, whatever the order of the files
    rows = rows.groupBy(F.pmod("x", F.lit(SAMPLE_ROWS)).alias("b")).agg(F.min_by(F.struct("t", "l"), F.struct("x", "t")).alias("r")).select("r.*").orderBy("t").collect()
    return [r.t for r in rows], [r.l for r in rows]


def classify(df: DataFrame, profiles: Profiles, text: str = "value") -> DataFrame:
    """One row per stretch: the other columns of df beside start_pos, lang, confidence, n_stretches, n_words.

    NULL and '' and texts without letters give no row. A row that isn't unique gives its stretches once per copy.
    """
    from guestlens.llm import mojibake

    others = [f for f in df.schema.fields if f.name != text]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in others) + ", start_pos bigint, lang string, confidence double, n_stretches int, n_words int"
    shared = (profiles.prototypes, profiles.unit)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = Profiles(*shared)
        for pdf in batches:
            for k in range(0, len(pdf), SLICE):
                part = pdf.iloc[k : k + SLICE]
                stored = [v if isinstance(v, str) else "" for v in part[text]]
                # texts of mostly plain letters can be told apart as they are
                read = [mojibake.repair(v)[0] if look and len(PLAIN_LETTER.findall(v)) < 0.4 * len(v) else v for v, look in zip(stored, mojibake.worth_a_look(stored))]
                rows, cells = [], []
                for i, (v, r, ss) in enumerate(zip(stored, read, stretches(read, p))):
                    for pos, lang, conf in ss:
                        if r is not v and pos > 1:  # the same word in the text as stored
                            w = len(r[: pos - 1].split())
                            m = re.match(r"(?:\s*\S+){%d}\s*" % w, v)
                            pos = m.end() + 1 if m else pos
                        rows.append(i)
                        cells.append((pos, lang, conf, len(ss), len(v.split())))
                out = part.iloc[rows][[f.name for f in others]].reset_index(drop=True)
                for j, name in enumerate(("start_pos", "lang", "confidence", "n_stretches", "n_words")):
                    out[name] = [c[j] for c in cells]
                yield out

    return df.where(F.length(text) > 0).mapInPandas(run, schema)


#: Languages written without blanks between words.
UNSPACED = ("zh", "ja", "th")


def found_labels(stretch_rows: DataFrame, label: str = "language") -> DataFrame:
    """The stretches of mixed texts, and the texts in one language whose label is missing or wrong."""
    long_enough = (F.col("n_words") >= 5) | F.col("lang").isin(*UNSPACED)
    mixed = F.col("n_stretches") > 1
    return stretch_rows.where((mixed | ~canonical_label(F.col(label)).eqNullSafe(F.col("lang"))) & (long_enough | mixed))


def fitted(tables: list[tuple[DataFrame, str, str]]) -> Profiles:
    texts, labels = [], []
    for df, text, label in tables:
        t, lab = training_rows(df, text, label)
        texts += t
        labels += lab
    return fit(texts, labels)
