"""Personal data in free text by a semi-Markov conditional random field.

Candidate segments (bounded in length, one kind each) are scored as wholes: shape, check digits, cue words on either side,
gazetteers, what the span covers. The best set of segments that don't overlap is found by dynamic programming over
candidate ends, boundaries and kinds together; everything between has score 0. Weights are fitted by maximum conditional
likelihood (forward and backward sums over the same lattice) on sentences composed in pii_train; given names come from all
guest names.
"""

from __future__ import annotations

import json
import math
import os
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_NAMES = 1_000_000  # different names that are broadcast, at most
MIN_NAME_ROWS = 1  # rows that make a word a given name
KINDS = ("EMAIL", "PHONE", "ID_NUMBER", "ADDRESS", "NAME")
WEIGHTS = os.path.join(os.path.dirname(__file__), "pii_weights.json")

# Cue words by what they announce.
CUES = {
    "phone": "tel telefon phone call number whatsapp numara numarasından hattındayım üzerinden ara arayın rang erreichen anrufen handy mobil téléphone appelez rappelé teléfono llámame llamó móvil звоните номеру тел телефон cell mobile reach ring gsm cep",
    "id": "passport pasaport kimlik tc ausweis pass passnummer personalausweis ausweisnummer reisepass reisepassnummer pass-nr ausweis-nr passeport documento dni nie паспорт инн ssn insurance sozialversicherung belgem belge kayıtta identity identität versicherung identité pasaporte national снилс id nino",
    "code": "voucher booking reservation rezervasyon kodumuz kod code kodu buchung gutschein réservation reserva бронь ref reference fiş fişte fatura invoice bon réf factura bono ваучер order sipariş buchungsnummer room oda zimmer номере room table",
    "address": "adres adresim adresimiz adresine yer address anschrift adresse dirección адрес адресу live lives jacket jacke kapısına eşyamı valizi chaqueta куртку wohne habite vivo живу send post schicken envoyer",
    "person": "barmen bartender waiter waitress manager müdür resepsiyondaki özellikle temizleyen odamızı garson kellner kellnerin frau herr herrn mme m madame monsieur serveur serveuse señora señor sr sra camarero администратор официант сотруднице сотруднику mr mrs ms miss named chef receptionist director руководитель hanım bey",
    "person_after": "bey hanım bey'e hanım'a bey'in from at vom von am de half nous nos was fue fue never nos helped помог помогла со был была bize her çok a war est était",
    "venue": "bar barı barındaki restoran restoranı restoranında restaurant restoranındaki bahçesi bahçesinde terası terasının sahnesi sahnesindeki iskelesi iskelesindeki garden terrace pier stage hotel otel resort palace suites spa beach caddesi sokak mah mahallesi cad sok garten terrasse steg bühne straße weg allee jardin ponton scène terraza muelle escenario jardín сцене причала террасы саду бара ресторан restoranı",
    "venue_before": "bar restaurant restoran garten steg bühne jardin terrasse ponton scène terraza muelle escenario jardín bara сцене причала террасы саду бара ресторан the le la el il das die der hotel",
    "title": "dr prof mr mrs ms miss bey hanım frau herr mme monsieur madame señor señora sr sra doç г барmen barmen",
    "placeholder": "guest user traveler traveller anonymous anonim misafir gast family booking google gezgin visitor reviewer customer müşteri kunde client hôte huésped гость family of four google tripadvisor member",
}
CUES = {k: frozenset(v.split()) for k, v in CUES.items()}

DIGIT = "0-9٠-٩"
MAIL = re.compile(
    r"[\w.+\-]{1,64} ?[@＠] ?[\w\-]+(?:\.[\w\-]+)+"
    r"|[\w.+\-]{2,64} ?(?:\(at\)|\[at\]|\{at\}) ?[\w\-]+(?: ?(?:\.|\(dot\)|\[dot\]|\{dot\}| dot ) ?[\w\-]+)+"
    r"|[\w.+\-]{2,64} at (?!www)[\w\-]+(?: ?(?:\.|\(dot\)|\[dot\]| dot ) ?[\w\-]+)*?(?: ?(?:\.|\(dot\)|\[dot\]| dot ) ?(?:com|net|org|co|example|test|invalid|de|tr|ru|fr|es|uk))+\b"
)
NUMBER = re.compile(rf"(?<![\w@.])(?:[A-Z]{{1,2}}[ -]?)?[+(]?[{DIGIT}](?:[{DIGIT}]|[ ().\-/]{{1,2}}(?=[({DIGIT}])|\)(?= ?[{DIGIT}]))*[{DIGIT}](?:[ -]?[A-Z])?(?!\w)")
# letters and digits in any order, in up to four groups
MIXED = re.compile(r"(?<![\w@.＠])(?:[A-Z0-9]{2,16}(?:[ -](?=[A-Z]*\d)[A-Z0-9]{1,9}){0,3}|[a-z0-9]{6,16})(?![\w@＠])")
TR_CITY = r"(?:,? ?[A-ZÇĞİÖŞÜ][a-zçğıöşü]+)?"
ADDRESSES = [
    re.compile(r"(?:[A-ZÇĞİÖŞÜ][\w]+ [Mm]ah(?:allesi|\.)?,? )?(?:[A-ZÇĞİÖŞÜ0-9][\w.]+ ){1,2}?(?:[Cc]ad(?:desi|\.)?|[Ss]ok(?:ak|ağı|\.)?|[Bb]ulvar[ıi]|[Cc]d\.|[Ss]k\.),? ?(?:[Nn]o ?[:.]? ?\d+\w?)(?:[ ,/]*(?:D|Daire|Kat|K)[:.]? ?\d+)*" + TR_CITY),
    re.compile(r"[A-ZÇĞİÖŞÜ]\w+ [Mm]ah(?:allesi|\.)?,? [^.!?\n]{0,40}?[Nn]o ?[:.]? ?\d+\w?(?:[ ,/]*(?:D|Daire|Kat|K)[:.]? ?\d+)*" + TR_CITY),
    re.compile(r"[A-ZÄÖÜ][\wäöüß\-]*(?:straße|strasse|str\.|weg|allee|platz|gasse|ufer|ring) \d+ ?[a-z]?(?:,| in)? \d{5} [A-ZÄÖÜ][\wäöüß]+"),
    re.compile(r"\d+(?: ?bis| ?ter)?,? (?:rue|avenue|boulevard|bd|place|impasse|chemin|allée|quai|cours)(?: (?:de|du|des|la|le))* [\wÀ-ÿ'\-]+(?: [A-ZÀ-Þ][\wÀ-ÿ'\-]+)?,? \d{5} [A-ZÀ-Þ][\wÀ-ÿ\-]+"),
    re.compile(r"(?:[Cc]alle|[Cc]/|[Aa]venida|[Aa]vda\.|[Pp]laza|[Pp]aseo|[Cc]amino)(?: (?:de|del|la))* [\wÀ-ÿ]+(?: [A-ZÀ-Þ][\wÀ-ÿ]+)?,? (?:n\.?º ?)?\d+(?:[ ,]+\d+ ?\.?[ºª°]? ?[A-Z]?)?,? ?\d{5} [A-ZÀ-Þ][\wÀ-ÿ]+"),
    re.compile(r"\d+[A-Za-z]? [A-Z]\w+(?: [A-Z]\w+)? (?:Street|Road|Lane|Avenue|Close|Drive|Way|Court|Square|St|Rd|Ave)\b\.?(?:, ?(?:Flat|Apt|Apartment|Unit|Suite)\.? ?\w+)?(?:, ?[A-Z]\w+)?(?: [A-Z]{1,2}\d[\dA-Z]? ?\d[A-Z]{2})?"),
    re.compile(r"(?:г\. ?[А-ЯЁ]\w+, ?)?(?:ул\.?|улица|проспект|пр-т|пр\.|переулок|пер\.|бульвар) ?[А-ЯЁ]\w+,? ?(?:д\.? ?)?\d+(?:[-/]\d+)?(?:,? ?кв\.? ?\d+)?(?:, ?[А-ЯЁ]\w+)?"),
    re.compile(r"(?:[A-ZÇĞİÖŞÜ][\w]+ [Mm]ah(?:allesi|\.)?,? )?(?:[A-ZÇĞİÖŞÜ0-9][\w.]+ ){1,2}?(?:[Cc]ad(?:desi|\.)?|[Ss]ok(?:ak|ağı|\.)?|[Bb]ulvar[ıi]|[Cc]d\.|[Ss]k\.),? ?\d+(?: ?[/\-] ?\d+)?[A-Za-z]?\b(?:[ ,/]*(?:D|Daire|Kat|K)[:.]? ?\d+)*" + TR_CITY),
]
TURKISH = (0, 1, 7)  # the places of the patterns that may take in the word before a street's name
WORD = re.compile(r"(?:[^\W\d_]|[\u0300-\u036f])+(?:['’\-][^\W\d_]+)*\.?")
SPAN_LEFT, SPAN_RIGHT = 46, 34
LIMIT = 6  # tokens of a name at most


def fold(w: str) -> str:
    return w.replace("İ", "i").replace("I", "ı" if any(c in "çğışöüÇĞİŞÖÜ" for c in w) else "i").lower().strip(".")


def cue(words: list[str], kind: str) -> bool:
    return any(w in CUES[kind] for w in words)


def near(text: str, a: int, b: int) -> tuple[list[str], list[str]]:
    left = [fold(m[0]) for m in WORD.finditer(text[max(0, a - SPAN_LEFT) : a])][-5:]
    right = [fold(m[0]) for m in WORD.finditer(text[b : b + SPAN_RIGHT])][:4]
    cut = max(text.rfind(c, max(0, a - SPAN_LEFT), a) for c in "!?\n")
    if cut >= 0:
        left = [fold(m[0]) for m in WORD.finditer(text[cut:a])][-5:]
    return left, right


def national_id(digits: str) -> bool:
    """Check digits of an eleven-digit national number: the tenth from the odd and even places, the eleventh from all."""
    if len(digits) != 11 or digits[0] == "0":
        return False
    d = [int(c) for c in digits]
    return (7 * sum(d[0:9:2]) - sum(d[1:8:2])) % 10 == d[9] and sum(d[:10]) % 10 == d[10]


class Gazetteer:
    def __init__(self, given: set[str], family: set[str]) -> None:
        self.given, self.family = given, family

    @staticmethod
    def parts(name: str | None) -> tuple[str, str] | None:
        """Folded given and family name of a guest name of two words and no sign of damage."""
        parts = WORD.findall(name) if name else []
        if len(parts) != 2 or not all(c.isalpha() or c in " ,.'’-" or "\u0300" <= c <= "\u036f" for c in name) or any(fold(p) in CUES["placeholder"] for p in parts):
            return None
        a, b = (parts[1], parts[0]) if "," in name else (parts[0], parts[1])
        return fold(a), fold(b)

    @staticmethod
    def of_counts(first: dict[str, int], last: dict[str, int]) -> Gazetteer:
        return Gazetteer({w for w, n in first.items() if n >= MIN_NAME_ROWS and len(w) > 1}, {w for w in last if len(w) > 2})

    @staticmethod
    def read(names: list[str]) -> Gazetteer:
        found = [p for n in names if (p := Gazetteer.parts(n))]
        return Gazetteer.of_counts(Counter(a for a, _ in found), Counter(b for _, b in found))


Candidate = tuple[int, int, str, tuple[str, ...]]


def number_candidates(text: str) -> Iterator[Candidate]:
    for m in NUMBER.finditer(text):
        raw = m[0]
        ascii_raw = raw.translate(str.maketrans("٠١٢٣٤٥٦٧٨٩", "0123456789"))
        digits = re.sub(r"\D", "", ascii_raw)
        if not 6 <= len(digits) <= 15:
            continue
        a, b = m.span()
        left, right = near(text, a, b)
        letters = re.sub(r"[^A-Z]", "", ascii_raw)
        groups = "-".join(str(len(g)) for g in re.findall(r"\d+", ascii_raw))
        shape = "plus" if "+" in raw else "00" if digits.startswith("00") else "0" if digits.startswith("0") else "9"
        f = [f"n{len(digits)}", f"s:{shape}", f"g:{groups}", f"L{len(letters)}{'p' if letters and ascii_raw[0].isalpha() else 's' if letters else ''}", f"s:{shape}:n{len(digits)}"]
        f += ["paren"] * ("(" in raw) + ["dot"] * ("." in raw) + ["dash"] * ("-" in raw) + ["slash"] * ("/" in raw) + ["arabic"] * (ascii_raw != raw) + ["check"] * national_id(digits)
        if re.fullmatch(r"\d{1,2}[./]\d{1,2}[./]\d{2,4}(?: \d{1,2}.?)?.*", ascii_raw) and len(digits) <= 12 and ("." in raw or "/" in raw) and not raw.startswith("0("):
            f.append("date")
        for k in ("phone", "id", "code", "address"):
            f += [f"l:{k}"] * cue(left, k) + [f"r:{k}"] * cue(right, k)
        if not any(x[:2] in ("l:", "r:") for x in f):
            f.append("nocue")
        if a == 0 and b == len(text):
            f.append("whole")
        yield a, b, "PHONE", tuple(f)
        yield a, b, "ID_NUMBER", tuple(f)


def mixed_candidates(text: str) -> Iterator[Candidate]:
    """Identifiers whose letters and digits alternate, which NUMBER doesn't take."""
    for m in MIXED.finditer(text):
        raw = m[0]
        digits, letters = sum(c.isdigit() for c in raw), sum(c.isalpha() for c in raw)
        if not (letters and digits >= 3 and 6 <= digits + letters <= 20) or NUMBER.fullmatch(text, *m.span()):
            continue
        a, b = m.span()
        left, right = near(text, a, b)
        f = ["mixed", f"m:n{digits + letters}", f"m:L{min(letters, 5)}", f"m:{'d' if raw[0].isdigit() else 'l'}{'d' if raw[-1].isdigit() else 'l'}"]
        f += ["m:low"] * any(c.islower() for c in raw) + ["m:groups"] * (" " in raw or "-" in raw)
        for k in ("phone", "id", "code", "address"):
            f += [f"l:{k}", f"m:l:{k}"] * cue(left, k) + [f"r:{k}"] * cue(right, k)
        # of several cues on the left the nearest counts most: others may belong to the sentence before
        f += next(([f"m:near:{k}"] for w in reversed(left) for k in ("id", "code", "phone", "address") if w in CUES[k]), [])
        if not any(x[:2] in ("l:", "r:") for x in f):
            f += ["nocue", "m:nocue"]
        yield a, b, "ID_NUMBER", tuple(f)


def name_candidates(text: str, field: str, gaz: Gazetteer) -> Iterator[Candidate]:
    words = list(WORD.finditer(text))
    low = [fold(w[0]) for w in words]
    n = len(words)
    for i in range(n):
        w = words[i][0]
        if low[i] in CUES["placeholder"] or low[i] in CUES["title"]:
            continue
        in_given, in_family = low[i] in gaz.given, low[i] in gaz.family
        capital = not w[0].islower()
        guest = field == "guest_name"
        cued = i > 0 and low[i - 1] in CUES["person"] and text[words[i - 1].end() : words[i].start()] in (" ", ", ")
        if not (in_given or guest or capital and (cued or in_family and i + 1 < n and low[i + 1] in gaz.given)):
            continue
        if not capital and not guest and not cued:
            continue
        for j in range(i, min(n, i + LIMIT)):
            if j > i:
                gap = text[words[j - 1].end() : words[j].start()]
                if not (gap == " " or gap in (", ", ",") and guest) or words[j - 1][0].endswith(".") and len(words[j - 1][0]) > 3:
                    break
            a, b = words[i].start(), words[j].end()
            k = j - i + 1
            span = low[i : j + 1]
            following = low[j + 1] if j + 1 < n else ""
            close = j + 1 < n and text[b : words[j + 1].start()] == " "
            f = [f"k{min(k, 4)}", f"field:{field}"]
            f += ["given"] * in_given + ["given2"] * (k > 1 and span[1] in gaz.given) + ["family"] * (span[-1] in gaz.family) + ["family1"] * in_family
            f += ["caps"] * all(not x[0][0].islower() for x in words[i : j + 1]) + ["low"] * (not capital)
            f += ["l:person"] * cued + ["r:person"] * (following in CUES["person_after"]) + ["l:title"] * (i > 0 and low[i - 1] in CUES["title"])
            f += ["in:title"] * any(x in CUES["title"] for x in span[1:]) + ["in:venue"] * any(x in CUES["venue"] for x in span) + ["in:placeholder"] * any(x in CUES["placeholder"] for x in span)
            f += ["r:venue"] * (following in CUES["venue"]) + ["l:venue"] * (i > 0 and low[i - 1] in CUES["venue_before"] and not cued)
            if close and not words[j + 1][0][0].islower() and following not in CUES["title"]:
                f.append("more" if following not in gaz.family else "morefamily")
            if i > 0 and text[words[i - 1].end() : a] == " " and not words[i - 1][0][0].islower() and low[i - 1] not in CUES["person"] and low[i - 1] not in CUES["title"]:
                f.append("before" if low[i - 1] not in gaz.given else "beforegiven")
            f += ["whole"] * (text[:a].strip(" .") == "" and text[b:].strip(" .") == "") + ["comma"] * ("," in text[a:b]) + ["allknown"] * (in_given and k == 2 and span[1] in gaz.family)
            f += ["inmail"] * (a > 0 and text[a - 1] in "@._+＠" or text[b : b + 1] in "@_+＠" or text[b : b + 1].isdigit() or b < len(text) and text[b - 1] == "." and text[b : b + 1].isalnum())
            if guest:
                f += ["at0"] * (a == 0) + ["sep"] * bool(re.match(r"\s*[-/,]\s", text[b:])) + ["aftertitle"] * (i > 0 and low[i - 1] in CUES["title"])
            yield a, b, "NAME", tuple(f)


def candidates(text: str, field: str, gaz: Gazetteer) -> list[Candidate]:
    out: list[Candidate] = []
    if "@" in text or "＠" in text or "at" in text and re.search(r"\bat\b", text):
        for m in MAIL.finditer(text):
            a, b = m.span()
            f = ["bias"] + ["sign"] * ("@" in m[0] or "＠" in m[0]) + ["spaced"] * (" " in m[0]) + ["tld"] * bool(re.search(r"(?:example|test|invalid|com|net|org|[a-z]{2})$", m[0], re.I)) + ["bracket"] * ("(" in m[0] or "[" in m[0])
            out.append((a, b, "EMAIL", tuple(f)))
    if any(c.isdigit() for c in text):
        out += number_candidates(text)
        out += mixed_candidates(text)
        for k, p in enumerate(ADDRESSES):
            for m in p.finditer(text):
                a, b = m.span()
                left, right = near(text, a, b)
                starts = [a]
                # a street pattern may take in the word before the name of the street
                first = re.match(r"[^\W\d_]+ ", m[0])
                if first and k in TURKISH:
                    starts.append(a + len(first[0]))
                for s in starts:
                    l2, _ = near(text, s, b)
                    f = [f"p{k}", f"parts{min(4, len(re.findall(r'\d+', text[s:b])))}"] + ["l:address"] * cue(left, "address") + ["r:address"] * cue(right, "address") + ["short"] * (s > a) + ["no:mah"] * (k == 7 and " mah" not in text[s:b].lower()) + ["slash"] * (k == 7 and "/" in text[s:b]) + ["first:cue"] * (fold(text[s:b].split(" ")[0]) in CUES["address"] or text[s:b].split(" ")[0][:1].islower()) + ["after:cue"] * (bool(l2) and l2[-1] in CUES["address"])
                    out.append((s, b, "ADDRESS", tuple(f)))
    out += name_candidates(text, field, gaz)
    return out


class Model:
    def __init__(self, weights: dict[str, float], gaz: Gazetteer) -> None:
        self.weights, self.gaz = weights, gaz

    def score(self, c: Candidate) -> float:
        w, kind = self.weights, c[2]
        return w.get(kind, 0.0) + sum(w.get(f"{kind}|{f}", 0.0) for f in c[3])

    def best(self, text: str, field: str) -> list[tuple[int, int, str]]:
        """The segments of highest total score that don't overlap."""
        cs = sorted(candidates(text, field, self.gaz), key=lambda c: (c[1], c[0]))
        cs = [(c, s) for c in cs if (s := self.score(c)) > 0]
        if not cs:
            return []
        ends = [c[1] for c, _ in cs]
        top: list[tuple[float, tuple | None]] = [(0.0, None)]
        for i, (c, s) in enumerate(cs):
            j = i
            while j > 0 and ends[j - 1] > c[0]:
                j -= 1
            value = top[j][0] + s
            top.append((value, (i, j)) if value > top[i][0] else (top[i][0], None))
        out, i = [], len(cs)
        while i > 0:
            if top[i][1] is None:
                i -= 1
            else:
                k, i = top[i][1]
                c = cs[k][0]
                out.append((c[0], c[1], c[2]))
        return out[::-1]


def fit(examples: list[tuple[str, str, list[tuple[int, int, str]]]], gaz: Gazetteer, rounds: int = 25, rate: float = 0.3, decay: float = 1e-3) -> dict[str, float]:
    """Weights of highest conditional likelihood, by stochastic gradient: observed minus expected features."""
    weights: dict[str, float] = {}
    model = Model(weights, gaz)
    prepared = []
    for text, field, gold in examples:
        cs = sorted(candidates(text, field, gaz), key=lambda c: (c[1], c[0]))
        truth = set(gold)
        before = []
        for i, c in enumerate(cs):
            j = i
            while j > 0 and cs[j - 1][1] > c[0]:
                j -= 1
            before.append(j)
        prepared.append((cs, before, [(c[0], c[1], c[2]) in truth for c in cs]))
    for r in range(rounds):
        step = rate / (1 + r / 5)
        for cs, before, gold in prepared:
            n = len(cs)
            s = [model.score(c) for c in cs]
            alpha = [0.0] * (n + 1)  # log sums over sets of segments among the first i
            for i in range(n):
                a, b = alpha[i], alpha[before[i]] + s[i]
                m = max(a, b)
                alpha[i + 1] = m + math.log(math.exp(a - m) + math.exp(b - m))
            grad = [0.0] * (n + 1)
            grad[n] = 1.0
            for i in range(n - 1, -1, -1):
                p = math.exp(alpha[before[i]] + s[i] - alpha[i + 1]) * grad[i + 1]
                grad[i] += grad[i + 1] - p
                grad[before[i]] += p
                delta = step * ((1.0 if gold[i] else 0.0) - p)
                if abs(delta) > 1e-4:
                    kind = cs[i][2]
                    for k in (kind, *(f"{kind}|{f}" for f in cs[i][3])):
                        weights[k] = weights.get(k, 0.0) * (1 - decay * step) + delta
    return {k: round(v, 4) for k, v in weights.items() if abs(v) > 1e-3}


def load_weights(path: str = WEIGHTS) -> dict[str, float]:
    with open(path) as f:
        return json.load(f)


def spans_of(text: str, field: str, model: Model) -> list[tuple[int, int, str]]:
    """Segments with places in the text as stored; a damaged guest name is read as repaired and its words matched."""
    from guestlens.llm import mojibake

    if field == "guest_name" and mojibake.worth_a_look([text])[0]:
        read = mojibake.repair(text)[0]
        letters = re.sub("�", "e", read)
        words, read_words = [m.span() for m in re.finditer(r"[^ ]+", text)], [m.span() for m in re.finditer(r"[^ ]+", letters)]  # (damage may look like other white space)
        if len(words) == len(read_words):
            at = {a: words[k] for k, (a, b) in enumerate(read_words)}
            ends = {b: words[k] for k, (a, b) in enumerate(read_words)}
            return [(at[a][0] if a in at else a, ends[b][1] if b in ends else min(b, len(text)), k) for a, b, k in model.best(letters, field)]
    return model.best(text, field)


def redacted(text: str, spans: list[tuple[int, int, str]]) -> str:
    parts, at = [], 0
    for a, b, kind in spans:
        parts += [text[at:a], f"[{kind}]"]
        at = b
    return "".join(parts) + text[at:]


def gazetteer(reviews: DataFrame, column: str = "guest_name") -> Gazetteer:
    """Given and family names counted over all rows. What is collected is at most MAX_NAMES names, or the job fails."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [(n, *p) for v, n in zip(pdf["v"], pdf["n"]) if (p := Gazetteer.parts(v))]
            yield pd.DataFrame([(w, k, n) for n, *p in found for k, w in enumerate(p)], columns=["word", "kind", "n"]).astype({"kind": "int32", "n": "int64"})

    values = reviews.select(F.col(column).alias("v")).where(F.length(column) > 2).groupBy("v").agg(F.count("*").alias("n"))
    names = values.mapInPandas(run, "word string, kind int, n bigint").groupBy("word", "kind").agg(F.sum("n").alias("n"))
    names = names.where(((F.col("kind") == 0) & (F.col("n") >= MIN_NAME_ROWS) & (F.length("word") > 1)) | ((F.col("kind") == 1) & (F.length("word") > 2)))
    rows = names.limit(MAX_NAMES + 1).collect()
    if len(rows) > MAX_NAMES:
        raise ValueError(f"more than {MAX_NAMES} different names: too many to broadcast")
    return Gazetteer.of_counts({r.word: r.n for r in rows if r.kind == 0}, {r.word: r.n for r in rows if r.kind == 1})


def annotate(values: DataFrame, gaz: Gazetteer) -> DataFrame:
    """Adds `spans` (start_pos from 1, end_pos, pii_kind) and `redacted` to rows with field_name and value.

    NULL and '' have no spans and come back as they are; a value that occurs twice is treated twice.
    """
    weights, names = load_weights(), (gaz.given, gaz.family)
    span = T.StructType([T.StructField("start_pos", T.LongType()), T.StructField("end_pos", T.LongType()), T.StructField("pii_kind", T.StringType())])
    schema = T.StructType([*values.schema.fields, T.StructField("spans", T.ArrayType(span)), T.StructField("redacted", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Model(weights, Gazetteer(*names))
        for pdf in batches:
            found, clean = [], []
            for v, f in zip(pdf["value"], pdf["field_name"]):
                s = spans_of(v, f, model) if isinstance(v, str) and v else []
                found.append([{"start_pos": a + 1, "end_pos": b, "pii_kind": k} for a, b, k in s])
                clean.append(redacted(v, s) if s else v)
            yield pdf.assign(spans=found, redacted=clean)

    return values.mapInPandas(run, schema)
