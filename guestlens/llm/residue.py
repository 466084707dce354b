"""Template residue, filler, error pages and scripts-required notices instead of content.

Character 4-gram models are fitted for filler, error notices, script notices, page furniture and placeholders (on phrases
written here and the documents they lead to) and for natural prose; all documents' 4-grams are counted. Over every whole text the log likelihood ratio of each model against prose is averaged in windows; characters in windows that favour
a residue model are residue. A document goes when residue covers most of it, furniture aside. Placeholders are localised
by their own windows; an exact pattern then decides inside them.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from guestlens.llm.language import tables

CORPUS_MASS = 200_000  # 4-grams that a kind's documents in the corpus weigh, at most
BITS = 18
GRAM = 4
MARK_LENGTH = 46  # characters of the longest placeholder
WINDOW, MARK_WINDOW = 24, 10  # characters of a window, and of one for placeholders
LEVEL = 0.25  # mean log likelihood ratio from which a window is residue
COVERAGE = 0.5
CLASSES = ("filler", "error", "script", "furniture", "mark")

# Phrases of the residue kinds, by kind, as web servers, frameworks and editors commonly word them; | separates alternatives.
FILLER = """lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua
ut enim ad minim veniam quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat duis aute irure dolor
in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident
sunt in culpa qui officia deserunt mollit anim id est laborum|sed ut perspiciatis unde omnis iste natus error sit voluptatem|vestibulum ante ipsum primis in faucibus orci luctus et ultrices posuere cubilia curae massa urna porta sem felis
xxxx xxxxx xxx xxxxxx xx|zzzz zzz zz zzzzz|asdf asdf qwerty qwer|asdfasdf jkl jkl|test test test|testing 1 2 3 test text test text|foo bar baz foo bar|aaaa bbbb cccc|abc abc abc|tbd|todo|n/a n/a n/a
TODO: add copy|TODO: write this section|TBD: to be supplied by marketing|TBC, text pending|FIXME: replace this dummy text|[insert text here]|insert your text here|enter a description here|Add your content here.|Click to add text|Type something here|Your content goes here. Edit or remove this text inline.|This is some sample text.|This is a placeholder paragraph.|Dummy text, to be replaced before launch.|Text to follow.|Description to be added later.|Write your introduction here.|First paragraph goes here.|Heading goes here|More text to come.|Replace this with your own text.
Metin buraya gelecek.|Buraya metin yazın.|Bu bölüme metin eklenecek.|Yazı daha sonra eklenecektir.|Örnek metin, değiştiriniz.|İçerik hazırlanıyor, lütfen doldurunuz.|Buraya başlık gelecek.
Hier steht Ihr Text.|Bitte Text einfügen.|Hier Text einsetzen.|Platzhalter für einen Text.|Dies ist ein Blindtext.|Beispieltext, wird noch ersetzt.|Text folgt.
Insérez votre texte ici.|Votre texte ici.|Texte à compléter.|Texte de remplissage provisoire.|À remplir.|Introduzca aquí el texto.|Su texto aquí.|Texto de relleno.|Texto pendiente.|Rellenar más tarde.
Введите текст здесь.|Здесь должен быть текст.|Текст будет добавлен позже.|Пример текста, заменить.|Заполнить описание.|Inserire qui il testo.|Testo segnaposto.|Voer hier uw tekst in.|Voorbeeldtekst""".split("\n")
ERROR = """404 Not Found|404 Page Not Found|Error 404|HTTP Error 404|500 Internal Server Error|HTTP ERROR 500|502 Bad Gateway nginx|503 Service Temporarily Unavailable|504 Gateway Timeout|403 Forbidden|400 Bad Request|401 Unauthorized|408 Request Timeout|429 Too Many Requests
The requested URL was not found on this server.|We can't find the page you're looking for.|Sorry, this page isn't available.|The page may have been moved, renamed or deleted.|This page does not exist or is no longer available.|No results: the requested resource could not be found.|The link you followed may be broken.|Return to the home page.
Something went wrong. Please try again later.|Oops, an error has occurred.|An unexpected error occurred.|The server encountered an internal error and was unable to complete your request.|The server encountered an unexpected condition that prevented it from fulfilling the request.|Your request could not be processed.|Error reference number: 12345|Request ID: 12345
The server is temporarily unable to service your request due to maintenance downtime or capacity problems. Please try again later.|We are currently undergoing scheduled maintenance. Please check back in a few minutes.|Service is overloaded, please retry.|The site is temporarily unavailable.
Access denied. You don't have permission to access this resource.|You are not authorized to view this page.|You do not have permission to view this directory.|Checking your browser before accessing the site.|Please verify you are a human by completing the captcha.|Our systems have detected unusual traffic from your network.|Prove that you are not a robot to proceed.|Rate limit exceeded, slow down your requests.|Ray ID: 12345
Traceback (most recent call last): File "app.py", line 123|KeyError: 'id'|TypeError: cannot read property of undefined|Uncaught exception|Unhandled exception at System.Web.UI.Page.Load()|NullPointerException at com.example.Main.run(Main.java:123)|System.NullReferenceException: Object reference not set to an instance of an object|Fatal error: Call to undefined function in index.php on line 12|Warning: Undefined variable in page.php on line 12|Notice: Undefined index
Error establishing a database connection|SQLSTATE[HY000] connection refused|could not connect to database server: connection timed out|MySQL server has gone away|Deadlock found when trying to get lock|ORA-12541: no listener|Connection refused|Connection timed out after 123 ms|upstream timed out
{"error":{"code":404,"message":"Not Found"}}|{"status":500,"error":"Internal Server Error","path":"/api/12"}|{"message":"Forbidden"}
Sayfa bulunamadı.|Hata 404: aradığınız sayfa mevcut değil.|Sunucuda bir hata oluştu. Lütfen daha sonra tekrar deneyiniz.|Beklenmeyen bir hata meydana geldi.|İsteğiniz işlenemedi. Hata kodu: 500|Bu sayfaya erişim izniniz yok.|Site bakımdadır, lütfen daha sonra tekrar deneyin.|Aradığınız sayfa silinmiş veya taşınmış olabilir.
Seite nicht gefunden. Fehler 404|Die angeforderte Seite existiert nicht.|Die Seite konnte nicht gefunden werden.|Es ist ein Fehler aufgetreten. Bitte versuchen Sie es später noch einmal.|Interner Serverfehler|Zugriff verweigert.|Der Dienst ist vorübergehend nicht verfügbar.|Fehlercode 500
Page introuvable. Erreur 404|La page demandée n'existe pas.|La page que vous recherchez est introuvable.|Une erreur s'est produite. Veuillez réessayer ultérieurement.|Erreur interne du serveur|Accès refusé.|Service indisponible.
Página no encontrada. Error 404|La página solicitada no existe.|Lo sentimos, esta página ya no está disponible.|Se ha producido un error. Vuelva a intentarlo más tarde.|No se pudo completar la solicitud.|Error interno del servidor|Acceso denegado.
Страница не найдена. Ошибка 404|Запрошенная страница не существует.|Страница была удалена или перемещена.|Произошла ошибка. Повторите попытку позже.|Внутренняя ошибка сервера|Доступ запрещён.|Сервис временно недоступен.|Вернуться на главную|Pagina non trovata. Errore 404.|Si è verificato un errore.|Pagina niet gevonden.|Er is een fout opgetreden.""".split("\n")
SCRIPT = """You need to enable JavaScript to run this app.|Please enable JavaScript to view this page.|JavaScript is disabled in your browser.|JavaScript is required to use this site.|JavaScript must be enabled in order for you to see this content.|We're sorry but this site doesn't work properly without JavaScript enabled. Please enable it to continue.|It looks like scripts are turned off; the reviews could not be loaded.|Enable scripts and reload the page to see the calendar, map or form.|To use the booking form, allow scripts to run in your browser settings.|This application requires client side scripting to work.|Your browser does not support JavaScript!|Your browser is blocking scripts, so the comments cannot be displayed.|Please turn on JavaScript and try again.|Activate JS to load the widget
<noscript>Please enable JavaScript</noscript>|<noscript>Your browser does not support scripts.</noscript>|<noscript>You need to enable JavaScript to run this app.</noscript>
Bu sayfayı görüntülemek için lütfen JavaScript'i etkinleştirin.|Tarayıcınızda JavaScript devre dışı.|Bu site JavaScript olmadan çalışmaz.|Devam etmek için tarayıcı ayarlarından betiklere izin verin.|İçerik yüklenemedi: tarayıcınız betikleri engelliyor. Sayfayı yenileyip tekrar deneyin.|Formu kullanmak için JavaScript açık olmalıdır.
Bitte aktivieren Sie JavaScript in Ihrem Browser.|JavaScript ist deaktiviert.|Diese Seite benötigt JavaScript.|Ohne JavaScript kann diese Seite nicht angezeigt werden.|Bitte erlauben Sie Skripte und laden Sie die Seite neu.|Zum Anzeigen der Bewertungen müssen Skripte eingeschaltet sein.
Veuillez activer JavaScript dans votre navigateur.|JavaScript est désactivé.|Ce site a besoin de JavaScript pour fonctionner.|Sans scripts, cette page ne peut pas s'afficher. Merci de les autoriser.|JavaScript está desactivado.|Habilite JavaScript en su navegador.|Este sitio necesita JavaScript para funcionar.|Permita los scripts y vuelva a cargar la página.
Включите JavaScript, чтобы просмотреть страницу.|JavaScript отключён в вашем браузере.|Сайт не работает без JavaScript.|Разрешите выполнение скриптов и обновите страницу.|Abilita JavaScript nel browser.|Schakel JavaScript in uw browser in.""".split("\n")
FURNITURE = """Home | About | Contact|Home | Rooms | Spa | Contact|Back to top|Skip to content|Privacy policy|Terms of use|Loading...|Please wait...|All rights reserved|Accept all cookies|Manage cookies|Share | Print|Log in | Register|Menu|Search|Subscribe to our newsletter|Follow us|© 2026|Ref 1234
Ana Sayfa | Odalar | İletişim|Anasayfa > Otel > Odalar|Her hakkı saklıdır|Çerez ayarları|Giriş yap|Yukarı çık|Startseite | Zimmer | Kontakt|Impressum Datenschutz|Zurück nach oben|Alle Rechte vorbehalten|Menü Zimmer Anfragen|Accueil | Chambres | Contact|Tous droits réservés|Inicio | Habitaciones | Contacto|Todos los derechos reservados|Главная | Номера | Контакты|Все права защищены""".split("\n")
# The ways of writing a placeholder, @ standing for the field's name, and names of fields.
MARKS = ["{{ @ }}", "{{@}}", "{@}", "[[@]]", "[@]", "<<@>>", "<%= @ %>", "%%@%%", "*|@|*", "${@}", "__@__", "#@#", "%@%", "<@>", "&lt;@&gt;", "@@@@"]
FIELDS = "guest_name first_name FIRST_NAME REVIEW_DATE room_no check_in agent.signature hotelAdi misafir datum nom_client NAME HOTEL user.name booking_id city date".split()

#: What is a placeholder for certain, once a window points there.
EXACT = re.compile(
    r"\{\{\s*[\w.]{2,40}\s*\}\}|\$\{\s*[\w.]{2,40}\s*\}|\[\[\s*[\w. ]{2,40}\s*\]\]|<<\s*[\w.]{2,40}\s*>>|<%=?\s*[\w.]{2,40}\s*%>|%%\s*[\w.]{2,40}\s*%%|\*\|\s*[\w.]{2,40}\s*\|\*|(?<!\w)__[\w.]{2,40}__(?!\w)|(?<![\w#])#[A-Za-z][\w.]{1,40}#(?!\w)"
    r"|\{[A-ZÇĞİÖŞÜ][A-ZÇĞİÖŞÜ_ ]{1,40}\}|\{[\w.]{2,40}\}|\[[A-ZÇĞİÖŞÜ]{2}[A-ZÇĞİÖŞÜ_ ]{0,38}\]|\[[a-z]+(?:[_.][a-z]+)+\]|\[[a-z]+[A-Z]\w*\]|\[(?:misafir|datum|name|guest|hotel|room|date|nom|nombre|ad|isim|tarih|fecha|имя|дата)\]|(?:<|&lt;)(?:[A-Z]+_[A-Z_]+|[a-z]+(?:[_.][a-z]+)+|[a-z]+[A-Z]\w*|NAME|HOTEL|DATE|misafir|datum)(?:>|&gt;)|(?<![@\w])@@\w{2,40}@@"
)


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Folded code points of all texts, each followed by GRAM line breaks, and the texts' starts."""
    letter, _ = tables()
    cps = np.frombuffer(("".join(t + "\n" * GRAM for t in texts)).encode("utf-32-le", "surrogatepass"), np.uint32)
    cps = np.where(cps < 0x20000, cps, 0x2A)
    low = np.where(letter[cps] > 0, letter[cps], cps)
    low = np.where((low >= 0x30) & (low <= 0x39), 0x39, low)
    low = np.where((low == 0x09) | (low == 0xA0) | (low == 0x0D), 0x20, low)
    return low.astype(np.uint64), np.cumsum([0] + [len(t) + GRAM for t in texts])


def grams(low: np.ndarray) -> np.ndarray:
    """Hash of the 4-gram that starts at each place (but the last GRAM - 1)."""
    h = np.zeros(len(low) - GRAM + 1, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(GRAM):
            h = h * np.uint64(1099511628211) + low[j : len(low) - GRAM + 1 + j]
        h *= np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def counted(texts: list[str]) -> np.ndarray:
    return np.bincount(grams(symbols(texts)[0]), minlength=1 << BITS).astype(np.float64) if texts else np.zeros(1 << BITS)


class Models:
    def __init__(self, ratios: np.ndarray) -> None:
        self.ratios = ratios  # classes x 2**BITS

    def spans(self, texts: list[str]) -> list[tuple[float, str | None, str | None]]:
        """Per text: share of residue, the kind of most of it, the first placeholder."""
        low, starts = symbols(texts)
        h = grams(low)
        n = len(h)
        sums = []
        for i, r in enumerate(self.ratios):
            w = MARK_WINDOW if CLASSES[i] == "mark" else WINDOW
            c = np.concatenate([[0], np.cumsum(r[h], dtype=np.float64)])
            lo, hi = np.maximum(np.arange(n) - w // 2, 0), np.minimum(np.arange(n) + w // 2, n)
            sums.append(((c[hi] - c[lo]) / (hi - lo)).astype(np.float32))
        kinds = np.stack(sums[:4])
        best = kinds.argmax(0)
        solid = (low[:n] != 0x20) & (low[:n] != 0x0A)
        hit = (kinds.max(0) > LEVEL) & solid
        out = []
        for k, t in enumerate(texts):
            a, b = starts[k], starts[k] + len(t)
            own, kind, ok = hit[a:b], best[a:b], solid[a:b]
            furniture = own & (kind == 3)
            content = ok.sum() - furniture.sum()
            residue = own & (kind != 3)
            share = float(residue.sum() / content) if content else 0.0
            top = CLASSES[int(np.bincount(kind[residue], minlength=4).argmax())] if residue.any() else None
            mark = None
            places = np.flatnonzero(sums[4][a:b] > LEVEL)
            # an exact pattern over each whole marked stretch, with room for a placeholder that begins before or ends after it
            gaps = np.flatnonzero(np.diff(places) > MARK_LENGTH)
            for x, y in zip(places[np.append(0, gaps + 1)], places[np.append(gaps, len(places) - 1)]) if len(places) else ():
                if m := EXACT.search(t, max(0, int(x) - MARK_LENGTH), int(y) + MARK_LENGTH):
                    mark = m[0]
                    break
            out.append((share, top, mark))
        return out


def slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Bounds of slices of bounded size."""
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size < 300_000):
            size += len(texts[j])
            j += 1
        yield i, j
        i = j


KINDS = CLASSES[:3]  # the kinds that documents can consist of


def tally(texts: list[str], models: Models | None) -> np.ndarray:
    """4-gram counts of natural prose (first row) and of the texts that the models take whole for one of KINDS."""
    out = np.zeros((1 + len(KINDS), 1 << BITS))
    rows = [0] * len(texts)
    if models is not None:
        rows = [0 if share < 0.3 else 1 + KINDS.index(kind) if share > COVERAGE and kind in KINDS else None for share, kind, _ in models.spans(texts)] if texts else []
    for r in set(rows) - {None}:
        out[r] += counted([t for t, k in zip(texts, rows) if k == r])
    return out


def corpus_counts(docs: DataFrame, models: Models | None, text: str = "text") -> np.ndarray:
    """The tally of all documents: at most (1 + KINDS) * 2 ** BITS rows a partition, and as many in all."""
    ratios = models.ratios if models else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = None if ratios is None else Models(ratios)
        total = np.zeros((1 + len(KINDS)) << BITS)
        for pdf in batches:
            texts = pdf[text].tolist()
            for i, j in slices(texts):
                total += tally(texts[i:j], m).ravel()
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bin": at, "n": total[at].astype(np.int64)})

    rows = docs.select(text).where(F.length(text) > 0).mapInPandas(run, "bin int, n bigint").groupBy("bin").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros((1 + len(KINDS)) << BITS)
    out[rows["bin"].to_numpy(int)] = rows["n"].to_numpy(float)
    return out.reshape(1 + len(KINDS), -1)


def fit(sample: list[str], corpus: Callable[[Models | None], np.ndarray] | None = None) -> Models:
    """Models from the phrases above and the tally of the corpus (of the sample by default), in three rounds."""
    corpus = corpus or (lambda models: tally(sample, models))
    join = lambda lines: [x for line in lines for x in line.split("|")]
    marks = [m.replace("@", f, 1).replace("@", "") if m != "@@@@" else f"@@{f}@@" for m in MARKS for f in FIELDS]
    marks = [f"{a} {m}{b}" for m in marks for a, b in ((" ", " "), ("x", ","), ("", "."))]
    seeds = {"filler": join(FILLER) * 3, "error": join(ERROR) * 3, "script": join(SCRIPT) * 3, "furniture": [x for line in FURNITURE for x in re.split(r"\|(?=\S)", line)] * 3, "mark": marks}
    seeds["error"] += [x.upper() for x in seeds["error"]]
    models = None
    for _ in range(3):
        natural, *found = corpus(models)
        base = natural + 0.2
        base /= base.sum()
        ratios = []
        for c in CLASSES:
            own = counted(seeds[c])
            if c in KINDS:
                more = found[KINDS.index(c)]
                own = own + more * min(1.0, CORPUS_MASS / max(more.sum(), 1.0))
            r = own + 0.2 * base * (1 << BITS) / 10 + 0.02
            r /= r.sum()
            # a 4-gram that neither prose nor the kind has says nothing
            ratios.append(np.where((natural == 0) & (own == 0), 0, np.clip(np.log(r / base), -3, 3)))
        models = Models(np.array(ratios, np.float32))
    return models


def classify(docs: DataFrame, models: Models, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, residue_share, residue_kind, placeholder, excluded for every document; NULL and '' have no residue."""
    ratios = models.ratios
    schema = T.StructType([docs.schema[key], T.StructField("residue_share", T.DoubleType()), T.StructField("residue_kind", T.StringType()), T.StructField("placeholder", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = Models(ratios)
        for pdf in batches:
            texts = [t if isinstance(t, str) else "" for t in pdf[text]]
            for i, j in slices(texts):
                found = m.spans(texts[i:j])
                yield pd.DataFrame({key: pdf[key].iloc[i:j].to_numpy(), "residue_share": [f[0] for f in found], "residue_kind": [f[1] for f in found], "placeholder": [f[2] for f in found]})

    out = docs.select(key, text).mapInPandas(run, schema)
    return out.withColumn("excluded", (F.col("residue_share") >= COVERAGE) | F.col("placeholder").isNotNull())


def fitted(docs: DataFrame, text: str = "text") -> Models:
    return fit([], lambda models: corpus_counts(docs, models, text))
