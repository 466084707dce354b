"""Composes labelled sentences and fits the weights in pii_weights.json: python -m guestlens.llm.pii_train"""

from __future__ import annotations

import json
import random

from guestlens.llm import pii

GIVEN = "Alda Borek Cemre Dilan Ediz Feray Gonca Halide Irmak Jale Koray Lale Mert Nazan Orkun Pelin Rıza Sevda Tarık Ümit Vedat Yasin Zafer Oliver Amelia George Isla Arthur Mia Hans Greta Klaus Ingrid Pierre Claire Lucien Odile Diego Carmen Pablo Elena Иван Мария Пётр Анна Сергей Дарья".split()
FAMILY = "Korkmazer Yıldızlı Demirtepe Gündoğar Akçaova Ashworth Penrose Hollins Fairley Brandtner Winkelhof Oberhauser Duvallon Mercier Lambrey Oteruelo Sandoval Quiroga Соколовский Зорин Мельников Лавров".split()
PEOPLE = ["Barmen {} Bey'e selam olsun.", "Resepsiyondaki {} Hanım sabırla dinledi.", "Özellikle {} elinden geleni yaptı.", "Odamızı temizleyen {} çok titizdi.", "Garson {} siparişi karıştırmadı.", "Waiter {} knew our table.", "The manager {} wrote back to us.", "A big thank you to {} for the tour.", "{} from housekeeping was quick.", "{} helped with the bags.", "Frau {} war sehr geduldig.", "Kellner {} brachte alles sofort.", "Herr {} vom Service half gleich.", "Besonders {} von der Bar blieb in Erinnerung.", "Merci à {} pour sa patience.", "Mme {} a tout arrangé.", "Serveur {} toujours souriant.", "Camarero {} siempre atento.", "La señora {} lo resolvió enseguida.", "Agradecemos a {} de recepción su ayuda.", "Администратор {} решила вопрос.", "Официант {} быстро принёс заказ.", "Спасибо {} за помощь с вещами."]
PHONES = ["+90 599 {3} {2} {2}", "0{3}{7}", "0090{10}", "+90.599.{3}.{4}", "0(599) {3}-{2}-{2}", "0 599 {7}", "+44 20 7946 {4}", "020 7946 {4}", "+1 646-555-{4}", "(212) 555-{4}", "312.555.{4}", "+49 (0)30 {5}-{3}", "030/{8}", "030 {5} {3}", "0049 30 {8}", "06 {2} {2} {2} {2}", "+33 6 {2} {2} {2} {2}", "+34 6{2} {3} {3}", "6{2} {2} {2} {2}", "+7 (495) {3}-{2}-{2}", "+7495{7}", "8 495 {3} {2} {2}", "٠٥٩٩ ٢٧٠ ٦٣٢٧", "0599 {3} {4}"]
PHONE_SAYS = ["Bana {} numarasından dönüş yapın.", "Bizi {} numarasından bulabilirsiniz.", "Tel {}", "Tel: {}", "Telefon: {}", "Lütfen {} numarasını arayın dedim.", "WhatsApp numaram {} açık.", "Akşam {} hattından ulaşabilirsiniz.", "Sorun çıkarsa {} üzerinden yazın.", "Please phone {} after six.", "Reach me on {} tomorrow.", "The number I left was {} for updates.", "Rufen Sie {} an.", "Handy: {}", "Mein Telefon ist {} tagsüber.", "Mon portable est le {} le matin.", "Appelez le {} demain.", "Llámame al {} por la tarde.", "Móvil: {}", "Мой телефон {} всегда включён.", "Позвоните на {} утром.", "{}"]
IDS = ["TCK", "TCK3", "S {8}", "U{8}", "U {8}", "{3}-{2}-{4}", "QQ {2} {2} {2} C", "X{8}", "{4} {6}", "{2} {2} {6}", "{8}G", "X-{7}-Z", "{2} {6} {1}", "C{2}X{2}", "L{1}X{6}", "L{1}Z{6}", "C{1}FK{2}T{2}", "L{2}X{2}T{2}", "L{1}X {3} {3}"]
ID_SAYS = ["The slip gave {} as my identity.", "Their list had {} as my passport.", "The label read {} as my insurance.", "TC: {}", "TC kimlik {} yazılıydı.", "Kimlik no {} herkesin önünde söylendi.", "Belge numaram {} ekranda kaldı.", "Pasaport {} masada duruyordu.", "Passport no. {} stayed on the desk.", "Passport number: {}", "My insurance number {} was visible to all.", "Identity card {} was scanned twice.", "Personalausweis {} lag am Tresen.", "Reisepassnummer {} stand auf dem Zettel.", "Passnummer: {}", "Passeport n° {} photocopié sans demander.", "Ma pièce d'identité {} est restée là.", "Pasaporte {} fotografiado en la entrada.", "DNI {} a la vista de todos.", "Паспорт {} сфотографировали.", "ИНН {} записали в журнал."]
CODE_SAYS = ["The voucher {} did not work.", "Booking {} had another date.", "Reference {} was unknown to them.", "Order {} never came.", "Rezervasyon no {} bulunamadı.", "Kupon kodu {} geçmedi.", "Fatura {} yanlış kesildi.", "Fiş tarihi {d} idi.", "Buchungsnummer {} war falsch.", "Gutschein {} wurde nicht genommen.", "Rechnung {} stimmte nicht.", "Le bon {} n'était plus valable.", "Réservation {} introuvable.", "El bono {} no servía.", "Factura {} con errores.", "Ваучер {} не приняли.", "Номер брони {} потеряли."]
CODES = ["{6}", "{8}", "{9}", "{11}", "{5}", "{10}", "K{1}R{2}X", "{2}HB{4}", "R{1}X{6}", "QT{2}-Z{3}"]
ADDRESS_SAYS = ["Adres: {}", "Adresimiz {} olarak kayıtlı.", "Paketi {} adresine gönderin lütfen.", "Şu adrese bekliyorum: {}", "Address: {}", "We live at {}, please note.", "Send the forgotten coat to {} if found.", "The parcel should go to {} instead.", "Ich wohne {} und warte.", "Adresse: {}", "Bitte senden Sie den Koffer an {} zurück.", "J'habite {} depuis dix ans.", "Mon adresse : {}", "Vivo en {} y espero.", "Dirección: {}", "Мой адрес {} указан в анкете.", "Пришлите сумку на адрес {} почтой."]
STREETS = ["{S} Mah. {S} Sok. No: {n} D: {n}, {C}", "{S} Caddesi No:{n} Kat {n} {C}", "{S} mah. {S} cad. no {n} {C}", "{S} Mah. 1043. Sok. No: {n} D: {n}, {C}", "{S} mahallesi {3}. sokak {n}/{n} {C}", "{S} Mah. {3}. Sok. {n}/{n}, {C}", "{S} Mahallesi {S} Caddesi {n} {C}", "{S} Caddesi {n}/{n} {C}", "{n} {S} Road, Flat {n}, {C}", "{n} {S} Lane, Apt {n}, {C}", "{n} {S} Street, {C}", "{S}straße {n}a, {5} {C}", "{S}weg {n}, {5} {C}", "{S}allee {n} in {5} {C}", "{n} avenue {S}, {5} {C}", "{n} rue {S}, {5} {C}", "Calle {S} {n}, {5} {C}", "улица {R} {n}-{n}, Казань", "ул. {R}, д. {n}, кв. {n}, Омск"]
PLAIN = ["{S} Caddesi {n} dakika mesafede kaldı.", "Durak {S} Caddesi {n} adım ötede.", "{S} sokak {n} dakika yürüyüş.", "Staff of {S} bar kept smiling.", "{S} barı geceleri gürültülüydü.", "Im Restaurant {S} gab es Fisch.", "We walked to {S} garden twice.", "{n} numaralı oda karanlıktı.", "It cost {n} euros more.", "{S} iskelesi uzaktı.", "Gül Bahçesi adlı restoranda masa {n} kirliydi.", "The Rose Garden closes at {n}.", "Otel {S} Caddesi üzerinde, denize {n} dakika.", "{S} sokak tarafı {n} metre sürüyor.", "Suite XL{n}00 faced the road.", "Our plane TK{n}23 landed early.", "На сцене {S} играли каждый вечер.", "Au bar {S} la musique était forte.", "En el restaurante {S} faltaba personal.", "Asansörü {n} dakika bekledik.", "Otopark {n} lira tuttu.", "See www.{s}.example for pictures.", "Tag us with @{s}_{n} online.", "Im Garten {S} war es schattig.", "All in all {n} days were enough.", "Room {n} smelled of paint.", "Zimmer {n} hatte keinen Balkon."]


def composed(seed: int = 11, n: int = 1500) -> tuple[list, pii.Gazetteer]:
    """Examples (text, field, segments) and a gazetteer that knows most of their given names."""
    r = random.Random(seed)
    number = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    syllables = lambda: "".join(r.choice(["mo", "ra", "ti", "ken", "lu", "vas", "per", "no", "dil"]) for _ in range(r.randint(2, 3)))

    def filled(t: str) -> str:
        if t.startswith("TCK"):
            d = [r.randint(1, 9)] + [r.randint(0, 9) for _ in range(8)]
            d.append((7 * sum(d[0:9:2]) - sum(d[1:8:2])) % 10)
            d.append(sum(d) % 10)
            s = "".join(map(str, d))
            return s if t == "TCK" else f"{s[:3]} {s[3:6]} {s[6:9]} {s[9:]}"
        out = t
        for k in range(11, 0, -1):
            while "{" + str(k) + "}" in out:
                out = out.replace("{" + str(k) + "}", number(k), 1)
        while "{n}" in out:
            out = out.replace("{n}", str(r.randint(1, 150)), 1)
        for mark, f in (("{S}", lambda: syllables().capitalize()), ("{s}", syllables), ("{C}", lambda: r.choice(["Ankara", "Leeds", "Mainz", "Lyon", "Sevilla", "Konya"])), ("{R}", lambda: r.choice(["Лесная", "Садовая", "Новая"]))):
            while mark in out:
                out = out.replace(mark, f(), 1)
        return out.replace("{d}", f"{r.randint(1, 28):02}.{r.randint(1, 12):02}.2024 {r.randint(0, 23):02}:{r.randint(0, 59):02}")

    def mail() -> str:
        local = r.choice([f"{syllables()}.{syllables()}", f"{syllables()}{number(2)}", f"{syllables()}+otel", f"{syllables()}_{syllables()}", syllables()])
        host, dom = syllables(), r.choice(["example", "test", "com.example", "invalid"])
        kind = r.randint(0, 6)
        dots = f"{host} dot {dom.replace('.', ' dot ')}" if r.random() < 0.5 else f"{host} [dot] {dom.replace('.', ' [dot] ')}"
        out = [f"{local}@{host}.{dom}"] * 3 + [f"{local}＠{host}.{dom}", f"{local} @ {host}.{dom}", f"{local} [at] {dots}", f"{local} at {dots}"]
        return out[kind].upper() if r.random() < 0.05 and kind < 3 else out[kind]

    def name(short: float = 0.4) -> str:
        g, f = r.choice(GIVEN), r.choice(FAMILY)
        out = g if r.random() < short else f"{g} {f}"
        return out.upper() if r.random() < 0.05 else out

    def piece() -> tuple[str, str | None, str]:
        k = r.random()
        if k < 0.3:
            return filled(r.choice(PLAIN)), None, ""
        if k < 0.5:
            return r.choice(PEOPLE), "NAME", name()
        if k < 0.62:
            return r.choice(PHONE_SAYS), "PHONE", filled(r.choice(PHONES))
        if k < 0.74:
            return r.choice(ID_SAYS), "ID_NUMBER", filled(r.choice(IDS))
        if k < 0.84:
            return r.choice(CODE_SAYS).replace("{}", filled(r.choice(CODES))).replace("{d}", filled("{d}")), None, ""
        if k < 0.93:
            return r.choice(ADDRESS_SAYS), "ADDRESS", filled(r.choice(STREETS))
        return r.choice(["Mail: {}", "Bana {} adresinden yazın.", "You can write to me at {} soon.", "Пишите мне на {} в любое время."]), "EMAIL", mail()

    out = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(r.randint(1, 4)):
            t, kind, value = piece()
            if text:
                text += r.choice([" ", " ", " ", "\n"])
            if kind:
                a = len(text) + t.index("{}")
                text += t.replace("{}", value)
                spans.append((a, a + len(value), kind))
            else:
                text += t
        out.append((text, "comment", spans))
    for _ in range(n // 3):
        k = r.random()
        g, f = r.choice(GIVEN), r.choice(FAMILY)
        full = r.choice([f"{g} {f}", f"{g} {f}", f"{f}, {g}", g, f"{g} {f[0]}."])
        if r.random() < 0.1:
            full = r.choice([full.upper(), full.lower()])
        if k < 0.55:
            out.append((full, "guest_name", [(0, len(full), "NAME")]))
        elif k < 0.65:
            t = r.choice(["Dr. ", "Prof. ", "Mr ", "Mrs. "])
            out.append((t + full, "guest_name", [(len(t), len(t + full), "NAME")]))
        elif k < 0.75:
            t = r.choice(["Guest", "A Traveler", "Google User", "Misafir", "Anonim", "travelbug22", "gezgin_1987", "Family of four", "Booking guest", "Gast", "sunny_days", "happyguest7"])
            out.append((t, "guest_name", []))
        elif k < 0.9:
            m, sep = (mail(), "EMAIL") if r.random() < 0.6 else (filled(r.choice(PHONES)), "PHONE"), r.choice([" - ", " / ", ", "])
            full = f"{g} {f}"
            text = full + sep + m[0]
            out.append((text, "guest_name", [(0, len(full), "NAME"), (len(full + sep), len(text), m[1])]))
        else:
            m, kind = (mail(), "EMAIL") if r.random() < 0.6 else (filled(r.choice(PHONES)), "PHONE")
            out.append((m, "guest_name", [(0, len(m), kind)]))
    known = {pii.fold(g) for g in GIVEN if r.random() < 0.9}
    return out, pii.Gazetteer(known, {pii.fold(f) for f in FAMILY if r.random() < 0.8})


def main() -> None:
    examples, gaz = composed()
    with open(pii.WEIGHTS, "w") as f:
        json.dump(pii.fit(examples, gaz), f, indent=0, sort_keys=True)


if __name__ == "__main__":
    main()
