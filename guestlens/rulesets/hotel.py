"""Own rule values for hotel reviews in Turkish, English, German and Russian. Terms are folded as functions.text.folded does."""

from __future__ import annotations

# Aspect, department, terms that name it, other words for it.
ASPECTS = (
    ("room cleanliness", "housekeeping", "clean room|oda temiz|temizlik|room dirty|kirli oda|towels|havlu|handtuch|полотен|carsaf|sheets|bettwasche|carpet|hali lekeli|teppich|housekeeping|kat gorevli|уборщиц|горничн", "spotless|lekeli|stained|fleckig|damp|rutubet|schimmel|плесен"),
    ("room comfort", "housekeeping", "mattress|yatak|matratze|матрас|pillow|yastik|kissen|wardrobe|dolap|oda kucuk|small room|номер", "too soft|yumusak|cok sert|uncomfortable|rahatsiz"),
    ("bathroom", "technical", "bathroom|banyo|badtur|bad |ванн|shower|dus |dusche|drain|gider|abfluss|слив", "would not lock|kilitlenmiyor|blocked|tikali|verstopft"),
    ("climate and noise", "technical", "air conditioning|klima|klimaanlage|кондиционер|noise|gurultu|larm|шум", "rattled|brummte|loud music|muzik"),
    ("connectivity", "technical", "wifi|wi-fi|internet|wlan|вайфай|интернет", "dropped every|koptu|abgebrochen"),
    ("lift", "technical", "lift|elevator|asansor|aufzug|лифт", "out of order|bozuktu|fiel aus|не работал"),
    ("in-room devices", "technical", "kettle|su isiticisi|wasserkocher|safe and|kasa ile|tresor|televizyon|television|fernseher|телевизор", ""),
    ("breakfast and buffet", "food_beverage", "breakfast|kahvalti|fruhstuck|завтрак|buffet|bufe|büfe|буфет", "flatbread|mantarli|cheese|peynir|kase"),
    ("restaurant", "food_beverage", "restaurant|restoran|ресторан|waiter|garson|kellner|официант|menu|yemek|speise|ужин|блюдо", "delicious|lezzetli|kostlich|вкусн|remembered our drinks"),
    ("bar and snacks", "food_beverage", "snack bar|snackbar|bar |barmen|bartender|barinda|бар |minibar|мини-бар", "greasy|yagli|fettig|cold and|soguk ve"),
    ("reception", "front_office", "reception|resepsiyon|rezeption|стойк|check-in|checkin|booking|rezervasyon|buchung|брон", "to find our booking|ancak buldu"),
    ("price and value", "front_office", "euros|avro|euro|евро|lira|price|fiyat|preis|цена|charged|extra for", "sea view|deniz manzarasi|meerblick|вид на море|car park|otopark"),
    ("spa", "spa_wellness", "spa |massage|masaj|массаж|hamam|sauna|сауна", "wonderful massage|harika bir masaj"),
    ("pool", "animation", "pool|havuz|бассейн|waterslide|kaydirak", "crowded before|doluyordu"),
    ("beach", "animation", "beach|plaj|strand|пляж|sun lounger|sezlong|liegen|лежак|pier|iskele|steg|причал", "taken before sunrise|gun dogmadan"),
    ("entertainment", "animation", "evening show|aksam gosteri|animasyon|animation|kids club|cocuk kulubu|kinderclub|детский клуб|treasure hunt|hazine avi", "kept the children happy|mutlu etti"),
    ("transfer", "guest_relations", "shuttle|servis araci|transfer|трансфер|minutes to the beach|plaja yurumek|weg vom|дорога от", "as promised|soz verildigi"),
    ("safety", "security", "security guard|guvenlik|sicherheitsdienst|охран|theft|hirsizlik|diebstahl|кража|fire alarm|yangin", "stolen|calindi|gestohlen"),
    ("management", "guest_relations", "manager|mudur|leitung|управляющ|complain|sikayet|beschwer|жалоб", "apologised|ozur|entschuldigt|извинил"),
)
# Terms that contain a cue without meaning it.
TRAPS = {"bar ": ("bar chart",), "pool": ("carpool", "pooled", "liverpool"), "lift": ("lifted", "uplift"), "havuz": ("havuzun parasi",), "price": ("priceless",), "hamam": ("hamamboceg",), "menu": ("menuet",)}
# The order in which near ties are settled.
FRAME_PRIORITY = ("safety", "room cleanliness", "bathroom", "climate and noise", "connectivity", "lift", "in-room devices", "restaurant", "breakfast and buffet", "bar and snacks", "spa", "pool", "beach", "reception", "price and value", "entertainment", "transfer", "management", "room comfort")
# Words of one polarity and their weight; phrases outweigh words.
POSITIVE = {"good": 1.0, "great": 1.5, "wonderful": 2.0, "delicious": 1.5, "friendly": 1.0, "clean": 1.0, "lovely": 1.5, "happy": 1.0, "perfect": 2.0, "best": 1.5, "kindly": 0.5, "luckily": 0.5, "guzel": 1.0, "harika": 2.0, "lezzetli": 1.5, "temiz": 1.0, "mukemmel": 2.0, "mutlu": 1.0, "iyi": 1.0, "rahat": 0.8, "gut": 1.0, "wunderbar": 2.0, "kostlich": 1.5, "kostliche": 1.5, "sauber": 1.0, "freundlich": 1.0, "hervorragend": 2.0, "хорошо": 1.0, "отличный": 1.5, "прекрасное": 1.5, "вкусно": 1.5, "чисто": 1.0, "отлично": 1.5}
NEGATIVE = {"bad": 1.0, "dirty": 1.5, "cold": 0.8, "greasy": 1.2, "broken": 1.2, "rude": 1.5, "awful": 2.0, "terrible": 2.0, "stained": 1.2, "damp": 1.2, "blocked": 1.0, "crowded": 0.8, "forgot": 1.0, "unfortunately": 0.5, "rattled": 1.0, "kotu": 1.5, "kirli": 1.5, "soguk": 0.8, "bozuktu": 1.2, "berbat": 2.0, "lekeliydi": 1.2, "tikaliydi": 1.0, "unuttu": 1.0, "maalesef": 0.5, "yavas": 0.8, "schlecht": 1.5, "schmutzig": 1.5, "kalt": 0.8, "kaputt": 1.2, "fettig": 1.2, "fleckig": 1.2, "verstopft": 1.0, "leider": 0.5, "плохо": 1.5, "грязно": 1.5, "ужасно": 2.0, "холодно": 0.8, "сожалению": 0.5, "забыла": 1.0}
PHRASES = {"would come again": 2.5, "yine geliriz": 2.5, "kommen gern wieder": 2.5, "вернулись снова": 2.5, "made our week": 2.5, "haftamizi guzellestirdi": 2.5, "out of order": -2.5, "never again": -3.0, "bir daha gelmeyiz": -3.0, "nie wieder": -3.0, "short of hands": -1.5, "personel sayisi azdi": -1.5, "complained twice": -2.0, "please fix": -1.5, "lutfen bunu duzeltin": -1.5, "baska oda istedik": -1.5, "asked for another room": -1.5, "not bad": 1.5, "fena degil": 1.5, "no problem": 1.0, "sorun yasamadik": 1.5}
# Words that turn the word after them, or the word before them.
NEGATES_NEXT = ("not", "no", "never", "hardly", "nicht", "kein", "keine", "nie", "не", "нет", "hic")
NEGATES_BEFORE = ("degil", "degildi", "yok", "yoktu", "nicht")
STRENGTHENS = ("very", "really", "extremely", "cok", "gercekten", "asiri", "sehr", "wirklich", "очень")
# Signs of the manners of writing; patterns over the folded text.
MANNERS = {
    "manipulation": ("refund|iade|ruckerstattung|возврат", "or else|yoksa|sonst|иначе|bad review|kotu yorum|schlechte bewertung|one star|tek yildiz"),
    "humor": ("let us say|nasil desem|sagen wir|скажем так|apparently a feature|joke|saka gibi|witz",),
    "hyperbole": ("worst .{0,20}(ever|in the world)|best .{0,20}(ever|in the world)|hayatimda (gordugum|yedigim)|dunyanin en|schlechteste[rns]? .{0,20}welt|a thousand times|bin kere|hundert mal|никогда в жизни",),
    "casual": ("lol|haha|:\\)|;\\)|\\^\\^|kanka|abi ya|valla|digga|krass|блин|ахах",),
    "short": ("^\\s*(\\S+\\s*){1,4}$",),
}
# Ordered overrides of a clause's decision: name, pattern over the folded clause, new value.
SENTIMENT_MODIFIERS = (
    ("queue", "queue|kuyruk|schlange|очеред|waited|bekledik|gewartet", -0.75), ("value waste", "paid .{0,40}(car park|nothing)|otopark manzarasi|waste of money|para israfi|geldverschwendung", -0.85), ("neglect", "forgot room|odayi .{0,20}unuttu|vergass|забыла номер", -0.8),
    ("out of order", "out of order|bozuk|kaputt|defekt|сломан|не работал", -0.7), ("apology", "apologised|ozur diledi|entschuldigt|извинил", -0.3), ("return wish", "come again|yine gel|gern wieder|вернулись снова", 0.8), ("praise", "wonderful|harika|wunderbar|прекрасн|delicious|lezzetli|kostlich|вкусн", 0.75), ("promise kept", "as promised|soz verildigi|wie versprochen|как обещали", 0.5),
)
DEPARTMENT_GUARDS = (
    ("theft goes to security", "stolen|calindi|gestohlen|украд", "security"), ("minibar is served by food and beverage", "minibar|мини-бар", "food_beverage"), ("a broken device is technical wherever it stands", "out of order|bozuk|kaputt|defekt|calismiyor|не работал", "technical"),
    ("towels are housekeeping even at the pool", "towel|havlu|handtuch|полотен", "housekeeping"), ("billing is front office", "euros extra|charged|fatura|rechnung|счет", "front_office"),
)
# Patterns of ladders; the first that matches decides.
ROOT_CAUSES = (("staffing", "short of hands|personel sayisi|zu wenig personal|не хватало людей"), ("maintenance", "out of order|bozuk|damp|rutubet|blocked|tikali|rattled|drop|kopt|сломан|kaputt|defekt"), ("process", "forgot|unuttu|took .{0,20}minutes|needed \\d+ minutes|dakikada ancak|минут"), ("capacity", "crowded|doluyordu|taken before|kapilmisti|voll"), ("pricing", "euros|avro|евро|lira"), ("quality", "cold|soguk|greasy|yagli|kalt|fettig|холодн"))
EMOTIONS = (("anger", "disappoint", "never again|bir daha gelmey|nie wieder|unacceptable|kabul edilemez|rezalet|скандал", 0.9), ("disappointment", "disappoint", "unfortunately|maalesef|leider|к сожалению|expected|bekledig", 0.75), ("worry", "concern", "damp|rutubet|schimmel|плесен|fire|yangin|unsafe|guvensiz", 0.8), ("joy", "delight", "happy|mutlu|wonderful|harika|lovely|прекрасн|gluckl", 0.85), ("gratitude", "delight", "thank|tesekkur|danke|спасибо", 0.85), ("surprise", "mixed", "surpris|sasir|uberrasch|удивил", 0.6))
SEVERITY = (("emergency", "fire|yangin|feuer|пожар|ambulance|ambulans|gas leak|gaz kacag|theft|hirsizlik|stolen|calindi"), ("critical", "food poisoning|zehirlen|injur|yaralan|verletz|hospital|hastane|cockroach|hamamboce|bed bug"), ("high", "damp|rutubet|mould|schimmel|плесен|out of order|bozuk|blocked|tikali|dirty|kirli|schmutzig"), ("medium", "forgot|unuttu|cold|soguk|slow|yavas|crowded|dolu|drop|kopt|noise|gurultu"))
SLA_HOURS = {"emergency": 1, "critical": 4, "high": 24, "medium": 48, "low": 72}
FAMILIES = {"housekeeping": "rooms", "technical": "rooms", "front_office": "service", "guest_relations": "service", "food_beverage": "food", "spa_wellness": "leisure", "animation": "leisure", "security": "safety"}
AGREEING = (("rooms", "service"), ("food", "leisure"))
ROOM_PATTERNS = ("([0-9]{3,4}) numarali oda", "room (?:no\\.? ?)?([0-9]{3,4})", "zimmer (?:nr\\.? ?)?([0-9]{3,4})", "номер[а-я]* №? ?([0-9]{3,4})", "chambre ([0-9]{3,4})", "habitacion ([0-9]{3,4})", "oda (?:no:? ?)?([0-9]{3,4})")
INTENTS = (("booking", "rezervasyon|booking|buchung|брон", "book(ed|ing)? (a|our|the)|rezervasyon yap", 0.5), ("complaint", "sikayet|complain|beschwer|жалоб|unfortunately|maalesef|leider", "out of order|bozuk|forgot|unuttu|kaputt", 0.5), ("price_question", "fiyat|price|preis|цена|euros|avro", "how much|ne kadar|wie viel|сколько", 0.0), ("transfer", "shuttle|servis|transfer|трансфер", "to the airport|havalimani|zum flughafen", 0.0), ("praise", "thank|tesekkur|danke|спасибо", "wonderful|harika|wunderbar", 0.25))
SUGGESTIONS = (("technical", "maintenance", "inspect and repair the unit, confirm with the guest"), ("housekeeping", "process", "add a second room check to the shift"), ("housekeeping", "maintenance", "dry, treat and repaint the room before the next arrival"), ("front_office", "process", "prepare bookings before arrival, open a second desk at peak hours"), ("front_office", "pricing", "state what the rate includes at booking"), ("food_beverage", "quality", "check temperature at the pass"), ("animation", "capacity", "extend hours or add loungers and places"), ("*", "staffing", "plan one more shift at peak times"), ("*", "*", "answer the guest and thank for the remark"))
# Operational patterns: name, pattern, observation, impact, failed process, procedure, action.
OPERATIONS = (
    ("damp room", "damp|rutubet|schimmel|плесен", "moisture in the room", "health and comfort", "room inspection", "SOP mould control", "take the room out of sale"),
    ("drain blocked", "blocked|tikali|verstopft|засор", "water does not run off", "bathroom unusable", "preventive maintenance", "SOP plumbing", "send the plumber"),
    ("lift failure", "(lift|asansor|aufzug|лифт).{0,40}(out of order|bozuk|aus|не работал)", "lift stands still", "access and safety", "preventive maintenance", "SOP lift", "call the contractor"),
    ("service forgotten", "forgot|unuttu|vergass|забыла", "room or request skipped", "trust lost", "task assignment", "SOP room list", "recover the service today"),
    ("connection drops", "(wifi|internet|wlan).{0,60}(drop|kopt|abge|пропад)", "network unstable", "guests can't work", "network monitoring", "SOP network", "replace the access point"),
    ("cold food", "(cold|soguk|kalt|холодн).{0,20}(greasy|yagli|fettig|жирн)", "food below temperature", "quality lost", "food control", "SOP hot holding", "check the holding line"),
)
# Questions that are answered often: name, words and their weights, answer.
FAQ = (("wifi", {"wifi": 3.0, "internet": 3.0, "dropped": 1.0, "koptu": 1.0, "floors": 0.5}, "network"), ("pool hours", {"pool": 3.0, "havuz": 3.0, "crowded": 1.0, "terrace": 0.5, "open": 1.0}, "pool"), ("towels", {"towels": 3.0, "havlular": 3.0, "changed": 1.0, "days": 0.5, "degisti": 1.0}, "towels"), ("shuttle", {"shuttle": 3.0, "servis": 2.0, "promised": 1.0, "airport": 2.0}, "shuttle"), ("sea view", {"sea": 1.5, "view": 1.5, "manzarasi": 2.0, "extra": 1.0, "euros": 1.0}, "rates"))


def terms() -> list[tuple[str, str, str, str]]:
    """(aspect, department, kind, term)"""
    return [(a, d, kind, t) for a, d, words, others in ASPECTS for kind, text in (("keyword", words), ("synonym", others)) for t in text.split("|") if t]
