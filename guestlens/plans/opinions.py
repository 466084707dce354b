"""Queries of the rule tables: cues, frames, categories, ontology, polarity, manners of writing, ladders, routing."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from guestlens.functions import text as tx
from guestlens.operators import clauses as cl
from guestlens.operators import opinions as op
from guestlens.registry import query
from guestlens.rulesets import hotel
from guestlens.sources.tables import table

TERMS = hotel.terms()
DEPARTMENTS = sorted({d for _, d, _, _ in TERMS})
SERVICE = {"room": "housekeeping", "guest": "guest_relations", "facility": "technical", "restaurant": "food_beverage"}  # department of an entity type


def lit(x) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)


def values(rows, columns: str) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + f") v({columns})"


def cues_sql(source: str, text: str = "comment", columns: str = "*") -> str:
    plain = tx.folded_sql(text)
    for t in op.TRAPS:
        plain = f"replace({plain}, {lit(t)}, ' ')"
    return f"f AS (SELECT {columns}, coalesce({tx.folded_sql(text)}, '') AS folded, ' ' || coalesce({plain}, '') || ' ' AS t, string_split_regex(coalesce({plain}, ''), '[^\\p{{L}}]+') AS lw FROM {source})"


TERM_ROWS = values([(a, d, k, t, op.short(t), len(t.strip().split(" "))) for a, d, k, t in TERMS], "aspect, department, kind, term, short, n_words")
HIT = "CASE WHEN short THEN list_contains(lw, term) ELSE contains(t, term) END"
HITS = f"h AS (SELECT f.*, v.* FROM f JOIN {TERM_ROWS} ON {HIT})"


def cued(spark, d, name: str, *columns: str, text: str = "comment"):
    return op.settled(table(spark, d, name).select("id", *columns, F.col(text).alias("text_")), t=op.cue_text(F.col("text_"))).drop("text_")


def ladder_sql(ladder, column: str = "t", default: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({column}, {lit(p)}) THEN {lit(v)}" for _, p, v in ladder) + f" ELSE {default} END"


# ---- terms
@query("cls_cue_match", f"WITH {cues_sql('reviews')}, {HITS} SELECT id, aspect, term FROM h")
def cls_cue_match(spark, d):
    """One row per text and term it has; trap phrases don't count, short terms only as whole words."""
    t = F.col("t")
    hits = F.array_compact(F.array(*[F.when(op.cue(t, term), F.struct(F.lit(a).alias("aspect"), F.lit(term).alias("term"))) for a, _, _, term in TERMS]))
    return cued(spark, d, "reviews").select("id", F.explode(hits).alias("h")).select("id", "h.aspect", "h.term")


def frame_scores(t):
    out = {}
    for aspect in dict.fromkeys(a for a, _, _, _ in TERMS):
        k = op.total(t, [(x, 1.0) for a, _, kind, x in TERMS if a == aspect and kind == "keyword"])
        s = op.total(t, [(x, 1.0) for a, _, kind, x in TERMS if a == aspect and kind == "synonym"])
        out[aspect] = 1.5 * k + s + F.when((k > 0) & (s > 0), 0.5).otherwise(0.0)
    return out


FRAME_SQL = f"""s AS (SELECT id, aspect, 1.5 * count(*) FILTER (kind = 'keyword') + count(*) FILTER (kind = 'synonym') + CASE WHEN count(DISTINCT kind) = 2 THEN 0.5 ELSE 0 END AS score FROM h GROUP BY 1, 2),
    p AS (SELECT s.*, place, max(score) OVER (PARTITION BY id) AS top FROM s JOIN {values([(a, i) for i, a in enumerate(hotel.FRAME_PRIORITY)], 'aspect, place')} USING (aspect))"""


@query("cls_frames", f"WITH {cues_sql('reviews')}, {HITS}, {FRAME_SQL} SELECT x.id, coalesce(arg_min(aspect, place), 'other') AS frame, coalesce(CAST(arg_min(score, place) AS DOUBLE), 0) AS score FROM reviews x LEFT JOIN p ON p.id = x.id AND score >= 0.75 * top GROUP BY 1")
def cls_frames(spark, d):
    """The frame of each text: of those within three quarters of the best score the first in the fixed order."""
    scored = op.ranked(frame_scores(F.col("t")))
    near = F.filter("r", lambda x: x["neg"] <= 0.75 * F.get("r", F.lit(0))["neg"])
    place = F.create_map(*[F.lit(x) for i, a in enumerate(hotel.FRAME_PRIORITY) for x in (a, i)])
    best = F.array_min(F.transform(near, lambda x: F.struct(F.element_at(place, x["label"]).alias("place"), x["label"].alias("label"), x["neg"].alias("neg"))))
    out = cued(spark, d, "reviews").transform(lambda x: op.settled(x, r=scored)).select("id", "r").select("id", F.when(F.size("r") > 0, best).alias("b"))
    return out.select("id", F.coalesce("b.label", F.lit("other")).alias("frame"), F.coalesce(-F.col("b.neg"), F.lit(0.0)).alias("score"))


# weights: several words 2.5 x 0.85 a word, keywords 2, other words 1; guards settle what the words leave open
def category_weight(kind: str, term: str) -> float:
    n = len(term.strip().split(" "))
    return round(2.5 * 0.85 * n, 4) if n > 1 else 2.0 if kind == "keyword" else 1.0


BONUS = 1.5
CATEGORY_SQL = f"""w AS (SELECT id, department, CASE WHEN n_words > 1 THEN round(2.5 * 0.85 * n_words, 4) WHEN kind = 'keyword' THEN 2.0 ELSE 1.0 END AS weight FROM h
      UNION ALL SELECT id, department, {BONUS} FROM f, {values([(p, x) for _, p, x in hotel.DEPARTMENT_GUARDS], 'pattern, department')} WHERE regexp_matches(t, pattern)),
    s AS (SELECT id, department, round(sum(weight), 6) AS score FROM w GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, department) AS rn, lead(score, 1, 0) OVER (PARTITION BY id ORDER BY score DESC, department) AS nxt FROM s)"""


def category_ranking(t):
    return op.ranked({d: op.total(t, [(x, category_weight(k, x)) for _, dep, k, x in TERMS if dep == d]) + sum((F.when(t.rlike(p), BONUS).otherwise(0.0) for _, p, v in hotel.DEPARTMENT_GUARDS if v == d), F.lit(0.0)) for d in DEPARTMENTS})


CONFIDENCE = "CASE WHEN score >= 6 AND score - nxt >= 1.5 THEN 0.95 WHEN score >= 3 AND score - nxt >= 1.5 THEN 0.85 WHEN score >= 3 THEN 0.7 ELSE 0.5 END"


def category_columns(r):
    score, nxt = -F.get(r, F.lit(0))["neg"], -F.coalesce(F.get(r, F.lit(1))["neg"], F.lit(0.0))
    conf = F.when((score >= 6) & (F.round(score - nxt, 6) >= 1.5), 0.95).when((score >= 3) & (F.round(score - nxt, 6) >= 1.5), 0.85).when(score >= 3, 0.7).otherwise(0.5)
    return F.get(r, F.lit(0))["label"], score, conf


@query("cls_category_rules", f"WITH {cues_sql('reviews')}, {HITS}, {CATEGORY_SQL} SELECT id, department AS category, CAST(score AS DOUBLE) AS score, CAST({CONFIDENCE.replace('score - nxt', 'round(score - nxt, 6)')} AS DOUBLE) AS confidence FROM r WHERE rn = 1")
def cls_category_rules(spark, d):
    """The category of each text with any term, its score and a confidence from score and margin."""
    r = cued(spark, d, "reviews").transform(lambda x: op.settled(x, r=category_ranking(F.col("t")))).select("id", "r").where("size(r) > 0")
    label, score, conf = category_columns(F.col("r"))
    return r.select("id", label.alias("category"), score.alias("score"), conf.alias("confidence"))


@query("cls_category_service", f"WITH {cues_sql('entity_comments', columns='id')}, {HITS}, {CATEGORY_SQL}, c AS (SELECT *, {CONFIDENCE.replace('score - nxt', 'round(score - nxt, 6)')} AS confidence FROM r WHERE rn = 1) SELECT x.id, CASE WHEN c.confidence >= 0.85 THEN c.department WHEN x.department IS NOT NULL THEN x.department WHEN c.id IS NOT NULL THEN c.department ELSE 'guest_relations' END AS category, CASE WHEN c.confidence >= 0.85 THEN 'rules' WHEN x.department IS NOT NULL THEN 'stored' WHEN c.id IS NOT NULL THEN 'rules' ELSE 'default' END AS source FROM entity_comments x LEFT JOIN c ON x.id = c.id")
def cls_category_service(spark, d):
    """Ordered candidates: sure rules, the stored decision, unsure rules, the default."""
    r = cued(spark, d, "entity_comments", "department").transform(lambda x: op.settled(x, r=category_ranking(F.col("t")))).select("id", "department", "r")
    label, _, conf = category_columns(F.col("r"))
    some, sure = F.size("r") > 0, (F.size("r") > 0) & (conf >= 0.85)
    category = F.when(sure, label).when(F.col("department").isNotNull(), F.col("department")).when(some, label).otherwise("guest_relations")
    source = F.when(sure, "rules").when(F.col("department").isNotNull(), "stored").when(some, "rules").otherwise("default")
    return r.select("id", category.alias("category"), source.alias("source"))


@query("cls_platform_dept", f"""WITH {cues_sql('entity_comments', columns='id')}, {HITS}, n AS (SELECT id, department, count(*) AS n FROM h GROUP BY 1, 2), b AS (SELECT id, list(department ORDER BY n DESC, department) AS found FROM n GROUP BY 1)
    SELECT x.id, coalesce(CASE WHEN list_contains(found, x.department) THEN x.department END, found[1], 'guest_relations') AS department, coalesce(list_contains(found, x.department), false) AS consensus FROM entity_comments x LEFT JOIN b ON b.id = x.id""")
def cls_platform_dept(spark, d):
    """The stored department where at least one keyword speaks for it, else the one of most keywords."""
    counts = {x: op.total(F.col("t"), [(t, 1.0) for _, dep, _, t in TERMS if dep == x]) for x in DEPARTMENTS}
    r = cued(spark, d, "entity_comments", "department").transform(lambda x: op.settled(x, r=op.ranked(counts))).select("id", F.col("department").alias("stored"), "r")
    trusted = F.coalesce(F.exists("r", lambda x: x["label"] == F.col("stored")), F.lit(False))
    return r.select("id", F.when(trusted, F.col("stored")).when(F.size("r") > 0, F.get("r", F.lit(0))["label"]).otherwise("guest_relations").alias("department"), trusted.alias("consensus"))


TIER_SQL = "CASE WHEN trim(term) = trim(t) THEN 0.95 WHEN n_words > 1 THEN 0.90 WHEN list_contains(string_split_regex(t, '[^\\p{L}\\p{N}]+'), trim(term)) THEN 0.85 ELSE round(least(0.70 + 0.01 * length(trim(term)), 0.84), 4) END"


@query("cls_ontology_term", f"WITH {cues_sql('entity_comments')}, {HITS}, c AS (SELECT id, aspect, term, CAST({TIER_SQL} AS DOUBLE) AS confidence FROM h), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY confidence DESC, length(trim(term)) DESC, term) AS rn FROM c) SELECT id, aspect, term, confidence FROM r WHERE rn = 1")
def cls_ontology_term(spark, d):
    """The best term of each text: the whole text .95, several words .90, a word .85, part of a word by length."""
    t = F.col("t")
    tokens = F.col("w")
    each = []
    for a, _, _, term in TERMS:
        x = term.strip()
        part = F.lit(round(min(0.70 + 0.01 * len(x), 0.84), 4))
        tier = F.when(F.trim(t) == x, 0.95).otherwise(F.lit(0.90) if " " in x else F.when(F.array_contains(tokens, x), 0.85).otherwise(part))
        each.append(F.when(op.cue(t, term), F.struct((-tier).alias("neg"), F.lit(-len(x)).alias("n"), F.lit(term).alias("term"), F.lit(a).alias("aspect"))))
    rows = op.settled(cued(spark, d, "entity_comments"), w=tx.words_of(t))
    return rows.select("id", F.array_min(F.array_compact(F.array(*each))).alias("b")).where("b IS NOT NULL").select("id", "b.aspect", "b.term", (-F.col("b.neg")).alias("confidence"))


@query("cls_ontology_aspect", f"""WITH {cues_sql('entity_comments', columns='id, entity_type')}, {HITS}, c AS (SELECT id, aspect, max(CASE WHEN kind = 'synonym' THEN 2.8 ELSE CASE n_words WHEN 1 THEN 2.0 WHEN 2 THEN 2.5 ELSE 3.0 END + round(0.1 * length(trim(term)), 1) END) AS score FROM h GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, aspect) AS rn FROM c)
    SELECT f.id, coalesce(r.aspect, v.aspect, 'general') AS aspect, CAST(CASE WHEN r.id IS NOT NULL THEN least(0.99, round(0.5 + score / 10, 4)) WHEN v.aspect IS NOT NULL THEN 0.82 ELSE 0.4 END AS DOUBLE) AS confidence
    FROM f LEFT JOIN r ON f.id = r.id AND rn = 1 LEFT JOIN {values([(e, dep) for e, dep in SERVICE.items()], 'entity_type, aspect')} ON f.entity_type = v.entity_type""")
def cls_ontology_aspect(spark, d):
    """The aspect of the strongest term; without one what the kind of entity answers for (.82), else general (.4)."""
    t = F.col("t")
    scores = {}
    for aspect in dict.fromkeys(a for a, _, _, _ in TERMS):
        own = [F.when(op.cue(t, x), round(2.8 if k == "synonym" else {1: 2.0, 2: 2.5}.get(len(x.strip().split(" ")), 3.0) + round(0.1 * len(x.strip()), 1), 4)).otherwise(0.0) for a, _, k, x in TERMS if a == aspect]
        scores[aspect] = F.greatest(*own, F.lit(0.0))
    r = cued(spark, d, "entity_comments", "entity_type").transform(lambda x: op.settled(x, r=op.ranked(scores))).select("id", "entity_type", "r")
    back = F.element_at(F.create_map(*[F.lit(x) for kv in SERVICE.items() for x in kv]), F.col("entity_type"))
    some = F.size("r") > 0
    conf = F.when(some, F.least(F.lit(0.99), F.round(0.5 - F.get("r", F.lit(0))["neg"] / 10, 4))).when(back.isNotNull(), 0.82).otherwise(0.4)
    return r.select("id", F.coalesce(F.when(some, F.get("r", F.lit(0))["label"]), back, F.lit("general")).alias("aspect"), conf.alias("confidence"))


GUARDS = hotel.DEPARTMENT_GUARDS


@query("cls_ontology_service", f"""WITH {cues_sql('entity_comments', columns='id, domain, department, entity_type')}, {HITS}, {FRAME_SQL}, b AS (SELECT id, arg_min(aspect, place) AS aspect FROM p WHERE score >= 0.75 * top GROUP BY 1)
    SELECT f.id, coalesce({ladder_sql(GUARDS)}, d.department, f.department, 'guest_relations') AS department, coalesce(b.aspect, 'general') AS aspect, f.domain
    FROM f LEFT JOIN b ON f.id = b.id LEFT JOIN (SELECT DISTINCT aspect, department FROM {TERM_ROWS}) d ON d.aspect = b.aspect""".replace("SELECT f.*, v.*", "SELECT f.id, f.t, v.*"))
def cls_ontology_service(spark, d):
    """Department of a comment: a guard, the frame's department, the stored one, the default."""
    place = F.create_map(*[F.lit(x) for i, a in enumerate(hotel.FRAME_PRIORITY) for x in (a, i)])
    home = F.create_map(*[F.lit(x) for a, dep in dict((a, dep) for a, dep, _, _ in TERMS).items() for x in (a, dep)])
    rows = cued(spark, d, "entity_comments", "domain", "department").transform(lambda x: op.settled(x, r=op.ranked(frame_scores(F.col("t")))))
    near = F.filter("r", lambda x: x["neg"] <= 0.75 * F.get("r", F.lit(0))["neg"])
    best = F.array_min(F.transform(near, lambda x: F.struct(F.element_at(place, x["label"]).alias("place"), x["label"].alias("label"))))["label"]
    rows = rows.withColumn("aspect", F.when(F.size("r") > 0, best))
    dep = op.first_match(F.col("t"), GUARDS, F.coalesce(F.element_at(home, F.col("aspect")), F.col("department"), F.lit("guest_relations")))
    return rows.select("id", dep.alias("department"), F.coalesce("aspect", F.lit("general")).alias("aspect"), "domain")


# ---- polarity
SIGNED = [*hotel.POSITIVE.items(), *((w, -x) for w, x in hotel.NEGATIVE.items())]


def in_list(words) -> str:
    return "(" + ", ".join(map(lit, words)) + ")"


def polarity_sql(source: str, columns: str = "*") -> str:
    return f"""{cues_sql(source, columns=columns)}, k AS (SELECT id, list_filter(string_split_regex(folded, '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '') AS w FROM f), u AS (SELECT id, w, unnest(range(1, len(w) + 1)) AS i FROM k),
    x AS (SELECT id, w[i] AS word, CASE WHEN i > 1 THEN w[i - 1] ELSE '' END AS b1, CASE WHEN i > 2 THEN w[i - 2] ELSE '' END AS b2, coalesce(w[i + 1], '') AS a1 FROM u),
    y AS (SELECT id, weight * CASE WHEN b1 IN {in_list(hotel.NEGATES_NEXT)} OR b2 IN {in_list(hotel.NEGATES_NEXT)} OR a1 IN {in_list(hotel.NEGATES_BEFORE)} THEN {op.NEGATED} ELSE 1 END * CASE WHEN b1 IN {in_list(hotel.STRENGTHENS)} THEN {op.STRENGTHENED} ELSE 1 END AS x FROM x JOIN {values(SIGNED, 'word, weight')} USING (word)),
    z AS (SELECT id, count(*) FILTER (x > 0) AS positive, count(*) FILTER (x < 0) AS negative, sum(x) AS words FROM y GROUP BY 1),
    ph AS (SELECT id, sum(weight) AS phrases FROM f, {values(hotel.PHRASES.items(), 'phrase, weight')} WHERE contains(folded, phrase) GROUP BY 1),
    q AS (SELECT f.*, coalesce(positive, 0) AS positive, coalesce(negative, 0) AS negative, round(coalesce(words, 0), 6) AS words, round(coalesce(phrases, 0), 6) AS phrases FROM f LEFT JOIN z USING (id) LEFT JOIN ph USING (id)),
    s AS (SELECT *, round(greatest(-1.0, least(1.0, (words + phrases) / 4 * CASE WHEN {manner_sql('hyperbole')} THEN 2 ELSE 1 END)), 6) AS score FROM q)"""


def manner_sql(name: str, t: str = "t") -> str:
    return "(" + " AND ".join(f"regexp_matches({'trim(' + t + ')' if name == 'short' else t}, {lit(p)})" for p in hotel.MANNERS[name]) + ")"


def opinions(spark, d, name: str, *columns: str):
    rows = op.settled(cued(spark, d, name, *columns, "comment"), p=op.polarity(F.col("comment")))
    return op.settled(rows, score=op.text_score(F.col("p"), F.col("t")))


@query("cls_lexicon_hits", f"WITH {polarity_sql('reviews')} SELECT id, CAST(positive AS INT) AS positive, CAST(negative AS INT) AS negative, CAST(words AS DOUBLE) AS score FROM s")
def cls_lexicon_hits(spark, d):
    """Positive and negative words with negation and strengthening; NULL texts have none."""
    return opinions(spark, d, "reviews").select("id", "p.positive", "p.negative", F.col("p.words").alias("score"))


@query("cls_phrase_patterns", f"WITH {cues_sql('reviews')} SELECT id, phrase, CAST(weight AS DOUBLE) AS weight FROM f, {values(hotel.PHRASES.items(), 'phrase, weight')} WHERE contains(folded, phrase)")
def cls_phrase_patterns(spark, d):
    f = tx.folded(F.col("comment"))
    hits = F.array_compact(F.array(*[F.when(F.contains(f, F.lit(p)), F.struct(F.lit(p).alias("phrase"), F.lit(w).alias("weight"))) for p, w in hotel.PHRASES.items()]))
    return table(spark, d, "reviews").select("id", F.explode(hits).alias("h")).select("id", "h.phrase", "h.weight")


LABEL = "CASE WHEN {0} > {1} THEN 'Positive' WHEN {0} < -{1} THEN 'Negative' ELSE 'Neutral' END"


def label(score, edge: float):
    return F.when(score > edge, "Positive").when(score < -edge, "Negative").otherwise("Neutral")


@query("cls_sentiment_text", f"WITH {polarity_sql('reviews')} SELECT id, CAST(score AS DOUBLE) AS score, {LABEL.format('score', 0.08)} AS label FROM s WHERE comment IS NOT NULL")
def cls_sentiment_text(spark, d):
    return opinions(spark, d, "reviews").where("comment IS NOT NULL").select("id", "score", label(F.col("score"), 0.08).alias("label"))


STARS = {5: 0.9, 4: 0.5, 3: 0.0, 2: -0.5, 1: -0.9}
CASCADE = ("manipulation", "hyperbole", "humor", "casual", "short")
RATED_SQL = f"""r AS (SELECT *, CASE rating {' '.join(f'WHEN {k} THEN {v}' for k, v in STARS.items())} END AS stars, CASE {' '.join(f"WHEN {manner_sql(m)} THEN '{m}'" for m in CASCADE)} WHEN positive >= 2 AND negative >= 2 THEN 'mixed' ELSE 'plain' END AS stage FROM s WHERE comment IS NOT NULL),
    m AS (SELECT id, stage, round(CASE WHEN stars IS NULL THEN score WHEN stage IN ('manipulation', 'short') THEN stars WHEN stage = 'hyperbole' THEN sign(score) * 0.9 WHEN stage = 'humor' THEN 0.5 * score + 0.5 * stars WHEN stage = 'mixed' THEN 0.5 * score + 0.5 * stars WHEN stage = 'casual' THEN 0.6 * score + 0.4 * stars ELSE 0.7 * score + 0.3 * stars END, 4) AS final FROM r)"""


@query("cls_sentiment_rated", f"WITH {polarity_sql('reviews')}, {RATED_SQL} SELECT id, stage, CAST(final AS DOUBLE) AS score, {LABEL.format('final', 0.1)} AS label FROM m")
def cls_sentiment_rated(spark, d):
    """Text and rating together: the first manner of writing that applies decides how they are weighed."""
    s = opinions(spark, d, "reviews", "rating").where("comment IS NOT NULL")
    stars = F.element_at(F.create_map(*[F.lit(x) for kv in STARS.items() for x in kv]), F.col("rating"))
    stage = F.coalesce(*[F.when(op.manner(F.col("t"), m), m) for m in CASCADE], F.when((F.col("p.positive") >= 2) & (F.col("p.negative") >= 2), "mixed"), F.lit("plain"))
    s = s.select("id", "score", stars.alias("stars"), stage.alias("stage"))
    x, y, g = F.col("score"), F.col("stars"), F.col("stage")
    final = F.when(y.isNull(), x).when(g.isin("manipulation", "short"), y).when(g == "hyperbole", F.signum(x) * 0.9).when(g.isin("humor", "mixed"), 0.5 * x + 0.5 * y).when(g == "casual", 0.6 * x + 0.4 * y).otherwise(0.7 * x + 0.3 * y)
    return s.select("id", "stage", F.round(final, 4).alias("score")).withColumn("label", label(F.col("score"), 0.1))


@query("cls_star_predict", f"WITH {polarity_sql('reviews')} SELECT id, CAST(CASE WHEN score >= 0.6 THEN 5 WHEN score >= 0.15 THEN 4 WHEN score > -0.15 THEN 3 WHEN score > -0.6 THEN 2 ELSE 1 END AS INT) AS stars FROM s WHERE comment IS NOT NULL")
def cls_star_predict(spark, d):
    s = F.col("score")
    return opinions(spark, d, "reviews").where("comment IS NOT NULL").select("id", F.when(s >= 0.6, 5).when(s >= 0.15, 4).when(s > -0.15, 3).when(s > -0.6, 2).otherwise(1).alias("stars"))


for _name in ("manipulation", "humor", "hyperbole", "casual"):

    @query(f"cls_{_name}", f"WITH {cues_sql('reviews')} SELECT id, {manner_sql(_name)} AS detected FROM f")
    def _manner(spark, d, name=_name):
        """Whether a text shows all signs of the manner of writing; NULL and '' don't."""
        return cued(spark, d, "reviews").select("id", op.manner(F.col("t"), name).alias("detected"))


@query("cls_contradiction", f"WITH {polarity_sql('reviews')} SELECT id, rating, CAST(score AS DOUBLE) AS score FROM s WHERE rating >= 4 AND score < -0.3 OR rating BETWEEN 1 AND 2 AND score > 0.3")
def cls_contradiction(spark, d):
    """Texts that say the opposite of their rating."""
    s = opinions(spark, d, "reviews", "rating")
    return s.where("rating >= 4 AND score < -0.3 OR rating BETWEEN 1 AND 2 AND score > 0.3").select("id", "rating", "score")


# ---- decisions
@query("cls_aspect_resolve", f"""WITH {cues_sql('reviews')}, {HITS}, {FRAME_SQL}, b AS (SELECT id, arg_min(aspect, place) AS aspect FROM p WHERE score >= 0.75 * top GROUP BY 1)
    SELECT b.id, aspect, coalesce({ladder_sql(GUARDS)}, d.department) AS department, CASE WHEN {ladder_sql(GUARDS)} IS NULL OR {ladder_sql(GUARDS)} = d.department THEN aspect ELSE aspect || ' (' || {ladder_sql(GUARDS)} || ')' END AS label
    FROM b JOIN f USING (id) JOIN (SELECT DISTINCT aspect, department FROM {TERM_ROWS}) d USING (aspect)""")
def cls_aspect_resolve(spark, d):
    """Aspect, department and label of each text with any cue: the frame decides, a guard can move the department."""
    frames = cls_frames(spark, d).where("frame <> 'other'")
    home = F.create_map(*[F.lit(x) for a, dep in dict((a, dep) for a, dep, _, _ in TERMS).items() for x in (a, dep)])
    rows = cued(spark, d, "reviews").join(frames, "id").withColumn("own", F.element_at(home, F.col("frame")))
    rows = rows.withColumn("department", op.first_match(F.col("t"), GUARDS, F.col("own")))
    return rows.select("id", F.col("frame").alias("aspect"), "department", F.when(F.col("department") == F.col("own"), F.col("frame")).otherwise(F.concat("frame", F.lit(" ("), "department", F.lit(")"))).alias("label"))


@query("cls_sentiment_modifiers", f"WITH {polarity_sql('entity_comments', 'id, comment')} SELECT id, CAST(coalesce({ladder_sql(hotel.SENTIMENT_MODIFIERS)}, score) AS DOUBLE) AS score, {ladder_sql([(n, p, n) for n, p, _ in hotel.SENTIMENT_MODIFIERS])} AS modifier FROM s WHERE comment IS NOT NULL")
def cls_sentiment_modifiers(spark, d):
    """The first cue class found replaces the score."""
    s = opinions(spark, d, "entity_comments").where("comment IS NOT NULL")
    t = F.col("t")
    name = op.first_match(t, [(n, p, n) for n, p, _ in hotel.SENTIMENT_MODIFIERS], F.lit(None).cast("string"))
    return s.select("id", op.first_match(t, hotel.SENTIMENT_MODIFIERS, F.col("score")).alias("score"), name.alias("modifier"))


@query("cls_dept_guards", f"WITH {cues_sql('entity_comments')} SELECT id, coalesce({ladder_sql(GUARDS)}, department) AS department, {ladder_sql([(n, p, n) for n, p, _ in GUARDS])} AS guard FROM f")
def cls_dept_guards(spark, d):
    t = F.col("t")
    return cued(spark, d, "entity_comments", "department").select("id", op.first_match(t, GUARDS, F.col("department")).alias("department"), op.first_match(t, [(n, p, n) for n, p, _ in GUARDS], F.lit(None).cast("string")).alias("guard"))


def clause_decisions(spark, d, name: str):
    """One row per clause of a table's comments with its whole decision."""
    rows = cl.with_clauses(table(spark, d, name).select("id", F.col("rating") if name == "reviews" else F.lit(None).cast("int").alias("rating"), "comment"), "comment")
    t = F.col("t")
    rows = op.settled(rows, t=op.cue_text(F.col("clause")), p=op.polarity(F.col("clause")))
    rows = op.settled(rows, r=category_ranking(t), fr=op.ranked(frame_scores(t)))
    score = op.first_match(t, hotel.SENTIMENT_MODIFIERS, op.text_score(F.col("p"), t))
    label_, points, conf = category_columns(F.col("r"))
    some = F.size("r") > 0
    rows = op.settled(rows, score=score)
    rows = rows.select("id", "clause_no", "start_pos", "clause", "t", "score", F.when(some, label_).alias("category"), F.when(some, points).otherwise(0.0).alias("points"), F.when(some, conf).otherwise(0.4).alias("confidence"), F.when(F.size("fr") > 0, F.get("fr", F.lit(0))["label"]).otherwise("general").alias("aspect"))
    dep = op.first_match(t, GUARDS, F.coalesce("category", F.lit("guest_relations")))
    severity = F.coalesce(*[F.when((F.col("score") <= 0) & t.rlike(p), s) for s, p in hotel.SEVERITY], F.lit("low"))
    out = rows.select("*", dep.alias("department"), label(F.col("score"), 0.08).alias("sentiment"), severity.alias("severity"))
    hours = F.element_at(F.create_map(*[F.lit(x) for kv in hotel.SLA_HOURS.items() for x in kv]), F.col("severity"))
    cause = op.first_match(t, [(n, p, n) for n, p in hotel.ROOT_CAUSES], F.lit("other"))
    family = F.element_at(F.create_map(*[F.lit(x) for kv in hotel.FAMILIES.items() for x in kv]), F.col("department"))
    level = F.when(F.col("sentiment") == "Negative", F.when(F.col("severity").isin("emergency", "critical"), 1).when(F.col("severity") == "high", 2).otherwise(3)).when(F.col("sentiment") == "Neutral", 4).otherwise(5)
    return out.select(
        "id", "clause_no", "start_pos", "clause", "aspect", "department", "category", "points", "confidence", "score", "sentiment", "severity", hours.alias("sla_hours"), level.alias("priority"), cause.alias("root_cause"),
        family.alias("family"), (F.col("category").isNotNull() & (F.col("category") != F.col("department"))).alias("guarded"), (F.col("sentiment") == "Negative").alias("actionable"),
    )


@query("cls_clause_full")
def cls_clause_full(spark, d):
    """The decision of every clause of every review (18 fields). Without SQL: clauses come from the splitter; tests hold it to fixtures."""
    return clause_decisions(spark, d, "reviews")


@query("cls_mixed_review")
def cls_mixed_review(spark, d):
    """Reviews with praise and complaints: how many clauses of each, the strongest category of each, and what outweighs."""
    c = clause_decisions(spark, d, "reviews").select("id", "clause_no", "category", "score", "sentiment")
    strongest = lambda s, by: F.min_by("category", F.when(F.col("sentiment") == s, F.struct(by, "clause_no")))
    g = c.groupBy("id").agg(F.count_if(F.col("sentiment") == "Positive").alias("praise"), F.count_if(F.col("sentiment") == "Negative").alias("complaints"), strongest("Positive", (-F.col("score")).alias("k")).alias("praised"), strongest("Negative", F.col("score").alias("k")).alias("complained"), F.round(F.avg("score"), 4).alias("overall"))
    return g.where("praise > 0 AND complaints > 0").withColumn("label", label(F.col("overall"), 0.1))


CAUSE_LADDER = [(n, p, n) for n, p in hotel.ROOT_CAUSES]
SEVERITY_LADDER = [(n, p, n) for n, p in hotel.SEVERITY]


@query("cls_root_cause", f"WITH {cues_sql('entity_comments')} SELECT id, {ladder_sql(CAUSE_LADDER, default=lit('other'))} AS cause FROM f WHERE comment IS NOT NULL")
def cls_root_cause(spark, d):
    return cued(spark, d, "entity_comments", "comment").where("comment IS NOT NULL").select("id", op.first_match(F.col("t"), CAUSE_LADDER, F.lit("other")).alias("cause"))


SEV_SQL = f"sv AS (SELECT id, department, is_resolution, t, score, CASE WHEN score > 0.3 THEN 'low' ELSE {ladder_sql(SEVERITY_LADDER, default=lit('low'))} END AS severity, {ladder_sql(CAUSE_LADDER, default=lit('other'))} AS cause FROM s WHERE comment IS NOT NULL)"
URGENCY = "CASE WHEN severity IN ('emergency', 'critical') THEN 'immediate' WHEN severity = 'high' AND score < 0 THEN 'today' WHEN severity IN ('high', 'medium') THEN 'soon' ELSE 'routine' END"


def severities(spark, d):
    s = opinions(spark, d, "entity_comments", "department", "is_resolution").where("comment IS NOT NULL")
    sev = F.when(F.col("score") > 0.3, "low").otherwise(op.first_match(F.col("t"), SEVERITY_LADDER, F.lit("low")))
    return s.select("id", "department", "is_resolution", "t", "score", sev.alias("severity"), op.first_match(F.col("t"), CAUSE_LADDER, F.lit("other")).alias("cause"))


EC = "id, comment, department, is_resolution"


@query("cls_sev_urgency", f"WITH {polarity_sql('entity_comments', EC)}, {SEV_SQL} SELECT id, severity, {URGENCY} AS urgency FROM sv")
def cls_sev_urgency(spark, d):
    """Severity by the first matching pattern, milder where the text is positive; urgency from both."""
    return severities(spark, d).select("id", "severity", F.expr(URGENCY).alias("urgency"))


SUGGEST = "CASE " + " ".join("WHEN " + (" AND ".join([f"department = {lit(dep)}"] * (dep != "*") + [f"cause = {lit(c)}"] * (c != "*")) or "true") + f" THEN {lit(text)}" for dep, c, text in hotel.SUGGESTIONS) + " END"
HOURS = "CASE severity " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in hotel.SLA_HOURS.items()) + " END"


@query("cls_recommend", f"WITH {polarity_sql('entity_comments', EC)}, {SEV_SQL} SELECT id, CAST({HOURS} AS INT) AS sla_hours, severity IN ('emergency', 'critical') AS escalate, coalesce(department, 'guest_relations') AS assignee, {SUGGEST} AS suggestion FROM sv")
def cls_recommend(spark, d):
    return severities(spark, d).select("id", F.expr(f"CAST({HOURS} AS INT)").alias("sla_hours"), F.col("severity").isin("emergency", "critical").alias("escalate"), F.coalesce("department", F.lit("guest_relations")).alias("assignee"), F.expr(SUGGEST).alias("suggestion"))


@query("cls_suggestion", f"WITH {polarity_sql('entity_comments', EC)}, {SEV_SQL} SELECT id, {SUGGEST} AS suggestion FROM sv WHERE score < 0")
def cls_suggestion(spark, d):
    """Of unhappy comments the first suggestion whose department and cause fit; * fits any."""
    return severities(spark, d).where("score < 0").select("id", F.expr(SUGGEST).alias("suggestion"))


TRIGGERS = (("inspect", "cause = 'maintenance'"), ("page_manager", "severity IN ('emergency', 'critical')"), ("recover_guest", "score < -0.3 AND NOT coalesce(is_resolution, false)"), ("ask_for_review", "score > 0.5"), ("plan_staff", "cause = 'staffing'"))


@query("cls_triggers", f"WITH {polarity_sql('entity_comments', EC)}, {SEV_SQL}, g AS (SELECT id, concat_ws(',', {', '.join(f'CASE WHEN {c} THEN {lit(n)} END' for n, c in TRIGGERS)}) AS triggers FROM sv) SELECT * FROM g WHERE triggers <> ''")
def cls_triggers(spark, d):
    t = F.array_compact(F.array(*[F.expr(f"CASE WHEN {c} THEN {lit(n)} END") for n, c in TRIGGERS]))
    return severities(spark, d).select("id", F.array_join(t, ",").alias("triggers")).where("triggers <> ''")


@query("cls_emotion", f"WITH {cues_sql('reviews')} SELECT id, {ladder_sql([(e, p, e) for e, _, p, _ in hotel.EMOTIONS], default=lit('neutral'))} AS emotion, {ladder_sql([(e, p, b) for e, b, p, _ in hotel.EMOTIONS], default=lit('none'))} AS branch, CAST({ladder_sql([(e, p, c) for e, _, p, c in hotel.EMOTIONS], default='0.5')} AS DOUBLE) AS confidence FROM f WHERE comment IS NOT NULL")
def cls_emotion(spark, d):
    t = F.col("t")
    pick = lambda k, default: op.first_match(t, [(x[0], x[2], x[k]) for x in hotel.EMOTIONS], default)
    return cued(spark, d, "reviews", "comment").where("comment IS NOT NULL").select("id", pick(0, F.lit("neutral")).alias("emotion"), pick(1, F.lit("none")).alias("branch"), pick(3, F.lit(0.5)).alias("confidence"))


ROOM_SQL = "coalesce(" + ", ".join(f"nullif(regexp_extract(t, {lit(p)}, 1), '')" for p in hotel.ROOM_PATTERNS) + ")"


@query("cls_room_extract", f"WITH {cues_sql('entity_comments')} SELECT id, {ROOM_SQL} AS room FROM f WHERE {ROOM_SQL} IS NOT NULL")
def cls_room_extract(spark, d):
    """The room a comment names, by patterns of seven wordings in order."""
    room = F.coalesce(*[F.nullif(F.regexp_extract("t", p, 1), F.lit("")) for p in hotel.ROOM_PATTERNS])
    return cued(spark, d, "entity_comments").select("id", room.alias("room")).where("room IS NOT NULL")


OPS = values([tuple(x) for x in hotel.OPERATIONS], "pattern_name, pattern, observation, impact, process_failure, procedure, action")
FACTS = ("observation", "impact", "process_failure", "procedure", "action")


@query("cls_hodip_facts", f"WITH {cues_sql('entity_comments')}, h AS (SELECT id, v.* FROM f JOIN {OPS} ON regexp_matches(t, pattern)), g AS (" + " UNION ALL ".join(f"SELECT id, pattern_name, {i + 1} AS fact_no, '{x}' AS fact_type, {x} AS fact FROM h" for i, x in enumerate(FACTS)) + ") SELECT id, pattern_name, CAST(fact_no AS INT) AS fact_no, fact_type, fact FROM g")
def cls_hodip_facts(spark, d):
    """For every operational pattern of a comment its chain of facts, one row each, in order."""
    t = F.col("t")
    hits = F.array_compact(F.array(*[F.when(t.rlike(o[1]), F.struct(F.lit(o[0]).alias("pattern_name"), F.array(*[F.struct(F.lit(i + 1).alias("fact_no"), F.lit(x).alias("fact_type"), F.lit(o[2 + i]).alias("fact")) for i, x in enumerate(FACTS)]).alias("facts"))) for o in hotel.OPERATIONS]))
    return cued(spark, d, "entity_comments").select("id", F.explode(hits).alias("h")).select("id", "h.pattern_name", F.explode("h.facts").alias("f")).select("id", "pattern_name", "f.fact_no", "f.fact_type", "f.fact")


@query("cls_gold_family", f"""WITH {cues_sql('entity_comments')}, {HITS.replace('SELECT f.*, v.*', 'SELECT f.id, v.department')}, n AS (SELECT id, department, count(*) AS n FROM h GROUP BY 1, 2), b AS (SELECT id, department, row_number() OVER (PARTITION BY id ORDER BY n DESC, department) AS rn FROM n),
    fam AS (SELECT * FROM {values(hotel.FAMILIES.items(), 'department, family')})
    SELECT x.id, f1.family, f2.family AS found_family, f1.family = f2.family OR (f1.family, f2.family) IN ({', '.join(f"('{a}', '{b}'), ('{b}', '{a}')" for a, b in hotel.AGREEING)}) AS agree
    FROM entity_comments x JOIN b ON x.id = b.id AND rn = 1 LEFT JOIN fam f1 ON f1.department = x.department LEFT JOIN fam f2 ON f2.department = b.department""")
def cls_gold_family(spark, d):
    """Family of the stored department, of the department of most terms, and whether the two count as agreeing."""
    fam = F.create_map(*[F.lit(x) for kv in hotel.FAMILIES.items() for x in kv])
    counts = {x: op.total(F.col("t"), [(t, 1.0) for _, dep, _, t in TERMS if dep == x]) for x in DEPARTMENTS}
    r = cued(spark, d, "entity_comments", "department").transform(lambda x: op.settled(x, r=op.ranked(counts))).select("id", "department", "r").where("size(r) > 0")
    r = r.select("id", F.element_at(fam, F.col("department")).alias("family"), F.element_at(fam, F.get("r", F.lit(0))["label"]).alias("found_family"))
    pairs = [F.array(F.lit(a), F.lit(b)) for x, y in hotel.AGREEING for a, b in ((x, y), (y, x))]
    agree = (F.col("family") == F.col("found_family")) | F.array("family", "found_family").isin(pairs)
    return r.withColumn("agree", F.when(F.col("family").isNull() | F.col("found_family").isNull(), F.lit(None)).otherwise(agree))


LANGUAGE_WORDS = {"en": "the was were and our with", "tr": "bir cok ve bu icin otel", "de": "der die das und war wir", "ru": "и в не на что был", "fr": "le la les et nous etait", "es": "el los y nos muy pero"}


@query("cls_span_multilingual", f"""WITH {cues_sql('documents', 'text', 'doc_id')}, w AS (SELECT DISTINCT doc_id, unnest(string_split_regex(t, '[^\\p{{L}}\\p{{N}}]+')) AS word FROM f), l AS (SELECT doc_id, v.lang, count(*) AS n FROM w JOIN {values([(w, k) for k, ws in LANGUAGE_WORDS.items() for w in ws.split()], 'word, lang')} USING (word) GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, lang) AS rn FROM l), a AS (SELECT doc_id, string_agg(DISTINCT aspect, ',' ORDER BY aspect) AS aspects FROM f JOIN {TERM_ROWS} ON {HIT} GROUP BY 1)
    SELECT a.doc_id, coalesce(r.lang, 'other') AS words_of, aspects FROM a LEFT JOIN r ON a.doc_id = r.doc_id AND rn = 1""")
def cls_span_multilingual(spark, d):
    """The aspects each document speaks of, whatever its language, and the language of most of its small words."""
    t = op.cue_text(F.col("text"))
    rows = op.settled(table(spark, d, "documents").select("doc_id", "text"), t=t).select("doc_id", "t")
    rows = op.settled(rows, w=F.array_distinct(tx.words_of(F.col("t"))))
    langs = op.ranked({k: F.size(F.array_intersect("w", F.array(*map(F.lit, ws.split())))).cast("double") for k, ws in LANGUAGE_WORDS.items()})
    aspects = F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(op.cue(F.col("t"), x), F.lit(a)) for a, _, _, x in TERMS]))))
    return rows.select("doc_id", F.coalesce(F.get(langs, F.lit(0))["label"], F.lit("other")).alias("words_of"), F.array_join(aspects, ",").alias("aspects")).where("aspects <> ''")


# ---- intents, routes, questions
INTENT_SQL = f"i AS (SELECT id, intent, CASE WHEN regexp_matches(t, words) THEN CASE WHEN regexp_matches(t, words || '.*(' || words || ')') THEN 2 ELSE 1 END ELSE 0 END + CASE WHEN regexp_matches(t, pattern) THEN 2.5 ELSE 0 END AS base, boost FROM f, {values(hotel.INTENTS, 'intent, words, pattern, boost')}), j AS (SELECT id, intent, base + CASE WHEN base > 0 THEN boost ELSE 0 END AS score FROM i), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, intent) AS rn FROM j)"


def intent_ranking(t):
    out = {}
    for name, words, pattern, boost in hotel.INTENTS:
        base = F.when(t.rlike(f"({words}).*({words})"), 2.0).when(t.rlike(words), 1.0).otherwise(0.0) + F.when(t.rlike(pattern), 2.5).otherwise(0.0)
        out[name] = base + F.when(base > 0, boost).otherwise(0.0)
    return op.ranked(out)


INTENT_SQL = INTENT_SQL.replace("regexp_matches(t, words || '.*(' || words || ')')", "regexp_matches(t, '(' || words || ').*(' || words || ')')")


@query("cls_intent", f"WITH {cues_sql('reviews')}, {INTENT_SQL} SELECT id, CASE WHEN score >= 1 THEN intent ELSE 'general_inquiry' END AS intent, CAST(score AS DOUBLE) AS score FROM r WHERE rn = 1")
def cls_intent(spark, d):
    """The intent of the best score: one or two keywords, a pattern, a boost; under 1 a general inquiry."""
    r = cued(spark, d, "reviews").transform(lambda x: op.settled(x, r=intent_ranking(F.col("t")))).select("id", "r")
    score = F.coalesce(-F.get("r", F.lit(0))["neg"], F.lit(0.0))
    return r.select("id", F.when(score >= 1, F.get("r", F.lit(0))["label"]).otherwise("general_inquiry").alias("intent"), score.alias("score"))


FAQ_ROWS = values([(n, w, x, sum(ws.values())) for n, ws, _ in hotel.FAQ for w, x in ws.items()], "faq, word, weight, whole")


@query("ret_faq_match", f"WITH {cues_sql('reviews')}, w AS (SELECT DISTINCT id, unnest(string_split_regex(folded, '[^\\p{{L}}\\p{{N}}]+')) AS word FROM f), s AS (SELECT id, faq, round(sum(weight) / max(whole), 6) AS score FROM w JOIN {FAQ_ROWS} USING (word) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, faq) AS rn FROM s) SELECT id, faq, CAST(score AS DOUBLE) AS score FROM r WHERE rn = 1 AND score >= 0.3")
def ret_faq_match(spark, d):
    """The question whose weighted words a text covers most, from 0.3 on."""
    w = F.array_distinct(tx.words_of(F.coalesce(tx.folded(F.col("comment")), F.lit(""))))
    scores = {n: sum((F.when(F.array_contains("w", x), y).otherwise(0.0) for x, y in ws.items()), F.lit(0.0)) / sum(ws.values()) for n, ws, _ in hotel.FAQ}
    r = table(spark, d, "reviews").select("id", w.alias("w")).transform(lambda x: op.settled(x, r=op.ranked(scores))).select("id", "r").where("size(r) > 0")
    return r.select("id", F.get("r", F.lit(0))["label"].alias("faq"), (-F.get("r", F.lit(0))["neg"]).alias("score")).where("score >= 0.3")


@query("rtr_agent", f"""WITH {cues_sql('reviews')}, {INTENT_SQL}, w AS (SELECT DISTINCT id, unnest(string_split_regex(folded, '[^\\p{{L}}\\p{{N}}]+')) AS word FROM f), q AS (SELECT id, max(score) AS faq FROM (SELECT id, faq, round(sum(weight) / max(whole), 6) AS score FROM w JOIN {FAQ_ROWS} USING (word) GROUP BY 1, 2) GROUP BY 1)
    SELECT f.id, CASE WHEN trim(t) = '' THEN 'clarify' WHEN {ROOM_SQL} IS NOT NULL AND r.score >= 1 THEN 'entity' WHEN faq >= 0.5 THEN 'faq' WHEN r.score >= 2.5 THEN r.intent WHEN length(t) > 300 THEN 'retrieval' WHEN r.score >= 1 THEN 'confirm' ELSE 'clarify' END AS route FROM f JOIN r ON f.id = r.id AND rn = 1 LEFT JOIN q ON q.id = f.id""")
def rtr_agent(spark, d):
    """The first route whose gate is open: a named entity with an intent, a sure question, a sure intent, retrieval for long texts."""
    t = F.col("t")
    w = F.array_distinct(tx.words_of(F.coalesce(tx.folded(F.col("comment")), F.lit(""))))
    faq = F.greatest(*[F.round(sum((F.when(F.array_contains("w", x), y).otherwise(0.0) for x, y in ws.items()), F.lit(0.0)) / sum(ws.values()), 6) for _, ws, _ in hotel.FAQ])
    room = F.coalesce(*[F.nullif(F.regexp_extract("t", p, 1), F.lit("")) for p in hotel.ROOM_PATTERNS])
    rows = cued(spark, d, "reviews", "comment").withColumn("w", w).select("id", "t", intent_ranking(t).alias("r"), faq.alias("faq"), room.alias("room"))
    score = F.coalesce(-F.get("r", F.lit(0))["neg"], F.lit(0.0))
    route = F.when(F.trim("t") == "", "clarify").when(F.col("room").isNotNull() & (score >= 1), "entity").when(F.col("faq") >= 0.5, "faq").when(score >= 2.5, F.get("r", F.lit(0))["label"]).when(F.length("t") > 300, "retrieval").when(score >= 1, "confirm").otherwise("clarify")
    return rows.select("id", route.alias("route"))


# ---- ontology lookups
@query("q_detect_domain", f"WITH {cues_sql('reviews')}, {HITS}, {FRAME_SQL}, r AS (SELECT id, aspect, score, row_number() OVER (PARTITION BY id ORDER BY score DESC, aspect) AS rn FROM s) SELECT id, CAST(rn AS INT) AS rank, aspect AS label, CAST(score AS DOUBLE) AS score FROM r WHERE rn <= 3")
def q_detect_domain(spark, d):
    """The three best frames of each text."""
    s = cued(spark, d, "reviews").select("id", F.posexplode(F.slice(op.ranked(frame_scores(F.col("t"))), 1, 3)).alias("rank", "x"))
    return s.select("id", (F.col("rank") + 1).alias("rank"), "x.label", (-F.col("x.neg")).alias("score"))


@query("q_search_entity", f"WITH {cues_sql('entity_comments')}, {HITS}, e AS (SELECT id, aspect AS entity, 'facility' AS kind FROM h WHERE kind = 'keyword' UNION SELECT id, {ROOM_SQL} AS entity, 'room' AS kind FROM f WHERE {ROOM_SQL} IS NOT NULL) SELECT id, kind, entity FROM e")
def q_search_entity(spark, d):
    """Every entity a comment names: its room and the facilities its keywords stand for."""
    t = F.col("t")
    room = F.coalesce(*[F.nullif(F.regexp_extract("t", p, 1), F.lit("")) for p in hotel.ROOM_PATTERNS])
    found = [F.when(op.cue(t, x), F.struct(F.lit("facility").alias("kind"), F.lit(a).alias("entity"))) for a, _, k, x in TERMS if k == "keyword"]
    found.append(F.when(room.isNotNull(), F.struct(F.lit("room").alias("kind"), room.alias("entity"))))
    return cued(spark, d, "entity_comments").select("id", F.explode(F.array_distinct(F.array_compact(F.array(*found)))).alias("e")).select("id", "e.kind", "e.entity")


@query("q_ontology_stats", f"WITH {cues_sql('documents', 'text', 'doc_id AS id')}, {HITS} SELECT aspect, count(DISTINCT term) AS terms_seen, count(DISTINCT id) AS documents FROM h GROUP BY 1")
def q_ontology_stats(spark, d):
    """Of each aspect how many of its terms the documents use, and in how many documents any stands."""
    t = F.col("t")
    hits = F.array_compact(F.array(*[F.when(op.cue(t, x), F.struct(F.lit(a).alias("aspect"), F.lit(x).alias("term"))) for a, _, _, x in TERMS]))
    rows = op.settled(op.settled(table(spark, d, "documents").select("doc_id", "text"), t=op.cue_text(F.col("text"))), h=hits).select("doc_id", "h")
    terms = rows.select(F.explode("h").alias("h")).groupBy("h.aspect").agg(F.count_distinct("h.term").alias("terms_seen"))
    docs = rows.select(F.explode(F.array_distinct(F.transform("h", lambda x: x["aspect"]))).alias("aspect")).groupBy("aspect").agg(F.count("*").alias("documents"))
    return terms.join(docs, "aspect")


# ---- clauses: without SQL, tests hold the splitter to fixtures and invariants
def register_split(name: str, source: str, text: str, splitter, doc: str) -> None:
    @query(name)
    def run(spark, d):
        return cl.with_clauses(table(spark, d, source).select("id", F.col(text).alias("text")), "text", splitter)

    run.__doc__ = doc


register_split("seg_rule_split", "reviews", "comment", lambda t: cl.split(t) if t else [], "Clauses before merging, by rank of separator.")
register_split("seg_finalize", "reviews", "comment", lambda t: cl.finalize(t, cl.split(t)) if t else [], "Clauses with connectors taken off and fragments merged.")
register_split("seg_combined", "reviews", "comment", cl.clauses, "Clauses, each split once more on its own; the finer result counts.")
register_split("seg_platform", "platform_reviews", "review_text", cl.clauses, "Clauses of the annotation platform's reviews.")
register_split("seg_ml_split", "entity_comments", "comment", cl.clauses, "No trained splitter exists, so the rules decide, as they must where the model is absent.")


@query("seg_masks")
def seg_masks(spark, d):
    """One row per masked place: decimals, times, dates, ordinals, abbreviations, quotations, brackets."""
    return cl.with_clauses(table(spark, d, "reviews").select("id", F.col("comment").alias("text")), "text", lambda t: cl.masked(t) if t else []).withColumnRenamed("clause", "mask").withColumnRenamed("clause_no", "mask_no")


@query("seg_topic_boundary")
def seg_topic_boundary(spark, d):
    """Where a clause passes to another topic without any mark; comments stripped of their punctuation, so that nothing else cuts."""
    bare = F.regexp_replace("comment", r"[.,;:!?…]+", " ")

    def cuts(t):
        k = cl.topic_cut(t, cl.masked(t)) if t else None
        return [(0, k), (k, len(t))] if k is not None else []

    return cl.with_clauses(table(spark, d, "reviews").select("id", bare.alias("text")), "text", cuts)


@query("seg_ve_coordination")
def seg_ve_coordination(spark, d):
    """Every "and" word of the comments, and whether it joins words of one clause or two clauses."""
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("start_pos", T.LongType()), T.StructField("coordination", T.BooleanType())])

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = [(i, m.start() + 1, cl.coordinated(t[: m.start()], t[m.end() :])) for i, t in zip(pdf["id"], pdf["comment"]) for m in cl.AND.finditer(t)]
            yield pd.DataFrame(rows, columns=["id", "start_pos", "coordination"])

    return table(spark, d, "entity_comments").select("id", "comment").where("length(comment) > 0").mapInPandas(run, schema)


SEPARATORS = (", but ", ", ama ", " fakat ", ", aber ", ", mais ", ", pero ", ", но ", " although ", " oysa ", " obwohl ", " хотя ")
LONG_SEPARATORS = ("; ", ", which ", ", bu da ", ", und ", ", и ", ", et ")


@query("seg_simple_mixed", "SELECT id, CASE " + " ".join(f"WHEN contains(comment, '{s}') THEN split_part(comment, '{s}', 1)" for s in SEPARATORS) + " WHEN len(string_split(comment, ' ')) >= 20 THEN CASE " + " ".join(f"WHEN contains(comment, '{s}') THEN split_part(comment, '{s}', 1)" for s in LONG_SEPARATORS) + " WHEN len(string_split(comment, '. ')) >= 3 THEN split_part(comment, '. ', 1) END WHEN len(string_split(comment, '. ')) >= 3 THEN split_part(comment, '. ', 1) END AS first_part FROM reviews WHERE comment IS NOT NULL")
def seg_simple_mixed(spark, d):
    """The part before the first separator: contrasts, for texts of twenty words others too, then the first of three sentences."""
    c = F.col("comment")
    before = lambda seps: [F.when(F.contains(c, F.lit(s)), F.substring_index(c, s, 1)) for s in seps]
    dotted = F.when(F.size(F.split(c, r"\. ")) >= 3, F.substring_index(c, ". ", 1))
    first = F.coalesce(*before(SEPARATORS), F.when(F.size(F.split(c, " ")) >= 20, F.coalesce(*before(LONG_SEPARATORS))), dotted)
    return table(spark, d, "reviews").where("comment IS NOT NULL").select("id", first.alias("first_part"))


META_SQL = "^(tel|tc no|not|note|p\\.?s|edit|guncelleme|update|review|yorum|puan|rating|devami|read more)([^\\p{L}]|$)"


@query("seg_skip", f"WITH {cues_sql('entity_comments')} SELECT id, CASE WHEN length(folded) < 4 THEN 'short' WHEN NOT regexp_matches(folded, '\\p{{L}}') THEN 'no letters' WHEN regexp_matches(folded, '{META_SQL}') AND len(string_split(folded, ' ')) <= 6 THEN 'remark' ELSE 'kept' END AS reason FROM f")
def seg_skip(spark, d):
    """Why a comment says nothing: too short (NULL and '' too), no letters, or a remark about the review."""
    f = F.coalesce(tx.folded(F.col("comment")), F.lit(""))
    reason = F.when(F.length(f) < 4, "short").when(~f.rlike(r"\p{L}"), "no letters").when(f.rlike(META_SQL) & (F.size(F.split(f, " ")) <= 6), "remark").otherwise("kept")
    return table(spark, d, "entity_comments").select("id", reason.alias("reason"))


FLAGS = (("very long", "length(t) > 900"), ("shouting", "upper(comment) = comment AND regexp_matches(comment, '[A-Z]{4}')"), ("positive word in bad review", "rating <= 2 AND positive > negative"), ("negative word in good review", "rating >= 4 AND negative > positive"), ("no aspect", "aspects = 0"), ("rating missing", "rating IS NULL OR rating NOT BETWEEN 1 AND 5"))


@query("cls_heuristic_flags", f"WITH {polarity_sql('reviews')}, a AS (SELECT id, count(*) AS aspects FROM f JOIN {TERM_ROWS} ON {HIT} GROUP BY 1), g AS (SELECT s.*, coalesce(aspects, 0) AS aspects FROM s LEFT JOIN a USING (id) WHERE comment IS NOT NULL), o AS (SELECT id, concat_ws(',', {', '.join(f'CASE WHEN {c} THEN {lit(n)} END' for n, c in FLAGS)}) AS flags FROM g) SELECT * FROM o WHERE flags <> ''")
def cls_heuristic_flags(spark, d):
    """Audit flags of a review, in fixed order."""
    t = F.col("t")
    rows = opinions(spark, d, "reviews", "rating").where("comment IS NOT NULL").withColumn("aspects", op.total(t, [(x, 1.0) for _, _, _, x in TERMS])).select("*", "p.positive", "p.negative")
    flags = F.array_compact(F.array(*[F.expr(f"CASE WHEN {c.replace('regexp_matches', 'regexp_like')} THEN {lit(n)} END") for n, c in FLAGS]))
    return rows.select("id", F.array_join(flags, ",").alias("flags")).where("flags <> ''")
