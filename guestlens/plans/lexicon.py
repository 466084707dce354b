"""Queries of words and vocabularies, retrieval over a fixed index, summaries, lookups of actions and facts, retraining."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from guestlens.functions import text as tx
from guestlens.operators import opinions as op
from guestlens.operators import retrieval as rt
from guestlens.operators import similarity as sim
from guestlens.plans.opinions import cues_sql, lit, values
from guestlens.plans.rules import similarity_sql
from guestlens.registry import query
from guestlens.rulesets import hotel
from guestlens.session import scratch_path
from guestlens.sources import domain
from guestlens.sources.domain import DOMAIN_SQL as D
from guestlens.sources.tables import table

ONLY = D.rstrip().rstrip(",")
SPLIT = "'[^\\p{L}\\p{N}]+'"


def words_sql(source: str, text: str = "comment", key: str = "id") -> str:
    return f"w AS (SELECT {key}, unnest(list_filter(string_split_regex(coalesce({tx.folded_sql(text)}, ''), {SPLIT}), lambda x: x <> '')) AS word FROM {source})"


def words(df: DataFrame, text: str, *keys: str) -> DataFrame:
    return df.select(*keys, F.explode(tx.words_of(F.coalesce(tx.folded(F.col(text)), F.lit("")))).alias("word"))


VOCAB = "vc AS (SELECT word, count(*) AS n FROM w WHERE length(word) >= 4 AND regexp_matches(word, '^\\p{L}+$') GROUP BY 1)"


def vocabulary(spark, d) -> DataFrame:
    """Words of letters only, four at least, of all review comments, with their counts."""
    return words(table(spark, d, "reviews"), "comment").where(r"length(word) >= 4 AND regexp_like(word, '^\\p{L}+$')").groupBy("word").agg(F.count("*").alias("n"))


COMMON, RARE = 20, 2


CHANGED = "list_filter(range(1, length(a) + 1), lambda i: substr(a, i, 1) <> substr(b, i, 1))"
ONE_LESS = "list_contains(list_transform(range(1, length({0}) + 1), lambda i: substr({0}, 1, i - 1) || substr({0}, i + 1)), {1})"


@query("txt_spell_dl1", f"""WITH {words_sql('reviews')}, {VOCAB}, p AS (SELECT r.word AS a, v.word AS b, v.n, {CHANGED.replace('a,', 'r.word,').replace('b,', 'v.word,').replace('(a)', '(r.word)')} AS m FROM vc r JOIN vc v ON r.n <= {RARE} AND v.n >= {COMMON} AND length(r.word) >= 5 AND abs(length(r.word) - length(v.word)) <= 1),
    c AS (SELECT a, b, n, NOT (length(a) = length(b) AND len(m) = 2) AS plain FROM p WHERE length(a) = length(b) AND (len(m) = 1 OR len(m) = 2 AND m[2] = m[1] + 1 AND substr(a, m[1], 1) = substr(b, m[2], 1) AND substr(a, m[2], 1) = substr(b, m[1], 1)) OR length(a) = length(b) + 1 AND NOT starts_with(a, b) AND {ONE_LESS.format('a', 'b')} OR length(a) = length(b) - 1 AND {ONE_LESS.format('b', 'a')}),
    k AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY plain, n DESC, b) AS rn FROM c) SELECT a AS word, b AS correction FROM k WHERE rn = 1""")
def txt_spell_dl1(spark, d):
    """Rare words one edit from a common one: pairs that share a deletion are the candidates, so no words are paired at large.

    A transposition goes before other edits; a further letter at the end is a suffix, no error. Words without a correction don't come out.
    """
    path = scratch_path(spark, "vocabulary")
    vocabulary(spark, d).where(f"n <= {RARE} OR n >= {COMMON}").write.parquet(path)
    v = spark.read.parquet(path)
    cut = F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.concat(F.substr(F.col("word"), F.lit(1), i - 1), F.substr(F.col("word"), i + 1)))
    keyed = lambda df: df.select("word", "n", F.explode(F.array_distinct(F.array_append(cut, F.col("word")))).alias("k"))
    rare = keyed(v.where(f"n <= {RARE} AND length(word) >= 5")).select("word", "k")
    pairs = rare.join(keyed(v.where(f"n >= {COMMON}")).select(F.col("word").alias("correction"), "n", "k"), "k").select("word", "correction", "n").distinct()
    a, b = F.col("word"), F.col("correction")
    swapped = F.exists(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.concat(F.substr(a, F.lit(1), i - 1), F.substr(a, i + 1, F.lit(1)), F.substr(a, i, F.lit(1)), F.substr(a, i + 2)) == b)
    plain = F.levenshtein(a, b) == 1
    pairs = pairs.withColumn("plain", plain).where((F.col("plain") | (F.length(a) == F.length(b)) & swapped) & ~((F.length(a) == F.length(b) + 1) & F.startswith(a, b)))
    return pairs.groupBy("word").agg(F.min_by("correction", F.struct("plain", -F.col("n"), "correction")).alias("correction"))


@query("txt_split_glued", f"WITH {words_sql('reviews')}, {VOCAB}, g AS (SELECT word, unnest(range(4, length(word) - 3)) AS i FROM vc WHERE n <= {RARE} AND length(word) >= 8), k AS (SELECT g.word, substr(g.word, 1, i) AS a, substr(g.word, i + 1) AS b, i FROM g) SELECT k.word, arg_max(a || ' ' || b, i) AS text FROM k JOIN vc x ON x.word = a AND x.n >= {COMMON} JOIN vc y ON y.word = b AND y.n >= {COMMON} GROUP BY 1")
def txt_split_glued(spark, d):
    """Rare words that are two common ones without the blank; of several cuts the one with the longest first word."""
    path = scratch_path(spark, "vocabulary")
    vocabulary(spark, d).where(f"n <= {RARE} OR n >= {COMMON}").write.parquet(path)
    v = spark.read.parquet(path)
    known = v.where(f"n >= {COMMON}")
    g = v.where(f"n <= {RARE} AND length(word) >= 8").select("word", F.explode(F.sequence(F.lit(4), F.length("word") - 4)).alias("i"))
    g = g.select("word", "i", F.substr("word", F.lit(1), F.col("i")).alias("a"), F.substr("word", F.col("i") + 1).alias("b"))
    g = g.join(known.select(F.col("word").alias("a")), "a", "left_semi").join(known.select(F.col("word").alias("b")), "b", "left_semi")
    return g.groupBy("word").agg(F.max_by(F.concat_ws(" ", "a", "b"), "i").alias("text"))


# Suffixes of Turkish, English and German words, longest first where one ends in another.
SUFFIXES = "larimizdan lerimizden larimizda lerimizde larindan lerinden larinda lerinde larimiz lerimiz lardan lerden larin lerin lari leri lar ler daki deki ndan nden dan den tan ten nda nde imiz umuz ydu ydi sinin sinin nin nun inin unun ini unu ing ings ed ungen ung lich en".split()
STEM = "^(.{3,}?)(" + "|".join(dict.fromkeys(SUFFIXES)) + ")$"


@query("txt_light_stem", f"WITH {words_sql('entity_comments')} SELECT word, regexp_replace(regexp_replace(word, {lit(STEM)}, '\\1'), {lit(STEM)}, '\\1') AS stem, count(*) AS n FROM w GROUP BY 1, 2")
def txt_light_stem(spark, d):
    """Two suffixes off at most, three letters stay at least."""
    once = lambda c: F.regexp_replace(c, STEM, "$1")
    return words(table(spark, d, "entity_comments"), "comment").groupBy("word").agg(F.count("*").alias("n")).select("word", once(once(F.col("word"))).alias("stem"), "n")


STOP = ("the", "and", "was", "for", "with", "bir", "ve", "bu", "da", "de", "der", "die", "das", "und")


@query("txt_tokenize", f"WITH {words_sql('reviews')}, t AS (SELECT id, list_filter(string_split_regex(coalesce({tx.folded_sql('comment')}, ''), {SPLIT}), lambda x: length(x) >= 2 AND x NOT IN ({', '.join(map(lit, STOP))})) AS l FROM reviews), u AS (SELECT id, unnest(l) AS word, generate_subscripts(l, 1) AS p FROM t), e AS (SELECT id, word, 2 * p AS p FROM u UNION ALL SELECT id, regexp_replace(word, {lit(STEM)}, '\\1'), 2 * p + 1 FROM u), g AS (SELECT id, word, min(p) AS p FROM e GROUP BY 1, 2) SELECT id, string_agg(word, ' ' ORDER BY p) AS tokens FROM g GROUP BY 1")
def txt_tokenize(spark, d):
    """Distinct words in order, each followed by its stem; short words and stop words are dropped. NULL and '' give no row."""
    kept = F.filter(tx.words_of(F.coalesce(tx.folded(F.col("comment")), F.lit(""))), lambda w: (F.length(w) >= 2) & ~w.isin(*STOP))
    both = F.array_distinct(F.flatten(F.transform(kept, lambda w: F.array(w, F.regexp_replace(w, STEM, "$1")))))
    return table(spark, d, "reviews").select("id", F.array_join(both, " ").alias("tokens")).where("tokens <> ''")


# Phrases and words of folded Turkish and their English; longer ones are replaced first.
GLOSSARY = {"oda": "room", "odayi": "room", "numarali": "number", "havuz": "pool", "kahvalti": "breakfast", "resepsiyon": "reception", "klima": "air conditioning", "cok": "very", "guzel": "nice", "lezzetli": "delicious", "soguk": "cold", "personel": "staff", "bir daha gelmeyiz": "we won't come again", "yine olsa yine geliriz": "we would come again", "lutfen bunu duzeltin": "please fix this", "baska oda istedik": "we asked for another room", "otel yari bostu": "the hotel was half empty", "mudur nazikce ozur diledi": "the manager apologised kindly", "gece": "night", "gun": "day", "deniz manzarasi": "sea view", "asansor": "lift", "havlular": "towels", "banyonun kapisi": "the bathroom door", "tikaliydi": "was blocked"}
ORDERED = sorted(GLOSSARY.items(), key=lambda kv: (-len(kv[0]), kv[0]))


def glossed_sql(c: str) -> str:
    for k, v in ORDERED:
        c = f"replace({c}, {lit(f' {k} ')}, {lit(f' {v} ')})"
    return c


PADDED = f"' ' || array_to_string(list_filter(string_split_regex({tx.folded_sql('comment')}, '[^\\p{{L}}\\p{{N}}'']+'), lambda x: x <> ''), ' ') || ' '"


@query("txt_translate", f"SELECT id, trim({glossed_sql(PADDED)}) AS text FROM entity_comments WHERE comment IS NOT NULL AND regexp_matches(comment, '[ğşıİ]')")
def txt_translate(spark, d):
    """Turkish comments with the phrases and words of the glossary replaced, the longest first; other words stay."""
    bare = F.array_join(F.filter(F.split(tx.folded(F.col("comment")), r"[^\p{L}\p{N}']+"), lambda x: x != ""), " ")
    c = F.concat(F.lit(" "), bare, F.lit(" "))
    for k, v in ORDERED:
        c = F.replace(c, F.lit(f" {k} "), F.lit(f" {v} "))
    return table(spark, d, "entity_comments").where("comment IS NOT NULL").where(F.col("comment").rlike("[ğşıİ]")).select("id", F.trim(c).alias("text"))


MINED_LEAST, MINED_SHARE = 10, 0.8


@query("lex_merge", f"WITH {words_sql('reviews', key='rating')}, c AS (SELECT word, count(*) AS n, count(*) FILTER (rating >= 4) AS up FROM w WHERE rating IN (1, 2, 4, 5) AND length(word) >= 4 GROUP BY 1), m AS (SELECT word, CASE WHEN up >= {MINED_SHARE} * n THEN 0.5 WHEN up <= {1 - MINED_SHARE:.1f} * n THEN -0.5 END AS weight FROM c WHERE n >= {MINED_LEAST}), b AS (SELECT * FROM {values([(k, v) for k, v in [*hotel.POSITIVE.items(), *((w, -x) for w, x in hotel.NEGATIVE.items())]], 'word, weight')}) SELECT word, CAST(weight AS DOUBLE) AS weight, 'base' AS origin FROM b UNION ALL SELECT word, CAST(weight AS DOUBLE), 'mined' FROM m WHERE weight IS NOT NULL AND word NOT IN (SELECT word FROM b)")
def lex_merge(spark, d):
    """The polarity words and those mined from rated reviews; the written ones keep their weight."""
    base = [(k, v) for k, v in [*hotel.POSITIVE.items(), *((w, -x) for w, x in hotel.NEGATIVE.items())]]
    c = words(table(spark, d, "reviews").where("rating IN (1, 2, 4, 5)"), "comment", "rating").where("length(word) >= 4").groupBy("word").agg(F.count("*").alias("n"), F.count_if(F.col("rating") >= 4).alias("up")).where(f"n >= {MINED_LEAST}")
    m = c.select("word", F.when(F.col("up") >= MINED_SHARE * F.col("n"), 0.5).when(F.col("up") <= round(1 - MINED_SHARE, 1) * F.col("n"), -0.5).alias("weight")).where("weight IS NOT NULL")
    m = m.where(~F.col("word").isin([w for w, _ in base])).withColumn("origin", F.lit("mined"))
    return spark.createDataFrame(base, "word string, weight double").withColumn("origin", F.lit("base")).unionByName(m)


ASPECT_WORDS = sorted({t.strip() for _, _, _, t in hotel.terms() if " " not in t.strip()})
STRONG = sorted([w for w, x in [*hotel.POSITIVE.items(), *hotel.NEGATIVE.items()] if x >= 1.5])
MILD = sorted([w for w, x in [*hotel.POSITIVE.items(), *hotel.NEGATIVE.items()] if x < 1.5])


@query("txt_keywords", f"WITH t AS (SELECT id, list_filter(string_split_regex(coalesce({tx.folded_sql('comment')}, ''), {SPLIT}), lambda x: length(x) >= 3 AND x NOT IN ({', '.join(map(lit, STOP))})) AS l FROM reviews), u AS (SELECT id, unnest(l) AS word, generate_subscripts(l, 1) AS p FROM t), s AS (SELECT id, word, min(p) AS p, count(*) + CASE WHEN word IN ({', '.join(map(lit, ASPECT_WORDS))}) THEN 4 ELSE 0 END + CASE WHEN word IN ({', '.join(map(lit, STRONG))}) THEN 5 WHEN word IN ({', '.join(map(lit, MILD))}) THEN 3 ELSE 0 END AS score FROM u GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, p) AS rn FROM s) SELECT id, string_agg(word, ',' ORDER BY rn) AS keywords FROM r WHERE rn <= 5 GROUP BY 1")
def txt_keywords(spark, d):
    """The five words of the highest score (count, a bonus for words of an aspect, for strong and mild polarity), earlier ones first."""
    kept = F.filter(tx.words_of(F.coalesce(tx.folded(F.col("comment")), F.lit(""))), lambda w: (F.length(w) >= 3) & ~w.isin(*STOP))

    def scored(ws):
        one = lambda w: F.size(F.filter(ws, lambda x: x == w)) + F.when(w.isin(*ASPECT_WORDS), 4).otherwise(0) + F.when(w.isin(*STRONG), 5).when(w.isin(*MILD), 3).otherwise(0)
        return F.transform(F.array_distinct(ws), lambda w: F.struct((-one(w)).alias("s"), F.array_position(ws, w).alias("p"), w.alias("w")))

    r = op.settled(table(spark, d, "reviews").select("id", "comment"), k=kept)
    r = op.settled(r, k=scored(F.col("k")))
    return r.select("id", F.array_join(F.transform(F.slice(F.array_sort("k"), 1, 5), lambda x: x["w"]), ",").alias("keywords")).where("keywords <> ''")


# ---- duplicates
LOWER = "lower(translate({0}, 'İI', 'iı'))"


@query("set_dedupe_hash", f"SELECT substr(sha256({LOWER.format('trim(comment)')}), 1, 16) AS hash, min(row_id) AS row_id FROM scraped_reviews WHERE comment <> '' GROUP BY 1")
def set_dedupe_hash(spark, d):
    """Keep-first by hash of the trimmed text in lower case, over every comment; NULL and '' are left out."""
    k = F.substring(F.sha2(tx.lower_tr(F.trim("comment")), 256), 1, 16)
    return table(spark, d, "scraped_reviews").where("comment <> ''").groupBy(k.alias("hash")).agg(F.min("row_id").alias("row_id"))


@query("set_dedupe_prefix", f"SELECT min(row_id) AS row_id FROM scraped_reviews WHERE trim(comment) <> '' GROUP BY substr({LOWER.format('trim(comment)')}, 1, 300)")
def set_dedupe_prefix(spark, d):
    """Keep-first by the first 300 characters in lower case: the key is the reference's, so the prefix is the feature."""
    k = F.substring(tx.lower_tr(F.trim("comment")), 1, 300)
    return table(spark, d, "scraped_reviews").where(F.trim("comment") != "").groupBy(k.alias("k")).agg(F.min("row_id").alias("row_id")).select("row_id")


@query("set_dedupe_prefix200_anti", f"SELECT row_id FROM scraped_reviews s WHERE batch_no > 0 AND comment <> '' AND NOT EXISTS (SELECT 1 FROM scraped_reviews h WHERE h.batch_no = 0 AND substr({LOWER.format('h.comment')}, 1, 200) = substr({LOWER.format('s.comment')}, 1, 200))")
def set_dedupe_prefix200_anti(spark, d):
    s = table(spark, d, "scraped_reviews").select("row_id", "batch_no", "comment", F.substring(tx.lower_tr(F.col("comment")), 1, 200).alias("k"))
    return s.where("batch_no > 0 AND comment <> ''").join(s.where("batch_no = 0").select("k").distinct(), "k", "left_anti").select("row_id")


@query("set_dedupe_fuzzy", f"""WITH {similarity_sql("(SELECT * FROM scraped_reviews WHERE comment <> '')", 'row_id')}, v AS (SELECT cl.rep, max(coalesce(helpful_count, 0)) AS votes, arg_min(row_id, struct_pack(a := -coalesce(helpful_count, 0), b := row_id)) AS best FROM cl JOIN scraped_reviews s ON s.row_id = cl.id GROUP BY 1),
    lo AS (SELECT CASE WHEN x.votes > y.votes OR x.votes = y.votes AND x.best < y.best THEN y.rep ELSE x.rep END AS rep FROM pr JOIN v x ON x.rep = a JOIN v y ON y.rep = b) SELECT best AS row_id FROM v WHERE rep NOT IN (SELECT rep FROM lo)""")
def set_dedupe_fuzzy(spark, d):
    """Comments kept: of each class of copies and of each pair of similar classes the one of more helpful votes, earlier rows on ties.

    A class goes where a similar one of higher standing exists.
    """
    s = table(spark, d, "scraped_reviews").where("comment <> ''").select("row_id", "comment", F.coalesce("helpful_count", F.lit(0)).alias("votes"))
    rows = sim.hashed(s, "row_id", "comment", "votes")
    t = sim.sketched(rows, sim.word_classes(rows), sim.THRESHOLD)
    path = scratch_path(spark, "classes")
    best = F.min_by(F.struct("id", *sim.SKETCHED, "px"), F.struct(-F.col("votes"), "id"))
    t.groupBy("h").agg(best.alias("x"), F.max("votes").alias("votes")).select("x.*", "votes").write.parquet(path)
    classes = spark.read.parquet(path)
    pairs = sim.similar_pairs(classes, s.select(F.col("row_id").alias("id"), F.col("comment").alias("text")), sim.THRESHOLD)
    v = classes.select("id", "votes")
    ranked = pairs.join(v.select(F.col("id").alias("a"), F.col("votes").alias("va")), "a").join(v.select(F.col("id").alias("b"), F.col("votes").alias("vb")), "b")
    lower = ranked.select(F.when((F.col("va") > F.col("vb")) | (F.col("va") == F.col("vb")) & (F.col("a") < F.col("b")), F.col("b")).otherwise(F.col("a")).alias("id")).distinct()
    return v.join(lower, "id", "left_anti").select(F.col("id").alias("row_id"))


# ---- dates, metrics
UNITS = {"minute": 60, "hour": 3600, "day": 86400, "week": 604800, "month": 2592000, "year": 31536000}
AGO = "^(a|an|[0-9]+) (" + "|".join(UNITS) + ")s? ago$"
SECONDS = "CASE u " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in UNITS.items()) + " END"


@query("dt_relative_range", f"WITH r AS (SELECT DISTINCT lower(trim(date_text)) AS record FROM scraped_reviews WHERE regexp_matches(lower(trim(date_text)), '{AGO}')), p AS (SELECT record, CASE WHEN regexp_extract(record, '{AGO}', 1) IN ('a', 'an') THEN 1 ELSE CAST(regexp_extract(record, '{AGO}', 1) AS BIGINT) END AS n, regexp_extract(record, '{AGO}', 2) AS u FROM r) SELECT record, CAST(n * {SECONDS} AS BIGINT) AS lo_seconds, CAST(CASE WHEN u = 'week' AND n = 4 THEN 2592000 ELSE (n + 1) * {SECONDS} END AS BIGINT) AS hi_seconds FROM p")
def dt_relative_range(spark, d):
    """Age in seconds [lo, hi) of relative dates of six units; four weeks end where a month begins."""
    record = F.lower(F.trim("date_text"))
    r = table(spark, d, "scraped_reviews").where(record.rlike(AGO)).select(record.alias("record")).distinct()
    n = F.regexp_extract("record", AGO, 1)
    r = r.select("record", F.when(n.isin("a", "an"), 1).otherwise(n.try_cast("bigint")).cast("bigint").alias("n"), F.regexp_extract("record", AGO, 2).alias("u"))
    return r.select("record", F.expr(f"CAST(n * {SECONDS} AS BIGINT)").alias("lo_seconds"), F.expr(f"CAST(CASE WHEN u = 'week' AND n = 4 THEN 2592000 ELSE (n + 1) * {SECONDS} END AS BIGINT)").alias("hi_seconds"))


@query("agg_nightly_metrics", ONLY + ", p AS (SELECT review_id, count(*) AS n, count(*) FILTER (lower(aspect) IN ('standard', 'general', 'other')) AS g, count(*) FILTER (sentiment = 'Positive') AS up, count(*) FILTER (sentiment = 'Negative') AS down, sum(len(string_split(text, ' '))) AS words FROM cl GROUP BY 1) SELECT round_even(100.0 * sum(g) / sum(n), 2) AS generic_ratio, round_even(sum(n) / count(*), 3) AS clauses_per_review, round_even(100.0 * count(*) FILTER (n = 1 AND words >= 3) / count(*), 2) AS under_segmented, round_even(100.0 * count(*) FILTER (n >= 2 AND (up = 0 OR down = 0)) / count(*), 2) AS one_sided FROM p")
def agg_nightly_metrics(spark, d):
    s = F.col("sentiment")
    p = domain.clauses(spark, d).groupBy("review_id").agg(F.count("*").alias("n"), F.count_if(F.lower("aspect").isin(*domain.GENERIC_LABELS)).alias("g"), F.count_if(s == "Positive").alias("up"), F.count_if(s == "Negative").alias("down"), F.sum(F.size(F.split("text", " "))).alias("words"))
    share = lambda c: F.bround(100.0 * F.count_if(c) / F.count("*"), 2)
    return p.agg(F.bround(100.0 * F.sum("g") / F.sum("n"), 2).alias("generic_ratio"), F.bround(F.sum("n") / F.count("*"), 3).alias("clauses_per_review"), share((F.col("n") == 1) & (F.col("words") >= 3)).alias("under_segmented"), share((F.col("n") >= 2) & ((F.col("up") == 0) | (F.col("down") == 0))).alias("one_sided"))


EVIDENCE = 5


@query("agg_evidence_by_dept", ONLY + f", e AS (SELECT department, review_id, clause_index, score5, text, row_number() OVER (PARTITION BY department ORDER BY score5, review_id, clause_index, text) AS rn, count(*) OVER (PARTITION BY department) AS n FROM cl WHERE sentiment = 'Negative' AND priority >= 2) SELECT department, max(n) AS n, string_agg(review_id || '/' || clause_index || ' ' || score5 || ' ' || text, '; ' ORDER BY rn) AS evidence FROM e WHERE rn <= {EVIDENCE} GROUP BY 1")
def agg_evidence_by_dept(spark, d):
    """Per department how many clauses stand against it and the five worst of them; the five are a bounded aggregate."""
    e = domain.clauses(spark, d).where("sentiment = 'Negative' AND priority >= 2").select("department", F.struct("score5", "review_id", "clause_index", "text").alias("x"))
    parts = e.groupBy("department", F.pmod(F.col("x.review_id"), F.lit(64)).alias("salt")).agg(F.count("*").alias("n"), F.slice(F.array_sort(F.collect_list("x")), 1, EVIDENCE).alias("k"))
    g = parts.groupBy("department").agg(F.sum("n").alias("n"), F.slice(F.array_sort(F.flatten(F.collect_list("k"))), 1, EVIDENCE).alias("k"))
    line = lambda x: F.concat(x["review_id"].cast("string"), F.lit("/"), x["clause_index"].cast("string"), F.lit(" "), x["score5"].cast("string"), F.lit(" "), x["text"])
    return g.select("department", "n", F.array_join(F.transform("k", line), "; ").alias("evidence"))


# ---- lookups
ACTION = "SELECT review_id, clause_index, category_id, reviewer_id, department, priority FROM cl WHERE sentiment = 'Negative'"


def actions(spark, d) -> DataFrame:
    return domain.clauses(spark, d).where("sentiment = 'Negative'").select("review_id", "clause_index", "category_id", "reviewer_id", "department", "priority")


def least_of(df: DataFrame, column: str) -> DataFrame:
    """The rows of the column's least value, as a join with a one-row aggregate: no job while the plan is built."""
    return df.join(F.broadcast(df.agg(F.min(column).alias(column))), column, "left_semi")


for _name, _column in (("q_actions_by_review", "review_id"), ("q_actions_by_dept", "department"), ("q_actions_by_user", "reviewer_id")):

    @query(_name, ONLY + f", a AS ({ACTION}) SELECT * FROM a WHERE {_column} = (SELECT min({_column}) FROM a)")
    def _actions(spark, d, column=_column):
        return least_of(actions(spark, d), column)


@query("q_aof_by_review", ONLY + " SELECT review_id, clause_index, category_id FROM cl WHERE review_id = (SELECT min(review_id) FROM cl)")
def q_aof_by_review(spark, d):
    return least_of(domain.clauses(spark, d).select("review_id", "clause_index", "category_id"), "review_id")


for _name, _column in (("q_aof_by_type", "aspect"), ("q_aof_by_dept", "department")):

    @query(_name, ONLY + f" SELECT {_column}, review_id, clause_index, category_id, reviewer_id, price FROM cl WHERE {_column} = (SELECT max({_column}) FROM cl) ORDER BY clause_index, review_id, category_id, reviewer_id, price LIMIT 100")
    def _facts(spark, d, column=_column):
        """The first hundred facts of a kind in chain order: the limit is the lookup's."""
        c = domain.clauses(spark, d).select(column, "review_id", "clause_index", "category_id", "reviewer_id", "price")
        top = c.join(F.broadcast(c.agg(F.max(column).alias(column))), column, "left_semi")
        return top.select(*c.columns).orderBy("clause_index", "review_id", "category_id", "reviewer_id", "price").limit(100)


@query("q_complaint_trend_answer", ONLY + ", m AS (SELECT department, year(clause_date) AS y, month(clause_date) AS m, count(*) AS n FROM cl WHERE sentiment = 'Negative' GROUP BY ALL) SELECT department, CAST(y AS INT) AS year, CAST(m AS INT) AS month, n AS complaints, n - lag(n) OVER (PARTITION BY department ORDER BY y, m) AS change, CASE WHEN n > 1.1 * lag(n) OVER (PARTITION BY department ORDER BY y, m) THEN 'rising' WHEN n < 0.9 * lag(n) OVER (PARTITION BY department ORDER BY y, m) THEN 'falling' ELSE 'steady' END AS trend FROM m")
def q_complaint_trend_answer(spark, d):
    """Complaints of each department by month, beside the month before."""
    g = domain.clauses(spark, d).where("sentiment = 'Negative'").groupBy("department", F.year("clause_date").alias("year"), F.month("clause_date").alias("month")).agg(F.count("*").alias("complaints"))
    before = F.lag("complaints").over(W.partitionBy("department").orderBy("year", "month"))  # months: a bounded number a department
    n = F.col("complaints")
    return g.select("department", "year", "month", "complaints", (n - before).alias("change"), F.when(n > 1.1 * before, "rising").when(n < 0.9 * before, "falling").otherwise("steady").alias("trend"))


@query("snk_push_notify", "SELECT event_id, 'group-' || user_id % 10 AS channel FROM events WHERE event_type = 'error'")
def snk_push_notify(spark, d):
    """One message per finished event, scoped to a group, handed over micro-batch by micro-batch; transport is the table of messages."""
    path = scratch_path(spark, "outbox")
    schema = table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{d}/events.parquet*").where("event_type = 'error'").select("event_id", F.concat(F.lit("group-"), (F.col("user_id") % 10).cast("string")).alias("channel"))

    def push(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/messages/batch={batch_id}")  # overwritten when a batch is run again: no message twice

    q = stream.writeStream.foreachBatch(push).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema("event_id bigint, channel string").parquet(f"{path}/messages").select("event_id", "channel")


# ---- retrieval
MAX_TERMS = 5_000
GRAMS = f"k AS (SELECT p_partkey, string_split(lower(p_name || ' ' || p_type || ' ' || p_brand), ' ') AS l FROM part), g AS (SELECT p_partkey, unnest(list_concat(l, list_transform(range(1, len(l)), lambda i: l[i] || ' ' || l[i + 1]))) AS term FROM k)"
INDEX = GRAMS + f", tf AS (SELECT p_partkey, term, count(*) AS tf FROM g GROUP BY 1, 2), df AS (SELECT term, count(*) AS df, sum(tf) AS total FROM tf {{old}} GROUP BY 1 ORDER BY total DESC, term LIMIT {MAX_TERMS}), idf AS (SELECT term, ln((1.0 + (SELECT count(*) FROM part {{old}})) / (1.0 + df)) + 1 AS idf FROM df), raw AS (SELECT p_partkey, term, tf * idf AS w FROM tf JOIN idf USING (term)), tw AS (SELECT p_partkey, term, w / sqrt(sum(w * w) OVER (PARTITION BY p_partkey)) AS w FROM raw)"


def grams(df: DataFrame) -> DataFrame:
    l = F.split(F.lower(F.concat_ws(" ", "p_name", "p_type", "p_brand")), " ")
    return df.select("p_partkey", F.explode(F.concat(l, tx.word_ngrams(l, 2))).alias("term")).groupBy("p_partkey", "term").agg(F.count("*").alias("tf"))


def index(spark, d, old: str = "true") -> DataFrame:
    """(p_partkey, term, w): one- and two-word terms, the most frequent MAX_TERMS of the fitted rows, smoothed idf, length 1."""
    parts = table(spark, d, "part")
    tf, fitted = grams(parts), parts.where(old)
    n = fitted.agg(F.count("*").alias("n"))
    terms = grams(fitted).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total")).orderBy(F.desc("total"), "term").limit(MAX_TERMS)
    idf = terms.join(F.broadcast(n)).select("term", (F.log((1.0 + F.col("n")) / (1.0 + F.col("df"))) + 1).alias("idf"))
    raw = tf.join(F.broadcast(idf), "term").select("p_partkey", "term", (F.col("tf") * F.col("idf")).alias("w"))  # at most MAX_TERMS rows
    norm = raw.groupBy("p_partkey").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, "p_partkey").select("p_partkey", "term", (F.col("w") / F.col("norm")).alias("w"))


@query("ret_tfidf_index", f"WITH {INDEX.format(old='')} SELECT term, count(*) AS documents, round_even(sum(w), 4) AS total FROM tw GROUP BY 1")
def ret_tfidf_index(spark, d):
    return index(spark, d).groupBy("term").agg(F.count("*").alias("documents"), F.bround(F.sum("w"), 4).alias("total"))


@query("ret_index_append", f"WITH {INDEX.format(old='WHERE p_partkey % 10 <> 0')} SELECT p_partkey, count(*) AS terms, round_even(max(w), 6) AS top FROM tw WHERE p_partkey % 10 = 0 GROUP BY 1")
def ret_index_append(spark, d):
    """Rows that come later under the vocabulary and weights fitted before them; here each tenth row is such a row."""
    return index(spark, d, "p_partkey % 10 <> 0").where("p_partkey % 10 = 0").groupBy("p_partkey").agg(F.count("*").alias("terms"), F.bround(F.max("w"), 6).alias("top"))


@query("srt_topk_similarity", f"WITH {INDEX.format(old='')}, q AS (SELECT p_partkey AS q, term, w AS wq FROM tw WHERE p_partkey % 50 = 0), s AS (SELECT q, p_partkey, round(sum(w * wq), 9) AS score FROM q JOIN tw USING (term) WHERE q <> p_partkey GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, p_partkey) AS rank FROM s WHERE score >= 0.001) SELECT q, p_partkey, CAST(rank AS INT) AS rank, round_even(score, 6) AS score FROM r WHERE rank <= 5")
def srt_topk_similarity(spark, d):
    """The five most similar rows of each query row (id divisible by 50), similarities under 0.001 cut off."""
    path = scratch_path(spark, "index")
    index(spark, d).write.parquet(path)
    w = spark.read.parquet(path)
    return rt.cosine_nearest(w, w.where("p_partkey % 50 = 0").select(F.col("p_partkey").alias("q"), "term", "w"), "p_partkey", "q", 5).where("score >= 0.001").select("q", "p_partkey", "rank", F.bround("score", 6).alias("score"))


DIM = 384


@query("ret_cold_embed", f"WITH c AS (SELECT p_partkey, unnest(range(1, length(p_name) + 1)) AS i, p_name FROM part), v AS (SELECT p_partkey, (unicode(substr(p_name, i, 1)) * 31 + i - 1) % {DIM} AS dim, count(*) AS x FROM c GROUP BY 1, 2) SELECT p_partkey, CAST(dim AS INT) AS dim, round_even(x / sqrt(sum(x * x) OVER (PARTITION BY p_partkey)), 6) AS x FROM v")
def ret_cold_embed(spark, d):
    """384 dimensions from characters and their places, length 1; one row per dimension that isn't zero."""
    dims = F.transform(F.sequence(F.lit(1), F.length("p_name")), lambda i: F.pmod(F.ascii(F.substr(F.col("p_name"), i, F.lit(1))) * 31 + i - 1, F.lit(DIM)))
    v = op.settled(table(spark, d, "part").select("p_partkey", "p_name"), dims=dims)
    counted = F.transform(F.array_distinct("dims"), lambda k: F.struct(k.alias("dim"), F.size(F.filter("dims", lambda y: y == k)).cast("double").alias("x")))
    v = op.settled(v.select("p_partkey", "dims"), v=counted)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, y: a + y["x"] * y["x"]))
    return v.select("p_partkey", norm.alias("norm"), F.explode("v").alias("v")).select("p_partkey", "v.dim", F.bround(F.col("v.x") / F.col("norm"), 6).alias("x"))


PROTOTYPES = {o[0]: o[0] + " " + o[2] for o in hotel.OPERATIONS}


@query("ret_nearest_failure", f"WITH {cues_sql('entity_comments')}, pr AS (SELECT label, list_distinct(list_transform(range(1, length(text) - 1), lambda i: substr(text, i, 3))) AS g FROM {values(PROTOTYPES.items(), 'label, text')}), c AS (SELECT id, t, list_distinct(list_transform(range(1, length(folded) - 1), lambda i: substr(folded, i, 3))) AS h FROM f), j AS (SELECT id, label, round(len(list_intersect(g, h)) / len(list_distinct(list_concat(g, h))), 6) AS jaccard FROM c, pr), b AS (SELECT id, arg_max(label, struct_pack(a := jaccard, b := -strpos('{'|'.join(PROTOTYPES)}', label))) AS label, max(jaccard) AS jaccard FROM j GROUP BY 1) SELECT c.id, CASE WHEN x.label IS NOT NULL THEN x.label WHEN b.jaccard >= 0.15 THEN b.label END AS label, CASE WHEN x.label IS NOT NULL THEN 'pattern' WHEN b.jaccard >= 0.15 THEN 'grams' ELSE 'none' END AS stage FROM c JOIN b USING (id) LEFT JOIN (SELECT id, CASE {' '.join(f'WHEN regexp_matches(t, {lit(o[1])}) THEN {lit(o[0])}' for o in hotel.OPERATIONS)} END AS label FROM f) x USING (id)")
def ret_nearest_failure(spark, d):
    """The operational pattern nearest to a comment: an exact pattern, else character 3-grams from 0.15 on, the first of the best."""
    from guestlens.operators.relational import set_jaccard

    rows = op.settled(table(spark, d, "entity_comments").select("id", "comment"), t=op.cue_text(F.col("comment")), h=tx.char_ngrams(F.coalesce(tx.folded(F.col("comment")), F.lit(""))))
    gram = {k: list(dict.fromkeys(t[i : i + 3] for i in range(len(t) - 2))) for k, t in PROTOTYPES.items()}
    each = F.array(*[F.struct((-F.round(set_jaccard(F.array(*map(F.lit, g)), F.col("h")), 6)).alias("neg"), F.lit(i).alias("i"), F.lit(k).alias("label")) for i, (k, g) in enumerate(gram.items())])
    rows = op.settled(rows, best=F.array_min(each), exact=op.first_match(F.col("t"), [(o[0], o[1], o[0]) for o in hotel.OPERATIONS], F.lit(None).cast("string")))
    close = F.col("best.neg") <= -0.15
    return rows.select("id", F.coalesce("exact", F.when(close, F.col("best.label"))).alias("label"), F.when(F.col("exact").isNotNull(), "pattern").when(close, "grams").otherwise("none").alias("stage"))


# ---- summaries
@query("gen_summary_simple", f"WITH s AS (SELECT doc_id, unnest(list_filter(string_split_regex(text, '[.!?\\n]+'), lambda x: trim(x, ' ') <> '')) AS s, generate_subscripts(list_filter(string_split_regex(text, '[.!?\\n]+'), lambda x: trim(x, ' ') <> ''), 1) AS p FROM documents WHERE text IS NOT NULL), f AS (SELECT doc_id, p, trim(s, ' ') AS s, string_split_regex({tx.folded_sql('s')}, {SPLIT}) AS w FROM s), r AS (SELECT doc_id, s, row_number() OVER (PARTITION BY doc_id ORDER BY len(list_intersect(list_distinct(w), [{', '.join(map(lit, sorted(hotel.NEGATIVE)))}])) DESC, p) AS rn FROM f) SELECT doc_id, array_to_string(string_split(s, ' ')[1:22], ' ') AS summary FROM r WHERE rn = 1")
def gen_summary_simple(spark, d):
    """Of each document the sentence with most words of complaint, the first on ties, cut to 22 words."""
    sentences = F.filter(F.split("text", r"[.!?\n]+"), lambda s: F.regexp_replace(s, "^ +| +$", "") != "")
    negative = F.array(*map(F.lit, sorted(hotel.NEGATIVE)))
    n = lambda s: F.size(F.array_intersect(tx.words_of(tx.folded(s)), negative))
    rows = op.settled(table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", "text"), s=sentences).select("doc_id", "s")
    best = F.array_min(F.transform("s", lambda s, i: F.struct((-n(s)).alias("n"), i.alias("i"), s.alias("s"))))["s"]
    return rows.where("size(s) > 0").select("doc_id", F.array_join(F.slice(F.split(F.regexp_replace(best, "^ +| +$", ""), " "), 1, 22), " ").alias("summary"))


@query("gen_exec_summary", ONLY + ", d AS (SELECT department, count(*) AS n, count(*) FILTER (sentiment = 'Negative') AS m FROM cl GROUP BY 1), t AS (SELECT sum(n) AS n, sum(m) AS m, arg_max(department, struct_pack(a := m, b := department)) AS worst, arg_min(department, struct_pack(a := m / n, b := department)) AS best FROM d) SELECT 'Of ' || CAST(n AS BIGINT) || ' clauses ' || CAST(m AS BIGINT) || ' are negative (' || CAST(round_even(100.0 * m / n, 0) AS INT) || ' %). Most complaints: ' || worst || '. Fewest for their number: ' || best || '. ' || CASE WHEN m > 0.4 * n THEN 'Act now.' WHEN m > 0.2 * n THEN 'Watch closely.' ELSE 'In order.' END AS line FROM t")
def gen_exec_summary(spark, d):
    g = domain.clauses(spark, d).groupBy("department").agg(F.count("*").alias("n"), F.count_if(F.col("sentiment") == "Negative").alias("m"))
    g = g.agg(F.sum("n").alias("n"), F.sum("m").alias("m"), F.max_by("department", F.struct("m", "department")).alias("worst"), F.min_by("department", F.struct(F.col("m") / F.col("n"), "department")).alias("best"))
    advice = F.when(F.col("m") > 0.4 * F.col("n"), "Act now.").when(F.col("m") > 0.2 * F.col("n"), "Watch closely.").otherwise("In order.")
    return g.select(F.format_string("Of %d clauses %d are negative (%d %%). Most complaints: %s. Fewest for their number: %s. %s", "n", "m", F.bround(100.0 * F.col("m") / F.col("n")).cast("int"), "worst", "best", advice).alias("line"))


# ---- learning
@query("ml_sgd_retrain")
def ml_sgd_retrain(spark, d):
    """A department model over corrections: base rows weigh 1, corrected ones 3; accuracy on held-out rows before and after, by label.

    Without SQL, as fitting is iterative; rows are held out by a hash of their id.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, HashingTF, NGram, RegexTokenizer, SQLTransformer, StringIndexer

    e = table(spark, d, "entity_comments").where("comment <> '' AND department IS NOT NULL").select("id", "comment", "department")
    e = e.withColumn("corrected", F.pmod(F.xxhash64("id", F.lit(7)), F.lit(4)) == 0).withColumn("held", F.pmod(F.xxhash64("id", F.lit(42)), F.lit(5)) == 0)
    e = e.withColumn("weight", F.when(F.col("corrected"), 3.0).otherwise(1.0))
    stages = [StringIndexer(inputCol="department", outputCol="label", handleInvalid="skip"), RegexTokenizer(inputCol="comment", outputCol="w1", pattern=r"[^\p{L}]+"), NGram(n=2, inputCol="w1", outputCol="w2"), SQLTransformer(statement="SELECT *, concat(w1, w2) AS w FROM __THIS__"), HashingTF(inputCol="w", outputCol="tf", numFeatures=1 << 13), IDF(inputCol="tf", outputCol="x"), LogisticRegression(featuresCol="x", weightCol="weight", maxIter=5, regParam=0.05)]
    train, held = e.where("NOT held"), e.where("held")
    out = None
    for name, rows in (("before", train.where("NOT corrected")), ("after", train)):
        got = Pipeline(stages=stages).fit(rows).transform(held).groupBy("department").agg(F.count("*").alias("n"), F.count_if(F.col("label") == F.col("prediction")).alias("right")).withColumn("model", F.lit(name))
        out = got if out is None else out.unionByName(got)
    return out.select("model", "department", "n", "right")
